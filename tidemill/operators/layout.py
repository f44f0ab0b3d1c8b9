"""How a time series is laid out over tasks.

A series on a calendar grid is bounded by the grid (a century of weeks is about 5,200 rows), so an
ordinary window per series is the right plan. Raw readings have no such bound: one series may hold
a third of all rows. Operators that take ``max_rows`` then cut every series longer than that into
equal-depth pieces of time and work per piece:

* look-back / look-ahead windows get the rows they need from the neighbouring blocks (`with_neighbours`);
* running values take the total of all earlier pieces from a small table (`running`, `fill`).

Both give exactly the rows of the ordinary window. Rows of a series must be told apart by the order
columns. The first of them sets the cut; a time that alone holds several pieces' rows is a piece of its own
and is cut again by the columns after it, and so on through the whole key. (Text is cut by its first seven
bytes, and rows equal in those stay together.) A cut makes at most ``FAN`` pieces; those still longer than
``max_rows`` are cut again in the same way, so no row meets more than ``FAN`` cut points at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import settle

PIECE, POS, LEN, BLOCK = "_piece", "_pos", "_len", "_block"

BROADCAST_BYTES = 64 * 1024 * 1024
FAN = 256


def names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def series_window(s: Sequence[str], o: str | Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*s).orderBy(*[F.col(c).asc_nulls_last() for c in names(o)])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also pairs null keys; keeps the left keys and the right non-keys."""
    marked = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                          *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(marked[f"_r_{k}"]) for k in keys])
    return left.join(marked, on, how).drop(*[f"_r_{k}" for k in keys])


def complete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without nulls, one test a column.

    ``dropna`` puts all columns into one expression; where the columns are renamed later, Catalyst
    derives a constraint for every subset of them, which on wide feature frames never ends.
    """
    tests = [F.col(f"`{c}`").isNotNull() for c in (df.columns if cols is None else cols)]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def long_series(df: DataFrame, s: Sequence[str], max_rows: int) -> DataFrame:
    """Series holding more than ``max_rows`` rows; at most ``rows / max_rows`` of them exist."""
    return df.groupBy(*s).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)


@dataclass(frozen=True)
class CutPoints:
    """Split points of the long series: settled, so every use cuts the same way.

    May be passed for ``max_rows`` to operators that run one after the other on the same series.
    """

    max_rows: int
    points: DataFrame | None
    # Pieces of each long series, and how many long series there are.
    pieces: int = 1
    series: int = 0
    # How pieces of a single time are cut by the rest of the key, where any is too long.
    rest: CutPoints | None = None
    # How pieces between two points are cut again by the whole key, where any is too long.
    finer: CutPoints | None = None

    @property
    def width(self) -> int:
        """Numbers a piece's parts may take."""
        return max([1, *[p.span for p in (self.rest, self.finer) if p]])

    @property
    def span(self) -> int:
        """Numbers all pieces of a series may take: times between two points, times on a point, no time."""
        return (2 * self.pieces + 1) * self.width

    @property
    def rows(self) -> int:
        """A bound of the pieces of all long series together."""
        inner = sum(p.rows for p in (self.rest, self.finer) if p)
        return self.series * (2 * self.pieces + 1) + inner


def row_bytes(kind: T.DataType) -> int:
    """A cautious size of one value: text and lists count as long ones."""
    if isinstance(kind, T.StructType):
        return sum(row_bytes(f.dataType) for f in kind.fields) + 16
    return 1024 if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) else 16


def fits_broadcast(rows: int, kind: T.DataType) -> bool:
    return rows * row_bytes(kind) <= BROADCAST_BYTES


@dataclass(frozen=True)
class Cut:
    """Rows with ``_piece`` (-1 for ordinary series), and how many pieces all long series have together."""

    df: DataFrame
    rows: int

    def attach(self, table: DataFrame, s: Sequence[str]) -> DataFrame:
        """Left join of a per-piece table of the long series, broadcast where its rows' real width allows."""
        return join_null_safe(self.df, F.broadcast(table) if fits_broadcast(self.rows, table.schema) else table, [*s, PIECE], "left")

    def per_piece(self, s: Sequence[str], *aggs: Column) -> DataFrame:
        return self.df.filter(F.col(PIECE) >= 0).groupBy(*s, PIECE).agg(*aggs)


def _axis(df: DataFrame, col: str) -> Column:
    """A column that percentiles can be taken of, in the order of ``col``."""
    if not isinstance(df.schema[col].dataType, T.StringType):
        return F.col(col)
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(col), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")


def plan_cut(df: DataFrame, s: Sequence[str], o: str | Sequence[str], max_rows: int) -> CutPoints:
    """Find the long series and the keys that split them into about equally many rows.

    The longest series sets the number of pieces: its rows over ``max_rows``, ``FAN`` at a time."""
    first, *others = names(o)
    hot = settle(long_series(df, s, max_rows))
    n_hot, longest = hot.agg(F.count(F.lit(1)), F.max("_n")).first()
    if n_hot == 0:
        return CutPoints(max_rows, None)
    wanted = ceil(longest / max_rows)
    pieces = min(wanted, FAN)
    hot_rows = join_null_safe(df.select(*s, *names(o)), F.broadcast(hot) if fits_broadcast(n_hot, hot.schema) else hot, s)
    levels = [i / pieces for i in range(1, max(pieces, 2))]
    keyed = hot_rows.withColumn("_key", _axis(df, first))
    points = settle(keyed.groupBy(*s).agg(
        F.coalesce(F.percentile_approx("_key", levels, 10 * pieces), F.array()).alias("_points"),
        F.count_if(F.col("_key").isNull()).alias("_nulls")))
    plan = CutPoints(max_rows, points.drop("_nulls"), pieces, n_hot)
    text = isinstance(df.schema[first].dataType, T.StringType)
    place = _place_name(s)
    placed = _place(hot_rows.drop("_n"), s, first, plan, place)
    here = [*s, place]
    rest = finer = None
    repeated = F.size(F.array_distinct("_points")) < F.size("_points")
    if others and not text and (wanted > FAN or not points.filter(repeated | (F.col("_nulls") > max_rows)).isEmpty()):
        rest = plan_cut(placed.filter("_on_point").select(*here, *others), here, others, max_rows)
    if wanted > FAN:
        finer = plan_cut(placed.filter("NOT _on_point").select(*here, *names(o)), here, o, max_rows)
    return replace(plan, **{k: p for k, p in (("rest", rest), ("finer", finer)) if p is not None and p.points is not None})


def _place_name(s: Sequence[str]) -> str:
    """A name for each depth of the cut."""
    return f"_place{sum(c.startswith('_place') for c in s)}"


def _place(df: DataFrame, s: Sequence[str], first: str, plan: CutPoints, out: str) -> DataFrame:
    """Add ``out``, the place among the points (-1 for ordinary series), and whether the row lies on one."""
    small = plan.series * plan.pieces * 16 <= BROADCAST_BYTES
    joined = join_null_safe(df, F.broadcast(plan.points) if small else plan.points, s, "left")
    value, pts = _axis(df, first), F.col("_points")
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, plan.pieces.bit_length())))])
    passed = F.aggregate(strides, F.lit(0), lambda found, stride: found + F.when(
        F.coalesce(F.get(pts, found + stride - 1) <= value, F.lit(False)), stride).otherwise(F.lit(0)))
    on_point = value.isNull() | F.coalesce(F.get(pts, F.col("_passed") - 1) == value, F.lit(False))
    outer = F.when(pts.isNull(), -1).when(value.isNull(), 2 * plan.pieces) \
        .otherwise(2 * F.col("_passed") - F.when(on_point, 1).otherwise(0))
    return joined.withColumn("_passed", passed).withColumns({out: outer.cast("long"), "_on_point": pts.isNotNull() & on_point}) \
        .drop("_points", "_passed")


def cut_series(df: DataFrame, s: Sequence[str], o: str | Sequence[str], max_rows: int | CutPoints) -> Cut:
    """Cut long series into increasing pieces of the order key: a binary search for each row's piece."""
    plan = max_rows if isinstance(max_rows, CutPoints) else plan_cut(df, s, o, max_rows)
    if plan.points is None:
        return Cut(df.withColumn(PIECE, F.lit(-1).cast("long")), 0)
    first, *others = names(o)
    if plan.rest is None and plan.finer is None:
        return Cut(_place(df, s, first, plan, PIECE).drop("_on_point"), plan.rows)
    place = _place_name(s)
    out, within = _place(df, s, first, plan, place).drop("_on_point"), []
    for inner, key in ((plan.rest, others), (plan.finer, names(o))):
        if inner is not None:
            within.append(f"_in{len(within)}{place}")
            out = cut_series(out, [*s, place], key, inner).df.withColumnRenamed(PIECE, within[-1])
    piece = F.when(F.col(place) < 0, F.col(place)).otherwise(F.col(place) * plan.width + F.greatest(F.lit(0), *within))
    return Cut(out.withColumn(PIECE, piece).drop(place, *within), plan.rows)


def _piece_window(s: Sequence[str], start: int, end: int) -> WindowSpec:
    return Window.partitionBy(*s).orderBy(PIECE).rowsBetween(start, end)


def number_rows(df: DataFrame, s: Sequence[str], o: str | Sequence[str], max_rows: int | CutPoints | None = None) -> DataFrame:
    """Add ``_pos`` (0-based place in the series) and ``_len`` (rows in the series)."""
    if max_rows is None:
        return df.withColumns({
            POS: F.row_number().over(series_window(s, o)) - 1,
            LEN: F.count(F.lit(1)).over(Window.partitionBy(*s)),
        })
    cut = cut_series(df, s, o, max_rows)
    offsets = cut.per_piece(s, F.count(F.lit(1)).alias("_n")).select(
        *s, PIECE,
        F.coalesce(F.sum("_n").over(_piece_window(s, Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*s)).alias("_all"),
    )
    here = [*s, PIECE]
    return cut.attach(offsets, s).withColumns({
        POS: F.row_number().over(series_window(here, o)) - 1 + F.coalesce(F.col("_off"), F.lit(0)),
        LEN: F.coalesce(F.col("_all"), F.count(F.lit(1)).over(Window.partitionBy(*here))),
    }).drop("_off", "_all", PIECE)


@dataclass(frozen=True)
class Neighbourhood:
    """What a windowed expression may use: the window, the place in the series, its length."""

    window: WindowSpec
    pos: Column
    length: Column


def with_neighbours(
    df: DataFrame,
    s: Sequence[str],
    o: str | Sequence[str],
    back: int,
    ahead: int,
    build: Callable[[Neighbourhood], dict[str, Column]],
    max_rows: int | CutPoints | None = None,
) -> DataFrame:
    """Add columns that look at most ``back`` rows back and ``ahead`` rows on.

    All columns come from one ``select`` over one window, so they share one exchange and sort.
    """
    if max_rows is None:
        w = series_window(s, o)
        near = Neighbourhood(w, F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(*s)))
        return _add(df, build(near))
    limit = max_rows.max_rows if isinstance(max_rows, CutPoints) else max_rows
    rows = max(limit, back + ahead + 1)
    numbered = number_rows(df, s, o, max_rows)
    own = F.floor(F.col(POS) / rows)
    first = F.floor(F.greatest(F.col(POS) - ahead, F.lit(0)) / rows)
    last = F.floor(F.least(F.col(POS) + back, F.col(LEN) - 1) / rows)
    # A row goes to its own block and to the blocks that can see it; the share of copies
    # is (back + ahead) / rows.
    spread = numbered.withColumn(BLOCK, F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*s, BLOCK).orderBy(POS)
    near = Neighbourhood(w, F.col(POS), F.col(LEN))
    built = _add(spread, build(near))
    return built.filter(F.col(BLOCK) == own).drop(BLOCK, POS, LEN)


def _add(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*kept, *[c.alias(n) for n, c in cols.items()])


def running(
    df: DataFrame,
    s: Sequence[str],
    o: str | Sequence[str],
    sums: dict[str, Column],
    max_rows: int | CutPoints | None = None,
) -> DataFrame:
    """Add running totals (current row included) of the given columns."""
    if max_rows is None:
        w = series_window(s, o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return _add(df, {n: F.sum(c).over(w) for n, c in sums.items()})
    cut = cut_series(df, s, o, max_rows)
    totals = cut.per_piece(s, *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = _piece_window(s, Window.unboundedPreceding, -1)
    carried = totals.select(*s, PIECE, *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums])
    w = series_window([*s, PIECE], o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    for n, c in sums.items():
        here, carry = F.sum(c).over(w), F.col(f"_c_{n}")
        out[n] = F.coalesce(here + carry, here, carry)
    return _add(cut.attach(carried, s), out).drop(PIECE, *[f"_c_{n}" for n in sums])


def fill(
    df: DataFrame,
    s: Sequence[str],
    o: str | Sequence[str],
    values: dict[str, Column],
    forward: bool = True,
    max_rows: int | CutPoints | None = None,
) -> DataFrame:
    """Add, per value, the nearest non-null at or before (``forward``) or at or after the row."""
    pick = F.last if forward else F.first
    frame = (Window.unboundedPreceding, 0) if forward else (0, Window.unboundedFollowing)
    if max_rows is None:
        w = series_window(s, o).rowsBetween(*frame)
        return _add(df, {n: pick(c, ignorenulls=True).over(w) for n, c in values.items()})
    cut = cut_series(df, s, o, max_rows)
    # Null order values sort last in the window; the flags make the struct sort the same way.
    rank = F.struct(*[x for c in names(o) for x in (F.col(c).isNull(), F.col(c))])
    edge = F.max_by if forward else F.min_by
    ends = cut.per_piece(s, *[edge(c, F.when(c.isNotNull(), rank)).alias(f"_t_{n}") for n, c in values.items()])
    side = _piece_window(s, Window.unboundedPreceding, -1) if forward else _piece_window(s, 1, Window.unboundedFollowing)
    carried = ends.select(*s, PIECE, *[pick(f"_t_{n}", ignorenulls=True).over(side).alias(f"_c_{n}") for n in values])
    w = series_window([*s, PIECE], o).rowsBetween(*frame)
    out = {n: F.coalesce(pick(c, ignorenulls=True).over(w), F.col(f"_c_{n}")) for n, c in values.items()}
    return _add(cut.attach(carried, s), out).drop(PIECE, *[f"_c_{n}" for n in values])


def fill_forward(df, s, o, values, max_rows=None):
    return fill(df, s, o, values, True, max_rows)


def fill_backward(df, s, o, values, max_rows=None):
    return fill(df, s, o, values, False, max_rows)
