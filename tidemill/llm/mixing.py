"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source asks for its weight's share of all words. A source may be repeated ``max_epochs`` times
at most; what it cannot give is shared among the others by weight, until none is above its cap. That
fixed point is ``min(cap, level * weight)`` for one water level, which is found from running sums over
the sources in the order in which they fill up, one row a source.

A rate of 2.3 takes each document twice and three tenths of them once more. The extra ones are chosen
systematically: documents of a source are ordered by size within seeded cells, and every 1/0.3-th is
taken from a seeded start; what that misses of the cell's share is made up by turning over its smallest
documents. So the words taken stay within a small document per cell of the target instead of drifting
as independent draws would. Cells hold about ``cell_rows`` documents, so a source
with a third of all rows is dealt to many tasks.

Defined cases: a null or blank text has size 0 and is taken 0 times (0 words); a null source is a
source of its own, last in order; a row is drawn by its id and its text, so rows without an id are dealt
like all others, and of rows that share an id a rerun takes the same texts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import settle

# The characters that separate words.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(text.isNull() | (inner == ""), F.lit(0)).otherwise(F.size(F.split(inner, BLANK_RUN))).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts; the same on every run and in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row a source: _source, source_size, n_docs, target. Weights repeat in code point order, null last."""
    per = sizes.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    ranked = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")) \
        .withColumn("cap", F.col("source_size") * max_epochs)
    fills = F.col("cap") / F.col("weight")
    order = Window.orderBy(fills, F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(after)).withColumn("place", F.row_number().over(order)) \
        .withColumn("open", fills >= F.col("level"))
    level = F.min_by(F.col("level"), F.when(F.col("open"), F.col("place"))).over(everything)
    return levels.select("_source", "source_size", "n_docs",
                         F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, row: list[str], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", cell_rows: int = 2_000) -> DataFrame:
    """Columns: row (a struct of the named columns), size, source_size, target, times, taken."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"), F.col(id_col).cast("string").alias("_id"),
                        F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"),
                        F.coalesce(F.md5(F.col(text_col)), F.lit("")).alias("_mark"))
    sizes = settle(keyed.select("_source", "size"))
    targets = settle(source_targets(sizes, "_source", "size", weights, max_epochs))
    key = F.coalesce(F.col("_id"), F.lit(""))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    cells = F.ceil(F.col("n_docs") / cell_rows)
    joined = keyed.withColumnRenamed("_source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("_source")))
    celled = joined.withColumn("rate", rate).withColumn("draw", uniform(F.lit(seed), key, F.col("_mark"))) \
        .withColumn("cell", F.floor(F.col("draw") * cells))
    within = Window.partitionBy("_s", "cell").orderBy(F.col("size").desc(), "draw", "_id", "_mark")
    part = F.col("rate") - F.floor("rate")
    start = uniform(F.lit(seed), F.coalesce(F.col("_s"), F.lit("")), F.col("cell").cast("string"))
    chosen = F.floor(F.col("nth") * F.col("part") + F.col("start")) - F.floor((F.col("nth") - 1) * F.col("part") + F.col("start"))
    cell = Window.partitionBy("_s", "cell")
    ranked = celled.withColumn("part", F.when(F.col("size") > 0, part).otherwise(F.lit(0.0))).withColumn("start", start) \
        .withColumn("nth", F.row_number().over(within)).withColumn("first", chosen)
    # what the choice misses of the cell's share is made up by turning over its smallest documents
    missed = ranked.withColumn("gap", F.sum("size").over(cell) * part - F.sum(F.col("size") * F.col("first")).over(cell))
    able = F.col("first") == F.when(F.col("gap") > 0, 0).otherwise(1)
    ready = missed.withColumn("able", able & (F.col("part") > 0))
    smallest = Window.partitionBy("_s", "cell", "able").orderBy("size", "draw", "_id", "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = ready.withColumn("turn", F.col("able") & (F.sum("size").over(smallest) <= F.abs("gap")))
    extra = F.when(F.col("turn"), 1 - F.col("first")).otherwise(F.col("first"))
    times = F.when(F.col("size") > 0, F.floor("rate") + extra).otherwise(F.lit(0))
    return turned.withColumn("times", times.cast("long")) \
        .select("row", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as many times as it is taken."""
    return mixed.where("times > 0").select(F.explode(F.array_repeat("row", F.col("times").cast("int"))).alias("row")).select("row.*")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(md5(text), '') AS mark, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source AS s, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY s ASC NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 3 AS cap
  FROM per),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, s ASC NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY cap / weight, s ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
         row_number() OVER (ORDER BY cap / weight, s ASC NULLS LAST) AS place
  FROM ranked),
targets AS (
  SELECT s, source_size, n_docs, least(CAST(cap AS DOUBLE),
         (SELECT arg_min(level, place) FROM levels WHERE cap / weight >= level) * weight) AS target FROM levels),
celled AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || d.mark), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS draw,
         ceil(t.n_docs / 2000) AS cells
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.s),
placed AS (
  SELECT *, CAST(floor(draw * cells) AS BIGINT) AS cell FROM celled),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, cell ORDER BY size DESC, draw, doc_id, mark) AS nth,
         CASE WHEN size > 0 THEN rate - floor(rate) ELSE 0.0 END AS part,
         CAST(CAST('0x' || substr(md5('mix|' || coalesce(source, '') || '|' || CAST(cell AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS start
  FROM placed),
chosen AS (
  SELECT *, CAST(floor(nth * part + start) - floor((nth - 1) * part + start) AS BIGINT) AS pick FROM numbered),
missed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source, cell) AS DOUBLE) * (rate - floor(rate)) - sum(size * pick) OVER (PARTITION BY source, cell) AS gap FROM chosen),
ready AS (
  SELECT *, pick = CASE WHEN gap > 0 THEN 0 ELSE 1 END AND part > 0 AS able FROM missed),
turned AS (
  SELECT *, able AND sum(size) OVER (PARTITION BY source, cell, able ORDER BY size, draw, doc_id, mark
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= abs(gap) AS turn FROM ready)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN size * (floor(rate) + CASE WHEN turn THEN 1 - pick ELSE pick END) ELSE 0 END AS BIGINT) AS taken
FROM turned
"""
