"""Conversation prefix trie, rolled up in depth bands.

A node is a distinct beginning of conversations. It is known by two 64-bit numbers: hashes of (depth, digest
of the turn), combined by exclusive or over the turns from the first on, so the beginnings of a
conversation are a running combination, and a long conversation can be worked on in pieces.

Sums over subtrees: depths are cut into bands of ``height``. A node adds its values to its ancestors within its
band only, at most ``height`` rows. What the bands' top nodes have then is the input of the next level, the trie
of those nodes alone with bands ``height`` times as deep, until one band holds all. On the way back each
completed top node hands its total to the nodes above it in the band before. So a trie of depth D takes about
log(D) / log(height) levels, and no level makes more than ``height`` rows of a node.

A conversation of any length is spread over tasks: turns are dealt by ranges of (conversation, turn), numbered
and combined within a range, and what earlier ranges hold comes from one row a conversation and range. Nodes
are grouped with partial sums, so a beginning that a third of all conversations share is one row a task. The
hash over the members that end at a node is made of a stream in order, ``ENDS`` ids a row.

Defined cases: rows without a conversation's id belong to none; turns are ordered by number, null first, and
repeated numbers by the MD5 of role and text; a null role or text is empty; a table without conversations has no rows,
otherwise the root counts them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import settle

HEIGHT = 16
ENDS = 500
KEYS = ["k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, part, place (from 1), digest, chars of every turn; ``part`` is the range it lies in."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said)))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(said).cast("long").alias("chars"))
    # equal rows are told apart by a draw, so that any number of them can be dealt to several ranges
    spread = settle(rows.withColumn("draw", F.rand(7)).repartitionByRange("conv", "turn", "digest", "draw").withColumn("part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return settle(spread.withColumn("local", local).join(offsets, ["conv", "part"])
                  .select("conv", "part", (F.col("local") + F.col("earlier")).alias("place"), "digest", "chars"))


def rebuilt(turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their group's first one.

    Conversation c takes the first h = crc32(c) % (most + 1) turns of c - c % group, then its own after its first h.
    The rows (conv, part, depth, digest, chars, ends) and all conversations (conv, size); a part of -1 is what was taken.
    """
    pieces = turns.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    convs = pieces.groupBy("conv").agg(F.sum("n").alias("n")) \
        .withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).withColumn("base", F.col("conv") - F.col("conv") % group)
    heads = turns.where((F.col("conv") % group == 0) & (F.col("place") <= most)) \
        .groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("head"))
    taken = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", F.lit(1), F.greatest(F.col("h"), F.lit(1)).cast("int"))).otherwise(
        F.slice(F.coalesce(F.col("head"), F.array().cast("array<struct<place:bigint,digest:binary,chars:bigint>>")), 1, 0))
    plans = settle(convs.join(heads, "base", "left").withColumn("head", taken).withColumn("k", F.size("head").cast("long"))
                   .withColumn("size", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv", "h", "k", "size", "head"))
    first = plans.select("conv", "size", F.explode("head").alias("t")).select(
        "conv", F.lit(-1).alias("part"), F.col("t.place").alias("depth"), "t.digest", "t.chars", "size")
    # one row a conversation and range, so a long conversation meets its plan range by range
    marked = pieces.select("conv", "part").join(plans.drop("head"), "conv")
    own = turns.join(marked, ["conv", "part"]).where(F.col("place") > F.col("h")).select(
        "conv", "part", (F.col("k") + F.col("place") - F.col("h")).alias("depth"), "digest", "chars", "size")
    return first.union(own), plans.select("conv", "size")


def paths(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, depth, k1, k2 (the node), p1, p2 (its parent), chars, ends (whether the conversation ends here), also for the root."""
    at = settle(rows.withColumn("x1", F.xxhash64("depth", "digest")).withColumn("x2", F.xxhash64(F.lit("second"), "digest", "depth")).drop("digest"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = at.groupBy("conv", "part").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    carry = whole.select("conv", "part", *[F.coalesce(F.bit_xor(f"t{i}").over(before), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    run = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    found = at.withColumn("r1", F.bit_xor("x1").over(run)).withColumn("r2", F.bit_xor("x2").over(run)).join(carry, ["conv", "part"])
    k1, k2 = F.col("r1").bitwiseXOR(F.col("c1")), F.col("r2").bitwiseXOR(F.col("c2"))
    nodes = found.select("conv", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("x1")).alias("p1"), k2.bitwiseXOR(F.col("x2")).alias("p2"),
                         "chars", (F.col("depth") == F.col("size")).alias("ends"))
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"),
                        (F.col("size") == 0).alias("ends"))
    return settle(nodes.union(root))


def subtree_sums(nodes: DataFrame, at: DataFrame, values: list[str], deepest: int, height: int, step: int = 1) -> DataFrame:
    """k1, k2 and the sums of values over each node's subtree, for nodes (k1, k2, conv, depth, values) in depths that ``step`` divides.

    ``conv`` is one member of the node and ``at`` has that member's beginnings."""
    band = step * height
    way = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    lists = at.where(F.col("depth") % step == 0).select("conv", "depth", F.floor(F.col("depth") / band).alias("band"), F.struct(*KEYS).alias("k")) \
        .select("conv", "depth", F.collect_list("k").over(way).alias("above"))
    tree = nodes.join(lists, ["conv", "depth"])
    last = deepest < band
    tree = tree if last else settle(tree)

    def up(rows: DataFrame) -> DataFrame:
        spread = rows.select(F.explode("above").alias("a"), *values).select("a.k1", "a.k2", *values)
        return spread.groupBy(*KEYS).agg(*[F.sum(v).alias(v) for v in values])

    within = settle(up(tree))
    if last:
        return within
    tops = settle(nodes.where(F.col("depth") % band == 0).drop(*values).join(within, KEYS))
    totals = subtree_sums(tops, at, values, deepest, height, band)
    done = tops.where("depth > 0").drop(*values).join(totals, KEYS).select("conv", (F.col("depth") - step).alias("depth"), *values)
    parents = done.join(at.select("conv", "depth", *KEYS), ["conv", "depth"]).groupBy(*KEYS).agg(*[F.sum(v).alias(v) for v in values])
    handed = up(parents.join(tree.select(*KEYS, "above"), KEYS))
    return settle(within.union(handed.select(within.columns)).groupBy(*KEYS).agg(*[F.sum(v).alias(v) for v in values]))


def end_hashes(at: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: over the ids of conversations that end at a node, ascending and comma-joined."""
    lot = F.col("conv") - F.pmod("conv", F.lit(ENDS))
    lots = at.where("ends").groupBy(*KEYS, lot.alias("lot")).agg(F.sort_array(F.collect_list("conv")).alias("ids")) \
        .select(*KEYS, "lot", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEYS, "ends_sha256"]
        node, found = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch.column(n).to_pylist() for n in ("k1", "k2", "ids"))):
                if (k1, k2) == node:
                    found.update(b",")
                else:
                    if node is not None:
                        out.append((*node, found.hexdigest()))
                    node, found = (k1, k2), hashlib.sha256()
                found.update(ids.encode())
            yield made(out, names)
        if node is not None:
            yield made([(*node, found.hexdigest())], names)

    def made(out: list[tuple], names: list[str]) -> pa.RecordBatch:
        columns = zip(*out) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=names)

    return lots.repartition(*KEYS).sortWithinPartitions(*KEYS, "lot").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, k1, k2."""
    at = paths(rows, convs)
    nodes = at.groupBy(*KEYS, "depth").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
                                           F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = settle(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    known = settle(nodes.join(children, KEYS, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    values = known.select(*KEYS, "conv", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    deepest = known.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(values, at, ["n_leaves", "saved_tokens"], deepest, height)
    whole = settle(known.join(sums, KEYS).join(end_hashes(at), KEYS, "left"))
    # a parent may have any number of children: the children's side is the one that adaptive execution splits
    parents = whole.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    return whole.join(parents, ["p1", "p2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), *KEYS)


TRIE_SQL = """
WITH said AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda d: [ord(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT c FROM said)),
taken AS (SELECT convs.c, place, role, text FROM convs JOIN said ON said.c = convs.c - convs.c % 100 AND place <= h),
own AS (SELECT convs.c, place - h + coalesce(k, 0) AS place, role, text FROM convs JOIN said ON said.c = convs.c AND place > h
    LEFT JOIN (SELECT c, count(*) AS k FROM taken GROUP BY c) AS t ON t.c = convs.c),
built AS (SELECT * FROM taken UNION ALL SELECT * FROM own),
paths AS (SELECT c, place AS d, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY place) AS node, length(text) AS chars FROM built
    UNION ALL SELECT c, 0, [], 0 FROM convs),
ended AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
nodes AS (SELECT node, d, min(c) AS c, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY node, d),
linked AS (SELECT nodes.*, paths.node AS parent FROM nodes LEFT JOIN paths ON paths.c = nodes.c AND paths.d = nodes.d - 1),
counted AS (SELECT linked.*, coalesce(n, 0) AS n_children FROM linked LEFT JOIN (SELECT parent, count(*) AS n FROM linked GROUP BY parent) AS k ON k.parent = linked.node),
sums AS (SELECT paths.node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * counted.chars) AS saved
    FROM counted JOIN paths ON paths.c = counted.c AND paths.d <= counted.d GROUP BY paths.node),
ends AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM paths JOIN ended USING (c, d) GROUP BY node)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, p.c AS parent_conv_id, n.n_convs, n.n_children, sums.n_leaves::BIGINT AS n_leaves,
    sums.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted AS n JOIN sums ON sums.node = n.node LEFT JOIN nodes AS p ON p.node = n.parent LEFT JOIN ends ON ends.node = n.node
"""
