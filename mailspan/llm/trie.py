"""Prefix trie of conversations by heavy-path decomposition.

A node is known by an XOR of hashes of its turns, each hashed with its place, so that the nodes of a conversation are running
XORs. The smallest conversation of a node and its depth are the node's id: the nodes of one id lie below one another. The child
that most conversations pass through continues its parent's path; every other child begins a path, and has at most half
of its parent's conversations, so that no more than log2(conversations) paths lie above one another. Sums over subtrees are suffix sums along
paths, after the totals of light paths were attached to the nodes they hang on, from the deepest paths upwards.

Running values (positions, prefixes, suffix sums) are taken in blocks of a bounded length and then over the blocks' totals, so
that one endless conversation or path is no single task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspan.llm._common import arrow_batches, table, written

#: Turns or nodes of a block, conversations of a family and turns that a member of it may take over, ids in one string (a power of 2).
BLOCK, FAMILY, TAKEN, IDS = 1024, 100, 5, 12
EMPTY = hashlib.sha256(b"").hexdigest()

_OVER = {"sum": F.sum, "xor": F.bit_xor, "max": F.max}
_JOINED = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "xor": lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0))), "max": lambda a, b: F.greatest(a, b)}


def running(df: DataFrame, keys: list[str], block: str, order: list[Column | str], **values: tuple[str, Column]) -> DataFrame:
    """`df` with running values (`sum`, `xor` or `max` of a column) over the rows of `keys`, by blocks in ascending order and by `order` inside them."""
    inside = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    above = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(*[_OVER[kind](c).alias(f"_{v}") for v, (kind, c) in values.items()])
    before = totals.select(*keys, block, F.row_number().over(W.partitionBy(*keys).orderBy(block)).alias("_i"), *[_OVER[kind](f"_{v}").over(above).alias(f"_{v}") for v, (kind, _) in values.items()])
    out = df.withColumns({v: _OVER[kind](c).over(inside) for v, (kind, c) in values.items()})
    out = out.join(before.filter("_i > 1").drop("_i"), [*keys, block], "left")
    return out.withColumns({v: _JOINED[kind](F.col(v), F.col(f"_{v}")) for v, (kind, _) in values.items()}).drop(*[f"_{v}" for v in values])


def turns(df: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, t (a digest of the text), len (its code points), in each conversation's order: by turn, null first,
    equal turns by role and digest."""
    text = F.coalesce(df["text"].cast("string"), F.lit(""))
    rows = df.filter(df["conv_id"].isNotNull()).select(df["conv_id"].cast("long").alias("conv_id"), df["turn"].cast("long").alias("turn"), F.coalesce(df["role"].cast("string"), F.lit("")).alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("t"), F.length(text).alias("len"))
    # long conversations are cut at even steps of their turn numbers
    long = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high")).filter(F.col("n") > BLOCK)
    step = F.expr(f"greatest(1D, (cast(high as double) - low + 1) * {BLOCK} / n)")
    cut = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.coalesce(F.floor((F.col("turn").cast("double") - F.col("low")) / step), F.lit(-1)))
    blocks = rows.join(long, "conv_id", "left").withColumn("block", cut.cast("long")).drop("n", "low", "high")
    return running(blocks, ["conv_id"], "block", [F.asc_nulls_first("turn"), "role", "t"], pos=("sum", F.lit(1).cast("long"))).select("conv_id", "pos", "role", "t", "len")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, total) and their turns (conv_id, total, depth, role, t, len), of which the first h are those of the family's first
    conversation: h is a hash of the id."""
    family = F.expr(f"conv_id - conv_id % {FAMILY}")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (TAKEN + 1)).cast("int")
    first = rows.filter(F.col("pos") <= TAKEN).filter(F.expr(f"conv_id % {FAMILY} = 0")).groupBy(F.col("conv_id").alias("family")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "t", "len"))).alias("first"))
    own = rows.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("family", family).withColumn("h", h)
    taken = own.join(first, "family", "left").withColumn("first", F.when(F.col("first").isNull(), F.array().cast(first.schema["first"].dataType)).otherwise(F.slice("first", F.lit(1), F.col("h"))))
    convs = written(taken.withColumn("took", F.size("first")).withColumn("total", (F.col("took") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).cast("long")).select("conv_id", "h", "took", "total", "first"), "conversations")
    a = convs.select("conv_id", "total", F.posexplode("first").alias("i", "x")).select("conv_id", "total", (F.col("i") + 1).cast("long").alias("depth"), "x.role", "x.t", "x.len")
    b = rows.join(convs.drop("first"), "conv_id").filter("pos > h").select("conv_id", "total", (F.col("took") + F.col("pos") - F.col("h")).alias("depth"), "role", "t", "len")
    return convs.select("conv_id", "total"), a.union(b)


def _digests(ends: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256 of (depth, x, y, conv_id): ids are joined in stretches of 4096 numbers, and the stretches of a node go through one
    digest in order, a string at a time. (SHA-256 has no form that could be computed in parts.)"""
    arrow_batches(ends.sparkSession, 200)
    part = F.shiftright("conv_id", IDS).alias("part")
    strings = ends.groupBy("depth", "x", "y", part).agg(F.sort_array(F.collect_list("conv_id")).alias("ids")).select("depth", "x", "y", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    placed = strings.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            done = []
            for depth, x, y, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if (depth, x, y) == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (depth, x, y), hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield _batch(done)
        if node is not None:
            yield _batch([(*node, sha.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "x", "y", "ends_sha256"])

    return placed.mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """conv, depth, parent_conv, light, n_convs, len, n_children, ends_sha256: one row a node."""
    mark = lambda seed: F.xxhash64(F.lit(seed), "depth", "role", "t")
    marked = rows.select("conv_id", "total", "depth", "len", F.expr(f"(depth - 1) div {BLOCK}").alias("block"), mark(1).alias("hx"), mark(2).alias("hy"))
    prefixes = written(running(marked, ["conv_id"], "block", ["depth"], x=("xor", F.col("hx")), y=("xor", F.col("hy"))), "prefixes")
    up = lambda c: F.col(c).bitwiseXOR(F.col(f"h{c}"))
    found = prefixes.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs"), F.min("len").alias("len"), F.min(up("x")).alias("px"), F.min(up("y")).alias("py"))
    zero = F.lit(0).cast("long")
    top = convs.agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv", "n_convs", F.lit(0).alias("len"), zero.alias("px"), zero.alias("py"))
    every = written(found.union(top), "nodes")

    kids = every.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"), (-F.max(F.struct("n_convs", -F.col("conv")))["col2"]).alias("heavy"))
    ends = prefixes.filter("depth = total").select("depth", "x", "y", "conv_id").union(convs.filter("total = 0").select(zero, zero, zero, "conv_id"))
    told = written(every.join(kids, ["depth", "x", "y"], "left").join(_digests(ends), ["depth", "x", "y"], "left"), "nodes")
    root = told.filter("depth = 0").first()
    above = told.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("parent_conv"), F.col("heavy").alias("chosen"))
    columns = ["conv", "depth", "parent_conv", "light", "n_convs", "len", "n_children", "ends_sha256"]
    deep = told.filter("depth > 1").join(above, ["depth", "px", "py"]).withColumn("light", F.col("conv") != F.col("chosen"))
    # the root is one row: its children need no join
    first, heavy = (F.lit(root[c] if root else None).cast("long") for c in ("conv", "heavy"))
    flat = told.filter("depth <= 1").withColumn("parent_conv", F.when(F.col("depth") == 1, first)).withColumn("light", (F.col("depth") == 0) | (F.col("conv") != heavy))
    out = deep.select(*columns).union(flat.select(*columns))
    return out.withColumns({"n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY))})


def with_paths(tree: DataFrame) -> DataFrame:
    """`tree` with the path of each node: the id (path_conv, path_depth) of the path's top node."""
    begins = F.col("light") | (F.col("parent_conv") != F.col("conv"))
    runs = written(running(tree.withColumn("block", F.expr(f"depth div {BLOCK}")), ["conv"], "block", ["depth"], start=("max", F.when(begins, F.col("depth")))).drop("block"), "runs")
    # a run that goes on with the path of a smaller conversation points to the run that it continues: lists, halved in each round
    at = runs.select(F.col("conv").alias("parent_conv"), F.col("depth").alias("d"), F.col("start").alias("to_start"))
    goes = runs.filter("depth = start and not light").select("conv", "start", "parent_conv", (F.col("start") - 1).alias("d")).join(at, ["parent_conv", "d"]).select("conv", "start", F.col("parent_conv").alias("to_conv"), "to_start")
    goes = written(goes, "jumps")
    while True:
        far = goes.select(F.col("conv").alias("to_conv"), F.col("start").alias("to_start"), F.col("to_conv").alias("far_conv"), F.col("to_start").alias("far_start"))
        moved = written(goes.join(far, ["to_conv", "to_start"], "left").select("conv", "start", F.coalesce("far_conv", "to_conv").alias("to_conv"), F.coalesce("far_start", "to_start").alias("to_start"), F.col("far_conv").isNotNull().alias("moved")), "jumps")
        goes = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return runs.join(goes, ["conv", "start"], "left").withColumns({"path_conv": F.coalesce("to_conv", "conv"), "path_depth": F.coalesce("to_start", "start")}).drop("to_conv", "to_start", "start")


def subtree_sums(tree: DataFrame, *values: str) -> DataFrame:
    """`tree` with each of `values` summed over the node's subtree, along heavy paths."""
    pathed = written(with_paths(tree), "paths")
    sums = lambda cs: [F.sum(c).cast("long").alias(c) for c in cs]
    own = pathed.groupBy("path_conv", "path_depth").agg(*sums(values))
    heads = pathed.filter("conv = path_conv and depth = path_depth and depth > 0").select("path_conv", "path_depth", F.col("parent_conv").alias("at_conv"), (F.col("depth") - 1).alias("at_depth"))
    on = pathed.select(F.col("conv").alias("at_conv"), F.col("depth").alias("at_depth"), F.col("path_conv").alias("on_conv"), F.col("path_depth").alias("on_depth"))
    light = written(own.join(heads, ["path_conv", "path_depth"]).join(on, ["at_conv", "at_depth"]), "light")
    # paths by the number of paths above them
    levels, rest = [], light
    over = pathed.filter("depth = 0").select(F.col("path_conv").alias("on_conv"), F.col("path_depth").alias("on_depth"))
    while True:
        level = written(rest.join(over, ["on_conv", "on_depth"], "left_semi"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        over = level.select(F.col("path_conv").alias("on_conv"), F.col("path_depth").alias("on_depth"))
        rest = rest.join(over.toDF("path_conv", "path_depth"), ["path_conv", "path_depth"], "left_anti")
    # totals of whole paths, the deepest first
    hung, below = None, None
    for level in reversed(levels):
        if below is not None:
            more = below.groupBy(F.col("on_conv").alias("path_conv"), F.col("on_depth").alias("path_depth")).agg(*[F.sum(v).cast("long").alias(f"_{v}") for v in values])
            level = written(level.join(more, ["path_conv", "path_depth"], "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).select(*level.columns), "level")
        hung, below = (level if hung is None else hung.unionByName(level)), level
    if hung is not None:
        hangs = hung.groupBy(F.col("at_conv").alias("conv"), F.col("at_depth").alias("depth")).agg(*[F.sum(v).cast("long").alias(f"_{v}") for v in values])
        pathed = written(pathed.join(hangs, ["conv", "depth"], "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop(*[f"_{v}" for v in values]), "attached")
    upwards = pathed.withColumn("block", -F.expr(f"depth div {BLOCK}"))
    return running(upwards, ["path_conv", "path_depth"], "block", [F.desc("depth")], **{f"all_{v}": ("sum", F.col(v)) for v in values})


def conversation_trie(df: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations of `df` (conv_id, turn, role, text): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, whatever else a text holds counts whole; null turns come first, equal turns by role and digest of the text; rows
    without conv_id belong to no conversation; repeated rows are turns of their own. An empty table gives no rows. Other columns of `df` are
    ignored, whatever their names.
    """
    convs, rows = rebuilt(written(turns(df), "turns"))
    tree = nodes(convs, rows).withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "tokens": (F.col("n_convs") - 1) * F.col("len")})
    out = subtree_sums(tree, "leaves", "tokens")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("all_leaves").alias("n_leaves"), F.col("all_tokens").alias("saved_tokens"), "ends_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {
    "op13_prefix_trie": f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS family, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295) % {TAKEN + 1} AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM (
  SELECT c.conv_id, o.role, o.text, o.pos, 0 AS part FROM c JOIN o ON o.conv_id = c.family AND o.pos <= h UNION ALL SELECT conv_id, role, text, pos, 1 FROM o JOIN c USING (conv_id) WHERE pos > h)),
m AS (SELECT conv_id, depth, len, md5(array_to_string(list(t) OVER (PARTITION BY conv_id ORDER BY depth), '')) AS k FROM (SELECT conv_id, depth, length(text) AS len, md5(md5(role) || md5(text)) AS t FROM r)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(len) AS len FROM m GROUP BY depth, k),
p AS (SELECT n.*, q.conv_id AS parent_conv_id, q.k AS parent_k FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN n q ON q.depth = n.depth - 1 AND q.k = m.k),
kids AS (SELECT depth - 1 AS depth, parent_k AS k, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
ends AS (SELECT depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS s FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY depth, k),
t AS (SELECT p.*, coalesce(n_children, 0) AS n_children, coalesce(s, sha256('')) AS ends_sha256 FROM p LEFT JOIN kids USING (depth, k) LEFT JOIN ends USING (depth, k)),
sums AS (SELECT m.depth, m.k, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * t.len)::BIGINT AS saved_tokens FROM t JOIN m ON m.conv_id = t.conv_id AND m.depth <= t.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM t JOIN sums USING (depth, k)"""
}
