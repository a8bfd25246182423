"""Prefix trie of conversations by preorder intervals.

Conversations are rebuilt as rows (conversation, depth, digest of a turn); texts stay in the scan.  A node is a distinct sequence of
turns: its key is a hash of its depth and of sums, along the conversation, of hashes of (digest, place), which are
distributed prefix sums.  Nodes are grouped by key with partial aggregation, so a first turn of a third of all conversations is a row for each task.

Preorder: in blocks of BLOCK turns a node's label is the list of digests from the block's beginning on, and labels are compared
below the same node at the block's beginning only.  While there are deeper nodes, labels become ranks (a range-partitioned sort)
and blocks are joined in pairs, a node's label then being the rank of the node at the first block's end and its own; so a depth of d takes
log2(d / BLOCK) rounds, and none in usual chats.  Nodes are then numbered by label.  A subtree's last node is an end of some conversation in it, so
it is the largest number among the ends of the node's members.  Leaves and savings of a subtree are differences of prefix sums over the numbers.

No window or group holds a whole conversation or all conversations of a node: prefix sums run in blocks and then over blocks; places come from one
numbering of all rows; ends of a node are sorted by range, a partition hashes its own nodes, and what a node has in several partitions goes, as text,
through one digest in order, a row for each partition.

Defined results: null role or text is empty; turns that are equal in their place go by the digest of role and text, so repeated rows are turns of their own; rows
without conv_id belong to no conversation; % keeps the sign of conv_id; an empty table has no node, not even a root;
texts of any length are digested in the scan; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import numbered
from .tables import cut, joined_by_weight, narrow_batches, partitions, table

GROUP, HEADS = 5, 9
#: Turns of a label before ranks take their place.
BLOCK = 32
#: Rows of a window of running sums.
STRETCH = 1 << 12
SUM = "decimal(38,0)"


def running(rows: DataFrame, by: list[str], at: str, values: list[str], sizes: tuple[int, ...] = (STRETCH, STRETCH)) -> DataFrame:
    """rows with <value>_upto, the sum of the value over the rows of by from at = 0 to here: within stretches, and then over the stretches before."""
    block = f"{at}_"
    own = Window.partitionBy(*by, block).orderBy(at)
    cut_up = rows.withColumn(block, F.floor(F.col(at) / sizes[0]).cast("long"))
    inner = cut_up.withColumns({f"{v}_upto": F.sum(v).over(own) for v in values})
    totals = cut_up.groupBy(*by, block).agg(*[F.sum(v).alias(v) for v in values])
    if len(sizes) > 1:
        whole = running(totals, by, block, values, sizes[1:])
    else:  # one row for each sizes[0] * sizes[1] * ... rows
        over = Window.partitionBy(*by).orderBy(block)
        whole = totals.withColumns({f"{v}_upto": F.sum(v).over(over) for v in values})
    before = whole.select(*by, block, *[(F.col(f"{v}_upto") - F.col(v)).alias(f"{v}_before") for v in values])
    found = inner.join(before, [*by, block])
    return found.withColumns({f"{v}_upto": F.col(f"{v}_upto") + F.col(f"{v}_before") for v in values}).drop(block, *[f"{v}_before" for v in values])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select("conv_id", "turn", F.unhex(F.md5(body.cast("binary"))).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, bytes, total) of each turn of each rebuilt conversation, from depth 1 on, and (conv_id, total), its turns, of all."""
    rows = numbered(turns(conversations), "g", "conv_id", "turn", "digest")
    convs = rows.groupBy("conv_id").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("len"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    convs = convs.select("conv_id", "start", "len", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    taken = F.least("head", F.coalesce("base_len", F.lit(0)))
    convs = cut(convs.join(bases, "base", "left").select("conv_id", "base", "start", "len", "head", taken.alias("taken"), (taken + F.greatest(F.col("len") - F.col("head"), F.lit(0))).alias("total")))
    placed = joined_by_weight(rows, convs, ["conv_id"], "len").withColumn("pos", F.col("g") - F.col("start"))
    own = placed.where("pos >= head").select("conv_id", (F.col("taken") + F.col("pos") - F.col("head") + 1).alias("depth"), "digest", "bytes", "total")
    heads = placed.where((F.col("pos") < HEADS - 1) & (F.col("base") == F.col("conv_id"))).select("base", "pos", "digest", "bytes")
    heads = heads.join(convs.select("conv_id", "base", "head", "total"), "base").where("pos < head").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "bytes", "total")
    return own.unionByName(heads), convs.select("conv_id", "total")


def _key(depth: Column, s: Column, t: Column, a: str, b: str) -> list[Column]:
    """128 bits for a sequence of turns."""
    parts = (depth.cast("long"), s.cast(SUM), t.cast(SUM))
    return [F.xxhash64(*parts).alias(a), F.xxhash64(F.lit(1), *parts).alias(b)]


def _root(a: str, b: str) -> list[Column]:
    return _key(F.lit(0), F.lit(0), F.lit(0), a, b)


def keyed(rows: DataFrame) -> DataFrame:
    """rows of rebuilt() with keys of their node (a, b), its parent (pa, pb) and the node where its block begins (ua, ub), and their label in the block."""
    terms = rows.withColumns({"at": F.col("depth") - 1, "block": F.floor((F.col("depth") - 1) / BLOCK).cast("long"), "s": F.xxhash64("digest", "depth").cast(SUM), "t": F.xxhash64(F.lit(1), "digest", "depth").cast(SUM)})
    label = F.collect_list("digest").over(Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    block = Window.partitionBy("conv_id", "block")
    summed = running(terms, ["conv_id"], "at", ["s", "t"], (BLOCK, STRETCH))
    # sums before the block: those up to its first row, less that row
    first = lambda v: F.min_by(F.col(f"{v}_upto") - F.col(v), F.col("at")).over(block)
    summed = summed.withColumns({"label": label, "s_block": first("s"), "t_block": first("t")})
    return summed.select(
        "conv_id", "depth", "total", "bytes", "label", *_key(F.col("depth"), F.col("s_upto"), F.col("t_upto"), "a", "b"),
        *_key(F.col("depth") - 1, F.col("s_upto") - F.col("s"), F.col("t_upto") - F.col("t"), "pa", "pb"), *_key(F.col("block") * BLOCK, F.col("s_block"), F.col("t_block"), "ua", "ub"),
    )


def ordered(nodes: DataFrame) -> DataFrame:
    """nodes numbered in preorder, as pre, without their labels."""
    size, deepest = BLOCK, nodes.agg(F.max("depth")).first()[0] or 0
    as_label = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    while deepest > size:
        ranked = cut(numbered(nodes, "rank", "ua", "ub", "label").drop("label"))
        odd = F.floor((F.col("depth") - 1) / size) % 2 == 1
        first = ranked.where(~odd).withColumn("label", F.array(as_label(F.col("rank"))))
        above = ranked.select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("ua").alias("ua_"), F.col("ub").alias("ub_"), F.col("rank").alias("rank_"))
        second = ranked.where(odd).join(above, ["ua", "ub"]).withColumns({"label": F.array(as_label(F.col("rank_")), as_label(F.col("rank"))), "ua": F.col("ua_"), "ub": F.col("ub_")})
        nodes, size = first.unionByName(second.drop("ua_", "ub_", "rank_")).drop("rank"), 2 * size
    return numbered(nodes, "pre", "label").drop("label", "ua", "ub")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, first, ids, digest): the digest of each node that lies within the partition; of its first and last node the ids, as text."""
    parts = [np.stack([b.column(i).to_numpy() for i in range(3)]) for b in batches]
    if not parts:
        return
    a, b, c = np.concatenate(parts, axis=1)
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    ids = [",".join(map(str, x.tolist())) for x in np.split(c, at[1:])]
    edge = [i in (0, len(at) - 1) for i in range(len(at))]
    columns = [pa.array(a[at]), pa.array(b[at]), pa.array(c[at]), pa.array([x if e else None for x, e in zip(ids, edge, strict=True)], pa.string())]
    columns.append(pa.array([None if e else hashlib.sha256(x.encode()).hexdigest() for x, e in zip(ids, edge, strict=True)], pa.string()))
    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "first", "ids", "digest"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, digest): ids of a node's parts, which come in order, through one digest."""
    held, digest = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([digest.hexdigest()])], names=["a", "b", "digest"])
    for batch in batches:
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (a, b) != held:
                if held:
                    yield row()
                held, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py().encode())
    if held:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, digest) of ends(conv_id, a, b): SHA-256 of a node's conv_ids in order, joined by commas."""
    n = partitions(ends.sparkSession)
    runs = ends.select("a", "b", "conv_id").repartitionByRange(n, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    parts = cut(runs.mapInArrow(_digested, "a long, b long, first long, ids string, digest string"), 1)
    edges = parts.where("digest is null").repartition(n, "a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids")
    return parts.where("digest is not null").select("a", "b", "digest").union(edges.mapInArrow(_joined, "a long, b long, digest string"))


def trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end (the number after the subtree's last)."""
    narrow_batches(conversations.sparkSession)
    turns_, convs = rebuilt(conversations)
    rows = cut(keyed(turns_))
    same = ["depth", "bytes", "label", "pa", "pb", "ua", "ub"]
    inner = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in same])
    top = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    top = top.select(*_root("a", "b"), "n_convs", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.array().cast("array<binary>").alias("label"), none.alias("pa"), none.alias("pb"), *_root("ua", "ub"))
    nodes = cut(ordered(cut(inner.unionByName(top))))

    ends = rows.where("depth = total").select("conv_id", "a", "b").union(convs.where("total = 0").select("conv_id", *_root("a", "b")))
    # conversations that end in a node have one path: one of them stands for all
    one = ends.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id")).join(nodes.select("a", "b", "pre"), ["a", "b"]).select("conv_id", F.col("pre").alias("last"))
    one = one.join(convs, "conv_id").select("conv_id", "last", F.greatest("total", F.lit(1)).alias("total"))
    last = joined_by_weight(rows.select("conv_id", "a", "b"), cut(one), ["conv_id"], "total").groupBy("a", "b").agg(F.max("last").alias("last"))
    whole = one.agg(F.max("last").alias("last")).select(*_root("a", "b"), "last")

    children = nodes.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    wide = nodes.join(last.union(whole), ["a", "b"]).join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    wide = wide.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    summed = cut(running(wide, [], "pre", ["leaf", "saved"]))

    chain = summed.groupBy("last").agg(F.count(F.lit(1)).alias("chain"))
    at_last = summed.select(F.col("pre").alias("last"), F.col("leaf_upto").alias("leaf_last"), F.col("saved_upto").alias("saved_last")).join(chain, "last")
    found = joined_by_weight(summed, at_last, ["last"], "chain")
    parents = summed.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("own"))
    below = joined_by_weight(found.where("pa is not null"), parents, ["pa", "pb"], "own").drop("own")
    found = below.unionByName(found.where("pa is null").withColumn("parent_conv_id", none)).join(end_digests(ends), ["a", "b"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf_last") - F.col("leaf_upto") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_last") - F.col("saved_upto") + F.col("saved")).alias("saved_tokens"), F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        F.col("pre").alias("preorder"), (F.col("last") + 1).alias("subtree_end"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal digits, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, (x & 1) * 3988292384 + bit))))"""
ORACLE = f"""
WITH k AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT conv_id, {CRC} % 9 AS h, list(digest ORDER BY turn NULLS FIRST, digest) AS own, list(bytes ORDER BY turn NULLS FIRST, digest) AS sizes FROM k GROUP BY conv_id
), r AS (SELECT l.conv_id, list_concat(coalesce(b.own, [])[1:l.h], l.own[l.h + 1:]) AS seq, list_concat(coalesce(b.sizes, [])[1:l.h], l.sizes[l.h + 1:]) AS sizes
  FROM l LEFT JOIN l b ON b.conv_id = l.conv_id - l.conv_id % 5
), p AS (SELECT conv_id, d, array_to_string(seq[1:d], '') AS path, coalesce(sizes[d], 0) AS bytes, d = len(seq) AS ends FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM r)
), n AS MATERIALIZED (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY path
), c AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, row_number() OVER (ORDER BY n.path) - 1 AS preorder FROM n LEFT JOIN c ON n.path = c.path
), s AS (SELECT left(path, 32 * k) AS path, count(*) AS size, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS k FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256, m.preorder, m.preorder + s.size AS subtree_end
FROM m JOIN s ON m.path = s.path LEFT JOIN m up ON m.depth > 0 AND up.path = left(m.path, 32 * (m.depth - 1))
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": ORACLE}
