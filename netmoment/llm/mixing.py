"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents are put in a fixed random order (a hash of doc_id), and
that order is cut into blocks by leading hash bits.  The mix reads a source's
blocks in order, again from the first after the last, until its target is
reached; so each source has an exact quota of drawn blocks.  The quotas are
split among the output shards by a binary tree: each node deals its blocks to
its two halves by one multivariate-hypergeometric draw, seeded by the node's
number, so the tree's parts can be computed apart and reruns agree.  A leaf then
owns a range of each source's drawn blocks, disjoint from any other leaf's, and
is shuffled by itself.

Only the quotas, one number for each source, come to the driver.  Documents are
grouped by source and block, never by source alone; blocks are numbered by sums over groups of
blocks and then within these.

Defined results: a null text has no words; a null source is a source of its own,
last in order; a document without words is taken zero words, but is copied like
its neighbours in materialized output; with no words at all each target is 0;
an empty table gives an empty result; equal hashes are ordered by doc_id; only rows equal in all columns
are alike, and each is taken by itself.  Other columns pass through mixed(), whatever their names,
and are ignored by taken().  A very long text is one document, whose words are counted by the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import WORD, cut, partitions, row_key, table, unused

HASH_BITS = 60
#: Blocks of a source that are summed in one go, in bits.
GROUP_BITS = 10
#: Source tables of at most this many rows are broadcast.
BROADCAST_SOURCES = 100_000
#: Tree nodes that the driver makes before it hands the subtrees out.
DRIVER_NODES = 64


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size, place): a key of the whole row, the words of the text, and the place in the source's order, of HASH_BITS bits."""
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.select("doc_id", "source", row_key(docs).alias("key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), place.alias("place"))


def targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, sid, source_size, target) from (source, size): shares of all words by weight, at most cap times a source's words.

    What is cut off is dealt to the others by weight until none is above its cap; so all but the capped ones have the same
    words for each unit of weight, level.  In the order of the caps for each unit of weight, level is that of the first
    source which it leaves below its cap.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = by_source.select("source", "source_size", rank.cast("long").alias("sid"), weight.cast("long").alias("weight"))
    ranked = ranked.withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", "sid")
    before = F.coalesce(F.sum(F.col("source_size") * cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - before) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double"))
    ranked = ranked.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid"))).over(Window.partitionBy()))
    return ranked.select("source", "sid", "source_size", F.least(F.col("level") * F.col("weight"), F.lit(float(cap)) * F.col("source_size")).alias("target"))


def split_tree(quotas: np.ndarray, first: int, shards: int, seed: int, stop: int = 1, begin: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first shard, shards, blocks of each source, how many of each come before) for the tree's nodes with at most stop shards."""
    begin = np.zeros_like(quotas) if begin is None else begin
    if shards <= stop:
        yield first, shards, quotas, begin
        return
    half = shards // 2
    total = int(quotas.sum())
    left = np.random.default_rng([seed, first, shards]).multivariate_hypergeometric(quotas, total * half // shards, method="marginals") if total else quotas
    yield from split_tree(left, first, half, seed, stop, begin)
    yield from split_tree(quotas - left, first + half, shards - half, seed, stop, begin + left)


class Mix:
    """The plan of a mix over docs; doc_id, source and text are read, and for mixed() all columns."""

    def __init__(self, docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, block_words: int = 1 << 16, shard_words: int = 1 << 22, seed: int = 17):
        self.docs, self.spark, self.seed, self.cap = docs, docs.sparkSession, seed, cap
        self.sizes = cut(sized(docs))
        self.sources = cut(
            targets(self.sizes, weights, cap)
            .withColumn("bits", F.ceil(F.log2(F.greatest(F.col("source_size") / block_words, F.lit(1.0)))).cast("int"))
            .withColumn("passes", F.least(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(cap)).cast("long"))
            .withColumn("passes", F.coalesce("passes", F.lit(0)))
            .withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))),
            32,
        )
        few = self.sources.count() <= BROADCAST_SOURCES
        plan = F.broadcast(self.sources) if few else self.sources
        of_source = self.sizes.alias("d").join(plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        #: Each document with its source's plan and its block.
        self.placed = of_source.select("doc_id", "key", "size", "place", "sid", "source_size", "target", "passes", "rest", F.expr(f"shiftright(place, {HASH_BITS} - bits)").alias("block"))
        total = self.sources.agg(F.sum("target")).first()[0] or 0.0
        self.shards = max(1, round(total / shard_words))
        self.blocks = cut(self._blocks(), 8)

    def _blocks(self) -> DataFrame:
        """(sid, block, number, before, draws, n_blocks): a source's blocks in order, the words before each, how often it is drawn, and how many there are."""
        up = F.expr(f"shiftright(block, {GROUP_BITS})").alias("up")
        sums = self.placed.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest")).select("*", up)
        sums = cut(sums, 8)
        groups = sums.groupBy("sid", "up").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"))
        over = Window.partitionBy("sid").orderBy("up")
        of_group = groups.select("sid", "up", (F.sum("n").over(over) - F.col("n")).alias("n_before"), (F.sum("words").over(over) - F.col("words")).alias("words_before"), F.sum("n").over(Window.partitionBy("sid")).alias("n_blocks"))
        w = Window.partitionBy("sid", "up").orderBy("block")
        numbered = sums.join(of_group, ["sid", "up"]).select(
            "*", (F.row_number().over(w) - 1 + F.col("n_before")).cast("long").alias("number"), (F.sum("words").over(w) - F.col("words") + F.col("words_before")).alias("before")
        )
        return numbered.select("sid", "block", "number", "before", (F.col("passes") + ((F.col("rest") > F.col("before")) & (F.col("rest") > 0)).cast("long")).alias("draws"), "n_blocks")

    def copies(self) -> DataFrame:
        """placed, with copies (how many the mix takes), the block's number and before, its source's n_blocks, and row (its place in the block)."""
        at = self.placed.join(self.blocks.select("sid", "block", "number", "before", "n_blocks"), ["sid", "block"])
        w = Window.partitionBy("sid", "block").orderBy("place", "doc_id", "size", "key")
        at = at.withColumn("row", F.row_number().over(w))
        start = F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
        more = (start + F.col("size") / 2.0 <= F.col("rest")) & (F.col("rest") > 0)
        return at.withColumn("copies", F.least(F.col("passes") + more.cast("long"), F.lit(self.cap)))

    def shard_ranges(self) -> DataFrame:
        """(sid, draw, shard) for each drawn block, dealt out by the splitting tree: a leaf owns the draws after those of the leaves before it."""
        quotas = {r.sid: r.q for r in self.blocks.groupBy("sid").agg(F.sum("draws").alias("q")).collect()}
        sids = sorted(quotas)
        vector = np.array([quotas[s] for s in sids], dtype=np.int64)
        stop, seed = max(1, -(-self.shards // DRIVER_NODES)), self.seed
        nodes = [(first, n, q.tolist(), b.tolist()) for first, n, q, b in split_tree(vector, 0, self.shards, seed, stop)] if sids else []

        def leaves(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for first, n, q, b in part.itertuples(index=False):
                    for shard, _, counts, begin in split_tree(np.asarray(q, dtype=np.int64), int(first), int(n), seed, begin=np.asarray(b, dtype=np.int64)):
                        yield pd.DataFrame({"shard": shard, "sid": sids, "begin": begin, "n": counts})[counts > 0]

        tree = self.spark.createDataFrame(nodes, "first long, n long, q array<long>, b array<long>").repartition(min(len(nodes) or 1, partitions(self.spark)))
        owned = tree.mapInPandas(leaves, "shard long, sid long, begin long, n long")
        return owned.select("sid", "shard", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)).alias("draw"))

    def taken(self) -> DataFrame:
        """Per document: doc_id, key, size, source_size, target, taken (words), shards (of its copies, in order of drawing)."""
        row = ["sid", "number", "row"]
        drawn = self.copies().withColumn("pass", F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1))))
        drawn = drawn.withColumn("draw", F.col("pass") * F.col("n_blocks") + F.col("number")).select(*row, "doc_id", "key", "size", "source_size", "target", "draw")
        dealt = drawn.join(self.shard_ranges(), ["sid", "draw"], "left")
        held = F.array_sort(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("draw", "shard"))))
        each = dealt.groupBy(*row).agg(*[F.first(c).alias(c) for c in ("doc_id", "key", "size", "source_size", "target")], held.alias("held"))
        return each.select("doc_id", "key", "size", "source_size", "target", (F.size("held") * F.col("size")).alias("taken"), F.col("held.shard").alias("shards"))

    def mixed(self) -> DataFrame:
        """The input's rows, as often as the mix takes them, shuffled within the shards: a partition holds whole shards."""
        key, shard, own = unused(self.docs, "key", "shard", "own")
        copies = self.taken().where(F.size("shards") > 0).select(F.col("key").alias(own), F.explode("shards").alias(shard))
        docs = self.docs.withColumn(key, row_key(self.docs))
        again = self.sizes.groupBy("key").count().where("count > 1").select(F.col("key").alias(own))
        if again.limit(1).count():
            # equal rows have been taken each by itself; here one stands for all their copies
            same = F.col(key) == F.col(own)
            docs = docs.join(again, same, "left_anti").union(docs.join(again, same, "left_semi").dropDuplicates([key]))
        rows = docs.join(copies, F.col(key) == F.col(own))
        n = max(1, min(self.shards, partitions(self.spark)))
        return rows.repartition(n, shard).sortWithinPartitions(shard, F.xxhash64(shard, own, F.lit(self.seed))).drop(key, own, shard)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return Mix(docs).taken().select("doc_id", "size", "source_size", "target", "taken")


#: The rows of taken() but for the shards, which are random draws.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM r
), t AS (
  SELECT source, source_size, least((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight, 3.0::DOUBLE * source_size) AS target FROM l
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(coalesce(floor(target / nullif(source_size, 0)), 0), 3) AS passes,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(least(passes + CASE WHEN target - passes * source_size > 0 AND start + size / 2.0 <= target - passes * source_size THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken
FROM c
"""

QUERIES = {"op6_source_mix": op6_source_mix}
ORACLES = {"op6_source_mix": ORACLE}
