"""Line deduplication with DataFrame functions only; the result is a run-length keep bitmap for each document.

Lines become (hash, document, position) rows, which are written once; text never leaves the scan.  They are range-partitioned
by hash and sorted within by document and position.  A hash with more rows than a task should have is cut into slices of
documents, which are ranges of their own: frequent hashes are told by a sketch of bounded size, and a hash it misses costs a longer
task, not a wrong result.  Windows then stream over each sorted run: they number a line's first occurrences in documents, count the
documents and find the largest doc_id.  A whole hash is decided by its run alone; slices carry
their counts and largest doc_id to each other, one row a slice, of which there are a few for each partition at most.

Only the places that are dropped go to their documents, as runs of kept and dropped lines; and only the texts that may lose any, as
a bitmap of their hashes tells, go to meet them.

Defined results: a null or empty text has one empty line and keeps it; each row
counts as one document, so rows with equal doc_id and text share one decision;
among documents with equal largest doc_id all keep their lines; a null doc_id
is smaller than any other; an empty table gives an empty result; other columns
of the input are ignored.  A text of any length is cut into lines by the scan, and all work on it is in proportion to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import SPACES, cut, parted, partitions, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a hash that stay in one slice, at least.
SLICE_ROWS = 1 << 12
#: Counters of the sketch of frequent hashes, at least and at most.
LEAST_COUNTERS, MOST_COUNTERS = 10_000, 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, body, pos, a, b) for each line whose key has at least min_chars code points; body is a hash of the text."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("body"), F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"))
    return keyed.where(F.char_length("key") >= min_chars).select("doc_id", "body", "pos", F.xxhash64("key").alias("a"), F.xxhash64("key", F.lit(1)).alias("b"))


def sorted_runs(occ: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """occ with slice (0: the whole hash), range-partitioned by hash and slice and sorted by hash, document and position."""
    n = partitions(occ.sparkSession)
    most = max(slice_rows, occ.count() // (4 * n))
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 16 * n))
    top = occ.agg(F.expr(f"approx_top_k(a, {min(counters, 8 * n)}, {counters})").alias("top")).select(F.explode("top").alias("t"))
    hot = top.where(F.col("t.count") > most).select(F.col("t.item").alias("a"), F.ceil(F.col("t.count") / most).alias("slices"))
    sliced = occ.join(F.broadcast(hot), "a", "left")
    own = F.when(F.col("slices").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "body"), F.col("slices")) + 1).cast("int")
    sliced = sliced.select("a", own.alias("slice"), "b", "doc_id", "body", "pos")
    return sliced.repartitionByRange(n, "a", "slice").sortWithinPartitions("a", "slice", "b", "doc_id", "body", "pos")


def streamed(runs: DataFrame) -> DataFrame:
    """runs with held (documents with the line) and keeper (the largest doc_id), both within the slice."""
    line = Window.partitionBy("a", "slice", "b")
    in_doc = Window.partitionBy("a", "slice", "b", "doc_id", "body").orderBy("pos")
    first = runs.withColumn("first", (F.rank().over(in_doc) == 1).cast("long"))
    return first.withColumns({"held": F.sum("first").over(line), "keeper": F.max("doc_id").over(line)}).drop("first")


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, body, pos) of the lines to drop."""
    told = streamed(sorted_runs(cut(occurrences(docs, min_chars)), slice_rows))
    other = ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    told = cut(told.where((F.col("slice") > 0) | ((F.col("held") >= min_docs) & other)), 4)
    ends = told.where("slice > 0").groupBy("a", "b", "slice").agg(F.first("held").alias("held"), F.max("keeper").alias("keeper"))
    whole = ends.groupBy("a", "b").agg(F.sum("held").alias("held"), F.max("keeper").alias("keeper")).where(F.col("held") >= min_docs).select("a", "b", "keeper")
    of_slices = told.where("slice > 0").drop("held", "keeper").join(F.broadcast(whole), ["a", "b"]).where(other)
    return told.where("slice = 0").select("doc_id", "body", "pos").union(of_slices.select("doc_id", "body", "pos"))


def dropped_positions(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, body, dropped): sorted positions of the lines to drop, for documents that lose any."""
    gone = dropped_lines(docs, min_chars, min_docs, slice_rows)
    return gone.groupBy("doc_id", "body").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def run_ends(n: Column, dropped: Column) -> Column:
    """Where runs end, kept and dropped ones in turn, kept ones first: the bitmap's change points, at n the last; dropped: sorted positions."""
    size = F.size(dropped)
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: (i == size - 1) | (F.get(dropped, i + 1) != x + 1))
    last = F.when(F.get(dropped, size - 1) == n - 1, F.array().cast("array<int>")).otherwise(F.array(n))
    return F.concat(F.flatten(F.zip_with(starts, ends, lambda s, e: F.array(s, e + 1))), last)


def bitmap(ends: Column) -> Column:
    """The bitmap's run lengths, kept and dropped lines in turn, joined by spaces; the first may be 0."""
    lengths = F.transform(ends, lambda x, i: x - F.when(i == 0, 0).otherwise(F.get(ends, i - 1)))
    return F.array_join(F.transform(lengths, lambda x: x.cast("string")), " ")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, keep (see bitmap)."""
    return _decided(docs, min_chars, min_docs).select("doc_id", "n_lines", "n_dropped", "keep")


def _decided(docs: DataFrame, min_chars: int, min_docs: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    drops = cut(dropped_positions(docs, min_chars, min_docs, slice_rows)).select(F.col("doc_id").alias("d"), F.col("body").alias("b"), "dropped")
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("body")).withColumn("key", F.xxhash64("doc_id", "body"))
    may, whole = parted(base, "key", drops.select(F.xxhash64("d", "b").alias("key")))
    out = may.join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left").select("doc_id", "text", "dropped")
    out = out.union(whole.select("doc_id", "text", F.lit(None).cast("array<int>").alias("dropped")))
    out = out.select("doc_id", "text", lines_of(F.col("text")).alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    out = out.select("*", run_ends(F.size("lines"), F.col("dropped")).alias("ends"))
    return out.select("doc_id", "text", "lines", "ends", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), bitmap(F.col("ends")).alias("keep"))


def kept_text() -> Column:
    """The kept lines of a row of _decided, joined by line feeds."""
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
    runs = F.transform(F.col("ends"), lambda end, i: F.when(i % 2 == 0, F.slice("lines", begin(i) + 1, end - begin(i))).otherwise(F.array().cast("array<string>")))
    return F.when(F.col("n_dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _decided(table(spark, sf_dir, "documents"), 20, 3)
    return decided.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text().cast("binary"), 256).alias("kept_sha256"), "keep")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), h AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), d AS (
  SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND k.doc_id <> h.keeper) AS gone FROM k LEFT JOIN h ON k.key = h.key
), b AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id
), e AS (
  SELECT doc_id, pos, gone AND NOT coalesce(lag(gone) OVER w, FALSE) AS starts, NOT gone AND coalesce(lag(gone) OVER w, FALSE) AS ends FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), m AS (SELECT doc_id, pos - 1 AS edge FROM e WHERE starts OR ends UNION ALL SELECT doc_id, n_lines FROM b
), g AS (SELECT doc_id, edge, edge - coalesce(lag(edge) OVER (PARTITION BY doc_id ORDER BY edge), 0) AS run FROM m
), s AS (SELECT doc_id, string_agg(run, ' ' ORDER BY edge) AS keep FROM g GROUP BY doc_id)
SELECT b.*, s.keep FROM b JOIN s ON b.doc_id = s.doc_id
"""

QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {"op10_line_dedup": ORACLE}
