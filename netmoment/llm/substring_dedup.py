"""Removal of repeated windows of words, with a count-min prefilter.

A window is covered by spans of SPAN neighbouring word 8-grams.  A span's anchor
is its smallest gram by hash, the leftmost if equal.  Equal spans have equal
anchors, and two spans at different places whose anchor is at one place would be
one span; so in a window that repeats, each span's anchor is a gram that is chosen at two
places at least.  Anchors are about an eighth of the words.

First pass: each partition sketches its anchor grams in a count-min sketch (see countmin), whose cells
count to two.  The merged sketch overestimates how often a gram is an anchor: it repeats only if its cells in all rows do.  Second pass: only windows all of whose anchors are
estimated to repeat go on, as 96-bit hashes, to be grouped exactly by hash; none
that repeats is lost.  A partition settles among its own windows first and
sends each hash once, so a text with copies everywhere costs each reducer one
record for each partition.  Last, the repeated starts are joined with the texts that may have any, as a bitmap of hashes tells.

The broadcast sketch has a fixed size, 32 MB by default; when a corpus outgrows
it, more windows are grouped exactly and the result stays the same.

Defined results: a null text has no words; a text shorter than a window keeps
all; each row is a document, so rows that are equal repeat each other; an empty
table gives an empty result; other columns are ignored.  Rows are told apart by 96 bits of hashes of doc_id and text.  A very long text is
cut into words and hashed in chunks, and its kept words are copied once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import countmin, packed
from .tables import cut, narrow_batches, parted, partitions, table
from .tokens import Words, words

GRAM = 8
SPAN = 14
SKETCH_BITS = 28
POSTING = np.dtype([("h", "<u8"), ("row", "<i8"), ("more", "<u4"), ("check", "<u4"), ("start", "<u4")])
#: The high bit of a posting's start: its repetition is known, others only have to hear of it.
KNOWN = np.uint32(1 << 31)
ANSWER = np.dtype([("row", "<i8"), ("more", "<u4"), ("start", "<u4")])
#: Windows that a part of the scan settles among itself.
FLUSH = 1 << 20
#: Spans whose grams are compared at once.
STEP = 1 << 17


def span_of(k: int) -> int:
    """Grams in a span, for windows of k words."""
    return min(SPAN, k - GRAM + 1)


def anchors(w: Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor's word) of each span of grams that lies within one text."""
    length = span + GRAM - 1
    n = len(w.hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = np.flatnonzero(text[:n] == text[length - 1 :])
    view, low = np.lib.stride_tricks.sliding_window_view(w.windows(GRAM), span), at.copy()
    for i in range(0, len(at), STEP):
        low[i : i + STEP] += view[at[i : i + STEP]].argmin(1)
    return at, low


def estimated(w: Words, k: int, repeated: countmin.Sketch) -> np.ndarray:
    """First words of the windows of k words all of whose anchors the sketch says repeat."""
    span = span_of(k)
    at, low = anchors(w, span)
    if not len(at):
        return at
    missing = np.ones(len(w.hashes) + 1, dtype=np.int64)
    missing[at] = ~countmin.reached(repeated, w.windows(GRAM)[low])
    total = np.concatenate([[0], np.cumsum(missing)])
    spans = k - GRAM - span + 2
    n = len(w.hashes) - k + 1
    return np.flatnonzero(total[spans : spans + n] == total[:n]) if n > 0 else at[:0]


def sketch(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> Broadcast:
    """The merged sketch of the texts' anchors: whether each cell is hit twice."""

    def grams(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, w in words(b.column(0), lower=False):
            yield w.windows(GRAM)[np.unique(anchors(w, span_of(k))[1])]

    return countmin.sketch(docs.select("text"), grams, bits, 2)


def _candidates(k: int, seen: Broadcast, buckets: int, most: int):
    """Windows with a repeated anchor, a record for each hash of a partition and for each place that needs an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = seen.value
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            p = np.concatenate(held)
            p = p[np.lexsort((p["check"], p["h"]))]
            new = np.ones(len(p), dtype=bool)
            new[1:] = (p["h"][1:] != p["h"][:-1]) | (p["check"][1:] != p["check"][:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(p)))
            many = np.repeat(size > 1, size)
            p["start"][many] |= KNOWN
            sent = p[new]
            yield packed.dealt(packed.bucket_of(sent["h"], buckets), sent)
            if (rest := p[~new]).size:  # known already: they only go to their own text
                rest["h"] = 0
                yield packed.dealt(rest["row"].astype(np.uint64).astype(np.int64) % buckets, rest)

        for b in batches:
            row, more = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, _, w in words(b.column(2), lower=False):
                start = estimated(w, k, repeated)
                if not len(start):
                    continue
                p = np.empty(len(start), dtype=POSTING)
                text = np.searchsorted(w.first, start, side="right") - 1
                p["h"], p["check"] = w.windows(k)[start], (w.windows(k, second=True)[start] >> np.uint64(32)).astype(np.uint32)
                p["h"] |= np.uint64(1)  # 0 marks what is known
                p["row"], p["more"], p["start"] = row[at + text], more[at + text], start - w.first[text]
                held.append(p)
                n += len(p)
                if n > most:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return run


def _repeated(buckets: int):
    """The places, by bucket of their row, of the windows whose hash is in the partition twice or known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = packed.gathered(batches, POSTING)
        p = p[np.lexsort((p["check"], p["h"]))]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p["h"][1:] != p["h"][:-1]) | (p["check"][1:] != p["check"][:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(p)))
        p = p[np.repeat(size > 1, size) | (p["start"] & KNOWN > 0)]
        out = np.empty(len(p), dtype=ANSWER)
        out["row"], out["more"], out["start"] = p["row"], p["more"], p["start"] & ~KNOWN
        yield packed.dealt(out["row"] % buckets, out)

    return run


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, more, starts), each row once."""
    p = packed.gathered(batches, ANSWER)
    p = p[np.lexsort((p["more"], p["row"]))]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p["row"][1:] != p["row"][:-1]) | (p["more"][1:] != p["more"][:-1])
    at = np.flatnonzero(new)
    ends = np.append(at, len(p))
    for i in range(0, len(at), 1000):
        lists = [p["start"][a:b].tobytes() for a, b in zip(ends[i : i + 1000], ends[i + 1 : i + 1001], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(p["row"][at[i : i + 1000]]), pa.array(p["more"][at[i : i + 1000]].astype(np.int64)), pa.array(lists, pa.binary())], names=["row", "more", "starts"])


def _row() -> tuple:
    """96 bits that tell rows apart, in two columns."""
    return F.xxhash64("doc_id", "text").alias("row"), F.shiftrightunsigned(F.xxhash64(F.lit(1), "doc_id", "text"), 32).alias("more")


def repeated_starts(docs: DataFrame, k: int = 35, bits: int = SKETCH_BITS, flush: int = FLUSH) -> DataFrame:
    """(row, more, starts): for rows of docs with repeated windows, their first words; row and more are those of _row()."""
    spark = docs.sparkSession
    narrow_batches(spark)
    n = partitions(spark)
    windows = docs.select(*_row(), "text").mapInArrow(_candidates(k, sketch(docs, k, bits), 4 * n, flush), packed.SCHEMA)
    found = windows.repartition(n, "bucket").mapInArrow(_repeated(4 * n), packed.SCHEMA)
    return found.repartition(n, "bucket").mapInArrow(_by_row, "row long, more long, starts binary")


def without(w: Words, starts: dict[int, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words, words removed, kept words joined by spaces) of each text; starts: by text, the first words of what goes."""
    n = len(w.starts)
    change = np.zeros(n + 1, dtype=np.int64)
    for i, s in starts.items():
        s = np.unique(s).astype(np.int64) + w.first[i]
        change[s] += 1
        change[s + k] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    edge = np.searchsorted(kept, w.first)
    parted = np.ones(len(kept), dtype=np.int64)  # all but a text's last kept word are followed by a space
    parted[edge[1:][np.diff(edge) > 0] - 1] = 0
    begin, end = w.starts[kept], w.ends[kept]
    step = np.zeros(len(w.bytes) + 2, dtype=np.int8)
    step[begin] += 1
    step[end + parted] -= 1
    data = w.bytes.copy()
    data[end[parted > 0]] = 32
    data = data[np.cumsum(step[: len(data)], dtype=np.int8) > 0].tobytes()
    at = np.append(0, np.cumsum(end - begin + parted))[edge]
    size = np.diff(w.first)
    return size, size - np.diff(edge), [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def dedup(docs: DataFrame, k: int = 35, bits: int = SKETCH_BITS, with_text: bool = False, flush: int = FLUSH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and kept if with_text."""
    starts = cut(repeated_starts(docs, k, bits, flush)).select(F.col("row").alias("r"), F.col("more").alias("m"), "starts")
    may, whole = parted(docs.select("doc_id", "text", *_row()), "row", starts.select(F.col("r").alias("key")))
    joined = may.join(starts, (F.col("row") == F.col("r")) & (F.col("more") == F.col("m")), "left").select("doc_id", "text", "starts")
    joined = joined.union(whole.select("doc_id", "text", F.lit(None).cast("binary").alias("starts")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {i: np.frombuffer(x.as_py(), dtype="<u4") for i, x in enumerate(b.column(2)) if x.is_valid}
            for at, end, w in words(b.column(1), lower=False):
                size, gone, out = without(w, {i - at: own[i] for i in range(at, end) if i in own}, k)
                columns = [b.column(0)[at:end], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())]
                columns += [pa.array([x.decode() for x in out], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])

    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return joined.mapInArrow(rows, schema.add("kept", "string") if with_text else schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), k=35)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 33, 1))) AS i, ws FROM w
), h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM p
), r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1
), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r
), a AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w
), k AS (SELECT a.doc_id, a.j, a.word, g.j IS NOT NULL AS gone FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.j = g.j
), s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""

QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {"op8_substring_dedup": ORACLE}
