"""Benchmark decontamination: rare seeds, then local alignment.

Words are runs of letters and digits, in upper case.  A copy is a passage of a
document in which Smith-Waterman alignment matches enough of an item's words.
Seeds are words, the n-grams that the lightest edits can't remove: with every third word replaced two
thirds of an item are left and not one 3-gram.  The words of the test items are looked up in all documents twice: once to
count the documents that hold each, and once with seeds.  Of an item's words
that any document holds, the rarest are seeds, as many as it takes for the others to be fewer than a copy
needs: so every copy holds a seed.  A document with a seed is compared with the item if it holds
enough of the item's words, and enough within the span that an alignment can have.

The items are broadcast in blocks of at most BLOCK_WORDS words; each block is
looked up in all documents.  Documents never leave their scan.

Defined results: null or empty texts of items or documents match nothing; equal items all match; equal rows
of documents match alike; several copies of an item in one document are a row each, and of alignments with equal scores the
one that ends first is taken; empty tables give an empty result; other columns are
ignored by matches() and pass through clean().  A very long text is hashed in chunks and aligned in stretches of a few times an item's length;
a very long item costs its length times the stretch's, in memory of the stretch's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import GAP, MATCH, smith_waterman
from .tables import narrow_batches, table, trim
from .tokens import PUNCTUATION, Words, words

COVERAGE = 0.6
BLOCK_WORDS = 1 << 21
FILTER_BITS = 20
#: Words of a document in an alignment, for each word of the item, at most: a match pays for so many gaps.
SPAN = 1 + MATCH // -GAP


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo to hi-1 of each pair, one after the other."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


def folded(text: str) -> Column:
    """The text with all letters in upper case, which letters with two lower forms, or an upper form of two letters, agree in."""
    return F.upper(F.col(text))


class Items:
    """Test items: their words as numbers in the sorted keys, the words that a copy needs, and for each key the items it is a seed of."""

    def __init__(self, ids: list[int], hashes: list[np.ndarray], coverage: float):
        self.ids, self.words = ids, hashes
        self.size = np.array([len(h) for h in hashes], dtype=np.int64)
        self.end = np.cumsum(self.size)
        self.need = np.maximum(1, -(-int(coverage * 1000) * self.size // 1000))
        self.keys, self.key = np.unique(np.concatenate(hashes), return_inverse=True)
        self.kinds = [np.unique(k, return_counts=True) for k in np.split(self.key, self.end[:-1])]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def seed(self, held: dict[int, int]) -> None:
        """Of each item's words that documents hold, all but need - 1 are seeds, the rarest first; held: documents by word's hash."""
        df = np.array([held.get(int(h), 0) for h in self.keys], dtype=np.int64)[self.key]
        item = np.repeat(np.arange(len(self.ids)), self.size)
        at = np.flatnonzero(df)
        order = at[np.lexsort((self.key[at], df[at], item[at]))]
        size = np.bincount(item[at], minlength=len(self.ids))
        place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        kept = order[place < np.repeat(size - self.need + 1, size)]
        key, self.seeds = np.unique(np.stack([self.key[kept], item[kept]]), axis=1)
        self.first = np.searchsorted(key, np.arange(len(self.keys) + 1))

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of words that items hold, and their numbers."""
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[i] == h[at]
        return at[same], i[same]

    def scratch(self) -> tuple[np.ndarray, np.ndarray]:
        """By key: a mark, and a place among an item's different words; all False and -1 between uses, and made where they are used."""
        if not hasattr(self, "_scratch"):
            self._scratch = np.zeros(len(self.keys), dtype=bool), np.full(len(self.keys), -1)
        return self._scratch

    def candidates(self, key: np.ndarray) -> np.ndarray:
        """Items with a seed and enough words among the keys."""
        u = np.unique(key)
        seeds = _ranges(self.first[u], self.first[u + 1])
        if not len(seeds):
            return seeds
        k = np.unique(self.seeds[seeds])
        mark, _ = self.scratch()
        mark[u] = True
        there = mark[self.key[_ranges(self.end[k] - self.size[k], self.end[k])]]
        mark[u] = False
        return k[np.add.reduceat(there, np.cumsum(self.size[k]) - self.size[k], dtype=np.int64) >= self.need[k]]


def read_items(bench: DataFrame, coverage: float) -> Iterator[Items]:
    """Blocks of the test items."""
    ids, hashes, n = [], [], 0
    for r in bench.select("item_id", folded("text").alias("text")).orderBy("item_id", "text").toLocalIterator():
        h = next(w.hashes for _, _, w in words(pa.array([r.text], pa.string()), lower=False, separators=PUNCTUATION))
        if len(h):
            ids.append(r.item_id)
            hashes.append(h)
            n += len(h)
        if n > BLOCK_WORDS:
            yield Items(ids, hashes, coverage)
            ids, hashes, n = [], [], 0
    if ids:
        yield Items(ids, hashes, coverage)


def _texts(w: Words, t: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, its word hashes, the places of items' words in it, and their keys) of texts with as many of these as any item needs."""
    at, key = t.found(w.hashes)
    edge = np.searchsorted(at, w.first)
    for i in np.flatnonzero(np.diff(edge) >= t.need.min()).tolist():
        a, b = int(edge[i]), int(edge[i + 1])
        yield i, w.hashes[w.first[i] : w.first[i + 1]], at[a:b] - w.first[i], key[a:b]


def _held(items: Broadcast):
    """(hash, documents) for the items' words in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = items.value
        count = np.zeros(len(t.keys), dtype=np.int64)
        for b in batches:
            for _, _, w in words(b.column(0), lower=False, separators=PUNCTUATION):
                at, key = t.found(w.hashes)
                pair = np.unique(key * (len(w.first) + 1) + np.searchsorted(w.first, at, side="right"))
                count += np.bincount(pair // (len(w.first) + 1), minlength=len(count))
        i = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(t.keys[i].view(np.int64)), pa.array(count[i])], names=["hash", "n"])

    return run


def prepared(docs: DataFrame, bench: DataFrame, coverage: float) -> list[Broadcast]:
    """Blocks of items with their seeds, broadcast."""
    narrow_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    out = []
    for block in read_items(bench, coverage):
        all_words = sc.broadcast(block)
        held = docs.select(folded("text")).mapInArrow(_held(all_words), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
        block.seed({r.hash % 2**64: r.n for r in held.toLocalIterator()})
        out.append(sc.broadcast(block))
    return out


def dense(at: np.ndarray, own: np.ndarray, times: np.ndarray, span: int, need: int) -> list[tuple[int, int]]:
    """Stretches of a text where a span of words holds at least need words of an item, repeated ones as often as the item does.

    at: places of the item's words in the text; own: which word, and times: how often the item has it.  A word counts for
    the spans that begin after the last place that would make it one too many.
    """
    if len(at) < need:
        return []
    order = np.argsort(own, kind="stable")
    back = np.arange(len(order)) - times[order]
    before = order[np.maximum(back, 0)]
    over = (back >= 0) & (own[before] == own[order])
    begin = np.maximum(at[order] - span, np.where(over, at[before], -1)) + 1
    # Spans that begin at a word of the item hold as many as any other.
    more = np.bincount(np.searchsorted(at, begin), minlength=len(at))
    more[1:] -= 1
    first = at[np.cumsum(more) >= need]
    if not len(first):
        return []
    gaps = np.flatnonzero(np.diff(first) > span)
    return list(zip(first[np.append(0, gaps + 1)].tolist(), (first[np.append(gaps, -1)] + span).tolist(), strict=True))


def copies(x: np.ndarray, h: np.ndarray, need: int, stretches: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(first word, end, score, matches) of the passages in stretches of a text h that copy x."""
    span = SPAN * len(x)
    for a, b in stretches:
        done, b = a, min(b, len(h))
        for start in range(a, max(a + 1, b - span), span):  # a passage that starts in the first half of two spans is whole there
            last = start + 2 * span >= b
            todo = [(max(start, done), min(start + 2 * span, b))]
            while todo:
                c, d = todo.pop()
                if np.isin(x, h[c:d]).sum() < need:
                    continue
                found = smith_waterman(x, h[c:d])
                first, end = c + found.other_start, c + found.other_end
                todo.append((c, first))
                if last or first < start + span:
                    todo.append((end, d))
                    if found.matches >= need:
                        done = max(done, end)
                        yield first, end, found.score, found.matches


def aligned(h: np.ndarray, at: np.ndarray, key: np.ndarray, t: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, first word, end, score, matches) of the copies of items in a text with words h, those of items at places at with keys key."""
    _, place = t.scratch()
    for k in t.candidates(key):
        kinds, times = t.kinds[k]
        place[kinds] = np.arange(len(kinds))
        own = place[key]
        place[kinds] = -1
        inside = own >= 0
        need, span, places = int(t.need[k]), SPAN * len(t.words[k]), at[inside]
        # so many words of the item within a span, repeated ones included, are the least that dense() asks for
        if len(places) < need or (places[need - 1 :] - places[: len(places) - need + 1]).min() >= span:
            continue
        own = own[inside]
        for found in copies(t.words[k], h, need, dense(places, own, times[own], span, need)):
            yield int(k), *found


def matches(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, score, coverage): passages of docs that copy items; score is 1 for an exact copy."""
    spark = docs.sparkSession
    schema = docs.select("doc_id").schema.add("item_id", "long").add("first_word", "long").add("end_word", "long").add("score", "double").add("coverage", "double")
    result = spark.createDataFrame([], schema)

    def find(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = block.value
            for b in batches:
                rows = []
                for at, _, w in words(b.column(1), lower=False, separators=PUNCTUATION):
                    for i, h, places, key in _texts(w, t):
                        rows += [(at + i, t.ids[k], s, e, score / (MATCH * len(t.words[k])), m / len(t.words[k])) for k, s, e, score, m in aligned(h, places, key, t)]
                own = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([own, *(pa.array([r[i + 1] for r in rows], kind) for i, kind in enumerate(kinds))], names=schema.names)

        return run

    for block in prepared(docs, bench, coverage):
        result = result.union(docs.select("doc_id", folded("text")).mapInArrow(find(block), schema))
    return result


def clean(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that copy no item; of a row its text alone goes to Python."""

    def copies_one(block: Broadcast):
        @F.arrow_udf("boolean")
        def run(column: pa.Array) -> pa.Array:
            found = np.zeros(len(column), dtype=bool)
            for at, _, w in words(column, lower=False, separators=PUNCTUATION):
                for i, h, places, key in _texts(w, block.value):
                    found[at + i] = next(aligned(h, places, key, block.value), None) is not None
            trim()
            return pa.array(found)

        return run

    out = docs
    for block in prepared(docs, bench, coverage):
        out = out.where(~copies_one(block)(folded("text")))
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLES: dict[str, str] = {}
