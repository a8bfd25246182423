"""Quality scores from preference pairs: Bradley-Terry with a linear score.

A document's score is linear in the features of its whole text: a few measures of its form, and how often each
word and each pair of neighbouring words occurs, hashed into cells.  Pairs of a
better and a worse labelled document, drawn at random, train it: the logistic
loss of the pair's difference in features is minimized by Newton steps, each solved by conjugate gradients on the
sparse features; thanks to a ridge the optimum is unique.  The threshold is the quantile of the
training scores at the share of worse documents, and a logistic curve about it
makes the score a number from 0 to 1.

Training takes at most max_rows labelled rows, the first by a hash of doc_id;
that bound is the only one.  Labels, lang, source and doc_id are no features.

Defined results: a null text is scored as the empty text, and that as the
features' zeros; labels that are null or have no document are not trained on;
documents and labels may repeat, and ties in the order of training rows are broken by their features; with only one class among the labels all scores are 0.5;
an empty table gives an empty result; other columns are ignored by score() and pass through kept().  A very long text is one row, of which
words are hashed in chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import narrow_batches, table, trim
from .tokens import Words, sized

FORM = ("log_words", "mean_word", "symbols", "upper", "digits", "echo", "variety", "line_words", "one_byte", "stops")
#: Cells of word and word-pair hashes, and what a share of a text's words counts for.
CELL_BITS = 12
CELLS = 1 << CELL_BITS
SHARE = 30.0

_CLASS = np.zeros((3, 256), dtype=np.float32)
for _i in range(128):
    _CLASS[0, _i] = 32 < _i < 127 and not chr(_i).isalnum() and chr(_i) not in ".,;:?!'\"()-"
    _CLASS[1, _i], _CLASS[2, _i] = chr(_i).isupper(), chr(_i).isdigit()
_STOP = np.zeros(256, dtype=np.float64)
_STOP[list(b".,;:?!")] = 1


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[edges[1:]] - total[edges[:-1]]


def form(w: Words, edges: np.ndarray) -> np.ndarray:
    """One row of FORM for each text."""
    n, first = np.diff(edges).astype(float), w.first
    words = np.diff(first).astype(float)
    by, bw = np.maximum(n, 1), np.maximum(words, 1)
    counts = [_sums(kind[w.bytes], edges) / by for kind in _CLASS]
    same = np.zeros(len(w.hashes))
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[first[:-1][words > 0]] = 0
    owner = np.repeat(np.arange(len(words), dtype=np.uint64), words.astype(np.int64))
    order = np.lexsort((w.hashes, owner))
    h, o = w.hashes[order], owner[order]
    new = np.ones(len(h))
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o.astype(np.int64), weights=new, minlength=len(words))
    lines = _sums((w.bytes == 10).astype(float), edges) + 1
    last = w.bytes[w.ends - 1] if len(w.ends) else np.zeros(0, dtype=np.uint8)
    length = w.ends - w.starts
    return np.column_stack([
        np.log1p(words), _sums(length, first) / bw, *counts,
        _sums(same, first) / bw, distinct / bw**0.9, np.log1p(words / lines), _sums(length == 1, first) / bw, _sums(_STOP[last], first) / bw,
    ])


def cells(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each word, and of each word with the next one of its text (else CELLS)."""
    shift = np.uint64(64 - CELL_BITS)
    one, two = (w.hashes >> shift).astype(np.int64), np.full(len(w.hashes), CELLS)
    if len(one) > 1:
        two[:-1] = (w.windows(2) >> shift).astype(np.int64)
    two[w.first[1:][np.diff(w.first) > 0] - 1] = CELLS
    return one, two


def texts(column: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    """Words and form of runs of texts."""
    for _, _, data, offsets in sized(column):
        w = Words(data, offsets, lower=True)
        yield w, form(w, (offsets - offsets[0]).astype(np.int64))


#: Largest count of 16 bits.
MOST_COUNT = 2**16 - 1


def sparse(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(form, cells in use, how often) of each text, cells and counts of 16 bits; the cells of pairs come after those of words.

    A cell of more than MOST_COUNT comes as often as its count takes.
    """
    for w, x in texts(column):
        one, two = cells(w)
        for i in range(len(x)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            own, count = np.unique(np.concatenate([one[a:b], two[a:b][two[a:b] < CELLS] + CELLS]), return_counts=True)
            parts = -(-count // MOST_COUNT)
            each = np.full(int(parts.sum()), MOST_COUNT)
            each[np.cumsum(parts) - 1] = count - (parts - 1) * MOST_COUNT
            yield x[i], np.repeat(own, parts).astype("<u2"), each.astype("<u2")


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(threshold - form . weights - shares . cells)) for standardized form."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cells: np.ndarray
    threshold: float

    def scores(self, column: pa.Array) -> np.ndarray:
        one_of, two_of = self.cells[:CELLS], np.append(self.cells[CELLS:], 0.0)
        out = [np.zeros(0)]
        for w, x in texts(column):
            one, two = cells(w)
            share = _sums(one_of[one] + two_of[two], w.first) * SHARE / np.maximum(np.diff(w.first), 1)
            z = ((x - self.mean) / self.spread) @ self.weights + share - self.threshold
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out)


class Rows:
    """Sparse rows: products with a vector and of a vector with them."""

    def __init__(self, dense: np.ndarray, cell: list[np.ndarray], count: list[np.ndarray], words: np.ndarray):
        self.dense, self.n = dense, len(dense)
        size = [len(c) for c in cell]
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), size)
        self.cell = np.concatenate(cell) if cell else np.zeros(0, dtype="<u2")
        self.share = (np.concatenate(count) if cell else np.zeros(0)).astype(np.float32)
        self.share *= np.repeat((SHARE / np.maximum(words, 1)).astype(np.float32), size)
        self.width = dense.shape[1] + 2 * CELLS

    def times(self, w: np.ndarray) -> np.ndarray:
        k = self.dense.shape[1]
        return self.dense @ w[:k] + np.bincount(self.row, self.share * w[k:][self.cell], self.n)

    def summed(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([r @ self.dense, np.bincount(self.cell, self.share * r[self.row], 2 * CELLS)])


def optimum(rows: Rows, won: np.ndarray, lost: np.ndarray, ridge: float, steps: int = 30, inner: int = 60) -> np.ndarray:
    """The weights of least mean log(1 + exp(-(score of won - score of lost))) + ridge / 2 * |weights|**2."""
    w, n, pairs = np.zeros(rows.width), rows.n, len(won)
    to_rows = lambda v: np.bincount(won, v, n) - np.bincount(lost, v, n)

    def loss(x: np.ndarray) -> float:
        s = rows.times(x)
        return float(np.logaddexp(0, s[lost] - s[won]).mean() + ridge / 2 * x @ x)

    best = loss(w)
    for _ in range(steps):
        s = rows.times(w)
        p = 1 / (1 + np.exp(np.clip(s[won] - s[lost], -30, 30)))  # of the worse winning
        grad = ridge * w - rows.summed(to_rows(p)) / pairs
        size = float(np.sqrt(grad @ grad))
        if size < 1e-7:
            break
        curve = p * (1 - p) / pairs

        def bent(v: np.ndarray, curve: np.ndarray = curve) -> np.ndarray:
            s = rows.times(v)
            return ridge * v + rows.summed(to_rows(curve * (s[won] - s[lost])))

        step, rest = np.zeros_like(w), -grad
        way, left = rest.copy(), float(rest @ rest)
        for _ in range(inner):
            h = bent(way)
            a = left / float(way @ h)
            step += a * way
            rest = rest - a * h
            now = float(rest @ rest)
            if now < (min(0.1, size) * size) ** 2:
                break
            way, left = rest + now / left * way, now
        length, slope = 1.0, float(grad @ step)
        while (new := loss(w + length * step)) > best + 1e-4 * length * slope and length > 1e-4:
            length /= 2
        w, done, best = w + length * step, best - new, new
        if done < 1e-10:
            break
    return w


def bradley_terry(dense: np.ndarray, cell: list[np.ndarray], count: list[np.ndarray], better: np.ndarray, pairs: int = 100_000, ridge: float = 1e-3, seed: int = 7) -> Model:
    """The model of rows' form, cells and counts, and labels better (0 or 1)."""
    k = dense.shape[1]
    if not len(dense) or better.min() == better.max():
        return Model(np.zeros(k), np.ones(k), np.zeros(k), np.zeros(2 * CELLS), 0.0)
    mean, spread = dense.mean(0), dense.std(0)
    spread = np.where(spread > 1e-12, spread, 1.0)
    rows = Rows((dense - mean) / spread, cell, count, np.expm1(dense[:, FORM.index("log_words")]).round())
    rng = np.random.default_rng(seed)
    won, lost = (rng.choice(np.flatnonzero(better == x), pairs) for x in (1, 0))
    w = optimum(rows, won, lost, ridge)
    s = np.sort(rows.times(w))
    at = int(np.clip(round(float((better == 0).mean()) * len(s)), 1, len(s) - 1))
    return Model(mean, spread, w[:k], w[k:], float(s[at - 1] + s[at]) / 2)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, seed: int = 7) -> Model:
    """The model of labels(doc_id, quality) on docs(doc_id, text), from at most max_rows labelled rows."""
    narrow_batches(docs.sparkSession)
    first = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    first = first.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "quality").limit(max_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("quality", F.xxhash64("doc_id", F.lit(seed)).alias("place"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [f.tobytes() + c.tobytes() + n.tobytes() for f, c, n in sparse(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("place"), pa.array(x, pa.binary())], names=["quality", "place", "x"])

    # a doc_id that documents repeat gives more rows than labels, so the bound holds for both
    got = known.mapInArrow(rows, "quality int, place long, x binary").orderBy("place", "quality", "x").limit(max_rows).collect()
    k = 8 * len(FORM)
    half = [(len(r.x) - k) // 4 for r in got]
    dense = np.array([np.frombuffer(r.x[:k]) for r in got]).reshape(-1, len(FORM))
    cell, count = ([np.frombuffer(r.x, "<u2", n, k + i * 2 * n) for r, n in zip(got, half, strict=True)] for i in (0, 1))
    return bradley_terry(dense, cell, count, np.array([int(r.quality > 0) for r in got]), seed=seed)


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column of scores from one of texts; nothing else goes to Python."""
    narrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        found = pa.array(shared.value.scores(column), pa.float64())
        trim()
        return found

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of docs."""
    return docs.select("doc_id", scorer(docs.sparkSession, model)(F.col("text")).alias("score"))


def kept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least least."""
    return docs.where(scorer(docs.sparkSession, model)(F.col("text")) >= least)


def held_out() -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3) == 1


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model that the queries use, trained on the labels that are not held out."""
    return fit(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fitted(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
