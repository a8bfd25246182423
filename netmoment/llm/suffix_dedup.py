"""Removal of repeated byte strings by suffix arrays that difference covers make.

A string of K bytes starts at each place; it goes if an equal one starts earlier, by document or within it.  Strings can only be equal
if they hold the same anchor at the same distance: the smallest by hash of the GRAM-byte grams in them, the leftmost of equal ones.
Neighbouring strings share their anchor, so a text falls into runs of strings of one anchor; a run with the bytes that its strings cover is a context.

1. A count-min sketch of anchors (see countmin) leaves contexts whose anchor may be at two places; a partition settles equal contexts among
   itself.  The others meet by anchor, 128 bits of hashes and a place each: of equal contexts only the earliest keeps strings.
2. Anchors with one context are done.  Where an anchor has several, only parts of them may be equal: contexts that differ are dealt out by anchor, with their
   bytes, so that equal strings are in one task, and each task builds the suffix array of its share: it sorts the triples of
   the places not divisible by 3, recurs on their names, sorts the remaining suffixes by first symbol and the next one's rank, merges both by
   ranks, and compares the K bytes of neighbours.  Of equal neighbours all but the earliest go.
3. Starts of strings that go meet the texts that may have any, as a bitmap tells.

A global suffix array of all bytes would move some 40 bytes for each byte of text through the exchanges; dealing by anchor gives the same
groups of equal strings, as those that share K bytes share the anchor.  An anchor with more than LARGE different contexts (a common line between different
neighbours) would be too much for a task: its strings are dealt by hashes of their own and compared by 128 bits.

Defined results: a null text is empty; a null doc_id comes first; rows with equal doc_id and text are one document and share their result, other rows of one doc_id
go by a hash of the text; a text shorter than K keeps all; an empty table gives an empty result; other columns are ignored.  Very long texts are worked on in overlapping
pieces, and bytes kept may end within a character.
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
from .tables import cut, narrow_batches, parted, partitions, table, trim
from .tokens import _BYTE, _BYTES_BASE, CHUNK_BYTES, mix, sized

GRAM = 64
#: Different contexts of an anchor that go into one suffix array.
LARGE = 4096
SKETCH_BITS = 28
#: Bytes of a suffix array; names below 2**21 let three of them fit a sort key.
SHARE = 1 << 20
PLACE_BITS = 21
FLUSH = 1 << 19
NO_ID = -(2**63)
#: g: the anchor's gram, 0 for strings that are known to go; h: the context, or a string's second hash where n is 0; n: strings of the context.
CONTEXT = np.dtype([("g", "<u8"), ("h", "<u8"), ("doc", "<i8"), ("more", "<u8"), ("lo", "<u4"), ("n", "u1")])
GONE = np.dtype([("doc", "<i8"), ("more", "<u8"), ("lo", "<u4"), ("n", "<u4")])
ORDER = ("lo", "more", "doc", "h", "g")  # for lexsort, the last key first


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Places of the suffixes of x, numbers from 1 to below 2**21, in order, by the difference cover {1, 2} modulo 3."""
    n = len(x)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: x[i:].tolist()), dtype=np.int64)
    top, s = int(x.max()) + 1, np.concatenate([x, np.zeros(3, dtype=np.int64)]).astype(np.int64)
    # a place past the end, if need be, keeps the two kinds of triples apart
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triples = (s[sample] * top + s[sample + 1]) * top + s[sample + 2]
    by = np.argsort(triples)
    new = np.ones(len(by), dtype=np.int64)
    new[1:] = triples[by][1:] != triples[by][:-1]
    names = np.empty(len(by), dtype=np.int64)
    names[by] = np.cumsum(new)
    sorted_sample = sample[by] if names.max() == len(names) else sample[suffix_array(names)]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    size = len(sample) + 1
    zero = np.arange(0, n, 3)
    first = s[zero] * size + rank[zero + 1]
    zero = zero[np.argsort(first)]
    # how many sampled suffixes come before each of the others
    kind = sorted_sample % 3
    ones, twos = sorted_sample[kind == 1], sorted_sample[kind == 2]
    ones = ones[ones < n]
    before = np.searchsorted(s[ones] * size + rank[ones + 1], s[zero] * size + rank[zero + 1])
    before += np.searchsorted((s[twos] * top + s[twos + 1]) * size + rank[twos + 2], (s[zero] * top + s[zero + 1]) * size + rank[zero + 2])
    out = np.full(n, -1, dtype=np.int64)
    out[before + np.arange(len(zero))] = zero
    out[out < 0] = sorted_sample[sorted_sample < n]
    return out


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of v[i:i + w] for each i: of block ends and block beginnings."""
    n = len(v) - w + 1
    blocks = np.concatenate([v, np.full(-len(v) % w, np.iinfo(v.dtype).max, dtype=v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


class Contexts:
    """Runs of strings of one anchor in a piece of data that holds texts, one after the other: lo, n, and hashes of anchor and context."""

    __slots__ = ("_down", "_sums", "g", "h", "lo", "n")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int, gram: int):
        n = len(data)
        none = np.zeros(0, dtype=np.int64)
        self.lo, self.n, self.g, self.h = none, none, none.astype(np.uint64), none.astype(np.uint64)
        if n < k:
            return
        up, down = _BYTES_BASE.upto(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        self._sums, self._down = sums, down
        grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        at = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), k - gram + 1) & low).astype(np.int64)
        inside = np.ones(n - k + 1, dtype=bool)
        for x in offsets[1:-1].tolist():
            inside[max(0, x - k + 1) : x] = False
        start = np.flatnonzero(inside)
        if not len(start):
            return
        at = at[start]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        self.lo, self.n = start[first], np.diff(np.append(first, len(start)))
        anchor = at[first]
        self.g = grams[anchor] | np.uint64(1)  # 0 marks what is known to go
        with np.errstate(over="ignore"):
            shape = (self.n + ((anchor - self.lo) << 8)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            self.h = mix(self.hashed(self.lo, self.n + k - 1) + shape)

    def hashed(self, lo: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self._sums[lo + size] - self._sums[lo]) * self._down[lo])


def pieces(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, offsets, first byte) of runs of texts; a text of more than a chunk comes in pieces that share k - 1 bytes."""
    for at, end, data, offsets in sized(column):
        data, offsets = data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
        if end - at > 1 or len(data) <= CHUNK_BYTES + k:
            yield np.arange(at, end), data, offsets, 0
            continue
        for i in range(0, len(data) - k + 1, CHUNK_BYTES):
            part = data[i : i + CHUNK_BYTES + k - 1]
            yield np.array([at]), part, np.array([0, len(part)]), i


def _ordered(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of p in order, each place once, and whether each is the earliest of its context."""
    by = np.lexsort([p[c] for c in ORDER])
    q = p[by]
    new, same = np.ones(len(q), dtype=bool), np.zeros(len(q), dtype=bool)
    new[1:] = (q["g"][1:] != q["g"][:-1]) | (q["h"][1:] != q["h"][:-1])
    same[1:] = ~new[1:] & (q["doc"][1:] == q["doc"][:-1]) & (q["more"][1:] == q["more"][:-1]) & (q["lo"][1:] == q["lo"][:-1])
    return by[~same], new[~same]


def _row_bucket(p: np.ndarray, buckets: int) -> np.ndarray:
    return packed.bucket_of(mix(p["doc"].astype(np.uint64) ^ p["more"]), buckets)


def _posted(c: Contexts, keep: np.ndarray, rows: np.ndarray, offsets: np.ndarray, base: int, doc: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Records of the contexts keep."""
    p = np.empty(len(keep), dtype=CONTEXT)
    text = np.searchsorted(offsets, c.lo[keep], side="right") - 1
    p["g"], p["h"], p["n"] = c.g[keep], c.h[keep], c.n[keep]
    p["doc"], p["more"], p["lo"] = doc[rows[text]], more[rows[text]].view(np.uint64), c.lo[keep] - offsets[text] + base
    return p


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)


def _contexts(k: int, gram: int, seen: Broadcast, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, held, n = seen.value, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            p = np.concatenate(held)
            by, new = _ordered(p)
            sent, rest = p[by[new]], p[by[~new]]
            yield packed.dealt(packed.bucket_of(mix(sent["g"]), buckets), sent)
            if len(rest):
                rest["g"] = 0
                yield packed.dealt(_row_bucket(rest, buckets), rest)

        for b in batches:
            doc, more = _columns(b)
            for rows, data, offsets, base in pieces(b.column(2), k):
                c = Contexts(data, offsets, k, gram)
                keep = np.flatnonzero(countmin.reached(repeated, c.g)) if len(c.g) else c.lo
                if len(keep):
                    held.append(_posted(c, keep, rows, offsets, base, doc, more))
                    n += len(keep)
                if n > most:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()
        trim()

    return run


def _gone(p: np.ndarray, buckets: int) -> pa.RecordBatch:
    out = np.empty(len(p), dtype=GONE)
    out["doc"], out["more"], out["lo"], out["n"] = p["doc"], p["more"], p["lo"], np.maximum(p["n"], 1)
    return packed.dealt(_row_bucket(out, buckets), out)


SETTLED = "kind int, bucket int, records binary"


def _kind(kind: int, b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, dtype=np.int32)), b.column(0), b.column(1)], names=["kind", "bucket", "records"])


def _settled(buckets: int, large: int):
    """Kind 0: places of strings that go; 1: anchors of two and more contexts; 2: anchors of more than large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = packed.gathered(batches, CONTEXT)
        known, p = p[p["g"] == 0], p[p["g"] > 0]
        by, new = _ordered(p)
        p = p[by]
        yield _kind(0, _gone(np.concatenate([known, p[~new]]), buckets))
        gram, count = np.unique(p["g"][new], return_counts=True)
        for kind, chosen in ((1, gram[(count > 1) & (count <= large)]), (2, gram[count > large])):
            if len(chosen):
                yield _kind(kind, packed.dealt(np.zeros(len(chosen), dtype=np.int64), chosen))
        trim()

    return run


BYTES = "bucket int, records binary, bytes binary"


def _byted(bucket: np.ndarray, p: np.ndarray, text: list[bytes]) -> pa.RecordBatch:
    """A row for each bucket, with its records and their bytes."""
    order = np.argsort(bucket, kind="stable")
    b = packed.dealt(bucket, p)
    at = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    data = [b"".join(text[i] for i in order[x:y].tolist()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["bucket", "records", "bytes"])


def _dealt(k: int, gram: int, several: Broadcast | None, many: Broadcast | None, buckets: int, most: int):
    """Contexts of anchors that have several, with their bytes; of anchors that have very many, their strings by hashes of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, text, n = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            p = np.concatenate(held)
            by, new = _ordered(p)
            p = p[by]
            yield _byted(packed.bucket_of(mix(p["g"][new]), buckets), p[new], [text[i] for i in by[new].tolist()])
            rest = p[~new & (p["n"] == 0)]  # equal contexts are settled already
            if len(rest):
                rest["g"] = 0
                yield _byted(_row_bucket(rest, buckets), rest, [b""] * len(rest))

        for b in batches:
            doc, more = _columns(b)
            for rows, data, offsets, base in pieces(b.column(2), k):
                c = Contexts(data, offsets, k, gram)
                if not len(c.g):
                    continue
                hot = countmin.reached(many.value, c.g) if many else np.zeros(len(c.g), dtype=bool)
                if several and len(keep := np.flatnonzero(countmin.reached(several.value, c.g) & ~hot)):
                    held.append(_posted(c, keep, rows, offsets, base, doc, more))
                    raw = data.tobytes()
                    text += [raw[a:e] for a, e in zip(c.lo[keep].tolist(), (c.lo + c.n + k - 1)[keep].tolist(), strict=True)]
                    n += len(keep)
                if len(keep := np.flatnonzero(hot)):
                    p = np.repeat(_posted(c, keep, rows, offsets, base, doc, more), c.n[keep])
                    step = np.arange(len(p)) - np.repeat(np.cumsum(c.n[keep]) - c.n[keep], c.n[keep])
                    first, half = np.repeat(c.lo[keep], c.n[keep]) + step, k // 2
                    x, y = c.hashed(first, half), c.hashed(first + half, k - half)
                    with np.errstate(over="ignore"):
                        p["g"], p["h"] = mix(x + y * np.uint64(0xD1342543DE82EF95)) | np.uint64(1), mix(y + x * np.uint64(0xAF251AF3B0F025B5))
                    p["lo"] += step.astype(np.uint32)
                    p["n"] = 0
                    held.append(p)
                    text += [b""] * len(p)
                    n += len(p)
                if n > most:
                    yield from flush()
                    held, text, n = [], [], 0
        if n:
            yield from flush()
        trim()

    return run


def repeats(p: np.ndarray, text: list[bytes], k: int) -> np.ndarray:
    """Of contexts p with their bytes, a row of GONE for each string that equals an earlier one."""
    size = np.array([len(x) for x in text], dtype=np.int64)
    base = np.cumsum(size + 1) - size - 1
    joined = np.frombuffer(b"\0".join(text) + b"\0", dtype=np.uint8)
    x = joined.astype(np.int64) + 1
    start = np.repeat(base, p["n"]) + np.arange(int(p["n"].sum())) - np.repeat(np.cumsum(p["n"].astype(np.int64)) - p["n"], p["n"])
    owner = np.full(len(x), -1, dtype=np.int64)
    owner[start] = np.repeat(np.arange(len(p)), p["n"])
    x[base + size] = 1 + 256  # between contexts
    sa = suffix_array(x)
    sa = sa[owner[sa] >= 0]
    view = np.lib.stride_tricks.sliding_window_view(joined, k)
    same = np.zeros(len(sa), dtype=bool)
    for a in range(1, len(sa), 1 << 14):
        e = min(a + (1 << 14), len(sa))
        same[a:e] = (view[sa[a:e]] == view[sa[a - 1 : e - 1]]).all(1)
    group, own = np.cumsum(~same), owner[sa]
    out = np.empty(len(sa), dtype=GONE)
    out["doc"], out["more"], out["lo"], out["n"] = p["doc"][own], p["more"][own], p["lo"][own] + (sa - base[own]).astype(np.uint32), 1
    by = np.lexsort([out["lo"], out["more"], out["doc"], group])
    first = np.ones(len(by), dtype=bool)
    first[1:] = group[by][1:] != group[by][:-1]
    return out[by[~first]]


def _arrayed(k: int, buckets: int):
    """Places of strings that go, from contexts that are together by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, text = [], []
        for b in batches:
            for r, raw in zip(b.column(1), b.column(2), strict=True):
                own, raw = np.frombuffer(r.as_py(), dtype=CONTEXT), raw.as_py()
                ends = np.cumsum(np.where((own["n"] > 0) & (own["g"] > 0), own["n"].astype(np.int64) + k - 1, 0)).tolist()
                parts.append(own)
                text += [raw[a:e] for a, e in zip([0, *ends[:-1]], ends, strict=True)]
        p = np.concatenate(parts) if parts else np.zeros(0, dtype=CONTEXT)
        by, new = _ordered(p)
        p = p[by]
        if len(lost := p[(p["g"] == 0) | (~new & (p["n"] == 0))]):
            yield _gone(lost, buckets)
        kept = np.flatnonzero(new & (p["n"] > 0) & (p["g"] > 0))
        gram = p["g"][kept]
        edge = np.append(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else [0], len(gram))
        upto = np.concatenate([[0], np.cumsum(p["n"][kept].astype(np.int64) + k)])
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(upto[edge], upto[edge[i]] + SHARE, side="right")) - 1)
            own = kept[edge[i] : edge[j]]
            if len(own) > j - i:  # else each anchor has one context
                found = repeats(p[own], [text[t] for t in by[own].tolist()], k)
                yield packed.dealt(_row_bucket(found, buckets), found)
            i = j
        trim()

    return run


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, more, runs): for each row its runs of starts, as first ones and numbers."""
    p = packed.gathered(batches, GONE)
    p = p[np.lexsort([p["lo"], p["more"], p["doc"]])]
    end = p["lo"].astype(np.int64) + p["n"]
    row = np.ones(len(p), dtype=bool)
    row[1:] = (p["doc"][1:] != p["doc"][:-1]) | (p["more"][1:] != p["more"][:-1])
    run = row.copy()
    run[1:] |= p["lo"][1:] > end[:-1]
    at = np.flatnonzero(run)
    last = np.maximum.reduceat(end, at) if len(at) else end
    runs = np.stack([p["lo"][at], (last - p["lo"][at]).astype(np.uint32)], axis=1).astype("<u4")
    edge = np.append(np.flatnonzero(row[at]), len(at))
    for i in range(0, len(edge) - 1, 1000):
        e = edge[i : i + 1001].tolist()
        lists = [runs[a:b].tobytes() for a, b in zip(e[:-1], e[1:], strict=True)]
        first = p[at[e[:-1]]]
        yield pa.RecordBatch.from_arrays([pa.array(first["doc"]), pa.array(first["more"].view(np.int64)), pa.array(lists, pa.binary())], names=["doc", "more", "runs"])
    trim()


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, more, text): doc and more tell rows apart, and doc orders them."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("more"), "text")


def _sketch_of_records(rows: DataFrame, bits: int) -> Broadcast:
    def grams(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for x in b.column(0):
            yield np.frombuffer(x.as_py(), dtype="<u8")

    return countmin.sketch(rows.select("records"), grams, bits, 1)


def repeated_runs(docs: DataFrame, k: int = 100, gram: int = GRAM, large: int = LARGE, bits: int | None = None, flush: int = FLUSH) -> DataFrame:
    """(doc, more, runs): for rows of docs (see _rows) that have strings which start earlier too, these as runs of starts."""
    spark = docs.sparkSession
    narrow_batches(spark)
    gram, n, rows = min(gram, k), partitions(spark), _rows(docs)
    buckets = 4 * n
    if bits is None:  # about sixteen cells for each anchor, as far as the bound goes
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(SKETCH_BITS, max(22, (2 * size // (k - gram + 2)).bit_length() + 4))

    def anchors(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, offsets, _ in pieces(b.column(0), k):
            yield Contexts(data, offsets, k, gram).g

    seen = countmin.sketch(rows.select("text"), anchors, bits, 2)
    met = rows.mapInArrow(_contexts(k, gram, seen, buckets, flush), packed.SCHEMA).repartition(n, "bucket")
    settled = cut(met.mapInArrow(_settled(buckets, large), SETTLED))
    counts = {r.kind: r.n // 8 for r in settled.where("kind > 0").groupBy("kind").agg(F.sum(F.octet_length("records")).alias("n")).collect()}
    sets = [_sketch_of_records(settled.where(F.col("kind") == kind), min(SKETCH_BITS, max(22, counts[kind].bit_length() + 5))) if counts.get(kind) else None for kind in (1, 2)]
    gone = settled.where("kind = 0").select("bucket", "records")
    if counts:
        dealt = rows.mapInArrow(_dealt(k, gram, *sets, buckets, flush // 8), BYTES).repartition(n, "bucket")
        gone = gone.union(dealt.mapInArrow(_arrayed(k, buckets), packed.SCHEMA))
    found = cut(gone.repartition(n, "bucket").mapInArrow(_by_row, "doc long, more long, runs binary"))
    for b in (seen, *sets):
        if b is not None:
            b.destroy()
    return found


def without(text: bytes, runs: np.ndarray, k: int) -> tuple[int, int, bytes]:
    """(bytes removed, spans of them, the others) of a text; runs: (first start, starts), in order."""
    lo, hi = runs[:, 0].astype(np.int64), runs.sum(1, dtype=np.int64) + k - 1
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    lo, hi = lo[at], hi[np.append(at[1:], len(hi)) - 1]
    kept = [text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True)]
    return int((hi - lo).sum()), len(lo), b"".join(kept)


def dedup(docs: DataFrame, k: int = 100, with_bytes: bool = False, **options) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if with_bytes; options as in repeated_runs."""
    runs = repeated_runs(docs, k, **options).select(F.col("doc").alias("d"), F.col("more").alias("m"), "runs")
    base = _rows(docs).withColumns({"id": F.when(F.col("doc") != NO_ID, F.col("doc")), "key": F.xxhash64("doc", "more")})
    may, whole = parted(base, "key", runs.select(F.xxhash64("d", "m").alias("key")))
    joined = may.join(runs, (F.col("doc") == F.col("d")) & (F.col("more") == F.col("m")), "left").select("id", "text", "runs")
    joined = joined.union(whole.select("id", "text", F.lit(None).cast("binary").alias("runs")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, own in zip(b.column(1), b.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                gone, spans, kept = without(raw, np.frombuffer(own.as_py(), dtype="<u4").reshape(-1, 2), k) if own.is_valid else (0, 0, raw)
                out.append((len(raw), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = [b.column(0), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))]
            columns += [pa.array([x[4] for x in out], pa.binary())] if with_bytes else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(rows, f"{schema}, kept binary" if with_bytes else schema)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), 100)


#: Bytes as pairs of hexadecimal digits; a string of 100 bytes is told by its MD5.
ORACLE = """
WITH x AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT *, unnest(range(greatest(n - 99, 0))) AS i FROM x)
), g AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS FIRST, i) AS r FROM w) WHERE r > 1
), o AS (SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g
), s AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o
), t AS (SELECT doc_id, span, min(i) AS lo, max(i) + 100 AS hi FROM s GROUP BY doc_id, span
), k AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS prev FROM t
), a AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed, string_agg(substr(x, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept FROM k JOIN x USING (doc_id) GROUP BY doc_id)
SELECT x.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM x LEFT JOIN a ON x.doc_id = a.doc_id
"""

QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}
ORACLES = {"op13_suffix_dedup": ORACLE}
