"""op13: repeated byte strings against a dictionary of all of them."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netmoment.llm import suffix_dedup
from netmoment.llm.tables import table
from tests.llm.conftest import SCHEMA, odd_rows, prose


def plain(rows, k):
    """Rows of (doc_id, bytes, removed, spans, digest), sorted as text; order: of documents with equal ids."""
    seen, out = {}, []
    for doc_id, raw, copies in rows:
        cover = bytearray(len(raw))
        for i in range(len(raw) - k + 1):
            if seen.setdefault(raw[i : i + k], (doc_id, i, raw)) != (doc_id, i, raw):
                cover[i : i + k] = b"\1" * k
        spans = sum(x == 1 and (i == 0 or not cover[i - 1]) for i, x in enumerate(cover))
        kept = bytes(b for b, gone in zip(raw, cover, strict=True) if not gone)
        out += [str((doc_id, len(raw), sum(cover), spans, hashlib.sha256(kept).hexdigest()))] * copies
    return sorted(out)


def documents(df):
    """Distinct documents in order, with how many rows they are."""
    rows = df.groupBy("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("more")).count().collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.more % 2**64))
    return [(r.doc_id, r.text.encode(), r["count"]) for r in rows]


def got(df, k, **options):
    return sorted(str(tuple(r)) for r in suffix_dedup.dedup(df, k, **options).collect())


def texts(rng, n):
    base = [prose(rng, 60, 300) for _ in range(6)]
    out = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"é{i}"
        out.append(" ".join(words if i % 3 else [*words, "and", *rng.choice(base).split()[10:40]]))
    return [*out, "a" * 300, "ab" * 200, "xyz" * 100 + "a" * 150]


@pytest.mark.parametrize(("parts", "options"), [(1, {}), (5, {}), (5, {"gram": 12}), (5, {"gram": 100}), (1, {"large": 1}), (5, {"large": 3, "flush": 8, "gram": 40}), (3, {"flush": 1})])
def test_as_all_strings(spark, parts, options):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts(rng, 60))], SCHEMA).repartition(parts)
    assert got(df, 100, **options) == plain(documents(df), 100)


def test_short_strings(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, "".join(rng.choice("ab") for _ in range(rng.randrange(60))), None, None, 0) for i in range(80)], SCHEMA)
    for k, options in ((3, {}), (8, {"gram": 4}), (12, {"gram": 6, "large": 2})):
        assert got(df, k, **options) == plain(documents(df), k)


def test_odd_rows(odd, clashing, empty):
    want = plain(documents(odd), 100)
    assert got(odd, 100) == want and got(clashing, 100) == want and len(want) == len(odd_rows())
    assert got(empty, 100) == []


def test_a_hot_passage_between_other_texts(spark):
    rng = random.Random(5)
    passage = prose(rng, 30)
    df = spark.createDataFrame([(i, f"{prose(rng, 12)} {passage} {prose(rng, 12)}", None, None, 0) for i in range(150)], SCHEMA).repartition(6)
    want = plain(documents(df), 100)
    assert got(df, 100) == got(df, 100, large=20) == want


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1000)
    rng = random.Random(6)
    whole = prose(rng, 2000, 5000)
    rows = [(1, whole), (2, whole[777:9000]), (3, "q" * 5000), (4, whole[:1100] + "q" * 120)]
    data = [t.encode() for _, t in rows]
    # the pieces of a long text have the same strings as the text itself
    import pyarrow as pa

    found = {raw: set() for raw in data}
    for at, part, offsets, base in suffix_dedup.pieces(pa.array([t for _, t in rows]), 100):
        c = suffix_dedup.Contexts(part, offsets, 100, 64)
        for lo, n in zip(c.lo.tolist(), c.n.tolist(), strict=True):
            t = int(np.searchsorted(offsets, lo, side="right")) - 1
            found[data[at[t]]] |= {lo - int(offsets[t]) + base + i for i in range(n)}
    assert all(found[raw] == set(range(len(raw) - 99)) for raw in data)
    df = spark.createDataFrame([(*r, None, None, 0) for r in rows], SCHEMA)
    assert got(df, 100) == plain(documents(df), 100)


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n in [*range(1, 40), 300]:
        for top in (1, 2, 4, 300):
            x = rng.integers(1, top + 1, n)
            assert suffix_dedup.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_same_as_sql(same_as_sql):
    same_as_sql(suffix_dedup.op13_suffix_dedup, suffix_dedup.ORACLE)


def test_partitions_do_not_matter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert got(docs.repartition(11), 100) == got(docs.coalesce(1), 100, gram=48, large=5)
