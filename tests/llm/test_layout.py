"""op2, op6 and the pipeline: shards, mixes and the stages together."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netmoment.llm import decontamination, jaccard_join, mixing, quality, sharding
from netmoment.llm.tables import parted, table
from tests.llm.conftest import SCHEMA, odd_rows, prose


@pytest.mark.parametrize("limit", [200, 2000, 50_000])
def test_shards_keep_the_limit(spark, sf_dir, limit):
    docs = table(spark, sf_dir, "documents")
    got = sharding.shards(docs, limit).select("doc_id", "shard", "bytes").collect()
    assert len(got) == docs.count()
    size, rows = Counter(), Counter()
    for r in got:
        size[r.shard] += r.bytes
        rows[r.shard] += 1
    assert all(v <= limit or rows[k] == 1 for k, v in size.items())
    names = sorted(k for k in size if "." not in k)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # a prefix code
    # only oversized buckets split: siblings together are over the limit
    both = defaultdict(int)
    for k, v in size.items():
        for d in range(len(k.split(".")[0])):
            both[k[:d]] += v
    assert all(both[k[:-1]] > limit for k in names if k)


def test_same_as_sql(spark, same_as_sql):
    from netmoment import llm

    same_as_sql(llm.queries()["op2_sharding"], llm.oracle_sql()["op2_sharding"])


@pytest.mark.parametrize("limit", [1, 60, 700])
def test_shards_by_splitting_buckets(spark, limit):
    rng = random.Random(limit)
    rows = [(i, "é" * rng.randrange(40)) for i in range(300)] + [(5, "equal")] * 200 + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    buckets = {"": [(r.h, r.bytes) for r in docs.select(sharding.hashed(F.col("doc_id"), F.col("text")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).collect()]}
    want = Counter()
    while buckets:
        name, held = buckets.popitem()
        if sum(b for _, b in held) <= limit:
            want[name] = len(held)
        elif len(name) == sharding.MAX_BITS:
            fit = max(1, limit // held[0][1])
            for i in range(0, len(held), fit):
                want[f"{name}.{held[0][0]:X}.{i // fit}"] = min(fit, len(held) - i)
        else:
            for bit in "01":
                if part := [x for x in held if f"{x[0]:060b}"[len(name)] == bit]:
                    buckets[name + bit] = part
    assert Counter(r.shard for r in sharding.shards(docs, limit).collect()) == want


def test_shards_of_odd_rows(odd, clashing, empty):
    for limit in (1, 100, 10**6):
        got = sharding.shards(odd, limit).collect()
        assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str(r[:2]) for r in odd_rows())
    got = sharding.shards(clashing, 100)
    assert got.count() == len(odd_rows()) and got.columns == [*(c for c in clashing.columns if c not in ("bytes", "shard")), "bytes", "shard"]
    assert got.where("h <> 1 or whole <> 1 or depth <> 1 or cell <> 1").count() == 0
    assert sharding.shards(empty).count() == 0


def test_equal_rows_are_paged(spark):
    docs = spark.createDataFrame([(1, "ten bytes!")] * 25 + [(2, "x" * 100)], "doc_id long, text string")
    got = Counter(r.shard for r in sharding.shards(docs, 40).collect())
    assert sorted(got.values()) == [1, 1, 4, 4, 4, 4, 4, 4]


def water_fill(sizes, weights, cap=3):
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if share * weights[i] > cap * sizes[i]}
        if not full:
            for i in open_:
                target[i] = share * weights[i]
            break
        for i in full:
            target[i] = float(cap * sizes[i])
            left -= target[i]
        open_ -= full
    return target


def test_targets(spark, odd):
    for rows in ([("a", 5), ("b", 100), (None, 7), ("c", 1000), ("d", 0)], [("a", 10), ("b", 10)], [("x", 0)]):
        got = mixing.targets(spark.createDataFrame(rows, "source string, size long"), (1, 2, 3), 3).orderBy("sid").collect()
        order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
        assert [r.source for r in got] == [s for s, _ in order]
        np.testing.assert_allclose([r.target or 0 for r in got], water_fill([n for _, n in order], [(1, 2, 3)[i % 3] for i in range(len(order))]))


def test_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mix = mixing.Mix(docs, block_words=2000, shard_words=20_000)
    got = mix.taken().collect()
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    longest = max(r.size for r in got)
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        x = by[source[r.doc_id]]
        x[0], x[1], x[2] = r.source_size, r.target, x[2] + r.taken
    assert all(abs(x[2] - x[1]) <= longest for x in by.values())
    assert sum(x[1] for x in by.values()) == pytest.approx(sum(r.size for r in got))
    again = mixing.Mix(docs.repartition(3), block_words=2000, shard_words=20_000).taken().collect()
    assert sorted((r.doc_id, tuple(r.shards)) for r in got) == sorted((r.doc_id, tuple(r.shards)) for r in again)
    words = Counter()
    for r in got:
        for s in r.shards:
            words[s] += r.size
    assert len(words) == mix.shards and max(words.values()) < 2.5 * np.mean(list(words.values()))
    rows = mix.mixed().groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {r.doc_id: len(r.shards) for r in got if r.shards}


@pytest.mark.parametrize("bits", [16, 27])
def test_parts_by_a_bitmap(spark, bits):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("key"), F.lit("x").alias("held"), F.lit("y").alias("bucket"))
    wanted = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("key"))
    may, whole = parted(rows, "key", wanted, bits)
    assert may.columns == whole.columns == rows.columns
    a, b = {r.id for r in may.collect()}, {r.id for r in whole.collect()}
    assert a | b == set(range(5000)) and not a & b and a >= set(range(0, 5000, 7)) and len(a) < 715 * (1 + 5000 / 2**16 * 2)
    may, whole = parted(rows, "key", wanted.limit(0), bits)
    assert may.count() == 0 and whole.count() == 5000


def test_splitting_tree_is_whole():
    quotas = np.array([100, 7, 0, 1])
    leaves = list(mixing.split_tree(quotas, 0, 13, 5))
    assert [x[0] for x in leaves] == list(range(13)) and (sum(x[2] for x in leaves) == quotas).all()
    assert all((b[3] == a[2] + a[3]).all() for a, b in zip(leaves, leaves[1:], strict=False)) and not leaves[0][3].any()
    parts = [x for first, n, q, b in mixing.split_tree(quotas, 0, 13, 5, stop=4) for x in mixing.split_tree(q, first, n, 5, begin=b)]
    assert [x[0] for x in parts] == list(range(13)) and all((a[k] == b[k]).all() for a, b in zip(parts, leaves, strict=True) for k in (2, 3))


def test_leaves_own_each_drawn_block_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_BITS", 2)
    mix = mixing.Mix(table(spark, sf_dir, "documents"), block_words=500, shard_words=9000)
    quota = Counter()
    for r in mix.blocks.collect():
        quota[r.sid] += r.draws
    owned = defaultdict(list)
    for r in mix.shard_ranges().collect():
        owned[r.sid].append((r.draw, r.shard))
    assert mix.shards > 8 and all(sorted(d for d, _ in owned[s]) == list(range(q)) for s, q in quota.items())
    assert all([s for _, s in sorted(v)] == sorted(s for _, s in v) for v in owned.values())
    # the blocks before each one, summed plainly
    words = defaultdict(list)
    for r in mix.placed.groupBy("sid", "block").agg(F.sum("size").alias("words")).orderBy("sid", "block").collect():
        words[r.sid].append(r.words)
    for r in mix.blocks.collect():
        assert r.before == sum(words[r.sid][: r.number]) and r.n_blocks == len(words[r.sid])


def test_rows_that_differ_in_other_columns_only_are_all_mixed(spark):
    rows = [(1, "a b c", "s", "x"), (1, "a b c", "u", "y"), (1, "a b c", "s", "z"), (1, "a b c", "s", "z"), (2, "d e", "u", None), (2, "d e", "u", None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string").withColumn("more", F.create_map(F.lit("k"), F.col("extra")))
    mix = mixing.Mix(docs)
    want = Counter()
    for r in mix.taken().join(docs.select("*", mixing.row_key(docs).alias("key")).dropDuplicates(["key"]).drop("doc_id"), "key").collect():
        want[r.doc_id, r.text, r.source, r.extra] += len(r.shards)
    got = Counter((r.doc_id, r.text, r.source, r.extra) for r in mix.mixed().collect())
    assert got == +want and len(got) >= 3


def test_mix_of_odd_rows(odd, clashing, empty):
    for t in (odd, clashing):
        mix = mixing.Mix(t, block_words=50, shard_words=500)
        got = mix.taken().collect()
        assert len(got) == len(odd_rows())
        assert mix.mixed().columns == t.columns
        assert mix.mixed().count() == sum(len(r.shards) for r in got)
    assert mixing.Mix(empty).taken().count() == 0 and mixing.Mix(empty).mixed().count() == 0
    none = empty.union(odd.where("trim(text) = ''"))
    assert {(r.taken, r.target) for r in mixing.Mix(none).taken().collect()} == {(0, 0.0)}


# Pipeline


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    quality_ = {r.doc_id for r in quality.op7_quality(spark, sf_dir).where("predicted = 1").collect()}
    out = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert {r.doc_id for r in out.collect()} == quality_
    unique = corpus_pipeline.STAGES[1][1](spark, out, sf_dir)
    want = {r.component_id for r in jaccard_join.components(out).where("n_shingles > 0").collect()}
    assert {r.doc_id for r in unique.collect()} == want
    clean = corpus_pipeline.STAGES[2][1](spark, unique, sf_dir)
    leaks = {r.doc_id for r in decontamination.matches(unique, table(spark, sf_dir, "benchmark")).collect()}
    assert {r.doc_id for r in clean.collect()} == want - leaks
    assert all(f(spark, docs, sf_dir).columns == docs.columns for _, f in corpus_pipeline.STAGES[:-1])


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "bytes"} == set(got.columns)
    assert got.count() > 500


def test_stages_of_odd_rows(spark, sf_dir, clashing, odd, empty):
    held = Counter((r.doc_id, r.text, r.source) for r in odd.collect())
    more = clashing.withColumn("extra", F.concat_ws("/", "doc_id", "source"))
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, more, sf_dir)
        last = name == "sharding"
        assert got.columns == ([c for c in more.columns if c not in ("bytes", "shard")] + ["bytes", "shard"] if last else more.columns)
        rows = got.collect()
        found = Counter((r.doc_id, r.text, r.source) for r in rows)
        # no row is made up, and each keeps its other columns
        assert found.keys() <= held.keys() and all(r.extra == "/".join(str(x) for x in (r.doc_id, r.source) if x is not None) and r.n == r.label == r._gone == 1 for r in rows)
        if name in ("decontamination", "sharding"):  # no odd row holds a test item
            assert found == held
        elif name == "mixing":
            assert all(v <= 3 * held[k] for k, v in found.items())
        else:
            assert all(v <= held[k] for k, v in found.items())
    docs = spark.createDataFrame([(i, prose(random.Random(i), 80), "en", "s", 1) for i in range(30)], SCHEMA)
    for t in (empty, docs):
        for _, f in corpus_pipeline.STAGES:
            t = f(spark, t, sf_dir)
            t.collect()
