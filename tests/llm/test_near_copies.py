"""op1, op8, op10: duplicates of documents, passages and lines, against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netmoment.llm import countmin, jaccard_join, line_dedup, sigtree, substring_dedup
from netmoment.llm.tokens import words
from tests.llm.conftest import SCHEMA, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    smallest = {}
    for (d, _), x in zip(rows, label, strict=True):
        if d is not None:
            smallest[x] = min(smallest.get(x, d), d)
    return sorted(((d, len(s), smallest.get(x) if s else d) for (d, _), s, x in zip(rows, sets, label, strict=True)), key=str)


def near_copies(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = prose(rng, rng.choice([3, 6, 12, 40, 150]), 300).split()
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 20])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return [(i, t) for i, t in enumerate(out[:n])]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(spark, seed):
    rows = near_copies(250, seed)
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows)


def test_components_of_odd_rows(odd, clashing, empty):
    want = brute_components([r[:2] for r in odd_rows()])
    for t in (odd, clashing):
        assert sorted((tuple(r) for r in jaccard_join.components(t).collect()), key=str) == want
    assert jaccard_join.components(empty).count() == 0


@pytest.mark.parametrize(("edits", "local", "rounds"), [(1, 5, 1), (3, 10**6, 0), (6, 10**6, 1)])
def test_large_groups_are_cut_into_blocks(spark, monkeypatch, edits, local, rounds):
    monkeypatch.setattr(jaccard_join, "LATE_BITS", 21)
    bounds = jaccard_join.Bounds(block=7, local=local, rounds=rounds, pivots=2)
    rng = random.Random(3)
    rows = []
    for k in range(2):
        base = prose(rng, 120, 10**6).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(50):
            # with 3 edits or more few copies are linked with each other, and some with no other
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    # texts that share a passage, and no more, with many others
    passage = prose(rng, 12, 10**6)
    rows += [(len(rows) + k, f"{prose(rng, 25, 10**6)} {passage} {prose(rng, 25, 10**6)}") for k in range(25)]
    rows += [(i + 1000, t + " end") for i, t in rows[-5:]]
    rng.shuffle(rows)
    want = brute_components(rows)
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), bounds)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len({r[2] for r in want}) > (edits > 3)


def shared_shingle(n, others):
    """n nine-word texts that share their first shingle and no other, in one part; in others parts a copy of one of them with one word more, and a filler."""
    texts = [f"one rare shingle of all a{i} b{i} c{i} d{i}" for i in range(n)]
    part = [(i, t) for i, t in enumerate(texts)]
    return [part] + [[(1000 * (k + 1), texts[253 % n - k] + " more"), (1000 * (k + 1) + 1, f"a filler that is like none of the others {k} {k} {k}")] for k in range(others)]


@pytest.mark.parametrize(
    ("n", "others", "bounds"),
    [(258, 1, jaccard_join.Bounds()), (30, 7, jaccard_join.Bounds(local=4)), (30, 1, jaccard_join.Bounds(local=4, block=7, rounds=0)), (30, 7, jaccard_join.Bounds(local=4, rounds=2))],
)
def test_links_do_not_depend_on_parts(spark, monkeypatch, n, others, bounds):
    monkeypatch.setattr(jaccard_join, "LATE_BITS", 21)
    parts = shared_shingle(n, others)
    want = brute_components([r for p in parts for r in p])
    assert sum(1 for d, _, c in want if d >= 1000 and c < 1000) == others
    rdd = spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda p: p)
    df = spark.createDataFrame(rdd, "doc_id long, text string")
    assert df.rdd.getNumPartitions() == others + 1
    for t in (df, df.coalesce(1), df.repartition(8)):
        assert sorted((tuple(r) for r in jaccard_join.components(t, bounds).collect()), key=str) == want
    kept = {r.doc_id for r in jaccard_join.representatives(df, bounds).collect()}
    assert kept == {c for _, _, c in want}


def brute_representatives(rows):
    """Indices of rows: one of each component, the first by (no id, id); which of equal ids is free."""
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    groups = defaultdict(list)
    for i, x in enumerate(label):
        groups[x if sets[i] else (i,)].append(i)
    return [(min((rows[i][0] is None, rows[i][0] or 0) for i in g), g) for g in groups.values()]


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(12)
    base = prose(rng, 60, 10**6)
    near = [base.replace(base.split()[k], f"x{k}") for k in (10, 30, 50)]
    rows = [(3, base, "a"), (5, base, "b"), (5, prose(rng, 40, 10**6), "c"), (5, prose(rng, 40, 10**6), "c"), (None, near[0], "d"), (None, "alone without an id", "e"), (None, "alone without an id", "e")]
    rows += [(9, x, "same id") for x in near]
    other = prose(rng, 60, 10**6)
    rows += [(8, other.replace(other.split()[k], f"y{k}"), "same id again") for k in (10, 30, 50)] + [(20, "", "f"), (20, "", "f"), (20, None, "f"), (21, "equal rows with", "x"), (21, "equal rows with", "y"), (21, "equal rows with", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").withColumn("more", F.create_map(F.lit("k"), F.col("extra"))).repartition(4)
    got = [(r.doc_id, r.text) for r in jaccard_join.representatives(docs).collect()]
    want = brute_representatives(rows)
    assert len(got) == len(want)
    for (none, doc_id), group in want:
        may = {(rows[i][0], rows[i][1]) for i in group}
        assert [d for d, t in got if (d, t) in may and (d is None, d or 0) == (none, doc_id)]


def test_representatives(odd, empty):
    left = jaccard_join.representatives(odd)
    assert left.columns == odd.columns
    found = Counter((r.doc_id, r.text) for r in left.collect())
    assert all(v == 1 for (d, t), v in found.items() if d is not None)
    assert (7, "another text with an id that is taken") in found and (None, "no id here") in found and (None, odd_rows()[7][1]) not in found
    assert (10, odd_rows()[10][1]) not in found and (7, odd_rows()[7][1]) in found and (0, None) in found
    assert jaccard_join.representatives(empty).count() == 0


def test_labels_by_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    label = {v: v for e in edges for v in e}
    for _ in range(80):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    rows = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for few in (0, 10**6):
        assert {r.v: r.label for r in jaccard_join.smallest_labels(rows, few).collect()} == label


def test_trees_lose_no_link():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sets = []
        for _ in range(rng.integers(1, 5)):
            base = rng.integers(0, 2**64, int(rng.integers(3, 600)), dtype=np.uint64)
            for _ in range(rng.integers(1, 40)):
                s = base.copy()
                k = int(len(base) * rng.random() * 0.25)
                s[rng.choice(len(s), k, replace=False)] = rng.integers(0, 2**64, k, dtype=np.uint64)
                sets.append(np.unique(s))
        sizes, bits = np.array([len(s) for s in sets]), [sigtree.signature(s) for s in sets]
        joined = list(range(len(sets)))
        exact = list(range(len(sets)))
        for label, pairs in ((joined, sigtree.candidates(sizes, bits)), (exact, sigtree.candidates(sizes, bits, sigtree.comparer(sets)))):
            for i, j in pairs:
                a, b = label[i], label[j]
                label[:] = [a if x == b else x for x in label]
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    assert joined[i] == joined[j] and exact[i] == exact[j]


# Windows of words


def brute_windows(rows, k):
    seen = defaultdict(list)
    for r, (_, t) in enumerate(rows):
        w = WORD.findall(t or "")
        for i in range(len(w) - k + 1):
            seen[tuple(w[i : i + k])].append((r, i))
    gone = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for r, i in places:
                gone[r].update(range(i, i + k))
    out = []
    for r, (d, t) in enumerate(rows):
        w = WORD.findall(t or "")
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[r])
        out.append((d, len(w), len(gone[r]), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "bits"), [(35, 28), (35, 21), (12, 21)])
def test_windows_by_brute_force(spark, k, bits):
    rng = random.Random(k)
    shared = [prose(rng, n, 10**5) for n in (k - 1, k, k + 1, 3 * k)]
    rows = [(i, " ".join([prose(rng, rng.randrange(60), 10**5), rng.choice(shared), prose(rng, rng.randrange(60), 10**5), *([rng.choice(shared)] * rng.randrange(2))])) for i in range(120)]
    rows.append((120, "same " * 200))
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, bits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_windows(rows, k)


def test_windows_of_odd_rows(odd, clashing, empty):
    want = brute_windows([r[:2] for r in odd_rows()], 35)
    for t in (odd, clashing):
        assert sorted((tuple(r) for r in substring_dedup.dedup(t).collect()), key=str) == want
    assert substring_dedup.dedup(empty).count() == 0


def test_sketch_counts_no_gram_too_low(spark):
    rows = near_copies(80, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bits, seen = 21, Counter()
    repeated = substring_dedup.sketch(docs, 20, bits).value
    for _, t in rows:
        for _, _, w in words(pa.array([t]), lower=False):
            seen.update(w.windows(8)[np.unique(substring_dedup.anchors(w, substring_dedup.span_of(20))[1])].tolist())
    grams = np.array(sorted(seen), dtype=np.uint64)
    cell = countmin.cells(grams, bits)
    assert len(cell) == countmin.ROWS >= 2 and all((c >> (bits - 1) == k).all() for k, c in enumerate(cell))
    each = repeated.bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1
    twice = np.array([seen[g] > 1 for g in grams.tolist()])
    assert (countmin.reached(repeated, grams) == each.min(0)).all() and each.min(0)[twice].all() and each.min(0)[~twice].sum() <= each.min(1).sum() and twice.any()


def test_kept_words_are_read_with_the_hashes(spark):
    rows = near_copies(40, 5) + [(100, None), (101, " \t "), (102, "a\nb\x0bc  d")]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 12, with_text=True).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and len(r.kept.split()) == r.n_words - r.n_removed for r in got)
    assert {r.doc_id: r.kept for r in got}[102] == "a b c d"


def test_flushes_keep_all_windows(spark):
    rows = near_copies(60, 9)
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 20, flush=10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_windows(rows, 20)


# Lines


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(d)
    keeper = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found_lines(docs, slice_rows=line_dedup.SLICE_ROWS):
    got = line_dedup._decided(docs, 20, 3, slice_rows).select("doc_id", "n_lines", "n_dropped", F.sha2(line_dedup.kept_text().cast("binary"), 256), "keep", "text").collect()
    for r in got:
        runs = [int(x) for x in r.keep.split(" ")]
        assert sum(runs) == r.n_lines and sum(runs[1::2]) == r.n_dropped and all(runs[1:])
        lines, at, kept = (r.text or "").split("\n"), 0, []
        for k, x in enumerate(runs):
            kept += lines[at : at + x] if k % 2 == 0 else []
            at += x
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == r[3]
    return sorted((tuple(r)[:4] for r in got), key=str)


def test_lines_by_brute_force(spark):
    rng = random.Random(8)
    pool = [prose(rng, 5, 10**4) for _ in range(12)] + ["short"]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), f"  {x} "]) for x in rng.choices(pool, k=rng.randrange(9)))) for i in range(80)]
    assert found_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute_lines(rows)


def test_frequent_lines_are_cut_into_slices(spark):
    rng = random.Random(9)
    pool = [prose(rng, 5, 10**4) for _ in range(6)]
    rows = [(i % 190 or None, "\n".join([rng.choice(pool), prose(rng, 6, 10**6), *rng.choices(pool[:2], k=rng.randrange(4))])) for i in range(200)] + [(500, "\n".join([pool[0]] * 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    runs = line_dedup.sorted_runs(line_dedup.occurrences(docs, 20), 20)
    assert runs.where("slice > 0").groupBy("a").agg({"slice": "max"}).count() >= 2
    assert found_lines(docs, 20) == found_lines(docs) == brute_lines(rows)


def test_lines_are_streamed_from_sorted_ranges(odd):
    plan = line_dedup.streamed(line_dedup.sorted_runs(line_dedup.occurrences(odd, 20)))._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Exchange rangepartitioning")[0]
    assert above.count("Window") >= 2 and above.count("Sort ") == 1 and "Exchange" not in above and "collect" not in above


def test_lines_of_odd_rows(odd, clashing, empty):
    want = brute_lines([r[:2] for r in odd_rows()])
    assert found_lines(odd) == want and found_lines(clashing) == want
    assert line_dedup.keep_bitmaps(empty).count() == 0


def test_lines_plan_is_native(odd):
    plan = line_dedup.keep_bitmaps(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op6_source_mix", "op8_substring_dedup", "op10_line_dedup"])
def test_same_as_sql(name, same_as_sql):
    from netmoment import llm

    same_as_sql(llm.queries()[name], llm.oracle_sql()[name])


def test_schema_used():
    assert SCHEMA.startswith("doc_id")


def _written(spark):
    """Bytes that all shuffles so far have written."""
    time.sleep(1)  # figures follow the tasks
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_texts_that_nobody_asked_for_stay_where_they_are(spark, monkeypatch):
    """Where there are too many keys to broadcast, a bitmap tells which texts go through the exchange, and results are the same."""
    texts = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: F.md5(F.concat_ws(":", "id", k)))).alias("text"))
    twice = texts.union(texts.where("doc_id < 5").select(F.col("doc_id") + 1000, "text"))
    keyed = jaccard_join.cut(twice.withColumn("key", jaccard_join.row_key(twice)))
    asked = keyed.where("doc_id < 3").select(F.lit(7).cast("long").alias("label"), F.col("doc_id").alias("set"), F.col("key").alias("own"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    want = rows(jaccard_join._texts(keyed, asked))
    monkeypatch.setattr(jaccard_join, "BROADCAST_DOCS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = _written(spark)
        assert rows(jaccard_join._texts(keyed, asked)) == want and len(want) == 3
        assert _written(spark) - before < 600 * 6400 / 8
        assert sorted(r.doc_id for r in jaccard_join.representatives(twice).collect()) == list(range(600))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
