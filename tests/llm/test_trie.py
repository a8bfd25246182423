"""op12: the prefix trie against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from netmoment.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in convs.items()}
    digest = {x[2]: x[1] for t in convs.values() for x in t}
    nodes, ends = {}, {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + t[h:]
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    order = sorted(nodes, key=lambda p: [digest[x] for x in p])
    at = {p: i for i, p in enumerate(order)}
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        told = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, told, at[p], at[p] + len(below)))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in prefix_trie.trie(df).collect())


def chats(rng, n, most, words=2):
    return [(c, t, rng.choice(["user", "bot"]), f"{rng.randrange(words)}é" * rng.randrange(3)) for c in range(n) for t in range(rng.randrange(1, most))]


def test_as_plain(spark):
    rng = random.Random(1)
    rows = chats(rng, 60, 9) + [(c, t, "user", "the same") for c in range(100, 140) for t in range(12)]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(6)) == plain(rows)


@pytest.mark.parametrize("deepest", [33, 70, 150])
def test_deep(spark, deepest):
    rng = random.Random(deepest)
    rows = [(c, t, "user", "x" if t < deepest - 20 * (c % 4) - 3 else str(rng.randrange(2))) for c in range(0, 40, 5) for t in range(deepest - c // 5)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", None), (0, 1, "user", ""), (0, 1, "user", ""), (1, 0, None, "a"), (None, 0, "user", "lost"), (7, None, "b", "é" * 5000), (-3, 0, "u", "t"), (-8, 2, "u", "t"), (9, 5, "user", "short"), (11, 0, "a", "bc"), (12, 0, "ab", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain(rows)
    clash = df.selectExpr("*", "1 as g", "2 as digest", "3 as bytes", "4 as depth", "5 as label", "6 as pre", "7 as a", "8 as total", "9 as hot")
    assert got(clash) == plain(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_one_node_in_many_partitions(spark):
    rows = [(c, 0, "user", "hi") for c in range(0, 3000, 5)] + chats(random.Random(3), 10, 4)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(6)) == plain(rows)


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(10)) for k in range(3) for i in range(50)]
    found = prefix_trie.running(spark.createDataFrame(rows, "k long, i long, v long").repartition(5), ["k"], "i", ["v"], (4, 3)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.v_upto == sum(v for k, i, v in rows if k == r.k and i <= r.i)


def test_same_as_sql(spark, sf_dir, duck):
    got = prefix_trie.op12_prefix_trie(spark, sf_dir)
    want = duck.sql(prefix_trie.ORACLE)
    assert want.columns == got.columns
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.collect())
