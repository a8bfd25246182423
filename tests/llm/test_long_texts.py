"""Texts of many megabytes through every operator on documents."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from netmoment.llm import decontamination, html_extract, jaccard_join, license_scan, line_dedup, media, mixing, quality, sharding, substring_dedup
from tests.llm.conftest import prose

LINE = "a line that a long text has in common with two short ones"
N = 1_000_000


@pytest.fixture(scope="module")
def long(spark):
    """A text of 8 MB, its copy with one word changed, a word of 3 MB, and two short texts."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(N)]
    words[500_000:500_000] = license_scan.TEMPLATES["MIT", "MIT"].split()
    for i in range(0, N, 40):
        words[i] = words[i] + "\n"
    text = " ".join(words) + f"\n{LINE}"
    words[77] = "changed"
    rows = [(1, text, "s"), (2, " ".join(words) + f"\n{LINE}", "s"), (3, "x" * 3_000_000, "s"), (4, f"short\n{LINE}", "t"), (5, f"{LINE}\nshort too", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_near_copies(long):
    assert {r.doc_id: r.component_id for r in jaccard_join.components(long).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_passages_and_lines(long):
    got = {r.doc_id: r for r in substring_dedup.dedup(long).collect()}
    # but for the words about the changed one, which windows with it alone cover
    assert got[1].n_words == got[2].n_words > N and got[1].n_words - got[1].n_removed == got[2].n_words - got[2].n_removed == 1
    assert got[3].n_words == 1 and got[3].n_removed == 0 and got[3].kept_sha256 == hashlib.sha256(b"x" * 3_000_000).hexdigest()
    lines = {r.doc_id: r for r in line_dedup.keep_bitmaps(long).collect()}
    assert lines[5].n_dropped == 0 and lines[4].n_dropped == 1 and lines[1].n_dropped == 1 and lines[1].n_lines > N // 40
    assert lines[4].keep == "1 1" and lines[1].keep == f"{lines[1].n_lines - 1} 1"


def test_scans(spark, long):
    assert [(r.doc_id, r.template) for r in license_scan.scan(long).where("template = 'MIT'").orderBy("doc_id").collect()] == [(1, "MIT"), (2, "MIT")]
    item = prose(random.Random(3), 30, 10**6)
    docs = long.withColumn("text", F.when(F.col("doc_id") == 2, F.concat("text", F.lit(f" {item}"))).otherwise(F.col("text")))
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.coverage) for r in decontamination.matches(docs, bench).collect()] == [(2, 9, 1.0)]
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 0)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.score(long, quality.fit(long, labels)).collect()}
    assert len(scores) == 5 and all(0 <= x <= 1 for x in scores.values()) and scores[1] > scores[4]


def test_layout(long):
    assert {r.doc_id: r.size for r in mixing.Mix(long).taken().collect()}[3] == 1
    shards = {r.doc_id: r.shard for r in sharding.shards(long).collect()}
    assert len({shards[k] for k in (1, 2)}) == 2 and shards[1] not in {shards[k] for k in (3, 4, 5)}


def test_media_and_pages(spark, long):
    want = {r.doc_id: len(r.text.encode()) for r in long.collect()}
    got = {r.doc_id: (r.n_bytes, r.fault) for r in media.decode(media.encode(long)).collect()}
    assert got == {k: (v, None) for k, v in want.items()}
    pages = long.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"))
    texts = {r.doc_id: " ".join(r.text.split()) for r in long.collect()}
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == texts
