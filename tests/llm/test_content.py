"""op3, op4, op5, op7, op9: media, pages, licenses, quality and benchmarks."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netmoment.llm import decontamination, html_extract, license_scan, media, quality
from netmoment.llm.alignment import smith_waterman
from netmoment.llm.tokens import words
from tests.llm.conftest import odd_rows, prose

# Tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\xe9　z", max_size=30)), min_size=1, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    import re

    want = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    got = []
    for _, _, w in words(pa.array(texts, pa.string()), lower=False):
        all_ = [bytes(w.bytes[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
        got += [all_[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        by = {}
        for x, h in zip(all_, w.hashes.tolist(), strict=True):
            assert by.setdefault(x, h) == h
        assert len(set(by.values())) == len(by)
    assert got == want


# Media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60_000))
def test_media_round_trip(data):
    payload = media.pad(data)
    assert len(payload) % 192 == 0 and payload.startswith(data) and payload
    s = media.demux(media.mux(payload))
    assert s.payload == payload and s.gaps == 0 and s.repeats == 0 and s.random_access[0] == 0


def test_media_faults():
    payload = media.pad(bytes(range(256)) * 700)
    ts = media.mux(payload)
    packets = [ts[i : i + 188] for i in range(0, len(ts), 188)]
    again = b"".join([*packets[:5], packets[4], *packets[5:]])
    s = media.demux(again)
    assert s.payload == payload and s.repeats == 1 and s.gaps == 0
    s = media.demux(b"".join(packets[:5] + packets[6:]))
    assert s.gaps == 1 and s.payload != payload
    nulls = b"\x47\x1f\xff\x10" + b"\xff" * 184
    assert media.demux(b"".join([*packets[:3], nulls, *packets[3:]])).payload == payload
    assert media.demux(ts[:-1]).fault == "not whole packets" and media.demux(b"").fault
    assert media.demux(b"\x00" + ts[1:]).fault == "no sync byte"
    assert media.demux(b"".join(packets[2:])).payload == payload  # the tables come again
    packets = packets[:7]
    assert media.demux(b"".join(packets[2:])).fault == "no program"
    broken = bytearray(packets[0])
    broken[10] ^= 1
    assert media.demux(bytes(broken) + packets[1] + b"".join(packets[2:7])).fault == "no program"


def test_media_tables_of_several_packets():
    payload = media.pad(b"b" * 40_000)
    ts = media.mux(payload)
    packets = [ts[i : i + 188] for i in range(0, len(ts), 188)]
    # forty more programs before ours: the section needs two packets, of which the second begins with its rest
    programs = b"".join(media.struct.pack(">HH", n, 0xE000 | 0x200 + n) for n in range(2, 62))
    section = media._section(0x00, 1, media.struct.pack(">HH", 0, 0xE010) + media.struct.pack(">HH", 1, 0xE000 | media.PMT_PID) + programs)
    first = (media.struct.pack(">BHBB", 0x47, 0x4000, 0x10, 0) + section[:183]).ljust(188, b"\xff")
    second = (media.struct.pack(">BHB", 0x47, 0x0000, 0x11) + section[183:]).ljust(188, b"\xff")
    own = [p for p in packets if p[1] & 0x1F or p[2]]  # without the tables of programs that mux wrote
    assert media.demux(b"".join([first, second, *own])).payload == payload
    assert media.demux(b"".join([first, *own])).fault == "no program"
    assert media.demux(b"".join([first, first, second, *own])).payload == payload


def test_media_gaps_that_are_announced():
    payload = media.pad(b"c" * 192 * 85 * 12)
    ts = media.mux(payload)
    packets = [bytearray(ts[i : i + 188]) for i in range(0, len(ts), 188)]
    at = next(i for i, p in enumerate(packets) if i > 20 and p[3] & 0x20 and p[4] and p[5] & 0x40)
    for p in packets[at:]:
        if ((p[1] & 0x1F) << 8 | p[2]) == media.ES_PID:
            p[3] = p[3] & 0xF0 | (p[3] + 5) & 15
    s = media.demux(b"".join(packets))
    assert s.gaps == 1 and s.fault == "1 gaps"
    packets[at][5] |= 0x80
    s = media.demux(b"".join(packets))
    assert s.gaps == 0 and not s.fault and s.payload == payload


def test_media_times():
    s = media.demux(media.mux(media.pad(b"a" * 192 * 85 * 20)))
    assert len(s.times) == 20 and np.diff(s.times).tolist() == [192 * 85 * 90_000 // 8_000] * 19
    assert s.offsets == [192 * 85 * k for k in range(20)] and s.random_access == [0, 192 * 85 * 8, 192 * 85 * 16]


def test_media_of_odd_rows(odd, clashing, empty):
    for t in (odd, clashing):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in media.decode(media.encode(t)).collect())
        want = []
        for d, text, *_ in odd_rows():
            raw = (text or "").encode()
            p = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
            want.append((-1 if d is None else d, len(raw), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
        assert got == sorted(want)
    assert media.decode(media.encode(empty)).count() == 0


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/x>y">menu</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">cookies <div>nested</div></div><article class="post"><header><h1>Head &amp; line</h1></header>
<p>First   paragraph&nbsp;with <b>bold</b>, <i>italics</i><br>and a break.<p>Second &#233; &lt;tag&gt;</p><div class="ad">buy</div><aside>side</aside><form><p>mail</p></form>
<ul><li>one<li>two</ul><section id="comments"><p>first!</p></section><footer>by me</footer></article><div id="sidebar"><p>more</p></div><footer>&copy;</footer></body></html>"""


def test_page_with_article():
    assert html_extract.blocks(PAGE) == (["First paragraph with bold, italics", "and a break.", "Second é <tag>", "one", "two"], True)


@pytest.mark.parametrize("tag", ["html", "body", "main", "article"])
def test_marks_of_the_whole_page(tag):
    names = {t: "class='single has-sidebar comments-open' id='with-search'" if t == tag else "" for t in ("html", "body", "main", "article")}
    page = "<html {html}><body {body}><div class='sidebar'>side</div><main {main}><article {article}><p>text</p><article class='comment even'>said</article></article></main></body></html>"
    assert html_extract.blocks(page.format(**names)) == (["text"], True)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><form id="aspnetForm"><nav>n</nav><main><article><p>The text.</p></article></main><label>x</label></form>', ["The text."]),
        ("<form><form><article>in two</article></form></form>", ["in two"]),
        ("<body><form><p>most of the text of a page</p><label>go</label><button>no</button></form><div>more</div>", ["most of the text of a page", "more"]),
        ("<body><p>a long text outside of it all</p><form>search</form>", ["a long text outside of it all"]),
        ('<article><p>A.</p><form><p>write a reply that is longer than the article</p></form><div class="comments"><p>c</p></div></article>', ["A."]),
        ('<form class="search"><main>no</main></form><p>yes</p>', ["yes"]),
        ('<div class="sidebar"><form><article>no</article></form></div><p>yes</p>', ["yes"]),
        ('<article><h2 id="search">Search</h2><p>Body.</p><section id="related"><p>More.</p></section><h3 class="notice">Notice</h3><p>End.</p></article>', ["Search", "Body.", "More.", "Notice", "End."]),
        ('<article><p>A.</p><section id="x" class="comments"><p>c</p></section><div role="navigation">n</div></article>', ["A."]),
        ('<div id="comments"><p>c</p></div><div id="notice">n</div><p>A.</p>', ["A."]),
        ("<article><article><p>in</p></article><p>out</p></article><p>no</p>", ["in", "out"]),
        ("<article><p>one<p>two", ["one", "two"]),
        ("<article><form><p>open to the end of <b>the page", []),
        ('<article><p>A.</p><section id="comments"><p>c</p></section><h2 id="comments">On comments</h2></article>', ["A.", "On comments"]),
    ],
)
def test_forms_and_identifiers(page, text):
    assert html_extract.Page(page).candidates() == text


def test_names_that_only_hold_a_mark_say_nothing():
    page = "<article><div class='{}'><p>text</p></div></article>"
    for name in ("social-history", "the-advert-of-1920", "shareholders", "notice-of-meeting x", "adsorption", "menu-of-the-day"):
        assert html_extract.blocks(page.format(name)) == (["text"], True)
    for name in ("ad", "adTop", "share-buttons", "x related-posts", "cookie_notice", "comment-list", "sidebar2", "side-bar", "SocialLinks"):
        assert html_extract.blocks(page.format(name)) == ([], True)


def test_suffixes_by_brute_force():
    rng = np.random.default_rng(5)
    run = html_extract.LEAST_RUN
    stories = [rng.integers(1, 10**6, n) for n in (5, 9, 14, 30, 60)]
    for _ in range(8):
        pages = [np.concatenate([x for _ in range(rng.integers(1, 4)) for x in (stories[rng.integers(5)], rng.integers(1, 10**6, rng.integers(0, 6)))]).astype(np.uint32) for _ in range(14)]
        rows = []
        for k, tokens in enumerate(pages):
            for i in range(len(tokens) - run + 1):
                s = np.zeros(1, dtype=html_extract.SUFFIX)
                s["host"], s["prefix"], s["a"], s["b"], s["place"], s["own"] = k % 2, zlib.crc32(tokens[i : i + run].tobytes()), k, -k, i, True
                part = tokens[i + run : i + run + html_extract.AHEAD]
                s["ahead"][0, : len(part)] = part
                rows.append(s)
        got = {}
        for r in html_extract.repeated(np.concatenate(rows), run, 2):
            at = r["at"]
            assert r["host"] == at["a"] % 2 == -at["b"] % 2
            got.setdefault((int(at["a"]), int(at["place"])), {})[int(at["pages"])] = int(at["length"])
        held = {}
        for k, tokens in enumerate(pages):
            for n in range(run, run + html_extract.AHEAD + 1):
                for i in range(len(tokens) - n + 1):
                    held.setdefault((k % 2, n, tokens[i : i + n].tobytes()), set()).add(k)
        for k, tokens in enumerate(pages):
            for i in range(len(tokens) - run + 1):
                want = {}
                for n in range(run, min(run + html_extract.AHEAD, len(tokens) - i) + 1):
                    if (m := len(held[k % 2, n, tokens[i : i + n].tobytes()])) >= 2:
                        want[m] = n
                assert got.get((k, i), {}) == want


def test_boilerplate_in_articles_goes_where_nearly_all_pages_have_it(spark):
    rng = random.Random(7)
    plea = "please write to the editors if you have found a mistake in this text"
    short = "more from us"
    stories = [[prose(rng, 30, 10**6) for _ in range(3)] for _ in range(12)]
    stories[1] = stories[0]
    stories[2][1] = plea  # a block in the middle stays
    rows = [(i, f"https://Big.example/{i}", f"<p>menu of the host with a few more words</p><article><p>{short}</p>{''.join(f'<p>{x}</p>' for x in s)}<p>{plea}</p></article><footer>foot of the host, as everywhere</footer>") for i, s in enumerate(stories)]
    rows += [(100 + i, f"https://small.example/{i}", f"<article><p>{plea}</p>{''.join(f'<p>{x}</p>' for x in s)}</article>") for i, s in enumerate(stories[:9])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert [got[i] for i in range(12)] == ["\n".join(s) for s in stories]
    assert [got[100 + i] for i in range(9)] == ["\n".join([plea, *s]) for i, s in enumerate(stories[:9])]


def test_equal_rows_are_one_page(spark):
    text = prose(random.Random(9), 40, 10**6)
    rows = [(1, "http://a.example/", f"<div>{text}</div><div>own words</div>")] * 5 + [(k, "http://b.example/", f"<div>{text}</div><div>own words of {k}</div>") for k in range(5)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got if "a.example" in r.url) == [f"{text}\nown words"] * 5
    assert sorted(r.text for r in got if "b.example" in r.url) == [f"own words of {k}" for k in range(5)]


@pytest.mark.parametrize("page", ["", "plain text", "<p>open <b>bold", "<article>", "<a <b> < c", "</p></div>", "<script>never closed", "<!-- never closed", "<p>a</p>" * 2000])
def test_broken_pages(page):
    found, _ = html_extract.blocks(page)
    assert all(x == " ".join(x.split()) and x for x in found)


def test_pages_without_article(spark):
    rng = random.Random(2)
    menu, foot = "home news sport weather travel culture shop help contact", "all rights belong to the people who wrote these fine pages here"
    unique = [prose(rng, 30, 10**6) for _ in range(6)]
    rows = [(i, f"http://Host.example/{i}", f"<div>{menu}</div><div>{u}</div><div>{foot}</div>") for i, u in enumerate(unique[:5])]
    rows += [(5, "http://other.example/", f"<div>{menu}</div><div>{unique[5]}</div>"), (6, None, None), (7, "no url", ""), (8, "http://host.example/8", f"<article><p>{menu}</p></article>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[i] for i in range(5)] == unique[:5]
    assert got[5] == f"{menu}\n{unique[5]}" and got[6] == got[7] == "" and got[8] == menu
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text string, page int")).count() == 0


def test_repeated_text_of_pages_without_article(spark):
    rng = random.Random(3)
    menu, foot = "home news sport weather travel culture shop help contact", "all rights belong to the people who wrote these fine pages here"
    story = [prose(rng, 30, 10**6) for _ in range(3)]
    bodies = [[prose(rng, 30, 10**6)] for _ in range(6)]
    bodies[0] = bodies[1] = story  # a copy
    bodies[2] = [story[0], "an edited paragraph", story[2]]
    bodies[3] = [f"{prose(rng, 9, 10**6)} {story[1]}"]  # a quotation
    rows = [(i, f"http://host.example/{i}", "".join(f"<div>{x}</div>" for x in (menu, *b, foot))) for i, b in enumerate(bodies)]
    bodies += [story] * 4  # on a host of copies only, and on one of two pages
    rows += [(i, f"http://{'copies' if i < 9 else 'small'}.example/{i}", "".join(f"<div>{x}</div>" for x in story)) for i in (6, 7, 8, 9)]
    rows += [(10, "http://small.example/10", "".join(f"<div>{x}</div>" for x in story))]
    bodies += [story]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[i] for i in range(11)] == ["\n".join(b) for b in bodies]


def test_pages_are_documents_again(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()}
    got = html_extract.op4_html_extract(spark, sf_dir).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    assert sum(r.text.split("\n", 1)[-1] in texts for r in got) == len(got)


# Licenses


def test_licenses(spark, odd, clashing, empty):
    mit = license_scan.TEMPLATES["MIT", "MIT"]
    cut = mit.split()
    edited = " ".join(x for i, x in enumerate(cut) if i % 17 != 5)
    rows = [(0, "word " * 40 + "Released under the MIT License. " + "word " * 10), (1, f"prefix {mit} suffix"), (2, edited), (3, " ".join(cut[:60])), (4, "the license of this software is unknown"), (5, None), (6, "LICENSED UNDER CC BY-NC 4.0"), (7, f"{mit}\n" + "between " * 30 + mit)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "first_word").collect()
    assert [(r.doc_id, r.template, r.first_word) for r in got][:4] == [(0, "MIT-notice", 40), (1, "MIT", 1), (2, "MIT", 0), (6, "CC-BY-NC-4.0-notice", 0)]
    assert [r.template for r in got if r.doc_id == 7] == ["MIT", "MIT"] and {r.coverage for r in got if r.doc_id in (0, 1, 6, 7)} == {1.0}
    assert 0.9 < next(r.coverage for r in got if r.doc_id == 2) < 1
    for t in (odd, clashing, empty):
        assert license_scan.scan(t).count() == 0


def test_recall_of_edited_licenses(spark):
    rng = random.Random(11)
    templates = {k: v for k, v in license_scan.TEMPLATES.items() if len(v.split()) >= 25}
    rows, want = [], set()
    for n, ((name, _), text) in enumerate(templates.items()):
        for k in range(8):
            w = edited_copy(rng, text.split(), 0.02 * k)
            rows.append((100 * n + k, f"{prose(rng, 60, 5000)} {' '.join(w)} {prose(rng, 60, 5000)}"))
            want.add((100 * n + k, name))
    rows += [(10**6 + i, prose(rng, 300, 5000)) for i in range(50)]
    got = {(r.doc_id, r.template) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    # the conditions alone are a template too, and part of the longer text
    alike = {("BSD-3-Clause", "BSD-conditions")}
    found = {w for w in want if w in got or any((w[0], b) in got for a, b in alike if a == w[1])}
    assert len(found) >= 0.97 * len(want) and len(templates) >= 12 and not any(d >= 10**6 for d, _ in got)


def test_planted_licenses_are_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sum(r.text.count("Released under the MIT License.") for r in docs.collect())
    assert license_scan.op5_license_scan(spark, sf_dir).where("template = 'MIT-notice'").count() == want > 0


def brute_alignment(a, b, centre=0, band=10**9):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(len(a)):
        for j in range(len(b)):
            if abs(j - i - centre) <= band:
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def alignment_score(a, b, found):
    """Of the passages that were found, aligned from end to end: the best score with as many matches."""
    n, m = found.end - found.start, found.other_end - found.other_start
    best = np.full((n + 1, m + 1, n + 1), -(10**6))
    best[0, 0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                same = a[found.start + i - 1] == b[found.other_start + j - 1]
                before = best[i - 1, j - 1]
                best[i, j] = np.maximum(best[i, j], np.append(-(10**6), before[:-1]) + 2 if same else before - 1)
            if i:
                best[i, j] = np.maximum(best[i, j], best[i - 1, j] - 1)
            if j:
                best[i, j] = np.maximum(best[i, j], best[i, j - 1] - 1)
    return best[n, m, found.matches]


def test_alignment_by_brute_force():
    rng = np.random.default_rng(1)
    for k in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 18)), rng.integers(0, 5, rng.integers(1, 18))
        if k % 2:
            centre, band = int(rng.integers(-6, 7)), int(rng.integers(0, 6))
            got, want = smith_waterman(a, b, centre, band), brute_alignment(a, b, centre, band)
        else:
            got, want = smith_waterman(a, b), brute_alignment(a, b)
        assert got.score == want
        assert not want or alignment_score(a, b, got) == want


def test_alignment_in_a_band_needs_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1000, 4000), rng.integers(0, 1000, 20_000)
    b[5000:9000] = a
    tracemalloc.start()
    got = smith_waterman(a, b, centre=5000, band=10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got.matches, got.other_start, got.other_end) == (4000, 5000, 9000) and most < 1 << 20


# Benchmark


def edited_copy(rng, w, share):
    out = []
    for x in w:
        r = rng.random()
        if r < share / 2:
            out.append(f"e{rng.randrange(10**6)}")
        elif r < share * 0.75:
            out += [x, f"e{rng.randrange(10**6)}"]
        elif r >= share:
            out.append(x)
    return out


def test_edited_copies_are_found(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 40, 3000)) for k in range(20)]
    rows, want = [], set()
    for i in range(200):
        w = prose(rng, 300, 3000).split()
        if i % 4 == 0:
            k = rng.randrange(20)
            w[100:100] = edited_copy(rng, items[k][1].split(), rng.choice([0, 0.1, 0.2]))
            want.add((i, k))
        rows.append((i, " ".join(w)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.matches(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert {r.doc_id for r in decontamination.clean(docs, bench).collect()} == set(range(200)) - {d for d, _ in want}


@pytest.mark.parametrize("every", [3, 4, 5])
@pytest.mark.parametrize("exact", [False, True])
def test_copies_with_words_replaced_throughout(spark, every, exact):
    rng = random.Random(every)
    items = [(k, prose(rng, 30 + k, 3000)) for k in range(12)]
    rows = [(k, " ".join([prose(rng, 90, 3000), *(f"z{i}" if i % every == every - 1 else w for i, w in enumerate(x.split())), prose(rng, 90, 3000)])) for k, x in items]
    rows += [(100 + k, x) for k, x in items if exact]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()} == {(d, d % 100) for d, _ in rows}
    assert decontamination.clean(docs, bench).count() == 0


def test_recall_against_all_pairs(spark):
    rng = random.Random(16)
    items = [(k, prose(rng, 20 + 3 * k, 2000)) for k in range(15)]
    rows = []
    for i in range(120):
        w = prose(rng, 150, 2000).split()
        w[60:60] = edited_copy(rng, items[i % 15][1].split(), 0.4 * (i // 15) / 7)
        rows.append((i, " ".join(w)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")
    number = {x: n for n, x in enumerate(sorted({x for _, t in rows + items for x in t.split()}))}
    coded = lambda t: np.array([number[x] for x in t.split()])
    want = {(i, k) for i, t in rows for k, x in items if smith_waterman(coded(x), coded(t)).matches >= decontamination.COVERAGE * len(x.split())}
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()}
    assert len(want & got) >= 0.98 * len(want) and len(want) > 90 and len(got - want) <= 2
    assert {r.doc_id for r in decontamination.clean(docs, bench).collect()} == set(range(120)) - {d for d, _ in got}


def test_words_inserted_throughout(spark):
    item = prose(random.Random(8), 40, 3000)
    far = " ".join(f"{w} z{i}" for i, w in enumerate(item.split()))
    docs = spark.createDataFrame([(0, far), (1, f"{item} and {item}"), (2, " ".join(item.split()[:23]))], "doc_id long, text string")
    got = decontamination.matches(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.first_word, r.end_word, r.coverage) for r in got) == [(0, 0, 79, 1.0), (1, 0, 40, 1.0), (1, 41, 81, 1.0)]


def test_copies_in_another_case(spark):
    items = ["El niño pequeño comió piñas en la montaña según él", "Straße und Größe, Übermut für Öl und Äpfel", "Été à la forêt où l'élève rêve", "ΟΔΟΣ ΤΗΣ ΘΑΛΑΣΣΑΣ καλός", "Ёлка ещё не"]
    rows = [(10 * k + i, t) for k, x in enumerate(items) for i, t in enumerate([x, x.upper(), x.lower(), x.title()])] + [(99, "nothing of these"), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_", F.lit("x"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in decontamination.matches(docs, bench).collect()) == [(d, d // 10, 1.0) for d, _ in rows[:-2]]
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns and sorted(left.collect()) == [(99, "nothing of these", "x"), (100, None, "x")]


def test_benchmark_of_odd_rows(spark, odd, clashing, empty):
    kind = "item_id long, text string"
    bench = spark.createDataFrame([(0, odd_rows()[7][1]), (1, None), (2, ""), (3, "three little words"), (4, "little"), (5, odd_rows()[7][1])], kind)
    for t in (odd, clashing):
        got = {(r.doc_id, r.item_id) for r in decontamination.matches(t, bench).collect()}
        assert {(7, 0), (8, 0), (9, 0), (10, 0), (7, 5), (None, 0), (6, 3), (6, 4)} <= got and all(k not in (1, 2) for _, k in got)
        left = decontamination.clean(t, bench)
        assert left.columns == t.columns and {r.doc_id for r in left.collect()} & {6, 8, 9, 10} == set()
    assert decontamination.matches(empty, bench).count() == 0
    assert decontamination.matches(odd, spark.createDataFrame([], kind)).count() == 0
    assert decontamination.clean(odd, spark.createDataFrame([], kind)).count() == odd.count()


def test_planted_items_are_found(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(d, k) for d, t in docs.items() for k, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in decontamination.op9_decontamination(spark, sf_dir).collect()}
    assert want <= got and want and len(got) <= len(want) + 2


# Quality


def test_quality_of_held_out_rows(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality.op7_quality(spark, sf_dir).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in test]) > 0.97
    again = {r.doc_id: r.score for r in quality.op7_quality(spark, sf_dir).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_optimum_by_plain_descent():
    rng = np.random.default_rng(3)
    n, dense = 40, rng.normal(size=(40, 3))
    cell = [np.unique(rng.integers(0, 2 * quality.CELLS, 6)) for _ in range(n)]
    count, words = [rng.integers(1, 9, len(c)) for c in cell], rng.integers(20, 90, n)
    won, lost = rng.integers(0, n // 2, 300), rng.integers(n // 2, n, 300)
    rows = quality.Rows(dense, cell, count, words)
    w = quality.optimum(rows, won, lost, 0.01)
    x = np.zeros((n, rows.width))
    x[:, :3] = dense
    for i in range(n):
        x[i, 3 + cell[i]] = count[i] * quality.SHARE / words[i]
    d, v = x[won] - x[lost], np.zeros(rows.width)
    for _ in range(20_000):
        v -= 0.3 * (0.01 * v - d.T @ (1 / (1 + np.exp(d @ v))) / len(d))
    assert np.abs(w - v).max() < 1e-4


def test_scores_are_those_of_the_features():
    rng = np.random.default_rng(4)
    column = pa.array([None, "", "one", "one two", "Two two\nthree, FOUR! 5 ", "a " * 500])
    model = quality.Model(rng.normal(size=10), rng.random(10) + 1, rng.normal(size=10), rng.normal(size=2 * quality.CELLS) / 10, 0.2)
    got = model.scores(column)
    rows = list(quality.sparse(column))
    size = [0, 0, 1, 2, 5, 500]
    want = [((f - model.mean) / model.spread) @ model.weights + model.cells[c] @ n * quality.SHARE / max(1, k) - 0.2 for (f, c, n), k in zip(rows, size, strict=True)]
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-np.array(want))), atol=1e-9)
    assert [len(c) for _, c, _ in rows] == [0, 0, 1, 3, 8, 2] and [int(n.sum()) for _, _, n in rows] == [0, 0, 1, 3, 9, 999]


def test_repeated_documents_keep_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 3, prose(random.Random(i), 30)) for i in range(60)], "doc_id long, text string").repartition(3)
    seen = []
    monkeypatch.setattr(quality, "bradley_terry", lambda dense, cell, count, better, seed: seen.append((dense, better)))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    for t in (docs, docs.repartition(5)):
        quality.fit(t, labels, max_rows=9)
    assert len(seen[0][0]) == 9 and (seen[0][0] == seen[1][0]).all() and (seen[0][1] == seen[1][1]).all()


def test_quality_counts_all_words_of_a_text():
    """Counts beyond 16 bits come in parts that add up, and products with them are those of the whole counts."""
    (_, cell, count), = quality.sparse(pa.array(["alpha " * 200_000 + "beta " * 70_000 + "alpha"]))
    total = np.zeros(2 * quality.CELLS)
    np.add.at(total, cell, count)
    assert total[: quality.CELLS].sum() == 270_001 and total[quality.CELLS :].sum() == 270_000
    assert sorted(total[total > 0].astype(int).tolist())[-3:] == [70_000, 199_999, 200_001] or total.max() >= 200_001
    w = np.random.default_rng(2).normal(size=10 + 2 * quality.CELLS)
    rows = quality.Rows(np.zeros((1, 10)), [cell], [count], np.array([270_001.0]))
    assert rows.times(w)[0] == pytest.approx(total @ w[10:] * quality.SHARE / 270_001, rel=1e-5)


def test_quality_of_odd_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(7, 1, 0), (12, 0, 0), (11, 1, 0), (16, 0, 0), (None, 1, 0), (3, None, 0), (999, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    for t in (odd, clashing):
        got = quality.score(t, model).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
        assert quality.kept(t, model).columns == t.columns
    assert quality.score(empty, model).count() == 0
    one_class = quality.fit(odd, labels.where("quality = 1"))
    assert {r.score for r in quality.score(odd, one_class).collect()} == {0.5}
    assert {r.score for r in quality.score(odd, quality.fit(empty, labels)).collect()} == {0.5}
