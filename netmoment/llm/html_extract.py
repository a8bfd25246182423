"""Main text of web pages: blocks by their markup, boilerplate by a suffix array of each host.

A page is read into blocks of visible text.  Its markup tells what is apart: navigation, headers, footers, side matter, adverts, notices,
forms and comments, by element, role, class or identifier; and if it has an article or main element, what is not in it.  Forms around an article, or around most of a page's
text, are layout; names of headings, and identifiers within an article, say nothing by themselves.  What is left are the candidates for main text.

The token streams of all pages of a host, what is apart included, are concatenated, and their suffixes sorted.  Suffixes next to each
other whose common prefix has least_run tokens or more repeat a substring; the longest prefix that enough distinct pages
share is covered by it.  A candidate block that is covered wholly is boilerplate if it stands before the first or after the last block that is not.
Text repeats for other reasons too: articles are copied, passages quoted.  So it takes LEAST_PAGES distinct pages
and more than half of the host's pages, and in an article or main element, whose markup says that it is text, GUARDED_PAGES and nine tenths.
A page of which all would go keeps its text.

A suffix is told by a hash of its first least_run tokens and by the AHEAD tokens after them, which is as far as it is sorted; longer substrings are covered by the suffixes that begin
later in them.  A count-min sketch of all pages' runs of least_run tokens keeps suffixes out that fewer than LEAST_PAGES pages share (it may let some
more in, and loses none).  Suffixes are dealt to tasks by host and a hash of their first
least_run tokens, so a host's array is built in parts that are each sorted, and no host is one task's.  Only places in candidates come back.

Defined results: a null html is the empty page, its text the empty string; a
null url or one without a host is a host of its own name, the empty one; rows that are equal in page_id, url and html are one page to the
suffix array, and rows with different page_ids are different pages; an empty table gives an empty result; other
columns are ignored.  A very long page is parsed once for each pass, and its tokens are hashed in chunks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import countmin, packed
from .tables import cut, narrow_batches, partitions, row_key, table
from .tokens import Words, words

LEAST_RUN = 8
#: Tokens by which suffixes that begin with the same run are sorted.
AHEAD = 8
LEAST_PAGES, GUARDED_PAGES = 3, 10
SKETCH_BITS = 28
#: Pages with boilerplate up to this many are broadcast to the last pass.
BROADCAST_PAGES = 1 << 16
PLACE = np.dtype([("a", "<i8"), ("b", "<i8"), ("place", "<u4"), ("length", "<u4"), ("pages", "<u4")])
SUFFIX = np.dtype([("host", "<u8"), ("prefix", "<u8"), ("a", "<i8"), ("b", "<i8"), ("place", "<u4"), ("own", "?"), ("ahead", "<u4", (AHEAD,))])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: What is not seen, or is no text, and what is text but not the page's.
NOT_SEEN = frozenset("head script style noscript template title textarea iframe svg canvas object audio video datalist".split())
NOT_MAIN = frozenset("nav header footer aside form button select option menu dialog fieldset label".split())
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Words of class and id names that mark what is not main text, and words that say nothing beside one: a name counts if it has no others.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login sidebar side aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead toolbar comment comments disqus replies reply respond related recommended "
    "share sharing social search pagination pager skip".split()
)
READERS = frozenset("comment comments disqus replies reply respond".split())
BESIDE = frozenset("area bar block box btn button buttons container content top bottom left right main site page post posts item items link links list row section slot unit wrap wrapper icons group inner outer panel form input the".split())
#: Their classes and identifiers say what the page has, not what they are.
WHOLE = frozenset("html body main".split())
#: Their identifiers are their own words.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPLIT = re.compile(r"[\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _marked(name: str, marks: frozenset = MARKS) -> bool:
    """Whether a class or id name marks what is not main text: all its words are marks, or stand beside one."""
    parts = {x for x in _SPLIT.split(_CAMEL.sub("-", name).lower()) if x}
    return not parts.isdisjoint(marks) and parts <= MARKS | BESIDE


def _apart(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element holds no main text; in_main: within an article or main element, where an identifier names a section and says nothing by itself, but for readers' comments."""
    if tag in NOT_MAIN:
        return True
    if not attributes or attributes.isspace():
        return False
    own = tag not in WHOLE and tag not in HEADINGS
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if own and name in ("class", "id") and any(_marked(x, READERS if in_main and name == "id" else MARKS) for x in value.split()):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _hidden(attributes: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


class Page:
    """The visible blocks of a page in order: their texts, and which are candidates; whether it has an article or main element.

    A form that holds an article or main element, or, on a page without one, most of the text that nothing else sets apart, is layout: the page is read again with it as a plain element.
    """

    def __init__(self, page: str):
        layout: set[int] = set()
        while more := self._read(page, layout):
            layout |= more

    def _read(self, page: str, layout: set[int]) -> set[int]:
        """Reads the page; the forms, by number, that turn out to be layout too."""
        found: list[tuple[str, bool, bool, int]] = []  # text, apart, in main, the form that alone sets it apart or -1
        open_: list[tuple[str, int, bool, int]] = []  # tag, 1 apart and 2 not seen, in main, form
        buffer: tuple[list[str], list[str]] = ([], [])
        self.main, forms, holding = False, 0, set()

        def flush() -> None:
            for apart in (0, 1):
                if buffer[apart]:
                    text = " ".join(html.unescape("".join(buffer[apart])).split())
                    if text:
                        found.append((text, bool(apart), bool(open_) and open_[-1][2], open_[-1][3] if apart and open_ else -1))
                    buffer[apart].clear()

        def close(tag: str, below: frozenset | None) -> None:
            """Ends the innermost tag; below: only elements of these may be open within it."""
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    del open_[k:]
                    return
                if below is not None and open_[k][0] not in below:
                    return

        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.match(page, at)
            at = m.end()
            tag = m.group(2)
            if tag is None:
                text = m.group()
                if not (text.startswith("<!") or text.startswith("<?")) and (not open_ or open_[-1][1] < 2):
                    buffer[open_[-1][1] if open_ else 0].append(text)
                continue
            tag = tag.lower()
            if tag in ("br", "hr"):
                flush()
            if tag in VOID:
                continue
            inline = tag in INLINE
            if not inline:
                flush()
            if m.group(1):
                close(tag, INLINE if inline else None)
                continue
            if not inline:
                close("p", INLINE)
            apart, main, form = open_[-1][1:] if open_ else (0, False, -1)
            if m.group(3).endswith("/") and tag not in RAW and tag not in MAIN:
                continue
            if tag == "form":
                forms += 1
            if tag in NOT_SEEN or apart == 2 or _hidden(m.group(3)):
                apart, form = 2, -1
            elif tag == "form" and not _apart("div", m.group(3), main):
                if not apart and forms not in layout:
                    apart, form = 1, forms
            elif (not apart or form >= 0) and _apart(tag, m.group(3), main):
                apart, form = 1, -1
            if tag in MAIN and not apart:
                main = self.main = True
            elif tag in MAIN and form >= 0:
                holding.add(form)
            if tag in RAW:  # its content is no markup
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else end
                continue
            open_.append((tag, apart, main, form))
        flush()
        self.texts = [t for t, *_ in found]
        self.own = [not apart and main >= self.main for _, apart, main, _ in found]
        if not holding and not self.main and forms > len(layout):
            size: dict[int, int] = {}
            for text, apart, _, form in found:
                if not apart or form >= 0:
                    size[form] = size.get(form, 0) + len(text)
            holding = {k for k, n in size.items() if k >= 0 and 2 * n > sum(size.values())}
        return holding

    def candidates(self) -> list[str]:
        return [t for t, own in zip(self.texts, self.own, strict=True) if own]


def blocks(page: str) -> tuple[list[str], bool]:
    """The page's candidate blocks, and whether they are an article's (else: all but what is marked as apart)."""
    p = Page(page)
    return p.candidates(), p.main


def _streams(column: pa.Array) -> Iterator[tuple[int, list[Page], Words]]:
    """(first row, pages, tokens of all their blocks) for runs of rows."""
    pages, first, size = [], 0, 0
    for i, x in enumerate(column):
        pages.append(Page(x.as_py() or ""))
        size += sum(map(len, pages[-1].texts))
        if size > 1 << 20 or i + 1 == len(column):
            done = 0
            for at, end, w in words(pa.array(["\n".join(p.texts) for p in pages], pa.large_string()), lower=True):
                yield first + at, pages[at:end], w
                done = end
            assert done == len(pages)
            pages, first, size = [], i + 1, 0


def _starts(w: Words, run_length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places from which run_length tokens of one page follow, and the number of the page."""
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    n = len(text) - run_length + 1
    start = np.flatnonzero(text[:n] == text[run_length - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
    return start, text[start]


def _keyed(run: np.ndarray, host: np.ndarray) -> np.ndarray:
    return run ^ (host * np.uint64(0x9E3779B97F4A7C15))


def _runs(run_length: int):
    """The runs of (host, html), with the host, once for each page."""

    def hashes(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        hosts = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at, _, w in _streams(b.column(1)):
            start, page = _starts(w, run_length)
            h = _keyed(w.windows(run_length)[start], hosts[at + page])
            order = np.lexsort((h, page))
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (page[order][1:] != page[order][:-1])
            yield h[order][new]

    return hashes


def _suffixes(run_length: int, shared: Broadcast, buckets: int):
    """The suffixes of (a, b, host, html), by bucket, whose runs the sketch says that LEAST_PAGES pages have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, b2, hosts = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            hosts = hosts.view(np.uint64)
            for at, pages, w in _streams(b.column(3)):
                start, page = _starts(w, run_length)
                prefix = w.windows(run_length)[start]
                often = countmin.reached(shared.value, _keyed(prefix, hosts[at + page]))
                start, page, prefix = start[often], page[often], prefix[often]
                if not len(start):
                    continue
                own = np.concatenate([np.repeat(p.own, [len(t.split()) for t in p.texts]) if p.texts else np.zeros(0, dtype=bool) for p in pages]).astype(bool)
                s = np.zeros(len(start), dtype=SUFFIX)
                s["prefix"], s["host"], s["a"], s["b"] = prefix, hosts[at + page], a[at + page], b2[at + page]
                candidates = np.append(0, np.cumsum(own))
                s["place"], s["own"] = start - w.first[page], candidates[start + run_length] > candidates[start]
                # the end of the page is less than any token
                ahead = start[:, None] + run_length + np.arange(AHEAD)
                inside = ahead < w.first[page + 1][:, None]
                s["ahead"] = np.where(inside, (w.hashes[np.minimum(ahead, len(w.hashes) - 1)] >> np.uint64(32)) | np.uint64(1), 0).astype(np.uint32)
                yield packed.dealt(packed.bucket_of(prefix ^ s["host"], buckets), s)

    return run


def sorted_suffixes(s: np.ndarray, run_length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of host, first run and the tokens after it, and how many tokens each has in common with the one before (0: no run)."""
    order = np.lexsort((*(s["ahead"][:, k] for k in range(AHEAD - 1, -1, -1)), s["prefix"], s["host"]))
    s = s[order]
    common = np.zeros(len(s), dtype=np.int64)
    if len(s) > 1:
        differ = (s["ahead"][1:] != s["ahead"][:-1]) | (s["ahead"][1:] == 0)
        common[1:] = run_length + np.where(differ.any(1), differ.argmax(1), AHEAD)
        common[1:][(s["host"][1:] != s["host"][:-1]) | (s["prefix"][1:] != s["prefix"][:-1])] = 0
    return s, common


def repeated(s: np.ndarray, run_length: int, least: int) -> np.ndarray:
    """PLACE records of the suffixes in candidates: for each length of a prefix that least pages or more share, the longest for a number of pages."""
    s, common = sorted_suffixes(s, run_length)
    out, above = [], np.zeros(len(s), dtype=np.int64)
    for length in range(run_length + AHEAD, run_length - 1, -1):
        if not (common == length).any():  # no suffix more comes to any other
            continue
        begin = common < length
        interval = np.cumsum(begin) - 1
        order = np.lexsort((s["b"], s["a"], interval))
        new = np.ones(len(s), dtype=bool)
        new[1:] = (interval[order][1:] != interval[order][:-1]) | (s["a"][order][1:] != s["a"][order][:-1]) | (s["b"][order][1:] != s["b"][order][:-1])
        pages = np.bincount(interval[order], new).astype(np.int64)[interval]
        found = np.flatnonzero((pages >= least) & (pages > above) & s["own"])
        above = np.maximum(above, pages)
        p = np.empty(len(found), dtype=PLACE)
        p["a"], p["b"], p["place"], p["length"], p["pages"] = s["a"][found], s["b"][found], s["place"][found], length, pages[found]
        out.append((s["host"][found], p))
    if not out:
        return np.zeros(0, dtype=[("host", "<u8"), ("at", PLACE)])
    records = np.empty(sum(len(p) for _, p in out), dtype=[("host", "<u8"), ("at", PLACE)])
    records["host"], records["at"] = np.concatenate([h for h, _ in out]), np.concatenate([p for _, p in out])
    return records


def _repeats(run_length: int):
    """(host, places): of each host in a partition the repeated places in candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = repeated(packed.gathered(batches, SUFFIX), run_length, LEAST_PAGES)
        found = found[np.argsort(found["host"], kind="stable")]
        for own in np.split(found, np.flatnonzero(np.diff(found["host"].view(np.int64)) != 0) + 1):
            for i in range(0, len(own), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(own["host"][i : i + 1].view(np.int64)), pa.array([own["at"][i : i + (1 << 16)].tobytes()], pa.binary())], names=["host", "places"])

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, places, pages) of (places, pages of the host): the places that more than half of the host's pages share, by page."""
    for b in batches:
        for x, pages in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            p = np.frombuffer(x.as_py(), dtype=PLACE)
            p = p[p["pages"] > pages // 2]
            p = p[np.lexsort((p["b"], p["a"]))]
            at = np.flatnonzero(np.append(True, (p["a"][1:] != p["a"][:-1]) | (p["b"][1:] != p["b"][:-1]))) if len(p) else []
            yield pa.RecordBatch.from_arrays([pa.array(p["a"][at]), pa.array(p["b"][at]), pa.array([q.tobytes() for q in np.split(p, at[1:])] if len(p) else [], pa.binary()), pa.array([pages] * len(at), pa.int64())], names=["a", "b", "places", "pages"])


def without_ends(page: Page, places: np.ndarray, pages: int) -> list[str]:
    """The candidates without repeated blocks before the first and after the last other one; pages: those of the host."""
    least = max(GUARDED_PAGES, -(-9 * pages // 10)) if page.main else max(LEAST_PAGES, pages // 2 + 1)
    p = places[places["pages"] >= least]
    end = np.cumsum([len(t.split()) for t in page.texts])
    gone = np.zeros(int(end[-1]) + 1 if len(end) else 1, dtype=np.int64)
    np.add.at(gone, p["place"].astype(np.int64), 1)
    np.add.at(gone, p["place"].astype(np.int64) + p["length"], -1)
    left = np.append(0, np.cumsum(np.cumsum(gone)[:-1] == 0))
    unique = [i for i in range(len(page.texts)) if page.own[i] and left[end[i]] > (left[end[i - 1]] if i else 0)]
    if not unique:
        return page.candidates()
    return [t for i, t in enumerate(page.texts) if page.own[i] and unique[0] <= i <= unique[-1]]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, text) of (page_id, url, html, places, pages of the host)."""
    for b in batches:
        out = []
        for x, lists, pages in zip(b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
            page = Page(x.as_py() or "")
            if lists.is_valid and len(lists):
                places = np.concatenate([np.frombuffer(part, dtype=PLACE) for part in lists.as_py()])
                out.append("\n".join(without_ends(page, places, pages)))
            else:
                out.append("\n".join(page.candidates()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def repeated_places(pages: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """(a, b, places, pages): for pages(page_id, url, html) with candidates that more than half of their host's pages share, where; a and b are row_key's."""
    spark = pages.sparkSession
    narrow_batches(spark)
    n = partitions(spark)
    pages = pages.select("page_id", "url", "html")
    keyed = pages.select(row_key(pages).alias("key"), F.xxhash64(host_of(F.col("url"))).alias("host"), "html")
    shared = countmin.sketch(keyed.select("host", "html"), _runs(least_run), SKETCH_BITS, LEAST_PAGES)
    suffixes = keyed.select("key.a", "key.b", "host", "html").mapInArrow(_suffixes(least_run, shared, 4 * n), packed.SCHEMA)
    found = suffixes.repartition(n, "bucket").mapInArrow(_repeats(least_run), "host long, places binary")
    # equal rows are one page; they are counted first, so that the hosts' pages are counted without their texts
    hosts = keyed.groupBy("host", "key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.sum("one").alias("pages"))
    by_page = found.join(hosts, "host").select("places", "pages").mapInArrow(_frequent, "a long, b long, places binary, pages long")
    return by_page.groupBy("a", "b").agg(F.collect_list("places").alias("places"), F.first("pages").alias("pages"))


def extract(pages: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """(page_id, url, text) of pages(page_id, url, html)."""
    rows = pages.select("page_id", "url", "html")
    found = cut(repeated_places(rows, least_run).select(F.struct("a", "b").alias("of"), "places", "pages"), 8)
    hint = F.broadcast(found) if found.count() <= BROADCAST_PAGES else found
    at = rows.select("*", row_key(rows).alias("key")).join(hint, F.col("key") == F.col("of"), "left")
    schema = rows.select("page_id", "url").schema.add("text", "string")
    return at.select("page_id", "url", "html", "places", "pages").mapInArrow(_extracted, schema)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_extract": op4_html_extract}
ORACLES: dict[str, str] = {}
