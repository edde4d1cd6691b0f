"""Main text of web pages, with site templates removed.

Each page is parsed once into blocks (the text of block elements, in page
order), and every element's subtree is hashed, twice: its content (element and
text) and its shape (element, class, id, role and the shapes below it, without
text). Spark counts, for each host, the pages in which a subtree recurs, and
subtrees that recur in many pages of their host are its template and are
deleted, before anything else is decided:

* content that recurs outside an article, on MIN_SHARE of the host's pages or,
  on a large host whose sections may have templates of their own, on
  ENOUGH_PAGES of them (pages without a host are no site, so there the share
  alone decides); inside an article only on nearly all pages (PROSE_SHARE of at
  least PROSE_PAGES), since articles of a site may quote the same passage;
* shapes that recur on SHAPE_SHARE of the pages next to an article and never in
  one: navigation, adverts and footers whose text differs from page to page.
  They are then deleted on the host's pages that have no article element, too.

Copies of one page count once, so an article that a site publishes often does
not become a template.

Where the host has too few pages to tell, and for what is in an article on few
pages, markup says the rest: the article or main element, where there is one,
bounds the text, and elements that are by name, role or class a menu, header,
footer, sidebar, notice, advert, form, script, style or comment are left out.

A hot host is no hot key: subtrees are counted by (host, hash) with partial
sums. Up to BROADCAST templates (they grow with the hosts, not with the pages;
16 MB at most) go to all tasks, and pages are not shuffled. More of them are
joined to the pages' subtrees, and each page to its deletions; page counts,
templates and deletions are written before, so that a join has a plain table on
both sides and is split where a host is hot or pages are equal.

Nulls: a null html gives an empty text; a null url has the host "". Repeated
rows each give a row. A page in which all is template gives an empty text. An
empty table gives no rows. Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import sliced, stored

MIN_PAGES = 5
MIN_SHARE = 0.2
#: So many pages of a host are enough, whatever their share of it.
ENOUGH_PAGES = 200
#: Inside an article only what nearly every page has is a template.
PROSE_PAGES, PROSE_SHARE = 20, 0.8
SHAPE_SHARE = 0.5
BROADCAST = 1_000_000
#: A shape is none of a template if it is in an article on more than this share of the pages that have it outside.
SHAPE_INSIDE = 0.01
#: What is counted: content, content of an article's paragraphs, and shapes next to an article, in one, and where there is none.
CONTENT, PROSE, BESIDE, INSIDE, OTHER = range(5)

#: Element names as HTML defines them.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt option optgroup td th tr tbody thead tfoot caption legend summary".split())
#: Elements and words in role, class or id that mark what is no article text.
OUT_TAGS = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input menu nav noscript object script search select style svg template textarea title video".split()
)
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "consent dialog disqus footer form gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
    "popup promo promotion related recommended replies reply respond search share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription "
    "toolbar widget widgets".split()
)
#: Left out only outside an article, whose own header holds its title.
OUTER_TAGS, OUTER_WORDS = frozenset(["header"]), frozenset(["header", "alert"])
#: A class that begins so says what a container has or is, not what it is for (has-sidebar, long-form).
_STATES = frozenset("has with without no is not long short".split())
KEPT_IN_ARTICLE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li td th dd dt figcaption article main tr table tbody ul ol dl".split())
#: Without attributes and blocks below them these say nothing by their shape.
_PLAIN = KEPT_IN_ARTICLE | frozenset(["div", "section"])
_WHOLE = frozenset(["html", "body", "article", "main"])
#: A start tag closes an open element of these names, unless a bound stands between.
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select", "datalist", "optgroup")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "td", "th"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
_P_BOUND = frozenset("button caption html marquee object td template th table".split())

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _hash(text: str) -> int:
    mark = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return mark - (1 << 64) if mark >> 63 else mark


def _marks(attributes: str) -> str:
    """Class, id and role of an element, numbers in them aside."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    return "|".join(re.sub(r"\d+", "0", " ".join(sorted(found[n].split()))) for n in ("class", "id", "role") if n in found)


def left_out(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is, by its name or its attributes, no article text."""
    if tag in OUT_TAGS or (tag in OUTER_TAGS and not in_article):
        return True
    if not attributes or tag in _WHOLE and tag != "article":
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id", "role"):
            for own in value.split():
                words = [w.lower() for w in _WORD.findall(own)]
                if words and words[0] not in _STATES and (not OUT_WORDS.isdisjoint(words) or (not in_article and not OUTER_WORDS.isdisjoint(words))):
                    return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
    return False


class Page:
    """Blocks and subtrees of a page.

    blocks: (text, left out by the markup, inside an article); subtrees: (hash,
    first block, end, kind) of the content of each block element with text;
    shapes: the same of its shape, of those outside an article that hold none.
    """

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, bool, bool]] = []
        self.subtrees: list[tuple[int, int, int, int]] = []
        self.shapes: list[tuple[int, int, int, int]] = []
        self._text: list[str] = []
        # open elements: tag, block or left out?, left out so far, in an article, first block, what marks its shape, shapes below
        self._open: list[tuple[str, bool, bool, bool, int, str, list[int]]] = []
        self._parse((html or "").replace("\x00", ""))
        self.has_article = any(inside and not out for _, out, inside in self.blocks)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                top = self._open[-1] if self._open else ("", True, False, False, 0)
                self.blocks.append((text, top[2], top[3]))
            self._text = []

    def _pop(self) -> None:
        tag, block, _, in_article, first, marks, below = self._open[-1]
        if block:
            self._flush()
            end = len(self.blocks)
            if end > first and tag not in ("html", "body"):
                prose = in_article and tag in KEPT_IN_ARTICLE
                held = "\n".join(b[0] for b in self.blocks[first:])
                self.subtrees.append((_hash(f"{'prose' if prose else 'content'} {tag}\n{held}"), first, end, PROSE if prose else CONTENT))
                shape = _hash(f"{tag}|{marks}|{below}")
                if (marks or below or tag not in _PLAIN) and (in_article or not any(b[2] for b in self.blocks[first:end])):
                    self.shapes.append((shape, first, end, INSIDE if in_article else BESIDE))
                over = self._open[-2][6] if len(self._open) > 1 else []
                if not over or over[-1] != shape:  # however many of a kind follow each other
                    over.append(shape)
        self._open.pop()

    def _close_to(self, tags, bounds) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] in tags:
                while len(self._open) > k:
                    self._pop()
                if len(tags) == 1:
                    return
            elif self._open[k][0] in bounds:
                return

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCK
        if tag in CLOSES_P:
            self._close_to(("p",), _P_BOUND)
        if tag in _SIBLINGS:
            self._close_to(*_SIBLINGS[tag])
        if tag == "br":
            self._text.append(" ")
        if block:
            self._flush()
        if tag in VOID:
            return
        _, _, out, in_article, *_ = self._open[-1] if self._open else ("", True, False, False)
        own = left_out(tag, attributes, in_article)
        if own and not out:
            self._flush()
        in_article = in_article or (tag in ("article", "main") and not out and not own)
        self._open.append((tag, block or (own and not out), out or own, in_article, len(self.blocks), _marks(attributes) if attributes else "", []))

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        inline = tag not in BLOCK
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                while len(self._open) > k:
                    self._pop()
                return
            if inline and self._open[k][1]:  # a block stands between: the end tag is misplaced
                return

    def _parse(self, html: str) -> None:
        at = 0
        while True:
            m = _MARKUP.search(html, at)
            if m is None:
                break
            if m.start() > at:
                self._text.append(unescape(html[at : m.start()]))
            at = m.end()
            slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                self._end(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                self._end(tag)
        if at < len(html):
            self._text.append(unescape(html[at:]))
        while self._open:
            self._pop()
        self._flush()

    def deleted(self, template: frozenset[int] | set[int]) -> set[int]:
        """The blocks of subtrees whose hashes are in template."""
        gone: set[int] = set()
        for mark, first, end, _ in self.subtrees:
            if mark in template:
                gone.update(range(first, end))
        for mark, first, end, kind in self.shapes:
            if kind != INSIDE and mark in template:
                gone.update(range(first, end))
        return gone

    def text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        """The main text, without subtrees whose hashes are in template."""
        return self.text_and_deleted(template)[0]

    def text_and_deleted(self, template: frozenset[int] | set[int]) -> tuple[str, int]:
        """The main text, and the code points of the blocks that the template took away."""
        gone = self.deleted(template) if template else set()
        kept = (t for k, (t, out, inside) in enumerate(self.blocks) if not out and k not in gone and (inside or not self.has_article))
        return "\n".join(kept), sum(len(self.blocks[k][0]) for k in gone)

    def marks(self) -> set[tuple[int, int]]:
        """(hash, kind) of all that is counted."""
        beside = BESIDE if self.has_article else OTHER
        return {(m, kind) for m, _, _, kind in self.subtrees} | {(m, INSIDE if kind == INSIDE else beside) for m, _, _, kind in self.shapes}

    def signature(self) -> int:
        """Of all text, so that copies of a page count once."""
        return xxhash.xxh3_64_intdigest("\n".join(b[0] for b in self.blocks if b[2]) or "\n".join(b[0] for b in self.blocks)) >> 1


def _subtree_batches(batches):
    for batch in sliced(batches):
        key, host, sig, mark, kinds = [], [], [], [], []
        for k, h, html in zip(*(c.to_pylist() for c in batch.columns)):
            page = Page(html)
            own = sorted(page.marks())
            key += [k] * len(own)
            host += [h] * len(own)
            sig += [page.signature()] * len(own)
            mark += [m for m, _ in own]
            kinds += [kind for _, kind in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(host, pa.string()), pa.array(sig, pa.int64()), pa.array(mark, pa.int64()), pa.array(kinds, pa.int8())],
            names=["key", "host", "sig", "mark", "kind"],
        )


def _text_batches(shared):
    """Pages with the hashes of their template, or with their host if the templates of hosts are shared."""

    def run(batches):
        for batch in sliced(batches):
            done = []
            for html, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = Page(html)
                if shared is not None:
                    known = shared.value.get(own)
                    marks = [] if known is None else [m for m, kind in page.marks() if kind != INSIDE]
                    at = np.minimum(np.searchsorted(known, marks), len(known) - 1) if marks else []
                    own = [m for m, k in zip(marks, at) if known[k] == m]
                done.append(page.text_and_deleted(set(own or ())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([t for t, _ in done], pa.string()),
                    pa.array(np.array([len(t) for t, _ in done], np.int64)), pa.array(np.array([n for _, n in done], np.int64)),
                ],
                names=["page_id", "url", "text", "n_chars", "template_chars"],
            )

    return run


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host, and a key that equal pages share."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return rows.withColumn("host", host).withColumn("key", F.xxhash64("host", "html"))


def subtrees(pages: DataFrame) -> DataFrame:
    """A row for each page and distinct subtree: key, host, sig, mark, kind."""
    return keyed(pages).select("key", "host", "html").mapInArrow(_subtree_batches, "key long, host string, sig long, mark long, kind byte")


def templates(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough_pages: int = ENOUGH_PAGES) -> DataFrame:
    """(host, mark) of subtrees that recur in enough pages of different content of the host; see the module's text."""
    different = found.select("host", "mark", "kind", "sig").distinct()
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    counts = different.groupBy("host", "mark").agg(n(CONTENT).alias("content"), n(PROSE).alias("prose"), n(BESIDE).alias("beside"), n(INSIDE).alias("inside"))
    counts = counts.where(F.greatest("content", "prose", "beside") >= min_pages)
    pages = stored(found.select("host", "sig").distinct().groupBy("host").agg(F.count("*").alias("pages")), "pages")
    enough = F.when(F.col("host") != "", F.col("content") >= enough_pages).otherwise(False)
    content = (F.col("content") >= min_pages) & ((F.col("content") >= min_share * F.col("pages")) | enough)
    prose = (F.col("prose") >= PROSE_PAGES) & (F.col("prose") >= PROSE_SHARE * F.col("pages"))
    shape = (F.col("beside") >= min_pages) & (F.col("beside") >= SHAPE_SHARE * F.col("pages")) & (F.col("inside") <= SHAPE_INSIDE * F.col("beside"))
    return counts.join(pages, "host").where(content | prose | (F.col("host") != "") & shape).select("host", "mark")


def by_host(known: DataFrame) -> dict[str, np.ndarray]:
    """Sorted template hashes of each host."""
    rows = known.toArrow().sort_by([("host", "ascending"), ("mark", "ascending")])
    host, mark = rows.column("host").to_pylist(), rows.column("mark").to_numpy()
    first = [k for k in range(len(host)) if not k or host[k] != host[k - 1]]
    return {host[a]: mark[a:b].copy() for a, b in zip(first, [*first[1:], len(host)])}


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, text and n_chars of every page, and template_chars: code points of blocks that the site's template took away."""
    schema = "page_id long, url string, text string, n_chars long, template_chars long"
    found = stored(subtrees(pages), "subtrees")
    known = stored(templates(found, min_pages, min_share), "templates")
    if known.count() <= broadcast:
        shared = pages.sparkSession.sparkContext.broadcast(by_host(known))
        return keyed(pages).select("page_id", "url", "html", "host").mapInArrow(_text_batches(shared), schema)
    gone = stored(found.where(F.col("kind") != INSIDE).join(known, ["host", "mark"]).groupBy("key").agg(F.collect_set("mark").alias("gone")), "gone")
    return keyed(pages).join(gone, "key", "left").select("page_id", "url", "html", "gone").mapInArrow(_text_batches(None), schema)


def op4_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
