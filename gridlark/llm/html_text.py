"""Main text of web pages, without the templates of their sites.

First pass: each page's block elements are hashed, subtree by subtree (tag,
attributes, text, children), and Spark counts on how many pages of a host each
hash occurs; pages of the same text count once.  Subtrees on a fifth of a
host's pages, and on at least five, are the site's template, but for text
blocks of an article or main element and what holds them.  Second pass: pages are read again; template subtrees,
page furniture and markup go, the article's blocks stay.

Scale: the first pass shuffles 24 bytes for each distinct subtree of a page,
with copies left out and partial counts, so a host with a third of all pages is spread by hash.  A
host has at most five times as many template hashes as a page has blocks.  The
template table is broadcast if it is counted to be small; else pages meet it in
a join on the host.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm.common import stored, tidy

#: A template subtree is on so many pages of its host at least, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.2
#: Template rows (about 40 bytes) up to which the table is broadcast.
BROADCAST_ROWS = 50_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# HTML's element kinds, and names by which page furniture is known.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video".split()
)
_CLOSED_BY_SAME = frozenset("li dd dt option tr td th thead tbody tfoot".split())
_CLOSES_DD = frozenset(("dd", "dt"))
_DROPPED = frozenset("head nav footer aside form button select input dialog menu script style noscript template iframe svg canvas object audio video map textarea fieldset".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login".split()
)
#: What such a name may be joined to and still tell of nothing else: ad-box, comments_list, but not share-price.
_FILLERS = frozenset(
    "box bar block wrapper wrap container section list area slot unit panel links link buttons button btn group inner outer top bottom left right site page global "
    "content posts articles stories news items item icons media module zone message toggle title heading".split()
)
_HEADER = frozenset(["header"])
_COMMENT_NAMES = frozenset("comment comments reply replies respond".split())
#: Names that layout wrappers round the article bear, too: a main or article element inside them is read all the same.
_LAYOUT_NAMES = frozenset("sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager widget footer masthead toolbar search banner skip".split())
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr figcaption".split())

_KEEP, _LAYOUT, _DROP = 0, 1, 2


class _Element:
    __slots__ = ("article", "fate", "holds", "inside", "own", "parts", "tag")

    def __init__(self, tag: str, own: int, fate: int, article: bool, inside: bool, head: str):
        self.tag, self.own, self.fate, self.article, self.inside, self.parts = tag, own, fate, article, inside, [head]
        #: Whether text blocks with a text were read within it.
        self.holds = False


def _means(token: str, names: frozenset[str]) -> bool:
    """Whether a class or id is made of such names, with fillers and numbers at most."""
    parts = [x.lower() for x in _NAME_PART.findall(token)]
    return any(x in names for x in parts) and all(x in names or x in _FILLERS or x.isdigit() for x in parts)


def _fate(tag: str, attributes: str, article: bool) -> int:
    """What an element's tag and attributes say about it."""
    if tag in _DROPPED or (tag == "header" and not article):
        return _DROP
    if not attributes or tag in ("html", "body"):
        return _KEEP
    tokens: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        low = value.lower()
        if key in ("class", "id"):
            tokens += value.split()
        elif key == "role" and low in _DROPPED_ROLES or key == "hidden" or key == "aria-hidden" and low == "true":
            return _DROP
        elif key == "style" and "display:none" in low.replace(" ", ""):
            return _DROP
    if not tokens:
        return _KEEP
    if tag in ("article", "main"):  # a comment may be an article; nothing else takes one away
        return _DROP if tag == "article" and any(_means(t, _COMMENT_NAMES) for t in tokens) else _KEEP
    if any(_means(t, _DROPPED_NAMES) for t in tokens):
        return _DROP
    if any(_means(t, _LAYOUT_NAMES | _DROPPED_NAMES) or (not article and _means(t, _HEADER)) for t in tokens):
        return _LAYOUT
    return _KEEP


class Page:
    """One reading of a page: its text blocks and the hashes of its block elements.

    template: hashes of subtrees to delete.  wrappers: whether layout names take
    away what no article or main element holds.
    """

    def __init__(self, source: str, template: frozenset[int] = frozenset(), wrappers: bool = True):
        self.template, self.wrappers = template, wrappers
        #: Hashes of the block elements; text blocks within an article or main, and what holds them, left out.
        self.hashes: set[int] = set()
        #: (rank, text): rank 3 in an article of main, 2 in another article, 1 in main, 0 elsewhere.
        self.blocks: list[tuple[int, str]] = []
        self._pending: list[str] = []
        self._stack: list[_Element] = [_Element("", _KEEP, _KEEP, False, False, "")]
        self._rank = 0
        self._ranks: list[int] = []
        #: Whether layout names were met.
        self.wrapped = False
        self._read(source)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._end(tag)
                continue
            attributes = m[3] if m[2] else m[6]
            if tag in _RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                body = source[at : close.start()] if close else source[at:]
                self._stack[-1].parts.append(f"<{tag}{attributes}>{body}")
                at = n if close is None else (source.find(">", close.start()) + 1 or n)
                continue
            self._start(tag, attributes)
        while len(self._stack) > 1:
            self._pop()
        self._flush()

    def _text(self, text: str) -> None:
        top = self._stack[-1]
        if top.fate == _KEEP:
            self._pending.append(text)
        if text.strip():
            top.parts.append(text)

    def _flush(self) -> None:
        if self._pending:
            text = " ".join(_html.unescape("".join(self._pending)).split())
            self._pending = []
            if text:
                self.blocks.append((self._rank, text))

    def _start(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag in _BLOCK:
            self._flush()
            self._close_before(tag)
        elif tag == "br":
            self._flush()
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            stack[-1].parts.append(f"<{tag}{attributes}>")
            return
        parent = stack[-1]
        own = _fate(tag, attributes, parent.article)
        if own == _LAYOUT:
            self.wrapped = True
            own = _LAYOUT if self.wrappers else _KEEP
        fate = max(own, parent.fate)
        if fate == _LAYOUT and own == _KEEP and tag in ("main", "article"):
            fate = _KEEP
        stack.append(_Element(tag, len(self.blocks), fate, parent.article or tag == "article", parent.inside or tag in ("article", "main"), f"<{tag}{attributes}>"))
        if tag in ("article", "main"):
            self._ranks.append(self._rank)
            self._rank = self._rank | (2 if tag == "article" else 1)

    def _close_before(self, tag: str) -> None:
        """What a block's start tag closes without an end tag."""
        stack = self._stack
        closed = ("p",) if tag not in _CLOSED_BY_SAME else ("p", "dd", "dt") if tag in _CLOSES_DD else ("p", tag)
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k].tag
            if name in closed:
                while len(stack) > k:
                    self._pop()
                if name != "p":
                    return
            elif name in _BLOCK:
                return

    def _end(self, tag: str) -> None:
        stack = self._stack
        block = tag in _BLOCK
        if block:
            self._flush()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                while len(stack) > k:
                    self._pop()
                return
            if not block and stack[k].tag in _BLOCK:
                return

    def _pop(self) -> None:
        e = self._stack.pop()
        if e.tag in _BLOCK:
            self._flush()
        digest = xxhash.xxh3_64_intdigest("\x00".join(e.parts))
        self._stack[-1].parts.append(f"{digest:x}")
        if e.tag in ("article", "main"):
            self._rank = self._ranks.pop()
        if e.holds or e.tag in _TEXT_BLOCKS and len(self.blocks) > e.own:
            e.holds = self._stack[-1].holds = True
        if e.tag in _BLOCK and e.tag not in ("html", "body", "article", "main") and not (e.inside and (e.holds or e.tag in _TEXT_BLOCKS)):
            self.hashes.add(digest)
            if digest in self.template:
                del self.blocks[e.own :]

    def text(self) -> str:
        """The article's blocks if there are any, else main's, else all, joined by newlines.

        An article that holds less of main's text than the rest does is a
        teaser: then main is the text.
        """
        size = [sum(len(t) for r, t in self.blocks if r == rank) for rank in range(4)]
        if size[2] + size[3] and size[1] <= size[2] + size[3]:
            chosen = [t for r, t in self.blocks if r & 2]
        elif size[1]:
            chosen = [t for r, t in self.blocks if r & 1]
        else:
            chosen = [t for _, t in self.blocks]
        return "\n".join(chosen)


def page_text(source: str, template: frozenset[int] = frozenset()) -> str:
    """The page's main text; if layout names leave nothing, they are not heeded."""
    page = Page(source, template)
    text = page.text()
    return text if text or not page.wrapped else Page(source, template, wrappers=False).text()


def host_column(url: str):
    """The url's host in lower case; empty for a null or odd url."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, hashes): the subtrees that recur across many pages of a host.  pages: host and html; those of the same text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                of, texts, found = [], [], []
                for k, source in enumerate(batch.column(1).slice(first, 500)):
                    page = Page(source.as_py() or "")
                    hashes = page.hashes
                    of += [first + k] * (len(hashes) + 1)
                    texts += [xxhash.xxh3_64_intdigest(page.text()) - (1 << 63)] * (len(hashes) + 1)
                    found += [None, *(h - (1 << 64) if h >> 63 else h for h in hashes)]  # the null counts the page
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(texts, pa.int64()), pa.array(found, pa.int64())], ["host", "page", "hash"])

    rows = pages.select("host", "html").mapInArrow(tidy(run), "host string, page long, hash long").distinct()
    counts = rows.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    often = counts.where(F.col("hash").isNotNull() & (F.col("n") >= least_pages)).join(totals, "host").where(F.col("n") >= least_share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract_text(df: DataFrame, html: str = "html", url: str = "url", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) and text, the page's main text.

    Null or empty html gives an empty text; a very long page is read whole.
    Pages without a host share one.  An empty df gives an empty result.
    Rows stay as they are, repeated ones too; a column of df named like text is
    replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != text]
    pages = df.select(F.struct(*keep).alias("kept"), host_column(url).alias("host"), F.col(html).alias("html"))
    found = stored(templates(pages))
    if (found.select(F.sum(F.size("hashes") + 1)).first()[0] or 0) <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = pages.join(found, "host", "left").select("kept", "html", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                made = []
                for source, hashes in zip(part.column(1), part.column(2), strict=True):
                    template = frozenset(h % (1 << 64) for h in hashes.as_py() or ())
                    made.append(page_text(source.as_py() or "", template))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], ["kept", text])

    out = rows.mapInArrow(tidy(run), T.StructType([rows.schema["kept"], T.StructField(text, T.StringType())]))
    return out.select("kept.*", text)
