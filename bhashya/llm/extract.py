"""Main text of web pages by a site style tree, with tags and labels as evidence.

A page is parsed into nodes; a node's style is its path of tags and classes. The site
style tree merges the nodes of one host's pages by style. A node's importance joins
the entropy of its presentations (sequences of children) and of its contents over the
pages that have it: 1 if all pages differ, 0 if they agree. A content that ``SHARED``
pages have in common says nothing about a page, however many more pages there are, so
this is the base of the entropy for a larger number of pages; a page's own host name
counts as the same word on all hosts. A second tree is merged
over all hosts; a style's importance on a host is the mean of both, the host's weighing
by its pages and the other by ``BACKING``. Hosts with fewer than ``MIN_PAGES`` pages
have the second tree alone.

What a branch scores is its style's importance (``UNKNOWN`` where too few pages have
it) and what speaks for or against it: labels of page furniture, as whole class or id
names, and standing in the page's ``article`` or ``main``. Branches that score less
than ``KEEP`` go. Elements that are no text of an article by their own meaning (menus,
asides, forms, page headers and footers, scripts) go in any case, as do labelled reader
comments, whose text differs by nature. If a page has an ``article`` or ``main``, only
what stands in it is text. Where a page would lose everything (a host of copies), the
trees aren't asked. Inline elements, whatever their labels, never part a block.

Only styles on at least a hundredth of a host's pages, and on ``MIN_PAGES``, are
listed: at most a hundred times as many as a page has on average. That bounds what is
joined to a page and, over all hosts, what is broadcast. Counts are aggregated by host,
style and signature before they meet, so a host with very many pages is no burden.

Null, empty and markup-free html: the empty text, or the text itself. Null URLs
form one host. Repeated rows give repeated results and count as pages of their own.
An empty table gives no rows; columns other than the three, of whatever name, are
ignored. Whole pages are parsed.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

GAMMA = 0.9
SHARED = 16
BACKING = 16
MIN_PAGES = 16
UNKNOWN = 0.7
KEEP = 0.6
#: What speaks against a labelled branch, and for one within the main region.
FURNITURE = 0.6
WITHIN = 0.35
#: Elements that are nested deeper count as text of the one they stand in, as browsers have it.
DEEPEST = 512

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "xmp"}
#: No text of an article by their own meaning; header and footer in their own way.
_NEVER = {"head", "nav", "aside", "form", "template", "select", "button", "svg", "object", "canvas", "audio", "video", "dialog", "menu", "math", "datalist"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img"}
#: Names of page furniture, as whole class or id names.
_FURNITURE = {
    "ad", "ads", "adbox", "ad-box", "adslot", "ad-slot", "ad-container", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu",
    "main-menu", "site-nav", "sidebar", "side-bar", "footer", "site-footer", "page-footer", "header", "site-header", "page-header", "cookie", "cookies", "cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "notices",
    "popup", "modal", "newsletter", "newsletter-signup", "subscribe", "subscription", "share", "share-buttons", "sharing", "social", "social-links", "related", "related-posts", "related-articles", "recommended",
    "recommendations", "breadcrumb", "breadcrumbs", "widget", "pagination", "pager", "toolbar", "login", "signup", "disclaimer", "masthead", "topbar", "top-bar", "alert", "teaser", "outbrain", "taboola", "skip-link", "rail",
}
#: Names of reader comments, as whole class or id names.
_COMMENTS = {"comment", "comments", "comment-list", "comment-section", "comments-section", "comments-area", "post-comments", "reader-comments", "user-comments", "respond", "disqus", "disqus_thread", "discussion", "replies", "reactions"}
_MAIN = {"article", "main"}
#: An li or a cell ends the one before it.
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _hash(*parts) -> int:
    h = xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))
    return h - (1 << 64) if h >> 63 else h


class Page:
    """Blocks of text with the nodes they stand in, and signatures by style.

    A node is (tag, style, gone, furniture, within): whether it goes in any case,
    whether it is labelled, whether it is or stands in the main region.
    """

    def __init__(self, html: str, signatures: bool = True, evidence: bool = True, host: str = ""):
        self.blocks: list[tuple[str, tuple[tuple, ...]]] = []
        self.shapes: dict[int, int] = {}
        self.contents: dict[int, int] = {}
        self._stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        self._buffer: list[str] = []
        self._signatures, self._evidence, self._host = signatures, evidence, host
        self._last: tuple[int, int] | None = None
        self._deep: list[str] = []
        self._parse(html)
        self.has_region = any(chain and chain[-1][4] and not any(n[2] for n in chain) for _, chain in self.blocks)

    def _flush(self) -> None:
        if not self._buffer:
            return
        text = " ".join(entities.unescape("".join(self._buffer)).split())
        self._buffer.clear()
        if not text:
            return
        chain = tuple(self._stack[1:])
        self.blocks.append((text, chain))
        if self._signatures:
            h = xxhash.xxh64_intdigest(text.replace(self._host, "\0") if self._host else text)
            for style in {n[1] for n in chain}:
                self.contents[style] = (self.contents.get(style, 7) * 1000003 ^ h) & 0xFFFFFFFFFFFFFFF

    def _open(self, tag: str, attrs: str) -> None:
        parent = self._stack[-1]
        if len(self._stack) > DEEPEST:
            self._deep.append(tag)
            return
        within, gone, furniture, name = parent[4] or tag in _MAIN, tag in _NEVER, False, ""
        if attrs and not attrs.isspace():
            for key, *v in _ATTR.findall(attrs):
                value, key = v[0] or v[1] or v[2], key.lower()
                if key == "role":
                    gone |= value.lower() in _ROLES
                    within |= value.lower() == "main"
                elif key == "hidden":
                    furniture = True
                else:
                    labels = set(value.lower().split())
                    gone |= not _COMMENTS.isdisjoint(labels)
                    furniture |= not _FURNITURE.isdisjoint(labels)
                    if key == "class":
                        name = " ".join(sorted(value.split()))
        if tag == "footer" or tag == "header" and not parent[4]:  # an article's own head has its title
            gone = True
        if tag in ("html", "body") or tag in _MAIN and not parent[4]:
            gone = furniture = False  # what holds the page isn't furniture, whatever it is called
        if not self._evidence:
            gone, furniture, within = tag == "head", False, False
        style = _hash(parent[1], tag, name)
        if self._signatures and self._last != (parent[1], style):
            self.shapes[parent[1]] = (self.shapes.get(parent[1], 7) * 1000003 ^ _hash(tag, name)) & 0xFFFFFFFFFFFFFFF
            self._last = (parent[1], style)
        self._stack.append((tag, style, gone, furniture, within))

    def _close(self, tag: str) -> None:
        if self._deep:
            if tag in self._deep:
                while self._deep.pop() != tag:
                    pass
                return
            self._deep.clear()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                del self._stack[i:]
                return

    def _parse(self, html: str) -> None:
        at, stack, buffer = 0, self._stack, self._buffer
        find = _TOKEN.search
        while True:
            m = find(html, at)
            if m is None:
                buffer.append(html[at:])
                break
            if m.start() > at:
                buffer.append(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if tag in _INLINE or tag == "wbr":
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            closing = m[1] or m[4]
            if tag in _RAW:
                if not closing:
                    e = re.compile(f"</{tag}\\b[^>]*>", re.I).search(html, at)
                    at = e.end() if e else len(html)
                continue
            self._flush()
            if closing:
                self._close(tag)
                continue
            if stack[-1][0] == "p":  # any block ends an open paragraph
                stack.pop()
            if tag in _SAME:
                while stack[-1][0] in _SAME[tag]:
                    stack.pop()
            if tag not in _VOID:
                self._open(tag, (m[3] if m[2] else m[6]) or "")
        self._flush()

    def _kept(self, importance) -> list[str]:
        out = []
        for text, chain in self.blocks:
            if self.has_region and not (chain and chain[-1][4]):
                continue
            for _, style, gone, furniture, within in chain:
                if gone or importance(style) - FURNITURE * furniture + WITHIN * within < KEEP:
                    break
            else:
                out.append(text)
        return out

    def text(self, importance: dict[int, float] | None = None) -> str:
        """The blocks that stay; ``importance`` by style, ``UNKNOWN`` for others."""
        kept = self._kept(lambda s: importance.get(s, UNKNOWN)) if importance else []
        return "\n\n".join(kept or self._kept(lambda s: UNKNOWN))


def _host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_SHAPE, _CONTENT = 0, 1


def style_tree(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", gamma: float = GAMMA, evidence: bool = True) -> DataFrame:
    """``host, style, n, importance, total``: the merged nodes of each host, and those of
    all hosts with a null host; ``n`` pages of ``total`` have the style.

    Aggregates with partial sums; no row is larger than a few numbers.
    """

    def run(batches):
        for b in common.bounded(batches):
            hosts, styles, kinds, signs = [], [], [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(html or "", evidence=evidence, host=host)
                for kind, found in ((_SHAPE, page.shapes), (_CONTENT, {0: 0, **page.contents})):
                    for style, sign in found.items():
                        hosts.append(host)
                        styles.append(style)
                        kinds.append(kind)
                        signs.append(sign)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(styles, pa.int64()), pa.array(kinds, pa.int32()), pa.array(signs, pa.int64())], ["host", "style", "kind", "sign"])

    seen = pages.select(_host(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "host string, style long, kind int, sign long")
    one = common.materialise(seen.groupBy("host", "style", "kind", "sign").agg(F.count("*").alias("c")), "signatures")
    every = one.groupBy("style", "kind", "sign").agg(F.sum("c").alias("c")).select(F.lit(None).cast("string").alias("host"), "style", "kind", "sign", "c")
    both = one.unionByName(every)
    # pages with the style, by kind: a node without children has no shape
    size = both.groupBy("host", "style", "kind").agg(F.sum("c").alias("n"))
    shared = F.least(F.lit(1.0), F.log("c") / F.log(F.least(F.col("n"), F.lit(SHARED))))
    of = both.join(size.withColumnsRenamed({"host": "h", "style": "s", "kind": "k"}), F.col("host").eqNullSafe(F.col("h")) & (F.col("style") == F.col("s")) & (F.col("kind") == F.col("k")))
    entropy = of.groupBy("host", "style", "kind").agg(F.max("n").alias("n"), (1 - F.sum(F.when(F.col("n") > 1, F.col("c") * shared).otherwise(0.0)) / F.max("n")).alias("e"))
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    nodes = entropy.groupBy("host", "style").agg(pick(_CONTENT, "n").alias("n"), pick(_CONTENT, "e").alias("content"), pick(_SHAPE, "e").alias("shape"))
    total = size.filter((F.col("style") == 0) & (F.col("kind") == _CONTENT)).select(F.col("host").alias("h"), F.col("n").alias("total"))
    nodes = nodes.filter("style <> 0 AND n > 0").join(total, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    # a node without children is judged by its content alone
    return nodes.select("host", "style", "n", F.when(F.col("shape").isNull(), F.col("content")).otherwise((1 - gamma) * F.col("shape") + gamma * F.col("content")).alias("importance"), "total")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: bool = True, evidence: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row.

    ``tree=False`` leaves the trees out, ``evidence=False`` tags and labels; both
    are there to measure what each of them does.
    """
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), _host(url_col).alias("host"))
    overall: dict[int, tuple[int, float]] = {}
    if tree:
        nodes = common.materialise(style_tree(pages, url_col=url_col, html_col=html_col, evidence=evidence), "style-tree")
        common_ones = nodes.filter((F.col("n") >= MIN_PAGES) & (F.col("n") * 100 >= F.col("total")))
        overall = {r["style"]: r["importance"] for r in common_ones.filter("host IS NULL").select("style", "importance").collect()}  # bounded: see above
        listed = common_ones.filter("host IS NOT NULL").groupBy("host").agg(F.collect_list(F.struct("style", "n", "importance")).alias("nodes"))
        listed = common.materialise(listed, "host-styles")
        common.discard(nodes)
        df = df.join(listed, "host", "left")
    else:
        df = df.withColumn("nodes", F.lit(None).cast("array<struct<style:long,n:long,importance:double>>"))
    df = df.select("page_id", "url", "html", "nodes")
    schema = f"page_id {df.schema['page_id'].dataType.simpleString()}, url {df.schema['url'].dataType.simpleString()}, text string, n_chars long"
    kind = to_arrow_type(df.schema["url"].dataType)

    def run(batches):
        for b in common.bounded(batches):
            texts = []
            for html, nodes in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                importance = dict(overall)
                for x in nodes or ():
                    back = overall.get(x["style"])
                    importance[x["style"]] = x["importance"] if back is None else (x["n"] * x["importance"] + BACKING * back) / (x["n"] + BACKING)
                texts.append(Page(html or "", False, evidence).text(importance))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(kind), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.mapInArrow(run, schema)
