"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged by path.  A node of the merged tree has its
presentations (sequences of child elements) and its contents (text blocks); their entropies over the
host's pages tell how much a node says: presentation that is alike on all pages, and a block that
stands on all pages, say nothing.  How sure that is grows with the pages that have the node, m:
repetition counts by (m - 1) / m.  On each page importance goes up the tree, as

    importance = presentation part + GAMMA ** (number of presentations) * mean importance of what is inside,

weighted by characters; inside are blocks, each with its content importance, less by its share of
linked text, and what stands outside of the page's article or main element counts little.  What
elements, roles and class words say of a node lowers the presentation's importance.  Branches of low
importance are removed; what is left is the text.  The merged tree is never gathered: it is a table of
counts, aggregated by host, path and feature, of which a page meets the rows that lower importance.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .tokens import by_bytes, strings

#: Weight of what is inside a node against its own presentation.
GAMMA = 0.9
#: Branches and blocks under this importance are removed.
LOW_IMPORTANCE = 0.25
#: Presentations and blocks of at least this importance count as fully important, so that a page meets few rows.
LISTED_STYLE, LISTED_BLOCK = 0.9, 0.5
#: What linked text loses outside and inside of an article, what stands outside of one, and what a doubtful name leaves.
LINKED, LINKED_INSIDE, OUTSIDE, DOUBTFUL = 1.0, 0.6, 0.2, 0.4

#: Fixed names. Elements whose text runs to their end tag and is never content.
RAW = frozenset("script style template noscript textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements without prose.
NEVER = frozenset("head button select svg canvas audio video object map datalist input".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note status".split())
#: Class and id words of what is never part of an article, wherever it stands.
FOREIGN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsors sponsored promo promos promotion comment comments commentlist disqus "
    "reply replies respond cookie cookies consent gdpr popup newsletter subscribe subscription signup login signin social share sharing shares paywall".split()
)
#: Class and id words of what stands around an article; inside of one they are doubtful.
AROUND_WORDS = frozenset(
    "banner nav navbar navigation menu menus breadcrumb breadcrumbs masthead header footer sidebar sidebars aside rail widget widgets related recommended "
    "recommendations discussion notice notices alert alerts modal overlay toolbar pagination pager search searchbox copyright disclaimer skip skiplink callout".split()
)
#: A start tag of the first name ends an open element of the second names.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
}
ENDS_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot option optgroup legend summary".split())
_P_WALLS, _LIST_WALLS = ENDS_P - {"p"}, frozenset(("ul", "ol", "dl", "table", "select"))
#: Elements that end tags and implied ends inside don't reach beyond.
WALLS = frozenset("article main body table td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def unseen(tag: str, attrs: dict[str, str]) -> bool:
    """Whether readers don't see an element, or it has no prose."""
    if tag in NEVER:
        return True
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or "hidden" in attrs.get("class", "").split() or re.search(r"display\s*:\s*none", attrs.get("style", "")) is not None)


def named(tag: str, attrs: dict[str, str], in_article: bool) -> tuple[float, bool]:
    """What an element's name, role and class words leave of its importance, and whether that holds if it has the article inside."""
    if tag in ("html", "body", "main", "article"):
        return 1.0, False
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return 0.0, False
    if not attrs:
        return 1.0, False
    if attrs.get("role", "").lower() in NOISE_ROLES:
        return 0.0, False
    if "class" not in attrs and "id" not in attrs:
        return 1.0, False
    words = {w.lower() for w in _WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
    if not words.isdisjoint(FOREIGN_WORDS):
        return 0.0, True
    return (1.0 if words.isdisjoint(AROUND_WORDS) else DOUBTFUL if in_article else 0.0), False


@lru_cache(maxsize=1 << 14)
def tag_of(tag: str, source: str, in_article: bool) -> tuple[str, bool, int, float, bool]:
    """Class, whether unseen, zone that it opens (2 article, 1 main), and what :func:`named` says, of a start tag."""
    attrs = attributes(source) if source and not source.isspace() else {}
    zone = 2 if tag == "article" else 1 if tag == "main" or attrs.get("role") == "main" else 0
    return attrs.get("class", ""), unseen(tag, attrs), zone, *named(tag, attrs, in_article)


@lru_cache(maxsize=1 << 16)
def path_of(parent: int, tag: str, name: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{tag}.{name}", seed=parent & (2**64 - 1)))


class Page:
    """One pass over a page: its block elements as nodes in page order, and the text blocks inside them."""

    def __init__(self, html: str):
        #: By node: parent, path, zone (2 in an article, 1 in main), what names leave, whether firmly, child elements.
        self.parent, self.path, self.zone, self.name, self.firm, self.style = [0], [0], [0], [1.0], [False], [[]]
        self.fixed = [True]  # nodes that are never removed as a whole
        #: By block: text, node, share of linked characters.
        self.blocks: list[str] = []
        self.node: list[int] = []
        self.linked: list[float] = []
        self._open: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, unseen, node
        self._text: list[str] = []
        self._links, self._sizes = 0, [0, 0]
        self._read(html)
        while len(self._open) > 1:
            self._close()
        self._flush()

    def features(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
        """(path, presentation) and (path, block), each once, and a digest of the page's text."""
        styles: dict[int, list[str]] = {}
        filled = {0}
        for k in self.node:
            while k not in filled:
                filled.add(k)
                k = self.parent[k]
        for k in sorted(filled - {0}):
            styles.setdefault(self.path[k], []).append(" ".join(self.style[k]))
        return (
            [(p, _signed(xxhash.xxh64_intdigest("/".join(s)))) for p, s in styles.items()],
            sorted({(self.path[k], self.key(i)) for i, k in enumerate(self.node)}),
            _signed(xxhash.xxh64_intdigest("\n".join(self.blocks))),
        )

    def key(self, i: int) -> int:
        """Hash of a block and its node's path."""
        return _signed(xxhash.xxh64_intdigest(self.blocks[i], seed=self.path[self.node[i]] & (2**64 - 1)))

    def text(self, styles: dict[int, tuple[float, float]], repeated: dict[int, float]) -> str:
        """The blocks of the branches whose importance isn't low.

        ``styles`` has the presentation part and the weight of what is inside by path, ``repeated`` the
        importance of blocks by :meth:`key`; what isn't there differs from page to page.
        """
        n = len(self.parent)
        size, total, inside = [0] * n, [0.0] * n, [False] * n
        own = []
        for i, k in enumerate(self.node):
            value = repeated.get(self.key(i), 1.0) if repeated else 1.0
            value *= 1 - (LINKED_INSIDE if self.zone[k] else LINKED) * self.linked[i]
            own.append(value)
            size[k] += len(self.blocks[i])
            total[k] += value * len(self.blocks[i])
        worth = [1.0] * n
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            inside[k] = inside[k] or (self.zone[k] > self.zone[up] and not self.firm[k])
            if size[k]:
                part, weight = styles.get(self.path[k], (1 - GAMMA, GAMMA)) if styles else (1 - GAMMA, GAMMA)
                worth[k] = (part + weight * total[k] / size[k]) * (1.0 if inside[k] and not self.firm[k] else self.name[k])
                size[up] += size[k]
                total[up] += worth[k] * size[k]
            inside[up] = inside[up] or (inside[k] and not self.firm[k])
        gone = [False] * n
        for k in range(1, n):
            gone[k] = gone[self.parent[k]] or (worth[k] < LOW_IMPORTANCE and not (self.fixed[k] or (inside[k] and not self.firm[k])))
        left = [i for i, k in enumerate(self.node) if not gone[k]]
        zoned = any(self.zone[self.node[i]] for i in left)
        return "\n".join(self.blocks[i] for i in left if own[i] * (1.0 if self.zone[self.node[i]] or not zoned else OUTSIDE) >= LOW_IMPORTANCE)

    def _flush(self) -> None:
        if self._text:
            block = " ".join(unescape("".join(self._text)).split())
            self._text = []
            if block:
                self.blocks.append(block)
                self.node.append(self._open[-1][2])
                self.linked.append(self._sizes[1] / max(1, sum(self._sizes)))
            self._sizes = [0, 0]

    def _add(self, text: str) -> None:
        self._text.append(text)
        self._sizes[self._links > 0] += len(text.strip())

    def _close(self) -> None:
        tag, hidden, _ = self._open[-1]
        if not hidden:
            if tag in BLOCK:
                self._flush()
            elif tag == "a":
                self._links -= 1
        self._open.pop()

    def _end(self, tag: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == tag:
                while len(self._open) > k:
                    self._close()
                return
            if self._open[k][0] in WALLS and not (tag in WALLS or tag == "html"):
                return

    def _start(self, tag: str, source: str) -> None:
        if tag in ENDS_P:
            self._imply(("p",), _P_WALLS)
        if tag in ENDS:
            self._imply(ENDS[tag], _LIST_WALLS)
        _, hidden, node = self._open[-1]
        if not hidden:
            if tag in BLOCK:
                self._flush()
            elif tag == "br":
                self._add(" ")
        if tag in VOID:
            return
        if hidden:
            self._open.append((tag, True, node))
            return
        read = tag_of if len(source or "") < 500 else tag_of.__wrapped__  # long attributes aren't held
        name, hide, zone, left, firm = read(tag, source or "", self.zone[node] > 0)
        self.style[node].append(tag)
        if hide:
            self._open.append((tag, True, node))
            return
        if tag in BLOCK or left < 1:
            self.parent.append(node)
            self.path.append(path_of(self.path[node], tag, name))
            self.zone.append(max(self.zone[node], zone))
            self.name.append(left)
            self.firm.append(firm)
            self.style.append([])
            self.fixed.append(tag in ("html", "body", "main", "article"))
            node = len(self.parent) - 1
            if tag not in BLOCK:
                self._flush()
        if tag == "a":
            self._links += 1
        self._open.append((tag, False, node))

    def _imply(self, tags: tuple, walls: frozenset) -> None:
        """End the innermost open element of ``tags`` and all inside it, but for walls between."""
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] in tags:
                while len(self._open) > k:
                    self._close()
                return
            if self._open[k][0] in walls or self._open[k][0] in WALLS:
                return

    def _read(self, html: str) -> None:
        at = 0
        while m := _TOKEN.search(html, at):
            if m.start() > at and not self._open[-1][1]:
                self._add(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA[") and not self._open[-1][1]:
                    self._add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            if m[1] or m[4]:
                self._end(tag)
                if tag == "p" and not self._open[-1][1]:
                    self._flush()
            elif tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
            else:
                self._start(tag, m[3] if m[2] else m[6])
        if not self._open[-1][1]:
            self._add(html[at:])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def main_text(html: str, styles: dict[int, tuple[float, float]] | None = None, repeated: dict[int, float] | None = None) -> str:
    return Page(html).text(styles or {}, repeated or {})


def style_tree(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """What lowers importance: ``host, kind, key, part, weight``, a row for each node or block that does.

    For a node (kind 0) ``key`` is its path, with the presentation part and the weight of what is inside;
    for a block (kind 1) ``key`` is its hash, with its importance.  Pages of a host with the same text
    count once, so that copies of a page don't make its article look like a template.
    """

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole, "t"):
                found = [Page(html).features() for html in strings(b.column("t")).to_pylist()]
                lists = []
                for side in (0, 1):
                    flat = [x for f in found for x in f[side]]
                    pair = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int64()) for k in (0, 1)], names=["p", "f"])
                    ends = pa.array([0, *accumulate(len(f[side]) for f in found)], pa.int32())
                    lists.append(pa.ListArray.from_arrays(ends, pair))
                yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([f[2] for f in found], pa.int64()), *lists], names=["host", "page", "styles", "blocks"])

    slim = pages.select(F.col(host_col).alias("h"), F.col(html_col).alias("t"))
    pair = "array<struct<p:long,f:long>>"
    seen = written(slim.mapInArrow(run, f"host string, page long, styles {pair}, blocks {pair}").dropDuplicates(["host", "page"]), "pages-seen")
    n, m = F.col("n"), F.col("m").cast("double")

    def counts(side: str) -> DataFrame:
        return seen.select("host", F.explode(side).alias("x")).groupBy("host", F.col("x.p").alias("p"), F.col("x.f").alias("f")).agg(F.count("*").alias("n"))

    own = counts("styles").groupBy("host", "p").agg(F.sum("n").alias("m"), F.count("*").alias("l"), F.sum(n * F.log(n.cast("double"))).alias("s")).where("m > 1")
    spread = 1 - F.col("s") / m / F.log(m)
    nodes = written(own.select("host", "p", "m", F.col("l").cast("double").alias("l"), (1 - (1 - spread) * (m - 1) / m).alias("spread")), "nodes-seen")
    inside = F.pow(F.lit(GAMMA), F.col("l"))
    alike = nodes.where(F.col("spread") < LISTED_STYLE).select("host", F.lit(0).alias("kind"), F.col("p").alias("key"), ((1 - inside) * F.col("spread")).alias("part"), inside.alias("weight"))
    repeated = counts("blocks").where("n > 1").join(nodes.select("host", "p", "m"), ["host", "p"])
    value = 1 - F.log(n.cast("double")) / F.log(m) * (m - 1) / m
    low = repeated.withColumn("part", value).where(F.col("part") < LISTED_BLOCK).select("host", F.lit(1).alias("kind"), F.col("f").alias("key"), "part", F.lit(0.0).alias("weight"))
    return alike.union(low)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``id_col, url_col, text, n_chars``.

    Null html counts as empty; a null url belongs to a host without a name; null ids and repeated
    rows are pages like any other; other columns are left out; an empty table gives an empty result.
    Malformed markup is read as browsers do in the main: unclosed paragraphs, items and cells end
    where the next begins, unknown end tags are passed over, open comments run to the end.
    """
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    slim = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("t"), host.alias("host"))
    rows = F.sort_array(F.collect_list(F.struct("kind", "key", "part", "weight")))
    tree = written(style_tree(slim, "host", "t").groupBy("host").agg(rows.alias("tree")), "style-tree")  # Spark broadcasts it only if its files are small
    joined = slim.join(tree, "host", "left").select("i", "u", "t", "host", "tree")

    def run(batches):
        last, known = None, ({}, {})
        for whole in batches:
            for b in by_bytes(whole, "t"):
                hosts, trees, texts = b.column("host").to_pylist(), b.column("tree"), []
                for k, html in enumerate(strings(b.column("t")).to_pylist()):
                    if hosts[k] != last or last is None:
                        last, own = hosts[k], trees[k].as_py() or ()
                        known = {x["key"]: (x["part"], x["weight"]) for x in own if not x["kind"]}, {x["key"]: x["part"] for x in own if x["kind"]}
                    texts.append(main_text(html, *known))
                yield pa.RecordBatch.from_arrays([b.column("i"), b.column("u"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
