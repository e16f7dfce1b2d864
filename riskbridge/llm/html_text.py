"""Main text of web pages by paths that the pages of a host agree on.

A page's containers are told by their path of tags and classes, numbers generalised. Every page scores those containers
outside which it has no prose, only stray lines; the shares are added up per host and path in Spark, and the deepest path that
has most of the host's votes wins. Pages are then read again by their host's path; a page with prose outside it uses
its own. Menus, notices, adverts, forms, comments and the like never count as prose. A class or id tells them only if all
words of one of its names do.

A page's paths are a tree with links to parents, and shares are added up it once, so that time grows with the page's length, not
with its depth.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbridge.functions.durable import durable
from riskbridge.llm.common import broadcast_if_small

# HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "noembed", "xmp")
CONTAINERS = set("article main section div aside nav header footer form ul ol dl table tbody thead tfoot tr td th details fieldset figure body center".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre address figcaption caption summary hr legend hgroup search dialog menu option optgroup".split())
BLOCKS = CONTAINERS | LEAVES
# Elements and names that hold no article text.
DROPPED = set("nav footer aside form button select option menu dialog head datalist object audio video canvas label fieldset".split()) | set(RAW)
NAMES = set(
    "nav navbar navigation menu submenu sidebar side rail footer foot bottom header masthead topbar topnav ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus respond reply replies discussion reactions share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager widget widgets toolbar skip search outbrain taboola hidden".split()
)
FRAME = set(
    "area article articles bar block blog body bottom box button buttons col column container content entry fixed foot footer form global group head header heading holder icon icons inner item items js "
    "left line link links list main more new news outer page panel post posts primary right row section site slot sticky stories story tab tabs text title top unit wrap wrapper zone".split()
)  # words beside them that tell nothing
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# elements that the start of one ends: which, and where the search stops
_CELL = (("td", "th"), ("tr",))
ENDED_BY = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": _CELL, "th": _CELL}
AGREED, MAJORITY = 0.8, 0.5
STRAY = 40  # text outside links from which a line is prose wherever it stands
KEPT = {"article", "main", "ul", "ol", "dl", "table"}
LONGEST = 300  # characters from which a path is told by its hash

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
_NAME = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?\u2026][\"'\u2019\u201d)\]]*\Z")
_BLANK = re.compile(r"\s+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _label(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split()})
    return ".".join([tag, *classes]).replace("/", "_")


def _dropped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    return attributes.get("role") in ROLES or _named(tag, attributes, in_article)


def _named(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether a class or id names what isn't the article: all words of one name do, or are of those that tell nothing."""
    if tag in ("body", "html", "article", "main"):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = set(_NAME.findall(name))
        if words & NAMES and words <= NAMES | FRAME and not (in_article and words & NAMES <= {"header", "side", "foot", "bottom"}):
            return True
    return False


@dataclass
class Paths:
    """The container paths of a page as a tree; node 0 is the page, parents come before their children."""

    parent: list[int] = field(default_factory=lambda: [-1])
    name: list[str] = field(default_factory=lambda: [""])
    depth: list[int] = field(default_factory=lambda: [0])
    kept: list[bool] = field(default_factory=lambda: [False])  # in an article, list or table
    _known: dict[tuple[int, str], int] = field(default_factory=dict)

    def child(self, of: int, tag: str, label: str) -> int:
        node = self._known.get((of, label))
        if node is None:
            node = self._known[of, label] = len(self.parent)
            name = f"{self.name[of]}/{label}"
            self.parent.append(of)
            self.name.append(name if len(name) <= LONGEST else "#" + md5(name.encode("utf-8", "replace"), usedforsecurity=False).hexdigest())
            self.depth.append(self.depth[of] + 1)
            self.kept.append(self.kept[of] or tag in KEPT)
        return node


@dataclass(frozen=True)
class Block:
    node: int
    text: str
    linked: int  # characters inside links
    heading: bool  # in a heading of the first two ranks
    paragraph: bool

    @property
    def worth(self) -> int:
        """Characters, those in links a tenth, in tenths."""
        return 10 * len(self.text) - 9 * min(self.linked, len(self.text))


def read(html: str) -> tuple[Paths, list[Block]]:
    """The paths and the blocks of text that may be prose, in page order."""
    paths, found = Paths(), []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, path, dropped, in an article
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _BLANK.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if whole:
                found.append(Block(stack[-1][1], whole, linked, opened["h1"] + opened["h2"] > 0, opened["p"] > 0))
        linked = 0

    def close(to: int) -> None:
        while len(stack) > to:
            if stack[-1][0] in BLOCKS:
                flush()
            opened[stack.pop()[0]] -= 1

    def last(tags: tuple[str, ...], stop: tuple[str, ...]) -> int | None:
        if not any(opened[t] for t in tags):
            return None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stop:
                return None
        return None

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1][2]:
            text.append(piece)
            if opened["a"] > 0:
                linked += len(piece)

    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            i = last((tag,), ("td", "th", "table") if tag in ("p", "li", "div") else ())
            if i is not None:
                close(i)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        raw = m[3] if m[2] else m[6]
        if tag in RAW:
            end = None if raw.endswith("/") else _RAW_END[tag].search(html, at)
            at = at if raw.endswith("/") else end.start() if end else len(html)
            continue
        if tag in BLOCKS:
            flush()
            i = last(("p",), ("td", "th", "table", "button", "object"))
            if i is not None:
                close(i)
            if tag in ENDED_BY:
                i = last(*ENDED_BY[tag])
                if i is not None:
                    close(i)
        _, path, gone, article = stack[-1]
        attributes = _attributes(raw)
        gone = gone or _dropped(tag, attributes, article)
        if tag in CONTAINERS and tag != "body":
            path = paths.child(path, tag, _label(tag, attributes))
        opened[tag] += 1
        stack.append((tag, path, gone, article or tag in ("article", "main")))
    add(html[at:])
    close(1)
    flush()
    return paths, found


def shares(paths: Paths, found: list[Block]) -> dict[int, float]:
    """Share of the page's prose inside each container path that leaves none out; words in links count a tenth.

    Left out may be links and stray short lines, up to a fifth of the page, but no headings, no paragraph that ends as a sentence
    does, and nothing of an article, list or table.
    """
    held, prose = [0] * len(paths.parent), [0] * len(paths.parent)
    for b in found:
        held[b.node] += b.worth
        prose[b.node] += 2 * b.linked < len(b.text) and (b.heading or b.worth >= 10 * STRAY or paths.kept[b.node] or (b.paragraph and _SENTENCE.search(b.text) is not None))
    for node in range(len(held) - 1, 0, -1):
        held[paths.parent[node]] += held[node]
        prose[paths.parent[node]] += prose[node]
    least = AGREED if prose[0] else 1.0
    return {node: v / held[0] for node, v in enumerate(held) if v and prose[node] == prose[0] and v >= least * held[0]} if held[0] else {}


def main_text(html: str, path: str | None) -> str:
    """Blocks inside the host's path, or the page's own path where the host has none or it would leave prose of the page out.

    The page's own is the deepest path that leaves no prose out; of equally deep ones the fullest, then the first by name.
    """
    paths, found = read(html)
    held = shares(paths, found)
    node = next((n for n in held if path and paths.name[n] == path), None)
    if node is None:
        node = max(held, key=lambda n: (paths.depth[n], held[n], [-ord(c) for c in paths.name[n]] if paths.depth[n] < 100 else [])) if held else 0
    inside = [False] * len(paths.parent)
    for n in range(len(inside)):
        inside[n] = n == node or (n > 0 and inside[paths.parent[n]])
    return "\n\n".join(b.text for b in found if inside[b.node])


def _host(url):  # noqa: ANN001, ANN202
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the deepest path that leaves no prose out on most of the host's pages. Votes are added up before they are shuffled."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                paths, found = read(html or "")
                out += [(host, paths.name[n], paths.depth[n], v) for n, v in shares(paths, found).items()]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.float64()), strict=True)], names=["host", "path", "depth", "share"])

    cast = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(votes, "host string, path string, depth int, share double")
    # shares are added as whole millionths, so that the order of addition doesn't matter
    added = durable(cast.groupBy("host", "path", "depth").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes")))
    # a host's highest count is added up as a plain maximum, so that a host of many paths is no task of its own
    agreed = added.join(added.groupBy("host").agg(F.max("votes").alias("all")), "host").filter(F.col("votes") >= MAJORITY * F.col("all"))
    return agreed.groupBy("host").agg(F.max_by("path", F.struct("depth", "votes", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null html is empty; a null or odd url belongs to the host "". An empty page and one without prose give an empty
    text. Repeated pages are read alike. Broken and cut off markup is read as far as it goes. Other columns are ignored.
    """
    paths = durable(host_paths(pages))
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host")).join(broadcast_if_small(paths, paths.count(), 200_000), "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h or "", p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "path").mapInArrow(read, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
