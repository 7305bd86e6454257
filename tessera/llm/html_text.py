"""Main text of web pages by consensus host paths.

Every page is read into a tree of elements by a small tolerant scanner. Its containers are scored by the text they
hold outside links and outside boilerplate elements; each page votes, with those scores, for the generalised path of
its best containers (tags with class names whose digits are masked). Votes are added up per host in Spark, and every
page is then extracted again from the container that its host's winning path names; pages without it use their own.

Votes combine before the shuffle, so a host with a third of all pages costs a row per task. Winning paths are one row
per host; they are broadcast when counted to be few and joined by shuffle otherwise.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_broadcast, text_or_empty, written

#: Labels that a path spells out.
PATH_LABELS = 32

# Names of the HTML standard, and words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form script style noscript template iframe svg canvas button select textarea input label menu dialog head title object embed audio video map figure".split()) - {"figure"}
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay sidebar side aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot copyright "
    "comment comments commentlist disqus reply replies respond reviews share sharing social related recommended recommendations newsletter subscribe signup login "
    "search pagination pager toolbar skip tracking".split()
)
PARTS = frozenset(
    "area bar block body bottom box btn button buttons center column container content count desktop entry fixed form global group holder icon icons inner item items "
    "label large left line link links list main mobile module outer page panel primary region right row secondary section site slot small sticky stories strip tab tabs "
    "thread top unit wrap wrapper zone post posts articles author".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTAINER = frozenset("article main section div td body html blockquote ol ul dl table tbody tr li details figure center".split())
WITHIN = frozenset("li ol ul tr td tbody table blockquote dl figure details center".split())
CLOSES_P = BLOCK - {"li", "dt", "dd", "option", "optgroup", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption", "html", "body"}
SELF_NESTING_END = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

# As in the HTML standard: a quote opens a value only right after "=", and ">" ends a tag outside quoted values.
_VALUE = r"\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>][^\s>]*+)|"
_ATTR = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:{_VALUE}))?+")
_INSIDE = re.sub(r"(?<!\\)\((?!\?)", "(?:", rf"(?:[\s/]++|{_ATTR.pattern})*+")
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>\x00]*+)({_INSIDE})(?:>|\Z)", re.S)
_CLOSED = re.compile(r"(?:\A|[\s\"'])/\s*\Z")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_LAYOUT = re.compile(r"(?:has|with|no|without|is|not)[-_]", re.I)  # says what a layout has beside it, not what an element is
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element: ``kids`` are nodes and pieces of raw text, in order."""

    __slots__ = ("tag", "kids", "parent", "label", "drop", "key")

    def __init__(self, tag: str, parent: Node | None, label: str, drop: bool) -> None:
        self.tag, self.parent, self.label, self.drop, self.kids = tag, parent, label, drop, []
        self.key = xxhash.xxh3_64_intdigest(label, seed=parent.key) if parent else 0

    @property
    def path(self) -> str:
        """The generalised path: labels from the root on; of a deeper element the last ones, after a hash of the others."""
        parts, node = [], self
        while node.parent is not None and len(parts) < PATH_LABELS:
            parts.append(node.label)
            node = node.parent
        if node.parent is not None:
            parts.append(f"#{node.key:016x}")
        return "/".join(reversed(parts))


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _furniture(tag: str, attrs: dict[str, str]) -> bool:
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower() or attrs.get("role", "").lower() in FURNITURE_ROLES:
        return True
    names = [t for name in ("class", "id") for t in attrs.get(name, "").split() if not _LAYOUT.match(t)]
    return any(_furniture_name(_WORD.findall(_CAMEL.sub(" ", t).lower())) for t in names)


def _furniture_name(words: list[str]) -> bool:
    """Whether a name says that an element is furniture: its last word does, or its first one does and the others only
    say which part. In ``header-text`` or ``ad-hoc-note`` the first word describes something else."""
    if not words:
        return False
    return words[-1] in FURNITURE_WORDS or (words[0] in FURNITURE_WORDS and all(w in PARTS or w in FURNITURE_WORDS for w in words[1:]))


def parse(page: str) -> Node:
    """The tree of a page. Unclosed and misnested elements are closed where the standard's implied ends close them."""
    root = Node("", None, "", False)
    at, cur = 0, root
    opened: Counter[str] = Counter()

    def leave(node: Node) -> None:
        """Close the open elements down to ``node``."""
        nonlocal cur
        while cur is not node.parent:
            opened[cur.tag] -= 1
            cur = cur.parent

    while at < len(page):
        m = _MARKUP.search(page, at)
        if not m:
            cur.kids.append(page[at:])
            break
        if m.start() > at:
            cur.kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                top = cur
                while top.tag != tag:
                    top = top.parent
                leave(top)
            continue
        if tag in CLOSES_P and opened["p"]:  # an open paragraph ends here, if nothing but inline elements is open in it
            top = cur
            while top is not root and top.tag not in BLOCK:
                top = top.parent
            if top.tag == "p":
                leave(top)
        if tag in SELF_NESTING_END:
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if any(opened[t] for t in same):
                top = cur
                while top is not root and top.tag not in same and top.tag not in SELF_NESTING_END[tag]:
                    top = top.parent
                if top.tag in same:
                    leave(top)
        attrs = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        mark = "." + ".".join(sorted(_DIGITS.sub("#", c) for c in attrs["class"].split())) if attrs.get("class", "").strip() else ""
        node = Node(tag, cur, tag + mark, _furniture(tag, attrs))
        cur.kids.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if tag not in ("script", "style"):
                node.kids.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not _CLOSED.search(m[3] or ""):
            cur = node
            opened[tag] += 1
    return root


def _headings(node: Node) -> list[Node]:
    """The headings of an article's own header, in order: they belong to the article."""
    found, stack = [], [node]
    while stack:
        cur = stack.pop()
        if cur.tag in ("h1", "h2", "h3"):
            found.append(cur)
        else:
            stack.extend(k for k in reversed(cur.kids) if isinstance(k, Node))
    return found


def blocks_of(node: Node) -> list[str]:
    """The texts of a container's blocks, furniture left out, in page order."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node, int, bool]] = [(node, 0, node.tag in BLOCK)]
    while stack:
        cur, i, block = stack.pop()
        if i == 0 and block:
            close()
        if i < len(cur.kids):
            stack.append((cur, i + 1, block))
            k = cur.kids[i]
            if isinstance(k, str):
                run.append(k)
            elif k.tag in ("br", "hr", "img", "wbr"):
                if k.tag == "hr":
                    close()
                elif k.tag == "br":
                    run.append(" ")
            elif not k.drop:
                stack.append((k, 0, k.tag in BLOCK))
            elif k.tag == "header" and cur.tag in ("article", "main"):
                close()
                stack.extend((h, 0, True) for h in reversed(_headings(k)))
            elif k.tag in BLOCK:
                close()
        elif block:
            close()
    close()
    return out


def score_containers(root: Node) -> list[tuple[str, float]]:
    """(path, score) of a page's containers: the text in blocks directly theirs or in child paragraphs, less linked
    text; article and main elements count for more. Depth-first, each path once with its total."""
    found: dict[str, float] = {}

    def text_len(node: Node, linked: bool) -> tuple[int, int]:
        total = links = 0
        stack = [(node, linked)]
        while stack:
            cur, l = stack.pop()
            for k in cur.kids:
                if isinstance(k, str):
                    n = len(k) - k.count(" ")
                    total += n
                    links += n if l else 0
                elif not k.drop and (k.tag not in CONTAINER or k is node):
                    stack.append((k, l or k.tag == "a"))
        return total, links

    names: dict[str, Node] = {}
    stack = [(root, root)]
    while stack:
        cur, up = stack.pop()  # the text of a list or table counts for what holds it
        stack.extend((k, up if k.tag in WITHIN and cur.tag in CONTAINER else k) for k in cur.kids if isinstance(k, Node) and not k.drop)
        if cur.tag in CONTAINER:
            total, links = text_len(cur, False)
            gain = (total - 2 * links) * (3.0 if up.tag in ("article", "main") else 1.0)
            if gain > 0:
                names.setdefault(up.path, up)
                found[up.path] = found.get(up.path, 0.0) + gain
    # a section's text speaks for what encloses it too, but less
    for p, s in sorted(found.items()):
        up = names[p].parent
        if up is not None and up.tag in ("article", "main"):
            found[up.path] = found.get(up.path, 0.0) + s
    return sorted(found.items())


def find(root: Node, path: str) -> list[Node]:
    """The outermost kept containers at a path, in page order."""
    out, stack = [], [root]
    while stack:
        cur = stack.pop()
        if cur is not root and path.endswith(cur.label) and cur.path == path:
            out.append(cur)
        else:
            stack.extend(k for k in reversed(cur.kids) if isinstance(k, Node) and not k.drop)
    return out


def extract(page: str, winner: str | None) -> str:
    """The main text of a page: from its host's winning path, else from its own best container, else from the page."""
    root = parse(page)
    for path in (winner, max(score_containers(root), key=lambda x: (x[1], x[0]), default=(None,))[0] if winner is None or not find(root, winner) else None):
        if path:
            got = [b for n in find(root, path) for b in blocks_of(n)]
            if got:
                return "\n".join(got)
    return "\n".join(blocks_of(root))


def host_column(url):
    """The lower-case host of an address; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, score, pages``: what the pages of each host vote for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], list] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                votes = score_containers(parse(page.as_py()))
                all_ = sum(s for _, s in votes)
                for p, s in votes:
                    v = sums.setdefault((host, p), [0.0, 0])
                    v[0] += s / all_  # a page has one vote to share
                    v[1] += 1
            k = sorted(sums)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in k], pa.string()), pa.array([p for _, p in k], pa.string()), pa.array([round(sums[x][0] * 1e6) for x in k], pa.int64()), pa.array([sums[x][1] for x in k], pa.int64())], ["host", "path", "score", "pages"])

    src = pages.select(host_column(F.col(url_col)).alias("host"), text_or_empty(F.col(html_col)).alias("html"))
    return src.mapInArrow(run, "host string, path string, score bigint, pages bigint").groupBy("host", "path").agg(F.sum("score").alias("score"), F.sum("pages").alias("pages"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """``host, winner``: each host's path with the highest score; ties go to the first in order of the path."""
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), "path"))["path"].alias("winner"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    A null page is empty: text '' and 0 characters. A null or odd address belongs to the host ''. Repeated rows come
    back as often as they are there; an empty table gives an empty result.
    """
    winners = bounded_broadcast(written(winning_paths(host_votes(pages, url_col, html_col)), "paths"))
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(F.col(html_col)).alias("html"), host_column(F.col(url_col)).alias("host"))
    joined = src.join(winners, "host", "left").select("page_id", "url", "html", "winner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), w) for p, w in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = src.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
