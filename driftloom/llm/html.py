"""Operator 7: main text of web pages by site template removal.

1. Every page becomes a tree (tag soup tolerated: implied end tags, unclosed
   inline tags, raw script and style).
2. Each element subtree has a hash over tag, attributes and content, apart for
   those outside and inside article and main; inside, blocks count that stand for
   themselves (not inline elements, paragraphs, headings, list items, cells).  An element that
   holds an article or main has none.  Spark counts the different pages of a host on
   which a hash occurs; those on at least ``LEAST`` pages and ``SHARE`` of the
   host's are its template.  As they are a fixed share of the pages, a host has at
   most 1 / SHARE times its mean number of subtrees a page, however many it has.
3. The template's subtrees are deleted, and so are elements that say what they
   are (nav, aside, form, class "ad", ...), which covers hosts with few pages.
4. What remains of the article elements (or main, or body, the first that there
   is) is read block by block.

Pages are different outside the article if their trees are, and inside it if the
least hash of the article's three-word runs is.  So copies and near copies of an
article are one page, and content, while a box that comes with articles of other
text is template.

Defined results: null or empty html gives an empty text; a null or odd url has
the empty host, whose pages count together; repeated pages count once and come
out each; extra columns of the table are left aside; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize

SHARE, LEAST = 0.1, 5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe object svg canvas title".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the left closes an open one of the right, up to the nearest element that holds it.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
#: Blocks that may be template inside an article: boxes, as a bare paragraph, heading, item or cell is running text.
_BOXES = _BLOCK - frozenset("caption dd dt fieldset figcaption h1 h2 h3 h4 h5 h6 hr html body legend li p pre blockquote summary tbody td tfoot th thead tr".split())
_INSIDE = 0x2545F4914F6CDD1D  # sets hashes inside an article apart
_DROP_TAGS = frozenset("head nav aside form button select input textarea script style noscript template iframe object svg canvas title dialog".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer comment comments disqus respond replies share sharing social related recommended recommendations pagination pager toolbar masthead skip banner".split()
)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class Node:
    __slots__ = ("attrs", "children", "hash", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children, self.hash = tag, attrs, [], 0


def parse(html: str) -> Node:
    """The element tree of a page; text is kept as strings, undecoded."""
    root = Node("#root")
    stack = [root]
    at = 0
    while m := _TOKEN.match(html, at):
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0][:2] not in ("<!", "<?") or m[0] == "<":
                stack[-1].children.append(m[0])
            continue
        tag, attrs = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in _BLOCK and stack[k].tag in _BLOCK:  # an inline end tag doesn't close blocks
                    break
            continue
        if tag in _BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _HOLDS[tag]:
                    break
                if stack[k].tag in _CLOSES[tag]:
                    del stack[k:]
                    break
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            node.children.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
        elif tag not in _VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def _all(root: Node) -> list[Node]:
    """The elements, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def hash_subtrees(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        h = hashlib.blake2b(f"{n.tag} {n.attrs.strip()}".encode("utf-8", "replace"), digest_size=8)
        for c in n.children:
            h.update(c.hash.to_bytes(8, "little", signed=True) if isinstance(c, Node) else " ".join(c.split()).encode("utf-8", "replace"))
        n.hash = int.from_bytes(h.digest(), "little", signed=True)


def _says_it(node: Node, in_article: bool) -> bool:
    """Whether tag, role, class or id name something that isn't the article."""
    if node.tag in _DROP_TAGS or node.tag in ("header", "footer") and not in_article or node.tag == "footer":
        return True
    if not node.attrs.strip():
        return False
    for name, value in _ATTR.findall(node.attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in _DROP_ROLES:
            return True
        if name in ("class", "id"):
            words = set(re.split(r"[^a-z0-9]+", value))
            if words & _DROP_WORDS and node.tag not in ("html", "body", "article", "main") or words & {"comment", "comments"}:
                return True
            if not in_article and words & {"header", "top"} and node.tag in ("div", "section"):
                return True
    return False


def _roots(root: Node, template: frozenset[int]) -> list[Node]:
    """The outermost article elements that stay; else main elements; else the whole."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        n, inside_main = todo.pop()
        if n.tag == "article" and not _says_it(n, False):
            found["article"].append(n)
            continue
        if n.tag == "main" and not inside_main:
            found["main"].append(n)
        elif n is not root and (n.hash in template or _says_it(n, False)):
            continue
        todo += [(c, inside_main or n.tag == "main") for c in reversed(n.children) if isinstance(c, Node)]
    return found["article"] or found["main"] or [root]


def _recurs(n: Node, inside: bool, template: frozenset[int]) -> bool:
    return n.tag in _BOXES and n.hash ^ _INSIDE in template if inside else n.hash in template


def _read(tops: list[Node], template: frozenset[int]) -> list[str]:
    """The blocks below ``tops`` in page order, without what goes."""
    blocks: list[str] = []
    text: list[str] = []

    def flush() -> None:
        line = " ".join(unescape("".join(text)).split())
        text.clear()
        if line:
            blocks.append(line)

    todo: list[tuple[object, bool]] = [(n, n.tag in ("article", "main")) for n in reversed(tops)]
    while todo:
        n, inside = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            text.append(n)
        elif n.tag == "br":
            text.append(" ")
        elif n not in tops and (_recurs(n, inside, template) or _says_it(n, inside)):
            text.append(" ")
        else:
            if n.tag in _BLOCK:
                flush()
                todo.append((None, inside))
            todo += [(c, inside) for c in reversed(n.children)]
    flush()
    return blocks


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text of one page, given the hashes of its host's template."""
    if not html:
        return ""
    root = parse(html)
    hash_subtrees(_all(root))
    return "\n\n".join(_read(_roots(root, template), template))


def _least_run(tops: list[Node]) -> int:
    """The least hash of the three-word runs of the text below ``tops``."""
    words = " ".join(_read(tops, frozenset())).split()
    return min((crc32(" ".join(words[k : k + 3]).encode("utf-8", "replace")) for k in range(max(1, len(words) - 2))), default=0)


def page_hashes(html: str | None) -> tuple[int, int, list[int], list[int]]:
    """What tells the page from others outside and inside articles, and the hashes of
    the distinct subtrees with content there."""
    if not html:
        return 0, 0, [], []
    root = parse(html)
    nodes = _all(root)
    hash_subtrees(nodes)
    holds: set[int] = set()
    for n in reversed(nodes):
        if any(isinstance(c, Node) and (c.tag in ("article", "main") or id(c) in holds) for c in n.children):
            holds.add(id(n))
    out, within = set(), set()
    todo = [(c, False) for c in root.children if isinstance(c, Node)]
    while todo:
        n, inside = todo.pop()
        if n.tag == "head":
            continue
        if n.tag in ("article", "main"):
            inside = True
        elif n.tag not in ("html", "body") and n.children and id(n) not in holds:
            if not inside:
                out.add(n.hash)
            elif n.tag in _BOXES:
                within.add(n.hash ^ _INSIDE)
        todo += [(c, inside) for c in n.children if isinstance(c, Node)]
    return root.hash, _least_run(_roots(root, frozenset())) if within else 0, sorted(out), sorted(within)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, hashes): two rows a page, of what is outside, with a null that
    stands for the page itself, and of what is inside."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            got = [page_hashes(x) for x in part.column("html").to_pylist()]
            hosts, pages = pa.concat_arrays([part.column("host")] * 2), [g[0] for g in got] + [g[1] for g in got]
            yield pa.RecordBatch.from_arrays([hosts, pa.array(pages, pa.int64()), pa.array([[None, *g[2]] for g in got] + [g[3] for g in got], pa.list_(pa.int64()))], names=["host", "page", "hashes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[tuple, frozenset[int]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            got = []
            for html, host, hashes in zip(part.column("html").to_pylist(), part.column("host").to_pylist(), part.column("hashes"), strict=True):
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = frozenset(hashes.as_py() or ())
                got.append(main_text(html, sets[host]))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, hashes): the recurring subtrees of each host that has any."""
    each = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_hashes, "host string, page long, hashes array<long>")
    counts = each.select("host", "page", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").count()
    counts = materialize(counts.filter((F.col("count") >= least) | F.col("hash").isNull()), "op7-counts")
    whole = counts.filter(F.col("hash").isNull()).select("host", F.col("count").alias("pages"))
    often = counts.filter(F.col("hash").isNotNull()).join(whole, "host").filter(F.col("count") >= F.col("pages") * F.lit(share))
    return materialize(often.groupBy("host").agg(F.collect_list("hash").alias("hashes")), "op7-templates")


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(templates(pages, share, least), "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extract": op7_html_extract}
SQL: dict[str, str] = {}
