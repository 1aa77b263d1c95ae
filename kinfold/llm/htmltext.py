"""Main text of web pages: page structure plus removal of site templates.

A page's text is that of its article, or of its body if it names none, without what it marks as navigation, header,
footer, sidebar, notice, advert, form, script, style or comments. The block elements of that region are hashed as
subtrees; Spark counts on how many different articles of its host a subtree stands, and those that recur are deleted.
Two pages count as one article if the longest stretch of text outside the subtree is equal, and what holds half of a
text or more is no template: copies of an article, near ones too, keep what they share.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, sliced

PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
#: Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rb rt rp".split())
DROPPED = frozenset("nav header footer aside form script style noscript template head title button select option textarea input iframe object embed canvas svg math menu dialog audio video map".split())
UNSEEN = frozenset("script style template noscript".split())  # where they stand no word ends
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class or id that mark what isn't article text.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist discussion disqus replies reply share sharing social related recommended pagination pager toolbar widget skip search".split()
)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
WHOLE = frozenset("#root html body article main".split())  # never a template


class Node:
    """An element: its tag, marks from its attributes, and children (nodes or texts)."""

    __slots__ = ("tag", "dropped", "kids")

    def __init__(self, tag: str, dropped: bool = False):
        self.tag, self.dropped, self.kids = tag, dropped, []


def _marked(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and any(w in DROPPED_WORDS for part in value.split() for w in [part.lower(), *SPLIT.split(part.lower())]):
            return True
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if name == "aria-hidden" and value.lower() == "true":
            return True
    return bool(re.search(r"(^|\s)hidden(\s|=|/|$)", attributes)) and tag not in VOID


def parse(page: str) -> Node:
    """A forgiving tree of the page: unknown ends are skipped, open elements end with their parent."""
    root = Node("#root")
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = PIECE.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(Node("br"))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
                if tag == "p" and stack[k].tag in ("article", "body", "main", "td", "section"):
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("li",) if tag == "li" else ("dt", "dd") if tag in ("dt", "dd") else ("tr", "td", "th") if tag == "tr" else ("td", "th") if tag in ("td", "th") else ("option",)
            ends = ("ul", "ol", "dl", "table", "select", "tbody", "thead", "tfoot")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in same:
                    del stack[k:]
                    break
                if stack[k].tag in ends:
                    break
        node = Node(tag, _marked(tag, m[3]))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def subtree_hashes(tops: list[Node]) -> dict[int, int]:
    """Hash of each element below ``tops`` with text, by id(node): from the tag and the hashes and texts of its children;
    marked elements don't count."""
    found: dict[int, int] = {}
    order: list[Node] = list(tops)
    for node in order:
        order += [k for k in node.kids if isinstance(k, Node) and not k.dropped]
    for node in reversed(order):
        parts = [node.tag]
        for k in node.kids:
            if isinstance(k, Node):
                if id(k) in found:
                    parts.append(f"<{found[id(k)]:x}>")
            elif text := " ".join(k.split()):
                parts.append(text)
        if len(parts) > 1:
            found[id(node)] = xxhash.xxh3_64_intdigest("\x00".join(parts)) >> 1
    return found


def region(root: Node) -> list[Node]:
    """Where the main text is: the outermost article or main elements that aren't marked or inside something marked; if
    there is none, the whole page."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.dropped:
            continue
        if node.tag in ("article", "main"):
            out.append(node)
            continue
        stack += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out or [root]


def candidates(root: Node) -> tuple[list[int], list[int], int]:
    """Subtrees that may be template, the unmarked block elements of the region that hold less text than stands outside
    them: their hashes, and for each the hash of the longest stretch of text outside it; and that of the longest of all."""
    tops = region(root)
    hashes = subtree_hashes(tops)
    runs: list[tuple[int, int]] = []  # length and hash of each stretch between block borders
    open_text: list[str] = []

    def border() -> None:
        if text := " ".join("".join(open_text).split()):
            runs.append((len(text), xxhash.xxh3_64_intdigest(text) >> 1))
        open_text.clear()

    spans: list[tuple[int, int, int]] = []
    stack: list = [(n, None) for n in reversed(tops)]
    while stack:
        node, start = stack.pop()
        if isinstance(node, str):
            open_text.append(node)
        elif node.dropped:
            if node.tag not in UNSEEN:
                border()
        elif start is not None:
            border()
            if len(runs) > start and node.tag not in WHOLE and id(node) in hashes:
                spans.append((hashes[id(node)], start, len(runs)))
        else:
            if node.tag not in INLINE:
                border()
                stack.append((node, len(runs)))
            stack += [(k, None) for k in reversed(node.kids)]
    border()
    none = (0, 0)
    before, behind = [none], [none]  # the longest stretch before each one, and from each one on
    for r in runs:
        before.append(max(before[-1], r))
    for r in reversed(runs):
        behind.append(max(behind[-1], r))
    behind.reverse()
    size = list(accumulate((n for n, _ in runs), initial=0))
    spans = [(h, a, b) for h, a, b in spans if 2 * (size[b] - size[a]) < size[-1]]
    return [h for h, _, _ in spans], [max(before[a], behind[b])[1] for _, a, b in spans], before[-1][1]


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of the page's region without marked elements and ``template`` subtrees."""
    root = parse(page or "")
    tops = region(root)
    hashes = subtree_hashes(tops) if template else {}
    out: list[str] = []
    stack: list = list(reversed(tops))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        if node.dropped or hashes.get(id(node)) in template:
            out.append("" if node.tag in UNSEEN else " ")
            continue
        if node.tag in INLINE:
            stack += reversed(node.kids)
        else:
            out.append(" ")
            stack.append(" ")
            stack += reversed(node.kids)
    return " ".join(html.unescape("".join(out)).split())


def host_of(url) -> F.Column:
    """The host of a URL in lower case; without one, the empty string."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_pages(pages: DataFrame, min_pages: int = 5, min_share: float = 0.2) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html): page_id, url, text and n_chars.

    A subtree is template if at least ``min_pages`` different articles of a host, and ``min_share`` of them, stand on
    pages that hold it. A null html is empty and gives an empty text; null urls share an unnamed host; repeated rows stay,
    and count as one article; an empty table gives no rows; extra columns are ignored."""

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            found = [candidates(parse(x.as_py() or "")) for x in part.column(1)]
            pairs = [[{"hash": h, "rest": r} for h, r in {*zip(f[0], f[1])}] for f in found]
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("rest", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pairs, kind), pa.array([f[2] for f in found], pa.int64())], ["host", "found", "longest"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url").cast("string")).alias("host"))
    seen = materialize(source.select("host", "html").mapInArrow(hashed, "host string, found array<struct<hash:long,rest:long>>, longest long"))
    each = seen.select("host", F.explode("found").alias("x")).select("host", "x.hash", "x.rest").distinct()
    many = each.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    hosts = seen.select("host", "longest").distinct().groupBy("host").agg(F.count("*").alias("articles"))
    common = many.join(hosts, "host").where(F.col("n") >= min_share * F.col("articles"))
    # a host has no more of these than its pages have elements on average, divided by min_share
    per_host = materialize(common.groupBy("host").agg(F.collect_list("hash").alias("template")))
    size = per_host.agg(F.coalesce(F.sum(F.size("template")), F.lit(0)), F.count("*")).first()
    listed = F.broadcast(per_host) if size[0] + size[1] <= 200_000 else per_host
    rows = source.join(listed, "host", "left").select("page_id", "url", "html", "template")

    def texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            got = [main_text(x.as_py(), frozenset(t.as_py() or ())) for x, t in zip(part.column(2), part.column(3))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
