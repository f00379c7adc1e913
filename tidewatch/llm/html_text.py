"""Main text of web pages by a site style tree.

The pages of one host are merged into one tree of styles: a node is a path of elements with their classes, from the
root on, and a leaf holds the block texts that stand directly in such a path. Everything on a page takes part, menus and
adverts too. Two importances decide, both from the tree:

* content: a text on one page tells something, a text on all pages tells nothing. Of a leaf on m pages, a text on n
  of them has the entropy log(n) / log(m); the importance of the leaf is one minus the mean entropy of its texts.
* presentation: the information of a node is the number of words below it, each counted by one minus the entropy of its
  text. Its importance is its information as a share of the richest node beside it, both weighed by what the element says of
  itself: 3 for ``article`` and ``main``, 1 for others, ``FAINT`` for headers, forms, and classes, ids and roles that
  stand for menus, notices, adverts or comments, 0 for elements that never hold main text (``nav``, ``footer``, ``aside``
  and the like). Paragraphs, headings, lists and tables, and plain elements within ``article`` or ``main``, are text of
  the node that they stand in and are not held against those beside them.

Leaves and nodes of low importance go, on every page of the host. A faint element with nearly all information of its
host stays, and so does plain text beside an article.

Defined results: null and empty html give an empty text; a row that repeats a page is a page of its own in the
result, but pages with the same text in their richest leaf are one page of the tree; content entropy counts from
``LEAST`` pages on, ties (a share just at the threshold) stay; pages without url are one host; a block ends at
the tags of block elements, white space inside it becomes one space, a line break in it is white space; unclosed
and cut-off tags are taken as a browser would, roughly; very long pages are read whole. No page, no row.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.scratch import cut

#: Leaves below this content importance are noise. At least ``LEAST`` pages must have it: entropy says nothing of fewer.
IMPORTANCE, LEAST = 0.2, 4
#: Nodes below this presentation importance are noise, and the weight of an element that says that it is none of the article.
SHARE, FAINT = 0.02, 0.02
#: Up to so many low nodes and hosts are broadcast (some 16 MB); beyond that the join shuffles.
BROADCAST_ROWS = 500_000

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$))", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Elements that are text of the node they stand in.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption details summary address center html body".split())
#: Elements that hold no main text, and those that are faint by themselves.
_NEVER = frozenset("head nav footer aside menu dialog button select option datalist textarea title template noscript object svg math".split())
_FAINT_TAGS = frozenset(("form", "fieldset"))
_FAINT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class or id that stand for something else than the article.
_FAINT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "comment comments reply replies respond disqus widget widgets toolbar pagination pager login search copyright disclaimer skip".split()
)
_MAIN = frozenset(("article", "main"))


def _weight(tag: str, values: dict[str, str], in_main: bool) -> float:
    """What an element says of itself; -1 if it is text of the node that it stands in."""
    if tag in _NEVER or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", ""):
        return 0.0
    words = set(re.split(r"[^a-z0-9]+", f"{values.get('class', '')} {values.get('id', '')}")) if values else set()
    faint = tag in _FAINT_TAGS or tag == "header" and not in_main or values.get("role") in _FAINT_ROLES or bool(words & (_FAINT_WORDS - {"header"} if in_main else _FAINT_WORDS))
    if faint and tag not in ("html", "body"):
        return FAINT
    if tag in _MAIN:
        return 3.0
    return -1.0 if tag in _TEXT or in_main else 1.0


def blocks(source: str) -> Iterator[tuple[tuple[tuple[str, float], ...], str]]:
    """(path of nodes, text) of each block; a node is an element with its classes, and its weight."""
    stack: list[tuple[str, tuple[str, float], bool]] = []  # tag, node, inside article or main
    held: list[str] = []
    at, end = 0, len(source)

    def flush() -> Iterator[tuple[tuple[tuple[str, float], ...], str]]:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            yield tuple(s[1] for s in stack if s[0] not in _INLINE), text

    while at < end:
        found = _TAG.search(source, at)
        held.append(source[at : found.start() if found else end])
        if not found:
            break
        at = found.end()
        tag = (found[3] or "").lower()
        if not tag:
            continue
        inline = tag in _INLINE
        if tag == "br":
            held.append(" ")
        if not inline:
            yield from flush()
        if found[2]:
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in _VOID:
            continue
        if not inline:
            if any(s[0] == "p" for s in stack):
                k = max(i for i, s in enumerate(stack) if s[0] == "p")
                if all(s[0] in _INLINE for s in stack[k + 1 :]):
                    del stack[k:]
            if tag in _CLOSES:
                same, stop = _CLOSES[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in stop:
                        break
                    if stack[k][0] in same.split():
                        del stack[k:]
                        break
        elif tag == "a" and any(s[0] == "a" for s in stack):
            k = max(i for i, s in enumerate(stack) if s[0] == "a")
            if all(s[0] in _INLINE for s in stack[k:]):
                del stack[k]
        values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(found[4])} if found[4] else {}
        in_main = bool(stack) and stack[-1][2]
        if tag in _RAW:
            close = re.compile(f"</{tag}\\s*>", re.I).search(source, at)
            if close or tag in ("script", "style"):
                at = close.end() if close else end
            continue
        style = tag + ("." + ".".join(sorted(set(values["class"].split()))) if values.get("class") else "")
        stack.append((tag, (style, _weight(tag, values, in_main)), in_main or tag in _MAIN))
    yield from flush()


def _number(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def _host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


@functools.lru_cache(50_000)
def _numbers(path: tuple[tuple[str, float], ...]) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The nodes of a path and, at the end, its leaf; and their weights."""
    labels = [f"{style} {weight}" for style, weight in path]
    return (*(_number(*labels[:k]) for k in range(1, len(labels) + 1)), _number(*labels, "text")), (*(w for _, w in path), -1.0)


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block text of a page (once a page), with its nodes, its words and a hash of the page's richest leaf.

    A row without text for each leaf and node that the page has.
    """
    schema = pa.schema([("host", pa.string()), ("node", pa.list_(pa.int64())), ("weight", pa.list_(pa.float32())), ("text", pa.int64()), ("words", pa.int32()), ("page", pa.int64())])
    for batch in batches:
        columns: list[list] = [[] for _ in schema]
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            own = dict.fromkeys(blocks(source or ""))
            leaves: dict[tuple, list[str]] = {}
            for path, text in own:
                leaves.setdefault(path, []).append(text)
            page = _number(*max(leaves.values(), key=lambda x: sum(map(len, x)), default=[]))
            for path, text in own:
                for column, x in zip(columns, (host, *_numbers(path), _number(text), text.count(" ") + 1, page), strict=True):
                    column.append(x)
            for node in {n for path in leaves for n in _numbers(path)[0]}:
                for column, x in zip(columns, (host, [node], None, None, None, page), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for source, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True):
            low = set(low or ())
            out.append("\n".join(text for path, text in blocks(source or "") if low.isdisjoint(_numbers(path)[0])))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def style_tree(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """host, node, parent, weight, pages, content, presentation: the nodes of each host's tree with their importances.

    ``content`` is null for nodes without texts of their own, ``presentation`` for those that are text of their parent.
    """
    rows = pages.select(_host().alias("host"), "html").mapInArrow(_branches, "host string, node array<long>, weight array<float>, text long, words int, page long")
    texts = rows.distinct().groupBy("host", "node", "weight", "text", "words").agg(F.count(F.lit(1)).alias("n"))
    is_text = F.col("text").isNotNull()
    own = lambda x: F.sum(F.when(is_text, x))
    n, spread = F.col("n"), F.col("n") * F.log("n")
    leaves = texts.groupBy("host", "node", "weight").agg(own(n).alias("n"), own(spread).alias("spread"), own(n * F.col("words")).alias("words"), own(spread * F.col("words")).alias("common"), F.max(F.when(~is_text, n)).alias("pages"))
    each = leaves.select("host", F.posexplode("node").alias("at", "id"), "node", "weight", "n", "spread", "words", "common", "pages")
    last = F.col("at") == F.size("node") - 1
    parent = F.when(F.col("n").isNotNull(), F.when(F.col("at") > 0, F.get("node", F.col("at") - 1)).otherwise(0))
    each = each.select("host", F.col("id").alias("node"), parent.alias("parent"), F.get("weight", F.col("at")).alias("weight"), F.when(last, F.col("n")).alias("n"), F.when(last, F.col("spread")).alias("spread"), "words", "common", "pages")
    nodes = each.groupBy("host", "node").agg(F.max("parent").alias("parent"), F.max("weight").alias("weight"), *[F.sum(c).alias(c) for c in ("n", "spread", "words", "common")], F.max("pages").alias("pages"))
    known = F.col("pages") >= least
    base = F.log(F.greatest(F.col("pages"), F.lit(2)))
    content = 1 - F.when(known, F.col("spread") / (F.col("n") * base)).otherwise(0.0)
    leaf = F.col("n").isNotNull() & (F.col("weight") == -1)
    information = F.when(known, F.greatest(F.col("words") - F.col("common") / base, F.lit(0.0))).otherwise(F.col("words"))
    nodes = nodes.select("host", "node", "parent", "weight", "pages", F.when(leaf, content).alias("content"), (information * F.when(F.col("weight") < 0, 1.0).otherwise(F.col("weight"))).alias("mass"))
    nodes = cut(nodes, "style-tree")
    richest = nodes.groupBy("host", "parent").agg(F.max("mass").alias("most"))
    share = F.when(F.col("weight") >= 0, F.when(F.col("mass") > 0, F.col("mass") / F.col("most")).otherwise(0.0))
    return nodes.join(richest, ["host", "parent"]).select("host", "node", "parent", "weight", "pages", "content", share.alias("presentation"))


def low_nodes(pages: DataFrame, importance: float = IMPORTANCE, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """host, low: the nodes of each host's style tree that are noise."""
    low = style_tree(pages, least).where((F.col("content") < importance) | (F.col("presentation") < share))
    return low.groupBy("host").agg(F.collect_set("node").alias("low"))


def main_text(pages: DataFrame, importance: float = IMPORTANCE, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages(page_id, url, html)``. With thresholds of 0 nothing is noise."""
    pages = pages.select("page_id", "url", "html")
    low = cut(low_nodes(pages, importance, share), "low-nodes")
    size = low.agg(F.coalesce(F.sum(F.size("low") + 1), F.lit(0))).first()[0]
    with_low = pages.withColumn("host", _host()).join(F.broadcast(low) if size <= BROADCAST_ROWS else low, "host", "left")
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string"
    return with_low.select("page_id", "url", "html", "low").mapInArrow(_extract, schema).withColumn("n_chars", F.length("text").cast("long"))
