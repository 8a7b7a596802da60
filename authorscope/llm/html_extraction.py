"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of element labels (tag and class), with the texts seen
at it and the sequences of child labels seen under it. A node whose texts differ from page to page is important, one
that repeats is not: its importance is the normalized entropy of its texts, with a share of the entropy of its parent's
styles. Hosts with few pages are shrunk toward all hosts for the same path: the
mean of their entropies, or the entropy of their texts together where that is less. A text counts once for each
distinct page it is on; a node met with one text on one page says nothing (0.5).

Entropy can't tell an article from reader comments, adverts or a sidebar that differ from page to page. What HTML itself
says of a branch therefore shifts its importance: so much that entropy can't make up for it for elements such as
navigation and footers and for sections named as comments, adverts and the like, less for paragraphs so named, and the
other way for articles. Page, body, article and main never lose by it, nor does a form or a named section that holds
most of a page's text where hardly any is left outside of such sections: it is the frame of the page, not a part of it.
Blocks below the threshold are removed from each page of the host, and the others joined.

Texts are counted by (host, path, text hash), so a host with a third of all pages is spread by its texts; a host's
removed paths, as many as its templates have, are broadcast with the others below ``BROADCAST_ROWS`` rows. Pages are
parsed twice and never moved.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read, without

#: Share of a node's own texts in its importance, the rest is its parent's styles.
CONTENT_SHARE = 0.9
#: Observations at which a host's own entropy counts as much as the mean of all hosts.
SHRINKAGE = 50.0
THRESHOLD = 0.5
#: Importance of a node seen once.
UNKNOWN = 0.5
#: Shift of importance by kind: an element or a named section that is no main text, a paragraph so named, none, an article.
HINTS = {-2: -0.75, -1: -0.35, 0: 0.0, 1: 0.45}
BROADCAST_ROWS = 200_000
OWN = ("text", "n_chars")

# Fixed values of HTML and of common class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NOISE_TAGS = frozenset("head nav header footer aside form menu button select option dialog svg canvas object audio video map label fieldset".split())
NOISE_NAMES = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar "
        "footer header masthead cookie cookies consent notice notices alert popup modal newsletter subscribe subscription comment comments reply replies "
        "respond disqus share sharing social related recommended login signup search widget widgets toolbar pagination pager skip complementary contentinfo dialog"
    ).split()
)
CONTENT_TAGS = frozenset(("article", "main"))
#: Elements that hold a page, whatever their names.
FRAMES = CONTENT_TAGS | {"html", "body"}
#: Noise elements that may wrap a whole page.
WRAPPERS = frozenset(("form", "fieldset"))
#: Elements of running text, whose names say less than those of sections.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption".split())
#: A frame leaves less than one part in so many of the page's text outside.
FRAME_REST = 10
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"?|'[^']*+'?|[^'\">])*+)>?",
    re.DOTALL,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


class Element:
    __slots__ = ("tag", "label", "path", "parent", "kind", "wrapper", "number", "chars", "blocks", "children")

    def __init__(self, tag: str, label: str, parent: Element | None, kind: int, wrapper: bool = False):
        self.tag, self.label, self.parent, self.wrapper = tag, label, parent, wrapper
        # a hash of the labels down to here: as long for a deep element as for any
        self.path = xxhash.xxh3_128_hexdigest(f"{parent.path}/{label}") if parent else label
        # the strongest hint against a branch holds in all of it; else that of an article
        self.kind = min(kind, parent.kind) if parent and min(kind, parent.kind) < 0 else max(kind, parent.kind if parent else 0)
        self.number, self.chars, self.blocks = -1, 0, 0
        self.children: list[str] = []


def opened(tag: str, attributes: str, parent: Element, free: bool = False) -> Element:
    """The element; a ``free`` one carries no hint against it."""
    names = [w for m in NAMES.finditer(attributes) for w in re.split(r"[\s_\-]+", (m[1] or m[2] or m[3] or "").lower())] if attributes else []
    names = [w.strip("0123456789") for w in names]
    kind = int(tag in CONTENT_TAGS or (tag not in INLINE and "main" in names))
    wrapper = False
    if tag not in FRAMES and not free:
        named = not NOISE_NAMES.isdisjoint(names)
        wrapper = tag in WRAPPERS or (named and tag not in NOISE_TAGS)
        if tag in NOISE_TAGS or named:
            kind = -1 if tag in PARAGRAPHS or tag in INLINE else -2
    label = ".".join([tag, *sorted({w for w in names if w})])
    return Element(tag, label, parent, kind, wrapper)


def parsed(source: str) -> tuple[list[tuple[Element, int, str]], list[Element]]:
    """Blocks of text in page order as (element, kind, text), and all elements that are no inline ones."""
    free: set[int] = set()
    while True:
        blocks, elements = walked(source, free)
        for element in reversed(elements[1:]):
            element.parent.chars += element.chars
            element.parent.blocks += element.blocks
        total, plain = elements[0].chars, sum(len(text) for _, kind, text in blocks if kind >= 0)
        more = {e.number for e in elements if e.wrapper and e.blocks > 1 and 2 * e.chars > total and FRAME_REST * plain < total}
        if not more:
            return blocks, elements
        free |= more


def walked(source: str, free: set[int]) -> tuple[list[tuple[Element, int, str]], list[Element]]:
    """As :func:`parsed`; the elements numbered in ``free`` carry no hint against them."""
    root = Element("", "", None, 0)
    stack, inline, elements, blocks, buffer = [root], [], [root], [], []
    opened_tags, inline_tags = Counter(), Counter()

    def close_from(i: int) -> None:
        opened_tags.subtract(e.tag for e in stack[i:])
        del stack[i:]
        inline.clear()
        inline_tags.clear()

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                owner = inline[-1] if inline and inline[-1].kind < 0 else stack[-1]
                blocks.append((owner, owner.kind, text))
                stack[-1].chars += len(text)
                stack[-1].blocks += 1
            buffer.clear()

    place, end = 0, len(source)
    while place < end:
        at = source.find("<", place)
        if at < 0:
            at = end
        if at > place:
            buffer.append(html.unescape(source[place:at]))
            place = at
            continue
        token = TOKEN.match(source, at)
        if not token:  # a lone "<" is text
            buffer.append("<")
            place = at + 1
            continue
        place = token.end()
        closing, tag = token[1], token[2]
        if closing:
            closing = closing.lower()
            if closing in INLINE:
                if inline_tags[closing] > 0:
                    i = next(i for i in range(len(inline) - 1, -1, -1) if inline[i].tag == closing)
                    if inline[i].kind < 0:
                        flush()
                    inline_tags.subtract(e.tag for e in inline[i:])
                    del inline[i:]
                continue
            flush()
            if opened_tags[closing] > 0:
                close_from(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == closing))
        elif tag:
            tag = tag.lower()
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, place)
                place = stop.end() if stop else end
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag in INLINE:
                element = opened(tag, token[3], inline[-1] if inline else stack[-1])
                if element.kind < 0 and stack[-1].kind >= 0 and not (inline and inline[-1].kind < 0):
                    flush()
                inline.append(element)
                inline_tags[tag] += 1
                continue
            flush()
            closes = CLOSES.get(tag) or (("p",) if tag not in VOID else ())
            if any(opened_tags[c] > 0 for c in closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        close_from(i)
                        break
                    if stack[i].tag in ("ul", "ol", "dl", "table", "div", "article", "section", "td") and stack[i].tag != tag:
                        break
            if tag in VOID:
                continue
            element = opened(tag, token[3], stack[-1], len(elements) in free)
            element.number = len(elements)
            stack[-1].children.append(element.label)
            stack.append(element)
            opened_tags[tag] += 1
            elements.append(element)
    flush()
    return blocks, elements


NODES = "host string, path string, parent string, kind int, sort string, seen bigint, share double"


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, html, share): a row for each text and each style met in a page's tree, once a page."""
    names = ["host", "path", "parent", "kind", "sort", "seen", "share"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.float64()]
    for batch in batches:
        rows: list[tuple] = []
        for host, page, share in zip(*batch.columns, strict=True):
            host, share, (blocks, elements) = host.as_py(), share.as_py(), parsed(page.as_py() or "")
            met: dict[tuple, int] = {}
            for element, kind, text in blocks:
                node = (element.path, element.parent.path if element.parent else "", "text", hashed(text))
                met[node] = min(kind, met.get(node, kind))
            for element in elements:
                if element.children:
                    node = (element.path, "", "style", hashed(" ".join(dict.fromkeys(element.children))))
                    met[node] = min(element.kind, met.get(node, element.kind))
            rows += [(host, path, parent, kind, sort, seen, share) for (path, parent, sort, seen), kind in met.items()]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def shared(pages: DataFrame) -> DataFrame:
    """(host, html, share) of pages (host, html): the n copies of a page count 1 / n each."""
    page = F.xxhash64("html")
    copies = pages.groupBy(F.col("host").alias("_copy_host"), page.alias("_copy")).agg(F.count("*").alias("_n")).where("_n > 1")
    copies = durable(copies, "page-copies")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    joined = pages.join(copies, (F.col("host") == F.col("_copy_host")) & (page == F.col("_copy")), "left")
    return joined.select("host", "html", (F.lit(1.0) / F.coalesce("_n", F.lit(1))).alias("share"))


def importances(pages: DataFrame) -> DataFrame:
    """(host, path, kind, importance) of the nodes that hold text, from pages (host, html): the importance without the
    hint, and the least kind met at the path."""
    seen = shared(pages).mapInArrow(node_rows, NODES).groupBy("host", "path", "parent", "sort", "seen")
    seen = durable(seen.agg(F.greatest(F.round(F.sum("share")), F.lit(1.0)).alias("c"), F.min("kind").alias("kind")), "seen")
    nodes = seen.groupBy("host", "path", "parent", "sort").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("c"))).alias("clogc"), F.min("kind").alias("kind")
    )
    entropy = F.when(F.col("n") > 1, (F.log("n") - F.col("clogc") / F.col("n")) / F.log("n")).otherwise(UNKNOWN)
    nodes = durable(nodes.withColumn("entropy", entropy), "nodes")
    means = nodes.groupBy("path", "sort").agg((F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("mean"))
    # hosts with few pages hardly repeat a text that many hosts share: the texts of all hosts together tell
    pooled = seen.groupBy("path", "sort", "seen").agg(F.sum("c").alias("c")).groupBy("path", "sort")
    pooled = pooled.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("c"))).alias("clogc")).select("path", "sort", entropy.alias("pooled"))
    overall = means.join(pooled, ["path", "sort"]).select("path", "sort", F.least("mean", "pooled").alias("mean"))
    shrunk = nodes.join(overall, ["path", "sort"]).withColumn(
        "shrunk", (F.col("entropy") * F.col("n") + F.col("mean") * SHRINKAGE) / (F.col("n") + SHRINKAGE)
    )
    styles = shrunk.where("sort = 'style'").select("host", F.col("path").alias("parent"), F.col("shrunk").alias("style"))
    texts = shrunk.where("sort = 'text'").select("host", "path", "parent", "kind", "shrunk")
    own = F.lit(CONTENT_SHARE) * F.col("shrunk") + F.lit(1 - CONTENT_SHARE) * F.coalesce("style", "shrunk")
    return texts.join(styles, ["host", "parent"], "left").select("host", "path", "kind", F.round(own, 9).alias("importance"))


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def main_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (html, removed paths, ...): the rest, and the text of the branches that stay."""
    for batch in batches:
        texts = []
        for page, removed in zip(batch.column(0), batch.column(1), strict=True):
            low = {r["path"]: r["importance"] for r in removed.as_py() or ()}
            blocks = parsed(page.as_py() or "")[0]
            texts.append(" ".join(text for element, kind, text in blocks if low.get(element.path, THRESHOLD + 1) + HINTS[kind] >= THRESHOLD))
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], names=[*batch.schema.names[2:], "text"])


def extract(pages: DataFrame, *, url: str = "url", source: str = "html") -> DataFrame:
    """``pages`` with text, the main text, and n_chars, its length.

    Defined cases: null or empty html gives an empty text; null urls are a host of their own; markup cut off at the end
    of a page is dropped and open elements count as closed there; equal rows get equal texts; columns named like one
    added are replaced.
    """
    rows = without(pages, *OWN)
    hosted = rows.withColumn("_host", host_of(url))
    found = importances(hosted.select(F.col("_host").alias("host"), F.col(f"`{source}`").alias("html")))
    hint = F.element_at(F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair]), F.col("kind"))
    low = durable(found.where(F.col("importance") + hint < THRESHOLD).select("host", "path", "importance"), "low")
    removed = low.groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("_removed")).withColumnRenamed("host", "_removed_host")
    if low.count() <= BROADCAST_ROWS:
        removed = F.broadcast(removed)
    joined = hosted.join(removed, F.col("_host") == F.col("_removed_host"), "left")
    joined = joined.select(F.col(f"`{source}`").alias("_html"), "_removed", *[f"`{c}`" for c in rows.columns])
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], "text string"])
    return joined.mapInArrow(main_texts, fields).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages).select("page_id", "url", *OWN)
