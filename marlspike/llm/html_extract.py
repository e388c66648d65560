"""Main text of web pages by equivalence-class template deduction.

A page's containers (body, div, nav, article ...) are tokens, named by their path of tags and classes. Over the pages of
one host each token has an occurrence vector: how often it occurs in each page. Tokens with one vector are an equivalence
class; classes with enough pages and tokens make up the host's template, nested as their paths are. Containers of the
template are its slots. The slots that hold the main text are of those whose text varies between the host's pages; article,
main and named elements only pick among them, where they hold enough of that text, and else it is all of them but those
mostly of links, with the page's own containers. On pages without a template, and pages of which the host's slots hold little, these elements decide alone.
What menus, headers, footers, sidebars, notices, adverts, forms and comments hold, by tags, roles and names, is never in
such a slot.

Vectors are never gathered: a token's vector is the sum of one hash for each page and count, which map-side aggregation
makes whatever the number of a host's pages, and equal vectors have equal values; repeated rows don't cancel. The template comes back to
the pages by a join on the host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspike.llm.common import written

#: A class of the template occurs in so many pages, and has so many tokens, at least.
LEAST_PAGES = 3
LEAST_TOKENS = 2

# Names of HTML elements, and words that sites use in class and id attributes.
CONTAINERS = frozenset("html body div section article main nav aside header footer form ul ol dl table tr td th tbody fieldset details dialog menu figure center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre hr address caption figcaption thead tfoot summary legend hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video select button head".split())
RAW_TO_END = frozenset("script style textarea title".split())
OUTSIDE = frozenset("nav aside footer form dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe signup sidebar sidebars widget widgets related recommended recommendations share sharing social "
    "comment comments reply replies respond disqus discussion nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer footers "
    "masthead topbar toolbar login search skip alert".split()
)
HEADER_WORDS = frozenset("header headers".split())
MAIN_WORDS = frozenset("article articlebody post postbody entry story maincontent".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: How surely an element is the article: an article element, a main element, or a name alone. Of these the surest counts that holds
#: at least SHARE of the text that isn't outside.
ARTICLE, MAIN, NAMED = 3, 2, 1
SHARE = 0.4

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Names end with them, so that head isn't header; other letters than A to Z have no second case here.
_BODY = re.compile(r"<body(?=[\s/>])", re.I | re.A)


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}


class Page:
    """Blocks (path, outside, article, characters in links, text) and container paths of one page, in order.

    outside is 1 in a form, from which an article inside comes back (some sites wrap all in a form), 2 in what else isn't text."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, bool, int, int, str]] = []
        self.paths: dict[int, list] = {}  # path: [parent, times, article]
        # (tag, path, outside, article, in header)
        self.stack: list[tuple[str, int, int, int, bool]] = [("", 0, 0, 0, False)]
        self.text: list[str] = []
        self.linked = 0
        self.in_link = 0
        self.heading = 0
        self._read(source)

    def _flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                _, path, outside, article, header = self.stack[-1]
                self.blocks.append((path, outside > 0 or (header and not (article and self.heading)), article, self.linked, text))
            self.text = []
        self.linked = 0

    def _open(self, tag: str, rest: str) -> None:
        top = self.stack[-1]
        path, outside, article, header = top[1:]
        found = _attributes(rest)
        if tag in CONTAINERS or found:
            named = set(_SPLIT.split(_CAMEL.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").lower()))
            wide = tag not in ("html", "body")
            hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
            role = found.get("role", "").lower()
            if tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody":
                level = ARTICLE
            elif tag == "main" or role == "main":
                level = MAIN
            else:
                level = NAMED if wide and tag in CONTAINERS and not named.isdisjoint(MAIN_WORDS) else 0
            article = max(article, level)
            if level >= MAIN and outside == 1:
                outside = 0
            if tag in OUTSIDE or (wide and (hidden or role in ROLES or not named.isdisjoint(OUTSIDE_WORDS))):
                outside = max(outside, 1 if tag == "form" and named.isdisjoint(OUTSIDE_WORDS) and not hidden else 2)
            if tag == "header" or (wide and not named.isdisjoint(HEADER_WORDS) and tag in CONTAINERS):
                header = True
        if tag in CONTAINERS:
            label = " ".join(sorted(w for w in _SPLIT.split(found.get("class", "").lower()) if w))
            parent, path = path, xxhash.xxh64_intdigest(f"{path}/{tag}.{label}") >> 1
            seen = self.paths.setdefault(path, [parent, 0, article])
            seen[1] += 1
        self.stack.append((tag, path, outside, article, header))

    def _close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def _implied(self, tag: str) -> None:
        """A block ends an open paragraph; an item ends the item before it."""
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == "p" or (name == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                del self.stack[i:]
                return
            if name in CONTAINERS:
                return

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            begin = source.find("<", at)
            if begin < 0:
                begin = n
            if begin > at:
                piece = source[at:begin]
                self.text.append(piece)
                if self.in_link:
                    self.linked += len(piece)
            if begin == n:
                break
            m = _TAG.match(source, begin) or _LOOSE.match(source, begin)
            if m is None:  # not markup
                self.text.append("<")
                at = begin + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCKS:
                    self._flush()
                if tag == "a":
                    self.in_link = max(0, self.in_link - 1)
                if tag in HEADINGS:
                    self.heading = 0
                self._close(tag)
                continue
            if tag in RAW and not m[0].endswith("/>"):
                end = _end_of(tag).search(source, at)
                if end is None:
                    # without an end, a script holds the rest of the page, a head what comes before the body, and others nothing
                    body = _BODY.search(source, at) if tag == "head" else None
                    at = body.start() if body else n if tag in RAW_TO_END else at
                else:
                    at = source.find(">", end.end()) + 1 or n
                continue
            if tag in BLOCKS:
                self._flush()
                self._implied(tag)
            elif tag == "br":
                self.text.append(" ")
            if tag in VOID or m[0].endswith("/>"):
                continue
            if tag == "a":
                self.in_link += 1
            if tag in HEADINGS:
                self.heading = 1
            self._open(tag, m[3])
        self._flush()

    def main_text(self, slots: frozenset[int], fixed: frozenset[int] = frozenset(), wide: bool = False) -> str:
        """The blocks in the host's main slots, if they hold enough of the page beside the template's fixed text; else those in the surest article; else, the containers that are neither menus nor the like nor mostly of links. wide: the slots are not picked by elements, and containers of the page alone count with them."""
        kept = [b for b in self.blocks if not b[1]]
        total = sum(len(b[4]) for b in kept)
        weight: dict[int, int] = {}
        for b in kept:
            weight[b[0]] = weight.get(b[0], 0) + len(b[4]) - 2 * b[3]
        if slots:
            inside = [b[4] for b in kept if self._in(b[0], slots) or (wide and b[0] not in fixed and weight[b[0]] > 0)]
            if inside and sum(map(len, inside)) >= SHARE * sum(len(b[4]) for b in kept if b[0] not in fixed):
                return "\n".join(inside)
        for level in (ARTICLE, MAIN, NAMED):
            inside = [b[4] for b in kept if b[2] >= level]
            if inside and sum(map(len, inside)) >= SHARE * total:
                return "\n".join(inside)
        if not weight:
            return ""
        best = frozenset(p for p, w in weight.items() if w > 0) or frozenset([max(weight, key=weight.__getitem__)])
        return "\n".join(b[4] for b in kept if self._in(b[0], best))

    def _in(self, path: int, slots: frozenset[int]) -> bool:
        while path not in slots:
            if not path:  # the page itself
                return False
            path = self.paths[path][0]
        return True

    def tokens(self) -> list[tuple]:
        """(path, parent, times, article, characters outside links, hash of the text, hash of the text at and below it) of each container, of what isn't outside."""
        chars: dict[int, int] = {}
        texts: dict[int, list[str]] = {}
        for path, outside, _, linked, text in self.blocks:
            if not outside:
                chars[path] = chars.get(path, 0) + len(text) - 2 * linked
                texts.setdefault(path, []).append(text)
        said = {p: xxhash.xxh64_intdigest("\n".join(t)) >> 1 for p, t in texts.items()}
        below: dict[int, int] = {}
        for path, code in said.items():
            while path:
                below[path] = (below.get(path, 0) + code) & (1 << 63) - 1
                path = self.paths[path][0]
        return [(p, parent, times, article, chars.get(p, 0), said.get(p, 0), below.get(p, 0)) for p, (parent, times, article) in self.paths.items()]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, page, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows += [(host, page, *t) for t in Page(source).tokens()] if source else []
        columns = list(zip(*rows, strict=True)) or [()] * 9
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "page", "path", "parent", "times", "article", "chars", "said", "below"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, slots, fixed, wide): of rows (host, page, html) the paths of each host's main slots, and of the template's containers
    whose own text is the same on all pages; wide where no element picks among the slots. Hosts without a template, or without text that varies in it, have no row."""
    tokens = pages.mapInArrow(_tokens, "host string, page long, path long, parent long, times long, article int, chars long, said long, below long")
    vectors = tokens.groupBy("host", "path").agg(
        F.count("*").alias("pages"),
        F.sum(F.xxhash64("page", "times").cast("decimal(20,0)")).alias("vector"),
        F.first("parent").alias("parent"),
        F.max("article").alias("article"),
        F.sum("chars").alias("chars"),
        (F.min("said") < F.max("said")).alias("varies"),
        (F.min("below") < F.max("below")).alias("changes"),
    )
    vectors = written(vectors, "html-vectors", few=True)  # a row for each token of a host; the pages are parsed once for it
    # tokens with equal occurrence vectors are a class; a host's tokens are few beside its pages
    by_class = Window.partitionBy("host", "vector", "pages")
    valid = vectors.withColumn("tokens", F.count("*").over(by_class)).where(f"pages >= {LEAST_PAGES} AND tokens >= {LEAST_TOKENS}")
    # the template nests: a class stands in slots of classes of at least its pages, or at the top
    up = valid.select("host", F.col("path").alias("parent"), F.lit(True).alias("nested"))
    nested = valid.join(up, ["host", "parent"], "left").where("nested OR parent = 0")
    # the surest elements that hold enough of the varying text pick among the slots
    varying = F.when(F.col("varies") & (F.col("chars") > 0), F.col("chars"))
    held = [F.coalesce(F.sum(F.when(F.col("article") >= level, varying)), F.lit(0)) for level in (ARTICLE, MAIN, NAMED)]
    enough = [h >= SHARE * F.sum(varying) for h in held]
    level = F.when(enough[0], ARTICLE).when(enough[1], MAIN).when(enough[2], NAMED).otherwise(0)
    hosts = nested.groupBy("host").agg(
        level.alias("level"),
        F.collect_list(F.when(F.col("changes"), F.struct("path", "article"))).alias("slots"),
        F.collect_list(F.when(~F.col("varies"), F.col("path"))).alias("fixed"),
        F.collect_list(F.when(varying.isNotNull(), F.col("path"))).alias("heavy"),
    )
    picked = F.transform(F.filter("slots", lambda s: s["article"] >= F.col("level")), lambda s: s["path"])
    return hosts.where("size(heavy) > 0").select("host", F.when(F.col("level") > 0, picked).otherwise(F.col("heavy")).alias("slots"), "fixed", (F.col("level") == 0).alias("wide"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
        texts = [Page(source).main_text(frozenset(slots or ()), frozenset(fixed or ()), bool(wide)) if source else "" for source, slots, fixed, wide in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per row of pages: key, url, text, n_chars.

    Null and empty pages, and pages without main text, have the empty text. Pages with a null url, or one without a host,
    count as one host's. Repeated rows each have their own result, and count as pages of the host. A page of any length is
    whole in memory while it is read; others don't matter to it but by its host's template. Other columns don't matter and may
    have any names. An empty table gives no rows."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    read = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), F.col(source).alias("html"))
    found = written(templates(read.select("host", F.xxhash64("key", "url").alias("page"), "html")), "html-templates", few=True)
    joined = read.join(found, "host", "left").select("key", "url", "html", "slots", "fixed", "wide")
    out = joined.mapInArrow(_extract, f"key {pages.schema[key].dataType.simpleString()}, url string, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
