"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a style path, the tags and classes from
`body` down, and holds how many pages have it and which contents they show there. Its importance is
one minus the mean entropy of its contents over the pages (logarithm to the number of pages): 1 if
every page shows its own text, 0 if all show the same. Presentation counts by the entropy of the
styles that follow a node, weighted as in the published measure. All text blocks of the body are in
the tree. Branches below IMPORTANCE are left out of each page, on hosts with enough different pages
to tell. Pages of a host with equal blocks, apart from those named as noise, count once.

Markup is a later check. What it names as not content (navigation, footers, asides, forms, adverts,
notices, comments and the like) is left out whatever its importance: adverts change from page to page
and would pass for content. On a page with an article or main element, branches outside of it are left
out too if the tree has found them below CERTAIN; those of more or unknown importance stay.

Rows: null or empty html gives empty text; a null url is the host of all such pages. Repeated rows
are pages of their own in the result.
"""

from __future__ import annotations

import re
from functools import cache
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.shared import cut, small_batches, small_side

IMPORTANCE = 0.2
#: Importance from which a branch stays that lies outside the article of its page.
CERTAIN = 0.5
LEAST_PAGES = 8
#: Weight of the children of a node in its importance, as published.
CHILDREN = 0.9

# Elements of HTML by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rb rp rt rtc "
             "ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
UNSEEN = set("script style noscript template head title datalist iframe frame frameset object embed applet svg canvas "
             "math audio video map".split())
SKIPPED = UNSEEN | set("nav footer aside form button select textarea option fieldset dialog menu meter progress".split())
ENDS_BEFORE = {  # an open element that the start of another closes
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}}
NOISE_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors "
    "promo promos promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar "
    "sidebars aside cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login social share sharing sharebar related recommended "
    "recommendations comment comments commentlist reply replies respond disqus discussion reactions widget widgets "
    "toolbar pagination pager skip tagcloud".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                  "toolbar note".split())


@cache
def _noisy_names(value: str) -> bool:
    words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", value).lower())
    return any(w in NOISE_NAMES for w in words)


class PageParser(HTMLParser):
    """Collects (path, text, region, noise) of the blocks of a page; region 2 is an article, 1 main, 0 else.

    Elements named as noise or main have paths of their own, so their contents do not mix with others'.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, bool, int]] = []  # tag, path, noise, region
        self.blocks: list[tuple[str, str, int, bool]] = []
        self.parts: dict[tuple[str, bool, int], list[str]] = {}  # of a block and the inline noise in it
        self.state = ("", False, 0)
        self.unseen = 0  # how many elements are open up to the outermost that shows no text

    def _flush(self) -> None:
        for (path, noise, region), parts in self.parts.items():
            text = " ".join("".join(parts).split())
            if text:
                self.blocks.append((path, text, region, noise))
        self.parts.clear()

    def _add(self, text: str) -> None:
        if not self.unseen:
            self.parts.setdefault(self.state, []).append(text)

    def _enter(self) -> None:
        self.state = self.open[-1][1:] if self.open else ("", False, 0)
        if len(self.open) < self.unseen:
            self.unseen = 0
        if not self.unseen and self.open and self.open[-1][0] in UNSEEN:
            self.unseen = len(self.open)

    def _close(self, tags: set[str], until: set[str]) -> None:
        """Closes the nearest open element of `tags` unless one of `until` is nearer."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                if self.open[k][0] not in INLINE:
                    self._flush()
                del self.open[k:]
                self._enter()
                return
            if self.open[k][0] in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            if tag in VOID:
                self._add(" ")
            elif self._noisy(tag, attrs):  # its text is left out, the block around it goes on
                self.open.append((tag, f"{self.state[0]}>{tag}!", True, self.state[2]))
                self._enter()
            return
        self._flush()
        if tag in VOID:
            return
        if tag in ENDS_BEFORE:
            self._close(ENDS_BEFORE[tag], {"ul", "ol", "dl", "table", "select"})
        self._close({"p"}, {"button", "td", "th", "article", "section", "div", "li", "blockquote"})
        path, noise, region = self.state
        names = dict(attrs)
        named = self._noisy(tag, attrs) or (not region and self._is_header(tag, names))
        noise = noise or named
        if not noise and tag == "article":
            region = 2
        elif not noise and (tag == "main" or names.get("role") == "main"):
            region = max(region, 1)
        shown = ".".join(sorted((names.get("class") or "").split()))
        mark = "!" if named else "@" if names.get("role") == "main" else ""
        self.open.append((tag, f"{path}>{tag}{mark}.{shown}" if shown else f"{path}>{tag}{mark}", noise, region))
        self._enter()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    @staticmethod
    def _noisy(tag, attrs) -> bool:
        if tag in SKIPPED:
            return True
        if tag in ("html", "body", "article", "main"):
            return any(n == "class" and tag == "article" and _noisy_names(v or "") for n, v in attrs)
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id") and _noisy_names(value):
                return True
            if name == "role" and value.strip().lower() in NOISE_ROLES:
                return True
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        return False

    @staticmethod
    def _is_header(tag, names) -> bool:
        """A header of the page, not of its article."""
        shown = f"{names.get('class') or ''} {names.get('id') or ''}".lower()
        return tag == "header" or (tag in ("div", "section", "table") and "header" in re.split(r"[^a-z0-9]+", shown))

    def handle_endtag(self, tag):
        if any(entry[0] == tag for entry in self.open):
            if tag in INLINE:  # only those that hold noise are open
                self._close({tag}, {"div", "p", "li", "td", "section", "article", "body"})
            else:
                self._close({tag}, set())
        elif tag == "p":
            self._flush()

    def handle_data(self, data):
        self._add(data)


def body_blocks(html: str | None) -> list[tuple[str, str, int, bool]]:
    """(style path, text, region, noise) of all blocks of a page that show text."""
    if not html:
        return []
    parser = PageParser()
    parser.feed(html)
    parser.close()
    parser._flush()
    return parser.blocks


def content_blocks(blocks: list[tuple[str, str, int, bool]], low, unsure) -> list[tuple[str, str]]:
    """(style path, text) of the blocks that are content: `low(path)` tells a branch to leave out,
    `unsure(path)` one to leave out if it lies outside the article or main element of the page."""
    top = max((region for _, _, region, noise in blocks if not noise), default=0)
    return [(path, text) for path, text, region, noise in blocks
            if not low(path) and not noise and (region == top or not unsure(path))]


def page_blocks(html: str | None) -> list[tuple[str, str]]:
    """(style path, text) of the blocks that markup alone allows as content, without a tree of the host."""
    return content_blocks(body_blocks(html), lambda path: False, lambda path: True)


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _page_nodes(batches):
    """Per page the distinct nodes of its blocks' paths, for the merged tree of its host."""
    paths: dict[str, tuple[int, int]] = {}
    for batch in small_batches(batches, 1):
        hosts, pages, lists, below = [], [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, own, following = [], [], {}
            for path, text, _, noise in body_blocks(html):
                if path not in paths:
                    if len(paths) > 100_000:
                        paths.clear()
                    paths[path] = (_digest(path), _digest(path.rpartition(">")[0]))
                found.append((*paths[path], _digest(text)))
                following.setdefault(found[-1][1], []).append(found[-1][0])
                if not noise:  # adverts that change do not make another page
                    own.append(found[-1])
            hosts.append(host)
            pages.append(_digest(repr(own)))
            lists.append([{"path": p, "parent": q, "content": c} for p, q, c in found])
            below.append([{"parent": q, "variant": hash(tuple(p))} for q, p in following.items()])
        kind = pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("content", pa.int64())]))
        styles = pa.list_(pa.struct([("parent", pa.int64()), ("variant", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(lists, kind),
                                          pa.array(below, styles)], names=["host", "page", "nodes", "below"])


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def unimportant_paths(pages: DataFrame, importance: float = IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, low, unsure) of the nodes below the wanted importance and of the others below CERTAIN
    in the tree of each host."""
    nodes = (pages.select(host_of(F.col("url")).alias("host"), "html")
             .mapInArrow(_page_nodes, "host string, page long, nodes array<struct<path:long,parent:long,content:long>>, "
                         "below array<struct<parent:long,variant:long>>"))
    different = cut(nodes.where(F.size("nodes") > 0).dropDuplicates(["host", "page"]))  # read twice, so pages are parsed once
    node = different.select("host", "page", F.explode("nodes").alias("node")).select("host", "page", "node.*")
    # contents: how many pages of the host show the same text at the node
    texts = node.groupBy("host", "path", "parent", "content").agg(F.countDistinct("page").alias("n"))
    style = node.select("host", "path", "parent", "page").distinct().groupBy("host", "path", "parent").agg(
        F.count("page").alias("pages"))
    leaves = (texts.groupBy("host", "path", "parent")
              .agg(F.sum(F.col("n") * F.log("n")).alias("bits"), F.sum("n").alias("shown"))
              .join(style, ["host", "path", "parent"])
              .withColumn("entropy", F.when(F.col("pages") > 1, F.col("bits") / (F.col("shown") * F.log("pages")))
                          .otherwise(F.lit(0.0)))
              .withColumn("importance", 1 - F.col("entropy")))
    # presentation: how differently the pages go on below the same parent
    variants = different.select("host", F.explode("below").alias("below")).groupBy("host", "below.parent", "below.variant").count()
    presentation = (variants.groupBy("host", "parent")
                    .agg(F.sum(F.col("count") * F.log("count")).alias("bits"), F.sum("count").alias("all"))
                    .withColumn("variety", F.when(F.col("all") > 1, 1 - F.col("bits") / (F.col("all") * F.log("all")))
                                .otherwise(F.lit(1.0))))
    weighted = (leaves.join(presentation.select("host", "parent", "variety"), ["host", "parent"])
                .withColumn("composite", (1 - CHILDREN) * F.col("variety") + CHILDREN * F.col("importance")))
    low = F.col("composite") < importance
    return (weighted.where((F.col("pages") >= least_pages) & (low | (F.col("composite") < CERTAIN)))
            .groupBy("host").agg(F.collect_set(F.when(low, F.col("path"))).alias("low"),
                                 F.collect_set(F.when(~low, F.col("path"))).alias("unsure")))


def _extract(at: int, width: int):
    def task(batches):
        digests: dict[str, int] = {}
        for batch in small_batches(batches, at):
            texts = []
            for html, *sets in zip(*(batch.column(k).to_pylist() for k in (at, width, width + 1))):
                blocks, (low, unsure) = body_blocks(html), (set(x or ()) for x in sets)
                if low or unsure:
                    for path, *_ in blocks:
                        if path not in digests:
                            digests[path] = _digest(path)
                found = content_blocks(blocks, lambda path: low and digests[path] in low,
                                       lambda path: unsure and digests[path] in unsure)
                texts.append("\n".join(text for _, text in found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string())],
                                             names=[*batch.schema.names[:width], "text"])
    return task


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with `text`, the main text; a column of this name is replaced."""
    pages = pages.drop("text")
    dropped = small_side(cut(unimportant_paths(pages.select("url", "html"))))
    marked = (pages.withColumn("__host", host_of(F.col("url")))
              .join(dropped.select(F.col("host").alias("__host"), F.col("low").alias("__low"), F.col("unsure").alias("__unsure")),
                    "__host", "left")
              .select(*(pages[c] for c in pages.columns), "__low", "__unsure"))
    schema = ", ".join(f"`{n}` {t}" for n, t in pages.dtypes)
    return marked.mapInArrow(_extract(pages.columns.index("html"), len(pages.columns)), f"{schema}, text string")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
