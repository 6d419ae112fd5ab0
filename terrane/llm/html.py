"""Main text of HTML pages through site style trees.

The pages of a host are merged into one tree: a node is a path of block elements with their classes. From all pages of
the host each node gets two importances between 0 and 1: of its presentation, the entropy of the child sequences that
it has had, and of its content, one less the mean entropy of its features over the pages. The features of a short block
are its words, a longer block is one feature. A node that shows the same everywhere has little of both. All sites
together make a tree of the same kind. A site's importances are drawn toward those of the same paths there, the more so
the fewer pages it has; paths that a site shows once only have those of all sites.

Each page is then judged from its root down. Below a node that looks the same on all pages, the children are slots of a
template: a branch stays if its importance (of presentation and content, the highest below it) is not far below that of
the best slot. From the node on whose own presentation varies as much as anything below it, all stays but branches that
show the same everywhere and those whose element, class, id or role says that they are none of it. What elements and
names say decides on a slot only where neither tree knows its path.

Scripts, styles, forms and reader comments go on any page. Where all pages together are fewer than PAGES, there is no tree
to speak of: there marked branches go, and a name that merely contains a word of SAYS cuts a branch outside of article
and main that holds neither, nor more than half of the page's text; if there is an article or main element, only what is
below counts. Ids of headings are anchors and say nothing.

Blocks are the texts between the borders of block elements. Character references are decoded, white space becomes one
blank, blocks are joined by one blank. Nulls and empty pages have the empty text. Pages without a host share the host
"". Repeated rows are judged each. Pages are read whole, in time in proportion to their length, however deep they nest
and whatever they leave open (a tag ends at the next "<" at the latest). Columns other than page_id, url and html are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.shared import save
from terrane.llm.urls import host

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^<>]*>|<\?[^<>]*>|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BLOCKS = frozenset(
    "html head body title address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What goes on any page: markup, forms, and by class, id or role the comments of readers.
CUT = frozenset("head form script style noscript template iframe svg button select textarea dialog object canvas audio video".split())
REPLIES = frozenset("comment comments disqus respond replies".split())
#: Elements that say that they are no main text.
ASIDE = frozenset("nav footer aside menu".split())
#: Classes, ids and roles that say so; as a part of a name they hint at it.
SAYS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond replies share sharing social related recommended widget popup modal overlay masthead search "
    "contentinfo complementary toolbar pagination pager skip".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that the start of another ends: start -> what is ended, and where to stop looking.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Pages from which the tree of all sites counts, and as how many pages of a site it does. Words of a short block.
PAGES, SHORT = 10, 16
#: Share of presentation in the importance of a branch; share of the best slot's value that a slot needs; importance that
#: a branch of a varying node needs; share of the presentation below a node from which its own makes it a varying one.
PRESENTATION, SLOT, LOW, VARIES = 0.7, 0.7, 0.05, 0.5
#: What a branch says about itself, and its importance where no tree knows it.
PLAIN, HINT, MARKED, MAIN, GONE = range(5)
UNKNOWN = (1.0, 0.4, 0.0, 1.0, 0.0)
#: Root of the tree of all sites.
POOLED = 1
#: Nodes (16 bytes each) that are sent to all tasks; with more, the nodes of each page are joined instead.
SENT = 1 << 20
#: Parts that the pages' nodes are dealt into for that join; what is known of a node goes to each.
PARTS = 64
MASK = (1 << 64) - 1


class Page:
    """A page as a tree of elements (lists by number, parents first) and blocks of text pieces.

    keys are the numbers of the nodes of the style tree, for inline elements that of the block around them.
    """

    def __init__(self, html: str, root: int = 0):
        self.parent, self.style, self.says, self.block = [-1], [""], [PLAIN], [True]
        self.keys, self.paths, self.shows, self.inside = [root], [POOLED], [0], [False]
        self.pieces: list[tuple[int, list[tuple[int, str]]]] = []  # node, pieces (node, raw text)
        self.stack: list[tuple[str, int]] = [("", 0)]  # element, node
        self.at: dict[str, list[int]] = defaultdict(list)  # places of each element in the stack
        self.around = [0]  # nearest block node of each node
        self.text: list[tuple[int, str]] = []
        at = 0
        while m := TOKEN.search(html, at):
            self.add(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self.close(name)
            else:
                self.open(name, m[3])
                if name in RAW and not m[3].endswith("/"):
                    end = re.compile(rf"</{name}(?=[\s/>])|\Z", re.I).search(html, at)
                    if name in ("textarea", "title"):
                        self.add(html[at : end.start()])
                    at = end.start()
        self.add(html[at:])
        while len(self.stack) > 1:
            self.pop()
        self.flush()

    def add(self, raw: str) -> None:
        node = self.stack[-1][1]
        if raw and self.says[node] != GONE:
            self.text.append((node, raw))

    def flush(self) -> None:
        node = self.stack[-1][1]
        if self.text and self.says[node] != GONE:  # what stands before a cut inline element waits for the rest of its block
            self.pieces.append((self.around[node], self.text))
            self.text = []

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
        if name == "br":
            self.add(" ")
        if name in VOID:
            return
        if name in BLOCKS and name not in ("body", "html") and self.at["p"]:
            self.close("p")
        if name in ENDS:
            ended, stop = ENDS[name]
            last = lambda names: max((self.at[n][-1] for n in names if self.at[n]), default=0)
            while last(ended) > last(stop):
                self.pop()
        up = self.stack[-1][1]
        names, roles, style = set(), set(), name
        if attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                value, key = next((v for v in values if v), "").lower(), key.lower()
                if key != "id" or name not in HEADINGS:
                    (roles if key == "role" else names).update(value.split())
                if key == "class":
                    style += "." + ".".join(sorted(value.split()))
        says, main = PLAIN, self.inside[up]
        if self.says[up] == GONE or name in CUT:
            says = GONE
        elif name in ("html", "body", "article", "main"):
            says = GONE if name == "article" and "comment" in names else PLAIN
        elif not REPLIES.isdisjoint(names) or not REPLIES.isdisjoint(roles):
            says = GONE
        elif name in ASIDE or not SAYS.isdisjoint(names) or not SAYS.isdisjoint(roles) or name == "header" and not main:
            says = MARKED
        elif not main and any(not SAYS.isdisjoint(re.split(r"[^a-z0-9]+", n)) for n in names):
            says = HINT
        if says in (PLAIN, HINT) and (name in ("article", "main") or "main" in roles):
            says, main = MAIN, True
        node, around, block = len(self.parent), self.around[up], name in BLOCKS
        if says != GONE:
            mark = xxhash.xxh64_intdigest(style)
            self.shows[around] = (self.shows[around] * 0x9E3779B97F4A7C15 + mark) & MASK
            key, path = (xxhash.xxh64_intdigest(style, self.keys[up]), xxhash.xxh64_intdigest(style, self.paths[up])) if block else (self.keys[up], self.paths[up])
        else:
            key = path = 0
        for column, value in ((self.parent, up), (self.style, style), (self.says, says), (self.block, block), (self.keys, key), (self.paths, path), (self.shows, 0), (self.inside, main), (self.around, node if block else around)):
            column.append(value)
        self.at[name].append(len(self.stack))
        self.stack.append((name, node))
        if attributes.endswith("/"):
            self.pop()

    def pop(self) -> None:
        name = self.stack[-1][0]
        if name in BLOCKS:
            self.flush()
        self.at[name].pop()
        self.stack.pop()

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if self.at[name]:
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def features(self) -> Counter:
        """(key, whether of the content, feature): how often the page shows it."""
        out = Counter((key, False, show) for key, show, says, block in zip(self.keys, self.shows, self.says, self.block, strict=True) if block and says != GONE)
        for node, pieces in self.pieces:
            words = plain(pieces).split(" ")
            if words[0]:
                for feature in words if len(words) <= SHORT else [" ".join(words)]:
                    out[self.keys[node], True, xxhash.xxh64_intdigest(feature)] += 1
        return out

    def by_names(self) -> list[bool]:
        """Which nodes stay where a site shows too little: by what the elements say."""
        n = len(self.parent)
        stays, chars, mains = [True] * n, [0] * n, [False] * n
        for i in range(1, n):
            stays[i] = stays[self.parent[i]] and self.says[i] not in (MARKED, GONE)
        for _, pieces in self.pieces:
            for node, raw in pieces:
                chars[node] += len(raw.strip()) if stays[node] else 0
        for i in range(n - 1, 0, -1):
            mains[i] |= stays[i] and self.says[i] == MAIN
            chars[self.parent[i]] += chars[i]
            mains[self.parent[i]] |= mains[i]
        for i in range(1, n):
            stays[i] = stays[i] and stays[self.parent[i]] and (self.says[i] != HINT or mains[i] or 2 * chars[i] > chars[0])
        return stays

    def by_tree(self, known: dict[int, tuple[float, float]]) -> list[bool]:
        """Which nodes stay by the importances (presentation, content) of the keys, else of their paths in all sites. What neither
        knows is rare, so important, unless it says otherwise."""
        n, up = len(self.parent), self.parent
        own = [known.get(k) or known.get(p) or (UNKNOWN[s],) * 2 if b else (0.0, 0.0) for k, p, b, s in zip(self.keys, self.paths, self.block, self.says, strict=True)]
        style, content = [x for x, _ in own], [x for _, x in own]
        for i in range(n - 1, 0, -1):
            if self.says[i] != GONE:
                style[up[i]], content[up[i]] = max(style[up[i]], style[i]), max(content[up[i]], content[i])
        worth = [PRESENTATION * s + (1 - PRESENTATION) * c for s, c in zip(style, content, strict=True)]
        best = [0.0] * n
        for i in range(1, n):
            if self.block[i]:
                best[up[i]] = max(best[up[i]], worth[i])
        stays, varies = [True] * n, [own[0][0] >= VARIES * style[0]] * n
        for i in range(1, n):
            p = up[i]
            if not stays[p] or self.says[i] == GONE:
                stays[i] = False
            elif not self.block[i]:
                stays[i], varies[i] = self.says[i] != MARKED, varies[p]
            else:
                stays[i] = self.says[i] != MARKED and worth[i] >= LOW if varies[p] else worth[i] >= SLOT * best[p]
                varies[i] = varies[p] or own[i][0] >= VARIES * style[i]
        return stays

    def texts(self, stays: list[bool], main: bool) -> list[tuple[int, str]]:
        """Blocks with text left; if main, only those in an article or main element if there is one."""
        out = [(node, t) for node, pieces in self.pieces if (t := plain([x for x in pieces if stays[x[0]]]))]
        inside = [b for b in out if self.inside[b[0]]] if main else []
        return inside or out

    def path(self, node: int) -> str:
        names = []
        while node > 0:
            names += [self.style[node]] if self.block[node] else []
            node = self.parent[node]
        return "".join(f">{x}" for x in reversed(names))

    @property
    def blocks(self) -> list[tuple[str, str, bool]]:
        return [(self.path(node), t, self.inside[node]) for node, t in self.texts(self.by_names(), False)]

    def main(self) -> list[tuple[str, str, bool]]:
        return [(self.path(node), t, self.inside[node]) for node, t in self.texts(self.by_names(), True)]

    def text_of(self, known: dict[int, tuple[float, float]] | None) -> str:
        """The main text; known: what the site's tree says, or None."""
        return " ".join(t for _, t in (self.texts(self.by_names(), True) if known is None else self.texts(self.by_tree(known), False)))


def plain(pieces: list[tuple[int, str]]) -> str:
    return " ".join(references.unescape("".join(raw for _, raw in pieces)).split())


def root(host: str | None) -> int:
    return xxhash.xxh64_intdigest(host or "")


def signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def features(pages: DataFrame) -> DataFrame:
    """node, path (the node in the tree of all sites), content (else presentation), feature, k (times on the page), first (once
    for each page and node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, path, content, feature, times, first = [], [], [], [], [], []
            for h, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                seen, page = set(), Page(text or "", root(h))
                paths = dict(zip(page.keys, page.paths, strict=True))
                for (key, c, f), k in page.features().items():
                    node.append(key)
                    path.append(paths[key])
                    content.append(c)
                    feature.append(f)
                    times.append(k)
                    first.append(not c and key not in seen)
                    if not c:
                        seen.add(key)
            columns = [signed(node), signed(path), pa.array(content, pa.bool_()), signed(feature), pa.array(times, pa.int64()), pa.array(first, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "path", "content", "feature", "k", "first"])

    return pages.select("host", "html").mapInArrow(run, "node long, path long, content boolean, feature long, k long, first boolean")


def _importance(k: DataFrame, node: str) -> DataFrame:
    """node, pages, presentation, content from sums by node, content and feature; of one page alone neither is known."""
    of = lambda content, x: F.when(F.col("content") if content else ~F.col("content"), x)
    rows = k.groupBy(F.col(node).alias("node")).agg(
        F.sum("m").alias("pages"),
        F.avg(of(True, F.log("t") - F.col("s") / F.col("t"))).alias("spread"),
        F.sum(of(False, F.col("t"))).alias("n"),
        F.sum(of(False, F.col("t") * F.log("t"))).alias("same"),
    ).where("pages > 1")
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    presentation = unit((F.log("n") - F.col("same") / F.col("n")) / F.log("pages"))
    return rows.select("node", "pages", presentation.alias("presentation"), F.coalesce(unit(1 - F.col("spread") / F.log("pages")), F.lit(0.0)).alias("content"))


def importance(pages: DataFrame) -> DataFrame:
    """node, pages, presentation, content of the nodes of all sites, and of the tree of all sites together.

    What a site of few pages shows is drawn toward the same path in all sites, which counts as PAGES pages of its own; so
    the method holds for sites of any size. Nodes of the tree of all sites count from PAGES pages on.
    """
    k = features(pages).groupBy("node", "path", "content", "feature").agg(F.sum("k").alias("t"), F.sum(F.col("k") * F.log("k")).alias("s"), F.sum(F.col("first").cast("long")).alias("m"))
    k = save(k)
    site = _importance(k, "node").join(k.select("node", "path").distinct(), "node")
    everywhere = k.groupBy("path", "content", "feature").agg(*(F.sum(c).alias(c) for c in ("t", "s", "m")))
    everywhere = save(_importance(everywhere, "path").where(F.col("pages") >= PAGES))
    own, prior = F.col("pages") - 1, F.lit(PAGES)
    shrunk = lambda c: ((own * F.col(c) + prior * F.col(f"all_{c}")) / (own + prior)).alias(c)
    drawn = site.join(everywhere.select(F.col("node").alias("path"), *(F.col(c).alias(f"all_{c}") for c in ("presentation", "content"))), "path")
    return drawn.select("node", "pages", shrunk("presentation"), shrunk("content")).unionByName(everywhere)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    nodes = save(importance(pages).select("node", F.col("presentation").cast("float"), F.col("content").cast("float")))
    if nodes.count() <= SENT:
        return judged(pages.withColumn("known", F.lit(None).cast(KNOWN)), nodes)
    return judged(with_known(pages, nodes), None)


KNOWN = "array<struct<node:long,presentation:float,content:float>>"


def with_known(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """pages with what is known of their nodes, by joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, node) for key, h, text in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "html")), strict=True) for page in [Page(text or "", root(h))] for node in {*page.keys, *page.paths}]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), signed([n for _, n in found])], ["key", "node"])

    pages = pages.withColumn("key", F.xxhash64("host", "html"))
    own = pages.select("key", "host", "html").mapInArrow(run, "key long, node long").distinct().withColumn("part", F.pmod("key", F.lit(PARTS)))
    each = nodes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    known = own.join(each, ["node", "part"]).groupBy("key").agg(F.collect_list(F.struct("node", "presentation", "content")).alias("known"))
    return pages.join(known, "key", "left")


def among(nodes: tuple[np.ndarray, np.ndarray, np.ndarray], keys: list[int]) -> dict[int, tuple[float, float]]:
    """What is known of the keys; nodes: sorted nodes, presentation, content."""
    keys = np.unique(np.array(keys, np.uint64))
    at = np.searchsorted(nodes[0], keys)
    hit = np.flatnonzero((at < len(nodes[0])) & (nodes[0][np.minimum(at, len(nodes[0]) - 1)] == keys)) if len(nodes[0]) else np.zeros(0, np.int64)
    at = at[hit]
    return dict(zip(keys[hit].tolist(), zip(nodes[1][at].tolist(), nodes[2][at].tolist(), strict=True), strict=True))


def judged(pages: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """page_id, url, text, n_chars of pages by their column known, or by nodes (SENT at most)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    sent = None
    if nodes is not None:
        rows = nodes.select("node", "presentation", "content").toArrow()
        key, presentation, content = (rows.column(c).to_numpy() for c in range(3))
        order = np.argsort(key.view(np.uint64))
        sent = pages.sparkSession.sparkContext.broadcast((key.view(np.uint64)[order], presentation[order], content[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for h, text, rows in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "known")), strict=True):
                page = Page(text or "", root(h))
                known = among(sent.value, page.keys + page.paths) if sent else {r["node"] & MASK: (r["presentation"], r["content"]) for r in rows or ()}
                texts.append(page.text_of(known if POOLED in known else None))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "host", "html", "known").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
