"""Operator 7: main text of web pages by a site style tree.

The DOMs of a host's pages are merged by style path: the path of container
elements with their presentation (tag, class, id and role).  Over the pages of
a host, Spark counts for every node how often each presentation of its children
and each text block occurs below it; pages of one content count once, so that
copies do not make their text look like boilerplate.  A node's importance is,
with g = 0.9, l presentations and m distinct pages::

    (1 - g ** l) * presentation entropy (base m) + g ** l * content importance
    content importance = 1 - mean over distinct blocks of log_m(pages with the block)

so branches whose looks and words repeat from page to page are unimportant and
go, on hosts of ``MIN_PAGES`` distinct pages or more, within articles as well.
Where nothing is left of a page by importance, every branch stays.

Names help where counts cannot, on hosts with few pages and for branches that
differ from page to page, such as reader comments: an element goes whose tag or
role says that it is no article, or that has a class or id made of nothing but
words for such parts and for the boxes they come in (``cookiebar``,
``top-nav-links``, but not ``share-price`` or ``has-sidebar``).  A name never
takes the article or what the article lies in.  Where a page marks an article
(``article``, ``main``), only text in one counts.

Counts are summed within a task before they are shuffled, keyed by (host, node,
value), so a host with a third of all pages is spread over tasks.  Each of n
copies of a page counts 1 / n, and sums are rounded to the whole numbers they
stand for; n is known from digests, so no page is shuffled for it unless there
are very many copied contents.

Defined results.  A null or empty page has the empty text.  A null address, or
one without a host, belongs to the host ''.  Repeated rows give repeated
results (and count as one page).  Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import as_batches, materialise

GAMMA = 0.9
#: A branch below this importance goes, on a host with so many pages.
THRESHOLD, MIN_PAGES = 0.3, 8
#: Site trees of at most so many unimportant nodes in all are broadcast.
MAX_BROADCAST_NODES = 200_000
#: At most so many contents that a host repeats are broadcast.
MAX_BROADCAST_COPIES = 200_000
#: Counts that a task holds before they are sent on.
HOLD = 200_000

# comments; tags, with quoted attributes or, if quotes don't match, up to the next >; declarations; what the end cuts off
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object select xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINER = frozenset("html body div section article main nav header footer aside form ul ol dl table figure fieldset details dialog menu center td".split())
GONE = frozenset("head nav footer aside form button input menu dialog".split()) | RAW
ARTICLE = frozenset("article main".split())
#: Elements that a start tag closes when they are open (up to the next container).
CLOSES = {t: frozenset([t]) for t in "li option tr".split()} | {t: frozenset("dt dd".split()) for t in "dt dd".split()} | {t: frozenset("td th".split()) for t in "td th".split()}
#: Words for parts that are not the article, and for the boxes and places they come in.
PARTS = frozenset("""ad ads adsbygoogle advert adverts advertisement advertisements adbox sponsor sponsors sponsored banner banners cookie cookies consent gdpr
    notice notices popup modal menu menus nav navbar navigation breadcrumb breadcrumbs sidebar side aside footer comment comments reply replies disqus
    opinion opinions discussion related share sharing social newsletter subscribe subscription promo promos promotion hidden search login signup signin""".split())
BOXES = frozenset("""bar bars box boxes list lists block blocks wrapper wrap container section sections area region link links button buttons btn group
    item items top bottom left right center site page global inner outer panel pane column columns col row rows main primary secondary reader readers user
    users visitor visitors post posts sticky fixed floating mobile desktop form forms icon icons tool tools toolbar widget widgets slot unit units zone
    header head title article articles entry story stories news blog form field fields us this more thread threads tree body content holder strip
    overlay dialog layer js small large""".split())
_HEADERS = frozenset("header masthead topbar".split())
_CAMEL, _WORD = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[a-z]+|\d+")
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())


@lru_cache(maxsize=100_000)
def names_a_part(name: str) -> bool:
    """Whether a class or id is made of words for parts that are not the article
    (and of words for their boxes), at least one of the former."""
    part = False
    for w in _WORD.findall(_CAMEL.sub("-", name).lower()):
        if w.isdigit():
            continue
        known = w in PARTS, w in BOXES
        if not any(known):  # two words in one
            cuts = [(w[:i], w[i:]) for i in range(2, len(w) - 1)]
            known = any((x in PARTS or y in PARTS) and all(z in PARTS or z in BOXES for z in (x, y)) for x, y in cuts), False
            if not known[0]:
                return False
        part |= known[0]
    return part


class Mark:
    """An element that a name takes, and the one around it that a name takes."""

    __slots__ = ("void", "outer")

    def __init__(self, outer: Mark | None):
        self.void, self.outer = False, outer

    def chain(self) -> Iterator[Mark]:
        mark = self
        while mark is not None:
            yield mark
            mark = mark.outer


class Block:
    """A run of text between block boundaries, and the containers it lies in, as
    links (node, outer link) up to None; ``article`` is the article's own link
    (None: not in one), ``taken`` the innermost :class:`Mark` around it."""

    __slots__ = ("parts", "path", "taken", "article")

    def __init__(self, path, taken, article):
        self.parts, self.path, self.taken, self.article = [], path, taken, article

    @property
    def gone(self) -> bool:
        return self.taken is not None and any(not m.void for m in self.taken.chain())

    def nodes(self) -> Iterator[int]:
        """Nodes of the containers from the innermost out."""
        link = self.path
        while link is not None:
            yield link[0]
            link = link[1]

    def text(self) -> str:
        return _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()


def parse(page: str | None):
    """(blocks, children): the text blocks of a page in order, and for each
    container node the tags below it.  Unclosed, misnested and stray tags are
    tolerated; a node is the hash of its style path."""
    page = page or ""
    children: dict[int, list[str]] = {}
    blocks: list[Block] = []
    # open elements: (tag, node, link, innermost mark, article's link)
    stack = [("", 0, None, None, None)]
    now: Block | None = None
    articles: list[tuple[Mark | None, object]] = []  # marks around each article, and its link

    def put(text):
        nonlocal now
        if text:
            if now is None:
                _, _, path, gone, article = stack[-1]
                now = Block(path, gone, article)
                blocks.append(now)
            now.parts.append(text)

    def close(tags, stop=CONTAINER):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, n, skip = 0, len(page), None
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        put(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                now = None
            if tag in CONTAINER or tag not in INLINE:
                close((tag,), frozenset(("article", "main", "body", "table")) - {tag} if tag in CONTAINER else CONTAINER)
            else:
                close((tag,), CONTAINER | {"p", "li"})
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in INLINE:
                now = None
            continue
        if tag in INLINE or tag in VOID:
            if tag == "br" or tag == "hr":
                now = None
            if tag not in VOID:
                _, node, path, gone, article = stack[-1]
                if (tag in GONE or m[3]) and _named(tag, _attributes(m[3])):
                    gone, now = Mark(gone), None
                stack.append((tag, node, path, gone, article))
            continue
        now = None
        if tag not in INLINE:
            close(("p",))
        if tag in CLOSES:
            close(CLOSES[tag], frozenset("ul ol dl table select".split()))
        _, node, path, gone, article = stack[-1]
        attrs = _attributes(m[3]) if m[3] else {}
        children.setdefault(node, []).append(tag)
        taken = _named(tag, attrs) or not article and _heads_page(tag, attrs)
        starts = article is None and not taken and (tag in ARTICLE or attrs.get("role") in ARTICLE)
        if taken:
            gone = Mark(gone)
        if tag in CONTAINER or starts:
            key = f"{node}>{tag}.{' '.join(sorted(attrs.get('class', '').split()))}#{attrs.get('id', '')}@{attrs.get('role', '')}"
            node = xxh64_intdigest(key.encode("utf-8", "surrogatepass")) >> 1
            path = (node, path)
            children.setdefault(node, [])
        if starts:
            article = path
            articles.append((gone, path))
        stack.append((tag, node, path, gone, article))
    put(page[at:])
    if articles and all(mark is not None for mark, _ in articles):
        # every article lies in something that a name would take: the longest frees what is around it
        size = {id(link): 0 for _, link in articles}
        for b in blocks:
            if b.article is not None:
                size[id(b.article)] += sum(map(len, b.parts))
        for mark in max(articles, key=lambda a: size[id(a[1])])[0].chain():
            mark.void = True
    return blocks, children


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(raw)}


def _of_names(attrs: dict[str, str]) -> Iterator[str]:
    yield from attrs.get("class", "").split()
    yield from attrs.get("id", "").split()


def _named(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element says of itself that it is not the article."""
    if tag in GONE:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    return (attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
            or any(map(names_a_part, _of_names(attrs))))


def _heads_page(tag: str, attrs: dict[str, str]) -> bool:
    """A header outside of articles is the page's."""
    if tag in ("html", "body", *ARTICLE):
        return False
    return tag == "header" or any(w in _HEADERS for name in _of_names(attrs) for w in _WORD.findall(name.lower()))


def main_text(page: str | None, unimportant: frozenset[int] = frozenset()) -> str:
    """The page's blocks without named and unimportant branches, of the articles
    alone if the page marks any."""
    blocks, _ = parse(page)
    named = [b for b in blocks if not b.gone]
    if any(b.article for b in named):
        named = [b for b in named if b.article]
    left = [t for b in named if unimportant.isdisjoint(b.nodes()) and (t := b.text())]
    # everything is unimportant, as where all of a host is one template: all of it stays
    return " ".join(left or [t for b in named if (t := b.text())])


def host_of(url) -> F.Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1)
    return F.lower(rest)


def _features(page: str | None) -> Iterator[tuple[int, int, int]]:
    """Distinct (node, kind, value) of a page: kind 0 presence, 1 presentation
    of the children, 2 a text block in the branch."""
    blocks, children = parse(page)
    for node, tags in children.items():
        if node:
            yield node, 0, 0
            yield node, 1, xxh64_intdigest(" ".join(dict.fromkeys(tags)) + f" {len(tags).bit_length()}") >> 1
    seen = set()
    for b in blocks:
        if t := b.text():
            v = xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1
            seen.update((node, v) for node in b.nodes())
    for node, v in seen:
        yield node, 2, v


def with_copies(pages: DataFrame) -> DataFrame:
    """``host, html, copies`` of every page: how many pages of its host have its content."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select("host", "html", F.struct(F.xxhash64(html), F.xxhash64(F.lit(1), html)).alias("digest"))
    many = materialise(p.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "page-copies")
    if many.count() <= MAX_BROADCAST_COPIES:
        many = F.broadcast(many)
    return p.join(many, ["host", "digest"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))


def site_tree(pages: DataFrame) -> DataFrame:
    """``host, node, pages, importance`` of every container node of every host,
    over its distinct pages; ``pages`` has host and html."""
    def run(batches):
        counts: Counter = Counter()

        def flush():
            keys, n = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
            cols = list(zip(*keys)) if keys else [[], [], [], []]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64()))] + [pa.array(n)],
                                              names=["host", "node", "kind", "value", "n"])

        for b in as_batches()(batches):
            for host, page, copies in zip(*(c.to_pylist() for c in b.columns)):
                for f in _features(page):
                    counts[(host, *f)] += 1 / copies
                if len(counts) >= HOLD:
                    yield flush()
        if counts:
            yield flush()

    rows = with_copies(pages).mapInArrow(run, "host string, node bigint, kind int, value bigint, n double")
    c = rows.groupBy("host", "node", "kind", "value").agg(F.round(F.sum("n")).alias("c"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    s = c.groupBy("host", "node").agg(
        of(0, F.col("c")).alias("m"), of(1, F.lit(1.0)).alias("l"), of(1, F.col("c")).alias("looks"),
        of(1, F.col("c") * F.log("c")).alias("looks_log"), of(2, F.lit(1.0)).alias("texts"), of(2, F.log("c")).alias("texts_log"))
    base = F.log(F.greatest(F.col("m"), F.lit(2.0)))
    looks = F.when(F.col("m") > 1, (F.log("looks") - F.col("looks_log") / F.col("looks")) / base).otherwise(1.0)
    content = F.when(F.col("texts") > 0, F.when(F.col("m") > 1, 1 - F.col("texts_log") / (F.col("texts") * base)).otherwise(1.0)).otherwise(0.0)
    g = F.pow(F.lit(GAMMA), F.col("l"))
    return s.select("host", "node", F.col("m").cast("bigint").alias("pages"), ((1 - g) * looks + g * content).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, text`` of every row."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    tree = materialise(site_tree(p).filter((F.col("pages") >= min_pages) & (F.col("importance") < threshold)), "site-tree")
    sites = tree.groupBy("host").agg(F.collect_list("node").alias("nodes"))
    if tree.count() <= MAX_BROADCAST_NODES:
        sites = F.broadcast(sites)

    def run(batches):
        for b in as_batches()(batches):
            texts = [main_text(h, frozenset(nodes or ())) for h, nodes in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in p.schema.fields}
    return p.join(sites, "host", "left").select("page_id", "url", "html", "nodes").mapInArrow(
        run, f"page_id {kinds['page_id']}, url string, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
