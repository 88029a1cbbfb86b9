"""HTML extraction by site style trees.

The whole DOMs of a host's pages merge into one tree of styled elements. An element is important if its pages present it
in many ways (entropy of its child sequences) or fill it with content of their own (one less the mean entropy of its
text blocks over the pages: a block that all pages hold has 1, one that a single page holds 0; each counts as often as
it occurs); elements of low
importance (menus, notices and the like that every page repeats) are removed from each page. What the markup itself
says to be no main text (tags, roles, hidden elements, and classes that name nothing else) goes whatever its pages fill
it with. The text of articles, where a page has some, is the main text.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Elements by role in HTML.
DROPPED = frozenset("nav footer aside form menu dialog button label fieldset audio video canvas map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
NOISE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget widgets ad ads adv advert adverts advertisement adbox banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "footer masthead topbar pagination pager toolbar copyright legal disclaimer skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that add nothing to what another word of a class says.
PLAIN = frozenset("site page main global top bottom left right primary secondary box area wrapper wrap container block section list item items bar inner outer link links post posts text group row column button buttons icon icons panel region module body".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|noscript|svg|math|iframe|object|textarea|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
ATTR = re.compile(r"(=?[^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def _named(token: str) -> int:
    """What a class or id says: 2 for reader comments, 1 for other noise, 0 if any of its words may mean something else."""
    words = WORD.findall(token)
    if not words or not all(w in NOISE or w in COMMENTS or w in PLAIN for w in words):
        return 0
    return 2 if not COMMENTS.isdisjoint(words) else int(not NOISE.isdisjoint(words))


def _style(tag: str, attrs: str, article: bool) -> tuple[str, bool, int]:
    """Label of an element in the style tree, whether its markup says that it is no main text, and what its class says
    (as _named): a class alone is taken back where the element turns out to hold the article, and says nothing of the
    document; of articles it can say that they are comments."""
    sure, named = tag in DROPPED or (tag == "header" and not article), 0
    if not attrs or attrs.isspace():
        return tag, sure, 0
    names = []
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            for v in value.split():
                names.append(v)
                named = max(named, _named(v), int(not article and v in ("header", "site-header")))
        elif name == "role":
            sure = sure or value in ROLES
        elif name == "hidden":
            sure = True
        elif name == "aria-hidden":
            sure = sure or value == "true"
        elif name == "style":
            sure = sure or "display:none" in value.replace(" ", "")
    if tag in ("html", "body") or (tag in ("article", "main") and named < 2):
        named = 0
    return ".".join([tag, *sorted(re.sub(r"\d+", "", x) for x in names)]), sure, named


class Page:
    """blocks: (path of styles, in an article, text) in page order; children: child sequences by path. whole: with what the
    markup says to be no main text, for the style tree; else without."""

    def __init__(self, html: str, whole: bool = False):
        self.blocks: list[tuple[tuple[str, ...], bool, str]] = []
        self.children: dict[tuple[str, ...], list[str]] = {}
        stack: list[list] = []  # tag, style (None: inline), noise (0 or 1), article, what its class says
        path: list[str] = []
        text: list[str] = []
        noise = 0
        article = 0

        def flush():
            if text:
                words = " ".join(unescape("".join(text)).split())
                text.clear()
                if words:
                    self.blocks.append((tuple(path), article > 0, words))

        def pop(to: int):
            nonlocal noise, article
            while len(stack) > to:
                _, style, bad, main, _ = stack.pop()
                if style is not None:
                    flush()
                    path.pop()
                noise -= bad
                article -= main

        def last(tags, until=()) -> int:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    return i
                if stack[i][0] in until:
                    return -1
            return -1

        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at and (whole or not noise):
                text.append(html[at : m.start()])
            at = m.end()
            if not (tag := m["tag"]):
                continue
            tag = tag.lower()
            if m["end"]:
                if (i := last((tag,), () if tag in CLOSES_P or tag in ("body", "html") else ("article", "main", "td", "th"))) >= 0:
                    pop(i)
                elif tag == "p":
                    flush()
                continue
            if tag == "br" or tag == "hr":
                if whole or not noise:
                    text.append(" ")
                continue
            if tag in VOID:
                continue
            if tag in CLOSES_P and (i := last(("p",), ("article", "section", "div", "td", "th", "li", "blockquote", "main", "aside", "table"))) >= 0:
                pop(i)
            elif tag in SAME and (i := last(SAME[tag][0].split(), SAME[tag][1])) >= 0:
                pop(i)
            style, sure, named = _style(tag, m["attrs"], article > 0)
            bad = int(sure or named > 0)
            if tag in INLINE:
                stack.append([tag, None, bad, False, named])
            else:
                flush()
                if tag in ("article", "main") and not bad and noise and not article and all(x[4] == 1 for x in stack if x[2]):
                    for x in stack:  # only classes spoke against what holds the article
                        x[2] = 0
                    noise = 0
                self.children.setdefault(tuple(path), []).append(style)
                path.append(style)
                stack.append([tag, style, bad, main := tag in ("article", "main") and not bad and not noise, 0 if sure else named])
                article += main
            noise += bad
            if m["attrs"].rstrip().endswith("/") and tag not in ("p", "div", "a"):
                pop(len(stack) - 1)
        if at < len(html) and (whole or not noise):
            tail = html[at:]
            text.append(tail[: cut] if (cut := tail.find("<")) >= 0 and re.match(r"</?[a-z!]", tail[cut:], re.I) else tail)
        flush()

    def digest(self) -> int:
        return _hash("\x1e".join(b[2] for b in self.blocks))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def features(page: Page) -> set[tuple[str, int, int]]:
    """(element's path, kind, feature): kind 0 child sequences (runs of equal children count once), kind 1 text blocks.

    All elements of the whole DOM that can be removed are listed, whatever their markup says.
    """
    out = set()
    texts: dict[tuple[str, ...], set[str]] = {}
    for path, _, words in page.blocks:
        for depth in range(1, len(path) + 1):
            if removable(own := path[:depth]):
                texts.setdefault(own, set()).add(words)
    for own, words in texts.items():
        kids, element = page.children.get(own, []), "/".join(own)
        out.add((element, 0, _hash("\x1f".join(k for i, k in enumerate(kids) if not i or kids[i - 1] != k))))
        out.update((element, 1, _hash(w)) for w in words)
    return out


def removable(path: tuple[str, ...]) -> bool:
    """Divisions, lists and tables can go; the document, articles and single paragraphs and headings stay or go with them."""
    tag = path[-1].split(".", 1)[0]
    return tag not in ("html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "tr", "td", "th", "tbody", "dt", "dd")


def _element(host: str, path: str) -> int:
    return _hash(f"{host}\x1d{path}")


def main_text(html: str | None, low: frozenset[int] = frozenset(), host: str = "") -> str:
    """Main text of a page; low: elements (hashes of host and path) of low importance on its host."""
    page = Page(html or "")
    blocks = page.blocks
    if low:
        known: dict[tuple[str, ...], bool] = {}

        def cut(path):
            if path not in known:
                known[path] = bool(path) and ((removable(path) and _element(host, "/".join(path)) in low) or cut(path[:-1]))
            return known[path]

        blocks = [b for b in blocks if not cut(b[0])]
    main = [b[2] for b in blocks if b[1]]
    return " ".join(main or [b[2] for b in blocks])


def _features(rows):
    for batch in rows:
        for at in range(0, batch.num_rows, 500):
            out = []
            part = batch.slice(at, 500)
            for url, html in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                page, host = Page(html or "", whole=True), host_of(url)
                if found := features(page):
                    digest, key = page.digest(), _hash(host)
                    out += [(key, _element(host, path), kind, feature, digest) for path, kind, feature in found]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols)], names=["host", "element", "kind", "feature", "page"])


def low_elements(pages: DataFrame, least_importance: float = 0.3, least_pages: int = 5) -> DataFrame:
    """(host, element) of low importance: the greater of the presentation's and the content's importance is below
    least_importance. Entropies are to the base of the number of pages that have the element. Pages with equal text count
    once; elements on fewer than least_pages pages are kept."""
    seen = pages.select("url", "html").mapInArrow(_features, "host long, element long, kind int, feature long, page long").distinct()
    count = seen.groupBy("host", "element", "kind", "feature").agg(F.count(F.lit(1)).cast("double").alias("c"))
    sums = count.groupBy("host", "element", "kind").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log("c")).alias("cl"))
    own = sums.groupBy("host", "element").agg(
        F.max(F.when(F.col("kind") == 0, F.col("t"))).alias("pages"),
        F.max(F.when(F.col("kind") == 0, F.log("t") - F.col("cl") / F.col("t"))).alias("style"),
        F.max(F.when(F.col("kind") == 1, F.col("cl") / F.col("t"))).alias("shared"),
    )
    importance = F.greatest(F.col("style") / F.log("pages"), 1 - F.col("shared") / F.log("pages"))
    return own.where((F.col("pages") >= least_pages) & (importance < least_importance)).select("host", "element")


def extract(pages: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per row of pages.

    Null html is empty; a null or odd url belongs to the host ''; null and repeated ids keep a row each. Pages are read
    whole, however long. An empty table gives no rows; other columns are ignored, whatever their names.

    Up to broadcast_rows low-importance elements (16 bytes each) go to the executors as a broadcast; more of them join by host.
    """
    low = stored(low_elements(pages), "styles")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    schema = "page_id long, url string, text string, n_chars long"

    def made(batch, lows, hosts):
        text = [main_text(h, x, y) for h, x, y in zip(batch.column("html").to_pylist(), lows, hosts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if low.count() <= broadcast_rows:
        sent = pages.sparkSession.sparkContext.broadcast(frozenset(r.element for r in low.collect()))

        def run(batches):
            for batch in batches:
                yield made(batch, [sent.value] * batch.num_rows, map(host_of, batch.column("url").to_pylist()))

        return rows.mapInArrow(run, schema)
    joined = rows.withColumn("host", F.udf(lambda url: _hash(host_of(url)), "long")("url")).join(low.groupBy("host").agg(F.collect_list("element").alias("low")), "host", "left")

    def run_joined(batches):
        for batch in batches:
            yield made(batch, [frozenset(x or ()) for x in batch.column("low").to_pylist()], map(host_of, batch.column("url").to_pylist()))

    return joined.select("page_id", "url", "html", "low").mapInArrow(run_joined, schema)
