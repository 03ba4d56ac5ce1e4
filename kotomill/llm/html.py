"""HTML main text with a site style tree.

Pages are parsed leniently, once per pass, into a tree of block elements; whatever its depth, an element is named by the hash of
its style path, the tags with class names from the root. The pages of one host merge by these names into a style tree:

* a presentation node is an element with the distribution of its styles, a style being the sequence of its children; its
  importance is the entropy of that distribution over the host's pages, in units of the logarithm of the pages that have it;
* a content node is a whole branch, by the digest of all text below it, at a presentation node; its importance is one minus the
  logarithm of the pages that hold it over the logarithm of the pages that have the element: 0 for a branch that every page
  repeats, 1 for one that no other page holds.

An element weighs (1 - GAMMA) of its presentation and GAMMA of the mean importance of its branches. Under THRESHOLD its
repeated branches, those that weigh no more themselves, are removed from the page with all below them, be they called a menu or
not; a passage that articles share stays, as their elements hold other text too. An element that fewer than LEAST_PAGES of the host's pages have gives no
statistics, and no statistics know an advert that changes from page to page; therefore some styles count 0 by their name on any host: tags
that mean menus, footers, asides and forms, and blocks with a class of a closed vocabulary. A class counts as a whole: all words of it must mean such a part
(NOISE_WORDS, COMMENT_WORDS) or only its place or form (PLACE_WORDS), so "cookie-notice" and "ad-slot" count and "profit-share" does not; headings, table cells and inline
elements have no such names, paragraphs and list items only those of adverts and comments, and ids count outside articles only. A block that holds more
than MOST of the page's text is not removed by its name (MOST_COMMENTS if it is one of comments, MOST_FORM if it is a form): it is a frame around the
content, unless more of the articles' text lies outside it. Of the rest, the page's text is its main part: what lies in articles, if that is
at least SHARE of the text, and in main, else in parts named as content, if that is SHARE of it, else all. Names that would leave a page empty are
disregarded, and so are statistics that would: the host's pages are then copies of each other.

Statistics are grouped sums over (host, element, digest), added up before any shuffle; only the branches to
remove travel back to the pages, by broadcast if they are few and else by a join on the host.

Defined edge cases: null or empty html gives an empty text; a null or odd url belongs to the host '';
repeated rows each give a row; an empty table gives an empty result; extra columns are ignored; pages of
any length and depth are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, passing, small_batches, small_side, table, tidy

GAMMA, THRESHOLD, LEAST_PAGES = 0.9, 0.3, 8
#: The share of a page's text that its main part has at least.
SHARE = 0.3
#: The most of a page's text that a block may hold and still be removed by its name.
MOST, MOST_COMMENTS, MOST_FORM = 0.5, 0.8, 0.9

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes of the open elements above the nearest of the stops.
CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, a, b in (("li", "li p", "ul ol menu"), ("dt", "dt dd p", "dl"), ("dd", "dt dd p", "dl"), ("tr", "tr td th p", "table"), ("td", "td th p", "tr table"), ("th", "td th p", "tr table"), ("tbody", "tr td th p thead tbody tfoot", "table"), ("thead", "tr td th p thead tbody tfoot", "table"), ("tfoot", "tr td th p thead tbody tfoot", "table"), ("option", "option", "select"), ("optgroup", "option optgroup", "select"))}
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P_STOPS = frozenset("button table td th caption html body article main section div li".split())
# Styles without importance, by tag, role and the words of a class.
HARD_TAGS = frozenset("nav footer aside head".split())  # even where the names leave nothing
SOFT_TAGS = frozenset("form dialog".split())
LOST_TAGS = frozenset("select object audio video canvas".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menubar breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising "
    "adsense sponsor sponsors sponsored promo promos cookie cookies consent gdpr notice notices popup modal newsletter subscribe "
    "share sharing social related recommended recommendations pagination pager skip outbrain taboola".split()
)
WEAK_WORDS = frozenset("menu alert widget widgets search banner hidden toolbar overlay login signup subscription promotion copyright header masthead topbar".split())  # not inside an article
COMMENT_WORDS = frozenset("comment comments commentlist feedback disqus respond reply replies responses".split())
PLACE_WORDS = frozenset(
    "site main page global top bottom left right inner outer upper lower primary secondary first last sub mobile desktop sticky fixed floating wrapper wrap container box bar block section area "
    "zone slot unit panel pane column col row list lists item items link links button buttons icon icons form thread post posts article articles story stories entry entries head body text title media js".split()
)
AD_WORDS = frozenset("ad ads advert advertisement sponsored".split())
#: Elements whose class never says that they are no content, and those of which only adverts and comments do.
UNNAMED = frozenset("html body main h1 h2 h3 h4 h5 h6 td th tr tbody thead tfoot caption table dt dd pre figure figcaption legend".split())
HALF_NAMED = frozenset("p li blockquote".split())
MAIN_WORDS = frozenset("content maincontent articlebody articlecontent postcontent entrycontent story".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|[\"'])*+)>")
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HOST = re.compile(r"\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


class Node:
    """An open element: its tag, the block element that it belongs to, whether its text is lost, and its tier."""

    __slots__ = ("block", "lost", "tag", "tier")

    def __init__(self, tag: str, block: int, lost: bool, tier: int):
        self.tag, self.block, self.lost, self.tier = tag, block, lost, tier


class Page:
    """The block elements of a page, and its blocks of text in order.

    ``parent``, ``label`` and ``most`` are by element; ``items`` holds an element's children (their number) and texts (the text), in
    order. ``most`` is the most of the page's text that the element may hold and still be none of its content: 0 says that it is content, 1 that its tag
    or attributes rule it out whatever it holds. A block of text is (element, text, tier, plain): tier 3 lies in an article, 2 in main, 1 in a part
    named as content; plain has text outside links.
    """

    def __init__(self) -> None:
        self.parent, self.label, self.most = [-1], [""], [0.0]
        self.items: list[list[int | str]] = [[]]
        self.texts: list[tuple[int, str, int, bool]] = []

    def open(self, parent: int, label: str, most: float) -> int:
        self.parent.append(parent)
        self.label.append(label)
        self.most.append(most)
        self.items.append([])
        self.items[parent].append(len(self.label) - 1)
        return len(self.label) - 1

    def ruled_out(self) -> tuple[list[bool], list[bool]]:
        """Whether each element, or one around it, is no content by its tag or attributes, and by those or by its name."""
        hard, noise, size, main = [False], [False], [0] * len(self.label), [0] * len(self.label)
        for parent, most in zip(self.parent[1:], self.most[1:], strict=True):
            hard.append(hard[parent] or most == 1)
        for k, words, tier, _ in self.texts:
            size[k] += 0 if hard[k] else len(words)
            main[k] += len(words) if tier > 1 and not hard[k] else 0
        for k in range(len(size) - 1, 0, -1):
            size[self.parent[k]] += size[k]
            main[self.parent[k]] += main[k]
        for k in range(1, len(size)):
            frame = size[k] > self.most[k] * size[0] and 2 * main[k] >= main[0]
            noise.append(noise[self.parent[k]] or hard[k] or (self.most[k] > 0 and not frame))
        return hard, noise

    def names(self) -> list[int]:
        """The hash of each element's style path."""
        out = [0]
        for parent, label in zip(self.parent[1:], self.label[1:], strict=True):
            out.append(xxhash.xxh64_intdigest(label, out[parent]))
        return out

    def digests(self) -> tuple[list[int], list[int]]:
        """Of each element the hash of the text below it, 0 if it has none, and the hash of its children's labels."""
        digest, style = [0] * len(self.label), [0] * len(self.label)
        for k in range(len(self.label) - 1, -1, -1):
            parts = [digest[x] if isinstance(x, int) else xxhash.xxh64_intdigest(x) for x in self.items[k]]
            if any(parts):
                digest[k] = xxhash.xxh64_intdigest(b"".join(x.to_bytes(8, "big") for x in parts if x)) or 1
            style[k] = xxhash.xxh64_intdigest(">".join("" if isinstance(x, str) else self.label[x] for x in self.items[k]))
        return digest, style


def _kind(name: str) -> str:
    """What a class or id means as a whole: "comment", "ad", "noise", "weak" (noise outside articles) or nothing."""
    words = {w.lower() for w in WORD.findall(name)}
    told = words - PLACE_WORDS
    if not told or not told <= NOISE_WORDS | WEAK_WORDS | COMMENT_WORDS:
        return ""
    return "comment" if told & COMMENT_WORDS else "ad" if words <= AD_WORDS else "noise" if told & NOISE_WORDS else "weak"


_styles: dict[tuple[str, str], tuple] = {}


def _style(tag: str, attrs: str) -> tuple[str, frozenset[str], str, bool, int]:
    """(label, the kinds of the classes, the kind of the id, whether an attribute rules it out, 2 for main or 1 for a part named as content) of a start tag."""
    if not attrs or attrs.isspace():
        return tag, frozenset(), "", False, 0
    found = _styles.get((tag, attrs))
    if found is None:
        a = {k.lower(): unescape(x or y or z) for k, x, y, z in ATTR.findall(attrs)}
        classes, own = a.get("class", "").split(), a.get("id", "")
        label = re.sub(r"\d+", "N", ".".join([tag, *sorted(classes)]))
        out = "hidden" in a or re.search(r"display\s*:\s*none", a.get("style", "")) is not None or a.get("role", "").lower() in NOISE_ROLES
        joined = {re.sub(r"[^a-z]", "", x.lower()) for x in (*classes, own)} & MAIN_WORDS
        main = 2 if a.get("role") == "main" or "maincontent" in joined else 1 if joined or "articlebody" in a.get("itemprop", "").lower() else 0
        found = label, frozenset(map(_kind, classes)) - {""}, _kind(own), out, main
        if len(_styles) < 50_000 and len(attrs) < 500:
            _styles[tag, attrs] = found
    return found


def _most(tag: str, kinds: frozenset[str], own: str, tier: int) -> float:
    """The most of the page's text that a block may hold and still be no content by its tag and name; 0 if these say nothing."""
    if tag in HARD_TAGS:
        return 1
    if tag in SOFT_TAGS:
        return MOST_FORM
    if tag in UNNAMED:
        return 0
    if tag == "header" and tier < 2:
        return MOST
    if tier < 2:
        kinds = kinds | {own}
    if tag in HALF_NAMED or tag == "article":
        kinds = kinds & {"ad", "comment"}
    if tier == 3:
        kinds = kinds - {"weak"}
    return MOST_COMMENTS if "comment" in kinds else MOST if kinds - {""} else 0


def parsed(html: str) -> Page:
    """The block elements and texts of a page; whatever is open at the end is closed."""
    page = Page()
    stack = [Node("", 0, False, 0)]
    open_: Counter = Counter()
    text: list[str] = []
    plain = said = False  # whether the block has text outside links and buttons, and outside buttons

    def drop(i: int) -> None:
        for n in stack[i:]:
            open_[n.tag] -= 1
        del stack[i:]

    def add(part: str) -> None:
        nonlocal plain, said
        if not stack[-1].lost:
            text.append(part)
            if not open_["button"] and not part.isspace():
                said, plain = True, plain or not open_["a"]

    def flush() -> None:
        nonlocal plain, said
        if text:
            if said and (words := " ".join(unescape("".join(text)).split())):
                top = next(n for n in reversed(stack) if n.tag in BLOCK or not n.tag)
                page.items[top.block].append(words)
                page.texts.append((top.block, words, top.tier, plain))
            text.clear()
            plain = said = False

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            add(html[at:lt])
            at = lt
            continue
        if html.startswith("<!--", at):
            close = html.find("-->", at + 4)
            at = end if close < 0 else close + 3
            continue
        m = TAG.match(html, at)
        if m is None:
            if html.startswith(("<!", "<?", "</"), at) or html[at + 1 : at + 2].isalpha():
                close = html.find(">", at)
                at = end if close < 0 else close + 1
            else:
                add("&lt;")
                at += 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    drop(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # a stray inline end tag closes nothing outside its block
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in RAW:
            close = None
            if not m[3].endswith("/") or tag != "svg":
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(html, at)
                at = end if close is None else close.end()
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and open_["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        drop(i)
                        break
                    if stack[i].tag in P_STOPS:
                        break
            if tag in CLOSES and any(open_[x] for x in CLOSES[tag][0]):
                these, stops = CLOSES[tag]
                cut = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in stops:
                        break
                    if stack[i].tag in these:
                        cut = i
                if cut:
                    drop(cut)
        if tag in VOID:
            continue
        top = stack[-1]
        label, kinds, own, out, main = _style(tag, m[3])
        tier, block, lost = top.tier, top.block, top.lost
        if tag in BLOCK:
            block = page.open(top.block, label, 1 if out else _most(tag, kinds, own, tier))
        else:
            lost = lost or out or tag in LOST_TAGS
        stack.append(Node(tag, block, lost, max(tier, 3 if tag == "article" else 2 if tag == "main" else main)))
        open_[tag] += 1
    flush()
    return page


def main_text(page: Page, low: frozenset[int] = frozenset()) -> str:
    """The blocks of the page's main part, without branches of low importance."""
    gone: list[bool] = []
    if low:
        digests = page.digests()[0]
        for name, digest, parent in zip(page.names(), digests, page.parent, strict=True):
            gone.append(parent >= 0 and (gone[parent] or branch(name, digest) in low))

    hard, noise = page.ruled_out()

    def kept(by_name: bool, by_tree: bool) -> list[tuple]:
        rows = [x for x in page.texts if not (noise if by_name else hard)[x[0]] and not (by_tree and gone and gone[x[0]])]
        return [x for x in rows if x[3] or x[2]]  # outside any main part, links alone are a menu

    rows = kept(True, True) or kept(True, False) or kept(False, True) or kept(False, False)
    total = sum(len(x[1]) for x in rows)
    tiers = {x[2] for x in rows}
    least = next((t for t in sorted(tiers, reverse=True) if t == 2 or sum(len(x[1]) for x in rows if x[2] >= t) >= SHARE * total), 0)
    least = 2 if least == 3 and 2 in tiers else least  # an article's title and lead may stand beside it
    return "\n".join(x[1] for x in rows if x[2] >= least)


def branch(name: int, digest: int) -> int:
    """A content node: a digest at an element."""
    return (name ^ (digest * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) - (1 << 63)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of pages by (host, element, kind, hash): kind 0 is a branch that a page has at the element, 1 a style, 2 the page itself."""
    for batch in batches:
        counts: Counter = Counter()
        for url, html in zip(batch.column(0), batch.column(1), strict=True):
            if (source := html.as_py()) is None:
                continue
            host, page = host_of(url.as_py()), parsed(source)
            digests, styles = page.digests()
            own = set()
            for name, digest, style in list(zip(page.names(), digests, styles, strict=True))[1:]:
                own |= {(name, 1, style), (name, 2, 0)} | ({(name, 0, branch(name, digest) + (1 << 63))} if digest else set())
            counts.update((host, name - (1 << 63), kind, h - (1 << 63)) for name, kind, h in own)
        keys = list(zip(*counts, strict=True)) if counts else [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(keys, kinds, strict=True)), pa.array(list(counts.values()), pa.int64())], ["host", "element", "kind", "h", "n"])


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, element, pages, importance, h, held): the content nodes of low importance, at elements of low importance.

    Elements of fewer than LEAST_PAGES pages are left out. A branch held by n of m pages weighs (1 - log n / log m) GAMMA at least.
    """
    rows = pages.select(F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(tidy(_counted), "host string, element long, kind int, h long, n long")
    each = Cut(rows.groupBy("host", "element", "kind", "h").agg(F.sum("n").alias("n")), "style-counts").df
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    log = F.col("n") * F.ln("n")
    nodes = each.groupBy("host", "element").agg(of(2, F.col("n")).alias("pages"), of(1, F.col("n")).alias("styles"), of(1, log).alias("style_log"), of(0, F.col("n")).alias("texts"), of(0, log).alias("text_log"))
    nodes = nodes.where((F.col("pages") >= LEAST_PAGES) & (F.col("texts") > 0))
    # -sum p log p over the style counts = log s - sum(n log n)/s, in units of log m
    spread = (F.ln("styles") - F.col("style_log") / F.col("styles")) / F.ln("pages")
    content = 1 - F.col("text_log") / (F.col("texts") * F.ln("pages"))
    weight = (1 - GAMMA) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), spread)) + GAMMA * content
    nodes = Cut(nodes.select("host", "element", "pages", weight.alias("importance")), "style-nodes")
    often = each.where((F.col("kind") == 0) & (F.col("n") >= LEAST_PAGES ** (1 - THRESHOLD / GAMMA)))
    low = often.select("host", "element", "h", F.col("n").alias("held"))
    near = nodes.df.where(F.col("importance") < THRESHOLD)
    near = F.broadcast(near) if nodes.small() else near
    found = low.join(near, ["host", "element"]).where((1 - F.ln("held") / F.ln("pages")) * GAMMA < THRESHOLD)
    return found.select("host", "element", "pages", "importance", "h", "held")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row."""
    small_batches(pages.sparkSession)
    with passing() as keep:
        low = keep(Cut(style_tree(pages, url, html).groupBy("host").agg(F.collect_list("h").alias("low")), "low-branches"))
    own = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("x"), own.alias("host"))
    rows = rows.join(small_side(low), "host", "left").select("k", "u", "x", "low", "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, frozenset[int]] = {}  # of the batch's hosts
        for batch in batches:
            texts = []
            for x, low, host in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                if host not in held:
                    held = held if len(held) < 256 else {}
                    held[host] = frozenset(low.as_py() or ())
                texts.append(main_text(parsed(x.as_py() or ""), held[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["k", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"k {kind}, url string, text string, n_chars long").withColumnRenamed("k", key)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html": op2_html}
ORACLES: dict[str, str] = {}
