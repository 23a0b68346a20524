"""HTML extraction by site style trees.

Pages of a host are merged into one tree: an element is known by its path of tags, classes and ids from the body down. For
each element of a host the distinct pages are counted that show it with each presentation (sequence of child tags) and with each
content (hash of its text); pages of one host with the same text outside noise are copies and count once. The entropy of these
counts, as a share of the most it can be over the element's n pages, is 0 for what looks and reads the same everywhere and 1 for what
differs on every page. An element's importance is

    weight * (prior + n * (PRESENTATION * entropy of presentation + (1 - PRESENTATION) * entropy of content)) / (prior + n)

and what has an importance below ``LOW`` is removed from each page with all below it, inside articles too.

* The prior stands for so many pages on which the element was important: ``PRIOR`` (``PRIOR_MAIN`` in ``article`` or ``main``), so
  on a small host little is removed, and in an article only what many pages repeat.
* The weight comes from the presentation: entropy can't tell content from a menu or advert that reads differently on every page.
  Tags, roles and class names that stand for navigation, adverts, forms, comments and so on weigh ``NOISE``, which is
  removed always, inline too; a class name that has such a word beside others (``share-price``) weighs ``DOUBTFUL``, so entropy decides; all else 1.
* Within ``article`` and ``main`` words that name content too (``BOTH_WAYS``) only make a branch doubtful. A doubtful branch goes if half of its text is links.
* If a page has an ``article`` or ``main`` with text that stays, text outside goes, unless that is more than ``OUTSIDE`` times as long (then the articles
  are teasers, or the page's story stands beside them). A branch with nearly all of a page's text outside noise is never removed from it.
* Text of inline elements of noise (an advert in a ``span``, a link to share) is left out of the block around it.

The counts are partial sums by (host, element, variant), so a host with a third of all pages is no large group. The table of
elements of low entropy is broadcast only if it proves to be small; else it is joined to the pages' elements by shuffle.

Defined results: a null or empty html has the empty text; a null url is a host of its own; rows that repeat are extracted
each; an empty table gives an empty result. Malformed markup is read as far as it goes: unclosed elements end with the page, a tag whose quote is
never closed ends at its first ``>``, and what has none is text. Time and memory are linear in a page's length. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

LOW, PRESENTATION, NEARLY_ALL = 0.2, 0.3, 0.9
NOISE, DOUBTFUL, OUTSIDE = 0.1, 0.5, 1.0
PRIOR, PRIOR_MAIN = 1, 4
BROADCAST_ROWS = 200_000

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
MARKUP = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)>|([^>]*+)>)|[!?][^>]*+>)")
#: For the rest of a page after a tag whose quotes swallow all further ``>``: values hold no ``<``, so a scan ends at the next tag.
BROKEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)(?:((?:[^<>\"'=]++|=\s*+(?:\"[^\"<]*+\"|'[^'<]*+'|)|[\"'])*+)>|([^>]*+)>)|[!?][^>]*+>)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKEN = re.compile(r"[a-z]+")
# Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg select button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog head".split())
MAIN_TAGS = frozenset("article main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer "
    "topbar toolbar cookie cookies consent notice notification popup modal newsletter subscribe signup login search share sharing social related "
    "recommended comment comments reply replies respond disqus discussion pagination pager copyright legal disclaimer widget skip hidden".split()
)
#: Of these, words that name content too: within articles a branch so called is doubtful, and goes without question only if most of its text is links.
BOTH_WAYS = frozenset("search related recommended discussion copyright legal disclaimer reply replies menu side widget skip notification".split())
#: Noise outside articles only, where they are the site's own.
SITE_WORDS = frozenset("header masthead".split())
#: Words that say nothing beside a noise word in a class name.
FILLING = frozenset("area bar block box buttons button container content form global group inner item items left link links list main outer page posts right row section site slot top bottom user wrap wrapper".split())
BARRIERS = frozenset("table article main body".split())
ENDS_P = BLOCK - {"body"}
#: An opening tag ends open elements of these names, up to the nearest of those.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
key = xxhash.xxh64_intdigest


def label(tag: str, attributes: str, in_main: bool) -> tuple[str, float]:
    """An element's name in the style tree, and the weight of its presentation."""
    weight, words, name = NOISE if tag in NOISE_TAGS or tag == "header" and not in_main else 1.0, [], tag
    if attributes.strip(" /"):
        noise = NOISE_WORDS if in_main else NOISE_WORDS | SITE_WORDS
        for m in ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "role":
                weight = NOISE if value in NOISE_ROLES else weight
            elif kind in ("hidden", "aria-hidden"):
                weight = NOISE if value != "false" else weight
            else:
                for one in value.split():
                    parts = TOKEN.findall(one)
                    words += parts
                    if tag not in ("body", "html") and not noise.isdisjoint(parts):
                        sure = all(x in noise or x in FILLING for x in parts) and not (in_main and all(x in BOTH_WAYS or x in FILLING for x in parts))
                        weight = min(weight, NOISE if sure else DOUBTFUL)
        name = f"{tag}.{'.'.join(sorted(words))}"
    return name, weight


class Element:
    """``kids`` and ``text`` are running hashes of the child tags and of the text below; ``mute``: an inline element of noise, or within one."""

    __slots__ = ("tag", "path", "parent", "weight", "noise", "main", "mute", "kids", "text", "held", "linked")

    def __init__(self, tag: str, path: int, parent: Element | None, weight: float, main: bool):
        self.tag, self.path, self.parent, self.weight, self.main = tag, path, parent, weight, main
        self.noise = parent is not None and parent.noise or weight < LOW
        self.mute = tag not in BLOCK and parent is not None and (parent.mute or weight < LOW)
        self.kids = self.text = self.held = self.linked = 0


def walk(html: str) -> tuple[list[Element], list[tuple[str, Element]]]:
    """The elements of a page in the order they begin, and its blocks of text with the element they stand in; text of inline noise is in none."""
    top = Element("", 0, None, 1.0, False)
    stack, elements, blocks, parts, linked, markup = [top], [], [], [], [0], MARKUP
    open_at: defaultdict[str, list[int]] = defaultdict(list)  # places on the stack by tag; "#" those of blocks, "|" those of barriers

    def add(text: str) -> None:
        if not stack[-1].mute:
            parts.append(text)
            if open_at["a"]:
                linked[0] += len(text)

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            stack[-1].linked += min(linked[0], len(text))
            linked[0] = 0
            if text:
                blocks.append((text, stack[-1]))
                stack[-1].text = key(f"{stack[-1].text:x}{text}")

    def close(upto: int) -> None:
        if open_at["#"] and open_at["#"][-1] >= upto:
            flush()
        while len(stack) > upto:
            e = stack.pop()
            open_at[e.tag].pop()
            if e.tag in BLOCK:
                open_at["#"].pop()
            if e.tag in BARRIERS:
                open_at["|"].pop()
            if e.text:
                stack[-1].text = key(f"{stack[-1].text:x}{e.text:x}")

    def last(*tags: str) -> int:
        return max((open_at[t][-1] for t in tags if open_at[t]), default=0)

    at, last_end, unended = 0, html.rfind(">"), set()
    while (m := markup.search(html, at, last_end + 1)) is not None or (m := COMMENT.search(html, at)) is not None:
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m.re is COMMENT:
            continue
        if m[2] is None:
            if m[0] == "<!--":
                at = COMMENT.match(html, m.start()).end()
            continue
        tag, attributes = m[2].lower(), m[3] if m[3] is not None else m[4]
        if m[3] is None:
            markup = BROKEN
        if m[1]:
            i = last(tag)
            if i and (tag in BARRIERS or tag == "html" or i > last("|")):
                close(i)
            continue
        if tag == "br" or tag in ("td", "th"):
            add(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = None
            if not attributes.endswith("/") and tag not in unended:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(html, at, last_end + 1)
                if end is None:
                    unended.add(tag)  # nor will a later one of its kind be
            if end:
                at = end.end()
            elif tag in ("script", "style") and not attributes.endswith("/"):
                at = len(html)
            continue
        if tag in ENDS_P and open_at["p"] and open_at["p"][-1] == open_at["#"][-1]:
            close(open_at["p"][-1])
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            if (i := last(*ends)) > last(*stops):
                close(i)
        if tag in BLOCK:
            flush()
        if tag == "body" and open_at["head"]:
            close(open_at["head"][0])
        parent = stack[-1]
        name, weight = label(tag, attributes, parent.main)
        parent.kids = key(f"{parent.kids:x} {name}")
        if tag not in BLOCK and weight == 1:
            name = "i"  # inline elements share a name: their kind isn't the page's structure
        e = Element(tag, key(f"{parent.path:x}>{name}") >> 1, parent, weight, parent.main or tag in MAIN_TAGS)
        elements.append(e)
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        open_at[tag].append(len(stack))
        if tag in BLOCK:
            open_at["#"].append(len(stack))
        if tag in BARRIERS:
            open_at["|"].append(len(stack))
        stack.append(e)
    if at < len(html):
        add(html[at:])
    flush()
    close(1)
    return elements, blocks


def variants(html: str) -> list[tuple[int, int, int, int, bool]]:
    """(page, element, presentation, content, in main) of a page, elements of one path merged; the page is known by its text outside noise."""
    elements, blocks = walk(html)
    page = key("\n".join(text for text, e in blocks if not e.noise)) >> 1
    merged: dict[int, list] = {}
    for e in elements:
        if e.tag in BLOCK and not e.noise:
            at = merged.setdefault(e.path, [0, 0, e.main])
            at[0], at[1] = key(f"{at[0]:x}<{e.kids:x}"), key(f"{at[1]:x}<{e.text:x}")
    return [(page, path, kids >> 1, text >> 1, main) for path, (kids, text, main) in merged.items()]


def main_text(html: str, entropy: dict[int, float] | None = None) -> str:
    """The main text of a page; ``entropy`` has the elements (with the prior's part) that have less than the most."""
    entropy, (elements, blocks) = entropy or {}, walk(html)
    whole = 0
    for text, e in blocks:
        if not e.noise:
            e.held += len(text)
            whole += len(text)
    held: defaultdict[int, int] = defaultdict(int)
    for e in reversed(elements):
        e.parent.held += e.held
        e.parent.linked += e.linked
        held[e.path] += e.held
    gone = set()
    for e in elements:
        links = e.weight < 1 and e.tag in BLOCK and 2 * e.linked >= e.held > 0
        if e.noise or e.parent in gone or (links or e.weight * entropy.get(e.path, 1.0) < LOW) and held[e.path] < NEARLY_ALL * whole:
            gone.add(e)
    kept = [(text, e) for text, e in blocks if e not in gone]
    inside, outside = (sum(len(text) for text, e in kept if e.main is main) for main in (True, False))
    if inside and outside <= OUTSIDE * inside:
        kept = [x for x in kept if x[1].main]
    return "\n\n".join(text for text, _ in kept)


def host_of(pages: DataFrame):
    return F.lower(F.regexp_extract(F.coalesce(pages["url"].cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def importance(pages: DataFrame) -> DataFrame:
    """host, element, n_pages, presentation, content and entropy (with the prior's part) of every element outside noise of every host's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                rows = [(h, *v) for h, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for v in variants(html or "")]
                kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["host", "page", "element", "presentation", "content", "main"])

    found = pages.select(host_of(pages).alias("host"), pages["html"].cast("string").alias("html")).mapInArrow(run, "host string, page long, element long, presentation long, content long, main boolean").distinct()
    kinds = F.explode(F.array(F.struct(F.lit("p").alias("kind"), F.col("presentation").alias("v")), F.struct(F.lit("c").alias("kind"), F.col("content").alias("v"))))
    counts = found.select("host", "element", "main", kinds.alias("x")).groupBy("host", "element", "x.kind", "x.v").agg(F.count("*").alias("n"), F.max("main").alias("main"))
    share = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n") * F.log("n")).otherwise(0.0))
    pages_of = F.sum(F.when(F.col("kind") == "p", F.col("n")).otherwise(0))
    per = counts.groupBy("host", "element").agg(pages_of.alias("n_pages"), share("p").alias("_p"), share("c").alias("_c"), F.max("main").alias("main"))
    entropy = lambda c: F.when(F.col("n_pages") <= 1, 1.0).otherwise(1 - F.col(c) / (F.col("n_pages") * F.log("n_pages")))
    per = per.select("host", "element", "n_pages", entropy("_p").alias("presentation"), entropy("_c").alias("content"), F.when(F.col("main"), F.lit(PRIOR_MAIN)).otherwise(PRIOR).alias("_prior"))
    composite = PRESENTATION * F.col("presentation") + (1 - PRESENTATION) * F.col("content")
    return per.withColumn("entropy", (F.col("_prior") + F.col("n_pages") * composite) / (F.col("_prior") + F.col("n_pages"))).drop("_prior")


def extract(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    low = staged(importance(pages).filter(F.col("entropy") < LOW / DOUBTFUL).select("host", "element", "entropy"), "low-elements")
    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"), host_of(pages).alias("host"))
    listed = F.collect_list(F.struct("element", "entropy")).alias("low")  # no more than a page's elements
    table: dict[str, dict[int, float]] = {}
    if low.limit(broadcast_rows + 1).count() <= broadcast_rows:
        for r in low.toLocalIterator():
            table.setdefault(r.host, {})[r.element] = r.entropy
        given = slim.select("page_id", "url", "html", F.lit(None).cast("array<struct<element:bigint,entropy:double>>").alias("low"), "host")
    else:
        rows = staged(slim.withColumn("row", F.monotonically_increasing_id()), "page-rows")

        def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(r, h, p) for r, h, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for p in {e.path for e in walk(html or "")[0] if not e.noise}]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, [pa.int64(), pa.string(), pa.int64()], strict=True)], ["row", "host", "element"])

        of_page = rows.select("row", "host", "html").mapInArrow(elements, "row long, host string, element long").join(low, ["host", "element"])
        given = rows.join(of_page.groupBy("row").agg(listed), "row", "left").select("page_id", "url", "html", "low", "host")
    hosts = pages.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = hosts.value
            texts = [main_text(html or "", known.get(host) or {x["element"]: x["entropy"] for x in low or ()}) for html, low, host in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
