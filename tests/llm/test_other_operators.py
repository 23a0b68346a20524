"""WARC, token counts, HTML extraction, packing, the language model and the pipeline."""

import base64
import gzip
import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from offerlens.llm import html, lm, packing, queries, tokens, warc
from offerlens.llm.common import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
PAGES = "page_id long, url string, html string, payload string, host string, low int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def pages(spark):
    shared = "<html><body><p>same</p></body></html>"
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<p>page {i} é ü</p>" if i % 4 else shared, "x", "y", 1) for i in range(40)]
    rows += [(50, None, None, None, None, None), (51, "http://x.org/a\nb", "", None, None, None), (None, "http://n.org", shared, None, None, None), (4, "http://h1.org/4", shared, None, None, None), (60, "http://long.org", "<p>" + "long " * 200_000, None, None, None)]
    return spark.createDataFrame(rows, PAGES)


def test_warc_round_trip(spark, pages):
    folder = shared_dir(spark, "warc-test")
    index = warc.write(pages, folder)
    got = warc.read(index, folder).collect()
    want = pages.collect()
    first = {}
    for r in want:
        p = (r.html or "").encode()
        if r.page_id is not None:
            first[p] = min(first.get(p, r.page_id), r.page_id)
    by_digest = {base64.b32encode(hashlib.sha1(p).digest()).decode(): p for p in first}
    assert Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in got) == Counter((r.page_id, base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode(), len((r.html or "").encode())) for r in want)
    for r in got:
        f = first[by_digest[r.payload_digest]]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == f else ("revisit", f))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == by_digest[r.payload_digest]
    some = warc.read(index.filter("url LIKE 'http://h1%'"), folder).collect()
    assert Counter(r.url for r in some) == Counter(r.url for r in want if r.url and r.url.startswith("http://h1"))


def test_warc_reads_in_tasks_by_bytes(spark):
    draw = np.random.default_rng(0)
    rows = [(i, f"http://a.org/{i}", draw.bytes(3000).hex()) for i in range(600)]
    folder = shared_dir(spark, "warc-tasks")
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), folder)
    total = index.agg(F.sum("length")).first()[0]
    tasks = warc.read(index, folder, 20_000, total // 24).select("page_id", F.length("payload").alias("n"), F.spark_partition_id().alias("task")).groupBy("task").agg(F.sum("n").alias("n"), F.count("*").alias("records")).collect()
    assert sum(r.records for r in tasks) == 600 and len(tasks) >= 16 and max(r.n for r in tasks) < 5 * 600 * 6000 / 24
    assert warc.tasks_for(index, 20_000, total) == min(spark.sparkContext.defaultParallelism, -(-total // 20_000) + 2)


def test_warc_record_is_a_gzip_member():
    member, digest = warc.record(7, "http://a.org/", b"<p>x</p>", None, "2024-01-01T00:00:00Z")
    raw = gzip.decompress(member)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"<p>x</p>\r\n\r\n") and f"sha1:{digest}".encode() in raw
    broken, _ = warc.record(7, None, b"abc", None, "d")
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(gzip.decompress(broken).replace(b"abc", b"abd")))


def test_token_counts(docs, rows, tokenizer):
    got = tokens.count_tokens(docs, PATH, block_bytes=20_000, common=4).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


ODD = st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x85\xa0 　\x1c'’st,.0a"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_pre_tokens_add_up(text):
    count = tokens.counter(PATH)
    first, *rest = tokens.pre_tokens(text)
    assert " ".join([first, *rest]) == text
    assert count([first])[0] + sum(count([" " + x for x in rest])) == count([text])[0]


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_encoder_gives_the_library_ids(text):
    assert packing.encoder(PATH)(text + "<|endoftext|>" + text).tolist() == Tokenizer.from_file(PATH).encode(text + "<|endoftext|>" + text, add_special_tokens=False).ids if len(text) < 3 else packing.encoder(PATH)(text).tolist() == _library().encode(text, add_special_tokens=False).ids


def _library(cache=[]):  # noqa: B006
    return cache[0] if cache else cache.append(Tokenizer.from_file(PATH)) or cache[0]


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000])
def test_encoder_of_very_long_white_space(run):
    assert packing.encoder(PATH)("a" + run + "b").tolist() == _library().encode("a" + run + "b", add_special_tokens=False).ids


def test_encoder_over_all_characters_and_the_vocabulary():
    ours, library = packing.encoder(PATH), _library()
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for sep in ("", "a", " "):
        for a in range(0, len(chars), 40_000):
            text = sep.join(chars[a : a + 40_000])
            assert ours(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizer_files(docs, rows, name):
    path = public_tokenizers.path(name)
    got = tokens.count_tokens(docs, path).collect()
    count = tokens.counter(path)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], count([r[1] or ""])[0]) for r in rows)


def packed(rows, tokenizer, got):
    """Holds the pieces against the documents' ids; the number of sequences."""
    want = Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        at, n, k = 0, (len(ids) - 1) % 1024 + 1, 0
        while at < len(ids):
            want[(r[0], k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
            at, n, k = at + n, 1024, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_packing(docs, rows, tokenizer):
    got = packing.pack(docs, PATH).collect()
    least = math.ceil(sum(r.length for r in got) / 1024)
    assert packed(rows, tokenizer, got) <= least * 1.1 + 1
    coarse = packing.pack(docs, PATH, groups=4, small=300).collect()
    assert packed(rows, tokenizer, coarse) < len(coarse)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 1023), st.integers(1, 40), min_size=1, max_size=60), st.integers(1, 80))
def test_plan_places_every_piece_once(histogram, groups):
    plan, sequences = packing.plan_large(histogram, 1024, groups)
    lengths = [x for x in sorted(histogram, reverse=True) for _ in range(histogram[x])]
    room, seen = Counter(), []
    for first, n, sequence, _ in plan.tolist():
        for i in range(n):
            seen.append(first + i)
            room[sequence + i] += lengths[first + i]
    assert sorted(seen) == list(range(len(lengths))) and max(room.values()) <= 1024 and len(room) == sequences


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 128), st.integers(1, 30), max_size=20), st.dictionaries(st.integers(0, 400), st.integers(1, 20), max_size=20))
def test_small_plan_fits(histogram, rooms):
    plan, over = packing.plan_small(histogram, rooms)
    lengths = [x for x in sorted(histogram, reverse=True) for _ in range(histogram[x])]
    left = [x for x in sorted(rooms, reverse=True) for _ in range(rooms[x])]
    placed = []
    for first, n, at, _ in plan.tolist():
        for i in range(n):
            left[at + i] -= lengths[first + i]
            placed.append(first + i)
    assert len(placed) == len(set(placed)) == len(lengths) - sum(over.values()) and min(left, default=0) >= 0


NOISY = """<html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a>Menu</a></ul></nav>
<div class="cookie-notice">Accept</div><!-- <p>gone</p> --><article><h1>Head &amp; &eacute;</h1><p>One <b>bold<br>line</b>
 &nbsp;end<p>Two<ul><li>a<li>b</ul><form>f</form><div class="ad">Buy</div><section id="comments"><p>first!</p></section></article>
<aside>Side</aside><footer>F</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(NOISY) == "Head & é\n\nOne bold line end\n\nTwo\n\na\n\nb"
    assert html.main_text("") == "" and html.main_text("<<<p>a &lt; b") == "<<\n\na < b"
    assert html.main_text("<p>x" * 3000).count("x") == 3000 and html.main_text("<div>" * 3000 + "deep").endswith("deep")


STORY = "The story of a river that nobody crossed for a hundred years, told by those who lived beside it. " * 4


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class=story><p>{STORY}</p></div><div class=teasers><article><h3>Teaser</h3></article></div>", f"{STORY.strip()}\n\nTeaser"), (f"<main><p>Intro.</p></main><div class=story>{STORY}</div>", f"Intro.\n\n{STORY.strip()}"),
        (f"<article><p>{STORY}</p></article><div>Site name</div>", STORY.strip()), ("<article><p>E is <math><mi>m</mi>c</math> and <object>text</object></p></article>", "E is mc and text"),
        ('<article><p>A</p><section class="search"><p>How search works, at length.</p></section><section id="discussion"><h2>Discussion</h2><p>We find that.</p></section><p class="related">Related work is rare.</p><div class="disclaimer">It may rain.</div></article>', "A\n\nHow search works, at length.\n\nDiscussion\n\nWe find that.\n\nRelated work is rare.\n\nIt may rain."),
        (f'<article><p>{STORY}</p><div class="related"><a href=1>One more</a> <a href=2>Another</a></div></article>', STORY.strip()), ('<article><p>A</p><span class="advert">Buy now</span><p>B <a class="share">Share</a>more</p></article>', "A\n\nB more"),
        ('<span class="cookie-notice">We use <b>cookies</b></span><p>A</p>', "A"), ('<p title="a > b">A <a href=x"y>z</a> b="> c</p>', 'A z b="> c'), ("<a title='>' x=\">\" y>in</a>", "in"),
    ],
)
def test_html_keeps_content_and_leaves_inline_noise(page, text):
    assert html.main_text(page) == text


def plain_texts(hosts):
    """The main texts of hosts of pages, given as trees (tag, class, children or text), from the rules as they are stated."""
    noise, doubtful = {"ad", "related"}, {"share-line"}

    def walk(node, path=(), main=False, bad=False):
        tag, cls, below = node
        name = f"{tag}.{'.'.join(sorted(cls.split('-')))}" if cls else tag
        bad = bad or cls in noise and not (main and cls == "related")
        weight = 0.5 if cls in doubtful or cls in noise else 1.0
        main = main or tag == "article"
        kids = [walk(k, (*path, name), main, bad) for k in below] if isinstance(below, list) else []
        text = tuple(k["text"] for k in kids if k["text"]) if isinstance(below, list) else (below,)
        return {"path": (*path, name), "name": name, "bad": bad, "weight": weight, "main": main, "kids": kids, "text": text, "own": None if isinstance(below, list) else below}

    def flat(node):
        yield node
        for k in node["kids"]:
            yield from flat(k)

    out = []
    for pages in hosts:
        trees = [[walk(n) for n in p] for p in pages]
        every = [[x for n in t for x in flat(n)] for t in trees]
        seen, shown = {}, defaultdict(lambda: ([], []))
        mains = {x["path"]: x["main"] for xs in every for x in xs}
        for xs in every:  # a page counts once for each element and variant
            name = tuple(x["own"] for x in xs if x["own"] and not x["bad"])
            for path in dict.fromkeys(x["path"] for x in xs if not x["bad"]):
                of = [x for x in xs if x["path"] == path and not x["bad"]]
                variant = (tuple(tuple(k["name"] for k in x["kids"]) for x in of), tuple(x["text"] for x in of))
                if seen.setdefault((name, path, variant), len(seen)) == len(seen) - 1 and (name, path, variant) not in shown:
                    for where, v in zip(shown[path], variant, strict=True):
                        where.append(v)
                    shown[(name, path, variant)] = ([], [])
        share = lambda some: 1.0 if len(some) <= 1 else 1 - sum(n * math.log(n) for n in Counter(some).values()) / (len(some) * math.log(len(some)))
        entropy = {}
        for path, (looks, reads) in shown.items():
            if looks:
                prior, n = html.PRIOR_MAIN if mains[path] else html.PRIOR, len(looks)
                entropy[path] = (prior + n * (0.3 * share(looks) + 0.7 * share(reads))) / (prior + n)
        for tree, xs in zip(trees, every, strict=True):
            size = lambda x: 0 if x["bad"] and x["own"] else len(x["own"]) if x["own"] else sum(map(size, x["kids"]))
            whole, held = sum(map(size, tree)), Counter()
            for x in xs:
                held[x["path"]] += size(x)

            def kept(x):
                if x["bad"] or x["weight"] * min(entropy.get(x["path"], 1.0), 1.0) < html.LOW and held[x["path"]] < 0.9 * whole:
                    return []
                return [(x["own"], x["main"])] if x["own"] else [t for k in x["kids"] for t in kept(k)]

            texts = [t for x in tree for t in kept(x)]
            inside, outside = (sum(len(t) for t, main in texts if main is side) for side in (True, False))
            out.append("\n\n".join(t for t, main in texts if main or not inside or outside > inside))
    return out


def test_html_text_by_plain_rules(spark):
    """Random hosts whose pages share menus, notices and phrases: all of the text against the rules, entropy included."""
    import random

    draw = random.Random(11)
    phrases = ["always the same words", "a line that comes back", "more"]

    def node(depth, page):
        cls = draw.choice(["", "", "", "x", "y", "ad", "related", "share-line"])
        if depth > 2 or draw.random() < 0.4:
            return ("p", cls, draw.choice([*phrases, f"story {page} {draw.randrange(50)}", f"page {page} tells {'so ' * draw.randrange(9)}much"]))
        return (draw.choice(["div", "section", "article"]) if depth == 0 else "div", cls, [node(depth + 1, page) for _ in range(draw.randrange(1, 4))])

    def markup(n):
        tag, cls, below = n
        return f"<{tag}{f' class={cls}' if cls else ''}>{''.join(map(markup, below)) if isinstance(below, list) else below}</{tag}>"

    frame = [node(0, "same") for _ in range(2)]
    hosts = [[[*frame, *(node(0, n) for _ in range(draw.randrange(1, 4)))] for n in range(size)] for size in (90, 25, 3)]
    rows = [(len(hosts[0]) * 10 * h + n, f"http://h{h}.org/{n}", "".join(map(markup, p))) for h, pages in enumerate(hosts) for n, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = dict(zip([r[0] for r in rows], plain_texts(hosts), strict=True))
    assert got == want
    without = {r[0]: html.main_text(r[2]) for r in rows}
    assert sum(without[k] != got[k] for k in got) > 10  # entropy decides


def test_html_quotes_in_linear_time():
    for page in ('<a "> y" z ', '<a b="> y" z ', "<a b='> y\" z ", '<p b="x>y'):
        began = time.monotonic()
        html.main_text(page * (1_000_000 // len(page)))
        assert time.monotonic() - began < 20, page


def test_html_style_tree_removes_what_repeats(spark):
    page = lambda i: f"<html><body><div class=box><p>Always the same words.</p></div><div class=story><p>Story {i} {'x' * i}</p></div></body></html>"
    pages = spark.createDataFrame([(i, f"https://u@Same.org:8{i}/{i}", page(i)) for i in range(12)] + [(99, "https://other.org/", page(3))], "page_id long, url string, html string")
    for rows in (10_000, 0):  # broadcast, and joined by shuffle
        got = {r.page_id: r for r in html.extract(pages, broadcast_rows=rows).collect()}
        assert all(got[i].text == f"Story {i} {'x' * i}".strip() for i in range(12)) and got[99].text == "Always the same words.\n\nStory 3 xxx"
        assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize("copies", [5, 85])
def test_html_copies_without_article_keep_their_text(spark, copies):
    page = lambda i: f"<html><body><div class=top><p>Site</p></div><div class=story><p>Story {i} {'long words ' * 30}</p></div></body></html>"
    pages = spark.createDataFrame([(i, "https://same.org/", page(0)) for i in range(copies)] + [(100 + i, "https://same.org/", page(i)) for i in range(1, 4)], "page_id long, url string, html string")
    got = html.extract(pages).collect()
    assert len(got) == copies + 3 and all(f"Story {max(0, r.page_id - 100)} long words" in r.text for r in got)


def test_html_class_words_beside_others_drop_nothing_alone():
    page = '<article><div class="post-header"><h1>Title</h1></div><p>Body</p><p class="share-price">12</p><div class="share-buttons">Share</div><div class="user-comments">Me too</div></article>'
    assert html.main_text(page) == "Title\n\nBody\n\n12"


def test_html_entropy_decides_inside_articles(spark):
    page = lambda i: f"<article><p>Story {i}</p><div class=share-line><p>Tell your friends</p></div><section><p>Always the same end.</p></section></article>"
    rows = [(i, "http://many.org/", page(i)) for i in range(40)] + [(100 + i, "http://few.org/", page(i)) for i in range(3)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}" for i in range(40))
    assert all(got[100 + i] == f"Story {i}\n\nTell your friends\n\nAlways the same end." for i in range(3))


def test_html_copies_with_other_noise_count_once(spark):
    page = lambda i: f"<div class=ad>Buy {i}</div><div class=story><p>One story that forty pages have.</p></div><div class=more><p>Short</p></div>"
    got = html.extract(spark.createDataFrame([(i, "http://a.org/", page(i)) for i in range(40)], "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"One story that forty pages have.\n\nShort"}


def plain_tree(pages):
    """(host, n, presentation, content) of each element, from a tree built by the standard library's parser."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.nodes, self.text = [[(), [], []]], [], []

        def handle_starttag(self, tag, attrs):
            name = f"{tag}.{dict(attrs).get('class', '')}"
            self.stack[-1][1].append(name)
            self.stack.append([(*self.stack[-1][0], name), [], []])

        def handle_endtag(self, tag):
            node = self.stack.pop()
            self.nodes.append(node)
            if node[2]:
                self.stack[-1][2].append(tuple(node[2]))

        def handle_data(self, data):
            self.stack[-1][2].append(data)
            self.text.append(data)

    seen = defaultdict(set)
    for host, page in pages:
        t = Tree()
        t.feed(page)
        merged = defaultdict(lambda: ([], []))
        for path, kids, text in t.nodes:
            merged[path][0].append(tuple(kids))
            merged[path][1].append(tuple(text))
        for path, (kids, text) in merged.items():
            seen[host, path].add((tuple(t.text), tuple(kids), tuple(text)))
    entropy = lambda xs: 1.0 if len(xs) < 2 else -sum(k / len(xs) * math.log(k / len(xs)) for k in Counter(xs).values()) / math.log(len(xs))
    return [(host, len(v), round(entropy([x[1] for x in v]), 9), round(entropy([x[2] for x in v]), 9)) for (host, _), v in seen.items()]


def test_html_importance_by_a_plain_tree(spark):
    import random

    draw = random.Random(2)

    def node(depth):
        if depth == 3 or draw.random() < 0.3:
            return f"<p>{draw.choice('abc')}</p>"
        return f"<div class={draw.choice(['x', 'y'])}>{''.join(node(depth + 1) for _ in range(draw.randrange(1, 4)))}</div>"

    pages = [(f"h{draw.randrange(3)}.org", f"<section>{node(0)}{node(1)}</section>") for _ in range(120)]
    got = html.importance(spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")).collect()
    assert Counter((r.host, r.n_pages, round(abs(r.presentation), 9), round(abs(r.content), 9)) for r in got) == Counter((h, n, abs(a), abs(b)) for h, n, a, b in plain_tree(pages))
    assert all(r.entropy == pytest.approx((1 + r.n_pages * (0.3 * r.presentation + 0.7 * r.content)) / (1 + r.n_pages)) for r in got)


LONG = {"open": "<div>x" * 50_000, "inline": "<div><span>x" * 30_000 + "</b>" * 30_000, "quote": '<a "x' * 100_000, "quotes": '<a "x>' * 100_001, "comments": "<!--" * 100_000, "raw": "<svg>" * 100_000, "barrier": "<i><article>" + "<div>" * 50_000 + "</i>" * 50_000, "less": "<" * 1_000_000}


@pytest.mark.parametrize("name", list(LONG))
def test_html_long_malformed_pages(name):
    began = time.monotonic()
    text = html.main_text(LONG[name])
    assert html.variants(LONG[name]) is not None and time.monotonic() - began < 20
    assert text.count("x") == LONG[name].count("x") if name in ("open", "inline", "quote") else True


def test_html_rows(pages):
    got = html.extract(pages).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r.page_id, r.url) for r in pages.select("page_id", "url").collect())
    assert {r.text for r in got if r.page_id in (50, 51)} == {""}


SIZE = lm.CLASSES * lm.IN_CLASS


def test_gradients_by_difference():
    draw = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm.start(np.ones(SIZE, np.int64)).items()}
    p["peep"] += draw.standard_normal(lm.WIDTH)
    inputs, targets = draw.integers(0, SIZE, (5, 3)), draw.integers(0, SIZE, 15)
    keep, h = np.ones((5, 3)), draw.standard_normal((3, lm.WIDTH)) * 0.1
    keep[2, 1] = 0

    def loss():
        return -float(lm.log_probabilities(p, lm.forward(p, inputs, keep, h)[0].reshape(-1, lm.WIDTH), targets).astype(np.float64).sum())

    states, trail = lm.forward(p, inputs, keep, h)
    _, gs, grads = lm.log_probabilities(p, states.reshape(-1, lm.WIDTH), targets, back=True)
    grads |= lm.backward(p, inputs, keep, trail, gs.reshape(states.shape))
    c, x = int(targets[0]) // lm.IN_CLASS, int(inputs[0, 0])
    for name, at in (("peep", (3,)), ("peep", (12,)), ("wc", (4, c)), ("wc", (lm.WIDTH, 9)), ("ww", (c, 3, int(targets[0]) % lm.IN_CLASS)), ("ww", (c, lm.WIDTH, 1)), ("gate", (x, 5)), ("value", (x, 5)), ("value", (int(inputs[1, 1]), 2))):
        eps, kept = 1e-2, p[name][at]
        p[name][at] = kept + eps
        up = loss()
        p[name][at] = kept - eps
        down = loss()
        p[name][at] = kept
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=5e-3), name


def test_state_is_carried_over_windows():
    p = lm.start(np.ones(SIZE, np.int64))
    draw, end = np.random.default_rng(1), 7
    texts = [np.append(draw.integers(8, SIZE, n), end).astype(np.uint16) for n in (0, 3, 15, 16, 17, 100, 333)]
    got = lm.score_block(p, texts)
    for text, s in zip(texts, got, strict=True):
        inputs = np.append(end, text[:-1])[:, None].astype(np.int32)
        keep = np.ones((len(text), 1), np.float32)
        states, _ = lm.forward(p, inputs, keep, np.zeros((1, lm.WIDTH), np.float32))
        assert s == pytest.approx(float(lm.log_probabilities(p, states[:, 0], text.astype(np.int32)).sum()), rel=1e-4)


@pytest.mark.parametrize("width_of_logits", [1.0, 60.0])
def test_model_is_a_distribution(width_of_logits):
    p = lm.start(np.arange(SIZE))
    states = (np.random.default_rng(2).standard_normal((1, lm.WIDTH)) * width_of_logits).astype(np.float32).repeat(SIZE, axis=0)
    got = lm.log_probabilities(p, states, np.arange(SIZE)).astype(np.float64)
    assert float(np.exp(got).sum()) == pytest.approx(1, abs=1e-4)
    exact = lm.log_probabilities({k: v.astype(np.float64) for k, v in p.items()}, states.astype(np.float64), np.arange(SIZE))
    assert np.abs(got - exact).max() < 0.25  # exponentials are linear between powers of two


def test_scoring_reads_many_rows_at_a_time(monkeypatch):
    draw, rows = np.random.default_rng(3), []
    plain = lm.exponents
    monkeypatch.setattr(lm, "exponents", lambda x, *more: rows.append(len(x)) or plain(x, *more))
    texts = [np.append(draw.integers(8, SIZE, 300), 7).astype(np.uint16) for _ in range(700)]
    lm.score_block(lm.start(np.ones(SIZE, np.int64)), texts)
    assert sum(rows) == 2 * 700 * 301 and len(rows) < 700  # windows of 16,384 tokens took over 1,000 products


@pytest.mark.parametrize("size", [0.1, 1.0, 4.0, 30.0])
def test_logits_that_surely_lie_within_need_no_cut(size):
    draw = np.random.default_rng(5)
    x, w = (draw.standard_normal(s).astype(np.float32) * np.float32(size) for s in ((50, lm.WIDTH + 1), (3, lm.WIDTH + 1, 20)))
    x[:, -1] = 1
    logits = np.abs(x @ w).max()
    assert lm.surely_within(x, w) == {0.1: True, 1.0: True}.get(size, False) and (logits < 59 or not lm.surely_within(x, w))
    w[1, 2, 3] = np.nan
    assert not lm.surely_within(x, w)
    if size == 1.0:
        assert (lm.exponents(x, lm.scaled(w[0]), True) == lm.exponents(x, lm.scaled(w[0]), False)).all()


def test_packed_numbers():
    packed = pa.array([np.array(x, "<u4").tobytes() for x in ([9], [1, 2], [], [3, 1 << 31])], pa.binary())
    assert lm.numbers_of(packed.slice(1)).tolist() == [1, 2, 3, 1 << 31] and lm.numbers_of(packed.slice(4)).tolist() == lm.numbers_of(pa.array([], pa.binary())).tolist() == []


def test_training_by_a_plain_step():
    """Windows that are full and such that are not, against Adagrad written out in double precision."""
    draw, counts = np.random.default_rng(6), np.arange(SIZE)[::-1]
    texts = [np.append(draw.integers(8, SIZE, n), 7).astype(np.uint16) for n in (31, 31, 80, 3)]
    p = lm.start(counts)
    seen = {k: np.full_like(v, 1e-4) for k, v in p.items()}
    q, total = ({k: v.astype(np.float64) for k, v in x.items()} for x in (p, seen))
    assert lm.train_block(p, seen, texts) == sum(map(len, texts))
    state, tokens = np.zeros((lm.LANES, lm.WIDTH)), 0
    for inputs, targets, keep, text in lm.windows(texts):
        states, trail = lm.forward(q, inputs, keep, state[: inputs.shape[1]])
        state, inside = states[-1], text.ravel() >= 0
        tokens += inside.sum()
        _, some, grads = lm.log_probabilities(q, states.reshape(-1, lm.WIDTH)[inside], targets.ravel()[inside], back=True)
        gs = np.zeros((inputs.size, lm.WIDTH))
        gs[inside] = some
        grads |= lm.backward(q, inputs, keep, trail, gs.reshape(states.shape))
        norm = np.sqrt(sum((g**2).sum() for g in grads.values())) / inside.sum()
        for k, g in grads.items():
            g = g / inside.sum() * min(1, lm.CLIP / (norm + 1e-9))
            total[k] += g**2
            q[k] -= lm.RATE * g / (np.sqrt(total[k]) + 1e-6)
    assert tokens == sum(map(len, texts)) and all(np.abs(p[k] - q[k]).max() < 0.02 for k in p)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85\xa0\u3000AaÄé.9"), max_size=20)), max_size=5))
def test_words_of_texts(texts):
    words, size = lm.listed_words(pa.array(texts, pa.string()))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for t in texts]
    assert words.to_pylist() == [w for x in want for w in x] and size.tolist() == [len(x) for x in want]


def test_shapes_of_words():
    words = ["a", "", "xion,", "fion,", "on,", "a12", "a99", "é", "1"]
    got = lm.shapes_of(pa.array(["skipped", *words], pa.large_string()).slice(1))
    assert got[2] == got[3] == got[4] and got[5] == got[6] and len(set(got.tolist())) == 6 and all(lm.shapes_of(pa.array([w], pa.large_binary()))[0] == s for w, s in zip((w.encode() for w in words), got, strict=True))


def test_rounds_grow_with_the_corpus():
    got = [lm.rounds_of(n) for n in (0, 1, 4 << 20, 8 << 20, 1 << 30, 1 << 40)]
    assert got == sorted(got) and got[0] == 2 and got[-1] == 20


def test_lm_scores(spark, docs, rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(lower)) + [None] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    c = Counter(w for x, h in zip(words, held, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 4)) for r, x, h in zip(rows, words, held, strict=True))
    got = lm.learn_and_score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_shares_are_a_distribution(spark, docs):
    of = lm.entries(counts := lm.count_words(docs))
    rows = [(bytes(r.word), r.n) for r in counts.filter("word IS NOT NULL").collect()]
    inside = Counter()
    for w, n in rows:
        place = of.known.index(w).as_py()
        e = int(of.entry[place]) if of.entry[place] >= 0 else int(of.of_shape[lm.shapes_of(pa.array([w], pa.large_binary()))[0]])
        inside[e] += 10 ** (math.log10(n + 1) - of.share[e]) if of.share[e] else 1
    assert all(0 < x <= 1 + 1e-9 for x in inside.values()) and of.counts.sum() == of.train_tokens and (np.diff(of.counts) <= 0).all()


def test_lm_beats_word_frequencies_on_held_out_texts(spark):
    draw = np.random.default_rng(4)
    chain = {w: draw.choice(200, 3) for w in range(200)}
    rows = []
    for i in range(1500):
        w, text = int(draw.integers(200)), []
        for _ in range(120):
            text.append(f"w{w}")
            w = int(draw.choice(chain[w]))
        rows.append((i, " ".join(text)))
    got = lm.learn_and_score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1]


def test_lm_beats_word_frequencies_on_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.learn_and_score(documents).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.96 * got[1]


def test_lm_score_by_a_plain_evaluation(spark, monkeypatch):
    """From text to number, token by token in double precision, with the weights and entries that were learnt."""
    draw, made = np.random.default_rng(7), {}
    vocabulary = [f"{a}{b}" for a in "stone river light paper green seven house small quick market".split() for b in ["", "s", "ing", "ed7", "é", *range(40)]]
    texts = [" ".join(draw.choice(vocabulary, int(draw.integers(0, 90)), p=None)) for _ in range(600)] + [None, "", " \t\n", "unseen wörds only 123 x", "STONE " * 3000, "a\u00a0b c\x85d"]
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda parts, of: made.setdefault("weights", made.setdefault("of", of) and train(parts, of)))
    got = {r.doc_id: r for r in lm.learn_and_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    of, p = made["of"], {k: v.astype(np.float64) for k, v in made["weights"].items()}
    lower = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
    counts = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in words_of(t))
    place = {bytes(w.as_py()): i for i, w in enumerate(of.known)}

    def entry(word):
        raw = word.encode()
        if of.entry[place.get(raw, -1)] >= 0 and raw in place:
            return int(of.entry[place[raw]])
        key = 0
        for back in (1, 2, 3):
            key = key << 8 | ((48 if 48 <= raw[-back] <= 57 else raw[-back]) if back <= len(raw) else 0)
        return int(of.of_shape[(key * 0x9E3779B97F4A7C15 % 2**64 >> 40) % lm.SHAPES])

    def positive(logits):
        t = np.clip(logits, -80, 60) / math.log(2)
        return np.exp2(np.floor(t)) * (1 + t - np.floor(t))

    def plain(text):
        h, before, total = np.zeros(lm.WIDTH), of.end, 0.0
        for word in [*words_of(text), None]:
            z = 1 / (1 + np.exp(-(p["gate"][before] + p["peep"] * h)))
            h = h + z * (p["value"][before] - h)
            at = of.end if word is None else entry(word)
            x = np.append(h, 1)
            for e, i in ((positive(x @ p["wc"]), at // lm.IN_CLASS), (positive(x @ p["ww"][at // lm.IN_CLASS]), at % lm.IN_CLASS)):
                total += math.log10(e[i] / e.sum())
            if word is not None and of.share[at] > 0:
                total += math.log10(counts[word] + 1) - of.share[at]
            before = at
        return total

    for i in [*range(0, 600, 12), *range(600, len(texts))]:
        assert got[i].score == pytest.approx(plain(texts[i]), rel=2e-4, abs=2e-3), i
        assert got[i].n_tokens == len(words_of(texts[i])) + 1


def test_lm_without_training_texts(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    got = lm.learn_and_score(spark.createDataFrame([(i, "a few words") for i in held], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(i, 4, 0, 0, 0.0) for i in held}
    assert all(r.held_out and math.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.parametrize("run", [lambda d: tokens.count_tokens(d, PATH), lambda d: packing.pack(d, PATH), lambda d: lm.learn_and_score(d)])
def test_empty_documents(empty, run):
    assert run(empty).collect() == []


@pytest.mark.parametrize("run", [lambda d: warc.archive(d), lambda d: html.extract(d)])
def test_empty_pages(spark, run):
    assert run(spark.createDataFrame([], PAGES)).collect() == []


def test_pipeline_stages(spark, docs, rows, tokenizer):
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, frame, "")
        assert kept.columns == docs.columns, name
        path = shared_dir(spark, "stage")
        kept.write.parquet(path)
        frame = spark.read.parquet(path)
        if name != "mixing":
            assert not Counter(map(tuple, frame.collect())) - Counter(rows)
    left = [tuple(r) for r in frame.collect()]
    packed(left, tokenizer, corpus_pipeline.STAGES[-1][1](spark, frame, "").collect())
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" in queries.QUERIES
