"""Pivot index, conversation trie and ranked search against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from offerlens.llm import pivots, prefixes, ranked

VECTORS = "vec_id long, embedding array<float>, label int, id long, w int, unit string, points int, root int, key int"
TURNS = "conv_id long, turn long, role string, text string, base int, place int, d0 int, lo int, ends int"
DOCS = "doc_id long, text string, n int, terms int, score int, rank int, item int"


def turned(x, cosine, draw):
    u = draw.normal(size=len(x))
    u -= (u @ x) * x
    return cosine * x + math.sqrt(1 - cosine**2) * u / np.linalg.norm(u)


@pytest.fixture(scope="module")
def vectors():
    """Near pairs close to the threshold, a chain, a group of near copies, exact and scaled copies, odd values, repeated and null ids."""
    draw = np.random.default_rng(3)
    out = []

    def add(v, label=0, vec_id=None):
        out.append((len(out) if vec_id is None else vec_id, None if v is None else [float(x) for x in v], label, *[7] * 6))

    for n in range(250):
        x = draw.normal(size=64)
        x /= np.linalg.norm(x)
        add(x, n % 3)
        add(turned(x, draw.choice([0.9805, 0.985, 0.99]), draw), n % 3)
        add(turned(x, 0.97, draw), n % 3)
        add(turned(x, 0.995, draw), (n + 1) % 3)  # another label
    centre = draw.normal(size=64)
    centre /= np.linalg.norm(centre)
    for _ in range(150):
        add(turned(centre, 0.9935, draw), 1)
    x = centre
    for _ in range(12):
        x = turned(x, 0.984, draw)
        add(x * 1e-3, 2)
    for _ in range(40):
        add(centre, 4)
    add(centre * 3, 4)
    for odd in (None, [], [0.0] * 64, [float("nan")] * 64, [float("inf"), *[1.0] * 63], [None, *[1.0] * 63]):
        add(odd if odd is None or None not in odd else [1.0] * 64, 4)
        if odd and None in odd:
            out[-1] = (out[-1][0], odd, 4, *[7] * 6)
    add(centre, None)
    add(centre[:5], 4)
    add(centre[:5], 4)
    out.extend([(out[0][0], out[0][1], out[0][2], *[7] * 6), (None, out[0][1], out[0][2], *[7] * 6), (None, out[4][1], 9, *[7] * 6)])
    return out


def plain_links(rows, threshold=0.98):
    fit = [n for n, (_, v, label, *_) in enumerate(rows) if v and None not in v and label is not None and np.isfinite(v).all() and any(v)]
    near = defaultdict(set)
    for label, width in {(rows[n][2], len(rows[n][1])) for n in fit}:
        own = [n for n in fit if rows[n][2] == label and len(rows[n][1]) == width]
        x = np.array([np.asarray(rows[n][1], np.float32) for n in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                near[own[a]].add(own[b])
    least = {}
    for n in range(len(rows)):
        if n not in least:
            seen, todo = {n}, [n]
            while todo:
                for m in near[todo.pop()] - seen:
                    seen.add(m)
                    todo.append(m)
            name = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
            least |= dict.fromkeys(seen, name)
    return Counter((r[0], len(near[n]), least[n], r[0] is not None and r[0] == least[n]) for n, r in enumerate(rows))


@pytest.mark.parametrize("tile", [pivots.TILE, 64])
def test_pivot_links_by_all_pairs(spark, vectors, tile):
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    got = Counter(map(tuple, pivots.components(df, tile=tile).collect()))
    want = plain_links(vectors)
    assert got == want
    assert max(r[1] for r in want) > 100


def test_pivot_recall_at_the_threshold():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.stack([turned(v, 0.98, draw) for v in x])
    a, b = (pivots.nearest(v, pivots.PIVOTS, pivots.LISTED) for v in (x, y))
    shared = (a[:, :, None] == b[:, None, :]).sum((1, 2))
    assert (shared >= 2).mean() > 0.999


def test_each_pair_is_owned_by_one_list():
    draw = np.random.default_rng(2)
    points = np.stack([np.sort(draw.choice(12, 5, replace=False)) for _ in range(60)])
    owners = np.zeros((60, 60), int)
    for p in range(12):
        for q in range(p + 1, 12):
            held = [n for n, x in enumerate(points) if p in x and q in x]
            if held:
                owners[np.ix_(held, held)] += pivots.owned(points[held], (p, q))
    shared = (points[:, None, :, None] == points[None, :, None, :]).sum((2, 3))
    assert ((owners == 1) == (shared >= 2)).all() and owners.max() == 1


def test_pivot_dedup_keeps_columns(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS)
    kept = pivots.dedup(df)
    assert kept.columns == df.columns
    assert Counter(r.vec_id for r in kept.collect()).keys() == {i for i, _, _, stays in plain_links(vectors) if stays}
    assert pivots.components(df.limit(0)).collect() == []
    assert pivots.components(df.filter("label IS NULL")).count() == 1


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return Counter(map(tuple, prefixes.trie(df).select(*COLS).collect()))


@pytest.fixture(scope="module")
def turns():
    """Families with and without base, copies, a common start, nulls, equal turn numbers, repeated rows, negative ids and a long conversation."""
    draw = np.random.default_rng(4)
    out = []
    for c in [*range(-12, 120), *range(1001, 1300, 7), 10**15 + 3]:
        if c % 11 == 5:
            continue
        start = ["system", "hello there"][: int(draw.integers(0, 3))]
        for t in range(int(draw.integers(1, 12))):
            word = start[t] if t < len(start) else f"é {draw.integers(0, 3)}"
            out.append((c, None if draw.random() < 0.05 else int(draw.integers(0, 9)) if c % 13 == 0 else t, None if draw.random() < 0.05 else "user" if t % 2 else "assistant", None if draw.random() < 0.05 else word))
    out += [(c, t, "user", f"same {t}") for c in range(2000, 2400) for t in range(3)]
    out += [(3000, t, "user", "x" * (t % 7)) for t in range(5000)]
    out += [(None, 1, "user", "lost"), (0, 0, "user", "again"), (0, 0, "user", "again"), (0, 0, "a", "again")]
    return [(*r, *[1] * 5) for r in out]


def test_trie_by_plain_walk(spark, turns):
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    small = [r for r in turns if r[0] != 3000]
    assert trie_rows(df.filter("conv_id IS NULL OR conv_id != 3000")) == plain_trie(small)
    assert prefixes.trie(df.limit(0)).collect() == []
    assert prefixes.trie(df.filter("conv_id IS NULL")).collect() == []
    long = prefixes.trie(df).orderBy("depth").collect()
    assert long[-1].depth == 5000 and long[0].depth == 0 and long[0].n_convs == len({r[0] for r in turns} - {None})


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 3), st.sampled_from(["u", "v"]), st.sampled_from(["", "a", "b"])), min_size=1, max_size=60))
def test_trie_of_random_turns(spark, some):
    rows = [(*r, *[1] * 5) for r in some]
    assert trie_rows(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(1001, t, *x, *[1] * 5) for t, x in enumerate([("ab", "c")] * 12)] + [(1006, t, *x, *[1] * 5) for t, x in enumerate([("a", "bc")] * 12)]
    assert trie_rows(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def plain_search(docs, items, k=10):
    counted = [(d, Counter(TERM.findall((t or "").translate(ASCII)))) for d, t, *_ in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    total, df = sum(n for _, _, n in counted), Counter(t for _, c, _ in counted for t in c)
    out = Counter()
    for item_id, text in items:
        found = []
        for d, c, n in counted:
            m = 100 - 90 + (90 * n * len(counted)) // total
            score = sum(math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(ASCII))) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out.update((item_id, n + 1, None if none else d, -s) for n, (s, none, d) in enumerate(sorted(found)[:k]))
    return out


@pytest.fixture(scope="module")
def searched(rows):
    """The texts of the other tests, more with few words in common, ties, and items of all kinds."""
    draw = np.random.default_rng(6)
    words = [f"w{n}" for n in range(300)] + ["Ünï", "naïve", "ﬀ", "x1"]
    rare = draw.zipf(1.3, size=60_000) % len(words)
    texts, at = [], 0
    while at < len(rare):
        n = int(draw.integers(1, 200))
        texts.append(" ".join(words[w] for w in rare[at : at + n]))
        at += n
    docs = [(r[0], r[1]) for r in rows] + [(1000 + n, t) for n, t in enumerate(texts)] + [(900 - n, "tie tie break") for n in range(30)]
    items = [(n, " ".join(words[w] for w in draw.zipf(1.2, size=int(draw.integers(1, 40))) % len(words))) for n in range(25)]
    items += [(100, "tie"), (101, "w0"), (102, None), (103, ""), (104, "nowhere to be-found zzz"), (105, "THE of,And  river\x00stone w1"), (None, "w3 w250"), (1, items[1][1]), (2, "w9")]
    return [(*d, *[1] * 5) for d in docs], items


@pytest.mark.parametrize("entries", [ranked.ENTRIES, 40])
def test_ranked_search_by_all_scores(spark, searched, entries):
    docs, items = searched
    got = ranked.search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string"), entries=entries)
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items)


def test_ranked_search_by_small_blocks_of_cells(spark, searched, monkeypatch):
    docs, items = searched
    monkeypatch.setattr(ranked, "CELLS", 40)
    got = ranked.search(spark.createDataFrame(docs[:300], DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == plain_search(docs[:300], items)


def test_pruning_leaves_candidates_out():
    """Terms whose best impacts stay below the seeded bound are pruned, and no more."""
    weights, kth, best = np.array([5, 900, 40, 0]), np.array([90, 50, 60, 10]), np.array([100, 80, 100, 20])
    bounds, rest, essential, every = ranked.seeded([(1, [0, 1, 2, 3]), (2, [0]), (3, [3])], weights, kth, best)
    assert bounds.tolist() == [45_000, 450, 0] and rest.tolist() == [4_500, 0, 0]
    assert [e.tolist() for e in essential] == [[1], [0], []] and every[0].tolist() == [0, 2, 1]


def test_ranked_search_without_rows(spark, searched):
    docs = spark.createDataFrame(searched[0], DOCS)
    items = spark.createDataFrame(searched[1], "item_id long, text string")
    assert ranked.search(docs.limit(0), items).collect() == []
    assert ranked.search(docs, items.limit(0)).collect() == []
    assert ranked.search(docs.filter("text = ''"), items).collect() == []


def test_terms_of_very_long_texts():
    text = "Ab-cd é" * 400_000 + " " + "z" * 3_000_000
    assert ranked.terms_of(text) == Counter({b: n for b, n in ((k.encode(), v) for k, v in Counter(TERM.findall(text.translate(ASCII))).items())})
