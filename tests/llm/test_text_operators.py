"""Quality rules, exact dedup, SimHash, mixing and substring dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offerlens.llm import exact_dedup, lines, mixing, quality, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def measures(text):
    w = WORD.findall(text or "")
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(wins), set()
    for i, x in enumerate(wins):
        if n[x] > 1:
            covered.update(range(i, i + 5))
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(covered)


def test_quality_measures(docs, rows):
    got = quality.judge(docs, "doc_id", "n_chars").collect()
    want = Counter((r[0], *measures(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_keeps_clean_and_all_columns(docs):
    kept = quality.apply_rules(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.judge(docs, "doc_id").filter("kept").collect())
    assert {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3}


def test_quality_repeats_of_a_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(5000)) + " " + " ".join(f"x{i}" for i in range(500))
    got = quality.measure(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").first()
    assert got.n_repeat_words == measures(text)[4]


@pytest.mark.parametrize("place_bits", [60, 3], ids=["clashing hashes", "more windows than places"])
def test_quality_repeats_by_the_windows_themselves(spark, place_bits):
    import random

    draw = random.Random(2)
    texts = [" ".join(draw.choice("abc") for _ in range(n)) for n in (4, 5, 9, 30, 100, 400)] + [" ".join(f"w{i}" for i in range(100)) + " w1 w2 w3 w4 w5 w6"]
    got = quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", place_bits=place_bits).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: measures(t)[4] for i, t in enumerate(texts)}


def lowered(text):
    return (text or "").translate(LOWER)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)], ids=["sha256", "clashing"])
def test_exact_groups(docs, rows, digest):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    got = exact_dedup.groups(docs, digest).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    largest = {k: max((i for i in v if i is not None), default=None) for k, v in by_sha.items()}
    for r in got:
        assert r.group_size == len(by_sha[r.text_sha256]) and r.keep_id == largest[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(by_sha))
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((r[0], hashlib.sha256(lowered(r[1]).encode()).hexdigest()) for r in rows)


def test_chunks_are_the_text_and_follow_its_content(spark):
    import random

    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    sentence = lambda: " ".join(word() for _ in range(draw.randrange(5, 20))) + draw.choice([".", "!", ".\n"])
    texts = [" ".join(sentence() for _ in range(200)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, sentence() + " " + t) for i, t in enumerate(texts)]
    rows += [(200, "a\x01b. " * 3000), (201, "same sentence. " * 3000), (202, "x" * 50_000), (203, ""), (204, "\n\n. ! ")]
    got = {r.doc_id: r.c for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", exact_dedup.chunks(F.col("text")).alias("c")).collect()}
    assert all("".join(got[i]) == t for i, t in rows) and all(len(c) <= exact_dedup.MOST for x in got.values() for c in x)
    for i in range(30):
        assert len(got[i]) > 10 and len(set(got[i]) & set(got[100 + i])) >= len(got[i]) - 1


def test_exact_dedup_of_repeated_rows(spark):
    rows = [(7, "A b", "x"), (7, "a B", "y"), (7, "a B", "y"), (3, "a b", "z"), (None, "a b", "n"), (1, "other", "o"), (None, "alone", "n"), (None, "alone", "m")]
    kept = [tuple(r) for r in exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, _row string")).collect()]
    assert sorted(kept, key=str) == sorted([(7, "A b", "x"), (1, "other", "o"), (None, "alone", "m")], key=str)


def test_exact_dedup_rows(docs, rows):
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(lowered(r.text) for r in kept.collect()) == Counter({lowered(r[1]) for r in rows})


def print_of(text, k=3):
    w = WORD.findall(lowered(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, rows):
    prints = [(r[0], print_of(r[1] if r[1] is None or len(r[1]) < 90000 else r[1])) for r in rows]
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        least[find(i)].append(d)
    want = Counter((d, f"{f:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, f) in enumerate(prints))
    assert Counter(map(tuple, simhash.components(docs).collect())) == want


def test_simhash_matches_spark_hash(spark):
    text = "Alpha beta GAMMA delta epsilon"
    h = [r[0] & (2**64 - 1) for r in spark.createDataFrame([("alpha beta gamma",), ("beta gamma delta",), ("gamma delta epsilon",)], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert int(simhash.fingerprint(text)[0]) == want


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 150), st.sampled_from([1, 2]), st.sampled_from([1, 2, 3, 9, 25]))
def test_bit_sliced_distances(seed, n, width, radius):
    draw = np.random.default_rng(seed)
    fps = draw.integers(0, 2**63, (n, width)).astype(np.uint64)
    for i in range(1, n):
        if draw.random() < 0.7:
            fps[i] = fps[draw.integers(0, i)]
            for b in draw.integers(0, 64 * width, draw.integers(0, radius + 2)):
                fps[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    planes = simhash.planes_of(fps)
    near = lambda a, b: bin(int.from_bytes((fps[a] ^ fps[b]).tobytes(), "little")).count("1") <= radius
    shifts = np.array(sorted({1, 2, n // 2, n - 1} - {0, n}))
    found, by = simhash.near_at(planes, shifts, n - shifts, radius)
    assert sorted(zip(found.tolist(), by.tolist(), strict=True)) == sorted((i, s) for s in shifts.tolist() for i in range(n - s) if near(i, i + s))
    keys = np.sort(draw.integers(0, 4, n))
    want = {(a, b) for b in range(n) for a in range(b) if keys[a] == keys[b] and near(a, b)}
    for at_once in (1, 8, simhash.WORDS_AT_ONCE):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(simhash, "WORDS_AT_ONCE", at_once)
            pairs = [(a, b) for x, y in simhash.near_pairs(keys, fps, radius) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(pairs) == len(want) and {(min(p), max(p)) for p in pairs} == want


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(5, 90), (7, 91), (90, 91)], [(i, 100) for i in range(30)] + [(200, 201), (200, 202)]])
def test_classes_of_chains_stars_and_hubs(spark, edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = simhash.classes(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: r for x, r in root.items() if x != r}
    assert len(got) == len({r.node for r in got})


def test_tiles_and_keys_lose_no_link(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**62, 6)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in draw.integers(0, 63, (40, 2))} | {int(b) for b in base})
    nodes = spark.createDataFrame([(f, f) for f in fps], "id long, fp0 long")
    for tile in (4, 8192):
        found = simhash.classes(simhash.links(nodes, 1, 2, simhash.exact_keys(2, 4), tile)).collect()
        root = {f: f for f in fps} | {r.node: r.root for r in found}
        same = {(a, b) for a in fps for b in fps if a < b and root[a] == root[b]}
        near = {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2}
        assert near <= same and len(set(root.values())) == 6


def test_links_within_a_key_are_verified_in_tiles(spark):
    draw = np.random.default_rng(5)
    base = np.unique(draw.integers(0, 2**63, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[draw.random(len(base)) < draw.choice([0.7, 0.9, 1.0])], draw.integers(0, 2**63, 2).astype(np.uint64)))) for _ in range(40)]
    assert simhash.similar_places(np.empty(0, np.int64), np.empty(0, np.int64), sets).tolist() == []
    prints = [simhash.sketch(x).view(np.int64).tolist() for x in sets]
    now = spark.createDataFrame([(i % 2, i, len(x), i, *p) for i, (x, p) in enumerate(zip(sets, prints, strict=True))], "key long, id long, n long, root long, fp0 long, fp1 long")
    held = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "id long, hashes binary")
    root = list(range(len(sets)))
    for _ in root:
        for b in range(len(sets)):
            for a in range(b % 2, b, 2):
                if simhash.similar(sets[a], sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for tile, size in ((8192, 1 << 25), (6, 1 << 25), (8192, 2048)):
        found = {r.node: r.root for r in simhash.classes(simhash.linked_within(now, held, tile, size)).collect()}
        assert [found.get(i, i) for i in range(len(sets))] == root and len(set(root)) < len(root)


def test_near_dedup_keeps_one_of_each_class(spark, docs):
    words = [f"word{i}" for i in range(300)]
    near = [(i, " ".join(w if k != 7 * i else "changed" for k, w in enumerate(words)), "x") for i in range(12)] + [(50, " ".join(f"other{i}" for i in range(300)), "x")]
    kept = simhash.dedup(spark.createDataFrame(near, "doc_id long, text string, component_id string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 50] and kept.columns == ["doc_id", "text", "component_id"]


def jaccard(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(lowered(a)), WORD.findall(lowered(b))))
    return len(x & y) / len(x | y)


def test_near_dedup_follows_the_shingle_rule(spark):
    base = [f"word{i}" for i in range(304)]
    text = lambda head, changed: " ".join(head + w if i not in changed else f"new{i}" for i, w in enumerate(base))
    rows, want = [], set()
    for k in range(40):  # a changed word changes five of 300 shingles: 6 leave 0.818, 7 leave 0.791
        far = k % 2
        pair = text(f"t{k}", ()), text(f"t{k}", range(20, 20 + 40 * (6 + far), 40))
        assert (jaccard(*pair) >= 0.8) == (not far)
        rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
        want |= {2 * k, 2 * k + 1} if far else {2 * k}
    assert {r.doc_id for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_near_dedup_recall_against_all_pairs(spark):
    """Of all pairs of similarity 0.8 or more in the small documents, each must end with one of the two at most."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {i: simhash.shingles(t)[1] for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = [(a, b) for n, b in enumerate(ids) for a in ids[:n] if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and simhash.similar(sets[a], sets[b])]
    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    for rounds in (0, simhash.LEADER_ROUNDS):  # the bit-sliced comparison alone, and after the turns
        kept = {r.doc_id for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"), rounds).collect()}
        assert len(near) > 50 and kept == {find(i) for i in ids}


def test_near_dedup_links_through_others(spark):
    base = [f"word{i}" for i in range(304)]
    chain = [(i, " ".join(w if not any(k == 20 + 25 * j for j in range(3 * i)) else f"new{k}" for k, w in enumerate(base))) for i in range(4)]
    assert jaccard(chain[0][1], chain[3][1]) < 0.8 <= min(jaccard(chain[i][1], chain[i + 1][1]) for i in range(3))
    assert [r.doc_id for r in simhash.dedup(spark.createDataFrame(chain, "doc_id long, text string")).collect()] == [0]


def test_near_dedup_of_null_and_repeated_ids(spark):
    text = lambda head: " ".join(f"{head}{i}" for i in range(300))
    rows = [(1, text("a")), (None, text("a") + " end"), (None, text("b")), (2, text("c")), (9, text("c") + " end"), (9, text("d")), (7, text("e")), (7, text("e") + " end")]
    kept = [(r.doc_id, r.text) for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(kept) - Counter(rows[6:]) == Counter([rows[0], rows[2], rows[3], rows[5]]) and len(kept) == 5


def water_fill(sizes, most=3.0):
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while open_:
        share = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if share * weight[n] > most * sizes[n]}
        if not over:
            return target | {n: share * weight[n] for n in open_}
        for n in over:
            target[n] = most * sizes[n]
            left -= target[n]
        open_ -= over
    return target


def test_mixing_targets_and_takes(docs, rows):
    sized = mixing.measured(docs)
    got = mixing.with_takes(sized, mixing.plan(sized)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = water_fill(sizes)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[3], len(WORD.findall(r[1] or ""))) for r in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.takes <= 3
        taken[r.source] += r.takes * r["size"]
    together = Counter()  # rows that repeat are taken together
    for r in rows:
        together[(r[3], r[0], r[1])] += len(WORD.findall(r[1] or ""))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(n for k, n in together.items() if k[0] == s) / 2 + 1
    again = mixing.with_takes(sized, mixing.plan(sized)).collect()
    assert Counter((r.doc_id, r.source, r.takes) for r in got) == Counter((r.doc_id, r.source, r.takes) for r in again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.takes for r in got)


def test_mixing_caps(spark):
    sizes = {"a": 3, "b": 500, "c": 1000, "d": 40, None: 2}
    totals = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(totals).collect()}
    want = water_fill(sizes)
    assert got == {k: pytest.approx(v) for k, v in want.items()} and sum(got.values()) == pytest.approx(1545)


def test_units_hold_every_word_once(rows):
    for r in rows:
        at, words = 0, []
        for begin, end, n, digest in lines.units(r[1] or ""):
            unit = r[1][begin:end]
            assert at <= begin < end and unit.strip() == unit and n == len(unit.split()) and digest == xxhash.xxh3_128_digest(" ".join(unit.lower().split()))
            words += unit.split()
            at = end
        assert words == (r[1] or "").split()


def test_substring_repeats_by_plain_walk(docs, rows):
    """Every earlier unit's normalised text is kept in a set; runs are walked one by one."""
    want, seen = Counter(), set()
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    named = [r for i, r in enumerate(named) if i == 0 or r[0] != named[i - 1][0]]
    for r in named:
        run, n = [], 0
        for begin, end, k, _ in [*lines.units(r[1] or ""), (None, None, 0, None)]:
            text = None if begin is None else " ".join(r[1][begin:end].lower().split())
            if text is not None and text in seen:
                run.append((r[0], begin, end, k))
                n += k
                continue
            seen.add(text)
            want.update(run if n >= lines.LEAST_RUN else [])
            run, n = [], 0
    one_each = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = lines.repeats(one_each).collect()
    assert Counter((r.doc_id, r.begin, r.end, r.n_words) for r in got) == want and want
    assert all((r.first_doc_id, r.first_begin) < (r.doc_id, r.begin) for r in got)


@pytest.mark.parametrize("parted", [" ", ". ", "\n"])
def test_planted_passages_go_and_clean_documents_stay(spark, parted):
    draw = np.random.default_rng(3)
    word = lambda: "".join(draw.choice(list("abcdefghijklmnop"), 7))
    prose = lambda n: " ".join(word() + ("." if draw.random() < 0.08 else "") for _ in range(n))
    common, passages = "All of this is said by every one of them.", [prose(60) for _ in range(4)]
    texts = [prose(150) + "\n" + common + "\n" + prose(20) for _ in range(30)]
    planted = {}
    for i in range(10, 22):
        k = i % 4
        before, after = prose(33), prose(41)
        texts[i] = f"{before}{parted}{passages[k]}{parted}{after}"
        planted[i] = (len(before) + len(parted), len(before) + len(parted) + len(passages[k]), k)
    got = defaultdict(list)
    for r in lines.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(range(14, 22))  # the first four hold the first occurrences
    for i, spans in got.items():
        begin, end, k = planted[i]
        assert [] == [(i, k, begin, end, tuple(r)) for r in spans if not (begin <= r.begin and r.end <= end + len(parted.strip()) and r.first_doc_id in range(10, i) and r.first_doc_id % 4 == k)]
        assert sum(r.n_words for r in spans) >= lines.LEAST_RUN


@pytest.mark.parametrize("shape", ["short sentences", "short lines", "long sentence"])
def test_shared_stretches_hold_a_unit(shape):
    draw = np.random.default_rng(4)
    word = lambda: "".join(draw.choice(list("abcdefghij"), 6)) + {"short sentences": "!! ", "short lines": "\n", "long sentence": " "}[shape]
    for _ in range(100):
        stretch = "".join(word() for _ in range(50))
        a, b = ("".join(word() for _ in range(draw.integers(0, 40))) + stretch + "".join(word() for _ in range(draw.integers(0, 40))) for _ in range(2))
        shared = {u[3] for u in lines.units(a)} & {u[3] for u in lines.units(b)}
        assert sum(u[2] for u in lines.units(a) if u[3] in shared) >= 20


def test_substring_clean(spark):
    words = lambda head, n: " ".join(f"{head}{i}" for i in range(n))
    a = f"This first sentence is said once only here. {words('p', 40)}. Tail."
    b = f"Another text begins in its own way today. {words('P', 20)}  {' '.join(f'p{i}' for i in range(20, 40))}. Short one."
    rows = [(2, b, "x"), (1, a, "y"), (3, None, "z"), (None, b, "n"), (None, "Nothing of this was said before.", "n"), (1, a, "y")]
    got = [tuple(r) for r in lines.clean(spark.createDataFrame(rows, "doc_id long, text string, _row string")).select("doc_id", "text", "_row", "removed").collect()]
    by = defaultdict(list)
    for i, t, x, removed in got:
        by[i].append((t, x, [tuple(s) for s in removed]))
    assert by[3] == [(None, "z", [])] and ("Nothing of this was said before.", "n", []) in by[None] and len(got) == 6
    assert (a, "y", []) in by[1] and len(by[1]) == 2  # of rows that repeat the first stays
    (text, _, removed), = by[2]
    assert removed and all("p" in b[x:y].lower() for x, y in removed) and text == "".join(b[x:y] for x, y in zip([0, *(y for _, y in removed)], [*(x for x, _ in removed), len(b)], strict=True))
    assert sum(len(b[x:y].split()) for x, y in removed) >= 25 and text.startswith("Another text begins in its own way today.") and text.endswith("Short one.")


@pytest.mark.parametrize("run", [lambda d: quality.apply_rules(d), lambda d: exact_dedup.groups(d), lambda d: exact_dedup.dedup(d), lambda d: simhash.components(d), lambda d: simhash.dedup(d), lambda d: mixing.mix(d), lambda d: lines.repeats(d), lambda d: lines.clean(d)])
def test_empty_table(empty, run):
    assert run(empty).collect() == []
