"""SimHash near-dedup: bit-sliced comparison of fingerprints.

1. Fingerprints: one pass over the texts; a fingerprint bit is set if over half of the shingles' hashes have it.
2. Equal fingerprints are one node (smallest document, combined before the shuffle).
3. Two fingerprints that differ in at most RADIUS = 2 bits agree in at least two of four 16-bit parts, so each
   node is dealt out under six 32-bit keys, and only nodes that share a key are compared. Within a key (many keys in one
   pass) the bits stand as vertical planes of 64 nodes a word; the planes are laid against themselves, shifted by
   1, 2, ...; the distances of all pairs at that shift are kept in two carry-save counter planes with an overflow plane,
   and a block of words is abandoned once all its distances exceed the radius. A key with more than TILE nodes is
   dealt out in tiles, each compared with itself and each other, so that no task gets all of it.
4. Of the links within a key only a spanning forest leaves the task (at most nodes - 1), and the classes are joined by
   large-star and small-star steps on DataFrames.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; rows that repeat have the same
fingerprint and component; a null ``doc_id`` is in its component but never names it, unless all are null; an empty
table gives an empty result; extra columns are ignored by ``components`` and carried by ``dedup``.

``dedup`` (the pipeline's near-dedup) finds pairs of shingle sets of Jaccard similarity 0.8 or more by the same comparison. Such pairs differ in up
to about 24 of 128 fingerprint bits, and no choice of bits is common to them, so nodes are dealt out by keys of their shingles (minima of hashes)
instead of fingerprint parts. Within a key, large groups of copies are first joined to one of their number by turns; the rest is compared
bit-sliced within a radius of ``NEAR_RADIUS`` bits, and each pair found is verified by the exact similarity of its sets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged

SEED, RADIUS, PARTS, TILE = 42, 2, 4, 8192
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
HASHES_AT_ONCE, WORDS_AT_ONCE = 1 << 16, 1 << 14


def fingerprint(text: str | None, words_each: int = 3, width: int = 1) -> np.ndarray:
    """The fingerprint of a whole text: ``width`` unsigned words of 64 bits (one: XXH64, seed 42; two: XXH3-128)."""
    words = WORD.findall((text or "").encode().translate(TO_LOWER))
    if not words:
        return np.zeros(width, np.uint64)
    joined, k = b" ".join(words), min(words_each, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    digest = {1: xxhash.xxh64_digest, 2: xxhash.xxh3_128_digest}[width]
    counts = np.zeros(64 * width, np.int64)
    for at in range(0, len(spans), HASHES_AT_ONCE):
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans[at : at + HASHES_AT_ONCE]]), ">u8")
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8 * width), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits((2 * counts > len(spans)).astype(np.uint8), bitorder="little").view("<u8")


def words_of(width: int) -> list[str]:
    return [f"fp{i}" for i in range(width)]


def fingerprints(docs: DataFrame, words_each: int = 3, width: int = 1) -> DataFrame:
    """doc_id and the fingerprint's words fp0, ... (as signed longs) of every document, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, words_each, width) for x in b.column(1).to_pylist()], np.uint64).reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in fps.T)], ["doc_id", *words_of(width)])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return staged(slim.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in words_of(width))), "fingerprints")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """A row for each bit of the fingerprints (n x width), 64 fingerprints a word, with a spare word at the end."""
    n, width = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(n, 8 * width), axis=1, bitorder="little")
    words = -(-n // 64) + 1
    padded = np.zeros((64 * width, words * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").reshape(64 * width, words)


def near_at(planes: np.ndarray, shifts: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and shifts s, i < the lanes of s, at which fingerprints i and i + s differ in at most ``radius`` bits.

    All shifts go at once, a word each for 64 places. The distances are bitwise counters of k planes that start at
    2**k - 1 - radius: a carry out of the last means too far.
    """
    words = -(-lanes // 64)
    at = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
    by = np.repeat(np.arange(len(shifts)), words)
    skip, bits = (shifts // 64)[by], (shifts % 64)[by].astype(np.uint64)
    k, full, one = radius.bit_length(), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)
    start = (1 << k) - 1 - radius
    counters = [np.full(len(at), full if start >> i & 1 else np.uint64(0)) for i in range(k)]
    far = np.zeros(len(at), np.uint64)
    last = planes.shape[1] - 1
    for first in range(0, len(planes), 8):
        low, high, back = np.minimum(at + skip, last), np.minimum(at + skip + 1, last), np.uint64(63) - bits
        for p in planes[first : first + 8]:
            carry = ((p[low] >> bits) | (p[high] << one << back)) ^ p[at]
            for c in counters:
                more = c & carry
                c ^= carry
                carry = more
            far |= carry
        alive = far != full
        if not alive.all():  # abandon words in which every distance exceeds the radius
            at, by, skip, bits, far, counters = at[alive], by[alive], skip[alive], bits[alive], far[alive], [c[alive] for c in counters]
            if not len(at):
                return np.empty(0, np.int64), np.empty(0, np.int64)
    word, bit = np.nonzero(np.unpackbits((~far).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    found, by = at[word] * 64 + bit, by[word]
    inside = found < lanes[by]
    return found[inside], shifts[by[inside]]


def near_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of fingerprints of equal key that differ in at most ``radius`` bits, by and by; ``keys`` is sorted."""
    _, first, sizes = np.unique(keys, return_index=True, return_counts=True)
    big = np.argsort(-sizes, kind="stable")
    big = big[sizes[big] > 1]
    if not len(big):
        return
    counts = sizes[big]
    place = np.repeat(first[big] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    group, lanes = np.repeat(np.arange(len(big)), counts), np.repeat(counts, counts)
    planes = planes_of(fps[place])
    shifts = np.arange(1, int(counts[0]))
    upto = np.minimum(np.searchsorted(-lanes, -shifts, "left"), len(place) - shifts)  # larger keys stand first
    turn = np.cumsum(-(-upto // 64)) // WORDS_AT_ONCE
    for some in np.split(np.arange(len(shifts)), np.nonzero(np.diff(turn))[0] + 1):
        hit, shift = near_at(planes, shifts[some], upto[some], radius)
        same = group[hit] == group[hit + shift]
        if same.any():
            yield place[hit[same]], place[(hit + shift)[same]]


def forest(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of a class's first member and of each other) among fingerprints of equal key; ``keys`` is sorted."""
    return spanned(len(keys), near_pairs(keys, fps, radius))


def spanned(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The classes of places 0 to n - 1 joined by ``pairs``: each class's first member and each other."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = root[a], root[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, up := root[root]):
                root = up
    other = np.nonzero(root != np.arange(len(root)))[0]
    return root[other], other


def exact_keys(radius: int, parts: int) -> list[list[int]]:
    """Bit places of keys of which two 64-bit fingerprints within ``radius`` always share one: all choices of parts - radius of ``parts`` parts."""
    each = 64 // parts
    return [[each * part + i for part in chosen for i in range(each)] for chosen in combinations(range(parts), parts - radius)]


def links(nodes: DataFrame, width: int, radius: int, keys: list[list[int]], tile: int = TILE) -> DataFrame:
    """(a, b): ids of ``nodes`` (id, fp0, ...) that differ in at most ``radius`` bits and share a key; no more than join them all."""
    cols = words_of(width)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), 4096):
                c = b.slice(a, 4096)
                fps = np.stack([c.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
                bits = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little").astype(np.int64)
                key = np.stack([bits[:, places] @ (1 << np.arange(len(places), dtype=np.int64)) + (n << 40) for n, places in enumerate(keys)], axis=1)
                again = np.repeat(np.arange(len(fps)), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(c.column(i).take(pa.array(again)) for i in range(width + 1))], ["key", "id", *cols])

    dealt = staged(nodes.select("id", *cols).mapInArrow(deal, f"key long, id long, {', '.join(f'{c} long' for c in cols)}"), "dealt")

    def linked(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = forest(rows[:, 0], rows[:, 2:].view(np.uint64), radius)
        yield rows[a, 1], rows[b, 1]

    return compared(dealt, linked, tile)


def compared(dealt: DataFrame, pairs_of: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]], tile: int = TILE) -> DataFrame:
    """Distinct (a, b), a < b, of the ids that ``pairs_of`` finds among rows of equal key; ``dealt`` is a table (key, id, more longs)."""
    cols = dealt.columns[1:]
    # how many tiles a key needs; only keys with more than one are listed
    large = staged(dealt.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > tile).select("key", F.ceil(F.col("m") / tile).cast("int").alias("t")), "large")
    if not large.isEmpty():
        tiled = dealt.join(large, "key", "left").withColumn("t", F.coalesce("t", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("t")).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("lo"), F.greatest(F.col("own"), o).alias("hi")))
        dealt = tiled.select("key", *cols, F.explode(pairs).alias("p")).select(F.xxhash64("key", "p.lo", "p.hi").alias("key"), *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, len(cols) + 1), np.int64)

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in pairs_of(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            rest = np.concatenate((rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)))
            if len(rest) > 100_000 and rest[0, 0] != rest[-1, 0]:
                cut = int(np.searchsorted(rest[:, 0], rest[-1, 0], "left"))  # the last key may go on
                yield from out(rest[:cut])
                rest = rest[cut:]
        if len(rest):
            yield from out(rest)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every larger node of ``edges`` (a, b) has one edge and is no smaller node: then a is the root of b."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(0).alias("larger")), F.struct(F.col("b").alias("x"), F.lit(1).alias("larger")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.min("larger").alias("lo"), F.max("larger").alias("hi"), F.sum("larger").alias("n")).filter("lo != hi OR n > 1").isEmpty()


def classes(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node but the roots of ``edges`` (a, b), a < b and distinct: root is the smallest node that can be reached.

    Large-star: every node hands its larger neighbours to the smallest one it sees; small-star: its smaller neighbours and itself.
    Both are a partial minimum and a join on the node, so a node with many neighbours is no large group.
    """
    edges = staged(edges, "edges")
    for _ in range(most_rounds):
        if settled(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a AND b != m").select(F.col("m").alias("a"), "b")
        # small-star on (larger, smaller): every smaller neighbour and the node itself point to the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.filter("a != m").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = staged(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a != b").distinct(), "edges")
    raise RuntimeError("components did not settle")


def classed(docs: DataFrame, words_each: int, width: int, radius: int, keys: list[list[int]]) -> DataFrame:
    """doc_id, the fingerprint's words and component_id of every document."""
    cols = words_of(width)
    prints = fingerprints(docs, words_each, width)
    nodes = prints.groupBy(*cols).agg(F.min("doc_id").alias("least"))
    nodes = staged(nodes.withColumn("id", F.col("fp0") if width == 1 else F.monotonically_increasing_id()), "nodes")
    found = classes(links(nodes, width, radius, keys))
    named = staged(nodes.join(found, nodes["id"] == found["node"], "left").select(*cols, "least", F.coalesce("root", "id").alias("root")), "named")
    ids = staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")  # a table, so that a large component's nodes are split
    return prints.join(named.join(ids, "root").select(*cols, "component_id"), cols).select("doc_id", *cols, "component_id")


def components(docs: DataFrame, words_each: int = 3, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document: all links of at most ``radius`` bits count."""
    of = classed(docs, words_each, 1, radius, exact_keys(radius, parts))
    return of.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


# Near-dedup of the pipeline: keys by minima of shingle hashes, bit-sliced comparison within a key, links by exact Jaccard similarity.
SHINGLE, BANDS, ROWS, LEADER_ROUNDS = 5, 24, 4, 1
#: Of similarity 0.8 a bit differs with probability 0.19 at most (sets of 5 and 4 shingles): 24 of 128 bits, deviation 4.4. Unlike texts differ in 64.
NEAR_RADIUS = 48
#: Texts of similarity exactly 0.8 share no band with (1 - 0.8**4)**24 = 3e-6.
FACTORS = np.random.default_rng(11).integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words_each: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """The text's words (lower case, joined by a space) and the distinct hashes of its shingles, in order; a shorter text is one shingle."""
    words = WORD.findall((text or "").encode().translate(TO_LOWER))
    joined, k = b" ".join(words), max(1, min(words_each, len(words)))
    ends = np.cumsum([len(w) + 1 for w in words] or [1]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(ends) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)])
    return joined, np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The 128-bit fingerprint of a set of shingle hashes, as two words."""
    counts = np.zeros(128, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE]
        both = np.stack((part, (part ^ part >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)), axis=1)
        counts += np.unpackbits(both.astype("<u8").view(np.uint8).reshape(len(part), 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: ``ROWS`` minima of the hashes, multiplied by odd factors."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (FACTORS[:, None] * hashes[None, at : at + 1024]).min(axis=1), out=least)
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more, for sorted distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose shingle ``sets`` (id, hashes) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            yield b.select([0, 1]).filter(pa.array([similar(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)) for u, v in zip(x, y, strict=True)], pa.bool_()))

    of = lambda side: sets.select(F.col("id").alias(side), F.col("hashes").alias(f"of_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def similar_places(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of the pairs of places (a, b) are similar; ``sets`` are those of the places, as distinct numbers counted from 0."""
    fits = np.zeros(len(a), bool)
    if not len(a):
        return fits
    order = np.argsort(a, kind="stable")
    starts = np.concatenate(([0], np.nonzero(np.diff(a[order]))[0] + 1, [len(a)]))
    marked = np.zeros(1 + max((int(s.max()) for s in sets), default=0), np.int64)
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        at = order[lo:hi]
        own = sets[a[at[0]]]
        marked[own] = 1
        for part in np.array_split(at, -(-len(at) // 1024)):
            others = [sets[i] for i in b[part].tolist()]
            sizes = np.array([len(o) for o in others])
            both = np.add.reduceat(marked[np.concatenate(others)], np.cumsum(sizes) - sizes)
            fits[part] = 5 * both >= 4 * (len(own) + sizes - both)
        marked[own] = 0
    return fits


def linked_within(now: DataFrame, sets: DataFrame, tile: int = TILE, tile_bytes: int = 1 << 25) -> DataFrame:
    """Distinct links (a, b) that join all similar pairs of equal key: bit-sliced comparison, then exact verification in the same task.

    No pair leaves a task but those of a spanning forest. ``now`` is a table (key, id, n, root, fp0, fp1); a key with more than ``tile``
    nodes or ``tile_bytes`` of sets is dealt out in tiles, each compared with itself and each other.
    """
    need = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") * 8 / tile_bytes)).cast("int")
    large = staged(now.groupBy("key").agg(need.alias("t")).filter("t > 1"), "large")
    dealt = now
    if not large.isEmpty():
        tiled = now.join(large, "key", "left").withColumn("t", F.coalesce("t", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("t")).cast("int"))
        both = F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("lo"), F.greatest(F.col("own"), o).alias("hi")))
        dealt = tiled.select(*now.columns, F.explode(both).alias("p")).withColumn("key", F.xxhash64("key", "p.lo", "p.hi")).drop("p")

    def out(rows: np.ndarray, held: list[bytes]) -> pa.RecordBatch:
        _, node, size, root = rows.T[:4]
        numbers = np.unique(np.frombuffer(b"".join(held), np.uint64), return_inverse=True)[1]
        own = np.split(numbers, np.cumsum(size)[:-1])

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in near_pairs(rows[:, 0], rows[:, 4:].view(np.uint64), NEAR_RADIUS):
                fits = (root[a] != root[b]) & (5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b]))
                a, b = a[fits], b[fits]
                fits = similar_places(a, b, own)
                yield a[fits], b[fits]

        a, b = spanned(len(rows), pairs())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held, weight = np.empty((0, 6), np.int64), [], 0
        for batch in batches:
            for some in (batch.slice(at, 1024) for at in range(0, len(batch), 1024)):
                rest = np.concatenate((rest, np.stack([c.to_numpy(zero_copy_only=False) for c in some.columns[:6]], axis=1)))
                held += some.column(6).to_pylist()
                weight += some.column(6).nbytes
                if (len(rest) > 100_000 or weight > tile_bytes) and rest[0, 0] != rest[-1, 0]:
                    cut = int(np.searchsorted(rest[:, 0], rest[-1, 0], "left"))  # the last key may go on
                    yield out(rest[:cut], held[:cut])
                    rest, held = rest[cut:], held[cut:]
                    weight = sum(map(len, held))
        if len(rest):
            yield out(rest, held)

    return dealt.join(sets, "id").select(*now.columns, "hashes").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def verified_links(keyed: DataFrame, sets: DataFrame, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """(node, root) of nodes joined by similar pairs that share a key.

    First each key's nodes are verified against one of them, in ``leader_rounds`` turns, so that a large group of near copies is joined by pairs in
    proportion to its size; then all nodes that share a key and are not yet in one class are compared bit-sliced, and what is near is verified
    where it is found. ``keyed`` is (key, id, n: size of its set, fp0, fp1).
    """
    sized = F.least("n", "n2") * 5 >= F.greatest("n", "n2") * 4
    ordered = [F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")]
    found: DataFrame | None = None
    for turn in range(leader_rounds + 1):
        now = keyed.withColumn("root", F.col("id")) if found is None else staged(keyed.join(found, keyed["id"] == found["node"], "left").withColumn("root", F.coalesce("root", "id")), "rooted")
        now = now.select("key", "id", "n", "root", "fp0", "fp1")
        if found is not None:
            mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
            now = staged(now.join(mixed, "key"), "mixed")
        if now.isEmpty():
            break
        if turn < leader_rounds:  # the keys of a large group are led by different nodes
            led = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id", F.lit(turn)).alias("h"), "id", "n", "root")).alias("l")).select("key", F.col("l.id").alias("id2"), F.col("l.n").alias("n2"), F.col("l.root").alias("root2"))
            edges = verified(now.join(led, "key").filter((F.col("root") != F.col("root2")) & sized).select(*ordered).distinct(), sets)
        else:
            edges = linked_within(now, sets)
        # the classes so far stand for the links that made them
        found = classes(edges if found is None else edges.unionByName(found.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    return keyed.select(F.col("id").alias("node"), F.col("id").alias("root")).limit(0) if found is None else found


def dedup(docs: DataFrame, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """The documents that stay, with their own columns: of each class of near copies the one with the smallest doc_id.

    Links are pairs of five-word shingle sets of Jaccard similarity 0.8 or more. Rows that repeat whole (doc_id and text) stay or go
    together; a null ``doc_id`` is larger than all others, and of texts with one ``doc_id`` that with the smallest hash stays.
    """
    row = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_t0"), F.hash(F.col("text").cast("string")).alias("_t1")]
    slim = docs.select(*row, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sizes, keys, prints = [], [], [], []
            for text in b.column(3).to_pylist():
                joined, hashes = shingles(text)
                words.append(xxhash.xxh3_128_digest(joined))
                sizes.append(len(hashes))
                keys.append(bands(hashes))
                prints.append(sketch(hashes))
            fps = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(words, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(c)) for c in fps.T)], ["_id", "_t0", "_t1", "words", "n", "keys", "fp0", "fp1"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t)[1].tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "hashes"])

    rows = staged(slim.mapInArrow(run, "_id long, _t0 long, _t1 int, words binary, n long, keys array<long>, fp0 long, fp1 long"), "minhashes")
    name = F.struct(F.col("_id").isNull().alias("none"), "_id", "_t0", "_t1")
    nodes = rows.groupBy("words").agg(F.min(name).alias("least"), *(F.first(c).alias(c) for c in ("n", "keys", "fp0", "fp1")))  # the same for equal words
    nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    keyed = staged(nodes.select(F.explode("keys").alias("key"), "id", "n", "fp0", "fp1"), "keyed")
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo != hi").select("key")
    keyed = staged(keyed.join(shared, "key"), "shared-keys")
    wanted = nodes.join(keyed.select("id").distinct(), "id").select("id", "least._id", "least._t0", "least._t1")
    same = slim["_id"].eqNullSafe(wanted["_id"]) & (slim["_t0"] == wanted["_t0"]) & (slim["_t1"] == wanted["_t1"])
    texts = slim.join(wanted, same).select("id", "text").dropDuplicates(["id"])
    sets = staged(texts.mapInArrow(hashed, "id long, hashes binary"), "shingle-sets")
    found = verified_links(keyed, sets, leader_rounds)
    named = staged(nodes.join(found, nodes["id"] == found["node"], "left").select("words", "least", F.coalesce("root", "id").alias("root")), "named")
    stays = staged(named.groupBy("root").agg(F.min("least").alias("stays")), "stays")  # a table, so that a large class's nodes are split
    of = rows.join(named.join(stays, "root").select("words", "stays"), "words")
    goes = of.filter(name != F.col("stays")).select("_id", "_t0", "_t1").distinct()
    text = docs["text"].cast("string")
    return docs.join(goes, docs["doc_id"].cast("long").eqNullSafe(goes["_id"]) & (F.xxhash64(text) == goes["_t0"]) & (F.hash(text) == goes["_t1"]), "left_anti")
