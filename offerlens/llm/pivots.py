"""Embedding near-dedup: pivot-permutation index, links by exact cosine.

1. Equal vectors of one label are one node with a weight (combined before the shuffle), so copies are never compared.
2. Each node is described by its ``LISTED`` nearest of ``PIVOTS`` reference points, nearest first. The points are random directions of a fixed seed,
   not data: how likely two vectors share points depends on their angle alone, whatever the corpus looks like. Two vectors of cosine 0.98
   share two of eight points with over 0.999 (simulated), unrelated ones with about 1e-4.
3. Inverted lists: a node stands in a list for each two of its points (and its label), so sharing a list means sharing at least two points. Lists of one
   node are dropped before vectors move. A list of more than ``TILE`` nodes goes in tiles, each against itself and each other.
4. In a list's task the shared points of all signatures are counted by one product of 0/1 matrices. A pair belongs to the list of its two
   smallest shared points, so it's verified once: cosine in double precision, row blocks against the columns that are candidates. No pair
   leaves the task, only each node's number of links and a spanning forest.
5. Components by large-star and small-star over the forests.

Cost: a group of g different vectors that are all alike takes g * g / 2 dot products, in tiles; counting their links asks for it.

Defined results: a null label, and a vector that is null, empty, zero or holds nulls or non-finite values, links with nothing; so do vectors of different
lengths. Every row is a vector of its own: rows that repeat a ``vec_id`` link with each other and both count. A null ``vec_id`` never names a component
unless all are null, and isn't kept then. Extra columns are ignored by ``components``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .simhash import classes, spanned

THRESHOLD, PIVOTS, LISTED, TILE, SEED = 0.98, 4096, 8, 4096, 20
ROWS_AT_ONCE = 256


@cache
def reference_points(width: int, pivots: int) -> np.ndarray:
    """Random unit vectors of a fixed seed."""
    points = np.random.default_rng((SEED, width)).normal(size=(pivots, width))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def nearest(unit: np.ndarray, pivots: int, listed: int) -> np.ndarray:
    """The numbers of the ``listed`` nearest reference points of each row, nearest first; ties by number."""
    near = unit @ reference_points(unit.shape[1], pivots).T
    some = np.sort(np.argpartition(-near, listed - 1, axis=1)[:, :listed], axis=1)
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector scaled to length 1 in double precision; None where it links with nothing."""
    found: list[np.ndarray | None] = []
    for x in column.to_pylist():
        v = None if not x or None in x else np.asarray(x, np.float64)
        if v is not None and np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
            v = v / top  # squares neither overflow nor vanish
            found.append(v / np.sqrt(v @ v))
        else:
            found.append(None)
    return found


def described(vectors: DataFrame, pivots: int = PIVOTS, listed: int = LISTED) -> DataFrame:
    """vec_id of every row, and for a row that can link: a digest (d0, d1) of label and vector, the vector of length 1 and its nearest points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                units, labels, raw = unit_rows(b.column(2)), b.column(1).to_pylist(), b.column(2).to_pylist()
                fit = [n for n, (u, x) in enumerate(zip(units, labels, strict=True)) if u is not None and x is not None]
                lists: dict[int, list[int]] = {}
                for width in {len(units[n]) for n in fit}:
                    own = [n for n in fit if len(units[n]) == width]
                    lists |= dict(zip(own, nearest(np.stack([units[n] for n in own]), pivots, listed).tolist(), strict=True))
                digests: list[tuple[int | None, int | None]] = [(None, None)] * len(b)
                for n in fit:
                    value = xxhash.xxh3_128_digest(np.asarray(raw[n], np.float64).tobytes(), labels[n] & 0xFFFFFFFFFFFFFFFF)
                    digests[n] = tuple(np.frombuffer(value, np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), pa.array([units[n].tobytes() if n in lists else None for n in range(len(b))], pa.binary()), pa.array([lists.get(n) for n in range(len(b))], pa.list_(pa.int32()))],
                    ["vec_id", "label", "d0", "d1", "unit", "points"],
                )

    slim = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), vectors["embedding"].cast("array<double>").alias("embedding"))
    return staged(slim.mapInArrow(run, "vec_id long, label long, d0 long, d1 long, unit binary, points array<int>"), "described")


def owned(points: np.ndarray, pair: tuple[int, int], least: int = 2) -> np.ndarray:
    """For signatures (rows of point numbers) that all hold ``pair``: which two have ``pair`` as their smallest shared points, and ``least`` in common."""
    names, place = np.unique(points, return_inverse=True)
    holds = np.zeros((len(points), len(names)), np.float32)
    holds[np.arange(len(points))[:, None], place.reshape(points.shape)] = 1
    upto = holds[:, names <= pair[1]]
    both = upto @ upto.T == 2  # the pair itself
    return both if least <= 2 else both & (holds @ holds.T >= least)


def linked_pairs(units: np.ndarray, points: np.ndarray, pair: tuple[int, int], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of the vectors of one list that are linked and whose smallest shared points are ``pair``, by blocks of rows."""
    signatures, of = np.unique(np.sort(points, axis=1), axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    units, of = units[order], of[order]
    for rows in np.array_split(np.arange(len(signatures)), -(-len(signatures) // 2048)):  # so the 0/1 product stays small
        for cols in np.array_split(np.arange(len(signatures)), -(-len(signatures) // 2048)):
            if rows[0] > cols[0]:
                continue
            some = np.concatenate((rows, cols)) if rows[0] != cols[0] else rows
            own = owned(signatures[some], pair)[: len(rows), -len(cols) :]
            a0, a1 = np.searchsorted(of, [rows[0], rows[-1] + 1])
            b0, b1 = np.searchsorted(of, [cols[0], cols[-1] + 1])
            for at in range(a0, a1, ROWS_AT_ONCE):
                i = np.arange(at, min(at + ROWS_AT_ONCE, a1))
                mine = own[of[i] - rows[0]]
                j = np.arange(max(b0, at), b1)
                j = j[mine.any(axis=0)[of[j] - cols[0]]]
                if not len(j):
                    continue
                x, y = np.nonzero((units[i] @ units[j].T >= threshold) & mine[:, of[j] - cols[0]] & (i[:, None] < j))
                if len(x):
                    yield order[i[x]], order[j[y]]


def linked(nodes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """A table of (a, b, n): links a, b that join all classes, with n null, and numbers n of vectors linked to node a, with b null.

    ``nodes`` is a table (id, label, w, unit, points).
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, width = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            if not len(b):
                continue
            points = np.sort(np.stack(b.column(3).to_numpy(zero_copy_only=False)), axis=1).astype(np.int64)
            chosen = list(combinations(range(points.shape[1]), 2))
            p, q = (points[:, [c[k] for c in chosen]] for k in (0, 1))
            again = np.repeat(np.arange(len(b)), len(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(labels[again]), pa.array(width[again]), pa.array(((p << 32) | q).ravel()), ids.take(pa.array(again))], ["label", "width", "pair", "id"])

    held = nodes.select("id", "label", (F.octet_length("unit") / 8).cast("long").alias("width"), "points")
    name = ["label", "width", "pair"]
    dealt = staged(held.mapInArrow(lists, "label long, width long, pair long, id long"), "lists")
    sizes = staged(dealt.groupBy(*name).agg(F.count("*").alias("m")).filter("m > 1").withColumn("t", F.ceil(F.col("m") / tile).cast("int")).drop("m"), "list-sizes")
    tiled = dealt.join(sizes, name).withColumn("own", F.pmod(F.xxhash64("id"), F.col("t")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("lo"), F.greatest(F.col("own"), o).alias("hi")))
    key = [*name, "lo", "hi"]
    tiled = staged(tiled.select(*name, F.explode(pairs).alias("p"), "own", "id").select(*name, "p.lo", "p.hi", "own", "id"), "tiles")
    full = tiled.join(nodes.select("id", "w", "unit", "points"), "id").select(*key, "own", "id", "w", "unit", "points")

    def out(rows: list[np.ndarray], units: list[bytes], points: np.ndarray) -> pa.RecordBatch:
        _, _, pair, lo, hi, own, ids, w = rows
        x = np.frombuffer(b"".join(units), np.float64).reshape(len(ids), -1)
        n, total = len(ids), np.zeros(len(ids), np.int64)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in linked_pairs(x, points, (int(pair[0]) >> 32, int(pair[0]) & 0xFFFFFFFF), threshold):
                if lo[0] != hi[0]:  # pairs within a tile are found where it is laid against itself
                    across = own[a] != own[b]
                    a, b = a[across], b[across]
                np.add.at(total, a, w[b])
                np.add.at(total, b, w[a])
                yield a, b

        a, b = spanned(n, found())
        some = np.nonzero(total)[0]
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((np.minimum(ids[a], ids[b]), ids[some]))), pa.concat_arrays([pa.array(np.maximum(ids[a], ids[b])), none(len(some))]), pa.concat_arrays([none(len(a)), pa.array(total[some])])],
            ["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if kept:
                b = pa.Table.from_batches(kept).combine_chunks()
                kept.clear()
                if len(b) > 1:
                    rows = [b.column(k).to_numpy().astype(np.int64) for k in range(8)]
                    yield out(rows, b.column(8).to_pylist(), np.stack(b.column(9).to_numpy()))

        last = None
        for b in batches:
            if not len(b):
                continue
            keys = np.stack([b.column(k).to_numpy() for k in range(5)], axis=1)
            for part in np.split(np.arange(len(b)), np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1):
                now = tuple(keys[part[0]].tolist())
                if now != last:
                    yield from flush()
                    last = now
                kept.append(b.slice(int(part[0]), len(part)))
        yield from flush()

    return staged(full.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long, n long"), "linked")


def components(vectors: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS, listed: int = LISTED, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = described(vectors, pivots, listed)
    can = rows.filter("d0 IS NOT NULL")
    nodes = can.groupBy("d0", "d1").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), *(F.first(c).alias(c) for c in ("label", "unit", "points")))
    nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    found = linked(nodes.select("id", "label", "w", "unit", "points"), threshold, tile)
    roots = classes(found.filter("n IS NULL").select("a", "b").distinct())
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    named = nodes.select("d0", "d1", "w", "least", "id").join(counts, "id", "left").join(roots, F.col("id") == roots["node"], "left")
    named = staged(named.select("d0", "d1", "least", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root")), "named")
    ids = staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")  # a table, so that a large component's nodes are split
    of = staged(named.join(ids, "root").select("d0", "d1", "n_links", "component_id"), "of-nodes")
    whole = rows.select("vec_id", "d0", "d1").join(of, ["d0", "d1"], "left")
    whole = whole.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("d0").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, **how: int) -> DataFrame:
    """The rows that stay, with their own columns: of each component that with the smallest ``vec_id`` (rows that repeat it stay together)."""
    of = components(vectors, threshold, **how).filter("kept").select(F.col("vec_id").alias("_stays")).distinct()
    return vectors.join(of, vectors["vec_id"].cast("long") == of["_stays"], "left_semi")
