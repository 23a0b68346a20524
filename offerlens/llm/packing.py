"""Best-fit packing by linear grouping.

A document's ids (closed by an end id) are cut into pieces of at most ``capacity``; only the first piece may be shorter. Full
pieces are sequences of their own. The others are packed:

1. the histogram of their lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver;
2. lengths over ``SMALL`` are sorted and split into ``GROUPS`` groups of equal cardinality; within a group they count as its
   largest, and configurations of these few sizes are chosen, fullest first, each as often as its counts allow;
3. actual pieces are substituted by their rank: the k-th piece of a group takes the k-th slot of that group;
4. the small ones go, longest first, to the sequences with the least room that is enough, again by histogram and rank;
   what fits nowhere opens new sequences by the same configurations.

Ranks need no sort and no large window: a task numbers its pieces of each length, and counts by (task, length) are summed up.

Defined results: a null or empty text has only the end id; rows that repeat are packed each; a null ``doc_id`` is returned as
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CAPACITY, END_ID, GROUPS, SMALL = 1024, 2, 1024, 128
#: Counts by task are summed up in ranges of so many tasks first, so that no window holds a row for every task.
TASKS_IN_RANGE = 32
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"


@lru_cache(2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text as the tokenizers library gives them for the file, without added special tokens.

    A byte-level BPE whose ids stand in the order of its merges is run by tiktoken (same ids, less time); any other file by tokenizers.
    """
    spec = json.load(open(path, encoding="utf-8")) if path.endswith(".json") else {}
    vocab, merges = spec.get("model", {}).get("vocab", {}), spec.get("model", {}).get("merges", [])
    pre = spec.get("pre_tokenizer") or {}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", []))
    if plain and [vocab.get(t) for t in merged] == list(range(256, 256 + len(merges))) and len(vocab) == 256 + len(merges):
        import public_tokenizers
        import tiktoken

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in vocab.items()}, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            try:
                return model.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its pattern gives up on a run of about a million white-space characters
                return library(path)(text)

        return encode
    return library(path)


@lru_cache(2)
def library(path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text by the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece, numbered by task and length; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "").astype("<u4"), np.uint32(end_id)).astype("<u4")
                at, n = 0, (len(ids) - 1) % capacity + 1
                for piece in range(-(-len(ids) // capacity)):
                    out.append((doc_id, piece, at, n, zlib.crc32(ids[at : at + n].tobytes()), part, int(seen[n])))
                    seen[n] += 1
                    at, n = at + n, capacity
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return staged(slim.mapInArrow(run, PIECES), "pieces")


def fullest(room: int, sizes: list[int], counts: list[int]) -> list[int]:
    """Places in ``sizes`` (falling) of a multiset, within ``counts``, whose sum is as near to ``room`` as can be."""
    reach, trail, keep = 1, [], (1 << (room + 1)) - 1
    for s, n in zip(sizes, counts, strict=True):
        trail.append(reach)
        for _ in range(min(n, room // s)):
            further = (reach | reach << s) & keep
            if further == reach:
                break
            reach = further
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for i in range(len(trail) - 1, -1, -1):
        while not trail[i] >> total & 1:  # as few of the smaller sizes as it takes
            total -= sizes[i]
            chosen.append(i)
    return chosen


def configurations(sizes: list[int], counts: list[int], capacity: int) -> Iterator[tuple[int, list[int]]]:
    """(how often, places in ``sizes``) until all ``counts`` are used; ``sizes`` fall."""
    left = list(counts)
    for i, s in enumerate(sizes):
        while left[i]:
            left[i] -= 1
            rest = [k for k in range(i, len(sizes)) if left[k]]
            chosen = [i, *(rest[k] for k in fullest(capacity - s, [sizes[k] for k in rest], [left[k] for k in rest]))]
            left[i] += 1
            need = {k: chosen.count(k) for k in chosen}
            times = min(left[k] // n for k, n in need.items())
            for k, n in need.items():
                left[k] -= times * n
            yield times, chosen


def plan_large(histogram: dict[int, int], capacity: int, groups: int, first_sequence: int = 0) -> tuple[np.ndarray, int]:
    """Rows (first place, count, first sequence, slot) over the places of all pieces sorted by falling length; and the next sequence."""
    lengths = sorted(histogram, reverse=True)
    ends = np.cumsum([histogram[x] for x in lengths])
    total = int(ends[-1]) if lengths else 0
    edges = sorted({round(i * total / min(groups, total)) for i in range(min(groups, total) + 1)}) if total else []
    sizes, counts, starts = [], [], []
    for a, z in zip(edges, edges[1:], strict=False):
        size = lengths[int(np.searchsorted(ends, a, "right"))]  # rounded up to the longest of the group
        if sizes and sizes[-1] == size:
            counts[-1] += z - a
        else:
            sizes.append(size)
            counts.append(z - a)
            starts.append(a)
    rows, used, sequence = [], [0] * len(sizes), first_sequence
    for times, chosen in configurations(sizes, counts, capacity):
        for slot, k in enumerate(chosen):
            rows.append((starts[k] + used[k], times, sequence, slot))
            used[k] += times
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4), sequence


def plan_small(histogram: dict[int, int], rooms: dict[int, int]) -> tuple[np.ndarray, dict[int, int]]:
    """Best fit by histogram: rows (first place, count, first bin, slot) and the lengths left over.

    Places are those of small pieces by falling length, bins those of sequences by falling room (``rooms``: room, how many).
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    at = 0
    for room in sorted(rooms, reverse=True):
        runs[room] = [(at, rooms[room])]
        at += rooms[room]
    rows, place, over, slot = [], 0, {}, 1000
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and (fit := min((r for r in runs if r >= length), default=None)) is not None:
            first, n = runs[fit].pop()
            take = min(left, n)
            if take < n:
                runs[fit].append((first + take, n - take))
            if not runs[fit]:
                del runs[fit]
            runs.setdefault(fit - length, []).append((first, take))
            rows.append((place, take, first, slot))
            place, left, slot = place + take, left - take, slot + 1
        if left:
            over[length] = left
            place += left
    return np.array(rows, np.int64).reshape(-1, 4), over


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """Turns a task's own rank among rows of equal ``by`` into a rank over all tasks."""
    counts = rows.groupBy("part", by).agg((F.max("rank") + 1).alias("n")).withColumn("_range", (F.col("part") / TASKS_IN_RANGE).cast("int"))
    upto = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = counts.withColumn("_inside", upto([by, "_range"], "part"))
    ranges = counts.groupBy(by, "_range").agg(F.sum("n").alias("n")).withColumn("_before", upto([by], "_range")).drop("n")
    base = inside.join(ranges, [by, "_range"]).select(F.col("part").alias("_part"), F.col(by).alias("_by"), (F.col("_inside") + F.col("_before")).alias("_base"))
    joined = rows.join(base, (rows["part"] == base["_part"]) & (rows[by] == base["_by"]))
    return joined.withColumn("rank", F.col("rank") + F.col("_base")).drop("_part", "_by", "_base", "part")


def placed(rows: DataFrame, by: str, histogram: dict[int, int], plan: np.ndarray, names: tuple[str, str]) -> DataFrame:
    """Adds ``names`` (where the plan puts a row, and its slot); -1 where it has no place for it. Rows are ranked."""
    first, at = np.zeros(max(histogram, default=0) + 1, np.int64), 0
    for x in sorted(histogram, reverse=True):
        first[x] = at
        at += histogram[x]
    cols = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = first[b.column(cols.index(by)).to_numpy()] + b.column(cols.index("rank")).to_numpy()
            i = np.searchsorted(plan[:, 0], place, "right") - 1 if len(plan) else np.full(len(place), -1)
            row = plan[np.maximum(i, 0)] if len(plan) else np.zeros((len(place), 4), np.int64)
            inside = (i >= 0) & (place < row[:, 0] + row[:, 1])
            to = np.where(inside, row[:, 2] + place - row[:, 0], -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to), pa.array(np.where(inside, row[:, 3], -1))], [*cols, *names])

    return rows.mapInArrow(run, ", ".join([f"{c} {k}" for c, k in rows.dtypes] + [f"{n} long" for n in names]))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    all_pieces = pieces(docs, path, capacity, end_id)
    counts = {r["length"]: r["count"] for r in all_pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    of_large = {x: n for x, n in counts.items() if small < x < capacity}
    of_small = {x: n for x, n in counts.items() if x <= small}
    plan, sequences = plan_large(of_large, capacity, groups)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = all_pieces.filter(F.col("length") == capacity).select(*keep, (-1 - F.shiftleft(F.col("part").cast("long"), 40) - F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("slot"))
    rest = ranked(all_pieces.filter(F.col("length") < capacity), "length")
    large = placed(rest.filter(F.col("length") > small), "length", of_large, plan, ("sequence_id", "slot")).drop("rank")
    large = staged(large, "large")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            room = b.column(1).to_numpy()
            order = np.argsort(room, kind="stable")
            value, start, n = np.unique(room[order], return_index=True, return_counts=True)
            rank = np.empty(len(room), np.int64)
            rank[order] = np.arange(len(room)) - np.repeat(start, n) + seen[room[order]]
            seen[value] += n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(room), part, np.int32)), pa.array(rank)], ["sequence_id", "room", "part", "rank"])

    rooms = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("room"))
    bins = staged(rooms.mapInArrow(number, "sequence_id long, room int, part int, rank long"), "bins")
    of_rooms = {r["room"]: r["count"] for r in bins.groupBy("room").count().collect()}  # at most ``capacity`` rows
    fits, over = plan_small(of_small, of_rooms)
    opened, _ = plan_large(over, capacity, groups, sequences)
    little = placed(rest.filter(F.col("length") <= small), "length", of_small, fits, ("bin", "slot"))
    little = staged(little, "small")
    # bins by falling room are numbered like the plan's
    one_each = np.array([(0, sum(of_rooms.values()), 0, 0)], np.int64)
    numbered = placed(ranked(bins, "room"), "room", of_rooms, one_each, ("bin", "_slot")).select("bin", "sequence_id")
    fitted = little.filter("bin >= 0").join(numbered, "bin").select(*keep, "sequence_id", "slot")
    # what is left over of a length are its last ranks
    skip = F.element_at(F.create_map(*[F.lit(v) for x, n in over.items() for v in (x, of_small[x] - n)]), F.col("length")) if over else F.lit(0)
    more = placed(little.filter("bin < 0").drop("bin", "slot").withColumn("rank", F.col("rank") - skip), "length", over, opened, ("sequence_id", "slot")).select(*keep, "sequence_id", "slot")
    together = large.select(*keep, "sequence_id", "slot").unionByName(fitted).unionByName(more)
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    packed = together.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).unionByName(full.withColumn("offset", F.lit(0).cast("long")))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
