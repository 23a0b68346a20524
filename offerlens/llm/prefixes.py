"""Conversation prefix trie, merged family first.

A family is a base conversation (its id is a multiple of 5) and those that are rebuilt from it: conversation c begins with the first h turns of
c - c % 5 (the remainder takes c's sign, as in SQL), h = crc32 of the decimal id modulo 9, and goes on with its own turns after its first h.

1. Families are cogrouped by their base's id in one sorted stream: the base's turns come first, of which only the first eight are kept, as digests.
   Each family's own trie is built as its turns pass by. A node is named by a chained 128-bit digest of roles and texts.
2. Only the families' nodes are shuffled: by digest for each node's smallest member and whether all members end there.
   What is in one family only needs no partner; digests with a thousandth of all rows or more (a thousand at most) are joined by broadcast.
3. Each distinct node belongs to the family of its smallest member. So sums over the distinct nodes of a subtree are sums over families of what they own
   there, and saved_tokens is (members x bytes) less (bytes of distinct nodes): each family adds up its own trie, a last aggregation adds the families.
   No step walks the levels of the whole trie.
4. ends_sha256 is taken over a sorted stream of ids, a node at a time in constant memory (a hash of one long string can't be split).

A task holds digests and counts of one family at a time (five conversations; some 200 bytes a turn), never its texts.

Defined results: turns with equal numbers go by role, then text; a null turn comes first; a null role or text is empty; rows that repeat are turns of their
own. Rows without conv_id belong to no conversation. A conversation whose base is absent loses its first h turns and may be turnless. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

FAMILY, HEADS = 5, 9
ROOT = bytes(16)
NODE = "base long, place int, up int, d0 long, d1 long, depth long, n long, lo long, bytes long, ends array<long>"
ROWS_AT_ONCE = 8192


def head(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def step(before: bytes, role: str, text: str) -> tuple[bytes, int]:
    """The digest of a node from its parent's, and the bytes of its text."""
    r, t = role.encode(), text.encode()
    return hashlib.blake2b(before + len(r).to_bytes(8, "little") + r + t, digest_size=16).digest(), len(t)


class Family:
    """The trie of one family, filled turn by turn."""

    def __init__(self) -> None:
        self.heads: list[tuple[bytes, int]] = []
        self.place = {ROOT: 0}
        self.up, self.depth, self.n, self.lo, self.bytes, self.ends = [-1], [0], [0], [0], [0], [[]]
        self.digests = [ROOT]
        self.at, self.conv, self.turn, self.skip = 0, 0, 0, 0

    def visit(self, place: int) -> None:
        self.at = place
        self.n[place] += 1
        self.lo[place] = self.conv if self.n[place] == 1 else min(self.lo[place], self.conv)

    def go(self, digest: bytes, size: int) -> None:
        place = self.place.get(digest)
        if place is None:
            place = self.place[digest] = len(self.digests)
            self.digests.append(digest)
            for column, value in ((self.up, self.at), (self.depth, self.depth[self.at] + 1), (self.n, 0), (self.lo, 0), (self.bytes, size), (self.ends, [])):
                column.append(value)
        self.visit(place)

    def begin(self, conv: int, base: bool) -> None:
        self.conv, self.turn, self.skip = conv, 0, 0 if base else head(conv)
        self.visit(0)
        for digest, size in self.heads[: self.skip]:
            self.go(digest, size)

    def add(self, role: str, text: str, base: bool) -> None:
        self.turn += 1
        if self.turn > self.skip:
            digest, size = step(self.digests[self.at], role, text)
            self.go(digest, size)
            if base and self.turn < HEADS:
                self.heads.append((digest, size))

    def end(self) -> None:
        self.ends[self.at].append(self.conv)


def family_nodes(turns: DataFrame) -> DataFrame:
    """A row for each node of each family's trie, parents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        base, conv, family = None, None, Family()

        def close() -> None:
            if conv is not None:
                family.end()

        def out(least: int) -> Iterator[pa.RecordBatch]:
            while len(rows) > least:
                some = rows[:ROWS_AT_ONCE]
                del rows[:ROWS_AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

        def finish() -> None:
            close()
            words = np.frombuffer(b"".join(family.digests), np.int64).reshape(-1, 2)
            rows.extend(zip([base] * len(words), range(len(words)), family.up, words[:, 0].tolist(), words[:, 1].tolist(), family.depth, family.n, family.lo, family.bytes, family.ends, strict=True))

        names = [x.split()[0] for x in NODE.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.list_(pa.int64())]
        for whole in batches:
            for at in range(0, len(whole), 1024):
                for b, c, role, text in zip(*(whole.column(k).slice(at, 1024).to_pylist() for k in range(4)), strict=True):
                    if b != base:
                        if base is not None:
                            finish()
                        base, conv, family = b, None, Family()
                    if c != conv:
                        close()
                        conv = c
                        family.begin(c, c == b)
                    family.add(role, text, c == b)
                yield from out(ROWS_AT_ONCE)
        if base is not None:
            finish()
        yield from out(0)

    c = turns["conv_id"].cast("long")
    text = lambda name: F.coalesce(turns[name].cast("string"), F.lit(""))
    slim = turns.filter(c.isNotNull()).select((c - c % FAMILY).alias("base"), c.alias("conv_id"), text("role").alias("role"), text("text").alias("text"), turns["turn"].cast("long").alias("turn"))
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "text"]
    return staged(slim.repartition("base").sortWithinPartitions(*order).mapInArrow(run, NODE), "family-nodes")


def summed(nodes: DataFrame) -> DataFrame:
    """Each family's share of its nodes' results. ``nodes`` has of every node also ``least`` (the smallest member of all families) and ``leaf``."""
    cols = ["base", "up", "d0", "d1", "depth", "n", "lo", "bytes", "least", "leaf", "place"]
    made = "d0 long, d1 long, depth long, n long, lo long, parent long, children long, leaves long, saved long"

    def shares(rows: list[list]) -> list[tuple]:
        up, d0, d1, depth, n, lo, size, least, leaf = rows
        own = [x == y for x, y in zip(lo, least, strict=True)]
        children, leaves = [0] * len(up), [int(x and y) for x, y in zip(own, leaf, strict=True)]
        saved = [x * s - s * o for x, s, o in zip(n, size, own, strict=True)]
        for k in range(len(up) - 1, 0, -1):  # children stand after their parents
            p = up[k]
            children[p] += own[k]
            leaves[p] += leaves[k]
            saved[p] += saved[k]
        return list(zip(d0, d1, depth, n, lo, [least[p] if p >= 0 else None for p in up], children, leaves, saved, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(9)]
        base, rows = None, []
        names = [x.split()[0] for x in made.split(", ")]

        def batch(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names)

        for whole in batches:
            for at in range(0, len(whole), 1024):
                for b, *values in zip(*(whole.column(k).slice(at, 1024).to_pylist() for k in range(10)), strict=True):
                    if b != base:
                        if base is not None:
                            rows += shares(held)
                        base, held = b, [[] for _ in range(9)]
                    for column, value in zip(held, values, strict=True):
                        column.append(value)
                while len(rows) > ROWS_AT_ONCE:
                    yield batch(rows[:ROWS_AT_ONCE])
                    del rows[:ROWS_AT_ONCE]
        if base is not None:
            rows += shares(held)
        for at in range(0, len(rows), ROWS_AT_ONCE):
            yield batch(rows[at : at + ROWS_AT_ONCE])

    return nodes.select(*cols).repartition("base").sortWithinPartitions("base", "place").mapInArrow(run, made)


def end_hashes(nodes: DataFrame) -> DataFrame:
    """d0, d1 and ends_sha256 of nodes at which conversations end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["d0", "d1", "ends_sha256"])
            done.clear()
            return made

        for b in batches:
            if not len(b):
                continue
            keys = np.stack([b.column(k).to_numpy() for k in (0, 1)], axis=1)
            for part in np.split(np.arange(len(b)), np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1):
                ids, name = ",".join(map(str, b.column(2).slice(int(part[0]), len(part)).to_pylist())).encode(), tuple(keys[part[0]].tolist())
                if name == last:
                    digest.update(b"," + ids)
                    continue
                if last is not None:
                    done.append((*last, digest.hexdigest()))
                last, digest = name, hashlib.sha256(ids)
                if len(done) > ROWS_AT_ONCE:
                    yield out()
        if last is not None:
            done.append((*last, digest.hexdigest()))
            yield out()

    ids = nodes.select("d0", "d1", F.explode("ends").alias("conv_id"))
    return ids.repartition("d0", "d1").sortWithinPartitions("d0", "d1", "conv_id").mapInArrow(run, "d0 long, d1 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    nodes = family_nodes(turns)
    name = ["d0", "d1"]
    ended = F.coalesce(F.size("ends"), F.lit(0))
    whole = nodes.groupBy(*name).agg(F.min("lo").alias("least"), (F.sum("n") == F.sum(ended)).alias("leaf"), F.count("*").alias("families"))
    shared = staged(whole.filter("families > 1"), "shared-nodes")
    hot = shared.filter(F.col("families") * 1000 >= nodes.count()).drop("families")  # a thousand at most
    rest = nodes.join(F.broadcast(hot.select(*name)), name, "left_anti").join(shared.drop("families"), name, "left")
    rest = rest.withColumns({"least": F.coalesce("least", "lo"), "leaf": F.coalesce("leaf", F.col("n") == ended)})
    known = rest.unionByName(nodes.join(F.broadcast(hot), name))
    total = summed(known).groupBy(*name).agg(
        F.min("lo").alias("conv_id"), F.first("depth").alias("depth"), F.min("parent").alias("parent_conv_id"), F.sum("n").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    named = total.join(end_hashes(nodes), name, "left")
    return named.drop(*name).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
