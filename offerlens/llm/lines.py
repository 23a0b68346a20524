"""Substring dedup by hashing units of lines: of repeated units the earliest occurrence stays, runs of the others are removed.

1. A line (or paragraph: texts part them by line ends) is cut into units so that a passage inside a long line is found as well:
   at the ends of sentences; neighbouring sentences or lines of fewer than ``LEAST_WORDS`` words are joined to one stretch; a
   sentence or stretch of more than ``MOST_WORDS`` words is cut where the hash of two words in a row is the least of its nine, so
   that the same words are cut alike whatever stands before them (one word over and over has no such place). Every word is in one unit.
2. A unit is normalised (lower case, one space between words) and hashed to 128 bits. Per digest the first occurrence (by
   ``doc_id``, null last, then place) is a partial minimum; the units of digests found more than once are joined with it.
3. Units that stand elsewhere before are removed where they follow each other in runs of ``LEAST_RUN`` words or more: a line of that length that
   is repeated whole, or a passage of several units. A single common sentence, which any two texts may share, stays.

A passage that many documents share is no large group in any step: the minimum is combined before its shuffle, Spark splits the
join's skewed partitions, and runs are found within a document.

Defined results: a null text has no units; rows that repeat are told apart by a row number, the first stays; offsets are code
points of the original text; an empty table gives an empty result; extra columns are ignored by ``repeats`` and carried by ``clean``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LEAST_WORDS, MOST_WORDS, ASIDE, LEAST_RUN = 5, 15, 4, 25
UNIT = re.compile(r"\S(?:.*?[.!?]+(?=\s)|.*)")
WORDS = re.compile(r"\S+")
UNITS = "doc_id long, row long, place int, begin int, end int, n_words int, digest binary"


def units(text: str, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, bytes]]:
    """(begin, end, words, digest) of every unit."""
    short, n_short = [0, 0], 0
    for m in UNIT.finditer(text):
        words, end = m[0].lower().split(), m.start() + len(m[0].rstrip())
        if len(words) < least_words:
            short, n_short = [short[0] if n_short else m.start(), end], n_short + len(words)
            continue
        if n_short:
            yield from cut_up(text, *short)
            n_short = 0
        if len(words) <= MOST_WORDS:
            yield m.start(), end, len(words), xxhash.xxh3_128_digest(" ".join(words))
        else:
            yield from cut_up(text, m.start(), end)
    if n_short:
        yield from cut_up(text, *short)


def cut_up(text: str, begin: int, end: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The units of a stretch of text, each of at least ``ASIDE`` + 1 words if it is cut at all."""
    spans = [m.span() for m in WORDS.finditer(text, begin, end)]
    words, at = [text[a:b].lower() for a, b in spans], 0
    if len(words) > MOST_WORDS:
        h = [zlib.crc32(f"{a} {b}".encode(errors="replace")) for a, b in zip(words, words[1:])]
        for i in range(ASIDE, len(h) - ASIDE):
            if h[i] < min(h[i - ASIDE : i]) and h[i] <= min(h[i + 1 : i + 1 + ASIDE]):
                yield spans[at][0], spans[i][1], i + 1 - at, xxhash.xxh3_128_digest(" ".join(words[at : i + 1]))
                at = i + 1
    yield spans[at][0], spans[-1][1], len(words) - at, xxhash.xxh3_128_digest(" ".join(words[at:]))


def listed(docs: DataFrame, least_words: int = LEAST_WORDS, row: str | None = None) -> DataFrame:
    """The units of every document with their place in it, and the text's row number (column ``row`` or a new one), written once."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = TaskContext.get().partitionId() << 33, []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        for b in batches:
            numbers = b.column(2).to_pylist() if row else range(number, number + len(b))
            number += len(b)
            for doc_id, text, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), numbers, strict=True):
                out += [(doc_id, n, k, *u) for k, u in enumerate(units(text or "", least_words))]
                if len(out) > 50_000:
                    yield pack()
                    out = []
        if out:
            yield pack()

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *([docs[row].alias("row")] if row else []))
    return staged(slim.mapInArrow(run, UNITS), "units")


def repeats(docs: DataFrame, least_run: int = LEAST_RUN, least_words: int = LEAST_WORDS, row: str | None = None) -> DataFrame:
    """A row for each unit to remove: doc_id, row, begin, end, n_words, and where its first occurrence stands (first_doc_id, first_begin)."""
    found = listed(docs, least_words, row)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "begin")
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = staged(first, "first-units")  # read from a table, so that Spark splits a digest's units if they are many
    again = found.join(first, "digest").filter((F.col("row") != F.col("first.row")) | (F.col("begin") != F.col("first.begin")))
    again = again.select("doc_id", "row", "place", "begin", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.begin").alias("first_begin"))
    runs = again.withColumn("_run", F.col("place") - F.row_number().over(Window.partitionBy("row").orderBy("place")))
    whole = runs.withColumn("_words", F.sum("n_words").over(Window.partitionBy("row", "_run"))).filter(F.col("_words") >= least_run)
    return whole.select("doc_id", "row", "begin", "end", "n_words", "first_doc_id", "first_begin")


def clean(docs: DataFrame, least_run: int = LEAST_RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with its runs of repeated units cut out of ``text``, and ``removed`` (begin, end in the original text).

    Spans are joined by a row number that is written first, so null and repeated ids are told apart; of rows that repeat whole the first stays.
    """
    row = next(c for c in ("_row" + "_" * n for n in range(len(docs.columns) + 1)) if c not in docs.columns)
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "clean-rows")
    spans = repeats(rows, least_run, least_words, row).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("_spans"))
    joined = rows.join(spans, rows[row] == spans["row"], "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            at, kept = 0, []
            for x in s:
                kept.append(t[at : x["begin"]])
                at = x["end"]
            return "".join(kept) + t[at:]

        return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    removed = F.coalesce(spans["_spans"], F.array().cast("array<struct<begin:int,end:int>>"))
    own = {c: rows[c] for c in docs.columns} | {"removed": removed, "text": cut(rows["text"].cast("string"), spans["_spans"])}
    return joined.select(*(c.alias(k) for k, c in own.items()))
