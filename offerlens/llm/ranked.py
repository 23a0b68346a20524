"""Ranked lexical search: threshold-seeded join, exact scores.

1. One pass over the documents keeps, of each text, the number of its terms and the counts of those terms that any item asks for.
2. Document frequencies give the weights; per term the k-th best impact over all documents is stored, and the best one. A document scores no less than
   one term's impact, so the largest k-th impact among an item's terms is a lower bound of its k-th score.
3. An item's terms are ordered by their best impact; those whose best impacts sum to less than the bound can't bring a document
   in by themselves: they are pruned (ties stay, as the sum must be smaller).
4. Candidates come from a join of the other terms' entries with the documents' terms. A task raises an item's bound by the k-th score it has seen, drops
   candidates whose partial score plus the pruned terms' best impacts stay below it, and scores the rest exactly over all terms. It returns k rows an item at most;
   a window takes the k best of all tasks.

No posting list is gathered anywhere, so a term that stands in every document is no large group. Items go in blocks of at most ``ENTRIES`` terms (each of
the blocks is a broadcast of that bound, and a pass over all documents): the number of items isn't limited. An item's own terms are held whole.

Defined results: scores are 64-bit whole numbers as stated by ``score_of``; equal scores go by doc_id, a null doc_id last, then in any order. Every row is a
document of its own and every row of the items an item of its own, also where ids repeat or are null. Texts without terms (null, empty) count
in nothing. Without documents or items the result is empty. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged

K, ENTRIES, CELLS, WINDOW = 10, 1_000_000, 1 << 21, 1 << 20
#: Bytes that end a term become a space; A-Z are lower-cased; all others stay.
BYTES = bytes(b if chr(b) in "0123456789" + LOWER or b >= 0x80 else ord(chr(b).lower()) if chr(b) in UPPER else 0x20 for b in range(256))


def terms_of(text: str | None) -> Counter[bytes]:
    """The terms of a whole text with their counts, by windows that end between terms."""
    plain, found, at = (text or "").encode().translate(BYTES), Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + WINDOW) if at + WINDOW < len(plain) else len(plain)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def factors(tf: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term's weight is multiplied by, in 64-bit whole numbers."""
    m = 10 + 90 * length * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def item_terms(items: DataFrame) -> DataFrame:
    """A table (item, item_id, terms): every row of the items with its distinct terms, in order; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(terms_of(t)) for t in b.column(1).to_pylist()], pa.list_(pa.binary()))], ["item_id", "terms"])

    slim = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    found = staged(slim.mapInArrow(run, "item_id long, terms array<binary>").filter("size(terms) > 0"), "item-terms")
    return staged(found.withColumn("item", F.monotonically_increasing_id()), "items")


def blocks(items: DataFrame, entries: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in blocks of at most ``entries`` terms, one item at least, read one by one."""
    held: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for row in items.orderBy("item").select("item_id", "terms").toLocalIterator():
        if held and size + len(row.terms) > entries:
            yield held
            held, size = [], 0
        held.append((row.item_id, [bytes(t) for t in row.terms]))
        size += len(row.terms)
    if held:
        yield held


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A table (doc_id, n, terms, tfs) of the documents that have a term: n counts all terms, the lists hold those of the ``vocabulary``, by number."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                ids, lengths, terms, tfs = [], [], [], []
                for doc_id, text in zip(*(whole.column(k).slice(at, 256).to_pylist() for k in (0, 1)), strict=True):
                    found = terms_of(text)
                    if found:
                        own = [(number[t], c) for t, c in found.items() if t in number]
                        ids.append(doc_id)
                        lengths.append(found.total())
                        terms.append([t for t, _ in own])
                        tfs.append([c for _, c in own])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return staged(slim.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>"), "postings")


def flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of a batch's documents, and place, term and count of all their entries."""
    sizes = np.diff(b.column(2).offsets.to_numpy())
    return b.column(1).to_numpy(), np.repeat(np.arange(len(b)), sizes), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()


def impacts(held: DataFrame, documents: int, terms: int, k: int) -> DataFrame:
    """(term, kth, best) of the terms' factors over all documents; kth is 0 if fewer than ``k`` hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, doc, term, tf = flat(b)
            factor = factors(tf, n[doc], documents, terms)
            order = np.lexsort((-factor, term))
            term, factor = term[order], factor[order]
            first = np.searchsorted(term, term, "left")
            few = np.arange(len(term)) - first < k  # the best k of a batch
            yield pa.RecordBatch.from_arrays([pa.array(term[few]), pa.array(factor[few])], ["term", "factor"])

    best = held.mapInArrow(run, "term int, factor long").withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("factor")))).filter(F.col("rank") <= k)
    return staged(best.groupBy("term").agg(F.coalesce(F.max(F.when(F.col("rank") == k, F.col("factor"))), F.lit(0)).alias("kth"), F.max("factor").alias("best")), "impacts")


def seeded(items: list[tuple[int | None, list[int]]], weights: np.ndarray, kth: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each item: the bound of its k-th score, the sum of the pruned terms' best impacts, its essential terms and all its terms."""
    bounds, rest, essential, every = [], [], [], []
    for _, terms in items:
        own = np.array([t for t in terms if weights[t] > 0 and best[t] > 0], np.int64)
        own = own[np.argsort(weights[own] * best[own], kind="stable")]
        top = np.cumsum(weights[own] * best[own])
        bound = int((weights[own] * kth[own]).max(initial=0))
        pruned = int(np.searchsorted(top, bound, "left"))  # sums below the bound
        bounds.append(bound)
        rest.append(int(top[pruned - 1]) if pruned else 0)
        essential.append(own[pruned:])
        every.append(own)
    return np.array(bounds, np.int64), np.array(rest, np.int64), essential, every


def best_of(found: np.ndarray, k: int) -> np.ndarray:
    """Rows (item, score, no id, doc_id): the best k of each item."""
    found = found[np.lexsort((found[:, 3], found[:, 2], -found[:, 1], found[:, 0]))]
    return found[np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0], "left") < k]


def search_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], first: int, k: int) -> DataFrame | None:
    """A table (item, item_id, doc_id, score) of each task's best ``k`` for each item; None if no document has a term."""
    spark = docs.sparkSession
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    held = postings(docs, vocabulary)
    documents, terms = held.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    weights, kth, best = (np.zeros(len(vocabulary), np.int64) for _ in range(3))
    for row in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weights[row.term] = weight(documents, row["count"])
    for row in impacts(held, documents, terms, k).toLocalIterator():
        kth[row.term], best[row.term] = row.kth, row.best
    numbered = [(item_id, [vocabulary[t] for t in own]) for item_id, own in items]
    bounds, rest, essential, every = seeded(numbered, weights, kth, best)
    # entries by term: the items in which it is essential
    terms_in = np.concatenate([*essential, np.empty(0, np.int64)])
    items_in = np.repeat(np.arange(len(items)), [len(e) for e in essential])
    order = np.argsort(terms_in, kind="stable")
    starts = np.searchsorted(terms_in[order], np.arange(len(vocabulary) + 1))
    plan = spark.sparkContext.broadcast((weights, bounds, rest, starts, items_in[order], every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bounds, rest, starts, entries, every = plan.value
        bounds, many = bounds.copy(), len(bounds)
        top = np.empty((0, 4), np.int64)
        look = np.zeros(len(weights), np.int64)  # a document's impacts by term

        def scored(part: pa.RecordBatch) -> np.ndarray:
            n, doc, term, tf = flat(part)
            impact = weights[term] * factors(tf, n[doc], documents, terms)
            size = starts[term + 1] - starts[term]
            at = np.repeat(starts[term] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            partial = np.zeros(len(part) * many, np.int64)
            np.add.at(partial, np.repeat(doc, size) * many + entries[at], np.repeat(impact, size))
            partial = partial.reshape(len(part), many)
            if len(part) >= k:  # a partial score is no more than the score
                np.maximum(bounds, np.partition(partial, len(part) - k, axis=0)[len(part) - k], out=bounds)
            d, item = np.nonzero((partial > 0) & (partial + rest >= bounds))
            score = np.empty(len(d), np.int64)
            ends = np.searchsorted(doc, np.arange(len(part) + 1))
            for lo, hi in zip(*(np.searchsorted(d, np.unique(d), side) for side in ("left", "right")), strict=True):
                own = slice(ends[d[lo]], ends[d[lo] + 1])
                look[term[own]] = impact[own]
                score[lo:hi] = [look[every[i]].sum() for i in item[lo:hi].tolist()]
                look[term[own]] = 0
            ids = part.column(0)
            none = np.asarray(ids.is_null())
            return np.stack((item, score, none[d].astype(np.int64), ids.fill_null(0).to_numpy()[d]), axis=1)

        step = max(1, CELLS // many)
        for b in batches:
            for at in range(0, len(b), step):
                found = scored(b.slice(at, step))
                if len(found):
                    top = best_of(np.concatenate((top, found)), k)
                    at_k = np.nonzero(np.arange(len(top)) - np.searchsorted(top[:, 0], top[:, 0], "left") == k - 1)[0]
                    bounds[top[at_k, 0]] = np.maximum(bounds[top[at_k, 0]], top[at_k, 1])
        if len(top):
            yield pa.RecordBatch.from_arrays([pa.array(top[:, 0]), pa.array(top[:, 3], mask=top[:, 2] > 0), pa.array(top[:, 1])], ["item", "doc_id", "score"])

    found = held.mapInArrow(run, "item long, doc_id long, score long")
    names = spark.createDataFrame([(n, item_id) for n, (item_id, _) in enumerate(items)], "item long, item_id long")
    return staged(found.join(names, "item").select((F.col("item") + first).alias("item"), "item_id", "doc_id", "score"), "found")


def search(docs: DataFrame, items: DataFrame, k: int = K, entries: int = ENTRIES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0."""
    first, found = 0, docs.sparkSession.createDataFrame([], "item long, item_id long, doc_id long, score long")
    for block in blocks(item_terms(items), entries):
        part = search_block(docs, block, first, k)
        first += len(block)
        if part is not None:
            found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
