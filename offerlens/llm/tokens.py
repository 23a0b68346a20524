"""Token counts: pieces are counted once per distinct pre-token and summed by document, without ids.

A pre-token here is a word with the space before it: texts are cut before every space that follows a character other than
white space, which is a border of the tokenizer's own pre-tokens whatever stands around it. So a text's pieces are the sum of
its pre-tokens' pieces.

A task turns a block of documents into pre-token frequencies. A pre-token of many documents of the block (or the first of
a text, or a very long one) is counted there; of any other a row goes out with the documents of the block that have it
(at most COMMON of them). Rows are dealt out by pre-token and sorted, so each distinct one is counted once, and the sums for a
block return as one row a task. Frequent words therefore never meet in one task.

That holds for byte-level BPE files that part words by the usual pattern (``has_borders``). For any other file a whole text is its only pre-token
and is counted where it is read.

Defined results: a null text counts as empty (0 tokens); null in other columns changes nothing; rows that repeat are
counted each; a null ``doc_id`` is returned as null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
BLOCK_BYTES, COMMON, LONG = 16 << 20, 16, 200
# The white space of the tokenizer's pattern (Unicode's White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"
ODD = re.compile(f"[{SPACE}] ")
BORDER = re.compile(f"(?<=[^{SPACE}]) ")

PARTS = "term string, block long, docs binary, times binary, doc_id long, n_bytes long, base long, n int"


@lru_cache(2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of each of some strings with the library of the file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def has_borders(path: str) -> bool:
    """Whether the file's own pre-tokens end before every space that follows a character other than white space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    return not spec.get("normalizer") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")


def whole_texts(path: str):
    """Counts each text as one pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter(path)(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text; all but the first without the space they begin with. Joined by spaces they are the text."""
    return BORDER.split(text) if ODD.search(text) else text.split(" ")


def blocks(path: str, block_bytes: int = BLOCK_BYTES, common: int = COMMON):
    """A task's documents as rows for documents (no term) and rows for pre-tokens."""

    def block(texts: list[str], ids: list, number: int) -> Iterator[pa.RecordBatch]:
        count, n = counter(path), len(texts)
        firsts, rest, sizes = [], [], np.empty(n, np.int64)
        for i, t in enumerate(texts):
            words = pre_tokens(t)
            firsts.append(words[0])
            sizes[i] = len(words) - 1
            rest += words[1:]
        base = np.array(count(firsts), np.int64)
        coded = pa.array(rest, pa.large_string()).dictionary_encode()
        del rest
        terms = coded.dictionary
        pair = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), sizes)
        pair.sort()
        edge = np.nonzero(np.concatenate(([True], pair[1:] != pair[:-1])))[0] if len(pair) else np.empty(0, np.int64)
        times = np.diff(np.append(edge, len(pair)))
        term, doc = np.divmod(pair[edge], n)
        start = np.searchsorted(term, np.arange(len(terms) + 1))
        here = np.diff(start) >= common
        here |= (pa.compute.utf8_length(terms).to_numpy() > LONG) if len(terms) else False
        own = np.nonzero(here)[0]
        pieces = np.zeros(len(terms), np.int64)
        pieces[own] = count([" " + x for x in terms.take(pa.array(own)).to_pylist()])
        np.add.at(base, doc, pieces[term] * times)
        yield rows(
            [None] * n, [number] * n, None, None, ids, [len(t.encode()) for t in texts], base, np.arange(n, dtype=np.int32)
        )
        gone = np.nonzero(~here)[0]
        keep = ~here[term]
        offsets = np.concatenate(([0], np.cumsum(np.diff(start)[gone]))).astype(np.int32)
        for a in range(0, len(gone), 50_000):
            z = min(a + 50_000, len(gone))
            lo, hi = offsets[a], offsets[z]
            if a == 0:
                docs_kept, times_kept = doc[keep].astype("<u4"), np.minimum(times[keep], 0xFFFFFFFF).astype("<u4")
            cut = pa.array((offsets[a : z + 1] - lo) * 4, pa.int32())
            packed = [pa.Array.from_buffers(pa.binary(), z - a, [None, cut.buffers()[1], pa.py_buffer(x[lo:hi].tobytes())]) for x in (docs_kept, times_kept)]
            yield rows(terms.take(pa.array(gone[a:z])).cast(pa.string()), [number] * (z - a), *packed, None, None, None, None)

    def rows(*columns) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        n = len(columns[1])
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PARTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, texts, ids, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.append(text or "")
                ids.append(doc_id)
                held += len(texts[-1])
                if held >= block_bytes:
                    yield from block(texts, ids, number)
                    number, texts, ids, held = number + 1, [], [], 0
        if texts:
            yield from block(texts, ids, number)

    return run


SUMS = "block long, n int, doc_id long, n_bytes long, tokens long, docs binary, worth binary"
#: So many (document, pieces) pairs are summed up at once.
PAIRS = 2_000_000


def summed(block: np.ndarray, docs: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by block and document, sorted by them."""
    order = np.lexsort((docs, block))
    block, docs, worth = block[order], docs[order], worth[order]
    edge = np.nonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (docs[1:] != docs[:-1]))))[0]
    return block[edge], docs[edge], np.add.reduceat(worth, edge)


def sums(path: str):
    """Rows sorted by pre-token: counts each distinct one, and gives a row of sums for each block; document rows pass."""
    names = [c.split()[0] for c in SUMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held, size = counter(path), [], 0
        last, last_pieces = None, 0
        for b in batches:
            plain = b.column(0).is_null()
            if (docs := b.filter(plain)).num_rows:
                none = pa.nulls(docs.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([docs.column(1), docs.column(7), docs.column(4), docs.column(5), docs.column(6), none, none], names)
            b = b.filter(b.column(0).is_valid())
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            terms = coded.dictionary.to_pylist()
            again = terms[0] == last  # a pre-token that goes on from the batch before
            pieces = np.array(([last_pieces] if again else []) + count([" " + x for x in terms[again:]]), np.int64)
            last, last_pieces = terms[-1], int(pieces[-1])
            each = pieces[coded.indices.to_numpy()]
            docs, times = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u4").astype(np.int64) for i in (2, 3))
            lengths = pa.compute.binary_length(b.column(2)).to_numpy() // 4
            held.append(summed(np.repeat(b.column(1).to_numpy(), lengths), docs, np.repeat(each, lengths) * times))
            size += len(held[-1][0])
            if size > PAIRS:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > PAIRS // 2:
                    yield flush(held[0])
                    held, size = [], 0
        if held:
            yield flush(summed(*map(np.concatenate, zip(*held, strict=True))))

    def flush(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        block, docs, worth = found
        edge = np.nonzero(np.concatenate(([True], block[1:] != block[:-1])))[0]
        ends = np.append(edge[1:], len(block))
        packed = [pa.array([x[a:z].astype("<i8" if k else "<u4").tobytes() for a, z in zip(edge, ends, strict=True)], pa.binary()) for k, x in enumerate((docs, worth))]
        none = [pa.nulls(len(edge), k) for k in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(block[edge]), *none, *packed], names)

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: each document with its sum."""
    block, total, rows = None, np.zeros(0, np.int64), []

    def out() -> pa.RecordBatch:
        n = np.array([r[0] for r in rows], np.int64)
        tokens = np.array([r[3] for r in rows], np.int64)
        inside = n < len(total)
        tokens[inside] += total[n[inside]]
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    for b in batches:
        for at, n, doc_id, n_bytes, tokens, docs, worth in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != block:
                if rows:
                    yield out()
                block, total, rows = at, np.zeros(0, np.int64), []
            if docs is None:
                rows.append((n, doc_id, n_bytes, tokens))
            else:
                places = np.frombuffer(docs, "<u4")
                if places[-1] >= len(total):
                    total = np.append(total, np.zeros(int(places[-1]) + 1 - len(total), np.int64))
                total[places] += np.frombuffer(worth, "<i8")
    if rows:
        yield out()


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, for the tokenizer file at ``path``."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    kind, over = "doc_id long, n_bytes long, n_tokens long", (F.col("n_tokens") > limit).alias("over_limit")
    if not has_borders(path):
        return slim.mapInArrow(whole_texts(path), kind).select("doc_id", "n_bytes", "n_tokens", over)
    parts = slim.mapInArrow(blocks(path, block_bytes, common), PARTS)
    dealt = parts.repartition(F.coalesce("term", F.concat("block", F.lit(" "), "n"))).sortWithinPartitions("term")
    found = dealt.mapInArrow(sums(path), SUMS)
    whole = found.repartition("block").sortWithinPartitions("block").mapInArrow(merged, kind)
    return whole.select("doc_id", "n_bytes", "n_tokens", over)
