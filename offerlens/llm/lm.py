"""LM scoring by a gated recurrent language model with class-factored output, in numpy within Spark tasks.

1. Counts: every training token is counted, in tasks by blocks of texts, then by a grouped sum (a table of words and counts).
2. Entries: the model predicts one of ``CLASSES * IN_CLASS`` entries, ordered by training frequency and put in classes in that order:
   P(entry) = P(class | state) * P(entry | class, state). The ``OWN`` most frequent words and the end have an entry each; all
   other words share ``SHAPES`` entries by their last three bytes. So the state predicts every
   token; a word has its entry's probability times its share (count + 1) / (tokens + words + 1 of the entry), which leaves a share for
   words never seen: a distribution over all words.
3. Each text is encoded once: its entries are written as a table of 16-bit numbers, from which training and scoring read.
4. Training: a gated recurrent unit whose gate sees the word and, by a diagonal, its own state: z = sigmoid(gate[x] + peep * h),
   h = (1 - z) * h + z * value[x]. Truncated backpropagation over windows of ``STEPS`` tokens, states carried on. Every training text is
   read once, in rounds whose number grows with the logarithm of the corpus (``rounds_of``). In a round each task trains over its texts
   from the same weights; the results are averaged by tokens, chunk of weights by chunk, in tasks that hold one running sum a chunk;
   only the averaged weights (a fixed number) go to the driver.
5. Scoring: texts lie in lanes, cut into windows; the state is carried across windows to the end of each text, so a text's
   score is its whole log-likelihood. Counts of words beyond the ``KNOWN`` most frequent are joined: a block of texts gives one
   row for each such word with the texts that have it, and sums come back by block.

Defined results: a null or wordless text is its end alone; rows that repeat are scored each; a null ``doc_id`` is in training
(the checksum of no text is 0); an empty table gives an empty result; with no training text all counts are 0 and the weights
stay as they begin. A very long text is scored as one sequence; in training its segments of ``SEGMENT`` tokens begin anew. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_freed_memory, staged

CLASSES, IN_CLASS, WIDTH = 80, 80, 15
SHAPES = 1600
OWN = CLASSES * IN_CLASS - SHAPES - 1
#: The counts of so many words at most are given to all tasks.
KNOWN = 1 << 16
LANES, STEPS, SEGMENT, RATE, CLIP = 512, 32, 1024, 0.4, 5.0
#: Tokens to the first round; each doubling beyond adds a round.
ROUND_TOKENS = 4 << 20
BLOCK_BYTES, BLOCK_TOKENS = 12 << 20, 2 << 20

Weights = dict[str, np.ndarray]


def listed_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (lower-cased A-Z) in order, and how many each text has.

    The white space that Arrow splits ASCII text at is just the six characters that part words.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, owner = split.flatten(), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(words), 0)  # leading and trailing white space gives empty strings
    return words.filter(real), np.bincount(owner.filter(real).to_numpy(), minlength=len(texts))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def shapes_of(words: pa.Array) -> np.ndarray:
    """The number of each word's shape: a hash of its last three bytes, with all digits taken as one."""
    _, offsets, data = words.cast(pa.large_binary()).buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    same = np.arange(256, dtype=np.uint64)
    same[ord("0") : ord("9") + 1] = ord("0")
    text, key = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), np.zeros(len(words), np.uint64)
    for back in (1, 2, 3):
        at = ends[1:] - back
        key = key << np.uint64(8) | np.where(at >= ends[:-1], same[text[np.maximum(at, 0)]], np.uint64(0))
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SHAPES


def sizes() -> dict[str, tuple[int, ...]]:
    v, h = CLASSES * IN_CLASS, WIDTH
    return {"gate": (v, h), "value": (v, h), "peep": (h,), "wc": (h + 1, CLASSES), "ww": (CLASSES, h + 1, IN_CLASS)}


def start(counts: np.ndarray, seed: int = 1) -> Weights:
    """Small random weights; the output's biases (its last rows) give the training frequencies."""
    draw = np.random.default_rng(seed)
    out = {k: (draw.standard_normal(s) * 0.3).astype(np.float32) for k, s in sizes().items()}
    by_class = (counts.astype(np.float64) + 0.5).reshape(CLASSES, IN_CLASS)
    out["gate"] += np.linspace(-3, 2, WIDTH, dtype=np.float32)  # from slow memory to the last word alone
    out["peep"] *= 0
    out["wc"] *= 0.1
    out["ww"] *= 0.1
    out["ww"][:, -1] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    out["wc"][-1] = np.log(by_class.sum(axis=1) / by_class.sum())
    return out


#: Scale and shift at which a float's bits, read as a number, are its exponent's logarithm.
BITS_PER_E, BITS_OF_ONE = float(np.float32(2**23 / np.log(2))), float(127 << 23)


def scaled(w: np.ndarray) -> np.ndarray:
    """Output weights as ``exponents`` takes them: with these the logits are the bits of the result."""
    if w.dtype == np.float64:  # as tests have it
        return w
    w = w * np.float32(BITS_PER_E)
    w[..., -1, :] += np.float32(BITS_OF_ONE)
    return w


def surely_within(x: np.ndarray, w: np.ndarray) -> bool:
    """Whether no logit of ``x @ w`` can come near the cuts, by the product of the longest row and column and the largest bias."""
    row = (np.square(x) @ np.ones(x.shape[1], x.dtype)).max(initial=0)
    column = np.square(w[..., :-1, :]).sum(axis=-2).max()
    return bool(np.sqrt(float(row) * float(column)) + float(np.abs(w[..., -1, :]).max()) < 59)


def exponents(x: np.ndarray, w: np.ndarray, within: bool) -> np.ndarray:
    """exp(x @ w), taken linear between powers of two in single precision: the logits, scaled and shifted, are the bits of the result.

    Any positive function gives a distribution once it is divided by its sum, and this one saves most of the time. ``x`` has a last
    column of ones, for the bias in the last row of ``w``, which is ``scaled``; logits are cut at -80 and 60, unless they are known to lie ``within``.
    """
    if x.dtype == np.float64:
        return np.exp(np.clip(x @ w, -80, 60))
    bits = x @ w
    low, high = BITS_OF_ONE - 80 * BITS_PER_E, BITS_OF_ONE + 60 * BITS_PER_E
    if not within and (bits.min(initial=high) < low or bits.max(initial=low) > high):
        np.clip(bits, np.float32(low), np.float32(high), out=bits)
    return bits.astype(np.int32).view(np.float32)


def forward(p: Weights, inputs: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
    """States (steps, lanes, width) over a window, and what backpropagation needs; ``keep`` is 0 where a text begins."""
    gates, values, peep, trail = np.negative(p["gate"]).take(inputs, axis=0), p["value"].take(inputs, axis=0), -p["peep"], []
    states = np.empty_like(values)
    begins = (keep == 0).any(axis=1)
    for t in range(len(inputs)):
        if begins[t]:
            h = h * keep[t][:, None]
        z, d = gates[t], values[t]
        z += h * peep
        np.exp(z, out=z)
        z += 1
        np.reciprocal(z, out=z)
        d -= h
        trail.append((h, z, d))
        h = np.multiply(z, d, out=states[t])
        h += trail[-1][0]
    return states, trail


def backward(p: Weights, inputs: np.ndarray, keep: np.ndarray, trail: list, gs: np.ndarray) -> Weights:
    """Gradients of the recurrent part over one window; ``gs`` are the states' own gradients."""
    peep, gh = p["peep"], np.zeros_like(gs[0])
    both, gp = np.empty((*inputs.shape, 2, WIDTH), gs.dtype), np.zeros_like(p["peep"])
    begins = (keep == 0).any(axis=1)
    for t in range(len(inputs) - 1, -1, -1):
        h, z, d = trail[t]
        gh += gs[t]
        gv = gh * z
        ga = gv * d
        gh -= gv
        ga -= z * ga
        gp += np.einsum("ij,ij->j", ga, h)
        both[t, :, 0], both[t, :, 1] = ga, gv
        ga *= peep
        gh += ga
        if begins[t]:
            gh *= keep[t][:, None]
    ids = inputs.ravel()
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    first = np.nonzero(np.concatenate(([True], np.diff(ids[order]) != 0)))[0]
    pairs = both.reshape(len(ids), -1).take(order, axis=0).view(np.result_type(gs.dtype, np.complex64))  # half as many columns to sum
    sums = np.add.reduceat(pairs, first).view(gs.dtype)
    out = {"gate": np.zeros_like(p["gate"]), "value": np.zeros_like(p["value"]), "peep": gp}
    out["gate"][ids[order][first]], out["value"][ids[order][first]] = sums[:, :WIDTH], sums[:, WIDTH:]
    return out


def log_probabilities(p: Weights, states: np.ndarray, targets: np.ndarray, back: bool = False):
    """log P of targets (n) after states (n, width); with ``back`` also the gradients of their negative sum."""
    order = np.argsort((targets // IN_CLASS).astype(np.uint8), kind="stable")
    target = targets.take(order)
    x = np.ones((len(order), WIDTH + 1), states.dtype)
    x[:, :-1] = states.take(order, axis=0)
    of_class, place = target // IN_CLASS, target % IN_CLASS
    part = 4096  # so many rows of logits stay in the cache
    starts = [np.arange(part) * n for n in (CLASSES, IN_CLASS)]  # of rows in flat logits
    ones = [np.ones(n, x.dtype) for n in (CLASSES, IN_CLASS)]
    chosen, total = np.empty((2, len(x)), x.dtype), np.empty((2, len(x)), x.dtype)
    if back:
        grads = {k: np.zeros_like(p[k]) for k in ("wc", "ww")}
        gx = np.zeros_like(x)

    def softmax(level: int, a: int, z: int, w: np.ndarray, ready: np.ndarray, within: bool, at: np.ndarray, gw: np.ndarray | None) -> None:
        e = exponents(x[a:z], ready, within)
        e.dot(ones[level], out=total[level, a:z])
        flat, cell = e.reshape(-1), starts[level][: z - a] + at
        picked = flat.take(cell, out=chosen[level, a:z])
        if back:  # (e - total at the place) / total is the gradient of the logits; the division comes last, where rows are short
            flat[cell] = picked - total[level, a:z]
            over = (1 / total[level, a:z])[:, None]
            gw += (e.T @ (x[a:z] * over)).T
            to_x = e @ w.T
            to_x *= over
            gx[a:z] += to_x

    of_classes, ready, within = scaled(p["wc"]), scaled(p["ww"]), [surely_within(x, p[k]) for k in ("wc", "ww")]
    for a in range(0, len(x), part):
        z = min(a + part, len(x))
        softmax(0, a, z, p["wc"], of_classes, within[0], of_class[a:z], grads["wc"] if back else None)
    edges = np.searchsorted(of_class, np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        for a in range(edges[c], edges[c + 1], part):
            z = min(a + part, edges[c + 1])
            softmax(1, a, z, p["ww"][c], ready[c], within[1], place[a:z], grads["ww"][c] if back else None)
    out = np.empty(len(x), np.float32)
    out[order] = np.log(chosen / total).sum(axis=0)
    if not back:
        return out
    given = np.empty_like(order)
    given[order] = np.arange(len(order))
    return out, gx.take(given, axis=0)[:, :-1], grads


def windows(texts: list[np.ndarray], lanes: int = LANES, steps: int = STEPS, cells: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts (entries that close with the end's) in lanes, as windows of (step, lane): inputs, targets, keep, text or -1.

    Longest first, each text goes to the lane that is shortest by then. Lanes lie in one array, the longest first, so those
    in use are always the first ones. A window has at least ``steps`` steps and, if that is more, ``cells`` of a step and a lane.
    """
    size = np.array([len(t) for t in texts], np.int64)
    load, lane_of = [(0, lane) for lane in range(min(lanes, len(texts)))], np.empty(len(texts), np.int64)
    for i in np.argsort(-size, kind="stable").tolist():
        n, lane = load[0]
        lane_of[i] = lane
        heapq.heapreplace(load, (n + len(texts[i]), lane))
    length = np.bincount(lane_of, size, len(load)).astype(np.int64)
    rank = np.empty(len(load), np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(len(load))
    order = np.lexsort((-size, rank[lane_of]))
    length = -np.sort(-length)
    end = np.cumsum(length)
    begin = end - length
    first = np.cumsum(size[order]) - size[order]
    last = texts[0][-1:]  # the end, which pads and stands before each text
    flat = np.concatenate([*(texts[i] for i in order), last]).astype(np.int32)
    before = np.concatenate((flat[:1], flat[:-1]))
    before[first] = before[-1] = last[0]
    keep = np.ones(len(flat), np.float32)
    keep[first] = 0
    text = np.append(np.repeat(order, size[order]), -1)
    at = 0
    while at < length[0]:
        used = int(np.searchsorted(-length, -at))
        upto = min(at + max(steps, cells // used), int(length[0]))
        place = begin[:used] + np.arange(at, upto)[:, None]
        place[place >= end[:used]] = len(flat) - 1
        yield before[place], flat[place], keep[place], text[place]
        at = upto


def score_block(p: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """The natural log-likelihood of each whole text's entries."""
    scores, state = np.zeros(len(texts)), np.zeros((LANES, WIDTH), np.float32)
    for inputs, targets, keep, text in windows(texts, cells=4 * LANES * STEPS):  # long ones, so that each class has many rows
        states, _ = forward(p, inputs, keep, state[: inputs.shape[1]])
        state = states[-1]
        inside = np.flatnonzero(text >= 0)
        logp = log_probabilities(p, states.reshape(-1, WIDTH).take(inside, axis=0), targets.take(inside))
        scores += np.bincount(text.take(inside), logp, len(texts))
    return scores


def train_block(p: Weights, seen: Weights, texts: list[np.ndarray]) -> int:
    """Truncated backpropagation over a block of texts, in place (Adagrad); the number of tokens."""
    state, tokens = np.zeros((LANES, WIDTH), np.float32), 0
    texts = [t[a : a + SEGMENT] for t in texts for a in range(0, len(t), SEGMENT)]
    for inputs, targets, keep, text in windows(texts):
        states, trail = forward(p, inputs, keep, state[: inputs.shape[1]])
        state = states[-1]
        inside = np.flatnonzero(text >= 0)
        n, flat = len(inside), states.reshape(-1, WIDTH)
        if n == text.size:
            _, gs, grads = log_probabilities(p, flat, targets.ravel(), back=True)
        else:
            _, some, grads = log_probabilities(p, flat.take(inside, axis=0), targets.take(inside), back=True)
            gs = np.zeros_like(flat)
            gs[inside] = some
        grads |= backward(p, inputs, keep, trail, gs.reshape(states.shape))
        norm = float(np.sqrt(sum(float(g.ravel() @ g.ravel()) for g in grads.values()))) / n
        scale = np.float32(min(1.0, CLIP / (norm + 1e-9)) / n)
        for name, g in grads.items():
            g *= scale
            step = g * g
            seen[name] += step
            np.sqrt(seen[name], out=step)
            step += np.float32(1e-6)
            np.divide(g, step, out=step)
            step *= np.float32(RATE)
            p[name] -= step
        tokens += n
    return tokens


@dataclass
class Entries:
    """What tasks need to encode texts."""

    known: pa.Array  # the most frequent words
    log_counts: np.ndarray  # log10(count + 1) by that place
    entry: np.ndarray  # entry by that place, -1: by shape
    of_shape: np.ndarray  # entry by shape
    share: np.ndarray  # log10(tokens + words + 1) by entry, 0 for words of their own
    counts: np.ndarray  # training tokens by entry
    end: int
    train_tokens: int
    distinct: int


def blocked(batches: Iterator[pa.RecordBatch], column: int, block: int) -> Iterator[list[pa.Array]]:
    """Columns of the batches in blocks of so many bytes in ``column``."""
    held, size = [], 0
    for b in batches:
        for a in range(0, len(b), 256):
            part = b.slice(a, 256)
            held.append(part)
            size += part.column(column).nbytes
            if size >= block:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns
                held, size = [], 0
    if size or held:
        yield from (t.columns for t in pa.Table.from_batches(held).combine_chunks().to_batches())


def numbers_of(packed: pa.Array) -> np.ndarray:
    """The 32-bit numbers that all of the packed binaries hold, in order, read in place."""
    packed = packed.cast(pa.large_binary())
    _, offsets, data = packed.buffers()
    if not len(packed) or data is None:
        return np.empty(0, "<u4")
    ends = np.frombuffer(offsets, np.int64)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<u4")


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all of ``docs``; the end has the null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in blocked(batches, 0, BLOCK_BYTES):
            found = listed_words(texts)[0].value_counts()
            words, n = found.field("values").cast(pa.large_binary()), found.field("counts")
            for a in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([words.slice(a, 50_000).cast(pa.binary()), n.slice(a, 50_000)], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([len(texts)], pa.int64())], ["word", "n"])

    partial = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return staged(partial.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def entries(counts: DataFrame) -> Entries:
    """The entries by the training counts."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.filter("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = counts.filter("word IS NOT NULL")
    top = words.orderBy(F.desc("n"), "word").limit(KNOWN).collect()  # a fixed number of words
    top_words = pa.array([bytes(r["word"]) for r in top], pa.large_binary())
    own = top_words.slice(0, OWN)

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for b in batches:
            listed = b.column(0).cast(pa.large_binary())
            other = pc.index_in(listed, own).is_null().to_numpy(zero_copy_only=False)
            of, c = shapes_of(listed)[other], b.column(1).to_numpy()[other]
            n += np.bincount(of, c, SHAPES).astype(np.int64)
            v += np.bincount(of, minlength=SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES, dtype=np.int32)), pa.array(n), pa.array(v)], ["shape", "n", "v"])

    by_shape = words.mapInArrow(shaped, "shape int, n long, v long").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    tokens, distinct = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in by_shape:
        tokens[r["shape"]], distinct[r["shape"]] = r["n"], r["v"]
    n = np.zeros(CLASSES * IN_CLASS, np.int64)  # words of their own, shapes, the end
    n[: len(own)] = [r["n"] for r in top[: len(own)]]
    n[OWN : OWN + SHAPES], n[-1] = tokens, ends
    at = np.empty(len(n), np.int64)
    at[np.argsort(-n, kind="stable")] = np.arange(len(n))
    by_rank, share = np.empty_like(n), np.zeros(len(n))
    by_rank[at], share[at[OWN : OWN + SHAPES]] = n, np.log10(tokens + distinct + 1)
    entry = np.full(len(top), -1, np.int64)
    entry[: len(own)] = at[: len(own)]
    return Entries(top_words, np.log10(np.array([r["n"] for r in top], np.float64) + 1), entry, at[OWN : OWN + SHAPES], share, by_rank, int(at[-1]), int(total[0]), int(total[1]))


#: ``docs`` holds a text's number in the block and the word's occurrences there, text by text.
PARTS = "word binary, block long, docs binary, n int, doc_id long, ids binary, n_tokens long, n_known long, logs double, inner double"


def encoded(docs: DataFrame, of: Entries) -> DataFrame:
    """Each text as entries, and a row for each block's word that isn't among the known ones; written once."""
    given = docs.sparkSession.sparkContext.broadcast(of)
    names = [c.split()[0] for c in PARTS.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(rows, k) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], k) for c, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, number = given.value, TaskContext.get().partitionId() << 32
        end_log = np.log10(e.counts[e.end] + 1)
        for doc_ids, texts in blocked(batches, 1, BLOCK_BYTES):
            listed, size = listed_words(texts)
            coded = listed.dictionary_encode()
            distinct, codes = coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy()
            place = pc.fill_null(pc.index_in(distinct, e.known), -1).to_numpy().astype(np.int64)
            entry = np.append(e.entry, -1)[place]
            entry = np.where(entry < 0, e.of_shape[shapes_of(distinct)], entry)
            log = np.where(place >= 0, np.append(e.log_counts, 0)[place], 0)
            inner = np.where(e.share[entry] > 0, log - e.share[entry], 0)
            doc, docs_ = np.repeat(np.arange(len(texts)), size), len(texts)
            ends = np.cumsum(size + 1)
            ids, inside = np.full(len(codes) + docs_, e.end, "<u2"), np.ones(len(codes) + docs_, bool)
            inside[ends - 1] = False
            ids[inside] = entry[codes] if len(codes) else 0
            cut = pa.array(np.append(0, ends * 2).astype(np.int32))
            yield batch(
                docs_, block=np.full(docs_, number), n=np.arange(docs_, dtype=np.int32), doc_id=doc_ids, ids=pa.Array.from_buffers(pa.binary(), docs_, [None, cut.buffers()[1], pa.py_buffer(ids.tobytes())]), n_tokens=size + 1,
                n_known=(np.bincount(doc, (place >= 0)[codes], docs_) + (e.counts[e.end] > 0)).astype(np.int64), logs=np.bincount(doc, log[codes], docs_) + end_log, inner=np.bincount(doc, inner[codes], docs_),
            )
            rare = (place < 0)[codes]
            pair, times = np.unique(codes[rare].astype(np.int64) * docs_ + doc[rare], return_counts=True)
            word, doc = np.divmod(pair, docs_)
            found = np.nonzero(np.concatenate(([True], word[1:] != word[:-1])))[0] if len(word) else np.empty(0, np.int64)
            distinct, edge = distinct.take(pa.array(word[found])), np.append(found, len(word))
            for a in range(0, len(distinct), 50_000):
                z = min(a + 50_000, len(distinct))
                lo, hi = edge[a], edge[z]
                cut = pa.array(((edge[a : z + 1] - lo) * 8).astype(np.int32))
                packed = np.stack((doc[lo:hi], times[lo:hi]), axis=1).astype("<u4").tobytes()
                yield batch(z - a, word=distinct.slice(a, z - a).cast(pa.binary()), block=np.full(z - a, number), docs=pa.Array.from_buffers(pa.binary(), z - a, [None, cut.buffers()[1], pa.py_buffer(packed)]))
            number += 1

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return staged(slim.mapInArrow(run, PARTS), "lm-parts")


def rounds_of(tokens: int) -> int:
    """2 rounds at least, and one more for each doubling of the training tokens beyond ``ROUND_TOKENS``."""
    return 2 + max(0, ceil(log2(max(tokens, 1) / ROUND_TOKENS)))


CHUNK = 1 << 13


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, tokens, v: tokens * weights): one sum a chunk, of those that are dealt to this task."""
    sums: dict[int, list] = {}
    for b in batches:
        for chunk, tokens, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at = sums.setdefault(chunk, [0, 0.0])
            at[0] += tokens
            at[1] = at[1] + np.frombuffer(v, np.float32).astype(np.float64) * tokens
    rows = [(k, n, (v / n).astype(np.float32).tobytes()) for k, (n, v) in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, [pa.int32(), pa.int64(), pa.binary()], strict=True)], ["chunk", "tokens", "v"])


def train(parts: DataFrame, of: Entries, rounds: int | None = None) -> Weights:
    """Learns from all texts of ``parts`` that aren't held out, each in one of the rounds."""
    weights, names = start(of.counts), list(sizes())
    seen = {k: np.full_like(v, 1e-4) for k, v in weights.items()}
    flat_of = lambda *ws: np.concatenate([w[k].ravel() for w in ws for k in names])
    rounds, kind = rounds or rounds_of(of.train_tokens), "chunk int, tokens long, v binary"
    texts = parts.filter(F.col("word").isNull() & ~is_held_out(F.col("doc_id")))
    for r in range(rounds):
        given = parts.sparkSession.sparkContext.broadcast((weights, seen))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            keep_freed_memory()
            p, s = ({k: v.copy() for k, v in w.items()} for w in given.value)
            tokens = sum(train_block(p, s, [np.frombuffer(x, "<u2") for x in ids.to_pylist()]) for (ids,) in blocked(batches, 0, 2 * BLOCK_TOKENS))
            if tokens:
                flat = flat_of(p, s)
                chunks = range(0, len(flat), CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([tokens] * len(chunks), pa.int64()), pa.array([flat[a : a + CHUNK].tobytes() for a in chunks], pa.binary())], ["chunk", "tokens", "v"])

        own = texts.filter(F.pmod(F.xxhash64("block", "n"), F.lit(rounds)) == r).select("ids")
        mean = own.mapInArrow(run, kind).repartition("chunk").mapInArrow(averaged, kind).collect()  # as many numbers as the model has
        if mean:
            flat = np.concatenate([np.frombuffer(x["v"], np.float32) for x in sorted(mean, key=lambda x: x["chunk"])])
            parts_of, at = [], 0
            for k in names * 2:
                shape_ = sizes()[k]
                parts_of.append(flat[at : at + int(np.prod(shape_))].reshape(shape_))
                at += int(np.prod(shape_))
            weights, seen = dict(zip(names, parts_of, strict=False)), dict(zip(names, parts_of[len(names) :], strict=True))
        given.unpersist()
    return weights


def score(parts: DataFrame, of: Entries, weights: Weights, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every encoded document."""
    given = parts.sparkSession.sparkContext.broadcast(weights)
    plain_kind = "block long, n int, doc_id long, n_tokens long, n_known long, logs double, inner double, ln double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *columns, ids in blocked(batches, 7, 2 * BLOCK_TOKENS):
            keep_freed_memory()
            ln = score_block(given.value, [np.frombuffer(x, "<u2") for x in ids.to_pylist()])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ln)], [c.split()[0] for c in plain_kind.split(", ")])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            block, docs_, logs, known = map(np.concatenate, zip(*held, strict=True))
            order = np.lexsort((docs_, block))
            block, docs_ = block[order], docs_[order]
            edge = np.nonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (docs_[1:] != docs_[:-1]))))[0]
            block, docs_, logs, known = block[edge], docs_[edge], np.add.reduceat(logs[order], edge), np.add.reduceat(known[order], edge)
            cut = np.nonzero(np.concatenate(([True], block[1:] != block[:-1])))[0]
            packed = [[x[a:z].astype(k).tobytes() for a, z in zip(cut, np.append(cut[1:], len(block)), strict=True)] for x, k in ((docs_, "<u4"), (logs, "<f8"), (known, "<i8"))]
            return pa.RecordBatch.from_arrays([pa.array(block[cut]), *(pa.array(x, pa.binary()) for x in packed)], ["block", "docs", "rare_logs", "rare_known"])

        for b in batches:
            count = b.column(2).to_numpy().astype(np.float64)
            docs_, times = numbers_of(b.column(1)).astype(np.int64).reshape(-1, 2).T
            length = pc.binary_length(b.column(1)).to_numpy() // 8
            held.append((np.repeat(b.column(0).to_numpy(), length), docs_, np.repeat(np.log10(count + 1), length) * times, np.repeat(count > 0, length) * times))
            size += len(docs_)
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, logs, known = None, [], np.zeros(0), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            n = np.array([r[0] for r in rows])
            width = max(int(n.max()) + 1, len(logs))
            more, seen = np.append(logs, np.zeros(width - len(logs)))[n], np.append(known, np.zeros(width - len(known), np.int64))[n]
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[1:3]] + [pa.array(np.array(cols[3]) + seen), pa.array(np.array(cols[4]) + more), pa.array(np.array(cols[5]) + more), pa.array(cols[6], pa.float64())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "n_known", "logs", "inner", "ln"])

        for b in batches:
            for block, docs_, rare_logs, rare_known, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != at:
                    if rows:
                        yield out()
                    at, rows, logs, known = block, [], np.zeros(0), np.zeros(0, np.int64)
                if docs_ is None:
                    rows.append(row)
                else:
                    places = np.frombuffer(docs_, "<u4")
                    if places[-1] >= len(logs):
                        logs, known = (np.append(x, np.zeros(int(places[-1]) + 1 - len(x), x.dtype)) for x in (logs, known))
                    logs[places] += np.frombuffer(rare_logs, "<f8")
                    known[places] += np.frombuffer(rare_known, "<i8")
        if rows:
            yield out()

    rare = parts.filter("word IS NOT NULL").join(counts.filter("word IS NOT NULL").withColumnRenamed("n", "c"), "word", "left")
    rare = rare.select("block", "docs", F.coalesce("c", F.lit(0)).alias("c")).mapInArrow(sums, "block long, docs binary, rare_logs binary, rare_known binary")
    plain = parts.filter("word IS NULL").select(*(c.split()[0] for c in plain_kind.split(", ")[:-1]), "ids").mapInArrow(run, plain_kind)
    own = plain_kind.split(", ")[1:]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    scored = plain.select("block", *(none("binary", c) for c in ("docs", "rare_logs", "rare_known")), *(c.split()[0] for c in own))
    summed = rare.select("block", "docs", "rare_logs", "rare_known", *(none(c.split()[1], c.split()[0]) for c in own))
    together = scored.unionByName(summed).repartition("block").sortWithinPartitions("block")
    whole = together.mapInArrow(merged, "doc_id long, n_tokens long, n_known long, logs double, inner double, ln double")
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(of.train_tokens + of.distinct + 1)))
    full = F.col("ln") / F.lit(float(np.log(10))) + F.col("inner")
    return whole.select("doc_id", "n_tokens", "n_known", F.lit(of.train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))


def learn_and_score(docs: DataFrame) -> DataFrame:
    """Trains on all but the held-out documents and scores all; adds held_out."""
    counts = count_words(docs.filter(~is_held_out(docs["doc_id"])))
    of = entries(counts)
    parts = encoded(docs, of)
    return score(parts, of, train(parts, of), counts).withColumn("held_out", is_held_out(F.col("doc_id")))
