"""Operator 3, language-model scoring by masked pseudo-likelihood.

The words of the whole corpus are counted in a table on Spark that grows with the corpus. The most
frequent words get a token class each, all others share ``RARE`` classes. A window network
(embeddings of the two words before and the two after, one tanh layer, softmax in two levels)
predicts the class of every word from both sides; the word table gives the probability of the word
within its class. A document's score is the sum over its words of log P(class | window)
+ log P(word | class), where log P(class | window) = log P(group | window) + log P(class | group, window).

The word table is joined to the words. The most frequent words, ``KNOWN`` at most, are broadcast, so
that no hot word is a hot key of the join; the others are joined on Spark, however many there are.

Training: the ``ROUNDS`` rounds part the positions by a hash, so that each word is predicted in
exactly one round. A task trains on its words in numpy from the shared weights, and the weights are
averaged over tasks by trained words, summed on Spark. The driver holds one set of weights and the
broadcast words, whose sizes do not depend on the input.

Defined edge cases: null, empty and blank texts have no words, log_prob 0 and a null mean; an
empty table has no scores; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import textkit as tk
from churnlens.llm.graph import stored

CLASSES, RARE = 256, 64
#: groups of the two-level softmax, and classes in each
GROUPS = 16
MEMBERS = CLASSES // GROUPS
#: most words that are looked up in a broadcast table instead of the join
KNOWN = 1 << 18
REACH, DIM, HIDDEN = 2, 12, 32
ROUNDS, BATCH, RATE = 2, 1024, 0.08
SCORE_BATCH = 4096
_RARE_SHIFT = 48
#: counts below this have a bin each in the histogram that sets the lexicon's least count
_EXACT_COUNTS = 1 << 15
#: embeddings, hidden layer and bias, group layer and bias, member layer and bias of each group
_SHAPES = ((CLASSES + 1, DIM), (2 * REACH * DIM, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,),
           (GROUPS, HIDDEN, MEMBERS), (GROUPS, MEMBERS))
Weights = list[np.ndarray]


def first_weights(classes: np.ndarray) -> Weights:
    """Small random weights; the output biases start at the class frequencies."""
    rng = np.random.default_rng(7)
    scales = (0.3, (2 * REACH * DIM) ** -0.5, 0, HIDDEN ** -0.5, 0, HIDDEN ** -0.5, 0)
    w = [(rng.standard_normal(shape) * scale).astype(np.float32) for shape, scale in zip(_SHAPES, scales, strict=True)]
    share = ((classes + 1) / (classes + 1).sum()).reshape(GROUPS, MEMBERS)
    w[4] = np.log(share.sum(axis=1)).astype(np.float32)
    w[6] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return w


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w])


def shaped(v: np.ndarray) -> Weights:
    cuts = np.cumsum([int(np.prod(s)) for s in _SHAPES])[:-1]
    return [x.reshape(s).astype(np.float32) for x, s in zip(np.split(v, cuts), _SHAPES, strict=True)]


class Lexicon:
    """The most frequent words: sorted hashes, their classes and log P(word | class)."""

    def __init__(self, words: np.ndarray, classes: np.ndarray, within: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.within = words[order], within[order]
        own = classes[order] < CLASSES - RARE
        self.own, self.own_class = self.words[own], classes[order][own]

    def classes(self, h: np.ndarray) -> np.ndarray:
        """The class of each word hash."""
        out = CLASSES - RARE + ((h >> tk.U64(_RARE_SHIFT)) % tk.U64(RARE)).astype(np.int64)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
            out = np.where(self.own[at] == h, self.own_class[at], out)
        return out

    def log_within(self, h: np.ndarray) -> np.ndarray:
        """log P(word | class), nan where the word isn't among the broadcast ones."""
        if not len(self.words):
            return np.full(len(h), np.nan)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.within[at], np.nan)


def windows(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The classes around each word, CLASSES where the text ends."""
    n = len(ids)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.full((n, 2 * REACH), CLASSES, dtype=np.int64)
    for k, d in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        a, b = max(0, -d), n - max(0, d)
        if a < b:
            inside = row[a:b] == row[a + d:b + d]
            out[a:b, k] = np.where(inside, ids[a + d:b + d], CLASSES)
    return out


def _hidden(w: Weights, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embedded windows, one a row, and the hidden layer, one word a column."""
    x = w[0][around].reshape(len(around), -1)
    return x, np.tanh(w[1].T @ x.T + w[2][:, None])


def _groups(ids: np.ndarray) -> list[tuple[int, slice]]:
    """The columns of each group that occurs; ``ids`` are in order."""
    cuts = np.searchsorted(ids, np.arange(GROUPS + 1) * MEMBERS)
    return [(g, slice(a, b)) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]


def _logits(w: Weights, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all groups, and of all members of each word's own group, a column for each word."""
    members = w[6].T[:, ids // MEMBERS]
    for g, at in _groups(ids):
        members[:, at] += w[5][g].T @ h[:, at]
    return w[3].T @ h + w[4][:, None], members


def _picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of each column's chosen row."""
    z -= z.max(axis=0)
    chosen = z[at, np.arange(len(at))]
    return chosen - np.log(np.exp(z, out=z).sum(axis=0))


def _slope(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gradient of the mean negative log-softmax of the chosen rows, in place."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0) * np.float32(len(at))
    z[at, np.arange(len(at))] -= np.float32(1 / len(at))
    return z


def log_probs(w: Weights, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of each word's class given the words around it."""
    out = np.empty(len(ids))
    for k in range(0, len(ids), SCORE_BATCH):
        order = np.argsort(ids[k:k + SCORE_BATCH], kind="stable")
        i = ids[k:k + SCORE_BATCH][order]
        groups, members = _logits(w, _hidden(w, around[k:k + SCORE_BATCH][order])[1], i)
        out[k + order] = _picked(groups, i // MEMBERS) + _picked(members, i % MEMBERS)
    return out


def train_step(w: Weights, seen: Weights, ids: np.ndarray, around: np.ndarray) -> None:
    """One Adagrad step on a batch, in place."""
    order = np.argsort(ids, kind="stable")
    ids, around = ids[order], around[order]
    x, h = _hidden(w, around)
    groups, members = _logits(w, h, ids)
    p, q = _slope(groups, ids // MEMBERS), _slope(members, ids % MEMBERS)
    dh = w[3] @ p
    dw, db = np.zeros_like(w[5]), np.zeros_like(w[6])
    for g, at in _groups(ids):
        dh[:, at] += w[5][g] @ q[:, at]
        dw[g], db[g] = h[:, at] @ q[:, at].T, q[:, at].sum(axis=1)
    dh *= 1 - h * h
    dx = dh.T @ w[1].T
    cell = around.ravel()[:, None] * DIM + np.arange(DIM)
    de = np.bincount(cell.ravel(), dx.ravel(), w[0].size).reshape(w[0].shape).astype(np.float32)
    for param, acc, g in zip(w, seen, (de, x.T @ dh.T, dh.sum(axis=1), h @ p.T, p.sum(axis=1), dw, db), strict=True):
        acc += g * g
        param -= RATE * g / np.sqrt(acc + 1e-8)


def masked(ids: np.ndarray, bounds: np.ndarray, turn: int) -> np.ndarray:
    """Positions that this round masks, by a hash of place and text length; the rounds part them."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(ids)) - bounds[row]
    with np.errstate(over="ignore"):
        h = tk.mix((place.astype(tk.U64) << tk.U64(24)) + np.diff(bounds)[row].astype(tk.U64) + tk._STEP)
    return np.flatnonzero(h % tk.U64(ROUNDS) == turn)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _count_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, buf, offs in tk.slices(batch, "text", 4 << 20):
            words, n = np.unique(tk.Words(buf, offs, tk.NON_SPACE, lower=True).hash, return_counts=True)
            yield tk.record_batch(word=_signed(words), n=n)


def _train_map(lexicon_ref, weights_ref, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = [x.copy() for x in weights_ref.value]
        seen = [np.full_like(x, 1e-4) for x in w]
        done = 0
        for batch in batches:
            for _, buf, offs in tk.slices(batch, "text"):
                words = tk.Words(buf, offs, tk.NON_SPACE, lower=True)
                ids = lexicon_ref.value.classes(words.hash)
                at = masked(ids, words.bounds, turn)
                around = windows(ids, words.bounds)[at]
                for k in range(0, len(at), BATCH):
                    train_step(w, seen, ids[at[k:k + BATCH]], around[k:k + BATCH])
                done += len(at)
        v = flat(w).astype(np.float64) * done
        yield tk.record_batch(k=np.arange(len(v) + 1), v=np.append(v, done))
    return run


def _score_map(lexicon_ref, weights_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, buf, offs in tk.slices(batch, "text", 1 << 19):
                words = tk.Words(buf, offs, tk.NON_SPACE, lower=True)
                bounds, ids = words.bounds, lexicon_ref.value.classes(words.hash)
                within = lexicon_ref.value.log_within(words.hash)
                left = np.isnan(within)
                each = log_probs(weights_ref.value, ids, windows(ids, bounds)) + np.where(left, 0, within)
                total, joined = (np.concatenate(([0], np.cumsum(x))) for x in (each, left))
                rest = pa.ListArray.from_arrays(pa.array(joined[bounds].astype(np.int32)), pa.array(_signed(words.hash[left])))
                yield tk.record_batch(row=rows + np.arange(part.num_rows), doc_id=part.column(0), n_tokens=np.diff(bounds).astype(np.int64),
                                      log_prob=total[bounds[1:]] - total[bounds[:-1]], rest=rest)
                rows += part.num_rows
    return run


def word_table(d: DataFrame) -> DataFrame:
    """(word, n) of all words of ``d`` (doc_id, text); word is the hash of the lower-cased word."""
    return stored(tk.map_batches(d, _count_map, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def _least_count(words: DataFrame) -> int:
    """The least count that is reached by at most KNOWN words.

    Counts are binned, each on its own below ``_EXACT_COUNTS`` and in steps of a sixteenth of a doubling
    above, so the driver gets a bounded histogram whatever the number of words.
    """
    step = F.floor(F.log2("n") * 16)
    bins = words.groupBy(F.when(F.col("n") < _EXACT_COUNTS, F.col("n")).otherwise(_EXACT_COUNTS + step).alias("bin")).agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("words")).orderBy(F.desc("least")).collect()
    least, held = np.iinfo(np.int64).max, 0
    for r in bins:
        held += r.words
        if held > KNOWN:
            break
        least = r.least
    return int(least)


def lexicon(words: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """(the most frequent words, count of each class); at most KNOWN words reach the driver, all of them above one count."""
    top = words.where(F.col("n") >= _least_count(words)).toPandas().sort_values(["n", "word"], ascending=[False, True])
    h, n = top["word"].to_numpy(np.int64).view(tk.U64), top["n"].to_numpy(np.int64)
    classes = np.concatenate((np.arange(CLASSES - RARE), np.zeros(len(h), dtype=np.int64)))[:len(h)]
    rare = (h >> tk.U64(_RARE_SHIFT)) % tk.U64(RARE)
    classes[CLASSES - RARE:] = CLASSES - RARE + rare[CLASSES - RARE:].astype(np.int64)
    counts = np.zeros(CLASSES, dtype=np.int64)
    for r in words.groupBy(_rare_class().alias("c")).agg(F.sum("n").alias("n")).collect():  # RARE rows at most
        counts[r.c] = r.n
    own = min(CLASSES - RARE, len(h))
    counts[:own] = n[:own]
    np.subtract.at(counts, CLASSES - RARE + rare[:own].astype(np.int64), n[:own])
    return Lexicon(h, classes, np.log(n / counts[classes])), counts


def _rare_class() -> Column:
    """The class of a word that has none of its own."""
    return (F.lit(CLASSES - RARE) + F.shiftrightunsigned("word", _RARE_SHIFT) % RARE).cast("int")


def train(d: DataFrame, lexicon_ref, counts: np.ndarray) -> Weights:
    """Weights fitted on all words of ``d`` (doc_id, text)."""
    sc = d.sparkSession.sparkContext
    w = first_weights(counts)
    for turn in range(ROUNDS):
        sums = tk.map_batches(d, _train_map(lexicon_ref, sc.broadcast(w), turn), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        v = sums.sort_values("k")["v"].to_numpy()  # one number for each weight
        if len(v) and v[-1] > 0:
            w = shaped(v[:-1] / v[-1])
    return w


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of each document under a model of all of them."""
    d = tk.texts(docs, id_col, text_col)
    sc = d.sparkSession.sparkContext
    words = word_table(d)
    known, counts = lexicon(words)
    lexicon_ref = sc.broadcast(known)
    w = train(d, lexicon_ref, counts)
    schema = "row long, doc_id long, n_tokens long, log_prob double, rest array<long>"
    scored = stored(tk.map_batches(d, _score_map(lexicon_ref, sc.broadcast(w)), schema), "scored")
    # the words beyond the broadcast ones all share the rare classes
    sizes = F.array(*[F.lit(float(max(n, 1))) for n in counts[CLASSES - RARE:]])
    within = words.select("word", F.log(F.col("n") / F.element_at(sizes, _rare_class() - (CLASSES - RARE) + 1)).alias("within"))
    rest = scored.select("row", F.explode("rest").alias("word")).join(within, "word").groupBy("row").agg(F.sum("within").alias("within"))
    log_prob = F.col("log_prob") + F.coalesce("within", F.lit(0.0))
    out = scored.drop("rest").join(rest, "row", "left").select("doc_id", "n_tokens", log_prob.alias("log_prob"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
