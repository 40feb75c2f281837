"""Operator 13, phrase collocation mining on a weighted de Bruijn graph.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``; everything is counted per language. Nodes are 3-grams and edges are 4-grams, so
only the longest grams are counted in the texts. Every shorter count follows from node flow: a
k-gram occurs once for each (k+1)-gram that begins with it, and once more for each piece that ends
with it. Those piece ends are the only shorter grams that the texts send.

1. A sketch of the counts of words, pairs and triples (its size does not depend on the input) tells
   which can reach the least count. A gram below it is in no candidate and in no part of one, so a
   piece ends before its last word as it does at punctuation. The sketch never counts too low, so no
   phrase is lost; when it fills up, only fewer are cut away.
2. Each word sends the longest gram from it on, up to an edge. These are counted with map-side sums,
   then flow goes from 4-grams down to words in three sums by key.
3. Unary paths of the frequent graph (nodes with one edge in and one out) are compacted by pointer
   doubling: each round doubles the reach of every pointer, so a path of n edges takes log n rounds.
   3-grams inside a path whose weight holds 80% of theirs lie in a longer candidate.
4. The other candidates are held against the grams one word longer. That is enough: between a phrase
   and any longer one that holds it lies one of each length, at least as frequent as the longest.
5. What is left is scored by its cuts, looked up in the table of frequent grams.

Defined edge cases: null texts are empty; a null language is ``und``; rows that repeat count as often
as they stand there; an empty table gives no rows; other columns are never read. A word is identified
by its text; only the sketch and path ids use 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import textkit as tk
from churnlens.llm.graph import stored

LEAST = 30
LONGEST = 4
FIRST = 2000
#: counters of words, pairs and triples in the sketch; powers of two. A task holds a byte for each,
#: the broadcast a bit; more of them cut more away where a corpus fills these
WORD_SLOTS = 1 << 24
PAIR_SLOTS = 1 << 25
TRIPLE_SLOTS = 1 << 26
SLOTS = WORD_SLOTS + PAIR_SLOTS + TRIPLE_SLOTS
BLOCK = 1 << 16
#: bytes of text that are cut at a time
SLICE = 2 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

_STOPS = np.zeros(256, dtype=bool)
_STOPS[[10, 11, 12, 13, *b".,;:!?"]] = True
_WORD = ~_STOPS
_WORD[[9, 32]] = False


class _Pieces:
    """The words of a slice of rows: text hash, sketch slot, row and piece of each."""

    def __init__(self, rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> None:
        buf = tk.LOWER[buf]
        inside = _WORD[buf]
        starts, ends = tk.runs(inside, offs)
        self.row = np.searchsorted(offs, starts, "right") - 1
        # both terms never fall, so the sum is the same only within one piece of one row
        self.piece = np.cumsum(_STOPS[buf])[starts] + self.row if len(starts) else starts
        self.langs = pc.fill_null(rows.column(0), "und").dictionary_encode()
        codes = self.langs.indices.to_numpy()
        # scrambled once more, or word `es` of language `en` would be word `en` of language `es`
        names = tk.mix(tk.hash_words(self.langs.dictionary.to_pylist()))
        with np.errstate(over="ignore"):
            self.hash = tk.mix(tk.hash_spans(buf, starts, ends) + names[codes[self.row]])
        self.slot = (self.hash & tk.U64(WORD_SLOTS - 1)).astype(np.int64)
        bounds = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=bounds[1:])
        self.words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(buf[inside].tobytes()))


def _counters(p: _Pieces) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For words, pairs and triples: whether the gram from word i on stands in one piece, and its counter."""
    key, whole, slots, base = p.hash, [np.ones(len(p.hash), bool)], [p.slot], WORD_SLOTS
    for k, size in ((1, PAIR_SLOTS), (2, TRIPLE_SLOTS)):
        with np.errstate(over="ignore"):
            key = tk.mix(key[:-1] + _STEP) + p.hash[k:]
        whole.append(p.piece[k:] == p.piece[:-k])
        slots.append((tk.mix(key) & tk.U64(size - 1)).astype(np.int64) + base)
        base += size
    return whole, slots


def _sketch_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of a task's words, pairs and triples in zstandard blocks, and (lang, n) with block -1. A counter
    stops at 255, which is above any least count."""
    seen = np.zeros(SLOTS, np.uint8)
    words: dict[str, int] = {}
    for batch in batches:
        for rows, buf, offs in tk.slices(batch, "text", SLICE):
            p = _Pieces(rows, buf, offs)
            at, n = np.unique(np.concatenate([slot[ok] for ok, slot in zip(*_counters(p), strict=True)]), return_counts=True)
            seen[at] = np.minimum(seen[at] + n, 255)
            per = np.bincount(p.langs.indices.to_numpy()[p.row], minlength=len(p.langs.dictionary))
            for lang, n in zip(p.langs.dictionary.to_pylist(), per.tolist(), strict=True):
                words[lang] = words.get(lang, 0) + n
    yield tk.record_batch(lang=pa.array(list(words), pa.string()), block=pa.array([-1] * len(words), pa.int32()), data=pa.nulls(len(words), pa.binary()), n=pa.array(list(words.values()), pa.int64()))
    pack = zstandard.ZstdCompressor(level=1)
    for k in range(len(seen) // BLOCK):
        part = seen[k * BLOCK:(k + 1) * BLOCK]
        if part.any():
            yield tk.record_batch(lang=pa.nulls(1, pa.string()), block=pa.array([k], pa.int32()), data=[pack.compress(part.tobytes())], n=pa.nulls(1, pa.int64()))


def _sum_map(least: int):
    """Adds up the blocks that a task gets, one by one; data becomes a bit for each counter of ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            inner = batch.column(1).to_numpy() >= 0
            yield batch.filter(pa.array(~inner))
            for block, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block >= 0:
                    got = sums.setdefault(block, np.zeros(BLOCK, np.uint8))
                    more = np.frombuffer(unpack.decompress(data.as_py()), np.uint8)
                    np.minimum(got.astype(np.uint16) + more, 255, out=got, casting="unsafe")
        for block, got in sums.items():
            yield tk.record_batch(lang=pa.nulls(1, pa.string()), block=pa.array([block], pa.int32()), data=[np.packbits(got >= least, bitorder="little").tobytes()], n=pa.nulls(1, pa.int64()))
    return run


def _test(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _gram_map(frequent):
    """(lang, k, phrase, c) for each word the longest gram from it on that can be frequent, in words 4
    at most: an edge, or for k < 4 the end of a piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(frequent.value, np.uint8)
        for batch in batches:
            for rows, buf, offs in tk.slices(batch, "text", SLICE):
                p = _Pieces(rows, buf, offs)
                whole, slots = _counters(p)
                reach = np.zeros(len(p.hash), np.int8)
                goes = np.ones(len(p.hash) + 1, bool)
                for k in range(LONGEST):
                    # a k-gram can be frequent if its two (k-1)-grams and its own counter say so
                    goes = goes[:-1] & goes[1:]
                    if k < len(slots):
                        goes &= whole[k] & _test(bits, slots[k])
                    reach[:len(goes)] += goes
                for k in range(1, LONGEST + 1):
                    where = np.flatnonzero(reach == k)
                    if not len(where):
                        continue
                    key = np.zeros(len(where), tk.U64)
                    for j in range(k):
                        with np.errstate(over="ignore"):
                            key = tk.mix(key) + p.hash[where + j]
                    _, one, count = np.unique(key, return_index=True, return_counts=True)
                    heads = where[one]
                    parts = [p.words.take(pa.array(heads + j)) for j in range(k)]
                    phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
                    lang = p.langs.take(pa.array(p.row[heads])).dictionary_decode()
                    for i in range(0, len(one), 1 << 17):
                        cut = slice(i, i + (1 << 17))
                        yield tk.record_batch(lang=lang[cut], k=pa.array(np.full(len(one[cut]), k, np.int32)), phrase=phrase[cut].cast(pa.string()), c=pa.array(count[cut].astype(np.int64)))
    return run


def _flow(counts: DataFrame, k: int, least: int) -> DataFrame:
    """One step down: k-gram counts from the flow of the (k+1)-grams and the pieces that end with the k-gram.
    Rows with ``settled`` are counts of longer grams that are done and frequent."""
    done = f"named_struct('settled', true, 'k', k, 'phrase', phrase, 'c', c)"
    down = f"named_struct('settled', false, 'k', {k}, 'phrase', substring_index(phrase, ' ', {k}), 'c', c)"
    return counts.selectExpr("lang", f"""inline(case when settled or k <= {k} then array(named_struct('settled', settled, 'k', k, 'phrase', phrase, 'c', c))
        when c >= {least} then array({done}, {down}) else array({down}) end)""").groupBy("lang", "settled", "k", "phrase").agg(F.sum("c").alias("c"))


def frequent_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, f) of all 1- to 4-grams with f >= least, (lang, n) word totals)."""
    if not 1 <= least <= 255:
        raise ValueError("least must be 1 to 255")
    spark = docs.sparkSession
    d = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    schema = "lang string, block int, data binary, n long"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(tk.map_batches(tk.map_batches(d, _sketch_map, schema).repartition(parts, "block", "lang"), _sum_map(least), schema), "word-sketch")
    totals = counted.where("block < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    bits = np.zeros(SLOTS // 8, np.uint8)
    for block, part in counted.where("block >= 0").select("block", "data").toLocalIterator():  # a bit for each counter in all
        bits[block * BLOCK // 8:(block + 1) * BLOCK // 8] = np.frombuffer(part, np.uint8)
    frequent = spark.sparkContext.broadcast(bits.tobytes())
    counts = tk.map_batches(d, _gram_map(frequent), "lang string, k int, phrase string, c long").groupBy("lang", "k", "phrase").agg(F.sum("c").alias("c")).select(
        "lang", F.lit(False).alias("settled"), "k", "phrase", "c")
    for k in range(LONGEST - 1, 0, -1):
        counts = _flow(counts, k, least)
    found = counts.where(f"c >= {least}").select("lang", "k", "phrase", F.col("c").alias("f"))
    return stored(found, "grams"), totals


def unary_paths(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(lang, src, dst, w, path, dist) of edges (lang, src, dst, w): the path's last edge and the steps to it.

    An edge goes on where its end has no other edge in and one edge out. A pointer that has not
    reached its path's end is one of its kind for its target, so no join is uneven. Circles have no
    end: they are what is left when a round brings no new arrivals, and each of their edges stays alone."""
    e = stored(edges.withColumn("id", F.xxhash64("lang", "src", "dst")), "edges")
    into = e.groupBy("lang", F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    out = e.groupBy("lang", F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.max("id").alias("next"))
    onward = into.join(out, ["lang", "node"]).where("n_in = 1 and n_out = 1").select("lang", F.col("node").alias("dst"), "next")
    at = e.join(onward, ["lang", "dst"], "left").select("id", F.coalesce("next", "id").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("next").isNull().alias("ended"))
    at = stored(at, "pointers")
    left = at.where("not ended").count()
    for _ in range(max_rounds):
        if not left:
            break
        target = at.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("dist").alias("more"), F.col("ended").alias("there"))
        at = stored(at.where("ended").unionByName(at.where("not ended").join(target, "to").select("id", F.col("far").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), F.col("there").alias("ended"))), "pointers")
        still = at.where("not ended").count()
        if still == left:
            break
        left = still
    return e.join(at, "id").select("lang", "src", "dst", "w", F.expr("if(ended, to, id)").alias("path"), F.expr("if(ended, dist, 0)").alias("dist"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language."""
    grams, totals = frequent_grams(docs, lang_col, text_col, least)
    edges = grams.where(f"k = {LONGEST}").select("lang", F.expr(f"substring_index(phrase, ' ', {LONGEST - 1})").alias("src"), F.expr(f"substring_index(phrase, ' ', {1 - LONGEST})").alias("dst"), F.col("f").alias("w"))
    paths = stored(unary_paths(edges), "paths")
    weight = paths.groupBy("path").agg(F.min("w").alias("path_w"))
    # an edge with steps left ends in a node inside its path
    inside = paths.where("dist > 0").join(weight, "path").select("lang", F.col("dst").alias("phrase"), "path_w")
    open_ = grams.where("k > 1").join(inside, ["lang", "phrase"], "left").where("path_w is null or 5 * path_w < 4 * f").select("lang", "k", "phrase", "f")
    longer = grams.where("k > 2").selectExpr("lang", "explode(array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k))) as phrase", "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = open_.join(longer, ["lang", "phrase"], "left").where("longer is null or 5 * longer < 4 * f").select("lang", "k", "phrase", F.col("f").alias("a"))
    cuts = kept.selectExpr("lang", "k", "phrase", "a", "explode(sequence(1, k - 1)) as cut").selectExpr(
        "lang", "phrase", "a", "cut", "inline(array(struct(0 as side, substring_index(phrase, ' ', cut) as part), struct(1 as side, substring_index(phrase, ' ', cut - k) as part)))")
    looked = cuts.join(grams.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    scored = looked.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.expr("if(side = 0, f, null)")).alias("l"), F.max(F.expr("if(side = 1, f, null)")).alias("r")).withColumn(
        "score", F.expr("(cast(a as decimal(19, 0)) * 2000000) div (l + r)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
