"""Operator 11, ranked lexical search over a length-stratified index.

The score divides by ``1000 * tf + 12 * m``, so documents of equal normaliser m form a stratum in which
a term's impact depends on its tf alone. Index (``build_index``): documents are dealt by stratum, in
parts of about ``PART_WORDS`` words, so a stratum that holds a third of all documents is many rows. A
row holds the document ids and, for each term, its postings ordered by tf: all terms of all documents.

Search (``search``), for a block of queries at a time (a block holds at most ``BLOCK_TERMS`` query terms):

1. One pass over the index sums up the document frequencies of the block's terms.
2. In a second pass, impacts are computed once for each tf of a stratum. A term's highest tf in a row
   gives its highest impact, the sum over a query's terms the row's bound for it. A task visits the
   rows of a batch in order of falling bound, keeps a query's best documents, and leaves out rows
   whose bound is below the score of the last of them. No document that can rank is left out.
3. The best ``top`` of each task are ranked by query.

Terms are identified by 64-bit hashes. Weights use the doubles of the C library's ``log``; all else is
integer. Sums are made in doubles where they stay below 2^53 and are therefore exact, else in Python
integers.

Defined edge cases: null and empty texts have no terms and are never found; an item without terms has
no rows; an item table with repeated rows ranks each row by itself; rows that repeat a doc_id are
documents of their own; null doc_ids come last among equal scores; an empty table on either side gives
no rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import textkit as tk
from churnlens.llm.graph import stored

TOP = 20
PART_WORDS = 1 << 20
#: query terms of a block; a broadcast of 12 bytes for each
BLOCK_TERMS = 1 << 20
#: strata with more than one part that are sent along with the plan; more are joined
MAX_SPLIT = 100_000
_NO_ID = np.iinfo(np.int64).max
_INDEX = "m long, part long, docs binary, terms binary, starts binary, tfs binary, where binary"


def _count_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, docs) of documents with n terms, for each length in a task."""
    seen: dict[int, int] = {}
    for batch in batches:
        for _, buf, offs in tk.slices(batch, "text"):
            starts, _ = tk.runs(tk.ALNUM[tk.LOWER[buf]], offs)
            n, docs = np.unique(np.diff(np.searchsorted(starts, offs)), return_counts=True)
            for a, b in zip(n.tolist(), docs.tolist(), strict=True):
                seen[a] = seen.get(a, 0) + b
    yield tk.record_batch(n=pa.array(list(seen), pa.int64()), docs=pa.array(list(seen.values()), pa.int64()))


def _normaliser(n: int, docs: int, words: int) -> int:
    return 75 + 25 * n * docs // words


def _measure_map(docs: int, words: int):
    """Adds each text's normaliser; drops texts without terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in tk.slices(batch, "text"):
                starts, _ = tk.runs(tk.ALNUM[tk.LOWER[buf]], offs)
                n = np.diff(np.searchsorted(starts, offs)).tolist()
                out = pa.RecordBatch.from_arrays([pa.array([_normaliser(k, docs, words) for k in n], pa.int64()), rows.column(0), rows.column(1)], names=["m", "doc_id", "text"])
                yield out.filter(pa.array([k > 0 for k in n], pa.bool_()))
    return run


class _Part:
    """Postings of one part of a stratum, gathered slice by slice."""

    def __init__(self, m: int, part: int) -> None:
        self.m, self.part, self.ids, self.terms, self.tfs, self.where = m, part, [], [], [], []
        self.docs = 0

    def add(self, ids: np.ndarray, h: np.ndarray, row: np.ndarray) -> None:
        """Documents ``ids`` and their words: hash and number of the document."""
        order = np.lexsort((row, h))
        h, d = h[order], row[order] + self.docs
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, np.int64)
        self.ids.append(ids)
        self.terms.append(h[first])
        self.tfs.append(np.diff(np.append(first, len(h))).astype(np.uint32))
        self.where.append(d[first].astype(np.uint32))
        self.docs += len(ids)

    def row(self) -> pa.RecordBatch:
        terms, tfs, where = np.concatenate(self.terms), np.concatenate(self.tfs), np.concatenate(self.where)
        order = np.lexsort((tfs, terms))
        terms, tfs, where = terms[order], tfs[order], where[order]
        first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
        starts = np.append(first, len(terms)).astype(np.uint32)
        return tk.record_batch(m=pa.array([self.m], pa.int64()), part=pa.array([self.part], pa.int64()), docs=[np.concatenate(self.ids).tobytes()],
                               terms=[terms[first].tobytes()], starts=[starts.tobytes()], tfs=[tfs.tobytes()], where=[where.tobytes()])


def _index_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (m, part); rows come sorted by them."""
    held: _Part | None = None
    for batch in batches:
        for rows, buf, offs in tk.slices(batch, "text"):
            w = tk.Words(buf, offs, tk.ALNUM, lower=True)
            row = np.repeat(np.arange(rows.num_rows), w.counts())
            m, part = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            ids = rows.column(2).fill_null(_NO_ID).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (part[1:] != part[:-1]))))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), rows.num_rows], strict=True):
                if held is None or (held.m, held.part) != (m[a], part[a]):
                    if held is not None:
                        yield held.row()
                    held = _Part(int(m[a]), int(part[a]))
                words = slice(w.bounds[a], w.bounds[b])
                held.add(ids[a:b], w.hash[words], row[words] - a)
    if held is not None:
        yield held.row()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(index rows, N, L)."""
    spark = docs.sparkSession
    d = tk.texts(docs, id_col, text_col).where("text is not null")
    lengths = stored(tk.map_batches(d.select("text"), _count_map, "n long, docs long").where("n > 0").groupBy("n").agg(F.sum("docs").alias("docs")), "lengths")
    total = lengths.agg(F.sum("docs"), F.sum(F.col("docs").cast("decimal(38,0)") * F.col("n"))).first()
    n_docs, n_words = int(total[0] or 0), int(total[1] or 0)
    if not n_docs:
        return spark.createDataFrame([], _INDEX), 0, 0
    # decimals: 25 * n * N may pass 64 bits on the way
    strata = lengths.withColumn("m", F.expr(f"75 + (25 * cast(n as decimal(19, 0)) * {n_docs}) div {n_words}")).groupBy("m").agg(
        F.ceil(F.sum(F.col("docs").cast("double") * F.col("n")) / PART_WORDS).cast("long").alias("parts")).where("parts > 1")
    if strata.count() <= MAX_SPLIT:
        strata = F.broadcast(strata)
    measured = tk.map_batches(d, _measure_map(n_docs, n_words), "m long, doc_id long, text string")
    dealt = measured.join(strata, "m", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.coalesce("parts", F.lit(1)))).select("m", "part", "doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.repartition(n, "m", "part").sortWithinPartitions("m", "part")
    return stored(tk.map_batches(rows, _index_map, _INDEX), "strata"), n_docs, n_words


def _query_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offs in tk.slices(batch, "text"):
            w = tk.Words(buf, offs, tk.ALNUM, lower=True)
            got = [np.unique(w.hash[a:b], return_counts=True) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
            yield tk.record_batch(qid=rows.column(0), terms=[t.tobytes() for t, _ in got], times=[c.astype(np.int64).tobytes() for _, c in got], n=np.array([len(t) for t, _ in got], np.int64))


class _Index:
    """An index row, narrowed to the sorted query terms ``vocab``."""

    def __init__(self, vocab: np.ndarray, m: int, docs: bytes, terms: bytes, starts: bytes, tfs: bytes, where: bytes) -> None:
        self.m, self.ids = m, np.frombuffer(docs, np.int64)
        own, starts = np.frombuffer(terms, np.uint64), np.frombuffer(starts, np.uint32).astype(np.int64)
        self.tfs, self.where = np.frombuffer(tfs, np.uint32), np.frombuffer(where, np.uint32)
        at = np.minimum(np.searchsorted(own, vocab), len(own) - 1)
        there = own[at] == vocab
        self.begin, self.end = np.where(there, starts[at], 0), np.where(there, starts[at + 1], 0)

    def impacts(self, tf: np.ndarray) -> np.ndarray:
        """Computed once for each tf that occurs."""
        each, back = np.unique(tf, return_inverse=True)
        return (10**9 * each.astype(np.int64) // (1000 * each.astype(np.int64) + 12 * self.m))[back]

    def ceilings(self) -> np.ndarray:
        """Each query term's impact at its highest tf, the last of its postings; 0 where it is absent."""
        out = np.zeros(len(self.begin), np.int64)
        there = np.flatnonzero(self.end > self.begin)
        out[there] = self.impacts(self.tfs[self.end[there] - 1])
        return out

    def scores(self, terms: np.ndarray, weights: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a query; its terms are places in the vocabulary."""
        begin, size = self.begin[terms], self.end[terms] - self.begin[terms]
        total = int(size.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        worth = np.repeat(weights, size) * self.impacts(self.tfs[at])
        docs = self.where[at]
        if exact:
            score = np.bincount(docs, worth.astype(np.float64), len(self.ids)).astype(np.int64)
        else:
            score = np.zeros(len(self.ids), np.int64)
            np.add.at(score, docs, worth)
        found = np.flatnonzero(score)
        return found, score[found]


def _df_map(vocab):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = np.frombuffer(vocab.value, np.uint64)
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = _Index(terms, *row)
                df += x.end - x.begin
        at = np.flatnonzero(df)
        yield tk.record_batch(term=at, df=df[at])
    return run


def _search_map(vocab, queries, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = np.frombuffer(vocab.value, np.uint64)
        qids, bounds, flat, worth = queries.value
        best_id = {q: np.zeros(0, np.int64) for q in range(len(qids))}
        best = dict(best_id)
        for batch in batches:
            rows = [_Index(terms, *row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            tops = [x.ceilings() for x in rows]
            for q in range(len(qids)):
                own, weight = flat[bounds[q]:bounds[q + 1]], worth[bounds[q]:bounds[q + 1]]
                # a bound in doubles would do; Python integers can't overflow
                limit = [int(weight @ t[own]) for t in tops] if float(weight.astype(float).sum()) < 9e12 else [sum(int(a) * int(b) for a, b in zip(weight, t[own], strict=True)) for t in tops]
                for k in sorted(range(len(rows)), key=lambda k: -limit[k]):
                    if not limit[k] or len(best[q]) == top and limit[k] < best[q][-1]:
                        break
                    docs, score = rows[k].scores(own, weight, limit[k] < 1 << 53)
                    if len(best[q]) == top:
                        docs, score = docs[score >= best[q][-1]], score[score >= best[q][-1]]
                    elif len(score) > 4 * top:
                        least = np.partition(score, -top)[-top]
                        docs, score = docs[score >= least], score[score >= least]
                    ids, score = np.concatenate((best_id[q], rows[k].ids[docs])), np.concatenate((best[q], score))
                    order = np.lexsort((ids, -score))[:top]
                    best_id[q], best[q] = ids[order], score[order]
        for q in range(len(qids)):
            if len(best[q]):
                yield tk.record_batch(qid=np.full(len(best[q]), qids[q], np.int64), doc_id=best_id[q], score=best[q])
    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``top`` documents of each item."""
    index, n_docs, _ = build_index(docs, id_col, text_col)
    return search_index(index, n_docs, items, top, item_id, item_text)


def search_index(index: DataFrame, n_docs: int, items: DataFrame, top: int = TOP, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    spark = items.sparkSession
    named = stored(items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).withColumn("qid", F.monotonically_increasing_id()), "items")
    asked = stored(tk.map_batches(named.where("text is not null").select("qid", "text"), _query_map, "qid long, terms binary, times binary, n long").where("n > 0"), "queries")
    blocks = math.ceil((asked.agg(F.sum("n")).first()[0] or 0) / BLOCK_TERMS)
    found = spark.createDataFrame([], "qid long, doc_id long, score long")
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).collect()  # about BLOCK_TERMS terms
        if not rows:
            continue
        terms = [np.frombuffer(r.terms, np.uint64) for r in rows]
        vocab, flat = np.unique(np.concatenate(terms), return_inverse=True)
        sent = spark.sparkContext.broadcast(vocab.tobytes())
        columns = index.select("m", "docs", "terms", "starts", "tfs", "where")
        df = np.zeros(len(vocab), np.int64)
        for r in tk.map_batches(columns, _df_map(sent), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term of the block
            df[r.term] = r.df
        # a term of no document can't score
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)
        times = np.concatenate([np.frombuffer(r.times, np.int64) for r in rows])
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
        queries = spark.sparkContext.broadcast(([r.qid for r in rows], bounds, flat, times * w[flat]))
        found = found.unionByName(stored(tk.map_batches(columns, _search_map(sent, queries, top), "qid long, doc_id long, score long"), "hits"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(named.select("qid", "item_id"), "qid").select("item_id", "rank", F.when(F.col("doc_id") != int(_NO_ID), F.col("doc_id")).alias("doc_id"), "score")
