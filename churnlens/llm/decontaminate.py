"""Operator 5, benchmark decontamination with a distributed positional inverted index.

Benchmark items are cut into windows of ``WINDOW`` words (shorter items are one window). They are
the query set and run in blocks of bounded size. For each block:

1. one scan counts how often each benchmark term occurs in the documents (all rows);
2. each window picks its ``RAREST`` rarest terms; a window with a term that never occurs is done;
3. a second scan stores the positional postings of the picked terms: (term, document, position,
   the words around it), the inverted index;
4. postings join the windows on the term; the offset-adjusted positions of a window's terms are
   intersected, and the words around the rarest one decide the exact phrase match;
5. terms of one window that occur within ``SLOP`` words of each other in any order are a
   proximity match.

Hit words are the union of the matched spans per document. Terms are 64-bit word hashes.

Defined edge cases: null, empty and wordless texts have no words and no hits; items without words
have no window; an empty benchmark hits nothing; repeated rows give repeated results; a row with a
null id is judged as any other and keeps its null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import textkit as tk
from churnlens.llm.graph import stored

WINDOW, RAREST, SLOP = 13, 2, 26
#: benchmark items of one block (one scan pair of the documents each)
BLOCK_ITEMS = 20_000
#: the window table of a block is broadcast up to so many rows, and joined beyond
BROADCAST_ROWS = 500_000


def _count_map(terms_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = terms_ref.value
        counts = np.zeros(len(terms), dtype=np.int64)

        def rows(kind, ids, keys, n):
            return tk.record_batch(kind=pa.array(np.full(len(n), kind), pa.int32()), doc_id=ids, tkey=keys, n=pa.array(n, pa.int64()))

        for batch in batches:
            for part, buf, offs in tk.slices(batch, "text"):
                w = tk.Words(buf, offs, tk.ALNUM, lower=True)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
                    counts += np.bincount(at[terms[at] == w.hash], minlength=len(terms))
                yield rows(0, part.column(0), part.column(1), w.counts())
        used = np.flatnonzero(counts)
        yield rows(1, pa.nulls(len(used), pa.int64()), pa.array(used, pa.int64()), counts[used])
    return run


def _postings_map(picked_ref, lead_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked, first = picked_ref.value, lead_ref.value  # sorted terms; whether a term leads a window
        for batch in batches:
            for part, buf, offs in tk.slices(batch, "text"):
                w = tk.Words(buf, offs, tk.ALNUM, lower=True)
                at = np.minimum(np.searchsorted(picked, w.hash), len(picked) - 1)
                p = np.flatnonzero(picked[at] == w.hash)
                if not len(p):
                    continue
                row = np.searchsorted(w.bounds, p, "right") - 1
                lo, hi = np.maximum(w.bounds[row], p - WINDOW + 1), np.minimum(w.bounds[row + 1], p + WINDOW)
                raw = w.hash.tobytes()
                around = [raw[8 * a:8 * b] if x else None for a, b, x in zip(lo.tolist(), hi.tolist(), first[at[p]].tolist(), strict=True)]
                yield tk.record_batch(
                    term=w.hash[p].view(np.int64), doc_id=part.column(0).take(pa.array(row)), tkey=part.column(1).take(pa.array(row)),
                    pos=p - w.bounds[row], before=p - lo, around=pa.array(around, pa.binary()))
    return run


def item_windows(items: list[tuple[int, str | None]]) -> list[tuple[int, np.ndarray]]:
    """(item_id, word hashes) of every window of the items."""
    out = []
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h = tk.Words(raw, np.array([0, len(raw)]), tk.ALNUM, lower=True).hash
        out += [(item, h[k:k + WINDOW]) for k in range(max(1, len(h) - WINDOW + 1))] if len(h) else []
    return out


def _block(d: DataFrame, items: list[tuple[int, str | None]]) -> tuple[DataFrame, DataFrame | None]:
    """Word counts of all documents, and the matches (doc_id, tkey, item, start, size, exact) of one block."""
    spark = d.sparkSession
    sc = spark.sparkContext
    windows = item_windows(items)
    terms = np.unique(np.concatenate([h for _, h in windows])) if windows else np.zeros(0, tk.U64)
    rows = stored(tk.map_batches(d, _count_map(sc.broadcast(terms)), "kind int, doc_id long, tkey long, n long"), "terms")
    counts = np.zeros(len(terms), dtype=np.int64)
    for r in rows.where("kind = 1").groupBy("tkey").agg(F.sum("n").alias("n")).collect():  # one row for each benchmark term
        counts[r.tkey] = r.n
    lookup, picked, leads = [], set(), set()
    for number, (item, h) in enumerate(windows):
        n = counts[np.searchsorted(terms, h)]
        if not n.all():
            continue
        distinct, offset = np.unique(h, return_index=True)
        order = np.lexsort((offset, n[offset]))[:RAREST]
        for k, j in enumerate(order):
            lookup.append((int(distinct[j].view(np.int64)), number, item, int(offset[j]), len(h), k, len(order), h.tobytes() if k == 0 else None))
            picked.add(int(distinct[j]))
        leads.add(int(distinct[order[0]]))
    if not lookup:
        return rows.where("kind = 0"), None
    sorted_terms = np.array(sorted(picked), dtype=tk.U64)
    lead = np.array([t in leads for t in sorted(picked)])
    index = stored(tk.map_batches(d, _postings_map(sc.broadcast(sorted_terms), sc.broadcast(lead)),
                                  "term long, doc_id long, tkey long, pos long, before long, around binary"), "postings")
    table = spark.createDataFrame(lookup, "term long, win long, item long, off int, size int, no int, terms int, words binary")
    found = index.join(F.broadcast(table) if len(lookup) <= BROADCAST_ROWS else table, "term").select(
        "doc_id", "tkey", "win", "item", "size", "no", "terms", "pos", (F.col("pos") - F.col("off")).alias("start"),
        F.expr("words is not null and off <= before and substring(around, cast(8 * (before - off) + 1 as int), 8 * size) = words").alias("same"))
    key = ["doc_id", "tkey", "win", "item", "size"]
    exact = found.groupBy(*key, "start").agg(F.bit_or(F.expr("shiftleft(1, no)")).alias("seen"), F.max("same").alias("same"), F.max("terms").alias("terms")).where(
        "same and seen = shiftleft(1, terms) - 1").select("doc_id", "tkey", "win", "item", "start", "size", F.lit(True).alias("exact"))
    by_place = Window.partitionBy("doc_id", "tkey", "win").orderBy("pos", "no")
    near = found.where("terms > 1").withColumn("gap", F.when(F.lag("no").over(by_place) != F.col("no"), F.col("pos") - F.lag("pos").over(by_place))).where(
        F.col("gap") <= SLOP).groupBy("doc_id", "tkey", "win", "item").agg(F.min("start").alias("start"), F.max("size").alias("size")).withColumn("exact", F.lit(False))
    return rows.where("kind = 0"), exact.unionByName(near)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(word counts by row, matches): exact phrase and proximity matches of all benchmark windows."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tkey"), F.col(text_col).cast("string").alias("text"))
    b = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    blocks = max(1, -(-b.count() // BLOCK_ITEMS))
    rows, parts = None, []
    for k in range(blocks):
        items = [(r.item_id, r.text) for r in b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        rows, found = _block(d, items)
        if found is not None:
            parts.append(found.withColumn("win", F.col("win") * blocks + k))
    none = d.sparkSession.createDataFrame([], "doc_id long, tkey long, win long, item long, start long, size int, exact boolean")
    return rows, reduce(DataFrame.unionByName, parts) if parts else none


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, hit words, matched items, proximity matches, verdict."""
    rows, found = matches(docs, benchmark, id_col, text_col)
    found = stored(found, "matches")
    key = ["doc_id", "tkey"]
    spans = found.where("exact").select(*key, "start", (F.col("start") + F.col("size")).alias("stop")).distinct()
    before = Window.partitionBy(*key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    hit = spans.withColumn("reached", F.max("stop").over(before)).withColumn(
        "new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("reached", F.lit(0))))).groupBy(*key).agg(F.sum("new").alias("n_hit"))
    items = found.where("exact").groupBy(*key).agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    close = found.groupBy(*key, "win").agg(F.max("exact").alias("exact")).where("not exact").groupBy(*key).agg(F.count("*").alias("n_near"))
    # grouped, not joined: nulls are equal in a grouping
    facts = hit.unionByName(items, allowMissingColumns=True).unionByName(close, allowMissingColumns=True).groupBy(
        F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).agg(*[F.max(c).alias(c) for c in ("n_hit", "items", "n_near")])
    out = rows.select("doc_id", "tkey", F.col("n").alias("n_words")).join(
        facts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        "doc_id", "tkey", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"))
