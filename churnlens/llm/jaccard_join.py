"""Operator 2, n-gram Jaccard join with multiple global orders.

A document is the set of its distinct word shingles; two documents link when their Jaccard
similarity reaches ``PERCENT`` / 100. Equal sets form one class, and only classes are joined.

1. One scan gives each document its set size and set key, and a fixed-size sketch of how many
   documents hold each shingle (``SLOTS`` counters over all rows).
2. Order 1 sorts shingles by sketch count (rare first), then by hash. Similar sets must share a
   token among the first n - ceil(0.8 n) + 1 of it, so those tokens are joined on. Any order that
   all rows agree on keeps this exact, so the sketch may be coarse.
3. Rounds of star joins: in each token bucket one leader is tried against the others, links are
   merged into components, and buckets that hold one component only are finished. In what is left,
   each member outside a bucket's largest component meets all its members if there are few such.
   Else the members are joined on what tells them from the bucket's leader: two sets that do not
   both link with it can link only if their symmetric differences from it overlap by so much that
   prefixes of these, rare tokens first, share a token. Near copies have the tokens of a difference
   to themselves, so a group of thousands of them costs pairs in proportion to its size.
4. A candidate must also pass two more global orders (ascending and descending shingle hash): it
   shares a prefix token under each, and what the two prefixes show in common leaves room for the
   overlap that the threshold asks for. The prefixes are kept as 32-bit stubs, a tenth of a set
   each; equal stubs of different tokens can only let a pair through.
5. The pairs that all orders let through are verified on the whole sets, which are made again from
   the texts of just these documents.

A bucket whose token the sketch shows to be frequent is split into parts of about ``HOT_DOCS``
documents however large it is; the leaders of the parts meet in a second star. Nothing is capped
or sampled.

Defined edge cases: null, empty or blank texts have no shingles, link with nothing and are their
own component. Texts of fewer than five words are one shingle. Rows that repeat a doc_id are
separate rows with the same id; the component id is the least doc_id of all linked rows. A row with a
null id links as any other; only a component without any id has a null component id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import textkit as tk
from churnlens.llm.graph import components, stored

WORDS, PERCENT = 5, 80
SLOTS = 1 << 18
#: a token whose sketch slot holds this many more documents than the mean slot is split into parts of so many
HOT_DOCS = 1000
STAR_ROUNDS = 2
#: buckets with more members outside the largest component are joined on differences from the leader
FEW = 200
#: up to so many ids are broadcast to pick rows out of a scan; beyond it the scan is joined
BROADCAST_IDS = 1_000_000


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their bounds."""
    w = tk.Words(buf, offs, tk.NON_SPACE, lower=True)
    sets, sizes = [], []
    for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        n = b - a
        got = np.unique(tk.ngrams(w.hash[a:b], min(words, n))) if n else w.hash[:0]
        sets.append(got)
        sizes.append(len(got))
    return np.concatenate(sets) if sets else w.hash[:0], np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def set_keys(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit key of each set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, tk.U64), np.cumsum(tk.mix(tokens + tk._STEP), dtype=tk.U64)))
        return tk.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(tk.U64)).view(np.int64)


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> tk.U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def prefix_length(n: int) -> int:
    """n - ceil(0.8 n) + 1."""
    return n - (PERCENT * n + 99) // 100 + 1


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(SLOTS, dtype=np.int64)

    def rows(kind: int, ids, rks, keys, n):
        return tk.record_batch(kind=pa.array(np.full(len(keys), kind), pa.int32()), doc_id=ids, rk=rks, key=keys, n=n)

    for batch in batches:
        for part, buf, offs in tk.slices(batch, "text"):
            tokens, bounds = shingle_sets(buf, offs)
            sketch += np.bincount(_slot(tokens), minlength=SLOTS)
            yield rows(0, part.column(0), part.column(part.schema.get_field_index("rk")), set_keys(tokens, bounds), np.diff(bounds))
    used = np.flatnonzero(sketch)
    for i in range(0, len(used), 50_000):
        at = used[i:i + 50_000]
        yield rows(1, pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), at, sketch[at])


def profile(docs: DataFrame) -> DataFrame:
    """kind 0: (doc_id, row key, set key, set size) of each row; kind 1: (slot, documents) of the sketch."""
    return stored(tk.map_batches(docs, _profile, "kind int, doc_id long, rk long, key long, n long"), "sets")


def _prefix_map(sketch_ref, mean: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sketch_ref.value
        seen: set[int] = set()  # copies in one task give the same rows once
        for batch in batches:
            for _, buf, offs in tk.slices(batch, "text"):
                tokens, bounds = shingle_sets(buf, offs)
                keys = set_keys(tokens, bounds)
                weight = sketch[_slot(tokens)]
                got, node, size = [], [], []
                for i, key in enumerate(keys.tolist()):
                    a, b = bounds[i], bounds[i + 1]
                    if a == b or key in seen:
                        continue
                    seen.add(key)
                    p = prefix_length(b - a)
                    order = np.argsort(weight[a:b], kind="stable")[:p] + a
                    got.append(order)
                    node.append(np.full(p, key, np.int64))
                    size.append((int(b - a) << 32) + np.arange(p, dtype=np.int64))
                if not got:
                    continue
                at, node = np.concatenate(got), np.concatenate(node)
                token = tokens[at]
                parts = np.maximum((weight[at] - mean) // HOT_DOCS, 0).astype(tk.U64)
                salt = np.where(parts > 0, 1 + node.view(tk.U64) % (parts + tk.U64(1)), 0).astype(tk.U64)
                with np.errstate(over="ignore"):
                    bucket = np.where(salt > 0, tk.mix(token + salt * tk._STEP), token)
                yield tk.record_batch(bucket=bucket.view(np.int64), token=np.where(salt > 0, token, 0).astype(tk.U64).view(np.int64),
                                      node=node, npos=np.concatenate(size))
    return run


def _sets_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, buf, offs in tk.slices(batch, "text"):
            tokens, bounds = shingle_sets(buf, offs)
            raw = tokens.tobytes()
            yield tk.record_batch(node=set_keys(tokens, bounds), tokens=pa.array([raw[8 * a:8 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))


def _stubs_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, buf, offs in tk.slices(batch, "text"):
            tokens, bounds = shingle_sets(buf, offs)
            stubs = (tokens >> tk.U64(32)).astype(np.uint32)
            low, high = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                p = prefix_length(b - a) if b > a else 0
                low.append(stubs[a:a + p].tobytes())
                high.append(stubs[b - p:b].tobytes())
            yield tk.record_batch(node=set_keys(tokens, bounds), n=np.diff(bounds).astype(np.int32), low=pa.array(low, pa.binary()), high=pa.array(high, pa.binary()))


def _in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries of ``a`` occur in ``b``; with stubs, never less than the tokens in common."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def may_link(n: int, low_a: np.ndarray, high_a: np.ndarray, m: int, low_b: np.ndarray, high_b: np.ndarray) -> bool:
    """Whether sets of n and m tokens can link, by their prefixes under the two hash orders.

    Below the lesser of the two last stubs of the ascending prefixes both sets are known whole, and
    likewise above the descending ones; elsewhere the smaller rest may be all in common."""
    if 100 * min(n, m) < PERCENT * max(n, m) or not _in_common(low_a, low_b) or not _in_common(high_a, high_b):
        return False
    ends = min(low_a[-1], low_b[-1]), max(high_a[0], high_b[0])
    a = low_a[:np.searchsorted(low_a, ends[0])], high_a[np.searchsorted(high_a, ends[1], "right"):]
    b = low_b[:np.searchsorted(low_b, ends[0])], high_b[np.searchsorted(high_b, ends[1], "right"):]
    both = sum(_in_common(x, y) for x, y in zip(a, b, strict=True))
    rest = min(n - len(a[0]) - len(a[1]), m - len(b[0]) - len(b[1]))
    return (100 + PERCENT) * (both + rest) >= PERCENT * (n + m)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def difference_prefixes(d: int, n: int, m: int) -> tuple[int, int]:
    """How much of the ordered difference of a set of n tokens from a leader of m, d tokens long, is to
    be joined on: as the longer of two differences, and as the shorter.

    Sets of n and k tokens link if they differ in at most (n + k) / 9 tokens, where k <= 1.25 n, so the
    two differences share at least d - n / 4, for the shorter d - n / 8. If the shorter one's set links
    with the leader, the other's does not: its difference is over (k + m) / 9 long."""
    shorter = max(1, -((n - 8 * d) // 8), (9 * d + m - n) // 18 + 1 if 9 * d <= n + m else 1)
    return d - max(1, -((n - 4 * d) // 4)) + 1, max(0, d - shorter + 1)


def _difference_map(sketch_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sketch_ref.value
        for batch in batches:
            sides = [[np.frombuffer(x.as_py(), tk.U64) for x in batch.column(k)] for k in (4, 5)]
            row, token, d, pos, short = [], [], [], [], []
            for i, (a, b) in enumerate(zip(*sides, strict=True)):
                diff = np.setxor1d(a, b, assume_unique=True)
                p, q = difference_prefixes(len(diff), len(a), len(b)) if len(diff) else (0, 0)
                held = sketch[_slot(diff)]
                # a token of the leader is in the differences of the sets without it: the fewer the more hold it
                often = np.where(np.isin(diff, b, assume_unique=True), sketch[_slot(b)].max() - held, held)
                token.append(diff[np.argsort(often, kind="stable")[:p]])
                row.append(np.full(p, i))
                d.append(np.full(p, len(diff)))
                pos.append(np.arange(p))
                short.append(np.arange(p) < q)
            if not row:
                continue
            at, d = np.concatenate(row).astype(np.int64), np.concatenate(d).astype(np.int64)
            n, m = (np.array([len(x) for x in side], np.int64)[at] for side in sides)
            node, leader, component, of_leader = (batch.column(k).take(pa.array(at)) for k in range(4))
            yield tk.record_batch(node=node, leader=leader, component=component, of_leader=of_leader, token=np.concatenate(token).astype(tk.U64).view(np.int64),
                                  n=n, d=d, pos=np.concatenate(pos).astype(np.int64), short=np.concatenate(short).astype(bool), near=9 * d <= n + m)
    return run


def _screen_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stubs(column):
        return [np.frombuffer(x.as_py(), np.uint32) for x in column]

    for batch in batches:
        sides = (batch.column(k).to_pylist() if k in (2, 5) else stubs(batch.column(k)) for k in range(2, 8))
        ok = [may_link(*row) for row in zip(*sides, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _verify_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        ok = [similar(np.frombuffer(x.as_py(), tk.U64), np.frombuffer(y.as_py(), tk.U64)) for x, y in zip(left, right, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _both_sides(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with the named columns of ``rows`` for u, then for v."""
    a = rows.select(F.col("node").alias("u"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = rows.select(F.col("node").alias("v"), *[F.col(c).alias(f"b_{c}") for c in columns])
    tk.small_batches(pairs.sparkSession)
    return pairs.join(b, "v").join(a, "u").select("u", "v", *[f"a_{c}" for c in columns], *[f"b_{c}" for c in columns])


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _only(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is listed; the list (stored, distinct) is broadcast up to a bound and joined beyond it."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, on, "left_semi")


def _size_ok(n, m) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _ordered(x, y) -> list:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]


def _n() -> Column:
    return F.shiftright("npos", 32)


def _pos() -> Column:
    return F.col("npos").bitwiseAND(F.lit((1 << 32) - 1))


def _led(entries: DataFrame, step: int) -> DataFrame:
    """Entries with the leader ``l`` of their bucket and whether the bucket holds several components.
    A bucket is a part of bounded size, so the window is, too.

    First the set of the least key leads wherever it occurs, so that a group of clear copies costs one
    pair a member. Then the sets with most open entries lead: edits make rare shingles, which come
    first in order 1, so that the least edited set of a group shares most."""
    bucket = Window.partitionBy("bucket")
    first = -F.count("*").over(Window.partitionBy("node")) if step else F.lit(0).cast("bigint")
    leader = F.min(F.struct("first", "node", _n().alias("n"), "component")).over(bucket)
    mixed = F.min("component").over(bucket) != F.max("component").over(bucket)
    return entries.withColumn("first", first).withColumn("l", leader).withColumn("mixed", mixed).drop("first")


def _open(led: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries of tokens that hold two components or more; for split tokens, the leaders of their
    parts and the leader ``h`` among these."""
    parts = led.where("token <> 0 and node = l.node")
    heads = parts.groupBy("token").agg(F.min("l").alias("h"), F.max("mixed").alias("mixed"), F.min("component").alias("a"), F.max("component").alias("b")).where(
        "mixed or a <> b").select("token", "h")
    split = led.where("token <> 0").join(heads.select("token"), "token", "left_semi").select(*led.columns)
    return led.where("token = 0 and mixed").unionByName(split), parts, heads


def _star_pairs(still: DataFrame, parts: DataFrame, heads: DataFrame) -> DataFrame:
    """(u, v) of each bucket member and its bucket's leader, where their components differ; parts of
    one split token meet through their leaders."""
    pairs = still.where((F.col("component") != F.col("l.component")) & _size_ok(_n(), F.col("l.n"))).select(*_ordered(F.col("node"), F.col("l.node")))
    across = parts.join(heads, "token").where((F.col("l.component") != F.col("h.component")) & _size_ok(F.col("l.n"), F.col("h.n")))
    return pairs.unionByName(across.select(*_ordered(F.col("l.node"), F.col("h.node")))).distinct()


def _rest_pairs(still: DataFrame, heads: DataFrame, differences) -> DataFrame:
    """Pairs of different components that share a token and may link: all that pass the size and position
    bounds where few members are outside the largest component, else those that ``differences`` of
    (node, leader, component, of_leader) lets through."""
    lead = F.when(F.col("token") != 0, F.col("h")).otherwise(F.col("l"))
    key = F.when(F.col("token") != 0, F.col("token")).otherwise(F.col("bucket"))
    e = stored(still.join(heads, "token", "left").select(key.alias("k"), "node", "component", _n().alias("n"), _pos().alias("pos"),
                                                         lead["node"].alias("leader"), lead["component"].alias("of_leader")), "rest")
    sizes = e.groupBy("k", "component").count()
    major = stored(sizes.groupBy("k").agg(F.max(F.struct("count", "component")).alias("m"), F.sum("count").alias("all")).select(
        "k", F.col("m.component").alias("major"), (F.col("all") - F.col("m.count") > FEW).alias("many")), "majors")
    few = e.join(major.where("not many"), "k").where("component <> major").select("k", *[F.col(c).alias(f"f_{c}") for c in ("node", "component", "n", "pos")])
    # tokens that both sets can still share from this one on
    left = F.least(F.col("n") - F.col("pos"), F.col("f_n") - F.col("f_pos"))
    enough = (100 + PERCENT) * left >= PERCENT * (F.col("n") + F.col("f_n"))
    pairs = few.join(e, "k").where((F.col("component") != F.col("f_component")) & _size_ok(F.col("n"), F.col("f_n")) & enough).select(
        *_ordered(F.col("node"), F.col("f_node")))
    many = major.where("many").select("k")
    if not many.isEmpty():
        led = e.join(many, "k", "left_semi").select("node", "leader", "component", "of_leader").distinct()
        pairs = pairs.unionByName(_difference_pairs(differences(stored(led, "led"))))
    return pairs.distinct()


def _difference_pairs(rows: DataFrame) -> DataFrame:
    """(u, v) of different components, one leader and differences from it that can overlap as much as a
    link asks for, and of sets and their leader where these link."""
    columns = ("node", "component", "n", "d", "pos", "near")
    a = rows.where("short").select("leader", "token", *[F.col(c).alias(f"s_{c}") for c in columns])
    left = F.least(F.col("d") - F.col("pos"), F.col("s_d") - F.col("s_pos"))
    enough = 18 * left >= 9 * (F.col("d") + F.col("s_d")) - F.col("n") - F.col("s_n")
    pairs = a.join(rows, ["leader", "token"]).where(
        (F.col("component") != F.col("s_component")) & (F.struct("s_d", "s_node") < F.struct("d", "node")) & ~(F.col("near") & F.col("s_near"))
        & _size_ok(F.col("n"), F.col("s_n")) & enough).select(*_ordered(F.col("node"), F.col("s_node")))
    return pairs.unionByName(rows.where("near and pos = 0 and component <> of_leader").select(*_ordered(F.col("node"), F.col("leader"))))


def _sketch(prof: DataFrame) -> np.ndarray:
    """Documents of each slot."""
    sketch = np.zeros(SLOTS, dtype=np.int64)
    got = prof.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    sketch[got["key"].to_numpy()] = got["n"].to_numpy()
    return sketch


def _entries(docs: DataFrame, sketch_ref) -> DataFrame:
    """(bucket, token if split or 0, node, set size and place) of the prefix tokens that two sets or more share,
    with the leaders of the first round."""
    raw = tk.map_batches(docs, _prefix_map(sketch_ref, int(sketch_ref.value.mean())), "bucket long, token long, node long, npos long")
    shared = F.expr("min(node) over (partition by bucket) <> max(node) over (partition by bucket)")
    several = raw.withColumn("shared", shared).where("shared or token <> 0").drop("shared").dropDuplicates(["bucket", "node"])
    return stored(_led(several.withColumn("component", F.col("node")), 0), "prefixes")


class _Sets:
    """What is known of the sets of ``docs`` by node: texts to make them from, and their stubs."""

    def __init__(self, docs: DataFrame, prof: DataFrame, nodes: DataFrame) -> None:
        rows = prof.where("kind = 0")
        self.docs = docs
        self.reps = stored(rows.groupBy(F.col("key").alias("node")).agg(F.min("rk").alias("rk")), "reps")
        # rows that repeat give a node twice; else each has one row already
        self.repeated = not rows.groupBy("rk").count().where("count > 1").isEmpty()
        self.stubs = self._of(nodes, _stubs_map, "node long, n int, low binary, high binary", "stubs")

    def _of(self, nodes: DataFrame, fn, schema: str, name: str) -> DataFrame:
        ids = stored(self.reps.join(nodes, "node", "left_semi").select("rk").distinct(), "row-keys")
        made = tk.map_batches(_only(self.docs, ids, "rk"), fn, schema)
        return stored(made.dropDuplicates(["node"]) if self.repeated else made, name)

    def differences(self, led: DataFrame, sketch_ref) -> DataFrame:
        """The prefixes of the differences of (node, leader, component, of_leader), a row a token."""
        nodes = led.select("node").unionByName(led.select(F.col("leader").alias("node"))).distinct()
        sets = self._of(nodes, _sets_map, "node long, tokens binary", "shingles")
        leaders = sets.select(F.col("node").alias("leader"), F.col("tokens").alias("b_tokens"))
        both = led.join(leaders, "leader").join(sets.withColumnRenamed("tokens", "a_tokens"), "node")
        made = both.select("node", "leader", "component", "of_leader", "a_tokens", "b_tokens").mapInArrow(
            _difference_map(sketch_ref), "node long, leader long, component long, of_leader long, token long, n long, d long, pos long, short boolean, near boolean")
        return stored(made, "differences")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that link."""
        stubs = _only(self.stubs, stored(_nodes(pairs), "nodes"), "node")
        likely = stored(_both_sides(pairs, stubs, ["n", "low", "high"]).mapInArrow(_screen_map, "u long, v long"), "likely")
        if likely.isEmpty():
            return likely
        sets = self._of(_nodes(likely), _sets_map, "node long, tokens binary", "shingles")
        return stored(_both_sides(likely, sets, ["tokens"]).mapInArrow(_verify_map, "u long, v long"), "links")


def _merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """The components with more links (u, v): only the components that these join are gone through again."""
    of_u, of_v = (comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in ("u", "v"))
    edges = found.join(of_u, "u", "left").join(of_v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    edges = stored(edges.where("u <> v").distinct(), "joined")
    if edges.isEmpty():
        return comps
    new = components(edges)
    old = comps.join(new.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left")
    more = new.join(comps.select("node"), "node", "left_anti").select("node", "component")
    return stored(old.select("node", F.coalesce("c", "component").alias("component")).unionByName(more), "components")


def links(docs: DataFrame, prof: DataFrame) -> DataFrame:
    """(node, component) of the set keys that link with another set."""
    sketch_ref = docs.sparkSession.sparkContext.broadcast(_sketch(prof))
    led = _entries(docs, sketch_ref)
    sets = _Sets(docs, prof, led.select("node").distinct())
    tested: list[DataFrame] = []
    comps = docs.sparkSession.createDataFrame([], "node long, component long")
    for step in range(STAR_ROUNDS + 1):
        still, parts, heads = _open(led)
        if still.isEmpty():
            break
        pairs = _star_pairs(still, parts, heads) if step < STAR_ROUNDS else _rest_pairs(still, heads, lambda rows: sets.differences(rows, sketch_ref))
        for old in tested:
            pairs = pairs.join(old, ["u", "v"], "left_anti")
        tested.append(stored(pairs, "pairs"))
        found = sets.linked(tested[-1])
        if not found.isEmpty():
            comps = _merged(comps, found) if step else components(found)
        if step < STAR_ROUNDS:  # closed buckets stay closed: components only merge
            e = still.select("bucket", "token", "node", "npos").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
            led = stored(_led(e, step + 1), "open")
    return comps


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share an id but not the text."""
    return F.xxhash64(doc_id.cast("bigint"), text.cast("string"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rk, n_shingles, component, component_id) of every row of ``docs``; rk is the row key,
    component the group's key (null for texts without words), component_id its least doc_id."""
    d = tk.texts(docs, id_col, text_col).withColumn("rk", row_key(F.col("doc_id"), F.col("text")))
    prof = profile(d)
    comps = links(d, prof)
    rows = prof.where("kind = 0").select("doc_id", "rk", F.col("n").alias("n_shingles"), F.col("key").alias("set_key"))
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    grouped = classes.join(comps.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = grouped.join(ids, "component").select("set_key", "component", "component_id")
    full = rows.where("n_shingles > 0").join(of_class, "set_key")
    empty = rows.where("n_shingles = 0").withColumn("component", F.lit(None).cast("bigint")).withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "rk", "n_shingles", "component", "component_id"]
    return full.select(columns).unionByName(empty.select(columns))


def repeats(found: DataFrame) -> DataFrame:
    """Row keys of all rows but the least (doc_id, rk) of each component."""
    rows = found.where("component is not null").select("component", "doc_id", "rk").distinct()
    least = rows.groupBy("component").agg(F.min(F.struct("doc_id", "rk")).alias("l"))
    return rows.join(least, "component").where("rk <> l.rk").select("rk")
