"""Random forest whose work and messages grow with rows x trees, not with open nodes x tasks.

The trees are those of Spark ML's classifier with the same parameters: Poisson(1) weights for each tree and
row, at most ``BINS`` bins a column, a fresh choice of ceil(sqrt(columns)) columns for each node, Gini gain,
at least ``MIN_ROWS`` draws on each side, depth ``DEPTH``, sibling leaves of one class merged, and the mean
of the leaves' shares. Draws and column choices are hashes of (seed, tree, row) and (seed, tree, node), so
that the forest depends neither on how rows are dealt nor on ``GROUP_ROWS``.

Nodes with more than ``GROUP_ROWS`` draws are split one level an aggregate: tasks sum histograms of these
few nodes and Spark adds them up by tree. Then the drawn rows, as bins, are dealt by (tree, node), and one
task grows the whole rest below a node, all nodes of a level at a time. A finished subtree is a row of a
stored table; a prediction sends its rows to the same (tree, node) and takes the mean by row. The driver
holds the few nodes above the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators.design import matrix
from churnlens.operators.features import DEFAULT_SPEC, FeatureSpec, Preprocessor, fit_preprocessor
from churnlens.operators.keyed_boost import bin_edges, bin_rows
from churnlens.session import stored

TREES = 300
DEPTH = 20
MIN_ROWS = 5
BINS = 32
GROUP_ROWS = 200_000
TASK_ROWS = 10_000
SLICE = 4096  # nodes whose histograms are made at a time
_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_NODES = "tree int, grp long, place binary, cut binary, left binary, share binary, single boolean, n double, pos double"
Top = dict[int, tuple[int, int]]  # split nodes above the groups: (column, cut); the root is 1, children 2 k and 2 k + 1


def _mix(z: np.ndarray) -> np.ndarray:
    """splitmix64"""
    z = z.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _key(seed: int, tree: int, use: int) -> np.ndarray:
    return _mix(_mix(_mix(np.array([seed])) ^ np.uint64(tree)) ^ np.uint64(use))


def draws(seed: int, tree: int, row: np.ndarray) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson(1)."""
    u = (_mix(_mix(row) ^ _key(seed, tree, 1)) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_CDF, u, "right").astype(np.uint8)


def columns_tried(seed: int, tree: int, node: np.ndarray, width: int) -> np.ndarray:
    """(nodes, k): the columns that each node may split by."""
    k = math.ceil(math.sqrt(width))
    z = _mix(_mix(_mix(node) ^ _key(seed, tree, 2))[:, None] ^ np.arange(width, dtype=np.uint64))
    return np.sort(np.argpartition(z, k - 1, 1)[:, :k], 1) if k < width else np.tile(np.arange(width), (len(node), 1))


def histogram(bins: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """(2, k, nodes, BINS): draws and positive draws of each tried column's bins. ``bins`` has a line a row."""
    nodes, k = tried.shape
    out = np.empty((2, k, nodes, BINS))
    flat, base, wy = bins.ravel(), np.arange(len(bins)) * bins.shape[1], w * y
    for f in range(k):
        slot = at * BINS + flat[base + tried[at, f]]
        for i, v in enumerate((w, wy)):
            out[i, f] = np.bincount(slot, v, nodes * BINS).reshape(nodes, BINS)
    return out


def best_splits(sums: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each node: column (-1: no split gains), cut, and draws and positive draws left of it."""
    nodes, every = tried.shape[0], np.arange(tried.shape[0])
    n, pos = sums[0, 0].sum(1), sums[1, 0].sum(1)
    best = pos**2 / np.maximum(n, 1) + 1e-9
    place, cut, nl, pl = np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8), np.zeros(nodes), np.zeros(nodes)
    for f in range(tried.shape[1]):
        left, hit = sums[0, f].cumsum(1)[:, :-1], sums[1, f].cumsum(1)[:, :-1]
        right = n[:, None] - left
        score = hit**2 / np.maximum(left, 1) + (pos[:, None] - hit) ** 2 / np.maximum(right, 1)
        score[(left < MIN_ROWS) | (right < MIN_ROWS)] = -1
        k = score.argmax(1)
        new = np.flatnonzero(score[every, k] > best)
        best[new] = score[new, k[new]] + 1e-9
        place[new], cut[new], nl[new], pl[new] = tried[new, f], k[new], left[new, k[new]], hit[new, k[new]]
    return place, cut, nl, pl


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int, tree: int, root: int) -> dict[str, np.ndarray]:
    """The subtree below node ``root``: column (-1: leaf), cut, place of the left child (the right one is
    next to it), share of positive draws."""
    levels, first = [], 0
    at, ids = np.zeros(len(bins), np.int64), np.array([root], np.int64)
    w = w.astype(float)
    for depth in range(root.bit_length() - 1, DEPTH + 1):
        nodes = len(ids)
        n, pos = np.bincount(at, w, nodes), np.bincount(at, w * y, nodes)
        place, cut = np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8)
        live = (n >= 2 * MIN_ROWS) & (pos > 0) & (pos < n) & (depth < DEPTH)
        mine = np.flatnonzero(live[at])
        mine = mine[np.argsort(at[mine], kind="stable")]
        bins, y, w, at = bins[mine], y[mine], w[mine], at[mine]
        for a in range(0, nodes if len(at) else 0, SLICE):
            part = slice(*np.searchsorted(at, (a, a + SLICE)))
            if part.start < part.stop:
                tried = columns_tried(seed, tree, ids[a:a + SLICE], bins.shape[1])
                place[a:a + SLICE], cut[a:a + SLICE], _, _ = best_splits(histogram(bins[part], y[part], w[part], at[part] - a, tried), tried)
        split = place >= 0
        left = np.where(split, first + nodes + 2 * (np.cumsum(split) - 1), 0).astype(np.int32)
        levels.append((place, cut, left, pos / np.maximum(n, 1), n, pos))
        if not split.any():
            break
        on = np.flatnonzero(split[at])
        bins, y, w, at = bins[on], y[on], w[on], at[on]
        at = left[at] - first - nodes + (bins[np.arange(len(bins)), place[at]] > cut[at])
        ids = np.stack((2 * ids[split], 2 * ids[split] + 1), 1).ravel()
        first += nodes
    for upper, lower in zip(levels[-2::-1], levels[:0:-1], strict=True):
        split = np.flatnonzero(upper[0] >= 0)
        leaf, yes = (lower[0] < 0).reshape(-1, 2), (lower[3] > 0.5).reshape(-1, 2)
        upper[0][split[leaf.all(1) & (yes[:, 0] == yes[:, 1])]] = -1
    out = {c: np.concatenate([lv[i] for lv in levels]) for i, c in enumerate(("place", "cut", "left", "share"))}
    return out | {"n": levels[0][4], "pos": levels[0][5]}


def leaf_shares(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    at = np.zeros(len(bins), np.int64)
    on = np.arange(len(bins))
    while len(on := on[tree["place"][at[on]] >= 0]):
        k = at[on]
        at[on] = tree["left"][k] + (bins[on, tree["place"][k]] > tree["cut"][k])
    return tree["share"][at]


def _route(top: Top, bins: np.ndarray) -> np.ndarray:
    at = np.ones(len(bins), np.int64)
    for node in sorted(top):
        place, cut = top[node]
        here = np.flatnonzero(at == node)
        at[here] = 2 * node + (bins[here, place] > cut)
    return at


def _bytes(column: pa.ChunkedArray, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _bin_map(edges: list[list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = bin_rows(matrix(b.column(2)), edges)
            yield pa.RecordBatch.from_pydict({"row": b.column(0), "y": b.column(1), "bins": pa.array([r.tobytes() for r in bins], pa.binary())})
    return run


def _read(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint8), _bytes(b.column(2)).reshape(-1, width)


def _count_map(top: list[Top], growing: dict[int, list[int]], seed: int, width: int):
    """(tree, sums): histograms of a tree's open nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            row, y, bins = _read(b, width)
            for t, nodes in growing.items():
                w, ids = draws(seed, t, row), np.array(nodes)
                mine = np.flatnonzero(w)
                at = _route(top[t], bins[mine])
                k = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                here = ids[k] == at
                mine, k = mine[here], k[here]
                total[t] = total.get(t, 0) + histogram(bins[mine], y[mine], w[mine].astype(float), k, columns_tried(seed, t, ids, width))
        if total:
            yield pa.RecordBatch.from_pydict({"tree": pa.array(list(total), pa.int32()), "sums": pa.array([s.tobytes() for s in total.values()], pa.binary())})
    return run


def _top_splits(growing: dict[int, list[int]], seed: int, width: int):
    def run(parts: pa.Table) -> pa.Table:
        t = parts["tree"][0].as_py()
        ids = np.array(growing[t])
        tried = columns_tried(seed, t, ids, width)
        sums = sum(np.frombuffer(s.as_py()) for s in parts["sums"]).reshape(2, tried.shape[1], len(ids), BINS)
        place, cut, nl, pl = best_splits(sums, tried)
        n, pos = sums[0, 0].sum(1), sums[1, 0].sum(1)
        return pa.table({"tree": pa.array([t] * len(ids), pa.int32()), "node": pa.array(ids, pa.int64()), "place": pa.array(place.astype(np.int32)),
                         "cut": pa.array(cut.astype(np.int32)), "n": n, "pos": pos, "nl": nl, "pl": pl})
    return run


def _send_map(top: list[Top], done: list[set[int]], seed: int, width: int):
    """Drawn rows by (tree, node), packed: one record for the rows of a batch that go to a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, y, bins = _read(b, width)
            for t, nodes in enumerate(top):
                w = draws(seed, t, row)
                mine = np.flatnonzero(w)
                at = _route(nodes, bins[mine])
                groups = [(g, mine[at == g]) for g in np.unique(at).tolist() if g not in done[t]]
                if groups:
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([t] * len(groups), pa.int32()), "grp": pa.array([g for g, _ in groups], pa.int64()),
                        "w": [w[m].tobytes() for _, m in groups], "y": [y[m].tobytes() for _, m in groups], "bins": [bins[m].tobytes() for _, m in groups]})
    return run


def _grow_group(seed: int, width: int):
    def run(part: pa.Table) -> pa.Table:
        t, g = part["tree"][0].as_py(), part["grp"][0].as_py()
        made = grow(_bytes(part["bins"]).reshape(-1, width), _bytes(part["y"]), _bytes(part["w"]), seed, t, g)
        return pa.table({"tree": pa.array([t], pa.int32()), "grp": pa.array([g], pa.int64()), **{c: [made[c].tobytes()] for c in ("place", "cut", "left", "share")},
                         "single": [bool(made["place"][0] < 0)], "n": [float(made["n"][0])], "pos": [float(made["pos"][0])]})
    return run


def _ask_map(top: list[Top], edges: list[list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, bins = b.column(0).to_numpy(), bin_rows(matrix(b.column(1)), edges)
            for t, nodes in enumerate(top):
                at = _route(nodes, bins)
                groups = [(g, np.flatnonzero(at == g)) for g in np.unique(at).tolist()]
                if groups:
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([t] * len(groups), pa.int32()), "grp": pa.array([g for g, _ in groups], pa.int64()),
                        "row": [row[m].tobytes() for _, m in groups], "bins": [bins[m].tobytes() for _, m in groups]})
    return run


def _answer(width: int):
    def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not nodes.num_rows:  # nothing to tell, or a tree that drew no rows
            return pa.table({"_row": pa.array([], pa.int64()), "p": pa.array([], pa.float64())})
        kinds = {"place": np.int16, "cut": np.uint8, "left": np.int32, "share": np.float64}
        tree = {c: np.frombuffer(nodes[c][0].as_py(), k) for c, k in kinds.items()}
        return pa.table({"_row": _bytes(asked["row"], np.int64), "p": leaf_shares(tree, _bytes(asked["bins"]).reshape(-1, width))})
    return run


@dataclass
class ForestModel:
    pre: Preprocessor
    edges: list[list[float]]
    top: list[Top]
    nodes: DataFrame  # a row for each subtree below ``top``
    name: str = "random_forest"

    def predict(self, df: DataFrame, keep: Sequence[str | Column]) -> DataFrame:
        rows = stored(df.select(*keep, _encoded(self.pre).alias("_x"), F.monotonically_increasing_id().alias("_row")), "forest-input")
        names = [c for c in rows.columns if c not in ("_x", "_row")]
        n = rows.count()
        asked = rows.select("_row", "_x").repartition(n // TASK_ROWS + 1).mapInArrow(_ask_map(self.top, self.edges), "tree int, grp long, row binary, bins binary")
        parts = len(self.top) * (n // GROUP_ROWS + 1)
        keys = ("tree", "grp")
        told = self.nodes.repartition(parts, *keys).groupBy(*keys).cogroup(asked.repartition(parts, *keys).groupBy(*keys)) \
            .applyInArrow(_answer(len(self.edges)), "_row long, p double")
        mean = told.groupBy("_row").agg(F.avg("p").alias("p"))
        return rows.join(mean, "_row").select(*names, "p")


def _encoded(pre: Preprocessor) -> Column:
    return F.array(*[F.coalesce(pre.column(n), F.lit(float("nan"))) for n in pre.names])


def fit_forest(train: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, label: str = cs.TARGET, seed: int = cs.SEED,
               trees: int = TREES, group_rows: int = GROUP_ROWS) -> ForestModel:
    spark = train.sparkSession
    pre = fit_preprocessor(train, spec)
    coded = stored(train.select(F.monotonically_increasing_id().alias("row"), F.col(label).cast("int").alias("y"), _encoded(pre).alias("x")), "forest-rows")
    width = len(pre.names)
    edges = bin_edges(coded, width, BINS)
    rows = stored(coded.mapInArrow(_bin_map(edges), "row long, y int, bins binary"), "forest-bins")
    n, labelled = rows.agg(F.count(F.lit(1)), F.count("y")).first()
    if labelled < n:
        raise ValueError(f"{n - labelled} training rows have no label")
    rows = rows.repartition(n // TASK_ROWS + 1)
    top: list[Top] = [{} for _ in range(trees)]
    count: list[dict[int, tuple[float, float]]] = [{} for _ in range(trees)]  # draws and positive draws of the nodes met
    done: list[set[int]] = [set() for _ in range(trees)]  # leaves above the groups
    growing = {t: [1] for t in range(trees)} if n > group_rows else {}
    for _ in range(DEPTH):
        if not growing:
            break
        sums = rows.coalesce(max(n // group_rows, spark.sparkContext.defaultParallelism)).mapInArrow(_count_map(top, growing, seed, width), "tree int, sums binary")
        found = sums.groupBy("tree").applyInArrow(_top_splits(growing, seed, width),
                                                  "tree int, node long, place int, cut int, n double, pos double, nl double, pl double").collect()  # a row an open node
        growing = {}
        for r in found:
            count[r.tree][r.node] = (r.n, r.pos)
            if r.place < 0:
                done[r.tree].add(r.node)
                continue
            top[r.tree][r.node] = (r.place, r.cut)
            for child, k, pos in ((2 * r.node, r.nl, r.pl), (2 * r.node + 1, r.n - r.nl, r.pos - r.pl)):
                if k > group_rows:
                    count[r.tree][child] = (k, pos)
                    growing.setdefault(r.tree, []).append(child)
        growing = {t: sorted(v) for t, v in growing.items()}
    for t, ids in growing.items():  # at full depth
        done[t].update(ids)
    keys = ("tree", "grp")
    sent = rows.mapInArrow(_send_map(top, done, seed, width), "tree int, grp long, w binary, y binary, bins binary")
    nodes = stored(sent.repartition(trees * (n // group_rows + 1), *keys).groupBy(*keys).applyInArrow(_grow_group(seed, width), _NODES), "forest")
    single = [{k: count[t][k] for k in done[t]} for t in range(trees)]
    for r in nodes.where("single").select("tree", "grp", "n", "pos").collect() if any(top) else []:  # a group holds many rows: few
        single[r.tree][r.grp] = (r.n, r.pos)
    extra = []
    for t in range(trees):
        own = set(done[t])
        for k in sorted(top[t], reverse=True):
            a, b = single[t].get(2 * k), single[t].get(2 * k + 1)
            if a and b and (2 * a[1] > a[0]) == (2 * b[1] > b[0]):  # sibling leaves of one class
                del top[t][k]
                single[t][k] = (a[0] + b[0], a[1] + b[1])
                own.add(k)
        extra += [(t, k, np.array([-1], np.int16).tobytes(), b"\0", np.zeros(1, np.int32).tobytes(), np.array([single[t][k][1] / single[t][k][0]]).tobytes(), True, *map(float, single[t][k]))
                  for k in sorted(own)]
    return ForestModel(pre, edges, top, nodes.unionByName(spark.createDataFrame(extra, _NODES)) if extra else nodes)
