"""Histogram gradient boosting for all fits of a training run at once.

Binary log loss, trees of depth ``DEPTH``, learning rate, leaf values ``-rate * G / (H + l2)``, at least
``MIN_LEAF`` training rows and ``MIN_HESSIAN`` on each side of a split, and a split only where it gains.
Values are cut into at most ``BINS`` bins: between all neighbouring values of a column with few of
them, else at equal steps of rank. Bin edges do not look at labels and are the same for all fits.

Rows are kept as blocks: the bins of several columns side by side in the bits of one number (``Layout``), so
that one count of a block serves them all, and sums of single columns are taken from the counts.

Where all rows fit a task (``FIT_BYTES``), each fit is grown whole by the task that gets its rows, and the
driver gets finished trees: the fits run beside each other, without a Spark job a level. On larger tables a
tree level is one Spark aggregate. A task sums gradient, hessian and rows by (fit, node, bin of each
column), so its output is as large as the bins of all nodes, whatever its rows. If the partial histograms of
all tasks are small (``DRIVER_BYTES``), the driver adds them up; else they are dealt by (fit, node), and the task
that has the sum finds the best split: the driver gets one short row a node. The blocks are stored and
persisted, for a level reads all of them. Raw scores are brought up to date every ``KEEP`` rounds, in the next
level's job; between, a task adds the few trees since. Blocks that are lost are made again from the stored ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.design import Design, Fit, matrix, training_rows
from churnlens.session import stored

BINS = 255
DEPTH = 3
ROUNDS = 200
RATE = 0.05
L2 = 1.0
MIN_LEAF = 20
MIN_HESSIAN = 1e-3
KEEP = 10
TASK_ROWS = 20_000
TASK_BYTES = 32 << 20
BLOCK_ROWS = 16_384
FIT_BYTES = 48 << 20
DRIVER_BYTES = 16 << 20
CODE_BITS = 10
_BLOCK = "n int, codes binary, y binary, trains binary, raw binary"


@dataclass
class Tree:
    """A full binary tree in breadth-first order; a node that is not split sends all rows left."""

    place: np.ndarray = field(default_factory=lambda: np.zeros(2**DEPTH - 1, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.full(2**DEPTH - 1, BINS, np.int32))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros(2**DEPTH))

    def node(self, bins: np.ndarray | Lines, depth: int = DEPTH) -> np.ndarray:
        """The node that each row reaches at a depth, counted from the left. ``bins`` has a line a column:
        a node compares one line, which is faster than looking up each row's own column."""
        at = np.zeros(bins.shape[1], np.min_scalar_type((1 << depth) - 1))
        for level in range(depth):
            right = np.zeros(bins.shape[1], bool)
            for node in range(1 << level):
                k = (1 << level) - 1 + node
                if self.cut[k] < BINS:  # else no row goes right
                    over = bins.over(int(self.place[k]), int(self.cut[k])) if isinstance(bins, Lines) else bins[self.place[k]] > int(self.cut[k])
                    right |= over & (at == node) if level else over
            at = 2 * at + right
        return at

    def split(self, level: int, node: int, found: tuple[float, int, int, float, float, float, float]) -> None:
        """Takes over what ``best_split`` found for a node; the last level also sets the leaves."""
        gain, place, cut, g, h, gl, hl = found
        sides = ((gl, hl), (g - gl, h - hl)) if gain > 0 else ((g, h), (0.0, 0.0))
        if gain > 0:
            self.place[(1 << level) - 1 + node], self.cut[(1 << level) - 1 + node] = place, cut
        if level == DEPTH - 1:
            for side, (g, h) in enumerate(sides):
                self.leaf[2 * node + side] = -RATE * g / (h + L2) if h else 0.0


class Layout:
    """Places of columns in the bits of block codes, widest first: ``at[column]`` is (code, shift, mask), and
    ``bits`` has the bits of each code, at most ``CODE_BITS`` (one column may have more)."""

    def __init__(self, sizes: list[int], columns: Iterable[int]):
        self.sizes, self.offset = sizes, np.concatenate(([0], np.cumsum(sizes)))
        self.at: dict[int, tuple[int, int, int]] = {}
        self.bits: list[int] = []
        for k in sorted(set(columns), key=lambda k: (-sizes[k], k)):
            need = (sizes[k] - 1).bit_length()
            code = next((c for c, used in enumerate(self.bits) if used + need <= CODE_BITS), len(self.bits))
            if code == len(self.bits):
                self.bits.append(0)
            self.at[k] = code, self.bits[code], (1 << need) - 1
            self.bits[code] += need

    def codes(self, bins: np.ndarray) -> np.ndarray:
        """(codes, rows) of a table of bins that has a line a row."""
        out = np.zeros((len(self.bits), len(bins)), np.uint16)
        for k, (code, shift, _) in self.at.items():
            out[code] |= bins[:, k].astype(np.uint16) << shift
        return out

    def empty(self, level: int) -> list[np.ndarray]:
        return [np.zeros((3, 1 << level + bits)) for bits in self.bits]

    def add(self, counts: list[np.ndarray], codes: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        """Adds gradient, hessian and rows of each (node, code)."""
        first = {bits: at.astype(np.intp) << bits for bits in set(self.bits)}
        for count, code, bits in zip(counts, codes, self.bits, strict=True):
            slots = first[bits] + code
            for i, v in enumerate((g, h, None)):
                count[i] += np.bincount(slots, v, count.shape[1])

    def sums(self, counts: list[np.ndarray], columns: list[int], level: int) -> np.ndarray:
        """(nodes, 3, slots): the sums of each bin, column after column."""
        out = np.zeros((1 << level, 3, self.offset[-1]))
        for k in columns:
            code, shift, mask = self.at[k]
            cells = counts[code].reshape(3, 1 << level, -1, mask + 1, 1 << shift).sum((2, 4))
            out[:, :, self.offset[k]:self.offset[k + 1]] = cells[:, :, :self.sizes[k]].swapaxes(0, 1)
        return out


class Lines:
    """Columns of bins in block codes, compared where they are."""

    def __init__(self, codes: np.ndarray, layout: Layout):
        self.codes, self.layout, self.shape = codes, layout, (len(layout.sizes), codes.shape[1])

    def over(self, column: int, cut: int) -> np.ndarray:
        """The rows whose bin is above ``cut``."""
        code, shift, mask = self.layout.at[column]
        line = self.codes[code]
        if shift + mask.bit_length() < self.layout.bits[code]:
            line = line & (mask << shift)
            return line > (cut << shift)
        return line >= (cut + 1) << shift


@dataclass
class Block:
    """Rows that tasks work through together: ``trains`` and ``raw`` have a line a fit."""

    codes: np.ndarray
    y: np.ndarray
    trains: np.ndarray
    raw: np.ndarray

    def batch(self) -> pa.RecordBatch:
        cells = (self.codes, self.y, np.packbits(self.trains, axis=1), self.raw)
        return pa.RecordBatch.from_arrays([pa.array([len(self.y)], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=[c.split()[0] for c in _BLOCK.split(", ")])


@dataclass
class BoostedModel:
    name: str
    columns: list[int]
    edges: list[list[float]]  # of every column of x
    start: float
    trees: list[Tree]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + _grown(self.trees, np.ascontiguousarray(bin_rows(x, self.edges).T))


def _grown(trees: list[Tree], bins: np.ndarray | Lines) -> np.ndarray:
    """Summed leaves of each row; ``bins`` has a line a column."""
    out = np.zeros(bins.shape[1])
    for t in trees:
        out += t.leaf[t.node(bins)]
    return out


def bin_edges(table: DataFrame, width: int, bins: int = BINS) -> list[list[float]]:
    """Ascending edges of each column of ``x``; a value is in the bin of the edges below it."""
    values = table.select(F.posexplode("x").alias("place", "v")).groupBy("place", "v").agg(F.count("*").alias("n"))
    few = values.groupBy("place").agg(F.count("*").alias("k"))
    small = values.join(few.where(F.col("k") <= bins), "place").select("place", "v")
    ranks = [k / bins for k in range(1, bins)]
    large = [r["place"] for r in few.where(F.col("k") > bins).select("place").collect()]
    out: list[list[float]] = [[] for _ in range(width)]
    for place, v in small.orderBy("place", "v").collect():  # at most ``bins`` rows a column
        out[place].append(v)
    for place, vs in enumerate(out):
        out[place] = [(a + b) / 2 for a, b in zip(vs, vs[1:], strict=False)]
    if large:
        got = table.agg(*[F.percentile_approx(F.col("x")[k], ranks, 10_000).alias(str(k)) for k in large]).first()
        for k in large:
            out[k] = sorted(set(got[str(k)]))
    return out


def bin_rows(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1).astype(np.uint8)


def _binned(batches: Iterator[pa.RecordBatch], edges: list[list[float]], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bins = bin_rows(matrix(b.column(0)), edges)
        yield pa.RecordBatch.from_pydict({"y": b.column(1), "is_test": b.column(2), "folds": b.column(3),
                                          "bins": pa.FixedSizeBinaryArray.from_buffers(pa.binary(bins.shape[1]), len(bins), [None, pa.py_buffer(bins.tobytes())]),
                                          "raw": pa.FixedSizeListArray.from_arrays(np.tile(starts, len(bins)), len(starts))})


def _block(row: tuple) -> Block:
    """A row of the stored blocks."""
    n = row[0]
    codes, y, trains, raw = (np.frombuffer(c, kind).reshape(-1, width) for c, kind, width in zip(row[1:], (np.uint16, np.uint8, np.uint8, float), (n, n, -(-n // 8), n), strict=True))
    return Block(codes, y[0], np.unpackbits(trains, axis=1, count=n).view(bool), raw)


def _blocks(batches: Iterable[pa.RecordBatch | Block], fits: list[Fit], layout: Layout) -> Iterator[Block]:
    """Blocks as they are; of a batch of binned rows, those that train any fit."""
    for b in batches:
        if isinstance(b, Block):
            yield b
            continue
        col = {name: b.column(name) for name in ("y", "is_test", "folds", "bins", "raw")}
        width = len(layout.sizes)
        cells = col["bins"].cast(pa.binary(width))  # all of one length: the buffer is the table of bins
        bins = np.frombuffer(cells.buffers()[1], np.uint8)[cells.offset * width:(cells.offset + b.num_rows) * width].reshape(b.num_rows, width)
        trains = training_rows(fits, col["is_test"].to_numpy(zero_copy_only=False), matrix(col["folds"], np.int64))
        mine = np.flatnonzero(trains.any(1))
        if len(mine):
            yield Block(layout.codes(bins[mine]), col["y"].to_numpy()[mine].astype(np.uint8), np.ascontiguousarray(trains[mine].T), np.ascontiguousarray(matrix(col["raw"])[mine].T))


def _store_map(edges: list[list[float]], starts: np.ndarray, fits: list[Fit], layout: Layout, most: int):
    """Design rows as blocks of at most ``most`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Block] = []

        def joined() -> Block:
            return Block(*(np.concatenate([getattr(b, name) for b in held], -1) for name in ("codes", "y", "trains", "raw")))

        for block in _blocks(_binned(batches, edges, starts), fits, layout):
            held.append(block)
            if sum(len(b.y) for b in held) >= most:
                whole = joined()
                n = len(whole.y) // most * most
                for k in range(0, n, most):
                    yield Block(*(getattr(whole, name)[..., k:k + most] for name in ("codes", "y", "trains", "raw"))).batch()
                held = [Block(*(getattr(whole, name)[..., n:] for name in ("codes", "y", "trains", "raw")))] if n < len(whole.y) else []
        if held:
            yield joined().batch()
    return run


def _advance_map(layout: Layout, new: list[list[Tree]]):
    def run(block: Block) -> Block:
        lines = Lines(block.codes, layout)
        return Block(block.codes, block.y, block.trains, block.raw + np.stack([_grown(t, lines) for t in new]))
    return run


def _slopes(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of each row's loss."""
    p = 1 / (1 + np.exp(-raw))
    return p - y, p * (1 - p)


def _histogram_map(fits: list[Fit], columns: list[list[int]], new: list[list[Tree]], growing: list[Tree], level: int, sizes: list[int]):
    """(fit, node, sums): gradient, hessian and rows of each bin, column after column."""
    layout = Layout(sizes, {k for c in columns for k in c})

    def run(batches: Iterator[pa.RecordBatch | Block]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, list[np.ndarray]] = {}
        for block in _blocks(batches, fits, layout):
            for j in range(len(fits)):
                codes, y, raw = block.codes, block.y, block.raw[j]
                if not block.trains[j].all():
                    mine = np.flatnonzero(block.trains[j])
                    if not len(mine):
                        continue
                    codes, y, raw = codes[:, mine], y[mine], raw[mine]
                lines = Lines(codes, layout)
                g, h = _slopes(raw + _grown(new[j], lines), y)
                layout.add(counts.setdefault(j, layout.empty(level)), codes, growing[j].node(lines, level), g, h)
        total = [(j, node, s) for j, c in counts.items() for node, s in enumerate(layout.sums(c, columns[j], level)) if s[2].any()]
        if total:
            yield pa.RecordBatch.from_pydict({"fit": pa.array([t[0] for t in total], pa.int32()), "node": pa.array([t[1] for t in total], pa.int32()), "sums": pa.array([t[2].tobytes() for t in total], pa.binary())})
    return run


def best_split(sums: np.ndarray, columns: list[int], offset: np.ndarray) -> tuple[float, int, int, float, float, float, float]:
    """(gain, column, cut, G, H, G left, H left); no split has gain 0. Gains that are equal but for
    rounding go to the first column and cut."""
    first = slice(offset[columns[0]], offset[columns[0] + 1])
    g, h, n = (float(v) for v in sums[:, first].sum(1))
    column = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    run = np.cumsum(sums, 1)
    before = np.concatenate((np.zeros((3, 1)), run), 1)[:, offset[:-1]]
    gl, hl, nl = run - before[:, column]
    gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
    allowed = np.isin(column, columns) & (nl >= MIN_LEAF) & (n - nl >= MIN_LEAF) & (hl >= MIN_HESSIAN) & (h - hl >= MIN_HESSIAN)
    gain = np.where(allowed, gain, 0.0)
    top = gain.max()
    if top <= 1e-9:
        return 0.0, 0, BINS, g, h, 0.0, 0.0
    k = int(np.argmax(gain >= top - 1e-9 * max(top, 1)))
    return float(gain[k]), int(column[k]), int(k - offset[column[k]]), g, h, float(gl[k]), float(hl[k])


def _node_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    for b in batches:
        for fit, node, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield (fit, node), np.frombuffer(raw, float).reshape(3, -1)


def grow(codes: np.ndarray, y: np.ndarray, start: float, columns: list[int], layout: Layout, rounds: int) -> list[Tree]:
    """The trees of one fit whose rows are all here, worked through a block at a time."""
    raw, trees = np.full(len(y), start), []
    parts = [slice(k, k + BLOCK_ROWS) for k in range(0, len(y), BLOCK_ROWS)]
    lines = [Lines(np.ascontiguousarray(codes[:, p]), layout) for p in parts]
    for _ in range(rounds):
        tree = Tree()
        slopes = [_slopes(raw[p], y[p]) for p in parts]
        for level in range(DEPTH):
            counts = layout.empty(level)
            for line, (g, h) in zip(lines, slopes, strict=True):
                layout.add(counts, line.codes, tree.node(line, level), g, h)
            for node, sums in enumerate(layout.sums(counts, columns, level)):
                if sums[2].any():
                    tree.split(level, node, best_split(sums, columns, layout.offset))
        for p, line in zip(parts, lines, strict=True):
            raw[p] += tree.leaf[tree.node(line)]
        trees.append(tree)
    return trees


def _deal_map(edges: list[list[float]], starts: np.ndarray, fits: list[Fit], layout: Layout):
    """The training rows of each fit; (part, k) is their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, block in enumerate(_blocks(_binned(batches, edges, starts), fits, layout)):
            mine = [(j, np.flatnonzero(t)) for j, t in enumerate(block.trains) if t.any()]
            yield pa.RecordBatch.from_pydict({
                "fit": pa.array([j for j, _ in mine], pa.int32()), "part": pa.array([part] * len(mine), pa.int32()), "k": pa.array([k] * len(mine), pa.int32()),
                "codes": pa.array([block.codes[:, m].tobytes() for _, m in mine], pa.binary()), "y": pa.array([block.y[m].tobytes() for _, m in mine], pa.binary())})
    return run


def _grow_map(starts: np.ndarray, columns: list[list[int]], layout: Layout, rounds: int):
    """(fit, trees): places, cuts and leaves of a fit's trees, one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for fit, part, k, codes, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(fit, {})[part, k] = np.frombuffer(codes, np.uint16).reshape(len(layout.bits), -1), np.frombuffer(y, np.uint8)
        for fit in sorted(held):
            rows = held.pop(fit)
            codes, y = (np.concatenate([rows[at][i] for at in sorted(rows)], -1) for i in (0, 1))
            del rows
            trees = grow(codes, y, starts[fit], columns[fit], layout, rounds)
            yield pa.RecordBatch.from_pydict({"fit": pa.array([fit], pa.int32()), **{
                name: pa.array([np.concatenate([getattr(t, name) for t in trees]).tobytes()], pa.binary()) for name in ("place", "cut", "leaf")}})
    return run


def fit_boosted(design: Design, fits: list[Fit], rounds: int = ROUNDS, edges: list[list[float]] | None = None) -> list[BoostedModel]:
    """One model a fit, in the order of ``fits``."""
    edges = edges or bin_edges(design.table, design.width)
    columns = [sorted(design.columns(f.spec)) for f in fits]
    layout = Layout([len(e) + 1 for e in edges], {k for c in columns for k in c})
    starts = log_odds(design, fits)
    table = design.table.select("x", "y", "is_test", "folds")
    rows = table.count()
    # a task that grows a fit has its codes and labels twice while it joins them, then raw scores and slopes
    whole = rows * (4 * len(layout.bits) + 32) <= FIT_BYTES and rounds > 0
    trees = (_grow_whole if whole else _grow_levels)(table, rows, fits, columns, layout, edges, starts, rounds)
    return [BoostedModel(f.model, c, edges, float(s), t) for f, c, s, t in zip(fits, columns, starts, trees, strict=True)]


def _grow_whole(table: DataFrame, rows: int, fits: list[Fit], columns: list[list[int]], layout: Layout, edges: list[list[float]], starts: np.ndarray, rounds: int) -> list[list[Tree]]:
    """The trees of each fit, grown by one task a fit."""
    dealt = table.mapInArrow(_deal_map(edges, starts, fits, layout), "fit int, part int, k int, codes binary, y binary").repartitionById(len(fits), "fit")
    found = dealt.mapInArrow(_grow_map(starts, columns, layout, rounds), "fit int, place binary, cut binary, leaf binary").collect()
    out: list[list[Tree]] = [[] for _ in fits]
    for r in found:
        parts = (np.frombuffer(c, kind).reshape(rounds, -1) for c, kind in ((r.place, np.int32), (r.cut, np.int32), (r.leaf, float)))
        out[r.fit] = [Tree(*t) for t in zip(*parts, strict=True)]
    return out


def _grow_levels(table: DataFrame, rows: int, fits: list[Fit], columns: list[list[int]], layout: Layout, edges: list[list[float]], starts: np.ndarray, rounds: int) -> list[list[Tree]]:
    """The trees of all fits, grown a level at a time by all tasks."""
    spark, sizes = table.sparkSession, layout.sizes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows * (2 * len(layout.bits) + 2 + 8 * len(fits))
    tasks = max(size // TASK_BYTES + 1, min(rows * len(fits) // TASK_ROWS + 1, spark.sparkContext.defaultParallelism))  # each fit works through the rows
    made = table.mapInArrow(_store_map(edges, starts, fits, layout, min(BLOCK_ROWS, rows // (8 * tasks) + 1)), _BLOCK)
    blocks: RDD[Block] = stored(made.repartition(tasks), "binned").rdd.map(_block).persist(StorageLevel.MEMORY_AND_DISK)
    old = None
    new: list[list[Tree]] = [[] for _ in fits]
    trees: list[list[Tree]] = [[] for _ in fits]

    def best(item: tuple[tuple[int, int], np.ndarray]) -> tuple:
        return *item[0], best_split(item[1], columns[item[0][0]], layout.offset)

    for turn in range(rounds):
        growing = [Tree() for _ in fits]
        for level in range(DEPTH):
            sums = blocks.mapPartitions(_histogram_map(fits, columns, new, growing, level, sizes))
            if tasks * len(fits) * int(layout.offset[-1]) * 24 << level <= DRIVER_BYTES:
                total: dict[tuple[int, int], np.ndarray] = {}
                for at, part in _node_sums(sums.collect()):
                    total[at] = total[at] + part if at in total else part
                found = [best(item) for item in total.items()]
            else:
                found = sums.mapPartitions(_node_sums).reduceByKey(np.add, parts).map(best).collect()  # a short row a node
            for fit, node, split in found:
                growing[fit].split(level, node, split)
            if old:  # the blocks of now are there
                old.unpersist()
                old = None
        for j, tree in enumerate(growing):
            new[j].append(tree)
            trees[j].append(tree)
        if len(new[0]) == KEEP and turn + 1 < rounds:
            old, blocks = blocks, blocks.map(_advance_map(layout, new)).persist(StorageLevel.MEMORY_AND_DISK)
            new = [[] for _ in fits]
    blocks.unpersist()
    return trees


def log_odds(design: Design, fits: list[Fit]) -> np.ndarray:
    """Log-odds of the positive share of each fit's training rows."""
    def member(f: Fit):
        dev = ~F.col("is_test")
        return F.lit(True) if f.everything else dev if f.fold < 0 else dev & (F.col("folds")[f.repeat] != f.fold)
    row = design.table.agg(*[F.avg(F.when(member(f), F.col("y").cast("double"))).alias(str(j)) for j, f in enumerate(fits)]).first()
    share = np.array(list(row), float)
    if not np.all((share > 0) & (share < 1)):
        raise ValueError("every fit needs training rows of both classes")
    return np.log(share / (1 - share))


def _predict_map(fits: list[Fit], models: list[BoostedModel]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            test, folds = b.column(3).to_numpy(zero_copy_only=False), matrix(b.column(4), np.int64)
            x = matrix(b.column(1))
            for f, m in zip(fits, models, strict=True):
                mine = np.flatnonzero(test if f.fold < 0 else ~test & (folds[:, f.repeat] == f.fold))
                if len(mine) and not f.everything:
                    at = pa.array(mine)
                    n = len(mine)
                    yield pa.RecordBatch.from_pydict({"model": [f.model] * n, "repeat": pa.array([f.repeat] * n, pa.int32()), "fold": pa.array([f.fold] * n, pa.int32()),
                                                      "customer_id": b.column(0).take(at), "y": b.column(2).take(at), "p": 1 / (1 + np.exp(-m.raw(x[mine])))})
    return run


def predictions(design: Design, fits: list[Fit], models: list[BoostedModel]) -> DataFrame:
    """(model, repeat, fold, customer_id, y, p) as ``keyed_logit.predictions`` has them."""
    return design.table.select("customer_id", "x", "y", "is_test", "folds").mapInArrow(_predict_map(fits, models), "model string, repeat int, fold int, customer_id string, y int, p double")
