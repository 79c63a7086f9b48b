"""Gradient-boosted decision trees for two classes: histogram splits, logistic loss, numpy only.

A level of a tree needs only sums of gradients by (feature, node, bin): tasks add them up over their blocks of rows
and rows never leave the tasks (`fit_slices`). Gradients are whole multiples of 1 / SCALE, so sums and model are the same however the
rows are spread. All trees grow in one barrier stage: its tasks exchange sums after each level and grow the same trees.
A model is a few KB of arrays that travels with the task closure and scores whole batches.
"""

from __future__ import annotations

import os
import pickle
import secrets
import tempfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from multiprocessing import AuthenticationError
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblore.session import cut

SCALE, NONE = 1 << 24, 255  # gradients are multiples of 1 / SCALE; NONE: no split
SLICE_ROWS, BLOCK_ROWS = 1 << 15, 1 << 15
CELLS = 1 << 11  # bins that are counted at once: several features with few bins share one pass over the rows
CARRY = 10  # trees after which the scores are stored with the rows, where each level is a job of its own
TASK_ROWS = 1 << 23  # rows of a task at most there, if the slices have as many partitions; each task sends 70 KB of sums a level
DRIVER_ROWS = 400_000  # rows of bins (14 MB) that the driver may hold; more are summed in tasks, with the same result
SLICES, BLOCKS = "n int, codes binary, vals array<array<double>>", "y binary, bins binary, score binary"
Sums = Callable[[list, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class BoostedTrees:
    """Complete trees of one depth: feature and threshold per inner node, value per leaf."""

    base: float
    features: np.ndarray  # (trees, inner nodes)
    thresholds: np.ndarray
    leaves: np.ndarray  # (trees, leaves)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class for each row."""
        finite = np.isfinite(self.thresholds)
        cuts = [np.unique(self.thresholds[finite & (self.features == j)]) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, j], "left") if len(c) else np.zeros(len(x), np.int64) for j, c in enumerate(cuts)]).astype(np.uint8)
        splits = [[np.searchsorted(cuts[j], t) if np.isfinite(t) else NONE for j, t in zip(f, ts)] for f, ts in zip(self.features, self.thresholds)]
        return _scored(bins, np.full(len(x), self.base), [(f, np.array(k, np.uint8), v) for f, k, v in zip(self.features, splits, self.leaves)])


def _nodes(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row among the nodes of a level. bins: (features, rows)."""
    at = np.zeros(bins.shape[1], np.uint8)
    for level in range(levels):
        right = np.zeros(len(at), bool)
        for k in range(2**level):
            i = 2**level - 1 + k
            if split[i] != NONE:
                right |= (at == k) & (bins[feature[i]] > split[i])
        at = 2 * at + right
    return at


def _scored(bins: np.ndarray, score: np.ndarray, trees: list) -> np.ndarray:
    for feature, split, values in trees:
        score = score + values[_nodes(bins, feature, split, len(values).bit_length() - 1)]
    return score


def _gradients(y: np.ndarray, score: np.ndarray, w: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians in 1 / SCALE; without weights whole numbers up to 2^24, exact as float32."""
    p = 1 / (1 + np.exp(-score))
    return np.rint((p - y) * SCALE) * w, np.rint(p * (1 - p) * SCALE) * w


def _groups(sizes: np.ndarray) -> list[tuple[list[int], int]]:
    """Features that are counted together, and the number of their joint bins."""
    groups: list[tuple[list[int], int]] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        i = next((i for i, (_, cells) in enumerate(groups) if cells * sizes[k] <= CELLS), len(groups))
        own, cells = groups[i] if i < len(groups) else ([], 1)
        groups[i : i + 1] = [([*own, k], cells * int(sizes[k]))]
    return groups


def _sums(rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], feature: np.ndarray, split: np.ndarray, level: int, used: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Gradients and hessians by (used feature, node of the level, bin). rows: blocks of bins, gradients, hessians; sizes: bins of the used features.

    Whole numbers are summed exactly up to 2^29 rows.
    """
    groups, nodes = _groups(sizes), 2**level
    tables = [np.zeros((2, nodes * cells)) for _, cells in groups]
    for bins, grad, hess in rows:
        at = _nodes(bins, feature, split, level).astype(np.intp)
        for (own, cells), table in zip(groups, tables):
            code = np.zeros(len(at), np.uint16)
            for k in own:
                code *= np.uint16(sizes[k])
                code += bins[used[k]]
            cell = at * cells + code
            table[0] += np.bincount(cell, grad, nodes * cells)
            table[1] += np.bincount(cell, hess, nodes * cells)
    out = np.zeros((2, len(used), nodes, sizes.max()))
    for (own, _), table in zip(groups, tables):
        table = table.reshape(2, nodes, *sizes[own])
        for i, k in enumerate(own):
            out[:, k, :, : sizes[k]] = table.sum(tuple(2 + j for j in range(len(own)) if j != i))
    return out


class _Held:
    """Blocks of rows (bins, y, weights, and to be filled: score, gradients, hessians) whose scores follow the trees."""

    def __init__(self, blocks: list[tuple], base: float) -> None:
        self.blocks, self.done = blocks, 0
        for block in blocks:
            block[3][:] = base
        self._follow([])

    def _follow(self, trees: list) -> None:
        for bins, y, w, score, grad, hess in self.blocks:
            score[:] = _scored(bins, score, trees[self.done :])
            grad[:], hess[:] = _gradients(y, score, w)
        self.done = len(trees)

    def sums(self, trees: list, *at) -> np.ndarray:
        if len(trees) > self.done:
            self._follow(trees)
        return _sums(((bins, grad, hess) for bins, _, _, _, grad, hess in self.blocks), *at)


def _base(share: float) -> float:
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    return float(np.log(share / (1 - share)))


def _grow(sums: Sums, cuts: list[np.ndarray], base: float, rounds: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 3.0, least: float = 1.0, columns: float = 0.5, seed: int = 7) -> BoostedTrees:
    """Trees from the sums of gradients of all rows.

    Each tree draws a share of the columns (seeded), each child holds at least `least` of hessian.
    """
    sizes = np.array([len(c) + 1 for c in cuts])
    width, inner, trees, draw = len(cuts), 2**depth - 1, [], np.random.default_rng(seed)
    for _ in range(rounds):
        feature, split = np.zeros(inner, np.int64), np.full(inner, NONE, np.uint8)
        used = np.sort(draw.permutation(width)[: max(1, round(columns * width))])  # of the columns, for this tree
        for level in range(depth):
            node = np.arange(2**level)
            g, h = sums(trees, feature, split, level, used, sizes[used]).cumsum(-1) / SCALE
            total_g, total_h = g[..., -1:], h[..., -1:]
            gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
            gain[(h < least) | (total_h - h < least)] = 0
            k = gain.argmax(-1)
            value = np.take_along_axis(gain, k[..., None], -1)[..., 0]
            best = value.argmax(0)
            found, k = value[best, node] > 1e-6, k[best, node]
            feature[2**level - 1 + node], split[2**level - 1 + node] = np.where(found, used[best], 0), np.where(found, k, NONE)
        both = [(np.where(found, s[best, node, k], s[0, :, -1]), s[0, :, -1]) for s in (g, h)]  # without a split all rows go left
        leaf_g, leaf_h = (np.stack([left, total - left], 1).ravel() for left, total in both)
        trees.append((feature, split, -rate * leaf_g / (leaf_h + ridge)))
    if not trees:
        return BoostedTrees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**depth)))
    thresholds = [[cuts[f][s] if s != NONE else np.inf for f, s in zip(feature, split)] for feature, split, _ in trees]
    return BoostedTrees(base, np.stack([t[0] for t in trees]), np.array(thresholds), np.stack([t[2] for t in trees]))


def _in_memory(bins: np.ndarray, y: np.ndarray, w: np.ndarray | float, base: float) -> Sums:
    score, grad, hess = np.empty((3, len(y)))
    parts = [slice(a, a + BLOCK_ROWS) for a in range(0, len(y), BLOCK_ROWS)]
    return _Held([(bins[:, p], y[p], w[p] if isinstance(w, np.ndarray) else w, score[p], grad[p], hess[p]) for p in parts], base).sums


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, bins: int = 32, weights: np.ndarray | None = None, **settings) -> BoostedTrees:
    """Fit on rows x (float) with labels y in {0, 1}. Without rows of both classes the model is constant."""
    n, width = x.shape
    w = np.ones(n) if weights is None else weights
    base = _base((w @ y) / max(w.sum(), 1e-9) if n else 0.5)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(width)]).astype(np.uint8) if n else np.zeros((width, 0), np.uint8)
    return _grow(_in_memory(binned, y, w, base), cuts, base, rounds if n and 0 < y.mean() < 1 else 0, **settings)


def packed(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, bytes, list[np.ndarray]]]:
    """Rows as records of SLICES: the sorted values of each column (the label is the last one) and their codes, column after column."""
    for at in range(0, len(x), SLICE_ROWS):
        columns = [np.unique(v, return_inverse=True) for v in (*x[at : at + SLICE_ROWS].T, y[at : at + SLICE_ROWS].astype(float))]
        codes = np.stack([c for _, c in columns]).astype(np.uint16)
        yield codes.shape[1], pa.compress(codes.tobytes(), "zstd", asbytes=True), [v for v, _ in columns]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        for n, codes, vals in zip(*batch.columns):
            vals = [v.values.to_numpy() for v in vals]
            size = n.as_py() * len(vals) * 2
            yield np.frombuffer(pa.decompress(codes.as_py(), size, "zstd", asbytes=True), np.uint16).reshape(len(vals), -1), vals


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for j, parts in held.items():
            vals, code = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            n = np.bincount(code, np.concatenate([n for _, n in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vals), j, np.int32)), pa.array(vals), pa.array(n)], names=["feature", "value", "n"])

    for codes, vals in _slices(batches):
        for j, v in enumerate(vals):
            held.setdefault(j, []).append((v, np.bincount(codes[j], minlength=len(v))))
            size += len(v)
        if size > 1_000_000:
            yield from given()
            held, size = {}, 0
    yield from given()


def _quantile_cuts(values: DataFrame, n: int, width: int, bins: int) -> list[np.ndarray]:
    """Exact quantiles (as np.quantile) of each feature over all n rows. values: feature, value, n, part (ranges of feature and value)."""
    place = np.linspace(0, 1, bins + 1)[1:-1] * (n - 1)
    low = np.floor(place).astype(np.int64)
    high, share = np.minimum(low + 1, n - 1), place - low
    asked, start = [], dict.fromkeys(range(width), 0)
    for feature, part, rows in sorted(values.filter(F.col("feature") < width).groupBy("feature", "part").agg(F.sum("n")).collect()):
        first, start[feature] = start[feature], start[feature] + rows
        asked += [(feature, part, int(r), int(r - first)) for r in np.union1d(low, high) if first <= r < first + rows]
    upto = F.sum("n").over(Window.partitionBy("feature", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranks = values.sparkSession.createDataFrame(asked, "feature int, part int, rank long, offset long")
    met = values.withColumn("upto", upto).join(F.broadcast(ranks), ["feature", "part"]).filter("offset < upto and offset >= upto - n")
    at = {(r.feature, r.rank): r.value for r in met.select("feature", "rank", "value").collect()}
    cuts = []
    for j in range(width):
        a, b = (np.array([at[j, r] for r in ranks.tolist()]) for ranks in (low, high))
        cuts.append(np.unique(np.where(share < 0.5, a + (b - a) * share, b - (b - a) * (1 - share))))
    return cuts


def _blocked(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def block() -> pa.RecordBatch:
        bins = np.concatenate(held, 1)
        return _block(bins[-1].tobytes(), pa.compress(bins[:-1].tobytes(), "lz4", asbytes=True), b"")

    for codes, vals in _slices(batches):
        place = [np.searchsorted(c, v, "left") for c, v in zip(cuts, vals)] + [vals[-1]]
        held.append(np.stack([p.astype(np.uint8)[c] for p, c in zip(place, codes)]))
        rows += codes.shape[1]
        if rows >= BLOCK_ROWS:
            yield block()
            held, rows = [], 0
    if rows:
        yield block()


def _block(*columns: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["y", "bins", "score"])


def _unpacked(blocks: Iterator[pa.RecordBatch], width: int, base: float, trees: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, y, score after the trees) of each block."""
    for batch in blocks:
        for y, bins, score in zip(*(c.to_pylist() for c in batch.columns)):
            bins = np.frombuffer(pa.decompress(bins, len(y) * width, "lz4", asbytes=True), np.uint8).reshape(width, -1)
            yield bins, np.frombuffer(y, np.uint8), _scored(bins, np.frombuffer(score) if score else np.full(len(y), base), trees)


def _carried(blocks: Iterator[pa.RecordBatch], width: int, base: float, trees: list) -> Iterator[pa.RecordBatch]:
    for bins, y, score in _unpacked(blocks, width, base, trees):
        yield _block(y.tobytes(), pa.compress(bins.tobytes(), "lz4", asbytes=True), score.tobytes())


def _tallied(blocks: Iterator[pa.RecordBatch], width: int, base: float, trees: list, at: tuple) -> Iterator[pa.RecordBatch]:
    total = None
    for bins, y, score in _unpacked(blocks, width, base, trees):
        part = _sums(iter([(bins, *_gradients(y, score))]), *at).astype(np.int64)
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _in_tasks(blocks: DataFrame, width: int, base: float) -> Sums:
    """Sums of all tasks, a job for each level."""
    carried = 0

    def sums(trees: list, *at) -> np.ndarray:
        nonlocal blocks, carried
        if len(trees) - carried >= CARRY:
            more = trees[carried:]
            blocks, carried = cut(blocks.mapInArrow(lambda it: _carried(it, width, base, more), BLOCKS)), len(trees)
        more = trees[carried:]
        parts = blocks.mapInArrow(lambda it: _tallied(it, width, base, more, at), "sums binary").toArrow().column(0).to_pylist()
        return np.sum([np.frombuffer(p, np.int64) for p in parts], 0).reshape(2, len(at[3]), 2 ** at[2], -1)

    return sums


def _in_files(blocks: Iterator[pa.RecordBatch], width: int, folder: str) -> list[tuple]:
    """Blocks for `_Held` in files of the folder (51 bytes a row), so that a task's memory doesn't grow with its rows."""
    names = [os.path.join(folder, name) for name in ("bins", "y", "score", "grad", "hess")]
    ends = [0]
    with open(names[0], "wb") as bins_file, open(names[1], "wb") as y_file:
        for bins, y, _ in _unpacked(blocks, width, 0.0, []):
            bins_file.write(bins.tobytes())
            y_file.write(y.tobytes())
            ends.append(ends[-1] + len(y))
    n = ends[-1]
    if not n:
        return []
    bins, y = (np.memmap(name, np.uint8, "r") for name in names[:2])
    score, grad, hess = (np.memmap(name, kind, "w+", shape=n) for name, kind in zip(names[2:], (np.float64, np.float32, np.float32)))
    return [(bins[a * width : b * width].reshape(width, -1), y[a:b], 1.0, score[a:b], grad[a:b], hess[a:b]) for a, b in zip(ends, ends[1:])]


def _peers(context: BarrierTaskContext, key: bytes, stack: ExitStack) -> list[Connection]:
    """Connections of the first task with all others, of another with the first. A lost task ends them and so the stage, which Spark runs again."""
    host = context.getTaskInfos()[0].address.rpartition(":")[0]
    others = len(context.getTaskInfos()) - 1
    if context.partitionId():
        port = int(context.allGather("")[0])  # takes Spark a second: done once
        return [stack.enter_context(Client((host, port), authkey=key))]
    listener = stack.enter_context(Listener((host, 0), backlog=others + 1, authkey=key))
    context.allGather(str(listener.address[1]))
    peers: list[Connection] = []
    while len(peers) < others:
        try:
            peers.append(stack.enter_context(listener.accept()))
        except (AuthenticationError, EOFError, ConnectionError):  # not one of the tasks: those have the key
            pass
    return peers


def _shared(own: np.ndarray, peers: list[Connection], first: bool) -> np.ndarray:
    """The sum of all tasks' arrays: the first one adds them up and sends the total back."""
    pack = lambda a: pa.compress(a.tobytes(), "zstd", asbytes=True)
    unpack = lambda x: np.frombuffer(pa.decompress(x, own.nbytes, "zstd", asbytes=True), own.dtype).reshape(own.shape)
    if not first:
        peers[0].send_bytes(pack(own))
        return unpack(peers[0].recv_bytes())
    total = sum((unpack(peer.recv_bytes()) for peer in peers), own)
    message = pack(total)
    for peer in peers:
        peer.send_bytes(message)
    return total


def _grown(blocks: Iterator[pa.RecordBatch], width: int, base: float, key: bytes, grow: Callable[[Sums], BoostedTrees]) -> Iterator[pa.RecordBatch]:
    """The model, from the first of the tasks that grow it together."""
    context = BarrierTaskContext.get()
    first = context.partitionId() == 0
    with ExitStack() as stack:
        folder = stack.enter_context(tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None))
        held, peers = _Held(_in_files(blocks, width, folder), base), _peers(context, key, stack)
        model = grow(lambda trees, *at: _shared(held.sums(trees, *at).astype(np.int64), peers, first))
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def _slots(spark: SparkSession) -> int:
    """Tasks that can run at once, 0 where tasks can't wait for each other (a cluster whose executors come and go)."""
    context = spark.sparkContext._jsc.sc()
    if context.getConf().getBoolean("spark.dynamicAllocation.enabled", False):
        return 0
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def fit_slices(slices: DataFrame, rounds: int = 60, bins: int = 32, **settings) -> BoostedTrees:
    """`fit` on all rows of a table of SLICES, without a bound on their number; the same model as `fit` on these rows.

    The driver gets sums by bin and quantiles; a task holds one block at a time. Up to DRIVER_ROWS rows are fit on the driver,
    more in one barrier stage, or by a job for each level where there can be none.
    """
    slices = cut(slices)
    tasks = slices.sparkSession.sparkContext.defaultParallelism
    values = slices.mapInArrow(_counted, "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    values = cut(values.repartitionByRange(tasks, "feature", "value").withColumn("part", F.spark_partition_id()))
    width = values.agg(F.max("feature")).first()[0]  # the label is the last column
    if width is None:
        return fit(np.zeros((0, 1)), np.zeros(0))
    of = {r.value: r.n for r in values.filter(F.col("feature") == width).collect()}
    n, positive = sum(of.values()), of.get(1.0, 0)
    base, cuts = _base(positive / n), _quantile_cuts(values, n, width, bins)
    rounds = rounds if 0 < positive < n else 0
    grow = lambda sums: _grow(sums, cuts, base, rounds, **settings)
    blocks = lambda parts: slices.coalesce(parts).mapInArrow(lambda it: _blocked(it, cuts), BLOCKS)
    if not rounds:
        return grow(None)
    if n <= DRIVER_ROWS:
        parts = list(_unpacked(blocks(tasks).toArrow().to_batches(), width, base, []))
        return grow(_in_memory(np.concatenate([p[0] for p in parts], 1), np.concatenate([p[1] for p in parts]), 1.0, base))
    if slots := _slots(slices.sparkSession):
        held, key = cut(blocks(min(slots, n // BLOCK_ROWS + 1))), secrets.token_bytes(32)
        models = held.mapInArrow(lambda it: _grown(it, width, base, key, grow), "model binary", barrier=True)
        return pickle.loads(models.repartition(1).collect()[0].model)  # Spark starts a barrier stage again only before a shuffle
    return grow(_in_tasks(cut(blocks(max(tasks, n // TASK_ROWS + 1))), width, base))
