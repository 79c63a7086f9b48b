"""Gaussian mixture over layout offsets: expectation-maximisation with regularised covariances.

Features are standardised and reduced to principal axes in column expressions. All rows are
added up into at most MOST_CELLS cells of the reduced space (count, sum, outer products: exact
moments), and only these cells reach the driver. There EM runs until the likelihood settles,
for a growing number of components until the information criterion (BIC) rises. The
fitted components propose the blocks in which rows are compared and rank typical members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblore.session import cut

FEATURES = tuple(f"v{k}" for k in range(8))
AXES, RIDGE, SETTLED = 4, 1e-3, 1e-5
MOST_CELLS, MOST_COMPONENTS = 4000, 16
WIDTH = 0.25  # of the finest cells, in standard deviations; coarser ones have 2, 4, 8 … times as much


@dataclass(frozen=True)
class Mixture:
    """Weights, means and covariances on standardised, reduced features."""

    center: np.ndarray
    scale: np.ndarray
    low: np.ndarray  # smallest and largest standardised value of each feature
    high: np.ndarray
    axes: np.ndarray  # (features, reduced)
    rest: np.ndarray  # variance of each feature that the axes leave out
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_density(self, raw: np.ndarray) -> np.ndarray:
        """Log density of raw rows; missing features are integrated out (the marginal density)."""
        std = (raw - self.center) / self.scale
        known = ~np.isnan(std)
        out = np.zeros(len(raw))
        patterns, inverse = np.unique(known, axis=0, return_inverse=True)
        for p, has in enumerate(patterns):
            rows = np.flatnonzero(inverse.ravel() == p)
            if not has.any():
                continue
            a = self.axes[has]
            parts = np.empty((len(rows), len(self.weights)))
            for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
                parts[:, k] = np.log(w) + _log_normal(std[rows][:, has], a @ m, a @ c @ a.T + np.diag(self.rest[has] + RIDGE))
            top = parts.max(1, keepdims=True)
            out[rows] = (top + np.log(np.exp(parts - top).sum(1, keepdims=True)))[:, 0]
        return out

    def members(self, raw: np.ndarray, reach: float) -> np.ndarray:
        """rows x components: which components may be the likeliest one of some point within reach of a row.

        A row's box reaches `reach` to both sides of every known feature and over the whole range of a
        missing one. A component counts if its largest value on the box is not below another one's
        smallest. Two rows with a common point in their boxes therefore share a component: the
        point's likeliest one.
        """
        std = (raw - self.center) / self.scale
        gone = np.isnan(std)
        z = np.where(gone, (self.low + self.high) / 2, std) @ self.axes
        half = np.where(gone, (self.high - self.low) / 2, reach / self.scale) + 1e-9
        n, k, d = len(raw), len(self.weights), self.axes.shape[1]
        value, upper, lower = np.empty((n, k)), np.empty((n, k)), np.full(n, -np.inf)
        bend, slope = np.empty((n, k)), np.empty((n, k, d))
        for i, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            chol = np.linalg.cholesky(c)
            whiten = np.linalg.inv(chol)
            away, play = (z - m) @ whiten.T, half @ np.abs(self.axes @ whiten.T)
            base = np.log(w) - np.log(np.diag(chol)).sum()
            value[:, i] = base - 0.5 * (away**2).sum(1)
            bend[:, i], slope[:, i] = 0.5 * (play**2).sum(1), away @ whiten
            away = np.abs(away)
            upper[:, i] = base - 0.5 * (np.maximum(away - play, 0) ** 2).sum(1)
            np.maximum(lower, base - 0.5 * ((away + play) ** 2).sum(1), out=lower)
        inside = upper >= lower[:, None]
        # against the likeliest one of the middle, by slope and bend of the difference
        top = value.argmax(1)
        every = np.arange(n)
        for i in range(k):
            at = np.flatnonzero(inside[:, i] & (top != i))
            steep = np.abs((slope[at, top[at]] - slope[at, i]) @ self.axes.T)
            inside[at, i] = value[at, i] - value[at, top[at]] + (steep * half[at]).sum(1) + bend[at, top[at]] >= 0
        inside[every, top] = True
        return inside


def _log_normal(x: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    low = np.linalg.cholesky(covariance)
    d = np.linalg.solve(low, (x - mean).T)
    return -0.5 * (d**2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * len(mean) * np.log(2 * np.pi)


def em(count: np.ndarray, sums: np.ndarray, outer: np.ndarray, k: int, seed: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, weights, means, covariances) of k components on cells of rows.

    count, sums, outer: rows of a cell, their sum and the sum of their outer products. All rows of a
    cell share the responsibilities of the cell's mean; the moments are those of all rows. Rounds go on
    until the likelihood per row grows by less than SETTLED.
    """
    points, n, d = sums / count[:, None], count.sum(), sums.shape[1]
    draw = np.random.default_rng(seed)
    starts = [int(draw.choice(len(points), p=count / n))]
    away = ((points - points[starts[0]]) ** 2).sum(1)
    while len(starts) < k:  # the next start is drawn by squared distance from the nearest one
        mass = count * away
        starts.append(int(draw.choice(len(points), p=mass / mass.sum())) if mass.sum() > 0 else starts[0])
        away = np.minimum(away, ((points - points[starts[-1]]) ** 2).sum(1))
    weights, means = np.full(k, 1 / k), points[starts]
    covariances = np.stack([np.eye(d) / k] * k)
    before = -np.inf
    while True:
        parts = np.column_stack([np.log(w) + _log_normal(points, m, c) for w, m, c in zip(weights, means, covariances)])
        top = parts.max(1, keepdims=True)
        share = np.exp(parts - top)
        total = share.sum(1, keepdims=True)
        now = float(count @ (top + np.log(total))[:, 0])
        if now - before < SETTLED * n:
            return now, weights, means, covariances
        before = now
        share /= total
        held = (share * count[:, None]).sum(0) + 1e-9
        weights, means = held / held.sum(), (share.T @ sums) / held[:, None]
        second = (share.T @ outer.reshape(len(points), -1)).reshape(k, d, d) / held[:, None, None]
        covariances = second - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: rows, and for each two features the rows that have both, the sums of the first one there and of the products; ranges."""
    rows, both, crossed, product = 0, np.zeros((8, 8)), np.zeros((8, 8)), np.zeros((8, 8))
    low, high = np.full(8, np.nan), np.full(8, np.nan)
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = _matrix(batch, 0)
        has = ~np.isnan(raw)
        x, m = np.where(has, raw, 0.0), has.astype(float)
        rows, both, crossed, product = rows + len(raw), both + m.T @ m, crossed + x.T @ m, product + x.T @ x
        low, high = np.fmin(low, np.fmin.reduce(raw)), np.fmax(high, np.fmax.reduce(raw))
    if rows:
        out = [("rows", 0, float(rows), None, None)] + [(kind, i, float(v), None, None) for kind, a in (("both", both), ("crossed", crossed), ("product", product)) for i, v in enumerate(a.ravel())]
        out += [("range", i, None, None if np.isnan(a) else float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(low, high))]
        types = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["kind", "at", "total", "low", "high"])


def _cells(batches: Iterator[pa.RecordBatch], center: np.ndarray, scale: np.ndarray, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Finest cells of each batch with count, sum and outer products of their rows."""
    d = axes.shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        z = np.nan_to_num((_matrix(batch, 0) - center) / scale) @ axes
        cell, inverse, count = np.unique(np.floor(z / WIDTH).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
        add = lambda w: np.bincount(inverse.ravel(), w, len(cell))  # noqa: B023, E731
        sums = [add(z[:, j]) for j in range(d)] + [add(z[:, i] * z[:, j]) for i in range(d) for j in range(i, d)]
        names = [*(f"g{j}" for j in range(d)), "n", *(f"s{j}" for j in range(d)), *(f"o{i}_{j}" for i in range(d) for j in range(i, d))]
        yield pa.RecordBatch.from_arrays([*(pa.array(cell[:, j]) for j in range(d)), pa.array(count.astype(float)), *(pa.array(s) for s in sums)], names=names)


def fit(rows: DataFrame, most: int = MOST_COMPONENTS, reduced: int = AXES, seed: int = 11) -> Mixture | None:
    """The mixture of least BIC over all rows (pair_id, v0..v7); None for an empty table.

    The number of components doubles as long as BIC falls, up to `most`. Missing features count as the mean here.
    """
    added = {(r.kind, r.at): (r.total, r.low, r.high) for r in rows.select(*FEATURES).mapInArrow(_moments, "kind string, at int, total double, low double, high double").groupBy("kind", "at").agg(
        F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # some 200 rows
    if not added:
        return None
    square = lambda kind: np.array([added[kind, i][0] for i in range(64)]).reshape(8, 8)
    both, product, crossed = square("both"), square("product"), square("crossed")
    held = np.maximum(np.diag(both), 1)
    n, center = added["rows", 0][0], np.diag(crossed) / held
    cov = (product - center[None, :] * crossed - center[:, None] * crossed.T + np.outer(center, center) * both) / n
    spread = np.sqrt(np.maximum(np.diag(cov) * n / held, 0))
    scale = np.where(spread > 0, spread, 1.0)
    low, high = ((np.array([added["range", i][k] if added["range", i][k] is not None else center[i] for i in range(8)]) - center) / scale for k in (1, 2))
    cov = cov / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(-values)[:reduced]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
    rest = np.maximum(np.diag(cov) - np.diag(axes @ (axes.T @ cov @ axes) @ axes.T), 0.0)

    keys, sums_ = [f"g{j}" for j in range(reduced)], ["n", *(f"s{j}" for j in range(reduced)), *(f"o{i}_{j}" for i in range(reduced) for j in range(i, reduced))]
    schema = ", ".join([*(f"{g} long" for g in keys), *(f"{c} double" for c in sums_)])
    fine = cut(rows.select(*FEATURES).mapInArrow(lambda it: _cells(it, center, scale, axes), schema).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums_)))
    while fine.count() > MOST_CELLS:  # in the end one cell per sign is left
        fine = cut(fine.groupBy(*(F.shiftright(F.col(g), 1).alias(g) for g in keys)).agg(*(F.sum(c).alias(c) for c in sums_)))
    found = fine.orderBy(*keys).toArrow()
    column = lambda c: found.column(c).to_numpy().astype(float)
    count, sums = column("n"), np.column_stack([column(f"s{j}") for j in range(reduced)])
    outer = np.zeros((len(count), reduced, reduced))
    for i in range(reduced):
        for j in range(i, reduced):
            outer[:, i, j] = outer[:, j, i] = column(f"o{i}_{j}")

    best, least, k = None, np.inf, 1
    while k <= min(most, len(count)):
        likelihood, *parameters = em(count, sums, outer, k, seed)
        bic = -2 * likelihood + np.log(n) * (k - 1 + k * reduced + k * reduced * (reduced + 1) / 2)
        if bic >= least:
            break
        best, least, k = parameters, bic, 2 * k
    return Mixture(center, scale, low, high, axes, rest, *best)


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(first + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(len(FEATURES))])


def _densities(batches: Iterator[pa.RecordBatch], model: Mixture) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = _matrix(batch, 1)
        values = np.round(model.log_density(raw), 6) if len(raw) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["pair_id", "log_density"])


def scored(rows: DataFrame, model: Mixture | None = None) -> DataFrame:
    """(pair_id, log_density) of rows (pair_id, v0..v7)."""
    rows = rows.select("pair_id", *FEATURES)
    model = model or fit(rows)
    if model is None:
        return rows.select("pair_id", F.lit(0.0).alias("log_density"))
    return rows.mapInArrow(lambda it: _densities(it, model), "pair_id long, log_density double")


def _propose(batches: Iterator[pa.RecordBatch], model: Mixture, reach: float, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, block = np.nonzero(model.members(_matrix(batch, at), reach)) if batch.num_rows else (np.zeros(0, int), np.zeros(0, int))
        taken = batch.take(pa.array(row))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block.astype(np.int32))], names=[*batch.schema.names, "block"])


def proposed(rows: DataFrame, model: Mixture | None, reach: float) -> DataFrame:
    """rows (…, v0..v7, all eight side by side) once per block (component) in which a row within reach may lie."""
    if model is None:
        return rows.withColumn("block", F.lit(0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", block int"
    at = rows.columns.index(FEATURES[0])
    return rows.mapInArrow(lambda it: _propose(it, model, reach, at), schema)
