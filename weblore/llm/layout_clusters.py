"""Problem 3: clusters of rows that show the same place of a layout.

A Gaussian mixture is fitted to all rows (gaussian_mixture.py). Its components propose the blocks
in which rows are compared: a row goes to every component that may be the likeliest one within
12 pixels of it, so two alike rows always share a block. Inside a block the exact test (no offset
that both have differs by more than 12 pixels) settles which rows are connected. The mixture
also ranks each cluster's members by density.

Rows of one (template, predicate text, component) are laid on a grid over two offsets; a row near a
cell's upper border is copied to the next cell, so every pair of alike rows meets in a cell. Cells
with more than CELL_ROWS rows are cut into chunks and every pair of chunks becomes a unit of
its own: no unit exceeds two chunks, whatever share of the rows one place holds. A unit is swept
in sorted order with array operations: rows of one 12-pixel cube are alike by definition, and
rows whose window holds only their own component are left at once, so a dense place costs its
sort, not its pairs. Each unit gives only its components, which the rows that stand in several
units join to the clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblore.llm.components import components
from weblore.llm.gaussian_mixture import FEATURES, Mixture, fit, proposed
from weblore.session import cut

REACH, CELL, CELL_ROWS, BUFFER_ROWS, LARGE_CELLS = 12.0, 96.0, 16_384, 60_000, 50_000
OFFSETS = tuple(f"horizontal.{c}" for c in ("left_left", "left_right", "right_left", "right_right")) + tuple(
    f"vertical.{c}" for c in ("up_up", "up_down", "down_up", "down_down"))
AXES = (0, 4)  # the offsets that the grid lies on


def nearest(pairs: DataFrame) -> DataFrame:
    """(pair_id, place_a, place_b, v0..v7, origin_distance) of each row's nearest candidate with features.

    place_a and place_b are hashes of template and of the candidate's text without case,
    punctuation and spacing (a null text counts as ''). Equal distances: the first candidate;
    a null distance counts as the largest. Rows without a candidate with features are left out,
    repeated rows of a pair_id count once.
    """
    ranked = F.array_sort(F.transform(
        F.filter("pred_candidates", lambda p: p["features"].isNotNull()),
        lambda p, i: F.struct(
            F.coalesce(p["features"]["distances"]["origin_distance"], F.lit(float("inf"))).alias("far"), i.alias("i"), p["text"].alias("text"),
            F.array(*(p["features"]["distances"][o.split(".")[0]][o.split(".")[1]] for o in OFFSETS)).alias("v")),
    ))
    rows = pairs.select("pair_id", "template", F.get(ranked, F.lit(0)).alias("n")).filter("n is not null")
    text = F.regexp_replace(F.lower(F.coalesce("n.text", F.lit(""))), r"[^\p{L}\p{N}]+", "")
    return rows.select(
        "pair_id", F.xxhash64("template").alias("place_a"), F.xxhash64(text).alias("place_b"), *(F.get("n.v", F.lit(i)).alias(f"v{i}") for i in range(8)),
        F.nullif("n.far", F.lit(float("inf"))).alias("origin_distance"),
    ).dropDuplicates(["pair_id"])


PLACE = ["place_a", "place_b", "block"]


def units(rows: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows with the unit (place, block, cx, cy, i, j) they are compared in, one row per unit.

    Rows that lack a grid offset go to every cell of their place and block that their other offset
    allows, and to one cell of all such rows.
    """
    x, y = (f"v{a}" for a in AXES)
    cells = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / CELL), F.floor((F.col(c) + REACH) / CELL)))
    whole = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    placed = whole.withColumn("cx", F.explode(cells(x))).withColumn("cy", F.explode(cells(y)))
    wild = rows.filter(F.col(x).isNull() | F.col(y).isNull())
    there = placed.select(*PLACE, "cx", "cy").distinct()
    spread = wild.join(there, PLACE).filter(
        (F.col(x).isNull() | F.array_contains(cells(x), F.col("cx")) | (F.col("cx") == F.floor((F.col(x) - REACH) / CELL)))
        & (F.col(y).isNull() | F.array_contains(cells(y), F.col("cy")) | (F.col("cy") == F.floor((F.col(y) - REACH) / CELL))))
    own = wild.withColumns({"cx": F.lit(None).cast("long"), "cy": F.lit(None).cast("long")})
    entries = placed.unionByName(spread.select(placed.columns)).unionByName(own)
    entries = entries.withColumns({"cx": F.coalesce("cx", F.lit(-(1 << 40))), "cy": F.coalesce("cy", F.lit(-(1 << 40)))})
    key = [*PLACE, "cx", "cy"]
    large = cut(entries.groupBy(*key).count().filter(F.col("count") > cell_rows).select(*key, F.ceil(F.col("count") / cell_rows).cast("int").alias("chunks")))
    large = F.broadcast(large) if large.count() <= LARGE_CELLS else large  # else entries meet them by shuffle
    cut_up = entries.join(large, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("pair_id"), F.col("chunks")).cast("int")
    return (cut_up.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("mine", "other", "chunks"))


def _cubes(unit: np.ndarray, v: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours in cube order that share unit and REACH-wide cube of all offsets."""
    at = np.flatnonzero(whole)
    cube = np.floor(v[at] / REACH)
    order = np.lexsort((*cube.T, unit[at]))
    same = (unit[at][order][1:] == unit[at][order][:-1]) & (cube[order][1:] == cube[order][:-1]).all(1)
    return at[order[:-1][same]], at[order[1:][same]]


def _local(unit: np.ndarray, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component; rows are sorted by unit, rows without a grid offset, then the first axis."""
    n, x = len(ids), v[:, AXES[0]]
    blind = np.isnan(x) | np.isnan(v[:, AXES[1]])
    order = np.argsort(ids, kind="stable")
    low = np.empty(n, np.int64)  # rank of the smallest id that a row is known to be connected with
    low[order] = np.arange(n)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            of_a, of_b = low[a], low[b]
            m = np.minimum(of_a, of_b)
            for at in (order[of_a], order[of_b]):  # the rows that bear the labels take the smaller one
                np.minimum.at(low, at, m)
            while not np.array_equal(again := low[order][low], low):
                low[:] = again
            apart = low[a] != low[b]
            a, b = a[apart], b[apart]

    join(*_cubes(unit, v, ~np.isnan(v).any(1)))
    ends = np.append(np.flatnonzero(unit[1:] != unit[:-1]) + 1, n)
    last = ends[np.searchsorted(ends, np.arange(n), "right")]  # the window of row i ends before last[i]
    for begin, end in zip(np.r_[0, ends[:-1]], ends):
        first = begin + int(np.count_nonzero(blind[begin:end]))
        last[first:end] = first + np.searchsorted(x[first:end], x[first:end] + REACH * (1 + 1e-9), "right")
    at, to = np.arange(n), np.arange(n) + 1
    runs = np.append(np.flatnonzero(low[1:] != low[:-1]) + 1, n)  # where the label changes
    while len(at):
        inside = to < last[at]
        at, to = at[inside], to[inside]
        known = low[to] == low[at]
        to[known] = runs[np.searchsorted(runs, to[known], "right")]  # behind the stretch of the own label
        inside = to < last[at]
        at, to = at[inside], to[inside]
        linked = ~(np.abs(v[at] - v[to]) > REACH).any(1)
        if linked.any():
            join(at[linked], to[linked])
            runs = np.append(np.flatnonzero(low[1:] != low[:-1]) + 1, n)
        to = to + 1
    return ids[order[low]]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of each unit from rows sorted by unit, a bounded number of units at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def done(parts: list) -> pa.RecordBatch:
        keys, ids, v = (np.concatenate([p[k] for p in parts]) for k in range(3))
        new = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
        root = _local(np.cumsum(new), ids, v)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], names=["pair_id", "root"])

    width = len(PLACE) + 4
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(k).to_numpy() for k in range(width)])
        ids = batch.column(width).to_numpy()
        v = np.column_stack([batch.column(width + 1 + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(8)])
        held.append((keys, ids, v))
        if sum(len(p[1]) for p in held) >= BUFFER_ROWS:
            keys, ids, v = (np.concatenate([p[k] for p in held]) for k in range(3))
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if len(ends):
                yield done([(keys[: ends[-1]], ids[: ends[-1]], v[: ends[-1]])])
                held = [(keys[ends[-1] :], ids[ends[-1] :], v[ends[-1] :])]
            else:
                held = [(keys, ids, v)]
    if held:
        yield done(held)


def clusters(pairs: DataFrame, rows: DataFrame | None = None, model: Mixture | None = None) -> DataFrame:
    """(pair_id, cluster) of every row with a nearest candidate; cluster is its smallest pair_id.

    The blocks are those of the mixture, fitted to the rows if none is given.
    """
    rows = cut(nearest(pairs)) if rows is None else rows
    model = fit(rows) if model is None else model
    key = [*PLACE, "cx", "cy", "i", "j"]
    x, y = (F.col(f"v{a}") for a in AXES)
    swept = units(cut(proposed(rows.select("pair_id", "place_a", "place_b", *FEATURES), model, REACH))).select(*(F.col(k).cast("long") for k in key), "pair_id", *FEATURES)
    swept = swept.repartition(*key).sortWithinPartitions(*key, (x.isNotNull() & y.isNotNull()), x.asc_nulls_first())
    local = cut(swept.mapInArrow(_sweep, "pair_id long, root long"))
    lowest = local.groupBy("pair_id").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    split = lowest.filter("low <> high").select("pair_id", "low")
    edges = local.join(split, "pair_id").filter("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b"))
    joined = components(edges)
    return lowest.join(joined, F.col("low") == F.col("node"), "left").select("pair_id", F.coalesce("comp", "low").alias("cluster"))


def linked_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_a, pair_b): the smallest pair_id of each cluster with each other member."""
    return clusters(pairs).filter("pair_id <> cluster").select(F.col("cluster").alias("pair_a"), F.col("pair_id").alias("pair_b"))


def typical_members(scored: DataFrame, top: int = 3) -> DataFrame:
    """(cluster, size, rank, pair_id, log_density) of each cluster's top members by density.

    scored: pair_id, cluster, log_density. A bounded heap per cluster is merged map-side, so a
    cluster of any size is never gathered.
    """
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.col("log_density"), (-F.col("pair_id")).alias("neg"))), asc=False), 1, top)
    part = scored.withColumn("salt", F.pmod(F.xxhash64("pair_id"), F.lit(64)))
    local = part.withColumn("r", F.row_number().over(W.partitionBy("cluster", "salt").orderBy(F.desc("log_density"), "pair_id"))).filter(F.col("r") <= top)
    sizes = part.groupBy("cluster").agg(F.count("*").alias("size"))
    tops = local.groupBy("cluster").agg(best.alias("best")).select("cluster", F.posexplode("best").alias("p", "b"))
    return tops.join(sizes, "cluster").select("cluster", "size", (F.col("p") + 1).alias("rank"), (-F.col("b.neg")).alias("pair_id"), F.col("b.log_density").alias("log_density"))
