"""Graph operators: normalisation, personalised PageRank, multi-rank walk, Louvain communities."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblore.session import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge (src, dst), weights reset to 1, repeated edges once."""
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").unionByName(flipped).distinct().withColumn("w", F.lit(1.0))


def row_normalized(edges: DataFrame) -> DataFrame:
    """Weights (src, dst, w) over the larger of 1 and the sum of their row."""
    sums = edges.groupBy("src").agg(F.sum("w").alias("s"))
    return edges.join(sums, "src").select("src", "dst", (F.col("w") / F.greatest(F.col("s"), F.lit(1.0))).alias("w"))


def read_edges(text: DataFrame) -> DataFrame:
    """(src, dst, w) of lines with two or three numeric columns; '#' lines are comments, ids are rebased to 0.

    A negative id or weight is an error.
    """
    parts = text.filter("not startswith(trim(value), '#') and trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("c"))
    edges = parts.select(F.col("c")[0].cast("long").alias("src"), F.col("c")[1].cast("long").alias("dst"), F.coalesce(F.try_element_at("c", F.lit(3)).cast("double"), F.lit(1.0)).alias("w"))
    checked = edges.filter(F.when((F.col("src") < 0) | (F.col("dst") < 0) | (F.col("w") < 0), F.raise_error(F.lit("negative id or weight")).cast("boolean")).otherwise(True))
    least = checked.agg(F.least(F.min("src"), F.min("dst")).alias("m")).first().m or 0
    return checked.select((F.col("src") - least).alias("src"), (F.col("dst") - least).alias("dst"), "w")


def walk_step(ranks: DataFrame, edges: DataFrame, start: DataFrame, damping: float) -> DataFrame:
    """One round of r' = d (Pt r + dangling mass on u) + (1 - d) u, for every class at once.

    ranks and start: class, node, r; edges: src, dst, w with rows summing to 1 (or absent: dangling).
    """
    moved = ranks.join(edges, ranks.node == edges.src, "left").groupBy("class", F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.coalesce("w", F.lit(1.0))).alias("m"))
    lost = moved.filter("node is null").select("class", F.col("m").alias("lost"))  # one row per class: mass on nodes without edges
    moved = moved.filter("node is not null")
    u = start.select("class", "node", F.col("r").alias("u"))
    joined = moved.join(u, ["class", "node"], "full").join(F.broadcast(lost), "class", "left").fillna(0.0, ["lost"])
    return joined.select("class", "node", (F.coalesce("m", F.lit(0.0)) * damping + F.coalesce("u", F.lit(0.0)) * (F.col("lost") * damping + (1 - damping))).alias("r"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-9) -> DataFrame:
    """(class, node, r): one walk per class of seeds (class, node), all classes in one pass.

    edges: src, dst, w of any weights; zero weights carry nothing. Seeds share the start evenly.
    With tolerance None exactly `rounds` rounds run; else the L1 change ends the loop, and a walk
    that does not settle is an error. A class without seeds gives no rows.
    """
    usable = edges.filter("w > 0")
    sums = usable.groupBy("src").agg(F.sum("w").alias("s"))
    norm = cut(usable.join(sums, "src").select("src", "dst", (F.col("w") / F.col("s")).alias("w")))
    counts = seeds.distinct().groupBy("class").agg(F.count("*").alias("n"))
    start = cut(seeds.distinct().join(counts, "class").select("class", "node", (1.0 / F.col("n")).alias("r")))
    ranks = start
    for _ in range(rounds):
        new = walk_step(ranks, norm, start, damping)
        new = cut(new)
        if tolerance is not None:
            change = new.join(ranks.withColumnRenamed("r", "old"), ["class", "node"], "full").agg(F.sum(F.abs(F.coalesce("r", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("c")).first().c or 0.0
            if change <= tolerance:
                return new
        ranks = new
    if tolerance is not None:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    return ranks


def multi_rank_walk(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-9, first: str = "seed") -> DataFrame:
    """(node, label): the class whose walk reaches the node most; ties go to `first`, then to the smaller name."""
    ranks = personalised_pagerank(edges, seeds, damping, rounds, tolerance)
    order = F.struct(F.col("r"), (F.col("class") == first).alias("f"), F.col("class"))
    return ranks.groupBy("node").agg(F.max(order).alias("best")).select("node", F.col("best.class").alias("label"))


def louvain(edges: list[tuple[int, int, float]], nodes: list[int]) -> dict[int, int]:
    """Communities of one graph by modularity (Blondel et al., 2008), deterministic: nodes by ascending id,
    moves on strictly positive gain, the lowest community on ties. Isolated nodes stay alone."""
    member = {n: n for n in nodes}
    links: dict[int, dict[int, float]] = {n: defaultdict(float) for n in nodes}
    for a, b, w in edges:
        if w > 0:
            links[a][b] += w
            if a != b:
                links[b][a] += w
    total = sum(sum(m.values()) + m.get(n, 0.0) for n, m in links.items())
    while total:
        group = {n: n for n in links}
        degree = {n: sum(m.values()) + m.get(n, 0.0) for n, m in links.items()}
        weight = dict(degree)
        moved_any = False
        moved = True
        while moved:  # each move raises the modularity, so this ends
            moved = False
            for n in sorted(links):
                near: dict[int, float] = defaultdict(float)
                for other, w in links[n].items():
                    if other != n:
                        near[group[other]] += w
                here = group[n]
                weight[here] -= degree[n]
                gain = lambda c: near.get(c, 0.0) - weight[c] * degree[n] / total  # noqa: B023, E731
                best, value = here, gain(here)
                for c in sorted(near):
                    if gain(c) > value + 1e-12:
                        best, value = c, gain(c)
                weight[best] += degree[n]
                if best != here:
                    group[n], moved, moved_any = best, True, True
        if not moved_any:
            break
        names: dict[int, int] = {}
        for n in sorted(links):
            names[group[n]] = min(names.get(group[n], n), n)
        merged: dict[int, dict[int, float]] = {c: defaultdict(float) for c in set(names.values())}
        for n, m in links.items():
            a = names[group[n]]
            for other, w in m.items():
                b = names[group[other]]
                if n == other or a != b:
                    merged[a][b] += w
                elif n < other:
                    merged[a][a] += w
        member = {n: names[group[c]] for n, c in member.items()}
        links = merged
    return member


def dense_louvain(row: Callable[[int], np.ndarray], n: int, total: float) -> np.ndarray:
    """The community of each of n nodes of a dense graph, named by its smallest node; rules as in louvain.

    row: weights from one node to all n, itself 0; total: sum of all degrees of the whole graph, of
    which the n nodes may be some of the components. Only one row is held at a time.
    """
    member = np.arange(n)
    loops = np.zeros(n)
    degree = np.array([row(i).sum() for i in range(n)])
    while n and total > 0:
        size = len(degree)
        group, weight = np.arange(size), degree.copy()
        moved_any = False
        moved = True
        while moved:
            moved = False
            for i in range(size):
                near = np.bincount(group, row(i), minlength=size)
                here = group[i]
                weight[here] -= degree[i]
                gain = near - weight * (degree[i] / total)
                known = np.where(near > 0, gain, -np.inf)
                top = known.max()
                best = int((known >= top - 1e-12).argmax()) if top > gain[here] + 1e-12 else here
                weight[best] += degree[i]
                if best != here:
                    group[i], moved, moved_any = best, True, True
        if not moved_any:
            break
        first = np.full(size, size)
        np.minimum.at(first, group, np.arange(size))
        names, small = np.unique(first[group], return_inverse=True)
        merged = np.zeros((len(names), len(names)))
        for i in range(size):
            merged[small[i]] += np.bincount(small, row(i), minlength=len(names))
            merged[small[i], small[i]] += loops[i]
        member = small[member]
        degree, loops = merged.sum(1), merged.diagonal().copy()
        np.fill_diagonal(merged, 0.0)
        row = merged.__getitem__
    first = np.full(int(member.max()) + 1 if n else 0, n)
    np.minimum.at(first, member, np.arange(n))
    return first[member]


def louvain_by(edges: DataFrame, key: str, key_type: str = "string") -> DataFrame:
    """(key, node, community) of edges (key, src, dst, w): one graph per key, all keys in parallel.

    A graph must fit into one task; callers split larger ones beforehand (connected components,
    classes of equal nodes).
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = louvain(list(zip(part.src, part.dst, part.w)), sorted(set(part.src) | set(part.dst)))
        return pd.DataFrame({key: part[key].iloc[0], "node": list(found), "community": list(found.values())})

    return edges.groupBy(key).applyInPandas(run, f"{key} {key_type}, node long, community long")
