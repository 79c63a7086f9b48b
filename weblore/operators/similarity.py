"""Similarity of candidate pairs by style and layout."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblore.operators.graph import dense_louvain
from weblore.session import cut

SIDES = {"horizontal": ("left_left", "left_right", "right_left", "right_right"), "vertical": ("up_up", "up_down", "down_up", "down_down")}
# A class of at most so many rows keeps its weights; of a larger one they are worked out again at each visit.
KEPT_ROWS = 4000


def best_ratio(a: Column, b: Column, side: str) -> Column:
    """The largest ratio smaller/larger of absolute offsets over the 4 x 4 grid; 0 where both are 0 or one is null."""
    grid = []
    for s in SIDES[side]:
        for t in SIDES[side]:
            x, y = F.abs(a[s]), F.abs(b[t])
            grid.append(F.coalesce(F.try_divide(F.least(x, y), F.greatest(x, y)) + F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).otherwise(0.0), F.lit(0.0)))
    return F.greatest(*grid)


def layout_similarity(a: Column, b: Column) -> Column:
    """Equal above-left flag plus best horizontal and vertical ratio, 0 to 3. a, b: feature structs."""
    same = F.when(a["graphic"]["is_above_and_on_left"] == b["graphic"]["is_above_and_on_left"], 1.0).otherwise(0.0)
    return same + best_ratio(a["distances"]["horizontal"], b["distances"]["horizontal"], "horizontal") + best_ratio(a["distances"]["vertical"], b["distances"]["vertical"], "vertical")


def style_key(dom: Column) -> Column:
    """A style struct as one string; a null struct stays null, null fields differ from empty ones."""
    return F.when(dom.isNotNull(), F.to_json(dom))


def similarity_classes(pairs: DataFrame) -> DataFrame:
    """(pair_id, rank, class_id, n_links): the gated similarity graph as classes instead of pairs.

    Rows are linked if template and both styles agree and their two paths differ in at least
    one. A class is all rows of one (template, styles); a row's links are the class without
    the rows that bear its own two paths. Only counts are shuffled.
    """
    keyed = pairs.withColumns({"o": style_key(F.col("obj_dom")), "p": style_key(F.col("f.dom"))}).filter("o is not null and p is not null")
    keyed = keyed.select("pair_id", "rank", "template", "o", "p", F.xxhash64("obj_xpath", "pred_xpath").alias("paths"))
    own = keyed.groupBy("template", "o", "p", "paths").agg(F.count("*").alias("own"))
    whole = own.groupBy("template", "o", "p").agg(F.sum("own").alias("whole"))
    counts = own.join(whole, ["template", "o", "p"]).select(F.xxhash64("template", "o", "p").alias("class_id"), "paths", (F.col("whole") - F.col("own")).alias("n_links"))
    return keyed.select("pair_id", "rank", F.xxhash64("template", "o", "p").alias("class_id"), "paths").join(counts, ["class_id", "paths"]).select("pair_id", "rank", "class_id", "n_links")


def page_similarity(pairs: DataFrame, gated: bool, every: int = 20) -> DataFrame:
    """(page_id, pair_a, rank_a, pair_b, rank_b, weight): the stated queries against all rows of their page.

    Queries are the rows whose pair_id is divisible by `every`.

    gated: 0 unless both styles agree; else equal styles add 1. Weights of 0 give no row.
    """
    # styles as strings: structs compare field by field with nulls
    left = pairs.select("page_id", F.col("pair_id").alias("pair_a"), F.col("rank").alias("rank_a"), F.col("f").alias("fa"), style_key(F.col("obj_dom")).alias("oa"), style_key(F.col("f.dom")).alias("da"), F.col("obj_xpath").alias("xa"), F.col("pred_xpath").alias("ya"))
    right = pairs.select("page_id", F.col("pair_id").alias("pair_b"), F.col("rank").alias("rank_b"), F.col("f").alias("fb"), style_key(F.col("obj_dom")).alias("ob"), style_key(F.col("f.dom")).alias("db"), F.col("obj_xpath").alias("xb"), F.col("pred_xpath").alias("yb"))
    same = (F.col("oa") == F.col("ob")) & (F.col("da") == F.col("db"))
    asked = left.filter(F.col("fa").isNotNull() & (F.col("pair_a") % every == 0))
    met = asked.join(right.filter("fb is not null"), "page_id").filter("pair_a <> pair_b or rank_a <> rank_b").filter("not (xa <=> xb and ya <=> yb)")
    base = layout_similarity(F.col("fa"), F.col("fb"))
    weight = F.when(same, base).otherwise(0.0) if gated else base + F.when(same, 1.0).otherwise(0.0)
    return met.withColumn("weight", weight).filter("weight > 0").select("page_id", "pair_a", "rank_a", "pair_b", "rank_b", "weight")


def gated_weights(rows: pd.DataFrame) -> tuple[Callable[[int], np.ndarray], Callable[[int], np.ndarray]]:
    """Layout similarity to all rows without `seed`, within one style class: of the k-th row without it (0 where
    both paths agree, as the graph has no such edge) and of the k-th seed."""
    sides = [np.abs(rows[[f"{side}_{c}" for c in names]].to_numpy(float)) for side, names in SIDES.items()]
    above, paths = rows["above"].to_numpy(float), pd.factorize(rows["obj_xpath"].fillna("\1") + "\0" + rows["pred_xpath"].fillna("\1"))[0]
    seed = rows["seed"].to_numpy(bool)
    free, seeds = np.flatnonzero(~seed), np.flatnonzero(seed)

    def weights(i: int) -> np.ndarray:
        out = (above[free] == above[i]).astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            for side in sides:
                a, b = side[i][:, None, None], side[free][None]
                ratio = np.minimum(a, b) / np.maximum(a, b)
                out += np.fmax.reduce(ratio, axis=(0, 2), initial=0.0)
        return out

    kept: dict[int, np.ndarray] = {}

    def of_free(k: int) -> np.ndarray:
        if k in kept:
            return kept[k]
        out = np.where(paths[free] == paths[free[k]], 0.0, weights(free[k]))
        if len(free) <= KEPT_ROWS:
            kept[k] = out
        return out

    return of_free, lambda k: weights(seeds[k])


def gated_clusters(pairs: DataFrame) -> DataFrame:
    """(template, pair_id, rank, seed, cluster): Louvain communities of each template's gated similarity graph.

    pairs: template, pair_id, rank, obj_xpath, pred_xpath, obj_dom, f, seed. The graph holds the rows
    without `seed`; rows are linked if both styles agree and a path differs, weighted by layout_similarity.
    No edge leaves a style class, so each class is one task's group, with the template's whole weight in
    the modularity: the result is that of the whole graph. Clusters count from 0 per template by their
    first row; rows without links stay alone. A seed row gets the cluster it is most similar to on
    average (all of them on ties), and no row if it is similar to none.
    """
    flat = [F.col(f"f.distances.{side}.{c}").cast("double").alias(f"{side}_{c}") for side, names in SIDES.items() for c in names]
    rows = cut(pairs.select("template", "pair_id", "rank", "obj_xpath", "pred_xpath", "seed", F.col("f.graphic.is_above_and_on_left").cast("double").alias("above"), *flat,
                            style_key(F.col("obj_dom")).alias("o"), style_key(F.col("f.dom")).alias("d")))
    styled = rows.filter("o is not null and d is not null")
    key = ["template", "o", "d"]

    def weigh(part: pd.DataFrame) -> pd.DataFrame:
        free = part[~part["seed"]]
        weight = 0.0
        if len(free):
            of_free, _ = gated_weights(free)
            weight = float(sum(of_free(k).sum() for k in range(len(free))))
        return pd.DataFrame({"template": [part["template"].iloc[0]], "w": [weight]})

    kind = pairs.schema["pair_id"].dataType.simpleString()
    sums = styled.groupBy(*key).applyInPandas(weigh, "template string, w double").groupBy("template").agg(F.sum("w").alias("total"))
    weighed = styled.join(F.broadcast(sums), styled.template.eqNullSafe(sums.template)).drop(sums.template)  # one row a template

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["seed", "pair_id", "rank"], ignore_index=True)
        free = part[~part["seed"]]
        if not len(free):
            return part[["template", "pair_id", "rank", "seed"]].assign(first_pair=part["pair_id"], first_rank=part["rank"]).iloc[:0]
        of_free, of_seed = gated_weights(part)
        found = dense_louvain(of_free, len(free), float(part["total"].iloc[0]))
        size, place, at = np.bincount(found, minlength=len(free)), list(range(len(free))), list(found)
        for k in range(len(part) - len(free)):
            mean = np.bincount(found, of_seed(k), minlength=len(free)) / np.maximum(size, 1)
            best = np.flatnonzero((mean > 0) & (mean >= mean.max() - 1e-9))
            place += [len(free) + k] * len(best)
            at += list(best)
        part = part.iloc[place].assign(at=at)
        return pd.DataFrame({"template": part["template"], "pair_id": part["pair_id"], "rank": part["rank"], "seed": part["seed"], "first_pair": free["pair_id"].to_numpy()[part["at"]], "first_rank": free["rank"].to_numpy()[part["at"]]})

    linked = weighed.groupBy(*key).applyInPandas(cluster, f"template string, pair_id {kind}, rank int, seed boolean, first_pair {kind}, first_rank int")
    alone = rows.filter("(o is null or d is null) and not seed").select("template", "pair_id", F.col("rank").cast("int"), "seed", F.col("pair_id").alias("first_pair"), F.col("rank").cast("int").alias("first_rank"))
    every = cut(linked.unionByName(alone))
    firsts = every.filter("pair_id = first_pair and rank = first_rank and not seed").select("first_pair", "first_rank", (F.row_number().over(W.partitionBy("template").orderBy("first_pair", "first_rank")) - 1).alias("cluster"))
    return every.join(firsts, ["first_pair", "first_rank"]).select("template", "pair_id", "rank", "seed", "cluster")
