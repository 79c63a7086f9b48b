"""Geometry of boxes (x, y, w, h) as column expressions on structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Viewport that distances are scaled by, weight of the vertical axis.
WIDTH, HEIGHT, VERTICAL_WEIGHT = 1024.0, 768.0, 1.5


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def point_distance(a: Column, b: Column, weighted: bool = False) -> Column:
    """Distance of two boxes' upper left corners; weighted: vertical steps count VERTICAL_WEIGHT times."""
    dy = (a["y"] - b["y"]) * (VERTICAL_WEIGHT if weighted else 1.0)
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2.0)) + F.pow(dy, F.lit(2.0)))


def rectangle_distance(a: Column, b: Column) -> Column:
    """Smallest distance of two boxes, 0 if they meet."""
    gap = lambda p, q, s, t: F.greatest(F.lit(0.0), p[s] - (q[s] + q[t]), q[s] - (p[s] + p[t]))
    return F.sqrt(F.pow(gap(a, b, "x", "w"), F.lit(2.0)) + F.pow(gap(a, b, "y", "h"), F.lit(2.0)))


def scaled_distance(a: Column, b: Column) -> Column:
    """Corner distance in shares of the viewport, vertical steps weighted."""
    return F.sqrt(F.pow((a["x"] - b["x"]) / WIDTH, F.lit(2.0)) + F.pow((a["y"] - b["y"]) / HEIGHT * VERTICAL_WEIGHT, F.lit(2.0)))


def offsets(pred: Column, obj: Column) -> Column:
    """Four horizontal and four vertical signed offsets (predicate minus object), smallest and corner distance."""
    near, far = lambda b, s: b[s], lambda b, s, t: b[s] + b[t]
    h = F.struct((near(pred, "x") - near(obj, "x")).alias("left_left"), (near(pred, "x") - far(obj, "x", "w")).alias("left_right"),
                 (far(pred, "x", "w") - near(obj, "x")).alias("right_left"), (far(pred, "x", "w") - far(obj, "x", "w")).alias("right_right"))
    v = F.struct((near(pred, "y") - near(obj, "y")).alias("up_up"), (near(pred, "y") - far(obj, "y", "h")).alias("up_down"),
                 (far(pred, "y", "h") - near(obj, "y")).alias("down_up"), (far(pred, "y", "h") - far(obj, "y", "h")).alias("down_down"))
    return F.struct(h.alias("horizontal"), v.alias("vertical"), rectangle_distance(pred, obj).alias("min_distance"), point_distance(pred, obj).alias("origin_distance"))


def vertical_distance(a: Column, b: Column) -> Column:
    return F.abs(a["y"] - b["y"])


def above_left(a: Column, b: Column) -> Column:
    """Whether a's corner is neither right of nor below b's."""
    return (a["x"] <= b["x"]) & (a["y"] <= b["y"])


def overlap(a: Column, b: Column) -> Column:
    """Whether two boxes share at least a border point."""
    return (a["x"] <= b["x"] + b["w"]) & (b["x"] <= a["x"] + a["w"]) & (a["y"] <= b["y"] + b["h"]) & (b["y"] <= a["y"] + a["h"])


def between(a: Column, b: Column) -> Column:
    """The smallest box around the corners of two boxes."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def middle_nodes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (page_id, obj, pred) with every node that stands between them in order and in the box around them.

    nodes: page_id, ord, b (box). Equi-join on the page, so work is bounded by a page's nodes.
    """
    n = lambda name: nodes.select("page_id", F.col("ord").alias(name), F.col("b").alias(f"{name}_box"))
    placed = pairs.join(n("obj"), ["page_id", "obj"]).join(n("pred"), ["page_id", "pred"])
    met = placed.join(nodes.select("page_id", F.col("ord").alias("mid"), F.col("b").alias("mid_box")), "page_id")
    inside = (F.col("mid") > F.least("obj", "pred")) & (F.col("mid") < F.greatest("obj", "pred"))
    return met.filter(inside & overlap(F.col("mid_box"), between(F.col("obj_box"), F.col("pred_box")))).select("page_id", "obj", "pred", "mid")
