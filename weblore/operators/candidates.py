"""Candidate predicate-object pairs of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblore.functions.text import alike, tag_of


def selected(pages: DataFrame, templates: list[str] | None = None, domains: list[str] | None = None) -> DataFrame:
    """Pages whose template holds one of the templates, or, without any, one of the domains; all pages without both."""
    column, parts = ("template", templates) if templates else ("domain", domains)
    if not parts:
        return pages
    test = F.lit(False)
    for p in parts:
        test = test | F.contains(F.col(column), F.lit(p))
    return pages.filter(test)


def is_object(text: Column, freq: Column, ancestors: Column, topic: Column, most: float = 0.90) -> Column:
    """Not too common, not inside a paragraph, not fuzzily the page's topic."""
    return (freq <= most) & ~F.array_contains(ancestors, F.lit("p")) & ~F.coalesce(alike(text, topic), F.lit(False))


def drawn(xpath: Column) -> Column:
    """Whether a path leads through svg or noscript."""
    return xpath.rlike("svg|noscript")


def nearest_predicates(objects: DataFrame, nodes: DataFrame, top: int = 3, accept: Column | None = None) -> DataFrame:
    """The nearest accepted nodes before each object in document order, rank 1 nearest.

    objects: page_id, obj, o_*; nodes: page_id, pred, p_*; obj and pred are places in document
    order. The join is an equi-join on the page, the rank a window over one object's candidates.
    """
    met = objects.join(nodes, "page_id").filter(F.col("pred") < F.col("obj"))
    if accept is not None:
        met = met.filter(accept)
    order = W.partitionBy("page_id", "obj").orderBy(F.desc("pred"))
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def accepted_predicate(pred_freq: Column, obj_freq: Column, above_left: Column, text: Column, least: float = 0.10) -> Column:
    """Frequent enough, more frequent than the object, above and left of it, longer than two characters."""
    return (pred_freq >= least) & (pred_freq > obj_freq) & above_left & (F.length(text) > 2)


def without_drawn(pairs: DataFrame) -> DataFrame:
    """Objects none of whose predicate candidates leads through svg or noscript. pairs: obj_xpath, pred_candidates."""
    return pairs.filter(~drawn(F.col("obj_xpath")) & ~F.coalesce(F.exists("pred_candidates", lambda p: F.coalesce(drawn(p["node"]), F.lit(False))), F.lit(False)))


def topic_pairs(entities: DataFrame, edges: DataFrame, topics: DataFrame) -> DataFrame:
    """Objects of a page that its topic is linked with: one row per (page_id, xpath, node_id) and relation.

    entities: page_id, xpath, node_id, text; topics: page_id, topic_id. Relation weight is 1 over the
    number of relations between the two.
    """
    kinds = edges.filter("edge_type_id is not null").groupBy("source_id", "dest_id", "edge_type_id").agg(F.max("edge_type_text").alias("edge_type_text"))
    many = kinds.groupBy("source_id", "dest_id").agg(F.count("*").alias("n_rels"))
    weighted = kinds.join(many, ["source_id", "dest_id"])
    on_page = entities.distinct().join(topics.select("page_id", F.col("topic_id").alias("source_id")), "page_id")
    return on_page.join(weighted, (F.col("node_id") == F.col("dest_id")) & (on_page.source_id == weighted.source_id)).select(
        "page_id", "xpath", "text", "node_id", on_page.source_id.alias("topic_id"), F.col("edge_type_id").alias("rel_id"), F.col("edge_type_text").alias("rel_text"), (1 / F.col("n_rels")).alias("w"))


def flat_candidates(pairs: DataFrame) -> DataFrame:
    """One row per predicate candidate of each pair, repeated rows of a pair_id once; rank is the place in the list."""
    once = pairs.dropDuplicates(["pair_id"])
    return once.select("pair_id", "page_id", "template", "obj_xpath", "obj_text", F.col("features.dom").alias("obj_dom"), F.posexplode("pred_candidates").alias("place", "p")).select(
        "pair_id", "page_id", "template", "obj_xpath", "obj_text", "obj_dom", (F.col("place") + 1).alias("rank"), F.col("p.node").alias("pred_xpath"), F.col("p.text").alias("pred_text"),
        F.col("p.features").alias("f"), F.col("p.score").alias("score"))


def path_tags(pairs: DataFrame) -> DataFrame:
    """pair_id with the tags of object and predicate."""
    return pairs.select("pair_id", "rank", tag_of(F.col("obj_xpath")).alias("obj_tag"), tag_of(F.col("pred_xpath")).alias("pred_tag"))
