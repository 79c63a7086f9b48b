"""Topic of a page: the entity whose neighbours overlap most with the page's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def jaccard_scores(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(page_id, node_id, score) of entities (page_id, node_id): overlap of the page's entities with the entity's neighbours."""
    on_page = entities.select("page_id", "node_id").distinct()
    sizes = on_page.groupBy("page_id").agg(F.count("*").alias("e"))
    linked = edges.select(F.col("source_id").alias("node_id"), "dest_id").distinct()
    degree = linked.groupBy("node_id").agg(F.count("*").alias("r"))
    met = on_page.join(linked, "node_id").join(on_page.select("page_id", F.col("node_id").alias("dest_id")), ["page_id", "dest_id"])
    inter = met.groupBy("page_id", "node_id").agg(F.count("*").alias("i"))
    joined = on_page.join(sizes, "page_id").join(degree, "node_id", "left").join(inter, ["page_id", "node_id"], "left").fillna(0, ["r", "i"])
    return joined.select("page_id", "node_id", F.coalesce(F.try_divide(F.col("i"), F.col("e") + F.col("r") - F.col("i")), F.lit(0.0)).alias("score"))


def best_topic(scores: DataFrame) -> DataFrame:
    """(page_id, node_id, score): the best entity of each page, the smallest id on ties."""
    order = W.partitionBy("page_id").orderBy(F.desc("score"), "node_id")
    return scores.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def frequent_topics(topics: DataFrame, least: int = 3) -> DataFrame:
    """(template, topic_text, n): topics chosen on at least `least` pages of a template; null counts as a topic."""
    return topics.groupBy("template", "topic_text").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def xpath_hints(topics: DataFrame, places: DataFrame) -> DataFrame:
    """(template, xpath, hint): how often a first-pass topic stood at an xpath.

    topics: page_id, node_id; places: template, page_id, node_id, xpath.
    """
    return places.join(topics.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi").distinct().groupBy("template", "xpath").agg(F.count("*").alias("hint"))


def second_pass(scores: DataFrame, places: DataFrame, hints: DataFrame, dropped: DataFrame, texts: DataFrame) -> DataFrame:
    """(page_id, node_id, score): scores times the best hint of the entity's xpaths, frequent topics dropped, best per page."""
    best = places.distinct().join(hints, ["template", "xpath"], "left").groupBy("template", "page_id", "node_id").agg(F.max(F.coalesce("hint", F.lit(1))).alias("hint"))
    named = scores.join(best, ["page_id", "node_id"]).join(texts, "node_id", "left")
    kept = named.join(dropped.select("template", "topic_text"), ["template", "topic_text"], "left_anti")
    return best_topic(kept.select("page_id", "node_id", (F.col("score") * F.col("hint")).alias("score")))


def evaluation(topics: DataFrame, truth: DataFrame) -> DataFrame:
    """(site, n_truth, n_found, n_right, precision, recall) per site and for all (site null).

    topics: page_id, topic; truth: site, page_id, topic_true. Shares without a denominator are null.
    """
    joined = truth.join(topics, "page_id", "left")
    right = F.count_if(F.col("topic") == F.col("topic_true"))
    out = joined.groupingSets([["site"], []], "site").agg(F.count("*").alias("n_truth"), F.count("topic").alias("n_found"), right.alias("n_right"))
    return out.withColumns({"precision": F.try_divide("n_right", "n_found"), "recall": F.try_divide("n_right", "n_truth")})
