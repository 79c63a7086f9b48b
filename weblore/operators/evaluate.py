"""Precision, recall and F1 at several levels in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblore.functions.text import alike


def ground_truth(pages: DataFrame) -> DataFrame:
    """(page_id, domain, template, pred, obj) of the JSON map predicate -> objects; keys "a|b" name several
    predicates. Invalid and null values give no rows, repeated rows of a page count once."""
    parsed = F.from_json("ground_truth", "map<string,array<string>>")
    every = pages.select("page_id", "domain", "template", F.explode(parsed).alias("k", "objs"))
    return every.select("page_id", "domain", "template", F.explode(F.split("k", r"\|")).alias("pred"), "objs").select("page_id", "domain", "template", F.trim("pred").alias("pred"), F.explode("objs").alias("obj")).distinct()


def judged(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """labels (page_id, obj_text, …) with is_right: some true object of the page is fuzzily equal.

    The equi-join on the page bounds the pairs; the topic's own name is no object.
    """
    objects = truth.filter("pred <> 'topic_entity_name'").select("page_id", "obj").distinct()
    hit = labels.select("page_id", "obj_text").distinct().join(objects, "page_id").filter(alike(F.col("obj_text"), F.col("obj"))).select("page_id", "obj_text").distinct().withColumn("is_right", F.lit(True))
    return labels.join(hit, ["page_id", "obj_text"], "left").fillna(False, ["is_right"])


def scores(labels: DataFrame, truth: DataFrame, distinct_objects: bool = False) -> DataFrame:
    """(template, domain, retrieved, correct, relevant, precision, recall, f1) per template, per domain and for all.

    labels: template, domain, is_right; relevant counts all true objects, or distinct ones.
    Shares without a denominator are null.
    """
    found = labels.groupingSets([["template"], ["domain"], []], "template", "domain").agg(F.count("*").alias("retrieved"), F.count_if("is_right").alias("correct"))
    count = F.countDistinct("obj") if distinct_objects else F.count("obj")
    want = truth.groupingSets([["template"], ["domain"], []], "template", "domain").agg(count.alias("relevant"))
    on = lambda c: found[c].eqNullSafe(want[c])
    joined = found.join(want, on("template") & on("domain")).select(found.template, found.domain, "retrieved", "correct", "relevant")
    joined = joined.withColumns({"precision": F.try_divide("correct", "retrieved"), "recall": F.try_divide("correct", "relevant")})
    return joined.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def distance_by_outcome(labels: DataFrame) -> DataFrame:
    """(is_right, n, mean_distance) of labels with dom_distance."""
    return labels.groupBy("is_right").agg(F.count("*").alias("n"), F.avg("dom_distance").alias("mean_distance"))


def missed(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """True objects (page_id, obj) that no label of the page bears."""
    return truth.select("page_id", "obj").distinct().join(labels.select("page_id", F.col("obj_text").alias("obj")).distinct(), ["page_id", "obj"], "left_anti")
