"""Seed labels: predicate synonyms by redundancy and the best predicate of each object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def relation_entries(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Distinct entries (template, page_id, rel_id, obj_id, w) with n_rel, the entries of their relation in the
    template; relations of fewer than `least` entries are left out. Entries without a predicate text count too."""
    entries = pairs.select("template", "page_id", "rel_id", "obj_id", "w").distinct()
    counts = entries.groupBy("template", "rel_id").agg(F.count("*").alias("n_rel")).filter(F.col("n_rel") >= least)
    return entries.join(counts, ["template", "rel_id"])


def redundancy(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """(template, rel_id, syn, score): weight of the entries that show a predicate text over the relation's entries."""
    shown = pairs.filter("syn is not null and syn <> ''").select("template", "page_id", "rel_id", "obj_id", "w", "syn").distinct()
    joined = shown.join(entries, ["template", "page_id", "rel_id", "obj_id", "w"])
    return joined.groupBy("template", "rel_id", "syn").agg((F.sum("w") / F.max("n_rel")).alias("score"))


def cutoff(synonyms: DataFrame, factor: float = 0.5) -> DataFrame:
    """Synonyms of at least factor times the relation's best score."""
    best = F.max("score").over(W.partitionBy("template", "rel_id"))
    return synonyms.withColumn("best", best).filter(F.col("score") >= F.col("best") * factor).drop("best")


def blend(own: DataFrame, others: DataFrame, weight: float = 1.0) -> DataFrame:
    """weight times a template's own score plus the rest times the score of all other templates (0 if unknown)."""
    return own.join(others.select("template", "rel_id", "syn", F.col("score").alias("other")), ["template", "rel_id", "syn"], "left").select(
        "template", "rel_id", "syn", (F.col("score") * weight + F.coalesce("other", F.lit(0.0)) * (1 - weight)).alias("score"))


def other_templates(synonyms: DataFrame) -> DataFrame:
    """(template, rel_id, syn, score): mean score of a synonym over the other templates that know it."""
    sums = synonyms.groupBy("rel_id", "syn").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    return synonyms.join(sums, ["rel_id", "syn"]).filter("n > 1").select("template", "rel_id", "syn", ((F.col("s") - F.col("score")) / (F.col("n") - 1)).alias("score"))


def best_predicate(pairs: DataFrame, synonyms: DataFrame, share: float = 0.21) -> DataFrame:
    """The best predicate of each (page_id, obj_xpath): share times redundancy plus the rest times nearness.

    pairs: template, page_id, obj_xpath, obj_id, obj_text, rel_id, syn, pred_xpath, pred_text,
    rank, distance. Only positive scores win; ties go to the nearer rank, then the smaller path.
    """
    scored = pairs.join(synonyms.withColumnRenamed("score", "syn_score"), ["template", "rel_id", "syn"])
    scored = scored.withColumn("score", F.col("syn_score") * share + (1 - F.col("distance")) * (1 - share)).filter("score > 0")
    order = W.partitionBy("page_id", "obj_xpath").orderBy(F.desc("score"), "rank", "pred_xpath", "rel_id", "obj_id")
    return scored.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def prune_duplicates(labels: DataFrame, factor: float = 0.9) -> DataFrame:
    """Of labels with one obj_text on a page those of at least factor times the best score."""
    best = F.max("score").over(W.partitionBy("page_id", "obj_text"))
    return labels.withColumn("best", best).filter(F.col("score") >= F.col("best") * factor).drop("best")


def prune_by_middle(labels: DataFrame, middles: DataFrame, most: float = 0.9) -> DataFrame:
    """Labels of predicate texts that do not have one and the same string between predicate and object too often.

    middles: template, pred_text, label_id, middle. A string in more than `most` of a predicate
    text's labels removes the text for the whole template; a string repeated in one pair counts repeatedly.
    """
    sizes = labels.groupBy("template", "pred_text").agg(F.countDistinct("label_id").alias("n"))
    often = middles.groupBy("template", "pred_text", "middle").agg(F.count("*").alias("k")).join(sizes, ["template", "pred_text"])
    bad = often.filter(F.col("k") > F.col("n") * most).select("template", "pred_text").distinct()
    return labels.join(bad, ["template", "pred_text"], "left_anti")
