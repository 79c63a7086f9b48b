"""Crowd selection: the largest cluster's pairs to show, and the triples that the crowd confirms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def largest_cluster(clusters: DataFrame) -> DataFrame:
    """(template, cluster, size): the largest cluster but cluster 0 of each template, the smallest number on ties."""
    sizes = clusters.filter("cluster <> 0").groupBy("template", "cluster").agg(F.count("*").alias("size"))
    order = W.partitionBy("template").orderBy(F.desc("size"), "cluster")
    return sizes.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def pages_to_show(members: DataFrame, cap: int = 5) -> DataFrame:
    """Up to cap members of each (template, cluster), one per page: (template, cluster, page_id, pair_id)."""
    one = members.groupBy("template", "cluster", "page_id").agg(F.min("pair_id").alias("pair_id"))
    order = W.partitionBy("template", "cluster").orderBy("page_id")
    return one.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap).drop("n")


def confirmed(shown: DataFrame, decisions: DataFrame) -> DataFrame:
    """Shown pairs of clusters that the decisions (template, cluster, accepted) accept."""
    return shown.join(decisions.filter("accepted").select("template", "cluster").distinct(), ["template", "cluster"], "left_semi")


def unlabelled(pairs: DataFrame, *labels: DataFrame) -> DataFrame:
    """Pairs whose object no label table bears yet."""
    for done in labels:
        pairs = pairs.join(done.select("page_id", "obj_xpath").distinct(), ["page_id", "obj_xpath"], "left_anti")
    return pairs


def of_cluster(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs that stand in a cluster table, by file and object path."""
    return pairs.join(clusters.select("file_name", "obj_xpath").distinct(), ["file_name", "obj_xpath"], "left_semi")
