"""Knowledge base: cleaning, neighbours, search, write-back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblore.functions.text import alike, clean


def clean_nodes(nodes: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Distinct (node_id, node_text) with cleaned texts."""
    out = nodes.select("node_id", clean(F.col("node_text")).alias("node_text")).distinct()
    return out.filter("node_text <> ''") if drop_empty else out


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges both of whose ends exist."""
    ids = nodes.select(F.col("node_id")).distinct()
    return (edges.distinct().join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
            .join(ids.withColumnRenamed("node_id", "dest_id"), "dest_id", "left_semi"))


def edge_types(edges: DataFrame) -> DataFrame:
    """One text per edge type: the smallest that is not null."""
    return edges.groupBy("edge_type_id").agg(F.min("edge_type_text").alias("edge_type_text"))


def related_objects(entities: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, obj_id, obj_text, rel_types) of each entity (node_id); entities without edges keep one row of nulls.

    Several edges to one object collapse into a map of relation id to text.
    """
    kinds = edges.filter("dest_id is not null").select("source_id", "dest_id", "edge_type_id", F.coalesce("edge_type_text", F.lit("")).alias("t")).groupBy("source_id", "dest_id", "edge_type_id").agg(F.max("t").alias("t"))
    grouped = kinds.groupBy("source_id", "dest_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_type_id", "t")))).alias("rel_types"))
    texts = nodes.groupBy(F.col("node_id").alias("obj_id")).agg(F.min("node_text").alias("obj_text"))
    return (entities.select("node_id").distinct().join(grouped, F.col("node_id") == F.col("source_id"), "left")
            .select("node_id", F.col("dest_id").alias("obj_id"), "rel_types").join(texts, "obj_id", "left").select("node_id", "obj_id", "obj_text", "rel_types"))


def relations_between(pairs: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Up to limit edges, by edge type, from source_id to dest_id of each pair."""
    found = pairs.select("source_id", "dest_id").distinct().join(edges.distinct(), ["source_id", "dest_id"])
    order = W.partitionBy("source_id", "dest_id").orderBy("edge_type_id", "edge_type_text")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def search_exact(texts: DataFrame, nodes: DataFrame, longest: int = 300) -> DataFrame:
    """(text, node_id, node_text): nodes whose lower-case words equal the text's; longer texts find nothing."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    left = texts.select("text").distinct().filter(F.length("text") <= longest).withColumn("k", key(F.col("text"))).filter("k <> ''")
    right = nodes.select("node_id", "node_text").distinct().withColumn("k", key(F.col("node_text")))
    return left.join(right, "k").select("text", "node_id", "node_text")


def search_phrase(texts: DataFrame, nodes: DataFrame, strict: bool = False, longest: int = 300) -> DataFrame:
    """(text, node_id, node_text): nodes that hold the text's words as a contiguous phrase.

    Both sides meet on the text's rarest word among the nodes' words, then the phrase is checked
    (strict: also fuzzy equality).
    """
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    right = nodes.select("node_id", "node_text").distinct().withColumn("k", key(F.col("node_text"))).filter("k <> ''")
    posting = right.select("node_id", "node_text", "k", F.explode(F.array_distinct(F.split("k", " "))).alias("word"))
    often = posting.groupBy("word").agg(F.count("*").alias("n"))
    left = texts.select("text").distinct().filter(F.length("text") <= longest).withColumn("q", key(F.col("text"))).filter("q <> ''")
    tokens = left.select("text", "q", F.explode(F.array_distinct(F.split("q", " "))).alias("word")).join(often, "word", "left")
    rare = tokens.groupBy("text", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).filter("r.n > 0")
    found = rare.select("text", "q", F.col("r.word").alias("word")).join(posting, "word")
    found = found.filter(F.contains(F.concat(F.lit(" "), "k", F.lit(" ")), F.concat(F.lit(" "), "q", F.lit(" "))))
    return (found.filter(alike(F.col("q"), F.col("k"))) if strict else found).select("text", "node_id", "node_text")


def not_in_kb(labels: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (topic_id, obj_text, pred_text, …) whose fact the knowledge base does not hold."""
    named = edges.distinct().join(nodes.select(F.col("node_id").alias("dest_id"), F.col("node_text").alias("obj_text")).distinct(), "dest_id")
    known = named.select(F.col("source_id").alias("topic_id"), "obj_text", F.col("edge_type_text").alias("pred_text")).distinct()
    return labels.join(known, ["topic_id", "obj_text", "pred_text"], "left_anti")


def _numbered(texts: DataFrame, name: str, first: int) -> DataFrame:
    """Dense ids behind `first` for distinct values: counted per hash range, then numbered inside each range."""
    spread = texts.withColumn("part", F.pmod(F.xxhash64(name), F.lit(256)))
    starts = spread.groupBy("part").count().select("part", (F.sum("count").over(W.partitionBy(F.lit(0)).orderBy("part")) - F.col("count")).alias("start"))  # at most 256 rows
    own = F.row_number().over(W.partitionBy("part").orderBy(name))
    return spread.withColumn("own", own).join(F.broadcast(starts), "part").select(name, (F.col("own") + F.col("start") + F.lit(first)).alias("id"))


def assign_edge_types(labels: DataFrame, kinds: DataFrame) -> DataFrame:
    """(pred_text, edge_type_id, is_new): the known type of a text (the smallest id), else a new id behind the largest."""
    wanted = labels.select("pred_text").filter("pred_text is not null").distinct()
    known = kinds.groupBy(F.col("edge_type_text").alias("pred_text")).agg(F.min("edge_type_id").alias("edge_type_id"))
    largest = kinds.agg(F.coalesce(F.max("edge_type_id"), F.lit(0)).alias("m")).first().m
    fresh = _numbered(wanted.join(known, "pred_text", "left_anti"), "pred_text", largest).select("pred_text", F.col("id").alias("edge_type_id"), F.lit(True).alias("is_new"))
    return wanted.join(known, "pred_text").withColumn("is_new", F.lit(False)).unionByName(fresh)


def write_back(labels: DataFrame, nodes: DataFrame, edges: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new nodes, new edges) of labels (topic_id, obj_text, pred_text) that the knowledge base lacks.

    An object's node is the smallest id that bears its text, else a new one; ids are unique over
    all pages. An edge is appended once per distinct fact.
    """
    lacking = not_in_kb(labels.select("topic_id", "obj_text", "pred_text").dropna().distinct(), nodes, edges)
    known = nodes.filter("node_text is not null").groupBy(F.col("node_text").alias("obj_text")).agg(F.min("node_id").alias("node_id"))
    largest = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("m")).first().m
    fresh = _numbered(lacking.select("obj_text").distinct().join(known, "obj_text", "left_anti"), "obj_text", largest).select("obj_text", F.col("id").alias("node_id"))
    typed = lacking.join(assign_edge_types(lacking, kinds), "pred_text").join(known.unionByName(fresh), "obj_text")
    new_edges = typed.select(F.col("topic_id").alias("source_id"), F.col("node_id").alias("dest_id"), "edge_type_id", F.col("pred_text").alias("edge_type_text"))
    return fresh.select("node_id", F.col("obj_text").alias("node_text")), new_edges
