"""Readers of page collections and knowledge-base dumps into the tables of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblore.functions.text import alike, clean, hash_id, insert_after
from weblore.sources.tables import table

# Attribute words of the film knowledge base and their edge types.
FILM_TYPES = {"cast": 1, "language": 2, "runtime": 3, "genre": 4, "director": 5, "writer": 6}


def page_files(spark: SparkSession, folder: str, pattern: str = "*.htm*") -> DataFrame:
    """(path, site_dir, file_name, html): every page file below a folder, read whole."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    parts = F.split(path, "/")
    return raw.select(path.alias("path"), F.element_at(parts, -2).alias("site_dir"), F.element_at(parts, -1).alias("file_name"), F.col("value").alias("html"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, pred, objs) of a JSON object page -> {"a|b": [objects]}: joined keys are split, both sides cleaned, lists merged."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("file_name", "m"))
    every = raw.select("file_name", F.explode("m").alias("k", "objs")).select("file_name", F.explode(F.split("k", r"\|")).alias("pred"), "objs")
    return every.groupBy("file_name", clean(F.col("pred")).alias("pred")).agg(F.flatten(F.collect_list(F.transform("objs", clean))).alias("objs"))


def annotated_pages(files: DataFrame, notes: DataFrame, domain: str, sites: list[str] | None = None, quota: int = 0, topics: list[str] | None = None) -> DataFrame:
    """Pages of one domain with their ground truth; pages without a topic name are left out.

    sites: a folder belongs to the first site name it contains; None or [] takes all. quota: at
    most so many pages altogether, shared evenly by the sites, 0 no limit. topics: only pages
    whose topic is fuzzily one of these.
    """
    name = F.col("site_dir")
    site = F.coalesce(*(F.when(F.contains(name, F.lit(s)), F.lit(s)) for s in sites)) if sites else F.regexp_replace(name, r"^[^-]*-|\(.*\)$", "")
    truth = notes.groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("pred", "objs"))).alias("ground_truth"))
    topic = F.get(F.try_element_at("ground_truth", F.lit("topicentityname")), F.lit(0))
    topic = F.coalesce(F.get(F.try_element_at("ground_truth", F.lit("topic_entity_name")), F.lit(0)), topic)
    rows = files.withColumn("site", site).filter("site is not null").join(truth, "file_name").withColumn("topic", topic).filter("topic is not null")
    if topics:
        wanted = F.lit(False)
        for t in topics:
            wanted = wanted | F.coalesce(alike(F.col("topic"), F.lit(t)), F.lit(False))
        rows = rows.filter(wanted)
    if quota:
        share = quota // max(1, len(sites) if sites else files.select("site_dir").distinct().count())
        rows = rows.withColumn("n", F.row_number().over(W.partitionBy("site").orderBy("file_name"))).filter(F.col("n") <= share).drop("n")
    base = F.regexp_extract("html", r"""(?i)<base[^>]*href=["']?([^"'>\s]+)""", 1)
    bare = F.regexp_replace("html", r"(?i)<base[^>]*>", "")
    return rows.select(base.alias("url"), insert_after(bare, F.lit("<head>"), F.lit("<style></style>")).alias("html"), "site", F.lit(domain).alias("domain"),
                       F.concat(F.lit(f"{domain}-"), "site").alias("template"), "file_name", "ground_truth")


def monitored_pages(files: DataFrame, facts: DataFrame, quota: int = 0, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Pages n.html joined with n.json (file_name, facts map) of their folder; "<page title>" becomes the topic name,
    every value a list of one."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    pages = files.withColumn("stem", stem).filter(~F.col("site_dir").isin(*excluded)) if excluded else files.withColumn("stem", stem)
    named = facts.select("site_dir", stem.alias("stem"), F.transform_values(
        F.transform_keys("facts", lambda k, _: F.when(k == "<page title>", "topic_entity_name").otherwise(k)), lambda _, v: F.array(v)).alias("ground_truth"))
    rows = pages.join(named, ["site_dir", "stem"])
    if quota:
        rows = rows.withColumn("n", F.row_number().over(W.partitionBy("site_dir").orderBy("file_name"))).filter(F.col("n") <= quota).drop("n")
    return rows.select(F.col("site_dir").alias("site"), F.lit("monitor").alias("domain"), F.concat(F.lit("monitor-"), "site_dir").alias("template"), "file_name", "html", "ground_truth")


def _lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    rows = spark.read.text(path)
    return rows.filter(~F.startswith("value", F.lit("#"))) if header else rows


def hashed_kb(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, edge types) of triples (source, pred, dest) by hashed texts; equal types keep the smallest text."""
    cleaned = facts.select(clean(F.col("source")).alias("source"), clean(F.col("pred")).alias("pred"), clean(F.col("dest")).alias("dest"))
    ids = cleaned.select(hash_id(F.col("source")).alias("source_id"), hash_id(F.col("dest")).alias("dest_id"), hash_id(F.col("pred")).alias("edge_type_id"), F.col("pred").alias("edge_type_text"), "source", "dest")
    nodes = ids.select(F.col("source_id").alias("node_id"), F.col("source").alias("node_text")).unionByName(ids.select(F.col("dest_id").alias("node_id"), F.col("dest").alias("node_text"))).distinct()
    return nodes, ids.select("source_id", "dest_id", "edge_type_id", "edge_type_text").distinct(), ids.groupBy("edge_type_id").agg(F.min("edge_type_text").alias("edge_type_text"))


def tab_facts(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(source, pred, dest) of a tab-separated file of triples; shorter lines are left out."""
    c = F.split("value", "\t")
    return _lines(spark, path, header).filter(F.size(c) >= 3).select(c[0].alias("source"), c[1].alias("pred"), c[2].alias("dest"))


def tab_nodes(spark: SparkSession, path: str, header: bool = False, drop_empty: bool = True) -> DataFrame:
    """(node_id, node_text) of a tab-separated file whose first column is the text; ids are hashes."""
    text = clean(F.split("value", "\t")[0])
    rows = _lines(spark, path, header).select(text.alias("node_text")).distinct()
    rows = rows.filter("node_text <> ''") if drop_empty else rows
    return rows.select(hash_id(F.col("node_text")).alias("node_id"), "node_text")


def quad_labels(spark: SparkSession, path: str, header: bool = False, drop_empty: bool = False) -> DataFrame:
    """(id, label) of tab-separated lines of four fields: the fourth without its first and its last two characters."""
    c = F.split("value", "\t", 4)
    label = F.expr("substring(c[3], 2, greatest(length(c[3]) - 3, 0))")
    rows = _lines(spark, path, header).select(c.alias("c")).filter("size(c) = 4").select(F.col("c")[0].alias("id"), clean(label).alias("label"))
    return rows.filter("label <> ''") if drop_empty else rows


def spaced_edges(spark: SparkSession, path: str, labels: DataFrame, header: bool = False) -> DataFrame:
    """(source_id, dest_id, edge_type_id, edge_type_text) of lines "src dst type"; a type without a label is an error."""
    c = F.split(F.trim("value"), " +")
    raw = _lines(spark, path, header).select(c[0].cast("long").alias("source_id"), c[1].cast("long").alias("dest_id"), c[2].alias("id"))
    named = raw.join(labels.groupBy("id").agg(F.min("label").alias("label")), "id", "left")
    text = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("edge type without a label: "), "id"))).otherwise(F.col("label"))
    return named.select("source_id", "dest_id", F.col("id").cast("long").alias("edge_type_id"), text.alias("edge_type_text"))


def value_file_kb(subjects: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a subject file (domain, key, text) and value files (domain, key, text, pred).

    Each value row becomes a node of its own with one edge from the subject of its key; ids are
    dense, counted per domain hash range.
    """
    s = subjects.select("domain", "key", clean(F.col("text")).alias("node_text")).distinct().withColumn("node_id", F.xxhash64(F.lit("s"), "domain", "key"))
    v = values.select("domain", "key", "pred", clean(F.col("text")).alias("node_text")).withColumn("n", F.row_number().over(W.partitionBy("domain", "key", "pred").orderBy("node_text")))
    v = v.withColumn("node_id", F.xxhash64(F.lit("v"), "domain", "key", "pred", "n"))
    edges = v.join(s.select("domain", "key", F.col("node_id").alias("source_id")), ["domain", "key"]).select(
        "source_id", F.col("node_id").alias("dest_id"), hash_id(F.col("pred")).alias("edge_type_id"), clean(F.col("pred")).alias("edge_type_text"))
    return s.select("node_id", "node_text").unionByName(v.select("node_id", "node_text")), edges


def film_facts(notes: DataFrame) -> DataFrame:
    """(source, pred, edge_type_id, dest) of annotated pages: for each of six attributes the first predicate (in order) that contains its word."""
    topic = notes.filter("pred in ('topic_entity_name', 'topicentityname')").select("file_name", F.get("objs", F.lit(0)).alias("source"))
    out = None
    for word, kind in FILM_TYPES.items():
        held = notes.filter(F.contains(F.lower("pred"), F.lit(word))).groupBy("file_name").agg(F.min(F.struct("pred", "objs")).alias("f"))
        rows = held.select("file_name", F.lit(word).alias("pred"), F.lit(kind).alias("edge_type_id"), F.explode("f.objs").alias("dest"))
        out = rows if out is None else out.unionByName(rows)
    return topic.join(out, "file_name").select("source", "pred", "edge_type_id", "dest")


def title_facts(pages: DataFrame, suffix: str = "") -> DataFrame:
    """(source, pred, dest) of fact maps (facts): the source is the second word of "<page title>" without the suffix, every other key an edge."""
    title = F.regexp_replace(F.try_element_at("facts", F.lit("<page title>")), F.lit(suffix + "$") if suffix else F.lit("$^"), F.lit(""))
    rows = pages.select(F.get(F.split(title, " "), F.lit(1)).alias("source"), F.explode("facts").alias("pred", "dest"))
    return rows.filter("pred <> '<page title>' and source is not null")


def kb_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, edge types) of the project's Parquet tables."""
    return table(spark, folder, "kb_node"), table(spark, folder, "kb_edge"), table(spark, folder, "kb_edge_type")


SOURCES = {"tab": tab_facts, "quads": quad_labels, "values": value_file_kb, "films": film_facts, "titles": title_facts, "parquet": kb_tables}


def id_column(text: Column) -> Column:
    """Hash id of a cleaned text."""
    return hash_id(clean(text))
