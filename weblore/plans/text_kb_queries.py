"""Queries of text functions, term index and knowledge base, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblore.functions import nested, text
from weblore.functions.stem import STOP_WORDS, stemmed
from weblore.operators import evaluate, kb, term_index
from weblore.plans import sql
from weblore.sources import html_nodes
from weblore.sources.tables import once, table

QUERY_BLOCKS = 64
ANCHOR = r"<a [^>]*>([^<]*)</a>"


def pages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each page once; a page's repeated rows hold the same content. html is not shuffled."""
    rows = table(spark, folder, "webpage", "page_id", *columns)
    return once(rows, "page_id") if "html" in columns else rows.dropDuplicates(["page_id"])


def pairs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "candidate_pairs", "pair_id", *columns).dropDuplicates(["pair_id"])


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    # the texts are extracted before repeated pages are dropped: html is never shuffled
    rows = table(spark, folder, "webpage", "page_id", "template", "html")
    return rows.select("page_id", "template", F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("text"))


def _frequency(spark: SparkSession, folder: str) -> DataFrame:
    return term_index.term_frequency(term_index.page_terms(_anchors(spark, folder)))


def term_freq_by_template(spark, folder):
    return _frequency(spark, folder)


def template_stats(spark, folder):
    return term_index.template_stats(_frequency(spark, folder), table(spark, folder, "webpage", "template", "page_id"))


def term_freq_normalized(spark, folder):
    nodes = pairs(spark, folder, "template", "obj_text").select("pair_id", "template", text.clean(F.col("obj_text")).alias("term")).filter("term <> ''")
    return term_index.normalized(nodes, _frequency(spark, folder), table(spark, folder, "webpage", "template", "page_id")).select("pair_id", "template", "term", F.round("freq", 9).alias("freq"))


def text_node_filter(spark, folder):
    return term_index.without_common(term_freq_normalized(spark, folder))


def clean_texts(spark, folder):
    return table(spark, folder, "candidate_pairs", "obj_text").distinct().filter("obj_text is not null").select("obj_text", text.clean(F.col("obj_text")).alias("cleaned"))


def hash_node_ids(spark, folder):
    return table(spark, folder, "kb_node", "node_text").filter("node_text is not null").distinct().select("node_text", text.hash_id(F.col("node_text")).alias("hashed"))


def scalar_texts(spark, folder):
    t = F.col("obj_text")
    rows = table(spark, folder, "candidate_pairs", "obj_text").distinct().filter("obj_text is not null")
    return rows.select("obj_text", text.without_brackets(t).alias("bare"), text.first_number(t).alias("number"), text.truth(t).alias("truth"),
                       text.insert_after(t, F.lit("a"), F.lit("+")).alias("inserted"), F.array_join(text.without_stop_words(text.words(text.clean(t)), list(STOP_WORDS)), " ").alias("content_words"))


def progress_texts(spark, folder):
    s = F.col("o_orderkey") * 37
    return table(spark, folder, "orders", "o_orderkey").select("o_orderkey", text.duration_text(s).alias("duration"), text.short_number(s).alias("number"))


def dom_distance(spark, folder):
    rows = pairs(spark, folder, "obj_xpath", "pred_candidates").select("pair_id", "obj_xpath", F.posexplode("pred_candidates").alias("place", "p"))
    rows = rows.filter("obj_xpath is not null and p.node is not null")
    x, y = F.col("obj_xpath"), F.col("p.node")
    return rows.select("pair_id", "place", text.dom_distance(x, y).alias("dom_distance"), text.tag_of(x).alias("obj_tag"), text.is_below(y, x).alias("below"), F.size(text.ancestor_paths(x)).alias("depth"))


def fuzzy_labels(spark, folder):
    truth = evaluate.ground_truth(pages(spark, folder, "domain", "template", "ground_truth"))
    labels = pairs(spark, folder, "page_id", "obj_text").filter("obj_text is not null").select("pair_id", "page_id", text.clean(F.col("obj_text")).alias("obj_text"))
    return evaluate.judged(labels, truth).select("pair_id", "page_id", "obj_text", "is_right")


def kb_nodes_clean(spark, folder):
    return kb.clean_nodes(table(spark, folder, "kb_node"))


def kb_edges_valid(spark, folder):
    return kb.valid_edges(table(spark, folder, "kb_edge"), table(spark, folder, "kb_node")).select("source_id", "dest_id", "edge_type_id", "edge_type_text")


def kb_edge_types(spark, folder):
    return kb.edge_types(table(spark, folder, "kb_edge").filter("edge_type_id is not null"))


def kb_max_ids(spark, folder):
    n = table(spark, folder, "kb_node", "node_id").agg(F.max("node_id").alias("max_node"), F.count("*").alias("n_rows"), F.countDistinct("node_id").alias("n_nodes"))
    e = table(spark, folder, "kb_edge").agg(F.max("edge_type_id").alias("max_type"), F.count("*").alias("e_rows"))
    return n.select(F.lit("node").alias("what"), F.col("max_node").alias("largest"), "n_rows").unionByName(e.select(F.lit("edge").alias("what"), F.col("max_type").alias("largest"), F.col("e_rows").alias("n_rows")))


def related_objects(spark, folder):
    out = kb.related_objects(table(spark, folder, "kb_node", "node_id"), table(spark, folder, "kb_edge"), table(spark, folder, "kb_node"))
    return out.select("node_id", "obj_id", "obj_text", F.array_join(F.transform(F.map_entries("rel_types"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ";").alias("rel_types"))


def relations_between(spark, folder):
    return kb.relations_between(table(spark, folder, "kb_edge", "source_id", "dest_id"), table(spark, folder, "kb_edge").filter("edge_type_text is not null"))


def entity_search_exact(spark, folder):
    return kb.search_exact(table(spark, folder, "candidate_pairs", F.col("obj_text").alias("text")), table(spark, folder, "kb_node"))


def entity_search_phrase(spark, folder):
    words = table(spark, folder, "webpage", F.col("topic_text").alias("text"))
    return kb.search_phrase(words, table(spark, folder, "kb_node"))


def entity_search_strict(spark, folder):
    return kb.search_phrase(table(spark, folder, "webpage", F.col("topic_text").alias("text")), table(spark, folder, "kb_node"), strict=True)


def map_helpers(spark, folder):
    """Nested map and array helpers over predicate scores."""
    rows = pairs(spark, folder, "pred_candidates").filter("size(pred_candidates) > 0").select("pair_id", F.filter("pred_candidates", lambda p: p["text"].isNotNull() & p["score"].isNotNull()).alias("p"))
    scores = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: i), F.transform("p", lambda c: c["score"]))
    rows = rows.filter("size(p) > 0").select("pair_id", scores.alias("m"), "p")
    return rows.select("pair_id", nested.key_of_largest(F.col("m")).alias("best"), nested.largest_absolute(F.map_values("m")).alias("largest"),
                       F.size(nested.keys_by_value(F.col("m"), F.lit(0.0))).alias("zeros"), nested.first_match(F.col("p"), lambda c: c["score"] > 0)["text"].alias("first_positive"))


def value_frequency(spark, folder):
    rows = pages(spark, folder, "template").groupBy("template").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 1
    return rows.select("template", "n", F.round(F.col("n") / total, 9).alias("share"))


def parse_nodes(spark, folder):
    return html_nodes.nodes(pages(spark, folder, "html")).select("page_id", "ord", "parent_ord", "xpath", "tag", "text", "depth", "is_leaf", "subtree_hash")


def page_strings(spark, folder):
    return html_nodes.text_strings(html_nodes.nodes(pages(spark, folder, "html")))


def stem_terms(spark, folder):
    terms = _frequency(spark, folder).select("term").distinct()
    return terms.select("term", stemmed(F.col("term")).alias("stem"))


def stemmed_term_freq(spark, folder):
    """Document frequency of every stemmed text of a page's DOM, tails included, per template."""
    return term_index.term_frequency(_stemmed_terms(spark, folder))


def _stemmed_terms(spark, folder):
    # parsed before repeated pages are dropped: only (template, page, text) is shuffled
    rows = table(spark, folder, "webpage", "page_id", "template", "html")
    strings = html_nodes.text_strings(html_nodes.nodes(rows)).select("page_id", "text").distinct()
    homes = table(spark, folder, "webpage", "page_id", "template").dropDuplicates(["page_id"])
    return term_index.page_terms(strings.join(homes, "page_id"), stems=True)


def stemmed_text_nodes(spark, folder):
    """Object texts by their stems with their share of the template's pages, too common and too short ones dropped."""
    nodes = pairs(spark, folder, "template", "obj_text").select("pair_id", "template", stemmed(text.clean(F.col("obj_text"))).alias("term")).filter("term <> ''")
    rated = term_index.normalized(nodes, stemmed_term_freq(spark, folder), table(spark, folder, "webpage", "template", "page_id"))
    return term_index.without_common(rated).select("pair_id", "template", "term", F.round("freq", 9).alias("freq"))


def embedding_distance(spark, folder):
    """Distance of every vector to each vector whose id is divisible by 20 (the stated query set), nearest five."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    # the stated query set against all rows, in blocks: every row meets each block of queries once
    met = e.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(QUERY_BLOCKS - 1)))).join(
        asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(QUERY_BLOCKS)).cast("int")), "block").filter("vec_id <> query_id")
    ranked = met.select("query_id", "vec_id", F.round(text.vector_distance(F.col("embedding"), F.col("q")), 4).alias("distance"))
    order = W.partitionBy("query_id", F.pmod("vec_id", F.lit(64))).orderBy("distance", "vec_id")  # at most 5 x 64 rows per query remain
    ranked = ranked.withColumn("n", F.row_number().over(order)).filter("n <= 5")
    return ranked.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))), 1, 5).alias("near")).select("query_id", F.posexplode("near").alias("place", "n")).select("query_id", "place", F.col("n.vec_id").alias("vec_id"), F.col("n.distance").alias("distance"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    term_freq_by_template, template_stats, term_freq_normalized, text_node_filter, clean_texts, hash_node_ids, scalar_texts, progress_texts, dom_distance, fuzzy_labels,
    kb_nodes_clean, kb_edges_valid, kb_edge_types, kb_max_ids, related_objects, relations_between, entity_search_exact, entity_search_phrase, entity_search_strict,
    map_helpers, value_frequency, parse_nodes, page_strings, stem_terms, stemmed_term_freq, stemmed_text_nodes, embedding_distance)}

_TERMS = f"""
anchors as (select page_id, template, unnest(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)) as text from webpage),
terms as (select distinct template, page_id, {sql.clean('text')} as term from anchors),
freq as (select template, term, count(*) as df from terms where term <> '' group by 1, 2),
sizes as (select template, count(distinct page_id) as n_pages from webpage group by 1)"""
_NORMAL = f"""with {sql.PAIRS}, {_TERMS},
n as (select pair_id, template, {sql.clean('obj_text')} as term from pairs),
r as (select pair_id, template, term, round(coalesce(df / n_pages, 0.0)::double, 9) as freq
      from n join sizes using (template) left join freq using (template, term) where term <> '')"""
_PHRASE = f"""with q as (select distinct topic_text as text, {sql.key('topic_text')} as q from webpage where length(topic_text) <= 300),
n as (select distinct node_id, node_text, {sql.key('node_text')} as k from kb_node)
select text, node_id, node_text from q join n on contains(' ' || k || ' ', ' ' || q || ' ') where q <> '' and k <> ''"""

ORACLES: dict[str, str] = {
    "term_freq_by_template": f"with {_TERMS} select template, term, df from freq",
    "template_stats": f"""with {_TERMS}, s as (select template, sum(df)::bigint as term_count, count(*) as different_terms from freq group by 1)
        select template, n_pages, coalesce(term_count, 0) as term_count, coalesce(different_terms, 0) as different_terms from sizes left join s using (template)""",
    "term_freq_normalized": _NORMAL + " select pair_id, template, term, freq from r",
    "text_node_filter": _NORMAL + " select pair_id, template, term, freq from r where length(term) >= 3 and freq < 0.5",
    "clean_texts": f"select distinct obj_text, {sql.clean('obj_text')} as cleaned from candidate_pairs where obj_text is not null",
    "hash_node_ids": f"select distinct node_text, {sql.hash_id('node_text')} as hashed from kb_node where node_text is not null",
    "scalar_texts": f"""with t as (select distinct obj_text from candidate_pairs where obj_text is not null)
        select obj_text, {sql.bare('obj_text')} as bare, nullif(regexp_extract(obj_text, '[0-9]+', 0), '') as number,
          obj_text in ('true', '1', 't', 'y', 'yes', 'True', 'TRUE') as truth,
          case when instr(obj_text, 'a') > 0 then left(obj_text, instr(obj_text, 'a')) || '+' || substr(obj_text, instr(obj_text, 'a') + 1) else obj_text end as inserted,
          array_to_string(list_filter(string_split({sql.clean('obj_text')}, ' '), lambda w: w <> '' and not list_contains({list(STOP_WORDS)}, w)), ' ') as content_words from t""",
    "progress_texts": """with s as (select o_orderkey, o_orderkey * 37 as s from orders)
        select o_orderkey, case when s >= 86400 then (s // 86400) || 'd:' || (s // 3600 % 24) || 'h:' || (s // 60 % 60) || 'm:' || (s % 60) || 's'
          when s >= 3600 then (s // 3600) || 'h:' || (s // 60 % 60) || 'm:' || (s % 60) || 's' when s >= 60 then (s // 60) || 'm:' || (s % 60) || 's' else s || 's' end as duration,
          case when s >= 10000 then format('{:,}', s) else s::varchar end as number from s""",
    "dom_distance": f"""with {sql.PAIRS}, r as (select pair_id, obj_xpath as x, unnest(pred_candidates).node as y, (unnest(range(len(pred_candidates))))::int as place from pairs where obj_xpath is not null)
        select pair_id, place, {sql.dom_distance('x', 'y')} as dom_distance, regexp_replace(string_split(x, '/')[-1], '\\[.*\\]', '') as obj_tag,
          starts_with(y, x || '/') as below, len({sql.prefixes('x')})::int as depth from r where y is not null""",
    "fuzzy_labels": f"""with {sql.PAIRS}, {sql.PAGES},
        g as (select page_id, unnest(json_keys(ground_truth)) as k, ground_truth from pages where json_valid(ground_truth)),
        t as (select distinct page_id, trim(unnest(string_split(k, '|'))) as pred, k, ground_truth from g),
        o as (select distinct page_id, unnest(from_json(ground_truth->('$."' || k || '"'), '["varchar"]')) as obj from t where pred <> 'topic_entity_name'),
        l as (select pair_id, page_id, {sql.clean('obj_text')} as obj_text from pairs where obj_text is not null),
        hit as (select distinct l.page_id, l.obj_text from (select distinct page_id, obj_text from l) l join o using (page_id) where {sql.alike('l.obj_text', 'o.obj')})
        select pair_id, page_id, obj_text, hit.page_id is not null as is_right from l left join hit using (page_id, obj_text)""",
    "kb_nodes_clean": f"select distinct node_id, {sql.clean('node_text')} as node_text from kb_node where {sql.clean('node_text')} <> ''",
    "kb_edges_valid": "select distinct source_id, dest_id, edge_type_id, edge_type_text from kb_edge where source_id in (select node_id from kb_node) and dest_id in (select node_id from kb_node)",
    "kb_edge_types": "select edge_type_id, min(edge_type_text) as edge_type_text from kb_edge where edge_type_id is not null group by 1",
    "kb_max_ids": "select 'node' as what, max(node_id) as largest, count(*) as n_rows from kb_node union all select 'edge', max(edge_type_id), count(*) from kb_edge",
    "related_objects": """with k as (select source_id, dest_id, edge_type_id, max(coalesce(edge_type_text, '')) as t from kb_edge where dest_id is not null group by 1, 2, 3),
        g as (select source_id, dest_id, string_agg(edge_type_id || '=' || t, ';' order by edge_type_id) as rel_types from k group by 1, 2),
        x as (select node_id as obj_id, min(node_text) as obj_text from kb_node group by 1)
        select n.node_id, dest_id as obj_id, obj_text, rel_types from (select distinct node_id from kb_node) n left join g on n.node_id = source_id left join x on x.obj_id = dest_id""",
    "relations_between": """with e as (select distinct * from kb_edge where edge_type_text is not null),
        r as (select *, row_number() over (partition by source_id, dest_id order by edge_type_id, edge_type_text) as n from e)
        select source_id, dest_id, edge_type_id, edge_type_text from r where n <= 10""",
    "entity_search_exact": f"""with q as (select distinct obj_text as text, {sql.key('obj_text')} as k from candidate_pairs where length(obj_text) <= 300),
        n as (select distinct node_id, node_text, {sql.key('node_text')} as k from kb_node) select text, node_id, node_text from q join n using (k) where k <> ''""",
    "entity_search_phrase": _PHRASE,
    "entity_search_strict": _PHRASE + f" and {sql.alike('q', 'k')}",
    "map_helpers": f"""with {sql.PAIRS}, r as (select pair_id, list_filter(pred_candidates, lambda p: p.text is not null and p.score is not null) as p from pairs),
        s as (select pair_id, p, list_transform(p, lambda c: c.score) as m from r where len(p) > 0)
        select pair_id, list_position(m, list_max(m)) as best, list_max(list_transform(m, lambda v: abs(v))) as largest, len(list_filter(m, lambda v: v = 0))::int as zeros,
          (list_filter(p, lambda c: c.score > 0)[1]).text as first_positive from s""",
    "value_frequency": f"with {sql.PAGES} select template, count(*) as n, round(count(*) / sum(count(*)) over ()::double, 9) as share from pages group by 1",
    "embedding_distance": """with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0),
        m as (select query_id, vec_id, round(list_distance(embedding::double[], q::double[]), 4) as distance from embeddings join q on vec_id <> query_id),
        r as (select *, row_number() over (partition by query_id order by distance, vec_id) - 1 as place from m)
        select query_id, place::int as place, vec_id, distance from r where place < 5""",
}
