"""The stages in order over pages, node boxes and a knowledge base; every stage writes its own table.

Layout is an input: node_boxes (page_id, xpath, x, y, w, h). Without it approximate_boxes lays
nodes out by document order and depth, which is enough to run but not the page's real geometry.
Styles are an input as well: styles (page_id, xpath, any strings such as font and colour); without
them approximate_styles takes a node's tag and class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblore.functions.stem import stemmed
from weblore.functions.text import alike_meaning, clean, dom_distance, tag_of
from weblore.operators import candidates, classify, crowd, evaluate, kb, layout, seeds, term_index, topic
from weblore.operators.similarity import gated_clusters
from weblore.plans.config import Config
from weblore.sources import html_nodes
from weblore.sources.stage_store import StageStore


def approximate_boxes(nodes: DataFrame) -> DataFrame:
    """Boxes from document order (y) and depth (x), marked as approximate."""
    return nodes.select("page_id", "xpath", (F.col("depth") * 40.0).alias("x"), (F.col("ord") * 18.0).alias("y"), F.lit(200.0).alias("w"), F.lit(16.0).alias("h"), F.lit(True).alias("approximate"))


def approximate_styles(nodes: DataFrame) -> DataFrame:
    """Stand-ins for styles: tag and class of every node."""
    return nodes.select("page_id", "xpath", "tag", F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")).alias("class"))


def run(store: StageStore, pages: DataFrame, kb_nodes: DataFrame, kb_edges: DataFrame, boxes: DataFrame | None = None, config: Config | None = None,
        styles: DataFrame | None = None, decisions: DataFrame | None = None) -> list[str]:
    """Run all stages; returns the names of the tables written.

    pages: page_id, template, domain, html, topic_text, and for the evaluation of labels ground_truth
    (without that column seed_evaluation and label_evaluation are not written). A page without
    entities, topic or labels has no rows in the later tables.
    decisions: page_id, obj_xpath, pred_xpath of the rows of crowd_pairs that the crowd holds right; with them
    crowd_nodes and crowd_edges are written too. new_nodes and new_edges are what the knowledge base lacks.
    """
    c = config or Config()
    pages = candidates.selected(pages, list(c.selection.templates), list(c.selection.domains)).dropDuplicates(["page_id"])
    homes = pages.select("page_id", "template")
    written = []

    def put(name: str, df: DataFrame) -> DataFrame:
        store.save(df, name)
        written.append(name)
        return store.load(name)

    nodes = put("nodes", html_nodes.nodes(pages))
    boxes = put("node_boxes", boxes if boxes is not None else approximate_boxes(nodes))
    strings = html_nodes.text_strings(nodes).join(homes, "page_id")
    freq = put("term_freq", term_index.term_frequency(term_index.page_terms(strings, stems=True)))
    texts = html_nodes.text_nodes(nodes).join(homes, "page_id").withColumn("term", stemmed(clean(F.col("text")))).filter("term <> ''")
    rated = put("text_nodes", term_index.normalized(texts, freq, pages).select("page_id", "template", "ord", "xpath", "text", "term", "freq", "ancestor_tags"))

    named = kb_nodes.select("node_id", F.col("node_text")).distinct()
    searched = term_index.without_common(rated, c.common_text_below, c.least_text_length).select("text")
    found = kb.search_exact(searched, named, c.search_longest) if c.strict_search else kb.search_phrase(searched, named, longest=c.search_longest)
    entities = put("page_entities", rated.join(found, "text").select("page_id", "template", "ord", "xpath", "node_id", "text").distinct())
    edges = kb_edges.distinct()
    scores = put("topic_scores", topic.jaccard_scores(entities, edges))
    if c.use_ground_truth:  # only candidates that fuzzily bear the page's true name, where it is known
        truth = pages.select("page_id", "topic_text")
        names = named.groupBy("node_id").agg(F.min("node_text").alias("node_text"))
        scores = scores.join(names, "node_id").join(truth, "page_id").filter(F.col("topic_text").isNull() | alike_meaning(F.col("node_text"), F.col("topic_text"))).select("page_id", "node_id", "score")
    first = topic.best_topic(scores)
    labels = kb.clean_nodes(named).groupBy("node_id").agg(F.min("node_text").alias("topic_text"))
    dropped = topic.frequent_topics(homes.join(first.join(labels, "node_id", "left"), "page_id", "left"), c.topic_drop_from)
    hints = topic.xpath_hints(first, entities.select("template", "page_id", "node_id", "xpath"))
    topics = put("topics", topic.second_pass(scores, entities.select("template", "page_id", "node_id", "xpath"), hints, dropped, labels))

    topic_names = put("topic_names", topics.join(labels, "node_id").select("page_id", "node_id", "topic_text"))
    site = "site" if "site" in pages.columns else "template"
    known = pages.filter("topic_text is not null").select("page_id", F.col(site).alias("site"), clean(F.col("topic_text")).alias("topic_true"))
    put("topic_evaluation", topic.evaluation(topic_names.select("page_id", F.col("topic_text").alias("topic")), known))

    placed = rated.join(boxes.select("page_id", "xpath", layout.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("b")), ["page_id", "xpath"])
    topical = placed.join(topic_names.select("page_id", "topic_text"), "page_id", "left")
    objects = topical.filter(candidates.is_object(clean(F.col("text")), F.col("freq"), F.col("ancestor_tags"), F.col("topic_text"), c.most_object_freq)).select("page_id", F.col("ord").alias("obj"), F.col("xpath").alias("obj_xpath"), F.col("text").alias("obj_text"), F.col("freq").alias("o_freq"), F.col("b").alias("o_box"))
    preds = placed.filter(~candidates.drawn(F.col("xpath"))).select("page_id", F.col("ord").alias("pred"), F.col("xpath").alias("pred_xpath"), F.col("text").alias("pred_text"), F.col("freq").alias("p_freq"), F.col("b").alias("p_box"))
    accept = candidates.accepted_predicate(F.col("p_freq"), F.col("o_freq"), layout.above_left(F.col("p_box"), F.col("o_box")), F.col("pred_text"), c.least_predicate_freq)
    near = candidates.nearest_predicates(objects, preds, c.predicates_per_object, accept)
    pairs = put("candidate_pairs", near.select("page_id", "obj", "obj_xpath", "obj_text", "pred", "pred_xpath", "pred_text", "rank", layout.offsets(F.col("p_box"), F.col("o_box")).alias("distances"), layout.above_left(F.col("p_box"), F.col("o_box")).alias("above_left"),
                                              layout.scaled_distance(F.col("p_box"), F.col("o_box")).alias("distance"), dom_distance(F.col("obj_xpath"), F.col("pred_xpath")).alias("dom_distance")))

    linked = candidates.topic_pairs(entities.select("page_id", "xpath", "node_id", "text"), edges, topics.select("page_id", F.col("node_id").alias("topic_id")))
    # an object whose name holds the topic's is no fact about it
    linked = linked.join(labels.withColumnRenamed("topic_text", "obj_name"), "node_id", "left").join(topic_names.select("page_id", "topic_text"), "page_id", "left")
    linked = linked.filter(~F.coalesce(F.contains("obj_name", "topic_text"), F.lit(False))).drop("obj_name", "topic_text")
    shown = pairs.select("page_id", F.col("obj_xpath").alias("xpath"), "obj_text", "rank", "obj", "pred", "pred_xpath", "pred_text", stemmed(clean(F.col("pred_text"))).alias("syn"), "distance")
    joined = linked.drop("text").join(shown, ["page_id", "xpath"], "left").join(homes, "page_id").withColumnsRenamed({"xpath": "obj_xpath", "node_id": "obj_id"})
    topic_pairs = put("topic_pairs", joined)
    synonyms = put("pred_syns", seeds.cutoff(seeds.redundancy(topic_pairs, seeds.relation_entries(topic_pairs, c.least_redundancy)), c.synonym_factor))
    if c.own_template_weight < 1:
        synonyms = seeds.blend(synonyms, seeds.other_templates(synonyms), c.own_template_weight)
    single = put("unpruned_labels", seeds.prune_duplicates(seeds.best_predicate(topic_pairs, synonyms, c.redundancy_share), c.duplicate_factor).withColumn("label_id", F.struct("page_id", "obj_xpath")))
    between = layout.middle_nodes(single.select("page_id", "obj", "pred").distinct(), placed.select("page_id", "ord", "b"))
    middles = between.join(placed.select("page_id", F.col("ord").alias("mid"), clean(F.col("text")).alias("middle")), ["page_id", "mid"]).join(single, ["page_id", "obj", "pred"])
    seed_labels = put("seed_labels", seeds.prune_by_middle(single, middles.select("template", "pred_text", "label_id", "middle"), c.middle_share).drop("label_id"))

    looks = styles if styles is not None else approximate_styles(nodes)
    dom = F.struct(*(c_ for c_ in looks.columns if c_ not in ("page_id", "xpath")))
    look = lambda side: looks.select("page_id", F.col("xpath").alias(f"{side}_xpath"), dom.alias(f"{side}_dom")).dropDuplicates(["page_id", f"{side}_xpath"])
    flat = pairs.join(homes, "page_id").join(look("obj"), ["page_id", "obj_xpath"], "left").join(look("pred"), ["page_id", "pred_xpath"], "left")
    flat = put("pair_features", flat.select(
        F.concat_ws(" ", "page_id", F.format_string("%09d", "obj")).alias("pair_id"), "page_id", "template", "obj_xpath", "obj_text", "obj_dom", "rank", "pred_xpath", "pred_text",
        F.struct(F.col("pred_dom").alias("dom"), "distances", F.struct(F.col("above_left").alias("is_above_and_on_left")).alias("graphic"), "dom_distance").alias("f")))
    tags = classify.label_codes(flat.select(F.explode(F.array(tag_of(F.col("obj_xpath")), tag_of(F.col("pred_xpath")))).alias("tag")), "tag")
    vectors = put("feature_vectors", classify.feature_vectors(flat, tags))
    clusters, predicted = classify.propagate(flat, vectors, seed_labels.select("page_id", "obj_xpath", "pred_xpath"), c.negatives_per_seed)
    put("clusters", clusters)
    new_labels = put("new_labels", classify.select_labels(put("predictions", predicted), flat))
    if "ground_truth" in pages.columns:
        truth = put("truth", evaluate.ground_truth(pages))
        for name, found in (("seed_evaluation", seed_labels), ("label_evaluation", new_labels)):
            own = found.select("page_id", clean(F.col("obj_text")).alias("obj_text")).join(pages.select("page_id", "template", "domain"), "page_id")
            put(name, evaluate.scores(evaluate.judged(own, truth), truth))

    fact = lambda rows: rows.join(topics.select("page_id", F.col("node_id").alias("topic_id")), "page_id").select("topic_id", clean(F.col("obj_text")).alias("obj_text"), clean(F.col("pred_text")).alias("pred_text")).filter("obj_text <> '' and pred_text <> ''")
    named_edges = edges.withColumn("edge_type_text", clean(F.col("edge_type_text")))

    def write_back(rows: DataFrame, nodes_: DataFrame, edges_: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        added = kb.write_back(fact(rows), nodes_, edges_, kb.edge_types(edges_))
        return put(f"{name}_nodes", added[0]), put(f"{name}_edges", added[1])

    tidy = kb.clean_nodes(named)
    new_nodes, new_edges = write_back(new_labels, tidy, named_edges, "new")
    left = crowd.unlabelled(flat, seed_labels, new_labels)
    members = put("crowd_clusters", gated_clusters(left.withColumn("seed", F.lit(False))).drop("seed"))
    members = members.join(left.select("pair_id", "rank", "page_id"), ["pair_id", "rank"]).join(crowd.largest_cluster(members).select("template", "cluster"), ["template", "cluster"], "left_semi")
    asked = crowd.pages_to_show(members.select("template", "cluster", "page_id", F.struct("pair_id", "rank").alias("pair_id")), c.crowd_pairs)
    asked = put("crowd_pairs", asked.select("template", "cluster", "pair_id.pair_id", "pair_id.rank").join(left.drop("template"), ["pair_id", "rank"]).select("template", "cluster", "pair_id", "rank", "page_id", "obj_xpath", "pred_xpath", "obj_text", "pred_text"))
    if decisions is not None:
        both = lambda old, new: old.select(*new.columns).unionByName(new)
        right = asked.join(decisions.select("page_id", "obj_xpath", "pred_xpath").distinct(), ["page_id", "obj_xpath", "pred_xpath"], "left_semi")
        write_back(right, both(tidy, new_nodes), both(named_edges, new_edges), "crowd")
    return written
