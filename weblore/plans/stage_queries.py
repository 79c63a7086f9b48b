"""Queries of the pipeline stages: topics, candidates, layout, seeds, propagation, evaluation, write-back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblore.functions import text
from weblore.operators import candidates, classify, crowd, evaluate, graph, kb, layout, seeds, similarity, term_index, topic, xpath_rules
from weblore.plans import sql
from weblore.plans.text_kb_queries import pages, pairs
from weblore.session import cut
from weblore.sources import html_nodes
from weblore.sources.tables import table
from weblore.streaming import page_stream

KEY = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _edges(spark, folder):
    return table(spark, folder, "kb_edge").filter("source_id is not null and dest_id is not null").distinct()


def _entities(spark, folder):
    """Page entities: objects whose words equal a node's, and the topic text."""
    nodes = table(spark, folder, "kb_node").distinct().select("node_id", KEY(F.col("node_text")).alias("k")).filter("k <> ''").distinct()
    objects = pairs(spark, folder, "page_id", "template", "obj_xpath", "obj_text").select("page_id", "template", F.col("obj_xpath").alias("xpath"), KEY(F.col("obj_text")).alias("k"))
    heads = pages(spark, folder, "template", "topic_text").select("page_id", "template", F.lit("/html/body/h1").alias("xpath"), KEY(F.col("topic_text")).alias("k"))
    return objects.unionByName(heads).join(nodes, "k").select("page_id", "template", "xpath", "node_id", "k").distinct()


_ENTITIES = f"""with {sql.PAIRS}, {sql.PAGES},
edges as (select distinct source_id, dest_id, edge_type_id, edge_type_text from kb_edge where source_id is not null and dest_id is not null),
nk as (select distinct node_id, {sql.key('node_text')} as k from kb_node where {sql.key('node_text')} <> ''),
ent as (select distinct page_id, template, xpath, node_id, k from (
  select page_id, template, obj_xpath as xpath, {sql.key('obj_text')} as k from pairs
  union all select page_id, template, '/html/body/h1', {sql.key('topic_text')} from pages) join nk using (k)),
e as (select distinct page_id, node_id from ent), es as (select page_id, count(*) as e from e group by 1),
ln as (select distinct source_id as node_id, dest_id from edges), rs as (select node_id, count(*) as r from ln group by 1),
ix as (select e.page_id, e.node_id, count(*) as i from e join ln using (node_id) join e o on o.page_id = e.page_id and o.node_id = ln.dest_id group by 1, 2),
js as (select page_id, node_id, coalesce(coalesce(i, 0)::double / nullif(e + coalesce(r, 0) - coalesce(i, 0), 0), 0.0) as score from e join es using (page_id) left join rs using (node_id) left join ix using (page_id, node_id)),
top1 as (select page_id, node_id, score from (select *, row_number() over (partition by page_id order by score desc, node_id) as n from js) where n = 1),
tx as (select node_id, min(k) as topic_text from nk group by 1),
tt as (select page_id, template, topic_text from pages p0(page_id) join (select page_id, template from pages) using (page_id) left join top1 using (page_id) left join tx using (node_id))
""".replace("pages p0(page_id) join (select page_id, template from pages) using (page_id)", "(select page_id, template from pages)")
_PASS2 = _ENTITIES + """, dropped as (select template, topic_text from tt group by 1, 2 having count(*) >= 3),
hints as (select template, xpath, count(*) as hint from (select distinct page_id, template, xpath, node_id, k from ent semi join top1 using (page_id, node_id)) group by 1, 2),
bh as (select template, page_id, node_id, max(coalesce(hint, 1)) as hint from (select distinct page_id, template, xpath, node_id from ent) left join hints using (template, xpath) group by 1, 2, 3),
s2 as (select bh.page_id, node_id, score * hint as score, template, topic_text from js join bh using (page_id, node_id) left join tx using (node_id)),
k2 as (select s2.* from s2 left join dropped d on d.template is not distinct from s2.template and d.topic_text = s2.topic_text where d.template is null),
top2 as (select page_id, node_id, score from (select *, row_number() over (partition by page_id order by score desc, node_id) as n from k2) where n = 1)
"""


def page_entities(spark, folder):
    return _entities(spark, folder)


def _scores(spark, folder):
    return topic.jaccard_scores(_entities(spark, folder), _edges(spark, folder))


def jaccard_topic(spark, folder):
    return topic.best_topic(_scores(spark, folder)).select("page_id", "node_id", F.round("score", 9).alias("score"))


def _texts(spark, folder):
    return table(spark, folder, "kb_node").select("node_id", KEY(F.col("node_text")).alias("k")).filter("k <> ''").groupBy("node_id").agg(F.min("k").alias("topic_text"))


def _topics(spark, folder):
    best = topic.best_topic(_scores(spark, folder)).join(_texts(spark, folder), "node_id", "left")
    return pages(spark, folder, "template").join(best, "page_id", "left")


def topic_frequency_drop(spark, folder):
    return topic.frequent_topics(_topics(spark, folder))


def topic_xpath_hints(spark, folder):
    return topic.xpath_hints(topic.best_topic(_scores(spark, folder)), _entities(spark, folder))


def _second(spark, folder):
    places = cut(_entities(spark, folder))
    scores = cut(topic.jaccard_scores(places, _edges(spark, folder)))
    best, texts = cut(topic.best_topic(scores)), _texts(spark, folder)
    dropped = topic.frequent_topics(pages(spark, folder, "template").join(best.join(texts, "node_id", "left"), "page_id", "left"))
    return topic.second_pass(scores, places, topic.xpath_hints(best, places), dropped, texts)


def topic_pass2(spark, folder):
    return _second(spark, folder).select("page_id", "node_id", F.round("score", 9).alias("score"))


def topic_meaning(spark, folder):
    """Whether a page's topic text means the same as its best topic's name."""
    best = topic.best_topic(_scores(spark, folder)).join(_texts(spark, folder), "node_id").select("page_id", F.col("topic_text").alias("name"))
    rows = pages(spark, folder, "topic_text").filter("topic_text is not null").join(best, "page_id")
    return rows.select("page_id", "name", text.alike_meaning(F.col("topic_text"), F.col("name")).alias("same_meaning"))


def topic_evaluation(spark, folder):
    found = _second(spark, folder).join(_texts(spark, folder), "node_id", "left").select("page_id", F.col("topic_text").alias("topic"))
    truth = pages(spark, folder, "site", "topic_text").filter("topic_text is not null").select("page_id", "site", KEY(F.col("topic_text")).alias("topic_true"))
    out = topic.evaluation(found, truth)
    return out.select("site", "n_truth", "n_found", "n_right", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def selected_templates(spark, folder):
    return candidates.selected(pages(spark, folder, "template", "domain"), templates=["hub", "guide"]).unionByName(candidates.selected(pages(spark, folder, "template", "domain"), domains=["book"])).distinct()


def candidate_ranks(spark, folder):
    """Predicate candidates by distance: the three nearest with features that are above and left."""
    flat = candidates.flat_candidates(pairs(spark, folder, "page_id", "template", "obj_xpath", "obj_text", "features", "pred_candidates"))
    kept = flat.filter("f.graphic.is_above_and_on_left and length(pred_text) > 2 and f.distances.origin_distance is not null")
    ranked = kept.withColumn("nearness", F.expr("row_number() over (partition by pair_id order by f.distances.origin_distance, rank)")).filter("nearness <= 3")
    return ranked.select("pair_id", "nearness", "pred_xpath", F.round("f.distances.origin_distance", 4).alias("distance"))


def without_drawn(spark, folder):
    return candidates.without_drawn(pairs(spark, folder, "obj_xpath", "pred_candidates")).select("pair_id")


def nearest_predicates(spark, folder):
    """The three accepted texts before each object text of a page, in the order of its nodes; page frequency as frequency.

    Object nodes in the order of their paths stand for the page's text nodes.
    """
    rows = pairs(spark, folder, "page_id", "template", "obj_xpath", "obj_text").select("page_id", "template", "obj_xpath", KEY(F.col("obj_text")).alias("term")).filter("term <> ''")
    freq = term_index.term_frequency(rows.select("template", "page_id", "term").distinct())
    places = rows.groupBy("page_id", "template", "obj_xpath").agg(F.min("term").alias("term")).join(freq, ["template", "term"])
    placed = cut(places.withColumn("n", F.expr("row_number() over (partition by page_id order by obj_xpath)")).select("page_id", "n", "df", "term"))
    objects = placed.select("page_id", F.col("n").alias("obj"), F.col("df").alias("o_freq"))
    nodes = placed.select("page_id", F.col("n").alias("pred"), F.col("df").alias("p_freq"), "term")
    return candidates.nearest_predicates(objects, nodes, accept=(F.col("p_freq") > F.col("o_freq")) & (F.length("term") > 2)).select("page_id", "obj", "pred", "rank")


def node_neighbours(spark, folder):
    """Text nodes with their nearest preceding text node outside their ancestors, over whole pages."""
    nodes = html_nodes.text_nodes(html_nodes.nodes(pages(spark, folder, "html")))
    nodes = cut(nodes.select("page_id", "ord", "xpath", "text"))
    w = "row_number() over (partition by page_id order by ord)"
    numbered = nodes.withColumn("n", F.expr(w))
    return numbered.alias("a").join(numbered.alias("b"), F.expr("a.page_id = b.page_id and a.n = b.n + 1")).filter("not startswith(a.xpath, concat(b.xpath, '/'))").select("a.page_id", "a.xpath", F.col("b.xpath").alias("before"))


def _boxes(spark, folder):
    """Boxes of each candidate (pred) and its object (box) with all eight offsets; the object's corner is the origin."""
    flat = _flat(spark, folder).select("pair_id", "rank", F.col("f.distances.horizontal").alias("h"), F.col("f.distances.vertical").alias("v"))
    whole = flat.filter(" and ".join(f"{side}.{c} is not null" for side, key in (("h", "horizontal"), ("v", "vertical")) for c in similarity.SIDES[key]))
    zero = F.lit(0.0)
    return whole.select("pair_id", "rank", layout.box(F.col("h.left_left"), F.col("v.up_up"), F.col("h.right_left") - F.col("h.left_left"), F.col("v.down_up") - F.col("v.up_up")).alias("pred"),
                        layout.box(zero, zero, F.col("h.left_left") - F.col("h.left_right"), F.col("v.up_up") - F.col("v.up_down")).alias("box"))


def rect_distance(spark, folder):
    p, o = F.col("pred"), F.col("box")
    return _boxes(spark, folder).select("pair_id", "rank", F.round(layout.rectangle_distance(p, o), 6).alias("min_distance"), F.round(layout.point_distance(p, o, True), 6).alias("weighted"),
                                        F.round(layout.scaled_distance(p, o), 6).alias("scaled"), F.round(layout.vertical_distance(p, o), 6).alias("vertical"), layout.above_left(p, o).alias("above_left"), layout.overlap(p, o).alias("overlap"))


def offset_features(spark, folder):
    """The offsets worked out again from the boxes, and how far they are from the stored ones."""
    f = layout.offsets(F.col("pred"), F.col("box"))
    rows = _boxes(spark, folder).select("pair_id", "rank", f.alias("f"))
    return rows.select("pair_id", "rank", *(F.round(f"f.horizontal.{c}", 4).alias(c) for c in similarity.SIDES["horizontal"]), *(F.round(f"f.vertical.{c}", 4).alias(c) for c in similarity.SIDES["vertical"]), F.round("f.origin_distance", 4).alias("origin_distance"))


def middle_nodes(spark, folder):
    """Of an object's candidates, in the order of their list, those between it and a farther one, in order and in the box around both."""
    b = cut(_boxes(spark, folder))
    nodes = b.select(F.col("pair_id").alias("page_id"), (-F.col("rank")).alias("ord"), F.col("pred").alias("b"))
    objects = b.select(F.col("pair_id").alias("page_id"), F.lit(0).alias("ord"), F.col("box").alias("b")).groupBy("page_id", "ord").agg(F.max("b").alias("b"))
    wide = b.select(F.col("pair_id").alias("page_id"), F.lit(0).alias("obj"), (-F.col("rank")).alias("pred"))
    return layout.middle_nodes(wide, nodes.unionByName(objects)).select(F.col("page_id").alias("pair_id"), "pred", "mid")


def _topic_pairs(spark, folder):
    """Objects linked with their page's topic, with each predicate candidate's text and distance."""
    linked = candidates.topic_pairs(_entities(spark, folder).select("page_id", "xpath", "node_id", F.col("k").alias("text")), _edges(spark, folder), topic.best_topic(_scores(spark, folder)).select("page_id", F.col("node_id").alias("topic_id")))
    flat = candidates.flat_candidates(pairs(spark, folder, "page_id", "template", "obj_xpath", "obj_text", "features", "pred_candidates"))
    near = flat.select("page_id", "template", F.col("obj_xpath").alias("xpath"), "obj_text", "pair_id", "rank", "pred_xpath", "pred_text", text.clean(F.col("pred_text")).alias("syn"),
                       F.coalesce(layout.scaled_distance(layout.box(F.col("f.distances.horizontal.left_left"), F.col("f.distances.vertical.up_up"), F.lit(0), F.lit(0)), layout.box(F.lit(0), F.lit(0), F.lit(0), F.lit(0))), F.lit(1.0)).alias("distance"))
    homes = pages(spark, folder, "template").withColumnRenamed("template", "home")
    out = linked.join(near, ["page_id", "xpath"], "left").join(homes, "page_id").withColumn("template", F.coalesce("template", "home"))
    return out.select("template", "page_id", F.col("xpath").alias("obj_xpath"), F.col("node_id").alias("obj_id"), "obj_text", "rel_id", "w", "pair_id", "rank", "pred_xpath", "pred_text", "syn", "distance")


_TP = _ENTITIES + f""", ek as (select source_id, dest_id, edge_type_id as rel_id from edges where edge_type_id is not null group by 1, 2, 3),
en as (select source_id, dest_id, count(*) as n from ek group by 1, 2),
lk as (select distinct ent.page_id, ent.xpath, ent.node_id, ek.rel_id, 1.0::double / en.n as w from ent join top1 on top1.page_id = ent.page_id join ek on ek.source_id = top1.node_id and ek.dest_id = ent.node_id join en on en.source_id = ek.source_id and en.dest_id = ek.dest_id),
fc as (select pair_id, page_id, template, obj_xpath, obj_text, unnest(pred_candidates) as p, (unnest(range(len(pred_candidates))) + 1)::int as rank from pairs),
nr as (select page_id, template, obj_xpath as xpath, obj_text, pair_id, rank, p.node as pred_xpath, p.text as pred_text, {sql.clean('p.text')} as syn, coalesce(sqrt(pow(p.features.distances.horizontal.left_left / 1024.0, 2) + pow(p.features.distances.vertical.up_up / 768.0 * 1.5, 2)), 1.0) as distance from fc),
tp as (select coalesce(nr.template, h.template) as template, lk.page_id, lk.xpath as obj_xpath, lk.node_id as obj_id, obj_text, rel_id, w, pair_id, rank, pred_xpath, pred_text, syn, distance from lk left join nr using (page_id, xpath) join (select page_id, template from pages) h on h.page_id = lk.page_id),
en3 as (select template, page_id, rel_id, obj_id, w, count(*) over (partition by template, rel_id) as n_rel from (select distinct template, page_id, rel_id, obj_id, w from tp)),
ent3 as (select * from en3 where n_rel >= 3),
sy as (select template, rel_id, syn, sum(w) / max(n_rel) as score from (select distinct template, page_id, rel_id, obj_id, w, syn from tp where syn <> '') join ent3 using (template, page_id, rel_id, obj_id, w) group by 1, 2, 3),
sc as (select template, rel_id, syn, score from (select *, max(score) over (partition by template, rel_id) as b from sy) where score >= b * 0.5),
bp as (select * from (select tp.*, sc.score * 0.21 + (1 - distance) * 0.79 as score, row_number() over (partition by page_id, obj_xpath order by sc.score * 0.21 + (1 - distance) * 0.79 desc, rank, pred_xpath, rel_id, obj_id) as n from tp join sc using (template, rel_id, syn) where sc.score * 0.21 + (1 - distance) * 0.79 > 0) where n = 1)
"""


def relation_weighted_candidates(spark, folder):
    return seeds.relation_entries(_topic_pairs(spark, folder)).select("template", "page_id", "rel_id", "obj_id", F.round("w", 9).alias("w"), "n_rel")


def _synonyms(spark, folder):
    tp = cut(_topic_pairs(spark, folder))
    return tp, cut(seeds.redundancy(tp, seeds.relation_entries(tp)))


def redundancy_score(spark, folder):
    return _synonyms(spark, folder)[1].select("template", "rel_id", "syn", F.round("score", 9).alias("score"))


def synonym_cutoff(spark, folder):
    return seeds.cutoff(_synonyms(spark, folder)[1]).select("template", "rel_id", "syn", F.round("score", 9).alias("score"))


def synonym_blend(spark, folder):
    own = seeds.cutoff(_synonyms(spark, folder)[1])
    return seeds.blend(own, seeds.other_templates(own), 0.7).select("template", "rel_id", "syn", F.round("score", 9).alias("score"))


def _best(spark, folder):
    tp, syn = _synonyms(spark, folder)
    return seeds.best_predicate(tp, seeds.cutoff(syn))


def best_predicate(spark, folder):
    return _best(spark, folder).select("page_id", "obj_xpath", "pred_xpath", "rel_id", F.round("score", 9).alias("score"))


def duplicate_object_prune(spark, folder):
    return seeds.prune_duplicates(_best(spark, folder)).select("page_id", "obj_xpath", "obj_text", F.round("score", 9).alias("score"))


def middle_string_prune(spark, folder):
    """Predicate texts that one and the same other candidate's text stands beside too often."""
    labels = cut(_best(spark, folder)).withColumn("label_id", F.col("pair_id"))
    others = candidates.flat_candidates(pairs(spark, folder, "page_id", "template", "obj_xpath", "obj_text", "features", "pred_candidates")).select("pair_id", F.col("rank").alias("r"), text.clean(F.col("pred_text")).alias("middle"))
    middles = labels.join(others, "pair_id").filter("r <> rank and middle <> ''").select("template", "pred_text", "label_id", "middle")
    return seeds.prune_by_middle(labels.filter("pred_text is not null"), middles).select("page_id", "obj_xpath", "pred_text")


def unlabeled_pairs(spark, folder):
    every = pairs(spark, folder, "page_id", "obj_xpath")
    labelled = _best(spark, folder).select("page_id", "obj_xpath")
    return crowd.unlabelled(every, labelled)


def _flat(spark, folder):
    return candidates.flat_candidates(pairs(spark, folder, "page_id", "template", "obj_xpath", "obj_text", "features", "pred_candidates"))


def similarity_classes(spark, folder):
    return similarity.similarity_classes(_flat(spark, folder)).groupBy("class_id").agg(F.count("*").alias("n_members"), F.sum("n_links").alias("n_links")).groupBy("n_members", "n_links").agg(F.count("*").alias("n_classes"))


def similarity_links(spark, folder):
    """Every candidate row with the size of its style class over all pages of its template and its number of links there."""
    rows = similarity.similarity_classes(_flat(spark, folder))
    sizes = rows.groupBy("class_id").agg(F.count("*").alias("n_members"))
    return rows.join(sizes, "class_id").select("pair_id", "rank", "n_members", "n_links")


def pair_similarity_gated(spark, folder):
    return similarity.page_similarity(_flat(spark, folder), True).select("page_id", "pair_a", "rank_a", "pair_b", "rank_b", F.round("weight", 6).alias("weight"))


def pair_similarity_open(spark, folder):
    return similarity.page_similarity(_flat(spark, folder), False).select("page_id", "pair_a", "rank_a", "pair_b", "rank_b", F.round("weight", 6).alias("weight"))


def undirected_edges(spark, folder):
    return graph.undirected(_edges(spark, folder).select(F.col("source_id").alias("src"), F.col("dest_id").alias("dst")))


def row_normalize(spark, folder):
    e = _edges(spark, folder).groupBy(F.col("source_id").alias("src"), F.col("dest_id").alias("dst")).agg((F.count("*") * 0.4).alias("w"))
    return graph.row_normalized(e).select("src", "dst", F.round("w", 9).alias("w"))


def _seeds(spark, folder):
    """Two classes of nodes: ends of 'genre' edges and ends of 'year' edges."""
    return _edges(spark, folder).filter("edge_type_text in ('genre', 'year')").select(F.when(F.col("edge_type_text") == "genre", "seed").otherwise("not_seed").alias("class"), F.col("dest_id").alias("node")).distinct()


def ppr_fixed_rounds(spark, folder):
    ranks = graph.personalised_pagerank(undirected_edges(spark, folder), _seeds(spark, folder), rounds=4, tolerance=None)
    return ranks.select("class", "node", F.round("r", 9).alias("r"))


def multi_rank_walk(spark, folder):
    return graph.multi_rank_walk(undirected_edges(spark, folder), _seeds(spark, folder), rounds=4, tolerance=None)


def louvain_clusters(spark, folder):
    """The cluster of every unlabelled candidate row: Louvain on each template's gated similarity graph."""
    free = crowd.unlabelled(_flat(spark, folder), _best(spark, folder)).withColumn("seed", F.lit(False))
    return similarity.gated_clusters(free).drop("seed")


def label_encode(spark, folder):
    return classify.label_codes(_flat(spark, folder).select(text.tag_of(F.col("pred_xpath")).alias("tag")), "tag").select("tag", "code")


def max_distance_feature(spark, folder):
    return classify.largest_offset(_flat(spark, folder))


def _vectors(spark, folder):
    flat = _flat(spark, folder)
    tags = flat.select(text.tag_of(F.col("pred_xpath")).alias("tag")).unionByName(flat.select(text.tag_of(F.col("obj_xpath")).alias("tag")))
    return classify.feature_vectors(flat, classify.label_codes(tags, "tag"))


def feature_vector(spark, folder):
    return _vectors(spark, folder).select("pair_id", "rank", *classify.FEATURES)


def nb_predict(spark, folder):
    """Predictions for the unlabelled rows, one model per template and cluster."""
    vectors, best = cut(_vectors(spark, folder)), _best(spark, folder)
    return classify.propagate(cut(_flat(spark, folder)), vectors, cut(best.select("page_id", "obj_xpath", "pred_xpath")))[1]


def new_labels(spark, folder):
    return classify.select_labels(nb_predict(spark, folder), _flat(spark, folder))


def cluster_pairs(spark, folder):
    """Pairs of each template's style class 'same style as the predicate'."""
    files = pages(spark, folder, "file_name", "template").select("page_id", "file_name")
    rows = pairs(spark, folder, "page_id", "obj_xpath", "obj_text").join(files, "page_id")
    return crowd.of_cluster(rows, rows.filter(F.length("obj_text") > 8)).select("pair_id", "file_name", "obj_xpath")


def new_labels_not_in_kb(spark, folder):
    return kb.not_in_kb(_labels(spark, folder), table(spark, folder, "kb_node"), table(spark, folder, "kb_edge"))


def _labels(spark, folder):
    """Labels (topic_id, obj_text, pred_text): facts of candidate rows under their page's best topic."""
    best = topic.best_topic(_scores(spark, folder)).select("page_id", F.col("node_id").alias("topic_id"))
    rows = pairs(spark, folder, "page_id", "obj_text", "pred_candidates").filter("obj_text is not null and size(pred_candidates) > 0").select("page_id", "obj_text", F.lower(F.rtrim(F.regexp_replace(F.col("pred_candidates")[0]["text"], ":", ""))).alias("pred_text"))
    return rows.filter("pred_text is not null").join(best, "page_id").select("topic_id", "obj_text", "pred_text").distinct()


def assign_edge_types(spark, folder):
    return kb.assign_edge_types(_labels(spark, folder), table(spark, folder, "kb_edge_type")).select("pred_text", F.when(~F.col("is_new"), F.col("edge_type_id")).alias("known_id"), "is_new")


def kb_write_back(spark, folder):
    nodes, edges = kb.write_back(_labels(spark, folder), table(spark, folder, "kb_node"), table(spark, folder, "kb_edge"), table(spark, folder, "kb_edge_type"))
    return edges


def crowd_pick_pages(spark, folder):
    members = pairs(spark, folder, "template", "page_id", "obj_text").filter("obj_text is not null").select("template", F.length("obj_text").alias("cluster"), "page_id", "pair_id")
    largest = crowd.largest_cluster(members)
    return crowd.pages_to_show(members.join(largest.select("template", "cluster"), ["template", "cluster"], "left_semi"))


def label_evaluation(spark, folder):
    truth = evaluate.ground_truth(pages(spark, folder, "domain", "template", "ground_truth"))
    homes = pages(spark, folder, "domain", "template")
    labels = pairs(spark, folder, "page_id", "obj_text").filter("obj_text is not null").select("pair_id", "page_id", text.clean(F.col("obj_text")).alias("obj_text")).join(homes, "page_id")
    out = evaluate.scores(evaluate.judged(labels, truth), truth)
    return out.select("template", "domain", "retrieved", "correct", "relevant", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def missed_objects(spark, folder):
    truth = evaluate.ground_truth(pages(spark, folder, "domain", "template", "ground_truth"))
    labels = pairs(spark, folder, "page_id", "obj_text").select("page_id", text.clean(F.col("obj_text")).alias("obj_text"))
    return evaluate.missed(truth, labels)


def xpath_rule_scores(spark, folder):
    """The best path to the heading of each template's pages: all templates in the same jobs, three levels."""
    return xpath_rules.best_paths(pages(spark, folder, "html", "template").filter("page_id is not null"), "h1", deepest=3).orderBy("template")


def events_by_hour(spark, folder):
    return page_stream.event_windows(table(spark, folder, "events")).select("start", "event_type", "n", F.round("total", 6).alias("total"))


def event_sessions(spark, folder):
    return page_stream.user_sessions(table(spark, folder, "events")).select("user_id", "start", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    page_entities, jaccard_topic, topic_frequency_drop, topic_xpath_hints, topic_pass2, topic_meaning, topic_evaluation, selected_templates, candidate_ranks, without_drawn, nearest_predicates, node_neighbours,
    rect_distance, offset_features, middle_nodes, relation_weighted_candidates, redundancy_score, synonym_cutoff, synonym_blend, best_predicate, duplicate_object_prune, middle_string_prune,
    unlabeled_pairs, similarity_classes, pair_similarity_gated, pair_similarity_open, undirected_edges, row_normalize, ppr_fixed_rounds, multi_rank_walk, similarity_links, louvain_clusters,
    label_encode, max_distance_feature, feature_vector, nb_predict, new_labels, cluster_pairs, new_labels_not_in_kb, assign_edge_types, kb_write_back, crowd_pick_pages, label_evaluation,
    missed_objects, xpath_rule_scores, events_by_hour, event_sessions)}

_FLAT = f"with {sql.PAIRS}, fl as (select pair_id, page_id, template, obj_xpath, obj_text, features.dom as obj_dom, unnest(pred_candidates) as p, (unnest(range(len(pred_candidates))) + 1)::int as rank from pairs)"
_BOX = _FLAT + """, fb as (select pair_id, rank, p.features.distances.horizontal as h, p.features.distances.vertical as v from fl),
b as (select pair_id, rank, h.left_left as px, v.up_up as py, h.right_left - h.left_left as pw, v.down_up - v.up_up as ph, 0.0::double as ox, 0.0::double as oy, h.left_left - h.left_right as ow, v.up_up - v.up_down as oh from fb
  where h.left_left + h.left_right + h.right_left + h.right_right + v.up_up + v.up_down + v.down_up + v.down_down is not null)"""
_H, _V = similarity.SIDES["horizontal"], similarity.SIDES["vertical"]


def _ratio(side: str, names: tuple[str, ...]) -> str:
    cells = [f"coalesce(least(abs(a.f.distances.{side}.{s}), abs(b.f.distances.{side}.{t})) + (a.f.distances.{side}.{s} + b.f.distances.{side}.{t}) * 0, 0) / nullif(greatest(abs(a.f.distances.{side}.{s}), abs(b.f.distances.{side}.{t})), 0)" for s in names for t in names]
    return "greatest(" + ", ".join(f"coalesce({c}, 0)" for c in cells) + ")"


_SIM = _FLAT + f""", s as (select pair_id, rank, page_id, obj_xpath, p.node as node, p.features as f, to_json(obj_dom)::varchar as o, to_json(p.features.dom)::varchar as d from fl where p.features is not null),
m as (select a.page_id, a.pair_id as pair_a, a.rank as rank_a, b.pair_id as pair_b, b.rank as rank_b, coalesce(a.o = b.o and a.d = b.d, false) as same,
  case when a.f.graphic.is_above_and_on_left = b.f.graphic.is_above_and_on_left then 1.0 else 0.0 end + {_ratio('horizontal', _H)} + {_ratio('vertical', _V)} as base
  from s a join s b on a.page_id = b.page_id and a.pair_id % 20 = 0 and (a.pair_id <> b.pair_id or a.rank <> b.rank) where not (a.obj_xpath is not distinct from b.obj_xpath and a.node is not distinct from b.node))"""


def _walk(rounds: int) -> str:
    start = """with e0 as (select distinct source_id as src, dest_id as dst from kb_edge where source_id is not null and dest_id is not null),
e as (select src, dst from e0 union select dst, src from e0), n as (select src, dst, 1.0 / count(*) over (partition by src) as w from e),
sd as (select distinct case when edge_type_text = 'genre' then 'seed' else 'not_seed' end as class, dest_id as node from kb_edge where edge_type_text in ('genre', 'year') and dest_id is not null and source_id is not null),
u as (select class, node, 1.0::double / count(*) over (partition by class) as r from sd), r0 as (select * from u)"""
    for k in range(1, rounds + 1):
        start += f""", m{k} as (select class, dst as node, sum(r * w) as m from r{k - 1} join n on node = src group by 1, 2),
l{k} as (select t.class, t.t - coalesce(k.k, 0) as lost from (select class, sum(r) as t from r{k - 1} group by 1) t left join (select class, sum(m) as k from m{k} group by 1) k using (class)),
r{k} as (select class, node, coalesce(m, 0) * 0.85 + coalesce(u.r, 0) * (lost * 0.85 + 0.15) as r from m{k} full join u using (class, node) join l{k} using (class))"""
    return start


_LABELS = _ENTITIES + """, lb as (select distinct top1.node_id as topic_id, obj_text, lower(rtrim(replace(pred_candidates[1].text, ':', ''), ' ')) as pred_text from pairs join top1 using (page_id) where obj_text is not null and len(pred_candidates) > 0 and pred_candidates[1].text is not null)"""
_TRUTH = f"""with {sql.PAIRS}, {sql.PAGES}, g as (select page_id, domain, template, unnest(json_keys(ground_truth)) as k, ground_truth from pages where json_valid(ground_truth)),
t as (select distinct page_id, domain, template, trim(unnest(string_split(k, '|'))) as pred, k, ground_truth from g),
tr as (select distinct page_id, domain, template, pred, unnest(from_json(ground_truth->('$."' || k || '"'), '["varchar"]')) as obj from t)"""

ORACLES: dict[str, str] = {
    "page_entities": _ENTITIES + "select page_id, template, xpath, node_id, k from ent",
    "jaccard_topic": _ENTITIES + "select page_id, node_id, round(score, 9) as score from top1",
    "topic_frequency_drop": _ENTITIES + "select template, topic_text, count(*) as n from tt group by 1, 2 having count(*) >= 3",
    "topic_xpath_hints": _PASS2 + "select template, xpath, hint from hints",
    "topic_pass2": _PASS2 + "select page_id, node_id, round(score, 9) as score from top2",
    "topic_evaluation": _PASS2 + f""", tv as (select page_id, site, {sql.key('topic_text')} as t from pages where topic_text is not null),
        j as (select tv.site, tv.t, tx.topic_text as f from tv left join top2 using (page_id) left join tx using (node_id))
        select site, count(*) as n_truth, count(f) as n_found, count(*) filter (where f = t) as n_right, round(count(*) filter (where f = t) / nullif(count(f), 0)::double, 9) as precision,
          round(count(*) filter (where f = t) / count(*)::double, 9) as recall from j group by grouping sets ((site), ())""",
    "selected_templates": f"with {sql.PAGES} select page_id, template, domain from pages where contains(template, 'hub') or contains(template, 'guide') or contains(domain, 'book')",
    "candidate_ranks": _FLAT + """, r as (select *, row_number() over (partition by pair_id order by p.features.distances.origin_distance, rank) as nearness from fl
        where p.features.graphic.is_above_and_on_left and length(p.text) > 2 and p.features.distances.origin_distance is not null)
        select pair_id, nearness, p.node as pred_xpath, round(p.features.distances.origin_distance, 4) as distance from r where nearness <= 3""",
    "without_drawn": f"""with {sql.PAIRS} select pair_id from pairs where not regexp_matches(obj_xpath, 'svg|noscript')
        and len(list_filter(coalesce(pred_candidates, []), lambda p: coalesce(regexp_matches(p.node, 'svg|noscript'), false))) = 0""",
    "nearest_predicates": f"""with {sql.PAIRS}, r as (select page_id, template, obj_xpath, {sql.key('obj_text')} as term from pairs), t as (select * from r where term <> ''),
        fq as (select template, term, count(distinct page_id) as df from t group by 1, 2), pl as (select page_id, template, obj_xpath, min(term) as term from t group by 1, 2, 3),
        n as (select page_id, term, df, row_number() over (partition by page_id order by obj_xpath) as n from pl join fq using (template, term)),
        m as (select o.page_id, o.n as obj, p.n as pred, row_number() over (partition by o.page_id, o.n order by p.n desc) as rank from n o join n p on o.page_id = p.page_id and p.n < o.n and p.df > o.df and length(p.term) > 2)
        select page_id, obj, pred, rank from m where rank <= 3""",
    "rect_distance": _BOX + """ select pair_id, rank, round(sqrt(pow(greatest(0, px - (ox + ow), ox - (px + pw)), 2) + pow(greatest(0, py - (oy + oh), oy - (py + ph)), 2)), 6) as min_distance,
        round(sqrt(pow(px - ox, 2) + pow((py - oy) * 1.5, 2)), 6) as weighted, round(sqrt(pow((px - ox) / 1024.0, 2) + pow((py - oy) / 768.0 * 1.5, 2)), 6) as scaled, round(abs(py - oy), 6) as vertical,
        px <= ox and py <= oy as above_left, px <= ox + ow and ox <= px + pw and py <= oy + oh and oy <= py + ph as overlap from b""",
    "offset_features": _BOX + """ select pair_id, rank, round(px - ox, 4) as left_left, round(px - ox - ow, 4) as left_right, round(px + pw - ox, 4) as right_left, round(px + pw - ox - ow, 4) as right_right,
        round(py - oy, 4) as up_up, round(py - oy - oh, 4) as up_down, round(py + ph - oy, 4) as down_up, round(py + ph - oy - oh, 4) as down_down, round(sqrt(pow(px - ox, 2) + pow(py - oy, 2)), 4) as origin_distance from b""",
    "middle_nodes": _BOX + """, w as (select pair_id, max(struct_pack(x := ox, y := oy, w := ow, h := oh)) as q from b group by 1)
        select p.pair_id, -p.rank as pred, -m.rank as mid from b p join w on w.pair_id = p.pair_id join b m on m.pair_id = p.pair_id and m.rank < p.rank
        where m.px <= greatest(p.px + p.pw, q.w) and least(p.px, 0) <= m.px + m.pw and m.py <= greatest(p.py + p.ph, q.h) and least(p.py, 0) <= m.py + m.ph""",
    "relation_weighted_candidates": _TP + "select template, page_id, rel_id, obj_id, round(w, 9) as w, n_rel from ent3",
    "redundancy_score": _TP + "select template, rel_id, syn, round(score, 9) as score from sy",
    "synonym_cutoff": _TP + "select template, rel_id, syn, round(score, 9) as score from sc",
    "synonym_blend": _TP + """, o as (select template, rel_id, syn, score, sum(score) over (partition by rel_id, syn) as s, count(*) over (partition by rel_id, syn) as n from sc)
        select template, rel_id, syn, round(score * 0.7 + case when n > 1 then (s - score) / (n - 1) else 0 end * (1 - 0.7::double), 9) as score from o""",
    "best_predicate": _TP + "select page_id, obj_xpath, pred_xpath, rel_id, round(score, 9) as score from bp",
    "duplicate_object_prune": _TP + "select page_id, obj_xpath, obj_text, round(score, 9) as score from (select *, max(score) over (partition by page_id, obj_text) as b from bp) where score >= b * 0.9",
    "middle_string_prune": _TP + """, mi as (select bp.template, bp.pred_text, nr.syn as middle, count(*) as k from bp join nr on nr.pair_id = bp.pair_id and nr.rank <> bp.rank where nr.syn <> '' group by 1, 2, 3),
        nz as (select template, pred_text, count(distinct pair_id) as n from bp where pred_text is not null group by 1, 2), bad as (select distinct template, pred_text from mi join nz using (template, pred_text) where k > n * 0.9)
        select page_id, obj_xpath, pred_text from bp anti join bad using (template, pred_text) where pred_text is not null""",
    "unlabeled_pairs": _TP + "select pair_id, page_id, obj_xpath from pairs anti join bp using (page_id, obj_xpath)",
    "similarity_classes": _FLAT + """, s as (select template, to_json(obj_dom)::varchar as o, to_json(p.features.dom)::varchar as d, obj_xpath, p.node as node from fl where obj_dom is not null and p.features.dom is not null),
        c as (select template, o, d, obj_xpath, node, count(*) as own from s group by all), w as (select template, o, d, sum(own)::bigint as n_members, (sum(own) * sum(own) - sum(own * own))::bigint as n_links from c group by 1, 2, 3)
        select n_members, n_links, count(*) as n_classes from w group by 1, 2""",
    "similarity_links": _FLAT + """, s as (select pair_id, rank, template, to_json(obj_dom)::varchar as o, to_json(p.features.dom)::varchar as d, coalesce(obj_xpath, chr(1)) as x, coalesce(p.node, chr(1)) as n from fl where obj_dom is not null and p.features.dom is not null)
        select pair_id, rank, count(*) over (partition by template, o, d) as n_members, count(*) over (partition by template, o, d) - count(*) over (partition by template, o, d, x, n) as n_links from s""",
    "pair_similarity_gated": _SIM + " select page_id, pair_a, rank_a, pair_b, rank_b, round(base, 6) as weight from m where same and base > 0",
    "pair_similarity_open": _SIM + " select page_id, pair_a, rank_a, pair_b, rank_b, round(base + case when same then 1 else 0 end, 6) as weight from m where base + case when same then 1 else 0 end > 0",
    "undirected_edges": "with e as (select distinct source_id as s, dest_id as d from kb_edge where source_id is not null and dest_id is not null) select src, dst, 1.0::double as w from (select s as src, d as dst from e union select d, s from e)",
    "row_normalize": f"""with {sql.EDGES}, e as (select source_id as src, dest_id as dst, count(*) * 0.4::double as w from edges where source_id is not null and dest_id is not null group by 1, 2)
        select src, dst, round(w / greatest(sum(w) over (partition by src), 1.0), 9) as w from e""",
    "ppr_fixed_rounds": _walk(4) + " select class, node, round(r, 9) as r from r4",
    "multi_rank_walk": _walk(4) + ", k as (select node, class, row_number() over (partition by node order by r desc, (class = 'seed') desc, class desc) as n from r4) select node, class as label from k where n = 1",
    "label_encode": _FLAT + ", t as (select distinct regexp_replace(string_split(p.node, '/')[-1], '\\[.*\\]', '') as tag from fl where p.node is not null) select tag, (row_number() over (order by tag) - 1)::int as code from t",
    "max_distance_feature": _FLAT + " select template, max(greatest(" + ", ".join(f"abs(p.features.distances.{s}.{c})" for s, n in similarity.SIDES.items() for c in n) + ")) as largest from fl where p.features is not null group by 1",
    "feature_vector": _FLAT + f""", tg as (select tag, row_number() over (order by tag) - 1 as code from (select regexp_replace(string_split(p.node, '/')[-1], '\\[.*\\]', '') as tag from fl union select regexp_replace(string_split(obj_xpath, '/')[-1], '\\[.*\\]', '') from fl) where tag is not null)
        select pair_id, rank, coalesce((to_json(obj_dom)::varchar = to_json(p.features.dom)::varchar), false)::int as same_dom, coalesce(p.features.dom_distance, 0) as dom_distance,
          coalesce(least({', '.join(f'p.features.distances.horizontal.{c}' for c in _H)}), 0) as min_h, coalesce(least({', '.join(f'p.features.distances.vertical.{c}' for c in _V)}), 0) as min_v,
          coalesce(p.features.graphic.is_above_and_on_left::int, 0) as above_left, coalesce(a.code, -1)::int as obj_tag, coalesce(b.code, -1)::int as pred_tag
        from fl left join tg a on a.tag = regexp_replace(string_split(obj_xpath, '/')[-1], '\\[.*\\]', '') left join tg b on b.tag = regexp_replace(string_split(p.node, '/')[-1], '\\[.*\\]', '') where p.features is not null""",
    "cluster_pairs": f"""with {sql.PAIRS}, {sql.PAGES}, r as (select pair_id, file_name, obj_xpath, obj_text from pairs join (select page_id, file_name from pages) using (page_id))
        select pair_id, file_name, obj_xpath from r semi join (select file_name, obj_xpath from r where length(obj_text) > 8) using (file_name, obj_xpath)""",
    "new_labels_not_in_kb": _LABELS + """ select topic_id, obj_text, pred_text from lb anti join (select source_id as topic_id, node_text as obj_text, edge_type_text as pred_text from kb_edge join kb_node on dest_id = node_id) using (topic_id, obj_text, pred_text)""",
    "assign_edge_types": _LABELS + """, w as (select distinct pred_text from lb), k as (select edge_type_text as pred_text, min(edge_type_id) as known_id from kb_edge_type group by 1)
        select pred_text, known_id, known_id is null as is_new from w left join k using (pred_text)""",
    "crowd_pick_pages": f"""with {sql.PAIRS}, m as (select template, length(obj_text)::int as cluster, page_id, pair_id from pairs where obj_text is not null),
        z as (select template, cluster, row_number() over (partition by template order by count(*) desc, cluster) as n from m where cluster <> 0 group by 1, 2),
        o as (select template, cluster, page_id, min(pair_id) as pair_id from m semi join (select template, cluster from z where n = 1) using (template, cluster) group by 1, 2, 3)
        select template, cluster, page_id, pair_id from (select *, row_number() over (partition by template, cluster order by page_id) as n from o) where n <= 5""",
    "label_evaluation": _TRUTH + f""", l as (select pair_id, page_id, {sql.clean('obj_text')} as obj_text from pairs where obj_text is not null),
        hit as (select distinct d.page_id, d.obj_text from (select distinct page_id, obj_text from l) d join (select distinct page_id, obj from tr where pred <> 'topic_entity_name') o using (page_id) where {sql.alike('d.obj_text', 'o.obj')}),
        j as (select h.template, h.domain, hit.page_id is not null as ok from l join (select page_id, template, domain from pages) h using (page_id) left join hit using (page_id, obj_text)),
        f as (select template, domain, count(*) as retrieved, count(*) filter (where ok) as correct from j group by grouping sets ((template), (domain), ())),
        w as (select template, domain, count(obj) as relevant from tr group by grouping sets ((template), (domain), ()))
        select f.template, f.domain, retrieved, correct, relevant, round(correct / retrieved::double, 9) as precision, round(correct / relevant::double, 9) as recall,
          round(2 * (correct / retrieved::double) * (correct / relevant::double) / nullif(correct / retrieved::double + correct / relevant::double, 0), 9) as f1
        from f join w on f.template is not distinct from w.template and f.domain is not distinct from w.domain""",
    "missed_objects": _TRUTH + f" select distinct page_id, obj from tr anti join (select page_id, {sql.clean('obj_text')} as obj from pairs) using (page_id, obj)",
    "events_by_hour": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
    "event_sessions": """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as s from events),
        g as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from o) select user_id, min(ts) as start, count(*) as n from g group by user_id, k""",
}
