"""Operators on micro fixtures: pages, graphs, geometry, nested records, sources and sinks."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblore.operators import classify, crowd, graph, kb, layout, nested, seeds, similarity, topic, xpath_rules
from weblore.plans import nested_queries, stage_queries
from weblore.sources import html_nodes, loaders, stage_store
from weblore.streaming import page_stream

PAGE = "<html><head><style>x</style></head><body><p>one<p>two <b>bold</b> tail<ul><li>a<li>b</ul><table><tr><td>N/A<td>N/A</table><!-- c --><br>end"


def test_tree(spark):
    nodes = {n["xpath"]: n for n in html_nodes.parse(PAGE)}
    assert nodes["/html/body/p[2]/b"]["text"] == "bold" and nodes["/html/body/p[2]/b"]["tail"] == " tail"
    assert "/html/body/ul/li[2]" in nodes and "/html/body/table/tr/td[2]" in nodes and nodes["/html/body/br"]["tail"] == "end"
    assert nodes["/html/body/table/tr/td[1]"]["subtree_hash"] == nodes["/html/body/table/tr/td[2]"]["subtree_hash"]
    df = html_nodes.nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain < text & more")], "page_id long, html string"))
    assert {r.text for r in html_nodes.text_strings(df).collect()} == {"one", "two", "bold", "tail", "N/A", "end"}
    assert {r.tag for r in html_nodes.text_nodes(df).collect()} == {"p", "b", "li", "td"}
    anchors = df.filter("xpath = '/html/body/p[2]/b'").select("page_id", F.col("ord").alias("anchor"))
    assert html_nodes.before(df, anchors, True).filter("back = 1").first().tag == "p"


def test_nested_records(spark):
    pairs = [{"xpath": "/a", "obj_text": "x", "pred_candidates": {"node": "/p", "text": "P", "score": "1"}}, {"xpath": "/b"}]
    entities = {"1": {"text": "e", "related_objs": {"2": {"obj_text": "o", "rel_types": {"9": "r"}}, "3": {"rel_types": {}}}}, "4": {}}
    rows = [
        (1, json.dumps(pairs), json.dumps({"/a": {"pred": "/p"}}), json.dumps(json.dumps(entities))), (1, json.dumps(pairs), json.dumps({"/a": {"pred": "/p"}}), json.dumps(json.dumps(entities))),
        (2, '[{"xpath": "/a"', None, "{}"), (3, "null", "[]", '"broken'), (4, "", "{'a': 1}", "7"),
    ]
    df = spark.createDataFrame(rows, "page_id long, candidate_pairs string, seed_labels string, page_entities string").withColumn("text", F.lit("clash"))
    got = {tuple(r)[1:] for r in nested.leaf_rows(df).collect()}
    assert got == {
        ("candidate_pairs", "/a", "/p", ""), ("candidate_pairs", "/b", "", ""), ("seed_labels", "/a", "/p", ""),
        ("page_entities", "1", "2", "9"), ("page_entities", "1", "3", ""), ("page_entities", "4", "", "")}
    assert [r.text for r in nested.flatten(df, ("candidate_pairs",), 2).collect()] == ["P"]
    assert nested.leaf_rows(df.limit(0)).collect() == []


def test_nested_fields(spark, tmp_path):
    dom = {"font_size": "12", "color": None}
    pred = {"node": "/p", "text": "P", "features": {"dom": dom, "distances": {"horizontal": {"left_left": "-3.5", "left_right": "?"}, "origin_distance": 7}, "graphic": {"is_above_and_on_left": True}, "dom_distance": 4}}
    rows = [(1, json.dumps({"/a": {"obj_text": "x", "features": {"dom": dom}, "pred_candidates": [pred, {"node": "/q"}]}}), json.dumps({"/a": {"pred": "/p", "obj_id": 77}}), json.dumps({"5": {"text": "e", "xpaths": ["/a", "/b"]}, "6": {"xpaths": "/c"}, "7": {}})),
            (2, "broken", None, "[]")]
    spark.createDataFrame(rows, "page_id long, candidate_pairs string, seed_labels string, page_entities string").write.parquet(str(tmp_path / "webpage.parquet"))
    run = lambda name: nested_queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert [(r.obj_xpath, r.dom_font_size, r.dom_color) for r in run("p4_pairs")] == [("/a", "12", None)]
    got = {r.child_key if "child_key" in r.asDict() else r.node: r for r in run("p4_pred_candidates")}
    assert set(got) == {"/p", "/q"} and got["/q"].dom_distance is None and got["/q"].dom_font_size is None
    p = got["/p"]
    assert (p.distances_horizontal_left_left, p.distances_horizontal_left_right, p.distances_origin_distance, p.graphic_is_above_and_on_left, p.dom_distance) == (-3.5, None, 7.0, True, 4)
    assert [r.obj_id for r in run("p4_labels")] == ["77"]
    assert {(r.entity_id, r.xpath) for r in run("p4_entity_places")} == {("5", "/a"), ("5", "/b"), ("6", "/c")}


def test_knowledge_base(spark):
    nodes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (2, "B"), (4, None)], "node_id long, node_text string")
    edges = spark.createDataFrame([(1, 2, 7, "likes"), (1, 2, 8, "knows"), (1, 9, 7, "likes"), (1, 2, 7, "likes")], "source_id long, dest_id long, edge_type_id long, edge_type_text string")
    kinds = spark.createDataFrame([(7, "likes"), (8, "knows")], "edge_type_id long, edge_type_text string")
    assert kb.valid_edges(edges, nodes).count() == 2
    related = kb.related_objects(nodes, edges.filter("dest_id = 2"), nodes).filter("node_id = 1").collect()
    assert len(related) == 1 and related[0].rel_types == {7: "likes", 8: "knows"}
    labels = spark.createDataFrame([(1, "B", "likes"), (1, "C", "likes"), (1, "C", "new"), (5, "C", "new"), (1, None, "likes")], "topic_id long, obj_text string, pred_text string")
    new_nodes, new_edges = kb.write_back(labels, nodes, edges, kinds)
    assert [r.node_text for r in new_nodes.collect()] == ["C"] and new_edges.count() == 3
    assert {r.edge_type_id for r in new_edges.collect()} == {7, 9}
    found = kb.search_phrase(spark.createDataFrame([("mill house",), ("x",), (None,), ("",)], "text string"), spark.createDataFrame([(1, "The Mill House"), (2, "Mill of House")], "node_id long, node_text string"))
    assert [r.node_id for r in found.collect()] == [1]


def test_topic(spark):
    entities = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 11)], "page_id long, node_id long")
    edges = spark.createDataFrame([(10, 11), (10, 12), (11, 99)], "source_id long, dest_id long")
    best = {r.page_id: (r.node_id, r.score) for r in topic.best_topic(topic.jaccard_scores(entities, edges)).collect()}
    assert best == {1: (10, 2 / 3), 2: (11, 0.0)}


def test_walk_keeps_mass_and_labels(spark):
    e = [(1, 2), (3, 2), (2, 4), (5, 2), (5, 4), (6, 4)]
    edges = graph.undirected(spark.createDataFrame(e, "src long, dst long"))
    seeds_ = spark.createDataFrame([("seed", 1), ("seed", 3), ("seed", 6), ("not_seed", 5)], "class string, node long")
    ranks = graph.personalised_pagerank(edges, seeds_, rounds=6, tolerance=None)
    assert all(abs(r.s - 1) < 1e-9 for r in ranks.groupBy("class").agg(F.sum("r").alias("s")).collect())
    labels = {r.node: r.label for r in graph.multi_rank_walk(edges, seeds_, rounds=6, tolerance=None).collect()}
    assert labels[5] == "not_seed" and labels[1] == "seed"
    alone = graph.personalised_pagerank(edges.limit(0), seeds_.filter("class = 'seed'"), rounds=2, tolerance=None)
    assert abs(alone.agg(F.sum("r")).first()[0] - 1) < 1e-9


def test_louvain():
    ring = [(a, b, 1.0) for g in (0, 10, 20) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10, 0.1), (14, 20, 0.1)]
    found = graph.louvain(ring, [*range(0, 5), *range(10, 15), *range(20, 25), 99])
    assert len(set(found.values())) == 4 and found[99] == 99 and found[0] == found[4] and found[10] == found[14]


STYLE = "font string"
FLAT = (f"template string, page_id long, pair_id long, rank int, obj_xpath string, pred_xpath string, obj_text string, pred_text string, obj_dom struct<{STYLE}>, "
        f"f struct<dom:struct<font:string>,distances:struct<horizontal:struct<left_left:double,left_right:double,right_left:double,right_right:double>,"
        "vertical:struct<up_up:double,up_down:double,down_up:double,down_down:double>>,graphic:struct<is_above_and_on_left:boolean>,dom_distance:int>").replace("font string", "font:string")


def candidate(pair, page, font, offsets, above=True, rank=1, obj="/o", pred="/p"):
    h, v = tuple(offsets[:4]), tuple(offsets[4:])
    return ("t", page, pair, rank, obj, pred, "o", "p", (font,) if font else None, ((font,) if font else None, (h, v), (above,), 2))


def brute_similarity(a, b):
    if not a[8] or a[8] != b[8] or a[4:6] == b[4:6]:
        return 0.0
    out = float(a[9][2] == b[9][2])
    for x, y in zip(a[9][1], b[9][1]):
        out += max(min(abs(p), abs(q)) / max(abs(p), abs(q)) if p or q else 0.0 for p in x if p is not None for q in y if q is not None)
    return out


@pytest.mark.parametrize("kept", [similarity.KEPT_ROWS, 3])
def test_clusters_equal_louvain_on_the_whole_gated_graph(spark, monkeypatch, kept):
    monkeypatch.setattr(similarity, "KEPT_ROWS", kept)
    draw = random.Random(5)
    rows = []
    for i in range(60):
        near = draw.choice([1, 40, 900])
        offsets = [near * draw.uniform(0.9, 1.1) for _ in range(8)]
        offsets[i % 8] = None if i % 13 == 0 else offsets[i % 8]
        rows.append(candidate(i, i % 7, "ab"[i % 2], offsets, near != 40, obj=f"/o{i % 5}", pred=f"/p{i % 3}"))
    rows.append(candidate(60, 1, None, [0.0] * 8))
    edges = [(i, j, w) for i in range(61) for j in range(i) if (w := brute_similarity(rows[i], rows[j])) > 0]
    want = graph.louvain(edges, list(range(61)))
    numbers = {c: k for k, c in enumerate(sorted(set(want.values())))}
    got = {r.pair_id: r.cluster for r in similarity.gated_clusters(spark.createDataFrame(rows, FLAT).withColumn("seed", F.lit(False))).collect()}
    assert got == {n: numbers[c] for n, c in want.items()}
    assert 3 < len(numbers) < 20


def test_labels_come_from_the_own_clusters_model(spark):
    near, far = [-10.0] * 4 + [-20.0, -21.0, -22.0, -23.0], [-500.0] * 4 + [-1.0, -2.0, -3.0, -4.0]
    rows = []
    for i in range(12):  # layout a: the upper candidate is right; layout b: the lower one; layout c has no seed
        for k, font in enumerate("abc"):
            pair = 10 * i + k
            good, bad = (near, far) if font == "a" else (far, near)
            rows += [candidate(pair, i, font, [x + i * 0.01 for x in good], True, 1, f"/{font}{i}/td", f"/{font}{i}/th"), candidate(pair, i, font, [x + i * 0.01 for x in bad], True, 2, f"/{font}{i}/td", f"/{font}{i}/b")]
    rows.append(candidate(999, 0, "only a seed", near, obj="/x/td", pred="/x/th"))
    flat = spark.createDataFrame(rows, FLAT)
    tags = classify.label_codes(spark.createDataFrame([("td",), ("th",), ("b",)], "tag string"), "tag")
    chosen = flat.filter("page_id < 6 and rank = 1 and obj_dom.font <> 'c'").select("page_id", "obj_xpath", "pred_xpath")
    clusters, predicted = classify.propagate(flat, classify.feature_vectors(flat, tags), chosen)
    assert {(r.pair_id // 10, r.pair_id % 10) for r in clusters.collect()} == {(i, k) for i in range(12) for k in range(3) if i >= 6 or k == 2}
    assert {(r.pair_id, r.rank) for r in predicted.filter("label = 1").collect()} >= {(10 * i + k, 1) for i in range(6, 12) for k in (0, 1)}
    assert not [r for r in predicted.collect() if r.pair_id % 10 == 2]


def test_edge_list(spark):
    lines = spark.createDataFrame([("# c",), ("5 6",), ("7 5 0.5",), ("",)], "value string")
    assert {tuple(r) for r in graph.read_edges(lines).collect()} == {(0, 1, 1.0), (2, 0, 0.5)}
    with pytest.raises(Exception, match="negative"):
        graph.read_edges(spark.createDataFrame([("-1 2",)], "value string")).collect()


def test_geometry(spark):
    df = spark.range(1).select(layout.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("a"), layout.box(F.lit(13), F.lit(14), F.lit(5), F.lit(5)).alias("b"))
    r = df.select(layout.rectangle_distance(F.col("a"), F.col("b")).alias("d"), layout.above_left(F.col("a"), F.col("b")).alias("l"), layout.overlap(F.col("a"), F.col("b")).alias("o")).first()
    assert (r.d, r.l, r.o) == (5.0, True, False)


def test_seeds(spark):
    rows = [("t", p, 7, p, 1.0, "year", "/y", "Year", 1, 0.1, f"/o{p}", "x") for p in range(3)] + [("t", 9, 8, 9, 1.0, "rare", "/r", "Rare", 1, 0.1, "/o9", "x")]
    pairs = spark.createDataFrame(rows, "template string, page_id long, rel_id long, obj_id long, w double, syn string, pred_xpath string, pred_text string, rank int, distance double, obj_xpath string, obj_text string")
    entries = seeds.relation_entries(pairs)
    synonyms = seeds.cutoff(seeds.redundancy(pairs, entries))
    assert [(r.syn, r.score) for r in synonyms.collect()] == [("year", 1.0)]
    assert seeds.best_predicate(pairs, synonyms).count() == 3


def test_crowd(spark):
    members = spark.createDataFrame([("t", c, p, p) for c, n in ((0, 9), (1, 7), (2, 7)) for p in range(n)], "template string, cluster int, page_id long, pair_id long")
    assert [(r.cluster, r["size"]) for r in crowd.largest_cluster(members).collect()] == [(1, 7)]
    assert crowd.pages_to_show(members).count() == 15


def test_rules(spark):
    pages = spark.createDataFrame([(i, f"<html><body><div class='a'><b>{i}</b></div><div><b>x</b></div></body></html>") for i in range(3)], "page_id long, html string")
    nodes = html_nodes.nodes(pages)
    targets = nodes.filter("xpath = '/html/body/div[1]/b'").select("page_id", "ord")
    best = xpath_rules.induce(nodes, targets)[0]
    assert best[1:3] == (1.0, 1.0) and "class" in best[0]


def test_rules_of_all_templates(spark):
    rows = [
        ("exact", "<html><body id='*'><div class='a'><h1>{n}</h1></div><div class='a'><b>x</b></div></body></html>"), ("exact", "<p>no heading {n}</p><h2 class='a'>y</h2>"),
        ("twice", "<div><h1 class='k'>{n}</h1><h1>Same</h1></div><h1 class='k'>x</h1>"), ("twice", "<div id='{n}'><h1 class='k'>Same</h1></div>"),
        ("twice", "<div><div><i>1</i></div><h1 class='k'>x</h1></div>"), ("rest", "<div class='b'><section><h1 id='t'>Same</h1></section></div><section><h1>{n}</h1></section>"),
        ("rest", "<section class='c'><b id='t'>Same</b></section>"), ("rest", "<section id='t'>cut off"),
        (None, "<ul><li>a<li><h1>{n}"), (None, "text only"), (None, ""), (None, None), ("none", "<p>a</p>"),
        ("many", "<div><h1>{n}</h1><h1>{n}</h1></div>")]
    pages = spark.createDataFrame([(i, t, html and html.format(n=i)) for i, (t, html) in enumerate(rows * 3)], "page_id long, template string, html string")
    found = {r.template: tuple(r)[1:] for r in xpath_rules.best_paths(pages, "h1").collect()}
    expected = {}
    for t in {t for t, _ in rows}:
        nodes = html_nodes.nodes(pages.filter(F.col("template").eqNullSafe(F.lit(t))))
        for best in xpath_rules.induce(nodes, nodes.filter("tag = 'h1'").groupBy("page_id").agg(F.min("ord").alias("ord")))[:1]:
            expected[t] = best
    assert found == expected and set(found) == {"exact", "twice", "rest", "many", None}
    assert found["twice"][1] == 1.0 and "div/" in found["twice"][0] and found["many"][1] == 0.5


def test_rule_counts_do_not_depend_on_batches(monkeypatch):
    rows = [([1, 2, 0, 7, 1, 1], 3), ([], 2), ([5, 1, 0, 6, 4, 0], 1), ([7, 1, 1], 9)]
    rules = np.array(xpath_rules._rules(3, 3), np.int64)
    whole = [c.tolist() for c in xpath_rules._count(rows, rules)]
    assert whole[3][0] == 15 and [c[-1] for c in whole] == [12, 12, 12, 12, 1] and [c[1] for c in whole] == [3 * 3 + 1 + 9, 12, 12, 13, 3]
    monkeypatch.setattr(xpath_rules, "CHUNK", 1)
    assert [c.tolist() for c in xpath_rules._count(rows, rules)] == whole


def test_rules_need_no_job_for_a_template(spark, tmp_path):
    def jobs(templates: int) -> int:
        rows = [(i, f"t{i}", f"<body><h1>{i}</h1><p>x</p></body>") for i in range(templates)]
        spark.createDataFrame(rows, "page_id long, template string, html string").coalesce(1).write.parquet(f"{tmp_path}/{templates}/webpage.parquet")
        spark.sparkContext.setJobGroup(f"rules-{templates}", "")
        assert stage_queries.xpath_rule_scores(spark, f"{tmp_path}/{templates}").count() == templates
        spark.sparkContext.setJobGroup("other", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rules-{templates}"))

    assert jobs(6) <= jobs(2) + 2


def test_loaders(spark, tmp_path):
    (tmp_path / "movie-imdb").mkdir()
    for n in range(3):
        (tmp_path / "movie-imdb" / f"{n}.htm").write_text(f"<base href='http://x/{n}'><html><head></head>{n}</html>")
    (tmp_path / "notes.json").write_text(json.dumps({"0.htm": {"topic_entity_name": ["A"], "cast|actor": ["B C"]}, "1.htm": {"cast": ["D"]}}))
    notes = loaders.annotations(spark, str(tmp_path / "notes.json"))
    assert {r.pred for r in notes.filter("file_name = '0.htm'").collect()} == {"topic_entity_name", "cast", "actor"}
    out = loaders.annotated_pages(loaders.page_files(spark, str(tmp_path)), notes, "movie", ["imdb"]).collect()
    assert [(r.url, r.template, r.file_name) for r in out] == [("http://x/0", "movie-imdb", "0.htm")]
    (tmp_path / "facts.tsv").write_text("Foo\tlikes\tBar\nFoo\tLikes\tBaz\nshort\n")
    nodes, edges, kinds = loaders.hashed_kb(loaders.tab_facts(spark, str(tmp_path / "facts.tsv")))
    assert (nodes.count(), edges.count(), kinds.count()) == (3, 2, 1)


def test_stage_store(spark, tmp_path):
    store = stage_store.StageStore(spark, str(tmp_path / "s"))
    store.save(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), "x")
    store.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), "x", "id")
    assert {tuple(r) for r in store.load("x").select("id", "v").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    store.delete("x", F.col("id") == 1)
    assert store.find("x", id=2).count() == 1 and store.load("x").count() == 2
    store.unset("x", "v")
    assert store.load("x").columns == ["id"]
    store.drop("x")
    assert not store.has("x")


def test_stream(spark, tmp_path):
    pages = spark.createDataFrame([(1, "t", "Some text", "2024-01-01 00:00:00"), (1, "t", "Some text", "2024-01-01 01:00:00"), (2, "t", "some-text", "2024-01-01 02:00:00")], "page_id long, template string, text string, at string").withColumn("loaded_at", F.to_timestamp("at")).drop("at")
    pages.write.parquet(str(tmp_path / "in"))
    stream = page_stream.arriving_term_frequency(page_stream.read_pages(spark, str(tmp_path / "in"), pages.schema.simpleString()[7:-1].replace(":", " ")))
    q = stream.writeStream.format("memory").queryName("tf").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.term, r.df) for r in spark.table("tf").collect()] == [("some text", 2)]
