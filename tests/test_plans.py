"""Every registered query against its SQL on the smallest tables, and the stages end to end."""

import json
import math
import os

import pytest

import __spark_entry__ as entry
from weblore.plans import pipeline
from weblore.sources.stage_store import StageStore

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.project(",".join(f'"{c}"' for c in columns)).fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stages(spark, tmp_path):
    facts = {1: ("Alpha", "Jane Doe", "1990"), 2: ("Beta", "John Roe", "1991"), 3: ("Gamma", "Ann Poe", "1992"), 4: ("Delta", "Jim Low", "1993")}
    html = "<html><body><h1>{}</h1><div><b>Director</b><span>{}</span></div><div><b>Year</b><span>{}</span></div></body></html>"
    pages = spark.createDataFrame([(i, "movie-x", "movie", html.format(*f), f[0]) for i, f in facts.items()] + [(9, "movie-x", "movie", None, None)], "page_id long, template string, domain string, html string, topic_text string")
    nodes = [(i * 10 + k, t) for i, f in facts.items() for k, t in enumerate(f)]
    edges = [(i * 10, i * 10 + k, k, r) for i in facts for k, r in ((1, "directed by"), (2, "year"))]
    store = StageStore(spark, str(tmp_path / "stages"))
    pipeline.run(store, pages, spark.createDataFrame(nodes, "node_id long, node_text string"), spark.createDataFrame(edges, "source_id long, dest_id long, edge_type_id long, edge_type_text string"))
    assert {(r.page_id, r.node_id) for r in store.load("topics").collect()} == {(i, i * 10) for i in facts}
    got = {(r.page_id, r.obj_text, r.pred_text) for r in store.load("seed_labels").collect()}
    assert {(i, f[1], "Director") for i, f in facts.items()} <= got


def test_stages_after_the_seed_labels(spark, tmp_path):
    names = [f"{a} {b}" for a in ("jane", "john", "mary", "carl") for b in ("doehler", "rower", "poelman")]
    titles = "alpha beta gamma delta epsilon zeta theta kappa lambda omicron sigma omega".split()
    html = "<html><body><h1>{}</h1><div class='row'><b>Director</b><span>{}</span></div><div class='row'><i>Writer</i><em>{}</em></div></body></html>"
    truth = [json.dumps({"topic_entity_name": [t], "director": [n]}) for t, n in zip(titles, names)]
    rows = [(i, "movie-x", "movie", html.format(t, names[i], names[-1 - i] + " jr"), t, truth[i]) for i, t in enumerate(titles)]
    pages = spark.createDataFrame(rows, "page_id long, template string, domain string, html string, topic_text string, ground_truth string")
    # the director of the last six films is not known, but their year is
    nodes = [(i, t) for i, t in enumerate(titles)] + [(100 + i, n) for i, n in enumerate(names[:6])]
    nodes = spark.createDataFrame(nodes, "node_id long, node_text string")
    edges = spark.createDataFrame([(i, 100 + i, 7, "director") for i in range(6)], "source_id long, dest_id long, edge_type_id long, edge_type_text string")
    store = StageStore(spark, str(tmp_path / "stages"))
    written = pipeline.run(store, pages, nodes, edges)
    assert {"topic_evaluation", "clusters", "new_labels", "label_evaluation", "new_nodes", "new_edges", "crowd_pairs"} <= set(written)
    assert {(r.page_id, r.obj_text) for r in store.load("seed_labels").collect()} == {(i, names[i]) for i in range(6)}
    assert not {t for t in titles} & {r.obj_text for r in store.load("candidate_pairs").collect()}
    new = {(r.page_id, r.obj_text, r.pred_text) for r in store.load("new_labels").collect()}
    assert {(i, names[i], "Director") for i in range(6, 12)} <= new
    assert {(r.source_id, r.edge_type_id) for r in store.load("new_edges").filter("edge_type_text = 'director'").collect()} >= {(i, 7) for i in range(6, 12)}
    assert {r.node_text for r in store.load("new_nodes").collect()} >= set(names[6:])
    whole = store.load("label_evaluation").filter("template is null and domain is null").first()
    assert whole.correct == 6 and whole.retrieved == len(new)
    assert store.load("topic_evaluation").filter("site is null").first().n_right == 12
