"""Linkage with knowledge-base nodes and the Gaussian mixture on small fixtures."""

import numpy as np
import pytest

from weblore.llm import entity_linkage as el
from weblore.llm import gaussian_mixture as gm


@pytest.mark.parametrize("a,b,same", [("abcd", "abxd", True), ("abcd", "acbd", True), ("abcd", "abd", True), ("abcd", "abcde", True), ("abcd", "badc", False), ("abc", "abc", True), ("a", "abc", False)])
def test_one_slip(a, b, same):
    assert el.one_slip(a, b) is same and el.one_slip(b, a) is same


def test_names():
    assert el.ordered("Doe, Jane") == "Jane Doe" and el.ordered("(1990)") == "1990" and el.ordered("Foo (North)") == "Foo"
    assert el.folded("Dr. Søren Ängström GmbH") == ["soren", "angstrom"] and el.raw_words("quarry for x a")[0] == "a"


def test_parts_of_a_number_name_no_year():
    assert el.name_keys("(1995)", False) == el.name_keys("1995", True) == [("name", "1995")] != el.name_keys("$19.95", False)


def test_links(spark):
    nodes = spark.createDataFrame([(1, "The Old Mill"), (2, "The Old Mill"), (10, "Jane Doehler"), (11, "1990"), (12, "Jane Doehler"), (13, "Drama"), (14, None), (15, " "), (10, "Jane Doehler")], "node_id long, node_text string")
    edges = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 13), (2, None), (1, 10)], "source_id long, dest_id long")
    pairs = spark.createDataFrame([(1, 100, "Doehler, Jane"), (2, 100, "(1990)"), (3, 100, "Jnae Doehler"), (4, 100, None), (5, 200, "Jane Doehler"), (6, 100, ""), (1, 100, "Doehler, Jane")], "pair_id long, page_id long, obj_text string")
    pages = spark.createDataFrame([(100, "Old Mill, The"), (200, "The Old Mill"), (300, None), (100, "Old Mill, The")], "page_id long, topic_text string")
    got = {(r.src_table, r.rec_id, r.node_id) for r in el.link(pairs, pages, nodes, edges).collect()}
    # page 100 shows two facts of node 1; on page 200 one name of two nodes stays undecided
    assert got == {("webpage", 100, 1), ("candidate_pairs", 1, 10), ("candidate_pairs", 2, 11), ("candidate_pairs", 3, 10)}
    assert el.link(pairs.limit(0), pages, nodes, edges).collect() == []


def test_mixture_finds_separate_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(100 * (i % 4), 5, 8))) for i in range(400)] + [(999, *([None] * 8))]
    df = spark.createDataFrame(rows, "pair_id long, " + ", ".join(f"v{k} double" for k in range(8)))
    model = gm.fit(df)
    assert len(model.weights) == 4 and abs(model.weights.sum() - 1) < 1e-9
    scored = {r.pair_id: r.log_density for r in gm.scored(df, model).collect()}
    assert len(scored) == 401 and all(np.isfinite(v) for v in scored.values())
    assert gm.fit(df.limit(0)) is None
