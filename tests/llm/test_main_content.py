"""Main body of pages on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from weblore.llm import main_content

LINES = ["<html>", "<body class='z'>", "<div class='n'><ul>", "<li><a href='/0'>Home</a></li>", "<li><a href='/1'>Help</a></li>", "</ul></div>", "<div id='m'>", "<h1>{t}</h1>",
         "<p>The long story of {t} begins near the quiet river {w} in the north.</p>", "<dl>", "<dt>Year</dt><dd>19{i}</dd>", "</dl>",
         "<div>All these pages come without any kind of warranty at all</div>", "</div>", "<div class='f'>", "<h4><a href='/e/{i}'>Other Entry Title</a></h4>", "Home &middot; Help &copy; 2020", "</div>", "</body>"]


def pages(spark, n):
    rows = []
    for i in range(10, 10 + n):
        title = f"Title {chr(97 + i % 26)}{chr(97 + i // 26)}x"
        rows.append((i, "t", "\n".join(LINES).format(t=title, i=i, w=title[-3:] + 'ish'), f'{{"topic_entity_name": ["{title.lower()}"], "year": ["19{i}"]}}'))
    rows += [(1, "t", None, None), (2, "t", "", "broken"), (3, "t", "no body", None), rows[0]]
    return spark.createDataFrame(rows, "page_id long, template string, html string, ground_truth string").withColumn("line_no", F.lit(7))


def test_main_lines(spark):
    df = pages(spark, 60)
    found = {}
    for r in main_content.main_lines(df).collect():
        found.setdefault(r.page_id, set()).add(r.line_no)
    assert set(found) == set(range(10, 70))
    assert {tuple(sorted(v)) for v in found.values()} == {(8, 9, 11)}
    texts = {r.page_id: r.main_text for r in main_content.main_text(df).collect()}
    assert len(texts) == 60 and "warranty" not in texts[10] and "Year1910" in texts[10]


def test_empty_table(spark):
    assert main_content.main_lines(pages(spark, 1).limit(0)).collect() == []


def test_every_page_trains(spark):
    """Pages behind the first 1,500 by hash of page_id count as well: two main nodes each, two or four of furniture."""
    first = ["<body>", "<div>", "<h1>Title</h1>", "</div>", "<ul>", "<li><a href='/0'>Home</a></li>"]
    ids = [r.page_id for r in spark.range(1600).withColumnRenamed("id", "page_id").orderBy(F.xxhash64("page_id")).collect()]
    rows = [(i, "t", "\n".join([*first, *(["<li><a href='/1'>Help</a></li>"] * 2 if k >= 1500 else []), "</ul>", "</body>"]), None) for k, i in enumerate(ids)]
    df = spark.createDataFrame([*rows, *rows[-50:]], "page_id long, template string, html string, ground_truth string")
    assert abs(main_content.train(df).base - np.log(3200 / 3400)) < 1e-12


def test_lines_repeated_on_any_page_are_furniture(spark):
    """A notice on a tenth of all pages, on none of the first 10,000 by hash."""
    ids = [r.page_id for r in spark.range(11200).withColumnRenamed("id", "page_id").orderBy(F.xxhash64("page_id")).collect()]
    page = "<body>\n<div>\n<h1>Title</h1>\n{}\n</div>\n</body>"
    notice = "<p>This whole notice stands on many of the pages</p>"
    rows = [(i, "t", page.format(notice if k >= 10000 else ""), None) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id long, template string, html string, ground_truth string")
    found = main_content.main_lines(df).groupBy("line_no").count().collect()
    assert {r.line_no: r["count"] for r in found} == {3: 11200}


def test_stored_trees_have_the_nodes_of_the_pages(spark):
    """Every page once, with the features that its html gives; a page without id keeps its lines."""
    df = pages(spark, 5)
    other = df.filter("page_id = 12").withColumn("html", F.concat("html", F.lit("\n<p>More</p>")))
    df = df.unionByName(other).unionByName(df.filter("page_id = 13").withColumn("page_id", F.lit(None).cast("long")))
    trees = main_content.page_trees(df)
    stored = sorted(trees.collect(), key=lambda r: (r.page_id is None, r.page_id, len(r.nodes)))
    assert [r.page_id for r in stored] == [3, 10, 11, 12, 12, 13, 14, None]
    got = main_content.features(main_content._unpacked([r.nodes for r in stored if r.page_id in (10, 11)])[0])[0]
    html = {r.page_id: r.html for r in df.filter("page_id in (10, 11)").collect()}
    assert np.array_equal(got, main_content.features(main_content._read(sorted(html.items()))[0])[0])
    assert all(len(r.hashed) == len(r.wordings) == 2 for r in stored if r.page_id == 10)
    found = {(r.page_id, r.line_no) for r in main_content.main_lines(df).collect()}
    assert {n for i, n in found if i is None} == {n for i, n in found if i == 13} != set()
