"""Scalar functions against hand-made and plain Python results."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weblore.functions import nested, text
from weblore.functions.stem import stem, stem_sentence, stemmed


def one(spark, expr, value=None, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw,cleaned", [
    ("A-B\nC", "a b c"), ("  \"Quoted\"; x.  ", "quoted x"), ("naïve café", "nave caf"), ("a\tb\rc", "a b c"), ("x&nbsp;y", "x"), ("", ""), ("$1,234.5", "12345"), (None, None)])
def test_clean(spark, raw, cleaned):
    assert one(spark, text.clean(F.col("v")), raw) == cleaned


@pytest.mark.parametrize("a,b,same", [
    ("job", "Job", False), ("yins restaurant", "restaurant", True), ("abc (x)", "abc (y)", True), ("(a)", "(b)", False), ("", "", False), ("restaurant one", "restaurant two", True), ("abcdefghij", "xyz", False)])
def test_alike(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(text.alike(F.col("a"), F.col("b")).alias("x")).first().x is same


def test_hash_id(spark):
    for v in ("Pulp Fiction", "", "é", "x" * 1000):
        assert one(spark, text.hash_id(F.col("v")), v) == int(hashlib.sha1(v.encode()).hexdigest(), 16) % 10**16


def test_paths(spark):
    assert one(spark, text.ancestor_paths(F.col("v")), "/a/b[2]/c") == ["/a", "/a/b[2]", "/a/b[2]/c"]
    df = spark.createDataFrame([("/a/b/c", "/a/d")], "a string, b string")
    assert df.select(text.dom_distance(F.col("a"), F.col("b")).alias("x")).first().x == 3
    assert one(spark, text.tag_of(F.col("v")), "/a/td[3]") == "td"


def test_small_functions(spark):
    assert one(spark, text.insert_after(F.col("v"), F.lit("<head>"), F.lit("!")), "a<head>b") == "a<head>!b"
    assert one(spark, text.insert_after(F.col("v"), F.lit("zz"), F.lit("!")), "ab") == "ab"
    assert one(spark, text.first_number(F.col("v")), "13.5px") == "13" and one(spark, text.first_number(F.col("v")), "px") is None
    assert [one(spark, text.truth(F.col("v")), v) for v in ("yes", "Yes", "TRUE", "0")] == [True, False, True, False]
    assert [one(spark, text.duration_text(F.col("v")), v, "v long") for v in (-1, 5, 65, 3700, 90061)] == ["-", "5s", "1m:5s", "1h:1m:40s", "1d:1h:1m:1s"]
    assert [one(spark, text.short_number(F.col("v")), v, "v long") for v in (9999, 12345)] == ["9999", "12,345"]


def test_nested_helpers(spark):
    m = {"a": 1.0, "b": 3.0, "c": 3.0}
    schema = "v map<string,double>"
    assert one(spark, nested.key_of_largest(F.col("v")), m, schema) == "b"
    assert one(spark, nested.keys_by_value(F.col("v"), F.lit(3.0)), m, schema) == ["b", "c"]
    assert one(spark, nested.merged(F.col("v"), F.create_map(F.lit("a"), F.lit(9.0))), m, schema)["a"] == 9.0
    assert one(spark, nested.map_values(F.col("v"), lambda v: v * 2, F.upper), m, schema) == {"A": 2.0, "B": 6.0, "C": 6.0}


@pytest.mark.parametrize("word,expected", [("running", "run"), ("happily", "happili"), ("generously", "generous"), ("skies", "sky"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("by", "by"), ("inning", "inning")])
def test_stem(word, expected):
    assert stem(word) == expected


def test_stemmed_column(spark):
    assert one(spark, stemmed(F.col("v")), "directed movies") == stem_sentence("directed movies") == "direct movi"
    assert one(spark, stemmed(F.col("v")), None) is None
