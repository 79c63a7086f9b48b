"""Document frequency of terms per template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblore.functions.stem import stemmed
from weblore.functions.text import clean


def page_terms(strings: DataFrame, stems: bool = False) -> DataFrame:
    """Distinct (template, page_id, term) of (template, page_id, text): cleaned, empty ones dropped.

    stems: words by their stems; the distinct cleaned texts are stemmed, not each occurrence.
    """
    terms = strings.select("template", "page_id", clean(F.col("text")).alias("term")).filter("term <> ''").distinct()
    return terms.select("template", "page_id", stemmed(F.col("term")).alias("term")).distinct() if stems else terms


def term_frequency(terms: DataFrame) -> DataFrame:
    """(template, term, df): pages of the template that hold the term."""
    return terms.groupBy("template", "term").agg(F.count("*").alias("df"))


def template_stats(frequency: DataFrame, pages: DataFrame) -> DataFrame:
    """(template, n_pages, term_count, different_terms); templates without terms have zeros."""
    sizes = pages.select("template", "page_id").distinct().groupBy("template").agg(F.count("*").alias("n_pages"))
    sums = frequency.groupBy("template").agg(F.sum("df").alias("term_count"), F.count("*").alias("different_terms"))
    return sizes.join(sums, "template", "left").fillna(0, ["term_count", "different_terms"])


def normalized(nodes: DataFrame, frequency: DataFrame, pages: DataFrame) -> DataFrame:
    """nodes (template, …, term) with freq: share of the template's pages; unknown terms 0, unknown templates null."""
    sizes = pages.select("template", "page_id").distinct().groupBy("template").agg(F.count("*").alias("n_pages"))
    shares = frequency.join(sizes, "template").select("template", "term", (F.col("df") / F.col("n_pages")).alias("share"))
    known = sizes.select("template", F.lit(True).alias("known"))
    return nodes.join(shares, ["template", "term"], "left").join(known, "template", "left").withColumn(
        "freq", F.when(F.col("known"), F.coalesce("share", F.lit(0.0)))).drop("share", "known")


def without_common(nodes: DataFrame, below: float = 0.50, least_length: int = 3) -> DataFrame:
    """Nodes of at least least_length characters whose freq lies below the threshold."""
    return nodes.filter((F.length("term") >= least_length) & (F.col("freq") < below))
