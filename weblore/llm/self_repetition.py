"""Problem 10: the share of a document's words that repeat inside it.

Words become integers and whole batches of documents are measured with array operations.
Thresholds come from one mergeable quantile sketch per (language, source); sketches of small
groups are replaced by their language's merged sketch. The sketches are a few KB each and are
joined back to the documents on (language, source), nothing is collected.

Where a fixed share must be found whole, a group whose quantile lies above it is filtered at the
sketch's own value next below that share instead; an exact check of the filtered rows follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblore.session import cut

WINDOW, PHRASE = 6, 5  # longer directly repeated phrases are repeated windows
MAX_SHARE, STEPS = 0.30, 100
SLICE_CHARS = 2_000_000
MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>")
WORD = re.compile(r"[^\W\d_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, repeated words) of each text.

    A word is repeated if it stands in a run of WINDOW or more words that stood earlier in
    the text, or in a phrase that directly follows itself. Letter case, punctuation, spacing,
    numbers and markup do not count. Null and empty texts have no words.
    """
    split = [WORD.findall((MARKUP.sub(" ", t) if "<" in t else t).casefold()) if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = [w for doc in split for w in doc]
    n = len(flat)
    if not n:
        return sizes, np.zeros(len(texts), np.int64)
    ids = pc.dictionary_encode(pa.array(flat, pa.large_string())).indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    marks = np.zeros(n + 1, np.int64)  # +1 where a repeated stretch begins, -1 after its end

    if n >= WINDOW:
        keys = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            keys = keys * MULTIPLIER + (ids[k : n - WINDOW + 1 + k].astype(np.uint64) + np.uint64(1))
            keys ^= keys >> np.uint64(29)
        starts = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
        order = starts[np.lexsort((keys[starts], doc[starts]))]  # stable: earlier positions first
        again = order[1:][(keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])]
        np.add.at(marks, again, 1)
        np.add.at(marks, again + WINDOW, -1)
    for k in range(1, PHRASE + 1):
        if n < 2 * k:
            break
        same = np.concatenate(([0], np.cumsum((ids[k:] == ids[:-k]) & (doc[k:] == doc[:-k]))))
        found = np.flatnonzero(same[k:] - same[:-k] == k) + k  # where a second copy begins
        np.add.at(marks, found, 1)
        np.add.at(marks, found + k, -1)
    repeated = np.cumsum(marks[:n]) > 0
    return sizes, np.bincount(doc, weights=repeated, minlength=len(texts)).astype(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:  # slices of bounded size, at least one text each
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_CHARS, "right")))
            part = batch.slice(at, to - at)
            words, repeated = repeated_words(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), pa.array(words), pa.array(repeated)],
                names=["doc_id", "lang", "source", "n_words", "n_repeated"],
            )
            at = to


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, n_repeated, share); a document without words has share 0."""
    rows = docs.select("doc_id", "text", "lang", "source").mapInArrow(
        _measure, "doc_id long, lang string, source string, n_words long, n_repeated long"
    )
    return rows.withColumn("share", F.coalesce(F.expr("try_divide(n_repeated, n_words)"), F.lit(0.0)))


def language(lang: Column) -> Column:
    """Main language code in lower case, 'und' for null, empty and unknown."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)), F.lit("")), F.lit("und"))


def thresholds(shares: DataFrame, quantile: float = 0.95, least_docs: int = 100, whole_from: float | None = None) -> DataFrame:
    """(lang, source, threshold, n_docs): the group's quantile by its sketch.

    Groups of fewer than least_docs documents use the merged sketch of their language. whole_from: a share
    from which on no document may be missed; the threshold is then the largest value of the sketch, up to the
    quantile, that does not exceed this share.
    Inputs: lang without nulls, source without nulls, share.
    """
    groups = shares.groupBy("lang", "source").agg(F.kll_sketch_agg_double("share").alias("sketch"), F.count("*").alias("n_docs"))
    languages = groups.groupBy(F.col("lang").alias("of_lang")).agg(F.kll_merge_agg_double("sketch").alias("merged")) if hasattr(F, "kll_merge_agg_double") else (
        shares.groupBy(F.col("lang").alias("of_lang")).agg(F.kll_sketch_agg_double("share").alias("merged")))
    chosen = F.when(F.col("n_docs") >= least_docs, F.col("sketch")).otherwise(F.col("merged"))
    rated = groups.join(languages, F.col("lang") == F.col("of_lang")).withColumn("chosen", chosen)
    if whole_from is None:
        threshold = F.kll_sketch_get_quantile_double("chosen", F.lit(quantile))
    else:  # the sketch's largest value up to the quantile that does not exceed the share
        steps = F.kll_sketch_get_quantile_double("chosen", F.array(*(F.lit(quantile * k / STEPS) for k in range(STEPS + 1))))
        threshold = F.coalesce(F.array_max(F.filter(steps, lambda q: q <= whole_from)), F.lit(0.0))
    return rated.select("lang", "source", threshold.alias("threshold"), "n_docs")


def flagged(docs: DataFrame, quantile: float = 0.95, whole_from: float | None = None) -> DataFrame:
    """Documents at or above their group's threshold and with any repetition: adds threshold."""
    shares = cut(measured(docs).withColumns({"lang": language(F.col("lang")), "source": F.coalesce("source", F.lit(""))}))
    return shares.join(thresholds(shares, quantile, whole_from=whole_from), ["lang", "source"]).filter(
        (F.col("share") > 0) & (F.col("share") >= F.col("threshold"))
    )


def repetitive(docs: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """Documents that their group's threshold lets through and whose share reaches max_share (exact check on integer counts)."""
    percent = round(max_share * 100)
    return flagged(docs, whole_from=max_share).filter(F.col("n_repeated") * 100 >= F.col("n_words") * percent)
