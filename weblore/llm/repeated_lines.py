"""Problem 1: lines repeated across the documents of one source.

Every line becomes a 64-bit hash of its wording inside the scan's Python stage, so only
(source, hash, document, line number) is ever shuffled, never text. Documents are counted per
(source, hash) in two steps (distinct documents, then a map-side combined count), so a line
that stands in a third of all documents is not gathered anywhere. Pages are rebuilt in a second
scan that meets the few frequent wordings of its source, so html is not shuffled either.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblore.llm.pagelines import body_lines, heading, visible, words
from weblore.session import cut

MIN_WORDS, MIN_PAGES, MIN_SHARE, SALTS = 6, 3, 0.10, 16
MOST_WORDINGS = 1_000_000  # hashes or ids that may be broadcast (8 MB)
HASHED = "page_id long, template string, line_no int, wording long"


def _without(tokens: list[str], title: list[str]) -> list[str]:
    """The tokens without contiguous occurrences of the title's tokens."""
    n = len(title)
    if not n or title[0] not in tokens:
        return tokens
    out, i = [], 0
    while i < len(tokens):
        if tokens[i : i + n] == title:
            i += n
        else:
            out.append(tokens[i])
            i += 1
    return out


def wording_hash(line: str, title: list[str], min_words: int = MIN_WORDS) -> int | None:
    """Signed hash of a line's wording, None if fewer than min_words words remain."""
    return tokens_hash(words(visible(line)), title, min_words)


def tokens_hash(tokens: list[str], title: list[str], min_words: int = MIN_WORDS) -> int | None:
    """`wording_hash` of the words of a line."""
    tokens = _without(tokens, title)
    return xxhash.xxh64_intdigest(" ".join(tokens)) - (1 << 63) if len(tokens) >= min_words else None


def _hash_batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, templates, numbers, hashes = [], [], [], []
        for page_id, template, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
            lines, first = body_lines(page)
            title = words(heading(page)) if first < len(lines) else []
            for i in range(first, len(lines)):
                if len(lines[i]) >= min_words and (h := wording_hash(lines[i], title, min_words)) is not None:
                    ids.append(page_id)
                    templates.append(template)
                    numbers.append(i + 1)
                    hashes.append(h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(templates, pa.string()), pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64())],
            names=["page_id", "template", "line_no", "wording"],
        )


def line_hashes(pages: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(page_id, template, line_no, wording) of every body line with at least min_words words.

    Null, empty and body-less pages give no rows; repeated rows of a page give one.
    """
    hashed = pages.select("page_id", "template", "html").mapInArrow(lambda it: _hash_batches(it, min_words), HASHED)
    return hashed.dropDuplicates(["page_id", "line_no", "template", "wording"])


def frequent_wordings(lines: DataFrame, pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(template, wording, n_pages) of wordings on at least min_pages and min_share of a template's pages.

    A null template is a source of its own. Thresholds are inclusive.
    """
    sizes = pages.select("template", "page_id").distinct().groupBy("template").agg(F.count("*").alias("of_pages"))
    counts = (
        lines.select("template", "wording", "page_id").distinct()
        .groupBy("template", "wording").agg(F.count("*").alias("n_pages"))
        .filter(F.col("n_pages") >= min_pages)
    )
    return (
        counts.join(sizes.withColumnRenamed("template", "t"), F.col("template").eqNullSafe(F.col("t")))
        .filter(F.col("n_pages") >= min_share * F.col("of_pages") - 1e-9)
        .select("template", "wording", "n_pages")
    )


def repeated_lines(
    pages: DataFrame, min_words: int = MIN_WORDS, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE
) -> DataFrame:
    """(page_id, line_no) of the body lines whose wording is frequent in the page's template.

    The frequent wordings are few per template (a wording needs a tenth of the pages), so
    each is repeated under SALTS salts and the lines carry a salt from their page: a wording
    of a third of all pages is spread over SALTS tasks in the join back.
    """
    lines = cut(line_hashes(pages, min_words))
    frequent = frequent_wordings(lines, pages, min_pages, min_share).select(
        F.col("template").alias("t"), F.col("wording").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")
    )
    return lines.join(
        frequent,
        (F.col("wording") == F.col("w")) & F.col("template").eqNullSafe(F.col("t")) & (F.pmod("page_id", F.lit(SALTS)) == F.col("s")),
        "left_semi",
    ).select("page_id", F.col("line_no").cast("long").alias("line_no"))


def _drop_lines(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Pages (page_id, html, template, frequent wordings of the template) without the lines that bear one of them."""
    for batch in batches:
        texts, removed, sets = [], [], {}
        for page, template, frequent in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if not page or not frequent.is_valid:
                texts.append(page)
                removed.append(0)
                continue
            if template not in sets:
                sets[template] = frozenset(frequent.as_py())
            known = sets[template]
            lines, first = body_lines(page)
            title = words(heading(page)) if first < len(lines) else []
            kept = [x for i, x in enumerate(lines) if i < first or len(x) < min_words or wording_hash(x, title, min_words) not in known]
            texts.append(page if len(kept) == len(lines) else "\n".join(kept))
            removed.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["page_id", "html", "n_removed"])


def meet_wordings(pages: DataFrame, frequent: DataFrame) -> DataFrame:
    """Pages with `frequent`, the sorted frequent wordings of their template, null without any; `frequent` is read twice.

    Up to MOST_WORDINGS are broadcast by source, more meet the pages by a salted join.
    """
    by_source = frequent.groupBy(F.col("template").alias("t")).agg(F.sort_array(F.collect_set("wording")).alias("frequent"))  # a source has at most its lines a page / min_share
    source = F.col("template").eqNullSafe(F.col("t"))
    if frequent.count() <= MOST_WORDINGS:
        return pages.join(F.broadcast(by_source), source, "left").drop("t")
    spread = by_source.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.join(spread, source & (F.pmod("page_id", F.lit(SALTS)) == F.col("s")), "left").drop("t", "s")


def remove_repeated_lines(pages: DataFrame, min_words: int = MIN_WORDS, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Each page once, rebuilt without its repeated lines: (page_id, html, n_removed).

    A page without repeated lines comes out as it is; a null page stays null. Every version of a page loses
    its own lines; of several versions of a page_id the largest rebuilt text is kept.
    """
    pages = pages.select("page_id", "template", "html")
    frequent = cut(frequent_wordings(cut(line_hashes(pages, min_words)), pages, min_pages, min_share))
    met = meet_wordings(pages, frequent)
    rebuilt = lambda rows: rows.select("page_id", "html", "template", "frequent").mapInArrow(lambda it: _drop_lines(it, min_words), "page_id long, html string, n_removed long")
    # only the pages that come several times are shuffled
    several = cut(pages.groupBy("page_id").count().filter("count > 1").select(F.col("page_id").alias("p")))
    several = F.broadcast(several) if several.count() <= MOST_WORDINGS else several
    again = F.col("page_id").eqNullSafe(F.col("p"))
    one = rebuilt(met.join(several, again, "left_anti"))
    best = rebuilt(met.join(several, again, "left_semi")).groupBy("page_id").agg(F.max(F.struct("html", "n_removed")).alias("b"))
    return one.unionByName(best.select("page_id", "b.html", "b.n_removed"))
