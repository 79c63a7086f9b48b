"""Queries of the text-corpus operators: name -> function of (session, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblore.llm import encoding_repair, entity_linkage, gaussian_mixture, layout_clusters, main_content, mixture, packing, repeated_lines, self_repetition, term_counts
from weblore.session import cut
from weblore.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, folder, "webpage", "page_id", "template", "html"))


def p1_clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "webpage", "page_id", "template", "html")
    return repeated_lines.remove_repeated_lines(pages)


def _text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    pages = encoding_repair.scan_tokens(table(spark, folder, "webpage", "page_id", "html"), "webpage", True)
    return pages.unionByName(encoding_repair.scan_tokens(table(spark, folder, "candidate_pairs", "pair_id", "obj_text"), "candidate_pairs", False))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_repair.garbled_records(_text_tokens(spark, folder)).select("src_table", "rec_id").distinct()


def p2_restored(spark: SparkSession, folder: str) -> DataFrame:
    garbled = cut(encoding_repair.garbled_records(_text_tokens(spark, folder)))
    pages = encoding_repair.restore(table(spark, folder, "webpage", "page_id", "html"), garbled, "webpage", True)
    return pages.unionByName(encoding_repair.restore(table(spark, folder, "candidate_pairs", "pair_id", "obj_text"), garbled, "candidate_pairs", False))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate_pairs", "pair_id", "template", "pred_candidates")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return layout_clusters.linked_pairs(_pairs(spark, folder))


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(layout_clusters.nearest(_pairs(spark, folder)))
    model = gaussian_mixture.fit(rows)
    placed = layout_clusters.clusters(None, rows, model).join(gaussian_mixture.scored(rows, model), "pair_id")
    return layout_clusters.typical_members(cut(placed))


def p5_matches(spark: SparkSession, folder: str) -> DataFrame:
    return entity_linkage.link(
        table(spark, folder, "candidate_pairs", "pair_id", "page_id", "obj_text"), table(spark, folder, "webpage", "page_id", "topic_text"),
        table(spark, folder, "kb_node"), table(spark, folder, "kb_edge"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_matches(spark, folder).select("src_table", "rec_id", "node_id").distinct()


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "webpage", "page_id", "template", "html", "ground_truth")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_content.main_lines(_pages(spark, folder))


def p6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_content.main_text(_pages(spark, folder))


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    pages = term_counts.block_counts(table(spark, folder, "webpage", "page_id", "template"), "page_id", {"template": F.array("template")})
    pairs = term_counts.block_counts(
        table(spark, folder, "candidate_pairs", "pair_id", "obj_text", F.col("pred_candidates.text").alias("pred_texts")),
        "pair_id", {"obj_text": F.array("obj_text"), "pred_text": F.col("pred_texts")},
    )
    return term_counts.term_counts(pages.unionByName(pairs))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_counts(spark, folder).filter("mark is not null").select("field_name", "val", "mark")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text", "lang", "source")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "container_size"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(cut(p8_packing(spark, folder)))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "source_target"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.share_report(cut(p9_mixture(spark, folder)), table(spark, folder, "source_target"))


def p9_choices(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.choices(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "source_target"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return self_repetition.repetitive(_documents(spark, folder)).select("doc_id")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    return self_repetition.measured(_documents(spark, folder)).select("doc_id", "n_words", "n_repeated", "share")


def p10_flagged(spark: SparkSession, folder: str) -> DataFrame:
    return self_repetition.flagged(_documents(spark, folder)).select("doc_id", "lang", "source", "share", "threshold")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean_pages": p1_clean_pages,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p5_found": p5_found,
    "p5_matches": p5_matches,
    "p6_found": p6_found,
    "p6_main_text": p6_main_text,
    "p7_found": p7_found,
    "p7_counts": p7_counts,
    "p8_packing": p8_packing,
    "p8_fill": p8_fill,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_choices": p9_choices,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
    "p10_flagged": p10_flagged,
}
