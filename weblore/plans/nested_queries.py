"""Queries of the nested-record operator (problem 4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblore.operators.nested import BRANCHES, OFFSETS, PAIR_FIELDS, PRED_FIELDS, flatten, leaf_rows
from weblore.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaf_rows(table(spark, folder, "webpage", "page_id", *BRANCHES))


def _level(branch: str, depth: int, names: dict[str, str], fields: dict[str, str] | None = None, places: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """One level's table; fields: further fields by path -> type, named by the path's end behind its parents."""
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = flatten(table(spark, folder, "webpage", "page_id", branch), (branch,), depth, whole=bool(fields), places=places)
        more = F.from_json("more", "map<string,string>")
        extra = [F.try_element_at(more, F.lit(p)).try_cast(kind).alias(p.removeprefix("features.").replace(".", "_")) for p, kind in (fields or {}).items()]
        return rows.select("page_id", *(F.col(a).alias(b) for a, b in names.items()), *extra).distinct()

    return query


TYPES = {p: "double" if p.removeprefix("features.") in OFFSETS else {"dom_distance": "int", "is_above_and_on_left": "boolean"}.get(p.rsplit(".", 1)[-1], "string") for p in PRED_FIELDS}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_pairs": _level("candidate_pairs", 1, {"parent_key": "obj_xpath", "text": "obj_text"}, dict.fromkeys(PAIR_FIELDS, "string")),
    "p4_pred_candidates": _level("candidate_pairs", 2, {"parent_key": "obj_xpath", "child_key": "node", "text": "pred_text", "score": "score"}, TYPES),
    "p4_labels": _level("seed_labels", 1, {"parent_key": "obj_xpath", "text": "obj_text", "score": "score"}, {"obj_id": "string"}),
    "p4_label_preds": _level("seed_labels", 2, {"parent_key": "obj_xpath", "child_key": "pred_xpath", "text": "pred_text"}),
    "p4_entities": _level("page_entities", 1, {"parent_key": "entity_id", "text": "entity_text", "score": "score"}),
    "p4_entity_places": _level("page_entities", 2, {"parent_key": "entity_id", "child_key": "xpath"}, places=True),
    "p4_related_objects": _level("page_entities", 2, {"parent_key": "entity_id", "child_key": "obj_id", "text": "obj_text"}),
    "p4_relation_types": _level("page_entities", 3, {"parent_key": "entity_id", "child_key": "obj_id", "leaf_key": "rel_id", "text": "rel_text"}),
}

ORACLES: dict[str, str] = {}
