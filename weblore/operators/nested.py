"""Problem 4: deeply nested semi-structured records to flat tables with parent-child links.

The JVM turns each JSON value into one tree type, whatever shape its writer used: lists of
(key, text, score, more, kids), where more holds all further fields of
a record by their path. The trees reach Python as Arrow nested lists and are flattened from
their offsets: the flattened child array of a level, the parent index of every child, and a
vectorised take that carries ids and keys down. No row is touched in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRANCHES = ("candidate_pairs", "seed_labels", "page_entities")
HEAD = "key:string,text:string,score:string,more:map<string,string>"
LEAF = f"struct<{HEAD}>"
TREE = f"array<struct<{HEAD},kids:array<struct<{HEAD},kids:array<{LEAF}>>>>>"
# Further fields of a record by the path below it.
STYLE = tuple(f"dom.{c}" for c in ("font_family", "font_size", "font_weight", "text_alignment", "color"))
OFFSETS = tuple(f"distances.horizontal.{c}" for c in ("left_left", "left_right", "right_left", "right_right")) + tuple(
    f"distances.vertical.{c}" for c in ("up_up", "up_down", "down_up", "down_down")) + ("distances.min_distance", "distances.origin_distance")
PAIR_FIELDS = tuple(f"features.{c}" for c in STYLE)
PRED_FIELDS = PAIR_FIELDS + tuple(f"features.{c}" for c in (*OFFSETS, "graphic.is_above_and_on_left", "dom_distance"))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def unquoted(text: Column) -> Column:
    """The JSON text itself; of a value that is a JSON string, the string's content. Damaged strings give null."""
    return F.when(F.ltrim(text).startswith('"'), _get(F.try_parse_json(text), "$")).otherwise(text)


def members(v: Column, key_field: str) -> Column:
    """array<struct<key, item>> of a list of objects that hold their key, or of a map from keys to items.

    A single object that holds key_field itself counts as a list of one.
    """
    listed = F.transform(_get(v, "$", "array<variant>"), lambda x: F.struct(_get(x, f"$.{key_field}").alias("key"), x.alias("item")))
    single = F.when(_get(v, f"$.{key_field}").isNotNull(), F.array(F.struct(_get(v, f"$.{key_field}").alias("key"), v.alias("item"))))
    mapped = F.transform(F.map_entries(_get(v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("item")))
    return F.coalesce(listed, single, mapped)


def _more(item: Column, paths: tuple[str, ...]) -> Column:
    """The further fields that a record has, by path."""
    entries = F.array(*(F.struct(F.lit(p).alias("key"), _get(item, f"$.{p}").alias("value")) for p in paths))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _node(key: Column, text: Column, score: Column, kids: Column | None = None, more: Column | None = None) -> Column:
    fields = [key.alias("key"), text.alias("text"), score.alias("score"), (_none("map<string,string>") if more is None else more).alias("more")]
    return F.struct(*fields, kids.alias("kids")) if kids is not None else F.struct(*fields)


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def pair_tree(v: Column, whole: bool = False) -> Column:
    """Objects of a page and their predicate candidates; whole: with their further fields."""
    return F.transform(
        members(v, "xpath"),
        lambda m: _node(
            m["key"], _get(m["item"], "$.obj_text"), _none(),
            F.transform(
                members(_get(m["item"], "$.pred_candidates", "variant"), "node"),
                lambda p: _node(p["key"], _get(p["item"], "$.text"), _get(p["item"], "$.score"), _none(f"array<{LEAF}>"), _more(p["item"], PRED_FIELDS) if whole else None),
            ),
            _more(m["item"], PAIR_FIELDS) if whole else None,
        ),
    )


def label_tree(v: Column, whole: bool = False) -> Column:
    """Labelled objects and the node that holds their predicate; whole: with the object's id."""
    return F.transform(
        members(v, "xpath"),
        lambda m: _node(
            m["key"], _get(m["item"], "$.obj_text"), _get(m["item"], "$.score"),
            F.when(
                _get(m["item"], "$.pred").isNotNull(),
                F.array(_node(_get(m["item"], "$.pred"), _get(m["item"], "$.pred_text"), _none(), _none(f"array<{LEAF}>"))),
            ),
            _more(m["item"], ("obj_id",)) if whole else None,
        ),
    )


def entity_tree(v: Column, whole: bool = False) -> Column:
    """Entities, their related objects and the relation types between them."""
    return F.transform(
        members(v, "entity_id"),
        lambda m: _node(
            m["key"], _get(m["item"], "$.text"), _get(m["item"], "$.score"),
            F.transform(
                members(_get(m["item"], "$.related_objs", "variant"), "obj_id"),
                lambda o: _node(
                    o["key"], _get(o["item"], "$.obj_text"), _none(),
                    F.transform(F.map_entries(_get(o["item"], "$.rel_types", "map<string,variant>")), lambda r: _node(r["key"], _get(r["value"], "$"), _none())),
                ),
            ),
        ),
    )


def place_tree(v: Column, whole: bool = False) -> Column:
    """Entities and the paths (one or a list) at which they stand."""
    paths = lambda item: F.coalesce(_get(item, "$.xpaths", "array<string>"), F.array_compact(F.array(F.coalesce(_get(item, "$.xpaths"), _get(item, "$.xpath")))))
    return F.transform(members(v, "entity_id"), lambda m: _node(
        m["key"], _get(m["item"], "$.text"), _get(m["item"], "$.score"), F.transform(paths(m["item"]), lambda x: _node(x, _none(), _none(), _none(f"array<{LEAF}>")))))


BUILDERS = {"candidate_pairs": pair_tree, "seed_labels": label_tree, "page_entities": entity_tree}


def _children(lists: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Flattened items of a list array and the index of the list each one stands in."""
    return lists.flatten(), pc.list_parent_indices(lists)


def _key(items: pa.StructArray) -> pa.Array:
    return pc.fill_null(pc.struct_field(items, "key"), "")


def _childless(count: int, parents: pa.Array) -> pa.Array:
    """Indices 0..count-1 that are nobody's parent."""
    mask = np.ones(count, bool)
    mask[parents.to_numpy(zero_copy_only=False)] = False
    return pa.array(np.flatnonzero(mask))


def _arrays(batch: pa.RecordBatch, branch: str, depth: int | None) -> Iterator[list[pa.Array]]:
    """[id, branch, parent, child, leaf, text, score, more] of one branch: one level, or the deepest existing ones."""
    ids = batch.column(0)
    tops, owner = _children(batch.column(batch.schema.get_field_index(branch)))
    top_id, top_key = ids.take(owner), _key(tops)
    mids, mid_up = _children(pc.struct_field(tops, "kids"))
    mid_id, mid_top, mid_key = top_id.take(mid_up), top_key.take(mid_up), _key(mids)
    lows, low_up = _children(pc.struct_field(mids, "kids"))
    blank = lambda n: pa.array([""] * n, pa.string())

    def rows(page: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, items: pa.StructArray) -> list[pa.Array]:
        return [page, pa.array([branch] * len(page), pa.string()), a, b, c, pc.struct_field(items, "text"), pc.struct_field(items, "score"), pc.struct_field(items, "more")]

    if depth in (None, 3):
        yield rows(mid_id.take(low_up), mid_top.take(low_up), mid_key.take(low_up), _key(lows), lows)
    if depth != 3:
        at = _childless(len(mids), low_up) if depth is None else pa.array(range(len(mids) if depth == 2 else 0), pa.int64())
        yield rows(mid_id.take(at), mid_top.take(at), mid_key.take(at), blank(len(at)), mids.take(at))
        at = _childless(len(tops), mid_up) if depth is None else pa.array(range(len(tops) if depth == 1 else 0), pa.int64())
        yield rows(top_id.take(at), top_key.take(at), blank(len(at)), blank(len(at)), tops.take(at))


NAMES = ["page_id", "branch", "parent_key", "child_key", "leaf_key", "text", "score", "more"]


def _flatten(batches: Iterator[pa.RecordBatch], branches: tuple[str, ...], depth: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for branch in branches:
            for arrays in _arrays(batch, branch, depth):
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, names=NAMES)


def flatten(pages: DataFrame, branches: tuple[str, ...] = BRANCHES, depth: int | None = None, whole: bool = False, places: bool = False) -> DataFrame:
    """(page_id, branch, parent_key, child_key, leaf_key, text, score, more) of the nested columns.

    more: a JSON object of the record's further fields by path, with whole; else null. places: entities with
    their paths below them instead of their related objects.

    depth 1, 2 or 3 gives that level's table, None one row per deepest existing level. Missing
    levels and missing keys are ''. Null and invalid values give no rows; an empty object or
    list has no level and gives none. Repeated rows come out once.
    """
    texts = pages.select("page_id", *(unquoted(F.col(b)).alias(b) for b in branches))
    values = texts.select("page_id", *(F.try_parse_json(b).alias(b) for b in branches))  # own projection: parsed once
    trees = values.select("page_id", *((place_tree if places and b == "page_entities" else BUILDERS[b])(F.col(b), whole).cast(TREE).alias(b) for b in branches))
    rows = trees.mapInArrow(
        lambda it: _flatten(it, branches, depth),
        "page_id long, branch string, parent_key string, child_key string, leaf_key string, text string, score string, more map<string,string>",
    )
    return rows.withColumn("more", F.to_json("more") if whole else F.lit(None).cast("string")).distinct()


def leaf_rows(pages: DataFrame) -> DataFrame:
    """Key paths of the deepest existing levels of all three branches."""
    return flatten(pages).select("page_id", "branch", "parent_key", "child_key", "leaf_key").distinct()
