"""Helpers on maps and arrays: recursion over nested maps, merging, picking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_values(m: Column, f: Callable[[Column], Column], keys: Callable[[Column], Column] | None = None) -> Column:
    """A map with f applied to its values and, if given, keys to its keys. Nested levels: call it in f."""
    out = F.transform_values(m, lambda _, v: f(v))
    return F.transform_keys(out, lambda k, _: keys(k)) if keys else out


def first_match(items: Column, test: Callable[[Column], Column]) -> Column:
    """The first item that passes the test, null if none does."""
    return F.get(F.filter(items, test), F.lit(0))


def key_of_largest(m: Column) -> Column:
    """The key of the largest value; of equal values the smallest key."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.array_min(entries)["k"]


def keys_by_value(m: Column, value: Column) -> Column:
    """Keys that hold the value, in order."""
    return F.sort_array(F.map_keys(F.map_filter(m, lambda _, v: v == value)))


def merged(*maps: Column) -> Column:
    """One map of several; of equal keys the last map's value."""
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), maps)


def largest_absolute(items: Column) -> Column:
    """The largest absolute value of an array, null for an empty one."""
    return F.array_max(F.transform(items, F.abs))
