"""Problem 8: filling containers of fixed capacity with items of varying length.

Items over the capacity are cut into full pieces and a rest; all others stay whole. Items are
spread over groups by hash, each of about WINDOWS containers, so a group's size depends on the
capacity and not on the collection. A group is divided into equal windows by Karmarkar-Karp
multiway differencing. Windows that exceed the capacity exchange single items with others; as
long as one still does, the window count rises.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblore.llm.token_sizes import VOCABULARY, with_token_sizes
from weblore.session import cut

WINDOWS = 128
PACKED = "container_kind string, capacity_tokens int, container_id long, doc_id long, part_no int, start_token long, n_tokens long"


def _merge(a: list, b: list, k: int) -> list:
    """Two partial partitions into one: largest sums of one with smallest of the other.

    A partition is a list of (sum, items) in ascending order without its empty windows.
    """
    free = k - len(a)  # empty windows of a
    if len(b) <= free:
        if len(b) == 1:
            insort(a, b[0], key=lambda w: w[0])
            return a
        return sorted(a + b, key=lambda w: w[0])
    # b's largest fill a's empty windows, the others stand against a's smallest in opposite order
    over = b[: len(b) - free]
    joined = [(s + t, (x, y)) for (s, x), (t, y) in zip(a[: len(over)], reversed(over))]
    return sorted(joined + a[len(over) :] + b[len(over) :], key=lambda w: w[0])


def differencing(sizes: list[int], k: int) -> list[tuple[int, object]]:
    """k windows (or fewer, without empty ones) of near-equal sums: (sum, nested pairs of item indices)."""
    spread = lambda p: p[-1][0] - (p[0][0] if len(p) == k else 0)
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        merged = _merge(a, b, k)
        heapq.heappush(heap, (-spread(merged), serial, merged))
        serial += 1
    return heap[0][2] if heap else []


def _items(nested: object) -> Iterator[int]:
    stack = [nested]
    while stack:
        top = stack.pop()
        if isinstance(top, tuple):
            stack += top
        else:
            yield top


def relieve(found: list[list[int]], sizes: list[int], capacity: int) -> bool:
    """Bring overfull windows under the capacity by moving or exchanging single items, in place.

    An overfull window gives an item to, or changes one with, a window whose free space takes
    the difference. False if some window stays overfull.
    """
    size = np.array(sizes + [0])  # the last stands for "nothing in return"
    sums = np.array([sum(sizes[i] for i in w) for w in found])
    at = np.array([i for w in found for i in w] + [len(sizes)] * len(found))
    home = np.array([n for n, w in enumerate(found) for _ in w] + list(range(len(found))))
    left, before = int(np.maximum(sums - capacity, 0).sum()), None
    while left and left != before:
        for w in np.argsort(-sums):
            while (excess := sums[w] - capacity) > 0:
                # items of one size in one window are alike: one of each stands for them
                _, kinds = np.unique(home * (capacity + 1) + size[at], return_index=True)
                mine, other = kinds[(home[kinds] == w) & (at[kinds] < len(sizes))], kinds[home[kinds] != w]
                if not len(other):
                    break
                room = (capacity - sums[home[other]])[None, :]
                gain = size[at[mine]][:, None] - size[at[other]][None, :]
                gain[gain > room] = 0
                fits = gain >= excess
                best = np.where(fits, room - gain, np.iinfo(np.int64).max).argmin() if fits.any() else gain.argmax()
                a, b = mine[best // len(other)], other[best % len(other)]
                d = gain.flat[best]
                if d <= 0:
                    break
                sums[w] -= d
                sums[home[b]] += d
                if at[b] == len(sizes):
                    home[a] = home[b]  # moved; the other window keeps its mark for nothing
                else:
                    home[a], home[b] = home[b], home[a]
        before, left = left, int(np.maximum(sums - capacity, 0).sum())
    if left:
        return False
    for w in found:
        w.clear()
    for i, n in zip(at.tolist(), home.tolist()):
        if i < len(sizes):
            found[n].append(i)
    return True


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item indices by window, no window above the capacity. Every size must be in 1..capacity."""
    if not sizes:
        return []
    k = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes), 1)
    while True:
        found = [sorted(_items(x)) for _, x in differencing(sizes, k)]
        found += [[] for _ in range(k - len(found))]
        if max(sum(sizes[i] for i in w) for w in found) <= capacity or relieve(found, sizes, capacity):
            return [sorted(w) for w in found if w]
        k += 1


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups arrive whole and one after another (sorted by group); each is packed on its own."""
    group: tuple | None = None
    rows: list[tuple] = []

    def done() -> pa.RecordBatch:
        kind, capacity, number = group
        out = []
        full, rest = ([r for r in rows if (r[3] == capacity) == whole] for whole in (True, False))
        filled = [[rest[i] for i in items] for items in windows([r[3] for r in rest], capacity)]
        for w, items in enumerate([*filled, *([r] for r in full)]):
            out += [(kind, capacity, (number << 20) + w, *r) for r in items]
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=[c.split()[0] for c in PACKED.split(", ")])

    for batch in batches:
        for kind, capacity, number, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (kind, capacity, number) != group:
                if rows:
                    yield done()
                group, rows = (kind, capacity, number), []
            rows.append(tuple(row))
    if rows:
        yield done()


def parts(sized: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """Every item once per container kind, cut only where it exceeds the capacity."""
    kinds = F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity_tokens")) for k, c in capacities))
    each = sized.filter("n_tokens > 0").withColumn("kind", F.explode(kinds)).select("doc_id", "n_tokens", "kind.*")
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.col("capacity_tokens").cast("long"))
    return each.select("container_kind", "capacity_tokens", "doc_id", F.posexplode(starts).alias("part_no", "start_token"), F.col("n_tokens").alias("of")).select(
        "container_kind", "capacity_tokens", "doc_id", "part_no", "start_token", F.least(F.col("capacity_tokens").cast("long"), F.col("of") - F.col("start_token")).alias("n_tokens"))


def pack(docs: DataFrame, containers: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(container_kind, capacity_tokens, container_id, doc_id, part_no, start_token, n_tokens).

    docs: doc_id, text. containers: container_kind, capacity_tokens, at most 100 rows. Texts
    without tokens are in no container. Repeated rows of a doc_id count once. Full pieces of
    cut items are containers of their own.
    """
    kinds = sorted((r.container_kind, int(r.capacity_tokens)) for r in containers.select("container_kind", "capacity_tokens").distinct().limit(101).collect())
    if not kinds or len(kinds) > 100 or any(c < 1 for _, c in kinds):
        raise ValueError("between 1 and 100 container kinds of positive capacity are needed")
    sized = cut(with_token_sizes(docs.select("doc_id", "text"), path=path).dropDuplicates(["doc_id"]))
    pieces = parts(sized, kinds)
    total = sized.agg(F.sum("n_tokens").alias("n")).first().n or 0
    groups = reduce(lambda c, kind: c.when((F.col("container_kind") == kind[0]) & (F.col("capacity_tokens") == kind[1]), max(1, round(total / (kind[1] * WINDOWS)))), kinds, F)
    number = F.pmod(F.xxhash64("doc_id", "part_no"), groups)
    key = ["container_kind", "capacity_tokens", "group"]
    columns = [c.split()[0] for c in PACKED.split(", ")]
    spread = pieces.withColumn("group", number).repartition(*key).sortWithinPartitions(*key, F.desc("n_tokens"), "doc_id", "part_no")
    return spread.select(*key, "doc_id", "part_no", "start_token", "n_tokens").mapInArrow(_pack, PACKED).select(*columns)


def fill_report(packed: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, n_containers, n_tokens, fill): how full the containers are."""
    return packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"),
        F.round(F.sum("n") / (F.count("*") * F.col("capacity_tokens")), 6).alias("fill"))
