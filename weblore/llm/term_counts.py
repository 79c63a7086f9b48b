"""Problem 7: occurrences and records of every distinct value.

Each block (task) counts its own terms first, so a value that stands in a third of all
records leaves a block as one row. The distinct terms get dense integer ids, block counts are
encoded and added into count arrays, one array per range of ids, in a streaming pass over the
rows of the range. Nothing grows with the collection except the dictionary, which stays a
distributed table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblore.session import cut

RARE_RECORDS, COMMON_SHARE = 3, 0.03
BUCKETS, RANGE, FLUSH = 256, 1 << 16, 200_000
BLANK = r"[ \t\r\n\u00a0]+"


def term(text: Column) -> Column:
    """Runs of blanks made one, trimmed, lower case; null stays null, '' is a value."""
    return F.lower(F.trim(F.regexp_replace(text, BLANK, " ")))


def _block(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Per block: (field, val, occurrences, records); val null holds the number of records."""
    def rows(counts: dict) -> pa.RecordBatch:
        keys, sums = list(counts), list(counts.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())],
            names=["field_name", "val", "occ", "rec"],
        )

    counts: dict[tuple[str, str | None], list[int]] = {}
    for batch in batches:
        for i, field in enumerate(fields):
            counts.setdefault((field, None), [0, 0])[1] += batch.num_rows
            for terms in batch.column(i).to_pylist():
                if not terms:
                    continue
                for t in terms:
                    if t is not None:
                        counts.setdefault((field, t), [0, 0])[0] += 1
                for t in set(terms):
                    if t is not None:
                        counts[field, t][1] += 1
        if len(counts) > FLUSH:
            yield rows(counts)
            counts = {}
    if counts:
        yield rows(counts)


def block_counts(records: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """fields: name -> array of raw terms of a record. Repeated rows of a key count once."""
    once = records.dropDuplicates([key]).select(*(F.transform(c, term).alias(name) for name, c in fields.items()))
    names = tuple(fields)
    return once.mapInArrow(lambda it: _block(it, names), "field_name string, val string, occ long, rec long")


def dictionary(blocks: DataFrame) -> DataFrame:
    """(field_name, val, id): dense ids from 0; ids within a hash bucket by order, buckets one after another."""
    terms = cut(blocks.filter("val is not null").select("field_name", "val").distinct()
                .withColumn("bucket", F.pmod(F.xxhash64("field_name", "val"), F.lit(BUCKETS))))
    sizes = terms.groupBy("bucket").count()  # at most BUCKETS rows
    starts = sizes.select("bucket", (F.sum("count").over(W.partitionBy(F.lit(0)).orderBy("bucket")) - F.col("count")).alias("start"))
    local = F.row_number().over(W.partitionBy("bucket").orderBy("field_name", "val")) - 1
    return terms.withColumn("local", local).join(F.broadcast(starts), "bucket").select("field_name", "val", (F.col("start") + F.col("local")).alias("id"))


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count arrays of the id ranges of a task, filled while the rows stream by."""
    arrays: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, occ, rec = (batch.column(i).to_numpy() for i in range(3))
        for r in np.unique(ids // RANGE):
            a = arrays.setdefault(int(r), np.zeros((2, RANGE), np.int64))
            at = ids // RANGE == r
            np.add.at(a[0], ids[at] % RANGE, occ[at])
            np.add.at(a[1], ids[at] % RANGE, rec[at])
    for r, a in arrays.items():
        used = np.flatnonzero(a[0])
        yield pa.RecordBatch.from_arrays([pa.array(used + r * RANGE), pa.array(a[0][used]), pa.array(a[1][used])], names=["id", "occ", "rec"])


def term_counts(blocks: DataFrame) -> DataFrame:
    """(field_name, val, n_occurrences, n_records, mark) of every value of every field.

    mark: 'rare' below RARE_RECORDS records, 'common' above COMMON_SHARE of all records of the
    field (nulls included), else null. An empty table gives no rows.
    """
    blocks = cut(blocks)
    ids = cut(dictionary(blocks))
    encoded = blocks.filter("val is not null").join(ids, ["field_name", "val"]).select("id", "occ", "rec")
    sums = encoded.repartition(F.floor(F.col("id") / RANGE)).mapInArrow(_sum_ranges, "id long, occ long, rec long")
    totals = blocks.filter("val is null").groupBy("field_name").agg(F.sum("rec").alias("of_records"))  # one row per field
    mark = F.when(F.col("rec") < RARE_RECORDS, "rare").when(F.col("rec") > F.col("of_records") * COMMON_SHARE, "common")
    return sums.join(ids, "id").join(F.broadcast(totals), "field_name").select(
        "field_name", "val", F.col("occ").alias("n_occurrences"), F.col("rec").alias("n_records"), mark.alias("mark")
    )
