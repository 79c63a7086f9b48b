"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches: Iterator[pa.RecordBatch], at: int, path: str) -> Iterator[pa.RecordBatch]:
    encode = encoding(path).encode_ordinary
    for batch in batches:
        sizes = [len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()]
        columns = [batch.column(i) for i in range(batch.num_columns) if i != at] + [pa.array(sizes, pa.int64())]
        names = [n for i, n in enumerate(batch.schema.names) if i != at] + ["n_tokens"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def with_token_sizes(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The table with n_tokens in place of its text column; null and empty texts have 0 tokens."""
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens long"
    at = docs.columns.index(text)
    return docs.mapInArrow(lambda it: _count(it, at, path), schema)
