"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of the tokenizer; give another path where it lies elsewhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(2)
def encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), path: str = TOKENIZER) -> DataFrame:
    """(key, *keep, n_tokens) of every row, over whole texts; NULL and empty texts have 0 tokens."""
    picked = documents.select(documents[key].alias("k"), *[documents[c].alias(f"c{n}") for n, c in enumerate(keep)], documents[text].alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema if f.name != "t") + ", n_tokens int"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*b.schema.names[:-1], "n_tokens"])

    return picked.mapInArrow(count, schema).select(F.col("k").alias(key), *[F.col(f"c{n}").alias(c) for n, c in enumerate(keep)], "n_tokens")
