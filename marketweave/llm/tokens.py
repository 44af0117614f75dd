"""Token counts of texts with a public tokenizer's vocabulary; nothing is trained."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary files live here; the path is a parameter of every function that counts.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str, step: int = 100_000) -> int:
    """Tokens of a whole text. A long text is encoded in steps, so that time stays in proportion.

    Steps end before a single blank between two words, where the pattern ends a piece too, so the count is that of the whole. A run
    of more than ``step`` characters without such a blank is cut at its end; each such cut may add a token.
    """
    if len(text) <= step:
        return len(encoder(path).encode_ordinary(text))
    total, i = 0, 0
    while i < len(text):
        j = min(i + step, len(text))
        if j < len(text):
            k = text.rfind(" ", i + 1, j - 1)
            while k > i and (text[k - 1].isspace() or text[k + 1].isspace()):
                k = text.rfind(" ", i + 1, k)
            j = k if k > i else j
        total += len(encoder(path).encode_ordinary(text[i:j]))
        i = j
    return total


def with_token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Columns ``keep`` and ``tokens bigint``; a null or empty text has 0 tokens."""
    fields = df.select(*keep).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tokens bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_tokens(t, path) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=[*(f.name for f in fields), "tokens"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(count, schema)
