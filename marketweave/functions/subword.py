"""Subword token counts with the vocabulary of a public tokenizer; nothing is trained."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A lower-casing word-piece-like vocabulary; the path is a parameter.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def subword_count(text: Column, path: str = VOCABULARY, special: int = 2) -> Column:
    """Subwords of a text and ``special`` marks around it; null for a null text. Whole texts are counted."""

    @F.pandas_udf("bigint")
    def batch(texts: pd.Series) -> pd.Series:
        told, counts = [t for t in texts if isinstance(t, str)], []
        for i in range(0, len(told), 100):  # what is coded takes many times a text's memory
            counts += [len(c.ids) + special for c in _tokenizer(path).encode_batch(told[i:i + 100], add_special_tokens=False)]
        coded = iter(counts)
        return pd.Series([next(coded) if isinstance(t, str) else None for t in texts], dtype="Int64")

    return batch(text)
