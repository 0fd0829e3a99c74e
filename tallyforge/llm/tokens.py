"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread

DEFAULT_VOCABULARY = os.environ.get("TALLYFORGE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The encoder of a vocabulary file of ranks, made once per worker."""
    import tiktoken

    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str) -> int:
    """Tokens of a whole text, whatever its length; a null text has none."""
    return len(encoder(vocabulary).encode_ordinary(text)) if text else 0


def with_tokens(docs: DataFrame, columns: list[str], text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``columns`` of the documents and ``tokens``, the size of ``text_col``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns=["__text"]).assign(tokens=[count_tokens(t, vocabulary) for t in b["__text"].array])

    source = docs.select(*columns, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")
    return spread(source).mapInPandas(run, f"{schema}, tokens long")
