"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a byte-level vocabulary for many languages; every executor reads it from this path
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: the pattern by which the vocabulary's texts were cut before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(vocabulary: str, pattern: str):
    """The tokenizer, made once in each worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, id_: str, text: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, keep, n_tokens): the number of tokens of each whole text; null and empty texts have 0."""
    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in (id_, *keep))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokenizer = encoding(vocabulary, pattern)
            n = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch[text]]
            yield batch[[id_, *keep]].assign(n_tokens=n)

    return documents.select(id_, *keep, F.col(text).alias(text)).mapInPandas(count, f"{kinds}, n_tokens long")
