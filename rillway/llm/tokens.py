"""Sizes of texts in tokens of a public tokenizer, counted on the executors."""

import base64
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def default_vocabulary() -> str:
    """Path of the multilingual byte-level vocabulary; RILLWAY_VOCABULARY names another."""
    path = os.environ.get("RILLWAY_VOCABULARY")
    if path:
        return path
    spec = importlib.util.find_spec("public_tokenizers")
    folder = spec.submodule_search_locations[0] if spec and spec.submodule_search_locations else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_multi_50k.tiktoken")


#: Fixed value: the split of texts before byte pairs are merged, as usual for byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def with_token_counts(df: DataFrame, text: str, vocabulary: str | None = None) -> DataFrame:
    """df with a column n_tokens; null and empty texts have 0. The vocabulary is read from its path on the executors."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int32")

    return df.withColumn("n_tokens", count(F.col(text)))
