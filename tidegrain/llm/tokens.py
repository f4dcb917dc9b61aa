"""Sizes of texts in tokens of a public byte-pair vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.session import spread

#: Vocabulary file: one base64 token and its rank per line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern of byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_sizes(documents: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``tokens``: the size of every text, 0 for null and empty ones. One pass, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for f in frames:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in f["_text"]]
            yield f.drop(columns="_text").assign(tokens=sizes)

    rows = spread(documents.select(*keep, F.col(text).alias("_text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInPandas(run, f"{schema}, tokens bigint")
