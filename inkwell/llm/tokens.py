"""Token counts with a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern this vocabulary splits text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), path: str = DEFAULT) -> DataFrame:
    """(key, *keep, tokens); a null text has no tokens. One pass, no shuffle."""
    kept = df.select(key, *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for pdf in batches:
            if not len(pdf):
                continue
            yield pdf.drop(columns="_text").assign(tokens=[0 if t is None else len(encode(t)) for t in pdf["_text"]])

    return df.selectExpr(*[f"`{c}`" for c in (key, *keep)], f"`{text}` as _text").mapInPandas(run, fields + ", tokens long")
