"""Vector functions over arrays of floats, in double precision, and base64 import and export.

Nulls and vectors of other lengths give null. A vector of length zero has cosine similarity 0 to all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def l2(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def score(a: Column, b: Column, metric: str) -> tuple[Column, Column]:
    """(raw value, rank score) of a metric: cosine (raw is the distance), dot or l2 (rank is the negative distance)."""
    if metric == "cosine":
        sim = cosine(a, b)
        return 1 - sim, sim
    if metric == "dot":
        return dot(a, b), dot(a, b)
    if metric == "l2":
        return l2(a, b), -l2(a, b)
    raise ValueError(f"unknown metric {metric}")


def is_unit(a: Column, tolerance: float = 0.01) -> Column:
    return F.abs(norm(a) - 1) < tolerance


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _floats(raw: pd.Series) -> pd.Series:
    """The values of byte strings; one conversion for a batch."""
    sizes = np.fromiter((len(x) if x is not None else 0 for x in raw), dtype=np.int64, count=len(raw))
    fine = (sizes > 0) & (sizes % 4 == 0)
    values = np.frombuffer(b"".join(x for x, ok in zip(raw, fine) if ok), "<f4")
    parts = iter(np.split(values, np.cumsum(sizes[fine] // 4)[:-1]) if fine.any() else [])
    return pd.Series([next(parts) if ok else None for ok in fine], dtype=object)


def decode_base64(text: Column | str) -> Column:
    """Little-endian float32 values; null if the text is no base64 or its bytes are no whole number of them."""
    return _floats(F.try_to_binary(text, F.lit("base64")))


@F.pandas_udf(T.StringType())
def encode_base64(v: pd.Series) -> pd.Series:
    import base64

    return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())
