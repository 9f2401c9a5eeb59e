"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Scaled to length 1 as floats; an all-zero vector stays. The length is bound once, not computed again for each element."""
    scaled = F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v.cast("array<float>")))
    return scaled[0]


def distances_to(query: Sequence[float]):
    """A function from a vector column to its squared distance from the query, both at unit length: a matrix product for each
    Arrow batch. Vectors must have the query's length."""
    q = _unit(np.asarray([query], dtype=np.float64))[0]

    def squared(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype="float64")
        x = _unit(np.concatenate(s.to_numpy()).reshape(len(s), len(q)).astype(np.float64))
        return pd.Series(((x - q) ** 2).sum(axis=1))

    return F.pandas_udf(squared, T.DoubleType())


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length, rounded to floats as they are stored; all-zero rows stay."""
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(n > 0, x / np.where(n > 0, n, 1), x).astype(np.float32).astype(np.float64)


def squared_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def similarity(squared: Column) -> Column:
    """Cosine of unit vectors from their squared distance, not below 0."""
    return F.greatest(F.lit(0.0), 1.0 - squared / 2.0)


def checked(v: Column, dim: int) -> Column:
    """The vector, or an error where its length isn't ``dim``: a model of another size must not slip in."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} values, got "), F.size(v).cast("string"))))
