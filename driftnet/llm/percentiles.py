"""Percentiles of very large numeric columns by radix selection (problem 7).

A double is mapped to an integer of the same order. Histograms of successive 16-bit digits are additive over rows,
partitions and days; each round counts one digit and keeps only the digit that holds a wanted rank, so four rounds
give the exact value and no group is ever sorted or gathered. A one-round histogram of the leading ``bits`` bits is
the mergeable form: its answers are off by at most a relative ``2 ** (12 - bits)`` (sign and exponent take 12 bits).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftnet.runtime import materialize

DIGIT = 16
ROUNDS = 4
PROBS = (0.5, 0.9, 0.99)


def order_bits(values: np.ndarray) -> np.ndarray:
    """Doubles to signed 64-bit integers of the same order; -0.0 equals 0.0."""
    raw = (np.asarray(values, dtype=np.float64) + 0.0).view(np.int64)
    return raw ^ ((raw >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


def value_of(bits: np.ndarray) -> np.ndarray:
    """The inverse of :func:`order_bits`."""
    bits = np.asarray(bits, dtype=np.int64)
    return (bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


@F.pandas_udf(T.LongType())
def _to_bits(s: pd.Series) -> pd.Series:
    return pd.Series(order_bits(s.to_numpy(dtype=np.float64)))


@F.pandas_udf(T.DoubleType())
def _to_value(s: pd.Series) -> pd.Series:
    return pd.Series(value_of(s.to_numpy(dtype=np.int64)))


def once_per_id(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Rows delivered again (same id) count once; which copy stays doesn't matter where copies are equal, else the
    least row in column order stays. Rows without an id are kept all: nothing says they are copies."""
    known = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.struct(*columns)).alias("_r")).select("_r.*")
    return known.unionByName(df.where(F.col(id_col).isNull()).select(*columns))


def _prepared(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Internal names, so that no column of the caller clashes; null and NaN values are not counted."""
    if reserved := {"p", "n", "cell", "low", "high"} & set(keys):
        raise ValueError(f"rename the keys {sorted(reserved)}: results have columns of these names")
    cols = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).select(*cols, _to_bits(v).alias("_b"))


def _match(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Null-safe inner join on ``names``, keeping the left copy."""
    renamed = right.select(*[F.col(n).alias(f"_right{n}") if n in names else F.col(n) for n in right.columns])
    on = [F.col(n).eqNullSafe(F.col(f"_right{n}")) for n in names]
    return left.join(renamed, on).drop(*[f"_right{n}" for n in names])


def _step(hist: DataFrame, want: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From counts a digit and wanted ranks within the prefix to the digit that holds each rank and the rank in it."""
    w = Window.partitionBy(*keys, "_pre").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("_cum", F.sum("_n").over(w))
    return (
        _match(cum, want, [*keys, "_pre"])
        .where((F.col("_rank") <= F.col("_cum")) & (F.col("_rank") > F.col("_cum") - F.col("_n")))
        .select(
            *keys, "p", "n",
            (F.col("_rank") - (F.col("_cum") - F.col("_n"))).alias("_rank"),
            (F.col("_pre") * (1 << DIGIT) + F.col("_d")).alias("_pre"),
        )
    )


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = PROBS) -> DataFrame:
    """Exact percentiles of ``value`` for each group: columns keys, p, n, value.

    The p-th percentile is the value of rank ceil(p * n), at least 1, in ascending order. Null and NaN values do not
    count, infinities do; a group without values gives no row; null keys form a group; equal values are fine, and an
    empty table gives an empty result. A group's histogram has at most 65,536 rows a round and is counted before the
    shuffle, so a group that holds a third of all rows costs no task more than that.
    """
    base = materialize(_prepared(df, keys, value), "radix")
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = base.withColumn("_pre", F.lit(0).cast("long"))
    want = None
    for r in range(ROUNDS):
        shift = 64 - DIGIT * (r + 1)
        digit = F.shiftright("_b", shift)
        digit = digit if r == 0 else digit.bitwiseAND((1 << DIGIT) - 1)
        hist = rows.groupBy(*ks, "_pre", digit.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
        if want is None:
            sizes = hist.groupBy(*ks).agg(F.sum("_n").alias("n"))
            want = sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
            rank = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n") - F.lit(1e-9))).cast("long")
            want = want.select(*ks, "p", "n", rank.alias("_rank"), F.lit(0).cast("long").alias("_pre"))
        want = materialize(_step(hist, want, ks), f"radix-round{r}")
        if r + 1 < ROUNDS:
            rows = base.withColumn("_pre", F.shiftright("_b", shift))
            rows = _match(rows, want.select(*ks, "_pre").distinct(), [*ks, "_pre"])
    return want.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)], "p", "n", _to_value("_pre").alias(value))


def leading_histogram(df: DataFrame, keys: Sequence[str], value: str, bits: int = 28) -> DataFrame:
    """The mergeable form: counts by the leading ``bits`` of the ordered value; columns keys, cell, n.

    Histograms of any partitions or days add up cell by cell. At 28 bits the relative error is below 2 ** -16.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    h = _prepared(df, keys, value).groupBy(*ks, F.shiftright("_b", 64 - bits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return h.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)], "cell", "n")


def merged_percentiles(histogram: DataFrame, keys: Sequence[str], probs: Sequence[float] = PROBS, bits: int = 28) -> DataFrame:
    """Percentiles from histograms merged over whatever is not in ``keys``: columns keys, p, n, low, high.

    The true percentile lies in [low, high]. ``keys`` may drop columns of the histogram (days, partitions).
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    h = histogram.select(*[F.col(name).alias(k) for k, name in zip(ks, keys, strict=True)], "cell", "n")
    h = h.groupBy(*ks, "cell").agg(F.sum("n").alias("_n"))
    w = Window.partitionBy(*ks).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("_cum", F.sum("_n").over(w)).withColumn("n", F.sum("_n").over(Window.partitionBy(*ks)))
    h = h.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    rank = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n") - F.lit(1e-9)))
    h = h.where((rank <= F.col("_cum")) & (rank > F.col("_cum") - F.col("_n")))
    low = F.shiftleft("cell", 64 - bits)
    return h.select(
        *[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)], "p", "n",
        # bit patterns past the infinities are no numbers
        F.coalesce(_to_value(low), F.lit(float("-inf"))).alias("low"), F.coalesce(_to_value(low.bitwiseOR((1 << (64 - bits)) - 1)), F.lit(float("inf"))).alias("high"),
    )
