import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftnet.llm import percentiles as P


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
def test_bits_keep_the_order(values):
    bits = P.order_bits(np.array(values))
    assert np.array_equal(np.argsort(bits, kind="stable"), np.argsort(np.array(values) + 0.0, kind="stable"))
    assert np.array_equal(P.value_of(bits), np.array(values) + 0.0)


def _rows(n=900):
    rng = random.Random(4)
    kinds = ["a"] * 8 + ["b", None]
    special = [0.0, -0.0, -1.5, 1e300, -1e300, float("inf"), float("nan"), None, 5e-324]
    return [(i, rng.choice(kinds), rng.choice(special) if rng.random() < 0.2 else rng.lognormvariate(0, 2), i // 300) for i in range(n)]


def test_exact_and_merged(spark):
    rows = _rows()
    df = spark.createDataFrame(rows + rows[:50], "id long, k string, x double, day int").withColumn("n", F.lit("clash")).withColumn("p", F.lit(1))
    once = P.once_per_id(df, "id", ["k", "x", "day", "n", "p"])
    assert once.count() == len(rows)
    got = {(r["k"], r["p"]): (r["n"], r["x"]) for r in P.percentiles(once, ["k"], "x").collect()}
    low = {(r["k"], r["p"]): (r["n"], r["low"], r["high"]) for r in P.merged_percentiles(P.leading_histogram(once, ["k", "day"], "x"), ["k"]).collect()}
    for k in ("a", "b", None):
        own = sorted(v for _, kk, v, _ in rows if kk == k and v is not None and not math.isnan(v))
        for p in P.PROBS:
            want = own[max(1, math.ceil(p * len(own) - 1e-9)) - 1]
            assert got[k, p] == (len(own), want)
            n, a, b = low[k, p]
            assert n == len(own) and a <= want <= b and (b - a <= abs(want) * 2**-15 + 1e-300 or math.isinf(want))
    assert len(got) == 9


def test_no_rows_and_no_keys(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert P.percentiles(empty, ["k"], "x").count() == 0
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", None)], "k string, x double")
    assert [(r["n"], r["x"]) for r in P.percentiles(df, [], "x", [0.5]).collect()] == [(2, 1.0)]
