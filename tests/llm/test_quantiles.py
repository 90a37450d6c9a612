"""Exact percentiles and ranks against numpy, and combination of partial results."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm.quantiles import combine, daily_counts, percentiles
from tallyloom.operators.ranking import distributed_rank

SCHEMA = "day string, g string, v double, grp string, n int"


def made(n=3000, seed=1):
    rng = random.Random(seed)
    bad = [None, math.nan, math.inf, -math.inf, -1.0]
    out = []
    for _ in range(n):
        g = rng.choice(["hot"] * 6 + ["a", "b", None])
        v = rng.choice(bad) if rng.random() < 0.1 else rng.choice([7.0, rng.lognormvariate(2, 2)])
        out.append((rng.choice(["d1", "d2", None]), g, v, "x", 1))
    return out


def counts(df, e=0.0):
    return daily_counts(df, F.col("g"), F.col("day"), {"v": F.col("v")}, e)


def want(rows):
    by = {}
    for _, g, v, *_ in rows:
        if v is not None and not math.isnan(v) and 0 <= v < math.inf:
            by.setdefault(g, []).append(v)
    return {g: np.quantile(vs, [0.5, 0.9, 0.95, 0.99]) for g, vs in by.items()}


def test_percentiles_equal_numpy_and_combine(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole = {r.grp: r for r in percentiles(combine(counts(df)), parts=7).collect()}
    days = [counts(df.filter(c)) for c in ("day = 'd1'", "day = 'd2'", "day is null")]
    merged = {r.grp: r for r in percentiles(combine(combine(days[0], days[1]), days[2]), parts=3).collect()}
    expect = want(rows)
    assert set(whole) == set(expect)
    for g, q in expect.items():
        assert np.allclose([whole[g].p50, whole[g].p90, whole[g].p95, whole[g].p99], q, rtol=1e-12)
        assert whole[g] == merged[g]


def test_bounded_intermediates(spark):
    rows = made(seed=2)
    c = counts(spark.createDataFrame(rows, SCHEMA), 0.01)
    got = {r.grp: r for r in percentiles(combine(c)).collect()}
    for g, q in want(rows).items():
        assert np.allclose([got[g].p50, got[g].p90, got[g].p95], q[:3], rtol=0.011)


def test_empty_and_unusable(spark):
    assert percentiles(combine(counts(spark.createDataFrame([], SCHEMA)))).count() == 0
    assert percentiles(combine(counts(spark.createDataFrame([("d", "g", None, "", 1), ("d", "g", -1.0, "", 1)], SCHEMA)))).count() == 0
    one = percentiles(combine(counts(spark.createDataFrame([("d", "g", 3.5, "", 1)], SCHEMA)))).collect()
    assert [(r.n, r.p50, r.p99) for r in one] == [(1, 3.5, 3.5)]


def test_rank_spreads_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "x", None]), rng.randrange(50), i, "extra") for i in range(800)]
    df = spark.createDataFrame(rows, "k string, v int, id int, __n string").repartition(5)
    got = {r.id: r["rank"] for r in distributed_rank(df.drop("__n"), ["k"], ["v", "id"], parts=6).collect()}
    for k in ("hot", "x", None):
        order = sorted((v, i) for kk, v, i, _ in rows if kk == k)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))
    empty = spark.createDataFrame([], "k string, v int, id int")
    assert distributed_rank(empty, ["k"], ["v"]).count() == 0
