"""Kendall's tau by counting inversions against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import statistics


def pairs(rows):
    """tau-b by comparing each row with each other one."""
    c = nx = ny = 0
    sign = lambda v: (v > 0) - (v < 0)
    for i, (a, b) in enumerate(rows):
        for x, y in rows[:i]:
            s, t = sign(a - x), sign(b - y)
            c, nx, ny = c + s * t, nx + s * s, ny + t * t
    return c / math.sqrt(nx * ny) if nx and ny else None


@pytest.mark.parametrize("range_rows", [7, 100_000])
def test_equal_to_all_pairs(spark, monkeypatch, range_rows):
    monkeypatch.setattr(statistics, "RANGE_ROWS", range_rows)
    rng = random.Random(range_rows)
    groups = {
        "free": [(rng.random(), rng.random()) for _ in range(150)], "tied": [(rng.randrange(8), rng.randrange(5)) for _ in range(200)], "hot": [(rng.choice([3, 3, 3, rng.random() * 9]), rng.randrange(40)) for _ in range(200)],
        "same": [(i, i) for i in range(30)], "back": [(i, -i) for i in range(30)], "flat": [(1, i) for i in range(9)], "one": [(1, 1)],
    }
    rows = [(g, i, float(x), float(y)) for g, r in groups.items() for i, (x, y) in enumerate(r)] + [("free", 999, None, 1.0), ("free", 998, 1.0, math.nan)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double")
    got = {r["g"]: r["tau"] for r in statistics.kendall_tau(df, "id", "x", "y", "g").collect()}
    assert set(got) == set(groups)
    for g, r in groups.items():
        want = pairs(r)
        assert (got[g] is None) == (want is None) and (want is None or abs(got[g] - want) < 1e-12), g
    alone = statistics.kendall_tau(df.where("g = 'tied'"), "id", "x", "y").first()[0]
    assert abs(alone - pairs(groups["tied"])) < 1e-12


def test_a_million_rows(spark):
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select("id", F.col("id").cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(F.col("id") - 1).cast("double").alias("y"))
    out = statistics.kendall_tau(df, "id", "x", "y")
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    # Every other neighbour is swapped: n / 2 of n (n - 1) / 2 pairs.
    assert abs(out.first()["tau"] - (1 - 2 * (n / 2) / (n * (n - 1) / 2))) < 1e-12
