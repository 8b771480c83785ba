"""Scores against values counted by hand, places against a sort."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, statistics, views

FIELD = "operation string, part string, status string, field string"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_bounds(spark):
    """Of four fields that could be called unused three were: one never comes, one comes less than its bound, one more."""
    at = lambda f: ("A", "request.body", "0", f)
    could = spark.createDataFrame([at("$.never"), at("$.rare"), at("$.often"), at("$.seen"), ("A", "request.query", "0", "$.q")], FIELD)
    said = spark.createDataFrame([(*at("$.never"), 0.1), (*at("$.rare"), 0.1), (*at("$.often"), 0.1)], FIELD + ", bound double")
    truth = [("$", 0.5), ("$.rare", 0.04), ("$.often", 0.1), ("$.seen", 0.5)]
    truth = spark.createDataFrame([("A", "request.body", 0, f, p) for f, p in truth], FIELD.replace("status string", "status int") + ", presence double")
    [found] = rows(evaluation.bound_calibration(could, said, truth))
    assert found == {"statements": 3, "covered": 2, "occurring": 2, "covered_occurring": 1, "eligible": 3, "wrong": 1, "coverage": pytest.approx(2 / 3), "coverage_occurring": 0.5, "wrong_rate": pytest.approx(1 / 3)}
    [none] = rows(evaluation.bound_calibration(could.limit(0), said.limit(0), truth))
    assert none["statements"] == 0 and none["coverage"] is None and none["wrong_rate"] is None


def test_share_error(spark):
    pairs = lambda x: spark.createDataFrame(x, "id int, client string")
    truth = pairs([(1, c) for c in "abcd"] + [(2, "a"), (3, "e")])
    found = pairs([(1, "a"), (1, "a"), (1, "b"), (2, "a")])
    everyone = pairs([(0, c) for c in "abcdefghij"])
    # Shares found of four known clients: 2/4, 1/4 and none; true ones of ten: 4/10, 1/10, 1/10.
    [x] = rows(evaluation.share_error(found, everyone.where("client < 'e'"), truth, everyone, "id"))
    assert x["rows"] == 3 and x["mean"] == pytest.approx((0.1 + 0.15 + 0.1) / 3) and x["p90"] == pytest.approx(0.14)
    [x] = rows(evaluation.share_error(found.limit(0), everyone.limit(0), truth, everyone, "id"))
    assert x["mean"] == pytest.approx(0.2)


def test_types_and_severities(spark):
    t = lambda x: spark.createDataFrame([("A", "response.body", "200", f, k) for f, k in x], FIELD + ", type string")
    found, truth = t([("$.a", "string"), ("$.b", "integer"), ("$.x", "null")]), t([("$.a", "string"), ("$.b", "integer"), ("$.b", "number"), ("$.c", "object"), ("$.d", "array")])
    [x] = rows(evaluation.type_quality(found, truth))
    assert x == {"found": 3, "true": 4, "both": 2, "same_types": 1, "precision": pytest.approx(2 / 3), "recall": 0.5, "type_accuracy": 0.5}
    s = lambda x: spark.createDataFrame(list(enumerate(x)), "id int, severity string")
    matrix = evaluation.severity_matrix(s(["HIGH", "LOW", "LOW"]), s(["HIGH", "HIGH", "LOW"]))
    assert sorted(tuple(r) for r in matrix.collect()) == [("HIGH", "HIGH", 1), ("HIGH", "LOW", 1), ("LOW", "LOW", 1)]
    assert rows(evaluation.severity_agreement(matrix)) == [{"rows": 3, "agreement": pytest.approx(2 / 3)}]


def test_agreement_classes(spark):
    a = spark.createDataFrame([("x", f"{i:02}") for i in range(20)] + [("y", "00")], "op string, client string")
    b = spark.createDataFrame([("x", f"{i:02}") for i in range(8, 20)] * 2, "op string, client string")
    found = {(r["op"], r["verdict"]): (r["n"], r["examples"]) for r in rows(statistics.agreement_classes(a, b, ["op", "client"], "op"))}
    assert found == {("x", "both"): (12, ["08", "09", "10", "11", "12"]), ("x", "only_a"): (8, ["00", "01", "02", "03", "04"]), ("y", "only_a"): (1, ["00"])}


def test_places(spark):
    """Places of all rows in one order, where one value holds most rows."""
    rng = random.Random(3)
    data = [(f"c{i:05}", rng.choice(["01", "01", "01", "11", "00", "10"])) for i in range(5000)]
    table = spark.createDataFrame(data, "client string, bits string").repartition(7)
    found = views.placed(table, F.desc("bits"), F.col("client"))
    ordered = sorted(data, key=lambda r: (-int(r[1], 2), r[0]))
    assert [(r.client, r.bits) for r in sorted(found.collect(), key=lambda r: r.place)] == ordered
    assert sorted(r.place for r in found.collect()) == list(range(1, 5001))
    assert views.placed(table.limit(0), "client").count() == 0
