"""Survey of documents, visibility, variants, and small functions and scores."""

import json

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import evaluation
from tidemark.sources import openapi


def test_survey(spark, tmp_path):
    good = {"openapi": "3.0.1", "paths": {"/a": {"get": {"responses": {"200": {"content": {"application/json": {"schema": {"oneOf": [{"type": "string"}, {"type": "object", "properties": {"x": {}}}]}}}}}}}}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.yaml").write_text("openapi: 3.1.0\npaths:\n  /b:\n    post:\n      responses: {'204': {}}\n")
    (tmp_path / "c.json").write_text('{"swagger": "2.0"}')
    (tmp_path / "d.json").write_text("{")
    (tmp_path / "e.yaml").write_bytes(b"\xff\xfe")
    rows = {r["file"].rsplit("/", 1)[1]: r for r in openapi.specifications(spark, str(tmp_path)).collect()}
    assert {k: r["category"] for k, r in rows.items()} == {"a.json": "parsed", "b.yaml": "parsed", "c.json": "not OpenAPI 3", "d.json": "unreadable", "e.yaml": "unreadable"}
    assert (rows["a.json"]["operations"], rows["a.json"]["fields"]) == (1, 2) and rows["a.json"]["unsupported"] > 0 and rows["d.json"]["error"]


def test_views_of_schemas():
    s = openapi.Spec({"openapi": "3.0.0", "paths": {}})
    one = s.view({"anyOf": [{"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "string"}}}, {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "c": {}}}]})
    assert one.types == {"object"} and one.required == {"a"} and list(one.properties) == ["a", "c"] and one.properties["a"] == {"type": "string"}
    assert s.view({"oneOf": [{"const": 1}, {"enum": [1, 2]}]}).enum == ("1", "2") and s.view({"oneOf": [{"const": 1}, {}]}).enum is None
    secret, computed = s.view({"writeOnly": True}), s.view({"readOnly": True})
    assert [openapi.visible(v, d) for v in (secret, computed) for d in ("request", "response")] == [True, False, False, True]


def test_paths_of_templates(spark):
    row = spark.range(1).select(
        C.normalise_path(F.lit("/a/{id}/{x}-{y}")).alias("shape"), C.template_names(F.lit("/a/{id}/{x}-{y}")).alias("names"), C.map_value_path(F.lit("$.m")).alias("values"), C.media_key(F.lit(" Application/JSON ; charset=utf-8")).alias("media")
    ).first()
    assert (row["shape"], row["names"], row["values"], row["media"]) == ("/a/{}/{}-{}", ["id", "x", "y"], "$.m.*", "application/json")


def test_scores(spark):
    found, truth = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, n int"), spark.createDataFrame([("a", 1), ("c", 3), ("d", 4)], "k string, n int")
    assert tuple(evaluation.drift_counts(found, truth, ["k", "n"]).first()) == (1, 2, 1)
    said, real = spark.createDataFrame([(1, "HIGH"), (2, "LOW"), (3, "LOW")], "id int, severity string"), spark.createDataFrame([(1, "HIGH"), (2, "HIGH"), (3, "LOW"), (4, "LOW")], "id int, severity string")
    assert {(r["truth"], r["said"]): r["count"] for r in evaluation.severity_matrix(said, real).collect()} == {("HIGH", "HIGH"): 1, ("HIGH", "LOW"): 1, ("LOW", "LOW"): 1}
