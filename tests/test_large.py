"""What lets tables grow: no broadcast of tables that grow with the input, tasks of bounded size."""

import json
import pickle

from pyspark.sql import functions as F

from tidemark.operators import diff, explorer, shapes
from tidemark.plans import bridge, contracts, queries
from tidemark.sources import archive, openapi, traffic
from tidemark.streaming import store


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_dealt(spark, tmp_path):
    """a part table of one file kept one core busy."""
    row = [F.col("id").alias("p_partkey"), F.lit(3).alias("p_size"), F.lit("TIN").alias("p_type"), F.lit("a").alias("p_name")]
    spark.range(300).select(*row).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    docs = contracts.documents(spark, str(tmp_path), ("old",))
    assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert docs.count() == 300
    rows = openapi.declarations(docs)
    assert rows.count() == 300 * 64
    assert rows.where("field = '$.container'").first()["enum"] == ["TIN"]


def test_bad_references_still_count():
    """what is remembered of references leaves the notes on unsupported ones as they were."""
    body = {"type": "object", "properties": {"a": {"$ref": "#/components/schemas/No"}, "b": {"$ref": "#/components/schemas/B"}}}
    answer = {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/A"}}}}}
    spec = openapi.Spec({"openapi": "3.0.0", "paths": {"/x": {"get": {"responses": answer}}, "/y": {"get": {"responses": answer}}}, "components": {"schemas": {"A": body, "B": {"type": "string"}}}})
    assert [(r[0], r[3], r[4]) for r in spec.declared()] == [(f"GET /{p}", f, t) for p in "xy" for f, t in (("$", ["object"]), ("$.a", []), ("$.b", ["string"]))]
    assert len([u for u in spec.unsupported if u[0] == "dangling reference"]) == 6


def test_details_are_not_broadcast(spark, tmp_path):
    """fields of all documents went through the driver, as their files looked small."""
    spark.createDataFrame([("a", "GET /x", "response.body", "200", "$", ["object"], True, None, True)], f"spec string, {openapi.DECLARED}").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([("a", "GET /x", "200")], "spec string, operation string, answer string").write.parquet(str(tmp_path / "r"))
    d, r = (spark.read.parquet(str(tmp_path / n)) for n in "dr")
    out = explorer.operation_details(d, r.select("spec", "operation"), r, ("spec", "operation"))
    assert "Broadcast" not in _plan(out)
    assert out.first()["answers"] == ["200"]


def test_differences_are_not_broadcast(spark):
    """tables of schemas went through the driver."""
    text = '{"openapi": "3.0.0", "paths": {"/x": {"get": {"responses": {"200": {"content": {"application/json": {"schema": {"type": "%s"}}}}}}}}}'
    graphs = openapi.graphs(spark.createDataFrame([("o", text % "string"), ("n", text % "number")], "spec string, text string"))
    out = diff.diff(spark.createDataFrame([(0, "o", "n")], "pair int, old string, new string"), graphs)
    assert "Broadcast" not in _plan(out)
    assert [r["kind"] for r in out.collect()] == ["response_type_changed"]


def test_tasks_on_traffic_hold_few_events(spark, tmp_path, monkeypatch):
    """tasks that count cells grew with the table, as there were as many as cores."""
    monkeypatch.setattr(bridge, "EVENTS", 50)
    kind = F.element_at(F.array(*map(F.lit, ("view", "purchase", "other"))), (F.col("id") % 3 + 1).cast("int"))
    columns = ["id AS event_id", "timestamp_ntz'2024-01-02 03:04:05' AS ts", "id % 7 AS user_id", "2.0D AS value", "concat('{\"k\":', id % 9, '}') AS props"]
    spark.range(1000).selectExpr("id", *columns).withColumn("event_type", kind).drop("id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert bridge.traffic(spark, str(tmp_path)).rdd.getNumPartitions() >= 20
    parts = []
    build = store.cube.build_cells
    monkeypatch.setattr(store, "EVENTS", 50)
    monkeypatch.setattr(store.cube, "build_cells", lambda df: parts.append(df.rdd.getNumPartitions()) or build(df))
    held = store.Store(spark, str(tmp_path / "store"), bridge.known_routes(spark))
    held.append(bridge.traffic(spark, str(tmp_path)), "all")
    assert parts[0] >= 20
    assert held.cells().where("kind = 'EVENT'").agg(F.sum("count")).first()[0] == 1000


def test_equal_shapes_are_made_once(spark, monkeypatch):
    """each text's shape became Arrow values by itself, and each name was matched again."""
    openapi.child_path("$", "lines")
    hits = openapi._suffix.cache_info().hits
    assert openapi.child_path("$", "lines") == "$.lines" and openapi._suffix.cache_info().hits == hits + 1
    texts = ['{"a":1,"b":[1,"x"]}', '{"a":2,"b":["y",3]}', "no", None, '{"a":1.5}', '{"a":1,"b":[1,"x"]}']
    rows = shapes.shapes(spark.createDataFrame(list(enumerate(texts)), "id int, body string").coalesce(1), "id", "body").collect()
    found = {}
    for r in rows:
        found.setdefault(r["id"], []).append((r["path"], r["types"]))
    same = [("$", ["object"]), ("$.a", ["integer"]), ("$.b", ["array"]), ("$.b[]", ["integer", "string"])]
    assert found == {0: same, 1: same, 4: [("$", ["object"]), ("$.a", ["number"])], 5: same}


def test_tasks_get_their_own_range_only():
    """all ranges of all archives went to each task."""
    ranges = [["file:/a", 1 << 20, n, False, 0, False, False] for n in range(1000)]
    reader = pickle.loads(pickle.dumps(archive._Reader({"chunk": "1024", "ranges": json.dumps(ranges)})))
    assert len(reader.partitions()) == len(reader.partitions()) == 1000
    assert len(pickle.dumps(reader)) < 1000


def test_lines_are_parsed_once(spark):
    """a filter on parsed events went below the parser and parsed each line again for each part of it."""
    out = traffic.parse_lines(spark.createDataFrame([("x",), (None,), ('{"v":1,"ts":"2024-01-02T03:04:05Z","method":"GET","path":"/a","status":200}',)], "value string"))
    plan = out.where("rejected IS NULL").select("path", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert [r["rejected"] for r in out.collect()] == ["not JSON", "not JSON", None]


def test_impact_is_counted_once(spark, monkeypatch):
    """the scores and the truth that they are held against each counted the impact of all changes."""
    columns = ["cast(id AS int) AS id", "'LOW' AS severity", "id AS clients", "id AS requests", "cast(id + 1 AS int) AS rank", "cast(id + 1 AS int) AS rank_spec_only"]
    made = spark.range(6).selectExpr(*columns)
    monkeypatch.setattr(queries, "_impact", lambda *_: made)
    out = queries.comparator_top5(spark, "")
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["ranking"]: r["top5"] for r in out.collect()}["volume_only"] == 1.0
