"""Sanitising, sinks, drift and impact on a small service, by hand."""

import base64
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells, diff, drift, evaluation, explorer, impact, report, routes, sanitise, shapes, views
from tidemark.plans import bridge, queries
from tidemark.sources import openapi, traffic

END = datetime(2026, 9, 30, 12)


def obj(**p):
    need = [k for k, v in p.items() if v.pop("need", 0)]
    return {"type": "object", "properties": p, "required": need}


def service(first: bool) -> openapi.Spec:
    s = lambda t, **k: {"type": t, **k}
    sent = obj(email=s("string", need=1), **({"phone": s("string")} if first else {}), age=s("number" if first else "integer", **({} if first else {"need": 1})), plan=s("string", enum=["free", "pro", "team"][: 3 if first else 2]))
    got = obj(id=s("integer", need=1), email=s("string", need=1), **({"legacy_id": s("integer")} if first else {}), unused_note=s("string"))
    answer = lambda *codes: {c: {"content": {"application/json": {"schema": got}}} for c in codes}
    one = {"parameters": [{"name": "id", "in": "path", "required": True, "schema": s("integer")}], "get": {"responses": answer("200") | {"404": {}}}}
    if first:
        one["delete"] = {"responses": {"204": {}}}
    post = {"requestBody": {"content": {"application/json": {"schema": sent}}}, "parameters": [{"name": "dry_run", "in": "query", "schema": s("string")}], "responses": answer("201") | {"400": {}}}
    return openapi.Spec({"openapi": "3.0.3", "info": {"title": "members", "version": "1"}, "paths": {"/members": {"post": post}, "/members/{id}": one}})


def calls():
    """(client, days ago, method, path, query, body types, values, status, answer fields)."""
    out = []
    for d in range(5):
        out.append(("web", d, "POST", "/members", [], {"email": "string", "phone": "string", "age": "integer", "plan": "string"}, "pro", 201))
        out.append(("mobile", d, "POST", "/members", ["dry_run"], {"email": "string", "age": "number", "plan": "string"}, "team", 201))
        out.append(("reader", d, "GET", "/members/7", [], None, None, 200))
    out.append(("mobile", 1, "POST", "/members", [], {"email": "string"}, None, 400))
    out.append(("batch", 20, "POST", "/members", [], {"email": "string", "phone": "string", "age": "integer", "plan": "string"}, "free", 201))
    out.append(("legacy", 45, "DELETE", "/members/9", [], None, None, 204))
    out.append(("legacy", 45, "GET", "/members/9", [], None, None, 200))
    return out


def events(spark, rows):
    made = []
    for client, days, method, path, query, body, plan, status in rows:
        ts = END - timedelta(days=days)
        fields = lambda f: [{"path": "$", "types": ["object"], "values": None}] + [{"path": f"$.{k}", "types": [t], "values": [plan] if k == "plan" else None} for k, t in f.items()]
        answer = fields({"id": "integer", "email": "string"}) if status in (200, 201) else None
        q = [{"path": f"$.{n}", "types": ["string"], "values": None} for n in query]
        made.append((ts, method, None, path, status, 5.0, client, q, fields(body) if body else None, answer, False))
    return spark.createDataFrame(made, traffic.EVENT)


@pytest.fixture(scope="module")
def known(spark):
    old, new = service(True), service(False)
    r = routes.build_routes([(o.method, o.path) for o in old.operations()])
    cube = cells.build_cells(routes.resolve(events(spark, calls()), r)).cache()
    return {"old": old, "new": new, "routes": r, "cube": cube, "tables": openapi.tables(spark, old), "changes": diff.diff_documents(spark, old, new).cache()}


def rows_of(known, **config):
    rows = impact.impact(known["cube"], known["changes"], known["tables"]["responses"], impact.Config(**config)).collect()
    return {(r["kind"], r["operation"], r["field"]): r for r in rows}


def test_impact_by_hand(known):
    rows = rows_of(known)
    phone = rows["request_field_removed", "POST /members", "$.phone"]
    assert (phone["clients"], phone["requests"], phone["recent"], phone["stale"], phone["active"], phone["severity"]) == (2, 6, 1, 2, 3, "HIGH")
    need = rows["request_field_made_required", "POST /members", "$.age"]
    assert (need["clients"], need["requests"]) == (1, 1)
    kind = rows["request_type_changed", "POST /members", "$.age"]
    assert (kind["clients"], kind["requests"]) == (1, 5)
    plan = rows["request_enum_narrowed", "POST /members", "$.plan"]
    assert (plan["clients"], plan["requests"]) == (1, 5)
    gone = rows["operation_removed", "DELETE /members/{id}", None]
    assert gone["severity"] == "DORMANT" and gone["rank"] == 5
    legacy = {op: rows["response_field_removed", op, "$.legacy_id"] for op in ("POST /members", "GET /members/{id}")}
    assert (legacy["POST /members"]["clients"], legacy["POST /members"]["requests"]) == (3, 11) and legacy["GET /members/{id}"]["clients"] == 2
    assert all(r["evidence"] == "POTENTIAL" and r["operations_touched"] == 2 for r in legacy.values())
    assert len(rows) == 7 and sorted(r["rank"] for r in rows.values() if r["evidence"] == "OBSERVED") == [1, 2, 3, 4, 5]
    assert sorted(r["rank_spec_only"] for r in legacy.values()) == [1, 2]
    assert rows_of(known, critical_clients=("batch",))["request_field_removed", "POST /members", "$.phone"]["severity"] == "HIGH"


def test_drift_by_hand(spark, known):
    more = [("reader", 0, "GET", "/members/8", ["expand"], None, None, 200)] * 300
    e = events(spark, calls() + more + [("reader", 0, "GET", "/members/8", [], None, None, 503), ("reader", 0, "POST", "/members", [], {"email": "string"}, None, 404), ("reader", 0, "GET", "/reports/{*}", [], None, None, 200)])
    extra = F.array(F.struct(F.lit("$.internal_flag").alias("path"), F.array(F.lit("boolean")).alias("types"), F.lit(None).cast("array<string>").alias("values")))
    wrong = F.transform("response_body", lambda f: F.struct(f["path"].alias("path"), F.when(f["path"] == "$.id", F.array(F.lit("string"))).otherwise(f["types"]).alias("types"), f["values"].alias("values")))
    e = e.withColumn("response_body", F.when(F.size("query") == 0, F.col("response_body")).when(F.col("method") == "GET", F.concat(wrong, extra)).otherwise(F.col("response_body")))
    cube = cells.build_cells(routes.resolve(e, known["routes"])).cache()
    d, r = known["tables"]["declared"], known["tables"]["responses"]
    got = {(x["operation"], x["part"], x["field"]): x["count"] for x in drift.undocumented_fields(cube, d, r).collect()}
    assert got == {("GET /members/{id}", "request.query", "$.expand"): 300, ("GET /members/{id}", "response.body", "$.internal_flag"): 300}
    got = {(x["operation"], x["field"], x["observed"]): x["count"] for x in drift.type_mismatches(cube, d, r).collect()}
    assert got == {("GET /members/{id}", "$.id", "string"): 300}
    got = {(x["operation"], x["field"]): x["of"] for x in drift.unused_fields(cube, d, r).collect()}
    assert got == {("GET /members/{id}", "$.legacy_id"): 306, ("GET /members/{id}", "$.unused_note"): 306}
    got = {(x["operation"], x["code"]): x["level"] for x in drift.undocumented_statuses(cube, r).collect()}
    assert got == {("GET /members/{id}", 503): "info", ("POST /members", 404): "warning"}
    assert [x["operation"] for x in drift.undocumented_operations(cube).collect()] == ["GET /reports/{*}"]


def exchange(**more):
    e = {"startedDateTime": "2026-01-02T03:04:05Z", "time": 2.5, "request": {"method": "post", "url": "https://h/members?dry_run=1&dry_run=2&x=%41", "headers": [{"name": "X-Api-Key", "value": "k"}, {"name": "When", "value": "2025-05-05T05:05:05Z"}], "postData": {"mimeType": "application/json", "text": '{"plan":"pro","email":"e","more":[{"a":1.5},{"a":null}]}'}}, "response": {"status": 201, "content": {"text": base64.b64encode(b'{"id":1}').decode(), "encoding": "base64"}}}
    return e | more


def test_sanitise(spark, known):
    other = exchange(request={"method": "GET", "url": "/shop/4711?b"}, response={"status": 99, "content": {"mimeType": "application/json", "text": "no json"}})
    lines = [json.dumps({"log": {"entries": [exchange(), other, {"time": 1}]}})]
    har = traffic.har_entries(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = sanitise.sanitise(har, known["routes"], known["old"], "salt", "api_key_hash", time_header="when").orderBy("method").collect()
    assert [(r["method"], r["operation"], r["path"], r["status"]) for r in rows] == [("GET", None, "/shop/{*}", 99), ("POST", "POST /members", None, 201)]
    get, post = rows
    assert get["client"] is None and [f["path"] for f in get["query"]] == ["$.b"] and get["response_body"] is None and str(get["ts"]) == "2026-01-02 03:04:05"
    assert len(post["client"]) == 16 and str(post["ts"]) == "2025-05-05 05:05:05" and [f["path"] for f in post["query"]] == ["$.dry_run", "$.x"]
    body = {f["path"]: (f["types"], f["values"]) for f in post["request_body"]}
    assert body["$.plan"] == (["string"], ["pro"]) and body["$.email"] == (["string"], None) and body["$.more[].a"] == (["null", "number"], None)
    assert [f["path"] for f in post["response_body"]] == ["$", "$.id"] and not post["truncated"]
    assert [r["skipped"] for r in traffic.har_entries(spark.createDataFrame([(lines[0],)], "value string"), strict=True).collect()] == [False, True, True]
    assert sanitise.sanitise(har).where("operation IS NULL AND client IS NULL").count() == 2


def test_shape_limits(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":{"c":1}}}'), (2, '{"a":1,"b":2}'), (3, "")], "id int, body string")
    got = {r["id"]: r["s"] for r in shapes.with_shape(df, "body", "s", depth=2).collect()}
    assert got[1]["truncated"] and [f["path"] for f in got[1]["fields"]] == ["$", "$.a", "$.a.b"] and not got[2]["truncated"] and got[3] is None
    few = shapes.with_shape(df, "body", "s", most=2).where("id = 2").first()["s"]
    assert few["truncated"] and len(few["fields"]) == 2


def test_sinks(spark, known, tmp_path):
    e = events(spark, calls())
    traffic.write_events(e, str(tmp_path / "events"))
    again = spark.read.parquet(str(tmp_path / "events"))
    assert again.count() == len(calls()) and traffic.retain(e, END - timedelta(days=30)).count() == len(calls()) - 2
    assert traffic.retain(known["cube"], "2026-09-01").where("day < DATE'2026-09-01'").isEmpty() and traffic.retain(known["cube"], "2026-09-01").count() > 0
    traffic.to_lines(e).select("value").write.text(str(tmp_path / "lines"))
    assert traffic.read_lines(spark, str(tmp_path / "lines")).where("rejected IS NULL").count() == len(calls())
    explorer.write_bundle(str(tmp_path / "bundle"), operations=explorer.operation_details(known["tables"]["declared"], known["tables"]["operations"], known["tables"]["responses"]))
    assert spark.read.json(str(tmp_path / "bundle" / "operations")).count() == 3
    head = explorer.summary(spark, known["old"]).first()
    assert (head["title"], head["operations"]) == ("members", 3)


def test_report(spark, known):
    active = views.active_clients(known["cube"], 7)
    head = report.header(known["cube"], known["changes"], active, impact.Config()).first()
    assert (head["events"], head["matched_events"], head["active_clients"], head["breaking_total"]) == (19, 19, 3, 7) and abs(head["window_days"] - 45) < 1e-6
    assert not any("stale_days" in x or "name no client" in x for x in head["limitations"])
    said = report.describe(*map(F.col, ("kind", "operation", "part", "field", "status", "from", "to")))
    texts = {r["s"] for r in known["changes"].select(said.alias("s")).collect()}
    assert "Field $.age in the request body of POST /members changed type from number to integer." in texts and "Field $.legacy_id in the response 200 of GET /members/{id} removed." in texts
    empty = report.header(known["cube"].limit(0), known["changes"], active.limit(0), impact.Config()).first()
    assert empty["events"] == 0 and any("no traffic" in x for x in empty["limitations"])


def test_rankings(spark):
    rows = spark.createDataFrame([(i, i + 1, "HIGH", 10 - i, 2 * i, 10 - i) for i in range(8)], "id int, rank int, severity string, clients long, requests long, rank_spec_only int")
    truth = spark.createDataFrame([(i, float(8 - i)) for i in range(8)], "id int, truth double")
    tau = {r["ranking"]: r["tau"] for r in evaluation.rank_correlation(evaluation.comparators(rows), truth).collect()}
    assert tau == {"report": 1.0, "severity_first": 1.0, "client_count": 1.0, "volume_only": -1.0, "spec_only": -1.0}
    top = {r["ranking"]: r["top5"] for r in evaluation.top_five(evaluation.comparators(rows), truth).collect()}
    assert top["report"] == 1.0 and top["volume_only"] == 0.4
    assert evaluation.random_rankings(rows, 3).groupBy("ranking").count().collect()[0]["count"] == 8
    zero = truth.withColumn("truth", F.when(F.col("id") < 4, F.col("truth")).otherwise(0.0))
    assert {r["top5"] for r in evaluation.top_five(evaluation.comparators(rows), zero).collect()} == {None}


def test_yaml_leading_zeros_and_maps():
    assert openapi.load("a: 010\nb: 10\nc: 0\nd: 00.5\n") == {"a": "010", "b": 10, "c": 0, "d": "00.5"}
    tags = next(r for r in bridge.OLD.declared() if r[3] == "$.tags.*")
    assert tags[4] == ["integer"]


def test_scans(spark):
    sf = "/root/testdata/sf0.001"
    plan = bridge.resolved(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan
    plan = views.field_presence(bridge.cube(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and "PartitionFilters: [kind" in plan
    plan = views.top_callers(bridge.cube(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and ", Partial" in plan  # tasks keep their own first ones before rows move
    # Views read stored cells and never build them from events.
    for name in ("contract_fields", "drift_unused_fields", "client_timeline", "report_header", "impact_ranked", "latency_percentiles"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "event_id" not in plan and "props" not in plan
