"""Scans on generated input: lines, archives, paths and bodies against plain versions."""

import base64
import json
import random
import re
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import routes, sanitise, shapes
from tidemark.sources import openapi, traffic

TYPES = ["string", "integer", "number", "boolean", "null", "object", "array"]


def test_redaction(spark):
    rng = random.Random(1)
    hexes = "0123456789abcdefABCDEF"

    def segment():
        return rng.choice([
            lambda: str(rng.randrange(10**6)), lambda: "".join(rng.choices("abcxyz", k=rng.randrange(1, 25))), lambda: "".join(rng.choices(hexes, k=rng.randrange(5, 12))), lambda: str(uuid.UUID(int=rng.getrandbits(128))),
            lambda: "".join(rng.choices("ab1@%.-", k=rng.randrange(1, 8))), lambda: "", lambda: "".join(rng.choices("abcdef", k=rng.randrange(6, 11))),
        ])()

    def value_like(s):
        digits, hexed = any(c.isdigit() for c in s), all(c in hexes for c in s)
        return s.isdigit() or (len(s) >= 8 and digits and hexed) or len(s) >= 20 or "@" in s or "%" in s or bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s))

    paths = ["/" + "/".join(segment() for _ in range(rng.randrange(5))) for _ in range(600)]
    got = {r["p"]: r["r"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", C.redact_path(F.col("p")).alias("r")).collect()}
    assert got == {p: "/" + "/".join("{*}" if value_like(s) else s for s in p.split("/") if s) for p in paths}


def test_odd_lines(spark):
    rng = random.Random(2)
    drawn = lambda *x: rng.choice(x)
    lines, want = [], []
    for _ in range(500):
        field = {"path": drawn("$", "$.a", "$['b c']", "$.a", "a", None), "types": drawn(["string"], ["integer", "null"], ["string", "string"], [], ["text"], ["string", "date"], None)}
        ts = drawn("2025-03-04T05:06:07Z", "2025-03-04T05:06:07.123456Z", "2025-03-04T05:06:07+02:00", "2025-03-04", "2025-03-04 05:06:07", "2025-13-04T05:06:07Z", "soon", None)
        e = {"v": drawn(1, 1, 1, 2, None), "ts": ts, "method": drawn("GET", "post", "GET", None), "operation": drawn(None, None, "GET /a"), "path": drawn("/a", "/b", None), "status": drawn(200, 404, 200, None), drawn("request", "response"): {"body": [field]} if rng.random() < 0.5 else {}, "more": 1}
        e = {k: v for k, v in e.items() if v is not None}
        lines.append(json.dumps(e) + drawn("", "", " "))
        bad_field = any(f["path"] is None or not f["path"].startswith("$") or not f["types"] or any(t not in TYPES for t in f["types"]) for x in ("request", "response") for f in e.get(x, {}).get("body", []))
        bad_time = ts is None or not re.fullmatch(r"\d{4}-(0\d|1[0-2])-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", ts)
        want.append(e.get("v") != 1 or bad_time or "method" not in e or "status" not in e or not ("operation" in e or "path" in e) or bad_field)
    lines += ["", "no", "[1]", '{"v":1', '{"v":3,"v":1,"ts":"2025-03-04T05:06:07Z","method":"GET","path":"/a","status":200}', '{"v":1,"ts":"2025-03-04T05:06:07Z","method":"GET","path":"/a","status":"x"}']
    want += [True, True, True, True, False, True]
    got = traffic.parse_lines(spark.createDataFrame(list(enumerate(lines)), "i int, value string")).orderBy("i").collect()
    wrong = [(lines[r["i"]], r["rejected"]) for r in got if (r["rejected"] is not None) != want[r["i"]]]
    assert not wrong, wrong[:5]
    assert 30 < want.count(False) < 300


def test_archives(spark):
    rng = random.Random(3)
    entries, want = [], []
    for i in range(200):
        at = datetime(2025, 1, 1, tzinfo=UTC) + timedelta(seconds=rng.randrange(10**7), milliseconds=rng.randrange(1000))
        hours = rng.choice([0, 2, -5])
        local = (at + timedelta(hours=hours)).replace(tzinfo=None)
        started = local.isoformat(timespec="milliseconds") + ("Z" if not hours else f"{'+' if hours > 0 else '-'}{abs(hours):02}:00")
        names = [rng.choice(["X-One", "x-one", "Accept", None, ""]) for _ in range(rng.randrange(4))]
        headers = [{"name": n, "value": rng.choice([f"{i}.{k}", None])} for k, n in enumerate(names)]
        text = json.dumps({"i": i, "t": "é" * (i % 3)})
        coded = rng.random() < 0.5
        e = {"startedDateTime": started, "time": rng.choice([i + 0.5, -1]), "request": {"method": "GET", "url": f"/u/{i}", "headers": headers}, "response": {"status": rng.choice([200, 404, 0, 700]), "content": {"text": base64.b64encode(text.encode()).decode() if coded else text, **({"encoding": "base64"} if coded else {})}}}
        lost = rng.choice([None] * 6 + ["startedDateTime", "request", "response"])
        if lost:
            del e[lost]
        entries.append(e)
        first = {}
        for h in headers:
            first.setdefault((h["name"] or "").lower(), h["value"] or "")
        if not lost:
            want.append((f"/u/{i}", at.replace(tzinfo=None), first, text, e["time"] if e["time"] >= 0 else None, not 100 <= e["response"]["status"] <= 599))
    cut = [entries[k : k + 30] for k in range(0, 200, 30)]
    archives = spark.createDataFrame([(json.dumps({"log": {"entries": c}}),) for c in cut] + [("{",), (None,)], "value string")
    rows = traffic.har_entries(archives, strict=True).select("*", F.col("ts").cast("timestamp_ntz").alias("at")).collect()
    assert len(rows) == 200 and sum(r["skipped"] for r in rows) == 200 - sum(not w[5] for w in want)
    got = {r["url"]: (r["at"], r["headers"], r["response_text"], r["latency_ms"]) for r in rows if r["url"] and r["ts"] and r["status"] is not None}
    assert got == {w[0]: w[1:5] for w in want}


def drawn_json(rng, depth):
    """A value as JSON text, and what a reader has of it: names in order, the last value of those that repeat."""
    if depth == 0 or rng.random() < 0.35:
        return rng.choice([("null", None, "null"), ("true", None, "boolean"), ('"s"', None, "string"), ("7", None, "integer"), ("7.0", None, "integer"), ("-0.5", None, "number"), ("1e3", None, "integer"), ("1" * 41, None, "integer"), ("1e400", None, "number"), ("123456789012345678901234567890.5", None, "integer")])
    if rng.random() < 0.4:
        parts = [drawn_json(rng, depth - 1) for _ in range(rng.randrange(4))]
        return "[" + ", ".join(p[0] for p in parts) + "]", parts, "array"
    names = [rng.choice(["b", "a", "odd name", "a.b", "it's"]) for _ in range(rng.randrange(5))]
    parts = [(n, drawn_json(rng, depth - 1)) for n in names]
    last = {}
    for n, p in parts:
        last[n] = p
    return "{" + ",".join(f"{json.dumps(n)}:{p[0]}" for n, p in parts) + "}", last, "object"


def walked(value, depth, most):
    types, cut = {}, False

    def walk(v, path, level):
        nonlocal cut
        if path not in types:
            if len(types) >= most:
                cut = True
                return
            types[path] = set()
        types[path].add(v[2])
        inner = list(v[1].items()) if v[2] == "object" else [(None, p) for p in v[1] or ()]
        if inner and level == depth:
            cut = True
            return
        for n, p in inner:
            step = "[]" if n is None else f".{n}" if re.fullmatch("[A-Za-z0-9_-]+", n) else "['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']"
            walk(p, path + step, level + 1)

    walk(value, "$", 0)
    return [(p, sorted(t)) for p, t in types.items()], cut


def test_shapes(spark):
    rng = random.Random(4)
    values = [drawn_json(rng, rng.randrange(1, 7)) for _ in range(400)]
    odd = ["", "{", '{"a":1} and more', "NaN", "[" * 5000, None, " \n[1]"]
    df = spark.createDataFrame([*((i, v[0]) for i, v in enumerate(values)), *((1000 + i, t) for i, t in enumerate(odd))], "id int, body string").repartition(4)
    for depth, most in ((10, 500), (3, 6)):
        got = {r["id"]: r["s"] for r in shapes.with_shape(df, "body", "s", depth=depth, most=most).collect()}
        for i, v in enumerate(values):
            want = walked(v, depth, most)
            assert ([(f["path"], f["types"]) for f in got[i]["fields"]], got[i]["truncated"]) == want, v[0]
        assert [got[1000 + i] is None for i in range(7)] == [True, True, False, True, True, True, False]
    plan = shapes.shapes(df, "id", "body")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the test's own repartition


def test_enum_values_under_maps_and_arrays(spark):
    level = {"type": "string", "enum": ["hot", "cold"]}
    node = {"type": "object", "properties": {"mark": level, "plain": {"type": "string"}, "next": {"$ref": "#/components/schemas/Node"}}, "additionalProperties": level}
    query = [{"name": "sort", "in": "query", "schema": {"type": "array", "items": level}}, {"name": "free", "in": "query", "schema": {"type": "string"}}, {"name": "kind", "in": "query", "schema": {"const": "x"}}]
    body = {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Node"}}}}}
    spec = openapi.Spec({"openapi": "3.1.0", "paths": {"/a": {"post": {"parameters": query, "requestBody": body, "responses": {"2XX": body, "default": {}}}}}, "components": {"schemas": {"Node": node}}})
    text = json.dumps([{"mark": "hot", "plain": "p", "next": {"next": {"next": {"next": {"next": {"next": {"other": "cold", "mark": None}}}}}}}, {"mark": "cold", "more": True}])
    entry = lambda status: {"startedDateTime": "2026-01-02T03:04:05Z", "time": 1, "request": {"method": "post", "url": "/a?sort=b&sort=a&free=1&kind=x", "postData": {"mimeType": "application/json", "text": text}}, "response": {"status": status, "content": {"mimeType": "application/json", "text": text}}}
    har = traffic.har_entries(spark.createDataFrame([(json.dumps({"log": {"entries": [entry(201), entry(500)]}}),)], "value string"))
    good, failed = sanitise.sanitise(har, routes.build_routes([("POST", "/a")]), spec).orderBy("status").collect()
    values = lambda fields: {f["path"]: f["values"] for f in fields if f["values"] is not None}
    deep = "$[]" + ".next" * 6
    want = {"$[].mark": ["hot", "cold"], "$[].more": ["true"], f"{deep}.other": ["cold"]}
    assert values(good["request_body"]) == values(failed["request_body"]) == values(good["response_body"]) == want
    assert values(failed["response_body"]) == {} and values(good["query"]) == {"$.sort": ["b", "a"], "$.kind": ["x"]}
