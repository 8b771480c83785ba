"""Traffic derived from the driver's `events` table, and the two specifications that go with it."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cells, diff, impact, routes
from ..sources import openapi, shared
from ..sources.traffic import FIELD
from ..streaming.store import EVENTS, Store

SALT = "salt"
CONFIG = impact.Config(recent_days=3, stale_days=12)


def _schema(**p):
    required = [k for k, v in p.items() if v.pop("need", False)]
    return {"type": "object", "properties": p, "required": required}


def _answer(schema=None, codes=("200", "429")):
    return {c: {"description": "", **({"content": {"application/json": {"schema": schema}}} if schema and c[0] == "2" else {})} for c in codes}


def _spec(first: bool) -> openapi.Spec:
    s = lambda t, **k: {"type": t, **k}
    plans = ["free", "pro", "team"] if first else ["free", "pro"]
    order = _schema(title=s("string"), qty=s("number" if first else "integer"), plan=s("string", enum=plans), email=s("string", **({} if first else {"need": True})), **({"note": s("string")} if first else {}), gift=s("boolean"), tags=s("object", additionalProperties=s("integer")))
    item = _schema(id=s("integer"), servings=s("integer"), **({"legacy_id": s("integer")} if first else {}), spare=s("string"))
    query = [{"name": "limit", "in": "query", "schema": s("string")}, {"name": "sort", "in": "query", "schema": s("string")}]
    if not first:
        query.pop(0)
    get = lambda answer, codes=("200", "429"): {"parameters": query, "responses": _answer(answer, codes)}
    named = [{"name": "id", "in": "path", "required": True, "schema": s("integer")}]
    paths = {
        "/items/{id}": {"parameters": named, "get": get(item)},
        "/items/featured": {"get": get(item, ("200", "429") if first else ("200",))},
        "/items/{id}/clicks": {"parameters": named, "get": get(item)},
        "/orders": {"post": {"requestBody": {"required": True, "content": {"application/json": {"schema": order}}}, "responses": _answer(item, ("201", "default"))}},
        "/users": {"post": {"requestBody": {"content": {"application/json": {"schema": order}}}, "responses": _answer(item, ("2XX",))}},
        "/reports/{year}": {"get": {"parameters": [{"name": "year", "in": "path", "required": True, "schema": s("integer")}], "responses": _answer(item)}},
    }
    if not first:
        del paths["/items/{id}/clicks"]
    return openapi.Spec({"openapi": "3.0.3", "info": {"title": "items", "version": "1" if first else "2"}, "servers": [{"url": "https://api.example.com/v1"}], "paths": paths})


OLD, NEW = _spec(True), _spec(False)


def traffic(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    e = shared.dealt(spark.read.parquet(f"{sf_dir}/events.parquet"), EVENTS)
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("kind"), "value", k.alias("k"))
    # One user in six fell silent in the middle of the month and one a week before its end: their later events lie earlier.
    back = lambda n, since, days: F.when((F.col("user_id") % 6 == n) & (F.col("ts") >= since), F.col("ts") - F.make_dt_interval(days=F.lit(days)))
    e = e.withColumn("ts", F.coalesce(back(0, "2024-01-15", 16), back(1, "2024-01-25", 6), F.col("ts")))
    post, k = F.col("kind").isin("purchase", "signup"), F.col("k")
    num = k.cast("string")
    path = (
        F.when(F.col("kind") == "view", F.concat(F.lit("/v1/items/"), num))
        .when((F.col("kind") == "click") & (k % 10 == 0), "/v1/items/featured").when(F.col("kind") == "click", F.concat(F.lit("/v1/items/"), num, F.lit("/clicks")))
        .when(F.col("kind") == "purchase", "/v1/orders").when(F.col("kind") == "signup", "/v1/users").otherwise(F.concat(F.lit("/internal/"), num))
    )
    status = F.when(F.col("event_id") % 40 == 0, 429).when(F.col("event_id") % 97 == 0, 503).when(post, 201).otherwise(200)
    f = lambda p, t, v=None: F.struct(F.lit(p).alias("path"), F.array(t if not isinstance(t, str) else F.lit(t)).alias("types"), (F.array(v) if v is not None else F.lit(None).cast("array<string>")).alias("values"))
    fields = lambda *x: F.filter(F.array(*[F.when(c, s) for c, s in x]), lambda y: y.isNotNull()).cast(FIELD)
    yes = F.lit(True)
    plan = F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("team")), k % 3 + 1)
    body = fields((yes, f("$", "object")), (yes, f("$.title", "string")), (yes, f("$.qty", F.when(k % 7 == 0, "number").otherwise("integer"))), (yes, f("$.plan", "string", plan)), (k % 5 == 0, f("$.note", "string")), (k % 4 != 0, f("$.email", "string")), (k % 6 == 0, f("$.tags", "object")), (k % 6 == 0, f("$.tags.a", F.when(k % 12 == 0, "string").otherwise("integer"))))
    query = fields((k % 2 == 0, f("$.limit", "string")), (k % 3 == 0, f("$.sort", "string")), (k % 11 == 0, f("$.debug", "string")))
    answer = fields((yes, f("$", "object")), (yes, f("$.id", "integer")), (k % 2 == 0, f("$.legacy_id", "integer")), (k % 9 == 0, f("$.internal_score", "number")), (yes, f("$.servings", F.when(k % 10 == 0, "string").otherwise("integer"))))
    client = F.when(F.col("user_id") % 25 != 0, C.pseudonym(SALT, F.col("user_id").cast("string")))
    e = e.withColumns({"status": status})
    return e.select(
        "event_id", "ts", F.when(post, "POST").otherwise("GET").alias("method"), F.lit(None).cast("string").alias("operation"), path.alias("path"), "status", F.col("value").alias("latency_ms"), client.alias("client"),
        F.when(post, F.array().cast(FIELD)).otherwise(query).alias("query"), F.when(post, body).alias("request_body"), F.when(F.col("status") < 300, answer).alias("response_body"), F.lit(False).alias("truncated"), *more,
    )


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same traffic as HAR texts, one for each user: urls with queries, headers, one without a name, JSON bodies with long integers and repeated names, every other one in base64."""
    e = traffic(spark, sf_dir, "user_id", "k")
    k, some = F.col("k"), lambda c, v: F.when(c, v)
    post = F.col("method") == "POST"
    query = F.concat_ws("&", some(k % 2 == 0, F.lit("limit=1")), some(k % 3 == 0, F.lit("sort=a%20b")), some(k % 11 == 0, F.lit("debug")))
    url = F.concat(F.lit("https://api.example.com"), F.col("path"), F.when(post | (query == ""), "").otherwise(F.concat(F.lit("?"), query)))
    tags = F.struct(F.when(k % 12 == 0, F.lit('"x"')).otherwise(F.lit("1")).alias("a"))
    parts = [
        F.lit('"title":"t"'), F.concat(F.lit('"qty":'), F.when(k % 7 == 0, '2.0,"qty":1.5').otherwise("2.0")), F.concat(F.lit('"plan":"'), F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("team")), k % 3 + 1), F.lit('"')),
        some(k % 5 == 0, F.lit('"note":"n"')), some(k % 4 != 0, F.lit('"email":"e"')), some(k % 6 == 0, F.concat(F.lit('"tags":{"a":'), tags["a"], F.lit("}"))),
    ]
    sent = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    got = F.concat(F.lit('{"id":'), F.repeat(F.lit("12345678"), k % 6 + 1), F.lit(","), F.concat_ws(",", some(k % 2 == 0, F.lit('"legacy_id":2')), some(k % 9 == 0, F.lit('"internal_score":0.5')), F.concat(F.lit('"servings":'), F.when(k % 10 == 0, '"s"').otherwise("3"))), F.lit("}"))
    coded = F.col("event_id") % 2 == 0
    text = F.when(F.col("status") < 300, F.when(coded, F.base64(got.cast("binary"))).otherwise(got))
    entry = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("startedDateTime"), F.col("latency_ms").alias("time"),
        F.struct(F.lower("method").alias("method"), url.alias("url"), F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("x-USER").alias("name"), F.when(F.col("client").isNotNull(), F.col("user_id").cast("string")).otherwise("").alias("value"))).alias("headers"), F.when(post, F.struct(F.lit("application/json; charset=utf-8").alias("mimeType"), sent.alias("text"))).alias("postData")).alias("request"),
        F.struct("status", F.struct(F.lit("text/plain").alias("mimeType"), text.alias("text"), F.when(coded, "base64").alias("encoding")).alias("content")).alias("response"),
    )
    return e.groupBy("user_id").agg(F.to_json(F.struct(F.struct(F.collect_list(entry).alias("entries")).alias("log"))).alias("value")).select("value")


def known_routes(spark: SparkSession) -> DataFrame:
    return routes.build_routes([(o.method, o.path) for o in OLD.operations()], OLD.base_paths())


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.resolve(traffic(spark, sf_dir), known_routes(spark))


def fresh_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells counted from the events."""
    return cells.build_cells(resolved(spark, sf_dir))


_CUBES: dict[tuple, DataFrame] = {}


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as the store holds them: a table's events are taken in once an application, and views read what they filter."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _CUBES:
        store = Store(spark, f"{shared.folder(spark)}/traffic-{uuid.uuid4().hex}", known_routes(spark))
        store.append(traffic(spark, sf_dir), "all")
        _CUBES[key] = store.cells()
    return _CUBES[key]


def spec_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return openapi.tables(spark, OLD)


_CHANGES: dict[str, list] = {}


def changes(spark: SparkSession) -> DataFrame:
    """The changes between both specifications, compared once an application: as many rows as the specifications differ in."""
    app = spark.sparkContext.applicationId
    if app not in _CHANGES:
        _CHANGES[app] = diff.diff_documents(spark, OLD, NEW).select(*[f"`{x.split()[0].strip('`')}`" for x in impact.CHANGE.split(", ")]).collect()
    return spark.createDataFrame(_CHANGES[app], impact.CHANGE)
