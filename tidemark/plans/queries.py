"""Queries over the driver's tables, one or more for each family of operators, and their SQL."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cells, diff, drift, evaluation, explorer, impact, report, routes, sanitise, shapes, statistics, views
from ..sources import archive, openapi, shared
from ..sources import traffic as T
from . import bridge, contracts

QUERIES, ORACLE_SQL = {}, {}

#: Events as rows `t`, their fields as rows `f`, for SQL.
BASE = """
WITH t0 AS (
  SELECT event_id, CASE WHEN user_id % 6 = 0 AND ts >= TIMESTAMP '2024-01-15' THEN ts - INTERVAL 16 DAY WHEN user_id % 6 = 1 AND ts >= TIMESTAMP '2024-01-25' THEN ts - INTERVAL 6 DAY ELSE ts END AS ts,
    user_id, event_type AS kind, value AS latency, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
t AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS day, k, latency, kind,
    CASE WHEN kind IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
    CASE kind WHEN 'view' THEN '/v1/items/' || k WHEN 'click' THEN CASE WHEN k % 10 = 0 THEN '/v1/items/featured' ELSE '/v1/items/' || k || '/clicks' END
      WHEN 'purchase' THEN '/v1/orders' WHEN 'signup' THEN '/v1/users' ELSE '/internal/' || k END AS path,
    CASE kind WHEN 'view' THEN 'GET /items/{id}' WHEN 'click' THEN CASE WHEN k % 10 = 0 THEN 'GET /items/featured' ELSE 'GET /items/{id}/clicks' END
      WHEN 'purchase' THEN 'POST /orders' WHEN 'signup' THEN 'POST /users' END AS op,
    CASE WHEN event_id % 40 = 0 THEN 429 WHEN event_id % 97 = 0 THEN 503 WHEN kind IN ('purchase', 'signup') THEN 201 ELSE 200 END AS status,
    CASE WHEN user_id % 25 = 0 THEN '' ELSE substr(sha256('salt' || user_id), 1, 16) END AS client
  FROM t0),
m AS (SELECT * FROM t WHERE op IS NOT NULL),
f AS (
  SELECT m.*, x.part, CASE WHEN x.part = 'response.body' THEN m.status ELSE 0 END AS st, x.field, x.type, x.val,
    CASE WHEN x.part = 'response.body' THEN '' ELSE client END AS who
  FROM m, LATERAL (VALUES
    ('request.body', '$', 'object', NULL, method = 'POST'), ('request.body', '$.title', 'string', NULL, method = 'POST'),
    ('request.body', '$.qty', CASE WHEN k % 7 = 0 THEN 'number' ELSE 'integer' END, NULL, method = 'POST'),
    ('request.body', '$.plan', 'string', CASE k % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'team' END, method = 'POST'),
    ('request.body', '$.note', 'string', NULL, method = 'POST' AND k % 5 = 0), ('request.body', '$.email', 'string', NULL, method = 'POST' AND k % 4 <> 0),
    ('request.body', '$.tags', 'object', NULL, method = 'POST' AND k % 6 = 0), ('request.body', '$.tags.a', CASE WHEN k % 12 = 0 THEN 'string' ELSE 'integer' END, NULL, method = 'POST' AND k % 6 = 0),
    ('request.query', '$.limit', 'string', NULL, method = 'GET' AND k % 2 = 0), ('request.query', '$.sort', 'string', NULL, method = 'GET' AND k % 3 = 0),
    ('request.query', '$.debug', 'string', NULL, method = 'GET' AND k % 11 = 0),
    ('response.body', '$', 'object', NULL, status < 300), ('response.body', '$.id', 'integer', NULL, status < 300),
    ('response.body', '$.legacy_id', 'integer', NULL, status < 300 AND k % 2 = 0), ('response.body', '$.internal_score', 'number', NULL, status < 300 AND k % 9 = 0),
    ('response.body', '$.servings', CASE WHEN k % 10 = 0 THEN 'string' ELSE 'integer' END, NULL, status < 300)) AS x(part, field, type, val, here)
  WHERE x.here),
cells AS (
  SELECT kind2 AS kind, operation, part, status, field, detail, client, day, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts FROM (
    SELECT 'EVENT' AS kind2, '' AS operation, '' AS part, 0 AS status, '' AS field, '' AS detail, client, day, ts FROM t
    UNION ALL SELECT 'UNMATCHED', '', '', 0, method || ' ' || path, '', '', day, ts FROM t WHERE op IS NULL
    UNION ALL SELECT 'CALL', op, '', 0, '', '', client, day, ts FROM m
    UNION ALL SELECT 'STATUS', op, '', status, '', '', client, day, ts FROM m
    UNION ALL SELECT 'LATENCY', op, '', 0, '', CAST(CASE WHEN latency <= 1 THEN 0 ELSE CAST(ceil(ln(latency) / ln(1.25) - 1e-9) AS INTEGER) END AS VARCHAR), '', day, ts FROM m WHERE latency IS NOT NULL
    UNION ALL SELECT 'REQUEST_BODY', op, '', 0, '', '', client, day, ts FROM m WHERE method = 'POST'
    UNION ALL SELECT 'RESPONSE_BODY', op, '', status, '', '', '', day, ts FROM m WHERE status < 300
    UNION ALL SELECT 'FIELD', op, part, st, field, '', who, day, ts FROM f
    UNION ALL SELECT 'TYPE', op, part, st, field, type, who, day, ts FROM f
    UNION ALL SELECT 'CAPTURED', op, part, st, field, '', '', day, ts FROM f WHERE val IS NOT NULL
    UNION ALL SELECT 'VALUE', op, part, st, field, val, who, day, ts FROM f WHERE val IS NOT NULL)
  GROUP BY ALL)"""


def query(sql: str | None = None, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (BASE + (sql if sql.lstrip().startswith(",") else "\n" + sql)) if base else sql
        return f

    return add


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables have them."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n, t in df.dtypes if t == "timestamp"})


#: What the first specification declares, written by hand: fields `d`, responses `r`, the answer of each status with a body `ans`.
SPEC = """
item(field, types, open) AS (VALUES ('$', 'object', false), ('$.id', 'integer', true), ('$.servings', 'integer', true), ('$.legacy_id', 'integer', true), ('$.spare', 'string', true)),
ordered(field, types, open) AS (VALUES ('$', 'object', false), ('$.title', 'string', true), ('$.qty', 'number', true), ('$.plan', 'string', true), ('$.email', 'string', true), ('$.note', 'string', true),
  ('$.gift', 'boolean', true), ('$.tags', 'object', true), ('$.tags.*', 'integer', true)),
answers(operation, answer) AS (VALUES ('GET /items/{id}', '200'), ('GET /items/featured', '200'), ('GET /items/{id}/clicks', '200'), ('POST /orders', '201'), ('POST /users', '2XX'), ('GET /reports/{year}', '200')),
r AS (SELECT * FROM answers UNION ALL SELECT operation, '429' FROM answers WHERE operation LIKE 'GET%' UNION ALL SELECT 'POST /orders', 'default'),
d AS (
  SELECT operation, 'response.body' AS part, answer AS status, field, types, open FROM answers, item
  UNION ALL SELECT operation, 'request.body', '0', field, types, open FROM answers, ordered WHERE operation LIKE 'POST%'
  UNION ALL SELECT operation, 'request.query', '0', field, 'string', true FROM answers, (VALUES ('$.limit'), ('$.sort')) AS q(field) WHERE operation LIKE 'GET /items%'
  UNION ALL VALUES ('GET /items/{id}', 'request.path', '0', '$.id', 'integer', true), ('GET /items/{id}/clicks', 'request.path', '0', '$.id', 'integer', true), ('GET /reports/{year}', 'request.path', '0', '$.year', 'integer', true)),
ans(operation, code, answer) AS (VALUES ('GET /items/{id}', '200', '200'), ('GET /items/featured', '200', '200'), ('GET /items/{id}/clicks', '200', '200'), ('POST /orders', '201', '201'), ('POST /users', '201', '2XX'))"""
#: Observed fields with the declared path that they fall under: values of the one map are `.*`.
PLACED = """,
placed AS (SELECT f.*, CASE WHEN part = 'response.body' THEN ans.answer ELSE '0' END AS answer, regexp_replace(field, '^\\$\\.tags\\..*', '$.tags.*') AS at
  FROM f LEFT JOIN ans ON ans.operation = op AND ans.code = CAST(st AS VARCHAR))"""


# Scalars and scans.


@query("SELECT DISTINCT user_id, substr(sha256('salt' || user_id), 1, 16) AS client FROM events", base=False)
def pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return u.select("user_id", C.pseudonym("salt", F.col("user_id").cast("string")).alias("client"))


@query(
    r"""
WITH p AS (SELECT page_id, split_part(split_part(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '#', 1), '?', 1) AS path FROM pages)
SELECT page_id, '/' || array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
  lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') OR regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
    OR (regexp_matches(s, '^[0-9a-fA-F]{8,}$') AND regexp_matches(s, '[0-9]')) OR length(s) >= 20 OR contains(s, '@') OR contains(s, '%') THEN '{*}' ELSE s END), '/') AS path FROM p""",
    base=False,
)
def redact_path(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", C.redact_path(C.url_path(F.col("url"))).alias("path"))


@query(
    r"""
WITH u AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages),
q AS (SELECT page_id, unnest(string_split(substr(u, instr(u, '?') + 1), '&')) AS pair FROM u WHERE contains(u, '?'))
SELECT page_id, split_part(pair, '=', 1) AS name, replace(CASE WHEN contains(pair, '=') THEN substr(pair, instr(pair, '=') + 1) ELSE '' END, '+', ' ') AS value, count(*) AS n
FROM q WHERE pair <> '' GROUP BY ALL""",
    base=False,
)
def query_params(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(C.query_pairs(F.col("url"))).alias("q"))
    return p.groupBy("page_id", "q.name", "q.value").agg(F.count("*").alias("n"))


@query("SELECT event_id, method, path, status, client, latency FROM (SELECT event_id, method, path, status, CASE WHEN client = '' THEN NULL ELSE client END AS client, round(latency, 6) AS latency FROM t)")
def events_round_trip(spark, sf_dir):
    """Events written as lines and parsed again."""
    e = T.parse_lines(T.to_lines(bridge.traffic(spark, sf_dir)).select("event_id", "value"))
    return e.where("rejected IS NULL").select("event_id", "method", "path", "status", "client", F.round("latency_ms", 6).alias("latency"))


@query(
    "SELECT reason AS rejected, count(*) AS n FROM (SELECT CASE event_id % 10 WHEN 0 THEN 'unknown version' WHEN 1 THEN 'not JSON' WHEN 2 THEN 'neither operation nor path' WHEN 3 THEN 'no status' WHEN 4 THEN 'no timestamp' WHEN 5 THEN 'no timestamp' WHEN 6 THEN 'bad field' ELSE 'good' END AS reason FROM t) GROUP BY ALL"
)
def events_rejected(spark, sf_dir):
    e = T.to_lines(bridge.traffic(spark, sf_dir)).select("event_id", "value")
    n = F.col("event_id") % 10
    v = F.col("value")
    broken = F.when(n == 0, F.regexp_replace(v, r'^\{"v":1', '{"v":2')).when(n == 1, F.concat(F.lit("x"), v)).when(n == 2, F.regexp_replace(v, r'"path":"/[^"]*",', "")).when(n == 3, F.regexp_replace(v, r'"status":[0-9]+,', "")).when(n == 4, F.regexp_replace(v, r'"ts":"[^"]*",', "")).when(n == 5, F.regexp_replace(v, r'"ts":"([^"T]*)T[^"]*"', r'"ts":"$1"'))
    broken = broken.when(n == 6, F.replace(F.replace(v, F.lit('"query":['), F.lit('"query":[{"path":"$.q","types":["string","text"]},')), F.lit("},]"), F.lit("}]"))).when(n == 7, F.regexp_replace(v, '"v":1', '"v":3,"v":1')).otherwise(v)
    return T.parse_lines(e.withColumn("value", broken)).groupBy(F.coalesce("rejected", F.lit("good")).alias("rejected")).agg(F.count("*").alias("n"))


@query("SELECT event_id, op AS operation FROM t")
def match_routes(spark, sf_dir):
    return bridge.resolved(spark, sf_dir).select("event_id", F.col("op_key").alias("operation"))


@query("SELECT method || ' ' || path AS operation, count(*) AS count FROM t WHERE op IS NULL GROUP BY 1")
def unmatched(spark, sf_dir):
    return drift.undocumented_operations(bridge.cube(spark, sf_dir))


@query("SELECT CAST(count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12') AS BIGINT) AS inside, CAST(count(*) FILTER (ts NOT BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12') AS BIGINT) AS outside FROM t")
def window_filter(spark, sf_dir):
    inside = F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    return bridge.traffic(spark, sf_dir).agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


# The cube.


@query("SELECT * FROM cells")
def cells_build(spark, sf_dir):
    return _plain(bridge.fresh_cube(spark, sf_dir))


@query("SELECT * FROM cells")
def cells_merge(spark, sf_dir):
    """Two parts of the traffic, built apart and merged."""
    r = bridge.resolved(spark, sf_dir)
    return _plain(cells.merge_cells(cells.build_cells(r.where("event_id % 2 = 0")), cells.build_cells(r.where("event_id % 2 = 1"))))


@query("SELECT * FROM cells WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'")
def cells_day_range(spark, sf_dir):
    return _plain(bridge.cube(spark, sf_dir).where("day BETWEEN DATE'2024-01-03' AND DATE'2024-01-09'"))


@query(
    """, x AS (SELECT count, ('0x' || substr(md5(concat_ws('|', kind, operation, part, CAST(status AS VARCHAR), field, detail, client, CAST(day AS VARCHAR), CAST(count AS VARCHAR), CAST(epoch_us(first_ts) AS VARCHAR), CAST(epoch_us(last_ts) AS VARCHAR))), 1, 15))::BIGINT AS h FROM cells)
SELECT count(*) AS cells, CAST(sum(count) AS BIGINT) AS total, bit_xor(h) AS mark FROM x"""
)
def fingerprint(spark, sf_dir):
    return cells.fingerprint(bridge.cube(spark, sf_dir))


@query("SELECT op AS operation, count(*) AS calls, count(DISTINCT CASE WHEN client <> '' THEN client END) AS clients, min(ts) AS first_ts, max(ts) AS last_ts FROM m GROUP BY op")
def calls_callers(spark, sf_dir):
    return _plain(views.operations(bridge.cube(spark, sf_dir)))


@query("SELECT op AS operation, status, count(*) AS count FROM m GROUP BY ALL")
def status_counts(spark, sf_dir):
    return cells.fold(bridge.cube(spark, sf_dir), "STATUS", "operation", "status").select("operation", "status", "count")


@query(
    """, b AS (SELECT op, 'request.query' AS part, 0 AS st, count(*) AS n FROM m GROUP BY op UNION ALL SELECT op, 'request.body', 0, count(*) FROM m WHERE method = 'POST' GROUP BY op
  UNION ALL SELECT op, 'response.body', status, count(*) FROM m WHERE status < 300 GROUP BY op, status)
SELECT f.op AS operation, f.part, f.st AS status, field, count(*) AS count, any_value(n) AS "of", round(least(1.0, count(*) / any_value(n)), 6) AS presence FROM f JOIN b ON f.op = b.op AND f.part = b.part AND f.st = b.st GROUP BY ALL"""
)
def field_presence(spark, sf_dir):
    return views.field_presence(bridge.cube(spark, sf_dir)).withColumn("presence", F.round("presence", 6))


@query("SELECT op AS operation, part, st AS status, field, type, count(*) AS count FROM f GROUP BY ALL")
def type_counts(spark, sf_dir):
    return views.field_types(bridge.cube(spark, sf_dir))


@query("SELECT op AS operation, part, field, val AS value, count(*) AS count, count(DISTINCT CASE WHEN who <> '' THEN who END) AS clients FROM f WHERE val IS NOT NULL GROUP BY ALL")
def enum_values(spark, sf_dir):
    v = bridge.cube(spark, sf_dir).where("kind = 'VALUE'")
    return v.groupBy("operation", "part", "field", F.col("detail").alias("value")).agg(F.sum("count").alias("count"), F.countDistinct(F.when(F.col("client") != "", F.col("client"))).alias("clients"))


@query(
    """, b AS (SELECT operation, CAST(detail AS INTEGER) AS bucket, sum(count) AS c FROM cells WHERE kind = 'LATENCY' GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY operation) AS n, sum(c) OVER (PARTITION BY operation ORDER BY bucket) AS cum FROM b)
SELECT operation, CAST(max(n) AS BIGINT) AS n, floor(pow(1.25, min(bucket) FILTER (cum >= ceil(0.5 * n))) * 10 + 0.5) / 10 AS p50, floor(pow(1.25, min(bucket) FILTER (cum >= ceil(0.95 * n))) * 10 + 0.5) / 10 AS p95,
  floor(pow(1.25, min(bucket) FILTER (cum >= ceil(0.99 * n))) * 10 + 0.5) / 10 AS p99 FROM w GROUP BY operation"""
)
def latency_percentiles(spark, sf_dir):
    return views.latency_percentiles(bridge.cube(spark, sf_dir))


@query(
    """, e AS (SELECT client, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM t WHERE client <> '' GROUP BY client ORDER BY last_ts DESC, client LIMIT 500),
y AS (SELECT client, string_agg(day || '=' || n, ',' ORDER BY day) AS days FROM (SELECT client, day, count(*) AS n FROM m GROUP BY ALL) GROUP BY client),
o AS (SELECT client, string_agg(op || '=' || n, ',' ORDER BY op) AS operations FROM (SELECT client, op, count(*) AS n FROM m GROUP BY ALL) GROUP BY client)
SELECT e.*, days, operations FROM e LEFT JOIN y USING (client) LEFT JOIN o USING (client)"""
)
def client_timeline(spark, sf_dir):
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"])), ",")
    return _plain(views.client_timeline(bridge.cube(spark, sf_dir)).withColumns({"days": text("days"), "operations": text("operations")}))


@query("SELECT op AS operation, client, count(*) AS count, CAST(row_number() OVER (PARTITION BY op ORDER BY count(*) DESC, client) AS INTEGER) AS place FROM m WHERE client <> '' GROUP BY op, client QUALIFY place <= 20")
def top_callers(spark, sf_dir):
    return views.top_callers(bridge.cube(spark, sf_dir), 20)


@query("SELECT op AS operation, part, field, who AS client, count(*) AS count, CAST(row_number() OVER (PARTITION BY op, part, field ORDER BY count(*) DESC, who) AS INTEGER) AS place FROM f WHERE part LIKE 'request%' AND who <> '' GROUP BY op, part, field, who QUALIFY place <= 10")
def top_senders(spark, sf_dir):
    return views.top_senders(bridge.cube(spark, sf_dir), 10)


@query(", d AS (SELECT day, count(*) AS calls FROM m GROUP BY day) SELECT CAST(g.day AS DATE) AS day, coalesce(calls, 0) AS calls FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day) g LEFT JOIN d ON d.day = CAST(g.day AS DATE)")
def timeline_dense(spark, sf_dir):
    return views.dense_days(bridge.cube(spark, sf_dir))


@query("SELECT client, max(ts) AS last_ts FROM t WHERE client <> '' GROUP BY client HAVING max(ts) >= (SELECT max(ts) FROM t) - INTERVAL 3 DAY")
def active_clients(spark, sf_dir):
    return _plain(views.active_clients(bridge.cube(spark, sf_dir), 3))


# Contract and drift.


@query(
    "," + SPEC + """, s AS (SELECT op, part, CAST(st AS VARCHAR) AS st, field, count(*) AS n FROM f WHERE field <> '$' GROUP BY ALL),
w AS (SELECT operation, part, status, field FROM d WHERE part <> 'request.path' AND field <> '$'
  UNION SELECT d.operation, part, code, field FROM d JOIN ans ON ans.operation = d.operation AND ans.answer = d.status WHERE part = 'response.body' AND field <> '$')
SELECT coalesce(w.operation, s.op) AS operation, coalesce(w.part, s.part) AS part, coalesce(w.status, s.st) AS status, coalesce(w.field, s.field) AS field, coalesce(n, 0) AS count,
  CASE WHEN w.field IS NULL THEN 'undocumented' WHEN n IS NULL THEN 'never_seen' ELSE 'documented_and_used' END AS state
FROM w FULL JOIN s ON w.operation = s.op AND w.part = s.part AND w.status = s.st AND w.field = s.field"""
)
def contract_fields(spark, sf_dir):
    t = bridge.spec_tables(spark)
    return views.contract_fields(bridge.cube(spark, sf_dir), t["declared"], t["responses"])


@query(
    "," + SPEC + """, s AS (SELECT op, part, CAST(st AS VARCHAR) AS st, field, count(*) AS n FROM f WHERE field <> '$' GROUP BY ALL),
w AS (SELECT operation, part, status, field FROM d WHERE part <> 'request.path' AND field <> '$'
  UNION SELECT d.operation, part, code, field FROM d JOIN ans ON ans.operation = d.operation AND ans.answer = d.status WHERE part = 'response.body' AND field <> '$'),
fs AS (
  SELECT coalesce(w.operation, s.op) AS operation, string_agg(coalesce(w.part, s.part) || ' ' || coalesce(w.status, s.st) || ' ' || coalesce(w.field, s.field) || ' ' || coalesce(n, 0) || ' '
    || CASE WHEN w.field IS NULL THEN 'undocumented' WHEN n IS NULL THEN 'never_seen' ELSE 'documented_and_used' END, ',' ORDER BY coalesce(w.part, s.part), coalesce(w.status, s.st), coalesce(w.field, s.field)) AS fields
  FROM w FULL JOIN s ON w.operation = s.op AND w.part = s.part AND w.status = s.st AND w.field = s.field GROUP BY 1),
st AS (
  SELECT op, string_agg(status || ' ' || n || ' ' || EXISTS (SELECT 1 FROM r WHERE r.operation = op AND (r.answer = CAST(status AS VARCHAR) OR r.answer = 'default' OR r.answer = substr(CAST(status AS VARCHAR), 1, 1) || 'XX')), ',' ORDER BY status) AS statuses
  FROM (SELECT op, status, count(*) AS n FROM m GROUP BY ALL) GROUP BY op),
c AS (SELECT op, count(*) AS calls, count(DISTINCT CASE WHEN client <> '' THEN client END) AS clients FROM m GROUP BY op)
SELECT fs.operation, coalesce(calls, 0) AS calls, coalesce(clients, 0) AS clients, statuses, fields FROM fs LEFT JOIN st ON st.op = fs.operation LEFT JOIN c ON c.op = fs.operation"""
)
def contract_document(spark, sf_dir):
    """The contract of each operation as one row; its latency has a query of its own."""
    t = bridge.spec_tables(spark)
    rows = views.contract(bridge.cube(spark, sf_dir), t["declared"], t["responses"])
    text = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[n].cast("string") for n in names])), ",").alias(c)
    return rows.select("operation", "calls", "clients", text("statuses", "status", "count", "documented"), text("fields", "part", "status", "field", "count", "state"))


def _drift(of, spark, sf_dir, *more):
    t = bridge.spec_tables(spark)
    return of(bridge.cube(spark, sf_dir), t["declared"], t["responses"], *more)


@query("," + SPEC + PLACED + " SELECT op AS operation, part, CAST(st AS VARCHAR) AS status, field, count(*) AS count FROM placed p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.operation = op AND d.part = p.part AND d.status = p.answer AND d.field = p.at) GROUP BY ALL")
def drift_undocumented_fields(spark, sf_dir):
    return _drift(drift.undocumented_fields, spark, sf_dir).drop("of", "presence")


@query(
    "," + SPEC + PLACED + """ SELECT op AS operation, p.part, CAST(st AS VARCHAR) AS status, p.field, count(*) AS count, string_agg(DISTINCT type, '|' ORDER BY type) AS observed
FROM placed p JOIN d ON d.operation = op AND d.part = p.part AND d.status = p.answer AND d.field = p.at WHERE p.part <> 'request.query' AND type <> d.types AND NOT (type = 'integer' AND d.types = 'number') GROUP BY ALL"""
)
def drift_type_mismatches(spark, sf_dir):
    return _drift(drift.type_mismatches, spark, sf_dir)


@query(
    "," + SPEC + PLACED + """, o AS (SELECT op, part, CAST(st AS VARCHAR) AS st, answer, field, count(*) AS n FROM placed WHERE type = 'object' GROUP BY ALL HAVING count(*) >= 20 UNION ALL SELECT op, 'request.query', '0', '0', NULL, count(*) FROM m GROUP BY op HAVING count(*) >= 20)
SELECT d.operation, d.part, o.st AS status, d.field, n AS "of", round(1 - pow(0.05, 1.0 / n), 6) AS bound FROM d JOIN o ON d.operation = o.op AND d.part = o.part AND d.status = o.answer
WHERE d.field <> '$' AND d.field <> '$.tags.*' AND (o.field = '$' OR o.field IS NULL) AND NOT EXISTS (SELECT 1 FROM f WHERE f.op = d.operation AND f.part = d.part AND CAST(f.st AS VARCHAR) = o.st AND f.field = d.field)"""
)
def drift_unused_fields(spark, sf_dir):
    return _drift(drift.unused_fields, spark, sf_dir, 20).withColumn("bound", F.round("bound", 6))


@query("," + SPEC + " SELECT op AS operation, status AS code, count(*) AS count, CASE WHEN status >= 500 THEN 'info' ELSE 'warning' END AS level FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.operation = op AND (r.answer = CAST(status AS VARCHAR) OR r.answer = 'default' OR r.answer = substr(CAST(status AS VARCHAR), 1, 1) || 'XX')) GROUP BY ALL")
def drift_undocumented_statuses(spark, sf_dir):
    return drift.undocumented_statuses(bridge.cube(spark, sf_dir), bridge.spec_tables(spark)["responses"])


@query("," + SPEC + " SELECT DISTINCT operation FROM r WHERE operation NOT IN (SELECT op FROM m)")
def drift_unused_operations(spark, sf_dir):
    return drift.unused_operations(bridge.cube(spark, sf_dir), bridge.spec_tables(spark)["operations"]).select("operation")


# Difference and impact.

_HITS = """, hits AS (
  SELECT id, client, count(*) AS requests, min(ts) AS first_ts, max(ts) AS last_ts, 'OBSERVED' AS evidence FROM ch JOIN m ON m.op = ch.operation WHERE ch.kind = 'operation_removed' GROUP BY ALL
  UNION ALL SELECT id, client, count(*), min(ts), max(ts), 'OBSERVED' FROM ch JOIN f ON f.op = ch.operation AND f.part = ch.part AND f.field = ch.field WHERE ch.kind = 'request_field_removed' GROUP BY ALL
  UNION ALL SELECT id, client, count(*) - count(*) FILTER (k % 4 <> 0), min(ts), max(ts), 'OBSERVED' FROM ch JOIN m ON m.op = ch.operation WHERE ch.kind = 'request_field_made_required' GROUP BY id, client HAVING count(*) > count(*) FILTER (k % 4 <> 0)
  UNION ALL SELECT id, client, count(*) FILTER (type = 'number'), min(ts), max(ts), 'OBSERVED' FROM ch JOIN f ON f.op = ch.operation AND f.part = ch.part AND f.field = ch.field WHERE ch.kind = 'request_type_changed' GROUP BY id, client HAVING count(*) FILTER (type = 'number') > 0
  UNION ALL SELECT id, client, count(*), min(ts), max(ts), 'OBSERVED' FROM ch JOIN f ON f.op = ch.operation AND f.part = ch.part AND f.field = ch.field WHERE ch.kind = 'request_enum_narrowed' AND val = 'team' GROUP BY ALL
  UNION ALL SELECT id, client, count(*), min(ts), max(ts), 'POTENTIAL' FROM ch JOIN m ON m.op = ch.operation AND (CAST(m.status AS VARCHAR) = ch.status OR (ch.status = '2XX' AND m.status BETWEEN 200 AND 299)) WHERE ch.kind LIKE 'response%' GROUP BY ALL),
en AS (SELECT max(ts) AS "end" FROM t),
act AS (SELECT count(*) AS active FROM (SELECT client FROM t WHERE client <> '' GROUP BY client HAVING max(ts) >= (SELECT "end" FROM en) - INTERVAL 3 DAY)),
e AS (SELECT ch.id, ch.kind, ch.operation, ch.field, ch.grp, CAST(coalesce(sum(requests), 0) AS BIGINT) AS requests, count(client) FILTER (client <> '') AS clients,
    count(client) FILTER (client <> '' AND last_ts >= "end" - INTERVAL 3 DAY) AS recent, count(client) FILTER (client <> '' AND last_ts >= "end" - INTERVAL 12 DAY) AS stale,
    max(last_ts) AS last_ts, any_value(active) AS active, CASE WHEN ch.kind LIKE 'response%' THEN 'POTENTIAL' ELSE 'OBSERVED' END AS evidence
  FROM ch CROSS JOIN en CROSS JOIN act LEFT JOIN hits ON hits.id = ch.id GROUP BY ALL),
sev AS (SELECT *, CASE WHEN clients = 0 THEN 6 WHEN recent > 0 AND recent / active >= 0.5 THEN 1 WHEN recent >= 3 OR (recent > 0 AND recent / active >= 0.1) THEN 2 WHEN recent >= 1 THEN 3 WHEN stale >= 1 THEN 4 ELSE 5 END AS lvl FROM e),
named AS (SELECT *, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'DORMANT', 'NONE_OBSERVED'][lvl] AS severity FROM sev)"""
#: The breaking changes between both specifications, written by hand; numbers as in the list of all changes, which here are the same.
CHANGES = """
ch(id, kind, operation, part, field, status) AS (VALUES
  (0, 'request_field_removed', 'GET /items/{id}', 'request.query', '$.limit', NULL), (1, 'response_field_removed', 'GET /items/{id}', 'response.body', '$.legacy_id', '200'),
  (2, 'request_field_removed', 'GET /items/featured', 'request.query', '$.limit', NULL), (3, 'response_field_removed', 'GET /items/featured', 'response.body', '$.legacy_id', '200'),
  (4, 'response_status_removed', 'GET /items/featured', 'response.body', NULL, '429'), (5, 'operation_removed', 'GET /items/{id}/clicks', NULL, NULL, NULL),
  (6, 'request_field_made_required', 'POST /orders', 'request.body', '$.email', NULL), (7, 'request_field_removed', 'POST /orders', 'request.body', '$.note', NULL),
  (8, 'request_type_changed', 'POST /orders', 'request.body', '$.qty', NULL), (9, 'request_enum_narrowed', 'POST /orders', 'request.body', '$.plan', NULL),
  (10, 'response_field_removed', 'POST /orders', 'response.body', '$.legacy_id', '201'),
  (11, 'request_field_made_required', 'POST /users', 'request.body', '$.email', NULL), (12, 'request_field_removed', 'POST /users', 'request.body', '$.note', NULL),
  (13, 'request_type_changed', 'POST /users', 'request.body', '$.qty', NULL), (14, 'request_enum_narrowed', 'POST /users', 'request.body', '$.plan', NULL),
  (15, 'response_field_removed', 'POST /users', 'response.body', '$.legacy_id', '2XX'), (16, 'response_field_removed', 'GET /reports/{year}', 'response.body', '$.legacy_id', '200')),
grouped AS (SELECT *, CASE WHEN part = 'request.query' OR field IS NULL THEN operation ELSE '' END || '|' || kind || '|' || coalesce(field, '') AS grp FROM ch)"""
_RANKED = "," + CHANGES + _HITS.replace("ch.grp", "grp").replace("FROM ch CROSS JOIN en", "FROM grouped ch CROSS JOIN en")


def _impact(spark, sf_dir):
    return impact.impact(bridge.cube(spark, sf_dir), bridge.changes(spark), bridge.spec_tables(spark)["responses"], bridge.CONFIG)


def _impact_once(spark, sf_dir):
    """The same rows, of which there are as many as changes, for queries that read them more than once."""
    return shared.stored(_impact(spark, sf_dir), "impact")


@query(
    _RANKED + """
SELECT n.id, n.kind, n.operation, n.field, evidence, severity, requests, clients, recent, stale, last_ts, touched AS operations_touched,
  CAST(row_number() OVER (ORDER BY evidence = 'POTENTIAL', lvl, recent DESC, last_ts DESC NULLS LAST, requests DESC, n.id) AS INTEGER) AS rank,
  CAST(row_number() OVER (ORDER BY touched DESC, n.id) AS INTEGER) AS rank_spec_only
FROM named n JOIN (SELECT grp, count(DISTINCT operation) AS touched FROM grouped GROUP BY grp) g ON g.grp = n.grp"""
)
def impact_ranked(spark, sf_dir):
    rows = _impact(spark, sf_dir)
    return _plain(rows.select("id", "kind", "operation", "field", "evidence", "severity", "requests", "clients", "recent", "stale", "last_ts", "operations_touched", "rank", "rank_spec_only"))


@query(_RANKED + " SELECT evidence, severity, count(*) AS changes FROM named GROUP BY ALL")
def impact_by_severity(spark, sf_dir):
    return impact.by_severity(_impact(spark, sf_dir))


@query(_RANKED + " SELECT id, client, requests, last_ts, CAST(row_number() OVER (PARTITION BY id ORDER BY requests DESC, client) AS INTEGER) AS place FROM hits WHERE client <> '' QUALIFY place <= 10")
def impact_top_clients(spark, sf_dir):
    h = impact.hits(bridge.cube(spark, sf_dir), bridge.changes(spark), bridge.spec_tables(spark)["responses"])
    return _plain(impact.top_clients(h).select("id", "client", "requests", "last_ts", "place"))


@query(_RANKED + " SELECT id, kind, operation FROM named WHERE evidence = 'OBSERVED' AND ((recent > 0 AND 100 * recent / active >= 40) OR lvl <= 1)")
def gate_check(spark, sf_dir):
    return impact.gate(_impact(spark, sf_dir), 1, 40.0, "CRITICAL").select("id", "kind", "operation")


@query("WITH RECURSIVE" + contracts.PAIRS + " SELECT * FROM changes", base=False)
def diff_breaking(spark, sf_dir):
    """All changes, breaking or not, between the two documents of each part."""
    rows = diff.diff(contracts.pairs(spark, sf_dir), openapi.graphs(contracts.documents(spark, sf_dir)))
    return rows.select("pair", "kind", "operation", "part", "field", "status", "breaking")


@query(
    _RANKED + """, ranked AS (SELECT id, operation, requests, row_number() OVER (ORDER BY evidence = 'POTENTIAL', lvl, recent DESC, last_ts DESC NULLS LAST, requests DESC, id) AS rank FROM named),
top AS (SELECT id, client, requests FROM hits WHERE client <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY requests DESC, client) <= 10),
first10 AS (SELECT id, operation FROM ranked WHERE requests > 0 AND id IN (SELECT id FROM top) ORDER BY rank LIMIT 10),
links AS (SELECT id, operation, client, requests FROM top JOIN first10 USING (id)), heavy AS (SELECT client FROM links GROUP BY client ORDER BY sum(requests) DESC, client LIMIT 14)
SELECT id, operation, CASE WHEN client IN (SELECT client FROM heavy) THEN client ELSE 'other' END AS client, CAST(sum(requests) AS BIGINT) AS requests FROM links GROUP BY ALL"""
)
def blast_radius(spark, sf_dir):
    cube, changes, answers = bridge.cube(spark, sf_dir), bridge.changes(spark), bridge.spec_tables(spark)["responses"]
    h = shared.stored(impact.hits(cube, changes, answers), "hits")  # counted once: the ranks, both sides of the links and the heaviest clients read them
    top = shared.stored(impact.top_clients(h).select("id", "client", "requests"), "top_clients")
    return views.blast_radius(shared.stored(impact.impact(cube, changes, answers, bridge.CONFIG, h), "impact"), top)


_MATRIX = [("GET /items/{id}", "request.query", "$.limit"), ("GET /items/{id}", "request.query", "$.sort"), ("POST /orders", "request.body", "$.note"), ("POST /orders", "request.body", "$.email")]


@query("SELECT who AS client, " + " || ".join(f"CASE WHEN bool_or(op = '{o}' AND part = '{p}' AND field = '{x}') THEN '1' ELSE '0' END" for o, p, x in _MATRIX) + " AS bits, row_number() OVER (ORDER BY bits DESC, who) AS place FROM f WHERE who <> '' GROUP BY who HAVING contains(bits, '1')")
def client_field_matrix(spark, sf_dir):
    return views.matrix(bridge.cube(spark, sf_dir), _MATRIX)


@query(", n AS (SELECT op, count(*) AS calls FROM m GROUP BY op) SELECT op AS operation, op <> 'GET /reports/{year}' AS changed, calls, CAST(row_number() OVER (ORDER BY calls DESC, op) AS INTEGER) AS place FROM n")
def matrix_operations(spark, sf_dir):
    return views.matrix_operations(bridge.cube(spark, sf_dir), bridge.changes(spark))


@query(
    _RANKED + """, s AS (SELECT operation, max(CASE WHEN evidence = 'OBSERVED' AND requests > 0 THEN 'breaking_observed' ELSE 'breaking_potential' END) AS low, bool_or(evidence = 'OBSERVED' AND requests > 0) AS seen FROM named GROUP BY operation),
n AS (SELECT op, count(*) AS calls FROM m GROUP BY op)
SELECT operation, CASE WHEN seen THEN 'breaking_observed' ELSE 'breaking_potential' END AS state, coalesce(calls, 0) AS calls, round(ln(1 + coalesce(calls, 0)), 6) AS size,
  CASE operation WHEN 'GET /items/{id}/clicks' THEN '/items/{id}' END AS parent FROM s LEFT JOIN n ON op = operation"""
)
def api_map(spark, sf_dir):
    rows = views.api_map(bridge.cube(spark, sf_dir), bridge.spec_tables(spark)["operations"], bridge.changes(spark), _impact(spark, sf_dir))
    return rows.withColumn("size", F.round("size", 6))


# Shapes of JSON and statistics.


@query(
    """
WITH r AS (SELECT o_orderkey AS key, l.* FROM orders o LEFT JOIN lineitem l ON l_orderkey = o_orderkey)
SELECT key, path, types FROM (
  SELECT DISTINCT key, '$' AS path, 'object' AS types FROM r UNION ALL SELECT DISTINCT key, '$.key', 'integer' FROM r UNION ALL SELECT DISTINCT key, '$.lines', 'array' FROM r
  UNION ALL SELECT DISTINCT key, '$.lines[]', 'object' FROM r WHERE l_orderkey IS NOT NULL UNION ALL SELECT DISTINCT key, '$.lines[].flag', 'string' FROM r WHERE l_orderkey IS NOT NULL
  UNION ALL SELECT key, '$.lines[].discount', string_agg(DISTINCT CASE WHEN l_discount = floor(l_discount) THEN 'integer' ELSE 'number' END, '|') FROM (SELECT * FROM r ORDER BY l_discount) WHERE l_orderkey IS NOT NULL GROUP BY key) WHERE types NOT LIKE '%|%'
UNION ALL SELECT key, '$.lines[].discount', 'integer|number' FROM r WHERE l_orderkey IS NOT NULL GROUP BY key HAVING count(DISTINCT l_discount = floor(l_discount)) = 2""",
    base=False,
)
def shape_extract(spark, sf_dir):
    """Field paths and types of all orders' JSON bodies."""
    o = shared.dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key")), 50_000)
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("key"), F.struct(F.col("l_returnflag").alias("flag"), F.col("l_discount").cast("double").alias("discount")).alias("x"))
    lines = item.groupBy("key").agg(F.collect_list("x").alias("lines"))
    body = o.join(lines, "key", "left").select("key", F.to_json(F.struct("key", F.coalesce("lines", F.array().cast("array<struct<flag:string,discount:double>>")).alias("lines"))).alias("body"))
    return shapes.shapes(body, "key", "body", depth=4).select("key", "path", F.array_join("types", "|").alias("types"))


@query("SELECT n_name AS nation, round(avg(c_acctbal), 6) AS mean, round(quantile_cont(c_acctbal, 0.1), 6) AS p10, round(median(c_acctbal), 6) AS median, round(quantile_cont(c_acctbal, 0.9), 6) AS p90, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", base=False)
def quantile_summary(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet")), F.col("c_nationkey") == F.col("n_nationkey"))
    s = statistics.summary(c.select(F.col("n_name").alias("nation"), F.col("c_acctbal").cast("double").alias("x")), ["nation"], "x")
    return s.select("nation", *[F.round(x, 6).alias(x) for x in ("mean", "p10", "median", "p90")], "n")


@query(
    """
WITH r AS (SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS x, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS y FROM nation)
SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(sign(a.x - b.x) * sign(a.x - b.x)) * sum(sign(a.y - b.y) * sign(a.y - b.y))), 6) AS tau FROM r a JOIN r b ON a.k < b.k""",
    base=False,
)
def kendall_tau(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("x"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("y"))
    r = n.join(c, "k", "left").join(s, "k", "left").fillna(0)
    return statistics.kendall_tau(r, "k", "x", "y").select(F.round("tau", 6).alias("tau"))


@query(
    ", a AS (SELECT DISTINCT op, client FROM m WHERE day < DATE '2024-01-10'), b AS (SELECT DISTINCT op, client FROM m WHERE day >= DATE '2024-01-10'), j AS (SELECT a.op AS x, b.op AS y FROM a FULL JOIN b ON a.op = b.op AND a.client = b.client), c AS (SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS \"both\", count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b FROM j) SELECT *, round(\"both\" / (\"both\" + only_a), 6) AS precision, round(\"both\" / (\"both\" + only_b), 6) AS recall, round(\"both\" / (\"both\" + only_a + only_b), 6) AS jaccard FROM c"
)
def set_agreement(spark, sf_dir):
    c = cells.fold(bridge.cube(spark, sf_dir), "CALL", "operation", "client", "day")
    out = statistics.agreement(c.where("day < DATE'2024-01-10'"), c.where("day >= DATE'2024-01-10'"), ["operation", "client"])
    return out.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "jaccard")})


@query("SELECT count(*) FILTER (latency > 50 AND status >= 400) AS tp, count(*) FILTER (latency <= 50 AND status >= 400) AS fp, count(*) FILTER (latency > 50 AND status < 400) AS fn, count(*) FILTER (latency <= 50 AND status < 400) AS tn FROM t")
def confusion(spark, sf_dir):
    return statistics.confusion(bridge.traffic(spark, sf_dir), F.col("latency_ms") > 50, F.col("status") >= 400).drop("precision", "recall")


@query("SELECT o_orderpriority AS line, CAST(count(*) - (SELECT count(*) FROM orders b WHERE b.o_orderpriority = a.o_orderpriority AND b.o_orderstatus = 'F') AS BIGINT) AS n FROM orders a WHERE o_orderstatus = 'O' GROUP BY 1 HAVING n > 0", base=False)
def text_diff(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("line"), "o_orderstatus")
    return statistics.removed_lines(o.where("o_orderstatus = 'O'").select("line"), o.where("o_orderstatus = 'F'").select("line")).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT field, n, round(1 - pow(1 - p, n), 6) AS predicted FROM (SELECT field, count(*) / (SELECT count(*) FROM m WHERE op = 'POST /orders') AS p FROM f WHERE op = 'POST /orders' AND part = 'request.body' GROUP BY field), (VALUES (1), (10), (100)) AS v(n)")
def learning_curve(spark, sf_dir):
    p = views.field_presence(bridge.cube(spark, sf_dir)).where("operation = 'POST /orders' AND part = 'request.body'").select("field", "presence")
    return statistics.learning_curve(p, "presence", [1, 10, 100]).select("field", "n", F.round("predicted", 6).alias("predicted"))


# Evaluation.

_SCORES = _RANKED + """, ranked AS (SELECT n.*, row_number() OVER (ORDER BY evidence = 'POTENTIAL', lvl, recent DESC, last_ts DESC NULLS LAST, requests DESC, n.id) AS rank,
  row_number() OVER (ORDER BY touched DESC, n.id) AS plain FROM named n JOIN (SELECT grp, count(DISTINCT operation) AS touched FROM grouped GROUP BY grp) g ON g.grp = n.grp),
scores AS (SELECT id, requests AS truth, ranking, score FROM ranked, LATERAL (VALUES ('report', -rank), ('severity_first', -(lvl * 1000000 + rank)), ('client_count', clients), ('volume_only', requests), ('spec_only', -plain)) AS v(ranking, score))"""


@query(
    _SCORES + """ SELECT a.ranking, round(sum(sign(a.score - b.score) * sign(a.truth - b.truth)) / sqrt(sum(abs(sign(a.score - b.score))) * sum(abs(sign(a.truth - b.truth)))), 6) AS tau
FROM scores a JOIN scores b ON a.ranking = b.ranking AND a.id < b.id GROUP BY a.ranking"""
)
def comparator_tau(spark, sf_dir):
    """How the report's order and others agree with the order by requests."""
    rows = _impact_once(spark, sf_dir)
    truth = rows.select("id", F.col("requests").cast("double").alias("truth"))
    return evaluation.rank_correlation(evaluation.comparators(rows), truth).withColumn("tau", F.round("tau", 6))


@query(
    _SCORES + """, p AS (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY score DESC, id) AS place, row_number() OVER (PARTITION BY ranking ORDER BY truth DESC, id) AS best FROM scores),
x AS (SELECT ranking, max(truth) FILTER (best = 5) AS fifth FROM p GROUP BY ranking)
SELECT p.ranking, count(*) FILTER (place <= 5 AND truth >= fifth) / 5 AS top5 FROM p JOIN x USING (ranking) GROUP BY p.ranking"""
)
def comparator_top5(spark, sf_dir):
    rows = _impact_once(spark, sf_dir)
    return evaluation.top_five(evaluation.comparators(rows), rows.select("id", F.col("requests").cast("double").alias("truth")))


@query(
    ", a AS (SELECT DISTINCT op, client FROM m WHERE client <> '' AND day < DATE '2024-01-10'), b AS (SELECT DISTINCT op, client FROM m WHERE client <> '') SELECT b.op AS operation, count(a.op) AS found, count(*) AS \"true\", count(a.op) AS \"both\", CASE WHEN count(a.op) > 0 THEN 1.0 END::DOUBLE AS precision, round(count(a.op) / count(*), 6) AS recall FROM b LEFT JOIN a ON a.op = b.op AND a.client = b.client GROUP BY b.op"
)
def client_set_quality(spark, sf_dir):
    """Callers known from the first days against all."""
    calls = cells.fold(bridge.cube(spark, sf_dir), "CALL", "operation", "client", "day").where("client <> ''")
    return evaluation.client_sets(calls.where("day < DATE'2024-01-10'"), calls, "operation").withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(
    """, g AS (SELECT op, part, st, field, count(*) AS c, count(*) FILTER (day < DATE '2024-01-03') AS c0 FROM f GROUP BY ALL),
b AS (SELECT op, 'request.query' AS part, 0 AS st, count(*) AS n, count(*) FILTER (day < DATE '2024-01-03') AS n0 FROM m GROUP BY op UNION ALL SELECT op, 'request.body', 0, count(*), count(*) FILTER (day < DATE '2024-01-03') FROM m WHERE method = 'POST' GROUP BY op
  UNION ALL SELECT op, 'response.body', status, count(*), count(*) FILTER (day < DATE '2024-01-03') FROM m WHERE status < 300 GROUP BY op, status),
q AS (SELECT least(1.0, c / n)::DOUBLE AS p, c0, n0 FROM g JOIN b ON g.op = b.op AND g.part = b.part AND g.st = b.st)
SELECT CASE WHEN p >= 0.5 THEN 0.5 WHEN p >= 0.1 THEN 0.1 WHEN p >= 0.01 THEN 0.01 ELSE 0.0 END::DOUBLE AS stratum, count(*) AS fields, count(*) FILTER (c0 > 0) AS found, round(sum(1 - pow(1 - p, n0)), 4) AS predicted FROM q GROUP BY 1"""
)
def field_recall(spark, sf_dir):
    """Fields that two days of traffic show, by how often they really come."""
    cube = bridge.cube(spark, sf_dir)
    found = evaluation.field_recall(views.field_presence(cube.where("day < DATE'2024-01-03'")), views.field_presence(cube))
    return found.withColumn("predicted", F.round("predicted", 4))


@query(
    ", n AS (SELECT op, count(DISTINCT client) AS t, count(DISTINCT client) FILTER (day < DATE '2024-01-05') AS f FROM m WHERE client <> '' GROUP BY op), c AS (SELECT count(DISTINCT client) AS p, count(DISTINCT client) FILTER (day < DATE '2024-01-05') AS s FROM t WHERE client <> ''), e AS (SELECT abs(f / s - t / p) AS error FROM n, c) SELECT count(*) AS rows, round(avg(error), 6) AS mean, round(quantile_cont(error, 0.9), 6) AS p90 FROM e"
)
def share_error(spark, sf_dir):
    """The share of clients that the first days show for an operation against the share of all."""
    cube = bridge.cube(spark, sf_dir)
    calls, known = cells.fold(cube, "CALL", "operation", "client", "day").where("client <> ''"), cells.fold(cube, "EVENT", "client", "day").where("client <> ''")
    early = "day < DATE'2024-01-05'"
    return evaluation.share_error(calls.where(early), known.where(early), calls, known, "operation").withColumns({c: F.round(c, 6) for c in ("mean", "p90")})


_EARLY = BASE.replace("FROM t0)", "FROM t0 WHERE CAST(ts AS DATE) < DATE '2024-01-16')")


@query(f"SELECT truth, said, count(*) AS count FROM ({BASE}{_RANKED} SELECT id, severity AS truth FROM named) a JOIN ({_EARLY}{_RANKED} SELECT id, severity AS said FROM named) b USING (id) GROUP BY ALL", base=False)
def severity_confusion(spark, sf_dir):
    """Severities as half a month of traffic gives them against those of all."""
    early = bridge.cube(spark, sf_dir).where("day < DATE'2024-01-16'")
    said = impact.impact(early, bridge.changes(spark), bridge.spec_tables(spark)["responses"], bridge.CONFIG)
    return evaluation.severity_matrix(said, _impact(spark, sf_dir))


@query(
    """, s AS (SELECT op, part, st, field, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM f WHERE day < DATE '2024-01-02' GROUP BY ALL), a AS (SELECT op, part, st, field, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM f WHERE day >= DATE '2024-01-02' GROUP BY ALL),
n AS (SELECT count(s.types) AS found, count(a.types) AS "true", count(*) FILTER (s.types IS NOT NULL AND a.types IS NOT NULL) AS "both", count(*) FILTER (s.types = a.types) AS same_types FROM s FULL JOIN a USING (op, part, st, field))
SELECT *, round("both" / found, 6) AS precision, round("both" / "true", 6) AS recall, round(same_types / "both", 6) AS type_accuracy FROM n"""
)
def type_quality(spark, sf_dir):
    """Fields and types of the first day against those of the days after it."""
    types = bridge.cube(spark, sf_dir).where("kind = 'TYPE'").select("operation", "part", "status", "field", F.col("detail").alias("type"), "day")
    found = evaluation.type_quality(types.where("day < DATE'2024-01-02'"), types.where("day >= DATE'2024-01-02'"))
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "type_accuracy")})


@query(
    "," + SPEC + PLACED + """, o AS (SELECT op, part, CAST(st AS VARCHAR) AS st, answer, count(*) AS n FROM placed WHERE type = 'object' AND field = '$' AND day < DATE '2024-01-03' GROUP BY ALL HAVING count(*) >= 5),
c AS (SELECT d.operation, d.part, o.st, d.field, o.n FROM d JOIN o ON d.operation = o.op AND d.part = o.part AND d.status = o.answer WHERE d.field <> '$' AND d.field <> '$.tags.*'),
p AS (SELECT op, part, CAST(st AS VARCHAR) AS st, field, count(*) AS n, count(*) FILTER (day < DATE '2024-01-03') AS n0 FROM f GROUP BY ALL),
q AS (SELECT CASE WHEN r.n > 0 THEN least(1.0, coalesce(x.n, 0) / r.n) ELSE 0.0 END AS share, CASE WHEN coalesce(x.n0, 0) = 0 THEN 1 - pow(0.05, 1.0 / c.n) END AS bound FROM c LEFT JOIN p x ON x.op = c.operation AND x.part = c.part AND x.st = c.st AND x.field = c.field LEFT JOIN p r ON r.op = c.operation AND r.part = c.part AND r.st = c.st AND r.field = '$'),
n AS (SELECT count(bound) AS statements, count(*) FILTER (share <= bound) AS covered, count(*) FILTER (bound IS NOT NULL AND share > 0) AS occurring, count(*) FILTER (share <= bound AND share > 0) AS covered_occurring, count(*) FILTER (share > 0) AS eligible FROM q)
SELECT *, occurring - covered_occurring AS wrong, round(covered / nullif(statements, 0), 6) AS coverage, round(covered_occurring / nullif(occurring, 0), 6) AS coverage_occurring, round((occurring - covered_occurring) / nullif(eligible, 0), 6) AS wrong_rate FROM n"""
)
def bound_calibration(spark, sf_dir):
    """Fields that two days of traffic let appear unused, and how often they come in all of it."""
    cube = bridge.cube(spark, sf_dir)
    t, early = bridge.spec_tables(spark), cube.where("day < DATE'2024-01-03'")
    of = [f(early, t["declared"], t["responses"], 5) for f in (drift.could_be_unused, drift.unused_fields)]
    found = evaluation.bound_calibration(*of, views.field_presence(cube))
    return found.withColumns({c: F.round(c, 6) for c in ("coverage", "coverage_occurring", "wrong_rate")})


@query(
    "," + SPEC + PLACED + """, u AS (SELECT 'undocumented_field' AS kind, op, part, st, field, day FROM placed p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.operation = op AND d.part = p.part AND d.status = p.answer AND d.field = p.at)
  UNION ALL SELECT 'type_mismatch', op, p.part, st, p.field, day FROM placed p JOIN d ON d.operation = op AND d.part = p.part AND d.status = p.answer AND d.field = p.at WHERE p.part <> 'request.query' AND type <> d.types AND NOT (type = 'integer' AND d.types = 'number')),
z AS (SELECT kind, bool_or(day < DATE '2024-01-02') AS found, bool_or(day >= DATE '2024-01-02') AS "true" FROM u GROUP BY kind, op, part, st, field)
SELECT kind, count(*) FILTER (found AND "true") AS tp, count(*) FILTER (NOT found) AS fn, count(*) FILTER (NOT "true") AS fp FROM z GROUP BY kind"""
)
def drift_scores(spark, sf_dir):
    """Findings of the first day's traffic against those of the days after it."""
    cube, t = bridge.cube(spark, sf_dir), bridge.spec_tables(spark)
    days = [cube.where("day < DATE'2024-01-02'"), cube.where("day >= DATE'2024-01-02'")]
    score = lambda kind, of: evaluation.drift_counts(*[of(c, t["declared"], t["responses"]) for c in days], drift.KEYS).select(F.lit(kind).alias("kind"), "tp", "fn", "fp")
    return score("undocumented_field", drift.undocumented_fields).union(score("type_mismatch", drift.type_mismatches))


@query(
    """, a AS (SELECT DISTINCT op, client FROM m WHERE day < DATE '2024-01-10'), b AS (SELECT DISTINCT op, client FROM m WHERE day >= DATE '2024-01-10'),
j AS (SELECT coalesce(a.op, b.op) AS operation, coalesce(a.client, b.client) AS client, CASE WHEN a.op IS NULL THEN 'only_b' WHEN b.op IS NULL THEN 'only_a' ELSE 'both' END AS verdict FROM a FULL JOIN b ON a.op = b.op AND a.client = b.client),
p AS (SELECT *, row_number() OVER (PARTITION BY operation, verdict ORDER BY client) AS place FROM j)
SELECT operation, verdict, count(*) AS n, string_agg(client, ',' ORDER BY client) FILTER (place <= 5) AS examples FROM p GROUP BY operation, verdict"""
)
def agreement_classes(spark, sf_dir):
    """Callers of each operation before and after a day, with examples."""
    c = cells.fold(bridge.cube(spark, sf_dir), "CALL", "operation", "client", "day")
    out = statistics.agreement_classes(c.where("day < DATE'2024-01-10'"), c.where("day >= DATE'2024-01-10'"), ["operation", "client"], "operation")
    return out.withColumn("examples", F.array_join("examples", ","))


@query(
    """, s AS (SELECT client, op AS operation, 'call' AS what, '' AS field, '' AS value FROM m UNION ALL SELECT client, op, 'body', '', '' FROM m WHERE method = 'POST'
  UNION ALL SELECT who, op, 'path', field, '' FROM f WHERE part LIKE 'request%' UNION ALL SELECT who, op, 'type', field, type FROM f WHERE part LIKE 'request%' UNION ALL SELECT who, op, 'value', field, val FROM f WHERE val IS NOT NULL)
SELECT client, operation, what, field, value, count(*) AS count FROM s WHERE client <> '' GROUP BY ALL"""
)
def truth_counts(spark, sf_dir):
    return evaluation.truth_of(bridge.resolved(spark, sf_dir))


@query("WITH RECURSIVE" + contracts.DECLARED + """, one AS (SELECT operation, count(*) AS fields, CASE operation WHEN 'POST /parts' THEN '201' ELSE '200' END AS answers FROM fields GROUP BY operation)
SELECT p_partkey AS partkey, operation, split_part(operation, ' ', 1) AS method, split_part(operation, ' ', 2) AS path, fields, answers FROM part, one""", base=False)
def explorer_operations(spark, sf_dir):
    """Operations of each part's document with their answers and numbers of fields."""
    documents = contracts.documents(spark, sf_dir, ("old",))
    operations, answers = openapi.operations_of(shared.stored(openapi.graphs(documents).select("spec", "slots"), "slots"))
    rows = explorer.operation_details(openapi.declarations(documents), operations, answers, ("spec", "operation"))
    return rows.select(F.split_part("spec", F.lit(":"), F.lit(1)).cast("long").alias("partkey"), "operation", "method", "path", F.size("fields").cast("long").alias("fields"), F.array_join("answers", ",").alias("answers"))


_PAGE_PATHS = ORACLE_SQL["redact_path"]


@query(f"SELECT TIMESTAMP '2026-09-30 08:00:00' AS ts, 'GET' AS method, path, 200 AS status, 31.5::DOUBLE AS latency_ms, false AS skipped FROM ({_PAGE_PATHS})", base=False)
def har_scan(spark, sf_dir):
    """Pages as HAR archives of one entry each, scanned again."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    entry = lambda u: F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("2026-09-30T10:00:00.000+02:00").alias("startedDateTime"), F.lit(31.5).alias("time"), F.struct(F.lit("GET").alias("method"), u.alias("url")).alias("request"), F.struct(F.lit(200).alias("status")).alias("response"))).alias("entries")).alias("log")))
    e = T.har_entries(p.select(entry(F.col("url")).alias("value")))
    return _plain(e.select("ts", "method", C.redact_path(C.url_path(F.col("url"))).alias("path"), "status", "latency_ms", "skipped"))


@query("SELECT kind, operation, part, status, CASE WHEN kind = 'UNMATCHED' THEN regexp_replace(field, '[0-9]+$', '{*}') ELSE field END AS field, detail, client, day, CAST(sum(count) AS BIGINT) AS count, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM cells GROUP BY ALL")
def har_cells(spark, sf_dir):
    """Each user's traffic as a HAR archive with headers, query strings and bodies, sanitised to events and counted."""
    found = sanitise.sanitise(T.har_entries(bridge.archives(spark, sf_dir)), bridge.known_routes(spark), bridge.OLD, bridge.SALT, "header", "X-User")
    return _plain(cells.build_cells(routes.resolve(found, bridge.known_routes(spark))))


@query("SELECT ts, method, status, latency AS latency_ms, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL")
def har_ranges(spark, sf_dir):
    """The same archives written to files and read by ranges of bytes that cut them anywhere."""
    path = f"{shared.folder(spark)}/archives-{uuid.uuid4().hex}"
    bridge.archives(spark, sf_dir).write.text(path)
    found = archive.read_har(spark, path, chunk=1 << 20).where("NOT skipped")
    return _plain(found.groupBy("ts", F.upper("method").alias("method"), "status", "latency_ms").agg(F.count("*").alias("n")))


@query(
    _RANKED + """, n AS (SELECT op, count(*) AS n FROM m GROUP BY op)
SELECT id, kind, coalesce(n, 0) AS events_in_scope, round(CASE WHEN n > 0 THEN 1 - pow(0.05, 1.0 / n) END, 6) AS unseen_rate_upper_95, CASE WHEN n >= 100 THEN 'high' ELSE 'low' END AS tier FROM ch LEFT JOIN n ON op = operation"""
)
def impact_confidence(spark, sf_dir):
    cube = bridge.cube(spark, sf_dir)
    days = fold_days(cube)
    rows = report.confidence(bridge.changes(spark).where("breaking"), cube, days)
    return rows.select("id", "kind", "events_in_scope", F.round("unseen_rate_upper_95", 6).alias("unseen_rate_upper_95"), "tier")


def fold_days(cube: DataFrame) -> DataFrame:
    e = cells.fold(cube, "EVENT", "kind")
    return e.select(C.window_days(F.col("first_ts").cast("timestamp"), F.col("last_ts").cast("timestamp")).alias("window_days"))


@query(
    """, w AS (SELECT count(*) AS events, count(*) FILTER (client <> '') AS identified, count(op) AS matched_events, count(*) - count(op) AS unmatched_events, min(ts) AS first_event, max(ts) AS last_event FROM t)
SELECT *, (SELECT count(*) FROM (SELECT client FROM t WHERE client <> '' GROUP BY client HAVING max(ts) >= (SELECT max(ts) FROM t) - INTERVAL 3 DAY)) AS active_clients, 17 AS changes_total, 17 AS breaking_total, false AS truncated,
  round((epoch_ms(last_event) - epoch_ms(first_event)) / 86400000.0, 6) AS window_days, round(3 / ((epoch_ms(last_event) - epoch_ms(first_event)) / 86400000.0), 6) AS min_detectable_rate_per_day, CAST(4 AS INTEGER) AS limitations FROM w"""
)
def report_header(spark, sf_dir):
    """The report's header; of its limitations the number: one each on responses, unnamed events, rare clients, and what isn't compared."""
    cube = bridge.cube(spark, sf_dir)
    head = report.header(cube, bridge.changes(spark), views.active_clients(cube, 3), bridge.CONFIG)
    return _plain(head.withColumns({"window_days": F.round("window_days", 6), "min_detectable_rate_per_day": F.round("min_detectable_rate_per_day", 6), "limitations": F.size("limitations")}))


@query()
def report_json(spark, sf_dir):
    """The whole report as one JSON text; its rows, header and drift have queries with SQL of their own."""
    cube, t = bridge.cube(spark, sf_dir), bridge.spec_tables(spark)
    rows = impact.impact(cube, bridge.changes(spark), t["responses"], bridge.CONFIG)
    said = report.describe(*map(F.col, ("kind", "operation", "part", "field", "status", "from", "to")))
    rows = report.confidence(rows.withColumn("description", said), cube, fold_days(cube)).select("rank", "rank_spec_only", "id", "kind", "operation", "part", "field", "description", "evidence", "severity", "clients", "requests", "recent", "stale", "share_recent", "operations_touched", "events_in_scope", "unseen_rate_upper_95", "tier")
    findings = drift.undocumented_fields(cube, t["declared"], t["responses"]).select(F.lit("undocumented_field").alias("kind"), "operation", "part", "status", "field", "count")
    head = report.header(cube, bridge.changes(spark), views.active_clients(cube, 3), bridge.CONFIG)
    return report.document(head, rows, findings, report.unsupported(spark, bridge.OLD, bridge.NEW))


@query("WITH RECURSIVE" + contracts.DECLARED + """ SELECT p_partkey AS partkey, operation, part, status, field, types, open, CASE node WHEN 'container' THEN p_type WHEN 'tier' THEN 'gold|silver|tin' END AS enum FROM part, fields""", base=False)
def declared_fields(spark, sf_dir):
    """Declared fields of each part's document."""
    rows = openapi.declarations(contracts.documents(spark, sf_dir, ("old",)))
    return rows.select(F.split_part("spec", F.lit(":"), F.lit(1)).cast("long").alias("partkey"), "operation", "part", "status", "field", F.array_join("types", "|").alias("types"), "open", F.array_join("enum", "|").alias("enum"))
