"""Traffic sources and sinks: event lines, HAR archives, tables of events and cells."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

FIELD = "array<struct<path:string,types:array<string>,values:array<string>>>"
EVENT = f"ts timestamp, method string, operation string, path string, status int, latency_ms double, client string, query {FIELD}, request_body {FIELD}, response_body {FIELD}, truncated boolean"
LINE = (
    "struct<v:int,ts:string,method:string,operation:string,path:string,status:int,latency_ms:double,client:string,"
    f"request:struct<query:{FIELD},body:{FIELD},truncated:boolean>,response:struct<body:{FIELD},truncated:boolean>,_bad:string>"
)


#: Fixed value: the form of an instant in an event line.
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{0,9})?([Zz]|[+-]\d{2}:\d{2})$"


def _clean(fields: Column) -> Column:
    return F.transform(fields, lambda f: F.struct(f["path"].alias("path"), F.array_distinct(f["types"]).alias("types"), f["values"].alias("values")))


def _bad(fields: Column) -> Column:
    """A field without a `$` path, without types, or with one that JSON does not have."""
    known = lambda types: F.coalesce((F.size(types) > 0) & F.forall(types, lambda t: F.coalesce(t.isin(C.TYPES), F.lit(False))), F.lit(False))
    return F.exists(F.coalesce(fields, F.array().cast(FIELD)), lambda f: F.coalesce(~f["path"].startswith("$"), F.lit(True)) | ~known(f["types"]))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Event columns and `rejected`, the reason why a line is no event (null for good ones)."""
    x = F.from_json(column, LINE, {"columnNameOfCorruptRecord": "_bad"})
    # As an array's only element: a filter on what is parsed then stays above, and does not parse again for each part that it asks for.
    rows = lines.select("*", F.explode(F.array(x)).alias("_x"))
    g = lambda n: F.col(f"_x.{n}")
    ts = F.when(g("ts").rlike(INSTANT), F.try_to_timestamp(g("ts")))
    reason = (
        F.when(F.col("_x").isNull() | g("_bad").isNotNull(), "not JSON")
        .when(F.coalesce(g("v") != 1, F.lit(True)), "unknown version")
        .when(ts.isNull(), "no timestamp")
        .when(g("method").isNull(), "no method")
        .when(g("status").isNull(), "no status")
        .when(g("operation").isNull() & g("path").isNull(), "neither operation nor path")
        .when(_bad(g("request.query")) | _bad(g("request.body")) | _bad(g("response.body")), "bad field")
    )
    return rows.withColumn("rejected", reason).select(
        *[c for c in lines.columns],
        ts.alias("ts"), g("method").alias("method"), g("operation").alias("operation"), g("path").alias("path"), g("status").alias("status"),
        g("latency_ms").alias("latency_ms"), g("client").alias("client"),
        F.coalesce(_clean(g("request.query")), F.array().cast(FIELD)).alias("query"), _clean(g("request.body")).alias("request_body"), _clean(g("response.body")).alias("response_body"),
        F.coalesce(g("response.truncated"), F.lit(False)).alias("truncated"), "rejected",
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def to_lines(events: DataFrame) -> DataFrame:
    """One JSON line an event, as the scan reads it; `truncated` only goes with a response body."""
    request = F.struct(F.col("query"), F.col("request_body").alias("body"))
    response = F.when(F.col("response_body").isNotNull(), F.struct(F.col("response_body").alias("body"), F.col("truncated")))
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return events.withColumn("value", F.to_json(F.struct(F.lit(1).alias("v"), ts.alias("ts"), "method", "operation", "path", "status", "latency_ms", "client", request.alias("request"), response.alias("response"))))


ENTRY = (
    "startedDateTime:string,time:double,request:struct<method:string,url:string,headers:array<struct<name:string,value:string>>,postData:struct<mimeType:string,text:string>>,"
    "response:struct<status:int,content:struct<mimeType:string,text:string,encoding:string>>"
)


def har_entries(archives: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """Exchanges of HAR texts: ts, method, url, headers, bodies with their types, status, latency_ms, skipped.

    strict: a status outside 100 to 599 is skipped as well, as in a browser's captures.
    """
    e = F.explode(F.from_json(column, f"struct<log:struct<entries:array<struct<{ENTRY}>>>>")["log"]["entries"]).alias("e")
    return exchanges(archives.select(e), strict)


def exchanges(rows: DataFrame, strict: bool = False) -> DataFrame:
    """The columns of har_entries() from parsed entries `e`."""
    text = F.col("e.response.content.text")
    body = F.when(F.col("e.response.content.encoding") == "base64", F.try_to_binary(text, F.lit("base64")).cast("string")).otherwise(text)
    ts = F.try_to_timestamp(F.col("e.startedDateTime"))
    heads = F.transform(F.coalesce(F.col("e.request.headers"), F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.struct(F.lower(F.coalesce(h["name"], F.lit(""))).alias("name"), F.coalesce(h["value"], F.lit("")).alias("value")))
    first = F.map_from_entries(F.filter(heads, lambda h, i: ~F.exists(F.slice(heads, F.lit(1), i), lambda g: g["name"] == h["name"])))
    return rows.select(
        ts.alias("ts"), F.col("e.request.method").alias("method"), F.col("e.request.url").alias("url"), first.alias("headers"),
        F.col("e.request.postData.mimeType").alias("request_type"), F.col("e.request.postData.text").alias("request_text"), F.col("e.response.content.mimeType").alias("response_type"), body.alias("response_text"), F.col("e.response.status").alias("status"),
        F.when(F.col("e.time") >= 0, F.col("e.time")).alias("latency_ms"),
        (ts.isNull() | F.col("e.request.method").isNull() | F.col("e.request.url").isNull() | F.col("e.response.status").isNull() | (~F.col("e.response.status").between(100, 599) if strict else F.lit(False))).alias("skipped"),
    )


def client_identity(headers: Column, mode: str, salt: str, header: str = "") -> Column:
    """Pseudonym of the sender: a header of choice, or the key that it calls with; null without one."""
    value = {"none": F.lit(None).cast("string"), "header": headers[header.lower()], "api_key_hash": F.coalesce(headers[header.lower() or "authorization"], headers["x-api-key"])}[mode]
    return F.when(F.coalesce(value, F.lit("")) != "", C.pseudonym(salt, value))


def write_events(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def retain(df: DataFrame, cutoff) -> DataFrame:
    """Rows of days from the cutoff day on (cells) or of times from the cutoff on (events)."""
    return df.where(F.col("day") >= F.to_date(F.lit(cutoff))) if "day" in df.columns and "ts" not in df.columns else df.where(F.col("ts") >= F.lit(cutoff))
