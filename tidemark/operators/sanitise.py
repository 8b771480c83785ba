"""From captured exchanges to events: matched, reduced to shapes, pseudonymous."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.openapi import Spec
from ..sources.traffic import FIELD, client_identity
from .routes import Routes, match
from .shapes import MOST_VALUES, Bodies, with_shape


def json_text(media: Column, text: Column) -> Column:
    """The text where it may be JSON, by its media type (no wildcard) or its first sign; else null."""
    first = F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 1)
    declared = F.coalesce(C.is_json_media(media) & ~F.contains(media, F.lit("*")), F.lit(False))
    return F.when((F.trim(F.regexp_replace(text, r"\s", " ")) != "") & (declared | first.isin("{", "[")), text)


def event_time(headers: Column, header: str | None, captured: Column) -> Column:
    """The time that a request header gives as an instant, else that of the capture."""
    if not header:
        return captured
    said = F.trim(headers[header.lower()])
    return F.coalesce(F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}T.*Z$"), F.try_to_timestamp(said)), captured)


def query_fields(url: Column, enums: Column) -> Column:
    """One field for each name of the query string, always a string; values only of declared enums."""
    pairs = C.query_pairs(url)
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))

    def field(n: Column) -> Column:
        path = C.child_path(F.lit("$"), n)
        values = F.slice(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"])), 1, MOST_VALUES)
        return F.struct(path.alias("path"), F.array(F.lit("string")).alias("types"), F.when(F.array_contains(enums, path), values).alias("values"))

    return F.transform(names, field).cast(FIELD)


def sanitise(exchanges: DataFrame, routes: Routes | None = None, spec: Spec | None = None, salt: str = "", mode: str = "none", header: str = "", time_header: str | None = None) -> DataFrame:
    """Events of exchanges (see har_entries), those that are skipped left out; without routes nothing is matched.

    Of what the specification declares as enums alone values are kept: fields of bodies, also under maps, and
    query parameters, also arrays.
    """
    rows = exchanges.where("NOT skipped").withColumn("method", F.upper("method")).withColumn("_path", C.url_path(F.col("url")))
    rows = match(rows, routes, "method", "_path") if routes is not None else rows.withColumn("op_key", F.lit(None).cast("string"))
    enums = F.array().cast("array<string>")
    if spec is not None:
        # As many entries as the specification has such parameters.
        for op in sorted({o for o, _ in Bodies(spec).queries}):
            enums = F.when(F.col("op_key") == op, F.array(*[F.lit(p) for o, p in Bodies(spec).queries if o == op])).otherwise(enums)
    rows = rows.withColumns({"_in": json_text(F.col("request_type"), F.col("request_text")), "_out": json_text(F.col("response_type"), F.col("response_text"))})
    rows = with_shape(rows, "_in", "_request", spec, F.col("op_key"))
    rows = with_shape(rows, "_out", "_response", spec, F.col("op_key"), F.col("status"))
    return rows.select(
        *[c for c in exchanges.columns if c not in ("ts", "method", "url", "headers", "request_type", "request_text", "response_type", "response_text", "status", "latency_ms", "skipped")],
        event_time(F.col("headers"), time_header, F.col("ts")).alias("ts"), "method", F.col("op_key").alias("operation"), F.when(F.col("op_key").isNull(), C.redact_path(F.col("_path"))).alias("path"), "status", "latency_ms",
        client_identity(F.col("headers"), mode, salt, header).alias("client"), query_fields(F.col("url"), enums).alias("query"), F.col("_request.fields").cast(FIELD).alias("request_body"), F.col("_response.fields").cast(FIELD).alias("response_body"),
        (F.coalesce("_request.truncated", F.lit(False)) | F.coalesce("_response.truncated", F.lit(False))).alias("truncated"),
    )
