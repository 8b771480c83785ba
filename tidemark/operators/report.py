"""The report of a specification change: header, rows with confidence and description, limits, unsupported constructs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .cells import fold

#: How many unsupported constructs a report lists.
MOST_UNSUPPORTED = 200


def describe(kind: Column, operation: Column, part: Column, field: Column, status: Column, before: Column, after: Column) -> Column:
    """One sentence for a change of a field; others are named by their kind."""
    where = F.when(part == "request.body", "request body").when(part == "response.body", F.concat(F.lit("response "), F.coalesce(status, F.lit("")))).otherwise(F.concat(F.regexp_replace(part, "^request[.]", ""), F.lit(" parameters")))
    subject = F.concat(F.lit("Field "), field, F.lit(" in the "), where, F.lit(" of "), operation)
    types = lambda x: F.coalesce(F.array_join(x, "|"), F.lit("any"))
    said = (
        F.when(kind.endswith("_removed"), " removed.").when(kind.endswith("_added_optional"), " added (optional).").when(kind.endswith("_added_required"), " added and required.").when(kind.endswith("_added"), " added.")
        .when(kind.endswith("_made_required"), " became required.").when(kind.endswith("_made_optional"), " became optional.")
        .when(kind.endswith("_type_changed"), F.concat(F.lit(" changed type from "), types(before), F.lit(" to "), types(after), F.lit(".")))
        .when(kind.endswith("_narrowed"), " allows fewer values.").when(kind.endswith("_widened"), " allows more values.").otherwise(" changed.")
    )
    plain = F.concat(C.capitalise(F.regexp_replace(kind, "_", " ")), F.lit(": "), operation, F.lit("."))
    return F.when(field.isNull() | part.isNull(), plain).otherwise(F.concat(subject, said))


def header(cells: DataFrame, changes: DataFrame, active: DataFrame, config) -> DataFrame:
    """One row: events, matched and identified ones, window, active clients, numbers of changes and whether some were left out, limitations."""
    e = fold(cells, "EVENT", "client").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("events"), F.coalesce(F.sum(F.when(F.col("client") != "", F.col("count"))), F.lit(0)).alias("identified"), F.min("first_ts").alias("first_event"), F.max("last_ts").alias("last_event")
    )
    m = cells.where("kind = 'CALL'").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("matched_events"))
    c = changes.agg(F.count("*").alias("changes_total"), F.count_if("breaking").alias("breaking_total"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))
    rows = e.crossJoin(m).crossJoin(active.agg(F.count("*").alias("active_clients"))).crossJoin(c)  # one row each
    days = C.window_days(F.col("first_event").cast("timestamp"), F.col("last_event").cast("timestamp"))
    rows = rows.withColumns({"unmatched_events": F.col("events") - F.col("matched_events"), "window_days": days}).withColumn("min_detectable_rate_per_day", C.detectable_rate(F.col("window_days")))
    return rows.withColumn("limitations", limitations(config))


def limitations(config) -> Column:
    """What a reader must know, as sentences; those that don't apply are left out."""
    short = lambda x: F.format_string("%.3g", x)
    said = [
        F.lit("Changes of responses are potential: traffic shows who calls and which status came back, not which fields were read."),
        F.when(F.lit(not config.identity) | (F.col("identified") == 0), "Traffic names no clients: severity is UNRATED and impact is the number of requests.").when(F.col("identified") < F.col("events"), F.concat((F.col("events") - F.col("identified")).cast("string"), F.lit(" events name no client; they count as requests alone."))),
        F.when(F.col("window_days") > 0, F.concat(F.lit("Clients that call less often than "), short(F.col("min_detectable_rate_per_day")), F.lit(" times a day may be missing from "), short(F.col("window_days")), F.lit(" days."))),
        F.when((F.col("window_days") > 0) & (F.col("window_days") < config.stale_days), "The window is shorter than stale_days: nothing can be DORMANT."),
        F.when(F.col("events") == 0, "There is no traffic: rows lack data, which is no proof of safety."),
        F.when(F.col("truncated"), "Some changes stand at more paths than are listed; each breaking one is listed at its shortest."),
        F.lit("Not compared: value constraints, defaults, formats, response headers, security."),
    ]
    return F.array_compact(F.array(*said))


def confidence(rows: DataFrame, cells: DataFrame, days: DataFrame) -> DataFrame:
    """rows (operation, ...) with events_in_scope, unseen_rate_upper_95, tier and the window's detectable rate; days: one row with window_days."""
    calls = fold(cells, "CALL", "operation").select("operation", F.col("count").alias("events_in_scope"))
    out = rows.join(F.broadcast(calls), "operation", "left").withColumn("events_in_scope", F.coalesce("events_in_scope", F.lit(0))).crossJoin(F.broadcast(days))  # one row
    n = F.col("events_in_scope")
    return out.withColumns({"unseen_rate_upper_95": C.unseen_bound(n), "tier": C.tier(n), "min_detectable_rate_per_day": C.detectable_rate(F.col("window_days"))})


def unsupported(spark, *specs) -> DataFrame:
    """(construct, location) of all specifications, each once, the first that many."""
    seen = dict.fromkeys(x for s in specs for x in s.unsupported)
    return spark.createDataFrame(list(seen)[:MOST_UNSUPPORTED], "construct string, location string")


def by_construct(found: DataFrame) -> DataFrame:
    return found.groupBy("construct").agg(F.count("*").alias("n"))


def document(head: DataFrame, rows: DataFrame, drift: DataFrame, constructs: DataFrame) -> DataFrame:
    """The whole report as one JSON text: as many parts as the specifications have changes and operations."""
    part = lambda d, name, by: d.agg(F.sort_array(F.collect_list(F.struct(by, *[c for c in d.columns if c != by]))).alias(name))
    severity = rows.groupBy("evidence", "severity").agg(F.count("*").alias("changes"))
    one = head.crossJoin(part(rows, "changes", "rank")).crossJoin(part(drift, "drift", drift.columns[0])).crossJoin(part(severity, "by_severity", "evidence")).crossJoin(part(constructs, "unsupported", "construct"))
    return one.select(F.to_json(F.struct(F.lit("0.2").alias("schema_version"), *one.columns)).alias("report"))
