"""The observed contract, latency, clients and the screens' views, from cells."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import shared
from .cells import fold


def latency_percentiles(cells: DataFrame, quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """Upper bucket edges that reach each quantile's rank."""
    b = fold(cells, "LATENCY", "operation", "detail").select("operation", F.col("detail").cast("int").alias("bucket"), "count")
    w = Window.partitionBy("operation")
    b = b.withColumns({"n": F.sum("count").over(w), "cum": F.sum("count").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))})
    cols = [C.latency_edge(F.min(F.when(F.col("cum") >= F.ceil(q * F.col("n")), F.col("bucket")))).alias(f"p{round(q * 100)}") for q in quantiles]
    return b.groupBy("operation").agg(F.max("n").alias("n"), *cols)


def operations(cells: DataFrame) -> DataFrame:
    calls = fold(cells, "CALL", "operation", "client")
    return calls.groupBy("operation").agg(F.sum("count").alias("calls"), F.count_if(F.col("client") != "").alias("clients"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def field_presence(cells: DataFrame) -> DataFrame:
    """How often each field was there, of how many calls or bodies that could hold it: one pass over the cells."""
    part = F.when(F.col("kind") == "CALL", "request.query").when(F.col("kind") == "REQUEST_BODY", "request.body").when(F.col("kind") == "RESPONSE_BODY", "response.body").otherwise(F.col("part"))
    rows = cells.where("kind IN ('CALL', 'REQUEST_BODY', 'RESPONSE_BODY', 'FIELD')").groupBy("operation", part.alias("part"), "status", "field").agg(F.sum("count").alias("count"))
    # Bodies and calls have no field; there is one row of them in each group of a few hundred fields at most.
    of = F.max(F.when(F.col("field") == "", F.col("count"))).over(Window.partitionBy("operation", "part", "status"))
    rows = rows.withColumn("of", of).where("field <> '' AND of IS NOT NULL")
    return rows.select("operation", "part", "status", "field", "count", "of", F.least(F.lit(1.0), F.col("count") / F.col("of")).alias("presence"))


def field_types(cells: DataFrame) -> DataFrame:
    return fold(cells, "TYPE", "operation", "part", "status", "field", "detail").select("operation", "part", "status", "field", F.col("detail").alias("type"), "count")


def status_answers(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """(operation, code, answer): the declared response of each status seen, exact before NXX before default."""
    seen = cells.where("kind = 'STATUS'").select("operation", F.col("status").alias("code")).distinct()
    text = F.col("code").cast("string")
    group = F.concat(F.substring(text, 1, 1), F.lit("XX"))
    rank = F.when(F.col("answer") == text, 0).when(F.col("answer") == group, 1).when(F.col("answer") == F.lower(group), 2).when(F.col("answer") == "default", 3)
    found = seen.join(F.broadcast(declared), "operation").withColumn("rank", rank).where("rank IS NOT NULL")
    return found.groupBy("operation", "code").agg(F.min_by("answer", "rank").alias("answer"))


def contract_fields(cells: DataFrame, declared: DataFrame, responses: DataFrame) -> DataFrame:
    """Declared and observed fields side by side: documented_and_used, never_seen or undocumented.

    A status seen that only NXX or default declares has the fields of that answer.  Roots of bodies are left out.
    """
    keys = ["operation", "part", "status", "field"]
    seen = field_presence(cells).select("operation", "part", F.col("status").cast("string").alias("status"), "field", "count").where("field <> '$'")
    d = declared.where("part IN ('request.query', 'request.body', 'response.body') AND field <> '$'").select(*keys)
    bodies = cells.where("kind = 'RESPONSE_BODY'").select("operation", F.col("status").alias("code")).distinct()
    codes = bodies.join(F.broadcast(status_answers(cells, responses)), ["operation", "code"])
    shown = d.where("part = 'response.body'").withColumnRenamed("status", "answer").join(F.broadcast(codes), ["operation", "answer"]).withColumn("status", F.col("code").cast("string"))
    out = d.unionByName(shown.select(*keys)).distinct().withColumn("d", F.lit(1)).join(seen, keys, "full_outer")
    state = F.when(F.col("d").isNull(), "undocumented").when(F.col("count").isNull(), "never_seen").otherwise("documented_and_used")
    return out.select(*keys, F.coalesce("count", F.lit(0)).alias("count"), state.alias("state"))


def active_clients(cells: DataFrame, days: float) -> DataFrame:
    """Clients of any event in the last days up to the last event."""
    c = fold(cells, "EVENT", "client")
    end = c.agg(F.max("last_ts").alias("end"))
    last = c.where("client <> ''").crossJoin(F.broadcast(end))  # one row
    return last.where(F.col("last_ts") >= F.col("end") - F.make_dt_interval(secs=F.lit(float(round(days * 86400))))).select("client", "last_ts")


def client_timeline(cells: DataFrame, most: int = 500) -> DataFrame:
    """Of each client all its events, matched or not, first and last; its calls by day and by operation as maps."""
    rows = cells.where("kind IN ('EVENT', 'CALL') AND client <> ''")
    calls = lambda key: rows.where("kind = 'CALL'").groupBy("client", key).agg(F.sum("count").alias("n"))
    by = lambda key, name: calls(key).groupBy("client").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(name))
    per = rows.where("kind = 'EVENT'").groupBy("client").agg(F.sum("count").alias("events"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    per = per.orderBy(F.desc("last_ts"), "client").limit(most)
    return per.join(by("day", "days"), "client", "left").join(by("operation", "operations"), "client", "left")


def _top(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The clients with most of each group.  Tasks leave their own first `most` of a group before rows move (WindowGroupLimit), up to Spark's limit of 1,000."""
    w = Window.partitionBy(*by).orderBy(F.desc("count"), "client")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(*by, "client", "count", "place")


def top_callers(cells: DataFrame, most: int = 500) -> DataFrame:
    """The clients with most calls of each operation."""
    return _top(fold(cells, "CALL", "operation", "client").where("client <> ''"), ["operation"], most)


def top_senders(cells: DataFrame, most: int = 500) -> DataFrame:
    """The clients that send each request field most often."""
    by = ["operation", "part", "field"]
    return _top(fold(cells.where("part LIKE 'request%' AND client <> ''"), "FIELD", *by, "client"), by, most)


def contract(cells: DataFrame, declared: DataFrame, responses: DataFrame) -> DataFrame:
    """One document for each operation that is declared or called: calls and callers, latency, statuses seen and whether they are documented, fields with their states.

    An operation has as many statuses and fields as it declares and shows, some hundreds.
    """
    known = status_answers(cells, responses).select("operation", F.col("code").alias("status"), F.lit(True).alias("documented"))
    seen = fold(cells, "STATUS", "operation", "status").select("operation", "status", "count").join(F.broadcast(known), ["operation", "status"], "left")
    statuses = seen.groupBy("operation").agg(F.sort_array(F.collect_list(F.struct("status", "count", F.coalesce("documented", F.lit(False)).alias("documented")))).alias("statuses"))
    fields = contract_fields(cells, declared, responses).groupBy("operation").agg(F.sort_array(F.collect_list(F.struct("part", "status", "field", "count", "state"))).alias("fields"))
    rows = operations(cells).join(latency_percentiles(cells).withColumnRenamed("n", "timed"), "operation", "left").join(statuses, "operation", "left").join(fields, "operation", "full_outer")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("calls", "clients")})


def dense_days(cells: DataFrame) -> DataFrame:
    """Calls of every day between the first and the last, days without calls too."""
    days = fold(cells, "CALL", "day").select("day", F.col("count").alias("calls"))
    axis = days.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return axis.join(days, "day", "left").select("day", F.coalesce("calls", F.lit(0)).alias("calls"))


def matrix(cells: DataFrame, fields: list[tuple[str, str, str]]) -> DataFrame:
    """For each client a string of bits, which of the (operation, part, field) it sent, and its place: signatures that are larger come first, then clients by name."""
    wanted = cells.sparkSession.createDataFrame([(i, *f) for i, f in enumerate(fields)], "at int, operation string, part string, field string")
    sent = fold(cells.where("part LIKE 'request%' AND client <> ''"), "FIELD", "operation", "part", "field", "client").join(F.broadcast(wanted), ["operation", "part", "field"])
    at = sent.groupBy("client").agg(F.collect_set("at").alias("at"))
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(len(fields) - 1)), lambda i: F.when(F.array_contains("at", i), "1").otherwise("0")), "")
    return placed(at.select("client", bits.alias("bits")), F.desc("bits"), F.col("client"))


def placed(rows: DataFrame, *order) -> DataFrame:
    """rows with their place from 1 in an order of all: sorted by ranges, counted in each, so that no task holds all."""
    # An id is the range's number and, in the lower 33 bits, the row's within it; ids are written once, as ranges are drawn by sampling.
    ids = shared.stored(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_id", 33)
    sizes = ids.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return ids.join(F.broadcast(starts), part == F.col("_part")).withColumn("place", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).select(*rows.columns, "place")


def matrix_operations(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Operations in the order of the matrix: those with breaking changes first, then by calls."""
    calls = fold(cells, "CALL", "operation").select("operation", F.col("count").alias("calls"))
    hit = changes.where("breaking").select("operation", F.lit(True).alias("changed")).distinct()
    rows = calls.join(F.broadcast(hit), "operation", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    # As many rows as a specification has operations.
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("changed"), F.desc("calls"), "operation")))


def blast_radius(impact: DataFrame, top: DataFrame, changes: int = 10, clients: int = 14) -> DataFrame:
    """Links (id, operation, client, requests) of the first ranked changes that reach clients; beyond the heaviest clients all are `other`.

    impact: rows with rank and requests; top: each change's top clients (id, client, requests).
    """
    first = impact.where("requests > 0").join(top.select("id").distinct(), "id", "left_semi").select("id", "operation", "rank").orderBy("rank").limit(changes)
    links = top.join(F.broadcast(first), "id").select("id", "operation", "client", "requests")
    heavy = links.groupBy("client").agg(F.sum("requests").alias("n")).orderBy(F.desc("n"), "client").limit(clients).select("client", F.lit(True).alias("kept"))
    named = links.join(F.broadcast(heavy), "client", "left").withColumn("client", F.when(F.col("kept"), F.col("client")).otherwise("other"))
    return named.groupBy("id", "operation", "client").agg(F.sum("requests").alias("requests"))


STATES = ["unchanged", "changed_safe", "breaking_potential", "breaking_observed"]


def api_map(cells: DataFrame, operations: DataFrame, changes: DataFrame, impact: DataFrame) -> DataFrame:
    """State, calls, size and parent of each operation: the longest path above its own that has operations.

    operations: (operation, method, path); changes: all; impact: rows of the breaking ones.
    """
    seen = impact.select("id", (((F.col("evidence") == "OBSERVED") & (F.greatest("clients", "requests") > 0)).cast("int") + 2).alias("level"))
    level = changes.join(F.broadcast(seen), "id", "left").groupBy("operation").agg(F.max(F.coalesce("level", F.lit(1))).alias("level"))
    calls = fold(cells, "CALL", "operation").select("operation", F.col("count").alias("calls"))
    known = operations.select("operation").union(changes.select("operation")).distinct()
    rows = known.join(F.broadcast(level), "operation", "left").join(calls, "operation", "left").fillna(0, ["level", "calls"])
    rows = rows.withColumn("path", F.split_part("operation", F.lit(" "), F.lit(2)))
    above = rows.select(F.col("path").alias("above")).distinct()
    inside = F.col("path").startswith(F.concat("above", F.lit("/"))) & (F.col("above") != "/")
    parent = rows.select("path").distinct().join(F.broadcast(above), inside).groupBy("path").agg(F.max_by("above", F.length("above")).alias("parent"))
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("level") + 1)
    return rows.join(F.broadcast(parent), "path", "left").select("operation", state.alias("state"), "calls", F.log1p("calls").alias("size"), "parent")
