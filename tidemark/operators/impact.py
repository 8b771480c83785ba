"""Who is affected by each change: evidence, exposure, severity, ranks, gate."""

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import shared
from .cells import fold

CHANGE = "id int, kind string, operation string, part string, field string, status string, `from` array<string>, `to` array<string>, breaking boolean, source string, direction string, truncated boolean"


@dataclass(frozen=True)
class Config:
    recent_days: float = 7
    stale_days: float = 30
    high_clients: int = 3
    high_share: float = 0.1
    critical_share: float = 0.5
    critical_clients: tuple = ()
    identity: bool = True


OBSERVABLE = ["request.query", "request.body"]
#: What rules look at in a cell, and kinds of cells that they count.
SHAPE = ["operation", "kind", "part", "field", "detail", "status"]
COUNTED = ["CALL", "REQUEST_BODY", "FIELD", "TYPE", "VALUE", "STATUS"]


def _rules(changes: DataFrame, cells: DataFrame, responses: DataFrame) -> DataFrame:
    """Breaking changes with what their rules ask: the parent of a field, the operation's answers, whether values were captured.

    As many rows as two specifications have changes.
    """
    ch = changes.where("breaking").select("id", "kind", "operation", F.col("part").alias("c_part"), F.col("field").alias("c_field"), F.col("status").alias("wanted"), "from", "to", C.parent_path(F.col("field")).alias("parent"))
    answers = responses.groupBy("operation").agg(F.collect_set("answer").alias("answers"))
    captured = cells.where("kind = 'CAPTURED'").join(F.broadcast(ch.where("kind = 'request_enum_narrowed'").select("id", "operation", "c_part", "c_field")), "operation").where("part = c_part AND field = c_field").select("id").distinct().withColumn("captured", F.lit(True))
    ch = ch.join(F.broadcast(answers), "operation", "left").join(F.broadcast(captured), "id", "left")
    known = F.coalesce(F.col("captured") & F.col("from").isNotNull() & F.col("to").isNotNull(), F.lit(False))
    seen = F.coalesce(F.col("c_part").isin(OBSERVABLE), F.lit(False))
    kind, body = F.col("kind"), F.col("c_part") == "request.body"
    rule = (
        F.when(kind == "operation_removed", "call").when(kind == "request_field_removed", F.when(seen, "field"))
        .when(kind.isin("request_field_added_required", "request_field_made_required"), F.when(seen, F.when(body, "parent").otherwise("call without field")))
        .when(kind == "request_type_changed", F.when(body, "type").when(seen, "field"))
        .when(kind == "request_enum_narrowed", F.when(known, "value").otherwise("field"))
        .when(kind == "request_body_removed", "body").when(kind.isin("request_body_added", "request_body_made_required"), "call without body")
        .when(kind.startswith("response") | ((kind == "media_type_removed") & F.col("wanted").isNotNull()), "status")
    )
    loose = kind.startswith("response") | (kind == "media_type_removed") | ((kind.startswith("request_field") | (kind == "request_type_changed")) & ~seen) | ((kind == "request_type_changed") & ~body) | ((kind == "request_enum_narrowed") & ~known)
    ch = ch.withColumns({"rule": F.coalesce(rule, F.when(loose, "call")), "evidence": F.when(loose, "POTENTIAL").otherwise("OBSERVED"), "lost": F.array_except("from", "to")})
    return ch.where("rule IS NOT NULL").drop("kind", "captured", "from")


def hits(cells: DataFrame, changes: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, client, requests, first_ts, last_ts, evidence) by the rules of each kind of change.

    Rules say of a cell what it adds, what it takes away and whether it is of a type that is refused.  This depends on SHAPE
    only: rules are held against each such once, cells are joined with what matches, and one aggregation counts them all.
    """
    rules = F.broadcast(_rules(changes, cells, responses))
    counted = cells.where(F.col("kind").isin(COUNTED))
    x = counted.select(*SHAPE).distinct().join(rules, "operation")
    cell = lambda k: F.col("kind") == k
    rule = lambda *r: F.col("rule").isin(*r)
    place = (F.col("part") == F.col("c_part")) & (F.col("field") == F.col("c_field"))
    code = F.col("status").cast("string")
    group = F.concat(F.substring(code, 1, 1), F.lit("XX"))
    answer = F.coalesce(*[F.when(F.array_contains("answers", a), a) for a in (code, group, F.lower(group), F.lit("default"))])
    adds = (
        (rule("call", "call without field", "call without body") & cell("CALL")) | (rule("field", "type") & cell("FIELD") & place)
        | (rule("parent") & cell("FIELD") & (F.col("part") == F.col("c_part")) & (F.col("field") == F.col("parent"))) | (rule("value") & cell("VALUE") & place & F.array_contains("lost", F.col("detail")))
        | (rule("body") & cell("REQUEST_BODY")) | (rule("status") & cell("STATUS") & ((F.col("wanted") == code) | F.coalesce(F.col("wanted") == answer, F.lit(False))))
    )
    takes = (rule("call without field", "parent") & cell("FIELD") & place) | (rule("call without body") & cell("REQUEST_BODY"))
    taken = F.array_contains("to", F.col("detail")) | ((F.col("detail") == "integer") & F.array_contains("to", F.lit("number")))
    refused = rule("type") & cell("TYPE") & place & ~taken
    yes = lambda c: F.coalesce(c, F.lit(False))
    x = x.withColumns({"adds": yes(adds), "takes": yes(takes), "refused": yes(refused)}).where("adds OR takes OR refused")
    x = shared.stored(x.select(*[F.col(c).alias(f"_{c}") for c in SHAPE], "id", "rule", "evidence", "adds", "takes", "refused"), "matched")
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SHAPE])
    x = counted.join(F.broadcast(x), same)
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("count"))), F.lit(0))
    added = lambda c: F.when(F.col("adds"), F.col(c))
    one = x.groupBy("id", "client", "rule", "evidence").agg(total("adds").alias("adds"), total("takes").alias("takes"), total("refused").alias("refused"), F.min(added("first_ts")).alias("first_ts"), F.max(added("last_ts")).alias("last_ts"))
    requests = F.when(F.col("rule") == "type", F.least("adds", "refused")).otherwise(F.col("adds") - F.col("takes"))
    return one.select("id", "client", requests.alias("requests"), "first_ts", "last_ts", "evidence").where("requests > 0")


def expected_evidence():
    observable = F.col("part").isin("request.query", "request.body")
    potential = F.col("kind").startswith("response") | (F.col("kind") == "media_type_removed") | (F.col("kind").startswith("request_field") & ~observable) | ((F.col("kind") == "request_type_changed") & (F.col("part") != "request.body"))
    return F.when(potential, "POTENTIAL").otherwise("OBSERVED")


def impact(cells: DataFrame, changes: DataFrame, responses: DataFrame, config: Config | None = None, h: DataFrame | None = None) -> DataFrame:
    """One row for each breaking change with exposure, severity and ranks; h: hits() of the same where they are stored."""
    config = config or Config()
    h = hits(cells, changes, responses) if h is None else h
    last = shared.stored(fold(cells, "EVENT", "client"), "last_seen")  # read for the end, for who is active and for both sides of the report
    end = last.agg(F.max("last_ts").alias("end"))
    recent = F.col("last_ts") >= F.col("end") - F.make_dt_interval(secs=F.lit(float(round(config.recent_days * 86400))))
    one = last.crossJoin(F.broadcast(end)).agg(F.max("end").alias("end"), F.count_if(recent & (F.col("client") != "")).alias("active"))  # one row
    h = h.crossJoin(F.broadcast(one.select("end")))
    since = lambda days: F.col("last_ts") >= F.col("end") - F.make_dt_interval(secs=F.lit(float(round(days * 86400))))
    known = F.col("client") != ""
    e = h.groupBy("id").agg(
        F.sum("requests").alias("requests"), F.count_if(known).alias("clients"), F.count_if(known & since(config.recent_days)).alias("recent"), F.count_if(known & since(config.stale_days)).alias("stale"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("evidence").alias("evidence"),
        F.coalesce(F.bool_or(F.col("client").isin(list(config.critical_clients)) & since(config.stale_days)), F.lit(False)).alias("critical"),
    )
    rows = changes.where("breaking").join(e, "id", "left").crossJoin(F.broadcast(one.select("active")))
    zero = ["requests", "clients", "recent", "stale"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {"critical": F.coalesce("critical", F.lit(False)), "evidence": F.coalesce("evidence", expected_evidence())})
    rows = rows.withColumn("severity", C.severity(F.col("clients"), F.col("recent"), F.col("stale"), F.col("active"), F.col("critical"), config) if config.identity else F.lit("UNRATED"))
    rows = rows.withColumn("share_recent", F.when(F.col("active") > 0, F.col("recent") / F.col("active")))
    touched = changes.withColumn("leaf", F.coalesce(C.leaf(F.col("field")), F.lit(""))).groupBy("source", "kind", "leaf", "direction").agg(F.countDistinct("operation").alias("operations_touched"))
    rows = rows.withColumn("leaf", F.coalesce(C.leaf(F.col("field")), F.lit(""))).join(F.broadcast(touched), ["source", "kind", "leaf", "direction"], "left")
    level = F.array_position(F.array(*[F.lit(s) for s in C.SEVERITIES]), F.col("severity"))
    # A report has as many rows as a specification pair has changes.
    order = Window.orderBy(F.when(F.col("evidence") == "OBSERVED", 0).otherwise(1), level, F.desc("recent"), F.desc_nulls_last("last_ts"), F.desc("requests"), "id")
    plain = Window.orderBy(F.desc("operations_touched"), "id")
    return rows.withColumns({"rank": F.row_number().over(order), "rank_spec_only": F.row_number().over(plain)})


def top_clients(h: DataFrame, most: int = 10) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("requests"), "client")
    return h.where("client <> ''").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def by_severity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("evidence", "severity").agg(F.count("*").alias("changes"))


def gate(rows: DataFrame, events: int, max_share: float | None = None, fail_on: str | None = None, potential: bool = False, identity: bool = True) -> DataFrame:
    """The rows that make a check fail."""
    if not events:
        return rows.where("breaking")
    seen = rows if potential else rows.where("evidence = 'OBSERVED'")
    if not identity:
        return seen.where("requests > 0")
    level = F.array_position(F.array(*[F.lit(s) for s in C.SEVERITIES]), F.col("severity"))
    fails = F.lit(False)
    if max_share is not None:
        fails = fails | ((F.col("recent") > 0) & (100 * F.coalesce("share_recent", F.lit(0.0)) >= max_share))
    if fail_on:
        fails = fails | (level <= C.SEVERITIES.index(fail_on) + 1)
    return seen.where(fails)
