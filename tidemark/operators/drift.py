"""Drift: what traffic shows and the specification does not say, and the reverse."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .cells import fold
from .views import field_presence, field_types, status_answers

#: declared: operation, part, status (as declared for responses, "0" for requests), field, types, open; values of maps as a field `.*`
KEYS = ["operation", "part", "status", "field"]


def _walk(tokens: Column) -> Column:
    """The declared path that tokens lead to in `known`; null where the specification says nothing."""
    child = lambda at, t: F.concat(at, t)
    value = lambda at: F.concat(at, F.lit(".*"))
    has = lambda path: F.coalesce(F.map_contains_key("known", path), F.lit(False))
    step = lambda at, t: F.when(at.isNull(), F.lit(None).cast("string")).when(has(child(at, t)), child(at, t)).when((t != "[]") & has(value(at)), value(at))
    return F.aggregate(tokens, F.when(has(F.lit("$")), F.lit("$")), step)


def placed(seen: DataFrame, cells: DataFrame, declared: DataFrame, responses: DataFrame) -> DataFrame:
    """seen (operation, part, status, field, ...) with answer, `known` fields of its schema, the declared path `at` and that of its parent `up`."""
    answers = status_answers(cells, responses).withColumnRenamed("code", "status")
    rows = seen.join(F.broadcast(answers), ["operation", "status"], "left")
    rows = rows.withColumn("answer", F.when(F.col("part") == "response.body", F.col("answer")).otherwise("0"))
    known = F.map_from_entries(F.collect_list(F.struct("field", F.struct("types", "open"))))
    schemas = declared.groupBy("operation", "part", F.col("status").alias("answer")).agg(known.alias("known"))  # as small as the specification
    rows = rows.join(F.broadcast(schemas), ["operation", "part", "answer"], "left").withColumn("tokens", C.path_tokens(F.col("field")))
    up = F.when(F.size("tokens") > 0, _walk(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0)))))
    return rows.withColumns({"at": _walk(F.col("tokens")), "up": up, "status": F.col("status").cast("string")})


def undocumented_fields(cells: DataFrame, declared: DataFrame, responses: DataFrame) -> DataFrame:
    """Observed query parameters and fields that are not declared.

    A field counts if its parent is declared, has properties and is no open map; below what
    is free-form or undocumented nothing is said.  A body without any schema is one row, its root.
    """
    rows = placed(field_presence(cells), cells, declared, responses)
    query = (F.col("part") == "request.query") & (F.size("tokens") == 1) & ~F.coalesce(F.map_contains_key("known", F.col("field")), F.lit(False))
    parent = F.element_at("known", F.col("up"))
    inner = (F.col("part") != "request.query") & F.col("at").isNull() & F.col("up").isNotNull() & (F.try_element_at("tokens", F.lit(-1)) != "[]") & ~parent["open"]
    root = (F.col("part") != "request.query") & (F.col("field") == "$") & F.col("known").isNull() & F.col("answer").isNotNull()
    return rows.where(query | F.coalesce(inner, F.lit(False)) | root).select(*KEYS, "count", "of", "presence")


def type_mismatches(cells: DataFrame, declared: DataFrame, responses: DataFrame) -> DataFrame:
    """Types of body fields that their declared types don't take, where these say anything but null."""
    rows = placed(field_types(cells).where("part <> 'request.query'"), cells, declared, responses).where("at IS NOT NULL")
    types = F.element_at("known", F.col("at"))["types"]
    accepts = F.array_contains(types, F.col("type")) | ((F.col("type") == "integer") & F.array_contains(types, F.lit("number")))
    wrong = rows.where((F.size(F.array_remove(types, "null")) > 0) & ~accepts)
    return wrong.groupBy(*KEYS).agg(F.sum("count").alias("count"), F.array_join(F.sort_array(F.collect_set("type")), "|").alias("observed"))


def unused_fields(cells: DataFrame, declared: DataFrame, responses: DataFrame, least: int = 300) -> DataFrame:
    """Declared query parameters and children of objects, seen that often without them."""
    presence = field_presence(cells).select("operation", "part", F.col("status").cast("string").alias("status"), "field")
    return could_be_unused(cells, declared, responses, least).join(presence, KEYS, "left_anti").select(*KEYS, "of", C.unseen_bound(F.col("of")).alias("bound"))


def could_be_unused(cells: DataFrame, declared: DataFrame, responses: DataFrame, least: int = 300) -> DataFrame:
    """Declared query parameters and children of objects whose operation or object was seen that often, with them or without."""
    objects = placed(field_types(cells).where("type = 'object'"), cells, declared, responses).where((F.col("count") >= least) & F.col("at").isNotNull())
    objects = objects.select("operation", "part", "status", "answer", F.col("field").alias("parent"), "at", F.col("count").alias("of"))
    children = declared.select("operation", "part", F.col("status").alias("answer"), C.parent_path(F.col("field")).alias("at"), F.try_element_at(C.path_tokens(F.col("field")), F.lit(-1)).alias("name")).where("name <> '[]' AND name <> '.*'")
    inner = objects.join(F.broadcast(children), ["operation", "part", "answer", "at"]).select("operation", "part", "status", F.concat("parent", "name").alias("field"), "of")
    calls = fold(cells, "CALL", "operation").where(F.col("count") >= least).select("operation", F.col("count").alias("of"))
    query = calls.join(F.broadcast(declared.where("part = 'request.query'").select(*KEYS)), "operation").select(*KEYS, "of")
    return inner.unionByName(query)


def undocumented_statuses(cells: DataFrame, responses: DataFrame) -> DataFrame:
    seen = fold(cells, "STATUS", "operation", "status").select("operation", F.col("status").alias("code"), "count")
    level = F.when(F.col("code") >= 500, "info").otherwise("warning")
    return seen.join(F.broadcast(status_answers(cells, responses)), ["operation", "code"], "left_anti").select("operation", "code", "count", level.alias("level"))


def undocumented_operations(cells: DataFrame) -> DataFrame:
    return fold(cells, "UNMATCHED", "field").select(F.col("field").alias("operation"), "count")


def unused_operations(cells: DataFrame, operations: DataFrame) -> DataFrame:
    return F.broadcast(operations).join(fold(cells, "CALL", "operation"), "operation", "left_anti")
