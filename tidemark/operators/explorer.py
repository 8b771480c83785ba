"""The explorer of a specification and the bundle of a report's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.openapi import Spec
from .report import by_construct, unsupported


def summary(spark: SparkSession, spec: Spec) -> DataFrame:
    """One row: title, version, numbers of operations and declared fields, unsupported constructs by kind."""
    info = spec.doc.get("info") or {}
    ops, declared = spec.operations(), spec.declared()
    constructs = by_construct(unsupported(spark, spec)).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("construct", "n")))).alias("unsupported"))
    head = spark.createDataFrame([(str(info.get("title", "")), str(info.get("version", "")), str(spec.doc["openapi"]), len(ops), len(declared))], "title string, version string, openapi string, operations int, fields int")
    return head.crossJoin(constructs)  # one row each


def operation_details(declared: DataFrame, operations: DataFrame, responses: DataFrame, by: tuple = ("operation",)) -> DataFrame:
    """Of each operation its answers and its declared fields by part and status, in order of paths; `by` may name the document as well."""
    fields = declared.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("part", "status", "field", "types", "required", "enum", "open"))).alias("fields"))
    answers = responses.groupBy(*by).agg(F.sort_array(F.collect_set("answer")).alias("answers"))
    return operations.join(shared.apart(answers), [*by], "left").join(shared.apart(fields), [*by], "left")


def write_bundle(path: str, **tables: DataFrame) -> None:
    """Each table as JSON lines in a folder of its name below path."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")
