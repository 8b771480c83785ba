"""The additive cube: one explosion and one aggregation over resolved events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .routes import unmatched_label

KEYS = ["kind", "operation", "part", "status", "field", "detail", "client", "day"]
_CELL = "array<struct<kind:string,operation:string,part:string,status:int,field:string,detail:string,client:string>>"


def _key(kind: str, operation="", part="", status=0, field="", detail="", client="") -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("kind"), as_col(operation).alias("operation"), as_col(part).alias("part"), as_col(status).cast("int").alias("status"), as_col(field).alias("field"), as_col(detail).alias("detail"), as_col(client).alias("client"))


def _fields(column: str, part: str, status, client) -> Column:
    op = F.col("op_key")

    def one(f):
        values = F.coalesce(f["values"], F.array().cast("array<string>"))
        found = [F.array(_key("FIELD", op, part, status, f["path"], "", client)), F.transform(f["types"], lambda t: _key("TYPE", op, part, status, f["path"], t, client)), F.when(f["values"].isNotNull(), F.array(_key("CAPTURED", op, part, status, f["path"]))).otherwise(F.array().cast(_CELL))]
        if part != "response.body":
            found.append(F.transform(values, lambda v: _key("VALUE", op, part, status, f["path"], v, client)))
        return F.concat(*found)

    return F.coalesce(F.flatten(F.transform(column, one)), F.array().cast(_CELL))


def build_cells(events: DataFrame) -> DataFrame:
    """events with op_key (see routes.resolve) to cells (8 keys, count, first_ts, last_ts).

    Counting is combined before the only exchange, which is on all keys, so that a
    busy client or operation is no hot partition.
    """
    client, op = F.coalesce("client", F.lit("")), F.col("op_key")
    empty = F.array().cast(_CELL)
    matched = F.concat(
        F.array(_key("CALL", op, client=client), _key("STATUS", op, status=F.col("status"), client=client)),
        F.when(F.col("latency_ms").isNotNull(), F.array(_key("LATENCY", op, detail=C.latency_bucket(F.col("latency_ms")).cast("string")))).otherwise(empty),
        _fields("query", "request.query", 0, client),
        F.when(F.col("request_body").isNotNull(), F.array(_key("REQUEST_BODY", op, client=client))).otherwise(empty),
        _fields("request_body", "request.body", 0, client),
        F.when(F.col("response_body").isNotNull(), F.array(_key("RESPONSE_BODY", op, status=F.col("status")))).otherwise(empty),
        _fields("response_body", "response.body", F.col("status"), ""),
    )
    keys = F.concat(F.array(_key("EVENT", client=client)), F.when(op.isNotNull(), matched).otherwise(F.array(_key("UNMATCHED", field=unmatched_label()))))
    rows = events.select("ts", F.to_date("ts").alias("day"), F.explode(keys).alias("x")).select("x.*", "day", "ts")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merge_cells(*parts: DataFrame) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*KEYS).agg(F.sum("count").alias("count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def fold(cells: DataFrame, kind: str, *by: str) -> DataFrame:
    """Sums of one kind by some of its keys."""
    return cells.where(F.col("kind") == kind).groupBy(*by).agg(F.sum("count").alias("count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def fingerprint(cells: DataFrame) -> DataFrame:
    """One row that does not depend on order: number of cells, their counts, and an xor of row hashes."""
    row = F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS], F.col("count").cast("string"), F.unix_micros(F.col("first_ts").cast("timestamp")).cast("string"), F.unix_micros(F.col("last_ts").cast("timestamp")).cast("string"))
    return cells.agg(F.count("*").alias("cells"), F.sum("count").alias("total"), F.bit_xor(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")).alias("mark"))
