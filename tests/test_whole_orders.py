
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.plans import queries

SF = "/root/testdata/sf0.001"


def test_shapes_of_all_orders(spark):
    discounts = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", F.col("l_discount").cast("double").alias("x")).collect():
        discounts[r["l_orderkey"]].add("integer" if r["x"] == int(r["x"]) else "number")
    want = set()
    for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect():
        k = r["o_orderkey"]
        want |= {(k, "$", "object"), (k, "$.key", "integer"), (k, "$.lines", "array")}
        if k in discounts:
            want |= {(k, "$.lines[]", "object"), (k, "$.lines[].flag", "string"), (k, "$.lines[].discount", "|".join(sorted(discounts[k])))}
    got = queries.shape_extract(spark, SF).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
