from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import cells, impact
from tidemark.plans import bridge, queries
from tidemark.sources import openapi, traffic

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_paths(spark):
    assert one(spark, C.parent_path(F.col("p")), p="$.a.b[].c") == "$.a.b[]"
    assert one(spark, C.parent_path(F.col("p")), p="$") is None
    assert one(spark, C.leaf(F.col("p")), p="$['odd name']") == "odd name"
    assert one(spark, C.child_path(F.lit("$"), F.col("p")), p="odd name") == "$['odd name']"


def test_yaml_scalars():
    assert openapi.load("a: yes\nb: 2020-01-01\nc: true\nd: 1\ne: 1.5\nf: null\n") == {"a": "yes", "b": "2020-01-01", "c": True, "d": 1, "e": 1.5, "f": None}


def test_cyclic_all_of():
    s = openapi.Spec({"openapi": "3.0.0", "paths": {}, "components": {"schemas": {"A": {"allOf": [{"$ref": "#/components/schemas/A"}, {"type": "object", "properties": {"x": {}}}]}}}})
    assert list(s.view({"$ref": "#/components/schemas/A"}).properties) == ["x"]


def test_severity_needs_recent(spark):
    level = lambda affected, recent, stale, active, critical=False: one(spark, C.severity(*map(F.col, "arsn"), F.col("c"), impact.Config()), a=affected, r=recent, s=stale, n=active, c=critical)
    assert [level(0, 0, 0, 9), level(1, 0, 0, 0), level(1, 0, 1, 9), level(2, 1, 1, 50), level(2, 1, 1, 10), level(2, 1, 1, 2), level(1, 0, 1, 9, True)] == ["NONE_OBSERVED", "DORMANT", "LOW", "MEDIUM", "HIGH", "CRITICAL", "HIGH"]


def test_plans(spark):
    plan = bridge.fresh_cube(spark, SF)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Python" not in physical and "PushedFilters" in physical
    assert impact.CHANGE and {"cells_build", "impact_ranked"} <= set(queries.QUERIES)
