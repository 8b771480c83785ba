"""Scores of rankings and findings against the truth: comparators, rank correlation, top five, client sets and shares, severities, recall by strata, types, bounds."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .statistics import kendall_tau

#: Lower bounds of the strata of presence.
STRATA = [0.5, 0.1, 0.01, 0.0]


def comparators(rows: DataFrame) -> DataFrame:
    """(ranking, id, score) of impact rows by other orders than the report's: larger scores come first."""
    level = F.array_position(F.array(*[F.lit(s) for s in C.SEVERITIES]), F.col("severity"))
    scores = {"report": -F.col("rank"), "severity_first": -(level * 1_000_000 + F.col("rank")), "client_count": F.col("clients"), "volume_only": F.col("requests"), "spec_only": -F.col("rank_spec_only")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("ranking"), s.cast("double").alias("score")) for n, s in scores.items()]))
    return rows.select("id", each.alias("x")).select("x.ranking", "id", "x.score")


def random_rankings(rows: DataFrame, shuffles: int, seed: int = 0) -> DataFrame:
    """(ranking, id, score) of so many random orders; a report has as many rows as a specification pair has changes."""
    n = F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("n")
    return rows.select("id", n).select(F.concat(F.lit("random "), F.col("n")).alias("ranking"), "id", (F.xxhash64("id", "n", F.lit(seed)) / F.lit(2.0**63)).alias("score"))


def rank_correlation(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Kendall's tau-b of each ranking with truth (id, truth)."""
    return kendall_tau(scores.join(truth, "id"), "id", "score", "truth", "ranking")


def top_five(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of each ranking's first five that are in the true five, ties at the fifth place counting; null where fewer than five are affected."""
    rows = scores.join(F.broadcast(truth), "id")
    by = Window.partitionBy("ranking")
    rows = rows.withColumns({"place": F.row_number().over(by.orderBy(F.desc("score"), "id")), "true_place": F.row_number().over(by.orderBy(F.desc("truth"), "id"))})
    rows = rows.withColumn("fifth", F.max(F.when(F.col("true_place") == 5, F.col("truth"))).over(by))
    hits = rows.groupBy("ranking").agg(F.max("fifth").alias("fifth"), F.count_if((F.col("place") <= 5) & (F.col("truth") >= F.col("fifth"))).alias("hits"))
    return hits.select("ranking", F.when(F.col("fifth") > 0, F.col("hits") / 5).alias("top5"))


def client_sets(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Precision and recall of the clients found for each key, both sides (key, client)."""
    both = found.select(key, "client", F.lit(1).alias("f")).distinct().join(truth.select(key, "client", F.lit(1).alias("t")).distinct(), [key, "client"], "full_outer")
    n = both.groupBy(key).agg(F.count("f").alias("found"), F.count("t").alias("true"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("both"))
    return n.select(key, "found", "true", "both", F.when(F.col("found") > 0, F.col("both") / F.col("found")).alias("precision"), F.when(F.col("true") > 0, F.col("both") / F.col("true")).alias("recall"))


def severity_matrix(said: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts of (truth, said) severities of rows with the same id."""
    return truth.select("id", F.col("severity").alias("truth")).join(said.select("id", F.col("severity").alias("said")), "id").groupBy("truth", "said").count()


def severity_agreement(matrix: DataFrame) -> DataFrame:
    """Share of the rows of a severity_matrix() that lie on its diagonal."""
    return matrix.agg(F.sum("count").alias("rows"), (F.sum(F.when(F.col("truth") == F.col("said"), F.col("count")).otherwise(0)) / F.sum("count")).alias("agreement"))


def share_error(found: DataFrame, seen: DataFrame, truth: DataFrame, population: DataFrame, key: str) -> DataFrame:
    """How far the share of clients found for a key is from the true share, over the keys of truth: rows, mean and 90th percentile.

    found and truth: (key, client); seen and population: clients that both sides know at all.  A key that is not found counts as found for none.
    """
    n = lambda df, name: df.groupBy(key).agg(F.count_distinct("client").alias(name))
    all_of = lambda df, name: F.broadcast(df.agg(F.count_distinct("client").alias(name)))
    rows = n(truth, "t").join(n(found, "f"), key, "left").crossJoin(all_of(seen, "s")).crossJoin(all_of(population, "p"))  # one row each
    share = lambda part, whole: F.when(F.col(whole) > 0, F.coalesce(part, F.lit(0)) / F.col(whole)).otherwise(0.0)
    error = rows.select(F.abs(share("f", "s") - share("t", "p")).alias("error"))
    return error.agg(F.count("*").alias("rows"), F.avg("error").alias("mean"), F.percentile("error", 0.9).alias("p90"))


def field_recall(sample: DataFrame, truth: DataFrame) -> DataFrame:
    """By stratum of true presence: fields, those that the sample shows, and how many 1 - (1 - p) ** n predicts.

    Both sides are field_presence rows; `of` of a sample is n.  Fields whose body the sample never shows count as missed.
    """
    keys = ["operation", "part", "status", "field"]
    bodies = sample.groupBy("operation", "part", "status").agg(F.max("of").alias("n"))
    rows = truth.select(*keys, F.col("presence").alias("p")).join(sample.select(*keys, F.lit(1).alias("seen")), keys, "left").join(F.broadcast(bodies), keys[:3], "left")
    stratum = F.coalesce(*[F.when(F.col("p") >= s, F.lit(s)) for s in STRATA])
    predicted = 1 - F.pow(1 - F.col("p"), F.coalesce("n", F.lit(0)))
    return rows.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("fields"), F.count("seen").alias("found"), F.sum(predicted).alias("predicted"))


def type_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Fields found and true, how many are both, and for how many of these both show the same set of types; (operation, part, status, field, type) rows."""
    keys = ["operation", "part", "status", "field"]
    sets = lambda df, name: df.groupBy(*keys).agg(F.sort_array(F.collect_set("type")).alias(name))
    both = sets(found, "f").join(sets(truth, "t"), keys, "full_outer")
    n = both.agg(F.count("f").alias("found"), F.count("t").alias("true"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("both"), F.count_if(F.col("f") == F.col("t")).alias("same_types"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return n.select("*", share("both", "found").alias("precision"), share("both", "true").alias("recall"), share("same_types", "both").alias("type_accuracy"))


def bound_calibration(could: DataFrame, said: DataFrame, truth: DataFrame) -> DataFrame:
    """How the bounds of fields that were called unused hold against how often these really come, given their parent.

    could: body fields that could be called unused (drift.could_be_unused); said: those that were, with their bound; truth: field_presence rows.
    wrong counts fields that come more often than their bound; its rate is of all `could` that come at all, and promised to be at most 0.05.
    """
    keys = ["operation", "part", "status", "field"]
    rate = truth.withColumn("status", F.col("status").cast("string")).select(*keys, F.col("presence").alias("own"))
    parent = rate.withColumnsRenamed({"field": "up", "own": "parent"})
    rows = could.where("part <> 'request.query'").select(*keys, C.parent_path(F.col("field")).alias("up")).join(said.select(*keys, "bound"), keys, "left")
    rows = rows.join(rate, keys, "left").join(parent, [*keys[:3], "up"], "left")
    rows = rows.withColumn("share", F.when(F.col("parent") > 0, F.least(F.lit(1.0), F.coalesce("own", F.lit(0.0)) / F.col("parent"))).otherwise(0.0))  # least() passes over nulls
    held, comes, told = F.col("share") <= F.col("bound"), F.col("share") > 0, F.col("bound").isNotNull()
    n = rows.agg(F.count_if(told).alias("statements"), F.count_if(held).alias("covered"), F.count_if(told & comes).alias("occurring"), F.count_if(held & comes).alias("covered_occurring"), F.count_if(comes).alias("eligible"))
    wrong = F.col("occurring") - F.col("covered_occurring")
    share = lambda a, b: F.when(F.col(b) > 0, a / F.col(b))
    return n.select("*", wrong.alias("wrong"), share(F.col("covered"), "statements").alias("coverage"), share(F.col("covered_occurring"), "occurring").alias("coverage_occurring"), share(wrong, "eligible").alias("wrong_rate"))


def drift_counts(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(true positives, false negatives, false positives) of findings by key."""
    both = found.select(*keys, F.lit(1).alias("f")).distinct().join(truth.select(*keys, F.lit(1).alias("t")).distinct(), keys, "full_outer")
    return both.agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("f").isNull()).alias("fn"), F.count_if(F.col("t").isNull()).alias("fp"))


def truth_of(events: DataFrame) -> DataFrame:
    """What each client sent to each operation: rows (client, operation, what, field, value, count) of calls, bodies, paths, types and values."""
    n = lambda what, field="", value="": F.struct(F.lit(what).alias("what"), (field if not isinstance(field, str) else F.lit(field)).alias("field"), (value if not isinstance(value, str) else F.lit(value)).alias("value"))
    none = F.array().cast("array<struct<what:string,field:string,value:string>>")
    sent = F.concat(F.col("query"), F.coalesce("request_body", F.array().cast(events.schema["query"].dataType.simpleString())))
    paths = F.transform(sent, lambda f: n("path", f["path"]))
    types = F.flatten(F.transform(sent, lambda f: F.transform(f["types"], lambda t: n("type", f["path"], t))))
    values = F.flatten(F.transform(sent, lambda f: F.transform(F.coalesce(f["values"], F.array().cast("array<string>")), lambda v: n("value", f["path"], v))))
    rows = F.concat(F.array(n("call")), F.when(F.col("request_body").isNotNull(), F.array(n("body"))).otherwise(none), paths, types, values)
    out = events.where("op_key IS NOT NULL AND client IS NOT NULL").select("client", F.col("op_key").alias("operation"), F.explode(rows).alias("x"))
    return out.groupBy("client", "operation", "x.what", "x.field", "x.value").agg(F.count("*").alias("count"))
