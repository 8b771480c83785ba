"""Statistics of the evaluation: rank correlation, quantiles, agreement, confusion, line differences."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

#: Distinct pairs of values that one task counts, and the most ranges of a score: beyond their product ranges grow.
RANGE_ROWS, MOST_RANGES = 100_000, 512


def inverted(x, y, w) -> int:
    """Weight of pairs with smaller x and larger y, strictly: for each bit of the ranks of x, rows that first differ there."""
    import numpy as np

    x, y = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    total = 0
    for bit in range(int(x.max(initial=0)).bit_length()):
        high, one = x >> (bit + 1), (x >> bit) & 1
        order = np.lexsort((one, y, high))  # at equal y the smaller side first: it counts as not larger
        zeros = np.cumsum(np.where(one[order] == 0, w[order], 0))
        ends = np.flatnonzero(np.diff(high[order], append=-1))
        larger = zeros[ends][np.searchsorted(ends, np.arange(len(order)))] - zeros
        total += int((larger * np.where(one[order] == 1, w[order], 0)).sum())
    return total


def _inverted(first: str, second: str):
    def run(table):
        import pyarrow as pa

        x, y, w = (table.column(c).to_numpy() for c in (first, second, "w"))
        return pa.table({"by": table.column("by")[:1], "n": pa.array([str(inverted(x, y, w))])})

    return run


def _ranges(rows: DataFrame, x: str, parts: int) -> DataFrame:
    """rows with the range of x that each value lies in: even numbers between cuts, odd ones for values that are cuts themselves.

    Values that many rows share are cuts, so that their ranges hold no two values and are not counted within.
    """
    cuts = rows.groupBy("by").agg(F.array_sort(F.array_distinct(F.percentile_approx(x, [k / parts for k in range(1, parts)] or [0.5], 10 * parts))).alias("cuts"))
    at = F.size(F.filter("cuts", lambda c: c < F.col(x)))
    return rows.join(F.broadcast(cuts), "by").withColumn(f"{x}_range", (2 * at + F.array_contains("cuts", F.col(x)).cast("int"))).drop("cuts")


def kendall_tau(df: DataFrame, key: str, x: str, y: str, by: str | None = None) -> DataFrame:
    """tau-b of two scores, for each value of `by`, by counting inversions in ranges: no pairs are formed.

    Equal pairs of values are counted together first.  Inversions between ranges of both scores come from the table of ranges,
    those within a range of either from its own rows, of which there are about RANGE_ROWS.
    Rows without a score are left out.  `key` names the rows and decides nothing.
    """
    shared.ship(df.sparkSession)
    rows = df.select((F.col(by) if by else F.lit(0)).alias("by"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    rows = shared.stored(rows.groupBy("by", "x", "y").agg(F.count("*").alias("w")), "scores")
    parts = min(MOST_RANGES, max(1, rows.count() // RANGE_ROWS))
    rows = shared.stored(_ranges(_ranges(rows, "x", parts), "y", parts), "ranges")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    ties = lambda name, *c: rows.groupBy("by", *c).agg(F.sum("w").alias("w")).groupBy("by").agg(F.sum(big("w") * (F.col("w") - 1)).alias(name))
    kind = f"by {rows.schema['by'].dataType.simpleString()}, n string"
    table = rows.groupBy("by", "x_range", "y_range").agg(F.sum("w").alias("w"))  # as many rows as ranges squared
    inner = lambda c, first, second: rows.where(F.col(c) % 2 == 0).groupBy("by", c).applyInArrow(_inverted(first, second), kind)
    found = table.groupBy("by").applyInArrow(_inverted("x_range", "y_range"), kind).unionByName(inner("x_range", "x", "y")).unionByName(inner("y_range", "x_range", "y"))
    found = found.groupBy("by").agg(F.sum(big("n")).alias("d"))
    out = ties("all").join(ties("tx", "x"), "by").join(ties("ty", "y"), "by").join(ties("txy", "x", "y"), "by").join(found, "by", "left")
    d = F.coalesce(F.col("d"), F.lit(0).cast("decimal(38,0)"))
    agree = ((F.col("all") - F.col("tx") - F.col("ty") + F.col("txy")) / 2 - 2 * d).cast("double")
    nx, ny = ((F.col("all") - F.col(c)).cast("double") / 2 for c in ("tx", "ty"))
    tau = F.when((nx > 0) & (ny > 0), agree / F.sqrt(nx * ny)).alias("tau")
    return out.select(*([F.col("by").alias(by)] if by else []), tau)


def summary(df: DataFrame, by: list[str], x: str) -> DataFrame:
    v = F.when(~F.isnan(x), F.col(x))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), *[F.percentile(v, F.lit(q)).alias(n) for n, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))], F.count(v).alias("n"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    j = a.select(*keys, F.lit(1).alias("a")).distinct().join(b.select(*keys, F.lit(1).alias("b")).distinct(), keys, "full_outer")
    both, only_a, only_b = (F.count_if(c) for c in (F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("b").isNull(), F.col("a").isNull()))
    return j.agg(both.alias("both"), only_a.alias("only_a"), only_b.alias("only_b")).select("*", (F.col("both") / (F.col("both") + F.col("only_a"))).alias("precision"), (F.col("both") / (F.col("both") + F.col("only_b"))).alias("recall"), (F.col("both") / (F.col("both") + F.col("only_a") + F.col("only_b"))).alias("jaccard"))


def agreement_classes(a: DataFrame, b: DataFrame, keys: list[str], by: str, most: int = 5) -> DataFrame:
    """For each value of `by`, one of the keys: how many keys both sides hold, or only one, with the first few of them as examples."""
    both = a.select(*keys, F.lit(1).alias("a")).distinct().join(b.select(*keys, F.lit(1).alias("b")).distinct(), keys, "full_outer")
    rows = both.withColumn("verdict", F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both"))
    others = [k for k in keys if k != by]
    # Tasks leave their own first few before rows move.
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(by, "verdict").orderBy(*others))).where(F.col("place") <= most)
    examples = first.groupBy(by, "verdict").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(" ", *others).alias("x")))), lambda e: e["x"]).alias("examples"))
    return rows.groupBy(by, "verdict").agg(F.count("*").alias("n")).join(examples, [by, "verdict"])


def confusion(df: DataFrame, truth, said) -> DataFrame:
    c = df.agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))
    return c.select("*", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"))


def removed_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of a that b lacks, as a multiset."""
    return a.exceptAll(b)


def learning_curve(df: DataFrame, p: str, ns: list[int]) -> DataFrame:
    n = F.explode(F.array(*[F.lit(x) for x in ns])).alias("n")
    return df.select("*", n).withColumn("predicted", 1 - F.pow(1 - F.col(p), F.col("n")))
