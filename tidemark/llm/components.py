"""Connected components of links between long ids, by large-star and small-star rounds on tables."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in the links a-b and the least id that each reaches, by union-find over them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while True:  # hook the larger root to the smaller one, then jump
        x, y = parent[left], parent[right]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return ids, ids[parent]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _local(batches):
    import pyarrow as pa

    held_a, held_b, n = [], [], 0

    def out():
        ids, roots = forest(np.concatenate(held_a), np.concatenate(held_b))
        keep = ids != roots
        return ids[keep], roots[keep]

    for b in batches:
        held_a.append(b.column(0).to_numpy())
        held_b.append(b.column(1).to_numpy())
        n += b.num_rows
        if n > 1 << 20:
            x = out()
            held_a, held_b, n = [x[0]], [x[1]], len(x[0])
            if n > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in x], names=["u", "v"])
                held_a, held_b, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(y) for y in out()], names=["u", "v"])


def connected(links: DataFrame) -> DataFrame:
    """Rows (id, component) for all ids of links (a, b); component is the least id reachable.

    Each task first reduces its links to stars, so that few remain; the rounds
    then work on links that are written to the shared folder.  No id's links meet
    in one task: minima are combined before the exchange and the joins can be split.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    stars = common.stored(edges.mapInArrow(_local, "u long, v long").distinct(), "links")
    mark = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored minima leave both sides of the joins an exchange of their own, so that a hub's rows can be split.
        least = common.stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.stored(large.where("u <> v").distinct(), "large")
        down = common.stored(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        fresh = common.stored(small.mapInArrow(_local, "u long, v long").distinct(), "links")
        common.dropped(stars, least, large, down)
        stars = fresh
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.countDistinct("u").alias("d")).first()
        if now == mark or now["n"] == 0 or _flat(stars, now):
            break
        mark = now
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def _flat(stars: DataFrame, now) -> bool:
    """Whether each id has one link, and to an id that has none upwards."""
    return now["n"] == now["d"] and stars.join(stars.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
