"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group.

Centroids are fitted on a bounded sample (SAMPLE vectors); every vector is
assigned.  A vector belongs to every cell whose centroid is within a margin of the
best one, so that two near vectors share a cell.  The margin is MARGIN / sqrt(dimensions),
or what the sample asks for if that is more: PROBES of its vectors are paired with
vectors at exactly the threshold, in directions that the sample's differences take,
and with their near ones of the sample; SHARED of these pairs have to share a cell.
Cells are cut into blocks of BLOCK vectors and pairs of blocks are tasks' groups, so
that no cell is held whole.  A pair counts in the first cell that both share.

Equal vectors are one class, compared once; its size counts in the links of others.
Null vectors, zero ones and those with null, NaN or infinite components link with
nothing, and so do vectors of different lengths and those without an id.  Repeated ids are separate vectors
of one id.  Other columns are ignored.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

SAMPLE, PER_CELL, MOST_CELLS, BLOCK, MARGIN = 32_768, 200, 4096, 1024, 0.96
PROBES, SHARED = 4096, 0.9995


def _vectors(column):
    """Doubles of each row, None for those that link with nothing."""
    out = []
    for x in column.to_pylist():
        v = None if x is None or None in x else np.array(x, np.float64)
        out.append(v if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def classes(df: DataFrame, vector: str, key: str) -> DataFrame:
    """Add digest and unit (bytes of doubles, unit length) to (key); both null for vectors without links."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            digests, units = [], []
            for i, v in zip(b.column(0).to_pylist(), _vectors(b.column(1)), strict=True):
                if v is None or i is None:
                    digests.append(None)
                    units.append(None)
                else:
                    v = v + 0.0  # no negative zero
                    digests.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest())
                    v /= np.abs(v).max()
                    units.append((v / np.linalg.norm(v)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=["id", "digest", "unit"])

    return df.select(F.col(key).cast("long").alias("id"), vector).mapInArrow(run, "id long, digest binary, unit binary")


def fit(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids, from evenly spread starts."""
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (sample @ centroids.T).argmax(1)
        order = np.argsort(home, kind="stable")
        found, starts = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts)
        norm = np.linalg.norm(sums, axis=1)
        centroids[found[norm > 0]] = sums[norm > 0] / norm[norm > 0, None]
    return centroids


def needed(x: np.ndarray, y: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The least margin at which each pair of unit vectors (x, y) shares a cell."""
    out = np.empty(len(x))
    for at in range(0, len(x), 512):
        a, b = x[at : at + 512] @ centroids.T, y[at : at + 512] @ centroids.T
        out[at : at + 512] = np.maximum(a.max(1, keepdims=True) - a, b.max(1, keepdims=True) - b).min(1)
    return out


def margin_of(sample: np.ndarray, centroids: np.ndarray, threshold: float, least: float) -> float:
    """The margin at which SHARED of the sample's probe pairs share a cell, `least` or more."""
    if len(sample) < 2 or len(centroids) < 2:
        return least
    rng = np.random.default_rng(0)
    x = sample[rng.integers(len(sample), size=PROBES)]
    z = sample[rng.integers(len(sample), size=PROBES)] - sample[rng.integers(len(sample), size=PROBES)]
    z = z - (z * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(z, axis=1)
    x, z = x[norm > 1e-9], z[norm > 1e-9] / norm[norm > 1e-9, None]
    at = min(1.0, max(-1.0, threshold))
    found = [needed(x, at * x + np.sqrt(1 - at * at) * z, centroids)] if len(x) else []
    probes = rng.permutation(len(sample))[:1024]
    near = sample[probes] @ sample.T >= threshold
    near[np.arange(len(probes)), probes] = False
    i, j = np.nonzero(near)
    if len(i):
        pick = rng.permutation(len(i))[:PROBES]
        found.append(needed(sample[probes[i[pick]]], sample[j[pick]], centroids))
    return max([least, *(float(np.quantile(x, SHARED, method="higher")) for x in found)])


def _cells(centroids: dict, margins: dict):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, counts = b.column("id").to_numpy(), b.column("n").to_numpy()
            units = b.column("unit").to_pylist()
            by = {}
            for i, u in enumerate(units):
                by.setdefault(len(u) >> 3, []).append(i)
            for dims, rows in by.items():
                c = centroids.get(dims)
                x = np.frombuffer(b"".join(units[i] for i in rows)).reshape(len(rows), dims)
                if c is None:
                    inside = np.ones((len(rows), 1), bool)
                else:
                    near = x @ c.T
                    inside = near >= near.max(1, keepdims=True) - margins[dims] - 1e-9
                row, cell = np.nonzero(inside)
                lists = np.split(cell, np.cumsum(inside.sum(1))[:-1])
                at = np.array(rows)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dims * (1 << 32) + cell), pa.array(ids[at]), pa.array(counts[at]), pa.array([lists[r].astype(np.int32).tobytes() for r in row.tolist()], pa.binary()), pa.array([units[i] for i in at.tolist()], pa.binary())],
                    names=["cell", "id", "n", "cells", "unit"],
                )

    return run


def _block_pair(threshold: float):
    def run(table):
        import pyarrow as pa

        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        cell = table.column("cell")[0].as_py() & 0xFFFFFFFF
        block = table.column("block").to_numpy()
        ids, counts = table.column("id").to_numpy(), table.column("n").to_numpy()
        units = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(ids), -1)
        cells = table.column("cells").to_pylist()
        a = np.flatnonzero(block == first)
        b = a if first == second else np.flatnonzero(block == second)
        left, right = [], []
        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            x, y = np.nonzero(units[part] @ units[b].T >= threshold)
            x, y = part[x], b[y]
            keep = x < y if first == second else np.ones(len(x), bool)
            left.append(x[keep])
            right.append(y[keep])
        left, right = (np.concatenate(v) if v else np.zeros(0, int) for v in (left, right))
        if len(left):
            sets = [np.frombuffer(c, np.int32) for c in cells]
            lowest = np.fromiter((np.intersect1d(sets[i], sets[j], True)[0] for i, j in zip(left.tolist(), right.tolist(), strict=True)), np.int64, len(left)) if any(len(s) > 1 for s in sets) else np.full(len(left), cell)
            keep = lowest == cell
            left, right = left[keep], right[keep]
        if not len(left):
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        links = np.bincount(left, counts[right], len(ids)) + np.bincount(right, counts[left], len(ids))
        found, roots = components.forest(ids[left], ids[right])
        at = np.flatnonzero(links)
        place = np.searchsorted(found, ids[at])
        return pa.table({"id": ids[at], "links": links[at].astype(np.int64), "root": roots[place]})

    return run


def embedding_near_dedup(df: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = 0.9, margin: float = MARGIN) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept."""
    spark = df.sparkSession
    common.ship(spark)
    rows = common.stored(classes(df, vector, key), "vectors")
    one = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    one = common.stored(one, "classes")
    total = one.count()
    picked = one.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))).select("id", "unit").limit(2 * SAMPLE)
    table = picked.toArrow().sort_by("id")
    by = {}
    for u in table.column("unit").to_pylist():
        by.setdefault(len(u) >> 3, []).append(u)
    k = max(1, min(MOST_CELLS, total // PER_CELL))
    samples = {dims: np.frombuffer(b"".join(us)).reshape(len(us), dims) for dims, us in by.items()}
    centroids = {dims: fit(x, max(1, min(k, len(x) // 8))) for dims, x in samples.items()}
    margins = {dims: margin_of(x, centroids[dims], threshold, margin / np.sqrt(dims)) for dims, x in samples.items()}
    members = one.mapInArrow(_cells(centroids, margins), "cell long, id long, n long, cells binary, unit binary")
    # At most MOST_CELLS sizes for each length of vectors.
    sizes = members.groupBy("cell").count().where(F.col("count") > BLOCK)
    members = members.join(F.broadcast(sizes), "cell", "left") if total > BLOCK else members.withColumn("count", F.lit(None).cast("long"))
    blocks = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    pairs = members.select("cell", "id", "n", "cells", "unit", "block", other).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o")
    found = pairs.groupBy("cell", "i", "j").applyInArrow(_block_pair(threshold), "id long, links long, root long")
    found = common.stored(found, "near")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components.connected(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classed = one.select("digest", "id", "n").join(links, "id", "left").join(groups, "id", "left")
    classed = classed.select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.select("id", "digest").where("digest IS NOT NULL").join(classed, "digest").select("id", "n_links", "component_id")
    lone = rows.where("digest IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(lone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
