"""Links within buckets of candidates, confirmed on whole texts: hubs first, then what they leave open.

A bucket is the ids that share a key.  Its least id is its hub.  Sketches say first which
ids of a bucket of up to BLOCK can be linked at all; the others leave it.  Then every id is
compared with the hubs of its buckets, if their sketches allow a link.  Buckets whose
ids then all belong to one component are done.  In the others, what the hub's
component does not hold is compared with everything of the bucket, in pairs of
blocks of BLOCK ids: sketches say which ids of a block pair can be linked at all,
and only the texts of these move.  So no bucket meets in one task, no text moves for a
bucket that is done, and no link that joins two parts of a bucket is lost.

A kit has
  prepare(texts as bytes): what is compared, one for each text,
  decide(pairs of these): mask of those that are linked,
  near(a's, b's or None, key): places (i, j) of pairs that can be linked, for decide(); pairs that another bucket shows can be left out,
  can(sketches a, sketches b, keys): which of these pairs can be linked, where the bucket
  `key` of each is to show them; key None: whichever shows them,
  possible(sketches a, sketches b, key): the same for all pairs of both.
"""

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

GROUP, BLOCK, PAIRS = 256, 256, 16384
CELL = ("key", "i", "j", "part", "component", "id")


def components_of(members: DataFrame, texts: DataFrame, sketches: DataFrame, kit, slices: int = 1) -> DataFrame:
    """Rows (id, component) of what is linked; members: (key, id, hub, n) of buckets of n, texts: (id, text), sketches: (id, sketch).

    Members get their sketches in so many slices of whole buckets, one after the other, as these rows are the most that is on disk at once.
    """
    found = []
    for s in range(slices):
        part = members.where(F.pmod(F.xxhash64("key"), slices) == s) if slices > 1 else members
        found.append(common.stored(near_members(part, sketches, kit), "near_members"))
        common.settled(members.sparkSession)
    return linked(functools.reduce(DataFrame.union, found), texts, sketches, kit)


def linked(members: DataFrame, texts: DataFrame, sketches: DataFrame, kit) -> DataFrame:
    """components_of, from what near_members leaves of the buckets; members are stored and go."""
    pairs = common.stored(members.where("to_hub").select("id", "hub").distinct(), "hub_pairs")
    first = hub_links(pairs, texts, kit)
    common.settled(members.sparkSession)
    joined = components.connected(first)
    common.dropped(pairs, first)
    cells = open_blocks(members, joined)
    common.dropped(members)
    if cells.isEmpty():
        common.dropped(cells)
        return joined
    needed = cells.join(sketches, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    needed = common.stored(needed.mapInArrow(common.tidy(_survivors(kit)), "key long, i int, j int, part int, component long, id long"), "survivors")
    common.dropped(cells)
    if needed.isEmpty():
        common.dropped(needed)
        return joined
    rest = needed.join(texts, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rest = common.stored(rest.mapInArrow(common.tidy(_block_links(kit)), "a long, b long"), "block_links")
    common.dropped(needed)
    if rest.isEmpty():
        common.dropped(rest)
        return joined
    links = joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(rest)
    groups = components.connected(links)
    common.dropped(links)
    return groups


def _with_hubs(pairs: DataFrame) -> DataFrame:
    """Rows (key, part, side, id, hub, n) of groups of about BLOCK pairs (key, hub, n, id), each headed by its hub as side 0."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    ends = pairs.select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(1).alias("side"), "id", "hub", "n")
    heads = pairs.select("key", "hub", "n", parts.alias("parts")).distinct()
    heads = heads.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("id"), "hub", "n")
    return ends.unionByName(heads)


def near_members(members: DataFrame, sketches: DataFrame, kit) -> DataFrame:
    """Rows (key, id, hub, n, to_hub) of the ids that can be linked with others of their buckets, or with their hubs."""
    rows = _with_hubs(members.where("id <> hub")).join(sketches, "id")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "side")

    def run(batches):
        import pyarrow as pa

        group, heads, ends = None, [], []
        rows, left, right, key_of = [], [], [], []  # members; sketches of pairs and what they decide: (row, other row or None for the hub)
        decides = []

        def close():
            """Note the pairs of a bucket: ids with its hub, and with each other where it is small."""
            if not heads or not ends:
                return
            key, part, hub, n = group
            start = len(rows)
            if part == 0:
                rows.append([key, hub, hub, n, False, n > BLOCK])
            for i, x in ends:
                rows.append([key, i, hub, n, False, n > BLOCK])
                for h in heads:
                    left.append(h)
                    right.append(x)
                    key_of.append(None)
                    decides.append((len(rows) - 1, start if part == 0 else None, True))
            if 1 < len(ends) and n <= BLOCK:
                first = len(rows) - len(ends)
                for u, v in zip(*(w.tolist() for w in np.triu_indices(len(ends), 1)), strict=True):
                    left.append(ends[u][1])
                    right.append(ends[v][1])
                    key_of.append(key)
                    decides.append((first + u, first + v, False))

        def out():
            for (u, v, to_hub), can in zip(decides, kit.can(left, right, key_of).tolist(), strict=True):
                if can:
                    rows[u][5] = True
                    rows[u][4] |= to_hub
                    if v is not None:
                        rows[v][5] = True
            kept = [r[:5] for r in rows if r[5]]
            for x in (rows, left, right, key_of, decides):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], t) for k, t in enumerate([*[pa.int64()] * 4, pa.bool_()])], names=["key", "id", "hub", "n", "to_hub"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "part", "hub", "n", "side", "id", "sketch")]
            for *g, side, i, x in zip(*cols, strict=True):
                if tuple(g) != group:
                    close()
                    group, heads, ends = tuple(g), [], []
                    if len(left) >= 4 * PAIRS:
                        yield out()
                if side:
                    ends.append((i, x))
                else:  # rows that repeat an id are heads side by side
                    heads.append(x)
        close()
        yield out()

    return rows.select("key", "part", "hub", "n", "side", "id", "sketch").mapInArrow(common.tidy(run), "key long, id long, hub long, n long, to_hub boolean")


def hub_links(pairs: DataFrame, texts: DataFrame, kit) -> DataFrame:
    """Stored rows (a, b): the pairs (id, hub) that are linked.  A hub's pairs are cut into parts, each with the hub's text."""
    sizes = common.stored(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hubs")
    rows = _with_hubs(pairs.join(sizes, "hub").withColumn("key", F.col("hub"))).drop("hub", "n").join(texts, "id")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "side")
    links = common.stored(rows.select("key", "part", "side", "id", "text").mapInArrow(common.tidy(_hubs(kit)), "a long, b long"), "hub_links")
    common.dropped(sizes)
    return links


def _hubs(kit):
    """Over rows sorted by hub, part and side: each id against the hub before it."""

    def run(batches):
        import pyarrow as pa

        group, hub, heads = None, None, []
        ends, pairs, held = [], [], 0

        def out():
            found = [e for e, k in zip(ends, kit.decide(pairs).tolist(), strict=True) if k]
            ends.clear()
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for whole in batches:
            for b in common.slices(whole, "text", 1 << 20):
                made = kit.prepare(b.column("text").cast(pa.binary()).to_pylist())
                held += b.column("text").nbytes
                cols = [b.column(c).to_pylist() for c in ("key", "part", "side", "id")]
                for key, part, side, i, x in zip(*cols, made, strict=True):
                    if (key, part) != group:
                        group, heads = (key, part), []
                    if side == 0:
                        hub = i
                        heads.append(x)
                    else:
                        ends += [(i, hub)] * len(heads)
                        pairs += [(x, head) for head in heads]
                if len(pairs) >= PAIRS or held >= 8 << 20:
                    held = 0
                    yield out()
        yield out()

    return run


def open_blocks(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Stored rows (key, i, j, part, component, id): pairs of blocks of the buckets that hubs leave open.

    part 0 is what the hub's component holds or, as j, the first of two blocks of the rest; part 1 the rest
    that is compared with it.  A block pair within the rest has i >= 0, one with the hub's component i < 0.
    """
    state = members.select("key", "id").join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    every = state = common.stored(state, "bucket_state")
    sizes = state.groupBy("key").agg(F.min_by("component", "id").alias("main"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    sizes = common.stored(sizes.where("low <> high AND n > 2").select("key", "main"), "open_buckets")
    opened = state = common.stored(state.join(sizes, "key").withColumn("rest", F.col("component") != F.col("main")).drop("main"), "open_state")
    common.dropped(every, sizes)
    cuts = state.groupBy("key").agg(F.ceil(F.count_if(~F.col("rest")) / BLOCK).cast("int").alias("many"), F.ceil(F.count_if("rest") / BLOCK).cast("int").alias("few"))
    cuts = common.stored(cuts, "open_cuts")
    state = state.join(cuts, "key")
    row = lambda i, j, part: [F.col("key"), i.cast("int").alias("i"), j.cast("int").alias("j"), part.cast("int").alias("part"), F.col("component"), F.col("id")]
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    among = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("o")
    rest, main = state.where("rest"), state.where("NOT rest")
    cells = main.select("*", among("few")).select(*row(-1 - block("many"), F.col("o"), F.lit(0)))
    cells = cells.union(rest.select("*", among("many")).select(*row(-1 - F.col("o"), block("few"), F.lit(1))))
    both = rest.withColumn("own", block("few")).select("*", among("few"))
    cells = cells.union(both.select(*row(F.least("own", "o"), F.greatest("own", "o"), F.when(F.col("own") <= F.col("o"), 0).otherwise(1))))
    cells = common.stored(cells, "open_blocks")
    common.dropped(opened, cuts)
    return cells


def _prepared(batches, kit):
    """Columns of batches, texts as the kit prepares them, many at once: blocks are small."""
    import pyarrow as pa

    for whole in batches:
        for b in common.slices(whole, "text", 1 << 20):
            yield [*(b.column(c).to_pylist() for c in CELL), kit.prepare(b.column("text").cast(pa.binary()).to_pylist())]


def _cells(columns):
    """(key, i, j, rows) of each block pair, from columns of rows sorted by these; rows: (part, component, id, value)."""
    cell, rows = None, []
    for cols in columns:
        for key, i, j, *row in zip(*cols, strict=True):
            if (key, i, j) != cell:
                if rows:
                    yield *cell, rows
                cell, rows = (key, i, j), []
            rows.append(row)
    if rows:
        yield *cell, rows


def _sides(i: int, j: int, rows):
    """Rows of both sides; None for the second where a block meets itself."""
    return ([r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]) if i != j else (rows, None)


def _survivors(kit):
    def run(batches):
        import pyarrow as pa

        out, held = [], 0
        names = ["key", "i", "j", "part", "component", "id"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for key, i, j, rows in _cells([b.column(c).to_pylist() for c in (*CELL, "sketch")] for b in batches):
            a, b = _sides(i, j, rows)
            c = a if b is None else b
            if not a or not c:
                continue
            can = kit.possible([r[3] for r in a], [r[3] for r in c], key)
            can &= np.array([r[1] for r in a])[:, None] != np.array([r[1] for r in c])[None]
            left, right = can.any(1), can.any(0)
            if b is None:
                left |= right
            kept = [r for r, k in zip(a, left.tolist(), strict=True) if k] + ([r for r, k in zip(b, right.tolist(), strict=True) if k] if b is not None else [])
            out += [(key, i, j, *r[:3]) for r in kept]
            if len(out) > 1 << 14:
                yield made()
                out = []
        if out:
            yield made()

    return run


def _block_links(kit):
    def run(batches):
        import pyarrow as pa

        ids, ends, pairs = [], [], []
        above: dict[int, int] = {}  # components that this task has linked so far

        def root(c):
            while c in above:
                c = above[c]
            return c

        def out():
            linked = kit.decide(pairs)
            found = np.array(ids, np.int64)[linked]
            for k in np.flatnonzero(linked).tolist():
                low, high = sorted(map(root, ends[k]))
                if low != high:
                    above[high] = low
            for c in list(above):
                above[c] = root(c)
            for x in (ids, ends, pairs):
                x.clear()
            x, roots = components.forest(found[:, 0], found[:, 1]) if len(found) else (np.zeros(0, np.int64),) * 2
            keep = x != roots
            return pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(roots[keep])], names=["a", "b"])

        for key, i, j, rows in _cells(_prepared(batches, kit)):
            a, b = _sides(i, j, rows)
            c = a if b is None else b
            if not a or not c:
                continue
            left, right = [r[3] for r in a], None if b is None else [r[3] for r in b]
            for x, y in zip(*(v.tolist() for v in kit.near(left, right, key)), strict=True):
                if root(a[x][1]) != root(c[y][1]):
                    ids.append((a[x][2], c[y][2]))
                    ends.append((a[x][1], c[y][1]))
                    pairs.append((left[x], (right or left)[y]))
                    if len(pairs) >= PAIRS:
                        yield out()
        if pairs:
            yield out()

    return run
