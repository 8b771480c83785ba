"""Product codes of vectors by Hamerly's form of Lloyd's iteration, in integers.

A component x is the integer floor(4096 x).  Vectors are cut into 8 equal parts; the parts
at one place share a codebook of up to 16 entries, at first those of the smallest ids.
Each round assigns every part to its nearest entry, the lower index at ties, then
replaces an entry by the componentwise floor of its parts' mean; unused entries stay.

Beside its entry a part keeps two numbers from round to round: an upper bound of its
distance to that entry and a lower bound of its distance to the second nearest.  When
entries move, the upper bound grows by the own entry's way and the lower one shrinks by
the longest way of the others.  As long as the upper bound is strictly below the lower
one, or below half the way to the nearest other entry, the part stays where it is; else
its own distance is measured, and only if that does not settle it either, all entries
are.  Bounds are doubles rounded outwards; what decides, at ties too, is an integer.

A round is one pass over the stored state, which becomes the next state, and one
aggregation of sums and counts per place and entry, 128 rows a task.  Codebooks of 8
times 16 entries are all that passes the driver.

Left out are vectors that are null, hold null, NaN or infinite components, have no
components, a number of them that 8 does not divide, or another number than the first
kept row.  Rows are ordered by id, nulls last, then by components; repeated rows count as
often as they occur.  Components of 2^24 and more are handled as integers of any size.
An error beyond 64 bits is given as 2^63 - 1.  An empty table gives no rows.
"""

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Below this size of all components, squared distances of parts fit 64 bits and, as doubles, lose nothing that bounds do not cover.
SMALL, MOST = 1 << 24, (1 << 63) - 1
#: Rows of label sums that are broadcast; more are joined by shuffling, with each label dealt to SALT tasks.
FEW_LABELS, SALT = 50_000, 32
#: A lower bound of roots that doubles may not hold, and factors that outweigh rounding.
FAR = 2.0**500
_LOW, _HIGH = 1 - 2.0**-40, 1 + 2.0**-40


def integers(data: bytes, rows: int, scale: int = SCALE) -> np.ndarray:
    """Rows of floor(scale x): 64-bit integers, or Python's where components are large."""
    x = np.frombuffer(data).reshape(rows, -1)
    if not x.size or np.abs(x).max() < SMALL / scale:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.shape, object)
    for i, v in np.ndenumerate(x):
        top, bottom = float(v).as_integer_ratio()
        out[i] = top * scale // bottom
    return out


def books_of(first: np.ndarray) -> list[np.ndarray]:
    """The codebook of each place from rows of integers."""
    return [np.ascontiguousarray(b) for b in np.split(first, PARTS, axis=1)]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances row by row, exact; 64 bits suffice for small components and up to 2^12 of them."""
    if (x.dtype == object) != (y.dtype == object) or x.shape[1] > 1 << 12:
        x, y = x.astype(object), y.astype(object)
    d = x - y
    return (d * d).sum(1)


def _roots(d: np.ndarray, beyond: float = math.inf) -> np.ndarray:
    """Square roots as doubles; `beyond` for those of 2^500 and more."""
    if d.dtype != object:
        return np.sqrt(d.astype(float))
    return np.array([math.sqrt(v) if v < 1 << 1000 else beyond for v in d.tolist()], float)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all entries: index of the nearest, its squared distance, a lower bound of the second distance."""
    all_ = np.stack([squares(x, np.broadcast_to(e, x.shape)) for e in book], 1)
    at = np.zeros(len(x), np.int64)
    best = all_[:, 0].copy()
    second = np.full(len(x), math.inf)
    for k in range(1, len(book)):
        d = all_[:, k]
        less = (d < best).astype(bool)
        second = np.minimum(second, _roots(np.where(less, best, d), FAR))
        at[less], best[less] = k, d[less]
    return at, best, second * _LOW


def ways(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each entry: its own way, the longest of the others, half the way to the nearest other new entry; outwards."""
    k = len(new)
    own = _roots(squares(old, new)) * _HIGH
    others = np.array([max((own[j] for j in range(k) if j != i), default=0.0) for i in range(k)])
    half = np.array([min((float(_roots(squares(new[i : i + 1], new[j : j + 1]), FAR)[0]) for j in range(k) if j != i), default=math.inf) for i in range(k)]) / 2 * _LOW
    return own, others, half


def advance(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, way) -> int:
    """Assign the parts of one place anew, in the given arrays; how many took a scan of all entries."""
    own, others, half = way
    upper[:] = (upper + own[at]) * _HIGH
    lower[:] = np.maximum(lower - others[at], 0) * _LOW
    open_ = np.flatnonzero(~(upper < np.maximum(lower, half[at])))
    if not len(open_):
        return 0
    upper[open_] = _roots(squares(x[open_], book[at[open_]])) * _HIGH
    open_ = open_[~(upper[open_] < np.maximum(lower[open_], half[at[open_]]))]
    if len(open_):
        found, best, second = nearest(x[open_], book)
        at[open_], upper[open_], lower[open_] = found, _roots(best) * _HIGH, second
    return len(open_)


def _state(batch) -> tuple:
    n = batch.num_rows
    return n, *(np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, PARTS).copy() for c, t in (("at", np.uint8), ("upper", np.float64), ("lower", np.float64)))


def _groups(batch):
    """Rows of a batch with small components, and those with large ones."""
    import pyarrow.compute as pc

    for wide in (False, True):
        part = batch.filter(pc.equal(batch.column("wide"), wide))
        if part.num_rows:
            yield part


def _bytes(batch) -> bytes:
    return b"".join(batch.column("x").to_pylist())


def _assign(books: list[np.ndarray], way: list | None):
    """A round's pass: state in, state out; without ways all is measured."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in _groups(whole):
                x = books_of(integers(_bytes(b), b.num_rows))
                n, at, upper, lower = _state(b)
                for p in range(PARTS):
                    entry, up, low = at[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].copy()
                    if way is None:
                        entry, best, low = nearest(x[p], books[p])
                        up = _roots(best) * _HIGH
                    else:
                        advance(x[p], entry, up, low, books[p], way[p])
                    at[:, p], upper[:, p], lower[:, p] = entry, up, low
                made = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (at, upper, lower)]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "label", "x", "wide")] + made, names=_NAMES)

    return run


_NAMES = ["id", "label", "x", "wide", "at", "upper", "lower"]


def _sums(batches):
    """Per task, place and entry: number of parts and their sum, as decimal integers."""
    import pyarrow as pa

    held: dict[tuple[int, int], list] = {}
    for whole in batches:
        for b in _groups(whole):
            x = books_of(integers(_bytes(b), b.num_rows))
            at = np.frombuffer(b"".join(b.column("at").to_pylist()), np.uint8).reshape(b.num_rows, PARTS)
            for p in range(PARTS):
                for e in np.unique(at[:, p]).tolist():
                    own = x[p][at[:, p] == e]
                    had = held.setdefault((p, e), [0, [0] * own.shape[1]])
                    had[0] += len(own)
                    had[1] = [s + int(t) for s, t in zip(had[1], own.sum(0).tolist(), strict=True)]
    rows = [(p, e, n, d, str(s)) for (p, e), (n, sums) in held.items() for d, s in enumerate(sums)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["part", "entry", "n", "place", "sum"])


def _total(table):
    """Sums of one component of one entry, one from each task, added up."""
    import pyarrow as pa

    total, n = sum(int(s) for s in table.column("sum").to_pylist()), sum(table.column("n").to_pylist())
    return pa.table({"part": table.column("part")[:1], "entry": table.column("entry")[:1], "place": table.column("place")[:1], "mean": pa.array([str(total // n)])})


def updated(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries moved to the floors of their parts' means."""
    means = state.select("x", "wide", "at").mapInArrow(_sums, "part int, entry int, n long, place int, sum string")
    means = means.groupBy("part", "entry", "place").applyInArrow(_total, "part int, entry int, place int, mean string").collect()  # as many rows as codebooks have integers
    new = [b.astype(object) for b in books]
    for r in means:
        new[r["part"]][r["entry"], r["place"]] = int(r["mean"])
    return [_narrow(b) for b in new]


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(v) < SMALL for v in book.ravel().tolist()) else book


def _codes(books: list[np.ndarray]):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in _groups(whole):
                x = books_of(integers(_bytes(b), b.num_rows))
                at = np.frombuffer(b"".join(b.column("at").to_pylist()), np.uint8).reshape(b.num_rows, PARTS)
                error = sum(squares(x[p], books[p][at[:, p]]).astype(object) for p in range(PARTS))
                made = [pa.array([r.tobytes().hex() for r in at]), pa.array([min(int(e), MOST) for e in error.tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), *made], names=["id", "label", "code", "error"])

    return run


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def kept_rows(df: DataFrame, vector: str, key: str, label: str | None) -> DataFrame:
    """id, label and v, the components as doubles, of vectors that have parts of finite numbers."""
    rows = df.select(F.col(key).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % PARTS == 0) & finite)


def _started(dims: int):
    """Rows of kept_rows as a state in which nothing is known yet."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            wide = ~(np.abs(x).max(1) < SMALL / SCALE)
            blank = [pa.array([z] * len(x), pa.binary()) for z in (bytes(PARTS), bytes(8 * PARTS), bytes(8 * PARTS))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(wide), *blank], names=_NAMES)

    return run


def product_codes(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str | None = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: key, code, error, label_error, codebooks_sha256."""
    spark = df.sparkSession
    common.ship(spark)
    rows = kept_rows(df, vector, key, label)
    order = [F.col("id").asc_nulls_last(), "v"]
    first = rows.orderBy(*order).limit(1).collect()
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}"
    if not first:
        empty = spark.createDataFrame([], f"{kinds}, code string, error long, label_error long, codebooks_sha256 string")
        return empty.select(F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256")
    dims = len(first[0]["v"])
    rows = rows.where(F.size("v") == dims)
    first = rows.orderBy(*order).limit(ENTRIES).select("v").collect()
    books = [_narrow(b) for b in books_of(integers(np.array([r["v"] for r in first]).tobytes(), len(first)).astype(object))]
    schema = f"{kinds}, x binary, wide boolean, at binary, upper binary, lower binary"
    state = common.stored(rows.mapInArrow(_started(dims), schema).mapInArrow(_assign(books, None), schema), "codes")
    for _ in range(rounds):
        moved = updated(state, books)
        way = [ways(old, new) for old, new in zip(books, moved, strict=True)]
        before, books = state, moved
        state = common.stored(before.mapInArrow(_assign(books, way), schema), "codes")
        common.dropped(before)
    out = common.stored(state.mapInArrow(_codes(books), f"{kinds}, code string, error long"), "errors")
    common.dropped(state)
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST).cast("decimal(30,0)")).cast("long")
    labels = common.stored(out.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label_errors")
    same = F.col("label").eqNullSafe(F.col("of"))
    if labels.count() <= FEW_LABELS:
        joined = out.join(F.broadcast(labels), same)
    else:
        salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALT)).cast("int")
        spread = labels.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = out.withColumn("salt", salt).join(spread, same & (F.col("salt") == F.col("dealt")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
