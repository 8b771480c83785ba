"""Repeated byte strings by a difference-cover suffix order, cut off at the length that counts.

No order of suffixes in text order is built: ranks of triples, recursion on a reduced
string and the merge are replaced by hashes of windows at positions of a difference
cover, sorted by hash and tested for equality, as only equality of the first `length`
(200) bytes decides what goes and hashes can be dealt to tasks without a global order.
"Suffix", "name", "sorted" and "merged" below mean such windows and their hashes.  Positions whose offset in their document lies in a difference cover of
PERIOD are sampled: any two suffixes have a shift below PERIOD that makes both
sampled, so that a repeat of `length` bytes shows as two equal samples of
length - PERIOD + 1 bytes.

1. Samples are named by the hash of these bytes and sorted by name; adjacent equal
   names are repeats, and unique ones drop out.
2. Only suffixes up to PERIOD - 1 bytes before a repeated name go on.  Of these,
   those at content-defined anchors (one in ANCHORS, the same in every copy) are
   sorted by their first `length` bytes and compared with their neighbours.
3. Recursion on names: where anchors leave open which bytes are covered, a repeated
   sample asks for the suffixes at those shifts before it, and every sample of the
   same name learns of them.
4. The suffixes asked for are merged in, sorted and compared in the same way.

Texts are packed into chunks, a table bucketed by chunk that every step reads
without an exchange.  Names go out as arrays, one of each value in a chunk, dealt
by name; only the places of repeated ones come back.  So neither a common passage
nor a large group of copies meets in one task row by row.  Equal documents are
matched by digest first, and one of them takes part.

Names of the last two steps have 64 bits: among n of them about n * n / 2**65 pairs
are taken for equal by chance.  Null texts are empty; texts shorter than `length`
keep all bytes; repeated ids are separate documents; other columns are ignored.
"""

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import Hasher

PERIOD, ANCHORS, CHUNK, PART = 133, 8, 2 << 20, 3_000_000
#: A perfect difference set; every residue of 133 is a difference of two of these.
COVER = np.array([1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110])

class Chunk:
    """A chunk with what the steps so far have found.  Every value follows from the text and the replies."""

    def __init__(self, text: bytes, ends: list[int], copies: list[int] | None, length: int):
        self.data = np.frombuffer(text, np.uint8)
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.length, self.copies = length, set(copies or ())
        self.hash = Hasher(self.data)
        self.docs = [i for i in range(len(self.ends)) if self.ends[i] - self.starts[i] >= length and i not in self.copies]

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.length - PERIOD + 1
        found = [np.zeros(0, np.int64)]
        for i in self.docs:
            s, e = int(self.starts[i]), int(self.ends[i])
            at = (np.arange(0, e - s, PERIOD)[:, None] + COVER).ravel()
            found.append(s + at[at + n <= e - s])
        at = np.concatenate(found)
        return at, self.hash(at, n)

    @staticmethod
    def repeated(at: np.ndarray, names: np.ndarray, replies: np.ndarray) -> np.ndarray:
        """Mask of all places whose name came back."""
        return np.isin(names, names[np.searchsorted(at, replies)])

    def open_starts(self, samples: np.ndarray) -> np.ndarray:
        """Starts whose `length` bytes hold a repeated sample at a shift below PERIOD."""
        change = np.zeros(len(self.data) + 2, np.int32)
        np.add.at(change, np.maximum(samples - PERIOD + 1, 0), 1)
        np.add.at(change, samples + 1, -1)
        fits = np.zeros(len(self.data) + 2, np.int32)
        for i in self.docs:
            fits[self.starts[i]] += 1
            fits[self.ends[i] - self.length + 1] -= 1
        return np.flatnonzero((np.cumsum(change)[:-2] > 0) & (np.cumsum(fits)[:-2] > 0))

    def anchors(self, replies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, names = self.samples()
        starts = self.open_starts(at[self.repeated(at, names, replies)])
        chosen = self.hash(starts, 16) >> np.uint64(40) & np.uint64(ANCHORS - 1) == 0 if len(starts) else np.zeros(0, bool)
        at = starts[chosen]
        return starts, at, self.hash(at, self.length)

    def open_after(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All starts, repeated anchors, and the starts that those leave open."""
        starts, at, names = self.anchors(first)
        good = self.repeated(at, names, second)
        if not len(at):
            return starts, at, starts
        # Between two repeated anchors not further apart than `length` all bytes are covered.
        before = np.searchsorted(at, starts, "right") - 1
        left, right = np.maximum(before, 0), np.minimum(before + 1, len(at) - 1)
        closed = (before >= 0) & (before + 1 < len(at)) & good[left] & good[right] & (at[right] - at[left] <= self.length)
        return starts, at[good], starts[~closed & ~((before >= 0) & (at[left] == starts))]

    def wishes(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Repeated samples, their names, and for each the shifts at which it wants suffixes compared."""
        at, names = self.samples()
        mask = self.repeated(at, names, first)
        at, names = at[mask], names[mask]
        wanted = np.zeros(len(self.data) + PERIOD, bool)
        wanted[self.open_after(first, second)[2] + PERIOD - 1] = True
        return at, names, np.packbits(wanted[at[:, None] + PERIOD - 1 - np.arange(PERIOD)], axis=1)

    def merged(self, first: np.ndarray, second: np.ndarray, third: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Repeated anchors, and the starts that any copy asks for with their names."""
        starts, good, open_ = self.open_after(first, second)
        at, names, _ = self.wishes(first, second)
        places, shifts = third
        asked = names[np.searchsorted(at, places)]
        order = np.argsort(asked)
        found = np.minimum(np.searchsorted(asked[order], names), max(len(asked) - 1, 0))
        if len(asked):
            hit = np.flatnonzero(asked[order][found] == names)
            bits = np.unpackbits(shifts[order][found[hit]], axis=1, count=PERIOD)
            row, shift = np.nonzero(bits)
            more = np.unique(at[hit][row] - shift)
            open_ = np.union1d(open_, more[np.isin(more, starts)])
        return good, open_, self.hash(open_, self.length)

    def covered(self, replies: list[np.ndarray], whole: list[int]) -> np.ndarray:
        """Mask of removed bytes; whole: documents with copies."""
        first, open_, names = self.merged(*replies[:3])
        starts = np.concatenate([first, open_[self.repeated(open_, names, replies[3])]])
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.length, -1)
        out = np.cumsum(change)[:-1] > 0
        for i in whole:
            if self.ends[i] - self.starts[i] >= self.length:
                out[self.starts[i] : self.ends[i]] = True
        return out


def _chunks(batches):
    import pyarrow as pa
    from pyspark import TaskContext

    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    ids, texts, held = [], [], 0

    def out():
        nonlocal number, ids, texts, held
        ends = np.cumsum([len(t) for t in texts]).tolist()
        digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        row = [[number], [ids], [ends], [digests], [b"".join(texts)]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]
        number, ids, texts, held = number + 1, [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=["chunk", "ids", "ends", "digests", "text"])

    for b in batches:
        for i, t in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            t = t or b""
            if ids and held + len(t) > CHUNK:
                yield out()
            ids.append(i)
            texts.append(t)
            held += len(t)
    if ids:
        yield out()


def _places(blobs) -> np.ndarray:
    """Sorted places from pairs of arrays of their upper and lower halves."""
    parts = [np.frombuffer(x["high"], np.uint16).astype(np.int64) << 16 | np.frombuffer(x["low"], np.uint16) for x in blobs or ()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _shifts(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Places with the shifts that are asked for at each."""
    parts = [_places([x]) for x in blobs or ()]
    masks = [np.frombuffer(x["shifts"], np.uint8) for x in blobs or ()]
    n = -(-PERIOD // 8)
    return (np.concatenate(parts), np.concatenate(masks).reshape(-1, n)) if parts else (np.zeros(0, np.int64), np.zeros((0, n), np.uint8))


def _rows(batches, length: int):
    """(chunk number, ids, Chunk, replies of each step, documents with copies) of every row."""
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            copies = [x["at"] for x in row["copies"] or () if not x["first"]]
            whole = [x["at"] for x in row["copies"] or ()]
            yield row["chunk"], row["ids"], Chunk(row["text"], row["ends"], copies, length), [_places(row.get("r1")), _places(row.get("r2")), _shifts(row.get("r3")), _places(row.get("r4"))], whole


def _emit(step: int, length: int, parts: int):
    """Names of a step, one place for each value in the chunk, dealt to parts by their upper bits."""

    def run(batches):
        import pyarrow as pa

        for number, _, chunk, replies, _ in _rows(batches, length):
            if step == 1:
                at, names = chunk.samples()
            elif step == 2:
                at, names = chunk.anchors(replies[0])[1:]
            elif step == 3:
                at, names, shifts = chunk.wishes(*replies[:2])
            else:
                at, names = chunk.merged(*replies[:3])[1:]
            if not len(at):
                continue
            values, first, inverse, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
            at = at[first]
            # What else a name carries: whether the chunk has it twice, or the shifts that its places ask for.
            extra = (counts > 1)[:, None].astype(np.uint8)
            if step == 3:
                extra = np.zeros((len(values), shifts.shape[1]), np.uint8)
                np.bitwise_or.at(extra, inverse, shifts)
            part = ((values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            # Samples are only a sieve: their part and 32 more bits are name enough.
            names = values.astype(np.uint32) if step == 1 else values
            rows = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                s = slice(cuts[p], cuts[p + 1])
                order = np.argsort(at[s])
                x = at[s][order]
                rows.append((p, number, names[s][order].tobytes(), (x >> 16).astype(np.uint16).tobytes(), (x & 0xFFFF).astype(np.uint16).tobytes(), extra[s][order].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)], names=["part", "chunk", "names", "high", "low", "extra"])

    return run


def _neighbours(step: int):
    """Sort the names of a part and compare neighbours; places with an answer go back to their chunks."""

    def run(table):
        import pyarrow as pa

        width = 4 if step == 1 else 8
        blobs = table.column("names").to_pylist()
        names = np.frombuffer(b"".join(blobs), np.uint32 if width == 4 else np.uint64)
        sizes = np.array([len(x) // width for x in blobs])
        extra = np.frombuffer(b"".join(table.column("extra").to_pylist()), np.uint8).reshape(len(names), -1)
        order = np.argsort(names, kind="stable")
        new = np.ones(len(names), bool)
        new[1:] = names[order][1:] != names[order][:-1]
        if step == 3:
            shifts = np.empty_like(extra)
            shifts[order] = np.bitwise_or.reduceat(extra[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            answer = shifts.any(axis=1)
        else:
            shifts = extra[:, :0]
            answer = extra[:, 0] > 0
            answer[order[1:][~new[1:]]] = True
            answer[order[:-1][~new[1:]]] = True
        out = []
        for c, n, e, h, w in zip(table.column("chunk").to_pylist(), sizes.tolist(), np.cumsum(sizes).tolist(), table.column("high").to_pylist(), table.column("low").to_pylist(), strict=True):
            mask = answer[e - n : e]
            if mask.any():
                out.append((c, np.frombuffer(h, np.uint16)[mask].tobytes(), np.frombuffer(w, np.uint16)[mask].tobytes(), shifts[e - n : e][mask].tobytes()))
        cols = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["chunk", "high", "low", "shifts"])

    return run


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 200, with_text: bool = True) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256, and what is kept as bytes if asked for."""
    if length <= PERIOD:
        raise ValueError(f"length has to be over {PERIOD}")
    spark = df.sparkSession
    common.ship(spark)
    name, folder = f"chunks_{uuid.uuid4().hex}", common.work_folder(spark)
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    made = texts.mapInArrow(common.tidy(_chunks), "chunk long, ids array<long>, ends array<int>, digests array<binary>, text binary")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    made.write.bucketBy(buckets, "chunk").option("path", f"{folder}/{name}").option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    total = table.agg(F.sum(F.element_at("ends", -1).cast("long"))).first()[0] or 0
    parts = int(min(max(buckets, total * len(COVER) / PERIOD // PART + 1), 20_000))
    docs = table.select("chunk", F.posexplode(F.arrays_zip("digests", "ends")).alias("at", "x"))
    docs = docs.select("chunk", "at", F.col("x.digests").alias("digest"))
    shared = docs.groupBy("digest").agg(F.min(F.struct("chunk", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = docs.join(shared, "digest").select("chunk", F.struct("at", (F.struct("chunk", "at") == F.col("first")).alias("first")).alias("x"))
    copies = common.stored(copies.groupBy("chunk").agg(F.collect_list("x").alias("copies")), "copies")
    rows = table.drop("digests").join(copies.hint("shuffle_hash"), "chunk", "left")
    for step in (1, 2, 3, 4):
        out = rows.mapInArrow(common.tidy(_emit(step, length, parts)), "part int, chunk long, names binary, high binary, low binary, extra binary")
        back = out.groupBy("part").applyInArrow(_neighbours(step), "chunk long, high binary, low binary, shifts binary")
        back = back.groupBy("chunk").agg(F.collect_list(F.struct("high", "low", "shifts")).alias(f"r{step}"))
        rows = rows.join(common.stored(back, f"places{step}").hint("shuffle_hash"), "chunk", "left")
    schema = f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    names = [x.split()[0] for x in schema.split(", ")]

    def finish(batches):
        import pyarrow as pa

        for _, ids, chunk, replies, whole in _rows(batches, length):
            gone = chunk.covered(replies, whole)
            made = []
            for i, s, e in zip(ids, chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
                g = gone[s:e]
                kept = chunk.data[s:e][~g].tobytes()
                made.append((i, e - s, int(g.sum()), int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()) + (kept,) * with_text)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=False)], names=names)

    return rows.mapInArrow(common.tidy(finish), schema)


def kept_text(kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kept) of remove_repeats with what is kept as text; a character that is cut goes."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode("utf-8", "ignore") for x in b.column(1).to_pylist()], pa.string())], names=[key, "kept"])

    return kept.select(key, "kept").mapInArrow(common.tidy(run), f"{key} long, kept string")
