"""HAR files of any size: cut at their entries by byte ranges, so that several tasks read one archive.

A file holds one archive or many, one after the other.  It is cut into ranges of about
`chunk` bytes, none right after a backslash, so that no escape is cut.  Three scans follow,
each dealt over all ranges:

1. Quotes that no backslash precedes are ends of strings, wherever a range starts.  So a
   range counts them, and the brackets of its even and of its odd stretches between them:
   whichever stretches are outside strings, its change of depth is known.  Running sums over
   the ranges of a file then give each one's state at its start.
2. With that a range says whether it ends within `log`, and within its `entries`.
3. The data source `har_entries` gives the text of each entry that starts in a range, and
   reads on behind the range until that entry ends.

Memory is that of one range and of one entry.  The driver gets one small row a range.

Files that are no JSON have no defined result: what looks like an entry is one.  Of an
archive that breaks off, the whole entries come out.  Entries that are no objects are left
out.  Empty files have no entries.
"""

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from . import shared
from .traffic import ENTRY, exchanges

CHUNK = 32 << 20
#: How far a key may be from its bracket.
BACK = 4096
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_KEY = re.compile(rb'"([^"\\]*)"\s*:\s*$')
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")], _STEP[list(b"}]")], _STEP[ord('"')] = 1, -1, 2


def _opened(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _cut(file, size: int, at: int) -> int:
    """The first place from `at` on that no backslash precedes."""
    while 0 < at < size and file.read_at(1, at - 1) == b"\\":
        at += 1
    return min(at, size)


def _marks(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the brackets outside strings, 1 or -1 for each, and whether data ends inside a string."""
    x = np.frombuffer(_ESCAPE.sub(b"__", data), np.uint8)
    at = np.flatnonzero(_STEP[x])
    step = _STEP[x[at]]
    quotes = np.cumsum(step == 2) + inside
    outside = (step != 2) & (quotes % 2 == 0)
    return at[outside], step[outside].astype(np.int64), bool((quotes[-1] if len(quotes) else inside) % 2)


def _summary(data: bytes) -> tuple[int, int, int]:
    """Quotes, and the change of depth if the first sign is outside or inside a string."""
    return _ESCAPE.sub(b"", data).count(b'"'), int(_marks(data, False)[1].sum()), int(_marks(data, True)[1].sum())


class _Walk:
    """State along the brackets of a file: depth, whether within `log`, whether within its `entries`."""

    def __init__(self, inside: bool = False, depth: int = 0, log: bool = False, entries: bool = False):
        self.inside, self.depth, self.log, self.entries = inside, depth, log, entries
        self.told = [None, None]  # what this walk itself saw of log and entries

    def over(self, data: bytes, before: bytes):
        """(place, opens) of the brackets where an entry starts or ends; before: what precedes data."""
        at, step, self.inside = _marks(data, self.inside)
        after = self.depth + np.cumsum(step)
        # Only brackets around levels 1 to 4 say anything.
        shallow = np.flatnonzero(np.where(step > 0, after, after + 1) <= 4)
        if len(after):
            last = int(after[-1])
        for i in shallow.tolist():
            depth, place, opens = int(after[i]), int(at[i]), step[i] > 0
            if opens and depth in (2, 3):
                head = data[max(place - BACK, 0) : place] if place >= BACK else before[place - BACK :] + data[:place]
                key = _KEY.search(head)
                name = key and key.group(1)
                if depth == 2:
                    self.log = self.told[0] = name == b"log" and data[place] == ord("{")
                else:
                    self.entries = self.told[1] = name == b"entries" and data[place] == ord("[")
            elif not opens and depth == 2:
                self.entries = self.told[1] = False
            elif not opens and depth == 1:
                self.log = self.told[0] = False
            elif self.log and self.entries and ((opens and depth == 4) or (not opens and depth == 3)):
                yield place, bool(opens)
        if len(after):
            self.depth = last


def _ranges(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), F.col("length").alias("size"))
    rows = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / chunk))).alias("n"))
    return rows.repartition(spark.sparkContext.defaultParallelism * 4, "file", "n")


def _pieces(batches, chunk: int):
    """(row, file, start, stop) of each row's range."""
    for b in batches:
        for r in b.to_pylist():
            with _opened(r["file"]) as f:
                yield r, f, _cut(f, r["size"], r["n"] * chunk), _cut(f, r["size"], (r["n"] + 1) * chunk)


def _summaries(chunk: int):
    def run(batches):
        import pyarrow as pa

        for r, f, start, stop in _pieces(batches, chunk):
            yield pa.RecordBatch.from_pylist([r | dict(zip(("quotes", "outer", "inner"), _summary(f.read_at(stop - start, start)), strict=True))])

    return run


def _ends(chunk: int):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("n", pa.int64()), ("log", pa.bool_()), ("entries", pa.bool_())])
        for r, f, start, stop in _pieces(batches, chunk):
            walk = _Walk(r["inside"], r["depth"])
            back = max(start - BACK, 0)
            for _ in walk.over(f.read_at(stop - start, start), f.read_at(start - back, back)):
                pass
            yield pa.RecordBatch.from_pylist([{"file": r["file"], "n": r["n"], "log": walk.told[0], "entries": walk.told[1]}], schema)

    return run


def states(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(file, size, n, inside, depth, log, entries): each range's state at its start."""
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sums = _ranges(spark, path, chunk).mapInArrow(_summaries(chunk), "file string, size long, n long, quotes long, outer long, inner long")
    inside = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    depth = inside.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).over(before), F.lit(0)))
    known = shared.stored(depth.select("file", "size", "n", "inside", "depth"), "ranges")
    cores = spark.sparkContext.defaultParallelism * 4
    ends = known.repartition(cores, "file", "n").mapInArrow(_ends(chunk), "file string, n long, log boolean, entries boolean")
    held = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(False)).alias(c)
    return known.join(ends, ["file", "n"]).select("file", "size", "n", "inside", "depth", held("log"), held("entries"))


class Range(InputPartition):
    def __init__(self, file, size, n, inside, depth, log, entries):
        self.file, self.size, self.n, self.inside, self.depth, self.log, self.entries = file, size, n, inside, depth, log, entries


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.chunk, self.ranges, self.dealt = int(options["chunk"]), json.loads(options["ranges"]), False

    def __getstate__(self):
        """What goes to each task: once ranges are dealt, a task has its own and not all of them."""
        return self.__dict__ | {"ranges": []} if self.dealt else self.__dict__

    def partitions(self):
        self.dealt = True
        return [Range(*r) for r in self.ranges]

    def read(self, p):
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("entry", pa.string())])
        with _opened(p.file) as f:
            start, n = _cut(f, p.size, p.n * self.chunk), p.n
            own = stop = _cut(f, p.size, (n + 1) * self.chunk)
            walk = _Walk(p.inside, p.depth, p.log, p.entries)
            back = max(start - BACK, 0)
            before, held, begun = f.read_at(start - back, back), [], None
            while start < p.size:
                data, last = f.read_at(stop - start, start), 0
                found, held_bytes = [], 0
                for place, opens in walk.over(data, before):
                    if opens:
                        if start >= own:
                            break
                        begun, last = start + place, place
                    elif begun is not None:
                        text = b"".join([*held, data[last : place + 1]])
                        found.append({"file": p.file, "place": begun, "entry": text.decode("utf-8", "replace")})
                        held, begun = [], None
                        held_bytes += len(text)
                        if held_bytes > 1 << 22:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, held_bytes = [], 0
                        if start >= own:
                            break
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)
                if begun is None:
                    return
                held.append(data[last:])
                before = (before + data)[-BACK:]
                n += 1
                start, stop = stop, _cut(f, p.size, (n + 1) * self.chunk)


class _PushedReader(_Reader):
    def pushFilters(self, filters):
        """Ranges of other files than the one asked for are not read."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.ranges = [r for r in self.ranges if r[0] == f.value]
            else:
                yield f


class HarSource(DataSource):
    """Entries of HAR files: (file, place, entry); options: chunk, ranges and pushed, as entries() gives them."""

    @classmethod
    def name(cls):
        return "har_entries"

    def schema(self):
        return "file string, place long, entry string"

    def reader(self, schema):
        return (_PushedReader if self.options["pushed"] == "true" else _Reader)(self.options)


def entries(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(file, place, entry): the text of each entry of the HAR files of a path, and where it starts."""
    shared.ship(spark)
    spark.dataSource.register(HarSource)
    found = [tuple(r) for r in states(spark, path, chunk).orderBy("file", "n").collect()]  # one row a range
    if not found:
        return spark.createDataFrame([], "file string, place long, entry string")
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled")  # where it is off, a reader must not take filters
    return spark.read.format("har_entries").options(chunk=chunk, ranges=json.dumps(found), pushed=pushed.lower()).load()


def read_har(spark: SparkSession, path: str, chunk: int = CHUNK, strict: bool = False) -> DataFrame:
    """The rows of traffic.har_entries() of HAR files that need not fit one task."""
    rows = entries(spark, path, chunk)
    return exchanges(rows.select(F.from_json("entry", f"struct<{ENTRY}>").alias("e")).where("e IS NOT NULL"), strict)
