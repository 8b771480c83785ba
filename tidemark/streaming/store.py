"""The store of events and cells: generations of folders, named by manifests, one line of them for each specification.

A folder is written once and never changed; a manifest says which folders count, and becomes
valid by one rename.  A batch writes a folder of events with their operations and one of delta cells; both are partitioned
by day, cells by kind as well, so that readers skip what their filters leave out.  Batches, compactions and
replays may fail at any point and run again: a folder that no manifest names counts for nothing.  There
is one writer at a time, as a stream has; readers need no lock.

Specifications are told apart by the digest of their routes.  A change of specification starts a line of its
own from the old one: only events of operations whose routes changed, and those without one, are matched again,
and only their cells are replaced.
"""

import hashlib
import json
import re
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as cube
from ..operators import routes as R
from ..sources import shared
from ..sources.traffic import EVENT

LOG = f"{EVENT}, op_key string, day date"
CELLS = "operation string, part string, status int, field string, detail string, client string, count long, first_ts timestamp, last_ts timestamp, kind string, day date"
#: Cells of these kinds hang on events alone, not on their operations.
FREE = ["EVENT"]
#: Events whose cells a task counts before they are exchanged: an event makes about ten keys, which so fit in memory.
EVENTS = 25_000


def digest(routes: R.Routes) -> str:
    return hashlib.sha256(json.dumps([routes.trie, routes.bases]).encode()).hexdigest()[:16]


def _could_share(a: str, b: str) -> bool:
    """Whether a request can fit both templates: segment by segment, parameters and mixed ones with anything."""
    x, y = R.segments_of(a), R.segments_of(b)
    return len(x) == len(y) and all("{" in s or "{" in t or s == t for s, t in zip(x, y, strict=True))


def changed_operations(old: R.Routes, new: R.Routes) -> set[str]:
    """Operations of the old specification whose events may belong elsewhere in the new one."""
    gone, come = set(old.keys) - set(new.keys), set(new.keys) - set(old.keys)
    out = set(gone)
    for k in set(old.keys) - gone:
        method, template = k.split(" ", 1)
        others = [o.split(" ", 1) for o in gone | come]
        if old.bases != new.bases or any(m == method and _could_share(template, t) for m, t in others):
            out.add(k)
    # Operations of equal shape hide each other by their order.
    order = lambda r: {re.sub(r"\{[^/}]*\}", "{}", k): k for k in reversed(r.keys)}
    return out | {k for s, k in order(old).items() if order(new).get(s, k) != k}


class Store:
    def __init__(self, spark: SparkSession, root: str, routes: R.Routes):
        self.spark, self.root, self.routes, self.name = spark, root, routes, digest(routes)
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    # Manifests.

    def manifest(self) -> dict:
        """What counts now: folders of the log and of cells with what each leaves out, and the first day kept."""
        at = self._path("manifests", self.name)
        names = [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
        if not numbers:
            return {"number": 0, "log": [], "cells": [], "from_day": None}
        stream = self.fs.open(self._path("manifests", self.name, f"{max(numbers)}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, m: dict) -> None:
        m = m | {"number": m["number"] + 1}
        made = self._path("manifests", self.name, f"{m['number']}-{uuid.uuid4().hex}.new")
        stream = self.fs.create(made, False)
        stream.write(json.dumps(m).encode())
        stream.close()
        final = self._path("manifests", self.name, f"{m['number']}.json")
        if self.fs.exists(final) or not self.fs.rename(made, final):
            raise RuntimeError("another writer committed first")

    def _write(self, df: DataFrame, folder: str, by: list[str]) -> dict:
        # Adaptive execution splits partitions of busy days.
        df.hint("rebalance", *by).write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{folder}")
        return {"path": folder, "without": None, "first_day": self._first_day(folder)}

    def _first_day(self, folder: str) -> str | None:
        found = [s.getPath().getName() for p in ("day=*", "kind=*/day=*") for s in self.fs.globStatus(self._path(folder, p)) or ()]
        return min((n.removeprefix("day=") for n in found), default=None)

    # Reading.

    def _read(self, entries: list[dict], schema: str, operation: str, from_day: str | None) -> DataFrame:
        parts = []
        for e in entries:
            df = self.spark.read.schema(schema).parquet(f"{self.root}/{e['path']}")
            if e["without"] is not None:
                gone = F.col(operation).isNull() | F.col(operation).isin(e["without"])
                if operation == "operation":
                    gone = ((F.col("kind") == "UNMATCHED") | F.col("operation").isin(e["without"])) & ~F.col("kind").isin(FREE)
                df = df.where(~gone)
            parts.append(df.where(F.col("day") >= F.lit(from_day).cast("date")) if from_day else df)
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def log(self) -> DataFrame:
        """All events with op_key."""
        m = self.manifest()
        return self._read(m["log"], LOG, "op_key", m["from_day"])

    def cells(self) -> DataFrame:
        """The cube; where several generations count, they are merged."""
        m = self.manifest()
        out = self._read(m["cells"], CELLS, "operation", m["from_day"])
        return out if len(m["cells"]) == 1 else cube.merge_cells(out)

    # Writing.

    def append(self, events: DataFrame, batch: str) -> None:
        """Add a batch of events.  The same batch again changes nothing."""
        m = self.manifest()
        if any(e["path"] == f"log/{batch}" for e in m["log"]) or batch in m.get("merged", ()):
            return
        resolved = R.resolve(events.select(*[c.split()[0] for c in EVENT.split(", ")]), self.routes).withColumn("day", F.to_date("ts"))
        log = self._write(resolved, f"log/{batch}", ["day"])
        stored = self.spark.read.schema(LOG).parquet(f"{self.root}/log/{batch}")
        made = self._write(cube.build_cells(shared.dealt(stored, EVENTS)), f"cells/{batch}", ["kind", "day"])
        self._commit(m | {"log": [*m["log"], log], "cells": [*m["cells"], made]})

    def compact(self) -> None:
        """One folder of cells and one of events in place of all that count; days before the first one kept go."""
        m = self.manifest()
        if not m["cells"]:
            return
        name = uuid.uuid4().hex
        made = self._write(cube.merge_cells(self._read(m["cells"], CELLS, "operation", m["from_day"])), f"cells/merged-{name}", ["kind", "day"])
        log = self._write(self._read(m["log"], LOG, "op_key", m["from_day"]), f"log/merged-{name}", ["day"])
        merged = [*m.get("merged", ()), *(e["path"].split("/", 1)[1] for e in m["log"])]
        self._commit(m | {"cells": [made], "log": [log], "merged": merged})

    def retain(self, first: date) -> bool:
        """Leave out days before `first`; nothing is done unless such a day is held.  Files go with the next compaction and sweep."""
        m = self.manifest()
        limit = max(first.isoformat(), m["from_day"] or "")
        held = [e["first_day"] for e in m["log"] + m["cells"] if e["first_day"]]
        if not held or max(min(held), m["from_day"] or "") >= limit:
            return False
        self._commit(m | {"from_day": limit})
        return True

    def sweep(self) -> list[str]:
        """Delete folders that no specification's newest manifest names; readers that began before must have ended."""
        lines = self._path("manifests")
        names = [f.getPath().getName() for f in self.fs.listStatus(lines)] if self.fs.exists(lines) else []
        named = set()
        for n in names:
            other = Store.__new__(Store)
            other.__dict__ |= self.__dict__ | {"name": n}
            m = other.manifest()
            named |= {e["path"] for e in m["log"] + m["cells"]}
        gone = []
        for kind in ("log", "cells"):
            at = self._path(kind)
            for f in self.fs.listStatus(at) if self.fs.exists(at) else ():
                folder = f"{kind}/{f.getPath().getName()}"
                if folder not in named:
                    shared.delete(self.spark, f"{self.root}/{folder}")
                    gone.append(folder)
        return gone

    def under(self, routes: R.Routes) -> "Store":
        """The same events under another specification; its cube is made from this one where there is none yet."""
        new = Store(self.spark, self.root, routes)
        if new.name == self.name or new.manifest()["number"]:
            return new
        m = self.manifest()
        touched = sorted(changed_operations(self.routes, routes))
        again = self.affected(touched)
        name = f"{new.name}-from-{self.name}-{m['number']}"
        log = new._write(R.resolve(again.drop("op_key"), routes), f"log/{name}", ["day"])
        stored = self.spark.read.schema(LOG).parquet(f"{self.root}/log/{name}")
        made = new._write(cube.build_cells(shared.dealt(stored, EVENTS)).where(~F.col("kind").isin(FREE)), f"cells/{name}", ["kind", "day"])
        keep = lambda entries: [e | {"without": sorted({*(e["without"] or ()), *touched})} for e in entries]
        new._commit(m | {"number": 0, "log": [*keep(m["log"]), log], "cells": [*keep(m["cells"]), made]})
        return new

    def affected(self, operations: list[str]) -> DataFrame:
        """Events of these operations and those without one."""
        return self.log().where(F.col("op_key").isNull() | F.col("op_key").isin(operations))
