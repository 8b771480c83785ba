"""URL filter over a sorted digest array.

Rules are (host, path, verdict).  Their strings `host + path` are hashed with
64-bit xxhash; the index file holds the sorted digests, offsets and the full
strings.  Executors map the file into memory, probe it by binary search with
the digests of every (host suffix, path prefix) that a url offers, and compare
the stored string before a hit counts, so that collisions change nothing.

Nulls: a null url, or one without `://`, has an empty host and path and fits no
rule.  Rules may repeat; the last one given for a (host, path) counts.  An empty
rule list or table gives the default verdict, or no rows.
"""

import os
import tempfile
import uuid

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [p for c in "?#" if (p := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    cut = rest.find("/")
    if cut < 0:
        return rest.translate(LOWER), ""
    return rest[:cut].translate(LOWER), rest[cut:]


def build_index(rules, path: str, digest=None) -> None:
    """Write the index: counts, sorted digests, string offsets, verdicts, strings."""
    digest = digest or _digest
    full = {}
    for host, prefix, verdict in rules:
        if not host:
            raise ValueError("a rule needs a host")
        full[(host.translate(LOWER), prefix or "")] = verdict
    keys = sorted((digest(f"{h}\n{p}".encode()), h, p, v) for (h, p), v in full.items())
    texts = [f"{h}\n{p}".encode() for _, h, p, _ in keys]
    lengths = sorted({len(p) for _, _, p, _ in keys})
    with open(path, "wb") as f:
        np.array([len(keys), len(lengths)], np.int64).tofile(f)
        np.array(lengths, np.int64).tofile(f)
        np.array([k[0] for k in keys], np.uint64).tofile(f)
        np.cumsum([0, *map(len, texts)], dtype=np.int64).tofile(f)
        np.array([v == "block" for *_, v in keys], np.int64).tofile(f)
        f.write(b"".join(texts) + b"\0")


def _digest(key: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key)


class Index:
    def __init__(self, path: str, digest=None):
        self.digest = digest or _digest
        raw = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in raw[:16].view(np.int64))
        at = 16
        self.lengths = raw[at : (at := at + 8 * m)].view(np.int64).tolist()
        self.keys = raw[at : (at := at + 8 * n)].view(np.uint64)
        self.offsets = raw[at : (at := at + 8 * (n + 1))].view(np.int64)
        self.blocks = raw[at : (at := at + 8 * n)].view(np.int64)
        self.text = raw[at:]

    def stored(self, i: int) -> bytes:
        return self.text[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def judge(self, urls: list, default: str):
        hosts, paths = zip(*map(split_url, urls), strict=True) if urls else ((), ())
        owner, texts = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            cut = 0
            while host:
                for n in self.lengths:
                    if n <= len(path):
                        owner.append(i)
                        texts.append(f"{host[cut:]}\n{path[:n]}".encode())
                cut = host.find(".", cut) + 1
                if not cut:
                    break
        rule, block, best = [None] * len(urls), [default] * len(urls), [0] * len(urls)
        if texts and len(self.keys):
            probe = np.fromiter(map(self.digest, texts), np.uint64, len(texts))
            found = np.searchsorted(self.keys, probe)
            hit = np.flatnonzero(self.keys[np.minimum(found, len(self.keys) - 1)] == probe)
            for k in hit.tolist():
                at = int(found[k])
                while at < len(self.keys) and self.keys[at] == probe[k]:
                    if self.stored(at) == texts[k]:
                        i = owner[k]
                        if len(texts[k]) > best[i]:
                            best[i] = len(texts[k])
                            rule[i] = texts[k].decode().replace("\n", "", 1)
                            block[i] = "block" if self.blocks[at] else "allow"
                        break
                    at += 1
        return list(hosts), list(paths), rule, block


def url_filter(df: DataFrame, rules, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row; columns of these names are replaced.

    A rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest fitting one decides, `default` where none does.  The index
    goes to the executors as a file, not as an object in every task.
    """
    spark = df.sparkSession
    folder = tempfile.mkdtemp(prefix="tidemark-rules")
    name = f"rules-{uuid.uuid4().hex}.idx"
    build_index(rules, os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    new = ["host", "path", "rule", "verdict"]
    keep = [c for c in df.columns if c not in new or c == url]
    rows = df.select(*keep)
    schema = StructType([f for f in rows.schema if f.name not in new] + [StructField(c, StringType()) for c in new])

    def run(batches):
        import pyarrow as pa

        index = Index(SparkFiles.get(name))
        for b in batches:
            made = index.judge(b.column(url).to_pylist(), default)
            kept = [c for c in b.schema.names if c not in new]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(x, pa.string()) for x in made], names=kept + new)

    return rows.mapInArrow(run, schema)
