"""Near-duplicate texts: SuperMinHash signatures, banding, verification on full sets, union-find groups.

A text's words are the stretches without ASCII white space, A-Z lower-cased; its
set is that of its shingles of `words` words, each a 64-bit hash.  A shorter text is
one shingle; one without words has the empty set and links with nothing.

Texts with equal sets are one class.  Classes that share a band are candidates, and
verify compares them on their full sets: with the least id of the band first, then
what that leaves open with the rest of the band, where the signatures agree in
enough slots.  With SIGNATURE slots, ROWS a band and MARGIN standard deviations below
the threshold, a link at 0.85 is missed with probability 5e-7 by the bands and 3e-5
by the slots, one at 0.8 with 5e-5 and 3e-5.

Null texts are empty.  Repeated ids are texts of one document: they share its component.
"""

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, verify
from .hashing import Hasher, mix

SIGNATURE, ROWS, MARGIN, PIECE = 127, 5, 4.0, 1 << 20
BAND_MASK = 31

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _pieces(text: bytes):
    """A text cut at white space, so that its pieces hold about PIECE bytes; a longer word is not cut."""
    at = 0
    while len(text) - at > PIECE:
        cut = _BREAK.search(text, at + PIECE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def _hashes_of(pieces: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each piece."""
    data = np.frombuffer(b"\n".join(pieces).lower() + b"\n", np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts = edges[0::2]
    hashes = Hasher(data).words(starts, edges[1::2])
    return np.split(hashes, np.searchsorted(starts, np.cumsum([len(p) + 1 for p in pieces])[:-1]))


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """Hashes of the lower-cased words of each text, PIECE bytes at a time."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    owners, pieces, held = [], [], 0

    def flush():
        for i, h in zip(owners, _hashes_of(pieces), strict=True):
            found[i].append(h)

    for i, text in enumerate(texts):
        for piece in _pieces(text or b""):
            owners.append(i)
            pieces.append(piece)
            held += len(piece)
            if held >= PIECE:
                flush()
                owners, pieces, held = [], [], 0
    if pieces:
        flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]


def _distinct(h: np.ndarray, n: int) -> np.ndarray:
    if not len(h):
        return h
    if len(h) < n:
        x = np.uint64(len(h))
        for v in h:
            x = mix(np.array([x * _GOLD + v]))[0]
        return np.array([x])
    x = h[: len(h) - n + 1]
    for k in range(1, n):
        x = mix(x) * _GOLD + h[k : len(h) - n + 1 + k]
    x = np.sort(mix(x))
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def shingles(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of n words of each text."""
    with np.errstate(over="ignore"):
        return [_distinct(h, n) for h in word_hashes(texts)]


def _prime(m: int) -> int:
    while any(m % k == 0 for k in range(2, math.isqrt(m) + 1)):
        m += 1
    return m


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, m: int = SIGNATURE) -> np.ndarray:
    """Signatures (n, m) of n sets; owner is the set of each element.

    Step j gives every element a value in [j, j + 1) at the slot that its own permutation
    names; a set whose slots all lie below j + 1 needs no further step.  The permutations
    are k -> a + b * k modulo a prime, a and b from the element, and need no table.
    """
    p = _prime(m)
    out = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        at = (mix(elements + np.uint64(0xA24BAED4963EE407)) % np.uint64(p)).astype(np.int64)
        by = (mix(elements + np.uint64(0x9FB21C651E98DF25)) % np.uint64(p - 1)).astype(np.int64) + 1 if p > 1 else at
        for j in range(p):
            inside = at < m
            value = np.uint64(j) << np.uint64(56) | mix(elements + np.uint64(j + 1) * _GOLD) >> np.uint64(8)
            np.minimum.at(out, owner[inside] * m + at[inside], value[inside])
            open_ = (out.reshape(n, m).max(1) >= np.uint64(j + 1) << np.uint64(56))[owner]
            if not open_.any():
                break
            elements, owner, at, by = elements[open_], owner[open_], at[open_], by[open_]
            at = (at + by) % p
    return out.reshape(n, m)


SKETCH = np.dtype([("slots", "<u2", (SIGNATURE,)), ("bands", "<i8", (SIGNATURE // ROWS,))])


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, bands = signatures.shape[0], signatures.shape[1] // rows
    parts = signatures[:, : bands * rows].reshape(n, bands, rows)
    x = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands))
    with np.errstate(over="ignore"):
        for k in range(rows):
            x = mix(x * _GOLD + parts[:, :, k])
    # The lowest bits say which band it is.
    x = x & ~np.uint64(BAND_MASK) | np.arange(bands, dtype=np.uint64)
    return x.view(np.int64)


def sketches(signatures: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Sixteen bits of each slot, enough to count those that agree, and the whole keys of the bands."""
    out = np.zeros(len(signatures), SKETCH)
    out["slots"], out["bands"] = mix(signatures) >> np.uint64(48), bands
    return out


def _sketch(words: int):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in common.slices(whole, "text", PIECE):
                sets = shingles(b.column("text").cast(pa.binary()).to_pylist(), words)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                keys, slots = {}, {}
                if len(full):
                    signatures = superminhash(np.concatenate([sets[i] for i in full]), np.repeat(np.arange(len(full)), sizes[full]), len(full))
                    bands = band_keys(signatures)
                    keys = dict(zip(full.tolist(), bands.tolist(), strict=True))
                    slots = dict(zip(full.tolist(), sketches(signatures, bands), strict=True))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                bands = pa.array([keys.get(i) for i in range(len(sets))], pa.list_(pa.int64()))
                slots = pa.array([slots[i].tobytes() if i in slots else None for i in range(len(sets))], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes), pa.array(digests, pa.binary()), bands, slots], names=["id", "n", "digest", "bands", "sketch"])

    return run


def counts(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 columns for the elements that occur more than once."""
    both = sets + (others or [])
    found, at = np.unique(np.concatenate(both), return_inverse=True)
    often = np.bincount(at) > 1
    column = np.cumsum(often) - 1
    keep = often[at]
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])[keep]
    at = column[at][keep]
    n = int(often.sum())
    left = len(sets)
    total = np.zeros((left, len(both) - left if others is not None else left), np.int64)
    step = 8192
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    cuts = np.searchsorted(at, np.arange(0, n + step, step))
    for i, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        m = np.zeros((len(both), min(step, n - i * step)), np.float32)
        m[row[s:e], at[s:e] - i * step] = 1
        total += (m[:left] @ (m[left:] if others is not None else m).T).astype(np.int64)
    return total


def linked(sets, others, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with 100 * intersection >= percent * union."""
    if others is None and len(sets) == 2:
        a = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        good = 100 * a >= percent * (len(sets[0]) + len(sets[1]) - a)
        return (np.array([0]), np.array([1])) if good else (np.zeros(0, int), np.zeros(0, int))
    g = counts(sets, others)
    a = np.array([len(s) for s in sets])
    b = a if others is None else np.array([len(s) for s in others])
    x, y = np.nonzero(100 * g >= percent * (a[:, None] + b[None] - g))
    if others is None:
        keep = x < y
        x, y = x[keep], y[keep]
    return x, y


class ShingleKit:
    """What verification needs: sets from texts, links between sets, and what signatures allow."""

    def __init__(self, words: int, percent: int):
        self.words, self.percent = words, percent
        s = percent / 100
        self.agree = math.ceil(SIGNATURE * (s - MARGIN * math.sqrt(s * (1 - s) / SIGNATURE)))

    def prepare(self, texts: list[bytes | None]) -> list[np.ndarray]:
        return shingles(texts, self.words)

    def decide(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([self._linked(a, b) for a, b in pairs], bool)

    def _linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = sorted((len(a), len(b)))
        if 100 * small < self.percent * large:
            return False
        both = np.sort(np.concatenate([a, b]))
        n = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * n >= self.percent * (small + large - n)

    def near(self, sets, others, key: int | None = None):
        return linked(sets, others, self.percent)

    def can(self, a: list[bytes], b: list[bytes], keys: list[int | None]) -> np.ndarray:
        """Pairs whose slots agree often enough, if the band `key` is the first that they share."""
        out = np.zeros(len(a), bool)
        for s in range(0, len(a), 4096):
            x, y = (np.frombuffer(b"".join(v[s : s + 4096]), SKETCH) for v in (a, b))
            equal, bands = x["slots"] == y["slots"], x["bands"] == y["bands"]
            # A band's number is in its key's lowest bits.
            band = np.array([-1 if k is None else k & BAND_MASK for k in keys[s : s + 4096]])
            out[s : s + 4096] = (equal.sum(1) >= self.agree) & ((band < 0) | bands.any(1) & (bands.argmax(1) == band))
        return out

    def possible(self, a: list[bytes], b: list[bytes], key: int | None) -> np.ndarray:
        return np.array([self.can([x] * len(b), b, [key] * len(b)) for x in a]).reshape(len(a), len(b))


def minhash_groups(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept."""
    spark = df.sparkSession
    common.ship(spark)
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = common.stored(texts.mapInArrow(common.tidy(_sketch(words)), "id long, n long, digest binary, bands array<long>, sketch binary"), "sketches")
    one = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    one = common.stored(one, "classes")
    members = one.select(F.explode("bands").alias("key"), "id")
    buckets = common.stored(members.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = common.stored(members.join(buckets, "key"), "members")
    groups = verify.components_of(members, texts, one.select("id", "sketch"), ShingleKit(words, percent))
    classed = one.select("digest", "id").join(groups, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    full = rows.where("digest IS NOT NULL").select("id", "n", "digest").join(classed, "digest").select("id", "n", "component_id")
    empty = rows.where("digest IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return full.union(empty).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
