"""Product codes against a plain version on Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes, queries

ROWS = "vec_id long, embedding array<double>, label int"


def plain(rows, rounds=6):
    """rows: (id, vector, label); a list of (id, code, error, label_error, digest)."""
    fine = [r for r in rows if r[1] and len(r[1]) % 8 == 0 and all(c is not None and math.isfinite(c) for c in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    if not fine:
        return []
    w = len(fine[0][1]) // 8
    x = []
    for _, v, _ in fine:
        q = [(lambda a, b: a * 4096 // b)(*float(c).as_integer_ratio()) for c in v]
        x.append([q[p * w : p * w + w] for p in range(8)])
    books = [[x[i][p] for i in range(min(16, len(x)))] for p in range(8)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [[min(range(len(books[p])), key=lambda e: (dist(v[p], books[p][e]), e)) for p in range(8)] for v in x]
        if r < rounds:
            for p in range(8):
                for e in range(len(books[p])):
                    own = [v[p] for v, a in zip(x, at, strict=True) if a[p] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(dist(v[p], books[p][a[p]]) for p in range(8)) for v, a in zip(x, at, strict=True)]
    total = {}
    for (_, _, label), e in zip(fine, errors, strict=True):
        total[label] = total.get(label, 0) + min(e, codes.MOST)
    return [(r[0], "".join(f"{e:02x}" for e in a), min(e_, codes.MOST), min(total[r[2]], codes.MOST), digest) for r, a, e_ in zip(fine, at, errors, strict=True)]


def same(got, want):
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got) == order(want)


def test_query(spark, tmp_path):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 0.2) for _ in range(24)] for _ in range(30)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([None, 0, 0, 0, 1, 2])) for i in range(400)]
    rows += [(400 + i, [rng.choice([0.0, 2.0**-12, -(2.0**-13)]) for _ in range(24)], 7) for i in range(60)]  # ties
    rows += [(900, None, 1), (901, [], 1), (902, [math.nan] * 24, 1), (903, [math.inf] * 24, 1), (904, [None] * 24, 1), (905, [1.0] * 20, 1), (906, [1.0] * 16, 1), (None, [0.1] * 24, None), (5, [0.2] * 24, 0), (5, [0.2] * 24, 0)]
    rng.shuffle(rows)
    spark.createDataFrame([(*r, "0f") for r in rows], ROWS + ", code string").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    same(queries.op12_hamerly(spark, str(tmp_path)).collect(), plain(rows))


@pytest.mark.parametrize("size", [1e5, 1e30, 1e300])
def test_large_components(spark, size):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, size if i % 3 else 1) for _ in range(16)], i % 2) for i in range(50)]
    same(codes.product_codes(spark.createDataFrame(rows, ROWS), rounds=3).collect(), plain(rows, 3))


def test_few_rows_and_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "FEW_LABELS", 1)
    rows = [(3, [0.5] * 8, 1), (1, [0.25, -0.5] * 4, None), (2, [0.5] * 8, 1)]
    same(codes.product_codes(spark.createDataFrame(rows, ROWS)).collect(), plain(rows))
    assert codes.product_codes(spark.createDataFrame(rows, ROWS).where("false")).collect() == []
    alone = codes.product_codes(spark.createDataFrame(rows, ROWS).select(F.col("vec_id").alias("k"), "embedding"), key="k", label=None).collect()
    assert len({r["label_error"] for r in alone}) == 1 and {r["k"] for r in alone} == {1, 2, 3}


def test_bounds_spare_scans():
    """Bounds settle most parts once entries hardly move, and never change an answer."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = np.concatenate([c + rng.integers(-200, 200, (300, 8)) for c in centres])
    book = x[:: len(x) // 16][:16].copy()
    at, best, lower = codes.nearest(x, book)
    upper, scans = np.sqrt(best) * codes._HIGH, []
    for _ in range(6):
        new = np.stack([x[at == e].sum(0) // max((at == e).sum(), 1) if (at == e).any() else book[e] for e in range(16)])
        scans.append(codes.advance(x, at, upper, lower, new, codes.ways(book, new)))
        book = new
        assert (at == codes.nearest(x, book)[0]).all()
    assert scans[-1] < len(x) / 4
