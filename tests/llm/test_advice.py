
import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import embeddings, lines

DOCS = "doc_id long, text string"


def test_lines_with_edits_of_any_length(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(3, 9)))
    docs = []
    for n in (5, 8, 12, 18, 30, 60):
        for _ in range(10):
            w = [word() for _ in range(n)]
            docs.append(" ".join(w))
            for _ in range(max(1, n // 12)):
                k = rng.randrange(n)
                w[k] = "z" + w[k][1:]
            docs.append(" ".join(w))
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(spark.createDataFrame(list(enumerate(docs)), DOCS)).collect()}
    assert got == {i: "" if i % 2 else x for i, x in enumerate(docs)}


def test_stages_decide_by_rows(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijkl", k=6)) for _ in range(n))
    a, b, c, d, shared = text(60), text(60), text(60), text(60), text(50)
    rows = [(1, a), (1, a), (2, b), (2, f"{c}\n{a}"), (None, d), (None, d), (None, None), (3, f"{text(40)} {shared}"), (None, f"{text(40)} {shared}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    run = lambda stage, df: sorted(((r["doc_id"], r["text"]) for r in stage(spark, df, str(tmp_path)).collect()), key=key)
    assert run(corpus_pipeline.toxicity, docs) == sorted(rows, key=key)
    got = run(corpus_pipeline.line_stage, docs)
    assert got == sorted([(1, a), (1, ""), (2, b), (2, c), (None, d), (None, ""), *rows[6:]], key=key)
    near = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=key) == sorted([(1, a), *rows[2:5], *rows[6:]], key=key)
    pair = [rows[0], rows[4], *rows[7:]]
    got = run(corpus_pipeline.repeated_strings, docs.where(F.col("text").isin([t for _, t in pair])).distinct())
    cut = lambda t: t.replace(" " + shared, "")
    assert got == sorted([rows[0], rows[4], *((i, cut(t)) for i, t in rows[7:])], key=key)
    packed = {r["doc_id"] for r in corpus_pipeline.packing(spark, docs, "").collect()}
    assert packed == {1, 2, 3, None}


def test_near_vectors_of_low_rank_share_cells():
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(384, 24)))[0].T
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(8000, 24)) @ basis)
    a = unit(rng.normal(size=(2000, 24)) @ basis)
    z = rng.normal(size=(2000, 24)) @ basis
    z = unit(z - (z * a).sum(1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(0.19) * z
    centroids = embeddings.fit(x, 40)
    least = embeddings.MARGIN / np.sqrt(384)
    margin = embeddings.margin_of(x, centroids, 0.9, least)
    need = embeddings.needed(a, b, centroids)
    assert (need <= least).mean() < 0.9 and (need <= margin).mean() > 0.998
