"""Empty tables through every stage, very long inputs through op7, op8 and op10."""

import hashlib
import random

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import chat, embeddings, url_filter

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == [], name
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_long_turns(spark):
    text = "</s>[INST] \\ é " * 60_000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (2, 0, "assistant", "x")]
    got = {r["conv_id"]: r for r in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit("clash"))).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[1]["loss_chars"] == len(text) and got[1]["valid"] and got[1]["error_turn"] is None
    assert not got[2]["valid"] and got[2]["error_turn"] == 0


def test_long_urls(spark):
    rules = [("net", "/a", "block"), ("net", "/" + "b" * 5000, "allow")]
    urls = ["http://x.net/" + "a" * 300_000, "http://" + "s." * 20_000 + "net/a", "http://x.net/" + "b" * 5000 + "?" + "q" * 300_000, "http://x.net/" + "b" * 4999]
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got == {0: ("block", "net/a"), 1: ("block", "net/a"), 2: ("allow", "net/" + "b" * 5000), 3: ("allow", None)}


def test_long_vectors(spark):
    rng = random.Random(1)
    v = [rng.gauss(0, 1) for _ in range(20_000)]
    rows = [(1, v), (2, [x + 0.01 for x in v]), (3, [-x for x in v]), (4, v[:100]), (5, [])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}
