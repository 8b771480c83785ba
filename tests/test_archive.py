"""Archives read by ranges of bytes against the same archives read whole."""

import json
import random

from pyspark.sql import functions as F
from tidemark.sources import archive
from tidemark.sources import traffic as T

SIGNS = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", "x", '"entries":[{', '\\"', '"log"', "\U0001f600"]


def made(rng: random.Random, entries: int) -> str:
    """An archive with strings full of brackets and quotes, in any order of keys, with other lists of objects beside its entries."""
    word = lambda: "".join(rng.choice(SIGNS) for _ in range(rng.randrange(8)))
    mixed = lambda d: dict(rng.sample(list(d.items()), len(d)))

    def entry(i):
        body = {"mimeType": word(), "text": json.dumps({word(): [word(), {"entries": [{}]}]})}
        request = {"method": "GET", "url": f"http://a/{i}?{word()}", "headers": [{"name": "n" + word(), "value": word()}], "postData": body}
        return mixed({"startedDateTime": "2026-01-01T00:00:00Z", "time": i, "request": request, "response": {"status": 200, "content": {"text": word() * rng.choice([1, 40])}}, "more": {"entries": [{"a": [{}]}]}})

    pages = [{"startedDateTime": "2026-01-01T00:00:00Z", "id": word()} for _ in range(2)]
    log = mixed({"creator": {"name": word(), "entries": [{"x": {}}]}, "pages": pages, "entries": [entry(i) for i in range(entries)], "comment": word()})
    return json.dumps(mixed({"log": log, "other": {"entries": [{"request": {}}]}}), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))


def rows(df):
    return sorted(map(str, df.select([F.col(c) if c != "headers" else F.map_entries("headers").alias(c) for c in df.columns]).collect()))


def test_ranges(spark, tmp_path):
    rng = random.Random(5)
    (tmp_path / "har").mkdir()
    texts = [made(rng, n) for n in (0, 1, 9, 30)] + ["", made(rng, 3) + "\n" + made(rng, 4)]
    for i, text in enumerate(texts):
        (tmp_path / "har" / f"{i}.har").write_text(text, encoding="utf-8")
    apart = [*texts[:4], *[t for t in _documents(texts[5])]]
    expected = rows(T.har_entries(spark.createDataFrame([(t,) for t in apart], "value string")))
    assert len(expected) == 47
    for chunk in (37, 500, 1 << 20):
        assert rows(archive.read_har(spark, str(tmp_path / "har"), chunk)) == expected, chunk


def _documents(text):
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        _, end = decoder.raw_decode(text, at)
        yield text[at:end]
        at = end + 1


def test_cut_between_tasks(spark, tmp_path):
    """One large archive goes to many tasks, none of which reads more than its range and its last entry."""
    (tmp_path / "one.har").write_text(made(random.Random(6), 400), encoding="utf-8")
    size = (tmp_path / "one.har").stat().st_size
    found = archive.entries(spark, str(tmp_path / "one.har"), size // 10)
    tasks = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum(F.octet_length("entry")).alias("bytes")).collect()
    assert sum(t.n for t in tasks) == 400 and len(tasks) >= 9 and max(t.bytes for t in tasks) < size / 5
    assert [r.place for r in found.orderBy("place").collect()] == sorted({r.place for r in found.collect()})


def test_pushed_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.har").write_text(made(random.Random(i), 5), encoding="utf-8")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = archive.entries(spark, str(tmp_path), 1 << 20)
        assert found.rdd.getNumPartitions() == 3
        one = found.where(F.col("file") == found.select("file").orderBy("file").first()[0])
        assert one.rdd.getNumPartitions() == 1 and one.count() == 5
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_none(spark, tmp_path):
    (tmp_path / "empty.har").write_text("")
    assert archive.read_har(spark, str(tmp_path)).count() == 0
    (tmp_path / "broken.har").write_text(made(random.Random(8), 20)[:3000], encoding="utf-8")
    assert 0 < archive.read_har(spark, str(tmp_path), 100).count() < 20
