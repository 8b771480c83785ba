"""The store of events and cells: batches, compaction, specifications, retention."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells, routes
from tidemark.plans import bridge
from tidemark.sources import traffic
from tidemark.streaming import ingest
from tidemark.streaming.store import Store, changed_operations

SF = "/root/testdata/sf0.001"
OPS = [("GET", "/items/{id}"), ("GET", "/items/featured"), ("GET", "/items/{id}/clicks"), ("POST", "/orders"), ("POST", "/users")]
BASES = ["/v1"]


@pytest.fixture(scope="module")
def events(spark):
    """Events of five days: a folder has a file for each kind and day."""
    days = ["2024-01-03", "2024-01-07", "2024-01-08", "2024-01-15", "2024-01-16"]
    return bridge.traffic(spark, SF).where(F.to_date("ts").isin([date.fromisoformat(d) for d in days])).cache()


def mark(df):
    return cells.fingerprint(df).first()


def whole(events, r):
    return mark(cells.build_cells(routes.resolve(events, r)))


def test_batches_and_compaction(spark, events, tmp_path, monkeypatch):
    r = routes.build_routes(OPS, BASES)
    store = Store(spark, str(tmp_path), r)
    assert store.cells().isEmpty() and not store.retain(date(2024, 1, 1))
    for k in range(3):
        store.append(events.where(f"event_id % 3 = {k}"), f"batch-{k}")
    want = whole(events, r)
    assert mark(store.cells()) == want
    store.append(events.where("event_id % 3 = 1"), "batch-1")  # runs again
    assert mark(store.cells()) == want
    before = store.cells()  # a reader that began earlier
    with monkeypatch.context() as m:  # fails before its commit
        m.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.compact()
    assert mark(store.cells()) == want
    store.compact()
    assert mark(before) == want and mark(store.cells()) == want and len(store.manifest()["cells"]) == 1
    store.append(events.where("event_id % 3 = 2"), "batch-2")  # merged already
    assert mark(store.cells()) == want
    gone = store.sweep()
    assert len(gone) == 8 and mark(store.cells()) == want and store.sweep() == []
    plan = store.cells().where("kind = 'CALL' AND day >= DATE'2024-01-05'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "PartitionFilters: [isnotnull(kind" in plan and "day#" in plan[plan.index("PartitionFilters") :]


@pytest.mark.parametrize(
    ("ops", "touched"),
    [
        ([("GET", "/items/{id}"), *OPS[2:], ("GET", "/internal/{n}")], {"GET /items/featured", "GET /items/{id}"}),  # an operation less, unmatched events found
        ([*OPS[:3], ("POST", "/orders"), ("POST", "/{kind}")], {"POST /users", "POST /orders"}),
        ([*OPS, ("GET", "/items/7")], {"GET /items/{id}", "GET /items/featured"}),
        (OPS[::-1], set()),
    ],
)
def test_specification_change(spark, events, tmp_path, ops, touched):
    old, new = routes.build_routes(OPS, BASES), routes.build_routes(ops, BASES)
    assert changed_operations(old, new) - {"GET /items/featured"} == touched - {"GET /items/featured"}
    store = Store(spark, str(tmp_path), old)
    for k in range(2):
        store.append(events.where(f"event_id % 2 = {k}"), f"batch-{k}")
    again = store.affected(sorted(changed_operations(old, new))).count()
    resolved = routes.resolve(events, old)
    assert again == resolved.where(F.col("op_key").isNull() | F.col("op_key").isin(sorted(changed_operations(old, new)))).count() < events.count()
    other = store.under(new)
    assert mark(other.cells()) == whole(events, new) == mark(ingest.replay(spark, str(tmp_path), old, new))
    assert mark(store.cells()) == whole(events, old)  # the old line stays
    other.compact()
    assert mark(other.cells()) == whole(events, new)
    assert mark(store.under(new).cells()) == whole(events, new)
    third = routes.build_routes(OPS[:1], BASES)  # a change of the changed one
    assert mark(other.under(third).cells()) == whole(events, third)


def test_stream_with_an_advancing_clock(spark, events, tmp_path):
    """Days leave as the clock goes on; a batch in which none does commits nothing for it."""
    r = routes.build_routes(OPS, BASES)
    lines = traffic.to_lines(events).select("value", F.to_date("ts").alias("day"))
    cuts = ["2024-01-08", "2024-01-09", "2024-01-20"]
    root, clock = str(tmp_path / "store"), []
    spans = [("2000-01-01", cuts[0]), (cuts[0], cuts[1]), (cuts[1], "2100-01-01")]
    for k, (first, last) in enumerate(spans):
        lines.where(f"day >= DATE'{first}' AND day < DATE'{last}'").select("value").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        clock.append(date.fromisoformat(cuts[k]))
        ingest.ingest(spark, str(tmp_path / "in"), root, r, retain_days=7, compact_after=1, today=lambda: clock[-1]).trigger(availableNow=True).start().awaitTermination()
        limit = {0: "2024-01-01", 1: "2024-01-02", 2: "2024-01-13"}[k]
        kept = events.where(F.to_date("ts").between(F.lit(limit).cast("date"), F.date_sub(F.lit(last).cast("date"), 1)))
        assert mark(ingest.live_cells(spark, root, r)) == whole(kept, r)
    store = Store(spark, root, r)
    number = store.manifest()["number"]
    assert not store.retain(date(2024, 1, 13)) and store.manifest()["number"] == number
    store.compact()
    store.sweep()
    assert store.log().agg(F.min("day")).first()[0] >= date(2024, 1, 13) and not list((tmp_path / "store" / "cells").glob("*/*/day=2024-01-0*"))


def test_rejected_lines_are_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('no\n{"v":1,"ts":"2024-01-01T00:00:00Z","method":"get","path":"/items/7","status":200}\n')
    r = routes.build_routes(OPS)
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), r).trigger(availableNow=True).start().awaitTermination()
    assert [x["rejected"] for x in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()] == ["not JSON"]
    assert [x["op_key"] for x in Store(spark, str(tmp_path / "out"), r).log().collect()] == ["GET /items/{id}"]
