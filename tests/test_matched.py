"""Rules of changes are held against each shape of cells once, and blast_radius counts the hits once."""

from tidemark.operators import impact
from tidemark.plans import bridge, queries
from tidemark.sources import shared

SF = "/root/testdata/sf0.001"


def test_rules_meet_shapes_and_hits_are_counted_once(spark, monkeypatch):
    """rules were evaluated on every cell of every client and day, once for the ranks and again for the links."""
    cube, seen, real = bridge.cube(spark, SF), {}, shared.stored
    bridge.changes(spark)

    def stored(df, name):
        out = real(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(shared, "stored", stored)
    rows = queries.blast_radius(spark, SF).collect()
    assert rows and len(seen["hits"]) == len(seen["matched"]) == 1
    shapes = cube.where("kind IN ('CALL', 'REQUEST_BODY', 'FIELD', 'TYPE', 'VALUE', 'STATUS')").select(*impact.SHAPE).distinct().count()
    assert 0 < seen["matched"][0] <= shapes * bridge.changes(spark).count() < cube.count() * bridge.changes(spark).count()
