"""Fill-in-middle against a plain version on code points."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tidemark.llm import middles, queries

DOCS = "doc_id long, text string"


def plain(i, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


def texts(rng, n):
    signs = ["\n", "\n", "a", "é", "日", "😀", "\r", " ", "\x85", "<", "S>", " "]
    return ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(n)]


def test_ranked():
    rng = random.Random(1)
    for _ in range(200):
        mask = rng.getrandbits(rng.randrange(1, 300)) | 1 << rng.randrange(300)
        places = [i for i in range(mask.bit_length()) if mask >> i & 1]
        assert [middles.ranked(mask, k) for k in range(len(places))] == places


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (0, 50)])
def test_rows(spark, rate, spm):
    rng = random.Random(2)
    docs = [*enumerate(texts(rng, 300)), (None, "a\nb\nc"), (7, None), (7, "line\n" * 40_000), (8, "x" * 300_000), (9, "held <M> inside\n"), (9, "held <M> inside\n"), (10, "\n" * 5000)]
    got = middles.fill_in_middle(spark.createDataFrame([(i, t, 1, "s") for i, t in docs], DOCS + ", n int, form string"), rate=rate, spm=spm).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *plain(i, t, rate, spm)) for i, t in docs)


def test_query(spark, tmp_path):
    rng = random.Random(3)
    docs = [*enumerate(texts(rng, 200)), (900, None), (901, ""), (902, "one\n" * 9)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = {}
    for i, t in docs:
        *first, out = plain(i, t)
        want[i] = (*first, digest(out), digest(t))
    rows = queries.op13_bit_masks(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) and {r[0]: tuple(r[1:]) for r in rows} == want


def test_empty_table(spark):
    assert middles.fill_in_middle(spark.createDataFrame([], DOCS), digests=True).collect() == []
