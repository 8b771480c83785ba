import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, components, embeddings, gif, lines, minhash, packing, pieces, queries, suffixes, toxicity, url_filter, verify

DOCS = "doc_id long, text string"
CASES = [(1, None), (2, ""), (3, "a"), (4, "x" * 5000), (5, "one two three four five six " * 60), (5, "one two three four five six " * 60), (6, "Ünïcödé ▁ \t\n\n  </s>" * 20), (None, "no id")]


@pytest.fixture(scope="module")
def cases(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    df = spark.createDataFrame(CASES, DOCS)
    return df.withColumns({"id": F.lit(7), "n": F.lit("n"), "chunk": F.lit(0), "digest": F.lit(None).cast("string"), "score": F.lit(1)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


OPERATORS = {
    "suffixes": lambda d: suffixes.remove_repeats(d),
    "lines": lambda d: lines.line_dedup(d),
    "gif": lambda d: gif.gif_store(d),
    "packing": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "minhash": lambda d: minhash.minhash_groups(d),
    "pieces": lambda d: pieces.sentencepiece(d, public_tokenizers.path("piece_bpe_32k.model")),
    "toxicity": lambda d: toxicity.toxicity(d, d.select("doc_id", F.lit(1).alias("toxic"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(cases, empty, name):
    rows = OPERATORS[name](cases).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, None}
    if name != "packing":
        assert len(rows) == len(CASES)
    assert OPERATORS[name](empty).collect() == []


def brute_repeats(texts, length=200):
    seen: dict = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = t[k : k + length] in seen
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]]:
                gone[k : k + length] = True
        out.append(gone)
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdeé ", k=n))
    base, texts = word(1500), []
    for n in (199, 200, 201, 260, 333, 334, 700):
        for _ in range(3):
            at = rng.randrange(0, 1500 - n)
            texts.append(word(rng.randrange(0, 300)) + base[at : at + n] + word(rng.randrange(0, 300)))
    texts += [base, base, "ab" * 300, "z" * 199, "z" * 200, "y" * 201, word(400)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(df).collect()}
    for i, (t, gone) in enumerate(zip(texts, brute_repeats([t.encode() for t in texts]), strict=True)):
        kept = np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        assert (got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (gone.sum(), spans, kept)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_cover():
    c = suffixes.COVER.tolist()
    assert {(a - b) % suffixes.PERIOD for a in c for b in c} == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("group", [256, 3])
def test_minhash_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(verify, "GROUP", group)
    monkeypatch.setattr(verify, "BLOCK", group)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([2, 9, 80, 200]))
        for _ in range(rng.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} or {tuple(t.split())} for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    ids, roots = components.forest(*(np.array(x) for x in zip(*pairs, strict=True)))
    want = dict(zip(ids.tolist(), roots.tolist(), strict=True))
    got = minhash.minhash_groups(spark.createDataFrame(list(enumerate(texts)), DOCS), words=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), want.get(i, i)) for i, s in enumerate(sets)}


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog and runs away into the deep dark forest today"
    docs = [(1, f"{line}\nshort\n{line.upper()}!"), (2, f"intro of its own\n{line}"), (3, line.replace("today", "todax")), (4, "short\nshort")]
    got = {r["doc_id"]: r for r in lines.line_dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1]["text"] == f"{line}\nshort" and got[2]["text"] == "intro of its own" and got[4]["text"] == "short\nshort"
    near = int(np.bitwise_count(np.bitwise_xor(*lines.simhashes([line, docs[2][1]])))) <= lines.MAX_BITS
    assert (got[3]["text"] == "") == near


@pytest.mark.parametrize("group", [256, 3])
def test_lines_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(verify, "GROUP", group)
    monkeypatch.setattr(verify, "BLOCK", group)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(1, 9))) for _ in range(300)]
    found = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([4, 40, 120]))
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                k = rng.randrange(len(w) - 1)
                w[k], w[k + 1] = w[k + 1], w[k]  # the same SimHash
            if rng.random() < 0.2:
                rng.shuffle(w)
            found.append(" ".join(w))
    rng.shuffle(found)
    docs = [(d, "\n".join(found[d::20])) for d in range(20)]
    first = {}
    for d, text in docs:
        for k, line in enumerate(text.split("\n")):
            if len(line) >= lines.MIN_CHARS:
                first.setdefault(line, (d, k))
    each = list(first)
    h = lines.simhashes(each)
    near = [(i, j) for i in range(len(each)) for j in range(i) if np.bitwise_count(h[i] ^ h[j]) <= lines.MAX_BITS]
    pairs = [(i, j) for i, j in near if _edits(each[i], each[j]) <= int(0.2 * max(len(each[i]), len(each[j])) + 1e-9)]
    assert 0 < len(pairs) < len(near)
    ids, roots = components.forest(*(np.array(x) for x in zip(*pairs, strict=True)))
    root = dict(zip(ids.tolist(), roots.tolist(), strict=True))
    best = {}
    for i, line in enumerate(each):
        r = root.get(i, i)
        best[r] = min(best.get(r, first[line]), first[line])
    stays = {line: best[root.get(i, i)] for i, line in enumerate(each)}
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if stays.get(x, (d, k)) == (d, k)) for d, t in docs}
    got = lines.line_dedup(spark.createDataFrame(docs, DOCS)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("compress", [False, True])
def test_gif_round_trip(compress):
    rng = random.Random(1)
    for n in (1, 2, 7, 400):
        data = bytes(rng.choices(b"abc \xff\x00", k=192 * n))
        frames = list(gif.decode(gif.encode(data, compress=compress)))
        assert b"".join(f.indexes.tobytes() for f in frames) == data and frames[0].delay_ms == 100


def test_gif_disposal_and_transparency():
    import struct

    def frame(left, data, w, flags, index):
        return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, 5, index, 0) + struct.pack("<BHHHHBB", 0x2C, left, 0, w, 1, 0, 2) + gif.blocks(gif.pack(np.array([4, *data, 5]), 2))

    table = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    g = b"GIF89a" + struct.pack("<HHBBB", 3, 1, 0x81, 0, 0) + table + frame(0, [1, 1, 1], 3, 4, 0) + frame(1, [2, 0], 2, 13, 0) + frame(0, [3], 1, 8, 0) + frame(2, [2], 1, 4, 0) + b";"
    shown = [f.canvas[0, :, :3].tolist() for f in gif.decode(g)]
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    assert shown == [[red, red, red], [red, green, red], [blue, red, red], [[0, 0, 0], red, green]]
    with pytest.raises(ValueError):
        list(gif.decode(b"GIF89a" + g[6:40]))


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["Alpha", "beta", "don't", "x<|endoftext|>y", "\x1c", "12", "é", "Σας"], k=rng.choice([0, 3, 90, 3000])))) for i in range(60)]
    rows = packing.pack(spark.createDataFrame(docs, DOCS), public_tokenizers.path("word_bpe_49k.json")).collect()
    for i, text in docs:
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    fill: dict = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())


def test_differencing():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert len(packing.windows([6, 6, 6], 10)) == 3


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1500).astype(np.uint64)
    s = minhash.superminhash(np.concatenate([x[:1000], x[500:]]), np.repeat([0, 1], 1000), 2, 80)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.15


def test_pieces_against_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    ours, theirs = pieces.Pieces(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    texts = ["", " ", "   a  b ", "▁▁a", "日本語", "ab" * 500, "-" * 300, " " * 200, "\x00", "<s></s>"] + ["".join(rng.choices(" ▁abethin\n-=é日9", k=40)) for _ in range(400)]
    for text, (n, ids, decoded) in zip(texts, ours.encode(texts), strict=True):
        want = theirs.encode(text)
        assert (n, ids, decoded.decode()) == (len(want), ",".join(map(str, want)), theirs.decode(want))


def test_chat(spark):
    said = r"</s>[INST] ok [/INST] \ [\INST] <\s>"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 1, "assistant", None), (2, 0, "assistant", "x"), (3, 0, None, "[")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", said), ("assistant", said)] and got[1]["loss_text"] == said and got[1]["valid"]
    assert got[2]["error_turn"] == 0 and got[2]["loss_text"] == "x" and not got[3]["valid"]
    assert chat.chat_digests(df.limit(0)).collect() == []


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 16))
    near = x[:60] + rng.normal(size=(60, 16)) * rng.choice([0, 0.05, 0.15], (60, 1))
    vectors = [v.tolist() for v in np.concatenate([x, near])] + [[0.0] * 16, [float("nan")] * 16, [None] * 16, None, [1.0, 2.0]]
    got = embeddings.embedding_near_dedup(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    y = np.concatenate([x, near])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(y @ y.T >= 0.9, 1))
    ids, roots = components.forest(a, b)
    want = dict(zip(ids.tolist(), roots.tolist(), strict=True))
    links = np.bincount(np.concatenate([a, b]), minlength=len(vectors))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (links[i], want.get(i, i)) for i in range(len(vectors))}


def test_url_filter(spark, tmp_path):
    urls = ["http://a.com/x", "http://WWW.Example.com/en/1?q", "http://example.com/en/", "http://b.net/es", "http://b.net/es/1#x", "x", None, "ftp://com"]
    got = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [
        ("a.com", "/x", "com/", "allow"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"),
        ("b.net", "/es", None, "allow"), ("b.net", "/es/1", "net/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "", None, "allow"),
    ]
    same = lambda key: 5  # noqa: E731  all keys collide
    path = os.path.join(tmp_path, "i")
    url_filter.build_index(queries.RULES, path, same)
    assert url_filter.Index(path, same).judge(urls[:5], "allow")[2] == ["com/", "www.example.com/en/", "example.com/en/", None, "net/es/"]


def test_toxicity_held_out(spark):
    out = queries.op5_nearest_examples(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    n = out.groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in n}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.85


def test_nearest_is_exact():
    rng = np.random.default_rng(0)
    v = rng.random((500, 20)) * (rng.random((500, 20)) < 0.3)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    m = toxicity.Model({}, np.ones(20), v, np.zeros(500), np.arange(500), np.ones(500), np.maximum.reduceat(v, np.arange(0, 500, toxicity.BLOCK)).T, np.array([-np.inf]), np.zeros(1), 0.0)
    for _ in range(50):
        q = rng.random(20) * (rng.random(20) < 0.3)
        at = np.flatnonzero(q)
        if len(at):
            s = v[:, at] @ q[at]
            want = sorted(((float(x), i) for i, x in enumerate(s) if x > 0), key=lambda p: (-p[0], p[1]))[:15]
            assert [i for _, i in m.nearest(at, q[at], 15)] == [i for _, i in want]


def test_edit_bound_and_ascii_lines():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(14))) for _ in range(2))
        if rng.random() < 0.5:
            k = rng.randrange(len(a) + 1)
            b = a[:k] + rng.choice(["", "x", " y "]) + a[k + rng.randrange(3) :]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        most = rng.randrange(6)
        assert lines.within(a, b, most) == (row[-1] <= most)
        line = "".join(chr(rng.randrange(128)) for _ in range(40))
        assert lines.normalised(line) == lines.normalised(line + " ")
