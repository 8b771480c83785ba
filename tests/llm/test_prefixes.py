"""Prefix encoding against the tokenizers library and against merging in order of ranks."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import prefixes, queries

DOCS = "doc_id long, text string"
PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = [chr(c) for c in [*range(1, 384), *range(0x300, 0x310), 0x3B1, 0x3A3, 0x130, 0x1E9E, 0x4E2D, 0x1F600, 0x2003, 0x3000, 0xAC00, 0x1100, 0x1161, 0x200D, 0x2028]]


def texts(rng):
    yield from ["", " ", "\n", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> don't", "中文字" * 700, "é" * 3000, "x" * 20_000, "ab" * 3000]
    for letters, n in (("ab", 200), ("etaoins", 400), (SIGNS, 400), ([*"st ré'lmvd'<|>09", "<|endoftext|>"], 300)):
        yield from ("".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(n))


def library(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_query(spark, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    docs = [*enumerate(texts(random.Random(5))), (None, "no id"), (3, None), (4, "again and again"), (4, "again and again"), (5, "plain words, " * 20_000)]
    spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS + ", n_tokens int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for i, t in docs:
        ids, decoded = library(tokenizer, t)
        want[(i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)))] += 1
    assert Counter(tuple(r) for r in queries.op11_prefixes(spark, str(tmp_path)).collect()) == want


def test_ids(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = prefixes.bpe(spark.createDataFrame([(1, "Two words"), (2, None)], DOCS), PATH).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids"], r["decoded"]) for r in rows} == {1: (2, *library(tokenizer, "Two words")), 2: (0, [], "")}
    assert prefixes.bpe(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_any_merges():
    """Merges drawn at random, among them tokens that their own merges never give."""
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    for seed in range(12):
        rng = random.Random(seed)
        end = file["model"]["end_of_word_suffix"]
        vocab = {t: i for i, t in enumerate(x + e for x in prefixes._SIGN.values() for e in ("", end))}
        inner, final, merges = [*"abc"], [x + end for x in "abc"], []
        while len(merges) < 40:
            a, b = rng.choice(inner), rng.choice(inner + final)
            if a + b not in vocab and len(a + b) < 12:
                vocab[a + b] = len(vocab)
                merges.append([a, b])
                (final if b.endswith(end) else inner).append(a + b)
        file["model"] |= {"vocab": vocab, "merges": merges}
        file["added_tokens"] = []
        tokenizer = Tokenizer.from_str(json.dumps(file))
        joins_of = prefixes.Encoder.__new__(prefixes.Encoder)
        joins_of.load(prefixes.tables(file["model"]))
        for _ in range(400):
            word = "".join(rng.choices("abc", k=rng.randrange(1, 25)))
            assert joins_of.merge(word.encode()) == tokenizer.encode(word).ids, (seed, word)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(prefixes, "MEMO", 5)
    monkeypatch.setattr(prefixes, "PAIRS", 5)
    encoder, tokenizer = prefixes.Encoder(PATH, prefixes._arrays(PATH)), Tokenizer.from_file(PATH)
    rng = random.Random(8)
    for _ in range(50):
        text = " ".join("".join(rng.choices("etaoin.", k=5)) for _ in range(9))
        assert encoder.encode(text)[0] == " ".join(map(str, library(tokenizer, text)[0]))
    assert len(encoder.ids) <= 9 and len(encoder.parts) <= 6 and len(encoder.apart) <= 6
