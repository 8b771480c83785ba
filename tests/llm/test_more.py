"""Whole queries and odd rows: brute force, hashes of the standard library, long texts, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, edits, embeddings, gif, lines, minhash, packing, pieces, queries, suffixes, toxicity, url_filter

DOCS = "doc_id long, text string"


def syllables(rng, n):
    return " ".join("".join(rng.choices(["an", "to", "ri", "se", "lo", "mi"], k=rng.randrange(1, 4))) for _ in range(n))


def test_gif_query(spark, tmp_path):
    rng = random.Random(6)
    docs = [(1, syllables(rng, 3000)), (2, None), (3, ""), (4, "é日" * 500), (5, syllables(rng, 30000)), (5, "twice"), (None, "no id"), (6, "".join(map(chr, range(1, 200))))]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter()
    for r in queries.op3_gif(spark, str(tmp_path)).collect():
        got[r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]] += 1
        if r["n_bytes"] > 10_000:
            assert r["media_bytes"] < 0.6 * r["payload_bytes"]  # codes of one sign alone could not
    want = Counter()
    for i, t in docs:
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert got == want
    stored = gif.gif_store(spark.createDataFrame(docs, DOCS).withColumn("frame", F.lit(1)))
    assert all(r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"]) for r in stored.collect())
    frames = gif.gif_frames(stored.where("doc_id = 5").limit(2)).orderBy(F.desc("frame")).collect()
    assert {(f["width"], f["delay_ms"]) for f in frames} == {(192, 100)} and frames[0]["at_ms"] == 100 * frames[0]["frame"]
    assert all(sum(f["histogram"]) == len(f["samples"]) == f["width"] * f["height"] for f in frames)
    assert gif.gif_frames(stored.limit(0)).collect() == []


def brute_scores(texts, labels, k=15):
    """Similarities of each text to all examples, by dictionaries."""
    counts = {i: Counter(toxicity._TERM.findall((t or "").lower())) for i, t in texts.items()}
    df = Counter(w for c in counts.values() for w in c)
    share = sum(labels.values()) / len(labels)
    held, toxic = Counter(w for i in labels for w in counts[i]), Counter(w for i in labels if labels[i] for w in counts[i])

    def weight(w):
        q, out = toxic[w] / held[w], 0.0
        for a, b in ((q, share), (1 - q, 1 - share)):
            out += a * math.log(a / b) if a else 0
        return (math.log((1 + len(texts)) / (1 + df[w])) + 1) * held[w] * max(out, 0)

    def vector(i):
        v = {w: (1 + math.log(n)) * weight(w) for w, n in counts[i].items() if held[w]}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items() if x} if norm else {}

    vectors = {i: vector(i) for i in texts}
    return {i: sorted(((sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), j) for j in labels), reverse=True)[:k] for i in texts}


def test_scores_by_brute_force(spark):
    rng = random.Random(8)
    texts = {i: syllables(rng, rng.randrange(1, 60)) + (" scum trash" if i % 5 == 0 else "") + (" moron" if i % 7 == 0 else "") for i in range(120)}
    texts |= {200: None, 201: "", 202: "123 456", 203: "unheard"}
    labels = {i: int(i % 5 == 0) for i in range(0, 120, 2)}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic long"))
    assert len(model.terms) == len({w for i in labels for w in toxicity._TERM.findall(texts[i])}) and len(model.column[model.column >= 0]) and (model.column < 0).any()
    want = brute_scores(texts, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i, row in got.items():
        near = [(round(s, 9), j) for s, j in want[i] if s > 1e-12][:3]
        assert [round(e["similarity"], 9) for e in row["evidence"]] == [s for s, _ in near]
        assert all(e["label"] == labels[e["doc_id"]] for e in row["evidence"]) and 0 <= row["score"] <= 1
    assert {got[i]["score"] for i in (200, 201, 202, 203)} == {model.blank}
    scores = [(got[i]["score"], i) for i in range(1, 120, 2)]
    assert {i for s, i in scores if s >= 0.3} == {i for i in range(1, 120, 2) if i % 5 == 0}
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("x")), model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["score"] < 0.3} and kept.columns == ["doc_id", "text", "score"]
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic long"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_edits_of_many_pairs():
    rng = random.Random(3)
    pairs, most, want = [], [], []
    for _ in range(900):
        a = "".join(rng.choices("abcé 日", k=rng.choice([1, 20, 63, 64, 65, 130, 200])))
        b = list(a)
        for _ in range(rng.randrange(0, len(a) // 3 + 2)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "z", "ab"])
        b = "".join(b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        pairs.append((a, b))
        most.append(rng.randrange(len(a) // 3 + 2))
        want.append(row[-1] <= most[-1])
    for likely in (None, np.ones(len(pairs), bool)):
        assert edits.within(pairs, np.array(most), likely).tolist() == want
    assert 0.2 < np.mean(want) < 0.9 and edits.within([], np.zeros(0)).tolist() == []


def test_lines_keep_digits_and_limit(spark):
    docs = [(1, "2023 10 11 12 13"), (2, "1987 65 43 21 09"), (3, "too short"), (4, "too short"), (5, "2023 10 11 12 13")]
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: docs[0][1], 2: docs[1][1], 3: "too short", 4: "too short", 5: ""}
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(spark.createDataFrame(docs, DOCS), least=5).collect()}
    assert got[3] == "too short" and got[4] == ""


def test_words_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words, t = packing.Words(path), Tokenizer.from_file(path)
    rng = random.Random(9)
    texts = ["a\0b c", "x <|endoftext|> y", "<|ENDOFTEXT|>a", "é é ", "Σας ΣΑΣ σ İ", "a\x1cc\x85d", "'s't it's I'LL", "１２ ²½ 12³", "ÀÉÎÕÜ ß ÿ þ", "", " ", "aaaaaaaaaaaa" * 30]
    texts += ["".join(rng.choices("abcdeéßÀ'.,!12 \n\t日", k=60)) for _ in range(300)]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_windows_are_near_equal(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, syllables(rng, rng.randrange(1, 400))) for i in range(200)], DOCS).coalesce(1)
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).where("window_id IS NOT NULL").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["window_id"]] += r["length"]
    full = sorted(sizes.values())[1:]
    assert max(full) <= 2048 and max(full) - min(full) < 200


LONG = "many words of one very long text " * 100_000


@pytest.mark.parametrize("name", ["minhash", "packing", "gif", "toxicity", "suffixes", "lines", "pieces"])
def test_very_long_text(spark, name):
    docs = spark.createDataFrame([(1, LONG), (2, "short one here"), (3, "x" * 1_000_000)], DOCS)
    run = {
        "minhash": lambda: minhash.minhash_groups(docs, words=3, percent=85), "packing": lambda: packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False),
        "gif": lambda: gif.gif_store(docs, media=False), "toxicity": lambda: toxicity.toxicity(docs, docs.select("doc_id", F.lit(1).alias("toxic"))),
        "suffixes": lambda: suffixes.remove_repeats(docs, with_text=False), "lines": lambda: lines.line_dedup(docs), "pieces": lambda: pieces.sentencepiece(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True),
    }
    rows = run[name]().collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3}
    if name == "minhash":
        assert {r["doc_id"]: r["n_shingles"] for r in rows} == {1: 7, 2: 1, 3: 1}


def test_odd_rows_of_the_others(spark):
    clash = {"id": F.lit(1), "n": F.lit("n"), "digest": F.lit(None).cast("string"), "host": F.lit("h"), "rule": F.lit(0), "unit": F.lit(2)}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.1])], "vec_id long, embedding array<double>").withColumns(clash)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.embedding_near_dedup(v).collect())
    assert got == {(1, 1, 1): 2, (2, 0, 2): 1, (None, 0, None): 1}
    assert embeddings.embedding_near_dedup(v.limit(0)).collect() == []
    pages = spark.createDataFrame([(1, "http://a.net/fr/x"), (1, "http://a.net/fr/x"), (None, None)], "page_id long, url string").withColumns({"digest": F.lit(1), "n": F.lit(2)})
    rows = url_filter.url_filter(pages, queries.RULES).select("page_id", "rule", "verdict").collect()
    assert Counter((r[0], r[1], r[2]) for r in rows) == {(1, "net/fr/", "block"): 2, (None, None, "allow"): 1}
    assert url_filter.url_filter(pages.limit(0), queries.RULES).collect() == []
    said = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, None, None)], "conv_id long, turn long, role string, text string").withColumns({"n_turns": F.lit("x"), "id": F.lit(0)})
    got = {r["conv_id"]: r["n_turns"] for r in chat.chat_digests(said).collect()}
    assert got == {1: 2, None: 1}


def test_minhash_with_ids_of_several_texts(spark):
    a, b, c = ("".join(f"{w}{i} " for i in range(60)) for w in "abc")
    docs = [(1, a), (1, b), (2, a + "tail"), (3, b + "tail"), (4, c), (None, c)]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in minhash.minhash_groups(spark.createDataFrame(docs, DOCS), words=3, percent=85).collect()}
    assert {k: v for k, v in got.items() if k[0]} == {(1, 58): 1, (2, 59): 1, (3, 59): 1, (4, 58): 4}


def test_patterned_words_differ():
    """Thue-Morse words, whose sums of values times powers agree modulo 2**64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
        other = word.translate({97: 98, 98: 97})
        a, b = minhash.shingles([word.encode(), other.encode()], 3)
        assert a[0] != b[0]
        hashes = lines.simhashes([word, other])
        assert hashes[0] != hashes[1]
