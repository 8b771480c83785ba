"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

fit() takes a bounded sample of labelled rows (EXAMPLES of either label).  Its terms are
all words of theirs: none is dropped.  A text's vector over them is (1 + ln tf) * idf *
information, scaled to length one: idf counts all documents, and a term's information
is how far its share of label 1 among the examples that hold it strays from the share of
all (their number times the Kullback-Leibler divergence), without which common words
outweigh the few that tell.  score() finds the NEAREST examples by cosine in an inverted
index: postings lie by term and block of BLOCK examples, each with its largest weight;
those of terms that one in OFTEN examples holds are full columns, multiplied for many
texts at once.  The FIRST blocks by upper bound are read, then all whose bound reaches
the similarity found, so that the result is exact.  Votes are weighted by similarity and by how thinly
a label was sampled; an isotonic curve through the examples' own scores, each without
itself, makes them probabilities.

Nulls and texts without a known term have no neighbour: they get the share of
label 1 among such examples.  Without labels every score is 0.  Labels are read by
document: the larger one where they repeat.  Only the text enters a score.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EXAMPLES, NEAREST, BLOCK, FIRST, OFTEN, TEXTS, PIECE = 2000, 15, 64, 4, 8, 64, 1 << 20
_TERM = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\W\d_]")


def words(text: str | None) -> Iterator[list[str]]:
    """The lower-case words of a text, of about PIECE signs at a time."""
    text, at = text or "", 0
    while len(text) - at > PIECE:
        cut = _BREAK.search(text, at + PIECE)
        if not cut:
            break
        yield _TERM.findall(text[at : cut.start()].lower())
        at = cut.start()
    yield _TERM.findall(text[at:].lower())


def counts_of(text: str | None) -> Counter:
    found: Counter = Counter()
    for part in words(text):
        found.update(part)
    return found


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, stop), one after the other."""
    n = stop - start
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - n), n)


@dataclass
class Model:
    terms: dict
    weight: np.ndarray  # idf times information of each term
    vectors: object  # of the examples, blocks in order: pairs (places, weights), or a matrix
    labels: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    bounds: object  # made from the vectors: largest weights, blocks, and first and last posting of each term and block
    steps: np.ndarray  # raw scores where the calibrated value changes
    values: np.ndarray
    blank: float

    def __post_init__(self):
        if isinstance(self.vectors, np.ndarray):
            self.vectors = [(np.flatnonzero(v), v[v != 0]) for v in self.vectors]
        sizes = [len(at) for at, _ in self.vectors]
        term = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in self.vectors)]).astype(np.int64)
        x = np.concatenate([np.zeros(0), *(x for _, x in self.vectors)])
        example = np.repeat(np.arange(len(sizes)), sizes)
        often = np.bincount(term, minlength=len(self.weight)) * OFTEN >= max(len(sizes), 1)
        self.column = np.where(often, np.cumsum(often) - 1, -1)  # of each term, -1 for those with postings
        self.columns = np.zeros((int(often.sum()), len(sizes)))
        full = often[term]
        self.columns[self.column[term[full]], example[full]] = x[full]
        term, x, example = term[~full], x[~full], example[~full]
        order = np.lexsort((example, term))
        self.example, self.x, term = example[order], x[order], term[order]
        cell = np.ones(len(term), bool)
        cell[1:] = (term[1:] != term[:-1]) | (self.example[1:] // BLOCK != self.example[:-1] // BLOCK)
        start = np.flatnonzero(cell)
        most = np.maximum.reduceat(self.x, start) if len(start) else self.x
        self.bounds = most, self.example[start] // BLOCK, start, np.append(start[1:], len(term)).astype(np.int64)
        self.first = np.searchsorted(term[start], np.arange(len(self.weight) + 1))  # cells of each term
        self.starts = np.arange(0, len(sizes), BLOCK)

    def __reduce__(self):  # the index is made anew where the model arrives
        sizes = np.array([len(at) for at, _ in self.vectors], np.int64)
        at = np.concatenate([np.zeros(0, np.int32), *(at for at, _ in self.vectors)]).astype(np.int32)
        x = np.concatenate([np.zeros(0), *(x for _, x in self.vectors)])
        return _model, ("\n".join(self.terms), self.weight, sizes, at, x, self.labels, self.ids, self.weights, self.steps, self.values, self.blank)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of the text's known terms."""
        return self.unit(counts_of(text).items())

    def unit(self, counts) -> tuple[np.ndarray, np.ndarray]:
        get = self.terms.get
        known = [(i, n) for i, n in ((get(w), n) for w, n in counts) if i is not None]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        at, n = np.array(known, np.int64).T
        order = np.argsort(at)
        at, x = at[order], (1 + np.log(n[order])) * self.weight[at[order]]
        at, x = at[x > 0], x[x > 0]
        return at, x / np.sqrt((x * x).sum()) if len(at) else x

    def base(self, vectors) -> np.ndarray:
        """What the full columns give each of the vectors, one row each."""
        dense = np.zeros((len(vectors), len(self.columns)))
        for row, (at, x) in zip(dense, vectors, strict=True):
            place = self.column[at]
            row[place[place >= 0]] = x[place >= 0]
        return dense @ self.columns

    def nearest(self, at: np.ndarray, x: np.ndarray, k: int, skip: int = -1, base: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k most similar examples of positive cosine; ties go to the earlier one."""
        if not len(self.vectors):
            return []
        similar = self.base([(at, x)])[0] if base is None else base
        most, block, start, stop = self.bounds
        n = self.first[at + 1] - self.first[at]
        cells, own = _ranges(self.first[at], self.first[at + 1]), np.repeat(x, n)
        in_block = block[cells]
        bound = np.maximum.reduceat(similar, self.starts) + np.bincount(in_block, most[cells] * own, len(self.starts))
        order = np.argsort(-bound, kind="stable")
        state = np.full(len(bound), -1)

        def read(chosen: np.ndarray) -> list[tuple[float, int]]:
            """The best of the blocks chosen so far."""
            state[chosen] = 1
            inside = state[in_block] == 1
            c = cells[inside]
            size = stop[c] - start[c]
            p = _ranges(start[c], stop[c])
            similar[:] += np.bincount(self.example[p], self.x[p] * np.repeat(own[inside], size), len(similar))
            state[chosen] = 0
            if skip >= 0:
                similar[skip] = 0
            seen = np.where(np.repeat(state == 0, BLOCK)[: len(similar)], similar, 0)
            found = np.flatnonzero(seen > 0)
            if len(found) > k:
                found = found[seen[found] >= np.partition(seen[found], len(found) - k)[len(found) - k]]
            return found[np.argsort(-seen[found], kind="stable")][:k]

        found = read(order[:FIRST])
        floor = similar[found[-1]] if len(found) == k else 0.0
        more = order[FIRST:]
        more = more[bound[more] >= floor - 1e-12]
        if len(more):
            found = read(more)
        return [(float(similar[i]), int(i)) for i in found]

    def votes(self, found: list[tuple[float, int]]) -> float:
        w = [(s / (1.01 - min(s, 1.0)) * self.weights[i], self.labels[i]) for s, i in found]
        return sum(a for a, y in w if y) / sum(a for a, _ in w)

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        return next(self.scores([text]))

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """Score and nearest examples of each text."""
        for s in range(0, len(texts), TEXTS):
            vectors = [self.vector(t) for t in texts[s : s + TEXTS]]
            base = self.base(vectors)
            for (at, x), row in zip(vectors, base, strict=True):
                found = self.nearest(at, x, NEAREST, base=row) if len(at) else []
                yield (float(self.values[np.searchsorted(self.steps, self.votes(found), "right") - 1]), found) if found else (self.blank, [])


def _model(terms, weight, sizes, at, x, labels, ids, weights, steps, values, blank) -> Model:
    cuts = np.cumsum(sizes)[:-1]
    vectors = list(zip(np.split(at.astype(np.int64), cuts), np.split(x, cuts), strict=True)) if len(sizes) else []
    return Model({w: i for i, w in enumerate(terms.split("\n"))} if terms else {}, weight, vectors, labels, ids, weights, None, steps, values, blank)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step function by pooling neighbours; a little of the mean keeps values inside (0, 1)."""
    steps, values = [-math.inf], []
    mean = float((y * w).sum() / w.sum())
    pools: list[list[float]] = []
    for v in np.unique(x):
        at = x == v
        pools.append([float(v), float((y[at] * w[at]).sum()), float(w[at].sum())])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    for v, a, b in pools:
        steps.append(v)
        values.append((a + mean) / (b + 1))
    return np.array([steps[0], *steps[2:]]), np.array(values)


def _examples(batches):
    import pyarrow as pa

    for b in batches:
        got = [sorted(counts_of(t).items()) for t in b.column("text").to_pylist()]
        cols = [b.column("id"), b.column("toxic"), pa.array([[w for w, _ in g] for g in got], pa.list_(pa.string())), pa.array([[n for _, n in g] for g in got], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "toxic", "words", "counts"])


def _frequencies(terms):
    """In how many texts each term occurs, and as the last one the number of texts."""

    def run(batches):
        import pyarrow as pa

        known = terms.value
        n = np.zeros(len(known) + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                n[-1] += 1
                found: set[str] = set()
                for part in words(t):
                    found.update(part)
                n[[known[w] for w in found if w in known]] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    return run


def _own_scores(shared):
    """Raw score of each example by the others, its terms weighted by these alone; none for those without neighbours."""

    def run(batches):
        import pyarrow as pa

        m, c, t, share = shared.value
        for b in batches:
            at, raw = b.column(0).to_pylist(), []
            for i in at:
                term, x = m.vectors[i]
                x = x * information(c[term] - 1, t[term] - m.labels[i], share) / information(c[term], t[term], share)
                term, x = term[x > 0], x[x > 0]
                found = m.nearest(term, x / np.sqrt((x * x).sum()), NEAREST, skip=i) if len(x) else []
                raw.append(m.votes(found) if found else None)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw, pa.float64())], names=["at", "raw"])

    return run


def information(c: np.ndarray, t: np.ndarray, share: float) -> np.ndarray:
    """Of terms in c examples, t of them with label 1: c times the divergence of t / c from the share."""
    q = t / np.maximum(c, 1)
    part = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-300) / max(b, 1e-9)), 0.0)
    return np.maximum(c * (part(q, share) + part(1 - q, 1 - share)), 0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """docs: all documents; labels: (key, label) of the rows to learn from."""
    spark = docs.sparkSession
    common.ship(spark)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.col(label).cast("long")).alias("toxic"))
    known = common.stored(known.join(texts.select("id"), "id", "left_semi"), "labels")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().where("toxic IN (0, 1)").collect()}
    share = {y: min(1.0, EXAMPLES / n) for y, n in totals.items()}
    one = 1 << 30
    limit = F.when(F.col("toxic") == 1, int(share.get(1, 0) * one)).when(F.col("toxic") == 0, int(share.get(0, 0) * one)).otherwise(0)
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(one)) < limit).limit(4 * EXAMPLES)
    sample = texts.join(F.broadcast(chosen), "id")  # at most 4 * EXAMPLES ids
    rows = sample.mapInArrow(common.tidy(_examples), "id long, toxic long, words array<string>, counts array<long>").toArrow().to_pylist()
    empty = np.zeros(0)
    model = Model({}, empty, [], empty, empty, empty, None, np.array([-math.inf]), np.array([0.0]), 0.0)
    if not rows:
        return model
    terms = {w: i for i, w in enumerate(sorted({w for r in rows for w in r["words"]}))}
    c, t = np.zeros(len(terms)), np.zeros(len(terms))
    for r in rows:
        at = [terms[w] for w in r["words"]]
        c[at] += 1
        t[at] += r["toxic"]
    shared = spark.sparkContext.broadcast(terms)
    found = texts.select("text").mapInArrow(common.tidy(_frequencies(shared)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    df = np.zeros(len(terms) + 1)
    df[found.column("at").to_numpy()] = found.column("n").to_numpy()
    ones = sum(r["toxic"] for r in rows)
    sides = {1: ones, 0: len(rows) - ones}
    weight = {y: totals[y] / n for y, n in sides.items() if n}
    prior = totals.get(1, 0) / sum(totals.values())
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    model = Model(terms, idf * information(c, t, ones / len(rows)), [], empty, empty, empty, None, model.steps, model.values, 0.0)
    made = [(r, model.unit(zip(r["words"], r["counts"], strict=True))) for r in rows]
    blank = [r for r, v in made if not len(v[0])]
    model.blank = (sum(weight[r["toxic"]] * r["toxic"] for r in blank) + prior) / (sum(weight[r["toxic"]] for r in blank) + 1)
    # Like examples side by side make tight bounds.
    made = sorted(((r, v) for r, v in made if len(v[0])), key=lambda p: (int(p[1][0][np.argmax(p[1][1])]), p[0]["toxic"], p[0]["id"]))
    if not made:
        return model
    y = np.array([r["toxic"] for r, _ in made])
    model = Model(terms, model.weight, [v for _, v in made], y, np.array([r["id"] for r, _ in made]), np.array([weight[v] for v in y.tolist()]), None, model.steps, model.values, model.blank)
    shared = spark.sparkContext.broadcast((model, c, t, ones / len(rows)))
    own = spark.range(len(made)).mapInArrow(common.tidy(_own_scores(shared)), "at long, raw double").where("raw IS NOT NULL").toArrow()
    shared.unpersist()
    if own.num_rows:
        at, raw = own.column("at").to_numpy(), own.column("raw").to_numpy()
        order = np.argsort(at)
        model.steps, model.values = isotonic(raw[order], y[at[order]].astype(float), model.weights[at[order]])
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", evidence: bool = True) -> DataFrame:
    """key, score and, if asked for, evidence: ids, labels and similarities of the nearest examples."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by EXAMPLES and their texts
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, score double" + ", evidence array<struct<doc_id:long,label:long,similarity:double>>" * evidence

    def run(batches):
        import pyarrow as pa

        m = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int64()), ("similarity", pa.float64())]))
        for b in batches:
            got = list(m.scores(b.column(text).to_pylist()))
            cols = [b.column(key), pa.array([g[0] for g in got], pa.float64())]
            if evidence:
                cols.append(pa.array([[{"doc_id": int(m.ids[i]), "label": int(m.labels[i]), "similarity": s} for s, i in g[1][:3]] for g in got], kind))
            yield pa.RecordBatch.from_arrays(cols, names=[key, "score", "evidence"][: len(cols)])

    return docs.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(common.tidy(run), schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, evidence: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted (and evidence) of every document; learnt from labels that are not held out."""
    model = fit(docs, labels.where(~held_out()))
    out = score(docs, model, evidence=evidence)
    return out.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= 0.3).cast("int")}).select("doc_id", "held_out", "score", "predicted", *["evidence"] * evidence)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs with a lower score, columns as they are."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            yield b.filter(pa.array([x < threshold for x, _ in m.scores(b.column(text).to_pylist())], pa.bool_()))

    return docs.mapInArrow(common.tidy(run), docs.schema)
