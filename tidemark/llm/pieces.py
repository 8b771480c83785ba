"""SentencePiece BPE by vectorised merge rounds, and decoding.

The normaliser that the model names must be the identity with a dummy prefix and
escaped spaces.  No piece but those of spaces alone holds a space after another
sign, so merges never leave a word: a run of spaces and the signs up to the next.

Words of a batch lie end to end in flat arrays.  Each round finds the best rank
of an adjacent pair in every word and merges it: all its places from the left at
once where no piece that goes on from the merged one is as good, else the first
place alone, which is the library's order exactly.  Words without a pair leave.

A null text is empty and gives no ids.  Words seen before come from a bounded memo.
"""

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from . import common

MEMO = 700_000
SPACE = "▁"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[i] & 127) << shift
        i += 1
        if b[i - 1] < 128:
            return x, i
        shift += 7


def _fields(b: bytes):
    """(number, value) of a protocol buffer's fields."""
    import struct

    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif kind == 5:
            v, i = struct.unpack("<f", b[i : i + 4])[0], i + 4
        else:
            v, i = b[i : i + 8], i + 8
        yield tag >> 3, v


class Pieces:
    #: Kinds of pieces in a model file.
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, model: bytes):
        self.text, self.score, self.kind = [], [], []
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.text.append(f[1].decode())
                self.score.append(f.get(2, 0.0))
                self.kind.append(f.get(3, self.NORMAL))
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2) or f.get(4, 1) or not f.get(3, 1) or not f.get(5, 1):
                    raise ValueError("only the identity normaliser with dummy prefix and escaped spaces is known")
        if self.USER in self.kind or self.UNUSED in self.kind:
            raise ValueError("user-defined and unused pieces are not known")
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == self.NORMAL}
        if any(SPACE in t[1:] and t.strip(SPACE) for t in self.id):
            raise ValueError("a piece holds a space inside")
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == self.BYTE}
        self.unknown = self.kind.index(self.UNKNOWN)
        levels = {s: r for r, s in enumerate(sorted({self.score[i] for i in self.id.values()}, reverse=True))}
        self.rank = {t: levels[self.score[i]] for t, i in self.id.items()}
        #: Signs that pieces hold have symbols even where they are no pieces.
        self.symbol = dict(self.id)
        for t in self.id:
            for c in t:
                self.symbol.setdefault(c, len(self.text) + len(self.symbol))
        pairs, lone = {}, set()
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = t[:k], t[k:]
                if a in self.symbol and b in self.symbol:
                    pairs[self.symbol[a] << 32 | self.symbol[b]] = (r, self.id[t])
                lone.update(x for x in (a, b) if x in self.rank and r <= self.rank[x])
        self.key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.key.tolist()], np.int64)
        self.pair_id = np.array([pairs[k][1] for k in self.key.tolist()], np.int64)
        self.alone = np.zeros(len(levels), bool)  # ranks that merge at one place a round
        self.alone[[self.rank[x] for x in lone]] = True
        tied = np.bincount([self.rank[t] for t in self.rank], minlength=len(levels)) > 1
        self.alone |= tied
        self.name = {v: k for k, v in self.symbol.items()}
        self.memo: dict[str, tuple[int, str, bytes]] = {}

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words are free of spaces but for a run before."""
        signs = "".join(words)
        if not signs:
            return [[] for _ in words]
        points = np.frombuffer(signs.encode("utf-32-le", "surrogatepass"), np.uint32)
        unique, at = np.unique(points, return_inverse=True)
        far = 1 << 30
        table = np.array([self.symbol.get(chr(c), far + int(c)) for c in unique.tolist()], np.int64)
        symbol = table[at]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_words = [], []
        worst = np.int64(1 << 40)
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.where((self.key[found] == key) & (word[1:] == word[:-1]), self.pair_rank[found], worst)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(starts, append=len(word))
            best = np.minimum.reduceat(np.append(rank, worst), starts)
            # The last pair of a segment crosses to the next word and is `worst`.
            live = best < worst
            spread = np.repeat(best, sizes)
            ended = np.repeat(~live, sizes)
            if ended.any():
                done_symbols.append(symbol[ended])
                done_words.append(word[ended])
            hit = np.flatnonzero((rank == spread[:-1]) & (rank < worst))
            if len(hit):
                one = self.alone[rank[hit]]
                first = np.diff(word[hit], prepend=-1) != 0
                hit = hit[~one | first]
                # Places in a row overlap: every second counts, from the left.
                run = np.diff(hit, prepend=-2) != 1
                place = np.arange(len(hit))
                place = place - np.maximum.accumulate(np.where(run, place, 0))
                hit = hit[place % 2 == 0]
                symbol[hit] = self.pair_id[found[hit]]
                gone = np.zeros(len(symbol), bool)
                gone[hit + 1] = True
                stay = ~(gone | ended)
            else:
                stay = ~ended
            symbol, word = symbol[stay], word[stay]
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        symbol, counts = symbol[order], np.bincount(word, minlength=len(words))
        odd = np.flatnonzero(symbol >= len(self.text))
        out = [x.tolist() for x in np.split(symbol, np.cumsum(counts)[:-1])]
        if len(odd):
            owner = set(word[order][odd].tolist())
            for i in owner:
                ids = []
                for s in out[i]:
                    if s < len(self.text):
                        ids.append(s)
                    else:
                        raw = (self.name.get(s) or chr(s - far)).encode("utf-8", "replace")
                        ids += [self.byte[b] for b in raw] if self.byte else [self.unknown]
                out[i] = ids
        return out

    def learn(self, words: list[str]) -> None:
        """Put words into the memo: how many ids, the ids in decimal, the decoded bytes."""
        if len(self.memo) + len(words) > MEMO:
            self.memo.clear()
        for w, ids in zip(words, self.merge([w.replace(" ", SPACE) for w in words]), strict=True):
            self.memo[w] = len(ids), ",".join(map(str, ids)), self.bytes_of(ids)

    @functools.cached_property
    def raw(self) -> list[bytes]:
        """What each id decodes to before the first space goes."""
        out = []
        for t, k in zip(self.text, self.kind, strict=True):
            out.append(bytes([int(t[3:5], 16)]) if k == self.BYTE else b"" if k == self.CONTROL else " ⁇ ".encode() if k == self.UNKNOWN else t.replace(SPACE, " ").encode())
        return out

    def bytes_of(self, ids) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])

    def decode(self, ids) -> str:
        got = self.bytes_of(ids)
        return (got[1:] if got[:1] == b" " else got).decode("utf-8", "replace")

    def encode(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """For each text the number of ids, the ids in decimal, the decoded text's bytes."""
        split = [_WORD.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        out = []
        at = 0
        while at < len(split):  # as many texts at a time as the memo can hold
            new: set[str] = set()
            to = at
            while to < len(split) and (to == at or len(new) < MEMO // 4):
                new.update(w for w in split[to] if w not in self.memo)
                to += 1
            if new:
                if len(self.memo) + len(new) > MEMO:
                    self.memo.clear()
                    new = {w for words in split[at:to] for w in words}
                self.learn_parts(list(new))
            memo = self.memo
            for words in split[at:to]:
                got = [memo[w] for w in words]
                text = b"".join([g[2] for g in got])
                out.append((sum([g[0] for g in got]), ",".join([g[1] for g in got if g[0]]), text[1:] if text[:1] == b" " else text))
            at = to
        return out

    def learn_parts(self, words: list[str], signs: int = 1 << 20) -> None:
        part, held = [], 0
        for w in words:
            part.append(w)
            held += len(w)
            if held > signs:
                self.learn(part)
                part, held = [], 0
        if part:
            self.learn(part)


_WORD = re.compile(r" *[^ ]+| +")


@functools.cache
def load(model: bytes) -> Pieces:
    return Pieces(model)


def sentencepiece(df: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", digests: bool = False) -> DataFrame:
    """Ids and decoded text of every row; with digests their number and SHA-256 in place of them."""
    spark = df.sparkSession
    common.ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # half a megabyte
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {fields}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        pieces = load(model.value)
        for whole in batches:
            for b in common.slices(whole, text, 4 << 20):
                got = pieces.encode([x or "" for x in b.column(text).to_pylist()])
                counts = pa.array([g[0] for g in got], pa.int64())
                if digests:
                    cols = [pa.array([hashlib.sha256(x).hexdigest() for x in c], pa.string()) for c in ((g[1].encode() for g in got), (g[2] for g in got))]
                else:
                    cols = [pa.array([[int(i) for i in g[1].split(",") if i] for g in got], pa.list_(pa.int32())), pa.array([g[2].decode("utf-8", "replace") for g in got])]
                yield pa.RecordBatch.from_arrays([b.column(key), counts, *cols], names=names)

    return df.select(key, text).mapInArrow(run, schema)
