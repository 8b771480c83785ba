"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Each prefix of a part (what the tokenizer never merges across) has one last token: the
one that the merges of that prefix alone would end with.  A token that ends at a place is
the last one there if its own merges give it, and if the last token before it keeps its
border with it.  Tokens that end at a place come from a suffix automaton of the
vocabulary, longest first; the border test unmakes the two tokens along the border, latest
merge first, and looks whether a merge across it would have come earlier.  Following the
last tokens back from the end of the part gives the ids of merging in order of ranks.

A part's last byte is a symbol of its own (it carries the end of the word), so that
symbols are 512: inner and final bytes.  The automaton is built once on the driver, its
size is that of the vocabulary, and goes to the executors as arrays.

Rows are independent: no shuffle.  Words and parts seen before come from bounded memos.
A null text is empty and has no ids; repeated rows give equal rows; columns besides key and
text are left out; an empty table gives no rows.
"""

import functools
import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from . import common
from .packing import _PARTS, _UNLIKE

MEMO, PAIRS = 300_000, 1_000_000
#: Fixed values of the byte-level alphabet: printable bytes stand for themselves, the others for signs from 256 up.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGN = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _SHOWN)}
_BYTE = {c: b for b, c in _SIGN.items()}
NEVER = 1 << 40


class Automaton:
    """Suffix automaton of many strings: states are substrings with the same places of occurrence."""

    def __init__(self, strings):
        self.next, self.link, self.size = [{}], [-1], [0]
        for s in strings:
            last = 0
            for c in s:
                last = self._extend(last, c)

    def _state(self, size: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of p's longest string and c, cut off from q."""
        new = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier string holds this one
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, c)
        new = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return new

    def where(self, s) -> int:
        at = 0
        for c in s:
            at = self.next[at][c]
        return at


def tables(model: dict) -> dict[str, np.ndarray]:
    """All that encoding needs, from a byte-level model with a suffix for the end of a word."""
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    string: dict[int, tuple] = {}
    for b in range(256):
        for symbol, name in ((b, _SIGN[b]), (256 + b, _SIGN[b] + end)):
            string[vocab[name]] = (symbol,)
    n = max(vocab.values()) + 1
    left, right, rank = (np.full(n, -1, np.int64) for _ in range(3))
    for r, pair in enumerate(model["merges"]):
        a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
        t = vocab[pair.replace(" ", "") if isinstance(pair, str) else "".join(pair)]
        if t in string:
            raise ValueError("two merges make the same token")
        left[t], right[t], rank[t] = a, b, r
        string[t] = string[a] + string[b]
        if rank[a] > r or rank[b] > r:
            raise ValueError("a merge comes before its parts")
    made = np.flatnonzero(left >= 0)
    made = made[np.argsort(rank[made])]
    joins = Joins(left, right, rank)
    # A token whose own merges do not give it back never occurs.
    whole = {int(t) for t in string if left[t] < 0}
    for t in made.tolist():
        a, b = int(left[t]), int(right[t])
        if a in whole and b in whole and joins.apart(a, b, int(rank[t])):
            whole.add(t)
    automaton = Automaton(string[t] for t in sorted(whole))
    state = {t: automaton.where(string[t]) for t in whole}
    source = [s for s, follow in enumerate(automaton.next) for _ in follow]
    sign = [c for follow in automaton.next for c in follow]
    target = [q for follow in automaton.next for q in follow.values()]
    ends = np.array([(state[t], len(string[t]), t) for t in whole], np.int64)
    return {
        "left": left, "right": right, "rank": rank, "key": np.array(source, np.int64) << 9 | np.array(sign, np.int64), "target": np.array(target, np.int32),
        "link": np.array(automaton.link, np.int32), "size": np.array(automaton.size, np.int32), "ends": ends[np.lexsort((-ends[:, 1], ends[:, 0]))],
    }


class Joins:
    """Whether two tokens side by side stay as they are."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.left, self.right, self.rank = left.tolist(), right.tolist(), rank.tolist()
        made = np.flatnonzero(left >= 0)
        self.pair = dict(zip((left[made] << 20 | right[made]).tolist(), rank[made].tolist(), strict=True))

    def apart(self, a: int, b: int, whole: int = NEVER) -> bool:
        """No merge across the border of a and b comes before those that make a and b.

        What stands left of the border is a or an end of a that a later merge took in, and
        likewise on the right; the time until which they stand there is the rank of that
        merge.  At equal ranks the pair further left goes first.  `whole` is the rank of the
        merge that makes one token of both, where they are to become one.
        """
        until_a = until_b = whole
        pair, rank = self.pair, self.rank
        while True:
            r = pair.get(a << 20 | b, NEVER)
            if r < until_a and r <= until_b:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra >= rb:
                until_a, a = ra, self.right[a]
            else:
                until_b, b = rb, self.left[b]


class Encoder:
    """Ids and tokens of texts; white space parts words in this tokenizer, so a memo by word is exact.

    Words beyond ASCII and Latin-1 letters, and those that may hold a special token, are
    normalised and cut by the tokenizer's own parts; merging is done here for all.
    """

    def __init__(self, path: str, arrays: dict[str, np.ndarray]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.shown = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.load(arrays)
        self.parts: dict[bytes, tuple[str, str]] = {}
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def load(self, arrays: dict[str, np.ndarray]) -> None:
        self.joins = Joins(arrays["left"], arrays["right"], arrays["rank"])
        self.next = dict(zip(arrays["key"].tolist(), arrays["target"].tolist(), strict=True))
        self.link, self.size = arrays["link"].tolist(), arrays["size"].tolist()
        own: dict[int, list] = {}
        for state, size, token in arrays["ends"].tolist():
            own.setdefault(state, []).append((size, token))
        #: Tokens that end where a state's strings end, longest first; states without tokens have those of the next shorter suffix.
        self.ends: list[tuple] = [()] * len(self.link)
        for s in np.argsort(arrays["size"], kind="stable").tolist():
            below = self.ends[self.link[s]] if s else ()
            self.ends[s] = (*own[s], *below) if s in own else below
        self.apart: dict[int, bool] = {}

    def merge(self, part: bytes) -> list[int]:
        """Ids of a part by the last token of each prefix."""
        n = len(part)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        follow, link, size, ends, apart, joins = self.next, self.link, self.size, self.ends, self.apart, self.joins.apart
        state = held = 0
        for i in range(n):
            c = part[i] if i < n - 1 else 256 + part[i]
            while (q := follow.get(state << 9 | c)) is None:
                state = link[state]
                held = size[state]
            state = q
            held += 1
            for k, token in ends[state]:
                if k > held:
                    continue
                if k <= i:
                    pair = last[i + 1 - k] << 20 | token
                    ok = apart.get(pair)
                    if ok is None:
                        if len(apart) > PAIRS:
                            apart.clear()
                        apart[pair] = ok = joins(pair >> 20, token)
                    if not ok:
                        continue
                last[i + 1], back[i + 1] = token, i + 1 - k
                break
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def cuts(self, word: str):
        """Parts of a word as bytes, special tokens as their ids."""
        if not _UNLIKE.search(word):
            yield from (p.encode() for p in _PARTS.findall(word.lower()))
            return
        for piece in self.cut.split(word) if self.cut else [word]:
            if piece in self.special:
                yield self.special[piece]
            elif piece:
                for signs, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece)):
                    yield bytes([_BYTE[c] for c in signs])

    def learn(self, word: str) -> None:
        ids, tokens = [], []
        for part in self.cuts(word):
            got = self.parts.get(part)
            if got is None:
                found = [part] if isinstance(part, int) else self.merge(part)
                if len(self.parts) > MEMO:
                    self.parts.clear()
                self.parts[part] = got = " ".join(map(str, found)), " ".join([self.shown[i] for i in found])
            ids.append(got[0])
            tokens.append(got[1])
        self.ids[word], self.tokens[word] = " ".join(ids), " ".join(tokens)

    def encode(self, text: str) -> tuple[str, str]:
        """The ids in decimal and the decoded text, both parted by one space."""
        words = _SPACE.split(text) if _CONTROL.search(text) else text.split()
        new = {w for w in words if w not in self.ids}
        if len(self.ids) + len(new) > MEMO:
            self.ids.clear()
            self.tokens.clear()
            new = set(words)
        for w in new:
            self.learn(w)
        return " ".join(filter(None, map(self.ids.__getitem__, words))), " ".join(filter(None, map(self.tokens.__getitem__, words)))


#: Signs that Python takes for white space and the tokenizer does not.
_CONTROL, _SPACE = re.compile("[\x1c-\x1f]"), re.compile("[ \n]")


@functools.cache
def _arrays(path: str) -> dict[str, np.ndarray]:
    with open(path, encoding="utf-8") as f:
        return tables(json.load(f)["model"])


_ENCODERS: dict[str, Encoder] = {}


def bpe(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", digests: bool = False) -> DataFrame:
    """Ids and decoded text of every row; with digests their number and SHA-256 in place of them."""
    spark = df.sparkSession
    common.ship(spark)
    arrays = spark.sparkContext.broadcast(_arrays(tokenizer_path))  # some ten megabytes, by the vocabulary alone
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {fields}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        encoder = _ENCODERS.get(tokenizer_path)
        if encoder is None:
            encoder = _ENCODERS[tokenizer_path] = Encoder(tokenizer_path, arrays.value)
        for whole in batches:
            for b in common.slices(whole, text, 4 << 20):
                counts, cols = [], ([], [])
                for t in b.column(text).to_pylist():
                    ids, decoded = encoder.encode(t or "")
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    if digests:
                        ids, decoded = (hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded))
                    cols[0].append(ids if digests else [int(i) for i in ids.split()])
                    cols[1].append(decoded)
                kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(counts, pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=names)

    return df.select(key, text).mapInArrow(run, schema)
