"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids are the tokenizer's, then one closing id.  Whole windows of
`capacity` ids are cut from the front; what remains of the documents of a group
is shared out by differencing: partial partitions are merged, the heavier parts
of one with the lighter of the other, always for the two of the largest spread.
Where a window would exceed the capacity the number of windows rises.  Ids then
move from the lightest windows to fill the others, and the last, lightest rest is
cut at powers of two, so that no sequence needs padding: the near-equal windows are
what the sequences are filled from, and `window_id` names the one a piece was dealt to
(null for whole windows cut from the front).

Groups are formed inside a task in the order of its rows: no shuffle, and no key
gathers rows.  Memory: a group holds at most GROUP_WINDOWS windows of remainders,
and a batch of texts.  Null and empty texts are the closing id alone.  Repeated
rows are packed as often as they occur.
"""

import functools
import heapq
import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import common
from .hashing import mix

CAPACITY, GROUP_WINDOWS, MEMO = 2048, 48, 400_000
WORST = np.int64(1 << 62)


class Merges:
    """Ids of many plain words by byte-pair merges in vectorised rounds.

    Words lie end to end in one array of symbols.  Each round merges the best pair of
    every word at all its places, from the left; a pair's merged symbol only occurs in
    pairs of later ranks, so that this is the order of one merge at a time.
    """

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # Fixed values of the byte-level alphabet: printable bytes stand for themselves, the others for signs from 256 up.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.inner = np.array([vocab[signs[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[signs[b] + end] for b in range(256)], np.int64)
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pairs.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        key = np.array(list(pairs), np.int64)
        self.bits = 17
        while True:  # an open table of one step: pairs that share a place are looked up in order
            place = self._place(key)
            order = np.argsort(place, kind="stable")
            depth = np.arange(len(key)) - np.searchsorted(place[order], place[order])
            if depth.max() < 6:
                break
            self.bits += 1
        self.depth = int(depth.max()) + 1
        self.key = np.full((self.depth, 1 << self.bits), -1, np.int64)
        self.value = np.zeros((self.depth, 1 << self.bits), np.int64)
        self.key[depth, place[order]] = key[order]
        self.value[depth, place[order]] = np.array([r << 32 | i for r, i in pairs.values()], np.int64)[order]

    def _place(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, key: np.ndarray) -> np.ndarray:
        """Rank and merged symbol of each pair as one number, or one that is larger than all."""
        place = self._place(key)
        out = np.full(len(key), WORST)
        for d in range(self.depth):
            hit = self.key[d][place] == key
            out[hit] = self.value[d][place[hit]]
        return out

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        symbol, word = self.inner[data], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.last[data[ends]]
        done = [(symbol[:0], word[:0])]
        value = np.full(len(symbol), WORST)
        value[:-1] = self.look(symbol[:-1] << 32 | symbol[1:])
        value[np.flatnonzero(word[1:] != word[:-1])] = WORST
        while len(symbol):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            counts = np.diff(starts, append=len(word))
            best = np.repeat(np.minimum.reduceat(value, starts), counts)
            ended = best == WORST
            done.append((symbol[ended], word[ended]))
            hit = np.flatnonzero((value == best) & ~ended)
            # Places in a row overlap: every second counts, from the left.
            place = np.arange(len(hit))
            place -= np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, place, 0))
            hit = hit[place % 2 == 0]
            symbol[hit] = value[hit] & 0xFFFFFFFF
            stay = ~ended
            stay[hit + 1] = False
            fresh = np.zeros(len(symbol), bool)
            fresh[hit] = True
            before = hit - 1
            before = before[before >= 0]
            # The sign before a merged one can have been merged itself and lie one place further left.
            before = np.where(stay[before], before, np.maximum(before - 1, 0))
            fresh[before] = True
            symbol, word, value, fresh = symbol[stay], word[stay], value[stay], fresh[stay]
            at = np.flatnonzero(fresh)
            inside = at[at + 1 < len(symbol)]
            value[at] = WORST
            inside = inside[word[inside] == word[inside + 1]]
            value[inside] = self.look(symbol[inside] << 32 | symbol[inside + 1])
        symbol, word = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class Words:
    """Ids of texts by words: white space parts them in this tokenizer, so a memo by word is exact.

    A new word is cut as the tokenizer cuts it, and Merges encodes the parts; what is
    not of ASCII and Latin-1 letters, or may hold a special token, goes to the tokenizer itself.
    The memo starts anew beyond MEMO words and with each task.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.clear()

    def clear(self) -> None:
        self.at = _Places()
        self.sizes, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: list[str]) -> None:
        """Append the ids of new words in their order."""
        ids, sizes = [self.ids], [self.sizes]
        for i in range(0, len(words), 1 << 16):
            part = words[i : i + (1 << 16)]
            odd = {k: self.tokenizer.encode(part[k], add_special_tokens=False).ids for k in _odd(part)}
            cut = [[] if k in odd else _PARTS.findall(w) for k, w in enumerate(_lower(part))]
            flat = [p for parts in cut for p in parts]
            known = {p: k for k, p in enumerate(dict.fromkeys(flat))}
            found, n = self.merges([p.encode() for p in known]) if known else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            place = np.array([known[p] for p in flat], np.int64)
            start, size = (np.cumsum(n) - n)[place], n[place]
            ends = np.cumsum(size)
            made = found[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)].astype(np.uint32)
            parts = np.array([len(x) for x in cut], np.int64)
            sums = np.concatenate([[0], ends])
            upto = np.cumsum(parts)
            total = sums[upto] - sums[upto - parts]
            if odd:
                cuts = np.concatenate([[0], np.cumsum(total)])
                pieces, before = [], 0
                for k, own in odd.items():
                    pieces += [made[before : cuts[k]], np.array(own, np.uint32)]
                    before = cuts[k]
                    total[k] = len(own)
                made = np.concatenate([*pieces, made[before:]])
            ids.append(made)
            sizes.append(total)
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[str]):
        """Ids of each text; the new words of all of them are learnt at once."""
        if len(self.at) > MEMO:
            self.clear()
        places = [np.array(list(map(self.at.__getitem__, t.replace("\n", " ").split(" "))), np.int64) for t in texts]
        if self.at.new:
            self.learn(self.at.new)
            self.at.new = []
        for place in places:
            sizes = self.sizes[place]
            ends = np.cumsum(sizes)
            shift = self.starts[place] - (ends - sizes)
            yield self.ids[np.arange(ends[-1]) + np.repeat(shift, sizes)]


class _Places(dict):
    """Numbers of words in the order in which they are first looked up; `new` are those not learnt yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


#: How the tokenizer cuts a lower-case text without white space, for ASCII and Latin-1 letters.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_UNLIKE = re.compile("[^!-~À-ÖØ-öø-ÿ\n]|<\\|")


def _odd(words: list[str]) -> list[int]:
    """Places of words for the tokenizer itself."""
    if not _UNLIKE.search("\n".join(words)):
        return []
    return [k for k, w in enumerate(words) if _UNLIKE.search(w)]


def _lower(words: list[str]) -> list[str]:
    return "\n".join(words).lower().split("\n")


@functools.cache
def words_of(path: str) -> Words:
    words = Words(path)
    common.MEMOS.append(words)
    return words


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of indexes whose sums are near each other."""
    heap = []
    for i, s in enumerate(sizes):
        # Sums descend; parts that are left out are empty.
        heap.append((-s, i, [(s, [i])]))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        if len(b) <= free:
            merged = a + b
        else:
            # The heaviest of b meet the empty parts of a, then its lightest.
            over = len(b) - free
            rest = len(a) - over
            merged = a[:rest] + b[:free] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[rest:], reversed(b[free:]), strict=True)]
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], count, merged))
        count += 1
    parts = heap[0][2] if heap else []
    return [p[1] for p in parts] + [[] for _ in range(k - len(parts))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows, none over capacity; their number rises until that holds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if max((sum(sizes[i] for i in w) for w in found), default=0) <= capacity:
            return found
        k += 1


def fill(sizes: list[int], found: list[list[int]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (index, start, length): all full, but for sequences of a power of two at the end."""
    parts = [[(i, 0, sizes[i]) for i in w] for w in sorted(found, key=lambda w: -sum(sizes[i] for i in w)) if w]
    sums = [sum(p[2] for p in w) for w in parts]
    low = len(parts) - 1
    for high in range(len(parts)):
        while high < low and sums[high] < capacity:
            i, start, n = parts[low].pop()
            take = min(n, capacity - sums[high])
            if take < n:
                parts[low].append((i, start, n - take))
                start += n - take
            parts[high].append((i, start, take))
            sums[high] += take
            sums[low] -= take
            if not parts[low]:
                low -= 1
    out = []
    for w, s in zip(parts, sums, strict=True):
        if not s:
            continue
        if s == capacity:
            out.append(w)
            continue
        w = w[::-1]
        while s:
            want = 1 << (s.bit_length() - 1)
            s -= want
            part = []
            while want:
                i, start, n = w.pop()
                if n > want:
                    w.append((i, start + want, n - want))
                    n = want
                part.append((i, start, n))
                want -= n
            out.append(part)
    return out


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, closing: int = 1, with_ids: bool = True) -> DataFrame:
    """Rows of pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_id, with the ids themselves if asked for."""
    spark = df.sparkSession
    common.ship(spark)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_id long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        words = words_of(tokenizer_path)
        sequence = window = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        rows, rest, held = [], [], 0
        kind = None

        def put(x, ids, start, n, offset, dealt=None):
            piece = ids[start : start + n]
            rows.append((x, start, n, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence, offset, dealt) + ((piece.tolist(),) if with_ids else ()))

        def close():
            nonlocal sequence, window, rest, held
            sizes = [len(ids) - at for _, ids, at in rest]
            dealt = windows(sizes, capacity)
            of = {i: window + k for k, w in enumerate(dealt) for i in w}
            for w in fill(sizes, dealt, capacity):
                offset = 0
                for i, start, n in w:
                    x, ids, at = rest[i]
                    put(x, ids, at + start, n, offset, of[i])
                    offset += n
                sequence += 1
            window += len(dealt)
            rest, held = [], 0

        def out():
            types = [kind, *[pa.int64()] * 7, pa.list_(pa.int64())]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)
            rows.clear()
            return made

        for whole in batches:
            for b in common.slices(whole, text, 4 << 20):
                kind = b.column(key).type
                for x, ids in zip(b.column(key).to_pylist(), words.encode([s or "" for s in b.column(text).to_pylist()]), strict=True):
                    ids = np.append(ids, np.uint32(closing))
                    at = len(ids) // capacity * capacity
                    for start in range(0, at, capacity):
                        put(x, ids, start, capacity, 0)
                        sequence += 1
                    if at < len(ids):
                        rest.append((x, ids, at))
                        held += len(ids) - at
                        if held >= GROUP_WINDOWS * capacity:
                            close()
                if rows:
                    yield out()
        if rest:
            close()
        if rows:
            yield out()

    return df.select(key, text).mapInArrow(common.tidy(run), schema)
