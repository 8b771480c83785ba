"""GIF: read code streams, palettes, disposal and transparency; store timed frames.

`encode` writes 8-bit samples as timed frames of a grey palette, in greedy LZW codes;
`decode` reads any GIF87a or GIF89a stream: code streams, sub-blocks, local palettes,
interlacing, delays, transparent indexes and the disposal rules (keep, background,
previous).  `frames_of` gives what is stored of each frame, `gif_frames` as a table;
histograms count the colours of the composed canvas in the frame's own area.

Nulls and empty texts give a payload of one row of 192 spaces.  Rows that repeat
give equal values.  A long text takes several frames and no more than a frame's
samples are composed at a time.  A stream that is cut short raises ValueError.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import common

WIDTH, ROWS = 192, 320
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


@dataclass
class Frame:
    left: int
    top: int
    delay_ms: int
    disposal: int
    transparent: int | None
    indexes: np.ndarray
    palette: np.ndarray
    canvas: np.ndarray | None = None


def lzw_codes(data: bytes, bits: int = 8) -> np.ndarray:
    """Greedy codes with a clear whenever the table is full."""
    clear, table, codes = 1 << bits, {}, [1 << bits]
    free = clear + 2
    current = data[0]
    get, put = table.get, codes.append
    for byte in data[1:]:
        code = get(current << 8 | byte)
        if code is None:
            put(current)
            if free == 4096:
                put(clear)
                table.clear()
                free = clear + 2
            else:
                table[current << 8 | byte] = free
                free += 1
            current = byte
        else:
            current = code
    codes += current, clear + 1
    return np.array(codes, np.int64)


def literal_codes(data: bytes, bits: int = 8) -> np.ndarray:
    """Every sample as its own code, with clears so early that codes never grow wider."""
    clear = 1 << bits
    step = clear - 2
    n = -(-len(data) // step)
    codes = np.full(n * (step + 1) + 1, -1, np.int64)
    rows = codes[:-1].reshape(n, step + 1)
    rows[:, 0] = clear
    padded = np.full(n * step, -1, np.int64)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    rows[:, 1:] = padded.reshape(n, step)
    codes[-1] = clear + 1
    return codes[codes >= 0]


def pack_narrow(codes: np.ndarray, bits: int = 8) -> bytes:
    """pack() where every code has bits + 1 bits: eight codes at a time fill bits + 1 bytes."""
    w = bits + 1
    padded = np.zeros(-(-len(codes) // 8) * 8, np.uint64)
    padded[: len(codes)] = codes
    rows = padded.reshape(-1, 8)
    out = np.zeros((len(rows), w), np.uint8)
    for k in range(w):
        for j in range(8):  # code j lies at bits j * w up to (j + 1) * w
            shift = 8 * k - j * w
            if -8 < shift < w:
                out[:, k] |= ((rows[:, j] >> np.uint64(shift)) if shift >= 0 else rows[:, j] << np.uint64(-shift)).astype(np.uint8)
    return out.tobytes()[: (len(codes) * w + 7) >> 3]


def widths(codes: np.ndarray, bits: int = 8) -> np.ndarray:
    """Bits of each code: a code's width follows from its distance to the last clear alone."""
    clear = 1 << bits
    index = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(codes == clear, index, -1))
    last = np.concatenate([[-1], last[:-1]])  # a clear is written in the width before it
    # After k codes since the clear the decoder has made k - 1 entries, the encoder k.
    made = clear + 1 + np.maximum(index - last - 1, 0)
    return np.minimum(np.maximum(bits + 1, np.floor(np.log2(np.maximum(made, 1))).astype(np.int64) + 1), 12)


def pack(codes: np.ndarray, bits: int = 8) -> bytes:
    w = widths(codes, bits)
    end = np.cumsum(w)
    where = end - w
    value = codes << (where & 7)
    n = int(end[-1] + 7) >> 3
    # Codes share bytes but no bits, so that sums put them together.
    made = sum(np.bincount((where >> 3) + k, value >> 8 * k & 255, n + 3) for k in range(3))
    return made[:n].astype(np.uint8).tobytes()


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_ms: int = 100, compress: bool = True) -> bytes:
    """Samples as timed frames over one grey palette; the last frame can be lower.  compress: greedy codes, else only literal ones."""
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREY.tobytes()]
    for at in range(0, len(payload), width * rows):
        part = payload[at : at + width * rows]
        codes = pack(lzw_codes(part)) if compress else pack_narrow(literal_codes(part))
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_ms // 10, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8) + blocks(codes))
    return b"".join([*out, b";"])


#: Bit offsets of the codes after a clear, by the size of the literals: they depend on nothing else.
_OFFSETS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _offsets(bits: int) -> tuple[np.ndarray, np.ndarray]:
    if bits not in _OFFSETS:
        made = (1 << bits) + 1 + np.arange(1 << 13)
        w = np.minimum(np.floor(np.log2(made)).astype(np.int64) + 1, 12)
        w = np.maximum(w, bits + 1)
        _OFFSETS[bits] = np.concatenate([[0], np.cumsum(w)[:-1]]), w
    return _OFFSETS[bits]


def _narrow(words: np.ndarray, at: int, total: int, bits: int, span: int) -> tuple[bytes, int, bool]:
    """Samples of a stretch that holds only literals of the first width, up to a clear or the end; else nothing."""
    w, clear = bits + 1, 1 << bits
    where = at + w * np.arange(min(span, (total - at) // w))
    codes = (words[where >> 3] >> (where & 7).astype(np.uint32)) & np.uint32((1 << w) - 1)
    ends = np.flatnonzero(codes >= clear)
    if not len(ends):
        return b"", 0, False
    good = (codes[ends] <= clear + 1) & (np.diff(ends, prepend=-1) < clear)
    bad = np.flatnonzero(~good)
    ends = ends[: bad[0]] if len(bad) else ends
    stop = np.flatnonzero(codes[ends] == clear + 1)
    ends = ends[: stop[0] + 1] if len(stop) else ends
    if not len(ends):
        return b"", 0, False
    codes = codes[: ends[-1] + 1]
    return codes[codes < clear].astype(np.uint8).tobytes(), w * len(codes), bool(len(stop))


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """Expand a code stream.  The codes up to the next clear are cut out at once; then one table step a code."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    total, at = 8 * len(data), 0
    offsets, width = _offsets(bits)
    literals = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, span = [], 1 << 10
    while True:
        if span:
            literal, moved, last = _narrow(words, at, total, bits, span)
            at += moved
            span = min(4 * span, 1 << 20) if moved else 0
            out.append(literal)
            if last:
                break
            if moved:
                continue
        n = int(np.searchsorted(offsets + width, total - at, "right"))
        where, w, run = at + offsets[:n], width[:n], n == len(offsets)
        codes = (words[where >> 3] >> (where & 7).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stops):
            if not run:
                raise ValueError("the code stream has no end")
            # No clear for long: 12-bit codes go on over a full table.
            extra = (total - at - int(offsets[-1])) // 12
            where = at + int(offsets[-1]) + 12 * np.arange(extra)
            more = (words[where >> 3] >> (where & 7).astype(np.uint32)) & np.uint32(0xFFF)
            codes = np.concatenate([codes[:-1], more])
            width_all = np.concatenate([w[:-1], np.full(extra, 12)])
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if not len(stops):
                raise ValueError("the code stream has no end")
            at += int(width_all[: stops[0] + 1].sum())
        else:
            at += int(offsets[stops[0]] + width[stops[0]])
        found = codes[: stops[0]].tolist()
        if found:
            table = literals.copy()
            if found[0] >= clear:
                raise ValueError("a code before its entry")
            before = table[found[0]]
            push, put = table.append, out.append
            put(before)
            for code in found[1 : 4096 - clear - 1]:
                try:
                    entry = table[code]
                except IndexError:
                    if code != len(table):
                        raise ValueError("a code before its entry") from None
                    entry = before + before[:1]
                push(before + entry[:1])
                put(entry)
                before = entry
            out += [table[code] for code in found[4096 - clear - 1 :]]
        if codes[stops[0]] == end:
            break
    found = b"".join(out)
    if len(found) < size:
        raise ValueError("too few samples")
    return found[:size]


def decode(data: bytes, compose: bool = True) -> Iterator[Frame]:
    """Frames in order; with compose each has the RGBA canvas at its time."""
    try:
        yield from _decode(data, compose)
    except (struct.error, IndexError) as e:
        raise ValueError("the stream is cut short") from e


def _decode(data: bytes, compose: bool) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, table = 13, GREY
    if flags & 0x80:
        n = 2 << (flags & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width), np.uint32)
    delay, disposal, transparent = 0, 0, None

    def chain(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = chain(at + 2)
            if label == 0xF9:
                f, d, index = struct.unpack("<BHB", body[:4])
                delay, disposal, transparent = 10 * d, f >> 2 & 7, index if f & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = table
        if f & 0x80:
            n = 2 << (f & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        bits = data[at]
        body, at = chain(at + 1)
        indexes = np.frombuffer(lzw_decode(body, bits, w * h), np.uint8).reshape(h, w)
        if f & 0x40:
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(indexes)
            straight[order] = indexes
            indexes = straight
        frame = Frame(left, top, delay, disposal, transparent, indexes, palette)
        if compose:
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            inside = indexes[: area.shape[0], : area.shape[1]]
            colours = np.full((256, 4), 255, np.uint8)
            colours[: len(palette), :3] = palette
            colours = colours.view(np.uint32)[:, 0][inside]
            area[...] = colours if transparent is None else np.where(inside == transparent, area, colours)
            frame.canvas = canvas.view(np.uint8).reshape(height, width, 4).copy()
            if disposal == 2:
                area[...] = 0
            elif disposal == 3:
                canvas = before
        yield frame
        delay, disposal, transparent = 0, 0, None


def histogram(frame: Frame, bins: int = 4) -> np.ndarray:
    """Counts of the visible colours that the canvas shows in a frame's own area, bins a channel."""
    h, w = frame.indexes.shape
    area = np.ascontiguousarray(frame.canvas[frame.top : frame.top + h, frame.left : frame.left + w]).view(np.uint32).ravel()
    colours, n = np.unique(area, return_counts=True)  # few: at most those of the frames so far
    colours = colours.view(np.uint8).reshape(-1, 4)
    seen = colours[:, 3] > 0
    at = colours[seen].astype(np.int64) * bins >> 8
    return np.bincount((at[:, 0] * bins + at[:, 1]) * bins + at[:, 2], n[seen], bins**3).astype(np.int64)


def frames_of(data: bytes) -> Iterator[tuple[int, int, int, int, int, int, int, int, bytes, np.ndarray]]:
    """(frame, left, top, width, height, delay_ms, at_ms, disposal, samples, histogram) of each frame."""
    at = 0
    for i, f in enumerate(decode(data)):
        h, w = f.indexes.shape
        yield i, f.left, f.top, w, h, f.delay_ms, at, f.disposal, f.indexes.tobytes(), histogram(f)
        at += f.delay_ms


def payload_of(text: bytes, unit: int = 192) -> bytes:
    return text + b" " * (-len(text) % unit if text else unit)


def gif_frames(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """Rows (key, frame, left, top, width, height, delay_ms, at_ms, disposal, samples, histogram), one a frame."""
    common.ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for x, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(x, *f[:-1], f[-1].tolist()) for f in (frames_of(data) if data is not None else ())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [b.schema.field(0).type, *[pa.int32()] * 8, pa.binary(), pa.list_(pa.int64())], strict=True)], names=names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, frame int, left int, top int, width int, height int, delay_ms int, at_ms int, disposal int, samples binary, histogram array<bigint>"
    names = [x.split()[0] for x in schema.split(", ")]
    return df.select(key, media).mapInArrow(common.tidy(run), schema)


def gif_store(df: DataFrame, text: str = "text", key: str = "doc_id", media: bool = True) -> DataFrame:
    """Store each text as a GIF and read it again: digests and features, with the stored bytes if asked for."""
    common.ship(df.sparkSession)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int" + ", media binary" * media

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in common.slices(whole, text, 4 << 20):
                rows = []
                for x, s in zip(b.column(key).to_pylist(), b.column(text).cast(pa.binary()).to_pylist(), strict=True):
                    s = s or b""
                    stored = encode(payload_of(s))
                    parts, counts = [], np.zeros(64, np.int64)
                    for *_, samples, colours in frames_of(stored):
                        parts.append(samples)
                        counts += colours
                    got = b"".join(parts)
                    feature = f"{len(parts)}:" + ",".join(map(str, counts[::21].tolist()))
                    rows.append((x, len(s), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(parts)) + (stored,) * media)
                types = [b.column(key).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    names = [f.split()[0] for f in schema.split(", ")]
    return df.select(key, text).mapInArrow(common.tidy(run), schema)
