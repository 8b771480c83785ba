"""Fill-in-middle by bit masks of big integers, at line boundaries.

A text's UTF-8 bytes are one integer per class, a byte of it for a byte of the text:
`bytes.translate` writes 1 for each byte of the class and 0 for the others.  The mask of
line ends, shifted by one byte, is the mask of line starts; its `bit_count` is the
number of lines.  The start of line k is the set bit of rank k, found by halving the
mask again and again: the half that holds the bit is kept, so that all steps together
cost one pass.  Code points of a span are the set bits of a third mask inside it.

Two numbers from the document's id cut the lines in prefix, middle and suffix, a third
decides whether the text is rearranged and a fourth in which order.  Texts that hold a
sentinel stay plain, so that every output can be read back.

Rows are independent: no shuffle.  A null text is empty, an empty text is plain with no
lines.  A null id counts as the empty string in the digest.  Repeated rows give equal
rows, columns besides key and text are left out, an empty table gives no rows.
"""

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_LINE_END = bytes(b == 10 for b in range(256))
_CHAR = bytes(b & 0xC0 != 0x80 for b in range(256))


def _mask(data: bytes, table: bytes) -> int:
    return int.from_bytes(data.translate(table), "little")


def ranked(mask: int, k: int) -> int:
    """Place of the set bit of rank k, the lowest being 0."""
    width = 1 << max(mask.bit_length() - 1, 0).bit_length()
    at = 0
    while width > 1:
        width >>= 1
        low = mask & ((1 << width) - 1)
        held = low.bit_count()
        if k < held:
            mask = low
        else:
            mask, k, at = mask >> width, k - held, at + width
    return at


class Lines:
    """Line starts of a text as a mask."""

    def __init__(self, data: bytes):
        self.data = data
        inside = (1 << 8 * len(data)) - 1
        self.starts = ((_mask(data, _LINE_END) << 8) | 1) & inside
        self.n = self.starts.bit_count()

    def after(self, k: int) -> int:
        """Where the first k lines end."""
        return 0 if k == 0 else len(self.data) if k == self.n else ranked(self.starts, k) >> 3


def chars(data: bytes) -> int:
    return _mask(data, _CHAR).bit_count()


def numbers(seed: int, key) -> list[int]:
    """The first four groups of eight hexadecimal digits of the SHA-256 of `seed:key`."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def rearrange(data: bytes, h: list[int], rate: int, spm: int) -> tuple[int, str, tuple[bytes, bytes, bytes] | None, bytes]:
    """Number of lines, form, the three parts unless plain, output."""
    lines = Lines(data)
    if not data or h[2] % 100 >= rate or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return lines.n, "plain", None, data
    first, second = sorted((h[0] % (lines.n + 1), h[1] % (lines.n + 1)))
    a, b = lines.after(first), lines.after(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h[3] % 100 < spm:
        return lines.n, "spm", (prefix, middle, suffix), SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return lines.n, "psm", (prefix, middle, suffix), PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made from."""
    if form == "plain":
        return output
    head, between = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, rest = output.removeprefix(head).split(between, 1)
    second, middle = rest.split(MIDDLE, 1)
    return first + middle + second if form == "psm" else second + middle + first


def fill_in_middle(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50, digests: bool = False) -> DataFrame:
    """Rows of key, n, form, prefix_chars, middle_chars and output; with digests those of output and restored text in its place.

    `rate` is the percentage of texts to rearrange, `spm` that of those with the suffix first.
    """
    common.ship(df.sparkSession)
    made = "output_sha256 string, restored_sha256 string" if digests else "output string"
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, {made}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (1 + digests)]
        for whole in batches:
            for b in common.slices(whole, text):
                rows = []
                for k, data in zip(b.column(key).to_pylist(), b.column(text).to_pylist(), strict=True):
                    n, form, parts, output = rearrange(data or b"", numbers(seed, k), rate, spm)
                    sizes = (chars(parts[0]), chars(parts[1])) if parts else (None, None)
                    last = (hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest()) if digests else (output.decode(errors="replace"),)
                    rows.append((n, form, *sizes, *last))
                yield pa.RecordBatch.from_arrays([b.column(key), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=names)

    return df.select(key, F.col(text).cast("string").cast("binary").alias(text)).mapInArrow(run, schema)
