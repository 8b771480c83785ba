"""64-bit hashes of substrings, all of a buffer at once."""

import hashlib

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BASE, STEP = 0xD1342543DE82EF95, 1 << 19
#: Words of so many bytes are hashed by BLAKE2b: sums modulo 2**64 lose more bits to patterns the longer they are.
LONG = 32


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            step = np.uint64(pow(base, len(out), 1 << 64))
            out = np.concatenate([out, out * step])
    return out[:n]


class Hasher:
    """Hashes of substrings from prefix sums: sum of byte values times powers, modulo 2**64."""

    size = -1

    def __init__(self, data: np.ndarray):
        if len(data) > Hasher.size:
            Hasher.size = -(-len(data) // STEP) * STEP
            Hasher.up = _powers(Hasher.size + 1, _BASE)
            Hasher.down = _powers(Hasher.size + 1, pow(_BASE, -1, 1 << 64))
            with np.errstate(over="ignore"):
                Hasher.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.data = np.ascontiguousarray(data)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(Hasher.value[data] * Hasher.down[: len(data)], out=self.sums[1:])

    def __call__(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.between(at, at + n)

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * Hasher.up[start])

    def words(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of substrings of any form and length."""
        out = self.between(start, stop)
        long = np.flatnonzero(stop - start >= LONG)
        if len(long):
            spans = [self.data[s:e] for s, e in zip(start[long].tolist(), stop[long].tolist(), strict=True)]
            out[long] = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in spans]), np.uint64)
        return out
