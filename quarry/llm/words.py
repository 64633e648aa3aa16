"""Words of whole texts as 64-bit hashes, found on UTF-8 bytes in numpy.

A word of up to ``LONG`` bytes is hashed by a polynomial modulo 2**64, of which texts of 1,024 bytes and more are
known that collide whatever the base; longer words get a cryptographic hash.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_K = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_K, -1, 1 << 64)
_STEP = 1 << 22
LONG = 256
_powers: dict[int, np.ndarray] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII letters and digits and every byte of a non-ASCII character
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12, 2 * len(have) if have is not None else 0)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)  # base**1 ...
        _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 from which the hash of any stretch follows, see stretch()."""
    out = np.zeros(len(raw) + 1, np.uint64)
    terms = raw.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _table(_K, len(raw))[: len(raw)]
    np.cumsum(terms, out=out[1:])
    return out


def stretch(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch first:end, the same wherever equal bytes stand."""
    return mix((sums[end] - sums[first]) * _table(_INVERSE, len(sums))[first])


def stretches(sums: np.ndarray, width: int) -> np.ndarray:
    """stretch() of all stretches of ``width`` bytes, in their order."""
    h = sums[width:] - sums[:-width]
    h *= _table(_INVERSE, len(sums))[: len(h)]
    return mix(h)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def lowered(raw: bytes) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[np.frombuffer(raw, np.uint8)]


def words(raw: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of each word."""
    first, end = runs(inside[raw])
    h = stretch(prefix_sums(raw), first, end)
    for i in np.flatnonzero(end - first > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return first, end, h


def batches_of(texts: list[bytes], most: int = _STEP):
    """(from, to) of stretches of the list that hold about ``most`` bytes, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def utf8(texts) -> list[bytes]:
    """Bytes of each text; a null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def texts_in(column: pa.Array, most: int = 1 << 20, rows: int = 3000) -> Iterator[tuple[int, int, list[bytes]]]:
    """A text column in stretches (from, to, bytes of each text; a null is empty) of about ``most`` bytes, one text
    at least.  Only one stretch is held as Python objects at a time, and what it took goes back to the system."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    a = held = 0
    for b in range(len(size) + 1):
        if b == len(size) or b > a and (held + size[b] > most or b - a >= rows):
            if b > a:
                yield a, b, [x or b"" for x in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
            a, held = b, 0
        held += size[b] + 1 if b < len(size) else 0
    release()


def release() -> None:
    """Hand freed memory back: workers live on between stages and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass
