"""NumPy kernels over the bytes of many texts at once: words, their 64-bit names, and mixing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The bytes between words, \x20 and \x09-\x0D.
SPACE_BYTES = (9, 10, 11, 12, 13, 32)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_SPAN = 64
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, size=(_SPAN, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[:, list(SPACE_BYTES)] = 0
_TABLE = _TABLE.ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a list of texts, in order: byte places in buf, the text each belongs to, and a 64-bit name of its bytes."""

    buf: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    name: np.ndarray


def words(texts: list[bytes]) -> Words:
    """Split texts at white space and name each word by tabulation hashing; equal words get equal names everywhere."""
    buf = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(buf, dtype=np.uint8)
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    offsets = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    doc = np.searchsorted(offsets, start, side="right")
    if not len(start):
        return Words(buf, start, end, doc, np.zeros(0, dtype=np.uint64))
    first = start[0]
    place = np.arange(first, len(raw), dtype=np.int64)
    place -= np.repeat(start, np.diff(np.append(start, len(raw))))
    far = place >= _SPAN
    part = _TABLE[((place & (_SPAN - 1)) << 8) + raw[first:]]
    if far.any():
        part[far] *= mix((place[far] >> 6).astype(np.uint64)) | np.uint64(1)
    name = np.add.reduceat(part, start - first)
    return Words(buf, start, end, doc, mix(name + (end - start).astype(np.uint64)))
