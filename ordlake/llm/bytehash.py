"""Vectorised hashing of words in UTF-8 bytes, used inside Arrow and pandas tasks.

A word is a run of ASCII letters and digits and of bytes over 127; A-Z is lowered. The hash of a word comes
from prefix sums of byte * BASE^position modulo 2^64, so a whole block of texts needs a few numpy passes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes in one numpy pass; longer texts are cut between words.
BLOCK = 1 << 19

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def is_word(byte: int) -> bool:
    return bool(_WORD[byte])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[bytes], limit: int = BLOCK) -> Iterator[list[int]]:
    """Consecutive indices whose texts together have at most limit bytes; a longer text stands alone."""
    own, size = [], 0
    for i, t in enumerate(texts):
        if own and size + len(t) + 1 > limit:
            yield own
            own, size = [], 0
        own.append(i)
        size += len(t) + 1
    if own:
        yield own


def slices(size: np.ndarray, limit: int, rows: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most rows rows that together have at most limit bytes; a larger row stands alone."""
    end, at = np.cumsum(size), 0
    while at < len(size):
        fit = int(np.searchsorted(end, (end[at - 1] if at else 0) + limit, side="right"))
        stop = min(max(fit, at + 1), at + rows)
        yield at, stop
        at = stop


def by_bytes(text: pa.Array, fn: Callable[[pa.Array], pa.Array], kind: pa.DataType, limit: int, rows: int = 1 << 12) -> pa.Array:
    """fn over consecutive parts of an Arrow array, so that what fn holds is bounded by bytes; unused memory goes back."""
    parts = [fn(text.slice(i, j - i)) for i, j in slices(sizes(text), limit, rows)]
    out = pa.concat_arrays(parts) if parts else pa.array([], kind)
    del parts
    give_back()
    return out


def give_back() -> None:
    """Return unused memory to the system: workers live on between stages, beside other workers."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def sizes(text: pa.Array) -> np.ndarray:
    """Bytes of each text of an Arrow array; null has none."""
    offsets = buffers(text)[1]
    return np.diff(offsets)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets from 0) of an Arrow array, not decoded."""
    b = text.cast(pa.large_binary())
    if not len(b):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(b.buffers()[1], np.int64)[b.offset : b.offset + len(b) + 1]
    return np.frombuffer(b.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, start, end, hash) of the words of one block."""
    b = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    inside = _WORD[b]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return b, start, end, mix((total[end] - total[start]) * down[start])


def heads(b: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hash of the first size bytes of each word, or of the whole word if it is shorter."""
    total = np.full(len(start), size, dtype=np.uint64)
    for j in range(size):
        inside = start + j < end
        total = total * BASE + np.where(inside, b[np.minimum(start + j, len(b) - 1)], 0).astype(np.uint64)
    return mix(total)


def pieces(text: bytes, limit: int = BLOCK) -> Iterator[bytes]:
    """text cut between words into parts of about limit bytes (a longer single word stays whole)."""
    at = 0
    while len(text) - at > limit:
        cut = at + limit
        while cut < len(text) and (_WORD[text[cut]] and _WORD[text[cut - 1]]):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """For each block of texts: their indices, all word hashes in order, and the number of words of each text."""
    for own in blocks(texts):
        if len(own) == 1 and len(texts[own[0]]) > BLOCK:
            h = np.concatenate([words(p)[3] for p in pieces(texts[own[0]])])
            yield own, h, np.array([len(h)])
            continue
        data = b"\n".join([texts[i] for i in own])
        ends = np.cumsum([len(texts[i]) + 1 for i in own])
        _, start, _, h = words(data)
        yield own, h, np.diff(np.searchsorted(start, ends), prepend=0)
