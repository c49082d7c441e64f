"""Vectorised word hashing over whole texts, used inside Arrow tasks.

Texts are joined by a line feed, which is white space to every caller, so one pass over a byte
buffer hashes the words of many documents. Memory follows SEGMENT, not the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; a longer text is hashed in parts cut at white space.
SEGMENT = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15 | 1
_QS = 0xD6E8FEB86659FD93
_tables: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        size = max(n, SEGMENT + 1)
        p = np.full(size, _R, np.uint64)
        p[0] = 1
        q = np.full(size, pow(_R, -1, 2**64), np.uint64)
        q[0] = 1
        with np.errstate(over="ignore"):
            _tables["p"], _tables["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _tables["p"], _tables["q"]


def word_places(buf: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end offsets and 64-bit hashes of the words of a byte buffer; apart: which bytes part words."""
    word = np.zeros(len(buf) + 2, np.int8)
    np.logical_not(apart[buf], out=word[1:-1].view(bool))
    edge = np.flatnonzero(np.diff(word))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    p, q = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    return starts, ends, mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(_QS))


def _hash_segment(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of a byte buffer."""
    starts, _, h = word_places(buf)
    return starts, h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one text after the other, and offsets (len(texts) + 1) into them."""
    hashes, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            lens = np.array([len(texts[i]) + 1 for i in group])
            begin = np.concatenate(([0], np.cumsum(lens)))
            starts, h = _hash_segment(np.frombuffer(b"\n".join([texts[i] for i in group]), np.uint8))
            counts[group] = np.diff(np.searchsorted(starts, begin))
            hashes.append(h)
        group, size = [], 0

    for i, t in enumerate(texts):
        if size + len(t) > SEGMENT:
            flush()
        if len(t) <= SEGMENT:
            group.append(i)
            size += len(t) + 1
            continue
        at = 0
        while at < len(t):
            end = _cut(t, at + SEGMENT) if len(t) - at > SEGMENT else len(t)
            _, h = _hash_segment(np.frombuffer(t, np.uint8, end - at, at))
            hashes.append(h)
            counts[i] += len(h)
            at = end
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def _cut(t: bytes, at: int) -> int:
    """The first white space at or after a position, so that no word is cut."""
    while at < len(t) and not _SPACE[t[at]]:
        at += 1
    return at


def windows(h: np.ndarray, k: int, factor: int = _QS) -> np.ndarray:
    """Hashes of the k-word windows at each position where one fits; order matters. Another odd factor gives another hash."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(factor)
        out += h[j : j + n]
    return out


def slices(column: pa.Array, rows: int, size: int = SEGMENT) -> list[tuple[int, int]]:
    """Ranges of a text column that hold at most so many rows and, one text apart, so many bytes."""
    out, begin, held = [], 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > begin and (i - begin == rows or held + n > size):
            out.append((begin, i))
            begin, held = i, 0
        held += n
    return [*out, (begin, len(column))] if len(column) else out
