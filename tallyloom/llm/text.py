"""Byte-level helpers shared by the text operators.

All of them work on Arrow string buffers with NumPy, one record batch at a
time, so that no Python object is made per word. A word is a maximal run of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased: ASCII digits,
ASCII letters and every non-ASCII code point. In UTF-8 that class can be told
from single bytes, since all bytes of a non-ASCII code point are 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z and turns each byte outside words into a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_MIX = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(int(_ODD), -1, 2**64))


def words(text: str | None) -> list[bytes]:
    """The words of one text, lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. offsets has one more entry than the column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, but one row at least.

    Bounds what the NumPy steps hold, whatever size Spark gives its Arrow batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        for k, base in enumerate((_ODD, _ODD_INV)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[k] = p
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums h with h[e] - h[s] the polynomial hash of raw[s:e], times a power of the base; see range_hash."""
    up, _ = _powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_MIX[raw] * up[:-1], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end] that depend on the bytes alone."""
    _, down = _powers(len(prefix) - 1)
    return mix((prefix[end] - prefix[start]) * down[start] ^ (end - start).astype(np.uint64))


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased and other non-word bytes as spaces, starts, ends, first word of each text).

    The last has one more entry than there are texts. Words never cross texts."""
    low = np.frombuffer(raw.tobytes().translate(WORD_TABLE), np.uint8)
    inside = np.zeros(len(low) + 1, bool)
    np.not_equal(low, 32, out=inside[:-1])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(low))]
    both = cut[inside[cut - 1] & inside[cut]]  # two texts that touch
    first[both] = True
    last[both - 1] = True
    starts = np.flatnonzero(first[:-1])
    ends = np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, at)


def pieces(raw: np.ndarray, inside: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive parts of the buffer of about ``most`` bytes; none ends between two bytes of which
    ``inside``, a table by byte, is true."""
    start = 0
    while start < len(raw):
        end = min(len(raw), start + most)
        while end < len(raw) and inside[raw[end]]:
            part = inside[raw[end : end + 4096]]
            end += len(part) if part.all() else int(part.argmin())
        yield start, end
        start = end


_WORD_BYTE = np.frombuffer(WORD_TABLE, np.uint8) != 32


def hashed_words(raw: np.ndarray, at: np.ndarray, most: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start of every word, first word of each text), as in ``word_spans``; a large buffer is taken in parts, so that
    what is held is some 16 bytes a word."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in pieces(raw, _WORD_BYTE, most):
        inner = at[np.searchsorted(at, a, "right") : np.searchsorted(at, b)] - a
        low, ws, we, _ = word_spans(raw[a:b], np.concatenate(([0], inner, [b - a])))
        hashes.append(range_hash(prefix_hash(low), ws, we))
        starts.append(ws + a)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.searchsorted(start, at)


def shingles(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every k consecutive words, the text of each). A text of fewer words, but not none, has one."""
    w, _, first = hashed_words(raw, at)
    n = np.diff(first)
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    text = np.repeat(np.arange(len(n)), count)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    start = first[:-1][text] + np.arange(len(text)) - begin[text]
    out = np.zeros(len(text), np.uint64)
    length = np.minimum(n[text], k)
    for j in range(k):
        use = j < length
        step = mix(w[np.minimum(start + j, len(w) - 1)] + np.uint64((2 * j + 1) * int(_ODD) % 2**64))
        out += np.where(use, step, np.uint64(0))
    return mix(out ^ length.astype(np.uint64)), text
