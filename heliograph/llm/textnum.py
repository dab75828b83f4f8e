"""Vectorised text primitives over Arrow string buffers.

Nothing here loops over characters or words in Python: words, word hashes and character
n-grams of a whole chunk of documents come out of a handful of numpy passes over the bytes.

Words are maximal runs of bytes above 0x20 (so ASCII white space and control bytes separate
words; every UTF-8 multi-byte character is part of a word).  Hashes ignore ASCII case.
Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass works on; bounds a worker's memory, not the work done.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # ASCII upper case hashes as lower case
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_IS_WORD = np.arange(256) > 0x20
_pow: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for spans of a chunk: their size is fixed, whatever the texts."""
    if not _pow:
        for base in (_BASE, _INV):
            p = np.full(CHUNK_BYTES + 1, base, np.uint64)
            p[0] = 1
            _pow.append(np.cumprod(p, dtype=np.uint64))
    return _pow


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0 and nulls have length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    n = len(col)
    if col.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    offs = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes, one row at least."""
    data, offs = buffers(col)
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of each word of the chunk and the index of each document's first word."""
    is_word = np.empty(len(data) + 1, bool)
    np.take(_IS_WORD, data, out=is_word[:-1])
    is_word[-1] = False
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    edge = offs[1:-1]
    first[edge] = is_word[edge]
    starts = np.flatnonzero(first)
    last = is_word[:-1] & ~is_word[1:]
    inner = edge[edge > 0] - 1
    last[inner] = is_word[inner]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (in order, none overlapping), from prefix sums of a polynomial modulo 2**64, CHUNK_BYTES at a time."""
    up, down = _powers()
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        end = int(np.searchsorted(ends, base + CHUNK_BYTES, side="right"))
        if end <= at:  # one span longer than a chunk
            out[at] = _long_span(data[base : ends[at]])
            at += 1
            continue
        part = data[base : ends[end - 1]]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        s = starts[at:end] - base
        out[at:end] = (total[ends[at:end] - base] - total[s]) * down[s]
        at = end
    return mix64(out)


def _long_span(span: np.ndarray) -> np.uint64:
    up, h = _powers()[0], 0
    for i in range(0, len(span), CHUNK_BYTES):
        part = span[i : i + CHUNK_BYTES]
        h += int((_BYTE[part] * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), i, 1 << 64)
    return np.uint64(h % (1 << 64))


def hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first word of each document) of a chunk."""
    starts, ends, first = words(data, offs)
    return span_hashes(data, starts, ends), starts, ends, first


_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries (len - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _MULT[0]
    for j in range(1, k):
        out += h[j : j + n] * _MULT[j % 64]
    return mix64(out)


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in characters) of a chunk of UTF-8 texts."""
    lead, at = (data & 0xC0) != 0x80, np.zeros(len(offs), np.int64)
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        at[some + 1] = np.add.reduceat(lead, offs[some], dtype=np.int64)
    text = data.tobytes().decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.cumsum(at)
