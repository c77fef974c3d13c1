"""Vectorised word and k-gram hashing over Arrow string buffers.

All functions work on the UTF-8 bytes of many texts at once.  Every byte of a code point above 0x7F is a word
byte under both word rules in use, so splitting bytes and splitting code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one numpy pass; bounds the memory of a Python worker (about 60 bytes per byte).
CHUNK_BYTES = 1 << 19

pa.set_memory_pool(pa.system_memory_pool())  # a worker gives freed batches back instead of keeping them

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_MASK = (1 << 64) - 1


def _table(is_word) -> np.ndarray:
    """Byte -> byte with A-Z lower-cased, 0 for a byte that ends a word."""
    return np.array([(b + 32 if 65 <= b <= 90 else b) if is_word(b) else 0 for b in range(256)], np.uint8)


#: Words ``[^\x20\x09-\x0D]+``; a NUL byte is a word byte, so it gets a code of its own (0xFF never occurs in UTF-8).
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
SPACED[0] = 0xFF
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = _table(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


_VALUE = np.array([_splitmix(i) | 1 for i in range(256)], _U)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n, kept for the next call."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, _U), np.full(size, _U(pow(int(_BASE), -1, 1 << 64)), _U)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return (data[offs[0] : offs[-1]], offs - offs[0]) if len(offs) else (data[:0], np.zeros(1, np.int64))


def chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about CHUNK_BYTES of text each (one longer text alone), with the text column's bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
            at = end


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and, per text, the index of its first word (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offs), np.int64)
    low = table[data]
    is_word = low != 0
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    edges = offs[:-1][offs[:-1] < offs[1:]]
    first[edges] = is_word[edges]
    starts = np.flatnonzero(first)
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUE[low] * up[: len(data)], dtype=_U, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x2545F4914F6CDD1D))
    return hashes, np.searchsorted(starts, offs)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and per text the index of its first k-gram.

    A text of fewer than k words has none here (see ``whole``)."""
    n = np.diff(first)
    kept = np.maximum(n - k + 1, 0)
    out_first = np.concatenate(([0], np.cumsum(kept)))
    if not out_first[-1]:
        return np.zeros(0, _U), out_first
    size = len(hashes) - k + 1
    h = hashes[:size].copy()
    for j in range(1, k):
        h = mix(h) + hashes[j : j + size] * _U(0x9E3779B97F4A7C15)
    h = mix(h + _U(k))
    at = np.repeat(first[:-1] - out_first[:-1], kept) + np.arange(out_first[-1])
    return h[at], out_first


def whole(hashes: np.ndarray, lo: int, hi: int) -> np.uint64:
    """The same hash for words lo..hi-1 as ``grams`` with k = hi - lo gives."""
    return grams(hashes[lo:hi], np.array([0, hi - lo]), hi - lo)[0][0]


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each full window of w values the index of its smallest, the rightmost among equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(h))
    span = 1
    while span < w:
        step = min(span, w - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] <= h[a], b, a)
        span += step
    return at


def winnow(h: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Indices that are the minimum of some window of w values inside one text; a shorter text gives its minimum.

    Rightmost minimum on ties, so equal spans select equal places whatever surrounds them."""
    n = np.diff(first)
    out = []
    if len(h) >= w:
        at = window_argmin(h, w)
        begin = np.arange(len(at))
        text = np.searchsorted(first, begin, "right") - 1
        at = at[begin + w <= first[text + 1]]
        if len(at):
            out.append(at[np.concatenate(([True], at[1:] != at[:-1]))])
    for t in np.flatnonzero((n > 0) & (n < w)):
        part = h[first[t] : first[t + 1]]
        out.append(np.array([first[t] + len(part) - 1 - int(np.argmin(part[::-1]))]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
