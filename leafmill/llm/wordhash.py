"""Vectorised word hashing over Arrow string columns.

Texts stay in Arrow's UTF-8 buffer; words are located by a 256-entry byte table and hashed with a
polynomial over prefix sums (mod 2**64), so the cost is a few nanoseconds a byte and no Python string
is made. Bytes are read in blocks cut between words, which bounds the temporary arrays.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; the temporary arrays are eight times that.
BLOCK = 1 << 18
MB = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


class Words(NamedTuple):
    """doc: row of each word; start, end: byte positions in the buffer; hash: 64 mixed bits."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def byte_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words are `[^\x20\x09-\x0D]+`.
NON_SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z has been lower-cased.
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return at - at[0], LOWER[raw] if lower else raw


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(kind: str, base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... mod 2**64, n of them at least."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 4096), base, dtype=np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; spans don't overlap and are in order."""
    out, lo = np.empty(len(start), dtype=np.uint64), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + BLOCK, side="right")))
        a = int(start[lo])
        out[lo:hi] = _span_hashes(data[a : int(end[hi - 1])], start[lo:hi] - a, end[lo:hi] - a)
        lo = hi
    return out


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers("p", _BASE, n + 1)[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * powers("i", _INVERSE, n + 1)[start])


def _block(data: np.ndarray, edges: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of one block; edges: positions where a word can't go on (starts of rows)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = table[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    opens, closes = inside & ~before, before & ~inside
    if len(edges):
        opens[edges] |= inside[edges]
        closes[edges] |= before[edges]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    return start, end, span_hashes(data, start, end)


def words(offsets: np.ndarray, data: np.ndarray, table: np.ndarray) -> Words:
    """The words of every row, in order."""
    parts, at, n = [], 0, len(data)
    while at < n:
        to, step = n, BLOCK
        while at + step < n:  # cut behind a separator or before a row, further on if a word is longer than the block
            window = data[at : at + step]
            k = int(np.searchsorted(offsets, at + step, side="right")) - 1
            cut = max(int(offsets[k]) - at, 0)
            stops = np.flatnonzero(~table[window[-4096:]])
            if len(stops):
                cut = max(cut, max(0, step - 4096) + int(stops[-1]) + 1)
            if cut > 0:
                to = at + cut
                break
            step *= 2
        lo, hi = np.searchsorted(offsets, at, side="left"), np.searchsorted(offsets, to, side="left")
        start, end, hashes = _block(data[at:to], np.unique(offsets[lo:hi] - at), table)
        parts.append((start + at, end + at, hashes))
        at = to
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64))
    start, end, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(np.searchsorted(offsets, start, side="right") - 1, start, end, hashes)


def windows(hashes: np.ndarray, size: int, seed: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every run of `size` neighbouring words, across rows too; one for each place where a run fits."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, q = np.zeros(n, np.uint64), 1
    for k in range(size):
        out += hashes[k : k + n] * np.uint64(q)
        q = q * (seed | 1) % (1 << 64)
    return mix(out)


def row_counts(doc: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(doc, minlength=rows)[:rows] if rows else np.zeros(0, np.int64)


def blocks(batch_rows: int, offsets: np.ndarray, most: int = 8 * MB):
    """Runs of rows (first, last exclusive) of about `most` bytes; a longer row stands alone."""
    first = 0
    while first < batch_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch_rows)
        yield first, last
        first = last
