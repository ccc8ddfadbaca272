"""Vectorised views of Arrow text batches: words, shingles and rolling hashes.

A batch's UTF-8 buffer is read in blocks of a few MB (a longer text is a
block of its own), so temporaries stay bounded whatever the batch holds.
Nulls read as empty texts. Hashes depend on content alone, never on the
position, the batch or the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE)) | _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, _U)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have, dtype=_U)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any span."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_VALUE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def hash_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums like those of ``prefix_hash``, of hashes."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) for arrays of positions."""
    return mix((prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start])


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of each block."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
        stop = min(stop, n)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


SPACED = word_table(b" \t\n\x0b\x0c\r")


class Words:
    """Words of a block: byte ``start`` and ``end``, ``hash``, and ``first``, the first word of each row (and the total)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, lower: bool = True):
        inside = table[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        begins[cut] |= inside[cut]
        ends[cut - 1] |= inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.text = LOWER[data] if lower else data
        self.hash = span_hash(prefix_hash(self.text), self.start, self.end)
        self.first = np.searchsorted(self.start, offsets, "left")


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words, none."""
    with np.errstate(over="ignore"):
        factor = mix(np.arange(1, k + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
        h, n = words.hash, len(words.hash)
        whole = np.zeros(max(0, n - k + 1), _U)
        for j in range(k):
            whole += h[j : n - k + 1 + j] * factor[j] if n >= k else _U(0)
        whole = mix(whole)
        out = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(whole[a : b - k + 1]))
            elif b > a:
                out.append(mix(np.array([(h[a:b] * factor[: b - a]).sum(dtype=_U) + _U(b - a)], _U)))
            else:
                out.append(np.zeros(0, _U))
    return out


def column_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, data, offsets in blocks(column):
        yield from shingle_sets(Words(data, offsets), k)


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return values.astype(_U).view(np.int64)
