"""numpy kernels over the bytes of Arrow string columns; they run in Python workers, a bounded chunk at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 19
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """offsets (n + 1) and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges of rows with about ``limit`` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers without visible structure."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[tuple, np.ndarray] = {}


def powers(n: int, inverse: bool = False, which: int = 0) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, or of the inverse base; ``which`` picks one of several independent bases."""
    name = (inverse, which)
    if len(_powers.get(name, ())) < n:
        size = max(n, CHUNK + 4096)
        base = (_BASE + which * 0x3C6EF372FE94F82A) & ((1 << 64) - 1) | 1
        steps = np.full(size, pow(base, -1, 1 << 64) if inverse else base, U)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=U)
    return _powers[name][:n]


def byte_codes(lower: bool, which: int = 0) -> np.ndarray:
    """A random 64-bit code for each byte; with ``lower``, A-Z have the codes of a-z."""
    codes = mix64(np.arange(1 + which * 256, 257 + which * 256, dtype=U) * U(0xD1342543DE82EF95))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def prefix_hash(data: np.ndarray, lower: bool = False, which: int = 0) -> np.ndarray:
    """Wrapping running sums (n + 1) of code(byte) * base ** position."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(byte_codes(lower, which)[data] * powers(len(data), False, which), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    inverse = powers(len(sums), True, which)
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and each row's first word (n + 1). ``offsets`` start at 0."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = ~_WHITE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return span_hash(prefix_hash(data, True), starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Each row's distinct word shingles as sorted hashes; fewer words give one shingle, none give an empty set."""
    hashes, first = word_hashes(data, offsets)
    factors = mix64(np.arange(1, words + 1, dtype=U) * U(0xA24BAED4963EE407)) | U(1)
    total = len(hashes) - words + 1
    rolled = np.zeros(max(total, 0), U)
    for k in range(words if total > 0 else 0):
        rolled += hashes[k : k + total] * factors[k]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(rolled[a : b - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix64(np.array([(hashes[a:b] * factors[: b - a]).sum() + U(b - a)], U)))
        else:
            out.append(np.zeros(0, U))
    return out
