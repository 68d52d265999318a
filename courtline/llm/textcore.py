"""Vectorised text helpers that run inside Spark tasks.

Texts arrive as Arrow strings; everything here works on the UTF-8 bytes of a few
megabytes at a time, so a task's memory does not depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once (a longer document is worked on alone).
CHUNK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: list[np.ndarray] = []
#: Blocks of 8 bytes that are hashed for all words at once; longer words are rare.
BLOCKS = 4
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about CHUNK_BYTES of text: the rows, their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = utf8_parts(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers[:] = []
        for base in (_BASE, _BASE_INV):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table))
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= _C1
    h ^= h >> np.uint64(29)
    h *= _C2
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64; span_hash takes the hash of any span from them.

    For spans of up to 512 units: from 1,024 on two spans can be built that cancel out.
    """
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers(len(units))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def run_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """The hash of every span of `width` units."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * powers(len(sums))[1][:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    return np.minimum(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ([^\\x20\\x09-\\x0D]+), and the word offsets of the rows."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(off), np.int64)
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    rows = off[:-1][off[1:] > off[:-1]]
    first[rows] = inside[rows]
    ends = off[1:][off[1:] > off[:-1]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: blocks of 8 bytes mixed one after another, words beyond BLOCKS of these by xxh3.

    Not a polynomial of the bytes: modulo 2**64 some long words would cancel out. Words of one length
    up to 8 bytes never share a hash.
    """
    sizes = ends - starts
    out = mix((sizes.astype(np.uint64) + np.uint64(1)) * _BASE)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    for block in range(BLOCKS):
        at = np.flatnonzero(sizes > 8 * block) if block else np.flatnonzero(sizes > 0)
        if not len(at):
            break
        left = np.minimum(sizes[at] - 8 * block, 8)
        bytes_ = np.ascontiguousarray(padded[(starts[at] + 8 * block)[:, None] + np.arange(8)]).view("<u8")[:, 0]
        out[at] = mix(out[at] ^ (bytes_ & _FIRST[left]))
    raw = data.tobytes() if (sizes > 8 * BLOCKS).any() else b""
    for i in np.flatnonzero(sizes > 8 * BLOCKS):
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


def segments(units: np.ndarray, off: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Splits every row's windows of `width` units by their least `gram`-unit hash.

    Equal windows have equal buckets wherever they are, and neighbouring windows with
    the same anchor form one segment. Returns row, start, windows, bucket, content hash.
    """
    n = len(units)
    if n < width:
        zero = np.zeros(0, np.int64)
        return {"row": zero, "start": zero, "n": zero, "bucket": zero, "seg": zero}
    sums = prefix_sums(units)
    grams = run_hash(sums, gram)
    at = sliding_min((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), width - gram + 1) & _LOW
    bound = np.zeros(len(at) + 1, np.int32)  # windows that cross rows don't count
    long_rows = off[1:] - off[:-1] >= width
    bound[off[:-1][long_rows]] += 1
    np.subtract.at(bound, off[1:][long_rows] - width + 1, 1)
    at[np.cumsum(bound[:-1]) == 0] = _NONE
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))
    real = at[starts] != _NONE
    starts, ends = starts[real], ends[real]
    return {
        "row": np.searchsorted(off, starts, "right") - 1,
        "start": starts,
        "n": ends - starts,
        "bucket": grams[at[starts].astype(np.int64)].view(np.int64),
        "seg": span_hash(sums, starts, ends - 1 + width).view(np.int64),
    }


def covered(start: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` units are in any of the spans."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.subtract.at(edge, np.minimum(start + length, size), 1)
    return np.cumsum(edge[:-1]) > 0


def take_row(batch: pa.RecordBatch, name: str, rows: np.ndarray) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).take(pa.array(rows, pa.int64()))
