"""Word shingles of texts as 64-bit hashes, in numpy over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about this many bytes, which bounds a task's memory: some sixty bytes for each.
RUN_BYTES = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and offsets into them; a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about RUN_BYTES each, at least one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A-Z are lower-cased; words are runs without space, tab, newline, vertical tab, form feed and carriage
    return. A text with fewer than `width` words has its whole sequence as one shingle; without words, none.
    """
    data, offsets = buffers(column)
    for first, end in runs(offsets):
        cut = offsets[first : end + 1] - offsets[first]
        raw = data[offsets[first] : offsets[end]]
        byte = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
        solid = ~((byte == 32) | ((byte >= 9) & (byte <= 13)))
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = cut[(cut < len(solid)) & (cut >= 0)]
        begins[inner] = solid[inner]
        starts = np.flatnonzero(begins)
        word = np.cumsum(begins) - 1
        at = np.arange(len(byte)) - starts[np.maximum(word, 0)] if len(starts) else np.zeros(len(byte), np.int64)
        values = np.where(solid, (byte.astype(np.uint64) + np.uint64(1)) * powers(_ODD, int(at[solid].max(initial=-1)) + 1)[np.where(solid, at, 0)], np.uint64(0)) if len(starts) else None
        words = mix(np.add.reduceat(values, starts)) if len(starts) else np.zeros(0, np.uint64)
        scale = powers(_ODD, width + 1)
        n = max(0, len(words) - width + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(width):
            grams += words[k : k + n] * scale[k]
        grams = mix(grams + np.uint64(width))
        bounds = np.searchsorted(starts, cut)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield mix(np.array([(words[a:b] * scale[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
