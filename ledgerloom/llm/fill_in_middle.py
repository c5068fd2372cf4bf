"""Fill-in-the-middle texts, cut between units by bit-parallel work on big integers.

A text's bytes become one integer for each class of bytes (bytes.translate writes a binary digit a byte, the first byte
is the lowest bit). Shifts and boolean operations on these integers mark where units start, bit_count counts the units, and
the place of the k-th mark is found by halving the integer again and again. No loop runs over characters or units.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import other_columns

#: What stands before the prefix, the suffix and the middle (fixed values of the contract).
MARKERS = ("<P>", "<S>", "<M>")
UNITS = ("lines", "words", "chars")


def _digits(*chosen: int) -> bytes:
    """A table for bytes.translate: "1" for the chosen bytes, "0" for others."""
    return bytes(49 if b in chosen else 48 for b in range(256))


NEWLINE = _digits(10)
LEAD = _digits(*range(0x80), *range(0xC0, 0x100))
WORD = _digits(*(b for b in range(256) if b != 32 and not 9 <= b <= 13))


def bits(data: bytes, digits: bytes) -> int:
    """Bit k is set where byte k is of the class."""
    return int(data.translate(digits)[::-1] or b"0", 2)


def starts(data: bytes, unit: str) -> int:
    """Bits of the bytes at which units start; bit 0 is one of them unless there are no bytes.

    Lines end after a line break, words take the white space after them along, and the first what stands before it.
    """
    if not data:
        return 0
    if unit == "lines":
        return (bits(data, NEWLINE) << 1 | 1) & ((1 << len(data)) - 1)
    if unit == "chars":
        return bits(data, LEAD) | 1
    word = bits(data, WORD)
    first = word & ~(word << 1)
    return first & (first - 1) | 1 if first else 1


def select(mask: int, rank: int, width: int) -> int:
    """The place of the set bit that has `rank` set bits below it, in a mask of `width` bits."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, rank, at, width = mask >> half, rank - below, at + half, width - half
    return at


def cut(data: bytes, first: int, second: int, unit: str) -> tuple[int, int, int]:
    """Number n of units, and the bytes after which prefix and middle end: after first % (n + 1) and second % (n + 1) units, the smaller first."""
    marks = starts(data, unit)
    n = marks.bit_count()
    ranks = sorted((first % (n + 1), second % (n + 1)))
    a, b = (len(data) if r == n else select(marks, r, len(data)) for r in ranks)
    return n, a, b


def _draws(seed: int, key: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4]) for k in range(4)]


def arrange(data: bytes, key: str, seed: int, rate: int, spm: int, unit: str, markers: tuple[bytes, ...]) -> tuple[int, str, bytes, int | None, int | None]:
    """(n, form, output, prefix_chars, middle_chars) of one text."""
    h1, h2, h3, h4 = _draws(seed, key)
    n, a, b = cut(data, h1, h2, unit)
    if not data or any(m in data for m in markers) or h3 % 100 >= rate:
        return n, "plain", data, None, None
    if data.isascii():
        chars = a, b - a
    else:
        lead = bits(data, LEAD)
        before = (lead & ((1 << a) - 1)).bit_count()
        chars = before, (lead & ((1 << b) - 1)).bit_count() - before
    p, s, m = markers
    if h4 % 100 < spm:
        return n, "spm", b"".join((s, data[b:], p, data[:a], m, data[a:b])), *chars
    return n, "psm", b"".join((p, data[:a], s, data[b:], m, data[a:b])), *chars


def _tangled(markers: tuple[str, ...]) -> bool:
    """Whether a marker could be found across the edge of another."""
    pairs = [(x, y) for i, x in enumerate(markers) for j, y in enumerate(markers) if i != j]
    return any(x in y for x, y in pairs) or any(x[-k:] == y[:k] for x in markers for y in markers for k in range(1, min(len(x), len(y))))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "lines", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """docs (doc_id, text, others) with n, form, output, prefix_chars and middle_chars; one row for each row, without a shuffle.

    The units (lines, words or chars) are cut at two places that the SHA-256 of "seed:doc_id" draws. rate of a hundred texts
    are rearranged, spm of a hundred of these with the suffix first; the others, empty texts (null ones count as empty) and texts that hold
    a marker stay plain: output is the text, and prefix_chars and middle_chars are null. A null doc_id draws as an empty one; equal
    ids draw alike. Columns of docs with a result's name are left out, all others stay. Work and memory are
    linear in a text's bytes; a text is never looked at in part.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    if len(markers) != 3 or not all(markers) or _tangled(markers):
        raise ValueError("three markers are needed of which none holds another or starts as one ends")
    raw = tuple(m.encode() for m in markers)

    @F.arrow_udf("n bigint, form string, output binary, prefix_chars bigint, middle_chars bigint")
    def arranged(texts: pa.Array, keys: pa.Array) -> pa.Array:
        rows = [arrange(t.as_buffer().to_pybytes() if t.is_valid else b"", k or "", seed, rate, spm, unit, raw) for t, k in zip(texts, keys.to_pylist(), strict=True)]
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
        kinds = {"n": pa.int64(), "form": pa.string(), "output": pa.binary(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    results = ("n", "form", "output", "prefix_chars", "middle_chars")
    made = arranged(F.col("text").cast("binary"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    out = docs.select(*other_columns(docs, *results), made.alias("output"))
    fields = [F.col(f"output.{c}").alias(c) for c in results]
    fields[2] = F.col("output.output").cast("string").alias("output")
    return out.select(*other_columns(out, "output"), *fields)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that transform() made output from, exactly. No marker can stand across the edge of another, as transform() checks."""
    p, s, m = markers

    def between(start: Column, end: Column) -> Column:
        return F.substr(output, start, end - start)

    at_p, at_s = F.locate(p, output), F.locate(s, output)
    at_m, after = F.locate(m, output), F.length(output) + 1
    middle = between(at_m + len(m), after)
    psm = F.concat(between(F.lit(1 + len(p)), at_s), middle, between(at_s + len(s), at_m))
    spm = F.concat(between(at_p + len(p), at_m), middle, between(F.lit(1 + len(s)), at_p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
