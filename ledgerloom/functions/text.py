"""Text rules of the conformance layer, all as built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def decompositions(form: str) -> dict[str, str]:
    """Characters of the basic plane and what is left of their decomposition ("NFD", "NFKD") without marks; for NFKD, in ASCII."""
    found = {}
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x10000)):
        parts = unicodedata.normalize(form, chr(code))
        left = "".join(c for c in parts if (c < "\x80" if form == "NFKD" else unicodedata.category(c) != "Mn"))
        if parts != chr(code) and left and left != chr(code) and (form == "NFKD" or len(left) == 1):
            found[chr(code)] = left
    return found


#: Characters of several ASCII letters that texts do hold; others of that kind are dropped.
COMPATIBLE = "ﬀﬁﬂﬃﬄﬅﬆ½¼¾…™№℡Ĳĳ"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def plain_letters(x: Column) -> Column:
    """Without accents, whether they are part of the letter or marks of their own."""
    table = decompositions("NFD")
    plain = F.regexp_replace(F.translate(x, "".join(table), "".join(table.values())), r"\p{Mn}", "")
    return F.when(x.rlike(r"[^\x00-\x7F]"), plain).otherwise(x)


def one_line(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def fold_name(x: Column) -> Column:
    """Trimmed, upper case, without accents, runs of white space as one blank."""
    return one_line(F.upper(plain_letters(x)))


def fold_label(x: Column) -> Column:
    return F.lower(fold_name(x))


def ascii_label(x: Column) -> Column:
    """Like fold_label, but compatible forms count too (ligatures, full width, fractions), and characters without an ASCII form are dropped."""
    table = decompositions("NFKD")
    single = {k: v for k, v in table.items() if len(v) == 1}
    plain = F.translate(x, "".join(single), "".join(single.values()))
    for many, long in ((k, v) for k, v in table.items() if len(v) > 1 and k in COMPATIBLE):
        plain = F.replace(plain, F.lit(many), F.lit(long))
    return one_line(F.lower(F.regexp_replace(F.when(x.rlike(r"[^\x00-\x7F]"), plain).otherwise(x), r"[^\x00-\x7F]", "")))


def shape_mask(x: Column) -> Column:
    """Digits as 9, ASCII letters as A; what else there is stays."""
    return F.regexp_replace(F.regexp_replace(x, r"[0-9]", "9"), r"[A-Za-z]", "A")


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def sentinel_to_null(x: Column, sentinel: str = "N/A") -> Column:
    return F.when(F.upper(F.trim(x)) != sentinel, x)


def tax_id_valid(x: Column) -> Column:
    """Whether 11 digits have right check digits; null unless there are 11; false if all are equal."""
    def right(d: Column) -> Column:
        last = F.substring(d, 10, 2)
        return (F.concat(check_digit(d, 9), check_digit(d, 10)) == last) & ~d.rlike(r"^([0-9])\1{10}$")

    # the digits are bound once, the sum is one loop over them
    return F.element_at(F.transform(F.array(digits(x)), lambda d: F.when(F.length(d) == 11, right(d))), 1)


def check_digit(d: Column, n: int) -> Column:
    """The check digit of the first n digits of d, as text."""
    weighed = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda acc, i: acc + d.substr(i, F.lit(1)).cast("int") * (n + 2 - i))
    return F.pmod(F.pmod(weighed * 10, F.lit(11)), F.lit(10)).cast("string")


def phone_digits(x: Column) -> Column:
    """Digits of a phone without the country code."""
    return F.regexp_replace(digits(x), r"^55(?=[0-9]{10,11}$)", "")


def looks_garbled(x: Column) -> Column:
    """UTF-8 read as Latin-1, or the replacement character."""
    return x.rlike("Ã[^A-Za-z ]") | (F.instr(x, "�") > 0)


def has_line_break(x: Column) -> Column:
    return x.rlike("[\r\n]")


def part(x: Column, mark: str, n: int) -> Column:
    """The n-th part between marks, null beyond the last."""
    return F.get(F.split(x, mark), F.lit(n - 1))


def reference(x: Column) -> tuple[Column, Column]:
    """System and number of references, LEG-12 or ECOM-12; null where the text is none."""
    found = lambda g: F.nullif(F.regexp_extract(x, r"^(LEG|ECOM)-([0-9]+)$", g), F.lit(""))
    return found(1), found(2).try_cast("bigint")


def without_note(x: Column) -> Column:
    """A reason without the note that agents append."""
    return F.regexp_replace(x, r"(?is)\s*obs:.*$", "")
