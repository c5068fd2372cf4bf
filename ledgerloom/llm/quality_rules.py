"""Quality rules: a table of thresholds compiled into one projection, without user functions.

measures() gives every number the rules may name, as columns of each row; verdict() compiles a
table of thresholds over them. A document is judged by its own row alone: no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, other_columns

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the four languages (fixed values), in lower case.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du en est et la le les par pas pour que qui sur un une "
    "auf das dem den der die ein eine für ist mit nicht sich und von zu "
    "al con del el es las los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes while lowest <= measure <= highest; None: no bound. measure is a measure, or two as "a / b"."""

    name: str
    measure: str
    lowest: float | None = None
    highest: float | None = None


#: Production thresholds. Ratios of symbols, shouting and doubled lines are wide: clean text is far below them.
RULES = (
    Rule("length", "n_words", 20, None),
    Rule("word_length", "word_chars / n_words", 1.5, 20),
    Rule("symbols", "n_symbols / n_words", None, 0.3),
    Rule("shouting", "n_marks / n_words", None, 0.5),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None),
    Rule("doubled_lines", "n_dup_lines / n_lines", None, 0.5),
)


def measures(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Numbers of one text (not null): those of its characters and lines, and structs of those of its lines and words.

    word_chars (code points in words), n_symbols, n_marks (exclamation marks), n_lines (lines with a
    word), n_dup_lines (such lines equal to an earlier one); n_words, n_stop_words, n_repeat_words.
    The split words are bound once: an expression used inside a lambda is computed again for every item.
    """
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    of_words = let(
        F.array_remove(F.split(text, SPACE), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_text = {
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_marks": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
    }
    return of_text, {"of_lines": of_lines, "of_words": of_words}


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, width: int = 8) -> Column:
    """Words in windows of `width` words that occur twice or more in the text, the first included.

    Windows are told apart by a 64-bit hash. Their hashes are sorted with their places only in texts
    that repeat one; a place then counts up to the next repeated place, `width` words at most. So
    the work grows as n log n with the words of a text.
    """
    n = F.size(words) - width + 1
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, width)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, width)))
    return F.when(n < 2, F.lit(0)).otherwise(found).cast("long")


def _covered(hashes: Column, width: int) -> Column:
    def places(ranked: Column) -> Column:
        last = F.size(ranked) - 1
        same = lambda k: F.get(ranked, k).getField("h") == F.get(ranked, k + 1).getField("h")
        picked = F.filter(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda k: F.when(((k > 0) & same(k - 1)) | ((k < last) & same(k)), F.get(ranked, k).getField("i")),
            ),
            lambda x: x.isNotNull(),
        )
        return let(F.array_sort(picked), gaps)

    def gaps(at: Column) -> Column:
        last = F.size(at) - 1
        return F.aggregate(
            F.sequence(F.lit(0), last),
            F.lit(0),
            lambda acc, k: acc + F.when(k < last, F.least(F.lit(width), F.get(at, k + 1) - F.get(at, k))).otherwise(F.lit(width)),
        )

    return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one boolean over columns named like the measures. A ratio over nothing passes."""
    kept = F.lit(True)
    for r in rules:
        over, _, under = r.measure.partition(" / ")
        value = F.col(over) / F.nullif(F.col(under), F.lit(0)) if under else F.col(over)
        for bound, fits in ((r.lowest, value >= F.lit(r.lowest)), (r.highest, value <= F.lit(r.highest))):
            if bound is not None:
                kept = kept & F.coalesce(fits, F.lit(True))
    return kept


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """docs with the measures, n_repeat_words, base_failed and kept; one row for each row.

    base_failed: fewer than min_words words, or more than repeat_percent % of the words in repeated
    8-word windows. A null or empty text has no words and fails; a very long one is judged whole. Repeated rows
    and null ids are rows like others. Columns of docs named like a result, in any case, are replaced; all
    others pass, whatever their names.
    """
    of_text, structs = measures(F.coalesce(F.col(text), F.lit("")))
    fields = {"of_lines": ("n_lines", "n_dup_lines"), "of_words": ("n_words", "n_stop_words", "n_repeat_words")}
    results = [*of_text, *(f for x in fields.values() for f in x)]
    # the columns of docs are kept apart from those of the plan
    row = F.struct(*other_columns(docs, *results, "base_failed", "kept")).alias("row")
    out = docs.select(row, *(c.alias(k) for k, c in (of_text | structs).items()))
    out = out.select("row", *of_text, *(F.col(f"{k}.{f}").alias(f) for k, x in fields.items() for f in x))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return out.withColumn("failed", failed).select("row.*", *results, F.col("failed").alias("base_failed"), (~F.col("failed") & verdict(rules)).alias("kept"))
