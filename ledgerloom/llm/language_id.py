"""Language identification by bit-sliced Bloom filters of character n-grams.

All languages share one filter: a cell for each hash place, with a bit for each language. The cells of an n-gram's places,
joined by AND, are the mask of all languages that hold it (and of some that do not, at a known rate). A text's languages are
counted over the masks of all its n-grams; each count is corrected for its language's rate of false positives, and the
largest decides.

The n-grams are trigrams of letters in lower case with a blank at either end of a word, packed exactly into 63 bits and
mixed one to one, so that only the filter itself can err.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import other_columns, saved

#: A language holds the n-grams that are at least this share of all it has (so 1 / RATE n-grams at most), unless another
#: language has them at more than 1 / SHARE times that share (passages in other languages).
RATE, SHARE = 2e-5, 0.1
#: Hash places of an n-gram, cells for each n-gram of the fullest language at least, languages at most.
PLACES, CELLS, LANGUAGES = 4, 12, 512
#: Code points looked at together, and n-grams counted in a task before they are sent on.
CHUNK, HELD = 1 << 19, 1 << 18
BLANK = 32
WORD = 62  # languages in a word of a cell; the sign bit stays free
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit words."""
    x = x.astype(np.uint64)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, its code points in lower case) for pieces of texts of CHUNK code points or so, whole texts in all.

    Between two texts and at a piece's ends stand blanks; a longer text's pieces overlap by two code points, so that no trigram is lost.
    """
    owners: list[np.ndarray] = []
    points: list[np.ndarray] = []
    held = 0
    for k, text in enumerate(texts):
        if not text.is_valid:
            continue
        codes = np.frombuffer(text.as_py().lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, max(1, len(codes)), CHUNK):
            piece = codes[max(0, at - 2) : at + CHUNK]
            ends = ([BLANK] if at == 0 else [], [BLANK] if at + CHUNK >= len(codes) else [])
            points.append(np.concatenate([np.array(ends[0], np.uint32), piece, np.array(ends[1], np.uint32)]))
            owners.append(np.full(len(points[-1]), k, np.int32))
            held += len(piece)
            if held >= CHUNK:
                yield np.concatenate(owners), np.concatenate(points)
                owners, points, held = [], [], 0
    if points:
        yield np.concatenate(owners), np.concatenate(points)


def grams(owners: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, mixed trigram) of each trigram around a letter; what is no letter counts as a blank."""
    points = np.where(_letters()[points], points, BLANK).astype(np.uint64)
    middle = (points[1:-1] != BLANK) & (owners[:-2] == owners[2:])
    place = np.flatnonzero(middle)
    packed = points[place] << np.uint64(42) | points[place + 1] << np.uint64(21) | points[place + 2]
    return owners[place + 1], mixed(packed)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, gram, n); a task holds HELD different n-grams and one piece's at most."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (names, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in set(langs):
            texts = batch.column(1).filter(pa.array([x == lang for x in langs]))
            for owners, points in chunks(texts):
                own = np.unique(grams(owners, points)[1], return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], own[0]])
                    names, at = np.unique(both, return_inverse=True)
                    n = np.zeros(len(names), np.int64)
                    np.add.at(n, at, np.concatenate([held[lang][1], own[1]]))
                    own = names, n
                held[lang] = own[0], own[1].astype(np.int64)
                if sum(len(names) for names, _ in held.values()) > HELD:
                    yield from flush()
    yield from flush()


@dataclass
class Model:
    """languages by bit, their numbers of rated texts, cells (a row a cell, a word for 62 languages) and each bit's false positive rate."""

    languages: list[str]
    texts: np.ndarray
    cells: np.ndarray
    errors: np.ndarray

    def masks(self, found: np.ndarray) -> np.ndarray:
        """The languages' words of each n-gram: the AND of its cells."""
        low, step = found & np.uint64(0xFFFFFFFF), found >> np.uint64(32) | np.uint64(1)
        out = np.full((len(found), self.cells.shape[1]), -1, np.int64)
        for k in range(PLACES):
            out &= self.cells[((low + np.uint64(k) * step) & np.uint64(len(self.cells) - 1)).astype(np.int64)]
        return out

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n_texts, n_languages = len(texts), len(self.languages)
        total, counts = np.zeros(n_texts), np.zeros((n_texts, n_languages))
        for owners, points in chunks(texts):
            owner, found = grams(owners, points)
            total += np.bincount(owner, minlength=n_texts)
            masks = self.masks(found)
            for bit in range(n_languages):
                here = masks[:, bit // WORD] >> (bit % WORD) & 1
                counts[:, bit] += np.bincount(owner, weights=here, minlength=n_texts)
        if not n_languages:
            return [UNKNOWN] * n_texts, np.zeros(n_texts)
        share = counts / np.maximum(total, 1)[:, None]
        share = np.clip((share - self.errors) / (1 - self.errors), 0, 1)
        order = np.lexsort((np.arange(n_languages), -self.texts))  # of equal shares, the language with more texts, then by name
        best = order[np.argmax(share[:, order], axis=1)]
        known = total > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, share[np.arange(n_texts), best], 0.0)


def fit(docs: DataFrame, rate: float = RATE, share: float = SHARE) -> Model:
    """The filters of all languages in docs (text, lang); rows with a null in either teach nothing.

    Every n-gram of every text is counted. What comes to the driver are the filter's cells: a language has 1 / rate n-grams at
    most, so 2 * CELLS / rate cells bound it, 9.6 MB for up to 62 languages at the default rate and as much again for each further 62. More than
    LANGUAGES languages are an error. Repeated rows count repeatedly.
    """
    given = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    texts = {r.lang: r.n for r in given.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()}
    if len(texts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(texts)
    if not languages:
        return Model([], np.zeros(0), np.zeros((1, 1), np.int64), np.zeros(0))
    counted = given.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = saved(counted, "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counted.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= rate)
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
    held = saved(rates.join(most, "gram").where(F.col("rate") >= share * F.col("most")).select("lang", "gram"), "held")
    fullest = held.groupBy("lang").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    size = 1 << max(6, (CELLS * fullest - 1).bit_length())
    number = F.create_map(*(F.lit(x) for pair in zip(languages, range(len(languages)), strict=True) for x in pair))[F.col("lang")]
    step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    places = F.array(*(F.pmod(F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(k) * step, F.lit(size)) for k in range(PLACES)))
    bit = F.expr(f"shiftleft(1L, int(bit % {WORD}))")
    rows = held.select(number.alias("bit"), F.explode(places).alias("cell")).groupBy("cell", F.floor(F.col("bit") / WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))
    cells = np.zeros((size, 1 + (len(languages) - 1) // WORD), np.int64)
    for batch in rows.toLocalIterator():
        cells[batch.cell, batch.word] = batch.bits
    filled = np.array([(cells[:, b // WORD] >> (b % WORD) & 1).mean() for b in range(len(languages))])
    return Model(languages, np.array([texts[x] for x in languages]), cells, np.minimum(filled**PLACES, 0.999))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, row by row without a shuffle.

    lang_pred is a language of the model, or "und" where the text is null, empty or without letters, or the model
    knows no language. score, from 0 to 1, is the share of the text's n-grams that the language holds, corrected for false positives.
    Where no language holds any, or several as many, that with more rated texts is taken, then the first by name. Whole texts
    are read, in pieces; columns of docs named like a result are left out, all others stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def decided(texts: pa.Array) -> pa.Array:
        languages, scores = sent.value.decide(texts)
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    out = docs.select(*other_columns(docs, "lang_pred", "score"), decided(F.col(text).cast("string")).alias("score"))
    return out.select(*other_columns(out, "score"), F.col("score.lang").alias("lang_pred"), F.col("score.score").alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a document teaches nothing: the CRC-32 of its id as text, modulo 4, is 2; of a null id it is false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
