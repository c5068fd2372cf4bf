"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features gives a score s, and ordered thresholds cut it into grades:
P(grade >= k) = sigmoid(s - threshold_k). Expected grade and tail probabilities follow from one score.
Features are marks of defects: a weight is 0 or less, so nothing in a text makes up for a defect, and more text
alone does not raise a score. The model is fitted on a bounded sample of rated documents, by Newton steps on all
buckets at once, and applied to all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import other_columns, saved

#: Hash buckets (a fixed size, so the model is), and rated documents in the sample at most. All buckets are fitted.
BUCKETS, SAMPLE = 1 << 20, 10_000
#: Penalties of a weight, as shares of a document: in proportion, and of its square.
LASSO, RIDGE = 1e-4, 1e-6
#: A document is kept if the probability of the highest grade is at least this.
CUT = 0.8
WORDS_KEPT = 500_000
#: Letters of the beginnings of words that are features too: endings vary.
BEGINNINGS = (4, 5, 6)
MARKS = ".,;:?()\"'"
SYMBOLS = "#*$%&|<>"


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def shape(text: str, words: list[str], different: int) -> list[str]:
    """Coarse shares of the whole text as features: symbols, capitals, exclamation marks, digits, repeated words and lines."""
    n, size = len(words) or 1, len(text) or 1
    lines = text.split("\n")
    shares = {
        "symbols": sum(map(text.count, SYMBOLS)) / n,
        "marks": text.count("!") / n,
        "upper": sum(map(str.isupper, words)) / n,
        "repeats": 1 - different / n,
        "lines": 1 - len(set(lines)) / len(lines),
        "long": size / n / 40,
    }
    return [f"\x00{k}{min(9, int(v * 20)) if v < 0.3 else 10 + min(9, int(v * 4))}" for k, v in shares.items()]


def features(text: str | None) -> tuple[set[str], set[str]]:
    """Distinct lower-cased words, without marks around them; and the beginnings of words and the shape features."""
    text = text or ""
    raw = text
    for mark in MARKS:
        raw = raw.replace(mark, " ")
    words = raw.split()
    low = set(raw.lower().split())
    other = {"\x01" + w[:k] for k in BEGINNINGS for w in low if len(w) > k}
    other.update(shape(text, words, len(low)))
    return low, other


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each grade but the lowest, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def fit_rows(rows: list[tuple[np.ndarray, int]], lasso: float = LASSO, ridge: float = RIDGE, steps: int = 100, tolerance: float = 1e-5) -> Model:
    """Fit on (feature buckets, grade): the least of the mean of -log P(grade) - lasso * sum(w) + ridge / 2 * sum(w * w), over w <= 0.

    All buckets that occur are fitted together with the thresholds, by Newton steps whose equations conjugate gradients
    solve on the sparse rows, projected to w <= 0. The problem is convex, so where it ends does not depend on the way.
    With one grade, or none, every score is 0 and that grade is certain.
    """
    grades = sorted({g for _, g in rows})
    weights = np.zeros(BUCKETS, np.float32)
    if len(grades) < 2:
        return Model(weights, np.zeros(0), grades or [0])
    n = len(rows)
    number = np.full(BUCKETS, -1, np.int32)
    for x, _ in rows:
        number[x] = 0
    ids = np.flatnonzero(number >= 0)
    number[ids] = np.arange(len(ids))
    row, column = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x, _ in rows]), number[np.concatenate([x for x, _ in rows])]
    y = np.searchsorted(grades, [g for _, g in rows])
    share = np.array([(y >= k).mean() for k in range(1, len(grades))])
    w, cuts = _minimum(row, column, len(ids), y, -np.log(share / (1 - share)), n * lasso, n * ridge, steps, tolerance * n)
    weights[ids] = w
    return Model(weights, cuts, grades)


def _slopes(score: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the log likelihood log(F(upper) - F(lower)): slopes by the two bounds of each row's grade, F's at the bounds."""
    bounds = np.r_[-np.inf, cuts, np.inf]
    upper, lower = (1 / (1 + np.exp(np.clip(score - b, -40, 40))) for b in (bounds[y + 1], bounds[y]))
    upper, lower = np.where(np.isinf(bounds[y + 1]), 1.0, upper), np.where(np.isinf(bounds[y]), 0.0, lower)
    mass = np.maximum(upper - lower, 1e-12)
    return upper * (1 - upper) / mass, -lower * (1 - lower) / mass, upper, lower


def _minimum(row: np.ndarray, column: np.ndarray, k: int, y: np.ndarray, cuts: np.ndarray, lasso: float, ridge: float, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The most likely weights and thresholds. row, column: where the design has ones; sums over rows, not means."""
    n, m = len(y), len(cuts)
    of_upper, of_lower = ((np.arange(m)[None, :] == (y + shift)[:, None]).astype(float) for shift in (0, -1))  # which threshold is a row's bound

    def loss(score: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> float:
        if (np.diff(cuts) <= 0).any():
            return np.inf  # thresholds out of order: a grade would have no likelihood
        _, _, upper, lower = _slopes(score, cuts, y)
        return float(-np.log(np.maximum(upper - lower, 1e-12)).sum() - lasso * w.sum() + ridge * (w @ w) / 2)

    w, score = np.zeros(k), np.zeros(n)
    best = loss(score, w, cuts)
    for _ in range(steps):
        du, dl, upper, lower = _slopes(score, cuts, y)
        slope = np.bincount(column, (du + dl)[row], k) + ridge * w - lasso
        slope_cuts = -(of_upper.T @ du + of_lower.T @ dl)
        free = (w < 0) | (slope > 0)  # others are held at 0
        if max(np.abs(slope[free]).max(initial=0), np.abs(slope_cuts).max()) < tolerance:
            break
        at = np.flatnonzero(free)
        place = np.full(k, -1, np.int32)
        place[at] = np.arange(len(at))
        own = free[column]
        r, c = row[own], place[column[own]]
        bend_u, bend_l, cross = du * (1 - 2 * upper) - du * du, dl * (1 - 2 * lower) - dl * dl, -du * dl
        curve = -(bend_u + 2 * cross + bend_l)
        to_cuts = of_upper * (bend_u + cross)[:, None] + of_lower * (cross + bend_l)[:, None]
        mixed = (of_upper * cross[:, None]).T @ of_lower
        of_cuts = -((of_upper * bend_u[:, None]).T @ of_upper + (of_lower * bend_l[:, None]).T @ of_lower + mixed + mixed.T)

        def times(v: np.ndarray, r=r, c=c, at=at, curve=curve, to_cuts=to_cuts, of_cuts=of_cuts) -> np.ndarray:  # noqa: ANN001
            s = np.bincount(r, v[: len(at)][c], n)
            return np.r_[np.bincount(c, (curve * s + to_cuts @ v[len(at) :])[r], len(at)) + ridge * v[: len(at)], to_cuts.T @ s + of_cuts @ v[len(at) :]]

        scale = np.r_[np.bincount(c, curve[r], len(at)) + ridge, np.diag(of_cuts)] + 1e-9
        step = _solve(times, np.r_[slope[at], slope_cuts], scale)
        size = 1.0
        while size > 1e-6:
            tried = w.copy()
            tried[at] = np.minimum(0, w[at] - size * step[: len(at)])
            after_cuts, after_score = cuts - size * step[len(at) :], np.bincount(r, tried[at][c], n)
            after = loss(after_score, tried, after_cuts)
            if after < best:
                break
            size /= 2
        if not after < best:
            break
        w, cuts, score, best = tried, after_cuts, after_score, after
    return w, cuts


def _solve(times, right: np.ndarray, scale: np.ndarray, rounds: int = 200) -> np.ndarray:  # noqa: ANN001
    """Conjugate gradients, by the diagonal `scale`."""
    x, rest = np.zeros(len(right)), right.copy()
    z = rest / scale
    way, now = z.copy(), rest @ z
    end = 1e-6 * now
    for _ in range(rounds):
        if now <= end:
            break
        t = times(way)
        pace = now / (way @ t)
        x += pace * way
        rest -= pace * t
        z = rest / scale
        now, before = rest @ z, now
        way = z + (now / before) * way
    return x


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on documents of ratings (doc_id, grade), at most `sample` of them, taken by a hash of doc_id.

    Only their feature buckets come to the driver, one row for each doc_id. Rows with a null are left out, and so are
    ratings of documents that docs does not have; of several ratings of a document the lowest counts, of several
    texts under a doc_id the first by its order.
    """
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    there = docs.select("doc_id").join(rated, "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = saved(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "rated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                low, other = features(text.as_py())
                found.append(np.array(sorted({bucket(x) for x in (*low, *other)}), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["x", "grade"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows of 12 bytes
    one = texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    # four bytes a bucket: as arrays, each number would be an object in the driver's heap and one in its Python
    rows = one.select("text", "grade").mapInArrow(run, "x binary, grade int")
    return fit_rows([(np.frombuffer(r.x, np.int32), r.grade) for r in rows.toLocalIterator()])


class _Weights(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, name: str) -> float:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[name] = float(self.weights[bucket(name)])
        return value


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """docs with expected_grade, tail_probability (of the highest grade) and kept; a row for each row.

    The whole text counts. A null or empty text has shape features only. Repeated rows and null ids are rows like
    others; no rows give none. Columns named like a result, in any case, are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # four bytes a bucket, whatever the input
    docs = docs.select(*other_columns(docs, "expected_grade", "tail_probability", "kept"))

    @F.arrow_udf("expected double, top double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        weights = _Weights(model.weights)
        grades = np.array(model.grades, float)
        for batch in batches:
            scores = np.zeros(len(batch))
            for i, text in enumerate(batch):
                low, other = features(text.as_py())
                scores[i] = sum(map(weights.__getitem__, low)) + sum(map(weights.__getitem__, other))
            tails = model.tails(scores)
            expected = grades[0] + tails @ np.diff(grades)
            top = tails[:, -1] if tails.shape[1] else np.ones(len(batch))
            yield pa.StructArray.from_arrays([pa.array(expected), pa.array(top)], names=["expected", "top"])

    # only the text goes to Python; other columns stay where they are, whatever their names and kinds
    out = docs.select(*other_columns(docs), scored(F.col("text")).alias("tail_probability"))
    expected, top = F.col("tail_probability.expected"), F.col("tail_probability.top")
    return out.select(*other_columns(out, "tail_probability"), expected.alias("expected_grade"), top.alias("tail_probability"), (top >= cut).alias("kept"))


def graded(labels: DataFrame) -> DataFrame:
    """labels (quality 0 or 1, toxic 0 or 1) as grades: 0 of low quality, 1 good but toxic, 2 good and clean; null if either is."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
