"""Each stage of the pipeline, as it is wired, against plain Python on the same rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from ledgerloom.llm import bpe, quality_classifier

from .test_table_operators import prefix_of, sorted_rows
from .test_text_operators import classes, tie

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in rows], FIELDS)


def plain(out):
    return sorted_rows(out.select("doc_id", "text", "n_chars").collect())


def shown(rows):
    return sorted_rows((d, t, len(t or "")) for d, t in rows)


def test_classifier_keeps_what_the_model_keeps(spark, tmp_path):
    random.seed(21)
    words = [f"word{i}" for i in range(80)]
    good = [(i, " ".join(random.choices(words, k=40))) for i in range(60)]
    bad = [(i, " ".join(random.choices(words, k=30) + ["vile"])) for i in range(60, 90)] + [(i, "%% && " * 30) for i in range(90, 120)]
    rows = good + bad + [(None, good[0][1]), (0, good[0][1]), (500, None), (501, "")]
    labels = [(i, 1, 0) for i in range(60)] + [(i, 1, 1) for i in range(60, 90)] + [(i, 0, 0) for i in range(90, 120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = STAGES["quality_classifier"](spark, table(spark, rows), str(tmp_path))
    buckets = lambda t: np.array(sorted({quality_classifier.bucket(x) for part in quality_classifier.features(t) for x in part}), np.int32)
    grade = {i: 0 if q == 0 else 1 if t else 2 for i, q, t in labels}
    sample = {i: t for i, t in rows if i in grade}
    model = quality_classifier.fit_rows([(buckets(t), grade[i]) for i, t in sample.items()])

    def kept(t):
        low, other = quality_classifier.features(t)
        score = sum(model.weights[quality_classifier.bucket(x)] for x in (*low, *other))
        return 1 / (1 + np.exp(model.thresholds[-1] - score)) >= quality_classifier.CUT

    assert plain(out) == shown([r for r in rows if kept(r[1])])
    assert {r.doc_id for r in out.collect()} >= set(range(60)) and not {r.doc_id for r in out.collect()} & set(range(60, 120))


def test_near_duplicates_leave_one_row_of_each_class(spark):
    random.seed(22)
    a = " ".join(random.choices([f"w{i}" for i in range(99)], k=60))
    b = "a text of its own that nothing else in this table is like at all"
    rows = [(1, a), (2, a), (2, b), (1, a), (7, a + " more"), (3, b.upper() + " x y"), (None, a), (None, a), (8, ""), (9, None), (10, " \n")]
    rows += [(20 + i, a.replace("w1", f"v{i}w1") if i % 2 else f"{a} {i}") for i in range(8)]
    label = classes(rows)
    want, seen = [], set()
    for (d, t), (_, n, least) in sorted(zip(rows, label, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, tie(x[0][1]))):
        # the first row of a component by id and hash; components of other texts under the same least id are told apart by their sets
        mates = frozenset(i for i, x in enumerate(label) if x[2] == least and _linked(rows, i, t))
        if d is None or not n or mates not in seen:
            want.append((d, t))
        seen.add(mates)
    assert plain(STAGES["jaccard_join"](spark, table(spark, rows), "")) == shown(want)


def _linked(rows, i, text):
    """Whether row i is in the component of a row with this text, by classes of all rows under new ids."""
    numbered = [(k, t) for k, (d, t) in enumerate(rows) if d is not None]
    label = {k: c for (k, _), (_, _, c) in zip(numbered, classes(numbered), strict=True)}
    own = next((label[k] for k, t in numbered if t == text), None)
    return own is not None and label.get(i) == own


def test_passages_are_cut_in_whole_characters(spark):
    random.seed(23)
    make = lambda n: "".join(random.choice("abcdefgh é中�") for _ in range(n))
    shared = make(160)
    rows = [(i, make(40) + shared[random.randint(0, 9) :] + make(40)) for i in range(12)] + [(20, shared[5:150]), (21, "�" + make(20)), (22, None), (23, "\n" * 300), (24, "\n" * 300)]
    seen, want = set(), []
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = set()
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone |= set(range(i, i + 100))
            seen.add(raw[i : i + 100])
        left, at = "", 0
        for c in t or "":
            size = len(c.encode())
            if not gone & set(range(at, at + size)):
                left += c
            at += size
        if not gone:
            want.append((d, t))
        elif left.strip(" \t\n\x0b\x0c\r"):
            want.append((d, left))
    assert plain(STAGES["suffix_dedup"](spark, table(spark, rows), "")) == shown(want)


def test_mixture_takes_the_prefix_of_a_leaf(spark):
    random.seed(24)
    rows = [(i, "one two three  four\tfive " * random.randint(0, 5)) for i in range(30)] + [(3, "x y z")] * 2 + [(None, "p q")] * 3
    total = sum(len(t.split()) for _, t in rows)
    want = [(d, t) for d, t, _, n, _ in prefix_of(rows, total * 4 // 5, 1) if n]
    got = STAGES["mixing"](spark, table(spark, rows), "").collect()
    cut = {(d, t) for d, t in want} - set(rows)
    assert sorted_rows((r.doc_id, r.text) for r in got if (r.text or "").split()) == sorted_rows(want)
    assert len(cut) <= 1 and all(r.n_chars == len(r.text) for r in got)


def test_tokens_are_those_of_the_public_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(path, public_tokenizers.PATTERN).vocabulary.ranks, special_tokens={})
    rows = [(1, "The river ran. 中文 é"), (1, ""), (None, "x" * 500), (3, None)]
    want = []
    for d, t in rows:
        ids = other.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted_rows(STAGES["bpe"](spark, table(spark, rows), "").collect()) == sorted_rows(want)


def test_run_hands_each_stage_all_that_the_one_before_kept(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted_rows(corpus_pipeline.run(spark, sf).collect()) == sorted_rows(docs.collect())
