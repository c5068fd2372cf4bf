"""Encoding, passages, near duplicates, rules and the classifier against brute force on small tables."""

import base64
import hashlib
import random
import re

import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, jaccard_join, quality_classifier, quality_rules, suffix_dedup

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


def test_bpe_agrees_with_the_public_library(spark):
    own = bpe.codec(PATH, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.vocabulary.ranks, special_tokens={})
    random.seed(1)
    texts = ["", " ", "\n\n  a", "<|endoftext|>", "naïve 中文 🙂 \x1c\x85", "x" * 3000, "ab" * 2000, "1234567 8", "\t\tIt's  'LL"]
    texts += ["".join(random.choice("etaoin srdlu'é中1!\n") for _ in range(random.randint(0, 200))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (5, None), (0, "again")]
    want = []
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.encode(docs_of(spark, rows), PATH, public_tokenizers.PATTERN, ids=False, digests=True).collect()
    assert sorted_rows(got) == sorted_rows(want)
    encoded = bpe.encode(docs_of(spark, rows), PATH, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert sorted_rows(back) == sorted_rows([(i, t or "") for i, t in rows])
    assert bpe.encode(docs_of(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_appends_and_edits_exactly():
    vocabulary = bpe.codec(PATH, public_tokenizers.PATTERN).vocabulary
    random.seed(2)
    piece = bpe.Editable(vocabulary)
    for _ in range(150):
        piece.append("".join(random.choice("etaoinshrdlé") for _ in range(random.randint(0, 12))).encode())
        a = random.randint(0, len(piece.piece))
        b = min(len(piece.piece), a + random.randint(0, 6))
        piece.edit(a, b, random.choice([b"", b"th", b"ation", "é".encode()]))
        assert piece.ids() == bpe.Editable(vocabulary, piece.piece).ids()
        assert vocabulary.decode(piece.ids()) == piece.piece
    long = bpe.Editable(vocabulary, b"internationalization" * 200)
    assert long.edit(100, 101, b"x") < 400


def test_bpe_ranks_are_read_whole():
    with open(PATH, "rb") as f:
        assert len(bpe.codec(PATH, public_tokenizers.PATTERN).vocabulary.ranks) == len({base64.b64decode(x.split()[0]) for x in f})


def tie(text):
    """Spark's xxhash64 of a text."""
    value = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def passages(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie(r[1]), r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def removed(spark, rows, **options):
    clash = docs_of(spark, rows).withColumns({"Kept": F.lit("clash"), "shard": F.lit(1), "tie": F.lit("x"), "other": F.lit("y")})
    out = suffix_dedup.remove_repeats(clash, **options)
    assert out.columns == ["doc_id", "text", "shard", "tie", "other", "n_bytes", "spans", "kept"]
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", n, F.size("spans"), F.sha2("kept", 256)).collect()


def test_passages_against_brute_force(spark):
    random.seed(3)
    base = ["".join(random.choice("abcdefghij é\n") for _ in range(random.randint(0, 700))) for _ in range(20)]
    rows = [(i, base[random.randrange(20)][random.randint(0, 90) :] + random.choice(base)[: random.randint(0, 300)] + "a" * random.choice([0, 0, 150, 400])) for i in range(90)]
    rows += [(7, rows[7][1]), (7, "x" * 300), (None, rows[3][1]), (None, None), (None, rows[3][1]), (900, None), (901, ""), (902, "ab" * 400), (903, "z" * 99), (904, "\x00" * 250)]
    assert sorted_rows(removed(spark, rows)) == sorted_rows(passages(rows))
    assert removed(spark, []) == []


def test_one_passage_in_all_documents(spark):
    random.seed(4)
    shared = "".join(random.choice("abcdefgh ") for _ in range(240))
    rows = [(i, "".join(random.choice("ijklmnop ") for _ in range(random.randint(20, 200))) + shared + str(i) * 9) for i in range(150)]
    assert sorted_rows(removed(spark, rows)) == sorted_rows(passages(rows))


def test_lists_merge_in_parts(spark, monkeypatch):
    """Shards of a few documents each, merged two at a time: passages in all of them, in two, and in one only."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    random.seed(14)
    shared = ["".join(random.choice("abcdefgh ") for _ in range(n)) for n in (100, 130, 240, 400)]
    make = lambda n: "".join(random.choice("ijklmnopq ") for _ in range(n))
    rows = [(i, make(random.randint(0, 150)) + shared[0] + make(5) + random.choice(shared)[random.randint(0, 30) :] + make(3) + (shared[3] if i % 7 == 0 else "")) for i in range(120)]
    rows += [(i // 2, make(90) + shared[2]) for i in range(20)] + [(None, make(20) + shared[1] + make(9)) for _ in range(20)]
    want = sorted_rows(passages(rows))
    assert sorted_rows(removed(spark, rows, fan=2)) == want
    assert sorted_rows(removed(spark, rows, fan=5)) == want


def test_one_passage_in_a_thousand_shards():
    """Lists of a thousand shards that share one passage: all but the earliest are repeats, in one task and in parts."""
    import numpy as np

    rng = np.random.default_rng(1)
    shared = rng.integers(97, 105, 160, dtype=np.uint8)
    rows = []
    for shard in range(1000):
        alone = rng.integers(105, 120, 130, dtype=np.uint8)
        data = np.concatenate([shared, alone])
        order = sorted(range(61), key=lambda i: data[i : i + 100].tobytes())
        value = np.empty(61, np.int64)
        value[order] = np.arange(61)
        at = lambda *x: np.array(x)
        # the passage's windows belong to one anchor, the shard's own to another that is not shared
        rows += suffix_dedup._runs(data, 100, np.array([7, 1000 + shard], np.uint64), at(60, 30), at(0, 160), at(60, 190), at(0, 1), None, at(5000 - shard, 9), at(0, 0), np.full(2, shard, np.int32), np.r_[value, np.arange(31)], at(0, 0), at(shard // 100, shard // 100))

    def merged(found, fan):
        return [r for r in suffix_dedup._merge(suffix_dedup._lists(found), 100, fan).to_pylist()]

    for parts in ([rows], [rows[i : i + 100] for i in range(0, 1000, 100)]):
        gone, left = [], []
        for part in parts:
            out = merged(part, 100)
            gone += [r for r in out if r["bucket"] is None]
            left += [r for r in out if r["bucket"] is not None]
        if len(parts) > 1:
            assert sum(len(r["anchors"]) // 8 for r in left) == 10 + 1000
            gone += [r for r in merged(left, 100) if r["bucket"] is None]
        assert sorted(r["shard"] for r in gone) == list(range(999)) and all(np.frombuffer(r["lo"], np.int64).tolist() == [0] and np.frombuffer(r["hi"], np.int64).tolist() == [60] for r in gone)


def test_characters_are_cut_whole(spark):
    base = "é" * 130
    rows = [(1, base + "a"), (2, "x" + base + "b�"), (3, "ü" + base), (4, None)]
    out = suffix_dedup.remove_repeats(docs_of(spark, rows), whole_characters=True, with_text=False)
    got = {r.doc_id: bytes(r.kept).decode() for r in out.collect()}
    assert got[1].endswith("éa") and got[2] == "xb�" and got[3] == "ü" and got[4] == ""


def classes(rows, percent=80):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_against_brute_force(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        text = [random.choice(words) for _ in range(random.choice([1, 3, 4, 5, 6, 9, 14, 40, 120, 300]))]
        for _ in range(random.choice([1, 2, 5, 9])):
            copy = list(text)
            for _ in range(random.randint(0, 1 + len(text) // 60)):
                copy[random.randrange(len(copy))] = random.choice(words).upper()
            rows.append((len(rows) * 3, " \t".join(copy)))
    # a family larger than HOT, of copies that differ from one another, and one passage in many documents
    text = [random.choice(words) for _ in range(150)]
    for _ in range(60):
        copy = list(text)
        for _ in range(random.randint(0, 4)):
            copy[random.randrange(150)] = random.choice(words)
        rows.append((len(rows) * 3, " ".join(copy)))
    for _ in range(40):
        rows.append((len(rows) * 3, " ".join(text[:50] + [random.choice(words) for _ in range(80)])))
    rows += [(None, rows[0][1]), (3, None), (4, ""), (5, " \n\x0b"), (6, rows[3][1]), (6, rows[3][1]), (1, rows[-1][1])]
    random.shuffle(rows)
    got = jaccard_join.jaccard_classes(docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("n", "sig", "text_hash", "component_id")})).collect()
    assert sorted_rows(got) == sorted_rows(classes(rows))
    assert jaccard_join.jaccard_classes(docs_of(spark, [])).count() == 0


def test_no_link_is_lost_at_any_threshold(spark):
    """Nested sets whose sizes lie right at the threshold, and far apart in bands; families larger than a hot key's."""
    random.seed(15)
    for percent in (50, 67, 80, 95):
        rows = []
        for size in (1, 2, 3, 5, 7, 10, 11, 15, 20, 33, 60, 100):
            words = [f"p{percent}s{size}w{i}" for i in range(2 * size + 10)]
            partner = size * 100 // percent
            for n in {size, partner, partner + 1, (size + partner) // 2}:
                rows.append((len(rows), " ".join(words[: n + 4])))
        text = [random.choice("abcdefghijklmnop") + random.choice("qrstuvwxyz") for _ in range(60)]
        rows += [(len(rows) + i, " ".join(text[: 60 - i])) for i in range(45)]
        assert sorted_rows(jaccard_join.jaccard_classes(docs_of(spark, rows), percent=percent).collect()) == sorted_rows(classes(rows, percent)), percent


def test_one_row_of_each_class_is_kept(spark):
    a, b = "one two three four five six seven", "other words that have nothing to do with it"
    rows = [(1, a), (2, a), (2, b), (1, a), (3, a.upper()), (None, a), (4, ""), (4, ""), (5, None)]
    got = {(r.doc_id, r.text_hash): (r.copies, r.kept) for r in jaccard_join.duplicates(docs_of(spark, rows)).collect()}
    assert got == {(1, tie(a)): (2, True), (2, tie(a)): (1, False), (2, tie(b)): (1, True), (3, tie(a.upper())): (1, False)}


def test_sketch_blocks_bound_the_difference():
    import numpy as np

    random.seed(6)
    for n in (1, 2, 5, 17, 200):
        a = np.unique(np.random.default_rng(n).integers(0, 1 << 62, n, dtype=np.uint64))
        b = a[random.randint(0, n // 8) :]
        _, differ, m = jaccard_join.contexts(n, 80)[0]
        ka, kb = set(jaccard_join.blocks_of(a, 0, m).tolist()), set(jaccard_join.blocks_of(b, 0, m).tolist())
        assert len(ka - kb) <= len(np.setxor1d(a, b)) <= max(differ, n // 8)


def rules_of(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, twice = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            twice |= {j for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), len(w) < 20 or 100 * len(twice) > 30 * len(w)


def test_quality_rules_against_brute_force(spark):
    random.seed(7)
    texts = [None, "", " ", "\n\n", "a" * 5000, "# " * 30, "the cat sat on the mat " * 40, "x\ny\nx\n \n\t\nx", "é中 the\x0bof\x0c" * 12]
    texts += [" ".join(random.choice("a b c d the of".split()) for _ in range(random.randint(1, 60))) + random.choice(["\n", "!! ", "|"]) for _ in range(80)]
    rows = list(enumerate(texts))
    got = quality_rules.judge(docs_of(spark, rows).withColumn("n_words", F.lit("clash"))).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules_of(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)
    clash = docs_of(spark, rows).withColumns({c: F.lit(c) for c in ("of_words", "of_lines", "row", "failed", "N_Words")})
    out = quality_rules.judge(clash)
    assert {(r.of_words, r.of_lines, r.row, r.failed) for r in out.collect()} == {("of_words", "of_lines", "row", "failed")} and "N_Words" not in out.columns
    assert quality_rules.judge(docs_of(spark, [])).count() == 0
    plain = "The river was wide and slow, and the people of the valley went down to it in the morning for water and for news of the road."
    assert quality_rules.judge(docs_of(spark, [(1, plain)])).first().kept
    assert not quality_rules.judge(docs_of(spark, [(1, plain.replace(" ", "%% "))])).first().kept


def test_classifier_on_held_out_documents(spark):
    random.seed(8)
    plain = [f"word{i}" for i in range(300)]

    def make(i):
        grade = i % 3
        words = [random.choice(plain) for _ in range(random.randint(20, 90))]
        if grade == 1:
            words[random.randrange(len(words))] = random.choice(["nasty", "vile", "rotten"]) + random.choice(["", "ly"])
        return i, (" ".join(w + "%%%" for w in words) if grade == 0 else " ".join(words)), grade

    rows = [make(i) for i in range(1200)]
    docs, grades = docs_of(spark, [r[:2] for r in rows]), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, grade int")
    model = quality_classifier.fit(docs.where("doc_id < 800"), grades.where("doc_id < 800"))
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    got = quality_classifier.score(docs.where("doc_id >= 800"), model).join(grades, "doc_id").collect()
    right = sum(r.kept == (r.grade == 2) for r in got)
    assert len(got) == 400 and right >= 388
    assert all(0 <= r.expected_grade <= 2 for r in got)


def test_classifier_agrees_with_a_dense_fit():
    """The same minimum by plain projected gradient steps on a dense matrix: no bucket is left out."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = (rng.random((300, 40)) < 0.2).astype(float)
    score = -x @ np.where(np.arange(40) < 6, rng.random(40) * 3, 0) + rng.logistic(size=300)
    y = np.digitize(score, [-3, -1])
    lasso, ridge = 1e-3, 1e-3
    model = quality_classifier.fit_rows([(np.flatnonzero(r).astype(np.int32), int(g)) for r, g in zip(x, y, strict=True)], lasso, ridge, tolerance=1e-9)

    def slopes(w, cuts):
        bounds = np.r_[-np.inf, cuts, np.inf]
        f = [1 / (1 + np.exp((x @ w) - b)) for b in (bounds[y + 1], bounds[y])]
        mass = f[0] - f[1]
        d = [v * (1 - v) / mass for v in f]
        return x.T @ (d[0] - d[1]) / 300 + ridge * w - lasso, np.array([(d[1][y == j + 1].sum() - d[0][y == j].sum()) / 300 for j in range(2)])

    w, cuts = np.zeros(40), np.array([-2.0, 0.0])
    for _ in range(60_000):
        a, b = slopes(w, cuts)
        w, cuts = np.minimum(0, w - 0.3 * a), cuts - 0.3 * b
    assert np.abs(model.weights[:40] - w).max() < 1e-3 and np.abs(model.thresholds - cuts).max() < 1e-3
    assert (w < 0).sum() > 5 and not model.weights[40:].any()


def test_classifier_on_odd_tables(spark):
    """Repeated ids and ratings, absent documents, empty and very long texts, clashing columns, empty tables."""
    plain = "the quiet river runs past the old mill and the people of the town walk there in the evening"
    rows = [(i, plain + f" word{i % 50}") for i in range(60)] + [(i, "%%% $$$ " * (20 + i)) for i in range(60, 120)]
    rows += [(3, "another text")] * 4 + [(None, plain), (200, ""), (201, None), (202, plain + " word" * 200_000)]
    docs = docs_of(spark, rows).withColumns({"Kept": F.lit("clash"), "grade": F.lit("own"), "x": F.lit(1)})
    grades = spark.createDataFrame([(i, 2 if i < 60 else 0) for i in range(120)] + [(5, 2), (900, 0), (901, 0), (None, 1), (7, None)], "doc_id long, grade int")
    out = quality_classifier.score(docs, quality_classifier.fit(docs, grades))
    assert out.columns == ["doc_id", "text", "grade", "x", "expected_grade", "tail_probability", "kept"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.grade == "own" for r in got)
    assert all(r.kept == (r.doc_id < 60) for r in got if r.doc_id is not None and r.doc_id < 120 and r.text != "another text")
    assert quality_classifier.score(docs.limit(0), quality_classifier.fit(docs.limit(0), grades)).count() == 0


def test_classifier_without_grades(spark):
    docs = docs_of(spark, [(1, "a"), (2, None), (None, ""), (1, "a")])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, grade int")
    out = quality_classifier.score(docs, quality_classifier.fit(docs, none)).collect()
    assert len(out) == 4 and all(r.kept for r in out)
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted_rows(quality_classifier.graded(labels).collect()) == sorted_rows([(1, 0), (2, 1), (3, 2), (4, None), (5, None)])
