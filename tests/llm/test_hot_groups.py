"""Hot keys and anchors: what meets in one bucket stays bounded, and results stay those of brute force."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, jaccard_join, quality_rules, shingles, suffix_dedup

from .test_text_operators import classes, docs_of, passages, removed, sorted_rows


def test_a_family_of_a_third_of_all_rows(spark, monkeypatch):
    """Small limits make every bucket heavy: keys are thinned in slices, links are as they were."""
    random.seed(21)
    words = [f"w{i}" for i in range(300)]
    text = [random.choice(words) for _ in range(120)]
    rows = []
    for k in range(80):  # copies that all differ
        copy = list(text)
        for _ in range(random.randint(0, 3)):
            copy[random.randrange(120)] = f"n{k}"
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(random.choice(words) for _ in range(random.choice([3, 30, 60])))) for k in range(130)]
    rows += [(len(rows) + k, rows[90 + k][1] + " " + rows[90 + k][1][:6]) for k in range(30)]
    want = sorted_rows(classes(rows))
    met, thin = {}, []
    saved = jaccard_join.saved

    def watched(df, name):
        out = saved(df, name)
        met.setdefault(name, []).append(sorted(map(tuple, out.collect()))) if name == "met" else None
        thin.extend(out.where("bucket IS NOT NULL").collect()) if name == "thin" else None
        return out

    monkeypatch.setattr(jaccard_join, "saved", watched)
    monkeypatch.setattr(jaccard_join, "BUCKET_BYTES", 20_000)
    assert sorted_rows(jaccard_join.jaccard_classes(docs_of(spark, rows)).collect()) == want
    assert not thin
    monkeypatch.setattr(jaccard_join, "MOST_KEYS", 700)
    assert sorted_rows(jaccard_join.jaccard_classes(docs_of(spark, rows)).collect()) == want
    assert thin
    counts = [np.unique(jaccard_join._unpack(pa.Table.from_pylist([r.asDict()]))[1], return_counts=True)[1].max() for r in thin]
    assert max(counts) <= jaccard_join.HOT + 1  # of a hot key a slice sends so many nodes, however many it has

    def summed(rows):
        out = {}
        for kind, a, b, n in rows:
            out[kind, a, b] = out.get((kind, a, b), 0) + n
        return out

    assert summed(met["met"][0]) == summed(met["met"][1])


def test_one_slice_of_a_hot_key():
    """100,000 nodes with one key: 17 go on, the others are counted where they are."""
    sig, key = np.arange(100_000), np.full(100_000, 12344, np.uint64)
    packed = jaccard_join._pack(np.r_[sig, sig[:5]], np.r_[key, np.full(5, 99, np.uint64)])
    table = pa.table({"bucket": pa.array([3], pa.int32()), **{n: pa.array([x], pa.binary()) for n, x in zip(("sigs", "sizes", "keys"), packed, strict=True)}})
    out = jaccard_join._thin(table).to_pylist()
    left = [r for r in out if r["bucket"] is not None]
    assert len(left) == 1 and len(left[0]["sigs"]) // 8 == jaccard_join.HOT + 1 + 5
    assert len(out) == 1 + 100_000 - jaccard_join.HOT - 1 and {(r["kind"], r["n"]) for r in out if r["bucket"] is None} == {(2, 1)}


def test_a_passage_in_a_third_of_all_documents(spark, monkeypatch):
    """Every bucket is thinned by shards: passages in one shard, in a few and in all of them."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1200)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "MOST_ANCHORS", 20)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    random.seed(22)
    shared = ["".join(random.choice("abcdefgh ") for _ in range(n)) for n in (100, 180, 320)]
    make = lambda n: "".join(random.choice("ijklmnopq ") for _ in range(n))
    rows = [(i, make(random.randint(0, 150)) + (shared[0] + make(5) if i % 3 == 0 else "") + (shared[1] if i % 29 == 0 else "") + make(40) + (shared[2] * 2 if i == 7 else "")) for i in range(120)]
    rows += [(i // 2, make(90) + shared[2]) for i in range(10)] + [(None, None), (None, ""), (500, shared[0])]
    seen = []
    saved = suffix_dedup.saved
    monkeypatch.setattr(suffix_dedup, "saved", lambda df, name: (lambda out: (seen.append((name, out.count())), out)[1])(saved(df, name)))
    want = sorted_rows(passages(rows))
    for fan in (2, 5, 1024):
        seen.clear()
        assert sorted_rows(removed(spark, rows, fan=fan)) == want
        assert dict(seen)["heavy"] > 0 and dict(seen)["thin"] > 0


def test_very_long_texts(spark):
    """A text of two million characters beside its copy, a near copy and others, in the operators on passages, sets and rules."""
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(300_000))
    near = long[: len(long) - 2000]
    docs = docs_of(spark, [(1, long), (2, long), (3, near), (4, "short text of six words only"), (5, None)])
    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(docs).collect()}
    assert [got[k].component_id for k in range(1, 6)] == [1, 1, 1, 4, 5] and got[1].n_shingles > 290_000 and got[5].n_shingles == 0
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, with_text=False).collect()}
    assert [len(cut[k].kept) for k in range(1, 6)] == [len(long), 0, 0, 28, 0] and [len(cut[k].spans) for k in range(1, 6)] == [0, 1, 1, 0, 0]
    twice = docs.unionByName(docs.where("doc_id = 4"))
    judged = quality_rules.judge(twice)
    rows = judged.select("doc_id", "n_words", "base_failed").collect()
    assert sorted((r.doc_id, r.n_words) for r in rows) == [(1, 300_000), (2, 300_000), (3, len(near.split())), (4, 6), (4, 6), (5, 0)]


def test_bpe_leaves_other_columns_out(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = docs_of(spark, [(1, "a b"), (1, "a b"), (None, None)]).withColumns({c: F.lit("clash") for c in ("n_tokens", "TOKEN_IDS", "ids_sha256", "a`b")})
    out = bpe.encode(docs, path, public_tokenizers.PATTERN, digests=True)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows)[0] == (0, 0) and len(rows) == 3 and rows[0] == rows[1]


def test_one_slice_of_a_hot_anchor():
    """An anchor in 50,000 shards: fan + 1 of them go on, at most twice each; the others get it at once, spread wide."""
    shard = np.repeat(np.arange(50_000, dtype=np.int32), 3)
    h = np.full(len(shard), 77, np.uint64)
    table = pa.table({"bucket": pa.array([1], pa.int32()), "shards": pa.array([shard.tobytes()], pa.binary()), "sizes": pa.array([np.ones(len(shard), np.int32).tobytes()], pa.binary()), "hashes": pa.array([h.tobytes()], pa.binary())})
    out = suffix_dedup._thin(table, 64).to_pylist()
    left = [r for r in out if r["bucket"] is not None]
    assert len(left) == 1 and len(left[0]["hashes"]) // 8 == 2 * 65
    assert len(out) == 1 + 50_000 - 65 and all(r["spread"] == 2 for r in out if r["bucket"] is None)
    rest = suffix_dedup._repeated(pa.Table.from_pylist(left).select(["shards", "sizes", "hashes"]), 64).to_pylist()
    assert len(rest) == 65 and all(r["spread"] == 2 for r in rest)


def test_a_task_that_sketches_holds_little():
    """Keys that wait for 5,000 buckets take some bytes each, however few of a node go to one bucket; all arrive."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50_000, 250)) for _ in range(3_000)]
    column = pa.array(texts)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 500)), column.slice(a, 500), pa.array(range(500))], names=["doc_id", "text", "text_hash"]) for a in range(0, 3_000, 500)]
    next(iter(jaccard_join._sketch(iter(batches[:1]), 8, 80, 5)))  # caches are filled
    tracemalloc.start()
    n_rows = n_keys = 0
    for out in jaccard_join._sketch(iter(batches), 5_000, 80, 5):
        keys = out.filter(out.column(8).is_valid())
        n_rows, n_keys = n_rows + out.num_rows - keys.num_rows, n_keys + sum(keys.column(12).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = sum(len(jaccard_join.blocks_of(x, g, m)) for x in shingles.shingle_sets(column) for g, _, m in jaccard_join.contexts(len(x), 80))
    assert (n_rows, n_keys) == (3_000, want)
    assert peak < 60 << 20


def test_a_node_of_more_keys_than_a_size_holds():
    """A text of 200,000 words has more keys in a bucket than 16 bits count."""
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([" ".join(map(str, range(200_000)))]), pa.array([1])], names=["doc_id", "text", "text_hash"])
    tokens = next(shingles.shingle_sets(batch.column(1)))
    want = sorted(int(k) & ~1 | g % 2 for g, _, m in jaccard_join.contexts(len(tokens), 80) for k in jaccard_join.blocks_of(tokens, g, m) & np.uint64((1 << 56) - 1))
    out = pa.Table.from_batches(list(jaccard_join._sketch(iter([batch]), 1, 80, 5)))
    sig, key = jaccard_join._unpack(out.filter(out.column("bucket").is_valid()))
    assert sorted(key.tolist()) == want and set(sig.tolist()) == {jaccard_join.signature(tokens)}
