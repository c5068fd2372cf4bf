"""Chat formatting, WARC, URL filters, embeddings, mixing and the pipeline on small tables."""

import base64
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, embedding_dedup, mixing, quality_classifier, queries, url_filter, warc


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


def test_preferences(spark):
    turns = spark.createDataFrame(
        [
            (1, 0, "user", "hi", 9), (1, 1, "assistant", "good", 9), (1, 2, "user", "bye", 9),
            (2, 0, "user", "hi", 9), (2, 1, "assistant", "bad", 9),
            (3, 0, "user", "hi", 9), (4, 1, None, None, 9), (4, 2, "assistant", "x", 9), (None, 0, "user", "lost", 9),
        ],
        "conv_id long, turn long, role string, text string, n_prefix int",
    )
    pairs = spark.createDataFrame([(0, 1, 2), (1, 1, 3), (2, 4, 4), (3, 1, None), (4, 77, 78), (0, 1, 2)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in chat_format.preferences(turns, pairs).collect()}
    assert chat_format.preferences(turns, pairs).count() == 6
    r = got[0]
    assert (r.n_prefix, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert [(s.text, s.trained) for s in r.chosen] == [("<|assistant|>\n", False), ("good<|end|>\n", True), ("<|user|>\n", False), ("bye<|end|>\n", False)]
    assert [(s.text, s.trained) for s in r.rejected] == [("<|assistant|>\n", False), ("bad<|end|>\n", True)]
    assert (r.n_chosen_trained, r.n_rejected_trained) == (len("good<|end|>\n"), len("bad<|end|>\n"))
    assert [tuple(s) for s in r.chosen_spans] == [(14, 26)] and r.chosen_text[14:26] == "good<|end|>\n" and [tuple(s) for s in r.rejected_spans] == [(14, 25)]
    assert got[1].n_prefix == 1 and got[1].rejected_text == ""
    assert got[2].n_prefix == 2 and got[2].chosen_text == "" and got[2].prompt.startswith("<||>\n<|end|>\n")
    assert got[3].n_prefix == 0 and got[4].n_prefix == 0 and got[4].chosen == []
    assert chat_format.preferences(turns.limit(0), pairs.limit(0)).count() == 0
    long = spark.createDataFrame([(c, k, "assistant", "é" * 200_000 if k == 50 else f"{c if k > 90 else ''}x") for c in (1, 2) for k in range(100)], "conv_id long, turn long, role string, text string")
    r = chat_format.preferences(long, pairs.limit(1)).first()
    assert r.n_prefix == 91 and r.prompt.count("é") == 200_000 and len(r.chosen_spans) == 9
    assert r.n_chosen_trained == sum(s.end - s.start for s in r.chosen_spans)


def test_neighbour_pairs(spark):
    turns = spark.createDataFrame([(0,), (1,), (1,), (4,), (7,), (None,)], "conv_id long")
    assert sorted_rows(chat_format.neighbour_pairs(turns).collect()) == sorted_rows([(0, 0, 1), (2, 4, None), (3, None, 7)])


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "same"), (1, "http://b/\r\nX: y", "same"), (2, None, None), (5, "u", ""), (None, "v", "same"), (1, "w", "same"), (9, "z", "é" * 5000), (None, "q", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    warc.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    back = warc.read_archive(spark, str(tmp_path / "a"))
    got = back.collect()
    assert len(got) == len(rows)
    assert sorted_rows((r.page_id, r.payload.decode(), r.record_type, r.refers_to) for r in got) == sorted_rows(
        [(3, "same", "revisit", 1), (1, "same", "response", None), (2, "", "response", None), (5, "", "revisit", 2), (None, "same", "revisit", 1), (1, "same", "response", None), (9, "é" * 5000, "response", None), (None, "alone", "response", None)]
    )
    digests = {r.p.encode(): r.d for r in spark.createDataFrame([("",), ("same",), ("é",)], "p string").select("p", warc.base32_sha1(F.col("p").cast("binary")).alias("d")).collect()}
    assert all(d == base64.b32encode(hashlib.sha1(p).digest()).decode() for p, d in digests.items())
    for r in warc.record_bytes(back).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        size = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and block == block[:size] + b"\r\n\r\n" and b"\nX: y" not in head
    warc.write_archive(pages, str(tmp_path / "b"), min_bytes=5)
    assert {r.record_type for r in warc.read_archive(spark, str(tmp_path / "b")).collect()} == {"response"}
    warc.write_archive(pages.limit(0), str(tmp_path / "c"))
    assert warc.read_archive(spark, str(tmp_path / "c")).count() == 0


def test_warc_header_bytes_count(spark, tmp_path, monkeypatch):
    """The query reads the stored header bytes: a wrong line of any kind is an error."""
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, "other")], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted_rows(r[:1] + r[3:] for r in queries.op7_warc(spark, str(tmp_path)).collect()) == sorted_rows([(1, "response", None), (2, "revisit", 1), (3, "response", None)])
    right = warc.headers
    for old, new in [("Length: 4", "Length: 5"), ("sha1:", "sha1:A"), ("Type: revisit", "Type: response"), ("Type: response", "Type: other"), ("Refers-To: <urn:page:1>", "Refers-To: <urn:page:x>"), ("text/html", "text/plain")]:
        path = str(tmp_path / hashlib.md5(new.encode()).hexdigest())
        with monkeypatch.context() as m:
            m.setattr(warc, "headers", lambda recs, old=old, new=new: F.replace(right(recs).cast("string"), F.lit(old), F.lit(new)).cast("binary"))
            warc.write_archive(pages, path)
        with monkeypatch.context() as m:
            m.setattr(warc, "write_archive", lambda *_: None)
            m.setattr(queries, "scratch_path", lambda *_, path=path: path)
            with pytest.raises(Exception, match="USER_RAISED_EXCEPTION|CAST_INVALID_INPUT"):
                queries.op7_warc(spark, "/root/testdata/sf0.001").collect()


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_filter(spark):
    random.seed(1)
    rules = [(f"{random.choice('abc')}.{random.choice(['net', 'org'])}", random.choice(["", "/", "/x", "/x/y/"]), random.choice(["block", "allow"])) for _ in range(12)] + url_filter.RULES
    urls = [None, "", "no scheme", "http://", "://A.NET/", "http://x.a.net?q", "http://a.net/x#y", "a://b://c.org/x", "http://ab.net/", "http://..a.net/x/y/z", "HTTP://EXAMPLE.com/de/", "http://é.Net/"]
    urls += [f"http://{random.choice(['', 'www.', 'q.w.'])}{random.choice('abcd')}.{random.choice(['net', 'org', 'com'])}{random.choice(['', '/', '/x', '/x/y/z'])}{random.choice(['', '?a=/', '#f'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, None, "again")], "page_id long, url string, verdict string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), rules[0]], "host string, path string, action string")
    got = url_filter.filter_urls(pages, table).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted_rows(got) == sorted_rows([(i, *judge(u, rules)) for i, u in enumerate(urls)] + [(0, "", "", None, "allow")])
    assert {r.verdict for r in url_filter.filter_urls(pages, table.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), table).count() == 0
    clash = pages.withColumns({c: F.lit(c) for c in ("fit", "key", "Host", "block", "word", "page", "suffix")})
    out = url_filter.filter_urls(clash, table)
    assert out.columns == ["page_id", "url", "fit", "key", "block", "word", "page", "suffix", "host", "path", "rule", "verdict"]
    assert sorted_rows(out.select("page_id", "host", "path", "rule", "verdict").collect()) == sorted_rows(got) and {r.fit for r in out.collect()} == {"fit"}


def test_url_filter_too_large_to_broadcast(spark, monkeypatch):
    """The filter and the list joined by their keys give the same."""
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    urls = ["http://a.net/x", "http://b.org/fr/1", "http://b.org/", "http://example.net/en/1", "http://www.example.com/de/", None, "http://a.net/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(pages, url_filter.contract_rules(spark)).drop("url").collect()
    assert sorted_rows(got) == sorted_rows([(i, *judge(u, url_filter.RULES)) for i, u in enumerate(urls)])
    long = spark.createDataFrame([(1, "http://" + "a." * 3000 + "net/" + "p/" * 5000)], "page_id long, url string")
    assert url_filter.filter_urls(long, url_filter.contract_rules(spark)).first().verdict == "block"


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 16))
    x = np.concatenate([base[rng.integers(0, 150, 900)] + rng.standard_normal((900, 16)) * rng.choice([0.02, 0.1, 0.25], (900, 1)), np.repeat(base[:1], 40, 0)]).astype(np.float32)
    rows = [(i * 2, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [float("inf")] * 16), (5004, [None] + [1.0] * 15), (5005, []), (None, x[0].tolist()), (0, x[0].tolist())]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>"), leaf=100).collect()
    assert len(got) == len(rows) + len(bad)
    by = {r.vec_id: r for r in got}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    found = sum(by[i * 2].n_links for i in range(1, len(x)))
    true = links[1:].sum() + 2 * links[0][1:].sum()  # the two more rows of vector 0
    assert 0.98 * true <= found <= true
    assert all(by[i].n_links == 0 and by[i].kept for i in range(5000, 5006))
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_dense_group_of_embeddings(spark):
    """A third of the vectors are one group, all different and all linked, of many times a leaf; a second group is wider than a link."""
    rng = np.random.default_rng(3)
    centre, other = np.eye(32)[0], np.eye(32)[1]
    noise = rng.standard_normal((2600, 32))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([centre + 0.155 * noise[:2000], other + 0.25 * noise[2000:], rng.standard_normal((3400, 32))])
    got = embedding_dedup.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), leaf=50).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    assert links[:2000, :2000].sum() == 2000 * 1999
    by = {r.vec_id: r for r in got}
    assert len(got) == len(by) == 6000
    assert all(by[i].n_links == links[i].sum() and by[i].component_id == 0 for i in range(2000))
    assert 0.98 * links[2000:].sum() <= sum(by[i].n_links for i in range(2000, 6000)) <= links[2000:].sum()


def components_of(links):
    """Smallest member of each row's component, brute force."""
    least = np.arange(len(links))
    while True:
        after = np.minimum(least, np.where(links, least[None, :], len(links)).min(axis=1))
        if (after == least).all():
            return least
        least = after


def test_leaves_beyond_the_sample_are_split(spark, monkeypatch):
    """A sample far too small for the table: leaves are split on their own vectors, and a dense group stays whole."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 24))
    x = np.concatenate([np.repeat(base, 2, axis=0) + 0.05 * rng.standard_normal((3000, 24)), np.eye(24)[0] + 0.004 * rng.standard_normal((300, 24))])
    sizes = []
    saved = embedding_dedup.saved
    monkeypatch.setattr(embedding_dedup, "saved", lambda df, name: (lambda out: (name == "sizes" and sizes.append(sorted(r["size"] for r in out.collect())), out)[1])(saved(df, name)))
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "Leaf": F.lit("x"), "kept": F.lit("y")})
    got = embedding_dedup.near_duplicates(rows, leaf=50, sample=64).collect()
    assert max(sizes[0]) > 1000 and np.median(sizes[-1]) <= 4 * 50 and max(sizes[-1]) <= 2 * 300  # the dense group does not come apart
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    by = {r.vec_id: r for r in got}
    found = sum(r.n_links for r in got)
    assert len(by) == 3300 and 0.95 * links.sum() <= found <= links.sum()
    least = components_of(links)
    assert np.mean([by[i].component_id == least[i] for i in range(3300)]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_a_dense_group_that_the_sample_does_not_see(spark):
    """A group too small for a ball of the sample and larger than an overfull leaf, so wide that splits cut through it."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(32)
    x = rng.standard_normal((8000, 32))
    x[:600] = centre / np.linalg.norm(centre) + 0.22 / np.sqrt(32) * rng.standard_normal((600, 32))
    x = x[rng.permutation(8000)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = sum(int((unit[k : k + 1000] @ unit.T >= 0.95).sum()) for k in range(0, 8000, 1000)) - 8000
    got = embedding_dedup.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), leaf=100, sample=64).collect()
    assert 0.98 * links <= sum(r.n_links for r in got) <= links and links > 200_000


def test_classifier_passes_odd_columns_on(spark):
    """Names with back quotes, fields with dashes, and kinds that have no plain name."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["good words here", None, "", "bad bad"] * 5)], "doc_id long, text string")
    model = quality_classifier.fit(docs, spark.createDataFrame([(k, k % 3) for k in range(20)], "doc_id long, grade int"))
    odd = docs.select("*", F.lit(1).alias("a`b"), F.struct(F.lit(2).alias("a-b"), F.lit("x").alias("c d")).alias("s t"), F.create_map(F.lit("k"), F.lit(1)).alias("m"), F.array(F.lit(None).cast("date")).alias("days"), F.lit("clash").alias("KEPT"))
    out = quality_classifier.score(odd, model)
    assert out.columns == ["doc_id", "text", "a`b", "s t", "m", "days", "expected_grade", "tail_probability", "kept"]
    rows = out.collect()
    assert len(rows) == 20 and all(r["a`b"] == 1 and r["s t"]["a-b"] == 2 and r.m == {"k": 1} and 0 <= r.expected_grade <= 2 for r in rows)


def test_embeddings_of_the_table(spark):
    """Recall on the table itself, and its components and kept rows, against all pairs."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids = sorted(x)
    unit = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    got = {r.vec_id: r for r in queries.op6_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    least = [ids[i] for i in components_of(links)]
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in ids] == [(int(n), c, c == i) for i, n, c in zip(ids, links.sum(axis=1), least, strict=True)]


def test_mixture(spark):
    random.seed(2)
    rows = [(i, "w " * random.randint(0, 30), random.choice(["en", "fr", None]), random.choice(["a", "b", "c"]), "clash") for i in range(600)] + [(None, "x y", "en", "a", "clash"), (0, None, "en", "a", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string")
    weights = spark.createDataFrame([("lang", "en", 3), ("source", "a", 5), ("source", "c", 0)], "level string, name string, weight long")
    out = mixing.mix(docs, {"lang": F.col("lang"), "source": F.col("source")}, weights, 1, 2, 2)
    got = out.collect()
    assert all(r.source != "c" and 0 <= r.take_tokens <= r.n_tokens for r in got)
    total = sum(len((r[1] or "").split()) for r in rows)
    assert total // 2 - 10 <= sum(r.take_tokens for r in got) <= total // 2
    by = {}
    for r in got:
        by[r.lang] = by.get(r.lang, 0) + r.take_tokens
    assert abs(by["en"] - 3 * by["fr"]) <= 10
    whole = {k for k in {(r.lang, r.source) for r in got} if max(r.epoch for r in got if (r.lang, r.source) == k) == 1}
    for lang, source in whole:
        n = sum(1 for r in rows if (r[2] or "unknown") == lang and r[3] == source)
        assert sum(1 for r in got if (r.lang, r.source, r.epoch) == (lang, source, 0)) == n
    assert sorted_rows(out.collect()) == sorted_rows(got)
    assert mixing.mix(docs.limit(0), {"lang": F.col("lang")}, weights).count() == 0


def prefix_of(rows, budget, epochs_allowed, seed=20262):
    """Brute force for one leaf: whole epochs, then rows in the order of the next one until the budget is used."""
    n = lambda r: len((r[1] or "").split())
    size = sum(map(n, rows))
    epochs, part = divmod(min(budget, size * epochs_allowed), size)
    out = [(r[0], r[1], e, n(r), n(r)) for r in rows for e in range(epochs)]

    def place(r):
        name = f"{seed}|{epochs}|{'none' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}"
        return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)

    sofar = 0
    for r in sorted(rows, key=place):
        if sofar >= part:
            break
        take = min(n(r), part - sofar)
        text = r[1]
        if take < n(r):
            text = "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)[:take])
        out.append((r[0], text, epochs, n(r), take))
        sofar += n(r)
    return out


def test_mixture_fills_its_budget_exactly(spark):
    """Repeated rows, repeated ids with other texts and null ids, at budgets that end within them; clashing columns stay."""
    random.seed(12)
    rows = [(None, "a b c d e f g h i j")] * 20 + [(3, "one two\tthree  four")] * 3 + [(3, " x y z")] * 2 + [(i, "w " * random.randint(0, 9)) for i in range(10, 25)] + [(9, None), (9, "")]
    fields = ("End", "rest", "epochs", "key", "last", "row", "hash", "l0", "copies", "slice")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in fields})
    weights = spark.createDataFrame([], "level string, name string, weight long")
    total = sum(len((t or "").split()) for _, t in rows)
    for budget in (1, 20, 205, total + 33, 2 * total - 1):
        out = mixing.mix(docs, {"leaf": F.lit("x")}, weights, budget, total, 2).collect()
        assert sum(r.take_tokens for r in out) == budget
        assert all(r[c] == f"own {c}" for r in out for c in fields)
        want = [x for x in prefix_of(rows, budget, 2) if x[3]]
        assert sorted_rows((r.doc_id, r.text, r.epoch, r.n_tokens, r.take_tokens) for r in out if r.n_tokens) == sorted_rows(want), budget
    many = spark.range(25_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    out = mixing.mix(many, {"leaf": F.lit("x")}, weights, 1, 2, 1)
    assert (out.count(), out.agg(F.sum("take_tokens")).first()[0]) == (12_500, 25_000)
    long = spark.createDataFrame([(1, "word " * 300_000)], "doc_id long, text string")
    assert len(mixing.mix(long, {"leaf": F.lit("x")}, weights, 1, 3, 1).first().text.split()) == 100_000


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        assert 0 < out.count() <= n, name
        if name != "bpe":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs, n = out, out.count()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, "s", 1), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5)], empty.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
        stage(spark, odd, sf).count()
