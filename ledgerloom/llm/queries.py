"""One query for each operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, conversation_trie, embedding_dedup, fill_in_middle, jaccard_join, language_id, mixing, quality_classifier, quality_rules, suffix_dedup, url_filter, warc
from .common import scratch_path, table

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as prompt and completions; masks as start:end of trained code points."""
    turns = table(spark, sf_dir, "conversations")
    out = chat_format.preferences(turns, chat_format.neighbour_pairs(turns)).drop("chosen", "rejected")
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.withColumns({c: flat(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


OP1_SQL = r"""
WITH pairs AS (
  SELECT conv_id // 2 AS pair_id, min(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, min(conv_id) FILTER (conv_id % 2 = 1) AS rejected_id
  FROM conversations GROUP BY 1),
t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body, coalesce(role = 'assistant', false) AS trained
  FROM conversations WHERE conv_id IS NOT NULL),
eq AS (
  SELECT pair_id, k, count(*) = 2 AND count(DISTINCT struct_pack(r := role, t := text)) = 1 AS same FROM t GROUP BY ALL),
pre AS (
  SELECT pair_id, coalesce(min(k) FILTER (NOT same), max(k) + 1) - 1 AS n FROM eq GROUP BY 1),
m AS (
  SELECT pair_id, side, k, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, side ORDER BY k) AS e, length(body) AS b FROM t JOIN pre USING (pair_id) WHERE k > n QUALIFY trained),
s AS (
  SELECT pair_id, coalesce(string_agg((e - b)::BIGINT || ':' || e::BIGINT, ',' ORDER BY k) FILTER (side = 0), '') AS chosen_spans,
    coalesce(string_agg((e - b)::BIGINT || ':' || e::BIGINT, ',' ORDER BY k) FILTER (side = 1), '') AS rejected_spans FROM m GROUP BY 1),
r AS (
  SELECT t.pair_id,
    coalesce(string_agg(head || body, '' ORDER BY k) FILTER (side = 0 AND k <= n), '') AS prompt,
    coalesce(string_agg(head || body, '' ORDER BY k) FILTER (side = 0 AND k > n), '') AS chosen_text,
    coalesce(string_agg(head || body, '' ORDER BY k) FILTER (side = 1 AND k > n), '') AS rejected_text,
    coalesce(sum(length(body)) FILTER (side = 0 AND k > n AND trained), 0) AS n_chosen_trained,
    coalesce(sum(length(body)) FILTER (side = 1 AND k > n AND trained), 0) AS n_rejected_trained
  FROM t JOIN pre USING (pair_id) GROUP BY 1)
SELECT pair_id, chosen_id, rejected_id, n::BIGINT AS n_prefix, prompt, chosen_text, rejected_text, coalesce(chosen_spans, '') AS chosen_spans, coalesce(rejected_spans, '') AS rejected_spans,
  n_chosen_trained::BIGINT AS n_chosen_trained, n_rejected_trained::BIGINT AS n_rejected_trained
FROM pairs JOIN pre USING (pair_id) JOIN r USING (pair_id) LEFT JOIN s USING (pair_id)
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests, with the digest of what they decode to."""
    import public_tokenizers

    rank_path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), rank_path, public_tokenizers.PATTERN, ids=False, digests=True)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier 100-byte string, counted and taken out."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100, with_text=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The tree's weights in op4_mixing and the pipeline; names that are not here weigh 1.
MIX_WEIGHTS = [("domain", "web", 3), ("domain", "books", 2), ("lang", "en", 6), ("lang", "fr", 3), ("lang", "de", 3), ("lang", "es", 2), ("source", "src0", 2)]


def mix_levels() -> dict[str, Column]:
    """Domain, language and source of documents: sources 0 to 9 are the web, the others books."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    return {"domain": F.when(F.length(number) == 1, "web").otherwise("books"), "lang": F.col("lang"), "source": F.col("source")}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a mixture of 4/5 of all words: domain, language and source, each document twice at most."""
    weights = spark.createDataFrame(MIX_WEIGHTS, "level string, name string, weight long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, mix_levels(), weights).withColumn("take_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).drop("text")


def _deal_sql(name: str, nodes: str, parent: list[str], level: str) -> str:
    """A level's budgets: capacities, the running sums that decide who gets all it has, and the shares of the others."""
    keys = ", ".join(parent)
    cases = " ".join(f"WHEN {level} = '{n}' THEN {w}" for lv, n, w in MIX_WEIGHTS if lv == level)
    return f"""
{name}_c AS (SELECT {keys}, {level}, sum(size) * 2 AS cap, CASE {cases} ELSE 1 END AS w FROM leaves GROUP BY ALL HAVING sum(size) > 0),
{name}_o AS (SELECT c.*, p.budget AS total, coalesce(sum(cap) OVER (PARTITION BY {keys} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (PARTITION BY {keys} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_c c JOIN {nodes} p USING ({keys})),
{name}_f AS (SELECT *, cap * rest <= w * (total - before) AS full FROM {name}_o),
{name} AS (SELECT {keys}, {level}, CASE WHEN "full" THEN cap ELSE greatest(0, (w * (total - coalesce(sum(cap) FILTER ("full") OVER (PARTITION BY {keys}), 0))) // sum(w) FILTER (NOT "full") OVER (PARTITION BY {keys})) END AS budget FROM {name}_f)"""


OP4_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CASE WHEN length(regexp_extract(source, '([0-9]+)$', 1)) = 1 THEN 'web' ELSE 'books' END AS domain, len({WORDS_SQL})::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT 0 AS root, domain, lang, source, sum(n_tokens)::BIGINT AS size FROM t GROUP BY ALL),
r0 AS (SELECT 0 AS root, sum(size) * 4 // 5 AS budget FROM leaves),
{_deal_sql("r1", "r0", ["root"], "domain")},
{_deal_sql("r2", "r1", ["root", "domain"], "lang")},
{_deal_sql("r3", "r2", ["root", "domain", "lang"], "source")},
plan AS (SELECT domain, lang, source, budget // size AS epochs, budget % size AS part FROM r3 JOIN leaves USING (domain, lang, source)),
k AS (
  SELECT t.*, epochs, part, ('0x' || substr(md5('20262|' || epochs::BIGINT || '|' || coalesce(doc_id::VARCHAR, 'none') || '|' || md5(text)), 1, 15))::BIGINT AS key
  FROM t JOIN plan USING (domain, lang, source)),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM k)
SELECT doc_id, domain, lang, source, e::INTEGER AS epoch, n_tokens, n_tokens AS take_tokens, length(text)::BIGINT AS take_chars FROM (SELECT *, unnest(range(0, epochs::BIGINT)) AS e FROM k)
UNION ALL
SELECT doc_id, domain, lang, source, epochs::INTEGER, n_tokens, least(n_tokens, part - sofar)::BIGINT,
  CASE WHEN part - sofar < n_tokens THEN length(array_to_string(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+')[1 : (part - sofar)::BIGINT], '')) ELSE length(text) END::BIGINT
FROM o WHERE sofar < part
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of the best grade and verdict of every document; fitted on labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, quality_classifier.graded(table(spark, sf_dir, "labels")))
    return quality_classifier.score(docs, model).drop("text")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector at cosine 0.95."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive as a record, and read back from it."""
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    back = warc.read_archive(spark, path)
    return back.select(
        "page_id",
        F.length("payload").cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


OP7_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[1 + 5 * (k // 4) : 5 + 5 * (k // 4)])::BIGINT >> (15 - 5 * (k % 4))) & 31)]), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.contract_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN best USING (host, path)
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-duplicate class of every document: five words, Jaccard 0.8."""
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), percent=80, width=5)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base verdict and verdict of every document."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
l AS (SELECT doc_id, w, text, len(w) AS n_words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
wins AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n
  FROM (SELECT doc_id, unnest(h) AS h, unnest(range(1, len(h) + 1)) AS i
    FROM (SELECT doc_id, list_transform(range(1, n_words - 6), lambda k: array_to_string(w[k : k + 7], ' ')) AS h FROM l WHERE n_words >= 8))),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM wins WHERE n > 1) GROUP BY 1),
m AS (
  SELECT doc_id, n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(text) - len(replace(text, '!', '')) AS n_marks,
    len(list_filter(w, lambda x: list_contains({quality_rules.STOP_WORDS!r}, x))) AS n_stop_words
  FROM l LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.3 AND n_marks / n_words <= 0.5
    AND n_stop_words / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM b
"""


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by filters of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language_id.held_out(F.col("doc_id")).alias("held_out"))
    model = language_id.fit(docs.where("NOT held_out"))
    return language_id.identify(docs.drop("lang"), model).drop("text")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt on the first turns of each hundredth."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into lines and rearranged, as digests of the output and of the text restored from it."""
    out = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS k1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS k2,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 AS plain,
    ('0x' || h[25:32])::BIGINT % 100 < 50 AS spm FROM d),
p AS (
  SELECT *, array_to_string(units[:least(k1, k2)], '') AS prefix, array_to_string(units[least(k1, k2) + 1:greatest(k1, k2)], '') AS middle,
    array_to_string(units[greatest(k1, k2) + 1:], '') AS suffix FROM k)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_bpe, op3_suffix_dedup, op4_mixing, op5_quality_classifier, op6_embedding_dedup, op7_warc, op8_url_filter,
        op9_jaccard_join, op10_quality_rules, op11_language_id, op12_prefix_trie, op13_fill_in_middle,
    )
}
ORACLES = {"op1_chat_format": OP1_SQL, "op4_mixing": OP4_SQL, "op7_warc": OP7_SQL, "op8_url_filter": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op10_quality_rules": OP10_SQL, "op13_fill_in_middle": OP13_SQL}
