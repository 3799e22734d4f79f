"""The operators over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    additive,
    collocations,
    decontam,
    licenses,
    packing,
    quality,
    repair,
    simhash,
    tokencount,
    toxicity,
    urlfilter,
    variants,
    warc,
)
from tessera.session import table, written


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = quality.apply_policy(quality.ledger(docs))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does in each policy, from a stored ledger."""
    stored = written(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "ledger")
    return quality.ablation(stored)


def op6_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = additive.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return additive.score(docs, model)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_revisits,
        op2_url_filter,
        op3_decontamination,
        op4_simhash,
        op5_quality_rules,
        op6_repair_ids,
        op7_best_fit_packing,
        op8_token_counts,
        op9_license_scan,
        op10_toxicity,
        op11_spelling_variants,
        op12_quality_model,
        op13_collocations,
        quality_ablation,
    )
}

_KNOWN = ", ".join(f"('{k}', '{d}')" for k, d in licenses.table_of())
_SPELLINGS = ", ".join(f"'{a}': '{b}'" for a, b in licenses.SPELLINGS)

_LEDGER = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents
), win AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM win) WHERE k > 1
), cov AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (r)
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 16 ELSE 0 END)::BIGINT AS fail_bits FROM m
)
"""

ORACLE_SQL = {
    "op1_warc_revisits": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages
), b AS (
  SELECT page_id, payload_bytes, s, max(page_id) OVER (PARTITION BY s) AS first,
         list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(s, 5 * (j // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31)::INT, 1) FOR j IN range(32)], 'string_agg', '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM b
""",
    "op2_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), s AS (
  SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw_host FROM u
), h AS (
  SELECT page_id,
         translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM s
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT h.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC) AS k
  FROM h LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op5_quality_rules": _LEDGER + r"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
""",
    "quality_ablation": _LEDGER + r""", p(policy, all_bits) AS (VALUES ('base', 3), ('v1', 31)), r(rule, bit) AS (
  VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16)
)
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS failed, count(*) FILTER (fail_bits & all_bits = bit) AS only_this,
       count(*) FILTER (fail_bits & bit <> 0 AND fail_bits & all_bits <> bit) AS also_without
FROM p JOIN r ON all_bits & bit <> 0 LEFT JOIN b ON true GROUP BY policy, rule
""",
    "op9_license_scan": rf"""
WITH known(license_id, digest) AS (VALUES {_KNOWN}), d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), e AS (
  SELECT r, doc_id, unnest(range(len(l))) AS line_no, lower(unnest(l)) AS x FROM d
), c AS (
  SELECT r, doc_id, line_no,
         CASE WHEN regexp_matches(x, '{licenses.COPYRIGHT_LINE}') THEN ''
              ELSE array_to_string([coalesce(MAP {{{_SPELLINGS}}}[w], w)
                     FOR w IN string_split(trim(regexp_replace(x, '{licenses.PUNCTUATION}', ' ', 'g'), ' '), ' ')], ' ') END AS form
  FROM e
), w AS (
  SELECT doc_id, 'document' AS unit, NULL::BIGINT AS line_no,
         sha256(coalesce(string_agg(form, ' ' ORDER BY line_no) FILTER (form <> ''), '')) AS digest FROM c GROUP BY r, doc_id
  UNION ALL
  SELECT doc_id, 'line', line_no, sha256(form) FROM c WHERE form <> '' AND sha256(form) IN (SELECT digest FROM known)
)
SELECT w.*, license_id FROM w LEFT JOIN (SELECT digest, min(license_id) AS license_id FROM known GROUP BY digest) USING (digest)
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE crcs AS (
  SELECT [list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
          FOR i IN range(256)] AS t
), r AS (
  SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (
    SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS x FROM documents) WHERE length(x) >= 7
), g AS (
  SELECT run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS b FROM r GROUP BY doc_id, run
), h AS (
  SELECT run, k, xor(list_reduce([4294967295] || [('0x' || substr(b, 2 * j + 1, 2))::BIGINT FOR j IN range(length(b) // 2)],
                     lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])), 4294967295) AS h FROM g, crcs
), s AS (
  SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word FROM h
), v AS (
  SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), d AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.rest = b.word
), best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM p
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form,
         CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word AND place = 1
), chain AS (
  SELECT word, coalesce(form, word) AS root FROM f
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL AND c.root <> c.word
), last AS (
  SELECT c.word, root FROM chain c JOIN f ON c.root = f.word WHERE f.form IS NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces
), grams AS (
  SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))
), f AS (
  SELECT lang, k, g, count(*)::BIGINT AS a FROM grams GROUP BY lang, k, g
), sizes AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE k >= 2 AND a >= 30
), inside AS (
  SELECT DISTINCT lang, g[i : i + m - 1] AS g, a AS most FROM (
    SELECT lang, g, a, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k)
), kept AS (
  SELECT c.* FROM c LEFT JOIN (SELECT lang, g, max(most) AS most FROM inside GROUP BY lang, g) i ON c.lang = i.lang AND c.g = i.g
  WHERE most IS NULL OR 100 * most < 80 * a
), cuts AS (
  SELECT lang, g, a, k, unnest(range(1, k)) AS j FROM kept
), parts AS (
  SELECT cuts.lang, cuts.g, cuts.a, j, x.a AS l, y.a AS r, ((2000000::HUGEINT * cuts.a) // (x.a + y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1 : j] JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[j + 1 : cuts.k]
), lowest AS (
  SELECT *, array_to_string(g, ' ') AS phrase FROM parts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN sizes USING (lang) QUALIFY rank <= 2000
""",
}
