"""The named queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    ann, bpe, hard_negatives, mixing, personal_data, quality, secret_scan, simhash, substring_dedup, token_alignment, token_files, url_filter,
)
from .common import WORD, model_file, read, tokenizer_file

HOST_RULES = (
    url_filter.HostRule(url_filter.ALLOW, "com", "/"),
    url_filter.HostRule(url_filter.BLOCK, "example.com", "/en/"),
    url_filter.HostRule(url_filter.ALLOW, "www.example.com", "/en/"),
    url_filter.HostRule(url_filter.BLOCK, "net", "/es/"),
    url_filter.HostRule(url_filter.BLOCK, "net", "/fr/"),
)
GLOB_RULES = (
    url_filter.GlobRule(url_filter.BLOCK, "*spam*/*"),
    url_filter.GlobRule(url_filter.BLOCK, "*casino*/*"),
)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return token_files.read_token_files(token_files.write_token_files(docs, tokenizer_file()))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_bytes(read(spark, sf_dir, "documents")).drop("kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), HOST_RULES, GLOB_RULES)


def op5_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_words(read(spark, sf_dir, "documents")).drop("kept", "spans")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents")).drop("redacted_text")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), tokenizer_file())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shifted)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.private_report(read(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokenizers(read(spark, sf_dir, "documents"), tokenizer_file(), model_file())


OP4_SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), named AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
  END AS rule FROM named
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN host || path LIKE '%spam%/%' OR host || path LIKE '%casino%/%' THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""


OP5_SQL = """
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM texts WHERE len(words) >= 20
), repeated AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY words[i:i + 19] ORDER BY doc_id, i) AS nth FROM placed) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM repeated
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS rest, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM texts) w
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.p = w.p) GROUP BY w.doc_id
)
SELECT t.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

_RULES = quality.Rules()
OP10_SQL = f"""
WITH texts AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 2]) AS times
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM texts WHERE len(words) >= 3)
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(t) AS n_chars,
    len(regexp_extract_all(t, '{quality.SYMBOLS}')) AS n_symbols, strlen(t) AS n_bytes, words,
    len(regexp_extract_all(t, '{quality.DIGITS}')) AS digits, len(regexp_extract_all(t, '{quality.CAPITALS}')) AS capitals,
    len(regexp_extract_all(t, '{quality.PUNCTUATION}')) AS punctuation
  FROM texts
), common AS (
  SELECT c.doc_id, w.word, count(u.word) AS v
  FROM counted c CROSS JOIN (SELECT unnest({list(quality.COMMON_WORDS)}) AS word) w
  LEFT JOIN (SELECT doc_id, unnest(words) AS word FROM counted) u ON u.doc_id = c.doc_id AND u.word = w.word
  GROUP BY c.doc_id, w.word
), bars AS (
  SELECT doc_id, lang, 'c' AS kind, unnest(['digits', 'capitals', 'punctuation', 'white', 'extra', 'rest']) AS k,
    unnest([digits, capitals, punctuation, n_chars - word_chars, n_bytes - n_chars, word_chars - digits - capitals - punctuation]) AS v
  FROM counted
  UNION ALL
  SELECT c.doc_id, lang, 'w', word, v FROM common c JOIN counted d ON d.doc_id = c.doc_id
  UNION ALL
  SELECT c.doc_id, any_value(lang), 'w', '', any_value(n_words) - sum(v) FROM common c JOIN counted d ON d.doc_id = c.doc_id GROUP BY c.doc_id
), shares AS (
  SELECT doc_id, kind, v / nullif(sum(v) OVER (PARTITION BY doc_id, kind), 0) AS p,
    sum(v) OVER (PARTITION BY lang, kind, k) / nullif(sum(v) OVER (PARTITION BY lang, kind), 0) AS q FROM bars
), distances AS (
  SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END / 2
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END / 2), 0)) AS d
  FROM shares WHERE p IS NOT NULL GROUP BY doc_id, kind
), judged AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < {_RULES.min_words}
      OR 100 * coalesce(n_repeat_words, 0) > {_RULES.max_repeat_percent} * n_words AS base_failed,
    coalesce(n_chars >= {_RULES.min_chars} AND x.d > {_RULES.max_char_distance}, false)
      OR coalesce(n_words >= {_RULES.min_words_for_distance} AND y.d > {_RULES.max_word_distance}, false) AS far
  FROM counted c LEFT JOIN lines l ON l.doc_id = c.doc_id LEFT JOIN repeats r ON r.doc_id = c.doc_id
  LEFT JOIN distances x ON x.doc_id = c.doc_id AND x.kind = 'c' LEFT JOIN distances y ON y.doc_id = c.doc_id AND y.kind = 'w'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept
FROM judged
"""


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 3
"""

_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LUHN = f"""list_sum([CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INTEGER)
  WHEN CAST({_DIGITS}[i] AS INTEGER) > 4 THEN 2 * CAST({_DIGITS}[i] AS INTEGER) - 9 ELSE 2 * CAST({_DIGITS}[i] AS INTEGER) END
  FOR i IN range(1, length({_DIGITS}) + 1)]) % 10 = 0"""
_ACCOUNT = """array_to_string([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END
  FOR c IN string_split(substr(replace(hit, ' ', ''), 5) || left(replace(hit, ' ', ''), 4), '')], '')"""
# The checks of the rules, written for SQL
OP12_CHECKS = {
    "email": "true",
    "ip": f"regexp_matches(hit, '^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$')",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": f"""CAST(CAST(CAST(CAST(CAST(left({_ACCOUNT}, 30) AS HUGEINT) % 97 AS VARCHAR) || substr({_ACCOUNT}, 31, 30) AS HUGEINT) % 97 AS VARCHAR)
      || substr({_ACCOUNT}, 61) AS HUGEINT) % 97 = 1""",
    "ssn": "NOT regexp_matches(hit, '^(000|666|9)') AND NOT regexp_matches(hit, '-00-|-0000$')",
    "local": f"regexp_matches({_DIGITS}, '^[2-9][0-9][0-9][2-9]')",
    "birth": """(regexp_matches(hit, '^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$')
      OR regexp_matches(hit, '^(0?[1-9]|[12][0-9]|3[01])[.](0?[1-9]|1[0-2])[.](19|20)[0-9][0-9]$')
      OR regexp_matches(hit, '^(0?[1-9]|[12][0-9]|3[01])/(0?[1-9]|[12][0-9]|3[01])/(19|20)[0-9][0-9]$'))""",
}


def _plain_pattern(pattern: str) -> str:
    """The same matches without look-behind and possessive marks, which only keep long texts fast."""
    pattern = pattern.replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "").replace("(?<![0-9])", "").replace("++", "+")
    return pattern.replace(r"\+", "[+]").replace("'", "''")


def _rule_sql(rank: int, rule: personal_data.Rule) -> str:
    pattern, alone = _plain_pattern(rule.pattern), rule.alone
    beside = f" AND NOT regexp_matches(right(before, 1), '{alone}') AND NOT regexp_matches(left(after, 1), '{alone}')" if alone else ""
    words = f" AND {rule.score} + CASE WHEN regexp_matches(lower(right(before, 40) || ' ' || left(after, 40)), '{rule.beside}') THEN {rule.gain} ELSE 0 END >= {personal_data.LEAST_SCORE}"
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, finish - length(hit) AS start, finish
  FROM (SELECT doc_id, hits[i] AS hit, parts[i] AS before, parts[i + 1] AS after,
          list_sum([length(x) FOR x IN parts[1:i]]) + list_sum([length(x) FOR x IN hits[1:i]]) AS finish
        FROM (SELECT doc_id, hits, parts, unnest(range(1, len(hits) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS parts FROM texts)))
  WHERE {OP12_CHECKS[rule.kind]}{beside}{'' if rule.base else words}"""


OP12_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_rule_sql(rank, rule) for rank, rule in enumerate(personal_data.RULES))}),
listed AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in personal_data.BASE_KINDS)},
    string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, rank) FILTER (rank < 4) AS base,
    string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in personal_data.BASE_KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN listed l ON l.doc_id = t.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_files, op2_suffix_dedup, op3_mixing, op4_url_filter, op5_word_windows, op6_secret_scan, op7_ann, op8_simhash, op9_bpe, op10_quality,
        op11_hard_negatives, op12_personal_data, op13_token_alignment,
    )
    return {query.__name__: query for query in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op5_word_windows": OP5_SQL, "op10_quality": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_personal_data": OP12_SQL}
