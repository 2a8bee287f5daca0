"""The queries of this subpackage: name -> function(spark, sf_dir), and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, decontaminate, licenses, lm, packing, pii, quality, simhash, substring, tokenfile

QUERIES = {
    "op1_lm_scoring": lm.op1,
    "op2_pii": pii.op2,
    "op3_substring_dedup": substring.op3,
    "op4_token_counts": attribution.op4,
    "op5_token_files": tokenfile.op5,
    "op6_license_scan": licenses.op6,
    "op7_quality_rules": quality.op7,
    "op8_packing": packing.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_simhash": simhash.op10,
}


def _pick(name: str, *columns: str):
    """An operator's columns that SQL can express."""
    return lambda spark, sf_dir: QUERIES[name](spark, sf_dir).select(*columns)


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unigram columns of op1, without its model."""
    out = lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit=False)
    return out.withColumn("base_score", F.round("base_score", 6))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
#: The sum that Luhn's rule asks to be divisible by ten: digits from the right, each second one doubled.
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), CAST(i AS INTEGER) + 1, 1) AS INTEGER) ELSE 2 * CAST(substr(reverse({_DIGITS}), CAST(i AS INTEGER) + 1, 1) AS INTEGER) - 9 * CAST(CAST(substr(reverse({_DIGITS}), CAST(i AS INTEGER) + 1, 1) AS INTEGER) > 4 AS INTEGER) END))"

#: CRC-32 of doc_id as text, bit by bit.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), CAST(4294967295 AS BIGINT))"

QUERIES |= {
    "lm_base_columns": lm_base,
    "pii_base_columns": _pick("op2_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone"),
    "quality_base_columns": _pick("op7_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
}

#: SQL of the columns that rest on no model; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "pii_base_columns": rf"""
        SELECT doc_id,
            CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
            CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT))) <= 255)) AS BIGINT) AS n_ip,
            CAST(len(list_filter(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN} % 10 = 0)) AS BIGINT) AS n_card,
            CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "quality_base_columns": rf"""
        WITH w AS MATERIALIZED (SELECT doc_id, text, {_WORDS} AS words FROM documents),
        grams AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2])) AS g FROM w),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
        dup AS (SELECT doc_id, len(l) - len(list_distinct(l)) AS n FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
            SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(dup.n AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
            FROM w JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))""",
    "lm_base_columns": rf"""
        WITH h AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out FROM documents),
        t AS MATERIALIZED (SELECT doc_id, unnest(list_append({_WORDS.replace("coalesce(text, '')", f"coalesce({_LOWER}, '')")}, '')) AS token FROM documents),
        c AS MATERIALIZED (SELECT token, count(*) AS c FROM t JOIN h USING (doc_id) WHERE NOT held_out GROUP BY token),
        s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT t.doc_id, any_value(held_out) AS held_out, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(c) AS BIGINT) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
            round(sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))), 6) AS base_score
        FROM t JOIN h USING (doc_id) LEFT JOIN c USING (token), s GROUP BY t.doc_id""",
}
