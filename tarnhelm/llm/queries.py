"""The queries op1_ to op10_ and the pipeline, over the tables ``documents embeddings pages benchmark labels``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate as D

    return D.report(D.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), lm.held_out("doc_id"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokens

    return tokens.round_trip(table(spark, sf_dir, "documents")).drop("ids")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.dedup(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.allot(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.report(pii.find_spans(table(spark, sf_dir, "documents")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.classes(table(spark, sf_dir, "documents")).drop("doc_key")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("doc_key")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import neighbours

    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_decontaminate": op3_decontaminate,
    "op5_lm_score": op5_lm_score,
    "op6_token_ids": op6_token_ids,
    "op10_substring_dedup": op10_substring_dedup,
    "op2_mixing": op2_mixing,
    "op8_pii": op8_pii,
    "op1_toxicity": op1_toxicity,
    "op7_neighbours": op7_neighbours,
    "op9_html_text": op9_html_text,
    "op4_near_duplicates": op4_near_duplicates,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WHITE = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
win AS (SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
occ AS (SELECT doc_id, k, n, id FROM (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)) JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM occ) GROUP BY doc_id),
names AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WHITE}) AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 19), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM again),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}
