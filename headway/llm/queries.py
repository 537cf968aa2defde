"""Registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from headway.llm import collocations, conversations, decontaminate, exact_dedup, language, licenses, lm, \
    near_dedup, packing, pages, pii, simhash, suffix_dedup
from headway.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        @functools.wraps(run)
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(prepare(spark), sf_dir)

        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql
        return prepared

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), vocabulary())


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages"))


EXACT_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = first_value(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body ORDER BY n DESC, doc_id)"""


@query("op9_exact_dedup", EXACT_SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


PHRASE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
one AS (SELECT lang, ws AS w, count(*) AS f FROM (SELECT lang, unnest(ws) AS ws FROM w) GROUP BY ALL),
two AS (SELECT lang, p[1] AS w1, p[2] AS w2, count(*) AS f FROM
  (SELECT lang, unnest([[ws[i], ws[i + 1]] FOR i IN range(1, len(ws))]) AS p FROM w) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, p[1] AS w1, p[2] AS w2, p[3] AS w3, count(*) AS f FROM
  (SELECT lang, unnest([[ws[i], ws[i + 1], ws[i + 2]] FOR i IN range(1, len(ws) - 1)]) AS p FROM w) GROUP BY ALL
  HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
inside AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM three UNION ALL
  SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, 1 AS k, t.f AS a, x.f AS l, y.f AS r FROM two t
  JOIN one x ON (t.lang, t.w1) = (x.lang, x.w) JOIN one y ON (t.lang, t.w2) = (y.lang, y.w)
  LEFT JOIN inside i ON (t.lang, t.w1, t.w2) = (i.lang, i.w1, i.w2) WHERE i.most IS NULL OR 100 * i.most < 50 * t.f
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f FROM three t
  JOIN one x ON (t.lang, t.w1) = (x.lang, x.w) JOIN two y ON (t.lang, t.w2, t.w3) = (y.lang, y.w1, y.w2)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f FROM three t
  JOIN two x ON (t.lang, t.w1, t.w2) = (x.lang, x.w1, x.w2) JOIN one y ON (t.lang, t.w3) = (y.lang, y.w)),
scores AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN n USING (lang) QUALIFY rank <= 2000"""


@query("op11_phrase_collocations", PHRASE_SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


@query("op13_simhash_near_dedup")
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.similar_groups(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
