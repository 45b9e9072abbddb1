"""Queries of the training-data problems and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import broken_pairs, entity_matching, leakage, mixing, plain_names, sentences, survivorship, value_mapping
from graphloom.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivorship.found(table(spark, folder, "entity"), table(spark, folder, "feed_trust"))


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    return survivorship.records(table(spark, folder, "entity"), table(spark, folder, "feed_trust")).drop("attributes")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return plain_names.found(table(spark, folder, "entity"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return value_mapping.found(*[table(spark, folder, t) for t in ("entity", "chat_request", "campus_list")])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return entity_matching.found(*[table(spark, folder, t) for t in ("program_listing", "entity", "feed_trust", "campus_list")])


def p6_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return entity_matching.match(*[table(spark, folder, t) for t in ("program_listing", "entity", "feed_trust", "campus_list")])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return broken_pairs.found(*[table(spark, folder, t) for t in ("chat_request", "chat_response", "eval_results")])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.found(table(spark, folder, "documents"), table(spark, folder, "eval_case"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.report(table(spark, folder, "documents"), table(spark, folder, "eval_case"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.found(table(spark, folder, "documents"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_target")).select("doc_id", "source", "tokens", "repeats")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_target")
    return mixing.shares(mixing.mix(table(spark, folder, "documents"), targets), targets)


QUERIES = {f.__name__: f for f in (p3_found, p3_records, p4_found, p5_found, p6_found, p6_confidence, p7_found, p8_found, p8_report, p9_mix, p9_shares, p10_found)}

_NOTHING = ", ".join(f"'{x}'" for x in survivorship.NOTHING)
_BLANKS = r"[\s\p{Z}\p{Cc}\p{Cf}]+"
_BARE = f"lower(regexp_replace(v, '^{_BLANKS}|{_BLANKS}$', '', 'g'))"
_SURVIVORS = f"""given AS (SELECT * FROM entity WHERE id IS NOT NULL AND id <> ''),
fields AS (
  SELECT id, feed, scraped_at, rec_id, 'name' AS field_name, name AS v FROM given
  UNION ALL SELECT id, feed, scraped_at, rec_id, 'url', url FROM given
  UNION ALL SELECT id, feed, scraped_at, rec_id, 'attributes.' || e.key, e.value FROM (SELECT *, unnest(map_entries(attributes)) AS e FROM given)),
usable AS (SELECT * FROM (SELECT *, {_BARE} AS bare FROM fields) WHERE NOT regexp_matches(bare, '(\\.\\.\\.|…)$')
  AND CASE WHEN field_name = 'url' THEN regexp_matches(bare, '^(https?|ftp)://[^\\s/?#.]+(\\.[^\\s/?#.]+)+\\.?([/?#]|$)')
      ELSE regexp_matches(bare, '[\\p{{L}}\\p{{N}}]') AND bare NOT IN ({_NOTHING}) AND NOT regexp_matches(bare, '{survivorship.NOWHERE}') END),
sizes AS (SELECT id, count(*) AS "rows" FROM given GROUP BY id),
best AS (SELECT id, field_name, rec_id, v, "rows" FROM (
  SELECT u.*, s."rows", row_number() OVER (PARTITION BY u.id, field_name ORDER BY trust DESC NULLS LAST, scraped_at DESC NULLS LAST, rec_id) AS k
  FROM usable u LEFT JOIN feed_trust USING (feed) JOIN sizes s ON s.id = u.id) WHERE k = 1)"""

ORACLES = {
    "p3_found": f"""WITH {_SURVIVORS} SELECT id AS entity_id, field_name, rec_id FROM best WHERE "rows" >= 2""",
    "p3_records": f"""WITH {_SURVIVORS} SELECT id, max(v) FILTER (field_name = 'name') AS name, max(v) FILTER (field_name = 'url') AS url, max("rows") AS "rows" FROM best GROUP BY id""",
}
