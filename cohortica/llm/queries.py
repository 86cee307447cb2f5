"""The registered queries of this folder and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.llm import common, decontam, fingerprint, html_extract, jaccard, licenses, mixing, quality, sharding, token_counts, token_output


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(_table(spark, sf_dir, "documents"))))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken, range-sorted by the training position of a document's first copy."""
    placed = mixing.place(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    facts = common.materialize(placed.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
        (F.size("positions") * F.col("size")).cast("long").alias("taken"),
        F.round(F.array_min("positions"), 6).alias("first_position"), F.round(F.array_max("positions"), 6).alias("last_position"),
    ), "mix-placed")
    return facts.repartitionByRange(common.task_count(spark), "first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


OP8_SQL = """
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k, row_number() OVER () AS r
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS n FROM rows GROUP BY source),
ranked AS (
  SELECT source, n, 1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w FROM sums),
phases AS (  -- the schedule of a source by its weight, and its integral at the ends of the phases
  SELECT w, list_transform(range(0, 5), lambda j: coalesce(list_sum(p[1:j]), 0.0) / list_sum(p)) AS ends
  FROM (VALUES (1, [1.0::DOUBLE, 1.0, 1.0, 1.0]), (2, [0.5::DOUBLE, 0.8, 1.2, 1.5]), (3, [1.5::DOUBLE, 1.2, 0.8, 0.5])) AS s(w, p)),
capped AS (
  SELECT *, sum(3 * n) OVER before AS fixed, (SELECT sum(w) FROM ranked) - coalesce(sum(w) OVER before, 0) AS rest
  FROM ranked WINDOW before AS (ORDER BY 3.0 * n / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT coalesce(arg_min(((SELECT sum(n) FROM ranked) - coalesce(fixed, 0)) / rest, 3.0 * n / w)
           FILTER (WHERE ((SELECT sum(n) FROM ranked) - coalesce(fixed, 0)) / rest < 3.0 * n / w), 1e300) AS x FROM capped),
goals AS (SELECT source, n, least(3.0 * n, ranked.w * x) AS target, ends FROM ranked, level JOIN phases ON phases.w = ranked.w),
placed AS (
  SELECT rows.*, n, target, ends,
         sum(size) OVER (PARTITION BY rows.source ORDER BY (1::BIGINT << (length(bin(size)) - 1)) * 256 <= n, k, doc_id, r ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows JOIN goals ON rows.source IS NOT DISTINCT FROM goals.source),
copies AS (  -- cumulative demand at the end of each copy taken
  SELECT *, list_transform(list_filter(range(0, 3), lambda c: upto - size / 2.0 + c * n <= target),
                           lambda c: least(1.0::DOUBLE, ((upto + c * n) / greatest(target, 1e-9))::DOUBLE)) AS demand
  FROM placed),
inverted AS (
  SELECT *, list_transform(demand, lambda u: list_extract(list_transform([greatest(len(list_filter(ends, lambda e: e < u)), 1)],
              lambda j: (j - 1 + (u - ends[j]) / (ends[j + 1] - ends[j])) / 4.0), 1)) AS positions
  FROM copies)
SELECT doc_id, size::BIGINT AS size, n AS source_size, round(target, 6) AS target, (size * len(positions))::BIGINT AS taken,
       round(list_min(positions), 6) AS first_position, round(list_max(positions), 6) AS last_position
FROM inverted
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_sharding, op2_html_text, op3_licenses, op4_jaccard_join, op5_token_counts, op6_fingerprints, op7_token_ids, op8_mixing, op9_quality,
        op10_decontamination,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": OP8_SQL}
