"""Queries p2, p7, p8, p9 and p10 over their whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legflow.llm import garble, leaks, linkage, nearest, tokenize
from legflow.tables import table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link([(t, table(spark, sf_dir, t).withColumnRenamed("bpuic", "key")) for t in ("dim_ch", "dim_de", "dim_at")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select(F.least("key_a", "key_b").alias("bpuic_a"), F.greatest("key_a", "key_b").alias("bpuic_b")).distinct()


def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.runs_with_trips(table(spark, sf_dir, "at_runs"), table(spark, sf_dir, "at_trips"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.affected(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.restored(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_confidence, p7_found, p8_ids, p9_found, p9_shares, p10_found, p10_restored)}

SQL: dict[str, str] = {
    "p7_found": """
with a as (select distinct rid, coalesce(nullif(ltrim(regexp_extract(num, '([0-9]+)[^0-9]*$', 1), '0'), ''), '0') as n, regexp_matches(num, '[0-9]') as ok,
  case when t_a > 100000000000 then t_a // 1000 else t_a end as ta, case when t_b > 100000000000 then t_b // 1000 else t_b end as tb from at_runs),
b as (select distinct trip_id, coalesce(nullif(ltrim(regexp_extract(num, '([0-9]+)[^0-9]*$', 1), '0'), ''), '0') as n, t_first, t_last from at_trips where regexp_matches(num, '[0-9]')),
j as (select rid, ta, tb, trip_id, t_first, abs(case when ta is null then tb - t_last else ta - t_first end) as d, case when ta is null then t_last else t_first end as bt from a join b using (n) where ok)
select distinct rid, arg_min(trip_id, (d, bt, t_first, trip_id)) as trip_id from j where d <= 900 group by rid, ta, tb""",
}
