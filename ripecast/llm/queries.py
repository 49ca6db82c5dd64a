"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripecast.llm import (
    centroid_clustering, decontaminate, exact_dedup, importance_resampling, jaccard_join, language_id, lm_scoring, mixing,
    paragraph_dedup, quality_rules, sharding, suffix_dedup, url_filter,
)

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines, and passages inside longer lines or over several short ones."""
    return paragraph_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines alone, the first pass of op4_passage_dedup."""
    return paragraph_dedup.line_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.join(docs, size=4, share=85)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(
        "doc_id", "source", "repeats", "replica", F.round("rate", 6).alias("rate"), "shuffle_key")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", *quality_rules.STATISTICS, "base_failed", "kept", "rule")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs, language_id.profiles(docs))


# The page table has no fetch time and there is no block list, so both follow from its own rows by
# rules that SQL can repeat: the day from the page id, list changes from the md5 of every domain.
FIRST_DAY, DAYS = "2023-01-01", 730


def captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(
        f"date_add(DATE'{FIRST_DAY}', CAST(pmod(page_id, {DAYS}) AS int))").alias("fetched_on"))


def list_changes(pages: DataFrame) -> DataFrame:
    """Dated changes for the hosts of the pages and their domains: a listing, for half of them a removal, for a quarter a new listing."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()
    patterns = hosts.select(F.explode(F.array("host", F.substring_index("host", ".", -3))).alias("pattern")).distinct()
    digits = patterns.withColumn("h", F.md5("pattern"))
    number = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("int")
    start = F.expr(f"DATE'{FIRST_DAY}'")
    first = F.date_add(start, number(3, 3) % 500)
    second = F.date_add(first, number(6, 2) + 1)
    third = F.date_add(second, number(8, 2) + 1)
    change = lambda action, day: F.struct(F.lit(action).alias("action"), day.alias("changed_on"))
    listed = digits.filter(number(1, 2) < 96).withColumns({
        "category": F.element_at(F.array(F.lit("adult"), F.lit("spam"), F.lit("malware")), number(2, 1) % 3 + 1),
        "changes": F.filter(F.array(
            change("add", first),
            F.when(number(10, 1) < 8, change("remove", second)),
            F.when(number(10, 1) < 4, change("add", third))), lambda c: c.isNotNull()),
    })
    return listed.select("pattern", "category", F.inline("changes"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(captures(pages), list_changes(pages)).drop("url")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resampling.resample(docs, table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sharding": op2_sharding,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_passage_dedup": op4_passage_dedup,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_centroid_clustering": op13_centroid_clustering,
}
