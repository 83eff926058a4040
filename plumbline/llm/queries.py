"""The operators' queries, each over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, fingerprints, langid, licenses, lm_score, mixing, neardup, quality, sharding, token_files
from plumbline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def over(f: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))

    def lm(spark: SparkSession, sf_dir: str) -> DataFrame:
        domain = table(spark, sf_dir, "labels").filter("quality = 1")
        return lm_score.score(table(spark, sf_dir, "documents"), domain)

    return {
        "op1_byte_bpe": over(bpe.encode),
        "op2_token_files": over(token_files.write),
        "op3_sharding": over(sharding.shard),
        "op4_fingerprints": over(fingerprints.fingerprints),
        "op5_lm_score": lm,
        "op6_language_id": over(langid.identify),
        "op7_mixing": over(mixing.select),
        "op8_license_scan": over(licenses.scan),
        "op9_quality_rules": over(quality.judge),
        "op10_near_duplicates": over(neardup.groups),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sharding": sharding.shard_sql(),
        "op7_mixing": mixing.mixing_sql(),
        "op8_license_scan": licenses.scan_sql(),
        "op9_quality_rules": quality.judge_sql(),
    }
