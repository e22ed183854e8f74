"""Queries op1 to op13 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, exact_dedup, fertility, mixing, near_dedup, packing, pu_classifier, sharding, substring_dedup, token_counts, toxicity, url_filter, whitening
from .common import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fertility": lambda s, d: fertility.op1(_docs(s, d)),
        "op2_near_dedup": lambda s, d: near_dedup.op2(_docs(s, d)),
        "op3_url_filter": url_filter.queries_op3,
        "op4_quality": lambda s, d: pu_classifier.op4(_docs(s, d), table(s, d, "labels")),
        "op5_exact_dedup": lambda s, d: exact_dedup.op5(_docs(s, d)),
        "op6_sharding": lambda s, d: sharding.op6(_docs(s, d)),
        "op7_mixing": lambda s, d: mixing.op7(_docs(s, d)),
        "op8_substring_dedup": lambda s, d: substring_dedup.op8(_docs(s, d)),
        "op9_packing": lambda s, d: packing.op9(_docs(s, d)),
        "op10_toxicity": lambda s, d: toxicity.op10(_docs(s, d), table(s, d, "labels")),
        "op11_whitening": lambda s, d: whitening.op11(table(s, d, "embeddings")),
        "op12_token_counts": lambda s, d: token_counts.op12(_docs(s, d)),
        "op13_centroids": lambda s, d: centroids.op13(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": near_dedup.ORACLE, "op3_url_filter": url_filter.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op6_sharding": sharding.ORACLE, "op7_mixing": mixing.ORACLE, "op8_substring_dedup": substring_dedup.ORACLE, "op13_centroids": centroids.ORACLE}
