"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import written

__all__ = ["ascii_lower", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    """Lower-case A-Z and nothing else.

    lower() is the fast way; it serves every text in which no other letter would change.
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    others = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"
    return F.when(text.rlike(others), F.translate(text, letters, letters.lower())).otherwise(F.lower(text))
