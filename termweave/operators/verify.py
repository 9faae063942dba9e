"""Expected against observed matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(expected: DataFrame, observed: DataFrame, on: tuple[str, ...] = ("query", "doc_id")) -> DataFrame:
    """Each pair with its kind: true_positive, false_positive or false_negative. Repeated pairs are one.

    One aggregation over both sides, so that their rows are shuffled once.
    """
    both = expected.select(*on, F.lit(True).alias("e"), F.lit(False).alias("o")).unionByName(observed.select(*on, F.lit(False).alias("e"), F.lit(True).alias("o")))
    met = both.groupBy(*on).agg(F.max("e").alias("e"), F.max("o").alias("o"))
    kind = F.when(F.col("e") & F.col("o"), "true_positive").when(F.col("o"), "false_positive").otherwise("false_negative")
    return met.select(*on, kind.alias("kind"))


def unverified(observed: DataFrame, on: tuple[str, ...] = ("query", "doc_id")) -> DataFrame:
    """Observed pairs of a run without ground truth."""
    return observed.select(*on).distinct().withColumn("kind", F.lit("unchecked"))


def summary(compared: DataFrame, by: str = "query") -> DataFrame:
    def n(kind: str):
        return F.count(F.when(F.col("kind") == kind, 1))

    got = compared.groupBy(by).agg(n("true_positive").alias("true_positives"), n("false_positive").alias("false_positives"), n("false_negative").alias("false_negatives"))
    rate = F.col("false_positives") / F.nullif(F.col("false_positives") + F.col("true_positives"), F.lit(0))
    noise = F.when(F.col("false_positives") == 0, F.lit(float("inf"))).otherwise(F.col("true_positives") / F.col("false_positives"))
    return got.withColumn("false_rate", rate).withColumn("signal_to_noise", noise)
