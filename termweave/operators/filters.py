"""Corpus filters and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators.ordering import numbered


def by_posting_count(docs: DataFrame, low: int, high: int) -> DataFrame:
    return docs.where(F.col("posting_count").between(low, high))


def at_random(docs: DataFrame, fraction: float, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Keeps a document by 32 bits of its key's MD5, so that reruns and other partitions keep the same ones."""
    lot = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return docs.where(lot < int(fraction * (1 << 32)))


def first_documents(docs: DataFrame, n: int) -> DataFrame:
    """The n lowest doc_ids of those that get here."""
    return docs.orderBy("doc_id").limit(n)


def composite(docs: DataFrame, *conditions: Column) -> DataFrame:
    for c in conditions:
        docs = docs.where(c)
    return docs


def active(docs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Documents without a tombstone."""
    return docs.join(deleted.select("doc_id"), "doc_id", "left_anti")


def every(df: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """Every n-th row of each `by`, in `order`."""
    return numbered(df, [by], [order], "_n").where(F.col("_n") % n == 0).drop("_n")


def shard_range(docs: DataFrame, minima: list[int], low: int = 0, high: int | None = None) -> DataFrame:
    """The documents of the shards low to high, with shard_id; as bounds of the posting count, which prune."""
    from termweave.functions.scalar import shard_of

    ordered = sorted(minima)
    high = len(ordered) - 1 if high is None else high
    if not 0 <= low <= high < len(ordered):
        raise ValueError(f"no shards {low} to {high} of {len(ordered)}")
    least = F.col("posting_count") >= (ordered[low] if low else 0)
    most = F.col("posting_count") < ordered[high + 1] if high + 1 < len(ordered) else F.lit(True)
    return docs.where(least & most).withColumn("shard_id", shard_of(F.col("posting_count"), ordered))


def unchanged(docs: DataFrame) -> DataFrame:
    """The filter that keeps all."""
    return docs


def mark_shard(docs: DataFrame, minima: list[int]) -> DataFrame:
    """Adds a term SHARD_low_high for the shard of one more posting, as annotated chunks have it."""
    from termweave.functions.scalar import shard_of

    k = shard_of(F.col("posting_count") + 1, minima)
    names = F.array(*[F.lit(f"SHARD_{a}_{b}") for a, b in zip(minima, [*(m - 1 for m in minima[1:]), "max"], strict=True)])
    return docs.withColumn("terms", F.array_append("terms", F.get(names, k)))
