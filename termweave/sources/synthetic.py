"""Corpora made by rule, with arithmetic as their oracle, and query logs."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _primes(n: int) -> list[int]:
    return [p for p in range(2, n + 1) if all(p % q for q in range(2, int(p**0.5) + 1))]


def prime_factors(spark: SparkSession, n: int) -> DataFrame:
    """Document k of 0..n-1 has the prime factors of k as its terms."""
    primes = F.array(*[F.lit(p) for p in _primes(n)])
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    toks = F.transform(F.filter(primes, lambda p: (F.col("doc_id") > 0) & (F.col("doc_id") % p == 0)), lambda p: p.cast("string"))
    return rows.withColumn("toks", toks).withColumn("terms", F.col("toks")).withColumn("posting_count", F.size("terms"))


def growing(spark: SparkSession, n: int) -> DataFrame:
    """Document k of 1..n has the terms 0..k-1."""
    rows = spark.range(1, n + 1).withColumnRenamed("id", "doc_id")
    return rows.withColumn("toks", F.transform(F.sequence(F.lit(0), F.col("doc_id") - 1), lambda x: x.cast("string"))).withColumn("terms", F.col("toks")).withColumn("posting_count", F.size("terms"))


_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_words(n: int) -> str:
    """A number below a million in English words."""
    if n < 20:
        return _SMALL[n]
    if n < 100:
        return _TENS[n // 10 - 2] + (f" {_SMALL[n % 10]}" if n % 10 else "")
    unit, name = (100, "hundred") if n < 1000 else (1000, "thousand")
    return f"{number_words(n // unit)} {name}" + (f" {number_words(n % unit)}" if n % unit else "")


def counting(spark: SparkSession, n: int = 192) -> DataFrame:
    """Document k of 1..n has the words of the numbers 1 to k, as (doc_id, text)."""
    names = F.array(*[F.lit(number_words(k)) for k in range(1, n + 1)])
    return spark.range(1, n + 1).select(F.col("id").alias("doc_id"), F.array_join(F.slice(names, F.lit(1), F.col("id").cast("int")), " ").alias("text"))


def sentences(spark: SparkSession) -> DataFrame:
    """A corpus of a few documents that comes with the library, as (doc_id, title, text)."""
    rows = [
        (1, "weather", "the rain falls on the roof and the wind moves the trees"), (2, "garden", "the gardener waters the trees when no rain falls"),
        (3, "night", "on the roof a cat sleeps and the moon moves on"), (4, "empty", ""), (5, "town", "trees stand on both sides of the road to the town"),
    ]
    return spark.createDataFrame(rows, "doc_id long, title string, text string")


def phrase_log(log: DataFrame) -> DataFrame:
    """Of a table of queries: those of several terms, and each once more as a phrase."""
    several = log.where(F.size(F.split(F.trim("query"), r"\s+")) > 1).select("query")
    return several.union(several.select(F.concat(F.lit('"'), F.col("query"), F.lit('"'))))


def query_log(terms: list[str], queries: int, seed: int = 0, mean: float = 3.0, sd: float = 1.5, longest: int = 8) -> list[str]:
    """Queries of 1 to `longest` terms, lengths roughly normal, terms lognormal by place in the list."""
    rng = random.Random(seed)
    weights = [2.718281828 ** (-(((k - mean) / sd) ** 2) / 2) for k in range(1, longest + 1)]
    out = []
    for k in rng.choices(range(1, longest + 1), weights, k=queries):
        out.append(" ".join(terms[min(len(terms) - 1, int(rng.lognormvariate(0, 1) * len(terms) / 10))] for _ in range(k)))
    rng.shuffle(out)
    return out


def with_phrases(log: list[str]) -> list[str]:
    """Queries of several terms, and each once more as a phrase."""
    several = [q for q in log if len(q.split()) > 1]
    return several + [f'"{q}"' for q in several]


def zipf_lengths(vocabulary: int, postings: int, draws: int, seed: int = 0) -> list[tuple[int, int]]:
    """For random pairs of terms by Zipf's law: the shorter posting list and both lists' postings."""
    rng = random.Random(seed)
    weights = [1 / k for k in range(1, vocabulary + 1)]
    total = sum(weights)
    sizes = [max(1, int(postings * w / total)) for w in weights]
    return [(min(sizes[a], sizes[b]), sizes[a] + sizes[b]) for a, b in (rng.choices(range(vocabulary), weights, k=2) for _ in range(draws))]


def row_access(spark: SparkSession, blocks: int, density: float, rows: int, bits: int = 512, seed: int = 0) -> DataFrame:
    """How many of the rows a block reads until no bit is left, over simulated blocks: rows_read, blocks."""
    chance = F.array(*[F.lit(1 - (1 - density**k) ** bits) for k in range(1, rows + 1)])
    u = spark.range(blocks).select(F.rand(seed).alias("u"))
    return u.select((1 + F.size(F.filter(chance, lambda c: F.col("u") < c))).alias("rows_read")).groupBy("rows_read").agg(F.count("*").alias("blocks"))
