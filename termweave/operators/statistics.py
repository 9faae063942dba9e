"""Corpus statistics. postings: (shard, doc_id, gram, gram_size); shards are any partition column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.operators.ordering import numbered, running_sum


def accumulate(value: str, prefix: str = "") -> list[Column]:
    """Count, mean, least, most and sample variance; the variance of a single value is 1."""
    v = F.when(F.count(value) < 2, F.lit(1.0)).otherwise(F.var_samp(value))
    return [F.count(value).alias(f"{prefix}count"), F.avg(value).alias(f"{prefix}mean"), F.min(value).alias(f"{prefix}min"), F.max(value).alias(f"{prefix}max"), v.alias(f"{prefix}var")]


def document_frequency(postings: DataFrame, docs: DataFrame, shard: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """df and frequency of each gram among its shard's documents, if the frequency reaches `least`."""
    shard = shard or []
    found = postings.groupBy(*shard, "gram", "gram_size").agg(F.count("*").alias("df"))
    if shard:
        sizes = docs.groupBy(*shard).agg(F.count("*").alias("n"))  # a row a shard
        found = found.join(sizes, shard)
    else:
        one = docs.agg(F.count("*").alias("n")).withColumn("_k", F.lit(0))  # a single row
        found = found.withColumn("_k", F.lit(0)).join(F.broadcast(one), "_k").drop("_k")
    return found.withColumn("frequency", F.col("df") / F.col("n")).where(F.col("frequency") >= least)


def length_histogram(docs: DataFrame, shard: list[str] | None = None) -> DataFrame:
    return docs.groupBy(*(shard or []), "posting_count").agg(F.count("*").alias("documents"))


def posting_totals(docs: DataFrame, shard: list[str] | None = None) -> DataFrame:
    return docs.groupBy(*(shard or [])).agg(F.count("*").alias("documents"), F.sum("posting_count").alias("postings"))


def cumulative_terms(postings: DataFrame, docs: DataFrame, shard: str) -> DataFrame:
    """After each document (by doc_id within its shard), how many different grams came up so far.

    Grams count at the document where they come first.
    """
    first = postings.groupBy(shard, "gram").agg(F.min("doc_id").alias("doc_id"))
    new = first.groupBy(shard, "doc_id").agg(F.count("*").alias("new"))
    rows = docs.select(shard, "doc_id").join(new, [shard, "doc_id"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return running_sum(rows, [shard], ["doc_id"], F.col("new"), "terms").select(shard, "doc_id", "terms")


def by_frequency(frequencies: DataFrame) -> DataFrame:
    """frequencies with `place`, 0 and up: the most frequent gram first, equal ones by gram."""
    return numbered(frequencies, [], [F.desc("df"), F.asc("gram")], "place")


def frequency_breaks(ordered: DataFrame) -> DataFrame:
    """Places of a frequency table whose frequency is above the one before: a well-ordered table has none."""
    after = ordered.select((F.col("place") + 1).alias("place"), F.col("frequency").alias("before"))
    return ordered.join(after, "place").where("frequency > before").select("place", "gram", "frequency")


def documents_by_idf(frequencies: DataFrame) -> DataFrame:
    """Grams and postings for each df: the shape of a frequency table."""
    return frequencies.groupBy("df").agg(F.count("*").alias("grams"), F.sum("df").alias("postings"))


def ingest_statistics(docs: DataFrame, source_bytes: Column) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.sum(source_bytes).alias("total_bytes"), F.avg(source_bytes).alias("bytes_per_document"), F.sum("posting_count").alias("postings"))


def term_dictionary(postings: DataFrame) -> DataFrame:
    """A text for each hash, the least one where hashes collide."""
    return postings.select(F.xxhash64("gram").alias("hash"), "gram").groupBy("hash").agg(F.min("gram").alias("text"))


def compare_frequencies(left: DataFrame, right: DataFrame, absent: float = 1e-8) -> DataFrame:
    """Two frequency tables by gram, what one lacks having the frequency `absent`; with their ratio."""
    a, b = left.select("gram", F.col("frequency").alias("left")), right.select("gram", F.col("frequency").alias("right"))
    both = a.join(b, "gram", "full_outer").select("gram", F.coalesce("left", F.lit(absent)).alias("left"), F.coalesce("right", F.lit(absent)).alias("right"))
    return both.withColumn("ratio", F.col("left") / F.col("right"))


def cooccurrence(postings: DataFrame, listed: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of listed grams (a bounded list) and how many documents they share, if `least` or more."""
    p = postings.join(F.broadcast(listed), "gram", "left_semi").select("doc_id", "gram")
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.gram") < F.col("b.gram")))
    return pairs.groupBy(F.col("a.gram").alias("left"), F.col("b.gram").alias("right")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def order_statistics(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999)) -> DataFrame:
    """Exact interpolated percentiles, over the histogram of values: rows are counted before any task orders them."""
    h = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    h = h.select(F.col(value).alias("v"), F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(value)).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    out = []
    for s in shares:
        place = F.lit(s) * (F.col("all") - 1)
        low, high = (F.min(F.when(F.col("upto") > x, F.col("v"))) for x in (F.floor(place), F.ceil(place)))
        out.append((low + (high - low) * (F.max(place) - F.floor(F.max(place)))).alias(f"p{str(s)[2:]}"))
    return h.agg(*out, F.max("v").alias("largest"))


def column_sum(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sum(value).alias("total"))


def hash_to_text(hashes: DataFrame, dictionary: DataFrame, absent: str = "UNKNOWN") -> DataFrame:
    """hashes with the text that the dictionary has for each, or the default."""
    return hashes.join(dictionary, "hash", "left").withColumn("text", F.coalesce("text", F.lit(absent)))


def log_against_frequencies(log: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Of a query log (query): each of its terms, how many queries have it, and its df (0 where no document has it)."""
    terms = log.select(F.explode(F.array_distinct(F.split(F.trim("query"), r"\s+"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("queries"))
    return terms.join(frequencies.select("gram", "df"), "gram", "left").select("gram", "queries", F.coalesce("df", F.lit(0)).alias("df"))


def bytes_used(lines: DataFrame, line: str = "line") -> DataFrame:
    """The sum of all numbers before 'bytes/document' in a report's lines."""
    n = F.regexp_extract(line, r"([0-9.]+) bytes/document", 1)
    return lines.where(n != "").agg(F.sum(n.cast("double")).alias("bytes_per_document"))


def density_table(sizes: DataFrame, documents: int) -> DataFrame:
    """Of runs (density, bytes_per_document, queries_per_s): megabytes, thousand queries a second, and their ratio."""
    mb = F.col("bytes_per_document") * documents / 1e6
    return sizes.select("density", mb.alias("mb"), (F.col("queries_per_s") / 1000).alias("kqps"), (F.col("queries_per_s") / mb).alias("dq"))
