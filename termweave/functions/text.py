"""Texts to tokens, terms and n-grams, in built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\x0B\r\f]+"
MAX_GRAM = 7


def tokenize(text: Column | str, lower: bool = True) -> Column:
    """Tokens in order; null and blank texts have none."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.lower(c) if lower else c
    return F.filter(F.coalesce(F.split(c, BLANKS), F.array().cast("array<string>")), lambda x: x != "")


def ngrams(tokens: Column, size: int) -> Column:
    """All grams of 1 to size tokens at each place, joined by a blank: struct(gram, gram_size, pos)."""
    if not 1 <= size <= MAX_GRAM:
        raise ValueError(f"gram size must be 1 to {MAX_GRAM}")
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))

    def at(p: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(size), F.size(tokens) - p))
        return F.transform(sizes, lambda n: F.struct(F.array_join(F.slice(tokens, p + 1, n), " ").alias("gram"), n.alias("gram_size"), p.alias("pos")))

    return F.flatten(F.transform(places, at))


def contains_phrase(tokens: Column, grams: Sequence[str]) -> Column:
    """Do the grams stand next to each other in this order?

    The tokens are joined by NUL, which no token has, so that this is one search in a string for each row.
    """
    row = F.concat(F.lit("\0"), F.array_join(tokens, "\0"), F.lit("\0"))
    return F.coalesce(F.contains(row, F.lit("\0" + "\0".join(grams) + "\0")), F.lit(False))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r'([ \t\f\x0B&|\\()":\-])', r"\\$1")


def documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """doc_id, toks (in order), terms (distinct), posting_count and kept columns."""
    tokens = df.select(F.col(doc_id).alias("doc_id"), tokenize(text).alias("toks"), *keep)
    return tokens.withColumn("terms", F.array_distinct("toks")).withColumn("posting_count", F.size("terms"))


def tokens_table(docs: DataFrame, stream_id: int = 0) -> DataFrame:
    """doc_id, stream_id, pos, term."""
    return docs.select("doc_id", F.lit(stream_id).cast("short").alias("stream_id"), F.posexplode("toks").alias("pos", "term"))


def grams_of(tokens: Column, size: int) -> Column:
    """The grams of exactly `size` tokens, in order: neighbours are zipped, so that the work is one pass a size."""
    if not 1 <= size <= MAX_GRAM:
        raise ValueError(f"gram size must be 1 to {MAX_GRAM}")
    out = tokens
    for k in range(1, size):
        n = F.greatest(F.size(tokens) - k, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), n), F.slice(tokens, F.lit(k + 1), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def postings(docs: DataFrame, gram_size: int = 1, *keep: str, exact: bool = False) -> DataFrame:
    """Distinct (doc_id, gram, gram_size); grams never cross documents. exact: of this size only, else up to it."""
    if gram_size == 1:
        return docs.select("doc_id", *keep, F.explode("terms").alias("gram"), F.lit(1).alias("gram_size"))
    sizes = [gram_size] if exact else range(1, gram_size + 1)
    def sized(k: int) -> Column:
        return F.transform(F.array_distinct(grams_of(F.col("toks"), k)), lambda g: F.struct(g.alias("gram"), F.lit(k).alias("gram_size")))

    each = [sized(k) for k in sizes]
    return docs.select("doc_id", *keep, F.explode(F.concat(*each)).alias("g")).select("doc_id", *keep, "g.gram", "g.gram_size")
