"""Many queries in one job: conjunctions joined to the postings by gram."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.plans.compiler import disjuncts, to_column
from termweave.plans.parser import Node, Term, parse

#: Queries whose literals are broadcast; longer logs are joined by gram.
BROADCAST_LITERALS = 100_000
Literal = tuple[str, int, int, str, bool, int]  # query, conjunction, stream, gram, wanted, wanted terms of the conjunction


def split_log(queries: Mapping[str, str], streams: Mapping[str, int] | None = None) -> tuple[list[Literal], dict[str, Node]]:
    """What can be met by counting literals, and the trees of all other queries.

    The others have phrases, conjunctions without a wanted term, or too many conjunctions.
    """
    rows, trees = [], {}
    for name, text in queries.items():
        tree = parse(text, streams)
        forms = disjuncts(tree)
        if forms is None or any(not all(isinstance(x, Term) for _, x in f) or not any(w for w, _ in f) for f in forms):
            trees[name] = tree
            continue
        for k, form in enumerate(forms):
            signs = {(x.stream, x.text): w for w, x in form}
            if all(signs[x.stream, x.text] == w for w, x in form):  # else a term is wanted and unwanted
                need = sum(signs.values())
                rows += [(name, k, stream, gram, w, need) for (stream, gram), w in signs.items()]
    return rows, trees


def met(hits: DataFrame, rows: list[Literal]) -> DataFrame:
    """(query, doc_id) of documents that meet all wanted and no unwanted literals. hits: distinct doc_id, stream, gram."""
    table = hits.sparkSession.createDataFrame(rows, "query string, form int, stream int, gram string, wanted boolean, need int")
    table = F.broadcast(table) if len(rows) <= BROADCAST_LITERALS else table
    found = hits.join(table, ["stream", "gram"]).groupBy("query", "form", "doc_id")
    found = found.agg(F.count(F.when(F.col("wanted"), 1)).alias("met"), F.max(~F.col("wanted")).alias("bad"), F.max("need").alias("need"))
    return found.where("met = need AND NOT bad").select("query", "doc_id").distinct()


def run_log(docs: DataFrame, queries: Mapping[str, str], stream_column: str = "terms") -> DataFrame:
    """(query, doc_id) of all matches, by one scan of documents without an index."""
    spark = docs.sparkSession
    rows, trees = split_log(queries)
    out = None
    if rows:
        grams = F.array(*[F.lit(g) for g in sorted({r[3] for r in rows})])
        own = F.array_intersect(stream_column, grams) if len(rows) <= BROADCAST_LITERALS else F.col(stream_column)
        out = met(docs.select("doc_id", F.lit(0).alias("stream"), F.explode(own).alias("gram")), rows)
    if trees:
        tests = F.array_compact(F.array(*[F.when(to_column(t, {0: stream_column}, {0: "toks"}), F.lit(q)) for q, t in trees.items()]))
        found = docs.select("doc_id", F.explode(tests).alias("query")).select("query", "doc_id")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query string, doc_id long")


def log_summary(found: DataFrame, queries: Mapping[str, str]) -> DataFrame:
    """Matches of each query, those without any included."""
    names = found.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    return names.join(found.groupBy("query").agg(F.count("*").alias("matches")), "query", "left").select("query", F.coalesce("matches", F.lit(0)).alias("matches"))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Of timings (succeeded, matches, plan_s, match_s) without the failed ones: rates, mean latency, share of planning."""
    t = timings.where("succeeded").withColumn("s", F.col("plan_s") + F.col("match_s"))
    total = F.nullif(F.sum("s"), F.lit(0.0))
    return t.agg(
        F.count("*").alias("queries"), F.sum("matches").alias("matches"), (F.count("*") / total).alias("queries_per_s"), (F.sum("matches") / total).alias("matches_per_s"),
        (F.sum("matches") / F.count("*")).alias("matches_per_query"), F.avg("s").alias("mean_latency"), (F.sum("plan_s") / total).alias("planning_share"),
    )


def phrase_against_plain(timings: DataFrame) -> DataFrame:
    """Seconds of the queries with a phrase and of the others, and how many of each."""
    phrase = F.col("query").contains('"')
    s = F.col("plan_s") + F.col("match_s")
    return timings.where("succeeded").agg(*(x for n, c in (("phrase", phrase), ("plain", ~phrase)) for x in (F.sum(F.when(c, s)).alias(f"{n}_s"), F.count(F.when(c, 1)).alias(f"{n}_queries"))))
