"""The engine: a corpus with its streams and facts, and what can be asked of it."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import documents, postings
from termweave.operators import batch, statistics, verify
from termweave.plans.compiler import to_column
from termweave.plans.parser import format_tree, parse


class Engine:
    """docs: doc_id, toks, terms, posting_count and fact columns; deleted: doc_ids that no query finds.

    streams: by name, a stream's id; columns: by id, its columns of terms and of tokens.
    """

    def __init__(self, docs: DataFrame, streams: Mapping[str, int] | None = None, columns: Mapping[int, tuple[str, str]] | None = None, deleted: DataFrame | None = None, stream_scope: str = "enforce"):
        self.all, self.deleted = docs, deleted
        self.streams, self.scope = dict(streams or {}), stream_scope
        columns = columns or {0: ("terms", "toks")}
        self.terms, self.tokens = {k: c[0] for k, c in columns.items()}, {k: c[1] for k, c in columns.items()}

    @classmethod
    def from_texts(cls, df: DataFrame, doc_id: str = "doc_id", text: str = "text", facts: tuple[str, ...] = (), **options) -> Engine:
        return cls(documents(df, doc_id, text, *facts), **options)

    @property
    def docs(self) -> DataFrame:
        return self.all if self.deleted is None else self.all.join(self.deleted.select("doc_id"), "doc_id", "left_anti")

    def condition(self, query: str):
        return to_column(parse(query, self.streams), self.terms, self.tokens, self.scope)

    def query(self, query: str) -> DataFrame:
        """The ids of the documents that match."""
        return self.docs.where(self.condition(query)).select("doc_id")

    def log(self, queries: Mapping[str, str]) -> DataFrame:
        return batch.run_log(self.docs, queries)

    def timed(self, queries: list[str]) -> DataFrame:
        """Each query with its matches and the seconds of parsing and matching; failed ones have none."""
        rows = []
        for q in queries:
            a = time.perf_counter()
            try:
                found = self.query(q)
                b = time.perf_counter()
                rows.append((q, True, found.count(), b - a, time.perf_counter() - b))
            except ValueError:
                rows.append((q, False, None, None, None))
        return self.all.sparkSession.createDataFrame(rows, "query string, succeeded boolean, matches long, plan_s double, match_s double")

    def explain(self, query: str) -> str:
        tree = parse(query, self.streams)
        found = self.query(query)
        plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return f"{format_tree(tree)}\n\n{self.condition(query)}\n\n{plan}"

    def verify(self, queries: Mapping[str, str], observed: DataFrame) -> DataFrame:
        """TP, FP and FN of observed (query, doc_id) against exact evaluation."""
        return verify.summary(verify.compare(self.log(queries), observed))

    def analyze(self, gram_size: int = 1) -> dict[str, DataFrame]:
        p = postings(self.docs, gram_size)
        return {
            "document_frequency": statistics.document_frequency(p, self.docs),
            "length_histogram": statistics.length_histogram(self.docs),
            "posting_totals": statistics.posting_totals(self.docs),
            "term_dictionary": statistics.term_dictionary(p),
        }

    def contains(self, term: str) -> DataFrame:
        """Has each document the term?"""
        return self.docs.select("doc_id", F.coalesce(F.array_contains("terms", term), F.lit(False)).alias("contains"))

    def save(self, folder: str) -> None:
        self.docs.write.mode("overwrite").parquet(folder)

    @classmethod
    def load(cls, spark, folder: str, **options) -> Engine:
        return cls(spark.read.parquet(folder), **options)
