"""Documents that arrive while queries run: appended batches, tombstones, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from termweave.functions.text import documents


class Store:
    """A folder with documents, tombstones and facts, each an append-only Parquet table.

    The last event of a document counts (by version); readers see whole batches only.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def add(self, docs: DataFrame, version: int) -> None:
        """docs: doc_id, text. An id that is already active fails, as does one that comes twice."""
        new = documents(docs).withColumn("version", F.lit(version).cast("long"))
        twice = new.groupBy("doc_id").count().where("count > 1")
        if not twice.isEmpty() or not new.join(self.active(), "doc_id", "left_semi").isEmpty():
            raise ValueError("a document id is already in use")
        new.write.mode("append").parquet(f"{self.folder}/documents")

    def delete(self, ids: DataFrame, version: int) -> int:
        """Marks active documents as deleted; ids that aren't active are no error. Returns how many were."""
        gone = self.active().join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit(version).cast("long").alias("version"))
        n = gone.count()
        if n:
            gone.write.mode("append").parquet(f"{self.folder}/tombstones")
        return n

    def set_fact(self, ids: DataFrame, fact: str, value: bool, version: int) -> None:
        ids.select("doc_id", F.lit(fact).alias("fact"), F.lit(value).alias("value"), F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{self.folder}/facts")

    def facts(self) -> DataFrame:
        rows = self._read("facts", "doc_id long, fact string, value boolean, version long")
        return rows.groupBy("doc_id", "fact").agg(F.max_by("value", "version").alias("value"))

    def active(self) -> DataFrame:
        docs = self._read("documents", "doc_id long, toks array<string>, terms array<string>, posting_count int, version long")
        gone = self._read("tombstones", "doc_id long, version long").groupBy("doc_id").agg(F.max("version").alias("gone"))
        return docs.join(gone, "doc_id", "left").where("gone IS NULL OR version > gone").drop("gone")

    def contains(self, ids: DataFrame) -> DataFrame:
        """doc_id and if it is an active document's."""
        held = self.active().select("doc_id", F.lit(True).alias("held"))
        return ids.select("doc_id").distinct().join(held, "doc_id", "left").select("doc_id", F.coalesce("held", F.lit(False)).alias("held"))

    def compact(self, folder: str) -> Store:
        """The active documents and last facts in a new folder, without tombstones."""
        self.active().write.parquet(f"{folder}/documents")
        self.facts().withColumn("version", F.lit(0).cast("long")).write.parquet(f"{folder}/facts")
        return Store(self.spark, folder)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Appends a stream of (doc_id, text) in batches; ids that are active already or come twice are left out."""

        def batch(df: DataFrame, version: int) -> None:
            first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
            fresh = df.withColumn("_n", first).where("_n = 1").drop("_n").join(self.active().select("doc_id"), "doc_id", "left_anti")
            documents(fresh).withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(f"{self.folder}/documents")

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
