"""A stored index: postings by gram with places, documents, and document frequencies, written once and read pruned.

A folder holds Parquet tables. `documents` has what was kept of each document. `postings` (bucket, stream, gram,
carried columns, df, doc_ids, steps, ends, places) has a block of documents in a row: `places` are those of all its
documents, one after the other, up to `ends` each; `steps` lead from one's doc_index to the next, if they are numbered. It lies in a folder for each bucket of gram hashes and is sorted
by gram, so that a query reads the buckets of its grams and within them the row groups that may hold these.
`frequencies` has df by stream and gram.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from termweave.functions.blocks import gathered, pack, spans, starts, steps, summed, unpack, whole
from termweave.operators import batch
from termweave.operators.ordering import SLOT, before_slots, index_of_slot
from termweave.plans.api import Engine
from termweave.plans.compiler import evaluate, literals, possible_without
from termweave.plans.parser import Fact, Node, Phrase, Term, parse
from termweave.sources.workspace import PACKED, small_batches

BUCKETS = 64
#: Documents for which a bucket gets one more task, beyond the first few.
DEALT = 250_000
#: Tokens that a worker groups at once, and places at most in a row of postings, or a single document's.
GROUPED, LONGEST = 1 << 21, 1 << 16


def buckets_of(grams: pa.Array, buckets: int) -> np.ndarray:
    return (pd.util.hash_array(grams.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int32)


def _codes(columns: list[pa.Array], n: int) -> np.ndarray:
    """A number for each row, equal where all columns are."""
    out = np.zeros(n, np.int64)
    for c in columns:
        c = c.dictionary_encode(null_encoding="encode")
        out = np.unique(out * (len(c.dictionary) + 1) + c.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
    return out


def _grouped(docs: pa.Table, streams: Mapping[int, str], carried: tuple[str, ...], buckets: int) -> Iterator[tuple[int, bytes]]:
    """For each bucket, what these documents have of it: blocks (stream, gram, one document with the carried values,
    postings), postings (document, places) and places."""
    grams, of, at, stream = [], [], [], []
    for k, name in streams.items():
        c = whole(docs.column(name))
        counts = np.nan_to_num(c.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        grams.append(c.flatten())
        of.append(np.repeat(np.arange(len(c)), counts))
        at.append(spans(np.zeros(len(c), np.int64), counts))
        stream.append(np.full(int(counts.sum()), k))
    grams = pa.concat_arrays(grams)
    of, at, stream = map(np.concatenate, (of, at, stream))
    if grams.null_count:
        held = grams.is_valid().to_numpy(zero_copy_only=False)
        grams, of, at, stream = grams.drop_null(), of[held], at[held], stream[held]
    if not len(grams):
        return
    coded = grams.dictionary_encode()
    bucket = buckets_of(coded.dictionary, buckets)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    kinds = sorted(streams)
    alike = _codes([whole(docs.column(c)) for c in carried], docs.num_rows)
    key = (rank[coded.indices.to_numpy()] * len(kinds) + np.searchsorted(kinds, stream)) * (alike.max() + 1) + alike[of]
    by = np.argsort(key, kind="stable")  # documents and places are in order already
    key, of, at, stream = key[by], of[by], at[by], stream[by]
    block = np.concatenate(([True], key[1:] != key[:-1]))
    posting = block | np.concatenate(([True], of[1:] != of[:-1]))
    first = np.flatnonzero(posting)
    begun = np.flatnonzero(block[first])  # postings that begin a block
    lengths = np.diff(np.append(first, len(key)))
    sizes = np.diff(np.append(begun, len(first)))
    word = order[key[first[begun]] // (len(kinds) * (alike.max() + 1))]
    home, token_at = bucket[word], starts(lengths)
    cuts = np.concatenate(([0], np.flatnonzero(home[1:] != home[:-1]) + 1, [len(home)]))
    posting_at = starts(sizes)
    for a, b in zip(cuts[:-1], cuts[1:]):
        first_, last = posting_at[a], posting_at[b]
        own, local = np.unique(of[first[first_:last]], return_inverse=True)
        t = {c: whole(docs.column(c)).take(pa.array(own)) for c in docs.column_names if c not in streams.values()}
        t |= {"_gram": coded.dictionary.take(pa.array(word[a:b])), "_stream": pa.array(stream[first[begun[a:b]]].astype(np.int32)), "_size": pa.array(sizes[a:b].astype(np.int32))}
        places = steps(at[token_at[first_] : token_at[last]], lengths[first_:last])
        t |= {"_doc": pa.array(np.diff(local, prepend=0).astype(np.int32)), "_length": pa.array(lengths[first_:last].astype(np.int32)), "_place": pa.array(places.astype(np.int32))}
        yield int(home[a]), pack(t)


def _merged(bucket: int, got: list[bytes], names: list[str], carried: tuple[str, ...]) -> Iterator[dict]:
    """The rows of postings of a bucket's parts; those of a gram are joined, up to LONGEST places."""
    parts = [unpack(x) for x in got]
    docs = {c: pa.concat_arrays([p[c] for p in parts]) for c in names}
    n_docs = [len(p[names[0]]) for p in parts]
    numbers = docs["doc_index"].to_numpy() if "doc_index" in docs else None
    doc = np.concatenate([np.cumsum(p["_doc"].to_numpy()) + d for p, d in zip(parts, starts(np.array(n_docs)))])
    gram = pa.concat_arrays([p["_gram"] for p in parts]).dictionary_encode()
    stream, size, length, place = (np.concatenate([p[c].to_numpy() for p in parts]).astype(np.int64) for c in ("_stream", "_size", "_length", "_place"))
    del parts
    place = summed(place, length)
    start, token = starts(size), starts(length)
    alike = _codes([docs[c] for c in carried], len(docs[names[0]]))[doc[start[:-1]]]
    by = np.lexsort((alike, stream, gram.indices.to_numpy()))  # stable: what came first stays first
    posting = spans(start[by], size[by])
    doc, held, token = doc[posting], length[posting], token[posting]
    word, stream, alike = gram.indices.to_numpy()[by], stream[by], alike[by]
    new = np.ones(len(by), bool)
    new[1:] = (word[1:] != word[:-1]) | (stream[1:] != stream[:-1]) | (alike[1:] != alike[:-1])
    new = np.repeat(np.cumsum(new), size[by])  # of postings: which row they would be in
    upto = np.cumsum(held)
    begins = np.searchsorted(new, new)  # the first posting of that row
    new = np.stack((new, (upto - held - (upto - held)[begins]) // LONGEST))
    first = np.flatnonzero(np.concatenate(([True], (new[:, 1:] != new[:, :-1]).any(axis=0))))
    block = np.repeat(np.arange(len(by)), size[by])[first]
    end = np.append(first, len(doc))
    for a in range(0, len(first), 20_000):
        b = min(a + 20_000, len(first))
        lo, hi = end[a], end[b]
        counts = np.diff(end[a : b + 1])
        base = np.repeat((upto - held)[first[a:b]], counts)
        lists = pa.array(end[a : b + 1] - lo, pa.int32())
        rows = pa.array(doc[lo:hi])
        places = place[spans(token[lo:hi], held[lo:hi])].astype(np.int32)
        tokens = np.append((upto - held)[first[a:b]], upto[hi - 1])
        heads = pa.array(doc[first[a:b]])
        ids = {"doc_ids": docs["doc_id"].take(rows)} | ({"steps": pa.array(steps(numbers[doc[lo:hi]], counts).astype(np.int32))} if numbers is not None else {}) | {"ends": pa.array((upto[lo:hi] - base).astype(np.int32))}
        yield {"bucket": pa.array(np.full(b - a, bucket, np.int32)), "stream": pa.array(stream[block[a:b]].astype(np.int32)), "gram": gram.dictionary.take(pa.array(word[block[a:b]]))} | {c: docs[c].take(heads) for c in carried} | {
            "df": pa.array(counts.astype(np.int32))
        } | {k: pa.ListArray.from_arrays(lists, x) for k, x in ids.items()} | {"places": pa.ListArray.from_arrays(pa.array(tokens - tokens[0], pa.int32()), pa.array(places))}


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.documents = self.stored(spark, folder)
        settings = spark.read.parquet(f"{folder}/settings").first()
        self.buckets = int(settings.buckets)
        self.blocks = spark.read.schema(StructType.fromJson(json.loads(settings.postings))).parquet(f"{folder}/postings")
        self.frequencies = spark.read.parquet(f"{folder}/frequencies")

    @staticmethod
    def stored(spark: SparkSession, folder: str) -> DataFrame:
        """A folder's documents. The terms are found anew, not stored beside the tokens, unless they came with other columns."""
        docs = spark.read.parquet(f"{folder}/documents")
        return docs.withColumn("terms", F.array_distinct("toks")) if "toks" in docs.columns and "terms" not in docs.columns else docs

    @staticmethod
    def store(docs: DataFrame, folder: str) -> None:
        """Writes the documents, the first part of an index."""
        docs.write.options(**PACKED).parquet(f"{folder}/documents")
        if SLOT in docs.columns:
            before_slots(docs.sparkSession.read.schema(docs.schema).parquet(f"{folder}/documents")).write.parquet(f"{folder}/slots")

    @staticmethod
    def numbers(docs: DataFrame, folder: str) -> DataFrame:
        """The documents of a folder with doc_index, if they have slots (see ordering.in_slots)."""
        return index_of_slot(docs, docs.sparkSession.read.parquet(f"{folder}/slots"), "doc_index") if SLOT in docs.columns else docs

    @classmethod
    def build(cls, docs: DataFrame, folder: str, streams: Mapping[int, str] | None = None, carried: tuple[str, ...] = (), buckets: int = BUCKETS, spread: int = 4) -> Index:
        """docs: doc_id, a column of tokens for each stream, and what else is to be kept.

        carried: columns of documents that postings have too, of few values.
        """
        cls.store(docs, folder)
        return cls.post(docs.sparkSession, folder, streams, carried, buckets, spread)

    @classmethod
    def post(cls, spark: SparkSession, folder: str, streams: Mapping[int, str] | None = None, carried: tuple[str, ...] = (), buckets: int = BUCKETS, spread: int = 4) -> Index:
        """Postings and frequencies of stored documents.

        Tokens are grouped by gram where documents are read, so that a gram crosses the one shuffle once for
        some thousand documents, in compressed columns. A bucket is dealt to `spread` tasks and more with many
        documents, so that no task has all postings of a bucket.
        """
        streams = dict(streams or {0: "toks"})
        docs = cls.numbers(spark.read.parquet(f"{folder}/documents"), folder)
        n = docs.count()
        spread = max(spread, n // DEALT)
        names = ["doc_id", *carried, *(["doc_index"] if "doc_index" in docs.columns else [])]
        docs = docs.select(*names, *streams.values())
        kinds = {f.name: f.dataType for f in docs.schema.fields}

        def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            deal = TaskContext.get().partitionId()
            for k, t in enumerate(gathered(batches, list(streams.values()), GROUPED), deal):
                for bucket, data in _grouped(t, streams, carried, buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([k % spread], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "part", "data"])

        fields = [StructField("bucket", IntegerType()), StructField("stream", IntegerType()), StructField("gram", StringType()), *(StructField(c, kinds[c]) for c in carried), StructField("df", IntegerType()), StructField("doc_ids", ArrayType(kinds["doc_id"]))]
        fields += [StructField(c, ArrayType(IntegerType())) for c in ("steps", "ends", "places")[0 if "doc_index" in names else 1 :]]
        schema = StructType(fields)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []

            def out() -> Iterator[pa.RecordBatch]:
                for t in _merged(key[0], held, names, carried):
                    yield pa.RecordBatch.from_arrays(list(t.values()), names=list(t))

            for b in batches:
                for k, part, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "part", "data"))):
                    if (k, part) != key and held:
                        yield from out()
                        held = []
                    key = k, part
                    held.append(data)
            if held:
                yield from out()

        small_batches(spark)
        dealt = docs.mapInArrow(group, "bucket int, part int, data binary").repartition("bucket", "part").sortWithinPartitions("bucket", "part")
        rows = dealt.mapInArrow(merge, schema).sortWithinPartitions("bucket", "gram", "stream")
        rows.write.options(**PACKED).partitionBy("bucket").parquet(f"{folder}/postings")
        written = spark.read.schema(schema).parquet(f"{folder}/postings")
        counts = written.groupBy("stream", "gram").agg(F.sum("df").alias("df")).withColumn("n", F.lit(n).cast("long"))
        counts.withColumn("frequency", F.col("df") / F.col("n")).write.options(**PACKED).parquet(f"{folder}/frequencies")
        spark.createDataFrame([(buckets, schema.json())], "buckets int, postings string").coalesce(1).write.parquet(f"{folder}/settings")
        return cls(spark, folder)

    @property
    def numbered(self) -> DataFrame:
        """The documents, with doc_index if they have slots."""
        return self.numbers(self.documents, self.folder)

    @property
    def postings(self) -> DataFrame:
        """bucket, stream, gram, carried columns, doc_id and places: a row for each document of a gram."""
        return self._each(self.blocks)

    @staticmethod
    def _each(blocks: DataFrame) -> DataFrame:
        kept = [c for c in blocks.columns if c not in ("df", "doc_ids", "steps", "ends", "places")]
        rows = blocks.select(*kept, "ends", "places", F.posexplode("doc_ids").alias("_i", "doc_id"))
        begin = F.when(F.col("_i") > 0, F.get("ends", F.col("_i") - 1)).otherwise(0)
        return rows.select(*kept, "doc_id", F.slice("places", begin + 1, F.get("ends", F.col("_i")) - begin).alias("places"))

    def of(self, terms: Iterable[tuple[int | None, str]]) -> DataFrame:
        """The postings of (stream, gram); of any stream where that is None."""
        terms = sorted(set(terms), key=str)
        grams = sorted({g for _, g in terms})
        held = sorted(set(buckets_of(pa.array(grams, pa.string()), self.buckets).tolist()))
        got = self.blocks.where(F.col("bucket").isin(held) & F.col("gram").isin(grams))
        streams = {s for s, _ in terms}
        return self._each(got if None in streams else got.where(F.col("stream").isin(sorted(streams))))

    def add(self, docs: DataFrame, folder: str, **options) -> Index:
        """An index, in a new folder, of these and more documents with the same columns."""
        return Index.build(self.documents.unionByName(docs), folder, **options)


class IndexedEngine(Engine):
    """An Engine whose queries read the index. alias: streams that stand for another one's postings."""

    def __init__(self, index: Index, streams: Mapping[str, int] | None = None, alias: Mapping[int, int] | None = None, deleted: DataFrame | None = None, stream_scope: str = "enforce"):
        super().__init__(index.documents, streams, {0: ("terms", "toks")}, deleted, stream_scope)
        self.index, self.alias = index, dict(alias or {})

    def _stream(self, stream: int) -> int | None:
        return None if self.scope == "ignore" else self.alias.get(stream, stream)

    def query(self, query: str) -> DataFrame:
        return self.match(parse(query, self.streams))

    def match(self, tree: Node) -> DataFrame:
        """The ids of the documents that match a tree, which may have facts: Boolean columns of the documents."""
        wanted: dict[tuple[int | None, str], bool] = {}  # if the places are asked for
        facts = set()
        for x in literals(tree):
            if isinstance(x, Fact):
                facts.add(x.name)
            else:
                for g in x.grams if isinstance(x, Phrase) else (x.text,):
                    k = (self._stream(x.stream), g)
                    wanted[k] = wanted.get(k, False) or isinstance(x, Phrase)
        names = {k: f"_h{i}" for i, k in enumerate(sorted(wanted, key=str))}

        def met(k: tuple[int | None, str]) -> Column:
            stream, gram = k
            test = F.col("gram") == gram if stream is None else (F.col("stream") == stream) & (F.col("gram") == gram)
            if not wanted[k]:
                return F.max(F.when(test, True)).alias(names[k])
            if stream is not None:
                return F.max(F.when(test, F.col("places"))).alias(names[k])  # the only one
            return F.collect_list(F.when(test, F.transform("places", lambda p: F.struct(F.col("stream"), p.alias("p"))))).alias(names[k])

        def leaf(x: Node) -> Column:
            match x:
                case Fact(name):
                    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))
                case Phrase(grams, stream):
                    held = [F.col(names[self._stream(stream), g]) for g in grams]
                    if self._stream(stream) is None:
                        held = [F.flatten(h) for h in held]
                        step = lambda h: F.transform(h, lambda p: F.struct(p["stream"].alias("stream"), (p["p"] + 1).alias("p")))
                    else:
                        step = lambda h: F.transform(h, lambda p: p + 1)
                    at = held[0]
                    for h in held[1:]:
                        at = F.array_intersect(step(at), h)
                    return F.coalesce(F.size(at) > 0, F.lit(False))
            k = (self._stream(x.stream), x.text)
            c = F.col(names[k])
            return c.isNotNull() if self._stream(x.stream) is not None or not wanted[k] else F.coalesce(F.size(c) > 0, F.lit(False))

        condition = evaluate(tree, leaf)
        if not wanted:
            return self.docs.where(condition).select("doc_id")
        hits = self.index.of(wanted).groupBy("doc_id").agg(*map(met, names))
        if possible_without(tree):  # documents without any of the grams may match
            rows = self.docs.select("doc_id", *facts).join(hits, "doc_id", "left")
        elif facts:
            rows = self.docs.select("doc_id", *facts).join(hits, "doc_id")
        else:
            rows = hits if self.deleted is None else hits.join(self.deleted.select("doc_id"), "doc_id", "left_anti")
        return rows.where(condition).select("doc_id")

    def log(self, queries: Mapping[str, str]) -> DataFrame:
        rows, trees = batch.split_log(queries, self.streams)
        out = None
        if rows:
            hits = self.index.of((self._stream(s), g) for _, _, s, g, _, _ in rows)
            if self.deleted is not None:
                hits = hits.join(self.deleted.select("doc_id"), "doc_id", "left_anti")
            aliased = [(q, k, -1 if self._stream(s) is None else self._stream(s), g, w, n) for q, k, s, g, w, n in rows]
            hits = hits.select("doc_id", "gram", (F.lit(-1) if self.scope == "ignore" else F.col("stream")).alias("stream"))
            out = batch.met(hits.distinct() if self.scope == "ignore" else hits, aliased)
        for name, tree in trees.items():
            found = self.match(tree).select(F.lit(name).alias("query"), "doc_id")
            out = found if out is None else out.union(found)
        return out

    def contains(self, term: str) -> DataFrame:
        """Has each document the term?"""
        held = self.match(Term(term)).withColumn("_in", F.lit(True))
        return self.docs.select("doc_id").join(held, "doc_id", "left").select("doc_id", F.coalesce("_in", F.lit(False)).alias("contains"))

    def handle(self, ids: DataFrame) -> DataFrame:
        """The documents, with their doc_index if they are numbered, of ids that are held and not deleted."""
        docs = self.index.numbers(self.docs, self.index.folder)
        return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def explain(self, query: str) -> str:
        from termweave.plans.parser import format_tree

        found = self.query(query)
        plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return f"{format_tree(parse(query, self.streams))}\n\n{plan}"
