"""Chunk files: NUL-delimited documents of streams of terms.

file := document* NUL; document := 16 hex digits NUL, stream*, NUL; stream := 2 hex digits NUL, (term NUL)*, NUL.
Hex digits are lower-case. A file is read whole by one task; files are the unit of parallelism, and of a
bounded size where they are written here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.sources.workspace import small_batches

SCHEMA = "path string, doc_id long, source_bytes long, streams array<struct<stream_id:smallint,terms:array<string>>>"
#: Of a chunk that is written, and of documents that a worker parses at once.
CHUNK_BYTES, READ_BYTES = 8 << 20, 1 << 20
_ID, _STREAM = re.compile(rb"[0-9a-f]{16}"), re.compile(rb"[0-9a-f]{2}")


class ChunkError(ValueError):
    pass


def parse_chunk(data: bytes) -> Iterator[tuple[int, int, list[tuple[int, list[str]]]]]:
    """doc_id, bytes and streams of each document; fails on an empty or cut chunk.

    No word is empty, so a stream ends at the first two NULs in a row and is split as a whole.
    """
    at = 0
    if not data:
        raise ChunkError("an empty chunk")
    while True:
        start, end = at, data.find(b"\0", at)
        if end < 0:
            raise ChunkError(f"the chunk ends within a word at byte {at}")
        name, at = data[start:end], end + 1
        if not name:
            if at != len(data):
                raise ChunkError(f"bytes after the chunk's end at {at}")
            return
        if not _ID.fullmatch(name):
            raise ChunkError(f"expected 16 hex digits at byte {start}")
        streams = []
        while data[at : at + 1] != b"\0":
            end = data.find(b"\0\0", at)
            if end < 0:
                raise ChunkError(f"the chunk ends within a stream at byte {at}")
            if data[at + 2 : at + 3] != b"\0" or not _STREAM.fullmatch(data[at : at + 2]):
                raise ChunkError(f"expected 2 hex digits at byte {at}")
            streams.append((int(data[at : at + 2], 16), data[at + 3 : end].decode("utf-8").split("\0") if end > at + 2 else []))
            at = end + 2
        at += 1
        doc = int(name, 16)
        yield doc - (1 << 64) if doc >> 63 else doc, at - start, streams


def format_document(doc_id: int, streams: list[tuple[int, list[str]]]) -> bytes:
    out = [b"%016x\0" % (doc_id % (1 << 64))]
    for kind, terms in streams:
        out += [b"%02x\0" % kind, *(t.encode() + b"\0" for t in terms), b"\0"]
    return b"".join([*out, b"\0"])


def _parsed(files: DataFrame, tail: bytes = b"") -> DataFrame:
    """The documents of files (path, content), whose contents may end with a tail; empty ones have none if there is one."""
    kinds = pa.schema([("path", pa.string()), ("doc_id", pa.int64()), ("source_bytes", pa.int64()), ("streams", pa.list_(pa.struct([("stream_id", pa.int16()), ("terms", pa.list_(pa.string()))])))])

    def rows(path: str, docs: list[tuple[int, int, list]]) -> pa.RecordBatch:
        ids, sizes, streams = zip(*docs)
        flat = [s for ss in streams for s in ss]
        terms = pa.ListArray.from_arrays(pa.array([0, *accumulate(len(t) for _, t in flat)], pa.int32()), pa.array([x for _, t in flat for x in t], pa.string()))
        each = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.int16()), terms], fields=list(kinds.field("streams").type.value_type))
        held = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, streams))], pa.int32()), each)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), held.cast(kinds.field("streams").type)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content")):
                data = content.as_py().removesuffix(tail)
                held, size = [], 0
                for d in parse_chunk(data) if data or not tail else ():
                    held.append(d)
                    size += d[1]
                    if size > READ_BYTES:
                        yield rows(path.as_py(), held)
                        held, size = [], 0
                if held:
                    yield rows(path.as_py(), held)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row a document: path, doc_id, source_bytes, streams."""
    return _parsed(spark.read.format("binaryFile").load(paths))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All chunks that a text file names, one a line; the list of names is short against the chunks."""
    names = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''")
    return read_chunks(spark, [r.v for r in names.collect()])


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """doc_id, stream_id, pos, term."""
    s = chunks.select("doc_id", F.explode("streams").alias("s"))
    return s.select("doc_id", "s.stream_id", F.posexplode("s.terms").alias("pos", "term"))


def write_chunks(docs: DataFrame, folder: str) -> None:
    """docs (doc_id, streams): a file for each chunk of about CHUNK_BYTES, or of one longer document, through Spark's text writer.

    A chunk is a single line, though a term may hold line feeds; the final line feed is cut by `read_chunk_folder`.
    """
    nul = F.lit("\0")

    def hexed(x: Column, digits: int) -> Column:
        return F.lpad(F.lower(F.hex(x)), digits, "0")

    stream = lambda s: F.concat(hexed(s["stream_id"].cast("long"), 2), nul, F.array_join(s["terms"], "\0"), F.when(F.size(s["terms"]) > 0, nul).otherwise(""), nul)
    value = F.concat(hexed(F.col("doc_id"), 16), nul, F.array_join(F.transform("streams", stream), ""), nul)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for x in b.column(0):
                held.append(x.as_py())
                size += len(held[-1])
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pydict({"value": ["".join([*held, "\0"])]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": ["".join([*held, "\0"])]})

    small_batches(docs.sparkSession)
    docs.select(value.alias("value")).mapInArrow(run, "value string").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(folder)


def read_chunk_folder(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark.read.format("binaryFile").load(f"{folder}/part-*"), b"\n")


def token_counts(chunks: DataFrame) -> DataFrame:
    """doc_id, tokens and different terms of each row that has tokens, over its streams."""
    each = chunks.select("doc_id", F.flatten(F.col("streams.terms")).alias("t"))
    return each.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("terms")).where("tokens > 0")
