"""Best-fit packing planned on the histogram of lengths.

Documents are tokenized once and cut into pieces of at most `capacity` ids; the piece table (numbers only) is
written to the shared folder. Best-fit decreasing then runs over the histogram, at most `capacity` lengths and
their counts, moving whole groups of equal sequences: its plan has ranges of ranks within a length. A piece
finds its slot by its rank within its length; ranks come from two prefix sums over cells of a length, so that
a length that a third of all pieces have is no single task.

Tokenizing: runs of white space separate the vocabulary's pre-tokens, so a text of words between single white
spaces is the concatenation of its words' ids. Each worker keeps words it has met, in bounded number; new words
of a slice are encoded together, one a line. Texts with other white space are encoded whole.

Defined cases: null and empty texts are the end id alone, one piece; repeated rows are packed each; null
doc_ids are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm.common import raw, slices, small_batches, stage, table

CAPACITY = 2048
END = 0
#: Words that a worker keeps: some 270 bytes each, also while later stages run.
KEPT_WORDS = 200_000
TOKENIZE_BYTES = 12 << 20


class WordCache:
    """Ids of texts, word by word. Equals the vocabulary's tokenizer on every text (see the tests)."""

    def __init__(self, ranks_file: str, json_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
        self.bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_file)
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.line = ranks[b"\n"]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Words begin with a space, a line feed or neither and have no other white space."""
        got = self.bpe.encode_to_numpy("\n".join(w[1:] if w[:1] == "\n" else w for w in words) + "\n", disallowed_special=()).astype(np.uint32)
        # each word's ids end with the line feed's; a word that begins with one gets it from the word before
        ends = np.flatnonzero(got == self.line)
        if len(ends) != len(words):  # some line feed went into another token: word by word
            each = [self.bpe.encode_to_numpy(w[1:] if w[:1] == "\n" else w, disallowed_special=()).astype(np.uint32) for w in words]
            got = np.concatenate([np.append(x, np.uint32(self.line)) for x in each])
            ends = np.cumsum([len(x) + 1 for x in each]) - 1
        begin = np.concatenate([[0], ends[:-1] + 1])
        begin -= np.fromiter((w[:1] == "\n" for w in words), bool, len(words))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.start = np.concatenate([self.start, (begin + len(self.ids) + 1).astype(np.int64)])
        self.size = np.concatenate([self.size, (ends - begin).astype(np.int32)])
        self.ids = np.concatenate([self.ids, np.array([self.line], np.uint32), got])

    def encode_slow(self, text: str) -> np.ndarray:
        if any(t in text for t in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and each text's end; no end ids."""
        texts = texts.fill_null("")
        # single spaces and line feeds between words: anything else is encoded whole
        odd = pc.match_substring_regex(texts, r"[\n ]{2}|[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[\n ]\z|\A[\n ]")
        for t in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd = odd.to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() == 0)
        plain = texts.filter(pa.array(~odd))
        # "a b\nc" becomes "a", " b", "\nc": each word begins with the white space before it
        marked = pc.replace_substring(pc.replace_substring(plain, " ", "\x00 "), "\n", "\x00\n")
        words = pc.split_pattern(marked, "\x00")
        code = words.flatten().dictionary_encode() if len(words) else pa.array([], pa.string()).dictionary_encode()
        vocab = code.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) > KEPT_WORDS:
            self.clear()
        at = [self.known.get(w) for w in vocab]
        if new := [w for w, k in zip(vocab, at, strict=True) if k is None]:
            n = len(self.known)
            self._learn(new)
            at = np.array([-1 if k is None else k for k in at], np.int64)
            at[at < 0] = np.arange(n, n + len(new))
        at = np.asarray(at, np.int64)
        use = code.indices.to_numpy(zero_copy_only=False)
        size, start = self.size[at][use], self.start[at][use]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        out = self.ids[np.repeat(start - (ends - size), size) + np.arange(total)]
        per = np.zeros(len(texts), np.int64)
        counts = np.diff(raw_offsets(words)) if len(words) else np.zeros(0, np.int64)
        cum = np.concatenate([[0], ends])
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        per[~odd] = cum[first[1:]] - cum[first[:-1]]
        if odd.any():
            slow = {int(i): self.encode_slow(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
            for i, ids in slow.items():
                per[i] = len(ids)
            end = np.cumsum(per)
            full = np.empty(int(end[-1]), np.uint32)
            owner = np.repeat(~odd, per)
            full[owner] = out
            for i, ids in slow.items():
                full[end[i] - len(ids) : end[i]] = ids
            out = full
        return out, np.cumsum(per)


def raw_offsets(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)


_cache: WordCache | None = None


def _encoder(files: tuple[str, str, str]) -> WordCache:
    global _cache
    if _cache is None:
        _cache = WordCache(*files)
    return _cache


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """Ranks, JSON file and pattern of a public byte-level vocabulary."""
    import public_tokenizers as p

    return p.path(f"{name}.tiktoken"), p.path(f"{name}.json"), p.PATTERN


def pieces_of(docs: DataFrame, files: tuple[str, str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32; a longer document's first piece is the short one."""
    small_batches(docs.sparkSession, 4000)
    kind = docs.schema["doc_id"].dataType.simpleString()
    files = files or tokenizer_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(files)
        for b in slices(batches, "text", TOKENIZE_BYTES):
            ids, ends = enc.encode(b.column("text"))
            out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc")}
            begin = 0
            for row, end in enumerate(ends.tolist()):
                doc = np.append(ids[begin:end], np.uint32(END)).astype("<u4")
                begin, n = end, end - begin + 1
                short = n % capacity or min(n, capacity)
                cuts = [0, *range(short, n + 1, capacity)]
                for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for key, value in zip(out, (row, k, a, z - a, zlib.crc32(doc[a:z].tobytes())), strict=True):
                        out[key].append(value)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column("doc_id").take(pa.array(out["row"], pa.int64())), "piece": pa.array(out["piece"], pa.int32())}
                | {n: pa.array(out[k], pa.int64()) for n, k in (("start", "start"), ("length", "length"), ("ids_crc32", "crc"))}
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, items, first sequence, items a sequence, offset).

    Rank r of a length, counted from a row's first rank, goes to the row's sequence r // items a sequence, at
    offset + length * (r % items a sequence). Groups of sequences with the same room are kept together.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, how many)
    out, sequences = [], 0
    filled = np.zeros(capacity + 2, bool)  # rooms that have sequences
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            open_ = np.flatnonzero(filled[length : capacity + 1])
            if len(open_):
                room = length + int(open_[0])
                first, many = rooms[room].pop()
                filled[room] = bool(rooms[room])
            else:
                room, first = capacity, sequences
                many = -(-left // (capacity // length))
                sequences += many
            each = min(room // length, left)
            if many * each > left:  # only some of the group are needed, the rest keep their room
                used = max(1, left // each)
                if used < many:
                    if room < capacity or first + many < sequences:
                        rooms[room].append((first + used, many - used))
                        filled[room] = True
                    elif first + many == sequences:  # new ones: only as many as are filled
                        sequences -= many - used
                many = used
            out.append((length, rank, many * each, first, each, capacity - room))
            rank, left = rank + many * each, left - many * each
            if rest := room - each * length:
                rooms[rest].append((first, many))
                filled[rest] = True
    return out


def pack(docs: DataFrame, files: tuple[str, str, str] | None = None, capacity: int = CAPACITY, cell: int = 20_000) -> DataFrame:
    """pieces_of() with sequence_id and offset."""
    spark = docs.sparkSession
    found = stage(pieces_of(docs, files, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    steps = plan(histogram, capacity)
    lot = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    cells = spark.createDataFrame([(k, max(1, -(-n // cell))) for k, n in sorted(histogram.items())], "length long, cells long")
    placed = found.withColumn("lot", lot).join(F.broadcast(cells), "length").withColumn("cell", F.pmod("lot", "cells")).drop("cells")
    inside = Window.partitionBy("length", "cell").orderBy("lot", "doc_id", "piece")
    placed = placed.withColumn("rank", F.row_number().over(inside) - 1)
    sizes = placed.groupBy("length", "cell").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "cell", (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    placed = placed.join(sizes, ["length", "cell"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the plan's ranges as arrays by length: bounded by the capacity, not by the documents
    by: dict[int, list[tuple[int, ...]]] = {}
    for length, *row in steps:
        by.setdefault(length, []).append(tuple(row))
    bins = {k: np.array(v, np.int64) for k, v in by.items()}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for k in np.unique(length):
                at, t = np.flatnonzero(length == k), bins[int(k)]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                r = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + r // row[:, 3], row[:, 4] + k * (r % row[:, 3])
            cols = {n: b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": sequence, "offset": offset})

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
