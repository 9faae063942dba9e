"""Suffix-array dedup: removes what repeated byte strings of a given length cover.

The difference-cover scheme sorts a sample of suffixes by names of their beginnings and gets all others from
the next sampled one. Here the sample is chosen by content instead of by position modulo 3: a position is
sampled if the `gram` bytes from it have the least fingerprint in a window of `length` bytes (a string
synchronising set), so equal strings of `length` bytes hold the same sampled positions. Only equality of
prefixes of `length` bytes is asked for, so that names are fingerprints and need no recursion, and equal
prefixes are grouped instead of sorted side by side:

1. sample: each text's sampled positions; those whose name occurs once in the corpus end here;
2. name: the suffixes between two sampled positions share a segment, named by all bytes their prefixes reach;
   a name that occurs twice has only repeated prefixes;
3. merge: where a sampled name has several segments, one of each is cut into runs of suffixes, by place from the
   sampled position. Runs whose common bytes no other has are unlike; runs that are equal are repeats;
4. compare: of the other runs, every prefix is compared. What repeated prefixes cover is removed.

Identical texts are one text from the start. Why the plain scheme isn't used is in the README, with figures.

Units are bytes (LENGTH of them) or words (PASSAGE of them: from a word's first byte to a word's last one); both
are found in one pass over the texts as they come, so that neither hides the other's.

Defined cases: null and empty texts have 0 bytes and nothing removed; repeated rows are copies, and all bytes of
copies of `length` bytes or more are removed; null doc_ids pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import Prefix, mix, raw, sieve, slices, small_batches, stage, table, whole_row, word_spans

LENGTH = 400
#: Words of a passage: over 50.
PASSAGE = 51
_SLICE = 1 << 20


@dataclass(frozen=True)
class Unit:
    """What is compared: strings of so many bytes or words, by the first grams of sampled suffixes."""

    length: int
    words: bool = False
    gram: int = 0

    def __post_init__(self):
        object.__setattr__(self, "gram", self.gram or max(1, self.length // (3 if self.words else 2)))

    @property
    def step(self) -> int:
        """Suffixes of a run."""
        return max(1, self.length // 12)

    @property
    def tag(self) -> np.uint64:
        return np.uint64(0x9E3779B97F4A7C15 * (1 + self.words) & (2**64 - 1))


class Units:
    """A buffer's bytes, or its words with what lies between them: borders of documents, fingerprints of spans."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, words: bool):
        self.words, self._prefix, self.off = words, Prefix(buf), off
        if words:
            self._start, self._end, self.off = word_spans(buf, off)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._prefix.spans(self._start[start], self._end[end - 1]) if self.words else self._prefix.spans(start, end)

    def windows(self, size: int) -> np.ndarray:
        if not self.words:
            return self._prefix.windows(size)
        n = max(0, len(self._start) - size + 1)
        return self._prefix.spans(self._start[:n], self._end[size - 1 : size - 1 + n])


def sampled(units: Units, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of whole prefixes, the first sampled position at or after each, and all grams' fingerprints."""
    off, value = units.off, units.windows(gram)
    spare = length - gram + 1
    if off[-1] < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), value
    least, where, span = value, np.arange(len(value), dtype=np.int32), 1
    while span < spare:  # the least of `span` grams, the leftmost of equals
        step = min(span, spare - span)
        n = len(least) - step
        right = least[step:] < least[:n]
        where = np.where(right, where[step:], where[:n])
        least = np.where(right, least[step:], least[:n])
        span += step
    doc_end = np.repeat(off[1:], np.diff(off))
    starts = np.flatnonzero(np.arange(len(least)) + length <= doc_end[: len(least)])
    return starts, where[starts].astype(np.int64), value


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.ListArray:
    """Values of rows, ordered by row, as a list column."""
    off = np.searchsorted(owner, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64)))


def sample_texts(docs: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """doc_id, t (SHA-256), n_bytes, n_words and the names at the text's sampled positions: all, and those met twice."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            buf, off = raw(b.column("text"))
            n_words, docs_, names = np.zeros(len(b), np.int64), [], []
            for u in units:
                held = Units(buf, off, u.words)
                if u.words:
                    n_words = np.diff(held.off)
                _, at, value = sampled(held, u.length, u.gram)
                at = np.unique(at)
                docs_.append(np.searchsorted(held.off, at, "right") - 1)
                names.append(mix(value[at] ^ u.tag))
            doc, name = np.concatenate(docs_), np.concatenate(names)
            order = np.lexsort((name, doc))
            doc, name = doc[order], name[order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            twice = np.diff(np.append(first, len(name))) > 1
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column("doc_id"), "t": b.column("t"), "n_bytes": np.diff(off), "n_words": n_words, "names": _lists(name[first], doc[first], len(b)), "twice": _lists(name[first][twice], doc[first][twice], len(b))}
            )

    rows = docs.select("doc_id", "text", text_hash().alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, t binary, n_bytes long, n_words long, names array<long>, twice array<long>")


def text_hash(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _segments(texts: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Of texts (t, text, names): name, segment, t, starts, size, lead (from the start to the sampled position) and unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            buf, edges = raw(b.column("text"))
            wanted, owner = b.column("names").flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(b)), np.diff(b.column("names").offsets.to_numpy()))
            pairs = mix(wanted.view(np.uint64) ^ mix(owner.astype(np.uint64) + np.uint64(1)))
            for k, u in enumerate(units):
                held = Units(buf, edges, u.words)
                off = held.off
                starts, at, value = sampled(held, u.length, u.gram)
                doc = np.searchsorted(off, starts, "right") - 1
                new = np.ones(len(starts), bool)
                new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(starts)))
                name = mix(value[at[first]] ^ u.tag)
                keep = np.isin(mix(name ^ mix(doc[first].astype(np.uint64) + np.uint64(1))), pairs)
                first, size, name = first[keep], size[keep], name[keep]
                begin, doc, lead = starts[first], doc[first], (at - starts)[first]
                segment = mix(held.spans(begin, begin + size - 1 + u.length) ^ mix(lead.astype(np.uint64)))
                order = np.lexsort((begin, segment, name, doc))
                begin, size, name, segment, doc, lead = (x[order] for x in (begin, size, name, segment, doc, lead))
                new = np.ones(len(begin), bool)
                new[1:] = (name[1:] != name[:-1]) | (segment[1:] != segment[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(begin)), pa.int32()), pa.array((begin - off[doc]).astype(np.int32)))
                yield pa.RecordBatch.from_pydict(
                    {"name": name[first].view(np.int64), "segment": segment[first].view(np.int64), "t": b.column("t").take(pa.array(doc[first])), "starts": lists}
                    | {n: pa.array(x, pa.int32()) for n, x in (("size", size[first]), ("lead", lead[first]), ("unit", np.full(len(first), k)))}
                )

    return texts.select("t", "text", "names").mapInArrow(run, "name long, segment long, t binary, starts array<int>, size int, lead int, unit int")


def _parts(b: pa.RecordBatch, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A list column of structs: each struct's row, and its fields."""
    rows = b.column("parts")
    p = rows.flatten()
    return np.repeat(np.arange(len(b)), np.diff(rows.offsets.to_numpy())), [p.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(fields)]


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many rows: each row's group and its place there."""
    group = np.repeat(np.arange(len(size)), size)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)


_CUT = 300_000  # rows of a batch


def _runs(texts: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Of texts (t, text, parts): runs of suffixes, each with its common bytes (core) and all its bytes (full)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            buf, edges = raw(b.column("text"))
            owner, (begin, size, lead, name, many, unit) = _parts(b, 6)
            for k, u in enumerate(units):
                if not len(mine := np.flatnonzero(unit == k)):
                    continue
                held = Units(buf, edges, u.words)
                low, high = -lead[mine] // u.step, (size[mine] - 1 - lead[mine]) // u.step
                part, r = _spread(high - low + 1)
                part, r = mine[part], r + low[part]
                base = held.off[owner[part]] + begin[part]  # the segment's first suffix; the sampled position is `lead` later
                anchor = base + lead[part]
                first = np.maximum(anchor + r * u.step, base)
                end = np.minimum(anchor + r * u.step + u.step, base + size[part])
                core = held.spans(anchor + r * u.step + u.step - 1, anchor + r * u.step + u.length)
                full = mix(held.spans(first, end - 1 + u.length) ^ mix(((first - anchor) * 4096 + (end - first)).astype(np.uint64)))
                key = mix(name[part].view(np.uint64) ^ mix(r.astype(np.uint64)))
                for i in range(0, len(part), _CUT):
                    s = slice(i, i + _CUT)
                    yield pa.RecordBatch.from_pydict(
                        {"run": mix(key[s] ^ core[s]).view(np.int64), "full": full[s].view(np.int64), "many": pa.array(np.minimum(many[part[s]], 2), pa.int32()), "t": b.column("t").take(pa.array(owner[part[s]]))}
                        | {n: pa.array(x[s], pa.int32()) for n, x in (("start", first - held.off[owner[part]]), ("size", end - first), ("unit", unit[part]))}
                    )

    return texts.select("t", "text", "parts").mapInArrow(run, "run long, full long, many int, t binary, start int, size int, unit int")


def _prefixes(texts: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Of texts (t, text, parts): the fingerprint of each prefix that starts in a part, with its run and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            buf, edges = raw(b.column("text"))
            owner, (begin, size, key, many, unit) = _parts(b, 5)
            for k, u in enumerate(units):
                if not len(mine := np.flatnonzero(unit == k)):
                    continue
                held = Units(buf, edges, u.words)
                part, place = _spread(size[mine])
                part = mine[part]
                start = begin[part] + place
                at = start + held.off[owner[part]]
                out = held.spans(at, at + u.length)
                for i in range(0, len(part), _CUT):
                    s = slice(i, i + _CUT)
                    single = many[part[s]] == 1
                    t = b.column("t").take(pa.array(np.where(single, owner[part[s]], 0)))
                    yield pa.RecordBatch.from_pydict(
                        {"prefix": mix(out[s] ^ mix(key[part[s]].view(np.uint64))).view(np.int64), "many": pa.array(many[part[s]], pa.int32()), "t": _null_where(t, ~single), "start": pa.array(start[s], pa.int32()), "unit": pa.array(unit[part[s]], pa.int32())}
                    )

    return texts.select("t", "text", "parts").mapInArrow(run, "prefix long, many int, t binary, start int, unit int")


def _null_where(values: pa.Array, nulls: np.ndarray) -> pa.Array:
    import pyarrow.compute as pc

    return pc.if_else(pa.array(~nulls), values, pa.scalar(None, values.type))


def covered_runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (begin, end) of bytes that spans cover."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return begin[first], reach[np.append(first[1:], len(begin)) - 1]


def repeats(docs: DataFrame, units: tuple[Unit, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, n_bytes, n_words, copies) and, of texts with repeats, (t, text, ranges_0 and on: repeated starts by unit)."""
    small_batches(docs.sparkSession, 1000)
    rows = stage(sample_texts(docs, units), "sample")
    short = F.substring("t", 1, 16).alias("t")
    texts = rows.groupBy("t").agg(F.first("names").alias("names"), F.first("twice").alias("twice"), F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    texts = stage(texts, "distinct")
    named = texts.select(F.col("t").alias("full"), F.explode("names").alias("name"), "twice").select(F.substring("full", 1, 16).alias("t"), "name", F.array_contains("twice", F.col("name")).cast("int").alias("more"))
    known = named.groupBy("name").agg(F.sum(F.col("more") + 1).alias("n")).where("n > 1").select("name")
    wanted = named.select("t", "name").join(known, "name").groupBy("t").agg(F.collect_list("name").alias("names"))
    wanted = wanted.join(texts.select(short, F.col("id"), F.col("t").alias("full")), "t").select("t", "names", F.xxhash64("id", "full").alias("_k"))
    wanted = stage(wanted, "wanted")
    found = docs.select("doc_id", "text").withColumn("_h", text_hash())
    found = found.select("text", F.substring("_h", 1, 16).alias("_t"), F.xxhash64("doc_id", "_h").alias("_k2"))
    held = sieve(found, "_k2", wanted, "_k").join(wanted, (F.col("_k") == F.col("_k2")) & (F.col("t") == F.col("_t"))).dropDuplicates(["_k", "t"]).select("t", "text", "names")
    held = stage(held, "held")

    segments = stage(_segments(held, units), "segments")
    kinds = segments.groupBy("name", "segment").agg(F.sum(F.size("starts")).alias("many"), F.min(F.struct("t", F.col("starts")[0].alias("start"), "size", "lead", "unit")).alias("of"))
    kinds = stage(kinds, "kinds")
    several = kinds.groupBy("name").agg(F.count("*").alias("k"), F.min("many").alias("fewest")).where("k > 1 AND fewest = 1").select("name")
    parts = kinds.join(several, "name").groupBy("of.t").agg(F.collect_list(F.struct("of.start", "of.size", "of.lead", "name", "many", "of.unit")).alias("parts"))
    runs = stage(_runs(held.join(parts, "t"), units), "runs")
    same = runs.groupBy("run", "full").agg(F.sum("many").alias("many"), F.min(F.struct("t", "start", "size", "unit")).alias("of"))
    same = stage(same, "same")
    unlike = same.groupBy("run").agg(F.count("*").alias("k")).where("k > 1").select("run")
    parts = same.join(unlike, "run").groupBy("of.t").agg(F.collect_list(F.struct("of.start", "of.size", "run", F.least("many", F.lit(2)).alias("many"), "of.unit")).alias("parts"))
    prefixes = stage(_prefixes(held.join(parts, "t"), units), "prefixes")
    twice = prefixes.groupBy("prefix").agg(F.sum("many").alias("n")).where("n > 1").select("prefix")
    single = prefixes.where("many = 1").join(twice, "prefix", "left_semi").select("t", "unit", F.struct("start", F.lit(1).alias("size")).alias("r"))
    equal = runs.where("many = 1").join(same.where("many > 1").select("run", "full"), ["run", "full"], "left_semi").select("t", "unit", F.struct("start", "size").alias("r"))
    whole = segments.join(kinds.where("many > 1").select("name", "segment"), ["name", "segment"], "left_semi")
    whole = whole.select("t", "unit", F.explode("starts").alias("start"), "size").select("t", "unit", F.struct("start", "size").alias("r"))
    ranges = whole.union(equal).union(single).groupBy("t").agg(*(F.collect_list(F.when(F.col("unit") == k, F.col("r"))).alias(f"ranges_{k}") for k in range(len(units))))
    return rows.join(texts.select("t", "copies"), "t").select("doc_id", "t", "n_bytes", "n_words", "copies"), held.select("t", "text").join(ranges, "t")


def _cut(texts: DataFrame, units: tuple[Unit, ...], removed: tuple[Unit, ...], with_text: bool) -> DataFrame:
    """Of texts with ranges by unit: t, n_removed, n_spans, kept_sha256, what is left, and words in repeated runs of words.

    removed: the units whose runs go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, *ranges in zip(b.column("text"), *(b.column(f"ranges_{k}") for k in range(len(units))), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                spans, words = [], 0
                for u, r in zip(units, ranges, strict=True):
                    first, size = (r.values.field(k).to_numpy().astype(np.int64) for k in range(2))
                    first, last = covered_runs(first, first + size - 1 + u.length)
                    if u.words:
                        words = int((last - first).sum())
                        start, end, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                        first, last = start[first], end[last - 1]
                    if u in removed:
                        spans.append((first, last))
                begin, end = covered_runs(*(np.concatenate(x) for x in zip(*spans, strict=True)))
                kept = b"".join(data[a:z] for a, z in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True))
                out.append((int((end - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None, words))
            n, spans, sha, kept, words = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_pydict({"t": b.column("t"), "n_removed": pa.array(n, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string()), "n_repeat_words": pa.array(words, pa.int64())})

    return texts.mapInArrow(run, "t binary, n_removed long, n_spans long, kept_sha256 string, kept string, n_repeat_words long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_repeat_words of every document.

    Only strings of `length` bytes are removed. n_repeat_words counts the words in runs of `words` words that
    also start anywhere else, which may be shorter than `length` bytes.
    """
    units = (Unit(length), Unit(words, True))
    rows, texts = repeats(docs, units)
    cut = _cut(texts, units, units[:1], False).drop("kept").withColumnRenamed("t", "_t")
    got = rows.join(cut, F.substring("t", 1, 16) == F.col("_t"), "left")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return got.select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("t")))).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & (F.col("n_words") >= words), F.col("n_words")).otherwise(F.coalesce("n_repeat_words", F.lit(0))).cast("long").alias("n_repeat_words"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = PASSAGE) -> DataFrame:
    """The documents, with all columns, without the bytes that repeated strings cover; n_chars follows the text.

    Beside strings of `length` bytes, those of `words` words go, however short they are. Both are found in the
    texts as they come, so that neither hides the other's. A character of which only some bytes go is dropped
    whole.
    """
    units = (Unit(length), Unit(words, True))
    rows, texts = repeats(docs, units)
    copied = rows.where((F.col("copies") > 1) & ((F.col("n_bytes") >= length) | (F.col("n_words") >= words))).select("t")
    cut = _cut(texts, units, units, True).select(F.col("t").alias("_t"), "kept")
    copied = copied.select(F.substring("t", 1, 16).alias("_t"), F.lit("").alias("kept")).distinct()
    new = stage(cut.join(copied, "_t", "left_anti").union(copied), "changed")
    got = docs.select(whole_row(docs), F.substring(text_hash(), 1, 16).alias("_h")).join(new, F.col("_h") == F.col("_t"), "left")
    changed = F.col("_t").isNotNull()
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns}
    cols["text"] = F.when(changed, F.col("kept")).otherwise(cols["text"])
    if "n_chars" in cols:
        cols["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return got.select(*[x.alias(c) for c, x in cols.items()])


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
