"""MinHash near-dedup: BagMinHash signatures, bands, and an exact check of the multiset overlap.

A document is the multiset of its windows of five words (lower-cased runs of letters and digits; shorter texts
are one window). Its signature has, for each component, the least point of Poisson processes that belong to the
windows: a window of weight w owns the levels (0, w], which are split into the blocks (0,1], (1,2], (2,4],
(4,8] and so on. Each block has one process over the whole block; a point lies at a level, and only points at
levels up to w count. So the work grows with log w, and two signatures agree in a component with the
probability of the weighted Jaccard similarity. Points come in ascending order, and a process ends when its next
point is above the document's largest component.

Texts that agree in a band share a bucket. First all pairs of small buckets, and the first text of each larger
one against its other texts, are checked on whole texts. What then remains is buckets whose texts are still in
several components. Their texts are compared by an exact prefix filter: each text's windows are put in order of
rarity among these texts, and two texts at the threshold share one among the first few of both, so early that
what follows still allows the overlap. A passage that many unlike texts share is late in that order and makes no
pair; of texts that are connected already none is compared again. With 30 bands of 5, a pair at similarity 0.8
shares a bucket with probability 1 - 7e-6; of those that do, none is lost.

Defined cases: null, empty and wordless texts are in no group (class_id is their own doc_id); exact copies are
one text from the start; repeated rows are copies; null doc_ids take part, and a group's class_id is its
smallest doc_id, null only if all are; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import Prefix, grams, mix, raw, slices, small_batches, stage, table, whole_row
from termweave.llm.components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
SMALL = 6
#: Bytes of text that a Python worker handles at once; its arrays take about 50 times as many.
_SLICE = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of the texts, and the text that each is of."""
    buf, off = raw(pc.utf8_lower(texts.fill_null("")))
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _LETTER[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, off)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(off) - 1), counts)
    words = Prefix(buf).spans(starts, ends)
    g = grams(words, size)
    whole = np.arange(len(g)) + size <= first[doc[: len(g)] + 1] if len(g) else np.zeros(0, bool)
    out, owner = g[whole], doc[: len(g)][whole]
    for k in range(1, size):  # texts of fewer words
        if len(at := np.flatnonzero(counts == k)):
            short = np.zeros(len(at), np.uint64)
            for j in range(k):
                short = short * np.uint64(0xD6E8FEB86659FD93) + words[first[at] + j]
            out, owner = np.concatenate([out, mix(short + np.uint64(k))]), np.concatenate([owner, at])
    return out, owner


def bag_minhash(keys: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Signatures (docs x size) of multisets given as different (doc, key) with whole weights of 1 or more."""
    least = np.full(docs * size, np.inf)
    # the blocks of levels that each element owns, the last one perhaps in part
    blocks = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    at = np.repeat(np.arange(len(keys)), blocks)
    b = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    below = np.where(b > 0, 1 << np.maximum(b - 1, 0), 0)
    rate = np.maximum(below, 1).astype(float)
    share = np.minimum(weight[at] - below, rate) / rate
    seed = mix(keys[at] + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    owner, time, k = doc[at], np.zeros(len(at)), np.zeros(len(at), np.uint64)
    while len(seed):
        # one point each, or more where few processes are left
        many = int(np.clip(200_000 // len(seed), 1, 64))
        r = mix(seed[:, None] + (k[:, None] + np.arange(1, many + 1, dtype=np.uint64)) * _STEP)
        gap = -np.log1p(-(r >> np.uint64(11)).astype(float) * 2.0**-53) / rate[:, None]
        gap[:, 0] += time
        t = np.cumsum(gap, axis=1)
        r = mix(r + np.uint64(1))
        counts = (r >> np.uint64(32)).astype(float) * 2.0**-32 < share[:, None]
        slot = owner[:, None] * size + ((r & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(least, slot[counts], t[counts])
        time, k = t[:, -1], k + np.uint64(many)
        live = time < least.reshape(docs, size).max(axis=1)[owner]
        seed, owner, time, k, rate, share = (x[live] for x in (seed, owner, time, k, rate, share))
    return least.reshape(docs, size)


def signatures(texts: pa.Array, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands, int64), and which texts have words."""
    g, owner = shingles(texts)
    key = mix(g ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    _, at, weight = np.unique(key, return_index=True, return_counts=True)
    sig = bag_minhash(g[at], owner[at], weight, len(texts), bands * rows)
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(texts), bands, rows)
    out = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(texts), 0)
    for j in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + bits[:, :, j])
    has = np.zeros(len(texts), bool)
    has[owner] = True
    return out.view(np.int64), has


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def banded(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, t (text_key) and bands (null for texts without words), a row each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_key().alias("t")).mapInArrow(lambda b: _signed(b, bands, rows), f"doc_id {kind}, t binary, bands array<long>")


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", _SLICE):
        keys, has = signatures(b.column("text"), bands, rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(b) + 1) * bands, bands), pa.int32()), pa.array(keys.reshape(-1)))
        lists = pc.if_else(pa.array(has), lists, pa.scalar(None, lists.type))
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "t": b.column("t"), "bands": lists})


def overlap(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts' window multisets."""
    x, y = (Counter(shingles(pa.array([t]))[0].tolist()) for t in (a, b))
    return _overlap(x, y)


def _overlap(x: Counter, y: Counter) -> float:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    both = sum(min(n, large[k]) for k, n in small.items() if k in large)
    total = x.total() + y.total() - both
    return both / total if total else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, Counter()
        for batch in slices(slices(batches, "x", _SLICE), "y", _SLICE):
            keep = []
            for key, x, y in zip(batch.column("a").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if key != last:
                    last, held = key, Counter(shingles(pa.array([x]))[0].tolist())
                keep.append(_overlap(held, Counter(shingles(pa.array([y]))[0].tolist())) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    got = pairs.join(texts.withColumnsRenamed({"t": "b", "text": "y"}), "b").join(texts.withColumnsRenamed({"t": "a", "text": "x"}), "a")
    return got.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, t, class_id, class_size and kept (one row of each class)."""
    small_batches(docs.sparkSession, 500)
    marked = stage(banded(docs, bands, rows), "bands")
    distinct = marked.where("bands IS NOT NULL").groupBy("t").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("id"))
    keys = distinct.select("t", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("t").alias("head")).where("n > 1")
    members = stage(keys.join(shared, "key").select("key", "t", "n", "head"), "buckets")
    comp = None
    if not members.isEmpty():
        wanted = marked.join(members.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.min("doc_id").alias("id"))
        # by doc_id and text: no key has many rows, even if a text has
        found = docs.select("doc_id", "text").withColumn("t", text_key()).withColumn("_k", F.xxhash64("doc_id", "t"))
        wanted = wanted.select(F.xxhash64("id", "t").alias("_k2"), F.col("t").alias("_t"))
        texts = found.join(wanted, (F.col("_k") == F.col("_k2")) & (F.col("t") == F.col("_t")), "left_semi")
        texts = stage(texts.dropDuplicates(["t"]).select("t", "text"), "texts")
        comp = _connect(members, texts, similarity)
    return _classes(marked, comp)


def _connect(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame | None:
    """Components (node, component) of the texts that share buckets and are similar."""
    small = members.where(F.col("n") <= SMALL).select("key", "t")
    pairs = small.alias("p").join(small.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.t") < F.col("q.t"))).select(F.col("p.t").alias("a"), F.col("q.t").alias("b"))
    pairs = pairs.union(members.where((F.col("n") > SMALL) & (F.col("t") != F.col("head"))).select(F.col("head").alias("a"), F.col("t").alias("b")))
    links = stage(_verified(pairs.distinct(), texts, similarity), "links")
    comp = None if links.isEmpty() else stage(components(links), "comp")

    # texts of larger buckets that lie in several components
    at = _placed(members.where(F.col("n") > SMALL).select("key", "t"), comp)
    split = at.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    rest = stage(at.join(split, "key", "left_semi").select("t").distinct(), "rest")
    if rest.isEmpty():
        return comp
    prefixes = stage(_prefixes(texts.join(rest, "t", "left_semi"), similarity), "prefixes")
    for whole in (False, True):  # first one text of each component for a window, then all
        pairs = stage(_prefix_pairs(_placed(prefixes, comp), similarity, whole), "pairs")
        more = stage(_verified(pairs, texts, similarity), "links")
        if not more.isEmpty():
            links = links.union(more)
            comp = stage(components(links), "comp")
    return comp


def _placed(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Rows of texts t with their component c."""
    if comp is None:
        return rows.withColumn("c", F.col("t"))
    return rows.join(comp.withColumnRenamed("node", "t"), "t", "left").withColumn("c", F.coalesce("component", "t")).drop("component")


def _prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """Of texts (t, text): their rarest windows e, each with its place in the order of rarity and the text's size.

    The k-th copy of a window is an element of its own, so that overlaps of sets are overlaps of multisets.
    Windows of one text alone come first and pair with nothing: only their number counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            g, owner = shingles(b.column("text"))
            order = np.lexsort((g, owner))
            g, owner = g[order], owner[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            copy = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
            e = np.where(copy > 0, mix(g ^ mix(copy.astype(np.uint64))), g)
            size = np.bincount(owner, minlength=len(b))
            cut = 200_000  # rows of a batch
            for i in range(0, len(e), cut):
                s = slice(i, i + cut)
                yield pa.RecordBatch.from_pydict({"t": b.column("t").take(pa.array(owner[s])), "e": e[s].view(np.int64), "size": pa.array(size[owner[s]], pa.int32())})

    each = stage(texts.select("t", "text").mapInArrow(run, "t binary, e long, size int"), "windows")
    often = each.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    held = each.join(often, "e").groupBy("t", "size").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))  # a text's own windows
    alone = F.col("size") - F.size("es")
    reach = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9).cast("int") + 1 - alone
    held = held.where(reach > 0).select("t", "size", alone.alias("alone"), F.posexplode(F.slice("es", 1, F.greatest(reach, F.lit(1)))).alias("k", "x"))
    return held.select("t", "size", F.col("x.e").alias("e"), (F.col("alone") + F.col("k") + 1).cast("int").alias("place"))


def _prefix_pairs(rows: DataFrame, similarity: float, whole: bool) -> DataFrame:
    """Pairs (a, b) of texts in different components that share a window early enough.

    rows: t, c, e, place, size. Each pair of components has one that isn't the window's most frequent one, so
    that only texts of those others look for partners. whole: all texts, else one of each component.
    """
    own = rows.groupBy("e", "c").agg(F.count("*").alias("n"), F.min(F.struct("place", "t", "size")).alias("one"))
    most = own.groupBy("e").agg(F.max(F.struct("n", "c")).alias("most"), F.count("*").alias("k")).where("k > 1").select("e", F.col("most.c").alias("most"))
    if not whole:
        rows = own.select("e", "c", "one.place", "one.t", "one.size")
    rows = rows.join(most, "e")
    x, y = rows.where("c <> most").alias("x"), rows.alias("y")
    if not whole:
        y = rows.where("c = most").alias("y")
    need = F.ceil(similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-9)
    fits = (F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-9) & (1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= need)
    pairs = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.c") != F.col("y.c")) & fits)
    return pairs.select(F.least("x.t", "y.t").alias("a"), F.greatest("x.t", "y.t").alias("b")).distinct()


def _classes(marked: DataFrame, comp: DataFrame | None) -> DataFrame:
    rows = marked.select("doc_id", "t", F.col("bands").isNotNull().alias("has"))
    if comp is not None:
        rows = rows.join(comp.withColumnRenamed("node", "t"), "t", "left").withColumn("c", F.coalesce("component", "t")).drop("component")
    else:
        rows = rows.withColumn("c", F.col("t"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("t"))).alias("head")
    heads = rows.where("has").groupBy(F.col("c").alias("k")).agg(head, F.count("*").alias("class_size"))
    got = rows.join(heads, F.col("has") & (F.col("c") == F.col("k")), "left")
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("t") == F.col("head.t"))
    return got.select(
        "doc_id", "t",
        F.when(F.col("has"), F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (~F.col("has") | first).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents with one row of each class, all columns kept."""
    found = stage(near_duplicates(docs, **options), "classes")
    kept = found.where("kept").select(F.col("doc_id").alias("id"), "t", "class_size").dropDuplicates(["id", "t"]).withColumn("k", F.xxhash64("id", "t"))
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("own"), text_key().alias("t2")).withColumn("k2", F.xxhash64("own", "t2"))
    on = (F.col("k") == F.col("k2")) & F.col("own").eqNullSafe(F.col("id")) & (F.col("t2") == F.col("t"))
    got = rows.join(kept, on).select("row", "k2", "t2", "class_size")
    if not found.where("kept AND class_size > 1").groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        # rows that are copies with the same doc_id: the least by content stays
        one = got.where("class_size > 1").groupBy("k2", "t2").agg(F.min("row").alias("row"))
        got = got.where("class_size = 1").select("row").union(one.select("row"))
    return got.select("row.*")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
