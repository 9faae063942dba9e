"""Embedding near-dedup: an epsilon grid order join on leading principal dimensions.

Unit vectors are at most eps apart when their cosine is at least the threshold. They are sorted by label and by
the cells, eps wide, of their leading principal projections; a projection never makes vectors more distant. The
sorted sequence is cut into intervals of at most `block` vectors, whose bounding boxes tell which pairs of
intervals can hold links: boxes of neighbouring intervals form a tree, and pairs are refined from its top down
to intervals and, within these, halves, skipping whatever is provably distant.
The principal axes come from a bounded sample; they decide how much is skipped, never what is found.

Equal vectors are one with a weight, and a joined pair of intervals gives link counts and a spanning forest, so
the output grows with the vectors and not with the links.

Defined cases: null labels, null, empty or zero vectors and those with null or non-finite components link with
nothing (n_links 0, their own component); so do null vec_ids (component null). Rows that share a vec_id are one
vector to the components. Vectors of different lengths don't link. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import small_batches, stage, table
from termweave.llm.components import components
from termweave.operators.ordering import numbered

COSINE, AXES, BLOCK, LEAF = 0.93, 6, 1024, 128


def principal_axes(vectors: DataFrame, axes: int, sample: int = 20_000) -> np.ndarray | None:
    """axes x dimension, from at most `sample` vectors (those with the lowest hashes)."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    if not len(rows):
        return None
    kinds, counts = np.unique(pc.list_value_length(rows).to_numpy(), return_counts=True)
    d = int(kinds[np.lexsort((kinds, counts))[-1]])
    x = _units(rows.filter(pc.equal(pc.list_value_length(rows), d)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x -= x.mean(0)
    _, _, v = np.linalg.svd(x.T @ x)
    return v[: min(axes, d)]


def _units(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return x


def ego_join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, cosine: float, eps: float, same: bool, at: int = 0, bt: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in a and b (i < j if they are the same) whose cosine reaches the threshold."""
    if not len(a) or not len(b):
        return
    if ((pa_.min(0) - eps > pb.max(0)) | (pb.min(0) - eps > pa_.max(0))).any():
        return
    if len(a) <= LEAF and len(b) <= LEAF:
        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        i, j = np.nonzero((a @ b.T) / norm >= cosine)
        if same and at == bt:
            i, j = i[i < j], j[i < j]
        yield i + at, j + bt
        return
    m, n = -(-len(a) // 2), -(-len(b) // 2)
    for k, (s, t) in enumerate(((slice(0, m), 0), (slice(m, None), m))):
        for l, (u, w) in enumerate(((slice(0, n), 0), (slice(n, None), n))):
            if same and at == bt and k > l:
                continue
            yield from ego_join(a[s], b[u], pa_[s], pb[u], cosine, eps, same, at + t, bt + w)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect, at most n - 1."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        u, v = find(x), find(y)
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def _intervals(vectors: DataFrame, axes: np.ndarray | None, eps: float, block: int) -> DataFrame:
    """The sorted sequence in intervals: label, block, low and high projections, ids, weights, vectors."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("embedding")
            sizes = np.diff(e.offsets.to_numpy())
            p = np.zeros((len(b), AXES))
            if axes is not None and len(at := np.flatnonzero(sizes == axes.shape[1])):
                x = _units(e.take(pa.array(at)))
                p[at, : len(axes)] = (x / np.sqrt((x * x).sum(1))[:, None]) @ axes.T
            cells = np.floor(p / eps).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(b) + 1) * AXES, AXES), pa.int32()), pa.array(p.reshape(-1)))
            grid = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(b) + 1) * AXES, AXES), pa.int32()), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in ("g", "d", "id", "w", "embedding")} | {"cells": grid, "p": flat})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, []

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal k
            group = np.array([f"{g}\0{d}" for g, d in zip(t.column("g").to_pylist(), t.column("d").to_pylist(), strict=True)])
            edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            for a, z in zip(edges, np.append(edges[1:], len(group)), strict=True):
                for s in range(a, z, block):
                    r = t.slice(s, min(block, z - s)).combine_chunks()
                    p = _units(r.column("p").combine_chunks())
                    x = _units(r.column("embedding").combine_chunks())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "g": r.column("g").slice(0, 1).combine_chunks(), "d": r.column("d").slice(0, 1).combine_chunks(), "block": pa.array([(part << 32) + k]),
                            "low": pa.array([p.min(0).tolist()]), "high": pa.array([p.max(0).tolist()]), "n": pa.array([len(r)]),
                            "ids": pa.array([r.column("id").to_numpy().tobytes()]), "ws": pa.array([r.column("w").to_numpy().tobytes()]), "ps": pa.array([p.tobytes()]), "xs": pa.array([x.astype("<f4").tobytes() if as_float else x.tobytes()]),
                        }
                    )
                    k += 1

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 8 * block:
                t = pa.Table.from_batches(held)
                keep = len(t) // block * block
                yield from out(t.slice(0, keep))
                held = t.slice(keep).to_batches()
        if held and sum(map(len, held)):
            yield from out(pa.Table.from_batches(held))

    as_float = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind, value = vectors.schema["g"].dataType.simpleString(), vectors.schema["embedding"].dataType.simpleString()
    placed = vectors.mapInArrow(project, f"g {kind}, d int, id long, w long, embedding {value}, cells array<int>, p array<double>")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["g", "d", "cells", F.xxhash64("id"), "id"]
    placed = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(cut, f"g {kind}, d int, block long, low array<double>, high array<double>, n long, ids binary, ws binary, ps binary, xs binary")


FAN = 8


def block_pairs(box: DataFrame, eps: float) -> DataFrame:
    """Pairs (ba, bb) of intervals of a label, ba <= bb, whose bounding boxes are at most eps apart on every axis.

    The sequence is a tree: FAN neighbouring intervals have one box, FAN of these one more, up to a single box for
    a label. Pairs are refined from the top: only near boxes have their halves compared, so that what is compared
    follows the pairs that remain, and no interval meets all others of its label.
    """
    box = stage(numbered(box, ["g", "d"], ["block"], "seq"), "boxes")
    top = box.agg(F.max("seq")).first()[0] or 0
    levels = 0
    while FAN**levels <= top:
        levels += 1

    def level(k: int) -> DataFrame:
        node = F.floor(F.col("seq") / FAN**k).alias("node")
        ends = [f(F.col(c)[i]) for c, f in (("low", F.min), ("high", F.max)) for i in range(AXES)]
        got = box.groupBy("g", "d", node).agg(*(e.alias(f"e{i}") for i, e in enumerate(ends)))
        return got.select("g", "d", "node", F.array(*(f"e{i}" for i in range(AXES))).alias("low"), F.array(*(f"e{i + AXES}" for i in range(AXES))).alias("high"))

    pairs = box.select("g", "d").distinct().select("g", "d", F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"))
    near = F.forall(F.sequence(F.lit(0), F.lit(AXES - 1)), lambda i: (F.col("la")[i] - eps <= F.col("hb")[i]) & (F.col("lb")[i] - eps <= F.col("ha")[i]))
    for k in range(levels - 1, -1, -1):
        at = stage(level(k), "box_level")
        parent = F.floor(F.col("node") / FAN)
        a = at.select("g", "d", parent.alias("na"), F.col("node").alias("ca"), F.col("low").alias("la"), F.col("high").alias("ha"))
        b = at.select("g", "d", parent.alias("nb"), F.col("node").alias("cb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        pairs = pairs.join(a, ["g", "d", "na"]).join(b, ["g", "d", "nb"]).where((F.col("ca") <= F.col("cb")) & near)
        pairs = pairs.select("g", "d", F.col("ca").alias("na"), F.col("cb").alias("nb"))
    one = box.select("g", "d", F.col("seq").alias("na"), F.col("block").alias("ba"))
    two = box.select("g", "d", F.col("seq").alias("nb"), F.col("block").alias("bb"))
    return pairs.join(one, ["g", "d", "na"]).join(two, ["g", "d", "nb"]).select("ba", "bb")


def links(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Of vectors (g, d, id, w, embedding): rows (id, other, n), a linked weight n of id or an edge to other."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-7
    width = "f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
    blocks = stage(_intervals(vectors, principal_axes(vectors, AXES), eps, block), "intervals")
    pairs = stage(block_pairs(blocks.select("g", "d", "block", "low", "high"), eps), "block_pairs")
    data = blocks.select("block", "d", "ids", "ws", "ps", "xs")
    one = data.toDF("ba", "d", "ia", "wa", "pa", "xa")
    two = data.drop("d").toDF("bb", "ib", "wb", "pb", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (ia, ib), (wa, wb) = ([np.frombuffer(r[k], np.int64) for k in ks] for ks in (("ia", "ib"), ("wa", "wb")))
                xa, xb = (np.frombuffer(r[k], width).astype(float).reshape(-1, r["d"]) for k in ("xa", "xb"))
                qa, qb = (np.frombuffer(r[k], float).reshape(-1, AXES) for k in ("pa", "pb"))
                same = r["ba"] == r["bb"]
                got = list(ego_join(xa, xb, qa, qb, cosine, eps, same))
                if not got:
                    continue
                i, j = (np.concatenate(x) for x in zip(*got, strict=True))
                na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
                np.add.at(na, i, wb[j])
                np.add.at(nb, j, wa[i])
                ids, n = np.concatenate([ia, ib]), np.concatenate([na, nb])
                tree = forest(i, j if same else j + len(ia), len(ids))
                keep = np.flatnonzero(n)
                first = [int(ids[x]) for x, _ in tree] + ids[keep].tolist()
                other = [int(ids[y]) for _, y in tree] + [None] * len(keep)
                yield pa.RecordBatch.from_pydict({"id": pa.array(first, pa.int64()), "other": pa.array(other, pa.int64()), "n": pa.array([0] * len(tree) + n[keep].tolist(), pa.int64())})

    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    small_batches(spark, 8)
    joined = pairs.join(one, "ba").join(two, "bb").select("ba", "bb", "d", "ia", "ib", "wa", "wb", "pa", "pb", "xa", "xb")
    got = stage(joined.mapInArrow(run, "id long, other long, n long"), "vector_links")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    return got


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    e = F.col("embedding")
    usable = e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", usable.alias("ok"), F.xxhash64("embedding").alias("h"))
    fit = rows.where("ok")
    kinds = fit.groupBy(F.col("label").alias("g"), "h", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"))
    kinds = stage(kinds.select("g", "h", F.size("embedding").alias("d"), "id", "w", "embedding"), "vectors")
    found = links(kinds.select("g", "d", "id", "w", "embedding"), cosine)
    counts = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "_c")
    comp = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    kinds = kinds.join(counts, F.col("id") == F.col("_c"), "left").join(comp, F.col("id") == F.col("node"), "left")
    kinds = stage(kinds.select("g", F.col("h").alias("h2"), F.col("embedding").alias("e2"), F.coalesce("component", "id").alias("c"), (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n")), "vector_kinds")
    got = rows.join(kinds, F.col("ok") & (F.col("label") == F.col("g")) & (F.col("h") == F.col("h2")) & (e == F.col("e2")), "left")
    return got.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), (F.coalesce("c", "vec_id").eqNullSafe(F.col("vec_id"))).alias("kept"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
