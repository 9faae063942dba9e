"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

A source's documents lie on a line of words in a seeded order, cut into blocks of equal words. Blocks are seats:
sources get them by highest quotients of their targets, and so do a source's shards of 128 blocks; within a
shard a seeded order says which blocks are taken. Whole passes come first, the blocks say what the last, partial
pass takes, and a source's last block is cut so that its target is met to the word. The block size follows the
corpus, so that the plan has at most `blocks` rows and one a source.

Where a document lies comes from two prefix sums, over cells of about `cell_docs` documents and within a cell,
so that no task gets a whole source. Documents look up the blocks at their two ends.

Defined cases: null sources are a source of their own, last in order; null and empty texts have size 0 and take
0; repeated rows lie on the line each; null doc_ids are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm.common import stage, table, whole_row

SHARD = 128
#: A plan of more rows than this is joined without broadcasting it.
BROADCAST_ROWS = 200_000


def fill_targets(sizes: Sequence[float], weights: Sequence[float], total: float, times: float = 2.0) -> np.ndarray:
    """Shares total by weight; none above times its size, the excess going to the others by weight."""
    s, w = np.asarray(sizes, float), np.asarray(weights, float)
    out, open_ = np.zeros(len(s)), s > 0
    left = min(total, times * s.sum())
    while open_.any():
        share = np.where(open_, w * left / w[open_].sum(), 0)
        over = open_ & (share >= times * s)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = times * s[over]
        left -= out[over].sum()
        open_ &= ~over
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1); at most `most` each; ties go to the first.

    Starts from what every party gets in any case (the quotients above a divisor that gives too few seats).
    """
    v = np.asarray(votes, float)
    cap = np.asarray(most if most is not None else [seats] * len(v), np.int64)
    seats = min(seats, int(cap[v > 0].sum()))
    got = np.zeros(len(v), np.int64)
    if seats <= 0:
        return got
    low, high = 0.0, 4 * v.max() + 1.0  # more than seats at low, none at high
    for _ in range(200):
        mid = (low + high) / 2
        n = np.minimum(np.floor(v / mid + 0.5), cap).sum() if mid > 0 else np.inf
        low, high = (mid, high) if n > seats else (low, mid)
    got = np.minimum(np.floor(v / (high * (1 + 1e-12)) + 0.5), cap).astype(np.int64)
    heap = [(-v[i] / (2 * got[i] + 1), i) for i in range(len(v)) if v[i] > 0 and got[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-v[i] / (2 * got[i] + 1), i))
    return got


def plan_source(size: int, target: int, seats: int, block: int, seed: int) -> list[tuple[int, int, int, int]]:
    """Rows (block, words taken before it, whole passes over it, words of its beginning taken once more)."""
    n = -(-size // block)
    passes, rest = divmod(target, size)
    lengths = np.full(n, block, np.int64)
    lengths[-1] = size - (n - 1) * block
    shards = np.arange(n) // SHARD
    words = np.bincount(shards, weights=lengths)
    quota = sainte_lague(words, min(seats, n), np.bincount(shards))
    lot = np.random.default_rng(seed).permutation(n)  # a seeded order of all blocks
    lot = lot[np.argsort(shards[lot], kind="stable")]
    rank = np.arange(n) - np.searchsorted(shards, shards[lot])
    chosen = lot[rank < quota[shards[lot]]]
    others = lot[rank >= quota[shards[lot]]]
    more, left = np.zeros(n, np.int64), rest
    for b in [*chosen, *others]:  # the quotas' blocks, then others while words are missing
        if left <= 0:
            break
        more[b] = min(left, lengths[b])
        left -= more[b]
    before = np.concatenate([[0], np.cumsum(passes * lengths + more)[:-1]])
    return [(b, int(before[b]), int(passes), int(more[b])) for b in range(n)]


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, times: float = 2.0, blocks: int = 32_768, cell_docs: int = 5_000, seed: int = 20240229, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words that the mix takes, repeats counted)."""
    spark = docs.sparkSession
    lot = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), lot.alias("lot"))
    sized = stage(sized, "mix")
    # one row a source; in code point order, as UTF-8 sorts
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [r["size"] for r in rows]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), times)
    block = max(1, -(-sum(sizes) // blocks))
    seats = sainte_lague(targets, int(round(targets.sum() / block)))
    about, plan = [], []
    for i, r in enumerate(rows):
        about.append((i, r["source"], r["size"], float(targets[i]), max(1, -(-r["docs"] // cell_docs))))
        if r["size"]:
            words = min(int(round(targets[i])), int(times * r["size"]))
            in_passes = words // r["size"] * -(-r["size"] // block)
            plan += [(i, *x) for x in plan_source(r["size"], words, max(0, int(seats[i]) - in_passes), block, seed + i)]
    about = spark.createDataFrame(about, "s int, source string, source_size long, target double, cells long")
    plan_df = spark.createDataFrame(plan, "s int, block long, before long, passes long, more long")
    if len(rows) <= BROADCAST_ROWS:
        about = F.broadcast(about)
    if len(plan) <= BROADCAST_ROWS:
        plan_df = F.broadcast(plan_df)

    placed = sized.withColumnRenamed("source", "source_").join(about, F.col("source_").eqNullSafe(F.col("source"))).drop("source_")
    placed = placed.withColumn("cell", F.pmod("lot", F.lit(1 << 40)) * F.col("cells") / F.lit(1 << 40)).withColumn("cell", F.floor("cell"))
    cells = placed.groupBy("s", "cell").agg(F.sum("size").alias("words"))
    cells = cells.select("s", "cell", (F.sum("words").over(Window.partitionBy("s").orderBy("cell")) - F.col("words")).alias("base"))
    inside = Window.partitionBy("s", "cell").orderBy("lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(inside)).join(cells, ["s", "cell"])
    placed = placed.withColumn("end", F.col("end") + F.col("base")).withColumn("begin", F.col("end") - F.col("size"))

    def upto(df: DataFrame, place: str, name: str) -> DataFrame:
        """Adds the words taken of the line's first `place` words."""
        p = plan_df.select(F.col("s").alias("_s"), F.col("block").alias("_b"), "before", "passes", "more")
        df = df.join(p, (F.col("s") == F.col("_s")) & (F.floor(F.greatest(F.col(place) - 1, F.lit(0)) / F.lit(block)) == F.col("_b")), "left")
        y = F.col(place) - F.col("_b") * F.lit(block)
        return df.withColumn(name, F.coalesce(F.col("before") + F.col("passes") * y + F.least(F.col("more"), y), F.lit(0))).drop("_s", "_b", "before", "passes", "more")

    placed = upto(upto(placed, "begin", "_from"), "end", "_to")
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("_to") - F.col("_from")).cast("long").alias("taken"), "lot")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes words of, once for each begun pass over them.

    The copies of a row that is taken twice are two rows. Where rows share doc_id, text and source they share their
    takes: each stays as often as the mean of their passes, rounded up.
    """
    mix = mix_sources(docs, **options).where("taken > 0")
    key = F.xxhash64(F.lit(options.get("seed", 20240229)), F.col("doc_id"), F.col("text"))
    takes = mix.select("lot", F.col("doc_id").alias("id"), "source", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("n"))
    takes = takes.groupBy("lot", "id", "source").agg(F.ceil(F.sum("n") / F.count("*")).cast("int").alias("each"))
    rows = docs.select(whole_row(docs), key.alias("key"), F.col("doc_id").alias("own"), F.col("source").alias("from"))
    same = (F.col("key") == F.col("lot")) & F.col("own").eqNullSafe(F.col("id")) & F.col("from").eqNullSafe(F.col("source"))
    return rows.join(takes, same).select("row", F.explode(F.sequence(F.lit(1), F.col("each")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
