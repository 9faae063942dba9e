"""Quality rules: an isolation forest over each document's rule statistics.

The statistics are counted by bytes in NumPy, a slice of documents at a time. The forest is grown on a bounded
sample of labelled rows (`sample`), as isolation forests are by design; its threshold is the one that best
separates the sample's labels. Every document is then scored against the forest, which is a fixed size.

Defined cases: a null text has no words and all counts 0; documents without words are scored like others and
fail the base rule; nulls and repeats of doc_id pass through, a row each; an empty table gives an empty table.
Without labels of both kinds the threshold keeps `keep_share` of the sample; without labels all are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import Prefix, grams, mix, raw, slices, small_batches, table, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_marks", "n_lines")
_SYMBOL, _UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_MARK[list(b"!?;:()[]{}=+_~^@/\\0123456789")] = True


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more within their document."""
    order = np.argsort(k := mix(keys ^ mix(doc.astype(np.uint64) + np.uint64(1))), kind="stable")
    s = k[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


def statistics(buf: np.ndarray, off: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The counts of COUNTS for the documents in a buffer."""
    n, docs = len(buf), len(off) - 1
    starts, ends, first = word_spans(buf, off)
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    lead = (buf & 0xC0) != 0x80
    out = {"n_words": np.diff(first), "word_chars": _sums(inside & lead, off), "n_symbols": _sums(_SYMBOL[buf], off)}
    prefix, doc = Prefix(buf), np.repeat(np.arange(docs), np.diff(first))

    # lines: cut at \n and at the documents' ends; those with a word count
    breaks = np.flatnonzero(buf == 10)
    begin = np.concatenate([off[:-1], breaks + 1])
    end = np.concatenate([off[1:], breaks])
    begin.sort()
    end.sort()  # an empty document's line begins and ends at the same place
    has = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[has], end[has]
    owner = np.searchsorted(off, begin, "right") - 1
    keys = mix(prefix.spans(begin, end) ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    lines = np.bincount(owner, minlength=docs)
    _, at = np.unique(keys, return_index=True)
    out["n_dup_lines"] = lines - np.bincount(owner[at], minlength=docs)

    # words that a repeated window of eight covers
    g = grams(prefix.spans(starts, ends), window)
    whole = np.arange(len(g)) + window <= first[doc[: len(g)] + 1] if len(g) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    at = at[_repeats(g[at], doc[at])]
    cover = np.zeros(len(starts) + 1, np.int64)
    cover[at] += 1
    np.subtract.at(cover, at + window, 1)
    out["n_repeat_words"] = _sums(np.cumsum(cover[:-1]) > 0, first)
    out |= {"n_chars": _sums(lead, off), "n_upper": _sums(_UPPER[buf], off), "n_marks": _sums(_MARK[buf], off), "n_lines": lines}
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """The rule statistics that the forest splits on."""
    w, c = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1)
    return np.column_stack(
        [
            np.log1p(np.minimum(s["n_words"], 40)),
            np.log1p(100 * s["n_symbols"] / c),
            s["n_repeat_words"] / w,
            s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
            np.log1p(100 * s["n_upper"] / c),
            np.log1p(100 * s["n_marks"] / c),
            np.clip(s["word_chars"] / w, 0, 20),
        ]
    )


#: Bad rows, at least, that a forest grows with where labels have so many.
FEW_BAD = 16


class Forest:
    """Isolation forest as flat arrays: trees x nodes, children at 2k + 1 and 2k + 2.

    Rules are one-sided: a statistic counts by its excess over `usual`, the top of the range that good rows have,
    so that good rows lie together and whatever leaves the range is isolated by few splits.
    """

    def __init__(self, x: np.ndarray, usual: np.ndarray | None = None, trees: int = 100, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.usual = np.zeros(x.shape[1]) if usual is None else usual
        x = self._excess(x)
        size = min(sample, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, np.int8)
        self.cut = np.zeros((trees, nodes))
        self.length = np.zeros((trees, nodes))
        self.norm = self._mean(size)
        for t in range(trees):
            self._grow(t, 0, 0, x[rng.choice(len(x), size, replace=False)], rng)

    def _excess(self, x: np.ndarray) -> np.ndarray:
        return np.log1p(np.maximum(x - self.usual, 0))

    @staticmethod
    def _mean(n: float) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, t: int, at: int, depth: int, x: np.ndarray, rng: np.random.Generator) -> None:
        low, high = x.min(0), x.max(0)
        open_ = np.flatnonzero(high > low)
        if depth == self.depth or not len(open_):
            self.length[t, at] = depth + self._mean(len(x))
            return
        f = rng.choice(open_)
        cut = rng.uniform(low[f], high[f])
        self.feature[t, at], self.cut[t, at] = f, cut
        left = x[:, f] <= cut
        self._grow(t, 2 * at + 1, depth + 1, x[left], rng)
        self._grow(t, 2 * at + 2, depth + 1, x[~left], rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over the expected one: 0 to 1, higher is odder."""
        x = self._excess(x)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                step = 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at])
                at = np.where(f < 0, at, step)
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / max(self.norm, 1e-9))


def _counted(doc_id: str, text: str, model: tuple | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            s = statistics(*raw(b.column(text)))
            cols = {"doc_id": b.column(doc_id)} | {k: pa.array(s[k], pa.int64()) for k in COUNTS}
            if model:
                forest, limit = model
                n, repeat = s["n_words"], s["n_repeat_words"]
                failed, odd = (n < 20) | (100 * repeat > 30 * n), forest.score(features(s))
                cols |= {"base_failed": pa.array(failed), "anomaly": pa.array(odd), "kept": pa.array(~failed & (odd < limit))}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def rule_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and COUNTS (long) of every whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(
        _counted(doc_id, text), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    )


def calibrate(x: np.ndarray, good: np.ndarray, failed: np.ndarray, keep_share: float) -> tuple[Forest, float]:
    """The forest of these rows, and the threshold that rejects most bad rows while keep_share of good ones stay."""
    plain = x[good & ~failed] if (good & ~failed).sum() >= 8 else x
    # bad rows of a kind lie together and would hide each other: the forest grows with a few of them only
    bad = np.flatnonzero(~good & ~failed)
    few = np.random.default_rng(5).permutation(bad)[: max(FEW_BAD, round(len(plain) * 0.02))]
    usual = np.quantile(plain, keep_share + (1 - keep_share) / 2, axis=0)
    # a row beyond each statistic's range, so that trees split on those too that no chosen bad row exceeds
    beyond = np.tile(np.median(plain, axis=0), (x.shape[1], 1))
    np.fill_diagonal(beyond, np.maximum(x.max(0), usual + 1))
    grown = np.vstack([plain, x[few], beyond]) if plain is not x else x
    forest = Forest(grown, usual)
    odd, y = forest.score(x)[~failed], good[~failed]
    if not len(odd):
        return forest, np.inf
    if y.all() or not y.any():
        return forest, float(np.quantile(odd, keep_share)) + 1e-12
    order = np.argsort(odd, kind="stable")
    odd, y = odd[order], y[order]
    last = np.append(odd[1:] > odd[:-1], True)  # a threshold lies between different scores
    kept, rejected = np.cumsum(y) / y.sum(), 1 - np.cumsum(~y) / (~y).sum()
    best = int(np.argmax(np.where(last, np.minimum(kept, keep_share) * 10 + rejected * (kept >= keep_share), -1)))
    return forest, float((odd[best] + odd[min(best + 1, len(odd) - 1)]) / 2 + 1e-12)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, keep_share: float = 0.99) -> tuple[Forest, float]:
    """Grows and calibrates the forest on at most `sample` labelled rows, those with the lowest hashes of doc_id."""
    picked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id")), "doc_id")  # at most `sample` keys
    rows = rule_statistics(chosen).groupBy("doc_id").agg(*(F.min(c).alias(c) for c in COUNTS))
    rows = rows.join(F.broadcast(picked), "doc_id").orderBy("doc_id").toPandas()
    if not len(rows):
        return Forest(np.zeros((2, 7)), trees=1), np.inf
    s = {c: rows[c].to_numpy() for c in COUNTS}
    failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
    return calibrate(features(s), rows["good"].to_numpy() > 0, failed, keep_share)


def quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """Counts, base_failed, anomaly (0 to 1) and kept of every document."""
    model = fit(docs, labels, sample)
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(_counted("doc_id", "text", model), schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
