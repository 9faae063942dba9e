"""Shared plumbing: the shared folder, Arrow batches cut by bytes, and byte-level hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.sources.workspace import shared_dir as shared_dir
from termweave.sources.workspace import small_batches as small_batches
from termweave.sources.workspace import stage as stage

#: Bytes of text that a Python worker handles at once; a longer document comes alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sieve(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Drops most rows whose key (a 64-bit hash) isn't wanted, before a join that drops the rest.

    A bitmap of wanted keys modulo its size is broadcast: 2 ** 20 words of 64 bits at most, whatever the data.
    Nothing wanted is dropped. wanted should be a written table, as it is read here and by the join.
    """
    words = 1 << min(20, max(6, (wanted.count() // 4 + 1).bit_length()))

    def word(c: str):
        return F.pmod(F.shiftright(c, 6), F.lit(words))

    bit = F.expr(f"shiftleft(1L, cast({wanted_key} & 63 as int))")
    bits = wanted.select(word(wanted_key).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = F.expr(f"shiftrightunsigned(_bits, cast({key} & 63 as int)) & 1L")
    return rows.join(F.broadcast(bits), word(key) == F.col("_word")).where(met == 1).drop("_word", "_bits")


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns as one, so that none clashes with a column that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its len + 1 offsets; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most limit bytes of text, or a single row."""
    for batch in batches:
        sizes = np.diff(raw(batch.column(text))[1])
        total, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


# ---- hashing -------------------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**60)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_POWER_STEP = 1 << 17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and its inverse. A worker keeps as many as it needed, those of a longer document not."""
    if n <= len(_pow[0]):
        return _pow[0], _pow[1]
    got = []
    for base in (_BASE, _INVERSE):
        x = np.full(-(-n // _POWER_STEP) * _POWER_STEP, np.array(base, np.uint64))
        x[0] = 1
        got.append(np.cumprod(x, out=x))
    if n <= SLICE_BYTES + 1:
        _pow[:] = got
    return got[0], got[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Fingerprints of any span of a buffer, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        up, self._down = _powers(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[:n], out=self._sum[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        got = (self._sum[end] - self._sum[start]) * self._down[start]
        return mix(got + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, size: int) -> np.ndarray:
        """Of all windows of so many bytes."""
        n = max(0, len(self._sum) - size)
        return mix((self._sum[size:] - self._sum[:n]) * self._down[:n])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each document's first word (len + 1 of them)."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of so many word fingerprints (document borders are the caller's)."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)
