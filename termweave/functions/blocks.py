"""Arrays of varying lengths, one after the other, and many arrays as compressed bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, and on, count[0] of them, then those from start[1]."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def steps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of arrays one after the other: the first value of each, then how much each next one is above the one before."""
    out = np.diff(values, prepend=0)
    first = starts(counts[counts > 0])[:-1]
    out[first] = values[first]
    return out


def summed(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of steps."""
    upto, counts = np.cumsum(steps), counts[counts > 0]
    first = starts(counts)[:-1]
    return upto - np.repeat(upto[first] - steps[first], counts)


def pack(t: dict[str, pa.Array]) -> bytes:
    rows = pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in t.values())], names=["_", *t])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> dict[str, pa.Array]:
    rows = pa.ipc.open_stream(data).read_next_batch()
    return {k: rows.column(k).flatten() for k in rows.schema.names[1:]}


def whole(x: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type)


def gathered(batches: Iterator[pa.RecordBatch], lists: list[str], limit: int) -> Iterator[pa.Table]:
    """The rows again, in tables with at most limit elements in these columns of lists, or of a single row."""
    held, n = [], 0
    for b in batches:
        upto = np.cumsum(sum(np.nan_to_num(b.column(c).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for c in lists))
        begin = 0
        while begin < b.num_rows:
            base = upto[begin - 1] if begin else 0
            end = int(np.searchsorted(upto, base + limit - n, "right"))
            if end <= begin and held:
                yield pa.Table.from_batches(held)
                held, n = [], 0
                continue
            end = max(end, begin + 1)
            held.append(b.slice(begin, end - begin))
            n, begin = n + int(upto[end - 1] - base), end
    if held:
        yield pa.Table.from_batches(held)
