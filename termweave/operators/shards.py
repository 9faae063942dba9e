"""Shards by document length: geometric minima, or the cheapest ones for a histogram."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import inf


def geometric(first: int = 32, factor: float = 2.0, limit: int = 16_385) -> list[int]:
    """0, then first and its multiples by factor below the limit."""
    out, x = [0], float(first)
    while x < limit:
        out.append(int(x))
        x *= factor
    return out


Cost = Callable[[int, int], float]  # documents and largest posting count of a shard: its cost, infinite if it can't be


def padded_cost(overhead: float = 1.0, least_capacity: int = 1, max_rank: int = 3) -> Cost:
    """Documents, rounded up to whole rows, times the largest posting count, plus the overhead."""
    unit = 64 << max_rank

    def cost(documents: int, postings: int) -> float:
        columns = -(-documents // unit) * unit
        return columns * postings + overhead if columns >= least_capacity else inf

    return cost


def optimal(histogram: Sequence[tuple[int, int]], most: int = 16, cost_of: Cost | None = None) -> list[int]:
    """Minima of at most `most` shards with the least cost, for (posting count, documents) pairs.

    A shard costs what cost_of says, padded_cost() by default. Shortest paths with a bounded number of steps over
    the sorted counts.
    """
    cost_of = cost_of or padded_cost()
    bars = sorted((p, n) for p, n in histogram if n)
    if not bars:
        return [0]
    n = len(bars)
    total = [0]
    for _, d in bars:
        total.append(total[-1] + d)

    def cost(i: int, j: int) -> float:
        return cost_of(total[j] - total[i], bars[j - 1][0])

    best = [[inf] * (n + 1) for _ in range(most + 1)]
    back = [[0] * (n + 1) for _ in range(most + 1)]
    best[0][0] = 0.0
    for k in range(1, most + 1):
        for j in range(1, n + 1):
            for i in range(j):
                if best[k - 1][i] < inf and (c := best[k - 1][i] + cost(i, j)) < best[k][j]:
                    best[k][j], back[k][j] = c, i
    k = min(range(1, most + 1), key=lambda k: (best[k][n], k))
    if best[k][n] == inf:
        return [0]
    cuts, j = [], n
    while j:
        j = back[k][j]
        cuts.append(j)
        k -= 1
    return [0 if i == 0 else bars[i][0] for i in reversed(cuts)]
