"""Exact bin lookup against literal double edges.

``floor(p * n)`` is wrong for edges such as 0.3 (a double product gives
0.30000000000000004), so the index is found by comparing with the edges
themselves. The nested CASE halves the edge list at each level: a row costs
log2(n) comparisons inside generated code.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_edges(bins: int) -> list[float]:
    """``bins + 1`` edges over [0, 1]; the inner ones are double products."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def edges_at_or_below(value: Column, edges: list[float]) -> Column:
    """How many of the ascending ``edges`` are <= value (0 .. len(edges))."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(edges[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(edges))


def uniform_bin(value: Column, bins: int) -> Column:
    """Index of the half-open bin [l, r) over [0, 1); NULL outside, so 1.0 has none."""
    found = edges_at_or_below(value, uniform_edges(bins)) - 1
    return F.when((value >= 0.0) & (value < 1.0), found)
