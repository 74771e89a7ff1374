"""String similarities (F06-F10) and edit distances, from their published definitions, as Arrow-batched UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence; the row of the dynamic programme is one integer (Hyyro 2004)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one, two = (" ".join(filter(None, (both, " ".join(sorted(s - t))))) for s, t in ((x, y), (y, x)))
    return max([ratio(one, two), *([ratio(both, one), ratio(both, two)] if both else [])])


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any window of its length in the longer, cut windows at both ends too."""
    if not a or not b:
        return 100.0 if a == b else 0.0

    def best(short: str, long: str) -> float:
        n = len(short)
        spans = ((max(0, i), min(len(long), i + n)) for i in range(1 - n, len(long)))
        return max(ratio(short, long[i:j]) for i, j in spans)

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(*sorted((a, b), key=len))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right, strict=True)) // 2) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def osa(a: str, b: str) -> int:
    """Edits and swaps of neighbours, no part edited twice."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


def _pairwise(kind: T.DataType, f):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}

        def of(x, y):
            if x is None or y is None:
                return None
            if (x, y) not in known:
                known[x, y] = f(x, y)
            return known[x, y]

        return pd.Series([of(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32" if isinstance(kind, T.IntegerType) else "float64")

    return run


ratio_udf, token_sort_udf, token_set_udf, partial_udf, jaro_winkler_udf = (
    _pairwise(T.DoubleType(), f) for f in (ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler)
)
osa_udf = _pairwise(T.IntegerType(), osa)


def register(spark) -> None:
    """The similarities under their names, for SQL."""
    for name, udf in (("lcs_ratio", ratio_udf), ("token_sort_ratio", token_sort_udf), ("token_set_ratio", token_set_udf), ("partial_ratio", partial_udf), ("jaro_winkler", jaro_winkler_udf), ("osa_distance", osa_udf)):
        spark.udf.register(name, udf)
