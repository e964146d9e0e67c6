"""String distances that Spark has no function for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType


def jaro_winkler(s: str, t: str, weight: float = 0.1, most: int = 4) -> int:
    """0 (equal) to 100 (nothing in common), without the fraction; 100 where a string is empty.

    The shorter string's characters look for partners in the longer one, and an odd number of transposed characters
    counts as one less.
    """
    short, long = (s, t) if len(s) <= len(t) else (t, s)
    reach = max(0, len(long) // 2 - 1)
    partner: dict[int, int] = {}
    for i, c in enumerate(short):
        free = (j for j in range(max(0, i - reach), min(len(long), i + reach + 1)) if long[j] == c and j not in partner)
        if (j := next(free, None)) is not None:
            partner[j] = i
    if not partner:
        return 100
    moved = sum(long[j] != short[i] for j, i in zip(sorted(partner), sorted(partner.values()), strict=True))
    m = len(partner)
    jaro = (m / len(long) + m / len(short) + (m - moved // 2) / m) / 3.0
    start = 0
    while start < min(most, len(short)) and s[start] == t[start]:
        start += 1
    return int(100 * (1.0 - (jaro + start * weight * (1.0 - jaro))))


@pandas_udf(IntegerType())
def jaro_winkler_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")
