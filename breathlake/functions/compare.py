"""Rounding that two engines agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added before rounding: means of decimals often lie exactly between two
#: results, where the last bit of a sum would decide.
NUDGE = 1e-10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c) + NUDGE, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def nudged(sql: str) -> str:
    """The same in SQL: each ``round(x, n)`` becomes ``round((x) + 1e-10, n)``."""
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        depth, comma, j = 1, -1, i + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            if sql[j] == "," and depth == 1:
                comma = j
            j += 1
        out += [sql[at:i], "round((", nudged(sql[i + 6: comma]), f") + {NUDGE:.0e}", sql[comma:j]]
        at = j
    return "".join([*out, sql[at:]])
