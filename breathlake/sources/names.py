"""What file names say about a recording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(c: Column | str) -> Column:
    """Last path part without its extension."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.substring_index(c, "/", -1), r"(?<=.)\.[^.]*$", "")


def subject_from_name(c: Column | str) -> Column:
    """First four characters of the stem, in upper case; a shorter stem as it is."""
    s = stem(c)
    return F.when(F.length(s) < 4, s).otherwise(F.upper(F.substring(s, 1, 4)))


def date_from_name(c: Column | str) -> Column:
    """``yyyymmdd`` from the last three digit runs (day, month, year), else UNKNOWN.

    Years of at most two digits up to 30 are 20xx, above 19xx. Longer runs stay
    whole, shorter ones are padded with zeros.
    """
    runs = F.regexp_extract_all(stem(c), F.lit(r"(\d+)"), F.lit(1))
    at = lambda i: F.element_at(runs, -i)
    two = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    y = at(1)
    year = F.when(F.length(y) <= 2, F.concat(F.when(y.cast("int") <= 30, "20").otherwise("19"), two(y))).otherwise(y)
    return F.when(F.size(runs) >= 3, F.concat(year, two(at(2)), two(at(3)))).otherwise("UNKNOWN")


def safe_name(c: Column | str) -> Column:
    """Letters, digits, ``-`` and ``_`` alone, for file names."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[^A-Za-z0-9_-]", "")
