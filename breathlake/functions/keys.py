"""Keys that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subject_key(c: Column | str) -> Column:
    """Canonical subject id: its ASCII letters and digits, in upper case.

    NULL where nothing is left or the id spells UNKNOWN (no subject).
    """
    c = F.col(c) if isinstance(c, str) else c
    k = F.upper(F.regexp_replace(c.cast("string"), "[^A-Za-z0-9]", ""))
    return F.when((k != "") & (k != "UNKNOWN"), k)


def calendar_date(c: Column | str) -> Column:
    """``yyyymmdd`` of a date written year first, or day, month, year.

    Two-digit years mean 20xx. NULL for UNKNOWN and for anything else.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c)
    compact = F.regexp_extract(s, r"^(\d{4})(\d{2})(\d{2})$", 0)
    first = r"^(\d{4})\D(\d{1,2})\D(\d{1,2})$"
    last = r"^(\d{1,2})\D(\d{1,2})\D(\d{4}|\d{2})$"

    def part(pattern: str, i: int, n: int = 2) -> Column:
        return F.lpad(F.regexp_extract(s, pattern, i), n, "0")

    year = F.regexp_extract(s, last, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return (
        F.when(compact != "", compact)
        .when(s.rlike(first), F.concat(part(first, 1, 4), part(first, 2), part(first, 3)))
        .when(s.rlike(last), F.concat(year, part(last, 2), part(last, 1)))
    )
