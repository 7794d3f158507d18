"""Date parsing and the interval rules every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c) -> Column:
    """``2026-08-03`` or ``2026-8-3``; anything else, or no such day, is NULL."""
    text = _col(c)
    part = F.split(text, "-")
    padded = F.concat_ws("-", F.lpad(part[0], 4, "0"), F.lpad(F.try_element_at(part, F.lit(2)), 2, "0"),
                         F.lpad(F.try_element_at(part, F.lit(3)), 2, "0"))
    return F.when(text.rlike("^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(padded, "yyyy-MM-dd"))


def is_open(status="status", legal_end="legal_end", as_of="publication_date") -> Column:
    """Active, and not past its legal end on the date the row is as of."""
    end = _col(legal_end)
    return (_col(status) == "active") & (end.isNull() | (end > _col(as_of)))


def existed_on(day, start="operational_start", end="operational_end") -> Column:
    """Whether an interval covers ``day`` (start inclusive, end exclusive, open ends allowed)."""
    day = F.lit(day).cast("date") if isinstance(day, str) else day
    return (_col(start) <= day) & (_col(end).isNull() | (_col(end) > day))


def is_closed_record(status="status", operational_end="operational_end") -> Column:
    """Closed for display: it has an operational end, or it is inactive."""
    return _col(operational_end).isNotNull() | F.coalesce(F.lower(_col(status)) == "inactive", F.lit(False))


def last_of_type(dates, kind: str) -> Column:
    """The last date block of one type, as a struct; later blocks replace earlier ones."""
    return F.try_element_at(F.filter(dates, lambda d: F.lower(d["date_type"]) == kind), F.lit(-1))


def first_of_type(dates, kind: str) -> Column:
    """The first date block of one type."""
    return F.try_element_at(F.filter(dates, lambda d: F.lower(d["date_type"]) == kind), F.lit(1))
