"""Postcode classification and matching as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: an outward code, and a whole postcode with the space removed.
OUTWARD = "^[A-Z]{1,2}[0-9]([A-Z0-9]|[0-9][A-Z])?$"
WHOLE = "^([A-Z]{1,2}[0-9](?:[A-Z0-9]|[0-9][A-Z])?)([0-9][A-Z]{2})$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def postcode_kind(c) -> Column:
    """``district``, ``outward``, ``full`` or NULL for a typed value."""
    typed = F.trim(_col(c))
    tight = F.upper(F.regexp_replace(typed, "\\s", ""))
    outward = ~typed.rlike("\\s") & tight.rlike(OUTWARD)
    return (F.when(outward & tight.rlike("[0-9]$"), F.lit("district"))
            .when(outward, F.lit("outward"))
            .when(tight.rlike(WHOLE), F.lit("full")))


def postcode_value(c) -> Column:
    """The typed value in stored form: upper case, one space inside a whole postcode."""
    tight = F.upper(F.regexp_replace(F.trim(_col(c)), "\\s", ""))
    kind = postcode_kind(c)
    return F.when(kind == "full", F.regexp_replace(tight, WHOLE, "$1 $2")).when(kind.isNotNull(), tight)


def outward(c) -> Column:
    """The part of a stored postcode before its first space; '' for none."""
    return F.coalesce(F.regexp_extract(_col(c), "(\\S+)", 1), F.lit(""))


def district(c) -> Column:
    """Outward code without a trailing letter that follows a digit."""
    return F.regexp_replace(outward(c), "([0-9])[A-Za-z]$", "$1")


def postcode_matches(stored, kind, value) -> Column:
    """Whether a stored postcode satisfies a classified value."""
    return F.coalesce(
        F.when(kind == "district", district(stored) == value)
        .when(kind == "outward", outward(stored) == value)
        .when(kind == "full", _col(stored) == value),
        F.lit(False),
    )
