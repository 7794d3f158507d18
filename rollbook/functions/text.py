"""Text, code and version helpers. All are built-in expressions inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(c) -> Column:
    """ASCII letters and digits only, upper-cased: the form names are matched in."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def normalise(c) -> Column:
    """Apostrophes dropped, every other run of punctuation or space made one space."""
    plain = F.regexp_replace(c, "['’‘]", "")
    return F.trim(F.regexp_replace(plain, "[^\\p{L}\\p{N}]+", " "))


def place_key(c) -> Column:
    """A place value as typed, in the form stored places are compared in."""
    return normalise(F.upper(F.trim(c)))


def numeric_part(c) -> Column:
    """Digits of a code as a number; codes without any, or too large, sort last."""
    last = F.lit(4294967295)
    digits = F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")
    return F.when(digits <= last, digits).otherwise(last)


#: Countries shown in title case.
COUNTRY_NAMES = {
    "england": "England",
    "scotland": "Scotland",
    "wales": "Wales",
    "northern ireland": "Northern Ireland",
}


def country_title(c) -> Column:
    """Title case for the four known countries, others as stored, a dash for NULL."""
    shown = F.col(c) if isinstance(c, str) else c
    out = F.coalesce(shown, F.lit("—"))
    for key, name in COUNTRY_NAMES.items():
        out = F.when(F.lower(shown) == key, F.lit(name)).otherwise(out)
    return out


def thousands(c) -> Column:
    """A count with thousands separators."""
    return F.format_number(c, 0)


def semver(c) -> Column:
    """``major.minor.patch`` as an array that compares element-wise; NULL when malformed."""
    text = F.col(c) if isinstance(c, str) else c
    parts = F.split(text, "\\.").cast("array<string>")
    return F.when(text.rlike("^[0-9]{1,18}\\.[0-9]{1,18}\\.[0-9]{1,18}$"),
                  F.transform(parts, lambda p: p.cast("bigint")))


def archive_name_parts(c) -> Column:
    """Version, label and date of a release archive's file name; NULL when it is not one.

    Fixed format: ``hscorgrefdataxml_data_<version>_<yyyymmdd><seq>.zip``.
    """
    text = F.col(c) if isinstance(c, str) else c
    pattern = "^(?i:hscorgrefdataxml_data_)([^_]+)_([^_]*)(?:_.*)?\\.zip$"
    version = F.regexp_extract(text, pattern, 1)
    digits = F.regexp_replace(F.regexp_extract(text, pattern, 2), "[^0-9]", "")
    day = F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd")
    good = (version != "") & (F.length(digits) >= 8) & day.isNotNull()
    return F.when(good, F.struct(version.alias("version"),
                                 F.concat(F.lit("Release "), version).alias("label"),
                                 day.alias("release_date")))


def name_at_code(names, codes, code) -> Column:
    """The name aligned with ``code`` in two parallel lists; NULL when it is absent."""
    return F.try_element_at(names, F.nullif(F.array_position(codes, code), F.lit(0)).cast("int"))
