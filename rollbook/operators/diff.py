"""Two snapshots compared by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "ods_code"
COMPARED = ["status", "name", "role", "town", "postcode", "contacts"]
GEO = ["town", "postcode"]
OTHER = ["role", "contacts"]


def diff_view(orgs: DataFrame, vocab: DataFrame) -> DataFrame:
    """The compared columns of an entity table; the primary role by name, or its code when it has none."""
    names = vocab.select(F.col("role_code").alias("primary_role_code"), F.col("role_name"))
    return orgs.join(names, "primary_role_code", "left").select(
        KEY, "name", "status", F.coalesce("role_name", "primary_role_code").alias("role"), "town", "postcode")


def passes(role: str | None = None, only_active: bool = False, prefix: str = "") -> Column:
    """Role substring (any case) and active state."""
    ok = F.lit(True)
    if only_active:
        ok = ok & (F.lower(f"{prefix}status") == "active")
    if role is not None:
        ok = ok & F.lower(f"{prefix}role").contains(role.lower())
    return ok


def diff_added(old: DataFrame, new: DataFrame, **keep) -> DataFrame:
    """Rows whose key only the new snapshot has."""
    return new.join(old.select(KEY), KEY, "left_anti").where(passes(**keep))


def diff_removed(old: DataFrame, new: DataFrame, **keep) -> DataFrame:
    """Rows whose key only the old snapshot has."""
    return old.join(new.select(KEY), KEY, "left_anti").where(passes(**keep))


def full_outer_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every key with the side or sides it is on."""
    a, b = old.select(KEY, F.lit(1).alias("a")), new.select(KEY, F.lit(1).alias("b"))
    side = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("both")
    return a.join(b, KEY, "full_outer").select(KEY, side.alias("side"))


def _paired(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """One row per key of either side: ``o`` and ``n`` structs, one shuffle per side."""
    pack = lambda df, name: df.select(KEY, F.struct(*columns).alias(name))
    return pack(old, "o").join(pack(new, "n"), KEY, "full_outer")


def _keep(role: str | None, only_active: bool) -> Column:
    old_ok = F.col("o").isNotNull() & passes(role, only_active, "o.")
    new_ok = F.col("n").isNotNull() & passes(role, only_active, "n.")
    return old_ok | new_ok


def _changed(c: str) -> Column:
    return F.col("o").isNotNull() & F.col("n").isNotNull() & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))


def diff(old: DataFrame, new: DataFrame, columns: list[str] | None = None, role: str | None = None,
         only_active: bool = False) -> DataFrame:
    """Every added, removed and modified key with its ``changes`` map and full ``record`` (added, removed)."""
    columns = columns or [c for c in COMPARED if c in old.columns and c in new.columns]
    rows = _paired(old, new, columns).where(_keep(role, only_active))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("modified")
    entry = lambda c: F.struct(F.lit(c).alias("key"), F.struct(
        F.col(f"o.{c}").cast("string").alias("old"), F.col(f"n.{c}").cast("string").alias("new")).alias("value"))
    changes = F.map_from_entries(F.array_compact(F.array(*[F.when(_changed(c), entry(c)) for c in columns])))
    out = rows.select(KEY, F.coalesce("n.name", "o.name").alias("name"), F.coalesce("n.role", "o.role").alias("role"),
                      kind.alias("change_type"), changes.alias("changes"),
                      F.when(kind != "modified", F.coalesce("n", "o")).alias("record"))
    return out.where((F.col("change_type") != "modified") | (F.size("changes") > 0))


def diff_modified(old: DataFrame, new: DataFrame, **options) -> DataFrame:
    """Long form of the changed fields: one row per key and field, old and new value."""
    rows = diff(old, new, **options).where("change_type = 'modified'")
    return rows.select(KEY, "name", "role", F.explode("changes").alias("field", "v")).select(
        KEY, "name", "role", "field", F.col("v.old").alias("old_value"), F.col("v.new").alias("new_value"))


def diff_long(old: DataFrame, new: DataFrame, **options) -> DataFrame:
    """The flat report: added and removed keys once with empty field, modified keys once per field."""
    rows = diff(old, new, **options)
    none = F.col("change_type") != "modified"
    flat = rows.where(none).select(KEY, "name", "role", "change_type", F.lit("").alias("field"),
                                   F.lit("").alias("old_value"), F.lit("").alias("new_value"))
    changed = rows.where(~none).select(KEY, "name", "role", "change_type", F.explode("changes").alias("field", "v")) \
        .select(KEY, "name", "role", "change_type", "field", F.coalesce("v.old", F.lit("")).alias("old_value"),
                F.coalesce("v.new", F.lit("")).alias("new_value"))
    return flat.unionByName(changed)


def _touched(columns: list[str], among: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        if c in among:
            out = out | _changed(c)
    return out


def diff_stats(old: DataFrame, new: DataFrame, role: str | None = None, only_active: bool = False,
               columns: list[str] | None = None) -> DataFrame:
    """Modified keys by kind of change; ``other`` counts keys with nothing but other changes."""
    columns = columns or [c for c in COMPARED if c in old.columns and c in new.columns]
    rows = _paired(old, new, columns).where(_keep(role, only_active))
    status, name = _changed("status"), _changed("name")
    geo, other = _touched(columns, GEO), _touched(columns, OTHER)
    return rows.agg(F.count_if(status).alias("status_changes"), F.count_if(name).alias("name_changes"),
                    F.count_if(geo).alias("geo_changes"),
                    F.count_if(other & ~status & ~name & ~geo).alias("other_changes"))


def diff_summary(old: DataFrame, new: DataFrame, role: str | None = None, only_active: bool = False,
                 columns: list[str] | None = None) -> DataFrame:
    """Totals of both sides, added, removed, modified, unchanged, and modified as a share of the old total."""
    columns = columns or [c for c in COMPARED if c in old.columns and c in new.columns]
    rows = _paired(old, new, columns)
    kept = _keep(role, only_active)
    any_change = F.lit(False)
    for c in columns:
        any_change = any_change | _changed(c)
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    out = rows.agg(
        F.count("o").alias("baseline_count"), F.count("n").alias("target_count"),
        F.count_if(kept & F.col("o").isNull()).alias("added_count"),
        F.count_if(kept & F.col("n").isNull()).alias("removed_count"),
        F.count_if(kept & any_change).alias("modified_count"), F.count_if(both).alias("_both"))
    share = F.when(F.col("baseline_count") > 0, F.col("modified_count") * 100.0 / F.col("baseline_count")).otherwise(0.0)
    return out.withColumn("unchanged_count", F.col("_both") - F.col("modified_count")) \
        .withColumn("modified_pct", F.round(share, 2)).drop("_both")


def diff_default_pair(series: DataFrame, date: str = "publication_date") -> DataFrame:
    """The two newest snapshot dates: ``old``, ``new``."""
    top = series.select(date).distinct().orderBy(F.col(date).desc()).limit(2)
    return top.agg(F.count("*").alias("n"), F.min(date).alias("old"), F.max(date).alias("new")).where("n = 2") \
        .select("old", "new")
