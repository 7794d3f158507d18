"""The snapshot series: what changed for a key from one publication date to the next.

A key has at most one row per date, so a window partitioned by key holds as many
rows as there are releases, whatever the register's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.runtime import checkpoint

KEY, DATE = "ods_code", "publication_date"


def _w(key: str = KEY, date: str = DATE):
    return Window.partitionBy(key).orderBy(date)


def status_transitions(series: DataFrame) -> DataFrame:
    """Openings and closures per release."""
    s = series.select(DATE, "status", F.lag("status").over(_w()).alias("prev_status"))
    return s.where("prev_status IS NOT NULL AND prev_status <> status").groupBy(DATE, "prev_status", "status").agg(
        F.count("*").alias("n"))


def column_changes(series: DataFrame, column: str = "name") -> DataFrame:
    """Rows where a column differs from the key's previous release: was, now."""
    s = series.select(KEY, DATE, F.col(column).alias("now"), F.lag(column).over(_w()).alias("was"))
    return s.where("was IS NOT NULL AND now <> was").select(KEY, "was", "now", DATE)


def renames(series: DataFrame) -> DataFrame:
    return column_changes(series, "name")


def change_counts(series: DataFrame, columns: list[str]) -> DataFrame:
    """Changes per release and column, all columns in one pass over one sort."""
    changed = lambda c: F.col(f"_{c}").isNotNull() & (F.col(c) != F.col(f"_{c}"))
    s = series.select(DATE, *columns, *[F.lag(c).over(_w()).alias(f"_{c}") for c in columns])
    return s.groupBy(DATE).agg(*[F.count_if(changed(c)).alias(f"{c}_changes") for c in columns])


def previous_in_order(df: DataFrame, keys: list[str], order: list[str], column: str, out: str,
                      hot_rows: int = 2_000_000) -> DataFrame:
    """``lag`` over a total order for groups of any size.

    Groups up to ``hot_rows`` use a window. A larger group is range-partitioned on
    its order columns, so it spreads over many tasks; each piece takes ``lag``
    inside itself and its first row takes the last value of the piece before.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = sizes.where(F.col("_n") > hot_rows).select(*keys)
    plain = Window.partitionBy(*keys).orderBy(*order)
    if hot.isEmpty():
        return df.withColumn(out, F.lag(column).over(plain))
    hot = checkpoint(hot)
    cool = df.join(hot, keys, "left_anti").withColumn(out, F.lag(column).over(plain))
    # checkpointed, so the piece numbers below cannot differ between two evaluations
    pieces = checkpoint(df.join(hot, keys, "left_semi").repartitionByRange(*keys, *order)
                        .withColumn("_piece", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "_piece").orderBy(*order)
    tagged = pieces.withColumn("_prev", F.lag(F.struct(column)).over(inner)) \
        .withColumn("_first", F.row_number().over(inner) == 1)
    ends = pieces.groupBy(*keys, "_piece").agg(F.max_by(F.struct(column), F.struct(*order)).alias("_last"))
    before = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_piece"))) \
        .select(*keys, "_piece", "_carry")
    carried = tagged.join(before, keys + ["_piece"])
    value = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))[column]
    return cool.unionByName(carried.withColumn(out, value).select(*df.columns, out))


def rel_churn(series: DataFrame, after: str, hot_rows: int = 2_000_000) -> DataFrame:
    """Changed commissioner and operator links per release, counted over active links.

    A source may have several targets of one type on a date; the order is total
    (date, target, relationship id) so the result is stable.
    """
    links = series.where("rel_status = 'active'").select("source_code", "rel_code", "target_code", "rel_id", DATE)
    s = previous_in_order(links, ["source_code", "rel_code"], [DATE, "target_code", "rel_id"], "target_code",
                          "prev_target", hot_rows)
    moved = ~F.col("target_code").eqNullSafe(F.col("prev_target"))
    return s.where(F.col(DATE) > F.lit(after).cast("date")).groupBy(DATE).agg(
        F.count_if((F.col("rel_code") == "RE4") & moved).alias("commissioner_changed"),
        F.count_if((F.col("rel_code") == "RE6") & moved).alias("operated_by_changed"))


def stamp_honesty(series: DataFrame, columns=("name", "postcode", "status", "primary_role_code"),
                  stamp: str = "last_changed") -> DataFrame:
    """Edited against stamped, per release."""
    lagged = {c: F.lag(c).over(_w()) for c in (*columns, stamp)}
    s = series.select(DATE, *columns, stamp, *[v.alias(f"p_{c}") for c, v in lagged.items()]) \
        .where(F.col(f"p_{stamp}").isNotNull())
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"p_{c}"))
    edited: Column = F.lit(False)
    for c in columns:
        edited = edited | differs(c)
    c = s.select(DATE, edited.alias("edited"), differs(stamp).alias("stamped"))
    return c.groupBy(DATE).agg(F.count_if(F.expr("edited AND stamped")).alias("edited_and_stamped"),
                               F.count_if(F.expr("edited AND NOT stamped")).alias("edited_not_stamped"),
                               F.count_if(F.expr("NOT edited AND stamped")).alias("stamped_no_visible_edit"))


def gained_successors(series: DataFrame) -> DataFrame:
    """Entities whose successor list grew, per release."""
    n = F.size("successor_codes")
    s = series.select(DATE, n.alias("n"), F.lag(n).over(_w()).alias("was"))
    return s.where("was IS NOT NULL AND n > was").groupBy(DATE).agg(F.count("*").alias("gained_successors"))


def _newest(series: DataFrame):
    return series.agg(F.max(DATE)).scalar()


def deleted_codes(series: DataFrame) -> DataFrame:
    """Keys last seen before the newest release."""
    return series.groupBy(KEY).agg(F.max(DATE).alias("last_seen")).where(F.col("last_seen") < _newest(series))


def new_codes(series: DataFrame) -> DataFrame:
    """Keys first seen after the first release."""
    return series.groupBy(KEY).agg(F.min(DATE).alias("first_seen")).where(
        F.col("first_seen") > series.agg(F.min(DATE)).scalar())


def latest_per_key(series: DataFrame) -> DataFrame:
    """Last state of every key ever seen."""
    rest = [c for c in series.columns if c != KEY]
    return series.groupBy(KEY).agg(F.max_by(F.struct(*rest), DATE).alias("r")).select(KEY, "r.*")


def rebuild_vs_actual(old: DataFrame, new: DataFrame, day: str) -> DataFrame:
    """What was active then, against a later release date-filtered to that day: codes in one only."""
    actual = old.where("status = 'active'").select(KEY, F.lit(1).alias("a"))
    rebuilt = new.where((F.col("operational_start") <= F.lit(day).cast("date"))
                        & (F.col("operational_end").isNull() | (F.col("operational_end") > F.lit(day).cast("date")))) \
        .select(KEY, F.lit(1).alias("b"))
    both = actual.unionByName(rebuilt, allowMissingColumns=True).groupBy(KEY).agg(F.max("a").alias("a"),
                                                                                 F.max("b").alias("b"))
    return both.agg(F.count_if(F.col("b").isNull()).alias("in_actual_only"),
                    F.count_if(F.col("a").isNull()).alias("in_rebuild_only"))


def staleness(series: DataFrame, as_of: str, days: int = 45) -> DataFrame:
    """Age of the newest snapshot on a given day, and whether it is too old."""
    newest = series.agg(F.max(DATE).alias("newest"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("newest"))
    return newest.select("newest", age.alias("age_days"), (age > days).alias("stale"))
