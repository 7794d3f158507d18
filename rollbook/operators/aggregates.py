"""The documented counting recipes. All are partial aggregates: map-side first, then one shuffle of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.dates import existed_on, is_open
from rollbook.functions.roles import COMMISSIONED_BY, OPERATED_BY


def active(orgs: DataFrame) -> DataFrame:
    return orgs.where("status = 'active'")


def role_histogram(orgs: DataFrame, record_class: str = "org", k: int = 8) -> DataFrame:
    """Most held roles among active entities of one class."""
    rows = active(orgs).where(F.col("record_class") == record_class)
    return rows.select(F.explode("role_names").alias("role")).groupBy("role").agg(F.count("*").alias("n")) \
        .orderBy(F.col("n").desc(), "role").limit(k)


def role_holders(orgs: DataFrame, vocab: DataFrame, query: str | None = None, all_rows: bool = False) -> DataFrame:
    """Every vocabulary role with its holders, zero included; optional substring of code or name."""
    rows = orgs if all_rows else orgs.where(is_open())
    held = rows.select(F.explode("role_codes").alias("role_code")).groupBy("role_code").agg(F.count("*").alias("n"))
    want = vocab
    if query is not None:
        q = query.strip().lower()
        want = vocab.where(F.lower("role_code").contains(q) | F.lower("role_name").contains(q))
    return want.join(held, "role_code", "left").select("role_code", "role_name", F.coalesce("n", F.lit(0)).alias("holders"))


def role_holders_order() -> list:
    return [F.col("holders").desc(), F.col("role_name")]


def roles_per_entity(orgs: DataFrame) -> DataFrame:
    return active(orgs).groupBy(F.size("role_codes").alias("roles")).agg(F.count("*").alias("entities"))


def count_with_name(orgs: DataFrame, role_code: str, text: str) -> DataFrame:
    """Active holders of a role, and those whose name contains a text."""
    rows = active(orgs).where(F.array_contains("role_codes", role_code))
    return rows.agg(F.count("*").alias("all_rows"), F.count_if(F.col("name").contains(text)).alias("named"))


def count_also_role(orgs: DataFrame, role_code: str, also: str) -> DataFrame:
    """Active holders of a role, and those that hold another as well."""
    rows = active(orgs).where(F.array_contains("role_codes", role_code))
    return rows.agg(F.count("*").alias("holders"), F.count_if(F.array_contains("role_codes", also)).alias("also"))


def rel_types_by_class(rels: DataFrame, orgs: DataFrame) -> DataFrame:
    """Relationships per type by the record class of an active source."""
    o = active(orgs).select(F.col("ods_code").alias("source_code"), F.col("record_class"))
    return rels.select("source_code", "rel_name").join(o, "source_code").groupBy("rel_name").agg(
        F.count_if(F.col("record_class") == "site").alias("site_source_count"),
        F.count_if(F.col("record_class") == "org").alias("org_source_count"))


def top_by_town(orgs: DataFrame, role_name: str, k: int = 5) -> DataFrame:
    rows = active(orgs).where(F.array_contains("role_names", role_name))
    return rows.groupBy("town").agg(F.count("*").alias("holders")).orderBy(F.col("holders").desc(), F.col("town")).limit(k)


def in_outward(orgs: DataFrame, outward_code: str, role_name: str) -> DataFrame:
    """Active holders of a role whose postcode begins with an outward code."""
    rows = active(orgs).where(F.array_contains("role_names", role_name) & F.col("postcode").startswith(outward_code + " "))
    return rows.select("ods_code", "name", "postcode")


def sources_per_target(rels: DataFrame, orgs: DataFrame, rel_code: str, source_filter) -> DataFrame:
    """Active relationships of one type from filtered active sources, counted per target.

    Counted by target code before the target's name is joined, so a target that
    collects a third of all rows is reduced on the map side first.
    """
    src = active(orgs).where(source_filter).select(F.col("ods_code").alias("source_code"))
    hits = rels.where((F.col("rel_code") == rel_code) & (F.col("rel_status") == "active")) \
        .select("source_code", "target_code").join(src, "source_code")
    per = hits.groupBy("target_code").agg(F.count("*").alias("n"))
    names = orgs.select(F.col("ods_code").alias("target_code"), F.col("name").alias("target_name"))
    return per.join(names, "target_code").groupBy("target_name").agg(F.sum("n").alias("n"))


def top_commissioners(rels: DataFrame, orgs: DataFrame, role_name: str, k: int = 5) -> DataFrame:
    per = sources_per_target(rels, orgs, COMMISSIONED_BY, F.array_contains("role_names", role_name))
    return per.orderBy(F.col("n").desc(), "target_name").limit(k)


def top_operators(rels: DataFrame, orgs: DataFrame, k: int = 3) -> DataFrame:
    per = sources_per_target(rels, orgs, OPERATED_BY, F.col("record_class") == "site")
    return per.orderBy(F.col("n").desc(), "target_name").limit(k)


def dup_names(orgs: DataFrame) -> DataFrame:
    """Names more than one active entity has."""
    return active(orgs).groupBy("name").agg(F.count("*").alias("codes")).where("codes > 1")


def release_totals(series: DataFrame) -> DataFrame:
    return series.groupBy("publication_date").agg(F.count("*").alias("n_rows"),
                                                  F.count_if(F.col("status") == "active").alias("n_active"))


def country_counts(orgs: DataFrame) -> DataFrame:
    return active(orgs).groupBy("country").agg(F.count("*").alias("n"))


def open_holders_by_country(orgs: DataFrame, role_codes: list[str]) -> DataFrame:
    """Open holders of any of some roles, per country."""
    held = F.arrays_overlap("role_codes", F.array(*[F.lit(c) for c in role_codes]))
    return orgs.where(is_open() & held).groupBy("country").agg(F.count("*").alias("n"))


def trust_states(orgs: DataFrame, country: str, role_code: str) -> DataFrame:
    """Active holders of a role in a country by open or not, with a successor or not."""
    rows = active(orgs).where((F.col("country") == country) & F.array_contains("role_codes", role_code))
    return rows.groupBy(is_open().alias("is_open"), (F.size("successor_codes") == 0).alias("no_successor")).agg(
        F.count("*").alias("n"))


def fill_rate(orgs: DataFrame, column: str = "legal_start") -> DataFrame:
    """Rows and share of rows with a value, per role, over all rows."""
    return orgs.select(F.explode("role_names").alias("role"), F.col(column)).groupBy("role").agg(
        F.count("*").alias("n_rows"), F.count(column).alias("filled")).withColumn(
        "pct", F.round(F.col("filled") * 100.0 / F.col("n_rows"), 1))


def status_split(rels: DataFrame) -> DataFrame:
    return rels.groupBy("rel_status").agg(F.count("*").alias("n"))


def rel_type_counts(rels: DataFrame) -> DataFrame:
    return rels.groupBy("rel_code", "rel_name").agg(F.count("*").alias("n"))


def sentinel_dates(orgs: DataFrame, column: str = "operational_start", day: str = "1900-01-01") -> DataFrame:
    return orgs.where(F.col(column) == F.lit(day).cast("date")).agg(F.count("*").alias("n"))


def date_disagreement(orgs: DataFrame) -> DataFrame:
    """Rows whose two starts differ, and those where the legal one is earlier."""
    return orgs.agg(F.count_if(F.col("legal_start") != F.col("operational_start")).alias("disagree"),
                    F.count_if(F.col("legal_start") < F.col("operational_start")).alias("legal_earlier"))


def existed_both_ways(orgs: DataFrame, day: str) -> DataFrame:
    """What existed on a day, by operational and by legal dates, in one pass."""
    return orgs.agg(F.count_if(existed_on(day)).alias("via_operational"),
                    F.count_if(existed_on(day, "legal_start", "legal_end")).alias("via_legal"))


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


def active_with_end(orgs: DataFrame) -> DataFrame:
    """Active entities with a scheduled operational end, and the furthest one."""
    return active(orgs).agg(F.count("operational_end").alias("n"), F.max("operational_end").alias("furthest"))


def overdue_closure(orgs: DataFrame) -> DataFrame:
    """Active entities past their legal end: all, within six months of it, more than two years past it."""
    past = F.coalesce(F.col("legal_end") <= F.col("publication_date"), F.lit(False))
    return active(orgs).where(past).agg(
        F.count("*").alias("overdue"),
        F.count_if(F.add_months("legal_end", 6) >= F.col("publication_date")).alias("within_six_months"),
        F.count_if(F.add_months("legal_end", 24) < F.col("publication_date")).alias("over_two_years"))


def active_rel_on_inactive(rels: DataFrame, orgs: DataFrame) -> DataFrame:
    """Active relationships stated by inactive entities."""
    gone = orgs.where("status = 'inactive'").select(F.col("ods_code").alias("source_code"))
    return rels.where("rel_status = 'active'").join(gone, "source_code", "left_semi").agg(F.count("*").alias("n"))


def open_holders(orgs: DataFrame, role_code: str) -> DataFrame:
    return orgs.where(is_open() & F.array_contains("role_codes", role_code)).agg(F.count("*").alias("n"))


def as_of_summary(orgs: DataFrame) -> DataFrame:
    return orgs.agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "active").alias("n_active"),
                    F.max("publication_date").alias("as_of"))
