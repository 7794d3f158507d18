"""The documented join recipes, and the traps they warn of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.roles import COMMISSIONED_BY, OPERATED_BY


def join_roles_orgs(roles: DataFrame, orgs: DataFrame) -> DataFrame:
    """Role rows with their entity."""
    return roles.join(orgs.select("ods_code", "name", "status"), "ods_code")


def join_rel_both_ends(rels: DataFrame, orgs: DataFrame) -> DataFrame:
    """Active relationships with the names of both ends."""
    s = orgs.select(F.col("ods_code").alias("source_code"), F.col("name").alias("organisation"))
    t = orgs.select(F.col("ods_code").alias("target_code"), F.col("name").alias("target"))
    return rels.where("rel_status = 'active'").join(s, "source_code").join(t, "target_code").select(
        "source_code", "organisation", "rel_code", "rel_name", "target_code", "target", "rel_id")


def _places(rows: DataFrame, codes: str) -> DataFrame:
    """``rows`` with one entry per distinct code of the list: ``at``, its places, and the code. Lists are sorted, not searched."""
    placed = rows.withColumn("_sorted", F.array_sort(F.transform(codes, lambda c, i: F.struct(c.alias("code"), i.alias("at")))))
    own = F.col("_sorted")
    new = lambda x, j: (j == 0) | ~x["code"].eqNullSafe(F.get(own, j - 1)["code"])
    begun = placed.withColumn("_begun", F.filter(F.transform(own, lambda x, j: F.when(new(x, j), j)), lambda j: j.isNotNull()))
    end = lambda k: F.coalesce(F.get("_begun", k + 1), F.size(own))
    return begun.withColumn("_places", F.transform("_begun", lambda j, k: F.struct(
        F.get(own, j)["code"].alias("code"), F.transform(F.slice(own, j + 1, end(k) - j), lambda x: x["at"]).alias("at")))).drop("_sorted", "_begun")


def join_code_to_name(rows: DataFrame, orgs: DataFrame, codes: str, key: str = "ods_code",
                      out: str = "related") -> DataFrame:
    """A code list as ``(code, name, status)`` structs in list order; unknown codes named '' and ``unknown``.

    ``key`` names one row. A code that a list repeats is looked up once for that list, and rows that
    hold nothing but key and list are put together from what was looked up, without being joined again.
    """
    bare = set(rows.columns) == {key, codes}
    flat = _places(rows.select(key, codes), codes).select(key, codes, F.posexplode_outer("_places").alias("_k", "_p")).select(
        key, "_p.code", "_p.at", F.when(F.coalesce("_k", F.lit(0)) == 0, F.col(codes)).alias("_codes"))
    facts = orgs.select(F.col("ods_code").alias("code"), F.col("name").alias("n"), F.col("status").alias("s"))
    known = F.struct("at", F.col("code").alias("code"), F.coalesce("n", F.lit("")).alias("name"), F.coalesce("s", F.lit("unknown")).alias("status"))
    # rows are dealt out before they are listed: lists of one or two begun before the shuffle would be larger than the rows
    lists = flat.join(facts, "code", "left").repartition(key).groupBy(key).agg(
        F.first("_codes", True).alias(codes), F.collect_list(F.when(F.col("at").isNotNull(), known)).alias("_found"))
    each = F.flatten(F.transform("_found", lambda x: F.transform(x["at"], lambda p: F.struct(p, x["code"], x["name"], x["status"]))))
    lists = lists.select(key, codes, F.transform(F.array_sort(each), lambda i: F.struct(
        i["code"].alias("code"), i["name"].alias("name"), i["status"].alias("status"))).alias(out))
    none = F.array().cast("array<struct<code:string,name:string,status:string>>")
    found = lists if bare else rows.join(lists.select(key, out), key, "left")
    return found.withColumn(out, F.coalesce(out, none)).select(*rows.columns, out)


def output_record(rows: DataFrame, orgs: DataFrame) -> DataFrame:
    """Entity rows with their predecessors and successors as objects, the JSON output form."""
    out = join_code_to_name(rows, orgs, "predecessor_codes", out="predecessors")
    return join_code_to_name(out, orgs, "successor_codes", out="successors")


def anti_unlinked(orgs: DataFrame, rels: DataFrame) -> DataFrame:
    """Active entities in no relationship, at either end."""
    linked = linked_codes(rels)
    return orgs.where("status = 'active'").join(linked, "ods_code", "left_anti")


def linked_codes(rels: DataFrame) -> DataFrame:
    """Source and target codes, distinct."""
    return rels.select(F.col("source_code").alias("ods_code")).union(rels.select("target_code")).distinct()


def targets_never_source(rels: DataFrame) -> DataFrame:
    """Codes that only ever appear as a target."""
    return rels.select(F.col("target_code").alias("ods_code")).distinct().join(
        rels.select(F.col("source_code").alias("ods_code")).distinct(), "ods_code", "left_anti")


def join_far_side_filter(rels: DataFrame, orgs: DataFrame) -> DataFrame:
    """Rows kept with and without an active filter on the joined side, in one join."""
    o = orgs.select(F.col("ods_code").alias("source_code"), F.col("status"))
    return rels.select("source_code").join(o, "source_code").agg(
        F.count_if(F.col("status") == "active").alias("filtered_rows"), F.count("*").alias("all_rows"))


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on every shared column name, as NATURAL JOIN does (NULLs never match)."""
    return left.join(right, [c for c in left.columns if c in right.columns])


def natural_join_trap(roles: DataFrame, orgs: DataFrame) -> DataFrame:
    """Rows of the key join beside those of the natural join."""
    keyed = roles.join(orgs.select("ods_code"), "ods_code").agg(F.count("*").alias("n"))
    natural = natural_join(roles, orgs).agg(F.count("*").alias("n"))
    return keyed.select(F.lit("using_key").alias("join_form"), "n").union(
        natural.select(F.lit("natural").alias("join_form"), "n"))


def join_roles_dup(orgs: DataFrame, roles: DataFrame, role_code: str) -> DataFrame:
    """Rows against distinct entities when a role filter goes through the holdings table."""
    held = roles.where(F.col("role_code") == role_code).select("ods_code")
    return orgs.where("status = 'active'").select("ods_code").join(held, "ods_code").agg(
        F.count("*").alias("n_rows"), F.count_distinct("ods_code").alias("orgs"))


def class_as_target(rels: DataFrame, orgs: DataFrame, record_class: str = "site") -> DataFrame:
    """Relationships whose target is of one record class."""
    o = orgs.where(F.col("record_class") == record_class).select(F.col("ods_code").alias("target_code"))
    return rels.join(o, "target_code", "left_semi").agg(F.count("*").alias("n"))


def rollup_two_hop(rels: DataFrame, first: str = COMMISSIONED_BY, second: str = COMMISSIONED_BY) -> DataFrame:
    """Source -> the body its target belongs to, through a second relationship; counts per body.

    Both sides are counted per middle code before the join, so a busy middle code
    meets one row per side instead of all pairs.
    """
    act = rels.where("rel_status = 'active'")
    up = act.where(F.col("rel_code") == first).groupBy(F.col("target_code").alias("middle")).agg(
        F.count("*").alias("sources"))
    over = act.where(F.col("rel_code") == second).select(F.col("source_code").alias("middle"),
                                                         F.col("target_code").alias("body")).distinct()
    return up.join(over, "middle").groupBy("body").agg(F.sum("sources").alias("sources"),
                                                       F.count("*").alias("sub_units"))


def no_commissioner(orgs: DataFrame, rels: DataFrame, role_code: str, rel_code: str = COMMISSIONED_BY) -> DataFrame:
    """Active holders of a role without an active relationship of one type."""
    have = rels.where((F.col("rel_status") == "active") & (F.col("rel_code") == rel_code)).select(
        F.col("source_code").alias("ods_code")).distinct()
    holders = orgs.where((F.col("status") == "active") & F.array_contains("role_codes", role_code))
    return holders.select("ods_code", "name").join(have, "ods_code", "left_anti")


def operated_sites(orgs: DataFrame, rels: DataFrame, target: str, rel_code: str = OPERATED_BY) -> DataFrame:
    """Active entities a body operates."""
    r = rels.where((F.col("target_code") == target) & (F.col("rel_code") == rel_code)
                   & (F.col("rel_status") == "active")).select(F.col("source_code").alias("ods_code"))
    return orgs.where("status = 'active'").select("ods_code", "name").join(r, "ods_code")


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def intersect_keys(left: DataFrame, right: DataFrame, key: str = "ods_code") -> DataFrame:
    return left.select(key).intersect(right.select(key))
