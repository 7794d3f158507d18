"""Checks of tables against their source and against fixed invariants.

A check is a row ``(check_name, n, sample)``: how many rows break it, and the least
offending key. Zero passes. Checks that share an input share one pass over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook import schemas
from rollbook.functions.dates import last_of_type
from rollbook.functions.roles import all_low_signal
from rollbook.operators.build import first_contact, primary_role, primary_role_code, role_codes
from rollbook.operators.graph import closure_verify


def check(df: DataFrame, name: str, sample: str, weight: Column | None = None) -> DataFrame:
    """One check row from the offending rows."""
    n = F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    return df.agg(n.cast("bigint").alias("n"), F.min(F.col(sample).cast("string")).alias("sample")).select(
        F.lit(name).alias("check_name"), "n", "sample")


def checks_in_one_pass(df: DataFrame, sample: str, rules: dict[str, Column], weights: dict[str, Column] | None = None) -> DataFrame:
    """Several row-level checks over one input in a single aggregate; ``weights`` counts a row more than once."""
    weights = weights or {}
    count = lambda k, c: F.coalesce(F.sum(F.when(c, weights[k])), F.lit(0)).cast("bigint") if k in weights else F.count_if(c)
    flat = [F.struct(count(k, c).alias("n"), F.min(F.when(c, F.col(sample).cast("string"))).alias("sample")).alias(f"c{i}")
            for i, (k, c) in enumerate(rules.items())]
    one = df.agg(*flat)
    rows = F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(f"c{i}")["n"].alias("n"), F.col(f"c{i}")["sample"].alias("sample"))
                     for i, k in enumerate(rules)])
    return one.select(F.explode(rows).alias("c")).select("c.*")


# --- source invariants --------------------------------------------------------------------


def dup_ids(ids: DataFrame, id_column: str, name: str) -> DataFrame:
    """Occurrences beyond the first of each id; blanks ignored."""
    per = ids.where(F.coalesce(F.col(id_column), F.lit("")) != "").groupBy(id_column).agg(F.count("*").alias("c"))
    return check(per.where("c > 1"), name, id_column, F.col("c") - 1)


def dangling(targets: DataFrame, target: str, entities: DataFrame, code: str, name: str) -> DataFrame:
    """Targets that are no entity; every occurrence counts. Occurrences are counted per code first."""
    per = targets.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("c"))
    lost = per.join(entities.select(F.col(code).alias(target)), target, "left_anti")
    return check(lost, name, target, F.col("c"))


def primary_role_mismatch(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Stated primary role of a target against the target's own. ``refs``: target, target_role; ``entities``: code, primary."""
    per = refs.where("target_role IS NOT NULL").groupBy("target", "target_role").agg(F.count("*").alias("c"))
    both = per.join(entities.select(F.col("code").alias("target"), "primary"), "target")
    return check(both.where("primary <> target_role"), "primary_role_mismatch", "target", F.col("c"))


def unknown_role_concepts(codes: DataFrame, concepts: DataFrame, code: str = "role_code") -> DataFrame:
    """Role codes missing from the code system; skipped (zero) when the source lists none."""
    per = codes.groupBy(code).agg(F.count("*").alias("c"))
    listed = concepts.agg(F.count("*")).scalar()
    lost = per.join(concepts.select(F.col("code").alias(code)), code, "left_anti").where(listed > 0)
    return check(lost, "unknown_role_concepts", code, F.col("c"))


def date_order_bad(start: Column, end: Column) -> Column:
    return F.coalesce(end < start, F.lit(False))


def entity_invariants(entities: DataFrame) -> DataFrame:
    """Row-level rules on source entities, one pass: dates, statuses as written, missing ends.

    Dates are compared as written, block by block; an entity with several bad blocks counts each.
    """
    status = F.coalesce("status", F.lit("Active"))
    operational = last_of_type("dates", "operational")
    bad_blocks = F.size(F.filter("dates", lambda d: d["date_type"].isNotNull() & date_order_bad(d["start"], d["end"])))
    return checks_in_one_pass(entities, "code", {
        "invalid_date_order": bad_blocks > 0,
        "missing_operational_date": operational.isNull(),
        "invalid_status": ~status.isin("Active", "Inactive"),
        "inactive_without_end": (F.lower(status) != "active") & operational["end"].isNull(),
    }, weights={"invalid_date_order": bad_blocks})


def invalid_succ_type(succs: DataFrame) -> DataFrame:
    """Succession types other than Predecessor and Successor. ``succs``: code, type."""
    return checks_in_one_pass(succs, "code", {"invalid_succ_type": ~F.coalesce(
        F.col("type").isin("Predecessor", "Successor"), F.lit(False))})


def source_audit(entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """All source invariants of a release's merged entities."""
    roles = entities.select("code", F.explode("roles").alias("r")).select("code", "r.role_id", F.col("r.id").alias("role_code"))
    rels = entities.select("code", F.explode("rels").alias("r")).select("code", "r.rel_id", "r.target", "r.target_role")
    succs = entities.select("code", F.explode("succs").alias("s")).select("code", "s.type", "s.target")
    primary = entities.select("code", primary_role("roles")["id"].alias("primary"))
    return reduce(DataFrame.unionByName, [
        dup_ids(roles, "role_id", "dup_role_ids"), dup_ids(rels, "rel_id", "dup_rel_ids"),
        dangling(rels, "target", entities, "code", "dangling_rel_targets"),
        dangling(succs, "target", entities, "code", "dangling_succ_targets"),
        primary_role_mismatch(rels, primary), unknown_role_concepts(roles, concepts),
        entity_invariants(entities), invalid_succ_type(succs)])


# --- parity with the source ---------------------------------------------------------------


def count_parity(entities: DataFrame, orgs: DataFrame, roles: DataFrame, rels: DataFrame, succs: DataFrame) -> DataFrame:
    """Source counts beside table counts: ``measure, source_n, table_n, ok``."""
    active = lambda c: F.count_if(F.lower(c) == "active")
    src = entities.agg(F.count("*").alias("orgs"), active("status").alias("active_orgs"),
                       F.sum(F.size("roles")).alias("roles"), F.sum(F.size("rels")).alias("relationships"))
    ids = entities.select(F.explode("succs").alias("s")).agg(F.count_distinct("s.succ_id").alias("n"))
    measure = lambda name, a, b: a.select(F.lit(name).alias("measure"), F.lit("source").alias("side"), F.col(b).alias("n"))
    table = lambda name, df, c: df.agg(c.alias("n")).select(F.lit(name).alias("measure"), F.lit("table").alias("side"), "n")
    rows = reduce(DataFrame.union, [
        src.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit("source").alias("side"),
                                                F.col(m).cast("bigint").alias("n"))
                                       for m in ("orgs", "active_orgs", "roles", "relationships")])).alias("x")).select("x.*"),
        measure("successions", ids, "n"),
        table("orgs", orgs, F.count("*")), table("active_orgs", orgs, active("status")), table("roles", roles, F.count("*")),
        table("relationships", rels, F.count("*")), table("successions", succs, F.count("*"))])
    wide = rows.groupBy("measure").agg(F.max(F.when(F.col("side") == "source", F.col("n"))).alias("source_n"),
                                       F.max(F.when(F.col("side") == "table", F.col("n"))).alias("table_n"))
    return wide.withColumn("ok", F.col("source_n") == F.col("table_n"))


VERBATIM = ["name", "status", "record_class", "primary_role_code", "town", "county", "country", "uprn", "telephone", "website"]


def field_parity(source: DataFrame, orgs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Fields whose table value differs from the source's, ignoring case, where the source has one."""
    fields = fields or VERBATIM
    pack = lambda df, name: df.select("ods_code", F.struct(*fields).alias(name))
    both = pack(source, "s").join(pack(orgs, "t"), "ods_code")
    bad = lambda f: (F.coalesce(F.col(f"s.{f}"), F.lit("")) != "") & (
        F.lower(f"s.{f}") != F.lower(F.coalesce(F.col(f"t.{f}"), F.lit(""))))
    rows = F.array_compact(F.array(*[F.when(bad(f), F.struct(
        F.lit(f).alias("field"), F.col(f"s.{f}").alias("source_value"), F.col(f"t.{f}").alias("table_value")))
        for f in fields]))
    return both.select("ods_code", F.explode(rows).alias("d")).select("ods_code", "d.*")


def missing_rows(source: DataFrame, orgs: DataFrame) -> DataFrame:
    """Entities of the source that the table lacks."""
    return source.select("ods_code").join(orgs.select("ods_code"), "ods_code", "left_anti")


def derived_parity(source: DataFrame, orgs: DataFrame) -> DataFrame:
    """Derived columns recomputed: postcode spacing, first address part, role set. One row per mismatch."""
    s = source.select("ods_code", F.struct(F.trim(F.regexp_replace("postcode", "\\s+", " ")).alias("postcode"),
                                           F.col("address_first"), F.array_sort(F.array_distinct("role_codes"))
                                           .alias("role_codes")).alias("s"))
    t = orgs.select("ods_code", F.struct("postcode", "address", F.array_sort(F.array_distinct("role_codes"))
                                         .alias("role_codes")).alias("t"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    bad = {"postcode": F.col("s.postcode").isNotNull() & (F.upper("s.postcode") != F.upper(blank(F.col("t.postcode")))),
           "address": F.col("s.address_first").isNotNull() & ~blank(F.col("t.address")).contains(F.col("s.address_first")),
           "role_codes": F.col("s.role_codes") != F.col("t.role_codes")}
    rows = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in bad.items()]))
    return s.join(t, "ods_code").select("ods_code", F.explode(rows).alias("field"))


def audit_source_view(entities: DataFrame) -> DataFrame:
    """Merged, normalised source entities in the shape the parity checks compare."""
    return entities.select(
        F.col("code").alias("ods_code"), "name", "status", "record_class", primary_role_code().alias("primary_role_code"),
        "town", "county", "country", "uprn", first_contact("tel").alias("telephone"), first_contact("http").alias("website"),
        "postcode", F.try_element_at(F.filter("address_lines", lambda a: F.trim(a) != ""), F.lit(1)).alias("address_first"),
        role_codes().alias("role_codes"))


def merge_flags(records: DataFrame, merged: DataFrame, fate: DataFrame) -> DataFrame:
    """The merge stated twice: codes where the aggregate's survivor and the staged survivor differ.

    ``merged``: from ``build.merge_entities``; ``fate``: from ``build.merge_fate``.
    """
    key = ["code", "file_index", "ref_only", "op_start"]
    staged = fate.where(F.col("fate").isin("kept", "stub kept")).select(*key)
    a = merged.select("code", F.struct(*key[1:]).alias("a")).groupBy("code").agg(F.min("a").alias("a"))
    b = staged.groupBy("code").agg(F.min(F.struct(*key[1:])).alias("b"), F.count("*").alias("survivors"))
    both = a.join(b, "code", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b")) | (F.col("survivors") > 1)).select("code", "survivors")


# --- table invariants ---------------------------------------------------------------------


def pk_unique(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows beyond the first of each key."""
    per = df.groupBy(key).agg(F.count("*").alias("c"))
    return check(per.where("c > 1"), name, key, F.col("c") - 1)


def fk_missing(rows: DataFrame, columns: list[str], orgs: DataFrame, name: str, row_id: str) -> DataFrame:
    """Rows with any of their code columns pointing at no entity; a row counts once, blanks are ignored.

    The distinct codes are matched with the entities first. Those without one are few in a
    sound register, so the rows then meet a small table and are not shuffled.
    """
    codes = rows.select(F.explode(F.array_distinct(F.array(*columns))).alias("code")).where("code <> ''").distinct()
    unknown = codes.join(orgs.select(F.col("ods_code").alias("code")), "code", "left_anti")
    out, lost = rows.select(row_id, *columns), F.lit(False)
    for i, c in enumerate(columns):
        out = out.join(unknown.select(F.col("code").alias(c), F.lit(True).alias(f"_u{i}")), c, "left")
        lost = lost | F.col(f"_u{i}").isNotNull()
    return check(out.where(lost), name, row_id)


def vocab_names(roles: DataFrame, vocab: DataFrame) -> DataFrame:
    """Role rows whose name is not the curated one, or whose code is unknown; counted per code and name first."""
    per = roles.groupBy("role_code", "role_name").agg(F.count("*").alias("c"))
    v = vocab.select("role_code", F.col("role_name").alias("curated"))
    bad = per.join(v, "role_code", "left").where("curated IS NULL OR curated <> role_name")
    return check(bad, "vocab_names", "role_code", F.col("c"))


def list_alignment(orgs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Role lists of different length (once per entity), or names that are not the curated ones (per position)."""
    same = F.size("role_codes") == F.size("role_names")
    uneven = orgs.where(~same).select("ods_code", F.lit(1).alias("c"))
    pairs = orgs.where(same).select("ods_code", F.explode(F.arrays_zip(F.col("role_codes").alias("code"),
                                                                       F.col("role_names").alias("name"))).alias("p"))
    per = pairs.groupBy("p.code", "p.name").agg(F.count("*").alias("c"), F.min("ods_code").alias("ods_code"))
    v = vocab.select(F.col("role_code").alias("code"), F.col("role_name").alias("curated"))
    wrong = per.join(v, "code", "left").where("curated IS NULL OR curated <> name").select("ods_code", "c")
    return check(uneven.union(wrong), "list_alignment", "ods_code", F.col("c"))


def not_null(df: DataFrame, columns: list[str], sample: str, table: str) -> DataFrame:
    """Required columns that hold NULL, all columns in one pass."""
    return checks_in_one_pass(df, sample, {f"not_null:{table}.{c}": F.col(c).isNull() for c in columns})


def schema_contract(spark, actual: T.StructType, table: str) -> DataFrame:
    """Columns whose name, position or type differ from the contract."""
    want = [(p, f.name, f.dataType.simpleString()) for p, f in enumerate(schemas.TABLES[table])]
    have = [(p, f.name, f.dataType.simpleString()) for p, f in enumerate(actual)]
    rows = [(table, *x, "missing") for x in want if x not in have] + [(table, *x, "unexpected") for x in have if x not in want]
    return spark.createDataFrame(rows, "table_name string, position int, field string, type string, problem string")


def low_signal_only(orgs: DataFrame) -> DataFrame:
    """Entities all of whose roles are low-signal: total and active."""
    only = all_low_signal("role_codes")
    return orgs.agg(F.count_if(only).alias("total"), F.count_if(only & (F.col("status") == "active")).alias("active"))


def name_case_drift(orgs: DataFrame) -> DataFrame:
    """Names whose matching form changes when upper-cased first."""
    late = F.regexp_replace("name", "[^A-Z0-9]", "")
    early = F.regexp_replace(F.upper("name"), "[^A-Z0-9]", "")
    return orgs.where(late != early).select("ods_code", "name")


def sample_first(records: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` records in document order: a top-k, kept per task before the merge."""
    return records.orderBy(*order).limit(n)


def sample_spread(records: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """A sample without a sort, for large sources."""
    return records.sample(fraction=fraction, seed=seed)


def table_audit(orgs: DataFrame, roles: DataFrame, rels: DataFrame, succs: DataFrame, vocab: DataFrame,
                pairs: DataFrame | None = None) -> DataFrame:
    """All table invariants of one release as check rows."""
    tables = {"orgs": orgs, "roles": roles, "relationships": rels, "successions": succs}
    parts = [pk_unique(df, schemas.PRIMARY_KEYS[t], f"pk_unique:{t}") for t, df in tables.items()]
    parts += [fk_missing(tables[t], cols, orgs, f"fk:{t}", schemas.PRIMARY_KEYS[t]) for t, cols in schemas.FOREIGN_KEYS.items()]
    parts += [vocab_names(roles, vocab), list_alignment(orgs, vocab)]
    for t, df in tables.items():
        parts.append(not_null(df, [f.name for f in schemas.TABLES[t] if not f.nullable and f.name in df.columns],
                              schemas.PRIMARY_KEYS[t], t))
    if pairs is not None:
        parts.append(check(closure_verify(orgs, pairs), "closures", "ods_code"))
    return reduce(DataFrame.unionByName, parts)


def audit_report(checks: DataFrame) -> DataFrame:
    """Totals and verdict of a set of checks."""
    return checks.agg(F.count("*").alias("checks"), F.count_if(F.col("n") > 0).alias("failed"),
                      F.sum("n").alias("discrepancies")).withColumn("passed", F.col("failed") == 0)


def audit_series(orgs: DataFrame, roles: DataFrame, releases: DataFrame, date: str = "publication_date") -> DataFrame:
    """Every release in one job: ``pass``, ``fail``, or ``skipped`` when it has no rows.

    Key and reference checks grouped by publication date. ``releases``: the dates to report.
    """
    dup = orgs.groupBy(date, "ods_code").agg(F.count("*").alias("c")).groupBy(date).agg(
        F.sum("c").alias("entities"), F.sum(F.col("c") - 1).alias("dup_keys"))
    known = orgs.select(date, "ods_code").distinct()
    lost = roles.join(known, [date, "ods_code"], "left_anti").groupBy(date).agg(F.count("*").alias("lost_roles"))
    out = releases.select(date).join(dup, date, "left").join(lost, date, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    verdict = (F.when(F.col("entities").isNull(), "skipped").when(zero("dup_keys") + zero("lost_roles") > 0, "fail")
               .otherwise("pass"))
    return out.select(date, zero("entities").alias("entities"), zero("dup_keys").alias("dup_keys"),
                      zero("lost_roles").alias("lost_roles"), verdict.alias("verdict"))


# --- every check of every release in one job ----------------------------------------------------


def _row_rules(name: str, df: DataFrame) -> dict[str, Column]:
    """What each row of a table must not be, by check name."""
    rules = {f"not_null:{name}.{f.name}": F.col(f.name).isNull() for f in schemas.TABLES[name] if not f.nullable and f.name in df.columns}
    if "legal_end" in df.columns:
        rules[f"date_order:{name}"] = date_order_bad(F.col("legal_start"), F.col("legal_end")) | date_order_bad(
            F.col("operational_start"), F.col("operational_end"))
    if name == "orgs":
        rules["primary_in_roles"] = F.coalesce(~F.array_contains("role_codes", F.col("primary_role_code")), F.lit(False))
        rules["lists_aligned"] = F.coalesce(F.size("role_codes") != F.size("role_names"), F.lit(False))
    return rules


def _as_rows(df: DataFrame, date: str, counters: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``date, check_name, n, sample`` from one aggregate by date, whatever the number of checks."""
    one = df.groupBy(date).agg(*[F.struct(F.lit(k).alias("check_name"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n"), sample.alias("sample"))
                                 .alias(f"c{i}") for i, (k, (n, sample)) in enumerate(counters.items())])
    return one.select(date, F.explode(F.array(*[f"c{i}" for i in range(len(counters))])).alias("c")).select(date, "c.*")


def _table_checks(name: str, df: DataFrame, date: str) -> tuple[list[str], DataFrame]:
    """Names and rows of the checks of one table: rows beyond the first of a key, and all row rules."""
    key, rules = schemas.PRIMARY_KEYS[name], _row_rules(name, df)
    per = df.groupBy(date, F.col(key).cast("string").alias("key")).agg(
        F.count("*").alias("rows"), *[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    again = F.col("key").isNotNull() & (F.col("rows") > 1)
    counters = {f"pk_unique:{name}": (F.sum(F.when(again, F.col("rows") - 1)), F.min(F.when(again, F.col("key"))))}
    for i, k in enumerate(rules):
        counters[k] = (F.sum(f"r{i}"), F.min(F.when(F.col(f"r{i}") > 0, F.col("key"))))
    # texts are compared in sorted rows, so keys that break nothing stay out of the sort by date
    bad = reduce(Column.__or__, [F.col(f"r{i}") > 0 for i in range(len(rules))], again)
    return list(counters), _as_rows(per.where(bad), date, counters)


def _reference_checks(tables: dict[str, DataFrame], date: str) -> tuple[list[str], DataFrame]:
    """References to no entity of the same release, each counted. Entities and references meet in one aggregate by code."""
    names = [t for t in schemas.FOREIGN_KEYS if t in tables]
    codes = tables["orgs"].select(date, F.col("ods_code").alias("code"), F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("key"))
    for i, t in enumerate(names):
        codes = codes.unionByName(tables[t].select(date, F.explode(F.array(*schemas.FOREIGN_KEYS[t])).alias("code"), F.lit(i).alias("kind"),
                                                   F.col(schemas.PRIMARY_KEYS[t]).cast("string").alias("key")))
    of = lambda t: F.col("kind") == (names.index(t) if t in names else -1)
    # least keys are texts, so rows are sorted: by code first, as nearly all rows would be equal by date and compared twice
    per = codes.where("code IS NOT NULL").groupBy("code", date).agg(
        F.count_if(of("orgs")).alias("known"), *[F.count_if(of(t)).alias(f"n_{t}") for t in names],
        *[F.min(F.when(of(t), F.col("key"))).alias(f"s_{t}") for t in names])
    return [f"fk:{t}" for t in names], _as_rows(per.where("known = 0"), date, {f"fk:{t}": (F.sum(f"n_{t}"), F.min(f"s_{t}")) for t in names})


def release_checks(tables: dict[str, DataFrame], releases: DataFrame, date: str = "publication_date") -> DataFrame:
    """Every check of every release, in one job: ``date, check_name, n, sample``, sample being the least offending key.

    ``tables`` holds the four tables by name, over all releases. Keys, required values, order of dates and role lists take one
    pass over each table, references one more; counters are added up by key or code before they meet by date, so neither a
    release nor a code that holds most rows is ever in one task as rows. Releases without entities have no
    rows here; the others have one row a check, passed or not. Rows of dates that are no release are left out.
    """
    parts = [_table_checks(t, df, date) for t, df in tables.items()] + [_reference_checks(tables, date)]
    built = releases.select(date).distinct().join(tables["orgs"].select(date).distinct(), date, "left_semi")
    every = built.select(date, F.explode(F.array(*[F.lit(k) for names, _ in parts for k in names])).alias("check_name"))
    found = reduce(DataFrame.unionByName, [rows for _, rows in parts])
    return every.join(found, [date, "check_name"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def release_verdicts(checks: DataFrame, releases: DataFrame, date: str = "publication_date") -> DataFrame:
    """One row a release: checks made and failed, discrepancies, and ``pass``, ``fail`` or ``skipped``."""
    per = checks.groupBy(date).agg(F.count("*").alias("checks"), F.count_if(F.col("n") > 0).alias("failed"), F.sum("n").alias("discrepancies"))
    verdict = F.when(F.col("checks").isNull(), "skipped").when(F.col("failed") > 0, "fail").otherwise("pass")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return releases.select(date).distinct().join(per, date, "left").select(date, zero("checks"), zero("failed"), zero("discrepancies"), verdict.alias("verdict"))
