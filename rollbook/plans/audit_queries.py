"""Audit queries (group A). Every check is a row ``check_name, n, sample``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook import schemas
from rollbook.operators import audit as A
from rollbook.operators import build as B
from rollbook.operators import graph as G
from rollbook.plans import written
from rollbook.plans.registry import plan
from rollbook.plans.source_queries import _STATUS, _SUCC
from rollbook.runtime import checkpoint, scratch_path
from rollbook.sources import files as files_
from rollbook.sources import xml


def _check(name: str, rows: str, key: str, n: str = "count(*)") -> str:
    return f"SELECT '{name}' AS check_name, cast(coalesce({n}, 0) as bigint) AS n, min({key}) AS sample FROM {rows}"


@plan("a1_dup_role_ids", _check("dup_role_ids", "(SELECT succession_id AS id, count(*) AS c FROM <successions> GROUP BY 1 UNION ALL "
                                "SELECT rel_id, count(*) FROM <relationships> GROUP BY 1 HAVING count(*) > 1) x WHERE c > 1", "id", "sum(c - 1)"))
def _(t):
    ids = t.successions.select(F.col("succession_id").alias("id")).union(t.relationships.select("rel_id"))
    return A.dup_ids(ids, "id", "dup_role_ids")


@plan("a2_dup_rel_ids", _check("dup_rel_ids", "(SELECT concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) AS id, count(*) AS c "
                               "FROM <lineitem> GROUP BY 1) x WHERE c > 1", "id", "sum(c - 1)"))
def _(t):
    ids = t.lineitem.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"))
    return A.dup_ids(ids, "id", "dup_rel_ids")


@plan("a3_dangling_rel_targets", _check("dangling_rel_targets", "<relationships> WHERE target_code NOT IN (SELECT ods_code FROM <orgs>)", "target_code"))
def _(t):
    return A.dangling(t.relationships, "target_code", t.orgs, "ods_code", "dangling_rel_targets")


@plan("a4_dangling_succ_targets", _check("dangling_succ_targets", "<xml_kept> WHERE NOT ref_only AND succ_type IS NOT NULL AND succ_target NOT IN "
                                         "(SELECT code FROM <xml_kept>)", "succ_target"))
def _(t):
    succs = t.xml_kept.where("NOT ref_only AND succ_type IS NOT NULL").select("succ_target")
    return A.dangling(succs, "succ_target", t.xml_kept, "code", "dangling_succ_targets")


@plan("a5_primary_role_mismatch", _check("primary_role_mismatch", "<xml_kept> r JOIN <xml_kept> e ON e.code = r.rel1_target WHERE NOT r.ref_only AND "
                                         "r.rel1_role IS NOT NULL AND NOT e.ref_only AND e.role1 <> r.rel1_role", "r.rel1_target"))
def _(t):
    refs = t.xml_kept.where("NOT ref_only").select(F.col("rel1_target").alias("target"), F.col("rel1_role").alias("target_role"))
    return A.primary_role_mismatch(refs, t.xml_kept.where("NOT ref_only").select("code", F.col("role1").alias("primary")))


@plan("a6_unknown_role_concepts", _check("unknown_role_concepts", "<roles> WHERE role_code NOT IN (SELECT role_code FROM <vocab>)", "role_code"))
def _(t):
    return A.unknown_role_concepts(t.roles, t.vocab.select(F.col("role_code").alias("code")))


_LEGAL_BAD = "(NOT ref_only AND legal_end < legal_start)"
_OP_BAD = "(NOT ref_only AND op_end < op_start)"


def _records(t):
    return xml.scan_xml_release(t.spark, written.xml_release(t)).withColumn("op_start", B.operational_start())


@plan("a7_to_a11_entity_invariants", " UNION ALL ".join([
    _check("invalid_date_order", f"<xml_kept> WHERE {_LEGAL_BAD} OR {_OP_BAD}", "code", "sum(CASE WHEN legal_end < legal_start THEN 1 ELSE 0 END + CASE WHEN op_end < op_start THEN 1 ELSE 0 END)"),
    _check("missing_operational_date", "<xml_kept> WHERE ref_only", "code"),
    _check("invalid_status", "<xml_kept> WHERE coalesce(status, 'Active') NOT IN ('Active', 'Inactive')", "code"),
    _check("inactive_without_end", "<xml_kept> WHERE status = 'Inactive' AND (ref_only OR op_end IS NULL)", "code")]))
def _(t):
    return A.entity_invariants(B.merge_entities(_records(t)))


@plan("a7_invalid_date_order", _check("invalid_date_order", "<orgs> WHERE legal_end < legal_start OR operational_end < operational_start", "ods_code"))
def _(t):
    bad = A.date_order_bad(F.col("legal_start"), F.col("legal_end")) | A.date_order_bad(F.col("operational_start"), F.col("operational_end"))
    return A.checks_in_one_pass(t.orgs, "ods_code", {"invalid_date_order": bad})


@plan("a8_missing_operational_date", _check("missing_operational_date", "<relationships> WHERE operational_start IS NULL OR operational_end IS NULL", "rel_id"))
def _(t):
    return A.checks_in_one_pass(t.relationships, "rel_id", {
        "missing_operational_date": F.col("operational_start").isNull() | F.col("operational_end").isNull()})


@plan("a9_invalid_status", _check("invalid_status", "<orders> WHERE o_orderstatus NOT IN ('O', 'F')", "cast(o_orderkey as string)"))
def _(t):
    return A.checks_in_one_pass(t.orders, "o_orderkey", {"invalid_status": ~F.col("o_orderstatus").isin("O", "F")})


@plan("a10_invalid_succ_type", _check("invalid_succ_type", "(SELECT code, CASE WHEN k % 15 = 2 THEN lower(succ_type) ELSE succ_type END AS ty FROM <xml_kept> "
                                      "WHERE succ_type IS NOT NULL) x WHERE ty NOT IN ('Predecessor', 'Successor')", "code"))
def _(t):
    low = F.when(F.col("k") % 15 == 2, F.lower("succ_type")).otherwise(F.col("succ_type"))
    return A.invalid_succ_type(t.xml_kept.where("succ_type IS NOT NULL").select("code", low.alias("type")))


@plan("a11_inactive_without_end", _check("inactive_without_end", "<orgs> WHERE status = 'inactive' AND operational_end IS NULL", "ods_code"))
def _(t):
    return A.checks_in_one_pass(t.orgs, "ods_code", {
        "inactive_without_end": (F.col("status") == "inactive") & F.col("operational_end").isNull()})


@plan("a_source_audit", " UNION ALL ".join([
    _check("dup_role_ids", "(SELECT 1 AS c, '' AS id) x WHERE c > 1", "id"), _check("dup_rel_ids", "(SELECT 1 AS c, '' AS id) x WHERE c > 1", "id"),
    _check("dangling_rel_targets", "(SELECT rel1_target AS x FROM <xml_kept> WHERE NOT ref_only UNION ALL SELECT rel2_target FROM <xml_kept> WHERE NOT ref_only "
           "AND rel2_target IS NOT NULL) r WHERE x NOT IN (SELECT code FROM <xml_kept>)", "x"),
    _check("dangling_succ_targets", "<xml_kept> WHERE NOT ref_only AND succ_type IS NOT NULL AND succ_target NOT IN (SELECT code FROM <xml_kept>)", "succ_target"),
    _check("primary_role_mismatch", "<xml_kept> r JOIN <xml_kept> e ON e.code = r.rel1_target WHERE NOT r.ref_only AND r.rel1_role IS NOT NULL AND NOT e.ref_only "
           "AND e.role1 <> r.rel1_role", "r.rel1_target"),
    _check("unknown_role_concepts", "(SELECT 1 AS c, '' AS id) x WHERE c > 1", "id"),
    _check("invalid_date_order", f"<xml_kept> WHERE {_LEGAL_BAD} OR {_OP_BAD}", "code", "sum(CASE WHEN legal_end < legal_start THEN 1 ELSE 0 END + CASE WHEN op_end < op_start THEN 1 ELSE 0 END)"), _check("missing_operational_date", "<xml_kept> WHERE ref_only", "code"),
    _check("invalid_status", "<xml_kept> WHERE coalesce(status, 'Active') NOT IN ('Active', 'Inactive')", "code"),
    _check("inactive_without_end", "<xml_kept> WHERE status = 'Inactive' AND (ref_only OR op_end IS NULL)", "code"),
    _check("invalid_succ_type", "(SELECT 1 AS c, '' AS id) x WHERE c > 1", "id")]))
def _(t):
    paths = written.xml_release(t)
    records = xml.scan_xml_release(t.spark, paths).withColumn("op_start", B.operational_start())
    return A.source_audit(checkpoint(B.merge_entities(records)), checkpoint(xml.scan_xml_concepts(t.spark, paths)))


def _built(t):
    """Source entities and the tables built from them, with faults: some rows lost, some changed."""
    e = checkpoint(B.normalise_entities(B.merge_entities(_records(t))))
    orgs = B.project_orgs(e, t.vocab, e.select(F.col("code").alias("ods_code"), F.array().cast("array<string>").alias("successor_codes")),
                          e.select(F.col("code").alias("ods_code"), F.array().cast("array<string>").alias("predecessor_codes")), written.PUBLISHED)
    num = F.substring("ods_code", 2, 20).cast("bigint")
    hurt = orgs.where(num % 53 != 3).withColumn("town", F.when(num % 31 == 2, F.lit("ELSEWHERE")).otherwise(F.lower("town"))) \
        .withColumn("telephone", F.when(num % 37 == 5, F.lit(None)).otherwise(F.col("telephone"))) \
        .withColumn("postcode", F.when(num % 41 == 6, F.lit("Q1 1QQ")).otherwise(F.col("postcode"))) \
        .withColumn("address", F.when(num % 43 == 7, F.lit("NOWHERE")).otherwise(F.col("address"))) \
        .withColumn("role_codes", F.when(num % 47 == 8, F.array_append("role_codes", F.lit("RO1"))).otherwise(F.col("role_codes")))
    return e, hurt


_COUNTS = {
    "orgs": ("SELECT count(*) FROM <xml_kept>", "SELECT count(*) FROM <xml_kept> WHERE k % 53 <> 3"),
    "active_orgs": (f"SELECT count(*) FROM <xml_kept> WHERE {_STATUS} = 'active'", f"SELECT count(*) FROM <xml_kept> WHERE {_STATUS} = 'active' AND k % 53 <> 3"),
    "roles": ("SELECT count(*) + count(role2) FROM <xml_kept> WHERE NOT ref_only",) * 2,
    "relationships": ("SELECT count(*) + count(rel2_target) FROM <xml_kept> WHERE NOT ref_only",) * 2,
    "successions": ("SELECT count(DISTINCT succ_id) FROM <xml_kept> WHERE NOT ref_only AND succ_type IS NOT NULL",) * 2,
}


@plan("a12_count_parity", "SELECT *, source_n = table_n AS ok FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, ({a}) AS source_n, ({b}) AS table_n" for m, (a, b) in _COUNTS.items()) + ") x")
def _(t):
    e, orgs = _built(t)
    none = e.select(F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("display_name")).limit(0)
    return A.count_parity(e, orgs, B.explode_roles(e, t.vocab, written.PUBLISHED), B.explode_relationships(e, none, written.PUBLISHED),
                          B.succession_edges(e, written.PUBLISHED))


@plan("a13_pk_unique", " UNION ALL ".join(
    _check(f"pk_unique:{tb}", f"(SELECT {k} AS id, count(*) AS c FROM <{tb}> GROUP BY 1) x WHERE c > 1", "id", "sum(c - 1)")
    for tb, k in schemas.PRIMARY_KEYS.items()))
def _(t):
    parts = [A.pk_unique(getattr(t, tb), k, f"pk_unique:{tb}") for tb, k in schemas.PRIMARY_KEYS.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_NOT_ORG = "NOT IN (SELECT ods_code FROM <orgs>)"


@plan("a14_fk_roles", _check("fk:roles", f"<roles> WHERE ods_code {_NOT_ORG}", "role_id"))
def _(t):
    return A.fk_missing(t.roles, ["ods_code"], t.orgs, "fk:roles", "role_id")


@plan("a15_fk_rels", _check("fk:relationships", f"<relationships> WHERE source_code {_NOT_ORG} OR target_code {_NOT_ORG}", "rel_id"))
def _(t):
    return A.fk_missing(t.relationships, ["source_code", "target_code"], t.orgs, "fk:relationships", "rel_id")


@plan("a16_fk_succs", _check("fk:successions", "<successions> WHERE predecessor_code NOT IN (SELECT ods_code FROM <orgs> WHERE status = 'active') OR "
                             "successor_code NOT IN (SELECT ods_code FROM <orgs> WHERE status = 'active')", "succession_id"))
def _(t):
    return A.fk_missing(t.successions, ["predecessor_code", "successor_code"], t.orgs.where("status = 'active'"), "fk:successions", "succession_id")


_VOCAB_BAD = "<roles> r LEFT JOIN <vocab> v USING (role_code) WHERE v.role_name IS NULL OR v.role_name <> r.role_name"


@plan("a17_vocab_names", _check("vocab_names", _VOCAB_BAD, "role_code"))
def _(t):
    return A.vocab_names(t.roles, t.vocab)


@plan("a18_list_alignment", f"""
    WITH o AS (SELECT ods_code, role_codes, CASE WHEN cast(substr(ods_code, 2) as bigint) % 45 = 10 THEN role_names[1:1]
      WHEN cast(substr(ods_code, 2) as bigint) % 45 = 11 THEN list_transform(role_names, lambda n: lower(n)) ELSE role_names END AS role_names FROM <orgs>)
    SELECT 'list_alignment' AS check_name, cast(sum(c) as bigint) AS n, min(ods_code) AS sample FROM (
      SELECT ods_code, 1 AS c FROM o WHERE len(role_codes) <> len(role_names)
      UNION ALL SELECT min(ods_code), count(*) FROM (SELECT ods_code, unnest(role_codes) AS code, unnest(role_names) AS name FROM o
        WHERE len(role_codes) = len(role_names)) p LEFT JOIN <vocab> ON role_code = code WHERE role_name IS NULL OR role_name <> name GROUP BY code, name) x""")
def _(t):
    num = F.substring("ods_code", 2, 20).cast("bigint")
    names = F.when(num % 45 == 10, F.slice("role_names", 1, 1)).when(num % 45 == 11, F.transform("role_names", lambda n: F.lower(n))) \
        .otherwise(F.col("role_names"))
    return A.list_alignment(t.orgs.withColumn("role_names", names), t.vocab)


_TOWN = "CASE WHEN k % 31 = 2 THEN 'ELSEWHERE' ELSE lower(town) END"


@plan("a19_field_parity", f"""
    SELECT code AS ods_code, 'town' AS field, town AS source_value, {_TOWN} AS table_value FROM <xml_kept>
    WHERE NOT ref_only AND town IS NOT NULL AND k % 53 <> 3 AND lower(town) <> lower({_TOWN})
    UNION ALL SELECT code, 'telephone', tel, NULL FROM <xml_kept> WHERE NOT ref_only AND tel IS NOT NULL AND k % 53 <> 3 AND k % 37 = 5""")
def _(t):
    e, orgs = _built(t)
    return A.field_parity(A.audit_source_view(e), orgs)


@plan("a20_derived_parity", f"""
    SELECT code AS ods_code, 'postcode' AS field FROM <xml_kept> WHERE NOT ref_only AND postcode IS NOT NULL AND k % 53 <> 3 AND k % 41 = 6
    UNION ALL SELECT code, 'address' FROM <xml_kept> WHERE NOT ref_only AND k % 53 <> 3 AND k % 43 = 7
    UNION ALL SELECT code, 'role_codes' FROM <xml_kept> WHERE k % 53 <> 3 AND k % 47 = 8""")
def _(t):
    e, orgs = _built(t)
    return A.derived_parity(A.audit_source_view(e), orgs)


@plan("a21_missing_rows", "SELECT code AS ods_code FROM <xml_kept> WHERE k % 53 = 3")
def _(t):
    e, orgs = _built(t)
    return A.missing_rows(A.audit_source_view(e), orgs)


@plan("a22_merge_flags", """
    WITH w AS (SELECT code, min(file_index) FILTER (WHERE NOT ref_only) AS win FROM <raw_records> GROUP BY 1),
    s AS (SELECT r.code, max(op_start) AS top FROM <raw_records> r JOIN w ON r.code = w.code AND r.file_index = win AND NOT ref_only GROUP BY 1)
    SELECT code, count(*) AS survivors FROM <raw_records> r JOIN w USING (code) LEFT JOIN s USING (code)
    WHERE (ref_only AND win IS NULL) OR (NOT ref_only AND file_index = win AND op_start IS NOT DISTINCT FROM top) GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    raw = t.raw_records
    return A.merge_flags(raw, B.merge_entities(raw), B.merge_fate(raw))


def _pub(c: str) -> str:
    return f"date '2001-08-01' + cast(cast(substr({c}, 2) as bigint) % 6 as int)"


@plan("a23_audit_all", f"""
    WITH o AS (SELECT ods_code, {_pub('ods_code')} AS d FROM <orgs> WHERE cast(substr(ods_code, 2) as bigint) % 18 <> 3
               UNION ALL SELECT ods_code, date '2001-08-01' + 1 FROM <orgs> WHERE cast(substr(ods_code, 2) as bigint) % 100 = 1),
    r AS (SELECT ods_code, {_pub('ods_code')} AS d FROM <roles> WHERE ods_code < 'X'),
    g AS (SELECT d, sum(c) AS entities, sum(c - 1) AS dup_keys FROM (SELECT d, ods_code, count(*) AS c FROM o GROUP BY 1, 2) x GROUP BY 1),
    l AS (SELECT d, count(*) AS lost_roles FROM r WHERE (d, ods_code) NOT IN (SELECT (d, ods_code) FROM o) GROUP BY 1),
    rel AS (SELECT date '2001-08-01' + cast(unnest(range(0, 8)) as int) AS d)
    SELECT d AS publication_date, cast(coalesce(entities, 0) as bigint) AS entities, cast(coalesce(dup_keys, 0) as bigint) AS dup_keys,
           coalesce(lost_roles, 0) AS lost_roles, CASE WHEN entities IS NULL THEN 'skipped' WHEN coalesce(dup_keys, 0) + coalesce(lost_roles, 0) > 0 THEN 'fail'
           ELSE 'pass' END AS verdict FROM rel LEFT JOIN g USING (d) LEFT JOIN l USING (d)""")
def _(t):
    num = F.substring("ods_code", 2, 20).cast("bigint")
    first = F.lit("2001-08-01").cast("date")
    day = F.date_add(first, (num % 6).cast("int"))
    orgs = t.orgs.where(num % 18 != 3).select("ods_code", day.alias("publication_date")).union(
        t.orgs.where(num % 100 == 1).select("ods_code", F.date_add(first, 1)))
    roles = t.roles.where("ods_code < 'X'").select("ods_code", day.alias("publication_date"))
    releases = t.region.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).distinct().select(
        F.date_add(first, F.col("i")).alias("publication_date"))
    return A.audit_series(orgs, roles, releases)


# all checks of six releases and two empty ones; the release of a row follows its code, so some targets lie in another one,
# and faults are planted by code. The same expressions build the tables on both sides.
def _num(c: str) -> str:
    return f"coalesce(try_cast(substr({c}, 2) as bigint), 0)"


_CODE = {"orgs": "ods_code", "roles": "ods_code", "relationships": "source_code", "successions": "predecessor_code"}
_PLANTED = {
    "orgs": {"name": f"CASE WHEN {_num('ods_code')} % 50 = 7 THEN NULL ELSE name END",
             "legal_end": f"CASE WHEN {_num('ods_code')} % 40 = 9 THEN legal_start - INTERVAL '1' DAY ELSE legal_end END",
             "primary_role_code": f"CASE WHEN {_num('ods_code')} % 60 = 11 THEN 'RO0' ELSE primary_role_code END",
             "role_names": f"CASE WHEN {_num('ods_code')} % 70 = 13 THEN NULL ELSE role_names END",
             "role_codes": f"CASE WHEN {_num('ods_code')} % 80 = 17 THEN role_names || role_names ELSE role_codes END"},
    "roles": {"operational_end": f"CASE WHEN {_num('ods_code')} % 30 = 4 THEN operational_start - INTERVAL '2' DAY ELSE operational_end END"},
    "relationships": {"rel_status": f"CASE WHEN {_num('source_code')} % 90 = 3 THEN NULL ELSE rel_status END"},
    "successions": {},
}
_TWICE = 100  # of codes with remainder 1, entities and roles are stated twice


def _series_sql() -> str:
    parts = []
    for tb, code in _CODE.items():
        planted = ", ".join(f"{sql} AS {c}" for c, sql in _PLANTED[tb].items())
        one = f"SELECT * {f'REPLACE ({planted})' if planted else ''}, {_pub_of(code)} AS d FROM <{tb}>"
        twice = f" UNION ALL {one} WHERE {_num(code)} % {_TWICE} = 1" if tb in ("orgs", "roles") else ""
        parts.append(f"x_{tb} AS ({one}{twice})")
    return ", ".join(parts)


def _pub_of(c: str) -> str:
    return f"date '2001-08-01' + cast({_num(c)} % 6 as int)"


def _release_checks_sql() -> str:
    rows = []
    for tb, key in schemas.PRIMARY_KEYS.items():
        rows.append(f"SELECT d, 'pk_unique:{tb}' AS check_name, c - 1 AS n, key AS sample FROM (SELECT d, {key} AS key, count(*) AS c FROM x_{tb} GROUP BY 1, 2) x WHERE c > 1")
        for f in schemas.TABLES[tb]:
            if not f.nullable and f.name not in ("predecessor_codes", "successor_codes"):
                rows.append(f"SELECT d, 'not_null:{tb}.{f.name}', 1, {key} FROM x_{tb} WHERE {f.name} IS NULL")
        if tb != "successions":
            rows.append(f"SELECT d, 'date_order:{tb}', 1, {key} FROM x_{tb} WHERE legal_end < legal_start OR operational_end < operational_start")
        for c in schemas.FOREIGN_KEYS.get(tb, ()):
            rows.append(f"SELECT d, 'fk:{tb}', 1, {key} FROM x_{tb} x WHERE NOT EXISTS (SELECT 1 FROM x_orgs o WHERE o.d = x.d AND o.ods_code = x.{c})")
    rows.append("SELECT d, 'primary_in_roles', 1, ods_code FROM x_orgs WHERE NOT list_contains(role_codes, primary_role_code)")
    rows.append("SELECT d, 'lists_aligned', 1, ods_code FROM x_orgs WHERE len(role_codes) <> len(role_names)")
    names = list(dict.fromkeys(r.split("'")[1] for r in rows))
    listed = ", ".join(f"('{k}')" for k in names)
    return (f"{_series_sql()}, bad AS ({' UNION ALL '.join(rows)}), dates AS (SELECT DISTINCT d FROM x_orgs), names(check_name) AS (VALUES {listed}), "
            "checks AS (SELECT t.d, t.check_name, cast(coalesce(sum(n), 0) as bigint) AS n, min(sample) AS sample "
            "FROM (SELECT d, check_name FROM dates, names) t LEFT JOIN bad b ON b.d = t.d AND b.check_name = t.check_name GROUP BY 1, 2)")


def _series(t):
    out = {}
    for tb, code in _CODE.items():
        df = getattr(t, tb)
        kinds = {f.name: f.dataType for f in df.schema}
        df = df.withColumns({c: F.expr(sql).cast(kinds[c]) for c, sql in _PLANTED[tb].items()})
        if tb in ("orgs", "roles"):
            df = df.union(df.where(f"{_num(code)} % {_TWICE} = 1"))
        out[tb] = df.withColumn("d", F.expr(_pub_of(code)))
    releases = t.region.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select(F.expr("date '2001-08-01' + i").alias("d"))
    return out, releases


@plan("a23b_release_checks", f"WITH {_release_checks_sql()} SELECT d AS publication_date, check_name, n, sample FROM checks")
def _(t):
    return A.release_checks(*_series(t), date="d").withColumnRenamed("d", "publication_date").select("publication_date", "check_name", "n", "sample")


@plan("a23c_release_verdicts", f"""
    WITH {_release_checks_sql()}, v AS (SELECT d, count(*) AS checks, count(*) FILTER (WHERE n > 0) AS failed, cast(sum(n) as bigint) AS discrepancies FROM checks GROUP BY 1)
    SELECT r.d AS publication_date, coalesce(checks, 0) AS checks, coalesce(failed, 0) AS failed, coalesce(discrepancies, 0) AS discrepancies,
      CASE WHEN checks IS NULL THEN 'skipped' WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS verdict
    FROM (SELECT date '2001-08-01' + cast(unnest(range(0, 8)) as int) AS d) r LEFT JOIN v ON v.d = r.d""")
def _(t):
    tables, releases = _series(t)
    return A.release_verdicts(A.release_checks(tables, releases, "d"), releases, "d").withColumnRenamed("d", "publication_date")


_NULLS = {"orgs": ["town", "postcode", "legal_end"], "roles": ["operational_end"], "relationships": ["operational_end", "rel_id"], "successions": ["legal_start"]}
_NOT_NULL = " UNION ALL ".join(_check(f"not_null:{tb}.{c}", f"<{tb}> WHERE {c} IS NULL", schemas.PRIMARY_KEYS[tb]) for tb, cs in _NULLS.items() for c in cs)


@plan("a24_audit_report", f"""
    WITH c AS ({_NOT_NULL} UNION ALL {_check("vocab_names", _VOCAB_BAD, "role_code")})
    SELECT count(*) AS checks, count(*) FILTER (WHERE n > 0) AS failed, cast(sum(n) as bigint) AS discrepancies, count(*) FILTER (WHERE n > 0) = 0 AS passed FROM c""")
def _(t):
    parts = [A.not_null(getattr(t, tb), cs, schemas.PRIMARY_KEYS[tb], tb) for tb, cs in _NULLS.items()] + [A.vocab_names(t.roles, t.vocab)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return A.audit_report(out)


@plan("a24b_table_audit", " UNION ALL ".join(
    [_check(f"pk_unique:{tb}", f"(SELECT {k} AS id, count(*) AS c FROM <{tb}> GROUP BY 1) x WHERE c > 1", "id", "sum(c - 1)") for tb, k in schemas.PRIMARY_KEYS.items()]
    + [_check("fk:roles", f"<roles> WHERE ods_code {_NOT_ORG}", "role_id"),
       _check("fk:relationships", f"<relationships> WHERE source_code {_NOT_ORG} OR target_code {_NOT_ORG}", "rel_id"),
       _check("fk:successions", f"<successions> WHERE predecessor_code {_NOT_ORG} OR successor_code {_NOT_ORG}", "succession_id"),
       _check("vocab_names", _VOCAB_BAD, "role_code"), "SELECT 'list_alignment', 0, NULL"]
    + [f"SELECT 'not_null:{tb}.{f.name}', 0, NULL" for tb, s in schemas.TABLES.items() for f in s
       if not f.nullable and f.name not in ("predecessor_codes", "successor_codes")]))
def _(t):
    return A.table_audit(t.orgs, t.roles, t.relationships, t.successions, t.vocab)


@plan("a25_unexpected_files", """
    SELECT 'stray-' || cast(r_regionkey as string) || '.txt' AS file_name, cast(length(r_name) + 1 as bigint) AS bytes FROM <region>""")
def _(t):
    root = scratch_path(t.spark, "release")
    t.region.select("r_name").write.text(f"{root}/parts")
    seen = t.region.select(F.concat(F.lit("stray-"), F.col("r_regionkey").cast("string"), F.lit(".txt")).alias("file_name"),
                           (F.length("r_name") + 1).cast("bigint").alias("bytes"))
    listed = files_.scan_files_binary(t.spark, t.folder, "*.parquet").select("file_name", "bytes").union(seen)
    expected = [f"{n}.parquet" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
                                         "pages", "benchmark", "labels", "conversations")]
    return files_.unexpected_files(listed, expected)


@plan("a26_same_provenance", """
    SELECT o_orderpriority AS release, count(*) AS files, count(DISTINCT p) + max(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS versions,
           count(DISTINCT p) + max(CASE WHEN p IS NULL THEN 1 ELSE 0 END) = 1 AS same
    FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority < '3' THEN 'same' WHEN o_orderpriority < '4' THEN o_orderstatus
          WHEN o_orderkey % 2 = 0 THEN 'x' END AS p FROM <orders>) f GROUP BY 1""")
def _(t):
    p = F.when(F.col("o_orderpriority") < "3", F.lit("same")).when(F.col("o_orderpriority") < "4", F.col("o_orderstatus")) \
        .when(F.col("o_orderkey") % 2 == 0, F.lit("x"))
    return files_.same_provenance(t.orders.select(F.col("o_orderpriority").alias("release"), p.alias("provenance")))


_SHIFTED = "(17, 'legal_start'), (18, 'legal_end'), (19, 'operational_start'), (20, 'operational_end'), (21, 'last_changed'), (22, 'publication_date')"


@plan("a27_schema_contract", f"""
    SELECT 'orgs' AS table_name, p AS position, f AS field, ty AS type, problem, (SELECT count(*) FROM <orgs>) AS n_rows FROM (
      SELECT p, f, 'array' || chr(60) || 'string' || chr(62) AS ty, 'missing' AS problem FROM (VALUES (15, 'predecessor_codes'), (16, 'successor_codes')) v(p, f)
      UNION ALL SELECT p, f, 'date', 'missing' FROM (VALUES {_SHIFTED}) w(p, f)
      UNION ALL SELECT p - 2, f, 'date', 'unexpected' FROM (VALUES {_SHIFTED}) w(p, f)) x""")
def _(t):
    rows = t.orgs.agg(F.count("*")).scalar()
    return A.schema_contract(t.spark, t.orgs.schema, "orgs").withColumn("n_rows", rows)


@plan("a28_not_null", _NOT_NULL)
def _(t):
    parts = [A.not_null(getattr(t, tb), cs, schemas.PRIMARY_KEYS[tb], tb) for tb, cs in _NULLS.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@plan("a29_sample_n", "SELECT code, file_index FROM <xml_src> ORDER BY file_index, code LIMIT 50")
def _(t):
    return A.sample_first(t.xml_src.select("code", "file_index"), ["file_index", "code"], 50)


@plan("a30_all_low_signal", """
    SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active FROM <orgs>
    WHERE len(list_filter(role_codes, lambda c: c NOT IN ('RO177', 'RO101', 'RO15', 'RO31', 'RO57'))) = 0""")
def _(t):
    return A.low_signal_only(t.orgs)


@plan("a31_name_case_drift", """
    SELECT ods_code, name FROM (SELECT ods_code, CASE WHEN cast(substr(ods_code, 2) as bigint) % 9 = 1 THEN lower(name) ELSE name END AS name FROM <orgs>) x
    WHERE regexp_replace(name, '[^A-Z0-9]', '', 'g') <> regexp_replace(upper(name), '[^A-Z0-9]', '', 'g')""")
def _(t):
    num = F.substring("ods_code", 2, 20).cast("bigint")
    return A.name_case_drift(t.orgs.withColumn("name", F.when(num % 9 == 1, F.lower("name")).otherwise(F.col("name"))))


@plan("a20b_closures_parity", f"""
    WITH RECURSIVE e AS (SELECT predecessor_code AS a, successor_code AS b FROM {_SUCC} s), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a)
    SELECT a AS ods_code, 'successor_codes' AS side, b AS member, 'missing' AS problem FROM p WHERE a <> b AND a IN (SELECT code FROM <xml_kept> WHERE k % 53 <> 3)
    UNION ALL SELECT b, 'predecessor_codes', a, 'missing' FROM p WHERE a <> b AND b IN (SELECT code FROM <xml_kept> WHERE k % 53 <> 3)""")
def _(t):
    e, orgs = _built(t)
    return G.closure_verify(orgs, checkpoint(G.successor_pairs(B.succession_edges(e, written.PUBLISHED))))


