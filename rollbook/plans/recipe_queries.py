"""Join, aggregate and set-operation recipes (groups J, G-A and T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import aggregates as A
from rollbook.operators import joins as J
from rollbook.plans.registry import OPEN, plan


@plan("j1_join_roles_orgs", "SELECT ods_code, name, status, role_code, role_id FROM <roles> JOIN <orgs> o USING (ods_code)")
def _(t):
    return J.join_roles_orgs(t.roles, t.orgs).select("ods_code", "name", "status", "role_code", "role_id")


@plan("j2_join_rel_both_ends", """
    SELECT r.source_code, s.name AS organisation, r.rel_code, r.rel_name, r.target_code, g.name AS target, r.rel_id
    FROM <relationships> r JOIN <orgs> s ON r.source_code = s.ods_code JOIN <orgs> g ON r.target_code = g.ods_code
    WHERE r.rel_status = 'active'""")
def _(t):
    return J.join_rel_both_ends(t.relationships, t.orgs)


@plan("j3_join_code_to_name", """
    SELECT y.ods_code, string_agg(c || ':' || coalesce(o.name, '') || ':' || coalesce(o.status, 'unknown'), '|' ORDER BY pos) AS related
    FROM (SELECT ods_code, unnest(codes) AS c, unnest(range(1, 5)) AS pos FROM
          (SELECT concat('P', cast(l_partkey as string), '/', cast(l_orderkey as string), '/', cast(l_linenumber as string), '/',
                         cast(l_suppkey as string)) AS ods_code,
                  ['P' || cast(l_partkey as string), 'S' || cast(l_suppkey as string), 'Q1', 'P' || cast(l_partkey as string)] AS codes
           FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM <lineitem>) l) x) y LEFT JOIN <orgs> o ON o.ods_code = c GROUP BY y.ods_code""")
def _(t):
    p, s = F.concat(F.lit("P"), F.col("l_partkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    key = F.concat_ws("/", p, F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").distinct().select(key.alias("ods_code"), F.array(p, s, F.lit("Q1"), p).alias("codes"))
    out = J.join_code_to_name(rows, t.orgs, "codes")
    return out.select("ods_code", F.array_join(F.transform("related", lambda x: F.concat_ws(":", x["code"], x["name"], x["status"])),
                                               "|").alias("related"))


@plan("j4_anti_unlinked", """
    SELECT ods_code, name FROM <orgs> WHERE status = 'active' AND ods_code NOT IN
    (SELECT source_code FROM <relationships> UNION SELECT target_code FROM <relationships>)""")
def _(t):
    return J.anti_unlinked(t.orgs, t.relationships).select("ods_code", "name")


@plan("j5_semi_targets_never_source", """
    SELECT DISTINCT target_code AS ods_code FROM <relationships> WHERE target_code NOT IN (SELECT source_code FROM <relationships>)""")
def _(t):
    return J.targets_never_source(t.relationships)


@plan("j6_join_far_side_filter", """
    SELECT count(*) FILTER (WHERE o.status = 'active') AS filtered_rows, count(*) AS all_rows
    FROM <relationships> r JOIN <orgs> o ON r.source_code = o.ods_code""")
def _(t):
    return J.join_far_side_filter(t.relationships, t.orgs)


@plan("j7_natural_join_trap", """
    SELECT 'using_key' AS join_form, count(*) AS n FROM <roles> r JOIN <orgs> o USING (ods_code)
    UNION ALL SELECT 'natural', count(*) FROM <roles> r NATURAL JOIN <orgs> o""")
def _(t):
    return J.natural_join_trap(t.roles, t.orgs)


@plan("j8_join_roles_dup", """
    SELECT count(*) AS n_rows, count(DISTINCT o.ods_code) AS orgs FROM <orgs> o JOIN <roles> r USING (ods_code)
    WHERE o.status = 'active' AND r.role_code = 'RO7009'""")
def _(t):
    return J.join_roles_dup(t.orgs, t.roles, "RO7009")


@plan("j9_full_outer_snapshots", """
    SELECT coalesce(a.ods_code, b.ods_code) AS ods_code, CASE WHEN a.ods_code IS NULL THEN 'added' WHEN b.ods_code IS NULL THEN 'removed'
           ELSE 'both' END AS side FROM <snap_old> a FULL JOIN <snap_new> b ON a.ods_code = b.ods_code""")
def _(t):
    from rollbook.operators.diff import full_outer_snapshots
    return full_outer_snapshots(t.snap_old, t.snap_new)


@plan("j10_class_never_target", """
    SELECT count(*) AS n FROM <relationships> WHERE target_code IN (SELECT ods_code FROM <orgs> WHERE record_class = 'site')""")
def _(t):
    return J.class_as_target(t.relationships, t.orgs)


@plan("j11_rollup_two_hop", """
    SELECT body, cast(sum(n) as bigint) AS sources, count(*) AS sub_units FROM
    (SELECT target_code AS middle, count(*) AS n FROM <relationships> WHERE rel_status = 'active' AND rel_code = 'RE4' GROUP BY 1) u
    JOIN (SELECT DISTINCT source_code AS middle, target_code AS body FROM <relationships> WHERE rel_status = 'active' AND rel_code = 'RE4') v
    USING (middle) GROUP BY body""")
def _(t):
    return J.rollup_two_hop(t.relationships)


@plan("j12_no_commissioner", """
    SELECT ods_code, name FROM <orgs> WHERE status = 'active' AND list_contains(role_codes, 'RO177') AND ods_code NOT IN
    (SELECT source_code FROM <relationships> WHERE rel_status = 'active' AND rel_code = 'RE4')""")
def _(t):
    return J.no_commissioner(t.orgs, t.relationships, "RO177")


@plan("ga1_role_histogram", """
    SELECT role, count(*) AS n FROM (SELECT unnest(role_names) AS role FROM <orgs> WHERE status = 'active' AND record_class = 'org') x
    GROUP BY 1 ORDER BY n DESC, role LIMIT 8""")
def _(t):
    return A.role_histogram(t.orgs)


_HELD = f"(SELECT role_code, count(*) AS n FROM (SELECT unnest(role_codes) AS role_code FROM <orgs> WHERE {OPEN}) x GROUP BY 1)"


@plan("ga2_role_holders", f"""
    SELECT v.role_code, v.role_name, coalesce(n, 0) AS holders FROM <vocab> v LEFT JOIN {_HELD} h USING (role_code)
    ORDER BY holders DESC, role_name""")
def _(t):
    return A.role_holders(t.orgs, t.vocab).orderBy(*A.role_holders_order())


@plan("ga2b_role_holders_matching", """
    SELECT v.role_code, v.role_name, coalesce(n, 0) AS holders FROM <vocab> v LEFT JOIN
    (SELECT role_code, count(*) AS n FROM (SELECT unnest(role_codes) AS role_code FROM <orgs>) x GROUP BY 1) h USING (role_code)
    WHERE contains(lower(v.role_code), 'ar') OR contains(lower(v.role_name), 'ar')""")
def _(t):
    return A.role_holders(t.orgs, t.vocab, " AR ", all_rows=True)


@plan("ga3_roles_per_entity", "SELECT cast(len(role_codes) as int) AS roles, count(*) AS entities FROM <orgs> WHERE status = 'active' GROUP BY 1")
def _(t):
    return A.roles_per_entity(t.orgs)


@plan("ga4_count_filter", """
    SELECT 'named' AS what, count(*) AS all_rows, count(*) FILTER (WHERE contains(name, 'WIDGET')) AS hits FROM <orgs>
    WHERE status = 'active' AND list_contains(role_codes, 'RO8005')
    UNION ALL SELECT 'also', count(*), count(*) FILTER (WHERE list_contains(role_codes, 'RO177')) FROM <orgs>
    WHERE status = 'active' AND list_contains(role_codes, 'RO6510')""")
def _(t):
    a = A.count_with_name(t.orgs, "RO8005", "WIDGET").select(F.lit("named").alias("what"), "all_rows", F.col("named").alias("hits"))
    return a.union(A.count_also_role(t.orgs, "RO6510", "RO177").select(F.lit("also"), "holders", "also"))


@plan("ga5_count_case", """
    SELECT r.rel_name, count(CASE WHEN o.record_class = 'site' THEN 1 END) AS site_source_count,
           count(CASE WHEN o.record_class = 'org' THEN 1 END) AS org_source_count
    FROM <relationships> r JOIN <orgs> o ON r.source_code = o.ods_code WHERE o.status = 'active' GROUP BY r.rel_name""")
def _(t):
    return A.rel_types_by_class(t.relationships, t.orgs)


@plan("ga6_top_by_town", """
    SELECT town, count(*) AS holders FROM <orgs> WHERE status = 'active' AND list_contains(role_names, 'VENDOR') AND town IS NOT NULL
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(t):
    return A.top_by_town(t.orgs.where("town IS NOT NULL"), "VENDOR")


@plan("ga6b_in_outward", """
    SELECT ods_code, name, postcode FROM <orgs> WHERE status = 'active' AND starts_with(postcode, 'N4 ') AND list_contains(role_names, 'BUILDING')""")
def _(t):
    return A.in_outward(t.orgs, "N4", "BUILDING")


@plan("ga7_top_commissioners", """
    SELECT g.name AS target_name, count(*) AS n FROM <relationships> r JOIN <orgs> s ON r.source_code = s.ods_code
    JOIN <orgs> g ON r.target_code = g.ods_code WHERE s.status = 'active' AND r.rel_code = 'RE4' AND r.rel_status = 'active'
      AND list_contains(s.role_names, 'VENDOR') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(t):
    return A.top_commissioners(t.relationships, t.orgs, "VENDOR")


@plan("ga8_top_operators", """
    SELECT g.name AS target_name, count(*) AS n FROM <relationships> r JOIN <orgs> s ON r.source_code = s.ods_code
    JOIN <orgs> g ON r.target_code = g.ods_code WHERE s.status = 'active' AND r.rel_code = 'RE6' AND r.rel_status = 'active'
      AND s.record_class = 'site' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def _(t):
    return A.top_operators(t.relationships, t.orgs)


@plan("ga9_dup_names", "SELECT name, count(*) AS codes FROM <orgs> WHERE status = 'active' GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return A.dup_names(t.orgs)


@plan("ga10_release_totals", """
    SELECT publication_date, count(*) AS n_rows, count(*) FILTER (WHERE status = 'active') AS n_active FROM <snapshots> GROUP BY 1""")
def _(t):
    return A.release_totals(t.snapshots)


@plan("ga11_country_counts", "SELECT country, count(*) AS n FROM <orgs> WHERE status = 'active' GROUP BY 1")
def _(t):
    return A.country_counts(t.orgs)


@plan("ga11b_open_holders_by_country", f"""
    SELECT country, count(*) AS n FROM <orgs> WHERE {OPEN} AND list_has_any(role_codes, ['RO177', 'RO8606']) GROUP BY 1""")
def _(t):
    return A.open_holders_by_country(t.orgs, ["RO177", "RO8606"])


@plan("ga12_trust_states", f"""
    SELECT {OPEN} AS is_open, coalesce(n, 0) = 0 AS no_successor, count(*) AS n FROM <orgs> LEFT JOIN
    (SELECT predecessor_code AS ods_code, count(*) AS n FROM <successions> WHERE predecessor_code <> successor_code GROUP BY 1) s USING (ods_code)
    WHERE country = 'ENGLAND' AND list_contains(role_codes, 'RO8606') AND status = 'active' GROUP BY 1, 2""")
def _(t):
    lists = t.successions.where("predecessor_code <> successor_code").groupBy(F.col("predecessor_code").alias("ods_code")).agg(
        F.collect_set("successor_code").alias("successor_codes"))
    orgs = t.orgs.join(lists, "ods_code", "left").withColumn(
        "successor_codes", F.coalesce("successor_codes", F.array().cast("array<string>")))
    return A.trust_states(orgs, "ENGLAND", "RO8606")


@plan("ga13_fill_rate", """
    SELECT role, count(*) AS n_rows, count(legal_start) AS filled, round(count(legal_start) * 100.0 / count(*), 1) AS pct
    FROM (SELECT unnest(role_names) AS role, legal_start FROM <orgs>) x GROUP BY 1""")
def _(t):
    return A.fill_rate(t.orgs).withColumn("pct", F.col("pct").cast("double"))


@plan("ga14_status_split", "SELECT rel_status, count(*) AS n FROM <relationships> GROUP BY 1")
def _(t):
    return A.status_split(t.relationships)


@plan("ga15_rel_type_counts", "SELECT rel_code, rel_name, count(*) AS n FROM <relationships> GROUP BY 1, 2")
def _(t):
    return A.rel_type_counts(t.relationships)


@plan("ga16_sentinel_dates", "SELECT count(*) AS n FROM <orgs> WHERE operational_start = date '1900-01-01'")
def _(t):
    return A.sentinel_dates(t.orgs)


@plan("ga17_date_disagreement", """
    SELECT count(*) FILTER (WHERE legal_start <> operational_start) AS disagree,
           count(*) FILTER (WHERE legal_start < operational_start) AS legal_earlier FROM <orgs>""")
def _(t):
    return A.date_disagreement(t.orgs)


@plan("ga18_scalar_subquery_pair", """
    SELECT (SELECT count(*) FROM <orgs> WHERE operational_start <= date '1998-03-31' AND (operational_end IS NULL OR operational_end > date '1998-03-31'))
             AS via_operational,
           (SELECT count(*) FROM <orgs> WHERE legal_start <= date '1998-03-31' AND (legal_end IS NULL OR legal_end > date '1998-03-31')) AS via_legal""")
def _(t):
    return A.existed_both_ways(t.orgs, "1998-03-31")


@plan("ga19_table_rows", """
    SELECT 'orgs' AS table_name, count(*) AS n FROM <orgs> UNION ALL SELECT 'roles', count(*) FROM <roles>
    UNION ALL SELECT 'relationships', count(*) FROM <relationships> UNION ALL SELECT 'successions', count(*) FROM <successions>""")
def _(t):
    return A.table_rows({n: getattr(t, n) for n in ("orgs", "roles", "relationships", "successions")})


@plan("ga20_active_with_end", """
    SELECT count(operational_end) AS n, max(operational_end) AS furthest FROM <orgs> WHERE status = 'active'""")
def _(t):
    return A.active_with_end(t.orgs)


@plan("ga21_overdue_closure", """
    SELECT count(*) AS overdue,
           count(*) FILTER (WHERE legal_end + INTERVAL 6 MONTH >= publication_date) AS within_six_months,
           count(*) FILTER (WHERE legal_end + INTERVAL 24 MONTH < publication_date) AS over_two_years
    FROM <orgs> WHERE status = 'active' AND legal_end <= publication_date""")
def _(t):
    return A.overdue_closure(t.orgs)


@plan("ga22_active_rel_on_inactive", """
    SELECT count(*) AS n FROM <relationships> WHERE rel_status = 'active' AND source_code IN (SELECT ods_code FROM <orgs> WHERE status = 'inactive')""")
def _(t):
    return A.active_rel_on_inactive(t.relationships, t.orgs)


@plan("ga23_open_holders", f"SELECT count(*) AS n FROM <orgs> WHERE {OPEN} AND list_contains(role_codes, 'RO177')")
def _(t):
    return A.open_holders(t.orgs, "RO177")


@plan("ga24_as_of_summary", """
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE status = 'active') AS n_active, max(publication_date) AS as_of FROM <orgs>""")
def _(t):
    return A.as_of_summary(t.orgs)


@plan("t1_union_distinct", "SELECT source_code AS ods_code FROM <relationships> UNION SELECT target_code FROM <relationships>")
def _(t):
    return J.linked_codes(t.relationships)


@plan("t2_except", "SELECT source_code AS ods_code FROM <relationships> WHERE rel_status = 'active' EXCEPT SELECT predecessor_code FROM <successions>")
def _(t):
    return J.except_distinct(t.relationships.where("rel_status = 'active'").select(F.col("source_code").alias("ods_code")),
                             t.successions.select("predecessor_code"))


@plan("t3_intersect_keys", "SELECT ods_code FROM <snap_old> INTERSECT SELECT ods_code FROM <snap_new>")
def _(t):
    return J.intersect_keys(t.snap_old, t.snap_new)
