"""Snapshot-series and two-snapshot queries (groups W and X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import diff as X
from rollbook.operators import history as W
from rollbook.plans.registry import plan
from rollbook.runtime import scratch_path
from rollbook.streaming import changefeed

_W = "OVER (PARTITION BY ods_code ORDER BY publication_date)"


@plan("w1_status_transitions", f"""
    WITH s AS (SELECT publication_date, status, lag(status) {_W} AS prev_status FROM <snapshots>)
    SELECT publication_date, prev_status, status, count(*) AS n FROM s WHERE prev_status <> status GROUP BY ALL""")
def _(t):
    return W.status_transitions(t.snapshots)


@plan("w2_renames", f"""
    WITH s AS (SELECT ods_code, publication_date, name, lag(name) {_W} AS was FROM <snapshots>)
    SELECT ods_code, was, name AS now, publication_date FROM s WHERE was IS NOT NULL AND name <> was""")
def _(t):
    return W.renames(t.snapshots)


@plan("w3_column_changes", f"""
    WITH s AS (SELECT publication_date, postcode, town, primary_role_code, lag(postcode) {_W} AS p, lag(town) {_W} AS w,
                      lag(primary_role_code) {_W} AS r FROM <snapshots>)
    SELECT publication_date, count(*) FILTER (WHERE postcode <> p) AS postcode_changes, count(*) FILTER (WHERE town <> w) AS town_changes,
           count(*) FILTER (WHERE primary_role_code <> r) AS primary_role_code_changes FROM s GROUP BY 1""")
def _(t):
    return W.change_counts(t.snapshots, ["postcode", "town", "primary_role_code"])


@plan("w4_rel_churn", """
    WITH h AS (SELECT rel_code, target_code, publication_date, lag(target_code) OVER (PARTITION BY source_code, rel_code
                 ORDER BY publication_date, target_code, rel_id) AS prev FROM <rel_series> WHERE rel_status = 'active')
    SELECT publication_date, count(*) FILTER (WHERE rel_code = 'RE4' AND target_code IS DISTINCT FROM prev) AS commissioner_changed,
           count(*) FILTER (WHERE rel_code = 'RE6' AND target_code IS DISTINCT FROM prev) AS operated_by_changed
    FROM h WHERE publication_date > date '1995-01-01' GROUP BY 1""")
def _(t):
    return W.rel_churn(t.rel_series, "1995-01-01")


@plan("w5_stamp_honesty", """
    WITH s AS (SELECT *, lag(last_changed) OVER w AS pc, lag(name) OVER w AS pn, lag(postcode) OVER w AS pp, lag(status) OVER w AS ps,
                      lag(primary_role_code) OVER w AS pr FROM <snapshots> WINDOW w AS (PARTITION BY ods_code ORDER BY publication_date)),
    c AS (SELECT publication_date, (name IS DISTINCT FROM pn OR postcode IS DISTINCT FROM pp OR status IS DISTINCT FROM ps
                 OR primary_role_code IS DISTINCT FROM pr) AS edited, last_changed IS DISTINCT FROM pc AS stamped FROM s WHERE pc IS NOT NULL)
    SELECT publication_date, count(*) FILTER (WHERE edited AND stamped) AS edited_and_stamped,
           count(*) FILTER (WHERE edited AND NOT stamped) AS edited_not_stamped,
           count(*) FILTER (WHERE NOT edited AND stamped) AS stamped_no_visible_edit FROM c GROUP BY 1""")
def _(t):
    return W.stamp_honesty(t.snapshots)


@plan("w6_gained_successors", f"""
    WITH s AS (SELECT publication_date, len(successor_codes) AS n, lag(len(successor_codes)) {_W} AS was FROM <snapshots>)
    SELECT publication_date, count(*) AS gained_successors FROM s WHERE n > was GROUP BY 1""")
def _(t):
    return W.gained_successors(t.snapshots)


@plan("w7_deleted_codes", """
    SELECT ods_code, max(publication_date) AS last_seen FROM <snapshots> GROUP BY 1
    HAVING max(publication_date) < (SELECT max(publication_date) FROM <snapshots>)""")
def _(t):
    return W.deleted_codes(t.snapshots)


@plan("w8_new_codes", """
    SELECT ods_code, min(publication_date) AS first_seen FROM <snapshots> GROUP BY 1
    HAVING min(publication_date) > (SELECT min(publication_date) FROM <snapshots>)""")
def _(t):
    return W.new_codes(t.snapshots)


@plan("w9_latest_per_key", """
    SELECT ods_code, name, status, postcode, town, publication_date FROM
    (SELECT *, row_number() OVER (PARTITION BY ods_code ORDER BY publication_date DESC) AS rn FROM <snapshots>) x WHERE rn = 1""")
def _(t):
    return W.latest_per_key(t.snapshots.select("ods_code", "name", "status", "postcode", "town", "publication_date"))


@plan("w10_rebuild_vs_actual", """
    WITH a AS (SELECT ods_code FROM <snapshots> WHERE publication_date = date '2024-01-10' AND status = 'active'),
    b AS (SELECT ods_code FROM <snapshots> WHERE publication_date = date '2024-01-20' AND operational_start <= date '2024-01-10'
          AND (operational_end IS NULL OR operational_end > date '2024-01-10'))
    SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x) AS in_actual_only,
           (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y) AS in_rebuild_only""")
def _(t):
    s = t.snapshots
    return W.rebuild_vs_actual(s.where("publication_date = date '2024-01-10'"), s.where("publication_date = date '2024-01-20'"),
                               "2024-01-10")


@plan("w11_staleness", """
    SELECT max(publication_date) AS newest, cast(date '2024-03-20' - max(publication_date) as int) AS age_days,
           date '2024-03-20' - max(publication_date) > 45 AS stale FROM <snapshots>""")
def _(t):
    return W.staleness(t.snapshots, "2024-03-20")


_COLS = ["status", "name", "role", "town", "postcode", "contacts"]
_BOTH = "<snap_old> o JOIN <snap_new> n ON o.ods_code = n.ods_code"


@plan("x1_diff_added", "SELECT ods_code, name, role, status FROM <snap_new> WHERE ods_code NOT IN (SELECT ods_code FROM <snap_old>)")
def _(t):
    return X.diff_added(t.snap_old, t.snap_new).select("ods_code", "name", "role", "status")


@plan("x7_diff_removed", "SELECT ods_code, name, role, status FROM <snap_old> WHERE ods_code NOT IN (SELECT ods_code FROM <snap_new>)")
def _(t):
    return X.diff_removed(t.snap_old, t.snap_new).select("ods_code", "name", "role", "status")


_MODIFIED = " UNION ALL ".join(
    f"SELECT n.ods_code, n.name, n.role, '{c}' AS field, o.{c} AS old_value, n.{c} AS new_value FROM {_BOTH} WHERE o.{c} IS DISTINCT FROM n.{c}"
    for c in _COLS)


@plan("x2_diff_modified", _MODIFIED)
def _(t):
    return X.diff_modified(t.snap_old, t.snap_new)


def _any(cols) -> str:
    return "(" + " OR ".join(f"o.{c} IS DISTINCT FROM n.{c}" for c in cols) + ")"


@plan("x3_diff_stats", f"""
    SELECT count(*) FILTER (WHERE {_any(['status'])}) AS status_changes, count(*) FILTER (WHERE {_any(['name'])}) AS name_changes,
           count(*) FILTER (WHERE {_any(['town', 'postcode'])}) AS geo_changes,
           count(*) FILTER (WHERE {_any(['role', 'contacts'])} AND NOT {_any(['status', 'name', 'town', 'postcode'])}) AS other_changes
    FROM {_BOTH}""")
def _(t):
    return X.diff_stats(t.snap_old, t.snap_new)


_PASS = "({0}.status = 'active' AND contains(lower({0}.role), 'urg'))"


@plan("x4_diff_filter", f"""
    SELECT n.ods_code, 'added' AS change_type FROM <snap_new> n WHERE {_PASS.format('n')} AND ods_code NOT IN (SELECT ods_code FROM <snap_old>)
    UNION ALL SELECT o.ods_code, 'removed' FROM <snap_old> o WHERE {_PASS.format('o')} AND ods_code NOT IN (SELECT ods_code FROM <snap_new>)
    UNION ALL SELECT n.ods_code, 'modified' FROM {_BOTH} WHERE ({_PASS.format('o')} OR {_PASS.format('n')}) AND {_any(_COLS)}""")
def _(t):
    return X.diff(t.snap_old, t.snap_new, role="URG", only_active=True).select("ods_code", "change_type")


@plan("x5_diff_summary", f"""
    SELECT *, both_n - modified_count AS unchanged_count, cast(round(modified_count * 100.0 / baseline_count, 2) as double) AS modified_pct FROM (
      SELECT (SELECT count(*) FROM <snap_old>) AS baseline_count, (SELECT count(*) FROM <snap_new>) AS target_count,
             (SELECT count(*) FROM <snap_new> WHERE ods_code NOT IN (SELECT ods_code FROM <snap_old>)) AS added_count,
             (SELECT count(*) FROM <snap_old> WHERE ods_code NOT IN (SELECT ods_code FROM <snap_new>)) AS removed_count,
             (SELECT count(*) FROM {_BOTH} WHERE {_any(_COLS)}) AS modified_count, (SELECT count(*) FROM {_BOTH}) AS both_n) x""")
def _(t):
    out = X.diff_summary(t.snap_old, t.snap_new)
    return out.withColumn("both_n", F.col("unchanged_count") + F.col("modified_count")).withColumn(
        "modified_pct", F.col("modified_pct").cast("double"))


@plan("x6_diff_default_pair", """
    SELECT min(d) AS old, max(d) AS new FROM (SELECT DISTINCT publication_date AS d FROM <snapshots> ORDER BY d DESC LIMIT 2) x""")
def _(t):
    return X.diff_default_pair(t.snapshots)


@plan("x8_diff_release_view", """
    WITH v AS (SELECT ods_code, publication_date AS d, name, status, coalesce(role_name, primary_role_code) AS role, town, postcode
      FROM <snapshots> LEFT JOIN (SELECT 'RO' || cast(r_regionkey as string) AS primary_role_code, r_name AS role_name FROM <region> WHERE r_regionkey < 2) r
      USING (primary_role_code)),
    o AS (SELECT * FROM v WHERE d = date '2024-01-10'), n AS (SELECT * FROM v WHERE d = date '2024-01-11')
    SELECT n.ods_code, o.role AS old_value, n.role AS new_value FROM o JOIN n USING (ods_code) WHERE o.role <> n.role""")
def _(t):
    vocab = t.region.where("r_regionkey < 2").select(F.concat(F.lit("RO"), F.col("r_regionkey").cast("string")).alias("role_code"),
                                                    F.col("r_name").alias("role_name"))
    day = lambda d: X.diff_view(t.snapshots.where(F.col("publication_date") == F.lit(d).cast("date")), vocab)
    return X.diff_modified(day("2024-01-10"), day("2024-01-11")).where("field = 'role'").select("ods_code", "old_value", "new_value")


_FEED = " UNION ALL ".join(
    f"""SELECT day AS publication_date, n.ods_code, 'modified' AS change_type, '{c}' AS field, coalesce(o.{c}, '') AS old_value, coalesce(n.{c}, '') AS new_value
        FROM p JOIN s n ON n.d = day JOIN s o ON o.d = before AND o.ods_code = n.ods_code WHERE o.{c} IS DISTINCT FROM n.{c}"""
    for c in _COLS[:-1])


@plan("st1_change_feed", f"""
    WITH s AS (SELECT publication_date AS d, ods_code, name, status, primary_role_code AS role, town, postcode FROM <snapshots>),
    p AS (SELECT d AS day, lag(d) OVER (ORDER BY d) AS before FROM (SELECT DISTINCT d FROM s) x)
    SELECT day AS publication_date, n.ods_code, 'added' AS change_type, '' AS field, '' AS old_value, '' AS new_value FROM p JOIN s n ON n.d = day
    LEFT JOIN s o ON o.d = before AND o.ods_code = n.ods_code WHERE before IS NOT NULL AND o.ods_code IS NULL
    UNION ALL SELECT day, o.ods_code, 'removed', '', '', '' FROM p JOIN s o ON o.d = before
    LEFT JOIN s n ON n.d = day AND n.ods_code = o.ods_code WHERE n.ods_code IS NULL UNION ALL {_FEED}""")
def _(t):
    """Every release of the series is written and announced, the second one late; the feed is what the stream made of them."""
    rows = t.snapshots.select("ods_code", "name", "status", F.col("primary_role_code").alias("role"), "town", "postcode", "publication_date")
    root = scratch_path(t.spark, "feed")
    rows.write.partitionBy("publication_date").parquet(f"{root}/releases")
    days = [r[0] for r in rows.select("publication_date").distinct().orderBy("publication_date").collect()]  # a row per release
    for batch in (days[:1] + days[2:], days[1:2]):
        for day in batch:
            changefeed.announce(t.spark, day, f"{root}/releases/publication_date={day}", f"{root}/markers")
        changefeed.start_change_feed(changefeed.read_markers(t.spark, f"{root}/markers"), rows.schema, f"{root}/series", f"{root}/changes",
                                     f"{root}/mark").awaitTermination()
    return t.spark.read.parquet(f"{root}/changes").select("publication_date", "ods_code", "change_type", "field", "old_value", "new_value")
