"""Reader, writer and build queries (groups S, K and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook import schemas
from rollbook.functions.dates import parse_date
from rollbook.functions.roles import role_display
from rollbook.functions.text import archive_name_parts, country_title, semver, thousands
from rollbook.operators import build as B
from rollbook.operators import graph as G
from rollbook.plans import written
from rollbook.plans.registry import plan
from rollbook.runtime import checkpoint, scratch_path
from rollbook.sources import files as files_
from rollbook.sources import reference, sinks, tables, xml


@plan("s1_scan_parquet", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal, cast(NULL as varchar) AS c_added FROM <customer>")
def _(t):
    ddl = "c_custkey bigint, c_name string, c_mktsegment string, c_acctbal double, c_added string"
    from pyspark.sql.types import _parse_datatype_string
    return tables.scan_parquet(t.spark, f"{t.folder}/customer.parquet", _parse_datatype_string(ddl))


@plan("s2_scan_snapshots", """
    SELECT ods_code, name, status, publication_date FROM <snapshots> WHERE publication_date BETWEEN date '2024-01-05' AND date '2024-01-12'""")
def _(t):
    return tables.scan_snapshots(t.spark, written.series(t), "2024-01-05", "2024-01-12").select("ods_code", "name", "status", "publication_date")


@plan("s3_scan_union_by_name", """
    SELECT o_orderkey, o_orderstatus, NULL AS extra FROM <orders> WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM <orders> WHERE o_orderkey % 2 = 1""")
def _(t):
    root = scratch_path(t.spark, "versions")
    t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus").write.parquet(f"{root}/v1")
    t.orders.where("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_orderpriority").alias("extra")).write.parquet(f"{root}/v2")
    return tables.scan_union_by_name(t.spark, f"{root}/v1", f"{root}/v2")


@plan("s4_scan_with_filename", "SELECT cast(year(o_orderdate) as int) AS year, count(*) AS n FROM <orders> GROUP BY 1")
def _(t):
    rows = tables.scan_with_filename(t.spark, written.yearly(t))
    year = F.regexp_extract("filename", "year=(\\d+)", 1).cast("int")
    return rows.groupBy(year.alias("year")).agg(F.count("*").alias("n"))


@plan("s5_scan_path_list", "SELECT o_orderkey, o_custkey FROM <orders> WHERE year(o_orderdate) IN (1996, 1999)")
def _(t):
    root = written.yearly(t)
    return tables.scan_path_list(t.spark, [f"{root}/year=1996", f"{root}/year=1999"]).select("o_orderkey", "o_custkey")


_STUBLESS = "CASE WHEN ref_only THEN '' ELSE {} END"


_XML_SQL = f"""
    SELECT code, file_index, ref_only, name, status, record_class, CASE WHEN ref_only THEN NULL ELSE town END AS town,
           {_STUBLESS.format("role1 || ':' || role1_status || CASE WHEN role2 IS NULL THEN '' ELSE ',' || role2 || ':' || role2_status END")} AS roles,
           {_STUBLESS.format("'RE4>' || rel1_target || CASE WHEN rel2_target IS NULL THEN '' ELSE ',RE5>' || rel2_target END")} AS rels,
           {_STUBLESS.format("CASE WHEN succ_type IS NULL THEN '' ELSE succ_type || '>' || succ_target END")} AS succs,
           {_STUBLESS.format("coalesce(lower(http), '')")} AS http, {_STUBLESS.format("op_start")} AS op_start FROM <xml_src>"""


def _shown_entities(t, paths):
    e = xml.scan_xml_release(t.spark, paths)
    show = lambda c, f: F.array_join(F.transform(c, f), ",")
    http = F.try_element_at(F.filter("contacts", lambda c: c["type"] == "http"), F.lit(1))["value"]
    return e.select("code", "file_index", "ref_only", "name", "status", "record_class", "town",
                    show("roles", lambda r: F.concat_ws(":", r["id"], r["status"])).alias("roles"),
                    show("rels", lambda r: F.concat_ws(">", r["id"], r["target"])).alias("rels"),
                    show("succs", lambda s: F.concat_ws(">", s["type"], s["target"])).alias("succs"),
                    F.coalesce(http, F.lit("")).alias("http"), F.coalesce(B.operational_start(), F.lit("")).alias("op_start"))


@plan("s6_scan_xml_entities", _XML_SQL)
def _(t):
    return _shown_entities(t, written.xml_release(t))


@plan("s6b_scan_xml_sections", _XML_SQL)
def _(t):
    """The same records between commented-out ones, CDATA sections that hold closing tags, and closing tags with white space."""
    return _shown_entities(t, written.xml_sections(t))


@plan("s7_scan_xml_manifest", """
    SELECT file_index, count(*) AS record_count, '2001-08-01' AS publication_date, 'RO7009,RO6510' AS primary_role_scope FROM <xml_src> GROUP BY 1""")
def _(t):
    parts = [xml.scan_xml_manifest(t.spark, p).select(F.lit(i).alias("file_index"), "record_count", "publication_date",
                                                      F.array_join("primary_role_scope", ",").alias("primary_role_scope"))
             for i, p in enumerate(written.xml_release(t))]
    return parts[0].union(parts[1])


@plan("s8_scan_xml_concepts", """
    SELECT role_code AS code, lower(role_name) AS display_name FROM <vocab> UNION ALL SELECT substr(role_code, 3), lower(role_name) FROM <vocab>
    UNION ALL SELECT unnest(['RE4', '4']), 'is commissioned by'""")
def _(t):
    return xml.scan_xml_concepts(t.spark, written.xml_release(t))


@plan("s9_scan_ndjson", "SELECT ods_code, name, status, array_to_string(role_codes, ',') AS role_codes, legal_start FROM <orgs>")
def _(t):
    path = scratch_path(t.spark, "records") + ".ndjson"
    sinks.write_json(t.orgs, path)
    rows = tables.scan_ndjson(t.spark, path, schemas.ORGS)
    return rows.select("ods_code", "name", "status", F.array_join("role_codes", ",").alias("role_codes"), "legal_start")


@plan("s10_scan_files_binary")
def _(t):
    return files_.scan_files_binary(t.spark, t.folder, "*.parquet").select("file_name", "bytes", "sha256")


@plan("s11_scan_vocab", "SELECT role_code, role_name, CASE WHEN length(role_code) = 5 THEN 'shortened' END AS rewrite_reason FROM <vocab>")
def _(t):
    path = scratch_path(t.spark, "vocab")
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    doc = t.vocab.agg(F.lit(1).alias("version"), entries("role_code", "role_name").alias("names"),
                      F.map_from_entries(F.array_compact(F.collect_list(F.when(F.length("role_code") == 5, F.struct(
                          F.col("role_code"), F.lit("shortened").alias("v")))))).alias("rewrites"))
    doc.write.json(path)
    return reference.scan_vocab(t.spark, path)


@plan("s12_scan_catalog", """
    SELECT r.release, r.source_hash, r.source_bytes, array_to_string(r.issues, ',') AS issues, d.version, d.manifest_digest, d.doi
    FROM <catalog_releases> r LEFT JOIN <catalog_datasets> d USING (release)""")
def _(t):
    path = scratch_path(t.spark, "catalog")
    ds = t.catalog_datasets.groupBy("release").agg(F.collect_list(F.struct(
        "version", "manifest_digest", "bytes", "tool_version", "tool_git_sha", "doi", "withdrawn")).alias("datasets"))
    src = F.struct(F.col("release").alias("version"), F.col("source_hash").alias("hash"), F.col("source_bytes").alias("bytes"), "issues")
    rel = t.catalog_releases.join(ds, "release", "left").select(F.struct(src.alias("source"), "datasets").alias("r"))
    rel.agg(F.lit("register").alias("name"), F.collect_list("r").alias("releases")).write.json(path)
    return reference.scan_catalog(t.spark, path).select("release", "source_hash", "source_bytes", F.array_join("issues", ",").alias("issues"),
                                                        "version", "manifest_digest", "doi")


@plan("s13_dataset_dispatch", """
    SELECT 'parquet' AS fmt, ods_code AS code FROM <orgs> UNION ALL SELECT 'ndjson', ods_code FROM <orgs>
    UNION ALL SELECT 'xml', code FROM <xml_src>""")
def _(t):
    root = scratch_path(t.spark, "dispatch")
    none = F.array().cast("array<string>")
    full = t.orgs.withColumn("predecessor_codes", none).withColumn("successor_codes", none)
    full.select(schemas.ORGS.names).write.parquet(f"{root}/orgs.parquet")
    sinks.write_json(full, f"{root}/orgs.ndjson")
    rows = t.xml_src.select(written._entity_xml(False).alias("value"))
    rows.write.text(f"{root}/source.xml")
    code = {"parquet": "ods_code", "ndjson": "ods_code", "xml": "code"}
    parts = [tables.scan_dataset(t.spark, p).select(F.lit(tables.dataset_format(p)).alias("fmt"), F.col(code[tables.dataset_format(p)]).alias("code"))
             for p in (root, f"{root}/orgs.ndjson", f"{root}/source.xml")]
    return parts[0].union(parts[1]).union(parts[2])


# --- writers ------------------------------------------------------------------------------


def _read_back(t, df, table):
    path = scratch_path(t.spark, table)
    sinks.write_table(df, path, schemas.SORT_KEYS[table])
    return t.spark.read.parquet(path)


@plan("k1_write_orgs", "SELECT status, ods_code, name, array_to_string(role_codes, ',') AS role_codes FROM <orgs>")
def _(t):
    return _read_back(t, t.orgs, "orgs").select("status", "ods_code", "name", F.array_join("role_codes", ",").alias("role_codes"))


@plan("k2_write_roles", "SELECT ods_code, role_code, role_id, operational_end FROM <roles>")
def _(t):
    return _read_back(t, t.roles, "roles").select("ods_code", "role_code", "role_id", "operational_end")


@plan("k3_write_relationships", "SELECT source_code, target_code, rel_code, rel_id FROM <relationships>")
def _(t):
    return _read_back(t, t.relationships, "relationships").select("source_code", "target_code", "rel_code", "rel_id")


@plan("k4_write_successions", "SELECT predecessor_code, successor_code, succession_id, legal_start FROM <successions>")
def _(t):
    return _read_back(t, t.successions, "successions").select("predecessor_code", "successor_code", "succession_id", "legal_start")


@plan("k5_write_csv", """SELECT ods_code, CASE WHEN ods_code LIKE '%7' THEN '  ' || name || '", ' ELSE name END AS name, array_to_string(role_names, '; ') AS role_names,
    town FROM <orgs>""")
def _(t):
    path = scratch_path(t.spark, "csv")
    odd = F.when(F.col("ods_code").like("%7"), F.concat(F.lit("  "), "name", F.lit('", '))).otherwise(F.col("name"))
    sinks.write_csv(t.orgs.select("ods_code", odd.alias("name"), "role_names", "town"), path)
    back = t.spark.read.option("header", "true").option("escape", '"').csv(path)
    return back.select("ods_code", "name", "role_names", "town")


@plan("k6_write_json", "SELECT ods_code, name, town, array_to_string(role_names, ',') AS role_names, last_changed FROM <orgs>")
def _(t):
    path = scratch_path(t.spark, "json")
    sinks.write_json(t.orgs, path)
    back = t.spark.read.schema("ods_code string, name string, town string, role_names array<string>, last_changed date").json(path)
    return back.withColumn("role_names", F.array_join("role_names", ","))


@plan("k7_write_tsv", """
    SELECT ods_code || chr(9) || CASE WHEN ods_code LIKE '%7' THEN ' "' || name || '", a b ' ELSE name END || chr(9) || coalesce(postcode, '') || chr(9)
           || CASE WHEN role_codes = ['RO177', 'RO57'] THEN 'COST CENTRE +1' WHEN len(role_codes) = 2 THEN role_names[2] || ' +1' ELSE role_names[1] END
           || chr(9) || record_class || chr(9) || status AS line FROM <orgs>""")
def _(t):
    path = scratch_path(t.spark, "tsv")
    odd = F.when(F.col("ods_code").like("%7"), F.concat(F.lit(' "'), "name", F.lit('",\ta\nb '))).otherwise(F.col("name"))
    sinks.write_tsv(t.orgs.withColumn("name", odd), path, all_rows=True)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@plan("k8_write_diff_ndjson", """
    SELECT coalesce(n.ods_code, o.ods_code) AS ods_code, CASE WHEN o.ods_code IS NULL THEN 'added' WHEN n.ods_code IS NULL THEN 'removed' ELSE 'modified' END
             AS change_type, coalesce(n.name, o.name) AS name, CASE WHEN n.status <> o.status THEN o.status || '>' || n.status END AS status_change
    FROM <snap_old> o FULL JOIN <snap_new> n ON o.ods_code = n.ods_code
    WHERE o.ods_code IS NULL OR n.ods_code IS NULL OR o.status IS DISTINCT FROM n.status OR o.name IS DISTINCT FROM n.name OR o.role IS DISTINCT FROM n.role
       OR o.town IS DISTINCT FROM n.town OR o.postcode IS DISTINCT FROM n.postcode OR o.contacts IS DISTINCT FROM n.contacts""")
def _(t):
    from rollbook.operators.diff import diff
    path = scratch_path(t.spark, "diff")
    sinks.write_diff_ndjson(diff(t.snap_old, t.snap_new), path)
    back = t.spark.read.schema("ods_code string, change_type string, name string, changes map<string, struct<old: string, new: string>>").json(path)
    s = F.try_element_at("changes", F.lit("status"))
    return back.select("ods_code", "change_type", "name", F.when(s.isNotNull(), F.concat(s["old"], F.lit(">"), s["new"])).alias("status_change"))


_K9 = " UNION ALL ".join(
    f"SELECT n.ods_code, n.name, n.role, 'modified' AS change_type, '{c}' AS field, coalesce(o.{c}, '') AS old_value, coalesce(n.{c}, '') AS new_value "
    f"FROM <snap_old> o JOIN <snap_new> n ON o.ods_code = n.ods_code WHERE o.{c} IS DISTINCT FROM n.{c}"
    for c in ("status", "name", "role", "town", "postcode", "contacts"))


@plan("k9_write_diff_csv", f"""{_K9}
    UNION ALL SELECT ods_code, name, role, 'added', '', '', '' FROM <snap_new> WHERE ods_code NOT IN (SELECT ods_code FROM <snap_old>)
    UNION ALL SELECT ods_code, name, role, 'removed', '', '', '' FROM <snap_old> WHERE ods_code NOT IN (SELECT ods_code FROM <snap_new>)""")
def _(t):
    from rollbook.operators.diff import diff_long
    path = scratch_path(t.spark, "diffcsv")
    sinks.write_diff_csv(diff_long(t.snap_old, t.snap_new), path)
    back = t.spark.read.option("header", "true").option("escape", '"').csv(path)
    return back.select("ods_code", "name", "role", "change_type", *[F.coalesce(c, F.lit("")).alias(c) for c in ("field", "old_value", "new_value")])


@plan("k10_snapshot_append", """
    SELECT publication_date, count(*) AS n, count(*) FILTER (WHERE publication_date = date '2024-01-09') AS replaced FROM <snapshots>
    WHERE publication_date <> date '2024-01-09' OR ods_code < 'U3' GROUP BY 1""")
def _(t):
    path = written.series(t)
    again = t.snapshots.where("publication_date = date '2024-01-09' AND ods_code < 'U3'")
    sinks.snapshot_append(again, path)
    return t.spark.read.parquet(path).groupBy("publication_date").agg(
        F.count("*").alias("n"), F.count_if(F.col("publication_date") == F.lit("2024-01-09").cast("date")).alias("replaced"))


_FIELDS = {
    "customer": "c_custkey:integer c_name:string c_nationkey:integer c_acctbal:number c_mktsegment:string",
    "orders": "o_orderkey:integer o_custkey:integer o_orderstatus:string o_totalprice:number o_orderdate:datetime o_orderpriority:string",
    "part": "p_partkey:integer p_name:string p_brand:string p_type:string p_size:integer p_retailprice:number",
    "events": "event_id:integer ts:datetime user_id:integer event_type:string value:number props:string",
}
_EXPORT = " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, {i} AS position, '{f.split(':')[0]}' AS field, '{f.split(':')[1]}' AS type, count(*) - count({f.split(':')[0]}) AS nulls FROM <{tb}>"
    for tb, fs in _FIELDS.items() for i, f in enumerate(fs.split(), 1))


@plan("k11_table_schema_export", _EXPORT)
def _(t):
    contract = sinks.table_schema_export(t.spark, {g: getattr(t, g).schema for g in _FIELDS})
    nulls = [sinks.observed_nulls(getattr(t, g)).withColumn("table_name", F.lit(g)) for g in _FIELDS]
    seen = nulls[0].unionByName(nulls[1]).unionByName(nulls[2]).unionByName(nulls[3])
    return contract.join(seen, ["table_name", "field"]).select("table_name", "position", "field", "type", "nulls")


@plan("k12_file_manifest")
def _(t):
    return files_.release_digest(files_.scan_files_binary(t.spark, t.folder, "*.parquet"))


# --- build --------------------------------------------------------------------------------


def _entities(t):
    """Merged, normalised source entities of the written release, and its code list."""
    paths = written.xml_release(t)
    records = xml.scan_xml_release(t.spark, paths).withColumn("op_start", B.operational_start())
    return B.normalise_entities(B.merge_entities(records)), paths


@plan("b1_choose_source_pair", """
    WITH f AS (SELECT * FROM <source_files>), per AS (SELECT a.release, a.publication_date AS d, abs(a.publication_date - a.release_date) AS dist, count(*) AS n,
        min(a.file_name) AS full_file, min(b.file_name) AS archive_file
      FROM f a JOIN f b ON a.release = b.release AND a.kind = 'full' AND b.kind = 'archive' AND a.publication_date = b.publication_date GROUP BY ALL),
    tot AS (SELECT release, sum(n) AS pairs, min(dist) AS best FROM per GROUP BY 1),
    pick AS (SELECT per.release, sum(n) AS near, min(full_file) AS full_file, min(archive_file) AS archive_file, min(d) AS d
           FROM per JOIN tot ON per.release = tot.release AND dist = best GROUP BY 1),
    v AS (SELECT r.release, CASE WHEN pairs IS NULL THEN 'no pair' WHEN pairs = 1 OR near = 1 THEN 'chosen' ELSE 'tie' END AS verdict, full_file, archive_file, d
          FROM (SELECT DISTINCT release FROM f) r LEFT JOIN tot USING (release) LEFT JOIN pick USING (release))
    SELECT release, verdict, CASE WHEN verdict = 'chosen' THEN full_file END AS full_file, CASE WHEN verdict = 'chosen' THEN archive_file END AS archive_file,
           CASE WHEN verdict = 'chosen' THEN d END AS publication_date FROM v""")
def _(t):
    return B.choose_source_pair(t.source_files)


@plan("b2_agree_publication_date", """
    SELECT release, count(*) FILTER (WHERE publication_date IS NULL OR publication_date = '2001-13-01') AS undated_files,
           count(DISTINCT publication_date) AS dates,
           CASE WHEN bool_or(publication_date IS NULL OR publication_date = '2001-13-01') THEN 'undated' WHEN count(DISTINCT publication_date) > 1
             THEN 'disagree' ELSE 'agreed' END AS verdict,
           CASE WHEN NOT bool_or(publication_date IS NULL OR publication_date = '2001-13-01') AND count(DISTINCT publication_date) = 1
             THEN cast(min(try_cast(publication_date as date)) as date) END AS publication_date FROM <manifests> GROUP BY release""")
def _(t):
    return B.agree_publication_date(t.manifests, "release")


@plan("b2b_stated_dates", """
    SELECT release, file_name, CASE WHEN publication_date IS NULL THEN 'no PublicationDate' WHEN publication_date = '2001-13-01'
      THEN 'PublicationDate ''2001-13-01'', not a date' ELSE 'PublicationDate ' || publication_date END AS says FROM <manifests>""")
def _(t):
    return B.stated_dates(t.manifests).select("release", "file_name", "says")


_PREF = "ORDER BY NOT ref_only DESC, file_index, op_start DESC NULLS LAST"


@plan("b3_merge_entities", f"""
    SELECT code, file_index, ref_only, op_start, CASE WHEN twins = 1 THEN name END AS name, twins > 1 AS tied FROM (
      SELECT *, row_number() OVER (PARTITION BY code {_PREF}, name) AS rn, count(*) OVER (PARTITION BY code, file_index, ref_only, op_start) AS twins
      FROM <raw_records>) x WHERE rn = 1""")
def _(t):
    """Which of several equal records is kept depends on their order in the file, so their names are left open."""
    key = ["code", "file_index", "ref_only", "op_start"]
    twins = t.raw_records.groupBy(*key).agg(F.count("*").alias("twins")).where("twins > 1").select(*[F.col(c).alias(f"t_{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in key]
    kept, tied = B.merge_entities(t.raw_records).join(twins, same, "left"), F.col("t_code").isNotNull()
    return kept.select(*key, F.when(~tied, F.col("name")).alias("name"), tied.alias("tied"))


@plan("b3b_merge_contradictions", """
    WITH w AS (SELECT code, min(file_index) FILTER (WHERE NOT ref_only) AS win FROM <raw_records> GROUP BY 1),
    f AS (SELECT r.code, count(*) AS records, count(*) FILTER (WHERE ref_only AND (win IS NULL OR file_index < win)) AS early,
            count(*) FILTER (WHERE NOT ref_only AND file_index = win) AS rivals,
            count(*) FILTER (WHERE NOT ref_only AND file_index = win AND op_start IS NULL) AS undated,
            max(op_start) FILTER (WHERE NOT ref_only AND file_index = win) AS top, win FROM <raw_records> r JOIN w USING (code) GROUP BY r.code, win),
    g AS (SELECT f.*, (SELECT count(*) FROM <raw_records> r WHERE r.code = f.code AND NOT ref_only AND r.file_index = f.win AND r.op_start = f.top) AS at_top FROM f)
    SELECT * FROM (SELECT code, records, CASE WHEN early > 1 THEN 'two stubs' WHEN rivals > 1 AND undated > 0 THEN 'no start to compare'
      WHEN rivals > 1 AND at_top > 1 THEN 'equal start' END AS reason FROM g) x WHERE reason IS NOT NULL""")
def _(t):
    return B.merge_contradictions(t.raw_records)


@plan("b4_merge_report", """
    WITH w AS (SELECT code, min(file_index) FILTER (WHERE NOT ref_only) AS win FROM <raw_records> GROUP BY 1),
    s AS (SELECT r.code, max(op_start) AS top FROM <raw_records> r JOIN w ON r.code = w.code AND r.file_index = win AND NOT ref_only GROUP BY 1)
    SELECT CASE WHEN ref_only AND win IS NOT NULL THEN 'stub superseded' WHEN ref_only THEN 'stub kept'
             WHEN file_index <> win THEN 'dropped: complete in an earlier file' WHEN op_start IS NOT DISTINCT FROM top THEN 'kept'
             ELSE 'dropped: starts earlier in the same file' END AS fate, count(*) AS records
    FROM <raw_records> r JOIN w USING (code) LEFT JOIN s USING (code) GROUP BY 1""")
def _(t):
    return B.merge_report(t.raw_records)


@plan("b5_check_record_counts", "SELECT count(*) AS declared, count(*) AS read, 0 AS undeclared_files, true AS ok FROM <xml_src>")
def _(t):
    paths = written.xml_release(t)
    manifests = xml.scan_xml_manifest(t.spark, paths[0]).unionByName(xml.scan_xml_manifest(t.spark, paths[1]))
    records = xml.scan_xml_release(t.spark, paths)
    # the written folders hold many part files; totals are what the check compares
    return B.check_record_counts(records.withColumn("file_name", F.lit("all")), manifests.withColumn("file_name", F.lit("all"))
                                 .groupBy("file_name").agg(F.sum("record_count").alias("record_count"))).withColumn(
        "undeclared_files", F.col("undeclared_files").cast("int"))


_STATUS = "coalesce(lower(status), CASE WHEN ref_only THEN 'active' ELSE lower(role1_status) END)"


@plan("b6_normalise_entities", f"""
    SELECT code, {_STATUS} AS status, CASE record_class WHEN 'RC2' THEN 'site' ELSE 'org' END AS record_class,
           CASE WHEN ref_only OR rel2_target IS NULL THEN NULL ELSE lower(rel2_status) END AS rel2_status FROM <xml_kept>""")
def _(t):
    e, _p = _entities(t)
    return e.select("code", "status", "record_class", F.try_element_at("rels", F.lit(2))["status"].alias("rel2_status"))


@plan("b7_pick_dates", """
    SELECT code, CASE WHEN NOT ref_only THEN legal_start END AS legal_start, CASE WHEN NOT ref_only THEN legal_end END AS legal_end,
           CASE WHEN NOT ref_only THEN op_start END AS operational_start, CASE WHEN NOT ref_only THEN op_end END AS operational_end FROM <xml_kept>""")
def _(t):
    e, _p = _entities(t)
    return e.select("code", *[c.alias(n) for n, c in B.pick_dates("dates").items()])


@plan("b8_parse_date_lenient", """
    SELECT raw, CASE WHEN regexp_matches(raw, '^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$') THEN try_cast(raw as date) END AS parsed FROM (
      SELECT DISTINCT unnest([legal_start, op_start, op_end, substr(op_start, 1, 4), op_start || 'T00', replace(op_start, '-0', '-')]) AS raw FROM <xml_src>) x""")
def _(t):
    raws = F.array("legal_start", "op_start", "op_end", F.substring("op_start", 1, 4), F.concat("op_start", F.lit("T00")),
                   F.replace("op_start", F.lit("-0"), F.lit("-")))
    return t.xml_src.select(F.explode(raws).alias("raw")).distinct().select("raw", parse_date("raw").alias("parsed"))


@plan("b9_unread_dates", """
    SELECT count(*) AS unread, min(code) AS code, 'operational_end' AS "column", '1999-02-30' AS value FROM <xml_kept> WHERE NOT ref_only AND op_end = '1999-02-30'""")
def _(t):
    e, _p = _entities(t)
    return B.unread_dates(e, "code", B.pick_dates("dates"))


_ROLES = f"""CASE WHEN ref_only THEN '' WHEN {_STATUS} <> 'active' THEN CASE WHEN role2 IS NULL THEN role1 ELSE role2 || ',' || role1 END
    ELSE array_to_string(list_filter([CASE WHEN role2_status = 'Active' THEN role2 END, CASE WHEN role1_status = 'Active' THEN role1 END],
         lambda x: x IS NOT NULL), ',') END"""


@plan("b10_role_codes", f"SELECT code, {_ROLES} AS role_codes FROM <xml_kept>")
def _(t):
    e, _p = _entities(t)
    return e.select("code", F.array_join(B.role_codes(), ",").alias("role_codes"))


@plan("b11_role_names", f"""
    SELECT ods_code, string_agg(role_name, ',' ORDER BY p) AS role_names FROM (SELECT ods_code, unnest(role_codes) AS role_code,
      unnest(range(1, len(role_codes) + 1)) AS p FROM <orgs>) x JOIN <vocab> USING (role_code) GROUP BY 1""")
def _(t):
    return B.with_role_names(t.orgs.drop("role_names"), t.vocab).select("ods_code", F.array_join("role_names", ",").alias("role_names"))


@plan("b12_primary_role_code", "SELECT code, CASE WHEN ref_only THEN '' ELSE role1 END AS primary_role_code FROM <xml_kept>")
def _(t):
    e, _p = _entities(t)
    return e.select("code", B.primary_role_code().alias("primary_role_code"))


_ADDRESS = """CASE WHEN ref_only THEN NULL ELSE array_to_string(list_filter([addr1, nullif(trim(addr2), ''), town, postcode],
    lambda x: x IS NOT NULL), ', ') END"""


@plan("b13_address_concat", f"SELECT code, {_ADDRESS} AS address FROM <xml_kept>")
def _(t):
    e, _p = _entities(t)
    return e.select("code", B.address().alias("address"))


@plan("b14_first_contact", """
    SELECT code, CASE WHEN NOT ref_only THEN tel END AS telephone, CASE WHEN NOT ref_only THEN lower(http) END AS website FROM <xml_kept>""")
def _(t):
    e, _p = _entities(t)
    return e.select("code", B.first_contact("tel").alias("telephone"), B.first_contact("http").alias("website"))


@plan("b15_explode_roles", """
    SELECT code AS ods_code, role1 AS role_code, role_name, true AS is_primary, lower(role1_status) AS role_status, code || '-r1' AS role_id
    FROM <xml_kept> LEFT JOIN <vocab> ON role_code = role1 WHERE NOT ref_only
    UNION ALL SELECT code, role2, 'COST CENTRE', false, lower(role2_status), code || '-r2' FROM <xml_kept> WHERE NOT ref_only AND role2 IS NOT NULL""")
def _(t):
    e, _p = _entities(t)
    return B.explode_roles(e, t.vocab, written.PUBLISHED).select("ods_code", "role_code", "role_name", "is_primary", "role_status", "role_id")


@plan("b16_explode_relationships", """
    SELECT code AS source_code, rel1_target AS target_code, 'RE4' AS rel_code, 'is commissioned by' AS rel_name, 'active' AS rel_status,
           cast(op_start as date) AS operational_start, code || '-e1' AS rel_id FROM <xml_kept> WHERE NOT ref_only
    UNION ALL SELECT code, rel2_target, 'RE5', 'RE5', lower(rel2_status), cast(op_start as date), code || '-e2' FROM <xml_kept>
    WHERE NOT ref_only AND rel2_target IS NOT NULL""")
def _(t):
    records, concepts = xml.scan_xml_parts(t.spark, written.xml_release(t), ["code", "ref_only", "dates", "rels"])
    kept = B.merge_entities(records.withColumn("op_start", B.operational_start()).select("code", "ref_only", "file_index", "op_start", "rels"))
    return B.explode_relationships(kept.withColumn("rels", B.normal_relationships()), concepts, written.PUBLISHED).select(
        "source_code", "target_code", "rel_code", "rel_name", "rel_status", "operational_start", "rel_id")


_SUCC = """(SELECT succession_id, predecessor_code, successor_code, legal_start FROM (SELECT succ_id AS succession_id,
      CASE succ_type WHEN 'Predecessor' THEN succ_target ELSE code END AS predecessor_code,
      CASE succ_type WHEN 'Predecessor' THEN code ELSE succ_target END AS successor_code, cast(op_start as date) AS legal_start,
      row_number() OVER (PARTITION BY succ_id ORDER BY code) AS rn FROM <xml_kept> WHERE NOT ref_only AND succ_type IS NOT NULL) x WHERE rn = 1)"""


@plan("b17_succession_edges", f"SELECT predecessor_code, successor_code, legal_start, succession_id FROM {_SUCC} s")
def _(t):
    e, _p = _entities(t)
    return B.succession_edges(e, written.PUBLISHED).select("predecessor_code", "successor_code", "legal_start", "succession_id")


@plan("b18_vocab_missing", "SELECT DISTINCT role_code FROM <roles> WHERE role_code NOT IN (SELECT role_code FROM <vocab>)")
def _(t):
    return B.vocab_missing(t.roles, t.vocab)


@plan("b19_project_orgs", f"""
    WITH RECURSIVE e AS (SELECT predecessor_code AS a, successor_code AS b FROM {_SUCC} s),
    p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a),
    su AS (SELECT a AS code, string_agg(b, ',' ORDER BY b) AS l FROM p WHERE a <> b GROUP BY 1),
    pr AS (SELECT b AS code, string_agg(a, ',' ORDER BY a) AS l FROM p WHERE a <> b GROUP BY 1)
    SELECT code AS ods_code, name, {_STATUS} AS status, CASE record_class WHEN 'RC2' THEN 'site' ELSE 'org' END AS record_class, {_ROLES} AS role_codes,
           CASE WHEN ref_only THEN '' ELSE role1 END AS primary_role_code, {_ADDRESS} AS address,
           CASE WHEN ref_only OR legal_start IS NULL THEN NULL ELSE try_cast(legal_start as date) END AS legal_start,
           CASE WHEN ref_only THEN NULL ELSE try_cast(op_end as date) END AS operational_end, date '2000-05-05' AS last_changed,
           coalesce(su.l, '') AS successor_codes, coalesce(pr.l, '') AS predecessor_codes, date '2001-08-01' AS publication_date
    FROM <xml_kept> LEFT JOIN su USING (code) LEFT JOIN pr USING (code)""")
def _(t):
    e, _p = _entities(t)
    e = checkpoint(e)  # the closure and the projection both read it
    pairs = G.successor_pairs(B.succession_edges(e, written.PUBLISHED))
    orgs = B.project_orgs(e, t.vocab, G.closure_list(pairs, "successor_code", "successor_codes"),
                          G.closure_list(G.predecessor_pairs(pairs), "predecessor_code", "predecessor_codes"), written.PUBLISHED)
    flat = lambda c: F.array_join(c, ",").alias(c)
    return orgs.select("ods_code", "name", "status", "record_class", flat("role_codes"), "primary_role_code", "address", "legal_start", "operational_end",
                       "last_changed", flat("successor_codes"), flat("predecessor_codes"), "publication_date")


@plan("b20_parent_and_region", """
    SELECT code, CASE WHEN NOT ref_only THEN rel1_target END AS parent, CASE WHEN NOT ref_only AND rel2_status = 'Active' THEN rel2_target END AS region
    FROM <xml_kept>""")
def _(t):
    e, _p = _entities(t)
    return B.parent_and_region(e)


@plan("b21_primary_role_display", """
    SELECT code, CASE WHEN ref_only THEN 'unknown' ELSE lower(role_name) END AS role FROM <xml_kept> LEFT JOIN <vocab> ON role_code = role1""")
def _(t):
    e, paths = _entities(t)
    return B.primary_role_display(e, xml.scan_xml_concepts(t.spark, paths))


@plan("fn_archive_name", """
    SELECT file_name, version, 'Release ' || version AS label, release_date FROM (
      SELECT 'hscorgrefdataxml_data_' || cast(n as string) || '.0.0_' || replace(cast(d as string), '-', '') || '000001.zip' AS file_name,
             cast(n as string) || '.0.0' AS version, d AS release_date FROM (SELECT DISTINCT cast(o_orderdate as date) AS d, o_custkey % 9 AS n FROM <orders>) x) y
    UNION ALL SELECT o_orderpriority || '.zip', NULL, NULL, NULL FROM <orders> GROUP BY 1""")
def _(t):
    day = F.col("o_orderdate").cast("date").cast("string")
    names = t.orders.select(F.concat(F.lit("hscorgrefdataxml_data_"), (F.col("o_custkey") % 9).cast("string"), F.lit(".0.0_"),
                                     F.replace(day, F.lit("-"), F.lit("")), F.lit("000001.zip")).alias("file_name")).distinct()
    names = names.union(t.orders.select(F.concat("o_orderpriority", F.lit(".zip"))).distinct())
    return names.select("file_name", archive_name_parts("file_name").alias("p")).select("file_name", "p.version", "p.label", "p.release_date")


@plan("b22_make_release", f"""
    SELECT 'orgs' AS table_name, count(*) AS n_rows, min(code) AS first_key FROM <xml_kept>
    UNION ALL SELECT 'roles', count(*) + count(role2), min(code) || '-r1' FROM <xml_kept> WHERE NOT ref_only
    UNION ALL SELECT 'relationships', count(*) + count(rel2_target), min(code) || '-e1' FROM <xml_kept> WHERE NOT ref_only
    UNION ALL SELECT 'successions', count(*), min(succession_id) FROM {_SUCC} s""")
def _(t):
    from rollbook.operators.make import make_release
    out = scratch_path(t.spark, "made")
    make_release(t.spark, written.xml_release(t), t.vocab, out)
    parts = [tables.scan_table(t.spark, out, name).agg(F.count("*").alias("n_rows"), F.min(key).alias("first_key"))
             .select(F.lit(name).alias("table_name"), "n_rows", "first_key") for name, key in schemas.PRIMARY_KEYS.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@plan("fn_country_title", """
    SELECT country, CASE country WHEN 'ENGLAND' THEN 'England' WHEN 'SCOTLAND' THEN 'Scotland' WHEN 'WALES' THEN 'Wales' WHEN 'NORTHERN IRELAND'
      THEN 'Northern Ireland' ELSE country END AS shown, count(*) AS n FROM (SELECT country FROM <orgs> UNION ALL SELECT county FROM <orgs>) x GROUP BY 1, 2""")
def _(t):
    rows = t.orgs.select("country").unionAll(t.orgs.select("county"))
    return rows.groupBy("country", country_title("country").alias("shown")).agg(F.count("*").alias("n"))


@plan("fn_semver_and_thousands", """
    SELECT tool_version, array_to_string(list_transform(string_split(tool_version, '.'), lambda x: cast(cast(x as bigint) as varchar)), ',') AS parts,
      format('{:,}', cast(sum(bytes) as bigint)) AS shown FROM <catalog_datasets> GROUP BY 1""")
def _(t):
    return t.catalog_datasets.groupBy("tool_version").agg(F.sum("bytes").alias("b")).select(
        "tool_version", F.array_join(semver("tool_version").cast("array<string>"), ",").alias("parts"), thousands("b").alias("shown"))


@plan("fn_role_display", """
    SELECT ods_code, CASE WHEN role_codes = ['RO177', 'RO57'] THEN 'COST CENTRE +1' WHEN len(role_codes) = 2 THEN role_names[2] || ' +1' ELSE role_names[1] END
      AS shown, array_to_string(role_names, ', ') AS verbose FROM <orgs>""")
def _(t):
    return t.orgs.select("ods_code", role_display("role_codes", "role_names").alias("shown"),
                         role_display("role_codes", "role_names", verbose=True).alias("verbose"))
