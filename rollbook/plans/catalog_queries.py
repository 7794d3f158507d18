"""Release catalogue queries (group C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import catalog as C
from rollbook.plans.registry import plan

_V = "list_transform(string_split(split_part(version, '_', 2), '.'), lambda x: cast(x as bigint))"
_BEST = f"""best AS (SELECT release, arg_max(version, (CASE WHEN withdrawn IS NULL THEN 1 ELSE 0 END, {_V})) AS version, bool_and(withdrawn IS NOT NULL) AS is_withdrawn
    FROM <catalog_datasets> GROUP BY 1)"""


@plan("c1_resolve_latest", f"""
    WITH {_BEST} SELECT release, version, CASE WHEN is_withdrawn THEN 'skipped' ELSE 'chosen' END AS outcome FROM best
    WHERE release >= (SELECT max(release) FROM best WHERE NOT is_withdrawn)""")
def _(t):
    return C.resolve_latest(t.catalog_datasets)


@plan("c2_select_version", f"WITH {_BEST} SELECT release, version, is_withdrawn FROM best")
def _(t):
    return C.select_version(t.catalog_datasets)


_MERGED = """SELECT coalesce(a.release, b.release) AS release, coalesce(a.version, b.version) AS version, coalesce(a.manifest_digest, b.manifest_digest)
      AS manifest_digest, coalesce(a.doi, b.doi) AS doi, coalesce(a.withdrawn, b.withdrawn) AS withdrawn
    FROM <old_datasets> a FULL JOIN <new_datasets> b ON a.release = b.release AND a.version = b.version"""


@plan("c3_append_only_merge", _MERGED)
def _(t):
    return C.merge_datasets(t.old_datasets, t.new_datasets).select("release", "version", "manifest_digest", "doi", "withdrawn")


@plan("c3b_merge_releases", """
    SELECT release, coalesce(a.source_hash, b.source_hash) AS source_hash, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.issues, []),
      coalesce(b.issues, [])))), ',') AS issues FROM <old_releases> a FULL JOIN <new_releases> b USING (release)""")
def _(t):
    return C.merge_releases(t.old_releases, t.new_releases).select(
        "release", "source_hash", F.array_join(F.array_sort("issues"), ",").alias("issues"))


@plan("c3c_catalog_contradictions", """
    SELECT release AS item, 'source_hash' AS field, a.source_hash AS recorded, b.source_hash AS candidate FROM <old_releases> a JOIN <new_releases> b USING (release)
    WHERE a.source_hash <> b.source_hash
    UNION ALL SELECT release, 'source_bytes', cast(a.source_bytes as string), cast(b.source_bytes as string) FROM <old_releases> a JOIN <new_releases> b USING (release)
    WHERE a.source_bytes <> b.source_bytes
    UNION ALL SELECT version, 'manifest_digest', a.manifest_digest, b.manifest_digest FROM <old_datasets> a JOIN <new_datasets> b USING (release, version)
    WHERE a.manifest_digest <> b.manifest_digest
    UNION ALL SELECT version, 'bytes', cast(a.bytes as string), cast(b.bytes as string) FROM <old_datasets> a JOIN <new_datasets> b USING (release, version)
    WHERE a.bytes <> b.bytes""")
def _(t):
    return C.catalog_contradictions(t.old_releases, t.new_releases, t.old_datasets, t.new_datasets)


@plan("c4_catalog_validate", """
    SELECT release AS item, 'malformed or repeated issue' AS problem FROM <catalog_releases> WHERE list_contains(issues, 'Bad Issue')
    UNION ALL SELECT version, 'malformed commit' FROM <catalog_datasets> WHERE low % 101 = 7
    UNION ALL SELECT version, 'version does not extend its release' FROM <catalog_datasets> WHERE low % 90 = 3
    UNION ALL SELECT version, 'bytes not positive' FROM <catalog_datasets> WHERE bytes <= 0
    UNION ALL SELECT version, 'duplicate dataset' FROM <catalog_datasets> WHERE low % 75 = 0""")
def _(t):
    d = t.catalog_datasets
    again = d.where("low % 75 = 0")
    off = d.withColumn("release", F.when(F.col("low") % 90 == 3, F.lit("1990-01-01")).otherwise(F.col("release")))
    hurt = off.union(again.withColumn("release", F.when(F.col("low") % 90 == 3, F.lit("1990-01-01")).otherwise(F.col("release"))))
    return C.catalog_validate(t.catalog_releases, hurt).distinct()


@plan("c5_catalog_status", """
    SELECT release, version, CASE WHEN withdrawn IS NOT NULL THEN 'withdrawn (' || withdrawn || ')' WHEN release IN (SELECT max(release) FROM <catalog_releases>
        WHERE release < '2001-01-01') THEN 'active (local)' WHEN release >= '2000-06-01' AND release < '2001-01-01' THEN 'local' ELSE 'remote' END AS status,
      manifest_digest FROM <catalog_datasets>""")
def _(t):
    local = t.catalog_releases.where("release >= '2000-06-01' AND release < '2001-01-01'")
    active = local.agg(F.max("release").alias("release"))
    return C.catalog_status(t.catalog_datasets, local, active)


@plan("c6_match_by_hash", """
    SELECT DISTINCT cast(o_orderdate as date) AS day, cast(cast(o_orderdate as date) as string) AS release FROM <orders> WHERE o_orderkey % 2 = 0""")
def _(t):
    day = F.col("o_orderdate").cast("date")
    sha = F.when(F.col("o_orderkey") % 2 == 0, F.upper(F.sha2(day.cast("string"), 256))).otherwise(F.lit("nothing"))
    files = t.orders.select(day.alias("day"), sha.alias("sha256")).distinct()
    return C.match_by_hash(files, t.catalog_releases).select("day", "release")


@plan("c7_verify_release", """
    WITH found AS (SELECT CASE WHEN low % 17 = 1 THEN '1980-01-01' ELSE d.release END AS release, CASE WHEN low % 17 = 2 THEN d.release || '_9.9.9' ELSE version END
        AS version, CASE WHEN low % 17 = 3 THEN 'sha256:00' ELSE source_hash END AS source_hash,
        CASE WHEN low % 17 = 4 THEN 'sha256:11' ELSE manifest_digest END AS manifest_digest FROM <catalog_datasets> d JOIN <catalog_releases> r USING (release))
    SELECT f.release, f.version, f.manifest_digest, d.manifest_digest AS published_digest, CASE WHEN r.release IS NULL THEN 'date unknown'
      WHEN r.source_hash <> f.source_hash THEN 'different archive' WHEN d.version IS NULL THEN 'version unpublished'
      WHEN d.manifest_digest <> f.manifest_digest THEN 'different bytes' ELSE 'published' END AS verdict
    FROM found f LEFT JOIN <catalog_releases> r ON r.release = f.release LEFT JOIN <catalog_datasets> d ON d.release = f.release AND d.version = f.version""")
def _(t):
    m = F.col("low") % 17
    j = t.catalog_datasets.join(t.catalog_releases, "release")
    found = j.select(F.when(m == 1, "1980-01-01").otherwise(F.col("release")).alias("release"),
                     F.when(m == 2, F.concat("release", F.lit("_9.9.9"))).otherwise(F.col("version")).alias("version"),
                     F.when(m == 3, "sha256:00").otherwise(F.col("source_hash")).alias("source_hash"),
                     F.when(m == 4, "sha256:11").otherwise(F.col("manifest_digest")).alias("manifest_digest"))
    return C.verify_release(found, t.catalog_releases, t.catalog_datasets)


@plan("c8_source_issues", "SELECT release, unnest(issues) AS issue FROM <catalog_releases>")
def _(t):
    return C.source_issues(t.catalog_releases)
