"""History, diff, profile, audit, catalogue, writers and the change feed on small fixtures."""

import datetime
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from rollbook import schemas
from rollbook.operators import audit as A
from rollbook.operators import catalog as C
from rollbook.operators import diff as X
from rollbook.operators import graph as G
from rollbook.operators import history as W
from rollbook.operators import profile as P
from rollbook.plans.audit_queries import _series
from rollbook.sources import files, sinks, tables
from rollbook.streaming.changefeed import announce, read_markers, start_change_feed


# --- history ------------------------------------------------------------------------------


def test_large_groups_lag_like_a_window(spark, t):
    rows = t.rel_series.withColumn("source_code", F.when(F.col("source_code") < "S5", F.lit("HOT")).otherwise(F.col("source_code")))
    rows = rows.withColumn("target_code", F.when(F.col("target_code").endswith("7"), F.lit(None)).otherwise(F.col("target_code")))
    keys, order = ["source_code", "rel_code"], ["publication_date", "rel_id", "target_code"]
    rows = rows.select(*keys, *order).distinct()
    spread = W.previous_in_order(rows, keys, order, "target_code", "prev", hot_rows=50)
    plain = rows.withColumn("prev", F.lag("target_code").over(Window.partitionBy(*keys).orderBy(*order))).select(spread.columns)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, spread.collect())) == sorted(map(key, plain.collect()))


def test_deleted_and_new_codes_use_the_series_ends(spark):
    rows = [("A", "2026-01-01"), ("A", "2026-02-01"), ("B", "2026-01-01"), ("C", "2026-02-01")]
    s = spark.createDataFrame(rows, "ods_code string, publication_date string").withColumn("publication_date", F.col("publication_date").cast("date"))
    assert [r.ods_code for r in W.deleted_codes(s).collect()] == ["B"] and [r.ods_code for r in W.new_codes(s).collect()] == ["C"]
    assert W.staleness(s, "2026-03-19").head()[1:] == (46, True) and W.staleness(s, "2026-03-18").head()[1:] == (45, False)


# --- diff ---------------------------------------------------------------------------------

_D = "ods_code string, name string, status string, role string, town string, postcode string, contacts string"


def snapshots(spark):
    old = [("A", "Alpha", "active", "GP", "X", "N1 1AA", "t1"), ("B", "Beta", "active", "GP", None, None, "t1"), ("C", "Gamma", "active", "Trust", "X", "N1", None),
           ("D", "Delta", "inactive", "GP", "X", "N1", "t")]
    new = [("A", "Alpha Ltd", "inactive", "GP", "Y", "N1 1AA", "t2"), ("B", "Beta", "active", "GP", None, None, "t2"), ("D", "Delta", "inactive", "GP", "X", "N1", "t"),
           ("E", "Eps", "active", "Trust", None, "E1", None)]
    return spark.createDataFrame(old, _D), spark.createDataFrame(new, _D)


def test_diff_rows_and_totals(spark):
    old, new = snapshots(spark)
    rows = {r.ods_code: r for r in X.diff(old, new).collect()}
    assert {k: r.change_type for k, r in rows.items()} == {"A": "modified", "B": "modified", "C": "removed", "E": "added"}
    assert set(rows["A"].changes) == {"status", "name", "town", "contacts"} and rows["A"].changes["town"] == Row(old="X", new="Y")
    assert rows["C"].record.name == "Gamma" and rows["A"].record is None
    assert X.diff_stats(old, new).head() == (1, 1, 1, 1)
    s = X.diff_summary(old, new).head()
    assert (s.baseline_count, s.target_count, s.added_count, s.removed_count, s.modified_count, s.unchanged_count, float(s.modified_pct)) == (4, 4, 1, 1, 2, 1, 50.0)
    assert {r.ods_code for r in X.diff(old, new, role="tru").collect()} == {"C", "E"}
    assert {r.ods_code for r in X.diff(old, new, only_active=True).collect()} == {"A", "B", "C", "E"}


# --- profile ------------------------------------------------------------------------------


def test_anomalies_first_rule_wins(spark):
    rows = [("c", None, None), ("c", "2021-01-01", "2022-01-01"), ("c", "2010-01-01", "2021-01-01"), ("c", "2010-01-01", "2019-01-01"), ("o", None, None)]
    items = spark.createDataFrame(rows, "ods_code string, s string, e string").select(
        "ods_code", F.col("s").cast("date").alias("operational_start"), F.col("e").cast("date").alias("operational_end"))
    orgs = spark.createDataFrame([("c", "inactive", "2020-01-01"), ("o", "active", None)], "ods_code string, status string, e string").select(
        "ods_code", "status", F.col("e").cast("date").alias("operational_end"))
    got = sorted((r.ods_code, r.anomaly or "") for r in P.with_anomaly(items, orgs).collect())
    assert got == [("c", ""), ("c", "ends-after"), ("c", "starts-after"), ("c", "still-open"), ("o", "")]


def test_documents_are_whole_json_and_split_without_loss(t):
    items = P.profile_items(t.orgs, t.relationships, G.succession_chain(t.successions, t.orgs), G.direct_predecessors(t.successions, t.orgs))
    whole = {r.ods_code: json.loads(r.document) for r in P.profile_json(t.orgs, items).collect()}
    assert len(whole) == t.orgs.count()
    parts = P.profile_json(t.orgs, items, part_rows=100).collect()
    assert max(r.part for r in parts) > 0
    for code in ("S1", "S4", "P3"):
        pieces = [json.loads(r.document) for r in parts if r.ods_code == code]
        joined = sorted(json.dumps(x) for p in pieces for x in p["relationships"])
        assert joined == sorted(json.dumps(x) for x in whole[code]["relationships"])
    rels = whole["P3"]["relationships"]
    assert [r["direction"] for r in rels] == sorted((r["direction"] for r in rels), reverse=True)
    starts = [r["operational_start"] for r in rels if r["direction"] == "inbound" and r["rel_name"] == "IS OPERATED BY" and r["status"] == "active"]
    assert starts == sorted(starts, reverse=True)


# --- audit: corrupt one thing, one check must fail ------------------------------------------


@pytest.fixture(scope="module")
def clean(spark):
    """A small register that passes every table check."""
    day, none = datetime.date(2026, 7, 28), None
    org = lambda c, pred, succ: (c, f"N{c}", "active", "org", ["RO1"], ["One"], "RO1", *[none] * 8, pred, succ, *[none] * 5, day)
    role = lambda c: (c, "RO1", "One", True, "active", none, none, none, none, f"r{c}", day)
    frame = lambda rows, name: spark.createDataFrame(rows, schemas.TABLES[name])
    return {
        "orgs": frame([org("A", [], ["B", "C"]), org("B", ["A"], ["C"]), org("C", ["A", "B"], [])], "orgs"),
        "roles": frame([role(c) for c in "ABC"], "roles"),
        "relationships": frame([("A", "B", "RE4", "x", "active", none, none, none, none, "e1", day), ("B", "C", "RE4", "x", "active", none, none, none, none, "e2", day)],
                               "relationships"),
        "successions": frame([("A", "B", none, "s1", day), ("B", "C", none, "s2", day)], "successions"),
        "vocab": spark.createDataFrame([("RO1", "One")], "role_code string, role_name string"),
    }


def failing(tables_):
    pairs = G.successor_pairs(tables_["successions"])
    checks = A.table_audit(tables_["orgs"], tables_["roles"], tables_["relationships"], tables_["successions"], tables_["vocab"], pairs)
    return {r.check_name for r in checks.where("n > 0").collect()}


def test_clean_tables_pass(clean):
    assert failing(clean) == set()


@pytest.mark.parametrize("table,change,expected", [
    ("orgs", lambda d: d.union(d.where("ods_code = 'A'")), {"pk_unique:orgs"}),
    ("roles", lambda d: d.withColumn("ods_code", F.when(F.col("ods_code") == "A", "Q").otherwise(F.col("ods_code"))), {"fk:roles"}),
    ("relationships", lambda d: d.withColumn("target_code", F.lit("Q")), {"fk:relationships"}),
    ("roles", lambda d: d.withColumn("role_name", F.lit("Two")), {"vocab_names"}),
    ("orgs", lambda d: d.withColumn("role_names", F.array()), {"list_alignment"}),
    ("orgs", lambda d: d.withColumn("successor_codes", F.when(F.col("ods_code") == "A", F.array(F.lit("B"))).otherwise(F.col("successor_codes"))), {"closures"}),
    ("orgs", lambda d: d.withColumn("name", F.when(F.col("ods_code") != "A", F.col("name"))), {"not_null:orgs.name"}),
    ("successions", lambda d: d.union(d.where("succession_id = 's1'")), {"pk_unique:successions"}),
])
def test_each_corruption_fails_its_check(clean, table, change, expected):
    assert failing({**clean, table: change(clean[table])}) == expected


def test_contract_and_report(spark, clean):
    assert A.schema_contract(spark, clean["orgs"].schema, "orgs").count() == 0
    swapped = clean["roles"].select("role_code", "ods_code", *clean["roles"].columns[2:]).schema
    assert A.schema_contract(spark, swapped, "roles").count() == 4
    checks = spark.createDataFrame([("a", 0, None), ("b", 2, "x")], "check_name string, n bigint, sample string")
    assert A.audit_report(checks).head() == (2, 1, 2, False)


# --- catalogue ----------------------------------------------------------------------------


def test_current_release_skips_withdrawn(spark):
    rows = [("2026-09-25", "2026-09-25_0.2.0", "bad"), ("2026-08-28", "2026-08-28_0.2.0", None), ("2026-08-28", "2026-08-28_0.10.0", None),
            ("2026-08-28", "2026-08-28_0.11.0", "bad"), ("2026-07-31", "2026-07-31_0.1.0", "bad"), ("2026-07-31", "2026-07-31_0.9.0", "bad")]
    d = spark.createDataFrame(rows, "release string, version string, withdrawn string")
    assert {tuple(r) for r in C.resolve_latest(d).collect()} == {("2026-09-25", "2026-09-25_0.2.0", "skipped"), ("2026-08-28", "2026-08-28_0.10.0", "chosen")}
    assert C.resolve_release(d, "2026-07-31").head()[1:] == ("2026-07-31_0.9.0", True)
    assert {r.outcome for r in C.resolve_latest(d.where("withdrawn IS NOT NULL")).collect()} == {"skipped"}


# --- readers and writers ------------------------------------------------------------------


def test_written_tables_are_sorted_and_split_a_heavy_key(spark, t, tmp_path):
    hot = t.relationships.withColumn("source_code", F.when(F.length("source_code") > 1, F.lit("S1")).otherwise(F.col("source_code")))
    sinks.write_table(hot, str(tmp_path / "rels"), schemas.SORT_KEYS["relationships"], partitions=6)
    back = spark.read.parquet(str(tmp_path / "rels")).withColumn("f", F.col("_metadata.file_name"))
    sizes = [r.n for r in back.groupBy("f").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == t.relationships.count() and len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)
    names = [f for f in os.listdir(tmp_path / "rels") if f.endswith(".parquet")]
    assert names and all(".zstd." in f for f in names)


def test_release_round_trip_aliases_and_missing_columns(spark, t, tmp_path):
    none = F.array().cast("array<string>")
    orgs = t.orgs.withColumn("predecessor_codes", none).withColumn("successor_codes", none)
    sinks.write_release({"orgs": orgs, "roles": t.roles, "relationships": t.relationships, "successions": t.successions}, str(tmp_path))
    for name, schema in schemas.TABLES.items():
        df = tables.scan_table(spark, str(tmp_path), name)
        assert df.columns == schema.names and df.count() == getattr(t, name).count()
    old = t.relationships.withColumnsRenamed({"rel_code": "rel_type_code", "rel_name": "rel_type_name"}).drop("legal_end")
    old.write.parquet(str(tmp_path / "older" / "relationships.parquet"))
    back = tables.scan_table(spark, str(tmp_path / "older"), "relationships")
    assert back.columns == schemas.RELATIONSHIPS.names and back.where("legal_end IS NOT NULL").count() == 0 and back.where("rel_code = 'RE4'").count() > 0
    t.orgs.drop("name").write.parquet(str(tmp_path / "broken" / "orgs.parquet"))
    with pytest.raises(ValueError, match="name"):
        tables.scan_table(spark, str(tmp_path / "broken"), "orgs")


def test_csv_quotes_and_json_nulls(spark, tmp_path):
    df = spark.createDataFrame([("A", 'say "hi", ok', ["x", "y"], None)], "ods_code string, name string, role_names array<string>, town string")
    sinks.write_csv(df.coalesce(1).withColumn("predecessors", F.array(F.struct(F.lit("B").alias("code")))), str(tmp_path / "csv"))
    text = "".join(open(tmp_path / "csv" / f).read() for f in os.listdir(tmp_path / "csv") if f.endswith(".csv"))
    assert text == 'ods_code,name,role_names,town\nA,"say ""hi"", ok",x; y,\n'
    assert json.loads(sinks.json_lines(df).head()[0]) == {"ods_code": "A", "name": 'say "hi", ok', "role_names": ["x", "y"], "town": None}


def test_file_digests(spark, tmp_path):
    for name, body in (("b.parquet", b"two"), ("a.parquet", b"one"), ("note.txt", b"x")):
        (tmp_path / name).write_bytes(body)
    found = files.scan_files_binary(spark, str(tmp_path))
    assert {r.file_name: r.sha256 for r in found.collect()}["a.parquet"] == hashlib.sha256(b"one").hexdigest()
    assert [r.file_name for r in files.unexpected_files(found, ["a.parquet", "b.parquet"]).collect()] == ["note.txt"]
    lines = "\n".join(f"{n}:3:sha256:{hashlib.sha256(b).hexdigest()}" for n, b in (("a.parquet", b"one"), ("b.parquet", b"two")))
    digest = files.release_digest(files.scan_files_binary(spark, str(tmp_path), "*.parquet")).head()
    assert (digest.files, digest.bytes, digest.manifest_digest) == (2, 6, "sha256:" + hashlib.sha256(lines.encode()).hexdigest())


def test_large_files_are_digested_split_by_split(spark, tmp_path):
    rng = random.Random(3)
    noise = rng.randbytes(50_000)
    bodies = {"noise": noise, "ended.bin": noise + b"\n", "begun": b"\n\n" + noise, "lines": b"\n" * 9_000, "text": b"one\r\ntwo\r" * 3_000,
              "mark": b"\xef\xbb\xbf" + noise, "mark and end": b"\xef\xbb\xbf" + noise + b"\n", "one line": b"\0" * 30_000, "od[d]{1}*": noise[::-1],
              "small": b"x"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = {r.file_name: (r.bytes, r.sha256) for r in files.scan_files_binary(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}


def test_release_checks_sort_little(t):
    tables, _ = _series(t)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Sort [code" in plan(A._reference_checks(tables, "d")[1])
    orgs = plan(A._table_checks("orgs", tables["orgs"], "d")[1])
    assert orgs.count("> 0)") > len(A._row_rules("orgs", tables["orgs"]))  # as a condition, beside those of the samples


def test_provenance_survives_a_round_trip(spark, t, tmp_path):
    facts = {"source": "sha256:00", "version": "1.0.0"}
    files.with_provenance(t.orgs.select("ods_code", "publication_date"), facts).write.parquet(str(tmp_path / "o"))
    assert files.column_provenance(spark.read.parquet(str(tmp_path / "o"))) == facts


def test_series_is_pruned_by_date(spark, t, tmp_path):
    path = str(tmp_path / "series")
    sinks.snapshot_append(t.snapshots, path)
    plan = tables.scan_snapshots(spark, path, since="2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(publication_date" in plan


# --- change feed --------------------------------------------------------------------------


def test_change_feed_follows_announced_releases(spark, t, tmp_path):
    cols = ["ods_code", "name", "status", "primary_role_code", "town", "postcode", "publication_date"]
    rows = t.snapshots.select(cols).withColumnRenamed("primary_role_code", "role")
    days = [r[0] for r in rows.select("publication_date").distinct().orderBy("publication_date").limit(3).collect()]
    series, feed, mark, markers = (str(tmp_path / n) for n in ("series", "feed", "mark", "markers"))
    on = lambda d: rows.where(F.col("publication_date") == F.lit(d))
    for day in (days[0], days[2], days[1], days[1]):  # one late, one announced twice
        release = str(tmp_path / f"release-{day}")
        for half in (0, 1):  # the files of a release arrive in pieces before it is announced
            on(day).where(F.abs(F.hash("ods_code")) % 2 == half).drop("publication_date").write.mode("append" if half else "overwrite").parquet(release)
        announce(spark, day, release, markers)
        start_change_feed(read_markers(spark, markers), rows.schema, series, feed, mark).awaitTermination()
    for before, day in zip(days, days[1:]):
        want = {tuple(r) for r in X.diff_long(on(before), on(day)).collect()}
        got = spark.read.parquet(feed).where(F.col("publication_date") == F.lit(day))
        assert {tuple(r) for r in got.select("ods_code", "name", "role", "change_type", "field", "old_value", "new_value").collect()} == want and want
    assert spark.read.parquet(series).count() == rows.where(F.col("publication_date") <= F.lit(days[2])).count()


def test_every_check_of_every_release_finds_its_fault(spark):
    day = lambda i: datetime.date(2001, 8, i)
    org = lambda d, code, **k: {"ods_code": code, "name": "n", "status": "active", "role_codes": ["R1", "R2"], "role_names": ["a", "b"],
                                "primary_role_code": "R1", "legal_start": day(1), "legal_end": None, "operational_start": None, "operational_end": None,
                                "publication_date": day(d)} | k
    role = lambda d, code, i, **k: {"ods_code": code, "role_code": "R1", "role_id": i, "publication_date": day(d)} | k
    rel = lambda d, a, b, i: {"source_code": a, "target_code": b, "rel_id": i, "publication_date": day(d)}
    orgs = [org(1, "A"), org(1, "B"),
            org(2, "A"), org(2, "A"), org(2, "A"), org(2, "C", name=None), org(2, "B", name=None), org(2, "D", legal_end=datetime.date(2001, 7, 1)),
            org(2, "E", primary_role_code="R9"), org(2, "F", role_names=["a"]), org(2, None), org(2, None), org(9, "Z", name=None)]
    roles = [role(1, "A", "1"), role(2, "A", "1"), role(2, "Q", "3"), role(2, "Q", "2"), role(2, "B", "2", role_code=None)]
    rels = [rel(1, "A", "B", "1"), rel(2, "Q", "Q", "8"), rel(2, "A", "W", "9"), rel(3, "A", "B", "1")]
    frame = lambda rows, kind: spark.createDataFrame(rows, ", ".join(f"{c} {kind.get(c, 'string')}" for c in rows[0]))
    dates = {c: "date" for c in ("legal_start", "legal_end", "operational_start", "operational_end", "publication_date")}
    tables = {"orgs": frame(orgs, dates | {"role_codes": "array<string>", "role_names": "array<string>"}), "roles": frame(roles, dates),
              "relationships": frame(rels, dates),
              "successions": spark.createDataFrame([], "predecessor_code string, successor_code string, succession_id string, publication_date date")}
    releases = spark.createDataFrame([(day(1),), (day(2),), (day(2),), (day(3),)], "publication_date date")
    checks = A.release_checks(tables, releases)
    bad = {(r.publication_date.day, r.check_name): (r.n, r.sample) for r in checks.collect() if r.n}
    assert bad == {(2, "pk_unique:orgs"): (2, "A"), (2, "not_null:orgs.name"): (2, "B"), (2, "not_null:orgs.ods_code"): (2, None), (2, "date_order:orgs"): (1, "D"),
                   (2, "primary_in_roles"): (1, "E"), (2, "lists_aligned"): (1, "F"), (2, "pk_unique:roles"): (1, "2"), (2, "not_null:roles.role_code"): (1, "2"),
                   (2, "fk:roles"): (2, "2"), (2, "fk:relationships"): (3, "8")}
    got = {r.publication_date.day: (r.checks, r.failed, r.discrepancies, r.verdict) for r in A.release_verdicts(checks, releases).collect()}
    n = got[1][0]
    assert n >= 12 and got == {1: (n, 0, 0, "pass"), 2: (n, len(bad), 16, "fail"), 3: (0, 0, 0, "skipped")}


def test_ends_of_a_relationship_are_looked_up_while_it_is_one_row(spark):
    orgs = spark.createDataFrame([("A", "a"), ("B", None), ("C", "c"), ("C", "cc")], "ods_code string, name string")
    edges = [("A", "B"), ("B", "A"), ("A", "A"), ("A", "X"), ("X", "A"), ("X", "Y"), ("A", None), (None, "A"), ("A", "C"), ("C", "C")]
    rels = spark.createDataFrame([(a, b, "RE1", "r", "" if i else None, f"i{i}") for i, (a, b) in enumerate(edges)],
                                 "source_code string, target_code string, rel_code string, rel_name string, rel_status string, rel_id string")
    rels = rels.withColumns({c: F.lit(None).cast("date") for c in ("legal_start", "legal_end", "operational_start", "operational_end")})
    named = {}
    for code, name in (("A", "a"), ("B", ""), ("C", "c"), ("C", "cc")):
        named.setdefault(code, []).append(name)
    want = []
    for i, (a, b) in enumerate(edges):
        if a in named:
            want += [(a, "outbound", b, n, f"i{i}") for n in named.get(b, [""])]
        if b in named and a is not None and a != b:
            want += [(b, "inbound", a, n, f"i{i}") for n in named.get(a, [""])]
    got = P.profile_rels(orgs, rels)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select("ods_code", "direction", "code", "name", "rel_id").collect()), key=key) == sorted(want, key=key)
    assert {r.rel_status for r in got.collect()} == {"active"}
    bare = P.profile_rels(orgs, rels, names=False)
    assert "name" not in bare.columns and bare.count() == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Union" not in plan
