import datetime
import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import audit as A
from rollbook.operators import build as B
from rollbook.operators import graph as G
from rollbook.operators.make import BuildRefused, build_release
from rollbook.sources import xml

HEAD = """<?xml version="1.0" encoding="utf-8"?>
<{p}OrgRefData xmlns:{n}="urn:x">
 <{p}Manifest><{p}Version value="2"/><{p}PublicationDate value="{date}"/><{p}RecordCount value="{count}"/></{p}Manifest>
 <{p}CodeSystems><{p}CodeSystem name="Role"><{p}concept id="RO76" code="76" displayName="GP &amp; CO"/>
 <{p}concept id="RO177" code="177" displayName="COST CENTRE" /></{p}CodeSystem></{p}CodeSystems>
 <{p}PrimaryRoleScope><{p}PrimaryRole id="RO76" displayName="x"/></{p}PrimaryRoleScope>
 <{p}Organisations>
"""


def org(code, body="", attrs='orgRecordClass="RC1"', status='<Status value="Active"/>', name=None, p=""):
    text = f'<Organisation {attrs}><Name>{name or code + " LTD"}</Name><OrgId root="2" extension="{code}"/>{status}{body}</Organisation>'
    if p:
        for tag in ("Organisation", "Name", "OrgId", "Status", "Date", "Type", "Start", "End", "Roles", "Role"):
            for a in (" ", ">", "/"):
                text = text.replace(f"<{tag}{a}", f"<{p}{tag}{a}")
            text = text.replace(f"</{tag}>", f"</{p}{tag}>")
    return text


def operational(start, end=None):
    return f'<Date><Type value="Operational"/><Start value="{start}"/>' + (f'<End value="{end}"/>' if end else "") + "</Date>"


def legal(start, end=None):
    return f'<Date><Type value="Legal"/><Start value="{start}"/>' + (f'<End value="{end}"/>' if end else "") + "</Date>"


def role(code, uid, primary="false", status="Active", dates=""):
    return f'<Role id="{code}" uniqueRoleId="{uid}" primaryRole="{primary}">{dates}<Status value="{status}"/></Role>'


def write(tmp_path, name, orgs, date="2026-07-28", count=None, p="", n="un"):
    path = tmp_path / name
    path.write_text(HEAD.format(p=p, n=n, date=date, count=len(orgs) if count is None else count) + "\n".join(orgs)
                    + f"</{p}Organisations></{p}OrgRefData>")
    return str(path)


def vocab(spark):
    return spark.createDataFrame([("RO76", "GP Practice"), ("RO177", "Cost Centre"), ("RO180", "Trust Site")], "role_code string, role_name string")


def merged(spark, paths):
    records = xml.scan_xml_release(spark, paths).withColumn("op_start", B.operational_start())
    return records, B.normalise_entities(B.merge_entities(records))


@pytest.fixture
def temporal(tmp_path):
    one = org("T1", legal("2006-10-01", "2013-03-31") + operational("2006-10-02", "2020-09-30") + "<Roles>"
              + role("RO177", "1001", "true", dates=operational("2006-10-01")) + role("RO76", "1002", dates=operational("2007-4-1")) + "</Roles>")
    two = org("T2", operational("2001-04-01") + "<Roles>" + role("RO180", "2001", "true", "Inactive", legal("2006-10-01", "2013-03-31")) + "</Roles>"
              '<Succs><Succ uniqueSuccId="171">' + legal("2006-10-01") + '<Type>Predecessor</Type><Target><OrgId extension="T1"/>'
              '<PrimaryRoleId id="RO180" uniqueRoleId="4"/></Target></Succ></Succs><Rels><Rel id="RE4" uniqueRelId="3001">'
              + operational("2013-04-01", "2022-06-30") + '<Status value="Inactive"/><Target><OrgId extension="T1"/></Target></Rel></Rels>')
    three = org("T3", "<Roles>" + role("RO76", "4001", "true") + role("RO177", "4002", status="Inactive") + role("RO177", "4003") + "</Roles>",
                attrs='orgRecordClass="RC2"')
    return write(tmp_path, "temporal.xml", [one, two, three])


def test_interval_and_role_semantics(spark, temporal):
    _, e = merged(spark, [temporal])
    none = spark.createDataFrame([], "ods_code string, successor_codes array<string>, predecessor_codes array<string>")
    pairs = G.successor_pairs(B.succession_edges(e, "2026-07-28"))
    rows = {r.ods_code: r for r in B.project_orgs(e, vocab(spark), G.closure_list(pairs, "successor_code", "successor_codes"),
                                                  G.closure_list(G.predecessor_pairs(pairs), "predecessor_code", "predecessor_codes"),
                                                  "2026-07-28").collect()}
    t1, t2, t3 = rows["T1"], rows["T2"], rows["T3"]
    assert (t1.legal_start, t1.legal_end, t1.operational_start, t1.operational_end) == tuple(
        datetime.date(*d) for d in ((2006, 10, 1), (2013, 3, 31), (2006, 10, 2), (2020, 9, 30)))
    assert t1.role_codes == ["RO177", "RO76"] and t1.role_names == ["Cost Centre", "GP Practice"] and t1.primary_role_code == "RO177"
    assert t2.status == "active" and t2.role_codes == [] and t2.primary_role_code == "RO180"
    assert t3.role_codes == ["RO177", "RO76"] and t3.record_class == "site" and t3.operational_start is None and t3.address is None
    assert t1.successor_codes == ["T2"] and t2.predecessor_codes == ["T1"] and t3.successor_codes == []
    edges = B.succession_edges(e, "2026-07-28").collect()
    assert [(x.predecessor_code, x.successor_code, str(x.legal_start)) for x in edges] == [("T1", "T2", "2006-10-01")]
    roles = B.explode_roles(e, vocab(spark), "2026-07-28").where("ods_code = 'T3'").count()
    rels = B.explode_relationships(e, xml.scan_xml_concepts(spark, temporal), "2026-07-28").collect()
    assert roles == 3 and rels[0].rel_status == "inactive" and str(rels[0].operational_end) == "2022-06-30" and rels[0].rel_name == "RE4"
    assert none.count() == 0


def test_manifest_concepts_and_counts(spark, tmp_path, temporal):
    short = write(tmp_path, "short.xml", [org("Z1")], count=5)
    m = xml.scan_xml_manifest(spark, temporal).head()
    assert (m.record_count, m.publication_date, m.primary_role_scope) == (3, "2026-07-28", ["RO76"])
    assert {tuple(r) for r in xml.scan_xml_concepts(spark, temporal).collect()} == {
        ("RO76", "GP & CO"), ("76", "GP & CO"), ("RO177", "COST CENTRE"), ("177", "COST CENTRE")}
    both = lambda p: (xml.scan_xml_entities(spark, p), xml.scan_xml_manifest(spark, p))
    assert B.check_record_counts(*both(temporal)).head().ok
    bad = B.check_record_counts(*both(short)).head()
    assert not bad.ok and (bad.declared, bad.read) == (5, 1)


def test_prefixed_and_long_tag_names(spark, tmp_path):
    body = operational("2001-01-01") + "<Roles>" + role("RO76", "1", "true") + "</Roles>"
    path = write(tmp_path, "prefixed.xml", [org("P1", body, p="un:"), org("P2", p="un:")], p="un:")
    assert xml.tag_prefix(spark, path) == "un:"
    rows = {r.code: r for r in xml.scan_xml_entities(spark, path).collect()}
    assert rows["P1"].dates[0].start == "2001-01-01" and rows["P1"].roles[0].id == "RO76" and rows["P2"].roles == []
    assert xml.scan_xml_manifest(spark, path).head().record_count == 2
    long = org("L1", '<Date type="Operational"><Start value="1999-01-01"/></Date><Roles><Role id="RO76" uniqueRoleID="9" primaryRole="true" status="Inactive"/></Roles>'
               '<Rels><Relationship id="RE6" uniqueRelID="7" status="Active"><Target><OrgId extension="P1"/></Target></Relationship></Rels>'
               '<Succs><Successor uniqueSuccID="5"><Type>Successor</Type><Target><OrgId extension="P2"/></Target></Successor></Succs>', status="")
    other = write(tmp_path, "long.xml", [long])
    records, e = merged(spark, [other])
    r = e.head()
    assert r.status == "inactive" and r.roles[0].role_id == "9" and r.rels[0].target == "P1" and r.succs[0].type == "successor"
    assert B.succession_edges(e, "2026-07-28").head()[:2] == ("L1", "P2")


def test_large_file_is_split(spark, tmp_path):
    path = write(tmp_path, "large.xml", [org(f"B{i:05d}", operational("2001-01-01")) for i in range(20000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        rows = xml.scan_xml_entities(spark, path)
        assert rows.rdd.getNumPartitions() > 4 and rows.select("code").distinct().count() == 20000
        assert rows.where(F.size("dates") != 1).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_merge_rules(spark, tmp_path):
    stub = 'orgRecordClass="RC1" refOnly="true"'
    full = write(tmp_path, "full.xml", [org("A", attrs=stub), org("B", operational("2000-01-01"), name="FULL"), org("C", attrs=stub),
                                        org("D", operational("1990-01-01")), org("D", operational("1995-01-01"), name="LATER")])
    archive = write(tmp_path, "archive.xml", [org("A", operational("1980-01-01"), name="COMPLETE"), org("B", operational("2010-01-01"), name="OLD"),
                                              org("E", attrs=stub), org("E", attrs=stub), org("F", operational("1990-01-01")), org("F", operational("1990-01-01")),
                                              org("G"), org("G", operational("1990-01-01"))])
    records, e = merged(spark, [full, archive])
    names = {r.code: r.name for r in e.collect()}
    assert (names["A"], names["B"], names["C"], names["D"]) == ("COMPLETE", "FULL", "C LTD", "LATER")
    assert {(r.code, r.reason) for r in B.merge_contradictions(records).collect()} == {
        ("E", "two stubs"), ("F", "equal start"), ("G", "no start to compare")}
    report = {r.fate: r.records for r in B.merge_report(records).collect()}
    assert report["stub superseded"] == 1 and report["dropped: complete in an earlier file"] == 1 and report["stub kept"] == 3
    clean = records.where(~F.col("code").isin("E", "F"))
    assert A.merge_flags(clean, B.merge_entities(clean), B.merge_fate(clean)).count() == 0


def test_publication_date_must_agree(spark):
    rows = lambda *dates: spark.createDataFrame([(f"f{i}", d) for i, d in enumerate(dates)], "file_name string, publication_date string")
    verdict = lambda *d: B.agree_publication_date(rows(*d)).head().verdict
    assert verdict("2026-07-28", "2026-07-28") == "agreed" and verdict("2026-07-28", "2026-07-29") == "disagree"
    assert verdict("2026-07-28", None) == "undated" and verdict("28 July") == "undated"


def test_unread_dates_are_counted(spark, tmp_path):
    path = write(tmp_path, "odd.xml", [org("A", operational("2001-02-30")), org("B", legal("soon") + operational("2001-1-2"))])
    _, e = merged(spark, [path])
    assert B.unread_dates(e, "code", B.pick_dates("dates")).head()[:] == (2, "A", "operational_start", "2001-02-30")


def test_source_invariants_find_each_fault(spark, tmp_path):
    rel = lambda uid, target, prim="": f'<Rel id="RE4" uniqueRelId="{uid}"><Status value="Active"/><Target><OrgId extension="{target}"/>{prim}</Target></Rel>'
    rows = [org("A", operational("2001-01-01", "2000-01-01") + "<Roles>" + role("RO76", "1", "true") + "</Roles><Rels>" + rel("5", "NOPE") + rel("5", "B")
                + "</Rels>"),
            org("B", "<Roles>" + role("RO999", "1", "true") + "</Roles>", status='<Status value="Dormant"/>'),
            org("C", operational("2001-01-01") + "<Rels>" + rel("6", "A", '<PrimaryRoleId id="RO177"/>') + '</Rels><Succs><Succ uniqueSuccId="1"><Type>merged</Type>'
                '<Target><OrgId extension="GONE"/></Target></Succ></Succs>', status='<Status value="Inactive"/>')]
    path = write(tmp_path, "faults.xml", rows)
    records, _ = merged(spark, [path])
    got = {r.check_name: (r.n, r.sample) for r in A.source_audit(records, xml.scan_xml_concepts(spark, path)).collect()}
    assert got == {"dup_role_ids": (1, "1"), "dup_rel_ids": (1, "5"), "dangling_rel_targets": (1, "NOPE"), "dangling_succ_targets": (1, "GONE"),
                   "primary_role_mismatch": (1, "A"), "unknown_role_concepts": (1, "RO999"), "invalid_date_order": (1, "A"),
                   "missing_operational_date": (1, "B"), "invalid_status": (1, "B"), "inactive_without_end": (2, "B"), "invalid_succ_type": (1, "C")}


def test_make_release_writes_four_tables_or_refuses(spark, tmp_path, temporal):
    from rollbook.operators.make import BuildRefused, make_release
    from rollbook.sources.tables import scan_table
    make_release(spark, [temporal], vocab(spark), str(tmp_path / "out"))
    n = {name: scan_table(spark, str(tmp_path / "out"), name).count() for name in ("orgs", "roles", "relationships", "successions")}
    assert n == {"orgs": 3, "roles": 6, "relationships": 1, "successions": 1}
    refused = lambda *a: pytest.raises(BuildRefused, match=a[0])
    with refused("disagree"):
        make_release(spark, [temporal, write(tmp_path, "late.xml", [org("X")], date="2026-07-29")], vocab(spark), str(tmp_path / "no"))
    with refused("declared 9, read 1"):
        make_release(spark, [write(tmp_path, "short.xml", [org("X")], count=9)], vocab(spark), str(tmp_path / "no"))
    with refused("X/no start to compare"):
        make_release(spark, [write(tmp_path, "twice.xml", [org("X"), org("X")])], vocab(spark), str(tmp_path / "no"))
    with refused("RO5"):
        make_release(spark, [write(tmp_path, "role.xml", [org("X", "<Roles>" + role("RO5", "1") + "</Roles>")])], vocab(spark), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def codes(spark, path):
    return sorted(r.code for r in xml.scan_xml_entities(spark, str(path)).select("code").collect())


def test_closing_tags_with_space_and_comments_between_records(spark, tmp_path):
    spaced = [org("A1").replace("</Organisation>", "</Organisation >"), org("A2").replace("</Organisation>", "</Organisation\n\t>"), org("A3")]
    assert codes(spark, write(tmp_path, "spaced.xml", spaced)) == ["A1", "A2", "A3"]
    hidden = ["<!-- " + org("X1") + " -->" + org("B1"), "<!--" + org("X2") + "\n" + org("X3") + org("X4") + "-->", org("B2"),
              "<!-- a -- > b --><?pi " + org("X5") + " ?>" + org("B3"), org("B4").replace("B4 LTD", "<!-- x -->B4 L<!-- </Organisation> -->TD")]
    path = write(tmp_path, "hidden.xml", hidden, count=4)
    assert codes(spark, path) == ["B1", "B2", "B3", "B4"]
    assert {r.code: r.name for r in xml.scan_xml_entities(spark, path).collect()}["B4"] == "B4 LTD"
    assert xml.xml_problems(spark, path).collect() == []


def test_cdata_that_holds_tags_and_comment_marks(spark, tmp_path):
    odd = org("C1", name="<![CDATA[A </Organisation> <!-- B ]]>LTD")
    path = write(tmp_path, "cdata.xml", [odd, org("C2"), "<!-- " + org("X1", name="<![CDATA[--]]>") + " -->", org("C3")], count=3)
    assert {r.code: r.name for r in xml.scan_xml_entities(spark, path).collect()} == {"C1": "A </Organisation> <!-- B LTD", "C2": "C2 LTD", "C3": "C3 LTD"}


def test_unreadable_records_are_refused_by_name(spark, tmp_path):
    path = write(tmp_path, "bare.xml", [org("D1"), org("D2", name="A & B"), org("D3")])
    with pytest.raises(Exception, match="not well-formed.*bare.xml.*D2"):
        xml.scan_xml_entities(spark, path).select("name").collect()
    assert [(r.file_name, r.problem, r.record[:2]) for r in xml.xml_problems(spark, path).collect()] == [("bare.xml", "not well-formed", "D2")]
    lost = write(tmp_path, "lost.xml", [org("E1").replace("</Organisation>", ""), org("E2")])
    with pytest.raises(Exception, match="begins inside another"):
        xml.scan_xml_entities(spark, lost).collect()
    last = write(tmp_path, "last.xml", [org("F1"), org("F2").replace("</Organisation>", "")])
    assert [r.problem for r in xml.xml_problems(spark, last).collect()] == ["2 entities begin, 1 end"]
    coded = write(tmp_path, "coded.xml", ['<Organisation orgRecordClass="RC1"><Name>N</Name></Organisation>'])
    assert [r.problem for r in xml.xml_problems(spark, coded).collect()] == ["no code"]
    with pytest.raises(BuildRefused, match="unreadable source.*D2"):
        build_release(spark, [path], vocab(spark))


def test_sections_across_many_splits(spark, tmp_path):
    """Small splits: comments and CDATA sections cross several of them, and every record is cut as a parser would."""
    draw, parts, true = random.Random(8), [], []
    for i in range(400):
        kind, one = draw.random(), org(f"S{i:03}", name=f"N{i} " + "x" * draw.randint(1, 300))
        if kind < 0.1:
            parts.append("<!-- " + "".join(org(f"X{i}{j}") for j in range(draw.randint(1, 30))) + " -->")
        elif kind < 0.15:
            body = "".join(org(f"Y{i}{j}") + "<!--" for j in range(draw.randint(1, 30)))
            parts.append(org(f"S{i:03}", name=f"<![CDATA[{body}]]>"))
            true.append((f"S{i:03}", body))
        else:
            parts.append(one.replace("</Organisation>", "</Organisation >") if kind < 0.3 else one)
            true.append((f"S{i:03}", one.split("<Name>")[1].split("</Name>")[0]))
    path = write(tmp_path, "many.xml", parts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = xml.scan_xml_entities(spark, path)
        got = sorted((r.code, r.name) for r in rows.select("code", "name").collect())
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        assert xml.xml_problems(spark, path).collect() == []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == true


def test_splits_are_rejoined_in_a_stream(spark, tmp_path):
    """No split is gathered as one pandas group, and its state is carried from one batch to the next."""
    from rollbook.sources import xmlcut
    text = "".join(f"<R><!-- {i} </R> <R> --><![CDATA[</R>]]>{i}</R>\n" for i in range(300))
    (tmp_path / "a.xml").write_text(text)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = xmlcut.true_chunks(spark, str(tmp_path), "</R")
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(r.value.lstrip(">\n") for r in rows.collect() if "<R>" in r.value)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(f"<R><![CDATA[</R>]]>{i}" for i in range(300))
    assert "MapInPandas" in plan


def test_source_files_are_compressed_and_bounded(t):
    import glob
    from rollbook.plans import written
    for path in written.xml_release(t):
        parts = glob.glob(f"{path}/part-*")
        assert parts and all(f.endswith(".lz4") for f in parts)


def test_only_what_columns_are_made_of_is_parsed(spark, t, tmp_path):
    from __spark_entry__ import queries
    from rollbook.plans import written
    columns = ["code", "ref_only", "dates", "rels"]
    paths = written.xml_release(t)
    some, concepts = xml.scan_xml_parts(spark, paths, columns)
    rows = lambda df: sorted(map(str, df.select(*columns, "file_index").collect()))
    assert rows(some) == rows(xml.scan_xml_release(spark, paths))
    assert sorted(map(str, concepts.collect())) == sorted(map(str, xml.scan_xml_concepts(spark, paths).collect()))
    plan = queries()["b16_explode_relationships"](spark, t.folder)._jdf.queryExecution().analyzed().toString()
    assert "Rels" in plan and "GeoLoc" not in plan and "Contacts" not in plan
    path = str(tmp_path / "bad.xml")
    with open(path, "w") as f:
        f.write('<X><Organisation><OrgId extension="A1"/><Name>A</Nam></Organisation></X>')
    with pytest.raises(Exception, match="not well-formed"):
        xml.scan_xml_entities(spark, path, columns=columns).collect()
