"""Files written by Spark from the given tables, for queries that exercise readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.plans.adapters import Tables
from rollbook.runtime import scratch_path

PUBLISHED = "2001-08-01"
#: Records of a part file; compressed files are not split, so they must not grow with the tables.
RECORDS = 20_000

_WRITTEN: dict[tuple, object] = {}


def _once(make):
    """Write a fixture once per session and data folder."""
    def get(t: Tables):
        key = (t.spark.sparkContext.applicationId, t.folder, make.__name__)
        if key not in _WRITTEN:
            _WRITTEN[key] = make(t)
        return _WRITTEN[key]
    return get


def _esc(c):
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _if(c, *parts):
    return F.when(c, _cat(*parts)).otherwise(F.lit(""))


def _date(kind: str, start, end, attribute: bool):
    open_tag = f'<Date type="{kind}">' if attribute else f'<Date><Type value="{kind}" />'
    return _cat(open_tag, _if(start.isNotNull(), '<Start value="', start, '" />'), _if(end.isNotNull(), '<End value="', end, '" />'), "</Date>")


def _entity_xml(second: bool):
    """XML text of one source row; the second file uses the long tag names and attribute forms."""
    c = F.col
    rel, succ = ("Relationship", "Successor") if second else ("Rel", "Succ")
    state = lambda s: (_cat(' status="', s, '">'), F.lit("")) if second else (F.lit(">"), _cat('<Status value="', s, '" />'))
    none = F.lit(None).cast("string")

    def role(code, n, primary, status):
        attr, child = state(status)
        return _cat('<Role id="', code, '" uniqueRoleId="', c("code"), f'-r{n}" primaryRole="{primary}"', attr, child, "</Role>")

    def relation(code, n, target, status, target_role):
        attr, child = state(status) if status is not None else (F.lit(">"), F.lit(""))
        return _cat(f'<{rel} id="{code}" uniqueRelId="', c("code"), f'-e{n}"', attr, _date("Operational", c("op_start"), none, second), child,
                    '<Target><OrgId extension="', target, '" />', _if(target_role.isNotNull(), '<PrimaryRoleId id="', target_role, '" />'),
                    f"</Target></{rel}>")

    body = _cat(
        _date("Legal", c("legal_start"), c("legal_end"), second), _date("Operational", c("op_start"), c("op_end"), second),
        "<GeoLoc><Location><AddrLn1>", c("addr1"), "</AddrLn1><AddrLn2>", c("addr2"), "</AddrLn2>",
        _if(c("town").isNotNull(), "<Town>", c("town"), "</Town>"), "<County>SHIRE</County>",
        _if(c("postcode").isNotNull(), "<PostCode>", c("postcode"), "</PostCode>"), "<Country>ENGLAND</Country></Location></GeoLoc>",
        "<Contacts>", _if(c("tel").isNotNull(), '<Contact type="tel" value="', c("tel"), '" />'),
        _if(c("http").isNotNull(), '<Contact type="http" value="', c("http"), '" />'), "</Contacts><Roles>",
        role(c("role1"), 1, "true", c("role1_status")), F.when(c("role2").isNotNull(), role(c("role2"), 2, "false", c("role2_status"))).otherwise(""),
        "</Roles><Rels>", relation("RE4", 1, c("rel1_target"), None, c("rel1_role")),
        F.when(c("rel2_target").isNotNull(), relation("RE5", 2, c("rel2_target"), c("rel2_status"), none)).otherwise(""), "</Rels>",
        _if(c("succ_type").isNotNull(), f'<Succs><{succ} uniqueSuccId="', c("succ_id"), '">',
            _date("Legal", c("op_start"), none, second), "<Type>", c("succ_type"), '</Type><Target><OrgId extension="', c("succ_target"),
            f'" /></Target></{succ}></Succs>'))
    return _cat('<Organisation orgRecordClass="', c("record_class"), '"', _if(c("ref_only"), ' refOnly="true"'), "><Name>", _esc(c("name")),
                '</Name><OrgId root="2.16" assigningAuthorityName="HSCIC" extension="', c("code"), '" />',
                _if(c("status").isNotNull(), '<Status value="', c("status"), '" />'), '<LastChangeDate value="2000-05-05" />',
                F.when(c("ref_only"), "").otherwise(body), "</Organisation>")


def _header(t: Tables, rows: DataFrame) -> DataFrame:
    roles = t.vocab.select(_cat('<concept id="', F.col("role_code"), '" code="', F.expr("substr(role_code, 3)"), '" displayName="',
                                F.lower("role_name"), '" />').alias("c"))
    codes = roles.agg(F.array_join(F.array_sort(F.collect_list("c")), "\n").alias("codes"))
    counted = rows.agg(F.count("*").cast("string").alias("n")).withColumn("g", F.lit(1)).join(codes.withColumn("g", F.lit(1)), "g")
    return counted.select(_cat(
        f'<?xml version="1.0"?>\n<OrgRefData><Manifest><Version value="2" /><PublicationDate value="{PUBLISHED}" /><RecordCount value="',
        F.col("n"), '" /></Manifest>\n<CodeSystems>\n', F.col("codes"),
        '\n<concept id="RE4" code="4" displayName="is commissioned by" />\n</CodeSystems>\n<PrimaryRoleScope><PrimaryRole id="RO7009" />'
        '<PrimaryRole id="RO6510" /></PrimaryRoleScope>\n<Organisations>').alias("value"))


def _write_xml(rows: DataFrame, path: str) -> None:
    """XML text in part files of bounded size, compressed: tags make up nearly all of it."""
    rows.write.option("compression", "lz4").option("maxRecordsPerFile", RECORDS).text(path)


@_once
def xml_release(t: Tables) -> list[str]:
    """Two source files of one release, full first, written as XML text."""
    root = scratch_path(t.spark, "source")
    paths = []
    for i, kind in enumerate(("full", "archive")):
        rows = t.xml_src.where(F.col("file_index") == i)
        path = f"{root}/{kind}"
        _write_xml(_header(t, rows).union(rows.select(_entity_xml(bool(i)).alias("value"))), path)
        paths.append(path)
    return paths


@_once
def xml_sections(t: Tables) -> list[str]:
    """The same source files, with sections that cross the cuts between records."""
    root = scratch_path(t.spark, "sections")
    paths = []
    for i, kind in enumerate(("full", "archive")):
        entity, k = _entity_xml(bool(i)), F.col("k")
        odd = F.replace(entity, F.lit("</Name>"), F.lit("</Name><Note><![CDATA[</Organisation> <!-- <Organisation> ]]></Note>"))
        text = F.when(k % 40 == 9, odd).otherwise(entity)
        text = F.when(k % 31 == 3, F.regexp_replace(text, "</Organisation>$", "</Organisation\t>")).otherwise(text)
        text = _cat(_if(k % 50 == 7, "<!-- ", entity, entity, " -->"), _if(k % 60 == 11, "<?old ", entity, " ?>"), text)
        path = f"{root}/{kind}"
        rows = t.xml_src.where(F.col("file_index") == i)
        _write_xml(_header(t, rows).union(rows.select(text.alias("value"))), path)
        paths.append(path)
    return paths


def series(t: Tables) -> str:
    """The snapshot series written with one folder per publication date."""
    from rollbook.sources.sinks import snapshot_append
    path = scratch_path(t.spark, "series")
    snapshot_append(t.snapshots, path)
    return path


@_once
def yearly(t: Tables) -> str:
    """One folder per order year, as separate releases."""
    path = scratch_path(t.spark, "releases")
    t.orders.withColumn("year", F.year("o_orderdate")).write.partitionBy("year").parquet(path)
    return path
