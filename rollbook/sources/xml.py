"""Source XML read as splittable text.

A large file is cut across tasks before every closing entity tag (``xmlcut``); each record is then parsed by Spark's own
``from_xml``. The manifest and the code lists sit in the chunk before the first entity. A record that can't be read is
refused by name; ``xml_problems`` lists all that is wrong with a set of files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.runtime import checkpoint
from rollbook.sources.xmlcut import true_chunks

_DATE = "array<struct<_type: string, Type: struct<_text: string, _value: string>, " \
        "Start: struct<_value: string>, End: struct<_value: string>>>"
_TARGET = "struct<OrgId: struct<_extension: string>, " \
          "PrimaryRoleId: struct<_id: string, _uniqueRoleId: string>, PrimaryRole: struct<_id: string>>"
_STATUS = "struct<_value: string>"
_REL = f"array<struct<_id: string, _uniqueRelId: string, _status: string, Status: {_STATUS}, Date: {_DATE}, " \
       f"Target: {_TARGET}>>"
_SUCC = f"array<struct<_uniqueSuccId: string, _type: string, Type: struct<_text: string, _value: string>, " \
        f"Date: {_DATE}, Target: {_TARGET}>>"

ENTITY_DDL = f"""
  _orgRecordClass string, _refOnly string, OrgRecordClass struct<_text: string, _value: string>, Name string,
  OrgId struct<_root: string, _assigningAuthorityName: string, _extension: string>,
  Status {_STATUS}, LastChangeDate struct<_value: string>, Date {_DATE},
  GeoLoc struct<Location: struct<AddrLn1: string, AddrLn2: string, AddrLn3: string, Town: string, County: string,
                                 PostCode: string, Country: string, UPRN: string>>,
  Contacts struct<Contact: array<struct<_type: string, _value: string>>>,
  Roles struct<Role: array<struct<_id: string, _uniqueRoleId: string, _primaryRole: string, _status: string,
                                  Status: {_STATUS}, Date: {_DATE}>>>,
  Rels struct<Rel: {_REL}, Relationship: {_REL}>, Relationships struct<Rel: {_REL}, Relationship: {_REL}>,
  Succs struct<Succ: {_SUCC}, Successor: {_SUCC}>, Successors struct<Succ: {_SUCC}, Successor: {_SUCC}>
"""

#: Elements and attributes that a column of the entities is made of; each object that is parsed costs more than the text around it.
_MADE_OF = {
    "code": ["OrgId"], "root": ["OrgId"], "authority": ["OrgId"], "name": ["Name"], "status": ["Status"], "record_class": ["OrgRecordClass", "_orgRecordClass"],
    "ref_only": ["_refOnly"], "last_change_date": ["LastChangeDate"], "dates": ["Date"], "contacts": ["Contacts"], "roles": ["Roles"],
    "rels": ["Rels", "Relationships"], "succs": ["Succs", "Successors"],
    **{c: ["GeoLoc"] for c in ("address_lines", "town", "county", "postcode", "country", "uprn")}}

_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_text", "mode": "PERMISSIVE"}
_PLAIN_OPTIONS = {k: v for k, v in _OPTIONS.items() if k != "ignoreNamespace"}
_ATTRS = "(?:\\s+[\\w:.-]+\\s*=\\s*(?:\"[^\"]*\"|'[^']*'))*"


def tag_prefix(spark: SparkSession, paths, tag: str = "Organisation") -> str:
    """Namespace prefix of the entity tag, such as ``un:``, read from the first one found."""
    tags = spark.read.option("lineSep", ">").text(paths)
    pattern = f"<((?:[\\w.-]+:)?){tag}(?:\\s|$)"
    hit = tags.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1)).head()
    return hit[0] if hit else ""


def xml_chunks(spark: SparkSession, paths, tag: str = "Organisation", prefix: str | None = None) -> DataFrame:
    """Text between closing entity tags, with the file each chunk came from; comments are taken out."""
    prefix = tag_prefix(spark, paths, tag) if prefix is None else prefix
    closing = f"</{prefix}{tag}"
    return true_chunks(spark, paths, closing).select("value", "file_name", F.lit(closing + ">").alias("closing"))


def _starts(text: Column) -> Column:
    """How many entities begin in ``text``."""
    return F.regexp_count(F.regexp_replace(text, r"(?s)<!\[CDATA\[.*?\]\]>", " "), F.lit(r"<(?:[\w.-]+:)?Organisation[\s>/]"))


def _schema(columns: list[str] | None) -> T.StructType:
    """What is parsed of a record: all of it, or its code and what the columns are made of."""
    whole = T.StructType.fromDDL(ENTITY_DDL)
    needed = {"OrgId"}.union(*[_MADE_OF[c] for c in columns]) if columns else whole.names
    return T.StructType([f for f in whole if f.name in needed])


def _records(chunks: DataFrame, prefix: str, columns: list[str] | None = None) -> DataFrame:
    """(file_name, xml, e, _parsed, broken): the text of each record, parsed and numbered; ``broken`` says why it can't be read, else null."""
    # stripping namespaces costs about a sixth of the parse, so only prefixed files pay for it
    options = {**(_OPTIONS if prefix else _PLAIN_OPTIONS), "columnNameOfCorruptRecord": "_unread"}
    cut = F.regexp_extract("value", "(?s)(<(?:[\\w.-]+:)?Organisation[\\s>/].*)$", 1)
    # Spark repeats an expression below a filter that uses it, but not beside a number that it may not repeat
    number = F.monotonically_increasing_id()
    rows = (chunks.select("file_name", F.length("closing").alias("least"), F.concat(cut, F.col("closing")).alias("xml"), number.alias("_cut"))
            .where((F.length("xml") > F.col("least")) & (F.col("_cut") >= 0))
            .select("file_name", "xml", F.from_xml("xml", _schema(columns).add("_unread", "string"), options).alias("e"), number.alias("_parsed")))
    again = F.locate(f"<{prefix}Organisation", F.col("xml"), 2) > 0  # a cheap look before the exact one
    broken = F.when(again & (_starts(F.col("xml")) > 1), "an entity begins inside another").when(
        F.col("e._unread").isNotNull(), "not well-formed").when(F.col("e.OrgId._extension").isNull(), "no code")
    return rows.withColumn("broken", broken)


def _shown(xml: Column) -> Column:
    """Enough of a record to find it: its code where one can be seen, and its beginning."""
    return F.concat(F.regexp_extract(xml, "<(?:[\\w.-]+:)?OrgId[^>]*?extension\\s*=\\s*[\"']([^\"']*)", 1), F.lit(" "), F.substring(xml, 1, 120))


def xml_problems(spark: SparkSession, paths, prefix: str | None = None) -> DataFrame:
    """``file_name, problem, record``: every record that can't be read, and files whose entities don't all end."""
    prefix = tag_prefix(spark, paths) if prefix is None else prefix
    chunks = xml_chunks(spark, paths, "Organisation", prefix)
    bad = _records(chunks, prefix).where("broken IS NOT NULL").select("file_name", F.col("broken").alias("problem"), _shown(F.col("xml")).alias("record"))
    return bad.unionByName(unended(chunks))


def unended(chunks: DataFrame) -> DataFrame:
    """``file_name, problem, record`` of files whose entities don't all end."""
    text = F.col("value")
    counts = chunks.groupBy("file_name").agg(F.sum(_starts(text)).alias("begun"), F.count_if(text.rlike(r"^\s*>")).alias("ended"))
    return counts.where("begun <> ended").select("file_name", F.concat("begun", F.lit(" entities begin, "), "ended", F.lit(" end")).alias("problem"),
                                                 F.lit(None).cast("string").alias("record"))


def _dates(c) -> Column:
    kind = lambda d: F.coalesce(d["Type"]["_value"], d["Type"]["_text"], d["_type"])
    made = F.transform(c, lambda d: F.struct(kind(d).alias("date_type"), d["Start"]["_value"].alias("start"),
                                             d["End"]["_value"].alias("end")))
    return F.coalesce(made, F.array().cast("array<struct<date_type:string,start:string,end:string>>"))


def _either(*arrays) -> Column:
    """Both spellings of a container joined; NULL parts count as empty."""
    kept = F.filter(F.array(*arrays), lambda a: a.isNotNull())
    return F.flatten(kept)


def scan_xml_entities(spark: SparkSession, paths, prefix: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """One nested row per entity element, with its file; values verbatim, nothing merged. A record that can't be read is refused by name.

    With ``columns``, only what these are made of is parsed; a record that is not well-formed or has no code is refused all the same.
    """
    prefix = tag_prefix(spark, paths) if prefix is None else prefix
    return entities_of(xml_chunks(spark, paths, "Organisation", prefix), prefix, columns)


def entities_of(chunks: DataFrame, prefix: str, columns: list[str] | None = None) -> DataFrame:
    """The same from ``xml_chunks``."""
    refused = F.raise_error(F.concat(F.lit("record refused, "), "broken", F.lit(", in "), "file_name", F.lit(": "), _shown(F.col("xml"))))
    fine = F.when(F.col("broken").isNotNull(), refused.cast("boolean")).otherwise(F.col("_parsed") >= 0)
    return _entities(_records(chunks, prefix, columns).where(fine).select("file_name", "e"), columns=columns)


def parse_xml_entities(chunks: DataFrame, prefix: str) -> DataFrame:
    """The same from ``xml_chunks``, refusing nothing: ``problem`` and ``record`` tell of records that can't be read."""
    rows = _records(chunks, prefix).select("file_name", "e", F.col("broken").alias("problem"), F.when(F.col("broken").isNotNull(), _shown(F.col("xml"))).alias("record"))
    return _entities(rows, "problem", "record")


def _entities(rows: DataFrame, *more: str, columns: list[str] | None = None) -> DataFrame:
    loc = "e.GeoLoc.Location."
    text = lambda path: F.nullif(F.col(loc + path), F.lit(""))
    status_of = lambda x: F.coalesce(x["Status"]["_value"], x["_status"])
    roles = F.transform("e.Roles.Role", lambda r: F.struct(
        r["_id"].alias("id"), F.coalesce(r["_uniqueRoleId"], F.lit("")).alias("role_id"),
        F.coalesce(F.lower(r["_primaryRole"]) == "true", F.lit(False)).alias("primary"),
        status_of(r).alias("status"), _dates(r["Date"]).alias("dates")))
    rels = F.transform(_either("e.Rels.Rel", "e.Rels.Relationship", "e.Relationships.Rel",
                               "e.Relationships.Relationship"), lambda r: F.struct(
        r["_id"].alias("id"), F.coalesce(r["_uniqueRelId"], F.lit("")).alias("rel_id"),
        status_of(r).alias("status"), _dates(r["Date"]).alias("dates"),
        r["Target"]["OrgId"]["_extension"].alias("target"),
        F.coalesce(r["Target"]["PrimaryRoleId"]["_id"], r["Target"]["PrimaryRole"]["_id"]).alias("target_role")))
    succs = F.transform(_either("e.Succs.Succ", "e.Succs.Successor", "e.Successors.Succ", "e.Successors.Successor"),
                        lambda s: F.struct(
        F.coalesce(s["_uniqueSuccId"], F.lit("")).alias("succ_id"),
        F.coalesce(s["Type"]["_text"], s["Type"]["_value"], s["_type"]).alias("type"),
        _dates(s["Date"]).alias("dates"), s["Target"]["OrgId"]["_extension"].alias("target")))
    contacts = F.transform("e.Contacts.Contact", lambda c: F.struct(
        c["_type"].alias("type"),
        F.when(F.lower(c["_type"]) == "http", F.lower(c["_value"])).otherwise(c["_value"]).alias("value")))
    made = {
        "code": F.col("e.OrgId._extension"), "name": F.col("e.Name"), "status": F.col("e.Status._value"),
        "record_class": F.coalesce("e.OrgRecordClass._value", "e.OrgRecordClass._text", "e._orgRecordClass"),
        "ref_only": F.coalesce(F.lower("e._refOnly") == "true", F.lit(False)),
        "root": F.col("e.OrgId._root"), "authority": F.col("e.OrgId._assigningAuthorityName"),
        "last_change_date": F.col("e.LastChangeDate._value"), "dates": _dates(F.col("e.Date")),
        "address_lines": F.array_compact(F.array(text("AddrLn1"), text("AddrLn2"), text("AddrLn3"))),
        "town": text("Town"), "county": text("County"), "postcode": text("PostCode"), "country": text("Country"), "uprn": text("UPRN"),
        "contacts": F.coalesce(contacts, F.array().cast("array<struct<type:string,value:string>>")),
        "roles": F.coalesce(roles, F.array().cast("array<struct<id:string,role_id:string,primary:boolean,status:string,"
                                                  "dates:array<struct<date_type:string,start:string,end:string>>>>")),
        "rels": rels, "succs": succs}
    return rows.select("file_name", *[c.alias(name) for name, c in made.items() if not columns or name in columns], *more)


def scan_xml_headers(spark: SparkSession, paths, prefix: str | None = None) -> DataFrame:
    """The chunks that hold a manifest or code list, kept so both are read from one pass over the files."""
    return headers_of(xml_chunks(spark, paths, "Organisation", prefix))


def headers_of(chunks: DataFrame) -> DataFrame:
    """The same from ``xml_chunks``."""
    return checkpoint(chunks.where(F.col("value").contains("Manifest") | F.col("value").contains("oncept "))
                      .select("file_name", "value"))


def manifests_of(headers: DataFrame) -> DataFrame:
    """Per file: declared record count, publication date as written, and the primary-role scope."""
    body = F.regexp_extract("value", "(?s)(<(?:[\\w.-]+:)?Manifest[\\s>].*?</(?:[\\w.-]+:)?Manifest>)", 1)
    scope = F.regexp_extract_all("value", F.lit(f"(?s)(<(?:[\\w.-]+:)?PrimaryRole{_ATTRS}\\s*/?>)"), F.lit(1))
    ids = F.transform(scope, lambda t: F.regexp_extract(t, "\\sid\\s*=\\s*[\"']([^\"']*)[\"']", 1))
    head = headers.withColumn("m", body).where(F.col("m") != "")
    parsed = F.from_xml("m", "RecordCount struct<_value: string>, PublicationDate struct<_value: string>", _OPTIONS)
    return head.withColumn("p", parsed).select(
        "file_name", F.col("p.RecordCount._value").try_cast("bigint").alias("record_count"),
        F.col("p.PublicationDate._value").alias("publication_date"), ids.alias("primary_role_scope"))


def concepts_of(headers: DataFrame, file: str = "file_name") -> DataFrame:
    """Code-list entries by id and by code -> display name; the first file wins, its last entry for a code."""
    tags = F.regexp_extract_all("value", F.lit(f"(?s)(<(?:[\\w.-]+:)?[Cc]oncept{_ATTRS}\\s*/?>)"), F.lit(1))
    one = F.concat(F.regexp_replace("tag", "\\s*/?>$", ""), F.lit("/>"))
    parsed = F.from_xml(one, "_id string, _code string, _displayName string", _OPTIONS)
    rows = headers.select(file, F.posexplode(tags).alias("ordinal", "tag")).withColumn("c", parsed)
    keyed = rows.select(file, "ordinal", F.col("c._displayName").alias("display_name"),
                        F.explode(F.array_compact(F.array("c._id", "c._code"))).alias("code"))
    return (keyed.where(F.col("display_name").isNotNull()).groupBy("code")
            .agg(F.min_by("display_name", F.struct(F.col(file), -F.col("ordinal"))).alias("display_name")))


def scan_xml_manifest(spark: SparkSession, paths, prefix: str | None = None) -> DataFrame:
    """``manifests_of`` the files' headers."""
    return manifests_of(scan_xml_headers(spark, paths, prefix))


def scan_xml_concepts(spark: SparkSession, paths, prefix: str | None = None) -> DataFrame:
    """``concepts_of`` the files' headers."""
    return concepts_of(scan_xml_headers(spark, paths, prefix))


def scan_xml_release(spark: SparkSession, paths_in_order: list[str]) -> DataFrame:
    """Entities of all source files of a release with ``file_index``, full file first."""
    return _indexed([scan_xml_entities(spark, p) for p in paths_in_order])


def scan_xml_parts(spark: SparkSession, paths_in_order: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Some columns of the same entities, and the files' code lists, from one look for sections that cross cuts."""
    prefixes = [tag_prefix(spark, p) for p in paths_in_order]
    chunks = [xml_chunks(spark, p, prefix=prefix) for p, prefix in zip(paths_in_order, prefixes, strict=True)]
    entities = _indexed([entities_of(c, prefix, columns) for c, prefix in zip(chunks, prefixes, strict=True)])
    return entities, concepts_of(headers_of(reduce(DataFrame.unionByName, chunks)))


def _indexed(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("file_index", F.lit(i)) for i, df in enumerate(parts)])
