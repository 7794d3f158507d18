"""Every entity's profile at once: roles, relationships, anomalies, counts, documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.functions.dates import is_closed_record
from rollbook.functions.roles import relationship_phrase, relationship_rank
from rollbook.functions.text import name_at_code, numeric_part
from rollbook.runtime import written

_ITEM_DATES = ["legal_start", "legal_end", "operational_start", "operational_end"]


def lookup(orgs: DataFrame, code: str) -> DataFrame:
    """The entity with a code, ignoring case."""
    return orgs.where(F.upper("ods_code") == code.upper())


def profile_roles(orgs: DataFrame, roles: DataFrame) -> DataFrame:
    """Role rows per entity; entities without any are given their role lists as active roles."""
    held = roles.join(orgs.select("ods_code", "primary_role_code"), "ods_code").select(
        "ods_code", "role_code", "role_name",
        F.coalesce("is_primary", F.col("role_code") == F.col("primary_role_code")).alias("is_primary"),
        F.coalesce("role_status", F.lit("active")).alias("role_status"), "operational_start", "operational_end")
    bare = orgs.join(roles.select("ods_code").distinct(), "ods_code", "left_anti").select(
        "ods_code", "primary_role_code",
        F.explode(F.slice(F.arrays_zip(F.col("role_codes").alias("code"), F.col("role_names").alias("name")), F.lit(1),
                          F.least(F.size("role_codes"), F.size("role_names")))).alias("r"))
    no_date = F.lit(None).cast("date")
    lists = bare.select("ods_code", F.col("r.code").alias("role_code"), F.col("r.name").alias("role_name"),
                        (F.col("r.code") == F.col("primary_role_code")).alias("is_primary"),
                        F.lit("active").alias("role_status"), no_date.alias("operational_start"),
                        no_date.alias("operational_end"))
    return held.unionByName(lists)


def profile_rels(orgs: DataFrame, rels: DataFrame, names: bool = True) -> DataFrame:
    """Each relationship under both of its ends, with the other side's name; a self-edge once, outbound.

    Both ends are looked up while a relationship is still one row. Without ``names`` there is no name column and none is carried along.
    """
    state = F.coalesce(F.nullif("rel_status", F.lit("")), F.lit("active")).alias("rel_status")
    rest = ["rel_code", "rel_name", *_ITEM_DATES, "rel_id"]
    shown = F.coalesce("name", F.lit("")) if names else F.lit("")
    known = orgs.groupBy("ods_code").agg(F.collect_list(shown).alias("names"))  # an entry a row, so rows of one code stay several
    end = lambda e: known.select(F.col("ods_code").alias(f"{e}_code"), F.col("names").alias(e))
    both = rels.select("source_code", "target_code", *rest, state).join(end("target"), "target_code", "left").join(end("source"), "source_code", "left")

    def seen(direction: str, own: str, other: str) -> Column:
        return F.transform(F.coalesce(other, F.array(F.lit(""))), lambda n: F.struct(
            F.col(f"{own}_code").alias("ods_code"), F.lit(direction).alias("direction"), F.col(f"{other}_code").alias("code"), n.alias("name")))

    out = seen("outbound", "source", "target")
    none = F.slice(out, F.lit(1), F.lit(0))
    back = F.when(F.col("target").isNotNull() & (F.col("source_code") != F.col("target_code")), seen("inbound", "target", "source")).otherwise(none)
    rows = both.select(F.explode(F.concat(F.when(F.col("source").isNotNull(), out).otherwise(none), back)).alias("x"), *rest, "rel_status")
    return rows.select("x.ods_code", "x.direction", "x.code", *(["x.name"] if names else []), "rel_code", "rel_name", "rel_status", *_ITEM_DATES, "rel_id")


def role_sort() -> list[Column]:
    """Open first, oldest start, numeric role code, code. Missing starts sort first."""
    return [F.col("operational_end").isNull().desc(), F.col("operational_start").asc_nulls_first(),
            numeric_part("role_code"), F.col("role_code")]


def rel_sort_card() -> list[Column]:
    """Display type order, open first, newest start, other code. Missing starts sort last."""
    return [relationship_rank(F.col("rel_code")), F.col("operational_end").isNull().desc(),
            F.col("operational_start").desc_nulls_last(), F.col("code")]


def rel_sort_json() -> list[Column]:
    """Outbound first, type name, active first, newest start, other code."""
    return [F.col("direction").desc(), F.col("rel_name"), (F.lower("rel_status") == "active").desc(),
            F.col("operational_start").desc_nulls_last(), F.col("code")]


def with_phrase(rels: DataFrame) -> DataFrame:
    return rels.withColumn("phrase", relationship_phrase(F.col("rel_code")))


def anomaly(record_end, start, end) -> Column:
    """First rule a row breaks against its entity's operational end; NULL when none."""
    return (F.when(record_end.isNull(), F.lit(None).cast("string"))
            .when(end.isNull(), F.lit("still-open"))
            .when(start > record_end, F.lit("starts-after"))
            .when(end > record_end, F.lit("ends-after")))


def with_anomaly(items: DataFrame, orgs: DataFrame) -> DataFrame:
    """Role or relationship rows with their ``anomaly`` and whether their entity is closed."""
    facts = orgs.select("ods_code", F.col("operational_end").alias("record_end"), is_closed_record().alias("record_closed"))
    return items.join(facts, "ods_code").withColumn(
        "anomaly", anomaly(F.col("record_end"), F.col("operational_start"), F.col("operational_end"))).drop("record_end")


def visible_rows(items: DataFrame, all_rows: bool = False) -> DataFrame:
    """Rows a profile shows: all of a closed entity's, else the open ones."""
    return items if all_rows else items.where(F.col("record_closed") | F.col("operational_end").isNull())


def anomaly_counts(role_items: DataFrame, rel_items: DataFrame) -> DataFrame:
    """Anomalies per entity and class over the shown roles and outbound relationships."""
    both = visible_rows(role_items).select("ods_code", "anomaly").unionByName(
        visible_rows(rel_items).where("direction = 'outbound'").select("ods_code", "anomaly"))
    return both.where("anomaly IS NOT NULL").groupBy("ods_code", "anomaly").agg(F.count("*").alias("n"))


def profile_counts(role_items: DataFrame, rel_items: DataFrame) -> DataFrame:
    """Open and closed roles and outbound relationships per entity."""
    is_open = F.col("operational_end").isNull()
    tag = lambda df, what: df.select("ods_code", F.lit(what).alias("what"), is_open.alias("open"))
    rows = tag(role_items, "role").unionByName(tag(rel_items.where("direction = 'outbound'"), "rel"))
    n = lambda what, flag: F.count_if((F.col("what") == what) & (F.col("open") == flag))
    return rows.groupBy("ods_code").agg(n("role", True).alias("open_roles"), n("role", False).alias("closed_roles"),
                                        n("rel", True).alias("open_rels"), n("rel", False).alias("closed_rels"))


def role_name_columns() -> dict[str, Column]:
    """Name at the primary code, and the other roles as ``"name (code)"``."""
    pairs = F.arrays_zip(F.col("role_codes").alias("code"), F.col("role_names").alias("name"))
    rest = F.transform(F.filter(pairs, lambda p: p["code"] != F.col("primary_role_code")),
                       lambda p: F.concat(p["name"], F.lit(" ("), p["code"], F.lit(")")))
    first = F.coalesce(name_at_code("role_names", "role_codes", F.col("primary_role_code")), F.lit(""))
    return {"primary_role_name": first, "other_roles": rest}


def primary_role_name(orgs: DataFrame) -> DataFrame:
    return orgs.withColumns(role_name_columns()).select("ods_code", "primary_role_name", "other_roles")


def relationship_items(orgs: DataFrame, rels: DataFrame) -> DataFrame:
    """The relationships of every profile document as rows, as ``profile_items`` has them; they come first in a document."""
    r = profile_rels(orgs, rels)
    late = F.datediff(F.lit("9999-12-31").cast("date"), F.coalesce("operational_start", F.lit("0001-01-01").cast("date")))
    rel_key = F.array(F.when(F.col("direction") == "outbound", "0").otherwise("1"), F.col("rel_name"),
                      F.when(F.lower("rel_status") == "active", "0").otherwise("1"), F.lpad(late.cast("string"), 8, "0"),
                      F.col("code"), F.col("rel_id").cast("string"))
    return r.select("ods_code", F.lit("relationships").alias("section"), rel_key.alias("sort_key"), F.to_json(
        F.struct("rel_code", "rel_name", "direction", "code", "name", F.col("rel_status").alias("status"), "operational_start",
                 "operational_end", "legal_start", "legal_end"), {"ignoreNullFields": "false"}).alias("item"))


def relationship_positions(orgs: DataFrame, rels: DataFrame) -> DataFrame:
    """``ods_code, code, rel_id, position`` of the relationships in profile documents, as ``profile_positions`` has them, without their items.

    Relationships that are alike in all they are ordered by are alike in what is returned, so only that is dealt out, once. Codes
    that several entities share are few: a relationship to one is seen once for each.
    """
    own, other = rels.select("source_code", "target_code", "rel_name", "rel_status", "operational_start", "rel_id"), orgs.select("ods_code")
    several = written(other.groupBy("ods_code").agg(F.count("*").alias("n")).where("n > 1"))
    active = F.lower(F.coalesce(F.nullif("rel_status", F.lit("")), F.lit("active"))) == "active"
    late = F.datediff(F.lit("9999-12-31").cast("date"), F.coalesce("operational_start", F.lit("0001-01-01").cast("date")))
    end = lambda inbound, mine, theirs: F.struct(F.lit(inbound).alias("inbound"), F.col(mine).alias("ods_code"), F.col(theirs).alias("code"))
    both = F.array(end(False, "source_code", "target_code"), F.when(F.col("source_code") != F.col("target_code"), end(True, "target_code", "source_code")))
    rows = own.select(F.explode(both).alias("x"), "rel_name", F.when(active, 0).otherwise(1).cast("byte").alias("state"), late.alias("late"),
                      F.col("rel_id").cast("string").alias("rel_id")).where("x IS NOT NULL").select("x.*", "rel_name", "state", "late", "rel_id")
    if not several.isEmpty():
        rows = rows.join(several.toDF("code", "n"), "code", "left").withColumn(
            "again", F.explode(F.array_repeat(F.lit(0), F.coalesce("n", F.lit(1)).cast("int")))).drop("n", "again")
    order = Window.partitionBy("ods_code").orderBy("inbound", "rel_name", "state", "late", "code", "rel_id")
    return rows.join(other.distinct(), "ods_code", "left_semi").select("ods_code", "code", "rel_id", F.row_number().over(order).alias("position"))


def predecessor_items(preds: DataFrame) -> DataFrame:
    """The direct predecessors of every profile document as rows, as ``profile_items`` has them."""
    return preds.withColumn("depth", F.lit(1)).select(
        "ods_code", F.lit("predecessors").alias("section"), F.array(F.col("hop_code"), F.col("succession_id").cast("string")).alias("sort_key"),
        _hop_json().alias("item"))


def _hop_json() -> Column:
    return F.to_json(F.struct("depth", F.col("hop_date").alias("date"), F.col("hop_code").alias("code"),
                              F.col("hop_name").alias("name"), F.col("hop_status").alias("status")),
                     {"ignoreNullFields": "false"})


def profile_items(orgs: DataFrame, rels: DataFrame, chain: DataFrame, preds: DataFrame) -> DataFrame:
    """The parts of every profile document as rows: ``ods_code, section, sort_key, item`` (JSON).

    ``sort_key`` is a list and is compared entry by entry, so a name before a longer one. ``chain`` holds hops with their ``place``
    in a depth-first walk or, ordered alike, their ``path``.
    """
    walked = F.array(F.lpad(F.col("place").cast("string"), 12, "0")) if "place" in chain.columns else F.col("path")
    succ_rows = chain.select("ods_code", F.lit("succession").alias("section"), walked.alias("sort_key"), _hop_json().alias("item"))
    return relationship_items(orgs, rels).unionByName(succ_rows).unionByName(predecessor_items(preds))


def profile_positions(items: DataFrame) -> DataFrame:
    """Items with their ``position`` in the entity's document, from 1."""
    order = F.when(F.col("section") == "relationships", 0).when(F.col("section") == "succession", 1).otherwise(2)
    own = Window.partitionBy("ods_code")
    return items.withColumn("position", F.row_number().over(own.orderBy(order, "sort_key", "item"))).withColumn("_n", F.count("*").over(own))


def profile_json(orgs: DataFrame, items: DataFrame, part_rows: int = 50_000) -> DataFrame:
    """One JSON document per entity: its columns, role names, relationships, succession, predecessors.

    The items of an entity, in order, are cut into numbered parts of ``part_rows``, each a full header with its
    stretch of the items; ``profile_positions`` is the same as rows.
    """
    placed = profile_positions(items).withColumn("part", F.floor((F.col("position") - 1) / part_rows).cast("int")) \
        .withColumn("parts", F.ceil(F.col("_n") / part_rows).cast("int"))
    lists = placed.groupBy("ods_code", "part", "parts").agg(*[_sorted_items(s).alias(s) for s in _SECTIONS])
    return _documents(_heads(orgs).join(lists, "ods_code", "left"), *[F.array_join(F.coalesce(s, F.array().cast("array<string>")), ",") for s in _SECTIONS])


_SECTIONS = ["relationships", "succession", "predecessors"]


def _sorted_items(section: str) -> Column:
    """The items of a section in a group of rows, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("sort_key", "item")))), lambda i: i["item"])


def _heads(orgs: DataFrame) -> DataFrame:
    return orgs.withColumns(role_name_columns()).withColumn(
        "head", F.to_json(F.struct(*orgs.columns, "primary_role_name", "other_roles"), {"ignoreNullFields": "false"})).select("ods_code", "head")


def _documents(rows: DataFrame, *sections: Column) -> DataFrame:
    """Rows with ``head, part, parts`` and the text of each section's items."""
    body = F.concat(F.expr("substring(head, 1, length(head) - 1)"), *[
        F.concat(F.lit(f',"{s}":['), text, F.lit("]")) for s, text in zip(_SECTIONS, sections, strict=True)], F.lit("}"))
    return rows.select("ods_code", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), body.alias("document"))


def profile_documents(orgs: DataFrame, rels: DataFrame, preds: DataFrame, hops: DataFrame,
                      runs: Callable[[DataFrame, bool], DataFrame], part_rows: int = 50_000) -> DataFrame:
    """``profile_json`` where hops never are rows: ``hops`` counts them by entity, ``runs`` lists them by part of a document.

    A part that holds nothing but hops is made by the task that walks; of the others, one or two an entity, the lists meet the other items.
    """
    items = relationship_items(orgs, rels)
    more = predecessor_items(preds)
    n = lambda df, name: df.groupBy("ods_code").agg(F.count("*").alias(name))
    sizes = written(n(items, "before").join(hops, "ods_code", "full").join(n(more, "after"), "ods_code", "full").na.fill(0, ["before", "hops", "after"])
                    .withColumn("total", F.col("before") + F.col("hops") + F.col("after")))
    parts = F.ceil(F.col("total") / part_rows).cast("int").alias("parts")
    place = F.col("position") - 1 + F.when(F.col("section") == "predecessors", F.col("hops")).otherwise(0)
    rest = profile_positions(items.unionByName(more)).join(sizes, "ods_code").select(
        "ods_code", "section", "sort_key", "item", F.floor(place / part_rows).cast("int").alias("part"), parts)
    text = F.to_json("hops", {"ignoreNullFields": "false"})
    text = F.expr("substring(text, 2, length(text) - 2)"), text.alias("text")
    walked = sizes.where("hops > 0").withColumn("code", F.col("ods_code"))
    # a part with hops and others has a row of the others, so lists stay where positions were numbered
    edge = runs(walked.withColumn("head", F.lit("")), False).select("ods_code", "part", text[1]).withColumn("text", text[0])
    texts = edge.groupBy("ods_code").agg(F.map_from_entries(F.collect_list(F.struct("part", "text"))).alias("texts"))
    lists = rest.groupBy("ods_code", "part", "parts").agg(*[_sorted_items(s).alias(s) for s in _SECTIONS]).join(
        texts, "ods_code", "left").withColumn("text", F.try_element_at("texts", F.col("part"))).drop("texts")
    heads = _heads(orgs)
    bare = heads.join(sizes.where("total > 0"), "ods_code", "left_anti")
    mixed = heads.join(lists, "ods_code").unionByName(bare, allowMissingColumns=True)
    none = F.array().cast("array<string>")
    inner = runs(heads.join(walked, "ods_code"), True).select("ods_code", "head", "part", parts, text[1]).withColumn("text", text[0])
    listed = lambda s: F.array_join(F.coalesce(s, none), ",")
    return _documents(mixed, listed("relationships"), F.coalesce("text", F.lit("")), listed("predecessors")).unionByName(
        _documents(inner, F.lit(""), F.col("text"), F.lit("")))
