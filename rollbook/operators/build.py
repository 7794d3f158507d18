"""From source records to the four tables: choose files, merge, normalise, project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook import schemas
from rollbook.functions.dates import first_of_type, last_of_type, parse_date
from rollbook.functions.roles import COMMISSIONED_BY, GEOGRAPHY_OF
from rollbook.runtime import checkpoint

# --- files of a release -------------------------------------------------------------------


def choose_source_pair(files: DataFrame, release: str = "release") -> DataFrame:
    """The full and archive file each release is built from, or why it is refused.

    ``files``: release, release_date, kind (``full``/``archive``), file_name, publication_date.
    Several dates with a pair: the one nearest the release date; a tie, or no pair, refuses.
    Pairs are counted per date, never listed.
    """
    is_full, is_archive = F.col("kind") == "full", F.col("kind") == "archive"
    per_date = (files.where(F.col("publication_date").isNotNull())
                .groupBy(release, "release_date", "publication_date")
                .agg((F.count_if(is_full) * F.count_if(is_archive)).alias("pairs"),
                     F.min(F.when(is_full, F.col("file_name"))).alias("full_file"),
                     F.min(F.when(is_archive, F.col("file_name"))).alias("archive_file"))
                .where("pairs > 0")
                .withColumn("distance", F.abs(F.datediff("publication_date", "release_date"))))
    best = per_date.groupBy(release).agg(
        F.sum("pairs").alias("pairs"), F.min("distance").alias("distance"),
        F.min_by(F.struct("full_file", "archive_file", "publication_date"), F.col("distance")).alias("pick"))
    at_best = (per_date.join(best.select(release, F.col("distance").alias("nearest")), release)
               .where(F.col("distance") == F.col("nearest")).groupBy(release).agg(F.sum("pairs").alias("at_nearest")))
    verdict = (F.when(F.col("pairs").isNull(), F.lit("no pair"))
               .when(F.col("pairs") == 1, F.lit("chosen"))
               .when(F.col("at_nearest").isNull(), F.lit("no release date"))
               .when(F.col("at_nearest") == 1, F.lit("chosen"))
               .otherwise(F.lit("tie")))
    joined = files.select(release).distinct().join(best, release, "left").join(at_best, release, "left") \
        .withColumn("verdict", verdict)
    chosen = F.col("verdict") == "chosen"
    single = per_date.groupBy(release).agg(F.min_by(F.struct("full_file", "archive_file", "publication_date"),
                                                    F.coalesce("distance", F.lit(0))).alias("only"))
    pick = F.coalesce("pick", "only")
    return joined.join(single, release, "left").select(
        release, "verdict", *[F.when(chosen, pick[c]).alias(c)
                              for c in ("full_file", "archive_file", "publication_date")])


def agree_publication_date(manifests: DataFrame, by: str | None = None) -> DataFrame:
    """The date all files state, or ``undated`` / ``disagree``; see ``stated_dates`` for who says what."""
    day = parse_date("publication_date")
    out = manifests.groupBy(*([by] if by else [])).agg(
        F.count_if(day.isNull()).alias("undated_files"), F.count_distinct("publication_date").alias("dates"),
        F.min(day).alias("agreed"))
    verdict = (F.when(F.col("undated_files") > 0, F.lit("undated")).when(F.col("dates") > 1, F.lit("disagree"))
               .otherwise(F.lit("agreed")))
    return out.withColumn("verdict", verdict).withColumn(
        "publication_date", F.when(F.col("verdict") == "agreed", F.col("agreed"))).drop("agreed")


def stated_dates(manifests: DataFrame) -> DataFrame:
    """What each file says about its date, for a refusal."""
    stated = F.col("publication_date")
    says = (F.when(stated.isNull(), F.lit("no PublicationDate"))
            .when(parse_date("publication_date").isNull(), F.concat(F.lit("PublicationDate '"), stated, F.lit("', not a date")))
            .otherwise(F.concat(F.lit("PublicationDate "), stated)))
    return manifests.withColumn("says", says)


def check_record_counts(records: DataFrame, manifests: DataFrame, file: str = "file_name") -> DataFrame:
    """Declared and read records summed over all files, before merging."""
    read = records.groupBy(file).agg(F.count("*").alias("read"))
    both = manifests.select(file, F.col("record_count").alias("declared")).join(read, file, "full_outer")
    return both.agg(F.sum("declared").alias("declared"), F.sum(F.coalesce("read", F.lit(0))).alias("read"),
                    F.count_if(F.col("declared").isNull()).alias("undeclared_files")).withColumn(
        "ok", (F.col("undeclared_files") > 0) | (F.col("declared") == F.col("read")))


# --- merge --------------------------------------------------------------------------------


def _preference(ref_only: str, file_index: str, started: str) -> Column:
    return F.struct((~F.col(ref_only)).alias("complete"), (-F.col(file_index)).alias("earlier_file"),
                    F.col(started).alias("started"))


def merge_entities(records: DataFrame, code: str = "code", ref_only: str = "ref_only",
                   file_index: str = "file_index", started: str = "op_start") -> DataFrame:
    """One record per code: complete beats stub, earlier file beats later, later start wins in a file.

    A ``max_by`` aggregate keeps one candidate per code on the map side, so a code
    repeated many times never gathers in one task.
    """
    best = records.groupBy(code).agg(
        F.max_by(F.struct(*records.columns), _preference(ref_only, file_index, started)).alias("r"))
    return best.select("r.*")


def split_repeated(records: DataFrame, code: str = "code") -> tuple[DataFrame, DataFrame]:
    """Records whose code occurs once, and the others.

    For written records: the repeated codes come from one narrow column. In a sound source they
    are few, so the wide rows are not shuffled to be merged; only the repeated ones are.
    """
    repeated = checkpoint(records.groupBy(code).agg(F.count("*").alias("n")).where("n > 1").select(code))
    return records.join(repeated, code, "left_anti"), records.join(repeated, code, "left_semi")


def _code_facts(records: DataFrame, code: str, ref_only: str, file_index: str, started: str) -> DataFrame:
    """Per code, by staged counts: the winning file, its latest start and rivals, and the stubs before it.

    Equal records are counted first, then summed per file, then per code. The last step
    gathers one entry per file, and a release has few files.
    """
    same = records.groupBy(code, file_index, ref_only, started).agg(F.count("*").alias("n"))
    stub, n = F.col(ref_only), F.col("n")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    per_file = same.groupBy(code, file_index).agg(
        total(stub).alias("stubs"), total(~stub).alias("complete"), total(~stub & F.col(started).isNull()).alias("undated"),
        F.max(F.when(~stub & F.col(started).isNotNull(), F.struct(F.col(started).alias("start"), n.alias("n")))).alias("top"))
    files = per_file.groupBy(code).agg(F.array_sort(F.collect_list(F.struct(
        F.col(file_index).alias("file"), "stubs", "complete", "undated", "top"))).alias("files"))
    win = F.try_element_at(F.filter("files", lambda f: f["complete"] > 0), F.lit(1))
    add = lambda items: F.aggregate(items, F.lit(0).cast("bigint"), lambda x, y: x + y)
    early = F.filter("files", lambda f: F.col("win").isNull() | (f["file"] < F.col("win.file")))
    return files.withColumn("win", win).select(
        code, F.col("win.file").alias("win_file"), F.col("win.top.start").alias("win_start"), F.col("win.top.n").alias("at_top"),
        F.col("win.complete").alias("rivals"), F.col("win.undated").alias("undated"),
        add(F.transform(early, lambda f: f["stubs"])).alias("early_stubs"),
        add(F.transform("files", lambda f: f["stubs"] + f["complete"])).alias("records"))


def merge_contradictions(records: DataFrame, code: str = "code", ref_only: str = "ref_only",
                         file_index: str = "file_index", started: str = "op_start") -> DataFrame:
    """Codes whose records contradict each other: two stubs, or rivals in one file with no later start.

    Row order inside a file is not kept, so a tie counts only at the latest start,
    and stubs count only in files before the first complete record.
    """
    reason = (F.when(F.col("early_stubs") > 1, F.lit("two stubs"))
              .when((F.col("rivals") > 1) & (F.col("undated") > 0), F.lit("no start to compare"))
              .when((F.col("rivals") > 1) & (F.col("at_top") > 1), F.lit("equal start")))
    facts = _code_facts(records, code, ref_only, file_index, started).withColumn("reason", reason)
    return facts.where(F.col("reason").isNotNull()).select(code, "records", "reason")


def merge_fate(records: DataFrame, code: str = "code", ref_only: str = "ref_only", file_index: str = "file_index",
               started: str = "op_start") -> DataFrame:
    """Every record with what the merge did to it (``fate``), by joining staged per-code minima and maxima."""
    facts = _code_facts(records, code, ref_only, file_index, started).select(code, "win_file", "win_start")
    joined = records.join(facts, code)
    stub = F.col(ref_only)
    fate = (F.when(stub & F.col("win_file").isNotNull(), F.lit("stub superseded"))
            .when(stub, F.lit("stub kept"))
            .when(F.col(file_index) != F.col("win_file"), F.lit("dropped: complete in an earlier file"))
            .when(F.col(started).eqNullSafe(F.col("win_start")), F.lit("kept"))
            .otherwise(F.lit("dropped: starts earlier in the same file")))
    return joined.withColumn("fate", fate).drop("win_file", "win_start")


def merge_report(records: DataFrame, **names) -> DataFrame:
    """Records per merge outcome."""
    return merge_fate(records, **names).groupBy("fate").agg(F.count("*").alias("records"))


# --- normalise ----------------------------------------------------------------------------


def record_class(c) -> Column:
    return F.when(F.col(c) == "RC2", F.lit("site")).otherwise(F.lit("org"))


def primary_role(roles) -> Column:
    """First role flagged primary, as a struct."""
    return F.try_element_at(F.filter(roles, lambda r: r["primary"]), F.lit(1))


def normal_relationships(rels="rels") -> Column:
    """Relationships with their states in lower case; one without a state is active."""
    return F.transform(rels, lambda r: r.withField("status", F.lower(F.coalesce(r["status"], F.lit("active")))))


def normalise_entities(records: DataFrame) -> DataFrame:
    """Lower-case states and types, map the record class, default missing states.

    An entity without a status takes its primary role's; roles and relationships
    without one are active.
    """
    roles = F.transform("roles", lambda r: r.withField("status", F.lower(F.coalesce(r["status"], F.lit("active")))))
    rels = normal_relationships()
    succs = F.transform("succs", lambda s: s.withField("type", F.lower(s["type"])))
    return (records.withColumn("roles", roles).withColumn("rels", rels).withColumn("succs", succs)
            .withColumn("status", F.lower(F.coalesce("status", primary_role("roles")["status"], F.lit("active"))))
            .withColumn("record_class", record_class("record_class")))


def operational_start(dates="dates") -> Column:
    """Start of the operational period as text, the key rivals in one file are compared on."""
    return last_of_type(dates, "operational")["start"]


def pick_dates(dates) -> dict[str, Column]:
    """The four interval columns as text: the last block of each type wins."""
    legal, operational = last_of_type(dates, "legal"), last_of_type(dates, "operational")
    return {"legal_start": legal["start"], "legal_end": legal["end"],
            "operational_start": operational["start"], "operational_end": operational["end"]}


def _date_columns(dates) -> list[Column]:
    return [parse_date(c).alias(name) for name, c in pick_dates(dates).items()]


def unread_dates(df: DataFrame, key: str, raw: dict[str, Column]) -> DataFrame:
    """How many raw dates do not parse, and the first by key and column order."""
    bad = [F.when(c.isNotNull() & parse_date(c).isNull(),
                  F.struct(F.col(key).alias("code"), F.lit(pos).alias("pos"), F.lit(name).alias("column"),
                           c.alias("value")))
           for pos, (name, c) in enumerate(raw.items())]
    rows = df.select(F.explode(F.array_compact(F.array(*bad))).alias("b"))
    return rows.agg(F.count("*").alias("unread"), F.min("b").alias("first")).select("unread", "first.code",
                                                                                   "first.column", "first.value")


# --- projection ---------------------------------------------------------------------------


def role_codes(status="status", roles="roles") -> Column:
    """Distinct sorted codes: active roles of an active entity, every role of an inactive one."""
    held = F.filter(roles, lambda r: (F.col(status) != "active") | (r["status"] == "active"))
    return F.array_sort(F.array_distinct(F.transform(held, lambda r: r["id"])))


def primary_role_code(roles="roles") -> Column:
    return F.coalesce(primary_role(roles)["id"], F.lit(""))


def address(lines="address_lines", town="town", postcode="postcode") -> Column:
    """Non-blank address lines, town and postcode joined ``", "``; NULL when there are none."""
    parts = F.concat(F.col(lines), F.array(F.col(town), F.col(postcode)))
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


def first_contact(kind: str, contacts="contacts") -> Column:
    return F.try_element_at(F.filter(contacts, lambda c: c["type"] == kind), F.lit(1))["value"]


def parent_code(rels="rels", kind: str = COMMISSIONED_BY) -> Column:
    """Target of the first active relationship of one type (commissioner, or region)."""
    return F.try_element_at(F.filter(rels, lambda r: (r["status"] == "active") & (r["id"] == kind)),
                            F.lit(1))["target"]


def parent_and_region(entities: DataFrame) -> DataFrame:
    return entities.select("code", parent_code(kind=COMMISSIONED_BY).alias("parent"),
                           parent_code(kind=GEOGRAPHY_OF).alias("region"))


def primary_role_display(entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """Code-list name of the active primary role, else of any primary role, else ``unknown``."""
    active = F.try_element_at(F.filter("roles", lambda r: r["primary"] & (r["status"] == "active")), F.lit(1))["id"]
    names = concepts.select(F.col("code").alias("_id"), F.col("display_name"))
    rows = entities.select("code", active.alias("a"), primary_role("roles")["id"].alias("p"))
    named = (rows.join(names.withColumnsRenamed({"_id": "a", "display_name": "an"}), "a", "left")
             .join(names.withColumnsRenamed({"_id": "p", "display_name": "pn"}), "p", "left"))
    return named.select("code", F.lower(F.coalesce("an", "pn", F.lit("unknown"))).alias("role"))


def with_role_names(df: DataFrame, vocab: DataFrame, codes: str = "role_codes", out: str = "role_names",
                    key: str = "ods_code") -> DataFrame:
    """Names aligned with ``codes`` by position; a vocabulary that holds a code twice is refused."""
    twice = F.raise_error(F.concat(F.lit("vocabulary holds a code twice: "), F.col("role_code"))).cast("string")
    single = vocab.groupBy("role_code").agg(F.count("*").alias("_n"), F.min("role_name").alias("role_name")) \
        .select("role_code", F.when(F.col("_n") > 1, twice).otherwise(F.col("role_name")).alias("role_name"))
    flat = df.select(key, F.posexplode(codes).alias("pos", "role_code")).join(single, "role_code", "left")
    named = flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role_name"))),
                                              lambda p: p["role_name"]).alias(out))
    return df.join(named, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def vocab_missing(codes: DataFrame, vocab: DataFrame, code: str = "role_code") -> DataFrame:
    """Observed codes without a curated name; a build with any is refused. One aggregation, reduced before its shuffle, and no join."""
    both = codes.select(code, F.lit(False).alias("curated")).unionByName(vocab.select(code, F.lit(True).alias("curated")))
    return both.groupBy(code).agg(F.max("curated").alias("curated")).where("NOT curated").select(code)


def project_orgs(entities: DataFrame, vocab: DataFrame, successors: DataFrame, predecessors: DataFrame,
                 publication_date) -> DataFrame:
    """The entity table. ``successors``/``predecessors``: ods_code and its sorted code list."""
    day = F.lit(publication_date).cast("date") if isinstance(publication_date, str) else publication_date
    flat = entities.select(
        F.col("code").alias("ods_code"), "name", "status", "record_class", role_codes().alias("role_codes"),
        primary_role_code().alias("primary_role_code"), address().alias("address"), "town", "county", "postcode",
        "country", "uprn", first_contact("tel").alias("telephone"), first_contact("http").alias("website"),
        *_date_columns("dates"), parse_date("last_change_date").alias("last_changed"), day.alias("publication_date"))
    named = with_role_names(flat, vocab)
    none = F.array().cast("array<string>")
    linked = named.join(successors.select("ods_code", "successor_codes"), "ods_code", "left") \
        .join(predecessors.select("ods_code", "predecessor_codes"), "ods_code", "left")
    return linked.withColumn("successor_codes", F.coalesce("successor_codes", none)) \
        .withColumn("predecessor_codes", F.coalesce("predecessor_codes", none)).select(schemas.ORGS.names)


def explode_roles(entities: DataFrame, vocab: DataFrame, publication_date) -> DataFrame:
    """One row per role holding."""
    day = F.lit(publication_date).cast("date") if isinstance(publication_date, str) else publication_date
    rows = entities.select(F.col("code").alias("ods_code"), F.explode("roles").alias("r"))
    flat = rows.select("ods_code", F.col("r.id").alias("role_code"), F.col("r.primary").alias("is_primary"),
                       F.col("r.status").alias("role_status"), *_date_columns("r.dates"), "r.role_id",
                       day.alias("publication_date"))
    return flat.join(vocab.select("role_code", "role_name"), "role_code", "left").select(schemas.ROLES.names)


def explode_relationships(entities: DataFrame, concepts: DataFrame, publication_date) -> DataFrame:
    """One row per relationship; the code itself when the code lists do not name it."""
    day = F.lit(publication_date).cast("date") if isinstance(publication_date, str) else publication_date
    rows = entities.select(F.col("code").alias("source_code"), F.explode("rels").alias("r"))
    flat = rows.select("source_code", F.col("r.target").alias("target_code"), F.col("r.id").alias("rel_code"),
                       F.col("r.status").alias("rel_status"), *_date_columns("r.dates"), "r.rel_id",
                       day.alias("publication_date"))
    names = concepts.select(F.col("code").alias("rel_code"), F.col("display_name"))
    return flat.join(names, "rel_code", "left").withColumn("rel_name", F.coalesce("display_name", "rel_code")) \
        .select(schemas.RELATIONSHIPS.names)


def succession_edges(entities: DataFrame, publication_date) -> DataFrame:
    """Directed predecessor -> successor edges, one per succession id (first by entity code)."""
    day = F.lit(publication_date).cast("date") if isinstance(publication_date, str) else publication_date
    rows = entities.select("code", F.posexplode("succs").alias("pos", "s"))
    backwards = F.lower("s.type").contains("predecessor")
    oriented = rows.select(
        "code", "pos", F.col("s.succ_id").alias("succession_id"),
        F.struct(F.when(backwards, F.col("s.target")).otherwise(F.col("code")).alias("predecessor_code"),
                 F.when(backwards, F.col("code")).otherwise(F.col("s.target")).alias("successor_code"),
                 parse_date(first_of_type("s.dates", "legal")["start"]).alias("legal_start")).alias("edge"))
    first = oriented.groupBy("succession_id").agg(F.min_by("edge", F.struct("code", "pos")).alias("edge"))
    return first.select("edge.*", "succession_id", day.alias("publication_date")).select(schemas.SUCCESSIONS.names)
