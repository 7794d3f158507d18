"""Search: open entities by name, code, role and place, with ranking and hints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.dates import is_open
from rollbook.functions.postcode import district, outward, postcode_kind, postcode_matches, postcode_value
from rollbook.functions.roles import ROLE_ALIASES, any_role
from rollbook.functions.text import normalise, place_key, squash
from rollbook.runtime import written


@dataclass
class FindSpec:
    """One search. Empty criteria do not restrict."""

    query: str | None = None
    codes: list[str] = field(default_factory=list)
    role_codes: list[str] = field(default_factory=list)
    role_names: list[str] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)
    places: list[str] = field(default_factory=list)
    all_rows: bool = False
    sort: str | None = None


# --- single predicates --------------------------------------------------------------------


def open_filter(orgs: DataFrame, all_rows: bool = False) -> DataFrame:
    """Open as of the publication date; ``all_rows`` drops the filter."""
    return orgs if all_rows else orgs.where(is_open())


def open_partition(rows: DataFrame) -> DataFrame:
    """Open, legally closed and inactive counts of a result."""
    active = F.lower("status") == "active"
    past = F.coalesce(F.col("legal_end") <= F.col("publication_date"), F.lit(False))
    return rows.agg(F.count_if(active & ~past).alias("open"), F.count_if(active & past).alias("legally_closed"),
                    F.count_if(~active).alias("inactive"))


def name_match(query, name="name") -> Column:
    """Squashed containment: spaces, punctuation and case are ignored."""
    q = F.lit(query) if isinstance(query, str) else query
    return squash(name).contains(squash(q))


def name_rank(query, name="name") -> Column:
    """True where the stored name contains the upper-cased query as typed."""
    q = F.lit(query) if isinstance(query, str) else query
    return (F.col(name) if isinstance(name, str) else name).contains(F.upper(q))


def code_in(codes: list[str], code="ods_code") -> Column:
    return F.upper(code).isin([c.upper() for c in codes])


def code_semi(orgs: DataFrame, codes: DataFrame, code: str = "ods_code") -> DataFrame:
    """Rows whose code is in a long list, ignoring case."""
    want = codes.select(F.upper(code).alias("_code")).distinct()
    return orgs.join(want, F.upper(orgs[code]) == want["_code"], "left_semi")


def _place_columns() -> dict[str, Column]:
    return {"town": normalise(F.coalesce("town", F.lit(""))), "county": normalise(F.coalesce("county", F.lit(""))),
            "country": normalise(F.coalesce("country", F.lit("")))}


def place_hits(places: list[str]) -> dict[str, Column]:
    """Per place field, in display order: whether any of the typed places matches it."""
    norm = _place_columns()
    keys = [place_key(F.lit(p)) for p in places]
    hit = {f: (c != "") & c.isin(keys) for f, c in norm.items()}
    stored = F.coalesce("postcode", F.lit(""))
    post = F.lit(False)
    for p in places:
        post = post | postcode_matches(stored, postcode_kind(F.lit(p)), postcode_value(F.lit(p)))
    return {"town": hit["town"], "county": hit["county"], "postcode": post, "country": hit["country"]}


def place_match(places: list[str]) -> Column:
    out = F.lit(False)
    for c in place_hits(places).values():
        out = out | c
    return out


def matched_fields(places: list[str]) -> Column:
    """Which of town, county, postcode, country matched, in that order."""
    flags = [F.when(c, F.lit(name)) for name, c in place_hits(places).items()]
    return F.array_join(F.array_compact(F.array(*flags)), ", ")


# --- roles --------------------------------------------------------------------------------


def role_resolve(inputs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Typed roles to codes: a known code, or the code of the name it equals once normalised.

    ``resolved`` is NULL for input that is neither; see ``suggest.suggest_roles``.
    """
    typed = inputs.withColumn("typed", F.trim("role_input")).where("typed <> ''")
    is_code = F.col("typed").rlike("^(RO|ro)[0-9]*$")
    keyed = typed.withColumn("code_key", F.when(is_code, F.upper("typed"))) \
        .withColumn("name_key", F.when(~is_code, place_key("typed")))
    by_code = vocab.select(F.col("role_code").alias("code_key"), F.lit(True).alias("known"))
    by_name = vocab.groupBy(place_key("role_name").alias("name_key")).agg(
        F.min(F.struct("role_code", "role_name")).alias("v"))
    return (keyed.join(by_code, "code_key", "left").join(by_name, "name_key", "left")
            .select("role_input", F.coalesce(F.when(F.col("known"), F.col("code_key")), F.col("v.role_code"))
                    .alias("resolved"), F.col("v.role_name").alias("resolved_name")))


def role_aliases(spark) -> DataFrame:
    """Alias -> role codes as a relation."""
    return spark.createDataFrame([(a, c) for a, codes in ROLE_ALIASES.items() for c in codes],
                                 "alias string, role_code string")


# --- one search ---------------------------------------------------------------------------


def find(orgs: DataFrame, spec: FindSpec) -> DataFrame:
    """All rows one search returns, with ``exact_match`` and ``matched_fields``, unsorted."""
    codes = spec.role_codes + [c for a in spec.aliases for c in ROLE_ALIASES[a]]
    out = orgs if spec.all_rows else orgs.where(F.col("status") == "active")
    if spec.codes:
        out = out.where(code_in(spec.codes))
    if spec.query is not None:
        out = out.where(name_match(spec.query))
    if codes or spec.role_names:
        out = out.where(any_role("role_codes", "primary_role_code", "role_names", codes, spec.role_names))
    if spec.places:
        out = out.where(place_match(spec.places))
    out = open_filter(out, spec.all_rows)
    return out.withColumn("exact_match", name_rank(spec.query) if spec.query is not None else F.lit(False)) \
        .withColumn("matched_fields", matched_fields(spec.places) if spec.places else F.lit(""))


def sort_keys(sort: str | None, ranked: bool, code: str = "ods_code") -> list[Column]:
    """Sort order of a result: by name or postcode without case, NULL as '', then code."""
    if sort in ("name", "postcode"):
        return [F.lower(F.coalesce(sort, F.lit(""))), F.col(code)]
    if sort is None and ranked:
        return [F.col("exact_match").desc(), F.col(code)]
    return [F.col(code)]


def sort_found(found: DataFrame, spec: FindSpec) -> DataFrame:
    return found.orderBy(*sort_keys(spec.sort, spec.query is not None))


def query_is_code(orgs: DataFrame, queries: DataFrame, text: str = "query") -> DataFrame:
    """Queries that are also an existing code."""
    keyed = queries.withColumn("_code", F.upper(F.trim(text)))
    return keyed.join(orgs.select(F.col("ods_code").alias("_code")), "_code", "left_semi")


# --- tables of places ---------------------------------------------------------------------


def parse_places(places: DataFrame, text: str = "place") -> DataFrame:
    """Typed places with their normalised key, postcode kind and value, and ``too_short``."""
    trimmed = F.trim(text)
    short = (F.length(trimmed) < 3) & ~trimmed.rlike("^[A-Za-z][0-9]$")
    return places.withColumns({"norm": place_key(text), "kind": postcode_kind(text), "value": postcode_value(text),
                               "too_short": short})


def place_min_length(places: DataFrame, text: str = "place") -> DataFrame:
    """Places refused as too short."""
    return parse_places(places, text).where("too_short").select(text)


def _row_keys() -> Column:
    """Keys a row can be found under: normalised place texts, and its postcode three ways."""
    key = lambda f, kind, c: F.struct(F.lit(f).alias("field"), F.lit(kind).alias("key_kind"), c.alias("key"))
    stored = F.coalesce("postcode", F.lit(""))
    return F.array(*[key(f, "text", c) for f, c in _place_columns().items()],
                   key("postcode", "district", district(stored)), key("postcode", "outward", outward(stored)),
                   key("postcode", "full", stored))


def match_places(rows: DataFrame, places: DataFrame, place: str = "place") -> DataFrame:
    """``(ods_code, place, matched_fields)`` for a table of places, by equi-join on place keys."""
    parsed = parse_places(places, place).where("NOT too_short")
    want = parsed.select(place, F.lit("text").alias("key_kind"), F.col("norm").alias("key")).unionByName(
        parsed.where("kind IS NOT NULL").select(place, F.col("kind").alias("key_kind"), F.col("value").alias("key")))
    keyed = rows.select("ods_code", F.explode(_row_keys()).alias("k")).select("ods_code", "k.*").where("key <> ''")
    hits = keyed.join(want.distinct(), ["key_kind", "key"])
    flag = lambda f: F.when(F.bool_or(F.col("field") == f), F.lit(f))
    order = ["town", "county", "postcode", "country"]
    return hits.groupBy("ods_code", place).agg(
        F.array_join(F.array_compact(F.array(*[flag(f) for f in order])), ", ").alias("matched_fields"))


def place_counts(rows: DataFrame) -> DataFrame:
    """Occurrences of every normalised town, county and country, and of every outward code."""
    norm = _place_columns()
    keys = F.array(norm["town"], norm["county"], norm["country"], outward(F.coalesce("postcode", F.lit(""))))
    return (rows.select(F.explode(keys).alias("place_key")).where("place_key <> ''")
            .groupBy("place_key").agg(F.count("*").alias("n")))


def place_also(places: DataFrame, counts: DataFrame, place: str = "place", search: str = "place", k: int = 3) -> DataFrame:
    """Longer names that begin with a searched place: per search the top ``k`` by count, and how many more.

    A search of several places shares one list; ``search`` names its column. A name is keyed
    by each of its leading word groups, so the prefix test is an equi-join.
    """
    wanted = places.select(F.col(search).alias("_search"), place_key(place).alias("norm")).distinct()
    words = F.split("place_key", " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    longer = counts.where(F.col("place_key").contains(" ")).select("place_key", "n", F.explode(heads).alias("norm"))
    near = longer.join(wanted, "norm").join(wanted.select("_search", F.col("norm").alias("place_key")), ["_search", "place_key"],
                                            "left_anti").select("_search", "place_key", "n").distinct()
    w = Window.partitionBy("_search").orderBy(F.col("n").desc(), "place_key")
    top = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    total = near.groupBy("_search").agg(F.count("*").alias("total"))
    return top.join(total, "_search").select(F.col("_search").alias(search), "place_key", "n", "rank",
                                             F.greatest(F.col("total") - k, F.lit(0)).alias("more"))


def district_subs(rows: DataFrame, places: DataFrame, place: str = "place") -> DataFrame:
    """Sub-districts a searched district included (at most one per letter)."""
    parsed = parse_places(places, place).where("kind = 'district'").select(place, F.col("value").alias("district"))
    held = rows.select(outward(F.coalesce("postcode", F.lit(""))).alias("out"),
                       district(F.coalesce("postcode", F.lit(""))).alias("district")).where("out <> district").distinct()
    return held.join(parsed, "district").groupBy(place).agg(F.array_sort(F.collect_set("out")).alias("sub_districts"))


def unmatched_places(rows: DataFrame, places: DataFrame, place: str = "place") -> DataFrame:
    """Places no row matches."""
    return places.select(place).distinct().join(match_places(rows, places, place), place, "left_anti")


# --- tables of searches -------------------------------------------------------------------


def _grams(text: Column, lengths: list[int]) -> Column:
    """Distinct substrings of the given lengths; length 0 is the empty string."""
    def pieces(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))) \
            .otherwise(F.array().cast("array<string>"))

    parts = [pieces(n) for n in lengths]
    return F.array_distinct(F.concat(*parts))


def name_matches(rows: DataFrame, queries: DataFrame, text: str = "query", qid: str = "query_id") -> DataFrame:
    """``(query_id, ods_code, exact_match)`` of a table of name searches, without a nested loop.

    Each query is looked up by its rarest three-character piece and the hits are
    verified by containment, so work follows the matching rows. What is looked for is
    written first: Spark then knows its size, and pieces of names don't have to be shuffled to it.
    """
    q = queries.where(F.col(text).isNotNull()).select(qid, F.col(text).alias("raw"), squash(text).alias("squashed"))
    q = q.withColumn("len", F.least(F.length("squashed"), F.lit(3)))
    lengths = sorted(r[0] for r in q.select("len").distinct().collect())
    names = rows.select("ods_code", "name", squash("name").alias("flat"))
    flat = names.select("ods_code", "name", "flat", F.explode(_grams(F.col("flat"), lengths or [3])).alias("gram"))
    wanted = written(q.select(qid, F.explode(F.when(F.col("len") == 3, _grams(F.col("squashed"), [3]))
                                             .otherwise(F.array("squashed"))).alias("gram")))
    freq = flat.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    key = wanted.join(freq, "gram", "left").groupBy(qid).agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    hits = flat.join(written(q.join(key, qid)), "gram").where(F.col("flat").contains(F.col("squashed")))
    return hits.select(qid, "ods_code", F.col("name").contains(F.upper("raw")).alias("exact_match"))


#: Pieces of the rows that searches without criteria meet one by one.
_PIECES = 64


def find_batch(orgs: DataFrame, queries: DataFrame, all_rows: bool = False) -> DataFrame:
    """A table of searches against all rows: ``query_id, ods_code, exact_match, matched_fields``.

    ``queries``: query_id, query (text or NULL), codes, role_codes, places (lists or NULL). Each
    criterion becomes an equi-join; an entity is returned when every criterion its query
    states has matched, every entity when it states none. Entities are dealt out by
    code, so that no task holds the hits of a whole file.
    """
    rows = open_filter(orgs, all_rows).repartition("ods_code")
    empty = F.array().cast("array<string>")
    q = written(queries.select("query_id", "query", *[F.coalesce(c, empty).alias(c) for c in ("codes", "role_codes", "places")]))
    need = q.select("query_id", (F.col("query").isNotNull().cast("int")
                                 + sum([(F.size(c) > 0).cast("int") for c in ("codes", "role_codes", "places")]))
                    .alias("need"))
    by_name = name_matches(rows, q).withColumn("criterion", F.lit("name"))
    want_code = q.select("query_id", F.explode("codes").alias("c")).select("query_id", F.upper("c").alias("c")).distinct()
    by_code = rows.select("ods_code", F.upper("ods_code").alias("c")).join(want_code, "c") \
        .select("query_id", "ods_code", F.lit("code").alias("criterion"))
    held = F.when(F.size("role_codes") > 0, F.col("role_codes")).otherwise(F.array("primary_role_code"))
    want_role = q.select("query_id", F.explode("role_codes").alias("c")).select("query_id", F.upper("c").alias("c")).distinct()
    by_role = rows.select("ods_code", F.explode(held).alias("c")).select("ods_code", F.upper("c").alias("c")) \
        .join(want_role, "c").select("query_id", "ods_code", F.lit("role").alias("criterion")).distinct()
    asked = q.select("query_id", F.explode("places").alias("place"))
    fields = match_places(rows, asked.select("place").distinct()).join(asked, "place")
    by_place = fields.select("query_id", "ods_code", F.lit("place").alias("criterion"), "matched_fields")
    every = by_name.unionByName(by_code, allowMissingColumns=True).unionByName(by_role, allowMissingColumns=True) \
        .unionByName(by_place, allowMissingColumns=True)
    order = ["town", "county", "postcode", "country"]
    flag = lambda f: F.when(F.bool_or(F.array_contains(F.split("matched_fields", ", "), f)), F.lit(f))
    met = every.groupBy("query_id", "ods_code").agg(
        sum([F.bool_or(F.col("criterion") == c).cast("int") for c in ("name", "code", "role", "place")]).alias("met"), F.coalesce(F.bool_or("exact_match"), F.lit(False)).alias("exact_match"),
        F.array_join(F.array_compact(F.array(*[flag(f) for f in order])), ", ").alias("matched_fields"))
    stated = met.join(need, "query_id").where("met = need").select("query_id", "ods_code", "exact_match", "matched_fields")
    # a search that states nothing returns every row; it meets them in pieces, so that neither side is one key
    free = need.where("need = 0").select("query_id", F.explode(F.sequence(F.lit(0), F.lit(_PIECES - 1))).alias("piece"))
    every_row = rows.select("ods_code", F.pmod(F.xxhash64("ods_code"), F.lit(_PIECES)).cast("int").alias("piece")).join(free, "piece") \
        .select("query_id", "ods_code", F.lit(False).alias("exact_match"), F.lit("").alias("matched_fields"))
    return stated.unionByName(every_row)
