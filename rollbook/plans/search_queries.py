"""Search, suggestion and sorting queries (groups F and O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions.distance import osa_distance
from rollbook.functions.postcode import district as district_col
from rollbook.functions.postcode import outward as outward_col
from rollbook.functions.postcode import postcode_kind, postcode_value
from rollbook.functions.text import normalise
from rollbook.operators import search as S
from rollbook.operators import suggest as G
from rollbook.plans.registry import OPEN, district, norm, outward, plan, squash

N = "cast(count(*) as bigint)"


@plan("f1_open_filter", f"SELECT ods_code, name, legal_end FROM <orgs> WHERE {OPEN}")
def _(t):
    return S.open_filter(t.orgs).select("ods_code", "name", "legal_end")


@plan("f2_open_partition", f"""
    SELECT count(*) FILTER (WHERE {OPEN}) AS open,
           count(*) FILTER (WHERE status = 'active' AND legal_end <= publication_date) AS legally_closed,
           count(*) FILTER (WHERE status <> 'active') AS inactive FROM <orgs>""")
def _(t):
    return S.open_partition(t.orgs)


@plan("f3_point_in_time", """
    SELECT ods_code, 'operational' AS via FROM <orgs> WHERE operational_start <= date '1996-05-29'
      AND (operational_end IS NULL OR operational_end > date '1996-05-29')
    UNION ALL SELECT ods_code, 'legal' FROM <orgs> WHERE legal_start <= date '1996-05-29'
      AND (legal_end IS NULL OR legal_end > date '1996-05-29')""")
def _(t):
    from rollbook.functions.dates import existed_on
    day = "1996-05-29"
    via = F.array_compact(F.array(F.when(existed_on(day), F.lit("operational")),
                                  F.when(existed_on(day, "legal_start", "legal_end"), F.lit("legal"))))
    return t.orgs.select("ods_code", F.explode(via).alias("via"))


@plan("f4_name_match", f"SELECT ods_code, name FROM <orgs> WHERE contains({squash('name')}, 'SSHOPCAF')")
def _(t):
    return t.orgs.where(S.name_match("'s shop, caf")).select("ods_code", "name")


@plan("f5_name_rank", f"""
    SELECT ods_code, name, contains(name, 'RED B') AS exact_match FROM <orgs> WHERE contains({squash('name')}, 'REDB')
    ORDER BY exact_match DESC, ods_code""")
def _(t):
    rows = t.orgs.where(S.name_match("red b")).select("ods_code", "name", S.name_rank("red b").alias("exact_match"))
    return rows.orderBy(F.col("exact_match").desc(), "ods_code")


@plan("f6_code_in", """
    SELECT ods_code, name FROM <orgs> WHERE upper(ods_code) IN ('C17', 'P4', 'S9', 'NOPE')
    UNION ALL SELECT ods_code, name FROM <orgs> WHERE ods_code IN (SELECT target_code FROM <relationships> WHERE rel_code = 'RE8')""")
def _(t):
    few = t.orgs.where(S.code_in(["c17", "p4", "S9", "nope"]))
    many = S.code_semi(t.orgs, t.relationships.where("rel_code = 'RE8'").select(F.col("target_code").alias("ods_code")))
    return few.union(many).select("ods_code", "name")


@plan("f7_role_any", """
    SELECT ods_code FROM <orgs> WHERE list_has_any(role_codes, ['RO57', 'RO8005']) OR list_contains(role_names, 'VENDOR')""")
def _(t):
    from rollbook.functions.roles import any_role
    return t.orgs.where(any_role("role_codes", "primary_role_code", "role_names", ["ro57", "RO8005"], ["Vendor"])).select("ods_code")


@plan("f8_role_resolve", f"""
    WITH typed AS (SELECT DISTINCT concat(' ', lower(role_name), CASE WHEN length(role_code) = 5 THEN '!' ELSE '' END) AS role_input
                   FROM <roles>
                   UNION SELECT DISTINCT lower(role_code) FROM <roles> UNION SELECT DISTINCT role_name || 'S' FROM <vocab>),
    vn AS (SELECT {norm('upper(role_name)')} AS nk, min(role_code) AS role_code, min(role_name) AS role_name FROM <vocab> GROUP BY 1)
    SELECT role_input, coalesce(v.role_code, vn.role_code) AS resolved, vn.role_name AS resolved_name
    FROM typed LEFT JOIN <vocab> v ON regexp_matches(trim(role_input), '^(RO|ro)[0-9]*$') AND v.role_code = upper(trim(role_input))
    LEFT JOIN vn ON NOT regexp_matches(trim(role_input), '^(RO|ro)[0-9]*$') AND vn.nk = {norm('upper(trim(role_input))')}""")
def _(t):
    names = t.roles.select(F.concat(F.lit(" "), F.lower("role_name"), F.when(F.length("role_code") == 5, "!").otherwise(""))
                           .alias("role_input"))
    typed = names.union(t.roles.select(F.lower("role_code"))).union(t.vocab.select(F.concat("role_name", F.lit("S")))).distinct()
    return S.role_resolve(typed, t.vocab)


@plan("f9_role_alias", """
    SELECT alias, ods_code FROM (SELECT 'gp' AS alias, unnest(['RO76', 'RO227', 'RO315']) AS c UNION ALL
                                 SELECT 'dentist', unnest(['RO110', 'RO65'])) a
    JOIN (SELECT ods_code, 'RO' || unnest(CASE WHEN cast(substr(ods_code, 2) as int) % 2 = 0 THEN ['76', '315'] ELSE ['65'] END) AS c
          FROM <orgs>) o USING (c)""")
def _(t):
    odd = F.array(F.lit("RO65"))
    rows = t.orgs.select("ods_code", F.explode(F.when(F.substring("ods_code", 2, 20).cast("int") % 2 == 0, F.array(
        F.lit("RO76"), F.lit("RO315"))).otherwise(odd)).alias("role_code"))
    return rows.join(S.role_aliases(t.spark), "role_code").select("alias", "ods_code")


@plan("f10_text_normalise", f"""
    SELECT conv_id, turn, {norm('text')} AS normalised FROM <conversations>
    UNION ALL SELECT page_id, -1, {norm('html')} FROM <pages>""")
def _(t):
    a = t.conversations.select("conv_id", "turn", normalise("text").alias("normalised"))
    return a.union(t.pages.select("page_id", F.lit(-1).cast("bigint"), normalise("html")))


_PLACES = ["nation 3", "Nation-7 queens west", "ASIA", "wales", "E5", "b3a", "c4 3xy", "nowhere"]
_PLACE_SQL = "(SELECT unnest([{}]) AS place)".format(", ".join(f"'{p}'" for p in _PLACES))
_KIND_SQL = """CASE WHEN NOT regexp_matches(trim(place), '\\s') AND regexp_matches(tight, '^[A-Z]{1,2}[0-9]([A-Z0-9]|[0-9][A-Z])?$')
         THEN CASE WHEN regexp_matches(tight, '[0-9]$') THEN 'district' ELSE 'outward' END
         WHEN regexp_matches(tight, '^[A-Z]{1,2}[0-9]([A-Z0-9]|[0-9][A-Z])?[0-9][A-Z]{2}$') THEN 'full' END"""
_PARSED = f"""parsed AS (SELECT place, {norm('upper(trim(place))')} AS nk, kind,
      CASE kind WHEN 'full' THEN substr(tight, 1, length(tight) - 3) || ' ' || substr(tight, length(tight) - 2) ELSE
      CASE WHEN kind IS NULL THEN NULL ELSE tight END END AS value
    FROM (SELECT place, tight, {_KIND_SQL} AS kind FROM
      (SELECT place, upper(regexp_replace(trim(place), '\\s', '', 'g')) AS tight FROM %s p) q) r)"""
_HITS = f"""hits AS (SELECT o.ods_code, place, {norm('town')} = nk AS h1, {norm('county')} = nk AS h2,
      coalesce(CASE kind WHEN 'district' THEN {district('postcode')} = value WHEN 'outward' THEN {outward('postcode')} = value
               WHEN 'full' THEN postcode = value END, false) AS h3, {norm('country')} = nk AS h4 FROM <orgs> o, parsed)"""


@plan("f11_place_match", f"""
    WITH {_PARSED % _PLACE_SQL}, {_HITS} SELECT DISTINCT ods_code FROM hits WHERE h1 OR h2 OR h3 OR h4""")
def _(t):
    return t.orgs.where(S.place_match(_PLACES)).select("ods_code")


@plan("f12_postcode_classify", f"""
    SELECT place, {_KIND_SQL} AS kind, CASE WHEN {_KIND_SQL} = 'full' THEN substr(tight, 1, length(tight) - 3) || ' ' ||
           substr(tight, length(tight) - 2) WHEN {_KIND_SQL} IS NOT NULL THEN tight END AS value
    FROM (SELECT place, upper(regexp_replace(trim(place), '\\s', '', 'g')) AS tight FROM
          (SELECT lower(postcode) AS place FROM <orgs> WHERE postcode IS NOT NULL UNION SELECT {outward('postcode')} FROM <orgs>
           UNION SELECT substr(postcode, 1, 4) FROM <orgs> WHERE postcode IS NOT NULL UNION SELECT name FROM <orgs>) u) v""")
def _(t):
    o = t.orgs.where("postcode IS NOT NULL")
    typed = o.select(F.lower("postcode").alias("place")).union(t.orgs.select(outward_col("postcode"))).union(
        o.select(F.substring("postcode", 1, 4))).union(t.orgs.select("name")).distinct()
    return typed.select("place", postcode_kind("place").alias("kind"), postcode_value("place").alias("value"))


@plan("f13_postcode_match", f"""
    SELECT ods_code, {outward('postcode')} AS outward, {district('postcode')} AS district FROM <orgs>
    WHERE {district('postcode')} = 'E5' OR {outward('postcode')} = 'B3A' OR postcode = 'C4 3XY'""")
def _(t):
    from rollbook.functions.postcode import postcode_matches
    hit = F.lit(False)
    for p in ("e5", "b3a", "C43XY"):
        hit = hit | postcode_matches("postcode", postcode_kind(F.lit(p)), postcode_value(F.lit(p)))
    return t.orgs.where(hit).select("ods_code", outward_col("postcode").alias("outward"), district_col("postcode").alias("district"))


@plan("f14_matched_fields", f"""
    WITH {_PARSED % _PLACE_SQL}, {_HITS}
    SELECT ods_code, array_to_string(list_filter([CASE WHEN bool_or(h1) THEN 'town' END, CASE WHEN bool_or(h2) THEN 'county' END,
           CASE WHEN bool_or(h3) THEN 'postcode' END, CASE WHEN bool_or(h4) THEN 'country' END], lambda x: x IS NOT NULL), ', ')
           AS matched_fields FROM hits GROUP BY ods_code""")
def _(t):
    return t.orgs.select("ods_code", S.matched_fields(_PLACES).alias("matched_fields"))


_TYPED = f"(SELECT DISTINCT substr({outward('postcode')}, 1, 2) AS place FROM <orgs> UNION SELECT substr(name, 1, 2) FROM <orgs>)"


@plan("f15_place_min_length", f"""
    SELECT place FROM {_TYPED} p WHERE length(trim(place)) < 3 AND NOT regexp_matches(trim(place), '^[A-Za-z][0-9]$')""")
def _(t):
    typed = t.orgs.select(F.substring(outward_col("postcode"), 1, 2).alias("place")).union(
        t.orgs.select(F.substring("name", 1, 2))).distinct()
    return S.place_min_length(typed)


_COUNTS = f"""counts AS (SELECT place_key, count(*) AS n FROM (SELECT unnest([{norm('town')}, {norm('county')}, {norm('country')},
    {outward('postcode')}]) AS place_key FROM <orgs> WHERE status = 'active') k WHERE place_key <> '' GROUP BY 1)"""


@plan("f16_place_counts", f"WITH {_COUNTS} SELECT place_key, n FROM counts")
def _(t):
    return S.place_counts(t.orgs.where("status = 'active'"))


@plan("f17_place_also", f"""
    WITH {_COUNTS}, w AS (SELECT n_name AS place, {norm('upper(n_name)')} AS nk FROM <nation>),
    near AS (SELECT DISTINCT place, place_key, n FROM w JOIN counts ON starts_with(place_key, nk || ' ')
             WHERE place_key NOT IN (SELECT nk FROM w)),
    r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY n DESC, place_key) AS rank,
                 count(*) OVER (PARTITION BY place) AS total FROM near)
    SELECT place, place_key, n, cast(rank as int) AS rank, greatest(total - 3, 0) AS more FROM r WHERE rank <= 3""")
def _(t):
    places = t.nation.select(F.col("n_name").alias("place"))
    return S.place_also(places, S.place_counts(t.orgs.where("status = 'active'")))


_ASKED = f"(SELECT DISTINCT lower({district('postcode')}) AS place FROM <orgs> UNION SELECT 'Z9' UNION SELECT 'nation 5')"


@plan("f18_district_subs", f"""
    WITH {_PARSED % _ASKED}
    SELECT place, string_agg(DISTINCT o, ',' ORDER BY o) AS sub_districts
    FROM parsed JOIN (SELECT {outward('postcode')} AS o, {district('postcode')} AS d FROM <orgs>) x ON d = value
    WHERE kind = 'district' AND o <> d GROUP BY place""")
def _(t):
    extra = t.region.select(F.explode(F.array(F.lit("Z9"), F.lit("nation 5"))))
    asked = t.orgs.select(F.lower(district_col("postcode")).alias("place")).union(extra).distinct()
    return S.district_subs(t.orgs, asked).withColumn("sub_districts", F.array_join("sub_districts", ","))


_ODD = ("(SELECT n_name AS place FROM <nation> UNION SELECT reverse(n_name) FROM <nation> UNION SELECT r_name || 'N' FROM <region> "
        "UNION SELECT lower(r_name) FROM <region>)")


@plan("f19_unmatched_places", f"""
    WITH {_PARSED % _ODD}, {_HITS} SELECT place FROM parsed WHERE length(trim(place)) >= 3 AND place NOT IN
    (SELECT place FROM hits WHERE h1 OR h2 OR h3 OR h4)""")
def _(t):
    places = t.nation.select(F.col("n_name").alias("place")).union(t.nation.select(F.reverse("n_name"))).union(
        t.region.select(F.concat("r_name", F.lit("N")))).union(t.region.select(F.lower("r_name")))
    return S.unmatched_places(t.orgs, places)


def _score_sql(inputs: str, cands: str) -> str:
    dl = "damerau_levenshtein"
    return f"""ins AS (SELECT DISTINCT a FROM {inputs} i), cands AS (SELECT DISTINCT b FROM {cands} c),
    whole AS (SELECT a, b, CASE WHEN a = b THEN 100 WHEN contains(b, a) OR contains(a, b) THEN 50 WHEN {dl}(a, b) <= 1 THEN 45
                           WHEN {dl}(a, b) = 2 THEN 20 ELSE 0 END AS s FROM ins, cands),
    iw AS (SELECT a, unnest(string_split_regex(a, '\\s+')) AS w FROM ins), cw AS (SELECT b, unnest(string_split_regex(b, '\\s+')) AS v FROM cands),
    words AS (SELECT a, b, sum(CASE WHEN w = v THEN 30 WHEN starts_with(v, w) THEN 15 WHEN {dl}(w, v) <= 1 THEN 25
                                    WHEN {dl}(w, v) = 2 THEN 10 ELSE 0 END) AS s
              FROM iw, cw WHERE w <> '' AND v <> '' GROUP BY a, b),
    scored AS (SELECT a, b, cast(whole.s + coalesce(words.s, 0) as bigint) AS score FROM whole LEFT JOIN words USING (a, b)
               WHERE whole.s + coalesce(words.s, 0) > 0)"""


_INPUTS = """(SELECT DISTINCT lower(role_name) AS a FROM <roles> UNION SELECT DISTINCT lower(substr(role_name, 2)) FROM <roles>
    UNION SELECT DISTINCT lower(n_name) FROM <nation>)"""
_CANDS = "(SELECT DISTINCT lower(role_name) AS b FROM <vocab> UNION SELECT DISTINCT lower(name) FROM <orgs>)"


def _score_frames(t):
    a = t.roles.select(F.lower("role_name").alias("a")).union(t.roles.select(F.lower(F.expr("substr(role_name, 2)")))).union(
        t.nation.select(F.lower("n_name"))).distinct()
    b = t.vocab.select(F.lower("role_name").alias("b")).union(
        t.orgs.select(F.lower("name"))).distinct()
    return a, b


@plan("f20_suggest_score", f"WITH {_score_sql(_INPUTS, _CANDS)} SELECT a, b, score FROM scored")
def _(t):
    return G.score_pairs(*_score_frames(t))


@plan("f21_osa_distance", """
    SELECT a, b, cast(damerau_levenshtein(a, b) as int) AS dist FROM
    (SELECT DISTINCT name AS a, CASE WHEN length(name) % 2 = 0 THEN substr(name, 2, 1) || substr(name, 1, 1) || substr(name, 3)
     ELSE substr(name, 3) END AS b FROM <orgs>) x""")
def _(t):
    swapped = F.expr("substr(name, 2, 1) || substr(name, 1, 1) || substr(name, 3)")
    pairs = t.orgs.select(F.col("name").alias("a"), F.when(F.length("name") % 2 == 0, swapped)
                          .otherwise(F.expr("substr(name, 3)")).alias("b")).distinct()
    return pairs.withColumn("dist", osa_distance("a", "b"))


@plan("f22_suggest_roles", f"""
    WITH typed AS (SELECT DISTINCT substr(role_name, 2) || substr(role_name, 1, 1) AS role_input FROM <vocab>
                   UNION SELECT DISTINCT substr(role_name, 1, 4) FROM <vocab>),
    {_score_sql("(SELECT lower(role_input) AS a FROM typed)", "(SELECT lower(role_name) AS b FROM <vocab>)")},
    r AS (SELECT role_input, role_code, role_name, score, row_number() OVER (PARTITION BY role_input
            ORDER BY score DESC, length(role_name), role_name, role_code) AS rank
          FROM typed JOIN scored ON a = lower(role_input) JOIN <vocab> ON b = lower(role_name))
    SELECT role_input, role_code, role_name, score, cast(rank as int) AS rank FROM r WHERE rank <= 3""")
def _(t):
    typed = t.vocab.select(F.expr("substr(role_name, 2) || substr(role_name, 1, 1)").alias("role_input")).union(
        t.vocab.select(F.substring("role_name", 1, 4))).distinct()
    return G.suggest_roles(typed, t.vocab)


@plan("f23_suggest_places", f"""
    WITH {_COUNTS}, typed AS (SELECT replace(n_name, 'NATION', 'NATOIN') AS place FROM <nation> UNION SELECT substr(r_name, 2) FROM <region>),
    kept AS (SELECT * FROM counts WHERE n >= (SELECT CASE WHEN max(n) >= 50 THEN 5 ELSE 0 END FROM counts)),
    {_score_sql("(SELECT lower(place) AS a FROM typed)", "(SELECT lower(place_key) AS b FROM kept)")},
    r AS (SELECT place, place_key AS candidate, row_number() OVER (PARTITION BY place ORDER BY
            score + CASE WHEN n >= 100 THEN 10 ELSE 0 END DESC, length(place_key), place_key) AS rank
          FROM typed JOIN scored ON a = lower(place) JOIN kept ON b = lower(place_key))
    SELECT place, candidate, cast(rank as int) AS rank FROM r WHERE rank <= 3""")
def _(t):
    typed = t.nation.select(F.replace("n_name", F.lit("NATION"), F.lit("NATOIN")).alias("place")).union(
        t.region.select(F.expr("substr(r_name, 2)"))).distinct()
    return G.suggest_places(typed, S.place_counts(t.orgs.where("status = 'active'")))


@plan("f24_sector_candidates", f"""
    WITH {_COUNTS}, typed AS (SELECT DISTINCT substr({outward('postcode')}, 1, 2) || ' ' || cast(cast(substr(ods_code, 2) as int) % 3 as string)
                              AS place FROM <orgs> WHERE postcode IS NOT NULL)
    SELECT place, candidate, cast(rank as int) AS rank FROM
      (SELECT place, split_part(place, ' ', 1) AS candidate, 1 AS rank FROM typed UNION ALL SELECT place, replace(place, ' ', ''), 2 FROM typed) c
    WHERE candidate IN (SELECT upper(place_key) FROM counts)""")
def _(t):
    sector = (F.substring("ods_code", 2, 20).cast("int") % 3).cast("string")
    typed = t.orgs.where("postcode IS NOT NULL").select(F.concat(F.substring(outward_col("postcode"), 1, 2), F.lit(" "), sector)
                                                       .alias("place")).distinct()
    return G.sector_candidates(typed, S.place_counts(t.orgs.where("status = 'active'"))).withColumn("rank", F.col("rank").cast("int"))


@plan("f25_query_is_code", """
    SELECT DISTINCT query FROM (SELECT ' ' || lower(source_code) AS query FROM <relationships> UNION SELECT target_code || 'Z' FROM <relationships>
      UNION SELECT target_code FROM <relationships>) q WHERE upper(trim(query)) IN (SELECT ods_code FROM <orgs>)""")
def _(t):
    r = t.relationships
    q = r.select(F.concat(F.lit(" "), F.lower("source_code")).alias("query")).union(
        r.select(F.concat("target_code", F.lit("Z")))).union(r.select("target_code")).distinct()
    return S.query_is_code(t.orgs, q).select("query")


@plan("f26_find", f"""
    SELECT ods_code, name, exact_match, CASE WHEN t AND c THEN 'town, country' WHEN t THEN 'town' ELSE 'country' END AS matched_fields
    FROM (SELECT ods_code, name, contains(name, 'RED') AS exact_match, {norm('town')} IN ('NATION 3', 'NATION 3 EAST') AS t,
                 {norm('country')} = 'WALES' AS c FROM <orgs>
          WHERE {OPEN} AND contains({squash('name')}, 'RED') AND list_has_any(role_codes, ['RO177', 'RO8005', 'RO6907', 'RO7605'])) x
    WHERE t OR c ORDER BY exact_match DESC, ods_code""")
def _(t):
    spec = S.FindSpec(query="red", role_codes=["RO177", "RO8005", "RO6907", "RO7605"], places=["nation 3", "nation 3 east", "wales"])
    return S.sort_found(S.find(t.orgs, spec), spec).select("ods_code", "name", "exact_match", "matched_fields")


def _batch(t):
    """One search per part colour and nation: words of names, roles and places from the tables."""
    empty = F.array().cast("array<string>")
    a = t.part.select(F.lower(F.split("p_name", " ")[0]).alias("query")).distinct().select(
        F.concat(F.lit("name:"), "query").alias("query_id"), "query", empty.alias("codes"), empty.alias("role_codes"), empty.alias("places"))
    b = t.nation.select(F.concat(F.lit("place:"), "n_name"), F.lit(None).cast("string"), empty, F.array(F.lit("RO177")), F.array("n_name"))
    c = t.region.select(F.concat(F.lit("mixed:"), "r_name"), F.lit("re"), empty, F.array(F.lit("RO6907"), F.lit("RO7605")),
                        F.array("r_name", F.lit("wales")))
    d = t.region.select(F.concat(F.lit("code:"), "r_name"), F.lit(None).cast("string"),
                        F.array(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")), F.lit("C8")), empty, empty)
    return a.union(b).union(c).union(d)


_FOUND = f"""found AS (SELECT ods_code, name, {squash('name')} AS flat, role_codes, {norm('town')} AS t, {norm('county')} AS c, {norm('country')} AS y
    FROM <orgs> WHERE {OPEN})"""


@plan("f27_find_batch", f"""
    WITH {_FOUND}, w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS query FROM <part>)
    SELECT 'name:' || query AS query_id, ods_code, contains(name, upper(query)) AS exact_match, '' AS matched_fields
    FROM w JOIN found ON contains(flat, {squash('query')})
    UNION ALL SELECT 'place:' || n_name, ods_code, false, 'town' FROM <nation> JOIN found ON t = {norm('n_name')} WHERE list_contains(role_codes, 'RO177')
    UNION ALL SELECT 'mixed:' || r_name, ods_code, contains(name, 'RE'), CASE WHEN c = r_name AND y = 'WALES' THEN 'county, country'
                     WHEN c = r_name THEN 'county' ELSE 'country' END
      FROM <region> JOIN found ON contains(flat, 'RE') AND list_has_any(role_codes, ['RO6907', 'RO7605']) AND (c = {norm('r_name')} OR y = 'WALES')
    UNION ALL SELECT 'code:' || r_name, ods_code, false, '' FROM <region> JOIN found ON ods_code IN ('P' || cast(r_regionkey as string), 'C8')""")
def _(t):
    return S.find_batch(t.orgs, _batch(t))


@plan("o1_sort_by", "SELECT ods_code, name, coalesce(postcode, '') AS postcode FROM <orgs> ORDER BY lower(coalesce(postcode, '')), ods_code")
def _(t):
    spec = S.FindSpec(sort="postcode", all_rows=True)
    return S.sort_found(S.find(t.orgs, spec), spec).select("ods_code", "name", F.coalesce("postcode", F.lit("")).alias("postcode"))


@plan("o2_limit_k", "SELECT ods_code, name FROM <orgs> ORDER BY lower(name), ods_code LIMIT 25")
def _(t):
    return t.orgs.orderBy(*S.sort_keys("name", False)).limit(25).select("ods_code", "name")


@plan("o3_topk_per_group", """
    SELECT county, ods_code, cast(rank as int) AS rank FROM (SELECT county, ods_code, row_number() OVER (PARTITION BY county
      ORDER BY operational_start DESC, ods_code) AS rank FROM <orgs>) x WHERE rank <= 3""")
def _(t):
    rows = t.orgs.select("county", "ods_code", "operational_start")
    return G.topk_per_group(rows, ["county"], [F.col("operational_start").desc(), "ods_code"], 3).select("county", "ods_code", "rank")
