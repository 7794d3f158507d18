import pytest
from pyspark.sql import functions as F

from rollbook.operators import search as S
from rollbook.operators.aggregates import role_holders

ROWS = [
    # code, name, status, roles, primary, town, county, postcode, country, legal_end
    ("A1", "ST. JOHN'S HOSPITAL", "active", ["RO1"], "RO1", "LONDON", "GREATER LONDON", "SW1A 1AA", "ENGLAND", None),
    ("A2", "St Johns Clinic", "active", ["RO2"], "RO2", "LONDONDERRY", None, "BT48 6SB", "NORTHERN IRELAND", None),
    ("A3", "100% CARE", "active", [], "RO1", "NEWCASTLE UPON TYNE", None, "NE1 4LP", "ENGLAND", None),
    ("A4", "OLD HOSPITAL", "inactive", ["RO1"], "RO1", "LONDON", None, "SW1 2AB", "ENGLAND", None),
    ("A5", "ENDING HOSPITAL", "active", ["RO1", "RO2"], "RO1", "LEEDS", "LONDON", None, "ENGLAND", "2026-07-28"),
    ("A6", "LATER HOSPITAL", "active", ["RO1"], "RO1", None, None, "SW1A", "ENGLAND", "2026-07-29"),
    ("A7", "KING’S CROSS", "active", ["RO2"], "RO2", "KING'S LYNN", None, "N1 9AA", None, None),
]


@pytest.fixture(scope="module")
def orgs(spark):
    df = spark.createDataFrame(ROWS, "ods_code string, name string, status string, role_codes array<string>, primary_role_code string, town string, "
                               "county string, postcode string, country string, legal_end string")
    return df.withColumn("legal_end", F.col("legal_end").cast("date")).withColumn("publication_date", F.lit("2026-07-28").cast("date")).withColumn(
        "role_names", F.transform("role_codes", lambda c: F.concat(F.lit("Name "), c)))


def codes(df):
    return [r.ods_code for r in df.collect()]


def found(orgs, **spec):
    s = S.FindSpec(**spec)
    return codes(S.sort_found(S.find(orgs, s), s))


def test_open_is_not_active(orgs):
    assert sorted(codes(S.open_filter(orgs))) == ["A1", "A2", "A3", "A6", "A7"]
    assert S.open_partition(orgs).head() == (5, 1, 1)


def test_names_ignore_punctuation_and_like_wildcards(orgs):
    assert found(orgs, query="st johns") == ["A1", "A2"]
    assert found(orgs, query="ST JOHN") == ["A1", "A2"]
    assert found(orgs, query="100%") == ["A3"]
    assert found(orgs, query="1_9") == []
    assert found(orgs, query="kings cross") == ["A7"]
    assert found(orgs, query="HOSPITAL", all_rows=True) == ["A1", "A4", "A5", "A6"]


def test_rank_puts_names_as_typed_first(orgs):
    more = orgs.union(orgs.where("ods_code = 'A1'").withColumn("ods_code", F.lit("A0")).withColumn("name", F.lit("CROSS-HOSP ITAL")))
    assert found(more, query="hospital") == ["A1", "A6", "A0"]


def test_places_match_whole_values(orgs):
    assert found(orgs, places=["london"]) == ["A1"]
    assert found(orgs, places=["london"], all_rows=True) == ["A1", "A4", "A5"]
    assert found(orgs, places=["sw1"]) == ["A1", "A6"]
    assert found(orgs, places=["SW1A"]) == ["A1", "A6"]
    assert found(orgs, places=["sw1a1aa"]) == ["A1"]
    assert found(orgs, places=["kings lynn"]) == ["A7"]
    assert found(orgs, places=["KING’S-LYNN", "londonderry"]) == ["A2", "A7"]
    s = S.FindSpec(places=["london", "sw1a", "england"])
    assert {r.ods_code: r.matched_fields for r in S.find(orgs, s).collect()}["A1"] == "town, postcode, country"


def test_roles_fall_back_to_the_primary_role(orgs):
    assert found(orgs, role_codes=["ro1"]) == ["A1", "A3", "A6"]
    assert found(orgs, role_names=["name ro2"]) == ["A2", "A7"]
    assert found(orgs, codes=["a7", "A2", "ZZ"]) == ["A2", "A7"]


def test_sorts(orgs):
    assert found(orgs, sort="name") == ["A3", "A7", "A6", "A2", "A1"]
    assert found(orgs, sort="postcode", all_rows=True)[0] == "A5"


def test_adding_values_widens_and_adding_criteria_narrows(t):
    base = set(codes(S.find(t.orgs, S.FindSpec(places=["nation 3"]))))
    wider = set(codes(S.find(t.orgs, S.FindSpec(places=["nation 3", "asia"]))))
    narrower = set(codes(S.find(t.orgs, S.FindSpec(places=["nation 3", "asia"], role_codes=["RO177"]))))
    everything = set(codes(S.find(t.orgs, S.FindSpec(places=["nation 3", "asia"], all_rows=True))))
    assert base <= wider <= everything and narrower <= wider and base and narrower


def test_batch_equals_single_searches(spark, t):
    specs = {"q1": dict(query="red"), "q2": dict(query="s", places=["asia"]), "q3": dict(codes=["p1", "c2", "P3"]), "q4": dict(query="re", role_codes=["ro177"]),
             "q5": dict(query="!!", places=["nation 3"]), "q6": dict(query="widget", places=["e5", "wales"]), "q7": dict(query="nothing here")}
    rows = [(k, s.get("query"), s.get("codes"), s.get("role_codes"), s.get("places")) for k, s in specs.items()]
    queries = spark.createDataFrame(rows, "query_id string, query string, codes array<string>, role_codes array<string>, places array<string>")
    got = {tuple(r) for r in S.find_batch(t.orgs, queries).collect()}
    want = {(k, r.ods_code, r.exact_match, r.matched_fields) for k, s in specs.items() for r in S.find(t.orgs, S.FindSpec(**s)).collect()}
    assert got == want and {k for k, *_ in got} >= {"q1", "q2", "q5", "q6"}


def test_place_hints(spark, orgs):
    counts = S.place_counts(orgs.where("status = 'active'"))
    got = {r.place_key: r.n for r in counts.collect()}
    assert got["LONDON"] == 2 and got["SW1A"] == 2 and got["KINGS LYNN"] == 1 and "SW1" not in got
    asked = spark.createDataFrame([("newcastle",), ("sw1",), ("nowhere",), ("ab",)], "place string")
    also = S.place_also(asked, counts).head()
    assert (also.place, also.place_key, also.n, also.more) == ("newcastle", "NEWCASTLE UPON TYNE", 1, 0)
    assert [r.sub_districts for r in S.district_subs(orgs, asked).collect()] == [["SW1A"]]
    assert sorted(r.place for r in S.unmatched_places(orgs, asked).collect()) == ["ab", "newcastle", "nowhere"]
    assert [r.place for r in S.place_min_length(asked).collect()] == ["ab"]


def test_role_holders_count_open_entities(spark, orgs):
    vocab = spark.createDataFrame([("RO1", "Name RO1"), ("RO2", "Name RO2"), ("RO3", "Unused")], "role_code string, role_name string")
    assert {r.role_code: r.holders for r in role_holders(orgs, vocab).collect()} == {"RO1": 2, "RO2": 2, "RO3": 0}
    assert {r.role_code: r.holders for r in role_holders(orgs, vocab, "ro1", all_rows=True).collect()} == {"RO1": 4}
    typed = spark.createDataFrame([("ro1",), ("RO9",), ("name-ro2",), (" ",), ("gp",)], "role_input string")
    got = {r.role_input: r.resolved for r in S.role_resolve(typed, vocab).collect()}
    assert got == {"ro1": "RO1", "RO9": None, "name-ro2": None, "gp": None} or got["name-ro2"] == "RO2"
