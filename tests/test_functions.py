import datetime
import random

from pyspark.sql import functions as F

from rollbook.functions.dates import parse_date
from rollbook.functions.distance import delete_keys, osa, osa_distance
from rollbook.functions.postcode import district, postcode_kind, postcode_matches, postcode_value
from rollbook.functions.roles import role_display
from rollbook.functions.text import archive_name_parts, country_title, name_at_code, normalise, numeric_part, semver, squash, thousands
from rollbook.operators import suggest


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [tuple(r) for r in df.select("i", *exprs).orderBy("i").drop("i").collect()]


def test_postcode_classify(spark):
    cases = {"LA1": ("district", "LA1"), "LA10": ("district", "LA10"), "N1": ("district", "N1"), "SW1A": ("outward", "SW1A"),
             "E1W": ("outward", "E1W"), "ec1a": ("outward", "EC1A"), "LA105DL": ("full", "LA10 5DL"), " la10 5dl ": ("full", "LA10 5DL"),
             "LA1 5": (None, None), "N1 1": (None, None), "ab": (None, None), "durham": (None, None), "": (None, None),
             "W1A 1AA": ("full", "W1A 1AA"), "1AB": (None, None), "ABC1": (None, None), "SW1AA": (None, None)}
    got = column(spark, cases, postcode_kind("v"), postcode_value("v"))
    assert dict(zip(cases, got)) == cases


def test_district_and_match(spark):
    cases = {"W1A": "W1", "EC1A 1BB": "EC1", "E1W": "E1", "LA10 5DL": "LA10", "N11": "N11", "A": "A", "": ""}
    assert [r[0] for r in column(spark, cases, district("v"))] == list(cases.values())
    hit = lambda kind, value: postcode_matches("v", F.lit(kind), F.lit(value))
    rows = column(spark, ["W1A 1AA", "W1 1AA", "W11 1AA", None], hit("district", "W1"), hit("outward", "W1A"), hit("full", "W1 1AA"))
    assert rows == [(True, True, False), (True, False, True), (False, False, False), (False, False, False)]


def test_names_are_squashed_and_normalised(spark):
    values = ["St. John's  (A&E)", "King’s–Cross", "  ", "BURY-ST-EDMUNDS", "Café Noir"]
    assert column(spark, values, squash("v"), normalise("v")) == [
        ("STJOHNSAE", "St Johns A E"), ("KINGSCROSS", "Kings Cross"), ("", ""), ("BURYSTEDMUNDS", "BURY ST EDMUNDS"), ("CAFNOIR", "Café Noir")]


def test_dates_parse_like_a_calendar(spark):
    days = [datetime.date(1, 1, 1) + datetime.timedelta(days=37 * i) for i in range(0, 19000)]
    df = spark.createDataFrame([(d.isoformat(), d) for d in days], "v string, d date")
    assert df.where(~parse_date("v").eqNullSafe(F.col("d"))).count() == 0
    bad = ["2026-02-30", "2026", "2026-13-01", "2026-01-01T00", "20260101", "", "x-1-1", "2026-1-", None, "2025-02-29"]
    assert all(r[0] is None for r in column(spark, bad, parse_date("v")))
    assert column(spark, ["2026-8-3", "2024-2-29"], parse_date("v")) == [(datetime.date(2026, 8, 3),), (datetime.date(2024, 2, 29),)]


def test_small_text_helpers(spark):
    assert column(spark, ["england", "NORTHERN IRELAND", "France", None], country_title("v")) == [("England",), ("Northern Ireland",), ("France",), ("—",)]
    assert column(spark, ["RO76", "RO177", "X", "RO99999999999"], numeric_part("v")) == [(76,), (177,), (4294967295,), (4294967295,)]
    assert column(spark, ["1.2.10", "1.2", "a.b.c", "1.2.3.4"], semver("v")) == [([1, 2, 10],), (None,), (None,), (None,)]
    assert column(spark, ["1234567"], thousands(F.col("v").cast("int"))) == [("1,234,567",)]
    name = "hscorgrefdataxml_data_8.0.0_20260925000001.zip"
    rows = column(spark, [name, name.upper().replace(".ZIP", ".zip"), "x.zip", "hscorgrefdataxml_data_8_2026.zip"], archive_name_parts("v"))
    assert rows[0][0].version == "8.0.0" and rows[0][0].release_date == datetime.date(2026, 9, 25) and rows[1][0] is not None
    assert rows[2] == rows[3] == (None,)


def test_role_display(spark):
    df = spark.createDataFrame([(0, ["RO177", "RO76"], ["Cost", "Practice"]), (1, ["RO177", "RO57"], ["Cost", "Flag"]), (2, ["RO177"], ["Cost"]),
                                (3, [], []), (4, ["RO1", "RO2"], ["A", "B"])], "i int, c array<string>, n array<string>")
    assert [r[0] for r in df.orderBy("i").select(role_display("c", "n")).collect()] == ["Practice +1", "Cost +1", "Cost", "", "A, B"]
    assert df.where("i = 0").select(role_display("c", "n", verbose=True)).head()[0] == "Cost, Practice"
    assert df.where("i = 0").select(name_at_code("n", "c", F.lit("RO76")), name_at_code("n", "c", F.lit("RO9"))).head() == ("Practice", None)


def test_osa_is_restricted(spark):
    assert osa("ca", "abc") == 3 and osa("newcastel", "newcastle") == 1 and osa("", "abc") == 3 and osa("abc", "abc") == 0
    pairs = spark.createDataFrame([("ca", "abc"), ("ab", "ba"), (None, "x")], "a string, b string")
    assert [r[0] for r in pairs.select(osa_distance("a", "b")).collect()] == [3, 1, None]


def brute_score(a, b):
    score = 100 if a == b else 50 if a in b or b in a else {0: 45, 1: 45, 2: 20}.get(osa(a, b), 0)
    for w in a.split():
        for v in b.split():
            score += 30 if w == v else 15 if v.startswith(w) else {0: 25, 1: 25, 2: 10}.get(osa(w, v), 0)
    return score


def test_scores_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    left = {" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)} | {"new castle", "newcastel", "general practice"}
    right = {" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(120)} | {"newcastle", "gp practice", "castle"}
    a = spark.createDataFrame([(x,) for x in left], "a string")
    b = spark.createDataFrame([(x,) for x in right], "b string")
    want = {(x, y, s) for x in left for y in right if (s := brute_score(x, y)) > 0}
    assert {tuple(r) for r in suggest.score_pairs(a, b).collect()} == want


def test_close_strings_share_a_deletion_key(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    pairs = [(word(rng.randint(0, 6)), word(rng.randint(0, 6))) for _ in range(800)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", F.arrays_overlap(delete_keys("a"), delete_keys("b"))).collect()
    assert all(shared for a, b, shared in rows if osa(a, b) <= 2)


def test_place_suggestions(spark):
    counts = spark.createDataFrame([("NEWCASTLE", 120), ("NEWCASTLE UPON TYNE", 300), ("NEWCASTL", 2), ("N1", 9), ("N11", 8), ("LEEDS", 40)],
                                   "place_key string, n bigint")
    asked = spark.createDataFrame([("newcastel",), ("N1 1",), ("N1 9",), ("zzzzzz",)], "place string")
    rows = {}
    for r in suggest.suggest_places(asked, counts).orderBy("place", "rank").collect():
        rows.setdefault(r.place, []).append(r.candidate)
    assert rows["N1 1"] == ["N1", "N11"] and rows["N1 9"] == ["N1"] and "zzzzzz" not in rows
    assert rows["newcastel"][0] == "NEWCASTLE" and "NEWCASTL" not in rows["newcastel"]


def test_distance_in_the_jvm_equals_the_definition(spark):
    draw, rows = random.Random(6), []
    for alphabet, longest, many in (("ab", 8, 400), ("abcdé日 '", 24, 400), ("abc", 62, 60), ("ab", 70, 30), ("abcdefgh", 140, 12)):
        for _ in range(many):
            a = [draw.choice(alphabet) for _ in range(draw.randint(0, longest))]
            b = list(a) if draw.random() < 0.6 else [draw.choice(alphabet) for _ in range(draw.randint(0, longest))]
            for _ in range(draw.randint(0, 5)):
                at = draw.randint(0, len(b))
                if draw.random() < 0.5 and at + 1 < len(b):
                    b[at], b[at + 1] = b[at + 1], b[at]
                elif draw.random() < 0.5:
                    b.insert(at, draw.choice(alphabet))
                elif at < len(b):
                    del b[at]
            rows.append(("".join(a), "".join(b)))
    rows += [("", ""), ("", "abc"), ("x" * 62, "y" * 62), ("x" * 63, "y" * 63), ("ca", "abc"), ("👍a", "a👍"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("d", osa_distance("a", "b"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    wrong = [(r.a, r.b, r.d) for r in df.collect() if r.d != (None if r.a is None or r.b is None else osa(r.a, r.b))]
    assert not wrong, wrong[:3]
