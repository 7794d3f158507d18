"""Closures, walks, labels, checks and documents that are made by slices of roots."""

import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import graph as G
from rollbook.operators import parts
from rollbook.operators import profile as P
from tests.test_graph import closure, depth_first, edge_table, org_table


def rows(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()))


@pytest.fixture
def edges():
    """A long part with cycles in it, a ring, many small parts."""
    rng = random.Random(5)
    long = [(f"S{i}", f"S{i + 1 + rng.randrange(6)}") for i in range(220)] + [(f"S{i}", f"S{i - i % 10}") for i in range(220) if i % 4 == 3]
    ring = [(f"R{i}", f"R{(i + 1) % 70}") for i in range(70)]
    small = [(f"P{i}", f"P{i + 1}") for i in range(0, 300, 3)] + [("X", "X")]
    return long + ring + small


@pytest.fixture
def sliced(monkeypatch):
    """Small slices, packs and stretches of edges, and hardly a walk remembered."""
    for name, value in (("ROOTS", 64), ("PACKED", 20), ("LINKED", 100), ("WALKS", 4000), ("ROWS", 50), ("STEPS", 500)):
        monkeypatch.setattr(parts, name, value)


def test_slices_follow_every_path(spark, edges, sliced):
    table, want = edge_table(spark, edges), closure(edges)
    of = G.closure_sets(G.direct_edges(table))
    assert of.nodes.agg(F.countDistinct("part")).first()[0] > 4
    pairs = [tuple(r) for r in of.pairs().collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a, bs in want.items() for b in bs}
    assert {r.ods_code: r.l for r in of.lists("l").collect()} == {a: sorted(bs) for a, bs in want.items() if bs}
    some = spark.createDataFrame([("S7",), ("S7",), ("S500",), (None,)], "ods_code string")
    assert rows(of.lists("l", some)) == sorted([("'S7'", repr(sorted(want["S7"])))] * 2 + [("'S500'", "[]"), ("None", "[]")])
    chain = {}
    for r in sorted(G.succession_walk(table, org_table(spark, {"S1": "active"}), paths=True).collect(), key=lambda r: r.place):
        assert r.depth == len(r.path) and r.hop_code == r.path[-1]
        chain.setdefault(r.ods_code, []).append(tuple(r.path))
    assert chain == {r: h for r in want if (h := depth_first([e for e in edges if e[0] != e[1]], r))}


def test_no_row_a_pair_is_shuffled(spark, edges):
    table, orgs = edge_table(spark, edges), org_table(spark, {"S1": "active"})
    for df in (G.successor_pairs(table), G.successor_lists(table), G.predecessor_lists(table), G.succession_chain(table, orgs),
               G.successor_labels(table, orgs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.index("MapInArrow") < plan.index("Exchange")


def test_walk_is_along_least_paths(spark):
    edges = [("A", "B"), ("B", "C"), ("C", "A"), ("B", "D"), ("D", "E"), ("E", "D"), ("A", "E"), ("E", "Z")]
    table = edge_table(spark, edges)
    least = G._least_paths(table.select(F.col("predecessor_code").alias("src"), F.col("successor_code").alias("dst")))
    walk = G.succession_walk(table, org_table(spark, {"A": "active"}), paths=True)
    assert rows(walk.select("ods_code", "hop_code", "path")) == rows(least)


def odd_orgs(spark, codes):
    """Some entities missing, some twice, some without a name or status."""
    rng = random.Random(7)
    made = [(c, rng.choice([f"name {c}", "", None, 'q"']), rng.choice(["active", "inactive", "Active", None]), None)
            for c in sorted(codes) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    return spark.createDataFrame(made, "ods_code string, name string, status string, operational_end date")


def test_labels_without_hops(spark, edges, sliced):
    table = edge_table(spark, edges)
    orgs = odd_orgs(spark, {c for e in edges for c in e}).dropDuplicates(["ods_code", "name"]).groupBy("ods_code").agg(
        F.min("name").alias("name"), F.min("status").alias("status"), F.lit(None).cast("date").alias("operational_end"))
    orgs = orgs.unionByName(orgs.where("ods_code LIKE '%7'"))
    assert rows(G.successor_labels(table, orgs)) == rows(G.successor_label(G.succession_walk(table, orgs)))


def test_stored_lists_are_compared_where_true_ones_are_made(spark, sliced):
    edges = [("A", "B"), ("B", "C"), ("C", "B"), ("C", "D")] + [(f"N{i}", f"N{i + 1}") for i in range(90)]
    stored = [("A", ["B", "C", "D"], []), ("B", ["C", "A", "A", None], ["A"]), ("C", None, ["A", "Q"]), ("Q", ["A", "A"], None), (None, ["Z"], []),
              ("D", [], ["A", "B", "C"]), ("N3", ["N5"], ["N0", "N1", "N2"]), ("N3", [], [])]
    orgs = spark.createDataFrame(stored, "ods_code string, successor_codes array<string>, predecessor_codes array<string>")
    table = edge_table(spark, edges)
    want = G.closure_verify_lists(orgs, G.successor_lists(table), G.predecessor_lists(table))
    assert rows(G.closure_verify_stored(orgs, table)) == rows(want)


def test_live_descendants_need_one_root(spark, edges):
    orgs = org_table(spark, {f"S{i}": "active" if i % 3 else "inactive" for i in range(240)})
    table = edge_table(spark, edges)
    want = G.live_descendants(orgs.join(G.predecessor_lists(table), "ods_code"), "S100")
    assert want.count() > 0 and rows(G.live_descendants_of(orgs, table, "S100")) == rows(want)


def relations(spark):
    rng, ends = random.Random(3), [f"S{i}" for i in range(12)] + ["Q", None]
    made = [(rng.choice(ends), rng.choice(ends), "RE4", rng.choice(["IS A", "IS B", None]), rng.choice(["active", "", None, "inactive"]),
             rng.choice([None, "2001-02-03", "1999-01-01"]), f"r{i % 150}") for i in range(200)]
    df = spark.createDataFrame(made, "source_code string, target_code string, rel_code string, rel_name string, rel_status string, operational_start string, rel_id string")
    none = F.lit(None).cast("date")
    return df.withColumns({"operational_start": F.col("operational_start").cast("date"), "legal_start": none, "legal_end": none, "operational_end": none})


def profile_tables(spark, edges):
    orgs = odd_orgs(spark, {c for e in edges for c in e}).withColumns({
        "primary_role_code": F.lit("R1"), "role_codes": F.array(F.lit("R1")), "role_names": F.array(F.lit("one"))})
    return orgs, relations(spark), edge_table(spark, edges)


def test_documents_without_a_row_a_hop(spark, edges, sliced):
    orgs, rels, table = profile_tables(spark, edges)
    preds = G.direct_predecessors(table, orgs)
    for size in (3, 40):
        want = P.profile_json(orgs, P.profile_items(orgs, rels, G.succession_walk(table, orgs), preds), size)
        got = P.profile_documents(orgs, rels, preds, *G.succession_runs(table, orgs, size), size)
        assert rows(got) == rows(want)


def test_positions_without_items(spark, edges):
    orgs, rels, _ = profile_tables(spark, edges)
    placed = P.profile_positions(P.relationship_items(orgs, rels)).select("ods_code", F.get_json_object("item", "$.code").alias("code"),
                                                                         F.col("sort_key")[5].alias("rel_id"), "position")
    got = P.relationship_positions(orgs, rels)
    assert "json" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got) == rows(placed)
