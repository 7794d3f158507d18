import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from rollbook.operators import graph as G


def edge_table(spark, edges):
    rows = [(a, b, f"2000-01-{i % 28 + 1:02d}", f"id{i:04d}") for i, (a, b) in enumerate(edges)]
    return spark.createDataFrame(rows, "predecessor_code string, successor_code string, legal_start string, succession_id string").withColumn(
        "legal_start", F.col("legal_start").cast("date"))


def org_table(spark, status):
    return spark.createDataFrame([(c, f"name {c}", s, None) for c, s in status.items()],
                                 "ods_code string, name string, status string, operational_end date")


def closure(edges):
    out, step = {}, {}
    for a, b in edges:
        step.setdefault(a, set()).add(b)
    for a in step:
        seen, todo = {a}, deque([a])
        while todo:
            for b in step.get(todo.popleft(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[a] = seen - {a}
    return out


def depth_first(edges, root):
    step = {}
    for a, b in sorted(set(edges)):
        step.setdefault(a, []).append(b)
    seen, hops = {root}, []

    def walk(node, path):
        for b in step.get(node, []):
            if b not in seen:
                seen.add(b)
                hops.append((path + (b,)))
                walk(b, path + (b,))
    walk(root, ())
    return hops


@pytest.mark.parametrize("seed,nodes,n", [(1, 12, 20), (2, 9, 30), (3, 25, 30), (4, 7, 25)])
def test_traversals_equal_brute_force_with_cycles(spark, seed, nodes, n):
    rng = random.Random(seed)
    names = [f"N{i:02d}" for i in range(nodes)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(n)]
    table = edge_table(spark, edges)
    pairs = {(r.ods_code, r.successor_code) for r in G.successor_pairs(table).collect()}
    assert pairs == {(a, b) for a, bs in closure(edges).items() for b in bs}

    status = {c: "active" if rng.random() < 0.4 else "inactive" for c in names[:-1]}
    orgs = org_table(spark, status)
    chain = {}
    for r in G.succession_chain(table, orgs).collect():
        chain.setdefault(r.ods_code, []).append(tuple(r.path))
    assert {k: sorted(v) for k, v in chain.items()} == {r: h for r in names if (h := depth_first(edges, r))}

    live = {r.ods_code: (r.live_codes, r.hops) for r in G.live_successors(G.live_successor_pairs(table, orgs)).collect()}
    for root in (c for c, s in status.items() if s == "inactive"):
        seen, todo, got, hops = {root}, deque(), [], 0
        first = {b for a, b in edges if a == root}
        todo.extend(first)
        seen |= first
        while todo:
            x = todo.popleft()
            if status.get(x) == "active":
                got.append(x)
                continue
            hops += 1
            for b in {b for a, b in edges if a == x} - seen:
                seen.add(b)
                todo.append(b)
        assert live.get(root, ([], 0)) == (sorted(got), hops)


def test_labels(spark):
    table = edge_table(spark, [("A", "B"), ("B", "C"), ("B", "D"), ("E", "F"), ("G", "Z")])
    orgs = org_table(spark, {"A": "inactive", "B": "inactive", "C": "active", "D": "active", "E": "inactive", "F": "inactive"})
    labels = {r.ods_code: r.successor_label for r in G.successor_label(G.succession_chain(table, orgs)).collect()}
    assert labels == {"A": "name C +1", "B": "name C +1", "E": "name F", "G": "Z"}


def test_empty_graph(spark):
    table = edge_table(spark, [("A", "A")])
    assert G.successor_pairs(table).count() == 0 and G.self_loops(table).count() == 1
    assert G.succession_chain(table, org_table(spark, {"A": "active"})).count() == 0


def test_closure_rounds_grow_with_the_digits_of_the_longest_path(spark, monkeypatch):
    rounds = []
    real = G.checkpoint
    monkeypatch.setattr(G, "checkpoint", lambda df: rounds.append(1) or real(df))
    ring = [(f"R{i:03d}", f"R{(i + 1) % 300:03d}") for i in range(300)]
    hub = [(f"A{i}", "HUB") for i in range(40)] + [("HUB", f"B{i}") for i in range(40)] + [("B7", "A3"), ("B7", "R005")]
    edges = ring + hub
    pairs = G.successor_pairs(edge_table(spark, edges))
    got = pairs.collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(a, b) for a, bs in closure(edges).items() for b in bs}
    assert len(rounds) <= 9 + 2  # the longest shortest path has 302 edges, nine binary digits


def test_closure_of_a_dense_cycle(spark):
    names = [f"D{i:02d}" for i in range(60)]
    edges = [(a, b) for a in names for b in names]
    assert G.successor_pairs(edge_table(spark, edges)).count() == 60 * 59


def test_reach_keeps_a_seeded_root_and_stops_where_edges_stop(spark):
    seeds = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "A"), ("Q", "Z")], "root string, node string")
    edges = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "A"), ("B", "C"), (None, "C"), ("C", None)], "src string, dst string")
    got = sorted(tuple(r) for r in G.reach(seeds, edges).collect())
    assert got == [("A", "A"), ("A", "B"), ("A", "C"), ("B", "A"), ("B", "C"), ("Q", "Z")]


def test_closure_is_kept_as_sets(spark):
    """Lists of both directions without a row a pair; no more than a bitmap a node and bucket is written."""
    edges = [(f"N{i:04d}", f"N{(i + 1) % 300:04d}") for i in range(300)] + [("A", "B"), ("B", "A"), ("B", "N0007"), ("C", "C"), (None, "A")]
    table = edge_table(spark, [e for e in edges if e[0]])
    want = closure([e for e in edges if e[0]])
    ahead = {r.ods_code: r.successor_codes for r in G.successor_lists(table).collect()}
    back = {r.ods_code: r.predecessor_codes for r in G.predecessor_lists(table).collect()}
    assert ahead == {a: sorted(bs) for a, bs in want.items() if bs}
    assert back == {b: sorted(a for a, bs in want.items() if b in bs) for b in set().union(*want.values())}
    sets = G.closure_sets(G.direct_edges(table)).sets
    assert sets.count() == len([a for a in want if want[a]]) and sets.select(F.max(F.length("near"))).head()[0] == G.BITS // 8


def test_paths_are_searched_inside_cycles_only(spark, monkeypatch):
    """A long register with small cycles: what lies between cycles is followed as rows of numbers, not as paths."""
    searched = []
    real = G._least_paths
    monkeypatch.setattr(G, "_least_paths", lambda edges: searched.append(edges.count()) or real(edges))
    edges = [(f"S{i}", f"S{i + 3 + i * 7 % 5}") for i in range(200)] + [(f"S{i}", f"S{i - i % 10}") for i in range(200) if i % 4 == 3]
    table = edge_table(spark, edges)
    chain = {}
    for r in sorted(G.succession_walk(table, org_table(spark, {"S1": "active"}), paths=True).collect(), key=lambda r: r.place):
        assert r.depth == len(r.path) and r.hop_code == r.path[-1]
        chain.setdefault(r.ods_code, []).append(tuple(r.path))
    assert chain == {r: h for r in {a for a, _ in edges} if (h := depth_first([e for e in edges if e[0] != e[1]], r))}
    assert sum(searched) < len(edges)


def test_labels_from_a_walk_without_paths(spark):
    table = edge_table(spark, [("A", "B"), ("B", "A"), ("B", "C"), ("C", "D"), ("A", "E"), ("E", "Q")])
    orgs = org_table(spark, {"A": "inactive", "B": "inactive", "C": "inactive", "D": "active", "E": "active"})
    walk = G.succession_walk(table, orgs)
    assert "path" not in walk.columns
    labels = {r.ods_code: r.successor_label for r in G.successor_label(walk).collect()}
    assert labels == {"A": "name D +1", "B": "name E +1", "C": "name D", "E": "Q"}


def test_documents_order_a_walk_by_place(spark):
    from rollbook.operators import profile as P
    table = edge_table(spark, [("A", "B"), ("B", "A"), ("B", "C"), ("A", "Z"), ("Z", "Y")])
    orgs = org_table(spark, {c: "active" for c in "ABCYZ"})
    rels = spark.createDataFrame([], "source_code string, target_code string, rel_code string, rel_name string, rel_status string, legal_start date, "
                                     "legal_end date, operational_start date, operational_end date, rel_id string")
    preds = G.direct_predecessors(table, orgs)
    of = lambda chain: sorted(tuple(r) for r in P.profile_positions(P.profile_items(orgs, rels, chain, preds)).select("ods_code", "item", "position").collect())
    assert of(G.succession_walk(table, orgs)) == of(G.succession_chain(table, orgs))
