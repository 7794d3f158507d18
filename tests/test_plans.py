"""Physical plans: what reaches the scan, and how often."""

import re

import pytest

from rollbook.operators import aggregates, history, search
from rollbook.sources import sinks, tables


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def whole_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")


@pytest.fixture(scope="module")
def release(spark, t, tmp_path_factory):
    from pyspark.sql import functions as F
    out = str(tmp_path_factory.mktemp("release"))
    none = F.array().cast("array<string>")
    orgs = t.orgs.withColumn("predecessor_codes", none).withColumn("successor_codes", none)
    sinks.write_release({"orgs": orgs, "roles": t.roles, "relationships": t.relationships, "successions": t.successions}, out)
    return out


def read_columns(plan):
    return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>(?:\s|$|\))", plan + " ").group(1)))


def test_search_filters_reach_the_scan_and_columns_are_pruned(spark, release):
    orgs = tables.scan_table(spark, release, "orgs")
    plan = physical(search.find(orgs, search.FindSpec(query="red", places=["nation 3"])).select("ods_code", "name"))
    assert "EqualTo(status,active)" in plan
    assert read_columns(plan) == {"ods_code", "name", "status", "town", "county", "country", "legal_end", "publication_date"}
    plan = physical(aggregates.top_by_town(orgs, "VENDOR"))
    assert read_columns(plan) == {"status", "role_names", "town"} and "TakeOrderedAndProject" in plan


def test_single_pass_summaries_scan_once(spark, release):
    orgs = tables.scan_table(spark, release, "orgs")
    for df in (aggregates.existed_both_ways(orgs, "1998-03-31"), aggregates.overdue_closure(orgs), search.open_partition(orgs)):
        assert physical(df).count("FileScan") == 1


def test_history_sorts_once_per_key(spark, t):
    plan = physical(history.stamp_honesty(t.snapshots))
    assert len(re.findall(r"\bWindow \[", plan)) == 1



def test_positions_of_relationships_need_no_chain(t, monkeypatch):
    """The walk of the succession graph is the costly part of a profile; relationships come before it."""
    from rollbook.operators import graph
    from rollbook.plans import load_all, registry
    load_all()
    monkeypatch.setattr(graph, "succession_chain", lambda *a: pytest.fail("the chain is walked"))
    assert not registry.PLANS["p4c_profile_positions"](t).isEmpty()


def test_batch_search_shuffles_no_pieces_of_names(t):
    """What is looked for is small, and rows are dealt out by code: no join sorts the rows' pieces, no count needs them apart."""
    from rollbook.plans import load_all, registry
    load_all()
    plan = physical(registry.PLANS["f27_find_batch"](t))
    assert "SortMergeJoin" not in plan and "hashpartitioning(gram" not in plan and "hashpartitioning(ods_code" in plan


def test_rows_of_codes_alone_are_not_joined_again(t):
    """The list of a row is put together from what was looked up; only codes meet entities."""
    from rollbook.plans import load_all, registry
    load_all()
    plan = physical(registry.PLANS["j3_join_code_to_name"](t))
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join \[code", plan)) == 1
    assert not re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join \[ods_code", plan)


def test_a_build_parses_its_source_once(spark, t, tmp_path, monkeypatch):
    from rollbook.operators import make
    from rollbook.plans import written
    from rollbook.sources import xml
    paths, records, seen = written.xml_release(t), xml._records, []
    monkeypatch.setattr(xml, "_records", lambda *a: seen.append(a) or records(*a))
    assert make.build_release(spark, paths, t.vocab).publication_date == written.PUBLISHED
    assert len(seen) == len(paths)
