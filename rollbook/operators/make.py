"""A release from end to end: source XML files to the four written tables."""

from __future__ import annotations

from functools import reduce
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators import build as B
from rollbook.operators import graph as G
from rollbook.runtime import checkpoint, scratch_path
from rollbook.sources import sinks, xml


class BuildRefused(ValueError):
    """The source does not allow a build; the message says why."""


@dataclass
class Built:
    publication_date: str
    entities: DataFrame
    tables: dict[str, DataFrame]


def _first(df: DataFrame, columns: list[str], n: int = 5) -> str:
    return ", ".join("/".join(str(r[c]) for c in columns) for r in df.limit(n).collect())


def build_release(spark: SparkSession, paths_in_order: list[str], vocab: DataFrame) -> Built:
    """Check, merge and project a release; the merged entities are parsed once and written out.

    Refuses files that disagree on their date, declared counts that differ from the
    records read, records that contradict each other, and roles without a curated name.
    """
    prefixes = [xml.tag_prefix(spark, p) for p in paths_in_order]
    chunks = [xml.xml_chunks(spark, p, prefix=prefix) for p, prefix in zip(paths_in_order, prefixes, strict=True)]
    indexed = lambda parts: reduce(DataFrame.unionByName, [df.withColumn("file_index", F.lit(i)) for i, df in enumerate(parts)])
    parsed = scratch_path(spark, "parsed")
    indexed(map(xml.parse_xml_entities, chunks, prefixes)).withColumn("op_start", B.operational_start()).write.parquet(parsed)
    records = spark.read.parquet(parsed)
    bad = records.where("problem IS NOT NULL")
    unread = reduce(DataFrame.unionByName, [bad.where(F.col("file_index") == i).select("file_name", "problem", "record").unionByName(xml.unended(c))
                                            for i, c in enumerate(chunks)])
    if not unread.isEmpty():
        raise BuildRefused(f"unreadable source: {_first(unread, ['file_name', 'problem', 'record'])}")
    records = records.drop("problem", "record")
    headers = indexed(map(xml.headers_of, chunks))
    dated = B.agree_publication_date(xml.manifests_of(headers)).head()
    if dated.verdict != "agreed":
        raise BuildRefused(f"publication date {dated.verdict}: {_first(B.stated_dates(xml.manifests_of(headers)), ['file_name', 'says'])}")

    declared = xml.manifests_of(headers).agg(F.sum("record_count").alias("n"), F.count_if(F.col("record_count").isNull()).alias("none")).head()
    read = records.count()
    if not declared.none and declared.n != read:
        raise BuildRefused(f"record count: declared {declared.n}, read {read}")
    once, repeated = B.split_repeated(records)
    clash = B.merge_contradictions(repeated)
    if not clash.isEmpty():
        raise BuildRefused(f"contradicting records: {_first(clash, ['code', 'reason'])}")
    entities = B.normalise_entities(once.unionByName(B.merge_entities(repeated)))
    merged = scratch_path(spark, "merged")
    entities.write.parquet(merged)
    entities = spark.read.parquet(merged)

    missing = B.vocab_missing(entities.select(F.explode("roles.id").alias("role_code")), vocab)
    if not missing.isEmpty():
        raise BuildRefused(f"roles without a curated name: {_first(missing, ['role_code'])}")
    day, concepts = str(dated.publication_date), xml.concepts_of(headers, "file_index")
    edges = B.succession_edges(entities, day)
    pairs = checkpoint(G.successor_pairs(edges))
    orgs = B.project_orgs(entities, vocab, G.closure_list(pairs, "successor_code", "successor_codes"),
                          G.closure_list(G.predecessor_pairs(pairs), "predecessor_code", "predecessor_codes"), day)
    return Built(day, entities, {"orgs": orgs, "roles": B.explode_roles(entities, vocab, day),
                                 "relationships": B.explode_relationships(entities, concepts, day), "successions": edges})


def make_release(spark: SparkSession, paths_in_order: list[str], vocab: DataFrame, out_dir: str) -> Built:
    """Build a release and write its four sorted tables under ``out_dir``."""
    built = build_release(spark, paths_in_order, vocab)
    sinks.write_release(built.tables, out_dir)
    return built
