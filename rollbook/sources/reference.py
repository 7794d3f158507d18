"""Small reference files: role vocabulary, aliases, display settings, the release catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCAB_DDL = "version int, names map<string,string>, rewrites map<string,string>"
ALIAS_DDL = "version int, aliases map<string, struct<codes: array<string>, name: string, why: string>>"
LOW_SIGNAL_DDL = "version int, low_signal map<string, struct<name: string, why: string>>"
CATALOG_DDL = """
  name string,
  releases array<struct<
    source: struct<version: string, hash: string, bytes: bigint, issues: array<string>>,
    datasets: array<struct<version: string, manifest_digest: string, bytes: bigint, tool_version: string,
                           tool_git_sha: string, doi: string, withdrawn: string>>>>
"""


def _json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", "true").json(path)


def scan_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Role code -> curated name, with the reason where a name is more than a case change."""
    doc = _json(spark, path, VOCAB_DDL)
    return (doc.select("rewrites", F.explode("names").alias("role_code", "role_name"))
            .select("role_code", "role_name", F.try_element_at("rewrites", "role_code").alias("rewrite_reason")))


def scan_aliases(spark: SparkSession, path: str) -> DataFrame:
    doc = _json(spark, path, ALIAS_DDL).select(F.explode("aliases").alias("alias", "a"))
    return doc.select("alias", "a.name", "a.why", F.explode("a.codes").alias("role_code"))


def scan_low_signal(spark: SparkSession, path: str) -> DataFrame:
    doc = _json(spark, path, LOW_SIGNAL_DDL).select(F.explode("low_signal").alias("role_code", "s"))
    return doc.select("role_code", "s.name", "s.why")


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue flattened: one row per release and dataset; a release without datasets keeps a row."""
    rows = _json(spark, path, CATALOG_DDL).select("name", F.posexplode("releases").alias("release_pos", "r"))
    flat = rows.select("name", "release_pos", "r.source", F.posexplode_outer("r.datasets").alias("dataset_pos", "d"))
    return flat.select(
        F.col("name").alias("family"), "release_pos", F.col("source.version").alias("release"),
        F.col("source.hash").alias("source_hash"), F.col("source.bytes").alias("source_bytes"),
        F.coalesce("source.issues", F.array().cast("array<string>")).alias("issues"), "dataset_pos",
        F.col("d.version").alias("version"), "d.manifest_digest", F.col("d.bytes").alias("bytes"), "d.tool_version",
        "d.tool_git_sha", "d.doi", "d.withdrawn")
