"""Reading the tables of one release or of a whole series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook import schemas


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One table of a release; a declared schema skips inference and fills absent columns with NULL."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def scan_table(spark: SparkSession, release_dir: str, table: str) -> DataFrame:
    """A register table by name, with older column names accepted and missing optional columns NULL."""
    df = spark.read.parquet(f"{release_dir}/{table}.parquet")
    for old, new in schemas.COLUMN_ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    want = schemas.TABLES[table]
    missing = [f.name for f in want if not f.nullable and f.name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks required column(s): {', '.join(missing)}")
    return df.select([F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                      for f in want])


def scan_snapshots(spark: SparkSession, glob: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """All releases under a glob; date bounds reach the partition filter or the file statistics."""
    df = spark.read.parquet(glob)
    if since is not None:
        df = df.where(F.col("publication_date") >= F.lit(since).cast("date"))
    if until is not None:
        df = df.where(F.col("publication_date") <= F.lit(until).cast("date"))
    return df


def scan_union_by_name(spark: SparkSession, *paths: str) -> DataFrame:
    """Releases written under different schema versions; missing columns are NULL."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def scan_with_filename(spark: SparkSession, *paths: str) -> DataFrame:
    """Every row with the file it came from."""
    return spark.read.parquet(*paths).withColumns(
        {"filename": F.col("_metadata.file_path"), "file_name": F.col("_metadata.file_name")})


def scan_path_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*paths)


def scan_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON record per line under a declared schema; a malformed line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def dataset_format(path: str) -> str:
    """``parquet``, ``ndjson`` or ``xml`` from a path's extension; a directory is Parquet."""
    low = path.lower().rstrip("/")
    for ext, fmt in ((".ndjson", "ndjson"), (".jsonl", "ndjson"), (".json", "ndjson"), (".xml", "xml"),
                     (".parquet", "parquet")):
        if low.endswith(ext):
            return fmt
    return "parquet"


def scan_dataset(spark: SparkSession, path: str, table: str = "orgs") -> DataFrame:
    """Entities from whatever a path holds: a Parquet release, NDJSON records, or source XML."""
    fmt = dataset_format(path)
    if fmt == "ndjson":
        return scan_ndjson(spark, path, schemas.TABLES[table])
    if fmt == "xml":
        from rollbook.sources.xml import scan_xml_entities
        return scan_xml_entities(spark, path)
    if path.lower().endswith(".parquet"):
        return scan_parquet(spark, path)
    return scan_table(spark, path, table)
