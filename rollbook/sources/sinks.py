"""Writers: sorted Parquet tables, CSV, JSON, TSV, diffs, the snapshot series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook import schemas
from rollbook.functions.roles import role_display


def write_table(df: DataFrame, path: str, sort: list[str], partitions: int | None = None,
                max_rows: int = 5_000_000) -> None:
    """Range-partitioned and sorted ZSTD Parquet.

    The full sort key is the range key, so one heavy leading value is split over
    several files and the files stay globally ordered.
    """
    ranged = df.repartitionByRange(partitions, *sort) if partitions else df.repartitionByRange(*sort)
    (ranged.sortWithinPartitions(*sort).write.mode("overwrite").option("compression", "zstd")
     .option("parquet.compression.codec.zstd.level", "3").option("maxRecordsPerFile", max_rows).parquet(path))


def write_release(tables: dict[str, DataFrame], release_dir: str, partitions: int | None = None) -> None:
    """The four tables of one release."""
    for name, df in tables.items():
        write_table(df.select(schemas.TABLES[name].names), f"{release_dir}/{name}.parquet", schemas.SORT_KEYS[name],
                    partitions)


def flat_columns(df: DataFrame) -> DataFrame:
    """CSV view: string lists joined ``"; "``, lists of objects left out, order kept."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, T.StringType):
                out.append(F.array_join(f.name, "; ").alias(f.name))
        elif not isinstance(f.dataType, (T.StructType, T.MapType)):
            out.append(F.col(f.name))
    return df.select(out)


_BLANKS_STAY = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 CSV with a header; quotes doubled, NULL and '' both empty cells."""
    (flat_columns(df).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "").options(**_BLANKS_STAY).csv(path))


def json_lines(df: DataFrame, column: str = "record") -> DataFrame:
    """Each row as one JSON text, NULL fields kept, columns in order."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def display_rows(found: DataFrame, all_rows: bool = False, verbose: bool = False) -> DataFrame:
    """Five display columns of a search result, six when closed rows are shown."""
    cols = [F.col("ods_code"), F.col("name"), F.coalesce("postcode", F.lit("")).alias("postcode"),
            role_display("role_codes", "role_names", verbose).alias("roles"), F.col("record_class")]
    return found.select(cols + ([F.col("status")] if all_rows else []))


def write_tsv(found: DataFrame, path: str, all_rows: bool = False) -> None:
    """Plain fields between tabs, absent ones empty; a tab or line end inside a value becomes a space."""
    shown = display_rows(found, all_rows)
    plain = [F.regexp_replace(F.coalesce(c, F.lit("")), "[\\t\\r\\n]", " ") for c in shown.columns]
    shown.select(F.concat_ws("\t", *plain).alias("line")).write.mode("overwrite").text(path)


def write_diff_ndjson(changes: DataFrame, path: str) -> None:
    """One object per change; an empty ``changes`` map and an absent ``record`` are left out."""
    shown = changes.withColumn("changes", F.when(F.size("changes") > 0, F.col("changes")))
    shown.write.mode("overwrite").json(path)


def write_diff_csv(long_form: DataFrame, path: str) -> None:
    (long_form.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"')
     .options(**_BLANKS_STAY).csv(path))


def snapshot_append(df: DataFrame, path: str, by: str = "publication_date") -> None:
    """Add a release to the series; pulling a date again replaces that date only."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy(by).parquet(path))


def table_contract(tables: dict[str, T.StructType] | None = None) -> list[tuple]:
    """Rows ``(table, position, field, type, item_type, required, primary_key, references)``."""
    names = {"StringType": "string", "DateType": "date", "BooleanType": "boolean", "ArrayType": "list",
             "LongType": "integer", "IntegerType": "integer", "DoubleType": "number", "TimestampType": "datetime", "TimestampNTZType": "datetime"}
    rows = []
    for table, schema in (tables or schemas.TABLES).items():
        for pos, f in enumerate(schema, 1):
            kind = names.get(type(f.dataType).__name__, f.dataType.simpleString())
            item = names.get(type(f.dataType.elementType).__name__) if kind == "list" else None
            refers = "orgs.ods_code" if f.name in schemas.FOREIGN_KEYS.get(table, []) else None
            rows.append((table, pos, f.name, kind, item, not f.nullable,
                         schemas.PRIMARY_KEYS.get(table) == f.name, refers))
    return rows


CONTRACT_DDL = ("table_name string, position int, field string, type string, item_type string, required boolean, "
                "primary_key boolean, reference string")


def table_schema_export(spark, tables: dict[str, T.StructType] | None = None) -> DataFrame:
    """The table contract as a relation, one row per field."""
    return spark.createDataFrame(table_contract(tables), CONTRACT_DDL)


def observed_nulls(df: DataFrame) -> DataFrame:
    """NULLs per column, all columns in one pass: the data's side of the ``required`` flag."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("nulls")) for c in df.columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")
