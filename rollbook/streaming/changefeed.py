"""A stream of finished releases turned into a change feed.

A release is announced by a small JSON marker (publication_date, path) once all its files are in place. The stream
carries markers only; a release is always read whole, however many files it has and however they arrived.
Releases are complete snapshots, so the feed needs no state store: each date is compared with the newest earlier date in
the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rollbook.operators.diff import diff_long
from rollbook.sources.sinks import snapshot_append

MARKER = "publication_date date, path string"


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """The stream of finished releases, with the time each was announced."""
    return spark.readStream.schema(MARKER).json(path).select("publication_date", "path", F.col("_metadata.file_modification_time").alias("announced"))


def announce(spark: SparkSession, day, release: str, markers: str) -> None:
    """Write the marker of a release whose files are all in place."""
    spark.createDataFrame([(str(day), release)], "publication_date string, path string").coalesce(1).write.mode("append").json(markers)


def _write_changes(series: DataFrame, day, before, feed_path: str) -> None:
    """The changes of one date against the one before, in place of what the feed has for it, also where there are none."""
    on = lambda d: series.where(F.col("publication_date") == F.lit(d))
    diff_long(on(before), on(day)).write.mode("overwrite").parquet(f"{feed_path}/publication_date={day}")


def start_change_feed(markers: DataFrame, schema: T.StructType, series_path: str, feed_path: str, checkpoint_path: str) -> StreamingQuery:
    """Add each announced release to the series and its changes to the feed.

    Every write replaces its date, so a batch that is replayed after a failure, or a release announced again, leaves
    the same result. A late or repeated date also renews the changes of the date after it. Of a date announced several times in one batch,
    the latest announcement counts.
    """
    def handle(batch: DataFrame, _id: int) -> None:
        spark = batch.sparkSession
        for day, path in batch.groupBy("publication_date").agg(F.max_by("path", F.struct("announced", "path"))).orderBy("publication_date").collect():  # a row per release
            new = spark.read.schema(T.StructType([f for f in schema if f.name != "publication_date"])).parquet(path)
            snapshot_append(new.withColumn("publication_date", F.lit(day)), series_path)
            series = spark.read.parquet(series_path)
            near = series.agg(F.max(F.when(F.col("publication_date") < F.lit(day), F.col("publication_date"))).alias("before"),
                              F.min(F.when(F.col("publication_date") > F.lit(day), F.col("publication_date"))).alias("after")).head()
            if near["before"] is not None:
                _write_changes(series, day, near["before"], feed_path)
            if near["after"] is not None:
                _write_changes(series, near["after"], day, feed_path)

    return (markers.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_path)
            .trigger(availableNow=True).start())
