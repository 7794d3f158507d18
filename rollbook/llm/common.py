"""Helpers shared by the corpus operators: numbering, folds, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Blocks into which a numbered group is split, so that no group is sorted in one task.
BLOCKS = 256
#: Classes a stratified sample tells apart; the most frequent ones.
MAX_CLASSES = 200
#: Longest text, in code points, that a training sample holds.
SAMPLE_CHARS = 20_000


def unit(*cols: Column) -> Column:
    """A uniform draw in (0, 1) decided by ``cols``."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def crc_text(c: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes of ``c``; null reads as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32(doc_id as text) mod 4 is 2. A null id is outside it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def numbered(df: DataFrame, groups: list[str], order: list[str], out: str, blocks: int = BLOCKS) -> DataFrame:
    """Number the rows of each group from 0 without gaps, as column ``out``.

    A group is cut into ``blocks`` by a hash of ``order``; rows are numbered in their block and shifted by the sizes of
    the blocks before it, so a group that holds a third of all rows is still spread over many tasks. Nulls form a group of their own.
    """
    cut = df.withColumn("_block", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(blocks)).cast("int"))
    sizes = cut.groupBy(*groups, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*groups, "_block"]
    starts = sizes.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1)
    return (ranked.join(starts, same).withColumn(out, (F.col("_start") + F.col("_rank")).cast("long"))
            .drop("_block", "_rank", "_start", *[f"_s_{k}" for k in keys]))


def stratified(df: DataFrame, label: str, id_col: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each of the ``MAX_CLASSES`` most frequent values of ``label``, chosen by a hash of the id.

    The bound is on rows: with fewer than ``per_class`` rows of a class, all of them are taken. Only for fitting models.
    """
    known = df.where(F.col(label).isNotNull())
    sizes = known.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(MAX_CLASSES).collect()
    if not sizes:
        return known.limit(0)
    kind = known.schema[label].dataType
    rates = known.sparkSession.createDataFrame([(r[0], min(1.0, per_class / r[1])) for r in sizes],
                                               T.StructType([T.StructField(label, kind), T.StructField("_rate", T.DoubleType())]))
    draw = unit(F.col(id_col), F.lit("sample"))
    return (known.join(F.broadcast(rates), label).where(draw < F.col("_rate")).drop("_rate")
            .limit(2 * per_class * len(sizes)))


def sampled(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows, at most twice as many, chosen by a hash of the id; all rows of a smaller table. Only for fitting models."""
    total = df.count()
    return df.where(unit(F.col(id_col), F.lit("sample")) < min(1.0, rows / max(1, total))).limit(2 * rows)


def squeezed(rows: DataFrame, text: str, out: str) -> DataFrame:
    """The rows with a text replaced by its compressed UTF-8 bytes, which cost less to shuffle; null reads as empty."""
    names = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = pa.array([squeeze.compress(t.as_buffer().to_pybytes()) for t in batch.column(len(names))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), texts], names=[*names, out])

    schema = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names]
    last = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return rows.select(*[F.col(f"`{c}`") for c in names], last).mapInArrow(run, ", ".join([*schema, f"{out} binary"]))
