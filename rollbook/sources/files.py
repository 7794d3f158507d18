"""File-level facts: sizes, digests, release manifests."""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from multiprocessing.pool import ThreadPool

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a file is digested as one value; a larger one is read split by split.
WHOLE = 256 << 20
#: Names that Spark's text reader unpacks, so their own bytes can't be read as text.
_PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"


class _Sha256(ctypes.Structure):
    """OpenSSL's SHA-256 in progress: ``hashlib`` can't hand it from one task to the next."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("rest", ctypes.c_uint32 * 16),
                ("held", ctypes.c_uint32), ("length", ctypes.c_uint32)]


@cache
def _openssl() -> ctypes.CDLL:
    """The library behind ``hashlib``."""
    import _hashlib
    lib = ctypes.CDLL(_hashlib.__file__)
    lib.SHA256_Init.argtypes = [ctypes.c_void_p]
    lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    return lib


def _begun() -> bytes:
    state = _Sha256()
    _openssl().SHA256_Init(ctypes.byref(state))
    return bytes(state)


def _added(state: bytes, body: bytes) -> bytes:
    now = _Sha256.from_buffer_copy(state)
    _openssl().SHA256_Update(ctypes.byref(now), body, len(body))
    return bytes(now)


def _ended(state: bytes) -> str:
    now, out = _Sha256.from_buffer_copy(state), ctypes.create_string_buffer(32)
    _openssl().SHA256_Final(out, ctypes.byref(now))
    return out.raw.hex()


def _can_be_handed_on() -> bool:
    """Whether this Python's OpenSSL works as described; where it does not, every file stays one value."""
    try:
        return _ended(_added(_added(_begun(), b"a" * 99), b"b")) == hashlib.sha256(b"a" * 99 + b"b").hexdigest()
    except (ImportError, AttributeError, OSError):
        return False


def _split_step(state: bytes, read: int, place: int):
    """Adds the lines of a split to ``state`` after ``read`` bytes; ``place`` is where the split before it began."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, at = state, read, place
        begun = read >= 0
        for batch in batches:
            starts = batch.column("start")
            if len(starts) and (pc.min(starts).as_py() < at or (place >= 0 and pc.min(starts).as_py() == place)):
                raise ValueError("splits out of order")
            at = pc.max(starts).as_py() if len(starts) else at
            lines = batch.column("line").cast(pa.large_binary())
            body = pc.binary_join(pa.LargeListArray.from_arrays([0, len(lines)], lines), pa.scalar(b"\n", pa.large_binary()))[0].as_py()
            body = b"\n" + body if begun else body
            begun, n = True, max(n, 0) + len(body)
            now = _added(now, body)
        yield pa.RecordBatch.from_pydict({"state": [now], "read": [n], "place": [at]}, schema=pa.schema(
            [("state", pa.binary()), ("read", pa.int64()), ("place", pa.int64())]))

    return step


def _literal(path: str) -> str:
    """A path as a pattern that matches it alone."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _digest_by_split(spark: SparkSession, path: str, size: int) -> str:
    """SHA-256 of a large file: a job for each split, one after the other, as the digest is one chain over all bytes.

    The text reader gives the bytes between line feeds as they are, from any store, without the marks at a line's end
    and a byte order mark. What it left out shows in the size.
    """
    lines = spark.read.option("lineSep", "\n").text(_literal(path)).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("start"))
    for mark in (b"", b"\xef\xbb\xbf"):
        state, read, place, at, splits = _added(_begun(), mark), -1, -1, 0, 1
        while at < splits:
            rdd = lines.mapInArrow(_split_step(state, read, place), "state binary, read long, place long").rdd
            splits = rdd.getNumPartitions()
            done = spark.sparkContext.runJob(rdd, list, [at])[0]
            state, read, place, at = bytes(done.state), done.read, done.place, at + 1
        left = size - len(mark) - max(read, 0)
        if left in (0, 1):  # the last line may have a line feed or not
            return _ended(_added(state, b"\n" * left))
    raise ValueError(f"{path}: {max(read, 0)} of {size} bytes read")


def scan_files_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File name, size and SHA-256 of every file under a path, one file per row.

    A file of up to ``WHOLE`` bytes is one value in one task. A larger one is read split by split, whatever its size: a task
    holds some lines of one split and hands the digest so far to the next. Packed text (``.gz`` and the like) stays one value, up to 2 GB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    largest = min(WHOLE, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(WHOLE))))
    facts = [F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes")]
    digested = lambda df: df.select(*facts, F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > largest).select("path", "length").collect() if _can_be_handed_on() else []
    if not large:
        return digested(files)
    packed = [_literal(r.path) for r in large if re.search(_PACKED, r.path)]
    plain = [(r.path, r.length) for r in large if not re.search(_PACKED, r.path)]
    out = digested(files.where(F.col("length") <= largest))
    if packed:
        out = out.unionByName(digested(spark.read.format("binaryFile").load(packed)))
    with ThreadPool(min(len(large), spark.sparkContext.defaultParallelism)) as pool:
        sums = pool.map(lambda f: (*f, _digest_by_split(spark, *f)), plain)
    return out.unionByName(spark.createDataFrame(sums, "path string, length long, sha256 string").select(*facts, "sha256"))


def release_digest(files: DataFrame, by: str | None = None) -> DataFrame:
    """One digest per release over its sorted ``name:size:hash`` lines, with file count and bytes.

    The lines of one release are its file list, a few hundred bytes a file.
    """
    line = F.concat_ws(":", "file_name", F.col("bytes").cast("string"), F.concat(F.lit("sha256:"), F.col("sha256")))
    grouped = files.groupBy(*([by] if by else []))
    return grouped.agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"),
        F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256))
        .alias("manifest_digest"))


def unexpected_files(files: DataFrame, expected: list[str]) -> DataFrame:
    """Files of a release directory that do not belong to it."""
    return files.where(~F.col("file_name").isin(expected)).select("file_name", "bytes")


def same_provenance(files: DataFrame, release: str = "release", provenance: str = "provenance") -> DataFrame:
    """Per release: whether every file carries one identical provenance object."""
    return files.groupBy(release).agg(
        F.count("*").alias("files"),
        (F.count_distinct(provenance) + F.max(F.col(provenance).isNull().cast("int"))).alias("versions"),
    ).withColumn("same", F.col("versions") == 1)


def column_provenance(df: DataFrame, column: str = "publication_date") -> dict:
    """The provenance object stored as column metadata, which survives a Parquet round trip."""
    return dict(df.schema[column].metadata or {})


def with_provenance(df: DataFrame, facts: dict, column: str = "publication_date") -> DataFrame:
    return df.withMetadata(column, facts)
