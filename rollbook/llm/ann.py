"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform, which acts like a random rotation;
its hash is the nearest signed axis. ``TABLES`` such hashes index every vector. A query probes, in each table, the
``PROBES`` signed axes nearest to it. The vectors of a probed bucket are compared with the queries that probe it by one
matrix product in double precision, and only each query's best leave the task.

Equal vectors are one class, so a vector repeated many times is compared once. Buckets are cut into blocks of about
``BLOCK`` classes and ``QUERIES`` queries by counting them first, so no task holds a large bucket. A query for which fewer
than ``k`` are found probes every bucket of one table, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.runtime import checkpoint

TABLES, PROBES, ROUNDS = 8, 12, 3
#: Most classes and queries, on average, that one task compares at once.
BLOCK, QUERIES = 4_000, 1_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    width, h = x.shape[1], 1
    while h < width:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), width)
        h *= 2
    return x / np.sqrt(width)


@cache
def _signs(table: int, width: int) -> np.ndarray:
    return np.random.default_rng((table, width)).choice([-1.0, 1.0], (ROUNDS, width))


def signed_axes(vectors: np.ndarray, table: int) -> np.ndarray:
    """Nearness of each row to the signed axes, after the table's rotation: first the positive axes, then the negative."""
    dim = vectors.shape[1]
    width = 1 << max(0, dim - 1).bit_length()
    x = np.zeros((len(vectors), width))
    x[:, :dim] = vectors
    for signs in _signs(table, width):
        x = hadamard(x * signs)
    return np.concatenate([x, -x], 1)


def nearest_axes(vectors: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """rows x tables x probes: the nearest signed axes, nearest first, ties to the smaller axis."""
    out = []
    for t in range(tables):
        axes = signed_axes(vectors, t)
        out.append(np.argsort(-axes, axis=1, kind="stable")[:, :probes] if probes < axes.shape[1] else np.tile(np.arange(axes.shape[1]), (len(axes), 1)))
    return np.stack(out, 1)


def usable(vector: Column) -> Column:
    """Vectors that are not null, not all zero and have neither null nor non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _hashed(rows: DataFrame, tables: int, probes: int | None) -> DataFrame:
    """(cls, vector, dim, table, axis), a row for each table and probe; all axes where ``probes`` is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                vectors = flat[start[at][:, None] + np.arange(dim)].astype(np.float64)
                vectors /= np.abs(vectors).max(1, keepdims=True)
                vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
                axes = nearest_axes(vectors, tables, probes or 1 << 30)
                n, _, p = axes.shape
                own = pa.array(np.repeat(at, tables * p))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(np.full(len(own), dim, np.int32)),
                     pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), p), n)), pa.array(axes.reshape(-1).astype(np.int32))],
                    names=["cls", "vector", "dim", "table", "axis"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("cls", "vector").mapInArrow(run, f"cls long, vector {kind}, dim int, `table` int, axis int")


def _unit(lists: pd.Series) -> np.ndarray:
    x = np.stack(lists.to_list()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _compared(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query, cls, score): the k + 1 best of each query in each block of each bucket it probes."""
    bucket = ["dim", "table", "axis"]
    many = (index.groupBy(bucket).agg(F.count("*").alias("n")).join(queries.groupBy(bucket).agg(F.count("*").alias("q")), bucket)
            .select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("q") / QUERIES).cast("int").alias("parts")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (queries.join(many, bucket).withColumn("part", F.pmod(F.hash("cls"), F.col("parts"))).withColumn("block", spread(F.col("blocks"))))
    right = (index.join(many, bucket).withColumn("block", F.pmod(F.hash("cls"), F.col("blocks"))).withColumn("part", spread(F.col("parts"))))

    def best(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if own.empty or other.empty:
            return pd.DataFrame({"query": [], "cls": [], "score": []})
        score = _unit(own["vector"]) @ _unit(other["vector"]).T
        cls, take = other["cls"].to_numpy(), min(k + 1, len(other))
        rows = []
        for i, q in enumerate(own["cls"].to_numpy()):
            edge = np.partition(score[i], len(cls) - take)[len(cls) - take] - 1e-12
            at = np.flatnonzero(score[i] >= edge)
            at = at[np.lexsort((cls[at], -score[i][at]))][:take + 16]
            rows.append(pd.DataFrame({"query": q, "cls": cls[at], "score": score[i][at]}))
        return pd.concat(rows)

    keys = [*bucket, "block", "part"]
    narrow = lambda df: df.select(*keys, "cls", "vector").groupBy(*keys)
    found = narrow(left).cogroup(narrow(right)).applyInPandas(best, "query long, cls long, score double")
    return found.groupBy("query", "cls").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
            tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that ``is_query`` marks, by cosine.

    Candidates are all rows but those with the query's own id; ties go to the smaller id. Rows with a null id or an unusable
    vector take no part; vectors are compared with those of their own length only. A query has fewer than ``k`` rows only if
    there are fewer candidates.
    """
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    by_vector = Window.partitionBy("vector").orderBy("id")
    few = (rows.select("vector", "id").distinct().withColumn("at", F.row_number().over(by_vector)).where(F.col("at") <= k + 1)
           .groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")))  # at most k + 1: enough to answer any query
    # classes are numbered by their least id, so cuts among equal scores keep the smaller ids
    classes = checkpoint(few.orderBy(F.col("ids")[0]).select(F.monotonically_increasing_id().alias("cls"), "vector", "ids"))
    asked = checkpoint(rows.where("asks").select("vector", "id").distinct().join(classes, "vector").select("id", "cls"))
    asking = classes.join(asked.select("cls").distinct(), "cls", "left_semi")
    found = checkpoint(_compared(_hashed(asking, tables, probes), _hashed(classes, tables, 1), k))
    answers = checkpoint(_ranked(asked, found, classes, k))
    short = asked.join(answers.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).withColumnRenamed("query_id", "id"), "id", "left_anti")
    rest = asking.join(short.select("cls").distinct(), "cls", "left_semi")
    if rest.isEmpty():
        return answers
    every = _ranked(short, _compared(_hashed(rest, 1, None), _hashed(classes, 1, 1), k), classes, k)
    return answers.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(every)


def _ranked(asked: DataFrame, found: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))).where(F.col("at") <= 2 * k + 2)
    with_ids = best.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    answers = (asked.withColumnRenamed("cls", "query").join(with_ids, "query").where("id <> vec_id")
               .groupBy("id", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return (answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("id").alias("query_id"), "rank", "vec_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score")).alias("score")))


def exact(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The same by comparing each query with every row, in blocks: every bucket of one table is probed."""
    return nearest(vectors, is_query, k, vec_id, vector, 1, 1 << 30)


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    return found.join(true, ["query_id", "vec_id"], "left_semi").count() / max(1, true.count())
