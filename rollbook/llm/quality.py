"""Document quality by Bradley-Terry ranking.

A pair of documents, one marked good and one marked bad, is a comparison that the good one won. The model gives each
document a strength, linear in features of its whole text, so that ``sigmoid(strength difference)`` is the chance to win;
it is fitted by logistic loss on feature differences. Every labelled document is compared, with those of the other label in
its bucket; the loss is added up over buckets, so only sums leave the tasks. A document is accepted if its strength reaches the quantile of
strengths of all labelled documents that the share of bad labels marks; scores are scaled so that this point is ``THRESHOLD``.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import held_out, numbered
from rollbook.runtime import checkpoint, scratch_path, stretches

THRESHOLD = 0.7
#: Labelled rows of a bucket: of the more frequent label, and at least of the other one, if there are as many.
FREQUENT, RARE = 128, 64
WIDTH = 30
PENALTY, STEPS = 1e-3, 40
_KINDS = 8  # other, lower, upper, digit, white space, sentence marks, further marks, letters without case


@cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))
        if c in ("Cn", "Co", "Cs"):
            continue
        table[cp] = {"Ll": 1, "Lu": 2, "Lt": 2, "Nd": 3, "Zs": 4, "Zl": 4, "Zp": 4}.get(c, 7 if c[0] == "L" else 6 if c[0] in "PSMN" else 0)
    table[[9, 10, 11, 12, 13]] = 4
    table[[ord(c) for c in ".,;:?'-\"()"]] = 5
    return table


def features(text: str | None) -> np.ndarray:
    """Shares and ratios of a whole text; of an empty one they are zeros."""
    words = text.split() if text else []
    if not words:
        return np.zeros(WIDTH)
    share = np.bincount(kinds()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=_KINDS) / len(text)
    n = len(words)
    seen = Counter(words)
    size = np.fromiter(map(len, words), np.int64, n)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    runs = len(set(zip(words, words[2:], words[4:], strict=False))) / max(1, n - 4)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = Counter(w[-1] for w in words)
    marked = sum(v for c, v in ends.items() if not c.isalnum() and c not in ".,;:?")
    stops = sum(v for c, v in ends.items() if c in ".?!") / n
    loud = sum(v for w, v in seen.items() if len(w) > 1 and w.isupper()) / n
    alone = sum(v for w, v in seen.items() if not any(map(str.isalnum, w))) / n
    letters = max(1e-9, share[1] + share[2] + share[7])
    raw = np.array([share[3], share[4], share[5], share[6], share[7], share[0], share[2] / letters, same, 1 - runs, len(seen) / n,
                    seen.most_common(1)[0][1] / n, marked / n, stops, loud, alone, 1 - len(set(lines)) / len(lines)])
    depth = np.log1p([len(text), n, n / len(lines), size.mean(), size.std(), len(seen)])
    return np.concatenate([raw, depth, np.sqrt(raw[[3, 6, 7, 8, 10, 11, 13, 14]])])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0  # the accepted strengths' lower end
    spread: float = 1.0  # strengths are divided by it before the logistic curve

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def rate(self, x: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """Scores of rows of features; those of blank texts are 0."""
        up = np.clip((self.scaled(x) @ self.weights - self.cut) / self.spread, -30, 30) + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.where(blank, 0.0, 1 / (1 + np.exp(-up)))


def _blank(texts: list[str | None]) -> np.ndarray:
    return np.array([not (t and t.strip()) for t in texts], bool)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(-1, WIDTH)


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``known`` (a text is there), ``blank`` and ``x``, the features of the whole text; written once."""
    names = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            x = np.concatenate([features(t) for t in texts]) if texts else np.zeros(0)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * WIDTH, pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t is not None for t in texts]), pa.array(_blank(texts)), rows],
                                             names=[*names, "known", "blank", "x"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`"))
    return _kept(rows.mapInArrow(run, ", ".join([*fields, "known boolean", "blank boolean", "x array<double>"])), "features")


def _buckets(rows: DataFrame, sizes: dict[bool, int]) -> DataFrame:
    """(bucket, good, x), a bucket in one partition: every row is in one, and rows of the rarer label are in several if they are few."""
    often = sizes[True] >= sizes[False]
    count = math.ceil(sizes[often] / FREQUENT)
    sets = max(1, min(count, sizes[not often] // RARE))
    at = numbered(rows, ["good"], ["id", "x"], "at")
    one = at.where(F.col("good") == often).withColumn("bucket", F.col("at") % count)
    more = at.where(F.col("good") != often).withColumn("bucket", F.explode(F.sequence(F.col("at") % sets, F.lit(count - 1).cast("long"), F.lit(sets).cast("long"))))
    both = one.unionByName(more).select("bucket", "good", "id", "x")
    return checkpoint(both.repartition("bucket").sortWithinPartitions("bucket", "good", "id", "x").drop("id"))


def _loss_sums(buckets: DataFrame, model: Model) -> np.ndarray:
    """Comparisons, gradient and Hessian of the logistic loss over all pairs of a good and a bad row in a bucket, added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + WIDTH + WIDTH * WIDTH)
        for own in stretches(batches, "bucket"):
            z, good = model.scaled(_matrix(own.column("x"))), np.asarray(own.column("good").combine_chunks().to_numpy(zero_copy_only=False), bool)
            g, b = z[good], z[~good]
            p = 1 / (1 + np.exp(np.clip((g @ model.weights)[:, None] - (b @ model.weights)[None, :], -30, 30)))
            q = p * (1 - p)
            mixed = g.T @ q @ b
            hessian = (g * q.sum(1)[:, None]).T @ g + (b * q.sum(0)[:, None]).T @ b - mixed - mixed.T
            total += np.concatenate([[p.size], p.sum(1) @ g - p.sum(0) @ b, hessian.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return np.sum([r[0] for r in buckets.mapInArrow(run, "sums array<double>").collect()], axis=0)


def _at_rank(values: DataFrame, rank: int) -> tuple[float, float]:
    """The value of column ``s`` at a rank from 0 and the next one in order: counts by ever narrower ranges, so nothing is sorted."""
    s, before = F.col("s"), 0
    low, high = values.agg(F.min(s), F.max(s)).head()
    while (step := (high - low) / 1000) > 0:
        inside = values.where((s >= low) & (s <= high)).groupBy(F.least(F.floor((s - low) / step), F.lit(999)).alias("part"))
        for r in inside.agg(F.count("*").alias("n"), F.min(s).alias("low"), F.max(s).alias("high")).orderBy("part").collect():
            low, high = r["low"], r["high"]
            if before + r["n"] > rank:
                break
            before += r["n"]
    upto, after = values.agg(F.count_if(s <= low), F.min(F.when(s > low, s))).head()
    return low, low if upto > rank + 1 or after is None else after


def learn(rows: DataFrame) -> Model:
    """Fit on all ``rows`` (id, good, x); with one label only there is nothing to compare and all scores are equal."""
    rows = _kept(rows.select("id", "good", "x"), "labelled")
    sizes = {True: 0, False: 0} | {r[0]: r[1] for r in rows.groupBy("good").count().collect()}
    if not sum(sizes.values()):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH))
    each = lambda f: [f(F.col("x")[i]) for i in range(WIDTH)]
    facts = np.array(rows.agg(*each(F.avg), *each(F.stddev_pop)).head(), float)
    model = Model(facts[:WIDTH], facts[WIDTH:] + 1e-6, np.zeros(WIDTH))
    if not all(sizes.values()):
        return model
    buckets = _buckets(rows, sizes)
    for _ in range(STEPS):  # Newton steps on the penalised logistic loss
        sums = _loss_sums(buckets, model)
        pairs, gradient, hessian = sums[0], sums[1:WIDTH + 1], sums[WIDTH + 1:].reshape(WIDTH, WIDTH)
        step = np.linalg.solve(hessian / pairs + PENALTY * np.eye(WIDTH), gradient / pairs - PENALTY * model.weights)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = np.round(model.weights, 9)  # sums may be added in any order

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scaled(_matrix(batch.column(1))) @ model.weights
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["good", "s"])

    values = _kept(rows.select("good", "x").mapInArrow(strengths, "good boolean, s double"), "strengths")
    model.cut = sum(_at_rank(values, sizes[False] - 1)) / 2
    model.spread = max(1e-6, sum(r[1] for r in values.groupBy("good").agg(F.stddev_pop("s")).collect()) / 4)
    return model


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, good, x) of ``rows`` (id, known, x) with a label, outside the held-out fold.

    Rows with a null label or text teach nothing; an id labelled both ways teaches both.
    """
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where(F.col("quality").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    return rows.where("known").select("id", "x").join(marks.select("id", (F.col("quality") == 1).alias("good")), "id")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled rows outside the held-out fold; texts are read for their features, which alone are joined to labels."""
    rows = docs.select(F.col("doc_id").alias("id"), "text").where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    return learn(_labelled(featured(rows), labels))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score and predicted from the whole text; other columns are kept, columns of those two names are replaced.

    Null and empty texts, and those of white space alone, get 0: there is nothing to learn from them.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, WIDTH))
            s = shared.value.rate(x, _blank(texts))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                                             names=[*kept, "score", "predicted"])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_scored_text"))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; an empty table gives no rows."""
    rows = featured(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"))
    model = learn(_labelled(rows.withColumnRenamed("doc_id", "id"), labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.rate(_matrix(batch.column("x")), np.asarray(batch.column("blank").to_numpy(zero_copy_only=False), bool))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return rows.select("doc_id", "held_out", "blank", "x").mapInArrow(run, fields)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good, with exactly their columns, also where one is called score or predicted."""
    columns = docs.columns
    renamed = docs.toDF(*[f"_c{i}" for i in range(len(columns))])
    text = f"_c{columns.index('text')}"
    kept = score(renamed, fit(docs, labels), text).where("predicted = 1")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])
