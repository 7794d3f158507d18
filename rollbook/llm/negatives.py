"""Hard negatives by slot-decomposed selection.

An anchor's nearest rows of its own label are its positives. Each positive asks for the best rows of other labels whose score
lies in a window that ends at a share of the positive's score. The windows of an anchor overlap, but their upper limits
split the scores into disjoint slots, and a row belongs to one slot only. So each task keeps the ``k`` best of every slot of
every anchor, partial results of a slot merge in any order, and the best below a limit are those of its own slot and of all
lower ones: one pass over an anchor's slots from the lowest up answers all its windows.

Anchors meet all rows in blocks: each pair of a block of anchors and a block of rows is one matrix product of whole
numbers. Blocks are of bounded size whatever the labels are, and only ``k`` candidates a slot leave a block.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.runtime import checkpoint

#: Rows and anchors, on average, that one task compares at once.
ROWS, ANCHORS = 8_192, 1_024
#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Squared lengths stay below this, so every inner product fits 64 bits.
LONGEST = 1 << 62
#: Whole numbers up to this are exact in double precision.
EXACT = 1 << 53


def quantised(vectors: DataFrame, vec_id: str, vector: str, label: Column, is_anchor: Column, every_row: bool = False) -> DataFrame:
    """(id, label, asks, dim, wide, v, row): usable rows with whole-number components as little-endian 32-bit bytes.

    ``row`` tells rows apart. Without ``every_row`` there is one for an id, and it is the id; empty vectors and those too long for
    64-bit scores are left out. With it all of them stay: too long ones are ``wide``, their bytes are the components in double precision.
    """
    x = F.col(vector)
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("string").alias("label"),
                          F.coalesce(is_anchor, F.lit(False)).alias("asks"), x.cast("array<double>").alias("x"), usable.alias("fine"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce("fine", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                scaled = np.floor(SCALE * flat)
                small = np.abs(scaled) < 1 << 31
                whole = np.where(small, scaled, 0).astype(np.int32)
                near = np.abs(whole) >= 1 << 24  # only such components can make a vector too long, unless it has thousands of them
            keep, dims, wide, blobs = [], [], [], []
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                risky = near[a:b].any() or b - a > 1 << 12
                fits = small[a:b].all() and not (risky and sum(int(c) * int(c) for c in whole[a:b]) >= LONGEST)
                if every_row or (b > a and fits):
                    keep.append(i)
                    dims.append(b - a)
                    wide.append(not fits)
                    blobs.append(whole[a:b].tobytes() if fits else flat[a:b].tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(dims, pa.int32()), pa.array(wide, pa.bool_()),
                                              pa.array(blobs, pa.binary())], names=["id", "label", "asks", "dim", "wide", "v"])

    whole = rows.select("id", "label", "asks", "x").mapInArrow(run, "id long, label string, asks boolean, dim int, wide boolean, v binary")
    if every_row:
        return whole.withColumn("row", F.monotonically_increasing_id())
    one = whole.groupBy("id").agg(F.min(F.struct("label", "dim", "v", "asks", "wide")).alias("r")).select("id", "r.*")
    return one.withColumn("row", F.col("id"))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers: in double precision where that is exact."""
    longest = [float(np.einsum("ij,ij->i", x, x, dtype=np.float64).max()) for x in (left, right)]
    if longest[0] * longest[1] < float(EXACT) ** 2 / 4:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def _matrix(blobs: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), dim)


def _numbers(blob: bytes, wide: bool) -> list[int]:
    """Components floor(SCALE * x) as whole numbers of any size; a double from 2^60 up is whole itself."""
    if not wide:
        return np.frombuffer(blob, "<i4").tolist()
    return [int(x) * SCALE if abs(x) >= 1 << 60 else math.floor(x * SCALE) for x in np.frombuffer(blob, "<f8").tolist()]


def _scores(own: pd.DataFrame, other: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """For each anchor: places and 64-bit scores of plain rows, then (place, score) where a ``wide`` vector takes part."""
    dim, asks_wide, is_wide = int(own["dim"].iloc[0]), own["wide"].to_numpy(bool), other["wide"].to_numpy(bool)
    plain, broad = np.flatnonzero(~is_wide), np.flatnonzero(is_wide)
    score = np.zeros((0, len(plain)), np.int64)
    if len(plain) and not asks_wide.all():
        score = products(_matrix(own["v"][~asks_wide], dim), _matrix(other["v"][~is_wide], dim))
    far = {int(p): _numbers(other["v"].iloc[p], True) for p in broad}
    nothing = np.zeros(0, np.int64)
    at = 0
    for blob, wide in zip(own["v"], asks_wide, strict=True):
        mine = _numbers(blob, wide) if wide or far else []
        dot = lambda v, mine=mine: sum(map(operator.mul, mine, v))
        rest = [(p, dot(v)) for p, v in far.items()]
        if wide:
            rest += [(int(p), dot(_numbers(other["v"].iloc[p], False))) for p in plain]
            yield nothing, nothing, rest
        else:
            yield plain, (score[at] if len(plain) else nothing), rest
            at += 1


def order_key(n: int) -> bytes:
    """Bytes that are ordered as the whole numbers they stand for, of any size: the length leads, downwards below zero."""
    body = abs(n).to_bytes(max(1, (abs(n).bit_length() + 7) // 8), "big")
    if n >= 0:
        return (0x8000 + len(body)).to_bytes(2, "big") + body
    return (0x8000 - len(body)).to_bytes(2, "big") + bytes(255 - b for b in body)


def key_number(key: bytes) -> int:
    if key[0] >= 0x80:
        return int.from_bytes(key[2:], "big")
    return -int.from_bytes(bytes(255 - b for b in key[2:]), "big")


def _longs(scores: list[int]) -> pd.Series:
    """Scores as 64-bit numbers; those that don't fit are null."""
    return pd.Series([s if -(1 << 63) <= s < 1 << 63 else None for s in scores], dtype="Int64")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids, best first."""
    at = np.arange(len(score))
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _grid(anchors: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Anchors and rows dealt to pairs of blocks within equal ``keys``: as many blocks as their counts need."""
    of = lambda df, size: df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("blocks"))
    many = checkpoint(of(anchors, ANCHORS).withColumnRenamed("blocks", "parts").join(of(rows, ROWS), keys))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")  # noqa: E731 - of one type on both sides, or equal cells go to different tasks
    left = anchors.join(many, keys).withColumn("part", dealt("parts")).withColumn("block", every(F.col("blocks")))
    right = rows.join(many, keys).withColumn("block", dealt("blocks")).withColumn("part", every(F.col("parts")))
    cell = [*keys, "part", "block"]
    apart = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns if c not in ("parts", "blocks")])  # noqa: E731 - both come from the same rows
    return apart(left), apart(right), cell


def positives(rows: DataFrame, k: int, low_percent: int, high_percent: int) -> DataFrame:
    """(anchor, id, positive, down, high, low, score): the ``k`` best other rows of each anchor's label; rows from ``quantised``.

    ``anchor`` is the anchor's row and ``id`` its id. ``down`` orders from the highest score down, as do the limits ``high`` and ``low``,
    ``high_percent`` and ``low_percent`` hundredths of the score, rounded inwards; see ``order_key``.
    """
    left, right, cell = _grid(rows.where("asks"), rows, ["dim", "label"])

    def best(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        anchor, anchor_id, positive, scores = [], [], [], []
        if len(own) and len(other):
            ids, numbers = other["id"].to_numpy(), other["row"].to_numpy()
            for row, own_id, (plain, score, rest) in zip(own["row"], own["id"], _scores(own, other), strict=True):
                others = numbers[plain] != row
                plain, score = plain[others], score[others]
                at = _best(score, ids[plain], k)
                found = [(-s, i) for s, i in zip(score[at].tolist(), ids[plain[at]].tolist(), strict=True)]
                found = sorted(found + [(-s, int(ids[p])) for p, s in rest if numbers[p] != row])[:k]
                anchor += [row] * len(found)
                anchor_id += [own_id] * len(found)
                positive += [i for _, i in found]
                scores += [-d for d, _ in found]
        return pd.DataFrame({"anchor": anchor, "id": anchor_id, "positive": positive, "down": [order_key(-s) for s in scores],
                             "high": [order_key(-(s * high_percent // 100)) for s in scores],
                             "low": [order_key(-s * low_percent // 100) for s in scores], "score": _longs(scores)})

    columns = [*cell, "id", "row", "wide", "v"]
    found = left.select(columns).groupBy(cell).cogroup(right.select(columns).groupBy(cell)).applyInPandas(
        best, "anchor long, id long, positive long, down binary, high binary, low binary, score long")
    order = Window.partitionBy("anchor").orderBy("down", "positive")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def slot_candidates(rows: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """(anchor, slot, down, score, id): the ``k`` best rows of other labels in each slot of each anchor, at least its lowest limit.

    ``windows`` is (anchor, tops, least): upper limits from the highest down. Slot j holds the scores above limit j + 1 up to limit j.
    """
    asking = rows.where("asks").join(windows, F.col("row") == F.col("anchor")).drop("anchor")
    left, right, cell = _grid(asking, rows.drop("asks"), ["dim"])

    def best(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        anchor, slot, top, idx = [], [], [], []
        if len(own) and len(other):
            ids = other["id"].to_numpy()
            codes, names = pd.factorize(pd.concat([own["label"], other["label"]]))
            mine, theirs = codes[:len(own)], codes[len(own):]
            limits = zip(own["row"], own["tops"], own["least"], mine, _scores(own, other), strict=True)
            for a, tops, least, label, (plain, score, rest) in limits:
                tops, least = [-key_number(t) for t in tops], -key_number(least)
                edges = np.array([min(t, LONGEST) for t in tops], np.int64)  # 64-bit scores lie below LONGEST
                near = np.flatnonzero((score <= edges[0]) & (score >= min(least, LONGEST)) & (theirs[plain] != label))
                s, at_ids = score[near], ids[plain[near]]
                place = len(tops) - 1 - np.searchsorted(edges[::-1], s, side="left")  # the lowest limit that is not below the score
                held = {}
                for j in np.unique(place):
                    inside = np.flatnonzero(place == j)
                    at = inside[_best(s[inside], at_ids[inside], k)]
                    held[int(j)] = [(-x, i) for x, i in zip(s[at].tolist(), at_ids[at].tolist(), strict=True)]
                for p, x in rest:
                    if least <= x <= tops[0] and theirs[p] != label:
                        held.setdefault(sum(t >= x for t in tops) - 1, []).append((-x, int(ids[p])))
                for j, found in held.items():
                    for down, i in sorted(found)[:k]:
                        anchor.append(a)
                        slot.append(j)
                        top.append(-down)
                        idx.append(i)
        return pd.DataFrame({"anchor": anchor, "slot": slot, "down": [order_key(-x) for x in top], "score": _longs(top), "id": idx})

    columns = [*cell, "id", "label", "wide", "v"]
    found = (left.select(*columns, "row", "tops", "least").groupBy(cell).cogroup(right.select(columns).groupBy(cell))
             .applyInPandas(best, "anchor long, slot int, down binary, score long, id long"))
    order = Window.partitionBy("anchor", "slot").orderBy("down", "id")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def _answers(windows: DataFrame, slots: DataFrame, k: int) -> DataFrame:
    """Every window's ``k`` best: slots are merged from the lowest up, and each window takes what has been merged by then."""
    held = slots.groupBy("anchor").agg(F.collect_list(F.struct("slot", "down", "id", "score")).alias("held"))
    both = windows.join(held, "anchor")
    kind = "array<struct<down:binary,id:bigint,score:bigint>>"
    start = F.struct(F.array().cast(kind).alias("top"), F.array().cast(f"array<{kind}>").alias("all"))

    def merge(acc: Column, j: Column) -> Column:
        own = F.transform(F.filter("held", lambda h: h["slot"] == j),
                          lambda h: F.struct(h["down"].alias("down"), h["id"].alias("id"), h["score"].alias("score")))
        top = F.slice(F.array_sort(F.concat(acc["top"], own)), 1, k)
        return F.struct(top.alias("top"), F.concat(F.array(top), acc["all"]).alias("all"))

    merged = F.aggregate(F.sequence(F.size("asked") - 1, F.lit(0), F.lit(-1)), start, merge)["all"]  # one for each window, highest first
    each = both.withColumn("m", merged).select("id", F.posexplode("asked").alias("j", "w"), "m")
    picked = F.filter(F.element_at("m", F.col("j") + 1), lambda c: c["down"] <= F.col("w.low"))
    return (each.select("id", "w", F.posexplode(picked).alias("at", "c"))
            .select(F.col("id").alias("anchor_id"), F.col("w.positive").alias("positive_id"), (F.col("at") + 1).alias("rank"),
                    F.col("c.id").alias("negative_id"), F.col("w.score").alias("positive_score"), F.col("c.score").alias("negative_score")))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", n_positives: int = 5,
                   k: int = 3, low_percent: int = 50, high_percent: int = 95, every_row: bool = False) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its ``n_positives`` best other rows of its label: the ``k`` best rows of other labels that score from
    ``low_percent`` to ``high_percent`` hundredths of the positive. Scores are inner products of whole numbers floor(256 x); ties go to
    the smaller id. A positive below zero has no negatives, as its limits cross.

    Rows with a null id, label or vector, or a component that is null or not finite take no part. Vectors meet those of their own
    dimension only. Other columns are not looked at.

    Of rows that share an id one counts, that of the smallest label (as text) and vector; empty vectors take no part, nor do those whose
    whole-number squared length is 2^62 or more, as their scores need not fit 64 bits. With ``every_row`` all these rows count: each
    is a row of its own whatever its id, and scores are compared exactly at any size; one that does not fit 64 bits is returned as null.
    """
    rows = checkpoint(quantised(vectors, vec_id, vector, label, is_anchor, every_row))
    close = positives(rows, n_positives, low_percent, high_percent).where(F.col("down") <= F.lit(order_key(0)))
    asked = close.select("anchor", "id", F.struct("high", "positive", "score", "low").alias("w"))
    windows = checkpoint(asked.groupBy("anchor", "id").agg(F.sort_array(F.collect_list("w")).alias("asked")))
    limits = windows.select("anchor", F.col("asked.high").alias("tops"), F.array_max("asked.low").alias("least"))
    return _answers(windows, slot_candidates(rows, limits, k), k)
