"""Repeated passages by prefix-free parsing.

Rolling-hash triggers cut every text into phrases (``phrases.py``), so that equal stretches are parsed alike wherever they
stand. The corpus is then treated through its parse, in the order (document, start) that says which copy is the first:

1. The occurrences of a phrase, one row each, are sorted by trigger and phrase. All windows of an occurrence that is not the first
   of its phrase stand earlier too, so its whole stretch is covered, and the phrase is looked into once, however often it occurs.
   Occurrences that are not the first of their Arrow batch are decided there and are not shuffled.
2. Windows of different phrases can be equal only if they share a trigger. The first occurrences of such phrases, the dictionary
   entries with a neighbour, are fetched with their bytes and their windows (the dictionary's suffixes, cut at the window's
   width) are brought into order: by trigger, window, document and start. All but the first of equal windows are covered.
   A trigger with more than ``CROWD`` entries is spread over tasks by window; the others are streamed, a batch at a time.
3. The covered stretches of a document are merged and its bytes removed.

Windows are compared by 128 bits of hashes: 64 of the window and 64 of its trigger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.llm.common import squeezed
from rollbook.llm.phrases import WIDTH, phrases, window_hashes
from rollbook.runtime import checkpoint, scratch_path

#: Dictionary entries of one trigger that are brought into order within one task.
CROWD = 20_000
_MANY = 7  # bits of a phrase's number of windows, below those of its first window


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, doc and bytes (compressed) of every row, written once. ``doc`` numbers the documents in order: by id, nulls last,
    then by a hash of the text; rows of equal id and text share one."""
    spark = docs.sparkSession
    own = squeezed(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), "text", "bytes")
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark").asc()]
    numbers = checkpoint(docs.select("doc_id", F.xxhash64("text").alias("mark")).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
                         .select(F.col("doc_id").alias("n_id"), F.col("mark").alias("n_mark"), F.monotonically_increasing_id().alias("doc")))
    path = scratch_path(spark, "numbered")
    same = F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("mark") == F.col("n_mark"))
    own.join(numbers, same).select("doc_id", "doc", "bytes").write.parquet(path)
    return spark.read.parquet(path)


def _start(place: Column) -> Column:
    return F.shiftright(place, _MANY)


def _many(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << _MANY) - 1)) + 1


def _spans(rows: DataFrame) -> DataFrame:
    """doc, start and end of the bytes under the windows of phrase occurrences."""
    return rows.select("doc", _start(F.col("place")).alias("start"), (_start(F.col("place")) + _many(F.col("place")) + WIDTH - 1).alias("end"))


def occurrences(rows: DataFrame, first: bool) -> DataFrame:
    """trigger, phrase, doc and place of the phrase occurrences that are (or are not) the first of their Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            docs, parts = batch.column(0).to_numpy(), []
            for k, raw in enumerate(batch.column(1)):
                trigger, phrase, start, many = phrases(np.frombuffer(expand.decompress(raw.as_py()), np.uint8))
                place = (start << _MANY) | (many - 1)
                parts.append((trigger, phrase, np.full(len(start), docs[k]), place))
            trigger, phrase, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
            order = np.lexsort((place, doc, phrase, trigger))
            new = np.ones(len(order), bool)
            new[1:] = (trigger[order][1:] != trigger[order][:-1]) | (phrase[order][1:] != phrase[order][:-1])
            same = np.zeros(len(order), bool)  # of a row that is repeated as a whole
            same[1:] = ~new[1:] & (doc[order][1:] == doc[order][:-1]) & (place[order][1:] == place[order][:-1])
            own = np.sort(order[(new == first) & ~same])
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (trigger, phrase, doc, place)], names=["trigger", "phrase", "doc", "place"])

    return rows.select("doc", "bytes").mapInArrow(run, "trigger long, phrase long, doc long, place long")


def _entries(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """trigger, doc, place and bytes of dictionary entries, cut out of their texts."""
    wanted = entries.groupBy("doc").agg(F.collect_list(F.struct("trigger", "place")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            trigger, doc, place, cut = [], [], [], []
            for d, raw, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = expand.decompress(raw.as_py())
                t, p = (own.values.field(k).to_numpy() for k in (0, 1))
                start, many = p >> _MANY, (p & ((1 << _MANY) - 1)) + 1
                trigger.append(t)
                place.append(p)
                doc.append(np.full(len(p), d))
                cut += [text[s:s + m + WIDTH - 1] for s, m in zip(start.tolist(), many.tolist(), strict=True)]
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (trigger, doc, place)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(cut, pa.binary())], names=["trigger", "doc", "place", "cut"])

    return rows.join(wanted, "doc").select("doc", "bytes", "own").mapInArrow(run, "trigger long, doc long, place long, cut binary")


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """trigger, window, doc and spot (start in the document) of all windows of a batch of entries."""
    trigger, doc, place = (batch.column(k).to_numpy() for k in range(3))
    cut = batch.column(3)
    sizes = np.array([len(x.as_buffer()) for x in cut], np.int64)
    raw = np.frombuffer(b"".join(x.as_buffer() for x in cut), np.uint8)
    at = np.cumsum(sizes) - sizes
    start, window, owner = window_hashes(raw, at, sizes - WIDTH + 1)
    spot = (place >> _MANY)[owner] + start - at[owner]
    return trigger[owner], window, doc[owner], spot


def _ordered(batch: pa.RecordBatch) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The windows of a batch in order, which of them are the first of equals, and which a smaller window of the batch equals."""
    trigger, window, doc, spot = _windows(batch)
    order = np.lexsort((spot, doc, window, trigger))
    trigger, window, doc, spot = (x[order] for x in (trigger, window, doc, spot))
    first, whole = np.ones(len(order), bool), np.zeros(len(order), bool)
    first[1:] = (trigger[1:] != trigger[:-1]) | (window[1:] != window[:-1])
    whole[1:] = ~first[1:] & (doc[1:] == doc[:-1]) & (spot[1:] == spot[:-1])  # a row repeated as a whole is not earlier
    return (trigger, window, doc, spot), first, ~first & ~whole


def _covered_windows(entries: DataFrame) -> DataFrame:
    """doc, start and end of the windows that an earlier window equals, for entries sorted by trigger in each partition."""

    def ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
        (_, _, doc, spot), _, later = _ordered(batch)
        return _runs(doc[later], spot[later])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            if not len(table):
                continue
            batch = table.to_batches()[0]
            trigger = batch.column(0).to_numpy()
            cut = int(np.searchsorted(trigger, trigger[-1]))  # the last trigger may go on in the next batch
            held = batch.slice(cut)
            if cut:
                yield ordered(batch.slice(0, cut))
        if held is not None and len(held):
            yield ordered(held)

    return entries.mapInArrow(run, "doc long, start long, end long")


def _runs(doc: np.ndarray, spot: np.ndarray) -> pa.RecordBatch:
    """The bytes under windows, windows in a row taken together."""
    order = np.lexsort((spot, doc))
    doc, spot = doc[order], spot[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (spot[1:] > spot[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(doc) - 1) if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first], spot[first], spot[last] + WIDTH)], names=["doc", "start", "end"])


def _crowded_windows(entries: DataFrame) -> DataFrame:
    """The same for triggers with many entries: the first of equals in each batch are compared by aggregation, the others are decided there."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, _ = _ordered(batch)
            yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in rows], names=["trigger", "window", "doc", "spot"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (_, _, doc, spot), _, later = _ordered(batch)
            yield _runs(doc[later], spot[later])

    rows = entries.mapInArrow(firsts, "trigger long, window long, doc long, spot long")
    first = rows.groupBy("trigger", "window").agg(F.min(F.struct("doc", "spot")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(first, ["trigger", "window"]).where((F.col("doc") != F.col("first.doc")) | (F.col("spot") != F.col("first.spot")))
    met = later.select("doc", F.col("spot").alias("start"), (F.col("spot") + WIDTH).alias("end"))
    return met.union(entries.mapInArrow(others, "doc long, start long, end long"))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """doc and the list of covered (start, end) of every document that has any, for numbered documents."""
    spark = rows.sparkSession
    by_trigger = Window.partitionBy("trigger")
    first = F.rank().over(Window.partitionBy("trigger", "phrase").orderBy("doc", "place")) == 1
    ranked = occurrences(rows, True).select("*", first.alias("first"), (F.min("phrase").over(by_trigger) != F.max("phrase").over(by_trigger)).alias("shared"))
    path = scratch_path(spark, "phrases")
    ranked.where("NOT first OR shared").drop("phrase").write.parquet(path)
    found = spark.read.parquet(path)
    entries = found.where("first AND shared").select("trigger", "doc", "place")
    path = scratch_path(spark, "entries")
    crowds = entries.groupBy("trigger").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("trigger", F.lit(True).alias("crowded"))
    _entries(rows, entries).join(crowds, "trigger", "left").write.parquet(path)
    cut = spark.read.parquet(path)
    quiet = cut.where(F.col("crowded").isNull()).drop("crowded").repartition("trigger").sortWithinPartitions("trigger")
    spans = (_spans(found.where("NOT first")).union(_spans(occurrences(rows, False))).union(_covered_windows(quiet))
             .union(_crowded_windows(cut.where("crowded").drop("crowded"))))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (and the kept bytes) of every document.

    A byte goes if it lies in ``WIDTH`` bytes that also start earlier: in a document of smaller id, or earlier in the same one.
    Null ids come last. Rows of one id are ordered by a hash of their texts; rows that are equal as a whole are one document.
    Null texts are empty. Removed runs that touch are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            cells = []
            for raw, spans in zip(batch.column(1), batch.column(2), strict=True):
                text = expand.decompress(raw.as_py())
                kept, removed, runs = text, 0, 0
                if spans.is_valid and len(spans.values):
                    start, end = (spans.values.field(k).to_numpy() for k in (0, 1))
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, end, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                cells.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][:4 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[i] for c in cells], k) for i, k in enumerate(kinds))],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:5 + with_text])

    rows = _rows(docs)
    both = rows.join(repeated_spans(rows), "doc", "left").select("doc_id", "bytes", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
