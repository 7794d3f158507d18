"""Packing documents into training sequences of nearly equal cost.

A piece of n tokens costs ``linear * n + quadratic * n * n``: work for each token, and attention inside the piece. Pieces are
taken from the costliest down, and each goes to the sequence of lowest cost that has room for it. Where no sequence has
room for a whole piece, the lowest-cost one with any room is filled with its head, and the tail is a shorter piece.

There are as many sequences as the tokens fill: full ones, and for the last few tokens sequences whose sizes are the
powers of two that sum to them. Such sizes need no padding, so nothing is padded at all.

The greedy choice depends on lengths alone. It is made once, on the driver, over the histogram of lengths (at most
``capacity`` rows however many documents there are): equal sequences are one range of numbers, and equal pieces go to a
whole range in one step, which gives what one piece after the other would. Tasks then find the place of a piece by its
rank in its length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.llm.packing import cuts, encoder
from rollbook.runtime import scratch_path

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END = 1
#: Costs of a token and of a pair of tokens: a layer of width 1024 does about 6 * 1024 times as much for a token as for a pair.
LINEAR, QUADRATIC = 6 * 1024, 1
#: Parts into which the pieces of one length are cut to number them.
BLOCKS = 64


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, start, length, doc_tokens, crc, ids): documents cut into pieces of at most ``capacity`` ids, ids compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, last = zstandard.ZstdCompressor(level=1), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for k, raw in enumerate(encoder(tokenizer).encode(batch.column(1).to_pylist())):
                raw = raw[:-4] + last  # the encoder closes a text with its own last id
                for start, length in cuts(len(raw) // 4, capacity):
                    own = raw[4 * start:4 * (start + length)]
                    rows.append((k, start, length, len(raw) // 4, zlib.crc32(own), _narrow(own, squeeze)))
            k, start, length, total, crc, own = zip(*rows, strict=True) if rows else ((),) * 6
            cols = [batch.column(0).take(pa.array(k, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc)), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "doc_tokens", "crc", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, crc long, ids binary")


def _narrow(ids: bytes, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Ids in two bytes each where they fit, compressed; the first byte tells which."""
    wide = np.frombuffer(ids, "<u4")
    small = not len(wide) or wide.max() < 1 << 16
    return (b"\x02" if small else b"\x04") + squeeze.compress(wide.astype("<u2").tobytes() if small else ids)


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob[1:]), "<u2" if blob[0] == 2 else "<u4").astype("<u4")


def sizes(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(size, how many) of the sequences that ``tokens`` fill to the last one, from the largest; no size needs padding."""
    out = [(capacity, tokens // capacity)] if tokens >= capacity else []
    rest = tokens % capacity
    return out + [(1 << b, 1) for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Run(NamedTuple):
    """``many`` pieces of ``length`` from rank ``start`` on: ``take`` tokens of each go to the sequences from ``first`` on, at
    ``offset``; what is left of each is a piece of length - take, with ranks from ``rest`` on."""

    length: int
    start: int
    many: int
    take: int
    first: int
    offset: int
    rest: int


def deal(demand: np.ndarray, room: list[tuple[int, int]], linear: int = LINEAR, quadratic: int = QUADRATIC) -> list[Run]:
    """Where the pieces go. ``demand[n]`` is the number of pieces of length n; ``room`` gives sequences by size, as ``sizes``."""
    left, runs, first = [int(n) for n in demand], [], 0
    ready, short, waiting, by_room = [], [], {}, defaultdict(list)

    def put(group: tuple[int, int, int, int, int], longest: int) -> None:
        """``group`` is (cost, first sequence, sequences, tokens used, size); it is ready if a piece of ``longest`` fits."""
        free = group[4] - group[3]
        if free >= longest:
            heapq.heappush(ready, group)
        elif free:
            waiting[group[1]] = group
            by_room[free].append(group)
            heapq.heappush(short, group)

    for size, many in room:
        put((0, first, many, 0, size), len(left))
        first += many
    for n in range(len(left) - 1, 0, -1):
        for group in by_room.pop(n, ()):
            if waiting.get(group[1]) == group:
                del waiting[group[1]]
                heapq.heappush(ready, group)
        at = 0
        while at < left[n]:
            if ready:
                cost, first, many, used, size = heapq.heappop(ready)
            else:
                group = heapq.heappop(short)
                if waiting.get(group[1]) != group:
                    continue
                del waiting[group[1]]
                cost, first, many, used, size = group
            take, now = min(n, size - used), min(many, left[n] - at)
            rest = n - take
            runs.append(Run(n, at, now, take, first, used, left[rest] if rest else 0))
            if rest:
                left[rest] += now
            at += now
            if now < many:
                put((cost, first + now, many - now, used, size), n)
            put((cost + linear * take + quadratic * take * take, first, now, used + take, size), n)
    return runs


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, linear: int = LINEAR,
         quadratic: int = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost (and ids) of every piece.

    Null and empty texts are their end id alone. Documents with the same id, or without one, are documents of their own. Other
    columns are not looked at. An empty table gives no pieces. Every sequence is filled to a size that needs no padding.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "tokenised")
    tokenised(docs, tokenizer, capacity, end).write.option("compression", "none").parquet(path)
    own = spark.read.parquet(path)
    demand = np.zeros(capacity + 1, np.int64)
    for n, many in own.groupBy("length").count().collect():  # at most ``capacity`` rows
        demand[n] = many
    runs = sorted(deal(demand, sizes(int((demand * np.arange(capacity + 1)).sum()), capacity), linear, quadratic))
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, len(Run._fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        length, start, _, take, first, offset, rest = runs.T
        # one number for length and rank: all ranks of a length come before those of the next
        span = np.zeros(capacity + 2, np.int64)
        np.maximum.at(span, length + 1, start + runs[:, 2])
        below = np.cumsum(span)
        edge = below[length] + start
        for batch in batches:
            doc, whole, n, total, crc, blob, rank = (batch.column(i) for i in range(7))
            n, rank, began = n.to_numpy(), rank.to_numpy(), whole.to_numpy()
            row, at, size, seq, off = ([] for _ in range(5))
            todo, done = np.arange(len(n)), np.zeros(len(n), np.int64)
            while len(todo):
                k = np.searchsorted(edge, below[n] + rank, side="right") - 1
                inside = rank - start[k]
                for out, x in zip((row, at, size, seq, off), (todo, done, take[k], first[k] + inside, offset[k]), strict=True):
                    out.append(x)
                more = take[k] < n
                todo, done, n, rank = todo[more], (done + take[k])[more], (n - take[k])[more], (rest[k] + inside)[more]
            row, at, size, seq, off = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, at, size, seq, off))
            cut = size < batch.column(2).to_numpy()[row] if len(row) else np.zeros(0, bool)
            sums, parts = crc.to_numpy(zero_copy_only=False)[row].copy(), []
            wide = {k: _wide(blob[k].as_py()) for k in (set(row.tolist()) if with_ids else set(row[cut].tolist()))}
            for i in range(len(row)) if with_ids else np.flatnonzero(cut):
                part = wide[int(row[i])][at[i]:at[i] + size[i]]
                sums[i] = zlib.crc32(part.tobytes())
                parts.append(part.astype(np.int32))
            cols = [doc.take(pa.array(row)), pa.array(began[row] + at), pa.array(size), pa.array(sums), total.take(pa.array(row)),
                    pa.array(seq), pa.array(off), pa.array(linear * size + quadratic * size * size)]
            if with_ids:
                cols.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", "ids"][:len(cols)])

    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost long" + ", ids array<int>" * with_ids
    return _ranked(own).select("doc_id", "start", "length", "doc_tokens", "crc", "ids", "rank").mapInArrow(run, schema)


def _ranked(own: DataFrame) -> DataFrame:
    """The pieces numbered from 0 within their length, block by block, so that no task holds a whole length."""
    cut = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "crc"), F.lit(BLOCKS)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = (cut.groupBy("length", "block").agg(F.count("*").alias("n"))
             .select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "start", "crc", "doc_tokens")
    return (cut.withColumn("rank", F.row_number().over(inside) - 1).join(shift, ["length", "block"])
            .withColumn("rank", (F.col("rank") + F.col("shift")).cast("long")))


def sequence_costs(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens, pieces, cost) of each sequence."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces"), F.sum("cost").alias("cost"))
