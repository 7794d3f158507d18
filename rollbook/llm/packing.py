"""Packing documents into training sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits a sequence. The program asks for the fewest sequences whose
configurations cover the histogram of lengths, which has at most ``capacity`` rows however many documents there are.
It is solved by multiplicative weights: every round prices configurations by a knapsack dynamic program over the current
weights, plays the best ones, and lowers the weight of lengths that are ahead of the others. The fractional solution is
rounded down; what it leaves is packed best fit, again by histogram. Spark then deals pieces to configurations by rank
within their length, so no piece passes through the driver and no task holds a whole length.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import numbered
from rollbook.runtime import checkpoint

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Words whose ids a worker remembers; others are encoded again.
REMEMBERED = 500_000
#: Rounds of multiplicative weights, configurations played a round, and the step of the weights.
ROUNDS, PLAYS, STEP = 160, 48, 0.35
#: Roundings tried: share of a configuration's fractional amount, and most tokens of room in it. Early configurations use up
#: short pieces, which best fit needs for its last gaps, so the whole amount is not always best.
ROUNDINGS = ((0.5, 0), (0.5, 8), (0.9, 0), (1.0, CAPACITY))
NEWLINE = 198  # the id of a line feed by itself in byte-level BPE vocabularies of this family

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Where every white space stands alone between other characters, the tokenizer splits the text before each of them, so
    words with the space or line feed before them are encoded once and remembered. Other texts, and those that hold an added token
such as ``<|endoftext|>``, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.by_word = self._ids(["\n"]) == [np.array([NEWLINE], "<u4").tobytes()]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> dict[str, bytes | None]:
        """One call for all words, told apart by line feeds; None for what can't be encoded by itself."""
        out = {w: None for w in words if not w.isalnum() and w[w.startswith("\n"):].split() != [w[w.startswith("\n"):]]}
        plain = [w for w in words if w not in out]
        if plain:
            line = self._ids(["\n".join(w[1:] if w[0] == "\n" else " " + w for w in plain)])[0]
            cuts = np.flatnonzero(np.frombuffer(line, "<u4") == NEWLINE).tolist()
            feed, at = np.array([NEWLINE], "<u4").tobytes(), 0
            for w, cut in zip(plain, [*cuts, len(line) // 4], strict=True):
                out[w] = feed + line[4 * at:4 * cut] if w[0] == "\n" else line[4 * at:4 * cut]
                at = cut + 1
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text and ``END``. Words stand for themselves and the space before them, or start with their line feed."""
        end = np.array([END], "<u4").tobytes()
        for at in range(0, len(texts), 256):
            own = [t or "" for t in texts[at:at + 256]]
            cut = [("\n" + t).replace("\n", " \n").split(" ")[1:] if t and self.by_word and not any(a in t for a in self.added) else [""] for t in own]
            fresh = self._encode_words(list(set().union(*cut).difference(self.words)))
            spare = list(fresh)[max(0, REMEMBERED - len(self.words)):]
            self.words.update(fresh)
            for text, words in zip(own, cut, strict=True):
                try:
                    yield b"".join(map(self.words.__getitem__, words))[4:] + end
                except TypeError:  # a word that has no ids of its own
                    yield (self._ids([text])[0] if text else b"") + end
            for w in spare:
                del self.words[w]


def encoder(name: str) -> Encoder:
    """The encoder of a vocabulary file, given by path or by its name among the public tokenizers; one for each worker."""
    if name not in _ENCODERS:
        if not os.path.isabs(name):
            import public_tokenizers
            path = public_tokenizers.path(name)
        else:
            path = name
        _ENCODERS[name] = Encoder(path)
    return _ENCODERS[name]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full pieces after a first that may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document, null texts as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = batch.column(0), []
            for k, raw in enumerate(encoder(tokenizer).encode(batch.column(1).to_pylist())):
                for p, (start, length) in enumerate(cuts(len(raw) // 4, capacity)):
                    own = raw[4 * start:4 * (start + length)]
                    rows.append((k, p, start, length, zlib.crc32(own), own))
            k, p, start, length, crc, own = zip(*rows, strict=True) if rows else ((),) * 6
            cols = [names.take(pa.array(k, pa.int64())), pa.array(p, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in own], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best total value for each room, and the length to take there (0: leave one token free). ``value[l]`` is that of length l."""
    room = len(value) - 1
    best, take = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        total = best[:c][::-1] + value[1:c + 1]
        j = int(total.argmax())
        if total[j] > best[c - 1]:
            best[c], take[c] = total[j], j + 1
        else:
            best[c] = best[c - 1]
    return best, take


def linear_program(demand: np.ndarray) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations, as (length, how often) from the longest, and how many sequences get each; a near-optimal cover.

    ``demand[l]`` is the number of pieces of length l, for l up to the capacity.
    """
    capacity = len(demand) - 1
    lengths = np.flatnonzero(demand)
    done, amount = np.zeros(capacity + 1), defaultdict(float)
    weight = np.full(capacity + 1, -np.inf)
    weight[lengths] = lengths / capacity
    for _ in range(ROUNDS if len(lengths) else 0):
        share = done[lengths] / demand[lengths]
        if share.min() >= 1:
            break
        best, take = knapsack(weight)
        open_ = lengths[share < 1]
        price = weight[open_] + best[capacity - open_]
        for first in open_[np.lexsort((share[share < 1], -price))][:PLAYS]:
            held, c = defaultdict(int), capacity - int(first)
            held[int(first)] = 1
            while c > 0:
                if take[c]:
                    held[int(take[c])] += 1
                    c -= int(take[c])
                else:
                    c -= 1
            step = min(max(demand[n] - done[n], 0.05 * demand[n]) / m for n, m in held.items()) * 0.5
            amount[tuple(sorted(held.items(), reverse=True))] += step
            for n, m in held.items():
                done[n] += step * m
        share = done[lengths] / demand[lengths]
        weight[lengths] *= np.exp(STEP * np.clip(share.mean() - share, -1, 1))
        weight[lengths[share >= 1]] *= 0.9
    return amount


def best_fit(demand: np.ndarray) -> dict[tuple[tuple[int, int], ...], int]:
    """Best fit from the longest length, many equal sequences at a time."""
    capacity, open_ = len(demand) - 1, defaultdict(lambda: defaultdict(int))
    for n in np.flatnonzero(demand)[::-1].tolist():
        left = int(demand[n])
        while left:
            room = min((r for r in open_ if r >= n and open_[r]), default=None)
            if room is None:
                room, group, many = capacity, (), max(1, left // (capacity // n))
            else:
                group, many = next(iter(open_[room].items()))
            each = min(room // n, left)
            many = min(many, left // each)
            if group or room < capacity:
                open_[room][group] -= many
                if not open_[room][group]:
                    del open_[room][group]
            open_[room - each * n][(*group, (n, each))] += many
            left -= many * each
    out = defaultdict(int)
    for groups in open_.values():
        for group, many in groups.items():
            out[group] += many
    return out


def rounded(solved: dict, demand: np.ndarray, share: float, free: int) -> dict[tuple[tuple[int, int], ...], int]:
    """Whole sequences of the configurations with at most ``free`` tokens of room, ``share`` of their fractional amounts
    rounded down and never more than there are pieces; best fit holds what is left."""
    left, out = demand.astype(np.int64).copy(), defaultdict(int)
    capacity = len(demand) - 1
    for held, amount in sorted(solved.items(), key=lambda x: (capacity - sum(n * m for n, m in x[0]), x[0])):
        if capacity - sum(n * m for n, m in held) > free:
            break
        many = int(min(int(amount * share), *(left[n] // m for n, m in held)))
        if many > 0:
            out[held] += many
            for n, m in held:
                left[n] -= many * m
    for held, many in best_fit(left).items():
        out[held] += many
    return out


def configurations(demand: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations with whole numbers of sequences that hold every piece exactly once; the best of a few roundings."""
    solved = linear_program(demand)
    tried = [rounded(solved, demand, share, free) for share, free in ROUNDINGS]
    return sorted(min(tried, key=lambda x: sum(x.values())).items())


def places(demand: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the pieces go, by their number in the order of lengths: first number of each run, its length, pieces a sequence,
    first sequence, and first offset. There are as many runs as configurations have parts, however many pieces there are."""
    runs, first = [], 0
    for held, many in configurations(demand):
        at = 0
        for n, m in held:
            runs.append((n, many * m, m, first, at))
            at += n * m
        first += many
    runs.sort()
    start = np.concatenate([[0], np.cumsum([r[1] for r in runs])[:-1]]) if runs else np.zeros(0)
    return (start.astype(np.int64), *(np.array([r[k] for r in runs], np.int64) for k in (0, 2, 3, 4)))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; offsets leave no gap in a sequence.

    Empty and null texts are one end token. Repeated ids are documents of their own. Extra columns are not looked at.
    """
    own = checkpoint(pieces(docs, tokenizer, capacity, with_ids))
    demand = np.zeros(capacity + 1, np.int64)
    for n, many in own.groupBy("length").count().collect():  # at most ``capacity`` rows
        demand[n] = many
    table = docs.sparkSession.sparkContext.broadcast((np.concatenate([[0], np.cumsum(demand)]), *places(demand)))
    kept = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, start, length, each, first, offset = table.value
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank_in_length"))
            number = below[n] + rank
            k = np.searchsorted(start, number, side="right") - 1
            inside = number - start[k]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first[k] + inside // each[k]), pa.array(offset[k] + inside % each[k] * length[k])],
                                             names=[*kept, "sequence_id", "offset"])

    ranked = numbered(own, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank_in_length")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pieces packed ``with_ids``; a sequence holds at most its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
