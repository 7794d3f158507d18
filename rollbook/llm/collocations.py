"""Phrase collocations from exact counts of all word sequences, gathered in HAT-tries.

Each task counts sequences of word ids in a trie whose leaves are hash containers. A container that grows too large bursts
into one container for each next word, for the first few words only, so the trie stays shallow. When a task holds too many
sequences, the largest subtrees leave it whole, as sorted runs. Spark partitions the runs by a hash of the first
two words of a sequence and adds up the counts of equal sequences.

A frequent sequence has frequent words and frequent pairs only. So words are counted first, then pairs of frequent words, and
then longer sequences of frequent pairs. What is frequent is sent to the tasks as a bit table of fixed size. It never misses
a frequent one, and lets a few others through, which are counted and then dropped by their exact counts. Most pairs are
rare, so before the pairs themselves are counted, a reading counts hashes of pairs in a table of fixed size, and only pairs whose
hash is frequent go on. On texts too large for that table more pairs go on; results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.runtime import checkpoint

#: Entries after which a container bursts, and how many words deep that goes.
BURST, DEPTH = 4_096, 2
#: Sequences a task holds before it spills subtrees, and words it remembers before it starts anew.
HELD, REMEMBERED = 400_000, 400_000
#: Size of a bit table, and of the pieces in which it is put together.
FILTER_BITS, FILTER_PIECE = 1 << 27, 1 << 16
#: Hashes of pairs that a task gathers before it hands on their counts.
GATHERED = 4_000_000
#: Bytes of text read at once.
BATCH_BYTES = 2 << 20
#: Parts of a language that are ranked by themselves first.
BLOCKS = 64

_BREAK = b"\xff"  # in no UTF-8 text
_SIGNS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _BREAK * 10 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: list[bytes]) -> list[bytes]:
    """The words of UTF-8 texts in lower case (A to Z only), with ``_BREAK`` where a piece or text ends."""
    return _BREAK.join(texts).lower().translate(_SIGNS).replace(_BREAK, b" " + _BREAK + b" ").split()


def hashed(lang: str, words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each sequence, given the hashes of its words as a row."""
    h = np.full(len(words), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words.shape[1]):
            h = (h ^ words[:, j]) * _MIX
            h ^= h >> np.uint64(29)
    return h


class Bits(NamedTuple):
    """``FILTER_BITS`` bits, of which a hash has one place or two."""

    data: np.ndarray
    places: int

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Which hashes have all their bits set."""
        out = np.ones(len(h), bool)
        for at in probes(h, self.places):
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def probes(h: np.ndarray, places: int) -> list[np.ndarray]:
    """The bit places of each hash."""
    return [((h >> np.uint64(32 * i)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for i in range(places)]


class Words(dict):
    """Ids of words, given in order of appearance; 0 for a break and for what ``table`` doesn't hold."""

    def __init__(self, lang: str, table: Bits | None):
        super().__init__({_BREAK: 0})
        self.lang, self.table, self.names, self.hashes = lang, table, [_BREAK], np.zeros(1, np.uint64)

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        """The id of each token; new words are learned first."""
        fresh = list(set(tokens).difference(self))
        h = np.array([xxhash.xxh64_intdigest(w) for w in fresh], np.uint64)
        if self.table is not None and fresh:
            good = self.table.holds(hashed(self.lang, h[:, None]))
            self.update((w, 0) for w, ok in zip(fresh, good.tolist(), strict=True) if not ok)
            fresh, h = [w for w, ok in zip(fresh, good.tolist(), strict=True) if ok], h[good]
        self.update(zip(fresh, range(len(self.names), len(self.names) + len(fresh)), strict=True))
        self.names += fresh
        self.hashes = np.concatenate([self.hashes, h])
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


class HatTrie:
    """Counts of sequences of word ids. A container is a dict from the rest of a sequence, as big-endian bytes, to its count;
    a node is a list of one dict from the next word to what lies below it."""

    def __init__(self, burst: int = BURST, depth: int = DEPTH):
        self.root, self.size, self.burst, self.depth = {}, 0, burst, depth

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        raw, width = grams.astype(">u4").tobytes(), 4 * grams.shape[1]
        for i, n in enumerate(counts.tolist()):
            self.put(raw[width * i:width * (i + 1)], n)

    def put(self, key: bytes, n: int) -> None:
        box, above, at, depth = self.root, None, b"", 0
        while type(box) is list:
            above, at, key, depth = box, key[:4], key[4:], depth + 1
            box = above[0].get(at)
            if box is None:
                box = above[0][at] = {}
        old = box.get(key, 0)
        box[key] = old + n
        if not old:
            self.size += 1
            if len(box) > self.burst and depth < self.depth and len(key) > 4:
                node = [{}]
                for rest, m in box.items():
                    node[0].setdefault(rest[:4], {})[rest[4:]] = m
                if above is None:
                    self.root = node
                else:
                    above[0][at] = node

    def _subtrees(self) -> list[tuple[bytes, dict | list]]:
        return list(self.root[0].items()) if type(self.root) is list else [(b"", self.root)]

    def spill(self, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out the largest subtrees until ``room`` sequences are left, as ids and counts of one number of words at a time."""
        sized = sorted(((_entries(box), first, box) for first, box in self._subtrees()), key=lambda x: -x[0])
        keys, counts = {}, {}
        for many, first, box in sized:
            if self.size <= room:
                break
            for above, held in _containers(first, box):
                for width in set(map(len, held)):
                    own = [key for key in held if len(key) == width]
                    keys.setdefault(width + len(above), []).extend([above + key for key in own])
                    counts.setdefault(width + len(above), []).extend([held[key] for key in own])
            if type(self.root) is list:
                del self.root[0][first]
            else:
                self.root = {}
            self.size -= many
        for width, own in keys.items():
            yield np.frombuffer(b"".join(own), ">u4").reshape(-1, width // 4).astype(np.int64), np.array(counts[width], np.int64)


def _entries(box: dict | list) -> int:
    return len(box) if type(box) is dict else sum(map(_entries, box[0].values()))


def _containers(first: bytes, box: dict | list) -> Iterator[tuple[bytes, dict]]:
    """The containers below ``first``, each with the words that lead to it."""
    if type(box) is dict:
        yield first, box
    else:
        for at, below in box[0].items():
            yield from _containers(first + at, below)


def sorted_run(known: Words, found: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """(lang, prefix, phrase, n) in the order of phrases; the prefix is a hash of the first two words."""
    names = pa.array(known.names, pa.binary())
    columns = [names.take(pa.array(found[:, j])) for j in range(found.shape[1])]
    phrase = pc.binary_join_element_wise(*columns, b" ") if len(columns) > 1 else columns[0]
    order = pc.sort_indices(phrase)
    prefix = hashed(known.lang, known.hashes[found[:, :2]]).astype(np.int64)
    lang = pa.array([known.lang], pa.string()).take(pa.array(np.zeros(len(found), np.int64)))
    return pa.RecordBatch.from_arrays([lang, pa.array(prefix).take(order), phrase.take(order).cast(pa.string()), pa.array(counts).take(order)],
                                      names=["lang", "prefix", "phrase", "n"])


def grams(ids: np.ndarray, good_pair: np.ndarray | None, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct sequences of ``low`` to ``high`` ids without a 0 and of good pairs only, with counts; a pair's place is its first."""
    start, code = np.flatnonzero(ids), ids[np.flatnonzero(ids)].astype(np.int64)
    for k in range(1, high + 1):
        if k > 1:
            last = start + k - 1
            fits = np.flatnonzero(last < len(ids))
            fits = fits[ids[last[fits]] > 0]
            if good_pair is not None:
                fits = fits[good_pair[last[fits] - 1]]
            start, code = start[fits], (code[fits] << 32) | ids[last[fits]]
        if not len(start):
            return
        _, at, code, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        if k >= low:
            yield ids[start[at][:, None] + np.arange(k)], n


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of a task, about ``BATCH_BYTES`` of one language at a time; rows are (lang, text)."""
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by_lang.setdefault(lang, []).append(text.as_buffer().to_pybytes())
            sizes[lang] = sizes.get(lang, 0) + len(by_lang[lang][-1])
            if sizes[lang] > BATCH_BYTES:
                del sizes[lang]
                yield lang, by_lang.pop(lang)
        yield from by_lang.items()


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _pairs(known: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two known words follow each other, and the hash of each such pair."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return at, hashed(known.lang, np.stack([known.hashes[ids[at]], known.hashes[ids[at + 1]]], 1))


def runs(docs: DataFrame, low: int, high: int, words: Bits | None, pairs: Bits | None) -> DataFrame:
    """(lang, prefix, phrase, n): sorted runs of counts from every task; with ``low`` 1, also an empty phrase with all words of a language."""
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pair_table = sent.value
        known: dict[str, tuple[Words, HatTrie]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for vocabulary, trie in known.values():
                for found, n in trie.spill(-1):
                    yield sorted_run(vocabulary, found, n)
            known.clear()

        for lang, texts in _texts(batches):
            if lang not in known:
                known[lang] = Words(lang, table), HatTrie()
            vocabulary, trie = known[lang]
            ids = vocabulary.ids(words_of(texts))
            if low == 1:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0]), pa.array([""]), pa.array([int((ids > 0).sum())])],
                                                 names=["lang", "prefix", "phrase", "n"])
            good = None
            if pair_table is not None:
                good = np.zeros(len(ids), bool)
                at, h = _pairs(vocabulary, ids)
                good[at] = pair_table.holds(h)
            for found, n in grams(ids, good, low, high):
                trie.add(found, n)
            if sum(t.size for _, t in known.values()) > HELD:
                for found, n in trie.spill(trie.size // 2):
                    yield sorted_run(vocabulary, found, n)
            if sum(len(w) for w, _ in known.values()) > REMEMBERED:
                yield from flush()
        yield from flush()

    return _read(docs).mapInArrow(run, "lang string, prefix long, phrase string, n long")


def hot_pairs(docs: DataFrame, words: Bits, least: int) -> Bits:
    """The hashes of pairs of known words that occur ``least`` times or more, pairs of one hash taken together."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    kind = np.uint8 if least < 1 << 8 else np.uint64

    def handed_on(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        place, n = np.unique(np.concatenate(gathered), return_counts=True)
        piece, first = np.unique(place // FILTER_PIECE, return_index=True)
        n, place = np.minimum(n, least).astype(kind), (place % FILTER_PIECE).astype("<u2")
        squeeze, ends = zstandard.ZstdCompressor(level=3), [*first[1:].tolist(), len(place)]
        blobs = [squeeze.compress(np.diff(place[a:b], prepend=np.uint16(0)).tobytes() + n[a:b].tobytes()) for a, b in zip(first.tolist(), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(blobs, pa.binary())], names=["piece", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gathered = {}, []
        for lang, texts in _texts(batches):
            if sum(map(len, known.values())) > REMEMBERED:
                known.clear()
            if lang not in known:
                known[lang] = Words(lang, sent.value)
            gathered.append(probes(_pairs(known[lang], known[lang].ids(words_of(texts)))[1], 1)[0])
            if sum(map(len, gathered)) > GATHERED:
                yield from handed_on(gathered)
                gathered = []
        if gathered:
            yield from handed_on(gathered)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One piece after the other, as the rows are sorted by piece."""
        now, total = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                bits = np.packbits(total >= least, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits], pa.binary())], names=["piece", "bits"])

        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if piece != now:
                    yield from done()
                    now, total = piece, np.zeros(FILTER_PIECE, np.int64)
                raw = zstandard.decompress(blob)
                many = len(raw) // (2 + np.dtype(kind).itemsize)
                total[np.cumsum(np.frombuffer(raw[:2 * many], "<u2"), dtype=np.int64)] += np.frombuffer(raw[2 * many:], kind)
        yield from done()

    counts = _read(docs).mapInArrow(count, "piece long, counts binary").repartition("piece").sortWithinPartitions("piece")
    return Bits(_put_together(counts.mapInArrow(add_up, "piece long, bits binary")), 1)


def _put_together(pieces: DataFrame) -> np.ndarray:
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for piece, bits in pieces.collect():  # at most FILTER_BITS bits in all
        table[piece * FILTER_PIECE // 8:(piece + 1) * FILTER_PIECE // 8] = np.frombuffer(bits, np.uint8)
    return table


def counted(docs: DataFrame, low: int, high: int, least: int, words: Bits | None = None, pairs: Bits | None = None) -> DataFrame:
    """(lang, phrase, f): sequences of ``low`` to ``high`` words with at least ``least`` occurrences; the runs added up by prefix."""
    merged = runs(docs, low, high, words, pairs).repartition("lang", "prefix").groupBy("lang", "prefix", "phrase").agg(F.sum("n").alias("f"))
    return checkpoint(merged.where((F.col("f") >= least) | (F.col("phrase") == "")).select("lang", "phrase", "f"))


def bit_table(frequent: DataFrame) -> Bits:
    """The bit table of (lang, phrase) rows: ``FILTER_BITS`` bits whatever the number of rows, put together from pieces."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pd.DataFrame({"lang": batch.column(0).to_pylist(), "words": [p.encode().split(b" ") for p in batch.column(1).to_pylist()]})
            for (lang, _), own in rows.groupby(["lang", rows["words"].map(len)]):
                h = hashed(lang, np.array([[xxhash.xxh64_intdigest(w) for w in words] for words in own["words"]], np.uint64))
                at = np.unique(np.concatenate(probes(h, 2)))
                yield pa.RecordBatch.from_arrays([pa.array(at // FILTER_PIECE), pa.array(at % FILTER_PIECE)], names=["piece", "bit"])

    def packed(own: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(FILTER_PIECE, np.uint8)
        bits[own["bit"].to_numpy()] = 1
        return pd.DataFrame({"piece": [int(own["piece"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    marked = frequent.where("phrase <> ''").select("lang", "phrase").mapInArrow(places, "piece long, bit long").distinct()
    return Bits(_put_together(marked.groupBy("piece").applyInPandas(packed, "piece long, bits binary")), 2)


def frequent_phrases(docs: DataFrame, most_words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to ``most_words`` words with ``least`` occurrences, and (lang, n) of all words."""
    first = counted(docs, 1, 1, least)
    found, totals = first.where("phrase <> ''"), first.where("phrase = ''").select("lang", F.col("f").alias("n"))
    if most_words > 1:
        words = bit_table(found)
        pairs = counted(docs, 2, 2, least, words, hot_pairs(docs, words, least))
        found = found.unionByName(pairs)
        if most_words > 2:
            found = found.unionByName(counted(docs, 3, most_words, least, words, bit_table(pairs)))
    return found.withColumn("size", F.size(F.split("phrase", " "))), totals


def cut_score() -> Column:
    """floor(1000 * a * n / (l * r)) of the columns a, n, l and r, exact beyond 64 bits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"CAST(1000 AS DECIMAL(4, 0)) * {wide('a')} * {wide('n')} div ({wide('l')} * {wide('r')})")


def _part(start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")


def collocations(docs: DataFrame, most_words: int = 5, least: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` collocations.

    Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs; phrases of
    two to ``most_words`` words lie within a piece. ``a`` counts the phrase, overlapping occurrences too; cut after its first k words,
    its parts occur ``l`` and ``r`` times, and the cut scores floor(1000 * a * n / (l * r)) with ``n`` words in the language. The
    lowest-scoring cut counts, the first of equals. A phrase goes when a longer candidate that holds its words has
    ``share`` hundredths of its occurrences. Order: score, then a, both from the highest, then the phrase's bytes.

    Null and empty texts have no words; a null language is ``und``. Repeated rows count each. Other columns are not looked at.
    """
    phrases, totals = frequent_phrases(docs, most_words, least)
    known = phrases.select(F.col("lang").alias("at_lang"), F.col("phrase").alias("at"), F.col("f").alias("at_f"))
    candidates = phrases.where("size > 1").withColumnRenamed("f", "a")
    inside = candidates.select("lang", F.col("a").alias("longer"), F.explode(F.expr(
        "filter(flatten(transform(sequence(2, size), m -> transform(sequence(1, size - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' ')))), p -> p <> phrase)"
    )).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = candidates.join(covered, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(share) * F.col("a"), F.lit(True)))

    def with_count(rows: DataFrame, part: str, out: str) -> DataFrame:
        return (rows.join(known, (F.col("lang") == F.col("at_lang")) & (F.col(part) == F.col("at")))
                .withColumn(out, F.col("at_f")).drop("at", "at_lang", "at_f", part))

    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("head", _part(F.lit(1), F.col("k"))).withColumn("tail", _part(F.col("k") + 1, F.col("size") - F.col("k")))
    cuts = with_count(with_count(cuts, "head", "l"), "tail", "r").join(totals, "lang")
    cut = F.min(F.struct(cut_score().alias("score"), "k", "l", "r", "n")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    scored = scored.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(BLOCKS)))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "block").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
