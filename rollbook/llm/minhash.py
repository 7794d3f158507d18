"""Near-duplicate groups by MinHash with tensored banding.

A document is the set of its distinct word shingles. ``COLLECTIONS`` small collections of ``ROWS`` minimum hashes each are
computed; a table key is a *pair* of collections, so 16 x 3 minimum hashes serve 120 tables of 6 hashes each, which would
take 720 if every table had its own. Two sets of similarity 0.8 miss all tables with probability below 0.0002.

1. Equal sets become one class, so a text copied a million times is searched for once.
2. Collections that no other class shares are found by counting; a class that shares fewer than two is in no table with
   another and drops out. The other classes get their table keys.
3. In each table key every class is paired with one pivot, which differs between keys; pairs are confirmed on the full sets
   and merged into groups.
4. Where a value of a collection still holds several groups, the pairs across groups that share two collections are confirmed
   too: the classes outside the largest group against all others, each pair from the first collection it shares. No pair
   that could join two groups is left out, and no pairs are made within a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.llm.common import squeezed
from rollbook.llm.components import components
from rollbook.runtime import checkpoint

COLLECTIONS, ROWS = 16, 3
#: 64-bit words of a set's bit sketch: every element sets one bit, so two sets differ in at least as many elements as bits.
SKETCH = 16
#: Shingles hashed at once, to bound memory for very long texts.
CHUNK = 65_536

_RANDOM = np.random.default_rng(20240607)
_BYTES = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z read as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_ODD = _RANDOM.integers(0, 2**64, COLLECTIONS * ROWS, np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, base)
            row[0] = 1
            _POWERS[name] = np.cumprod(row)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text: runs of anything but ASCII white space, with A-Z as a-z."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    inside = np.concatenate([[False], ~_BLANK[raw], [False]])
    start, end = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[:len(raw)])])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; with fewer words the whole sequence is one, without any there is none."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    size = min(words, len(h))
    if not size:
        return h
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        acc = _mix(acc * _BASE + h[k:len(h) - size + 1 + k])
    return np.unique(acc)


def collections(own: np.ndarray) -> np.ndarray:
    """One hash for each collection of minimum hashes."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for at in range(0, len(own), CHUNK):
        part = own[at:at + CHUNK]
        for k, odd in enumerate(_ODD):
            least[k] = min(least[k], (part * odd).min())
    out = np.zeros(COLLECTIONS, np.uint64)
    for r in range(ROWS):
        out = _mix(out * _BASE + least[r::ROWS])
    return out.view(np.int64)


def sketch(own: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * SKETCH, bool)
    bits[own % np.uint64(64 * SKETCH)] = True
    return np.packbits(bits).view(np.int64)


def class_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """row, n_shingles, cls (equal for equal sets, null for empty ones), collections and bits of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(t, words) for t in batch.column(1).to_pylist())
            rows = [(len(s), class_key(s), collections(s), sketch(s)) if len(s) else (0, None, None, None) for s in sets]
            n, key, groups, bits = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(groups, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["row", "n_shingles", "cls", "collections", "bits"])

    kind = docs.schema["row"].dataType.simpleString()
    return docs.select("row", "text").mapInArrow(run, f"row {kind}, n_shingles long, cls binary, collections array<long>, bits array<long>")


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """id and shingles of every row of (id, bytes), with bytes as ``squeezed`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(expand.decompress(x.as_py()).decode("utf-8", "replace"), words).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles array<long>")


def shared_collections(classes: DataFrame) -> DataFrame:
    """(id, at, value): the collections that a class shares with others, of the classes that share at least two."""
    each = classes.select("id", F.posexplode("collections").alias("at", "value"))
    several = each.groupBy("at", "value").agg(F.count("*").alias("classes")).where("classes > 1").drop("classes")
    met = each.join(several, ["at", "value"])
    own = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("own")).where(F.size("own") > 1)  # at most COLLECTIONS
    return own.select("id", F.inline("own"))


def table_keys(shared: DataFrame) -> DataFrame:
    """(bucket, id) of the tables: a key for each pair of collections."""
    own = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("own"))
    pairs = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.xxhash64(
        x["at"], x["value"], y["at"], y["value"]))))
    return own.select("id", F.explode(pairs).alias("bucket"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, counted on the full sets."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _row(docs: DataFrame) -> Column:
    """What stands for a row: its id (nulls last) and its text, so that rows of one id with different texts are told apart."""
    id_ = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    return F.struct(F.col("doc_id").isNull().alias("nameless"), id_.alias("id"), F.xxhash64("text").alias("text")).alias("row")


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """row, n_shingles and least: the first row, by id and then text, of those that are reachable over links."""
    docs = docs.select(_row(docs), "text")
    signed = checkpoint(signatures(docs, words))
    classes = checkpoint(signed.where(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.min("row").alias("least"), F.max("n_shingles").alias("n"), F.min("collections").alias("collections"), F.min("bits").alias("bits"))
        .withColumn("id", F.monotonically_increasing_id()))
    shared = checkpoint(shared_collections(classes))
    bounds = partial(may_be_near, percent=percent)
    tried = checkpoint(to_pivots(table_keys(shared).withColumn("root", F.col("id")), classes, bounds))
    wanted = classes.join(shared.select("id").distinct(), "id").select("id", F.col("least").alias("row"))
    texts = squeezed(docs, "text", "bytes")
    sets = checkpoint(full_sets(texts.join(wanted, "row").select("id", "bytes"), words).dropDuplicates(["id"]))
    links = checkpoint(confirmed(tried, sets, percent))
    roots = checkpoint(components(links))
    buckets = shared.select("id", F.xxhash64("at", "value").alias("bucket"), "at")
    rest = checkpoint(across(several_groups(buckets, roots), classes, bounds).join(tried, ["a", "b"], "left_anti"))
    more = checkpoint(confirmed(rest, sets, percent))
    if not more.isEmpty():
        roots = checkpoint(components(links.union(more)))
    named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("cls", F.coalesce("root", "id").alias("root"), F.col("least").alias("own"))
    by_class = named.join(named.groupBy("root").agg(F.min("own").alias("least")), "root").select("cls", "least")
    return signed.select("row", "n_shingles", "cls").join(by_class, "cls", "left").select("row", "n_shingles", F.coalesce("least", "row").alias("least"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (one row per document).

    Documents are linked when their shingle sets have a similarity of at least ``percent`` / 100; ``component_id`` is the
    smallest doc_id reachable. Texts without words are linked with nothing. A row with a null id takes the smallest
    id of its component, if there is one, and is never kept. All rows of the id that a component is named by are kept.
    """
    def id_of(c: str) -> Column:
        return F.when(~F.col(f"{c}.nameless"), F.col(f"{c}.id"))

    found = groups(docs, words, percent).select(id_of("row").alias("doc_id"), "n_shingles", id_of("least").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the first by id (null ids last) and text, with its columns. Documents without words all stay."""
    kept = groups(docs, words, percent).where("row = least").groupBy("row").agg(F.max("n_shingles").alias("_n"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _row(docs))
    met = named.join(kept, "row").withColumn("_at", F.row_number().over(Window.partitionBy("row").orderBy("row")))
    return met.where("_at = 1 OR _n = 0").select("_doc.*")


def several_groups(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the buckets whose classes are in several groups so far, with their group as root."""
    grouped = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = grouped.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    return checkpoint(grouped.join(mixed, "bucket"))


def _main(rows: DataFrame) -> DataFrame:
    """The largest group of each bucket, and one of its classes; which one differs between buckets, so that a class meets several."""
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("id", F.pmod("bucket", F.lit(8))), "id")).alias("one"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("members", "root", "one")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    return most.select("bucket", F.col("most.root").alias("main"), F.col("most.one.id").alias("c"))


def may_be_near(percent: int) -> Column:
    """Whether sets of sizes n and m and sketches bits and their_bits can be similar enough: exact bounds, they lose no pair."""
    differ = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("their_bits", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (differ * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("m")))


def to_pivots(rows: DataFrame, classes: DataFrame, bounds: Callable[[], Column]) -> DataFrame:
    """Pairs of each class outside its bucket's largest group with one class of that group; linear in the rows."""
    met = rows.join(_main(rows), "bucket").where(F.col("root") != F.col("main")).select("id", "c").distinct()
    own = met.join(classes.select("id", "n", "bits"), "id")
    both = own.join(classes.select(F.col("id").alias("c"), F.col("n").alias("m"), F.col("bits").alias("their_bits")), "c").where(bounds())
    return both.select(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")).distinct()


def across(rows: DataFrame, classes: DataFrame, bounds: Callable[[], Column]) -> DataFrame:
    """Pairs of classes in different groups that share at least two collections, each from the first that they share.

    The classes outside the largest group of a collection's value meet all classes of that value in other groups.
    """
    wide = rows.join(classes.select("id", "n", "collections", "bits"), "id")
    open_ = wide.join(_main(rows).select("bucket", "main"), "bucket")
    minor = open_.where("root <> main").select("bucket", F.col("id").alias("c"), F.col("n").alias("m"), F.col("root").alias("other"),
                                               F.col("collections").alias("theirs"), F.col("bits").alias("their_bits"))
    same = [F.get("collections", F.lit(k)) == F.get("theirs", F.lit(k)) for k in range(COLLECTIONS)]
    first, common = F.lit(True), sum((s.cast("int") for s in same), F.lit(0))
    for k, s in enumerate(same):
        first &= ~s | (F.col("at") <= k)
    met = open_.join(minor, "bucket").where((F.col("root") != F.col("other")) & bounds() & (common > 1) & first)
    return met.select(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")).distinct()
