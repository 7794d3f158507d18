"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

A text is read as words of letters and digits, three times: literally (lower case), as a template in which numbers, names
(capitalised words inside a sentence) and units after a number become typed placeholders, and as a wide template in which
every capitalised word is a name, those that begin a sentence too. Windows of ``WINDOW`` words of
each reading are joined by hash with those of the benchmark. A window that matches as a template fills slots: along one
alignment of document and item, a value of the item must always be filled by the same value, else the template matches of this
alignment do not count. Wide templates count if they and the others of their alignment agree, and never make others fail. A document leaks an item when the matched windows are at least ``SHARE`` of the item's.

Documents are read twice. The first reading keeps only keys, and finds the few documents in which enough windows of an item stand;
slots are looked up in those alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.runtime import checkpoint

WINDOW, SHARE = 8, 0.5
#: Least words of a template window of ``WINDOW`` words that are no placeholders; in proportion, rounded up, for shorter ones.
LITERALS = 4
#: Rows up to which the table of benchmark windows (24 bytes and a few words a row), or that of suspects (an id and a hash), is sent to every
#: executor; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"  # private characters, blanked in the input
# fixed values: unit names read as units after a number
UNITS = ("mm cm m km in ft yd mi mg g kg t lb oz ml cl l s ms min h hr hrs sec day days hour hours minute minutes second seconds week weeks "
         "month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches "
         "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars euro euros cent cents usd eur "
         "gbp percent degrees kmh mph hz khz mhz ghz kb mb gb tb w kw v a").split()
# fixed values: number words
NUMBERS = ("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
           "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def _spaced(c: Column, keep: str = "") -> Column:
    return F.regexp_replace(c, rf"[^a-z\p{{L}}\p{{N}}{keep}]+", " ")


def _split(c: Column) -> Column:
    flat = F.trim(F.lower(c))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def _plain(text: Column) -> Column:
    own = F.coalesce(text, F.lit(""))
    marked = F.contains(own, F.lit(NUMBER)) | F.contains(own, F.lit(NAME)) | F.contains(own, F.lit(UNIT))
    return F.when(marked, F.translate(own, NUMBER + NAME + UNIT, "   ")).otherwise(own)


def n_words(text: Column) -> Column:
    """The number of words of a text; null reads as empty."""
    return F.size(_split(_spaced(_plain(text))))


def readings(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys with _words, the words of a text, and at the same places _template and _wide, those of its templates; null reads as empty.

    Patterns begin with what they take and look back from there, so most characters are passed at the first test.
    """
    t = F.regexp_replace("_own", r"\p{Lu}(?<=[\p{L}\p{N},;:]\s\p{Lu})\p{L}*", NAME)
    begin = "".join(sorted({w[0] + w[0].upper() for w in NUMBERS}))
    t = F.regexp_replace(t, rf"(?=[{begin}\p{{N}}]){_EDGE}(?:\p{{N}}+|(?i:{'|'.join(NUMBERS)})){_END}", NUMBER)
    t = F.regexp_replace(t, rf"({NUMBER}\s)(?i:{'|'.join(UNITS)}){_END}", f"$1{UNIT}")
    wide = F.regexp_replace("_form", r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{L}*", NAME)
    return (rows.select(*keys, _plain(F.col(text)).alias("_own"))
            .select(*keys, _spaced(F.col("_own")).alias("_flat"), _spaced(t, NUMBER + NAME + UNIT).alias("_form"))
            .select(*keys, _split(F.col("_flat")).alias("_words"), _split(F.col("_form")).alias("_template"), _split(wide).alias("_wide")))


def _placeholder(x: Column) -> Column:
    return F.substring(x, 1, 1).isin(NUMBER, NAME, UNIT)


_WINDOWS = "array<struct<pos:int,size:int,key:bigint,slots:array<string>,wide:boolean>>"


READ = ["_words", "_template", "_wide"]


def _hashed(read: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """``keep`` with the array of window keys of each reading and size, as ``<reading>_<size>``; keys of different sizes are hashes of different shapes.

    Hashes of 1, 2, 4, ... words are made by pairing those of half as many words; other sizes are joined from them.
    A template of another number of words than its text (a placeholder that stands on part of a word) has no windows.
    """
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    later = lambda c, n: F.slice(c, n + 1, F.size(c)) if n else F.col(c)
    made = read.select(*keep, F.size("_words").alias("_n"), *[
        F.when(F.size(c) == F.size("_words"), F.transform(c, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")).alias(f"{c}_p1") for c in READ])
    span = 1
    while 2 * span <= max(sizes):
        made = made.select("*", *[pair(F.col(f"{c}_p{span}"), later(f"{c}_p{span}", span)).alias(f"{c}_p{2 * span}") for c in READ])
        span *= 2

    def joined(c: str, size: int) -> Column:
        parts, at = [], 0
        for p in (1 << k for k in reversed(range(size.bit_length())) if size >> k & 1):
            parts.append(later(f"{c}_p{p}", at))
            at += p
        out = parts[0]
        for other in parts[1:]:
            out = pair(out, other)
        whole = F.slice(out, 1, F.greatest(F.col("_n") - size + 1, F.lit(0)))
        return F.when(F.size(f"{c}_p1") == F.col("_n"), whole).otherwise(F.array().cast("array<bigint>"))

    return made.select(*keep, *[joined(c, n).alias(f"{c}_{n}") for n in sizes for c in READ])


def _windows_of(size: int) -> Column:
    """The windows of ``size`` words: all of them literally, and those with placeholders as templates."""
    least = -(-LITERALS * min(size, WINDOW) // WINDOW)

    def part(c: str, i: Column) -> Column:
        return F.slice(c, i + 1, size)

    def filled(c: str, i: Column) -> Column:
        literals = F.size(F.array_remove(part(c, i), 1))
        return (literals < size) & (literals >= least)

    def slots(c: str, i: Column) -> Column:
        both = F.arrays_zip(part(c, i).alias("t"), part("_words", i).alias("w"))
        return F.transform(F.filter(both, lambda z: _placeholder(z["t"])), lambda z: z["w"])

    def keyed(c: str, asked: Callable[[Column], Column] | None, wide: bool) -> Column:
        keys = F.transform(f"{c}_{size}", lambda k, i: F.struct(i.alias("pos"), k.alias("key")))
        keys = keys if asked is None else F.filter(keys, lambda z: asked(z["pos"]))
        none = F.lit(None).cast("array<string>")
        every = F.transform(keys, lambda z: F.struct(z["pos"].alias("pos"), F.lit(size).alias("size"), z["key"].alias("key"),
                                                     (slots(c, z["pos"]) if asked else none).alias("slots"), F.lit(wide).alias("wide")))
        return every.cast(_WINDOWS)

    empty = F.array().cast(_WINDOWS)
    forms = keyed("_template", lambda i: filled("_template_slots", i), False)
    wides = keyed("_wide", lambda i: F.array_contains(part("_more", i), 1) & filled("_wide_slots", i), True)
    return F.concat(keyed("_words", None, False), F.when(F.array_contains("_template_slots", 1), forms).otherwise(empty),
                    F.when(F.array_contains("_more", 1), wides).otherwise(empty))


def windows(rows: DataFrame, keys: list[str], text: str, sizes: list[int]) -> DataFrame:
    """keys, pos, size, key, slots and wide of each window of each reading; slots, the words behind the placeholders, are null for literal
    windows; a window is wide if only the wide template has it so."""
    marks = [F.transform(c, lambda w: _placeholder(w).cast("int")).alias(f"{c}_slots") for c in READ[1:]]
    more = F.zip_with("_template", "_wide", lambda a, b: (a != b).cast("int")).alias("_more")
    made = _hashed(readings(rows, keys, text).select(*keys, *READ, *marks, more), [*keys, *READ, "_template_slots", "_wide_slots", "_more"], sizes)
    return made.select(*keys, F.inline(F.concat(*[_windows_of(n) for n in sizes])))


def suspects(docs: DataFrame, asked: DataFrame, sizes: list[int], share: float) -> DataFrame:
    """doc_id and row of the documents in which at least ``share`` of some item's windows read the same in any reading.

    No document that leaks is left out, as slots can only take windows away. A document's keys become rows of their own, without its words.
    """
    keyed = _hashed(readings(docs, ["doc_id", "row"], "text"), ["doc_id", "row"], sizes)
    rows = keyed.select("doc_id", "row", F.explode(F.concat(*[f"{c}_{n}" for n in sizes for c in READ])).alias("key"))
    met = rows.join(asked, "key").groupBy("doc_id", "row", "item", "at").agg(F.max("windows").alias("windows"))
    near = met.groupBy("doc_id", "row", "item").agg(F.count("*").alias("n"), F.max("windows").alias("windows"))
    return near.where(F.col("n") >= share * F.col("windows")).select("doc_id", "row").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, matched, windows, templated: the items that each document leaks.

    An item shorter than a window is one window of its own length; null and empty texts leak nothing. Items of
    equal text are compared once and all reported. A document id that stands on several rows is judged row by row, and reported once an item.
    """
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    distinct = checkpoint(items.groupBy("text").agg(F.min("item_id").alias("item")))
    sized = distinct.select(n_words(F.col("text")).alias("n")).where("n > 0")
    sizes = [r[0] for r in sized.select(F.least("n", F.lit(window)).alias("n")).distinct().collect()]  # at most ``window`` values
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not sizes:
        return docs.limit(0).select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("matched"),
                                    F.lit(0).alias("windows"), F.lit(False).alias("templated")).withColumn("doc_id", F.col("doc_id").cast(kind))
    every = windows(distinct.select("text", F.col("item"), n_words(F.col("text")).alias("n")), ["item", "n"], "text", sorted(sizes))
    # an item's own window length, and one row for each of its windows that reads the same
    asked = checkpoint(every.where(F.col("size") == F.least("n", F.lit(window)))
                       .select("item", F.col("pos").alias("at"), (F.col("n") - F.col("size") + 1).alias("windows"), "size", "key", F.col("slots").alias("values"), F.col("wide").alias("asked_wide")))
    small = asked.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").where(F.col("text").isNotNull())
    fits = lambda a, b: a.eqNullSafe(b)
    plain = asked.select("key", "item", "at", "windows").distinct()
    near = checkpoint(suspects(texts, F.broadcast(plain) if small else plain, sorted(sizes), share))
    few = near.count() <= BROADCAST_ROWS
    near = near.select(F.col("doc_id").alias("s_doc"), F.col("row").alias("s_row"))
    own = windows(texts.join(F.broadcast(near) if few else near, fits(F.col("doc_id"), F.col("s_doc")) & (F.col("row") == F.col("s_row")), "left_semi"), ["doc_id", "row"], "text", sorted(sizes))
    hits = checkpoint(own.join(F.broadcast(asked) if small else asked, ["key", "size"])
                      .where(F.col("slots").isNull() == F.col("values").isNull())
                      .select("doc_id", "row", "item", (F.col("pos") - F.col("at")).alias("shift"), "at", "windows", "slots", "values",
                              (F.col("wide") | F.col("asked_wide")).alias("wide")))
    line = ["doc_id", "row", "item", "shift"]
    pairs = hits.where(F.col("slots").isNotNull()).select(*line, "wide", F.inline(F.arrays_zip("values", "slots")))
    fills = pairs.groupBy(*line, "values", "slots").agg(F.min("wide").alias("wide")).groupBy(*line, "values").agg(
        F.count("*").alias("fills"), F.count_if(~F.col("wide")).alias("narrow"))
    wrong = fills.where("fills > 1").groupBy(*line).agg((F.max("narrow") > 1).alias("w_all"))
    bad = wrong.select(*[F.col(c).alias(f"w_{c}") for c in line], "w_all")
    sound = hits.where(F.col("slots").isNull()).unionByName(
        hits.where(F.col("slots").isNotNull()).join(bad, [fits(F.col(c), F.col(f"w_{c}")) for c in line], "left")
        .where(F.col("w_all").isNull() | ~F.col("wide") & ~F.col("w_all")).drop("w_all", *[f"w_{c}" for c in line]))
    per_window = sound.groupBy("doc_id", "row", "item", "at").agg(F.max("windows").alias("windows"), F.min(F.col("slots").isNotNull()).alias("templated"))
    found = (per_window.groupBy("doc_id", "row", "item").agg(F.count("*").cast("int").alias("matched"), F.max("windows").alias("windows"), F.max("templated").alias("templated"))
             .where(F.col("matched") >= share * F.col("windows")))
    best = found.groupBy("doc_id", "item").agg(F.max("matched").alias("matched"), F.max("windows").alias("windows"), F.min("templated").alias("templated"))
    named = distinct.withColumnRenamed("item", "_item").join(items, "text").select("_item", "item_id")
    return best.join(named, F.col("item").eqNullSafe(F.col("_item"))).select("doc_id", "item_id", "matched", "windows", "templated").distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The documents that leak no item, with all their columns. Ids that stand on several rows go or stay together; null ids stay
    unless a row with a null id leaks."""
    out = leaks(docs, benchmark, window, share).select("doc_id").distinct()
    return docs.alias("all").join(out.alias("out"), F.col("all.doc_id").eqNullSafe(F.col("out.doc_id")), "left_anti")
