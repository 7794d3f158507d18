"""Optimal string alignment distance.

Spark's ``levenshtein`` counts a swap of neighbours as two edits; the register's suggestions count it as one. The distance is a
column expression, so no pair leaves the JVM: one column of the edit matrix is two bit vectors of the shorter string's
length, and a character of the longer string moves to the next column by a few additions and shifts (bit-parallel
method of Myers and Hyyrö). What both strings begin or end with can't change the distance and is cut off first; strings that
are still longer than a 62-bit word are done in rows of the matrix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a vector: sums of two such vectors stay within a signed 64-bit number.
WORD = 62


def osa(a: str, b: str) -> int:
    """Restricted edit distance: insert, delete, replace, swap neighbours. The plain definition, for tests and single pairs."""
    older, prev = None, list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            best = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (ca != cb))
            if older is not None and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        older, prev = prev, row
    return prev[-1]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _common(a: Column, b: Column) -> Column:
    """How many leading characters two arrays share."""
    same = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"].eqNullSafe(z["y"]))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def _chars(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def _by_bits(a: Column, b: Column) -> Column:
    """Distance of two arrays of characters, the first of at most ``WORD``."""
    zero, m = F.lit(0).cast("long"), F.size(a)
    full = _power(m) - 1
    top = _power(m - 1)
    either = lambda x, y: x.bitwiseOR(y)
    both = lambda x, y: x.bitwiseAND(y)
    places = F.transform(a, lambda x, i: F.struct(x.alias("c"), _power(i).alias("bit")))
    masks = F.map_from_entries(F.transform(F.array_distinct(a), lambda c: F.struct(c, F.aggregate(
        places, zero, lambda s, p: s + F.when(p["c"] == c, p["bit"]).otherwise(zero)))))

    def distance(tools: Column) -> Column:
        whole, last = tools["full"], tools["top"]
        unlike = lambda x: F.bitwise_not(x).bitwiseAND(whole)

        def step(s: Column, c: Column) -> Column:
            def with_mask(pm: Column) -> Column:
                swap = both(both(F.shiftleft(both(unlike(s["d0"]), pm), 1), s["pm"]), whole)
                d0 = both(either(either(either(swap, (both(pm, s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])), pm), s["vn"]), whole)
                return _let(d0, lambda d: _let(F.struct(either(s["vn"], unlike(either(d, s["vp"]))).alias("hp"), both(d, s["vp"]).alias("hn")),
                            lambda h: _let(F.struct(both(either(F.shiftleft(h["hp"], 1), F.lit(1).cast("long")), whole).alias("hp"),
                                                    both(F.shiftleft(h["hn"], 1), whole).alias("hn")),
                            lambda k: F.struct(
                                either(k["hn"], unlike(either(d, k["hp"]))).alias("vp"), both(k["hp"], d).alias("vn"), d.alias("d0"), pm.alias("pm"),
                                (s["n"] + F.when(both(h["hp"], last) != 0, 1).when(both(h["hn"], last) != 0, -1).otherwise(0)).alias("n")))))
            return _let(F.coalesce(F.try_element_at(tools["masks"], c), zero), with_mask)

        start = F.struct(whole.alias("vp"), zero.alias("vn"), zero.alias("d0"), zero.alias("pm"), m.alias("n"))
        return F.aggregate(b, start, step)["n"]

    return F.when(m == 0, F.size(b)).otherwise(_let(F.struct(full.alias("full"), top.alias("top"), masks.alias("masks")), distance))


def _power(n: Column) -> Column:
    """2 to the ``n``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _by_rows(a: Column, b: Column) -> Column:
    """Distance of two arrays of characters of any length, a row of the matrix at a time."""
    n = F.size(b)

    def row(s: Column, ca: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            cb = F.element_at(b, j)
            plain = F.least(F.element_at(s["prev"], j + 1) + 1, F.element_at(done, -1) + 1, F.element_at(s["prev"], j) + F.when(ca == cb, 0).otherwise(1))
            swap = F.when((j > 1) & (F.size(s["older"]) > 0) & (ca == F.try_element_at(b, j - 1)) & (s["before"] == cb), F.try_element_at(s["older"], j - 1) + 1)
            return F.concat(done, F.array(F.least(plain, swap)))
        first = F.array(F.element_at(s["prev"], 1) + 1)
        return F.struct(s["prev"].alias("older"), F.aggregate(F.sequence(F.lit(1), n), first, cell).alias("prev"), ca.alias("before"))

    start = F.struct(F.array().cast("array<int>").alias("older"), F.sequence(F.lit(0), n).alias("prev"), F.lit(None).cast("string").alias("before"))
    return F.when(n == 0, F.size(a)).otherwise(F.element_at(F.aggregate(a, start, row)["prev"], -1))


def osa_distance(a, b) -> Column:
    """Restricted edit distance of two string columns; null where either is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)

    def trimmed(p: Column) -> Column:
        def without_end(q: Column) -> Column:
            k = _common(F.reverse(q["x"]), F.reverse(q["y"]))
            return F.struct(F.slice(q["x"], F.lit(1), F.size(q["x"]) - k).alias("x"), F.slice(q["y"], F.lit(1), F.size(q["y"]) - k).alias("y"))
        k = _common(p["x"], p["y"])
        rest = lambda c: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
        return _let(F.struct(rest(p["x"]).alias("x"), rest(p["y"]).alias("y")), without_end)

    pair = F.struct(_chars(short).alias("x"), _chars(long).alias("y"))
    found = _let(pair, lambda p: _let(trimmed(p), lambda q: F.when(F.size(q["x"]) <= WORD, _by_bits(q["x"], q["y"])).otherwise(_by_rows(q["x"], q["y"]))))
    near = F.levenshtein(a, b, 1)  # up to one edit both distances are the same
    return F.when(a.isNotNull() & b.isNotNull(), F.when(near >= 0, near).otherwise(found)).cast("int")


def delete_keys(c) -> Column:
    """Every string left after removing up to two characters.

    Two strings within distance two always share one of these keys, so an
    equi-join on them finds every close pair without comparing all pairs.
    """
    text = F.col(c) if isinstance(c, str) else c
    drop = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
    each = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: drop(s, i))) \
                      .otherwise(F.array().cast("array<string>"))
    one = F.array_distinct(each(text))
    two = F.flatten(F.transform(one, each))
    return F.array_distinct(F.concat(F.array(text), one, two))
