"""Near-miss suggestions for roles and places.

The score of an input against a candidate adds a whole-string part and a part per
word pair. Every scoring condition implies a shared key (an equal word, a word
prefix, a string left after two deletions, a three-character piece), so pairs are
found by equi-joins and only those are scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.distance import delete_keys, osa_distance
from rollbook.operators.search import _grams
from rollbook.runtime import checkpoint


def _close(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ``(a, b, dist)`` with distance at most two; ``left.a``, ``right.b`` distinct strings."""
    la = left.select("a", F.length("a").alias("la"), F.explode(delete_keys("a")).alias("key"))
    lengths = left.select(F.explode(F.array(*[F.length("a") + i for i in range(-2, 3)])).alias("lb")).distinct()
    rb = right.select("b", F.length("b").alias("lb")).join(lengths, "lb", "left_semi").select("b", "lb", F.explode(delete_keys("b")).alias("key"))
    rb = rb.join(la.select("key").distinct(), "key", "left_semi")
    pairs = la.join(rb, "key").where(F.abs(F.col("la") - F.col("lb")) <= 2).select("a", "b").distinct()
    pairs = pairs.where(F.levenshtein("a", "b", 4) >= 0)  # a swap is at most two plain edits
    return pairs.withColumn("dist", osa_distance("a", "b")).where("dist <= 2")


def word_scores(input_words: DataFrame, cand_words: DataFrame) -> DataFrame:
    """Score of each distinct word pair: equal 30, prefix 15, distance one 25, two 10."""
    heads = cand_words.select("b", F.explode(F.transform(F.sequence(F.lit(1), F.length("b")),
                                                         lambda n: F.substring("b", F.lit(1), n))).alias("a"))
    prefix = heads.join(input_words, "a", "left_semi").select("a", "b", F.when(F.col("a") == F.col("b"), 30)
                                                               .otherwise(15).alias("score"))
    near = _close(input_words, cand_words).join(prefix.select("a", "b"), ["a", "b"], "left_anti") \
        .select("a", "b", F.when(F.col("dist") <= 1, 25).otherwise(10).alias("score"))
    return prefix.unionByName(near)


def _contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` where one string contains the other."""
    def inside(small, s, large, t):
        short = small.where(F.length(s) > 0).select(s, F.substring(s, 1, 3).alias("gram"))
        grams = large.select(t, F.explode(_grams(F.col(t), [1, 2, 3])).alias("gram"))
        return grams.join(short, "gram").where(F.col(t).contains(F.col(s))).select("a", "b")
    return inside(left, "a", right, "b").union(inside(right, "b", left, "a")).distinct()


def score_pairs(inputs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(a, b, score)`` of every pair with a positive score; both sides lower-cased distinct strings."""
    left, right = checkpoint(inputs.select("a").distinct()), checkpoint(candidates.select("b").distinct())
    words = lambda df, c, w: df.select(c, F.explode(F.filter(F.split(c, "\\s+"), lambda x: x != "")).alias(w))
    lw, rw = words(left, "a", "aw"), words(right, "b", "bw")
    pairs = word_scores(lw.select(F.col("aw").alias("a")).distinct(), rw.select(F.col("bw").alias("b")).distinct()) \
        .withColumnsRenamed({"a": "aw", "b": "bw"})
    by_words = lw.join(pairs, "aw").join(rw, "bw").groupBy("a", "b").agg(F.sum("score").alias("part"))
    inside = _contained(left, right).select("a", "b", F.when(F.col("a") == F.col("b"), 100).otherwise(50).alias("part"))
    near = _close(left, right).join(inside, ["a", "b"], "left_anti") \
        .select("a", "b", F.when(F.col("dist") <= 1, 45).otherwise(20).alias("part"))
    return by_words.unionByName(inside).unionByName(near).groupBy("a", "b").agg(
        F.sum("part").cast("bigint").alias("score"))


def topk_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows per group with their ``rank``; Spark keeps only ``k`` per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def suggest_roles(inputs: DataFrame, vocab: DataFrame, k: int = 3, text: str = "role_input") -> DataFrame:
    """Top roles per input by score, then shorter name, then name."""
    typed = inputs.select(text, F.lower(text).alias("a"))
    names = vocab.select("role_code", "role_name", F.lower("role_name").alias("b"))
    scored = typed.join(score_pairs(typed, names), "a").join(names, "b")
    return topk_per_group(scored, [text], [F.col("score").desc(), F.octet_length("role_name"), "role_name", "role_code"],
                          k).select(text, "role_code", "role_name", "score", "rank")


def sector_candidates(inputs: DataFrame, counts: DataFrame, text: str = "place") -> DataFrame:
    """``"N1 1"`` -> N1 and N11, those of them that exist, in that order."""
    typed = F.trim(text)
    p1, p2 = F.split(typed, "\\s+")[0], F.try_element_at(F.split(typed, "\\s+"), F.lit(2))
    shape = typed.rlike("^(?:[A-Za-z][0-9][A-Za-z0-9]?|[A-Za-z]{2}[0-9][A-Za-z0-9]?|[A-Za-z][0-9]\\S\\S)\\s+[0-9][A-Za-z]{0,2}$")
    rows = inputs.where(shape).select(text, F.posexplode(F.array(F.upper(p1), F.upper(F.concat(p1, p2))))
                                      .alias("pos", "candidate"))
    keys = counts.select(F.upper("place_key").alias("candidate")).distinct()
    return rows.join(keys, "candidate", "left_semi").select(text, "candidate", (F.col("pos") + 1).alias("rank"))


def suggest_places(inputs: DataFrame, counts: DataFrame, k: int = 3, text: str = "place") -> DataFrame:
    """Top places per input: as roles, rare names dropped when common ones exist, +10 for very common ones.

    A typed postcode sector is answered by ``sector_candidates`` instead.
    """
    sectors = sector_candidates(inputs, counts, text)
    rest = inputs.join(sectors.select(text).distinct(), text, "left_anti")
    threshold = counts.agg(F.when(F.max("n") >= 50, F.lit(5)).otherwise(F.lit(0)).alias("least")).scalar()
    names = counts.where(F.col("n") >= threshold).select("place_key", "n", F.lower("place_key").alias("b"))
    typed = rest.select(text, F.lower(text).alias("a"))
    scored = typed.join(score_pairs(typed, names), "a").join(names, "b") \
        .withColumn("score", F.col("score") + F.when(F.col("n") >= 100, 10).otherwise(0))
    top = topk_per_group(scored, [text], [F.col("score").desc(), F.octet_length("b"), "place_key"], k)
    return top.select(text, F.col("place_key").alias("candidate"), "rank").unionByName(
        sectors.select(text, "candidate", "rank"))
