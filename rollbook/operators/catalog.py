"""The release catalogue: which dataset is current, append-only merging, verification.

Rows are ``release`` facts (release, source_hash, source_bytes, issues) and ``dataset``
facts (release, version, manifest_digest, bytes, tool_version, tool_git_sha, doi,
withdrawn); ``version`` is ``<release>_<major.minor.patch>``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import semver

HASH = "^sha256:[0-9a-f]{64}$"
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
COMMIT = "^[0-9a-f]{40}$"


def dataset_semver(version="version") -> Column:
    return semver(F.element_at(F.split(version, "_"), -1))


def select_version(datasets: DataFrame) -> DataFrame:
    """Per release the highest dataset not withdrawn, else the highest withdrawn."""
    rank = F.struct(F.col("withdrawn").isNull().alias("live"), dataset_semver().alias("semver"))
    return datasets.groupBy("release").agg(F.max_by(F.struct("version", "withdrawn"), rank).alias("d")).select(
        "release", "d.version", F.col("d.withdrawn").isNotNull().alias("is_withdrawn"))


def resolve_latest(datasets: DataFrame) -> DataFrame:
    """The newest release with a live dataset (``chosen``) and the newer withdrawn ones it skips."""
    best = select_version(datasets)
    newest = best.where("NOT is_withdrawn").agg(F.max("release")).scalar()
    return best.where(newest.isNull() | (F.col("release") >= newest)).select(
        "release", "version", F.when(F.col("is_withdrawn"), "skipped").otherwise("chosen").alias("outcome"))


def resolve_release(datasets: DataFrame, release: str) -> DataFrame:
    return select_version(datasets.where(F.col("release") == release))


_FIXED_RELEASE = ["source_hash", "source_bytes"]
_FIXED_DATASET = ["manifest_digest", "bytes", "tool_version", "tool_git_sha"]


def catalog_contradictions(old_releases: DataFrame, new_releases: DataFrame, old_datasets: DataFrame,
                           new_datasets: DataFrame) -> DataFrame:
    """Recorded facts a candidate would change: ``item, field, recorded, candidate``."""
    def differ(a, b, key, fields):
        both = a.select(*key, F.struct(*fields).alias("a")).join(b.select(*key, F.struct(*fields).alias("b")), key)
        rows = F.array_compact(F.array(*[F.when(F.col(f"a.{f}") != F.col(f"b.{f}"), F.struct(
            F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("recorded"),
            F.col(f"b.{f}").cast("string").alias("candidate"))) for f in fields]))
        return both.select(F.col(key[-1]).alias("item"), F.explode(rows).alias("d")).select("item", "d.*")
    return differ(old_releases, new_releases, ["release"], _FIXED_RELEASE).unionByName(
        differ(old_datasets, new_datasets, ["release", "version"], _FIXED_DATASET))


def merge_releases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Recorded releases kept, new ones added, issues only ever added."""
    a, b = old.alias("a"), new.alias("b")
    none = F.array().cast("array<string>")
    keep = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in _FIXED_RELEASE]
    issues = F.array_distinct(F.concat(F.coalesce("a.issues", none), F.coalesce("b.issues", none)))
    return a.join(b, F.col("a.release") == F.col("b.release"), "full_outer").select(
        F.coalesce("a.release", "b.release").alias("release"), *keep, issues.alias("issues"))


def merge_datasets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Recorded datasets kept, new ones added, empty ``doi`` and ``withdrawn`` filled in."""
    a, b = old.alias("a"), new.alias("b")
    on = (F.col("a.release") == F.col("b.release")) & (F.col("a.version") == F.col("b.version"))
    cols = ["release", "version", *_FIXED_DATASET, "doi", "withdrawn"]
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in cols])


def catalog_validate(releases: DataFrame, datasets: DataFrame) -> DataFrame:
    """Rows ``(item, problem)`` that break the catalogue's rules.

    ``release_pos`` and ``dataset_pos``, when present, give the listed order to check.
    """
    def problems(df, item, rules):
        rows = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(p)) for p, c in rules.items()]))
        return df.select(F.col(item).alias("item"), F.explode(rows).alias("problem"))
    many = lambda df, key, item, p: df.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").select(
        F.col(item).alias("item"), F.lit(p).alias("problem"))
    bad_issue = F.exists("issues", lambda i: ~i.rlike(SLUG)) | (F.size("issues") != F.size(F.array_distinct("issues")))
    parts = [
        problems(releases, "release", {
            "release is not a date": F.try_to_date("release", "yyyy-MM-dd").isNull(),
            "malformed source hash": ~F.col("source_hash").rlike(HASH),
            "source bytes not positive": F.col("source_bytes") <= 0, "malformed or repeated issue": bad_issue}),
        many(releases, ["release"], "release", "duplicate release"),
        many(datasets, ["release", "version"], "version", "duplicate dataset"),
        problems(datasets, "version", {
            "version does not extend its release": ~F.col("version").startswith(F.concat("release", F.lit("_")))
            | dataset_semver().isNull(),
            "malformed digest": ~F.col("manifest_digest").rlike(HASH), "bytes not positive": F.col("bytes") <= 0,
            "malformed tool version": semver("tool_version").isNull(), "malformed commit": ~F.col("tool_git_sha").rlike(COMMIT)}),
    ]
    def before(df, key, pos, value):
        """Each row with the value listed just before it, by an equi-join on the position."""
        keyed = df.select(*key, pos, value.alias("v")).distinct()
        prior = keyed.select(*key, (F.col(pos) + 1).alias(pos), F.col("v").alias("p"))
        return keyed.join(prior, [*key, pos])

    if "release_pos" in releases.columns:
        parts.append(before(releases, [], "release_pos", F.col("release")).where("v > p").select(
            F.col("v").alias("item"), F.lit("releases not newest first").alias("problem")))
    if "dataset_pos" in datasets.columns:
        value = F.struct(dataset_semver().alias("s"), "version")
        parts.append(before(datasets, ["release"], "dataset_pos", value).where("v.s < p.s").select(
            F.col("v.version").alias("item"), F.lit("datasets not oldest first").alias("problem")))
    return reduce(DataFrame.unionByName, parts)


def catalog_status(datasets: DataFrame, local: DataFrame, active: DataFrame) -> DataFrame:
    """Per dataset: withdrawn (why), active (local), local, or remote. ``local``/``active``: release."""
    flag = lambda df, name: df.select("release").distinct().withColumn(name, F.lit(True))
    joined = datasets.join(flag(local, "_local"), "release", "left").join(flag(active, "_active"), "release", "left")
    status = (F.when(F.col("withdrawn").isNotNull(), F.concat(F.lit("withdrawn ("), "withdrawn", F.lit(")")))
              .when(F.col("_active"), F.lit("active (local)")).when(F.col("_local"), F.lit("local"))
              .otherwise(F.lit("remote")))
    return joined.select("release", "version", status.alias("status"), "manifest_digest")


def bare_hash(c) -> Column:
    return F.regexp_replace(F.lower(c), "^sha256:", "")


def match_by_hash(files: DataFrame, releases: DataFrame, sha: str = "sha256") -> DataFrame:
    """Files whose bytes are a catalogued source, with its release."""
    known = releases.select("release", bare_hash("source_hash").alias("_h"))
    return files.withColumn("_h", bare_hash(sha)).join(known, "_h").drop("_h")


def verify_release(found: DataFrame, releases: DataFrame, datasets: DataFrame) -> DataFrame:
    """What each rebuilt release is: published, date unknown, different archive, version unpublished, different bytes.

    ``found``: release, version, source_hash, manifest_digest (rebuilt).
    """
    r = releases.select("release", F.col("source_hash").alias("_src"))
    d = datasets.select("release", "version", F.col("manifest_digest").alias("_digest"))
    joined = found.join(r, "release", "left").join(d, ["release", "version"], "left")
    verdict = (F.when(F.col("_src").isNull(), "date unknown")
               .when(F.col("_src") != F.col("source_hash"), "different archive")
               .when(F.col("_digest").isNull(), "version unpublished")
               .when(F.col("_digest") != F.col("manifest_digest"), "different bytes").otherwise("published"))
    return joined.select("release", "version", "manifest_digest", F.col("_digest").alias("published_digest"),
                         verdict.alias("verdict"))


def source_issues(releases: DataFrame) -> DataFrame:
    """Known issues, one row each."""
    return releases.select("release", F.explode("issues").alias("issue"))
