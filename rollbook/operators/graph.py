"""The succession graph: closures, hop chains, live successors.

Closures and walks are made by tasks that hold the part of the graph their roots are in, see ``parts``;
what is kept on the way is the graph itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators import parts
from rollbook.runtime import checkpoint

_EMPTY = "array<string>"
#: Numbers a bitmap holds; Spark's bitmap functions fix it.
BITS = 32_768


def direct_edges(successions: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` pairs of an edge table; NULL ends dropped."""
    return (successions.select(F.col("predecessor_code").alias("src"), F.col("successor_code").alias("dst"))
            .where("src IS NOT NULL AND dst IS NOT NULL").distinct())


@dataclass
class Closure:
    """Who reaches whom: ``nodes`` of a graph that tasks follow from slices of roots, see ``parts``."""
    nodes: DataFrame

    @property
    def sets(self) -> DataFrame:
        """(src, bucket, near): bitmaps of ``BITS`` numbers, as Spark's bitmap functions take them."""
        return parts.follow(self.nodes, parts.bitmaps(BITS), "src long, bucket long, near binary")

    def pairs(self, roots: DataFrame | None = None) -> DataFrame:
        """All ``(src, dst)`` with a path from ``src`` to another node ``dst``; only from the ``code`` of the few ``roots``, if any are given."""
        return parts.follow(self.nodes, parts.pairs("dst"), "code string, dst string", roots, roots is not None).toDF("src", "dst")

    def lists(self, out: str, entities: DataFrame | None = None) -> DataFrame:
        """``ods_code`` and the sorted list of codes each one reaches; ``[]`` for ``entities`` that reach none."""
        roots = None if entities is None else entities.select(F.col("ods_code").alias("code"))
        found = parts.follow(self.nodes, parts.lists(out), f"code string, {out} {_EMPTY}", roots).withColumnRenamed("code", "ods_code")
        return found if entities is None else found.unionByName(
            self._others(entities.select("ods_code")).withColumn(out, F.array().cast(_EMPTY)))

    def verify(self, stored: DataFrame, column: str) -> DataFrame:
        """Lists in the ``column`` of ``stored`` against what its ``ods_code`` reaches: one row per missing or extra member.

        A list is sent to the task that makes the true one, and only what differs leaves it.
        """
        rows = stored.select(F.col("ods_code").alias("code"), "ods_code", F.coalesce(column, F.array().cast(_EMPTY)).alias(column))
        work = parts.differences(column)
        found = parts.follow(self.nodes, work, "ods_code string, member string, problem string", rows, others=work)
        return found.select("ods_code", F.lit(column).alias("side"), "member", "problem")

    def _others(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.nodes.select(F.col("code").alias("ods_code")), "ods_code", "left_anti")


def closure_sets(edges: DataFrame) -> Closure:
    """The closure of ``edges`` (src, dst); NULL ends are not looked at."""
    return Closure(parts.nodes_of(edges))


def closure(edges: DataFrame) -> DataFrame:
    """All ``(src, dst)`` with a path from ``src`` to another node ``dst``; see ``closure_sets``."""
    return closure_sets(edges).pairs()


def reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All ``(root, node)`` pairs reachable from ``seeds`` along ``edges``; seeds included.

    A root is in its own set only where a seed says so.
    """
    seeds = seeds.select("root", "node").distinct()
    ahead = seeds.join(closure(edges).toDF("node", "far"), "node").where("far <> root").select("root", F.col("far").alias("node"))
    return seeds.union(ahead).distinct()


def successor_pairs(successions: DataFrame) -> DataFrame:
    """``(ods_code, successor_code)``: every entity each one became, itself excluded."""
    return closure(direct_edges(successions)).toDF("ods_code", "successor_code")


def predecessor_pairs(pairs: DataFrame) -> DataFrame:
    """The inverse of ``successor_pairs``; no second traversal."""
    return pairs.select(F.col("successor_code").alias("ods_code"), F.col("ods_code").alias("predecessor_code"))


def _for_entities(lists: DataFrame, out: str, entities: DataFrame) -> DataFrame:
    return entities.select("ods_code").join(lists, "ods_code", "left").withColumn(
        out, F.coalesce(out, F.array().cast(_EMPTY)))


def successor_lists(successions: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """``ods_code`` and its sorted ``successor_codes``, itself excluded; ``[]`` for ``entities`` without any."""
    return closure_sets(direct_edges(successions)).lists("successor_codes", entities)


def predecessor_lists(successions: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """``ods_code`` and its sorted ``predecessor_codes``: the closure the other way round."""
    return closure_sets(direct_edges(successions).toDF("dst", "src")).lists("predecessor_codes", entities)


def closure_list(pairs: DataFrame, member: str, out: str, entities: DataFrame | None = None) -> DataFrame:
    """Sorted code list per entity, the stored column form; ``[]`` for entities without any.

    The stored tables hold a list per row, so its size is a property of the register;
    work on the pair form where that is in doubt.
    """
    lists = pairs.groupBy("ods_code").agg(F.array_sort(F.collect_set(member)).alias(out))
    return lists if entities is None else _for_entities(lists, out, entities)


def _edge_facts(successions: DataFrame) -> DataFrame:
    """One edge per pair: the least succession id's date."""
    return (successions.where("predecessor_code IS NOT NULL AND successor_code IS NOT NULL")
            .groupBy(F.col("predecessor_code").alias("src"), F.col("successor_code").alias("dst"))
            .agg(F.min_by("legal_start", "succession_id").alias("date")))


def _segments(edges: DataFrame, growth: int = 8, longest: int = 8) -> DataFrame:
    """Simple paths of one edge up to a few, as long as all of them stay within ``growth`` times the edges."""
    tip = edges.select("src", "dst", F.array("dst").alias("segment"))
    found, allowed = tip, growth * edges.count()
    for _ in range(longest - 1):
        allowed -= tip.count()
        step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        tip = tip.join(step, "dst").where((F.col("next") != F.col("src")) & ~F.array_contains("segment", F.col("next"))).select(
            "src", F.col("next").alias("dst"), F.concat("segment", F.array("next")).alias("segment"))
        if tip.limit(allowed + 1).count() > allowed:
            break
        tip = checkpoint(tip)
        found = found.unionByName(tip)
    return checkpoint(found)


def _least_paths(edges: DataFrame) -> DataFrame:
    """(root, node, path): of all paths of ``edges`` (src, dst) without repeats, the least to every node.

    A round extends only the paths that improved, by every simple segment of a few edges at once, and one aggregate keeps
    the least path per (root, node). That holds with cycles: the prefix of a least simple path is itself least. Tests
    compare walks with it; its work grows with the paths, so no query does.
    """
    segments = _segments(edges)
    none = F.lit(None).cast(segments.schema["segment"].dataType)
    first = edges.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.array("dst").alias("path"))
    best = checkpoint(first.withColumn("improved", F.lit(True)))
    while not (frontier := best.where("improved")).isEmpty():
        longer = (frontier.join(segments, F.col("node") == F.col("src"))
                  .where(~F.array_contains("segment", F.col("root")) & ~F.arrays_overlap("path", "segment"))
                  .select("root", F.col("dst").alias("node"), F.concat("path", "segment").alias("path"), none.alias("old")))
        least = best.select("root", "node", "path", F.col("path").alias("old")).unionByName(longer).groupBy("root", "node").agg(
            F.min("path").alias("path"), F.min("old").alias("old"))
        best = checkpoint(least.select("root", "node", "path", F.expr("old IS NULL OR path < old").alias("improved")))
    return best.select("root", "node", "path")


def _walked(successions: DataFrame, orgs: DataFrame) -> DataFrame:
    """The nodes of the succession graph with what is shown of them: every name an entity has, in the order of its JSON."""
    nodes = parts.nodes_of(_edge_facts(successions))
    name, status = F.coalesce("name", F.lit("")), F.coalesce("status", F.lit("unknown"))
    own = lambda code, name, status: F.struct(
        F.to_json(F.struct(name.alias("name"), status.alias("status"))).alias("json"), name.alias("name"), status.alias("status"),
        F.coalesce(F.nullif(name, F.lit("")), code).alias("shown"), (F.lower(status) == "active").alias("active"))
    names = nodes.select("code").join(orgs.select(F.col("ods_code").alias("code"), name.alias("name"), status.alias("status")), "code").groupBy("code").agg(
        F.array_sort(F.collect_list(own(F.col("code"), F.col("name"), F.col("status")))).alias("names"))
    unknown = F.array(own(F.col("code"), F.lit(""), F.lit("unknown")))
    return nodes.join(names, "code", "left").withColumn("names", F.coalesce("names", unknown))


def succession_walk(successions: DataFrame, orgs: DataFrame, roots: DataFrame | None = None, paths: bool = False) -> DataFrame:
    """Hops of every root in depth-first order: ``ods_code, depth, hop_date, hop_code, hop_name, hop_status, place`` and maybe ``path``.

    Edges leave a node in successor-code order, so a depth-first walk's first visit of a node is along the least path without
    repeats, compared element by element. The task that walks from a root returns its hops: walks behind the edges out of its
    cycles are remembered from other roots of the slice, and paths are made a batch at a time.
    """
    out = "code string, depth int, hop_date date, hop_code string, hop_name string, hop_status string, place long" + (", path array<string>" if paths else "")
    wanted = None if roots is None else roots.select(F.col("ods_code").alias("code")).distinct()
    return parts.follow(_walked(successions, orgs), parts.hops(paths), out, wanted, roots is not None).withColumnRenamed("code", "ods_code")


def succession_chain(successions: DataFrame, orgs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``succession_walk`` with the path of each hop: ``ods_code, depth, hop_date, hop_code, hop_name, hop_status, path``."""
    return succession_walk(successions, orgs, roots, paths=True).drop("place")


def succession_runs(successions: DataFrame, orgs: DataFrame, part_rows: int) -> tuple[DataFrame, Callable[[DataFrame, bool], DataFrame]]:
    """What ``profile.profile_documents`` needs of the walks: ``ods_code, hops`` counts, and lists of hops for rows of entities.

    Rows have ``code, before, total`` and strings ``ods_code, head``; see ``parts.runs``.
    """
    nodes = checkpoint(_walked(successions, orgs))
    counts = parts.follow(nodes, parts.counts, "code string, hops long").withColumnRenamed("code", "ods_code")
    hop = "struct<depth: int, date: date, code: string, name: string, status: string>"
    return counts, lambda rows, inner: parts.follow(
        nodes, parts.runs(part_rows, inner), f"code string, before long, total long, ods_code string, head string, part int, hops array<{hop}>",
        rows.select("code", "before", "total", "ods_code", "head")).drop("code")


def direct_predecessors(successions: DataFrame, orgs: DataFrame) -> DataFrame:
    """One hop back per edge, with date, name and status."""
    names = orgs.select(F.col("ods_code").alias("hop_code"), F.col("name").alias("n"), F.col("status").alias("s"))
    rows = successions.where("predecessor_code IS NOT NULL AND successor_code IS NOT NULL").select(
        F.col("successor_code").alias("ods_code"), F.col("legal_start").alias("hop_date"),
        F.col("predecessor_code").alias("hop_code"), "succession_id")
    return rows.join(names, "hop_code", "left").select(
        "ods_code", "hop_date", "hop_code", F.coalesce("n", F.lit("")).alias("hop_name"),
        F.coalesce("s", F.lit("unknown")).alias("hop_status"), "succession_id")


def closed_scope(orgs: DataFrame) -> DataFrame:
    """Entities a live successor is looked up for: inactive, or with an operational end."""
    return orgs.where(F.col("operational_end").isNotNull() | (F.lower("status") == "inactive")).select("ods_code")


def live_successor_pairs(successions: DataFrame, orgs: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Walk forward through closed entities and stop at active ones: ``ods_code, node, name, live``.

    An entity's own self-loop counts as one closed hop; a later return to it does not.
    """
    scope = closed_scope(orgs) if scope is None else scope
    state = orgs.select(F.col("ods_code").alias("code"), F.col("name"), F.lower("status").alias("state"))
    edges = direct_edges(successions)
    seeds = edges.join(scope.select(F.col("ods_code").alias("src")), "src", "left_semi") \
        .select(F.col("src").alias("root"), F.col("dst").alias("node"))
    active = state.where("state = 'active'").select(F.col("code").alias("src"))
    pairs = reach(seeds, edges.join(active, "src", "left_anti"))
    return pairs.join(state, F.col("node") == F.col("code"), "left").select(
        F.col("root").alias("ods_code"), "node", F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce(F.col("state") == "active", F.lit(False)).alias("live"))


def live_successors(pairs: DataFrame) -> DataFrame:
    """Per entity: live successor count, closed entities passed, and the sorted live codes."""
    return pairs.groupBy("ods_code").agg(
        F.array_sort(F.collect_set(F.when(F.col("live"), F.col("node")))).alias("live_codes"),
        F.count_if(~F.col("live")).alias("hops"))


def successor_label(chain: DataFrame) -> DataFrame:
    """``"Name +2"``: first active hop (else first hop) in walk order, and how many more there are."""
    order = "place" if "place" in chain.columns else "path"
    active = F.lower("hop_status") == "active"
    shown = F.coalesce(F.nullif("hop_name", F.lit("")), F.col("hop_code"))
    return _label(chain.groupBy("ods_code").agg(
        F.min_by(F.when(active, shown), F.when(active, F.col(order))).alias("live"), F.count_if(active).alias("n_live"),
        F.min_by(shown, order).alias("any"), F.count("*").alias("n_any")))


def successor_labels(successions: DataFrame, orgs: DataFrame) -> DataFrame:
    """``successor_label`` of every entity without its hops: a walk ends at the first active one, hops are counted as bits."""
    out = "code string, live string, n_live long, any string, n_any long"
    return _label(parts.follow(_walked(successions, orgs), parts.firsts, out).withColumnRenamed("code", "ods_code"))


def _label(per: DataFrame) -> DataFrame:
    name = F.when(F.col("n_live") > 0, F.col("live")).otherwise(F.col("any"))
    more = F.when(F.col("n_live") > 0, F.col("n_live")).otherwise(F.col("n_any")) - 1
    return per.select("ods_code", F.when(more > 0, F.concat(name, F.lit(" +"), more.cast("string"))).otherwise(name)
                      .alias("successor_label"))


def live_descendants(orgs: DataFrame, code: str) -> DataFrame:
    """Active entities whose predecessor list holds ``code``."""
    return orgs.where((F.col("status") == "active") & F.array_contains("predecessor_codes", code)).select(
        "ods_code", "name")


def live_descendants_of(orgs: DataFrame, successions: DataFrame, code: str) -> DataFrame:
    """``live_descendants`` where no lists are stored: active entities that ``code`` reaches; no other closure is made."""
    root = successions.sparkSession.createDataFrame([(code,)], "code string")
    reached = closure_sets(direct_edges(successions)).pairs(root).select(F.col("dst").alias("ods_code"))
    return orgs.where("status = 'active'").join(reached, "ods_code").select("ods_code", "name")


def closure_verify_lists(orgs: DataFrame, successors: DataFrame, predecessors: DataFrame) -> DataFrame:
    """Stored lists against recomputed ones: one row per missing or extra member.

    ``successors`` and ``predecessors`` hold the true lists by ``ods_code``. Two lists of an entity are compared as sets, so
    only what differs leaves its row. ``side`` says which stored column is wrong.
    """
    def compare(column: str, truth: DataFrame) -> DataFrame:
        none = F.array().cast(_EMPTY)
        both = orgs.select("ods_code", F.coalesce(column, none).alias("stored")).join(truth.select("ods_code", F.col(column).alias("true")), "ods_code", "left")
        want = F.coalesce("true", none)
        beyond = F.array_except("stored", want)
        extra = F.when(F.size(beyond) > 0, F.filter("stored", lambda x: x.isNull() | F.coalesce(F.array_contains(beyond, x), F.lit(False)))).otherwise(none)
        tagged = lambda members, what: F.transform(members, lambda m: F.struct(m.alias("member"), F.lit(what).alias("problem")))
        found = F.concat(tagged(F.array_except(want, "stored"), "missing"), tagged(extra, "extra"))
        return both.select("ods_code", F.lit(column).alias("side"), F.explode(found).alias("x")).select("ods_code", "side", "x.member", "x.problem")
    return compare("successor_codes", successors).unionByName(compare("predecessor_codes", predecessors))


def closure_verify_stored(orgs: DataFrame, successions: DataFrame) -> DataFrame:
    """``closure_verify_lists`` against closures that are made where they are compared."""
    edges = direct_edges(successions)
    return closure_sets(edges).verify(orgs, "successor_codes").unionByName(
        closure_sets(edges.toDF("dst", "src")).verify(orgs, "predecessor_codes"))


def closure_verify(orgs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``closure_verify_lists`` against recomputed pairs."""
    return closure_verify_lists(orgs, closure_list(pairs, "successor_code", "successor_codes"),
                                closure_list(predecessor_pairs(pairs), "predecessor_code", "predecessor_codes"))


def self_loops(successions: DataFrame) -> DataFrame:
    return successions.where(F.col("predecessor_code") == F.col("successor_code"))
