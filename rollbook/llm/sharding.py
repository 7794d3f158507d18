"""Hierarchical weighted hash tree: a row descends region, rack and shard by weighted hash draws.

At every node each child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name; the least
draw wins. A child's draw depends on nothing but its own name and weight, so

* raising a weight moves rows only into that child's subtree, lowering it only out of that subtree;
* a shard added as a subtree of its own (``Tree.grown``) takes rows only into itself.

The placement is a column expression over constant arrays: no shuffle, no Python, and any number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import crc_text, numbered, unit


@dataclass(frozen=True)
class Tree:
    """Shard weights by region and rack; shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    def __post_init__(self):
        weights = [w for region in self.regions for rack in region for w in rack]
        if not weights or any(not w > 0 for w in weights) or any(not rack for region in self.regions for rack in region):
            raise ValueError("every rack needs a shard and every weight must be positive")

    @classmethod
    def even(cls, shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
        """``shards`` equal shards in full regions of ``racks`` x ``per_rack``; each shard left over is a region of its own."""
        full, rest = divmod(shards, racks * per_rack)
        region = tuple(tuple(1.0 for _ in range(per_rack)) for _ in range(racks))
        return cls((region,) * full + (((1.0,),),) * rest)

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a new region of its own."""
        return Tree((*self.regions, ((weight,),)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        """The tree with the weight of one shard changed."""
        at, out = 0, []
        for region in self.regions:
            racks = []
            for rack in region:
                racks.append(tuple(weight if at + i == shard else w for i, w in enumerate(rack)))
                at += len(rack)
            out.append(tuple(racks))
        return Tree(tuple(out))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _constant(levels: list[list[tuple[str, float, int]]]) -> Column:
    """For each node of a level, its children as (name, weight, index in the next level)."""
    child = lambda c: F.struct(F.lit(c[0]).alias("name"), F.lit(float(c[1])).alias("weight"), F.lit(c[2]).alias("at"))
    return F.array(*[F.array(*[child(c) for c in node]) for node in levels])


def _least(key: Column, children: Column) -> Column:
    draws = F.transform(children, lambda c: F.struct((-F.ln(unit(key, c["name"])) / c["weight"]).alias("draw"), c["at"].alias("at")))
    return F.array_min(draws)["at"]


def _children(tree: Tree) -> tuple[list, list, list]:
    """The root's regions, each region's racks, each rack's shards; a node's weight is the sum below it."""
    root, by_region, by_rack, rack_at, shard_at = [], [], [], 0, 0
    for r, region in enumerate(tree.regions):
        root.append((f"region{r}", sum(map(sum, region)), r))
        racks = []
        for k, rack in enumerate(region):
            racks.append((f"region{r}/rack{k}", sum(rack), rack_at))
            rack_at += 1
            by_rack.append([(f"region{r}/rack{k}/shard{s}", w, shard_at + s) for s, w in enumerate(rack)])
            shard_at += len(rack)
        by_region.append(racks)
    return [root], by_region, by_rack


def place(df: DataFrame, key: str, tree: Tree, out: str = "shard", levels: bool = False) -> DataFrame:
    """Add the shard of each row as ``out`` (int), and with ``levels`` also ``out_region`` and ``out_rack``.

    Equal keys share a shard; a null key is one key among others. All other columns are kept; ``out`` is replaced if present.
    """
    root, by_region, by_rack = _children(tree)
    region, rack = f"{out}_region", f"{out}_rack"
    placed = df.withColumn(region, _least(F.col(key), F.element_at(_constant(root), 1)))
    placed = placed.withColumn(rack, _least(F.col(key), F.element_at(_constant(by_region), F.col(region) + 1)))
    placed = placed.withColumn(out, _least(F.col(key), F.element_at(_constant(by_rack), F.col(rack) + 1)).cast("int"))
    return placed if levels else placed.drop(region, rack)


def shard_documents(docs: DataFrame, tree: Tree) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16. ``slot`` numbers the rows of a shard from 0 without gaps.
    Repeated ids share a shard and have slots of their own; columns other than doc_id and text are not looked at.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                       crc_text(F.col("text")).alias("text_crc32"))
    placed = place(place(rows, "doc_id", tree, "shard"), "doc_id", tree.grown(), "grown_shard")
    slotted = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
