"""Merkle manifest of a table: a hash tree per group of rows, and one over the groups.

Checkpoint-and-recompute: of each tree only every few levels are stored. A proof needs the levels
between, so each aligned subtree (the 16**EVERY nodes below a stored one) is rebuilt from its
stored descendants, gives its nodes' siblings, and is dropped again. Blocks are of that fixed
size whatever the size of a group, and paths are handed down from stored level to stored level.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitbook.columns import compute_once
from visitbook.llm.ordered_rows import ROW_BITS, group_key, in_order
from visitbook.session import settle

FANOUT = 16
# Levels between two stored ones.
EVERY = 2

STEP = "array<struct<before:string,after:string>>"


class Manifest(NamedTuple):
    """Stored levels, leaves first; each has tree, position, left (nodes of its level), digest."""

    items: list[DataFrame]   # one tree per group; leaves carry further columns
    groups: list[DataFrame]  # one tree; its leaves are the groups' roots, named by `name`
    root: str | None         # null for a table without rows


def field_text(value: Column) -> Column:
    """A value such that joined fields can be told apart: its bytes' number and itself, or `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Hexadecimal digest of a row's values in order."""
    return F.sha2(F.concat(*map(field_text, values)), 256)


def _numbered(items: DataFrame, order: list[str]) -> DataFrame:
    """Adds position (from 0) and left (rows of the tree), for trees of any size.

    Positions come from the rows before a stretch and the place within it; one row per tree
    and stretch is all that a window sees.
    """
    spark = items.sparkSession
    stored = in_order(items, ["tree", *order]).withColumn("stretch", F.shiftright("row", ROW_BITS))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("tree", "stretch")
        .agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(
            "tree", "stretch", F.sum("_n").over(tree).alias("left"),
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        )
    )
    placed = stored.join(settle(starts, spark, "stretches"), ["tree", "stretch"])
    return placed.withColumn("position", F.col("row") + F.col("_shift")).drop("row", "stretch", "_shift")


def _run_digests(nodes: str) -> Column:
    """Digests of consecutive runs of FANOUT nodes, the last one of fewer."""
    numbers = F.sequence(F.lit(0), F.expr(f"cast((size({nodes}) - 1) div {FANOUT} as int)"))
    return F.transform(numbers, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def _blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """One row per aligned subtree: its nodes in order, and the digests of all its levels.

    level_0 .. level_EVERY; a level that the tree does not have repeats the one below.
    """
    grouped = nodes.groupBy("tree", F.expr(f"position div {FANOUT**EVERY}").alias("block")).agg(
        F.max("left").alias("left"),
        F.array_sort(F.collect_list(F.struct("position", "digest", *carried))).alias("nodes"),
    )
    built = compute_once(grouped, {"level_0": F.transform("nodes", lambda n: n["digest"])})
    for level in range(EVERY):
        runs = F.when(F.col("left") > FANOUT**level, _run_digests(f"level_{level}")).otherwise(F.col(f"level_{level}"))
        built = compute_once(built, {f"level_{level + 1}": runs})
    return built


def build_trees(items: DataFrame, order: list[str]) -> list[DataFrame]:
    """Stored levels of the trees named by `tree`, whose leaves are `digest` in the given order.

    The last level has one node per tree, its root. Nodes of a level are hashed in runs of
    FANOUT, the last one of fewer, while several remain.
    """
    spark = items.sparkSession
    levels = [_numbered(items, order)]
    most = levels[0].agg(F.max("left")).first()[0] or 0
    while most > 1:
        up = _blocks(levels[-1]).select(
            "tree", F.col("block").alias("position"),
            F.ceil(F.col("left") / FANOUT**EVERY).cast("bigint").alias("left"), F.get(f"level_{EVERY}", F.lit(0)).alias("digest"),
        )
        levels.append(settle(up, spark, "level"))
        most = -(-most // FANOUT**EVERY)
    return levels


def build_manifest(
    spark: SparkSession, rows: DataFrame, group: Column, order: Column, digest: Column, carry: dict[str, Column] | None = None
) -> Manifest:
    """Trees of the rows' digests per group, ordered by `order` (nulls first), and their root.

    `digest` is the leaf of a row, as from `leaf_digest`. Rows of equal order stand by their
    digest, so equal rows give one result wherever they come from. Null is a group, the first.
    The columns in `carry` stay beside the leaves. The rows are read once.
    """
    extra = carry or {}
    named = {**{f"_{k}": c for k, c in extra.items()}, "tree": group_key(group), "place": order, "digest": digest}
    leaves = settle(rows.select(*[c.alias(k) for k, c in named.items()]), spark, "leaves")
    items = build_trees(leaves, ["place", "digest"])
    roots = items[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    groups = build_trees(roots, ["name"])
    top = groups[-1].first()
    return Manifest(items, groups, top["digest"] if top else None)


def _siblings(level: int, place: Column) -> Column:
    """The step of a subtree's node at one level: what stands before and after it in its run."""
    nodes = F.col(f"level_{level}")
    at = F.floor(place / FANOUT**level).cast("int")
    inside = at % FANOUT
    before = F.array_join(F.slice(nodes, at - inside + 1, inside), "")
    after = F.array_join(F.slice(nodes, at + 2, F.lit(FANOUT - 1) - inside), "")
    step = F.array(F.struct(before.alias("before"), after.alias("after")))
    return F.when(F.col("left") > FANOUT**level, step).otherwise(F.array().cast(STEP))


def _paths_below(nodes: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """Paths of a stored level from those of the next: the nodes with path and tree_root."""
    blocks = _blocks(nodes, *carried)
    met = blocks.join(above.withColumnRenamed("position", "block"), ["tree", "block"])

    def located(node: Column, place: Column) -> Column:
        steps = F.concat(*[_siblings(level, place) for level in range(EVERY)], F.col("path"))
        return F.struct(node["position"].alias("position"), node["digest"].alias("digest"),
                        *[node[c].alias(c) for c in carried], steps.alias("path"))

    found = met.select("tree", "tree_root", F.transform("nodes", located).alias("_nodes"))
    return found.select("tree", "tree_root", F.inline("_nodes"))


def tree_paths(levels: list[DataFrame], above: DataFrame, carried: list[str], wanted: Column | None = None) -> DataFrame:
    """The leaves with path: per level the siblings before and after, up to the tree's root.

    `above` has tree and path: what follows beyond each tree's root. `wanted`, a condition on
    the leaves, restricts the work to the subtrees that hold such leaves.
    """
    found = levels[-1].join(above, "tree").select("tree", "position", F.col("digest").alias("tree_root"), "path")
    if len(levels) == 1:
        leaves = levels[0].join(found, ["tree", "position"])
        return leaves if wanted is None else leaves.where(wanted)
    for level in levels[-2:0:-1]:
        found = _paths_below(level, found, []).drop("digest")
    leaves = levels[0]
    if wanted is None:
        return _paths_below(leaves, found, carried)
    block = F.expr(f"position div {FANOUT**EVERY}")
    asked = leaves.where(wanted).select("tree", block.alias("_block")).distinct()
    near = leaves.withColumn("_block", block).join(asked, ["tree", "_block"], "left_semi").drop("_block")
    return _paths_below(near, found, carried).where(wanted)


def proofs(manifest: Manifest, wanted: Column | None = None) -> DataFrame:
    """Every leaf with tree_root (its group's root), root, its carried columns and `path`.

    A path lists, level by level up to the root of all groups, the joined digests that stand
    before and after the node in its run. `wanted` is a condition on the carried columns, whose
    names have a leading underscore in the stored levels.
    """
    carried = [c for c in manifest.items[0].columns if c.startswith("_")]
    end = manifest.groups[-1].select("tree", F.array().cast(STEP).alias("path"))
    groups = tree_paths(manifest.groups, end, ["name"]).select(F.col("name").alias("tree"), "path")
    found = tree_paths(manifest.items, groups, carried, wanted)
    named = [F.col(c).alias(c[1:]) for c in carried]
    return found.select(*named, "digest", "tree_root", F.lit(manifest.root).cast("string").alias("root"), "path")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded_root(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to; equal to the manifest's if nothing was changed."""
    return F.aggregate(path, digest, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))
