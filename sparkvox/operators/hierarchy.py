"""Hierarchies (group I): paths, inherited flags, positions, open nodes and
leaves of a tree given as an adjacency table
``nodes(id, parent_id, label, key BIGINT, checked, disabled)``.

Trees are walked by pointer doubling. Every node points at an ancestor, first at
its parent, and holds what lies between (flags, depth, path). In a round it
takes over its ancestor's pointer and what that one holds, so the distance
doubles: a tree of depth D takes log2(D) + 1 rounds of one join, a chain of
10,000 nodes 14. In the same rounds every node's counts are added to the
ancestor it points at, which sums whole subtrees. A node that still points
somewhere after log2(number of nodes) + 1 rounds is in a cycle or below one.

Each round is written to the shared checkpoint folder and the one before it
deleted. A parent with very many children is split by adaptive execution in the
join and pre-aggregated per task in the sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparkvox.functions import lexicon as L
from sparkvox.operators.numbering import sums_before
from sparkvox.session import drop_folder, scratch_path

KEY_WIDTH = 19          # digits of a non-negative BIGINT


def _key(c) -> F.Column:
    return F.lpad(c.cast("string"), KEY_WIDTH, "0")


def _doubled(state: DataFrame, down: dict[str, Callable[[Column, Column], Column]], up: tuple[str, ...] = ()) -> DataFrame:
    """``state(id, jump, …)`` with ``jump`` the parent → the nodes that a root
    reaches. ``down`` says how a node's column goes with that of the ancestor it
    points at; the columns ``up`` are summed over subtrees."""
    spark = state.sparkSession
    state = state.withColumn("lost", F.lit(False))
    path, n, rounds = None, None, 0
    while True:
        seen = Observation()
        fresh = scratch_path(spark, "tree_round")
        (state.observe(seen, F.count(F.lit(1)).alias("n"), F.count("jump").alias("live")).write.parquet(fresh))
        if path:
            drop_folder(spark, path)
        path, state = fresh, spark.read.schema(state.schema).parquet(fresh)
        n = seen.get["n"]
        if not seen.get["live"] or rounds > n.bit_length():
            return state.where(F.col("jump").isNull() & ~F.col("lost")).drop("jump", "lost")
        above = state.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("lost").alias("_lost"),
                             *[F.col(c).alias(f"_{c}") for c in down])
        points, found = F.col("jump").isNotNull(), F.col("_id").isNotNull()
        joined = state.join(above, F.col("jump") == F.col("_id"), "left")
        new = joined.select(
            "id", F.col("_jump").alias("jump"),
            *[F.when(found, how(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c, how in down.items()],
            *up, (F.col("lost") | (points & ~found) | F.coalesce("_lost", F.lit(False))).alias("lost"))
        if up:
            sums = state.where(points).groupBy(F.col("jump").alias("_to")).agg(*[F.sum(c).alias(f"_{c}") for c in up])
            new = new.join(sums, F.col("id") == F.col("_to"), "left").select(
                *[c for c in new.columns if c not in up], *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in up])
        state = new.select(*state.columns)
        rounds += 1


def _either(mine: Column, theirs: Column) -> Column:
    return mine | theirs


def tree_marks(nodes: DataFrame) -> DataFrame:
    """Per node that a root reaches: ``depth``, inherited ``checked`` and
    ``disabled`` (own OR any ancestor's), ``own_checked``, ``n_nodes`` (of its
    subtree, itself included) and ``n_checked`` (own-checked ones there).
    Nothing in a row grows with the depth."""
    rows = nodes.select(
        "id", F.col("parent_id").alias("jump"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        "checked", "disabled", F.col("checked").alias("own_checked"),
        F.lit(1).cast("long").alias("n_nodes"), F.when(F.col("checked"), 1).otherwise(0).cast("long").alias("n_checked"))
    return _doubled(rows, {"depth": lambda a, b: a + b, "checked": _either, "disabled": _either, "own_checked": lambda a, b: a},
                    ("n_nodes", "n_checked"))


def tree_walk(nodes: DataFrame) -> DataFrame:
    """Every node with ``path`` (labels joined by '/'), ``depth``,
    ``preorder_key`` (zero-padded keys along the path: sorts the flattened
    tree), inherited ``checked``/``disabled``, and ``own_checked``. A path is
    as long as the node is deep; ``tree_marks`` and ``tree_positions`` do
    without. Nodes that no root reaches are not in the result: see
    ``tree_unreached``."""
    joined = lambda by: lambda a, b: F.concat(b, F.lit(by), a)
    # Without the nodes in cycles, whose paths would double in every round.
    reached = _doubled(nodes.select("id", F.col("parent_id").alias("jump")), {})
    rows = nodes.join(reached, "id").select(
        "id", F.col("parent_id").alias("jump"), F.col("label").alias("path"),
        F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), _key(F.col("key")).alias("preorder_key"),
        "checked", "disabled", F.col("checked").alias("own_checked"))
    return _doubled(rows, {"path": joined(L.TREE_DELIMITER), "depth": lambda a, b: a + b, "preorder_key": joined("."),
                           "checked": _either, "disabled": _either, "own_checked": lambda a, b: a})


def tree_positions(nodes: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """``tree_marks`` with ``position``, the node's place from 0 in the
    flattened tree (each node before its children, these by key, then id), and
    ``open`` (the node or any descendant is checked).

    A node comes after its parent and the subtrees of its earlier siblings.
    Sizes of these are summed among siblings, without a window over all of a
    parent's children, and the sums along each path by pointer doubling."""
    marks = tree_marks(nodes) if marks is None else marks
    sized = nodes.select("id", "parent_id", "key").join(marks.select("id", "n_nodes"), "id")
    placed = sums_before(sized, "parent_id", ["key", "id"], "n_nodes", "before")
    steps = placed.select("id", F.col("parent_id").alias("jump"),
                          (F.col("before") + F.when(F.col("parent_id").isNull(), 0).otherwise(1)).alias("position"))
    position = _doubled(steps, {"position": lambda a, b: a + b})
    return marks.join(position, "id").withColumn("open", F.col("checked") | (F.col("n_checked") > 0))


def tree_unreached(nodes: DataFrame, walk: DataFrame) -> DataFrame:
    """``(id, reason)`` of the nodes that no root reaches: ``orphan`` where
    the parent does not exist, ``below orphan or in a cycle`` otherwise. A
    walk from the roots never enters a cycle, as every node has one parent."""
    lost = nodes.filter(F.col("parent_id").isNotNull()).join(walk.select("id"), "id", "left_anti")
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    return lost.select("id", "parent_id").join(known, "parent_id", "left").select(
        "id", F.when(F.col("_known"), F.lit("below orphan or in a cycle")).otherwise(F.lit("orphan")).alias("reason")
    )


def tree_paths(walk: DataFrame) -> DataFrame:
    return walk.select("id", "path", "depth", "preorder_key")


def tree_inherit_flags(walk: DataFrame) -> DataFrame:
    return walk.select("id", "checked", "disabled")


def tree_open_nodes(walk: DataFrame, marks: DataFrame) -> DataFrame:
    """A node is open when it or any descendant is checked: it inherits a
    check, or its subtree holds a checked node."""
    held = marks.select("id", (F.col("n_checked") > 0).alias("held"))
    return walk.join(held, "id").select("id", "preorder_key", "checked", (F.col("checked") | F.col("held")).alias("open"))


def flat_positions(positions: DataFrame, mark: str) -> DataFrame:
    """Places in the flattened tree of the nodes with a ``mark`` (``checked`` or ``open``)."""
    return positions.where(F.col(mark)).select("position", "id")


def tree_leaves(walk: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaf mark (no children, by anti join), icon (folder/table), and for
    checked leaves the last path part (the selected leaf's name)."""
    parents = nodes.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct()
    leaves = walk.join(parents, "id", "left_anti").select("id").withColumn("is_leaf", F.lit(True))
    w = walk.join(leaves, "id", "left").withColumn("is_leaf", F.coalesce("is_leaf", F.lit(False)))
    return w.select(
        "id",
        "is_leaf",
        F.when(F.col("is_leaf"), F.lit("table")).otherwise(F.lit("folder")).alias("icon"),
        F.when(F.col("is_leaf") & F.col("checked"),
               F.element_at(F.split(F.col("path"), L.TREE_DELIMITER), -1)).alias("selected_leaf"),
    )
