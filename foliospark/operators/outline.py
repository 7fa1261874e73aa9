"""Outlines: trees of titled nodes as flat tables with level, reading order and target page, of any depth.

Levels come from pointer doubling: each round a node learns of the ancestor twice as far up, so that a chain of 10,000 nodes takes 14 rounds. Reading order
(parents before children, siblings by `ord`) comes from the tour round the tree: every node is entered and left once, each step knows its
successor, and doubling counts the entrances that are still to come. Rounds read and write tables in the shared folder; settled rows leave them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import normalised
from foliospark.plans.order import with_next
from foliospark.plans.shared import written

UNTITLED = "(Untitled)"


@dataclass(frozen=True)
class Outline:
    """nodes (outline_id, node_id, parent_id, title, level, position, page_index): level and position from 0, position within the outline.
    rejected (outline_id, node_id, parent_id, reason): `no id`, `repeated id`, `orphan` (its parent, or that of an ancestor, is missing) or `cycle`."""

    nodes: DataFrame
    rejected: DataFrame


def titled(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("title", F.coalesce(F.nullif(normalised(F.col("title")), F.lit("")), F.lit(UNTITLED)))


def climbed(nodes: DataFrame, key: list[str], path: bool = False) -> DataFrame:
    """nodes (key + node_id + parent_id, distinct) with level, root_parent (what is missing above the topmost ancestor: null for a proper root) and, if asked for,
    path (ids from the root, by slashes); nodes in or under a cycle have no level."""
    up = [*key, "node_id"]
    own = F.col("node_id").cast("string") if path else F.lit(None).cast("string")
    start = nodes.select(*up, F.col("parent_id").alias("to"), F.lit(0).cast("long").alias("level"), own.alias("path"))
    ids = nodes.select(*up).withColumnRenamed("node_id", "to").withColumn("known", F.lit(True))
    # a missing parent ends a climb as a null one does, but is remembered
    now = written(start.join(ids, [*key, "to"], "left").select(*up, F.when(F.col("known"), F.col("to")).alias("to"), F.when(F.col("known").isNull(), F.col("to")).alias("root_parent"), "level", "path"), "climb")
    most, reach, done = nodes.count(), 1, None
    while True:
        settled, going = now.filter("to IS NULL"), now.filter("to IS NOT NULL")
        if reach > most or going.isEmpty():
            return now.withColumn("level", F.when(F.col("to").isNull(), F.col("level"))).drop("to")
        above = now.select(*key, F.col("node_id").alias("to"), F.col("to").alias("_to"), F.col("root_parent").alias("_root"), F.col("level").alias("_level"), F.col("path").alias("_path"))
        step = F.lit(reach).cast("long")  # a climber that goes on stands `reach` above its node
        moved = going.join(above, [*key, "to"]).select(
            *up, F.col("_to").alias("to"), F.col("_root").alias("root_parent"), (step + F.when(F.col("_to").isNull(), F.col("_level")).otherwise(0)).alias("level"),
            F.concat("_path", F.lit("/"), "path").alias("path"),
        )
        now = written(settled.unionByName(moved), "climb")
        reach *= 2


def toured(nodes: DataFrame, key: list[str]) -> DataFrame:
    """(key, node_id, position): the places, from 0, of nodes (key, node_id, parent_id, ord) that form trees, in the order of a reader."""
    roots = nodes.select(*key, "node_id", "parent_id", "ord")
    linked = written(with_next(roots, [*key, "parent_id"], ["ord", "node_id"], "node_id"), "siblings")
    child = linked.filter("is_first AND parent_id IS NOT NULL").select(*key, F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"))
    step = lambda node, side: F.struct(node.alias("node_id"), F.lit(side).alias("side"))
    enter = linked.select(*key, "node_id").join(child, [*key, "node_id"], "left").select(
        *key, "node_id", F.lit(0).alias("side"), F.when(F.col("child").isNotNull(), step(F.col("child"), 0)).otherwise(step(F.col("node_id"), 1)).alias("to"), F.lit(1).cast("long").alias("left"))
    leave = linked.select(
        *key, "node_id", F.lit(1).alias("side"), F.when(F.col("next").isNotNull(), step(F.col("next"), 0)).when(F.col("parent_id").isNotNull(), step(F.col("parent_id"), 1)).alias("to"), F.lit(0).cast("long").alias("left"))
    now = written(enter.unionByName(leave), "tour")
    while not now.filter("to IS NOT NULL").isEmpty():
        settled, going = now.filter("to IS NULL"), now.filter("to IS NOT NULL").withColumns({"_n": F.col("to.node_id"), "_s": F.col("to.side")}).drop("to")
        ahead = now.select(*key, F.col("node_id").alias("_n"), F.col("side").alias("_s"), "to", F.col("left").alias("_left"))
        moved = going.join(ahead, [*key, "_n", "_s"]).select(*key, "node_id", "side", "to", (F.col("left") + F.col("_left")).alias("left"))
        now = written(settled.unionByName(moved), "tour")
    many = nodes.groupBy(*key).agg(F.count("*").alias("_many"))
    return now.filter("side = 0").join(many, key).select(*key, "node_id", (F.col("_many") - F.col("left")).alias("position"))


def flattened(nodes: DataFrame, page_counts: DataFrame | None = None) -> Outline:
    """nodes (outline_id, node_id, parent_id, ord, title, page_index), page_counts (outline_id, page_count).

    A target page that the document doesn't have is null. An outline_id may not be null; siblings of equal ord are ordered by node_id. A parent is looked for
    in its own outline.
    """
    key = ["outline_id"]
    many = nodes.filter("node_id IS NOT NULL").groupBy(*key, "node_id").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n").withColumn("_twice", F.lit(True))
    marked = written(nodes.join(many, [*key, "node_id"], "left"), "outline")
    single = marked.filter("node_id IS NOT NULL AND _twice IS NULL").drop("_twice")
    levels = climbed(single.select(*key, "node_id", "parent_id"), key)
    judged = written(single.join(levels.drop("path"), [*key, "node_id"]), "judged")
    good = judged.filter("level IS NOT NULL AND root_parent IS NULL")
    placed = titled(good).join(toured(good, key), [*key, "node_id"])
    page = F.col("page_index")
    if page_counts is not None:
        placed = placed.join(page_counts.select(*key, "page_count"), key, "left")
        page = F.when((page >= 0) & (page < F.col("page_count")), page)
    reason = F.when(F.col("node_id").isNull(), "no id").otherwise("repeated id")
    early = marked.filter("node_id IS NULL OR _twice").select(*key, "node_id", "parent_id", reason.alias("reason"))
    late = judged.filter("level IS NULL OR root_parent IS NOT NULL").select(*key, "node_id", "parent_id", F.when(F.col("level").isNull(), "cycle").otherwise("orphan").alias("reason"))
    return Outline(placed.select(*key, "node_id", "parent_id", "title", "level", "position", page.alias("page_index")), early.unionByName(late))
