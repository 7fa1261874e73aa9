"""Connected components of an edge table: forests of its parts, then alternating large-star and small-star rounds, all in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import labels
from .shared import ensure_importable, written

#: Edges (16 bytes each) that a task joins up at once. A table of no more needs no round; of a larger one this only shortens the rounds.
PART = 1 << 16


def components(edges: DataFrame, name: str = "components", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long); component is the smallest node reachable.

    First `PART` edges at a time become stars of the smallest nodes that they reach. If the table has more, rounds follow.
    Each round rewires edges to the smallest neighbour, so the number of rounds grows with the logarithm of the
    longest path. A round is written to the shared folder; only its row count and a checksum reach the driver.
    Null ends and loops are ignored; repeated edges count once; an empty table gives an empty result.
    """
    ensure_importable(edges.sparkSession)
    both = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = written(both.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")), name)
    n = now.count()
    now = written(_forests(now.coalesce(-(-n // PART) or 1), PART), name)
    if n > PART:
        now = _rounds(now, name, max_rounds)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _rounds(now: DataFrame, name: str, max_rounds: int) -> DataFrame:
    """The edges (u, v) as stars of the smallest nodes that they reach."""
    sign = _sign(now)
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now)), name)
        last, sign = sign, _sign(now)
        if last == sign:
            return now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _forests(edges: DataFrame, most: int) -> DataFrame:
    """For each `most` edges (u, v) of a task the nodes u that they link to a smaller one, and the smallest v that they reach."""

    def star(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = labels(len(nodes), ends[: len(u)], ends[len(u) :])
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[label[linked]])], ["u", "v"])

    def join(batches):
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - size)
                held.append([part.column(c).to_numpy() for c in ("u", "v")])
                at, size = at + part.num_rows, size + part.num_rows
                if size == most:
                    yield star(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield star(*map(np.concatenate, zip(*held, strict=True)))

    return edges.mapInArrow(join, "u bigint, v bigint")


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    arcs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return arcs.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
