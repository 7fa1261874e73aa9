"""Visual changes of page pairs from their grids of coloured cells: offset, tiles, differing cells, regions, merged regions.

cells (keys, side, x, y, r, g, b, a) of both sides; a cell that isn't there is white. offsets (keys, dx, dy): where the old cell (x, y) stands on
the new side, (0, 0) for pages that it doesn't hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.colour import CHANNELS
from foliospark.plans.components import components
from foliospark.plans.grouped import labels, lists, split
from foliospark.plans.shared import ensure_importable, written
from .regions import merged
from .tiles import cells_of, marked_runs, tiled

THRESHOLD, REACH, NEIGHBOURS, LEAST, TILE = 60.0, 2, 3, 8, 64
#: Width of the stretches of a row in which runs of neighbouring rows meet.
STRETCH = 64


def changed_tiles(cells: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """(keys, tx, ty): tiles whose sides differ, and their neighbours. A tile's signature is two sums without carry of its cells' hashes, in any order; cells that
    are there but white make it differ, which costs work and changes nothing."""
    at = [F.floor(F.col(c) / tile).cast("int").alias(f"t{c}") for c in "xy"]
    signs = cells.groupBy(*keys, *at, "side").agg(F.bit_xor(F.xxhash64("x", "y", *CHANNELS)).alias("s1"), F.bit_xor(F.xxhash64(*CHANNELS, "y", "x")).alias("s2"))
    differ = signs.groupBy(*keys, "tx", "ty").agg(F.count("*").alias("n"), F.count_distinct("s1", "s2").alias("kinds")).filter("n < 2 OR kinds > 1")
    around = F.array(*[F.struct((F.col("tx") + i).alias("tx"), (F.col("ty") + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return differ.select(*keys, F.inline(around)).distinct()


def mask(cells: DataFrame, keys: list[str], offsets: DataFrame, threshold: float = THRESHOLD, reach: int = REACH, neighbours: int = NEIGHBOURS, tile: int = TILE) -> DataFrame:
    """(keys, x, y): old cells that differ by more than the threshold from the new side at their place and from all places within `reach` of it, and have
    `neighbours` of the kind about them. Old cells whose place lies outside the new side are skipped. The new side is seen from the old frame, bilinear by channel."""
    return cells_of(marked_runs(tiled(cells, keys, offsets, reach + 1, tile=tile), keys, threshold, reach, neighbours, tile), keys)


def runs(marked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x0, x1, node): the runs of neighbouring cells of each row."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    return marked.withColumn("_k", F.col("x") - F.row_number().over(row)).groupBy(*keys, "y", "_k").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_k").withColumn("node", F.xxhash64(*keys, "y", "x0"))


def regions(marked: DataFrame, keys: list[str], least: int = LEAST, scale: float | tuple[float, float] = 1.0) -> DataFrame:
    """(keys, region_id, left, top, right, bottom, n_cells): 4-connected regions with at least `least` cells."""
    return regions_of_runs(runs(marked, keys).drop("node"), keys, least, scale)


def regions_of_runs(parts: DataFrame, keys: list[str], least: int = LEAST, scale: float | tuple[float, float] = 1.0) -> DataFrame:
    """The same from runs (keys, y, x0, x1) of a row, which may follow each other without a gap. Runs are linked where those of the next row overlap: those of a page as one row, or,
    of a page with very many, over the table."""
    each = written(parts.withColumn("node", F.xxhash64(*keys, "y", "x0")), "runs")
    ensure_importable(parts.sparkSession)
    small, large = split(each, keys)
    pages = small.groupBy(*keys).agg(F.collect_list(F.struct("y", "x0", "x1", "node")).alias("r"))
    kinds = {f.name: f.dataType.simpleString() for f in each.schema.fields}
    out = pages.mapInArrow(_linked(keys), ", ".join([*[f"{k} {kinds[k]}" for k in keys], "region_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, n_cells bigint"]))
    found = out if large is None else out.unionByName(_regions_by_table(large, keys))
    w, h = scale if isinstance(scale, tuple) else (scale, scale)
    boxes = found.select(*keys, "region_id", (F.col("x0") * w).alias("left"), (F.col("y0") * h).alias("top"), ((F.col("x1") + 1) * w).alias("right"), ((F.col("y1") + 1) * h).alias("bottom"), "n_cells")
    return boxes.filter(F.col("n_cells") >= least)


def _linked(keys: list[str]):
    def link(batches):
        for batch in batches:
            sizes, r = lists(batch.column("r"))
            page = np.repeat(np.arange(len(sizes)), sizes)
            if not len(page):
                continue
            order = np.lexsort((r["x0"], r["y"], page))
            page, (y, x0, x1, node) = page[order], (r[c][order].astype(np.int64) for c in ("y", "x0", "x1", "node"))
            rank = lambda v: np.unique(v, return_inverse=True)[1]
            high, low = rank(np.concatenate([y, y + 1])), rank(np.concatenate([x0, x1]))
            n, rows, width = len(y), int(high.max()) + 1, int(low.max()) + 1
            # one number that orders page, row and place, so that the runs of the next row are found by search
            at = lambda row, x: (page * rows + row) * width + x
            starts, ends = at(high[:n], low[:n]), at(high[:n], low[n:])
            first = np.searchsorted(ends, at(high[n:], low[:n]))
            count = np.maximum(np.searchsorted(starts, at(high[n:], low[n:]), "right") - first, 0)
            upper = np.repeat(np.arange(n), count)
            lower = np.repeat(first, count) + np.arange(len(upper)) - np.repeat(np.cumsum(count) - count, count)
            beside = np.flatnonzero((page[1:] == page[:-1]) & (y[1:] == y[:-1]) & (x0[1:] == x1[:-1] + 1))
            roots, place = np.unique(labels(n, np.concatenate([upper, beside]), np.concatenate([lower, beside + 1])), return_inverse=True)
            least, most = lambda v: np.minimum.reduceat(v[by], cuts), lambda v: np.maximum.reduceat(v[by], cuts)
            by = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[by], np.arange(len(roots)))
            total = np.add.reduceat((x1 - x0 + 1)[by], cuts)
            values = [least(node), least(x0), least(y), most(x1), most(y), total]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(page[roots])) for k in keys], *map(pa.array, values)], names=[*keys, "region_id", "x0", "y0", "x1", "y1", "n_cells"])

    return link


def _regions_by_table(each: DataFrame, keys: list[str]) -> DataFrame:
    """The same for pages of any number of runs: runs meet in stretches of a row and are linked in the one where their overlap begins."""
    put = each.select("*", F.explode(F.sequence(F.floor(F.col("x0") / STRETCH).cast("int"), F.floor(F.col("x1") / STRETCH).cast("int"))).alias("s"))
    upper = put.select(*keys, (F.col("y") + 1).alias("y"), "s", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("node").alias("a"))
    start = F.greatest("x0", "u0")
    edges = upper.join(put, [*keys, "y", "s"]).filter((start <= F.least("x1", "u1")) & (F.floor(start / STRETCH) == F.col("s"))).select("a", F.col("node").alias("b"))
    beside = each.select(*keys, "y", (F.col("x1") + 1).alias("x0"), F.col("node").alias("a")).join(each.select(*keys, "y", "x0", F.col("node").alias("b")), [*keys, "y", "x0"]).select("a", "b")
    linked = components(edges.unionByName(beside), "grid").withColumnRenamed("node", "_n")
    named = each.join(linked, F.col("node") == F.col("_n"), "left").withColumn("region_id", F.coalesce("component", "node"))
    span = [F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n_cells")]
    return named.groupBy(*keys, "region_id").agg(*span).withColumns({c: F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1", "n_cells")})


def tile_regions(tiles: DataFrame, scale: float = 1.0) -> DataFrame:
    """(pair_id, page_index, region_id, left, top, right, bottom): what a comparison takes as the changed regions of a detector, from the tiles of page pairs."""
    keys = ["pair_id", "page_index"]
    return run_regions(marked_runs(tiles, keys, THRESHOLD, REACH, NEIGHBOURS), scale)


def run_regions(marked: DataFrame, scale: float = 1.0) -> DataFrame:
    """The same from the runs of marked cells."""
    return regions_of_runs(marked, ["pair_id", "page_index"], scale=scale).drop("n_cells")


def visual_regions(cells: DataFrame, offsets: DataFrame, scale: float = 1.0) -> DataFrame:
    """The same from cells."""
    return tile_regions(tiled(cells, ["pair_id", "page_index"], offsets, REACH + 1), scale)


def visual_changes(cells: DataFrame, offsets: DataFrame, scale: float = 1.0) -> DataFrame:
    """The same, regions within the merging gap as one."""
    return merged(visual_regions(cells, offsets, scale))
