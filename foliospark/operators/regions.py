"""Merging of changed regions: boxes of one page within a gap of each other are one region, linked on the original boxes.

Pages of up to `PAIRED` boxes are merged as rows, all pairs of a page at once; on larger ones boxes meet by a grid and are linked over the table.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.components import components
from foliospark.plans.grouped import labels, lists, pairs_within, split
from foliospark.plans.shared import ensure_importable, written

GAP = 8.0
#: Side of a grid bucket by which boxes meet.
BUCKET = 32.0
#: Boxes of a page up to which all its pairs are looked at, and pairs that are held at a time.
PAIRED, HELD = 256, 1 << 20
BOX = ("left", "top", "right", "bottom")


def buckets(low: Column, high: Column, side: float) -> Column:
    """The numbers of the grid intervals of that side that [low, high] touches."""
    return F.sequence(F.floor(F.least(low, high) / side).cast("int"), F.floor(F.greatest(low, high) / side).cast("int"))


def near_pairs(regions: DataFrame, gap: float = GAP, side: float = BUCKET) -> DataFrame:
    """Pairs (a < b) of node numbers of regions of one page, both gaps at most `gap`.

    Boxes, those of a wider by the gap, stand in all buckets of a grid that they touch, and meet there; a pair is reported in the bucket that holds the top left corner of what they share.
    """
    key = ["pair_id", "page_index"]
    put = lambda df, g: df.select("*", F.explode(buckets(F.col("left") - g, F.col("right") + g, side)).alias("bx")).select("*", F.explode(buckets(F.col("top") - g, F.col("bottom") + g, side)).alias("by"))
    a, b = put(regions, gap).alias("a"), put(regions, 0.0).alias("b")
    apart = lambda low, high: F.greatest(F.col(f"a.{low}") - F.col(f"b.{high}"), F.col(f"b.{low}") - F.col(f"a.{high}"))
    corner = lambda low: F.floor(F.greatest(F.col(f"a.{low}") - gap, F.col(f"b.{low}")) / side)
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*key, "bx", "by"]]
    near = (F.col("a.node") < F.col("b.node")) & (apart("left", "right") <= gap) & (apart("top", "bottom") <= gap)
    once = (corner("left") == F.col("a.bx")) & (corner("top") == F.col("a.by"))
    return a.join(b, reduce(and_, met) & near & once).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def merged(regions: DataFrame, gap: float = GAP) -> DataFrame:
    """(pair_id, page_index, left, top, right, bottom, n_boxes): union boxes of the connected regions of a page."""
    key = ["pair_id", "page_index"]
    rows = written(regions.select(*key, F.xxhash64(*key, "region_id").alias("node"), *BOX), "boxes")
    plain = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < 1e300) for c in BOX])
    small, large = split(rows, key, plain, PAIRED)
    ensure_importable(regions.sparkSession)
    pages = small.groupBy(*key).agg(F.collect_list(F.struct("node", *[F.col(c).cast("double").alias(c) for c in BOX])).alias("b"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = pages.mapInArrow(_merger(gap), ", ".join([*[f"{k} {kinds[k]}" for k in key], *[f"{c} double" for c in BOX], "n_boxes bigint"]))
    out = out.select(*key, *[F.col(c).cast(kinds[c]).alias(c) for c in BOX], "n_boxes")
    return out if large is None else out.unionByName(_merged_by_grid(large, gap))


def _merger(gap: float):
    def merge(batches):
        for batch in batches:
            done, rows = 0, batch.num_rows
            sizes = np.diff(batch.column("b").offsets.to_numpy())
            pairs = np.cumsum(sizes.astype(np.int64) ** 2 // 2)
            while done < rows:  # as many pages as have HELD pairs
                before = pairs[done - 1] if done else 0
                end = max(done + 1, int(np.searchsorted(pairs, before + HELD, "right")))
                yield _merge(batch.slice(done, end - done), gap)
                done = end

    return merge


def _merge(batch: pa.RecordBatch, gap: float) -> pa.RecordBatch:
    sizes, c = lists(batch.column("b"))
    a, b = pairs_within(sizes)
    apart = lambda low, high: np.maximum(c[low][a] - c[high][b], c[low][b] - c[high][a])
    near = (apart("left", "right") <= gap) & (apart("top", "bottom") <= gap) | (c["node"][a] == c["node"][b])
    label = labels(len(c["node"]), a[near], b[near])
    roots, place = np.unique(label, return_inverse=True)
    box = {}
    for name in BOX:
        least = name in ("left", "top")
        box[name] = np.full(len(roots), np.inf if least else -np.inf)
        (np.minimum if least else np.maximum).at(box[name], place, c[name])
    page = np.repeat(np.arange(len(sizes)), sizes)[roots]
    keys = [batch.column(k).take(pa.array(page)) for k in ("pair_id", "page_index")]
    return pa.RecordBatch.from_arrays([*keys, *[pa.array(box[n]) for n in BOX], pa.array(np.bincount(place, minlength=len(roots)))], names=["pair_id", "page_index", *BOX, "n_boxes"])


def _merged_by_grid(numbered: DataFrame, gap: float) -> DataFrame:
    """The same for pages of any number of boxes."""
    labelled = components(near_pairs(numbered, gap), "regions").withColumnRenamed("node", "_n")
    named = numbered.join(labelled, F.col("node") == F.col("_n"), "left").withColumn("component", F.coalesce("component", "node"))
    return named.groupBy("pair_id", "page_index", "component").agg(
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count("*").alias("n_boxes")
    ).drop("component")


PAGE_BOXES = "array<struct<left:double,top:double,right:double,bottom:double,n_boxes:bigint,bare:boolean>>"


def merged_lists(pages: int, page: np.ndarray, c: dict[str, np.ndarray], other_page: np.ndarray, o: dict[str, np.ndarray], gap: float = GAP) -> pa.Array:
    """For each page the merged ones of its boxes c, which are well-formed, and whether they are `bare`: overlap none of the boxes o of their page.

    Equal boxes are looked at once, and boxes in the order of their tops meet those that begin before they end, so a page may have any number.
    """
    order = np.lexsort((c["bottom"], c["right"], c["left"], c["top"], page))
    page, c = page[order], {n: c[n][order] for n in BOX}
    fresh = np.ones(len(page), bool)
    fresh[1:] = (page[1:] != page[:-1]) | np.any([v[1:] != v[:-1] for v in c.values()], axis=0)
    copies = np.diff(np.append(np.flatnonzero(fresh), len(page)))
    page, c = page[fresh], {n: v[fresh] for n, v in c.items()}
    ends = np.concatenate([c["top"], c["bottom"], o["top"], o["bottom"], [0.0]])
    high = max(0.0, float((o["bottom"] - o["top"]).max(initial=0.0)))
    apart = float(ends.max() - ends.min()) + high + gap + 8  # pages below each other, so that one search serves all; what it finds too much by rounding is tested again
    edges = [(a[near], b[near]) for a, b in _expanded(np.arange(1, len(page) + 1), np.searchsorted(c["top"] + page * apart, c["bottom"] + page * apart + gap + 1, "right")) for near in [(page[a] == page[b]) & _within(c, a, b, gap)]]
    label = labels(len(page), *(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*edges, strict=True))) if edges else np.arange(len(page))
    roots, place = np.unique(label, return_inverse=True)
    box = {}
    for name in BOX:
        least = name in ("left", "top")
        box[name] = np.full(len(roots), np.inf if least else -np.inf)
        (np.minimum if least else np.maximum).at(box[name], place, c[name])
    total = np.zeros(len(roots), np.int64)
    np.add.at(total, place, copies)
    page = page[roots]
    order = np.lexsort((o["top"], other_page))
    other_page, o = other_page[order], {n: o[n][order] for n in BOX}
    starts, bare = o["top"] + other_page * apart, np.ones(len(roots), bool)
    for a, b in _expanded(np.searchsorted(starts, box["top"] + page * apart - high - 1), np.searchsorted(starts, box["bottom"] + page * apart + 1, "right")):
        met = (page[a] == other_page[b]) & (box["left"][a] < o["right"][b]) & (o["left"][b] < box["right"][a]) & (box["top"][a] < o["bottom"][b]) & (o["top"][b] < box["bottom"][a])
        bare[a[met]] = False
    offsets = np.append(0, np.cumsum(np.bincount(page, minlength=pages))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([*[pa.array(box[n]) for n in BOX], pa.array(total), pa.array(bare)], [*BOX, "n_boxes", "bare"]))


def _within(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, gap: float) -> np.ndarray:
    far = lambda low, high: np.maximum(c[low][a] - c[high][b], c[low][b] - c[high][a]) > gap
    return ~far("left", "right") & ~far("top", "bottom")


def _expanded(first: np.ndarray, last: np.ndarray):
    """The pairs (place, other) of each place with the others from first to before last, `HELD` or those of one place at a time."""
    count, done = np.maximum(last - first, 0), 0
    total = np.cumsum(count)
    while done < len(count):
        end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + HELD, "right")))
        n = count[done:end]
        a = np.repeat(np.arange(done, end), n)
        yield a, np.repeat(first[done:end], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        done = end
