"""SimHash near-dedup by segment popcounts.

A fingerprint of 64 bits is mapped to 32 segment counts (bits set in each 2-bit segment). The Manhattan distance of two
such vectors is a lower bound of the Hamming distance. The vectors lie on a grid; the range join "Manhattan distance at
most r" is dealt into cell joins: the segments form r + 3 bands, at most r of which a partner can change, so some
choice of 3 bands is unchanged and the pair shares the cell of that choice. Pairs of a cell are kept if the whole
vectors are within r, and then verified on the fingerprints.

Counts are held in unary, two bits a segment (0: 00, 1: 01, 2: 11): the Manhattan distance of two vectors is then one
xor and one bit count.

Scale: only distinct fingerprints enter the join, so exact copies meet in one row. Only cells with company are kept, and in them
links to one member come first; pairs are looked for between what these leave apart (see `links`), so a group of near copies
isn't expanded into all its pairs. The joins by cell are sort-merge joins at every size: no side of them is bounded. A hot cell is split by the skew join of AQE. No cell is capped.

Defined cases: null and empty texts have the fingerprint zero and link like any other. Rows with equal doc_id are one
document with several texts: each row keeps its own fingerprint. A null doc_id never becomes a component's name
unless the component has no other row; then component_id is null. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.components import components

from .common import ascii_lower, hamming, hex64, majority, shingles, vote_sums, words, written

EVEN = 0x5555555555555555


def shingle_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id_col, fp: long) a row: bit majority over the XXH64 hashes (seed 42) of the word n-shingles.

    The 64 counts of a row are summed where its words are (partial aggregation by row), so the exchange carries one
    record a row, whatever the length of its text.
    """
    split = docs.select(
        F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), words(ascii_lower(F.col(text_col))).alias("_w")
    )
    each = split.select("_id", "_row", F.explode_outer(shingles(F.col("_w"), n)).alias("_s"))
    hashed = each.select("_id", "_row", F.when(F.col("_s").isNotNull(), F.xxhash64("_s")).alias("_h"))
    votes = hashed.groupBy("_row", "_id").agg(F.count("_h").alias("_t"), *vote_sums(F.col("_h")))
    return votes.select(F.col("_id").alias(id_col), majority(F.col("_t")).alias("fp"))


def segment_counts(fp: Column) -> Column:
    """The 32 counts of the 2-bit segments, in unary."""
    half = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(half).bitwiseAND(F.lit(EVEN))
    both = fp.bitwiseAND(half).bitwiseAND(F.lit(EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def bit_masks(radius: int, same: int = 3, width: int = 1) -> list[int]:
    """For each choice of `same` of the radius + same bands of `width`-bit segments, in order, its bits as a signed long."""
    bands = radius + same
    cut = [round(64 // width * k / bands) for k in range(bands + 1)]
    each = [sum(((1 << width) - 1) << (width * s) for s in range(cut[k], cut[k + 1])) for k in range(bands)]
    masks = [sum(each[k] for k in chosen) for chosen in combinations(range(bands), same)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(k, cell, fp, e): a distinct long `fp` with its counts e, once for each choice of bands."""
    grid = fps.select("fp", segment_counts(F.col("fp")).alias("e"))
    choices = F.array(*[F.struct(F.lit(k).alias("k"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)])
    return grid.select(F.inline(choices), "fp", "e")


def _near(a: str, b: str, radius: int) -> Column:
    """The bound on the counts, then the distance of the fingerprints."""
    c = lambda side, name: F.col(f"{side}{name}")
    return (F.bit_count(c(a, "e").bitwiseXOR(c(b, "e"))) <= radius) & (hamming(c(a, "fp"), c(b, "fp")) <= radius)


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): pairs of the distinct longs `fp` within the Hamming radius, that connect all that such pairs connect.

    First each fingerprint of a cell meets the smallest one. What these links connect needs no further pair among itself: in a cell that
    still holds several components, the members of all but the largest one meet everything in it. So a group of near copies
    gives links in proportion to its members, not to their pairs, and no connection is lost.
    """
    masks = bit_masks(radius, width=2)
    cells = _keyed(fps, masks)
    shared = written(cells.groupBy("k", "cell").agg(F.min("fp").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared")
    held = written(cells.hint("merge").join(shared, ["k", "cell"]), "held")
    head = F.struct(F.col("head").alias("fp"), segment_counts(F.col("head")).alias("e")).alias("h")
    stars = written(held.filter("fp <> head").select("fp", "e", head).filter(_near("", "h.", radius)).select(F.col("fp").alias("a"), F.col("h.fp").alias("b")).distinct(), "stars")
    labels = components(stars, "parts").withColumnRenamed("node", "fp")
    marked = written(held.drop("head").hint("merge").join(labels, "fp", "left").withColumn("part", F.coalesce("component", "fp")).drop("component"), "marked")
    sizes = marked.groupBy("k", "cell", "part").agg(F.count("*").alias("n")).groupBy("k", "cell").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("parts"))
    open_ = written(marked.hint("merge").join(sizes.filter("parts > 1").drop("parts"), ["k", "cell"]), "open")
    a, b = open_.filter("part <> largest").alias("a"), open_.alias("b")
    moved = F.col("a.e").bitwiseXOR(F.col("b.e"))
    first = F.lit(len(masks))
    for k in reversed(range(len(masks))):
        first = F.when(moved.bitwiseAND(F.lit(masks[k])) == 0, F.lit(k)).otherwise(first)
    once = (F.col("b.part") == F.col("b.largest")) | (F.col("a.fp") < F.col("b.fp"))
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.part") != F.col("b.part")) & once & _near("a.", "b.", radius) & (F.col("a.k") == first)
    across = a.hint("merge").join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    return written(stars.unionByName(across), "links")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 3) -> DataFrame:
    """(id_col, fingerprint: hex, component_id: smallest id of the component) a row."""
    fps = written(shingle_fingerprints(docs, id_col, text_col, n), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "classes")
    labels = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    member = classes.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = member.join(names, "component").select("fp", "component_id")
    return fps.join(named, "fp", "left").select(id_col, hex64(F.col("fp")).alias("fingerprint"), "component_id")
