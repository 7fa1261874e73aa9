"""Search over many pages and queries, recent comparisons, outline levels, text offsets, change detection on grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import alignment_key, match_count, snippet
from foliospark.plans.shared import written
from . import tiles
from .detect import regions
from .layout import line_shifts
from .outline import climbed, titled


#: Letters by which words and query words meet.
GRAM = 3


def search(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, page_index, match_count, snippet): every query over every page that holds it, in any case.

    A page can only hold a query if it holds the query's longest word as part of one of its own words. That part shares its first `GRAM`
    letters (all of a shorter word) with the query's word, so distinct words and distinct query words meet on letter groups, by
    an equi-join, and what is left joins on words. Blank queries find nothing.
    """
    asked = queries.filter(F.trim("query") != "").withColumn("q", F.lower(F.trim("query"))).withColumn("w", F.element_at(F.array_sort(F.split("q", r"\s+"), lambda a, b: F.length(a) - F.length(b)), -1))
    texts = pages.withColumn("low", F.lower("text"))
    words = texts.select("doc_id", "page_index", F.explode(F.array_distinct(F.split("low", r"\s+"))).alias("word"))
    wanted = written(asked.select("w", F.substring("w", 1, GRAM).alias("gram")).distinct(), "wanted")
    sizes = sorted(r.n for r in wanted.select(F.length("gram").alias("n")).distinct().collect())  # GRAM of them at most
    # letters first, so that the work is linear in a word's length
    letters = words.select("word").distinct().filter("word <> ''").withColumn("l", F.split("word", ""))
    group = lambda n: F.transform(F.sequence(F.lit(0), F.size("l") - n), lambda i: F.concat(*[F.get("l", i + k) for k in range(n)]))
    groups = F.concat(*[F.when(F.size("l") >= n, group(n)).otherwise(F.array().cast("array<string>")) for n in sizes or [GRAM]])
    known = letters.select("word", F.explode(F.array_distinct(groups)).alias("gram"))
    # written, so that Spark knows how few they are: then neither the words nor the texts are shuffled
    hits = written(known.join(wanted, "gram").filter(F.contains("word", "w")).select("word", "w").distinct(), "hits")
    places = written(words.join(hits, "word").select("doc_id", "page_index", "w").distinct(), "places")
    found = texts.join(places, ["doc_id", "page_index"]).join(asked, "w").filter(F.contains("low", "q"))
    return found.select("query_id", "doc_id", "page_index", match_count(F.col("text"), F.col("q")).alias("match_count"), snippet(F.col("text"), F.col("q")).alias("snippet"))


def recent(events: DataFrame, by: str, what: list[str], top: int) -> DataFrame:
    """The latest distinct `what` of each `by`, newest first."""
    last = events.groupBy(by, *what).agg(F.max("ts").alias("ts"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), *what))).filter(F.col("place") <= top)


def outline_levels(nodes: DataFrame) -> DataFrame:
    """nodes (node_id, parent_id, title) with level and path, of any depth; blank titles are `(Untitled)`. Nodes without a root above them are left to `outline.flattened` to report."""
    climb = climbed(nodes.select("node_id", "parent_id"), [], path=True).filter("level IS NOT NULL AND root_parent IS NULL")
    return titled(nodes).join(climb.select("node_id", "level", "path"), "node_id")


def text_offset(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys with dx and dy: exact medians of the shifts between lines of equal text, in 1/300 inch; (0, 0) if both are under one."""
    a = old.select(*keys, alignment_key(F.col("text")).alias("k"), F.col("left").alias("ol"), F.col("top").alias("ot")).filter("k <> ''")
    b = new.select(*keys, alignment_key(F.col("text")).alias("k"), F.col("left").alias("nl"), F.col("top").alias("nt")).filter("k <> ''")
    return _in_dots(a.join(b, [*keys, "k"]).groupBy(*keys).agg(F.median(F.col("nl") - F.col("ol")).alias("x"), F.median(F.col("nt") - F.col("ot")).alias("y")), keys)


def _in_dots(shift: DataFrame, keys: list[str]) -> DataFrame:
    dots = shift.select(*keys, (F.col("x") * 300 / 72).alias("x"), (-F.col("y") * 300 / 72).alias("y"))
    small = (F.abs("x") < 1) & (F.abs("y") < 1)
    return dots.select(*keys, F.round(F.when(small, 0.0).otherwise(F.col("x")), 3).alias("dx"), F.round(F.when(small, 0.0).otherwise(F.col("y")), 3).alias("dy"))


def page_cells(pages: DataFrame) -> DataFrame:
    """(pair_id, page_index, side, x, y, r, g, b, a): pages as grids, a cell a word, the longer the darker, letters red and others blue."""
    def side(name: str) -> DataFrame:
        lines = pages.select("pair_id", "page_index", F.posexplode(f"{name}_lines").alias("y", "line"))
        words = lines.select("pair_id", "page_index", "y", F.posexplode(F.split("line", " ")).alias("x", "w"))
        letters = F.length(F.regexp_replace("w", "[^A-Za-z]", ""))
        grey = lambda n: F.greatest(F.lit(0), 255 - n * 20).cast("int")
        return words.select("pair_id", "page_index", F.lit(name).alias("side"), "x", "y", grey(F.length("w")).alias("r"), grey(letters).alias("g"), grey(F.length("w") - letters).alias("b"), F.lit(255).alias("a"))

    return side("old").unionByName(side("new"))


def grid_mask(cells: DataFrame, keys: list[str], threshold: float = 60.0, reach: int = 2, neighbours: int = 3) -> DataFrame:
    """(keys, x, y): old cells that differ in colour by more than the threshold from every new cell within `reach` (places beyond the rim count
    as those at the rim), and have as many differing ones among their eight neighbours."""
    return tiles.cells_of(tiles.marked_runs(tiles.tiled(cells, keys, halo=reach + 1), keys, threshold, reach, neighbours), keys)


def grid_regions(mask: DataFrame, keys: list[str], least: int = 8, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(keys, left, top, right, bottom, n_cells): 4-connected regions of the mask with at least `least` cells, right and bottom exclusive, in cells
    times the scale."""
    return regions(mask, keys, least, scale).drop("region_id")


def grid_offset(cells: DataFrame, keys: list[str], reach: float = 2.0, step: float = 0.25, every: int = 8) -> DataFrame:
    """(keys, dx, dy, score): the shift of the new side with the smallest mean difference in luminance on every `every`-th old cell.

    Shifts go by `step` up to `reach`; between cells a value is bilinear, channel by channel, in whole numbers; what comes to lie outside
    doesn't count. No shift wins over equals, then the first by dy and dx.
    """
    return tiles.best_shifts(tiles.tiled(cells, keys, halo=math.ceil(reach) + 2, blank=True), keys, reach, step, every)


def page_offset(by_text: DataFrame, by_grid: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """keys with dx and dy: the offset of the text where there is one, else that of the grid; (0, 0) where it is under one on
    both axes or beyond an eighth of the page."""
    t, g = (x.select(*keys, F.col("dx").alias(f"{n}x"), F.col("dy").alias(f"{n}y")) for x, n in ((by_text, "t"), (by_grid, "g")))
    return _within(t.join(g, keys, "full").select(*keys, F.coalesce("tx", "gx").cast("double").alias("dx"), F.coalesce("ty", "gy").cast("double").alias("dy")), keys, width, height)


def offsets_by_page(pages: DataFrame, keys: list[str], id_col: str, width: float, height: float) -> DataFrame:
    """`page_offset` of common pages (keys pair_id and page_index, old_lines, new_lines), each of which is one row, by `text_offset` of their ordered lines, or else by their grids. What is
    written are the offsets, and the lines of the pages that have none by their text."""
    found = written(line_shifts(pages, keys, id_col), "line_shifts")
    known = _in_dots(found.filter("x IS NOT NULL"), keys)
    rest = tiles.best_shifts(tiles.page_tiles(found.filter("old_lines IS NOT NULL"), 4), keys)
    return _within(known.unionByName(rest.select(*keys, "dx", "dy")), keys, width, height)


def _within(both: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    none = ((F.abs("dx") < 1) & (F.abs("dy") < 1)) | (F.abs("dx") > width / 8) | (F.abs("dy") > height / 8)
    return both.select(*keys, F.when(none, 0.0).otherwise(F.col("dx")).alias("dx"), F.when(none, 0.0).otherwise(F.col("dy")).alias("dy"))
