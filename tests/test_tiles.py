"""Work by page as rows: tiles, merged regions and runs against the ways by joins, and pages of any size."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import detect, drawings, misc, regions, tiles
from foliospark.plans import grouped

PAGE = ["pair_id", "page_index"]
BOX = "pair_id long, page_index int, region_id int, left double, top double, right double, bottom double"
CELL = "pair_id long, page_index int, side string, x int, y int, r int, g int, b int, a int"


def rows(df, *names):
    return sorted(map(tuple, df.select(*(names or df.columns)).collect()))


def test_boxes_of_small_pages_need_no_rounds(spark, monkeypatch):
    rng = random.Random(4)
    made = [(p % 5, p // 5, k, x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + rng.choice([0, 9, 30]), y + rng.choice([0, 9])) for p in range(40) for k in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(made, BOX)
    numbered = df.withColumn("node", F.xxhash64(*PAGE, "region_id"))
    want = rows(regions._merged_by_grid(numbered, 8.0))
    assert rows(regions.merged(df.withColumn("left", F.col("left")))) == want
    monkeypatch.setattr(regions, "PAIRED", 20)  # some pages are larger
    assert rows(regions.merged(df)) == want
    monkeypatch.setattr(regions, "PAIRED", 256)
    monkeypatch.setattr(regions, "HELD", 50)
    monkeypatch.setattr(regions, "components", lambda *a: pytest.fail("rounds over the table"))
    assert rows(regions.merged(df)) == want


def test_boxes_that_numbers_cannot_compare(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 5.0, 5.0), (1, 0, 1, 6.0, 0.0, 9.0, 5.0), (1, 0, 2, None, None, None, None), (2, 0, 0, 0.0, 0.0, 1.0, 1.0), (None, 0, 0, 0.0, 0.0, 1.0, 1.0)], BOX)
    assert sorted(map(str, regions.merged(df).collect())) == sorted(map(str, regions._merged_by_grid(df.withColumn("node", F.xxhash64(*PAGE, "region_id")), 8.0).collect()))


def test_runs_that_end_at_tiles(spark, monkeypatch):
    rng = random.Random(5)
    marked = {(p, rng.randrange(40), rng.randrange(12)) for p in range(6) for _ in range(260)}
    df = spark.createDataFrame([(p, 0, x, y) for p, x, y in marked], "pair_id long, page_index int, x int, y int")
    whole = rows(detect.regions(df, PAGE, 3), "pair_id", "left", "top", "right", "bottom", "n_cells")
    cut = detect.runs(df.withColumn("t", F.floor(F.col("x") / 8)), [*PAGE, "t"]).select(*PAGE, "y", "x0", "x1")
    assert rows(detect.regions_of_runs(cut, PAGE, 3), "pair_id", "left", "top", "right", "bottom", "n_cells") == whole
    monkeypatch.setattr(grouped.split, "__defaults__", (None, 1))
    assert rows(detect.regions_of_runs(cut, PAGE, 3), "pair_id", "left", "top", "right", "bottom", "n_cells") == whole


def test_drawn_tiles_are_the_drawn_cells(spark):
    ids = spark.range(40).select(F.col("id").alias("pair_id"))
    cells = drawings.drawn(ids)
    made = drawings.drawn_tiles(ids)
    for side in ("old", "new"):
        got = made.select("pair_id", F.inline(side))
        assert rows(got.drop("a")) == rows(cells.filter(F.col("side") == side), "pair_id", "x", "y", "r", "g", "b")
    assert rows(detect.tile_regions(made, 12.0), "pair_id", "left", "top", "right", "bottom") == rows(detect.visual_regions(cells, drawings.shifts(ids), 12.0), "pair_id", "left", "top", "right", "bottom")


def page_rows(seed=7):
    rng = random.Random(seed)
    words = ["a", "Bb", "c7c", "1234", "", "longer-word", "I"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = []
    for k in range(14):
        old = [line(rng.choice([1, 5, 40, 150])) for _ in range(rng.randrange(1, 21))]
        new = [" ".join(["darker-than-these"] * 90) if k % 2 and i % 12 < 8 else line(30) if rng.random() < 0.3 else t for i, t in enumerate(old[rng.randrange(2) :])]
        out.append((k, 0, new, old))
    return [*out, (99, 0, ["x y"], [])]


def test_tiles_of_pages_give_what_their_cells_give(spark):
    pages = spark.createDataFrame(page_rows(), "pair_id long, page_index int, old_lines array<string>, new_lines array<string>")
    cells = misc.page_cells(pages)
    marked = rows(tiles.cells_of(tiles.marked_runs(tiles.page_tiles(pages), PAGE), PAGE), "pair_id", "x", "y")
    assert marked and marked == rows(misc.grid_mask(cells, PAGE), "pair_id", "x", "y")
    best = rows(tiles.best_shifts(tiles.page_tiles(pages, 4), PAGE))
    assert best == rows(misc.grid_offset(cells, PAGE)) and len(best) == 15
    # tiles of a page that don't follow one another are added up over the table
    assert rows(tiles.best_shifts(tiles.page_tiles(pages, 4).repartition(7, "tx"), PAGE)) == best


def test_no_cell_becomes_a_row(spark):
    pages = spark.createDataFrame(page_rows(), "pair_id long, page_index int, old_lines array<string>, new_lines array<string>")
    plan = tiles.marked_runs(tiles.page_tiles(pages), PAGE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_lines_are_written_once_whatever_the_modes(spark, monkeypatch):
    from foliospark.operators import compare, linediff

    kept = []
    monkeypatch.setattr(compare, "written", lambda df, name: kept.append((name, df.columns)) or df)
    pages = spark.createDataFrame([(d, 0, [f"line {d % 3}", "same", f"x{d}"]) for d in range(4)], "doc_id long, page_index int, lines array<string>")
    pairs = spark.createDataFrame([(k, k, k + 1, m) for k in range(3) for m in compare.MODES], "pair_id long, old_doc_id long, new_doc_id long, mode string")
    report = compare.compare(pairs, pages)
    assert [name for name, columns in kept if "old_text" in columns or "old_lines" in columns] == ["paired", "entries"]
    assert not hasattr(linediff, "written")
    assert report.stats.count() == 9 and report.pages.filter("status = 'modified'").count() == 9
    assert {(r.mode, r.origin) for r in report.entries.collect()} == {("text", "text"), ("hybrid", "text"), ("visual", "visual"), ("hybrid", "visual")}


def test_words_are_placed_within_their_page(spark):
    from foliospark.operators.layout import ordered_lines, reading_order_lines, word_segments

    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["für", "", "x", "\U0001f600y", " ", "longer"]) for _ in range(rng.choice([1, 3, 90])))
    made = [(d, p, k, line()) for d in (6, 7, -3, -4, None) for p in range(2) for k in range(rng.randrange(1, 21))]
    lines = spark.createDataFrame(made, "doc_id long, page_index int, line_index int, text string")
    got, keys = ordered_lines(lines, ["doc_id", "page_index"]), ["doc_id", "page_index"]
    want = reading_order_lines(word_segments(lines), keys)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "Sort" not in plan


def test_runs_of_drawings_are_those_of_their_tiles_in_one_pass(spark):
    ids = spark.range(40).select(F.col("id").alias("pair_id"))
    made = drawings.drawn_runs(ids, detect.THRESHOLD, detect.REACH, detect.NEIGHBOURS)
    assert rows(made) == rows(tiles.marked_runs(drawings.drawn_tiles(ids), PAGE, detect.THRESHOLD, detect.REACH, detect.NEIGHBOURS)) != []
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_words_of_lines_give_what_their_cells_give(spark, monkeypatch):
    odd = [("\u00fcber \U0001f600\U0001f600 x", "", " a  b "), ("1234567 abcdefgh", "a"), ("-" * 13,) * 5]
    more = [(200 + k, k, list(a), list(b)) for k, a in enumerate(odd) for b in odd]
    pages = spark.createDataFrame([*page_rows(), *more, (100, 0, [], ["x y"]), (101, 0, [], [])], "pair_id long, page_index int, old_lines array<string>, new_lines array<string>")
    want = rows(misc.grid_mask(misc.page_cells(pages), PAGE), "pair_id", "x", "y")
    for most in (tiles.TEXT_HELD, 100):
        monkeypatch.setattr(tiles, "TEXT_HELD", most)
        made = tiles.text_runs(pages.coalesce(1))
        assert rows(tiles.cells_of(made, PAGE), "pair_id", "x", "y") == want
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
