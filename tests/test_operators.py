"""Unit cases of the revision operators as literal rows."""

import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliospark.functions import colour
from foliospark.functions import text as T
from foliospark.operators import compare as C
from foliospark.operators import linediff
from foliospark.operators import misc as M
from foliospark.operators import scoring as S
from foliospark.operators.layout import STRETCH, reading_order_lines, word_segments
from foliospark.operators.linediff import common_lines, entries
from foliospark.operators.regions import merged
from foliospark.sources import tables

SEGMENT = "doc_id int, page_index int, seg_id int, text string, left double, top double, right double, bottom double"


@pytest.mark.parametrize("rows,lines", [
    ([("lower", 31, 207.5, 95, 196), ("upper", 31, 233, 95, 221)], ["upper", "lower"]),
    ([("right cell", 305, 118, 361, 107.5), ("left cell", 44, 118, 131, 107.5)], ["left cell right cell"]),
    ([("high", 310, 118.5, 361, 107.5), ("low", 44, 118, 131, 107.5)], ["high low"]),  # by top first, however far to the right
    ([("tall", 12, 77, 30, 51), ("inside", 33, 70, 64, 61), ("next", 12, 49.5, 40, 40)], ["tall inside", "next"]),
    ([("touching", 5, 64, 9, 55), ("within one point", 5, 54.2, 9, 45)], ["touching within one point"]),
    ([("", 3, 9, 4, 8), ("\u00a0", 3, 9, 4, 8), ("shown", 17, 23, 58, 12)], ["shown"]),
    # a bottom above its top: what follows is held against that line alone, not against the lowest bottom so far
    ([("tall", 1, 70, 5, 10), ("upside down", 1, 5, 5, 5.5), ("beside it", 8, 4.6, 9, 4)], ["tall", "upside down beside it"]),
    ([], []),
])
def test_reading_order(spark, rows, lines):
    df = spark.createDataFrame([(1, 0, k, t, *map(float, box)) for k, (t, *box) in enumerate(rows)], SEGMENT)
    got = [r.text for r in reading_order_lines(df, ["doc_id", "page_index"]).orderBy("line_index").collect()]
    assert got == lines


def line_by_line(segments):
    """The lines (text, left, top, right, bottom) of one page's segments (text, left, top, right, bottom), one segment after another."""
    lines = []
    for text, left, top, right, bottom in sorted(segments, key=lambda s: (-s[2], s[1])):
        if lines and top >= lines[-1][4] - max((lines[-1][4] - lines[-1][2]) * 0.3, 1.0):
            text_, left_, top_, right_, bottom_ = lines[-1]
            lines[-1] = (f"{text_} {text}", min(left, left_), max(top, top_), max(right, right_), min(bottom, bottom_))
        else:
            lines.append((text, left, top, right, bottom))
    return lines


def test_pages_with_and_without_malformed_boxes(spark):
    rng = random.Random(5)
    pages = {}
    for page in range(12):
        place = rng.sample(range(4000), 150)
        pages[page] = [(f"w{k}", float(x % 97), x / 4, x % 97 + 9.0, x / 4 - (rng.choice([8, 11, -4, -30]) if page % 2 else rng.choice([8, 11]))) for k, x in enumerate(place)]
    df = spark.createDataFrame([(1, page, k, *s) for page, own in pages.items() for k, s in enumerate(own)], SEGMENT)
    got = reading_order_lines(df, ["doc_id", "page_index"]).orderBy("page_index", "line_index").collect()
    for page, own in pages.items():
        rows = [r for r in got if r.page_index == page]
        assert [r.line_index for r in rows] == list(range(len(rows)))
        assert [(r.text, r.left, r.top, r.right, r.bottom) for r in rows] == line_by_line(own)


@pytest.mark.parametrize("n", [1, STRETCH, STRETCH + 1, 20 * STRETCH + 7])
def test_offsets_of_words(spark, n):
    words = [("f\u00fcr", "x", "\U0001f600y", "longer")[k * k % 4] for k in range(n)]
    rows = word_segments(spark.createDataFrame([(6, 0, 3, " ".join(words))], "doc_id long, page_index int, line_index int, text string")).orderBy("word_no").collect()
    assert [r.text for r in rows] == words and [r.word_no for r in rows] == list(range(n))
    assert [r.left for r in rows] == [6.0 * sum(len(w) + 1 for w in words[:k]) for k in range(n)]
    assert len({r.seg_id for r in rows}) == n


def diff(spark, old, new):
    df = spark.createDataFrame([(1, 0, old, new)], "pair_id long, page_index int, old_lines array<string>, new_lines array<string>")
    return [tuple(r) for r in entries(df).orderBy("entry_seq").select("kind", "old_line", "new_line", "old_text", "new_text").collect()]


@pytest.mark.parametrize("old,new,kinds", [
    (["north", "south"], ["north", "south"], ["unchanged", "unchanged"]),
    (["north", "south"], ["north", "west", "south"], ["unchanged", "added", "unchanged"]),
    (["north", "west", "south", "east"], ["north", "south"], ["unchanged", "removed", "unchanged", "removed"]),
    (["total 17"], ["total 71"], ["modified"]),
    (["\tfee", "sum\u2003"], ["fee  ", " sum"], ["unchanged", "unchanged"]),
    ([], [], []),
    (["only"], [], ["removed"]),
])
def test_line_diff_kinds(spark, old, new, kinds):
    assert [e[0] for e in diff(spark, old, new)] == kinds


def test_replacement_repeats_last_line(spark):
    assert diff(spark, ["x"], ["a", "b", "c"]) == [("modified", 0, k, "x", t) for k, t in enumerate("abc")]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_diff_rebuilds_both_sides_with_fewest_edits(spark):
    rng = random.Random(3)
    cases = [(k, 0, [rng.choice("abcde") for _ in range(rng.randrange(8))], [rng.choice("abcde") for _ in range(rng.randrange(8))]) for k in range(120)]
    df = spark.createDataFrame(cases, "pair_id long, page_index int, old_lines array<string>, new_lines array<string>")
    rows = {}
    for r in entries(df).orderBy("pair_id", "entry_seq").collect():
        rows.setdefault(r.pair_id, []).append(r)
    for k, _, old, new in cases:
        mine = rows.get(k, [])
        assert sorted({r.old_line for r in mine if r.old_line is not None}) == list(range(len(old)))
        assert sorted({r.new_line for r in mine if r.new_line is not None}) == list(range(len(new)))
        assert sum(r.kind == "unchanged" for r in mine) == lcs(old, new) == len(common_lines(old, new))


def test_common_lines_in_halves(monkeypatch):
    rng = random.Random(6)
    cases = [([rng.choice("abcdefg") for _ in range(rng.randrange(90))], [rng.choice("abcdefg") for _ in range(rng.randrange(90))]) for _ in range(60)]
    whole = [common_lines(a, b) for a, b in cases]
    monkeypatch.setattr(linediff, "ROWS_HELD", 3)
    assert [common_lines(a, b) for a, b in cases] == whole and all(len(w) == lcs(a, b) for w, (a, b) in zip(whole, cases))


def boxes(spark, rows):
    return spark.createDataFrame([(1, 0, k, *map(float, r)) for k, r in enumerate(rows)], "pair_id long, page_index int, region_id int, left double, top double, right double, bottom double")


def test_regions_merge_within_gap(spark):
    got = merged(boxes(spark, [(0, 0, 10, 10), (14, 0, 20, 10), (100, 0, 110, 10)]), 6.0).collect()
    assert sorted((r.left, r.right, r.n_boxes) for r in got) == [(0, 20, 2), (100, 110, 1)]
    assert merged(boxes(spark, [(0, 0, 10, 10), (0, 20, 10, 30)]), 6.0).count() == 2
    assert merged(boxes(spark, []), 6.0).count() == 0


def test_word_diff(spark):
    rows = [(1, 0, 0, "modified", "pay two euros in May and two in June", "pay six euros in May and six in July"), (1, 0, 1, "modified", "a < b", "a < b"), (1, 0, 2, "removed", "<gone>", None)]
    df = spark.createDataFrame(rows, "pair_id long, page_index int, entry_seq int, kind string, old_text string, new_text string")
    got = [(r.deleted, r.inserted) for r in C.word_diff(df).orderBy("entry_seq").collect()]
    assert got == [("two two June", "six six July"), ("", "")]
    marks = [(r.old_markup, r.new_markup) for r in C.word_markup(df).orderBy("entry_seq").collect()]
    assert marks[0] == ("pay <del>two</del> euros in May and <del>two</del> in <del>June</del>", "pay <ins>six</ins> euros in May and <ins>six</ins> in <ins>July</ins>")
    assert marks[2] == ("<del>&lt;gone&gt;</del>", "")


def test_search(spark):
    pages = spark.createDataFrame([(1, 0, "aaaa and Some words"), (2, 0, None), (3, 1, "x" * 60 + " some WORDS here")], "doc_id long, page_index int, text string")
    asked = spark.createDataFrame([(1, "AA"), (2, " "), (3, "some words")], "query_id long, query string")
    got = {(r.query_id, r.doc_id): (r.match_count, r.snippet) for r in M.search(pages, asked).collect()}
    assert got[(1, 1)][0] == 2 and (2, 1) not in got
    assert got[(3, 3)][1].startswith("...x") and got[(3, 1)][1] == "aaaa and Some words"


def test_text_counts(spark):
    kind = "case_id string, old_text string, new_text string"
    t = spark.createDataFrame([("both", "3 pens", "4 pens"), ("both", "3 pens", "4 pens"), ("missed", None, "ink"), ("blank", " ", None)], kind)
    d = spark.createDataFrame([("both", "3  pens", None), ("both", None, "4 pens "), ("both", "other", None), ("invented", None, "glue"), ("missed", None, None)], kind)
    got = {r.case_id: (r.tp, r.fp, r.fn) for r in S.text_counts(t, d, ["case_id"]).collect()}
    assert got == {"both": (2, 1, 0), "missed": (0, 0, 1), "blank": (0, 0, 1), "invented": (0, 1, 0)}


def test_page_classes_take_the_last_status(spark):
    want = spark.createDataFrame([("c", 0, "match", 1), ("c", 0, "modified", 2), ("c", 1, "added", 1)], "case_id string, page_index int, status string, ord int")
    got = spark.createDataFrame([("c", 0, "modified"), ("c", 2, "match"), ("d", 0, "match")], "case_id string, page_index int, status string")
    rows = {r.case_id: (r.pages_total, r.pages_correct) for r in S.page_classes(want, got).collect()}
    assert rows == {"c": (3, 1), "d": (1, 0)}


def two_documents(spark):
    pages = [("a", 0, ["one", "two"]), ("a", 1, ["three"]), ("b", 0, ["one", "2"]), ("b", 1, ["three"]), ("b", 2, ["four"]), ("e", 0, [])]
    table = spark.createDataFrame(pages, "doc_id string, page_index int, lines array<string>")
    pairs = spark.createDataFrame([(k, o, n, m) for k, o, n in ((1, "a", "b"), (2, "b", "a"), (3, "a", "a"), (4, "e", "missing")) for m in C.MODES], "pair_id long, old_doc_id string, new_doc_id string, mode string")
    return table, pairs


def test_comparison_of_two_documents_in_three_modes(spark):
    table, pairs = two_documents(spark)
    regions = spark.createDataFrame([(1, 0, 0, 70.0, 40.0, 90.0, 50.0), (1, 1, 0, 300.0, 300.0, 320.0, 310.0), (1, 1, 1, 322.0, 300.0, 340.0, 310.0)], "pair_id long, page_index int, region_id int, left double, top double, right double, bottom double")
    report = C.compare(pairs, table, regions)
    got = {}
    for r in report.pages.orderBy("page_index").collect():
        got.setdefault((r.pair_id, r["mode"]), []).append(r.status)
    assert got == {
        (1, "text"): ["modified", "match", "added"], (1, "visual"): ["modified", "modified", "added"], (1, "hybrid"): ["modified", "modified", "added"],
        (2, "text"): ["modified", "match", "removed"], (2, "visual"): ["match", "match", "removed"], (2, "hybrid"): ["modified", "match", "removed"],
        **{(3, m): ["match", "match"] for m in C.MODES}, **{(4, m): ["removed"] for m in C.MODES},
    }
    entries_ = {(r.pair_id, r["mode"]): sorted((e.origin, e.kind) for e in report.entries.filter((F.col("pair_id") == r.pair_id) & (F.col("mode") == r["mode"])).collect()) for r in pairs.filter("pair_id = 1").collect()}
    assert entries_ == {(1, "text"): [("text", "modified")], (1, "visual"): [("visual", "modified")] * 2, (1, "hybrid"): [("text", "modified"), ("visual", "modified")]}
    stats = {(r.pair_id, r["mode"]): (r.total_changes, r.has_differences) for r in report.stats.collect()}
    assert stats[(1, "visual")] == (2, True) and stats[(3, "text")] == (0, False) and stats[(4, "visual")] == (0, True)
    rows = C.report_rows(report).filter("pair_id = 1 AND mode = 'hybrid'").orderBy("page").collect()
    assert [(r.page, r.old_line, r.new_text, r.regions) for r in rows] == [(1, 2, "2", 0), (2, None, None, 1)] and rows[1].new_box == "(300.0,300.0)-(340.0,310.0)"


def test_full_report(spark):
    table, pairs = two_documents(spark)
    summaries = spark.createDataFrame([("a", 2, "A title"), ("b", 3, None)], "doc_id string, page_count long, title string")
    made = C.nested_report(C.compare(pairs, table), pairs, summaries).filter("pair_id = 1 AND mode = 'text'").first()
    report = json.loads(made.report)
    assert report["old"] == {"doc_id": "a", "page_count": 2, "title": "A title"} and report["mode"] == "text" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", report["generated_at"])
    assert [p["status"] for p in report["pages"]] == ["modified", "match", "added"] and report["stats"]["entries_modified"] == 1
    entry = report["pages"][0]["entries"][0]
    assert (entry["old_text"], entry["new_text"]) == ("two", "2") and entry["old_rect"]["left"] == 72 and entry["visual_rects"] == []


def test_modes_and_cases_asked_for(spark):
    assert C.parsed_modes(None) == list(C.MODES) and C.parsed_modes(["hybrid", "text", "hybrid"]) == ["hybrid", "text"]
    with pytest.raises(ValueError):
        C.parsed_modes(["text", "audio"])
    table, pairs = two_documents(spark)
    report = C.compare(pairs.filter("pair_id < 3"), table)
    pages = spark.createDataFrame([(1, 0, "modified", None, None, None), (1, 1, "match", None, "modified", None), (1, 2, "added", None, None, None), (2, 0, "match", None, None, None)], "case_id long, page_index int, status string, text_status string, visual_status string, hybrid_status string")
    regions = spark.createDataFrame([(1, 0, 0, 1, 1, "two", "2")], "case_id long, page_index int, region_id int, old_line int, new_line int, old_text string, new_text string")
    got = {(r.case_id, r["mode"]): r for r in S.case_scores(report, pages, regions).collect()}
    assert (got[(1, "text")].text_tp, got[(1, "text")].pages_correct, got[(1, "visual")].pages_correct, got[(1, "visual")].region_tp) == (1, 3, 2, 1)
    assert got[(2, "text")].doc_false_positive and got[(2, "text")].text_fp == 1 and got[(1, "hybrid")].region_tp is None
    assert {r.case_id for r in S.case_scores(report, pages, regions, cases=[1]).collect()} == {1}
    with pytest.raises(ValueError):
        S.case_scores(report, pages, regions, cases=[77])
    with pytest.raises(ValueError):
        S.case_list(spark.createDataFrame([], "name string, description string"))


def test_recent_and_names(spark):
    rows = [(1, f"p{k % 6}", k) for k in range(7)]
    df = spark.createDataFrame(rows, "u int, pair string, ts int")
    assert [r.pair for r in M.recent(df, "u", ["pair"], 5).orderBy("place").collect()] == ["p0", "p5", "p4", "p3", "p2"]
    one = spark.createDataFrame([("/a/b.PDF",), ("C:\\x\\y.txt",), ("dir/",), (None,)], "p string")
    assert [tuple(r) for r in one.select(T.base_name(F.col("p")), T.extension(F.col("p"))).collect()] == [("b.PDF", "pdf"), ("y.txt", "txt"), ("dir/", ""), (None, None)]
    n = spark.createDataFrame([(0.25,), (0.35,), (None,)], "v double").select(T.one_decimal(F.col("v")).alias("t"))
    assert [r.t for r in n.collect()] == ["0.2", "0.3", ""]


def test_ground_truth_folders(spark, tmp_path):
    for name, files in (("good", ["old.pdf", "new.pdf"]), ("half", ["old.pdf"])):
        d = tmp_path / name
        d.mkdir()
        (d / "ground_truth.json").write_text(json.dumps({"name": name, "description": "d", "pages": [{"page": 1, "status": "modified", "regions": [{"rect": None, "old_text": "a", "new_text": "b"}]}]}))
        for f in files:
            (d / f).write_bytes(b"%PDF-1.4")
    cases = tables.ground_truth(spark, str(tmp_path))
    assert [r.case_id for r in cases.collect()] == ["good"]
    assert [(r.page, r.old_text, r.rect) for r in tables.truth_rows(cases).collect()] == [(1, "a", None)]
    (tmp_path / "good" / "empty.pdf").write_bytes(b"")
    reasons = {Path(r.path).name: r.reason for r in tables.checked_binaries(spark, str(tmp_path)).collect()}
    assert reasons == {"old.pdf": None, "new.pdf": None, "ground_truth.json": "wrong kind", "empty.pdf": "empty"}


def test_files_over_the_limit_are_rejected_unread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LIMIT_BYTES", 100)
    (tmp_path / "big.pdf").write_bytes(b"%PDF" + b"x" * 500)
    (tmp_path / "small.pdf").write_bytes(b"%PDF")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "200")
    try:
        assert {Path(r.path).name: r.reason for r in tables.checked_binaries(spark, str(tmp_path)).collect()} == {"big.pdf": "too large", "small.pdf": None}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_given_segments(spark, tmp_path):
    rows = [(1, 0, 0, "kept", 1.0, 9.0, 5.0, 2.0), (1, 0, 1, " \u3000", 1.0, 9.0, 5.0, 2.0)]
    spark.createDataFrame(rows, tables.SEGMENT).write.parquet(str(tmp_path / "s"))
    assert [r.text for r in tables.segments(spark, str(tmp_path / "s")).collect()] == ["kept"]


CELL = "page int, side string, x int, y int, r int, g int, b int, a int"


def test_colours(spark):
    row = lambda *c: Row(r=c[0], g=c[1], b=c[2], a=c[3])
    df = spark.createDataFrame([Row(p=row(0, 0, 0, 255), q=row(255, 255, 255, 255)), Row(p=row(9, 8, 7, 255), q=row(9, 8, 7, 0)), Row(p=row(200, 30, 90, 128), q=row(20, 130, 9, 255))])

    def want(p, q):
        y, i, k = (sum(w * (p[n] - q[n]) for n, w in enumerate(axis)) for axis in ((0.29889531, 0.58662247, 0.11448223), (0.59597799, -0.27417610, -0.32180189), (0.21147017, -0.52261711, 0.31114694)))
        o = (p[3] + q[3]) / 510
        return (max(0, o * (y * y + 0.48 * i * i) + 0.48 * k * k) + max(0, o * y * y + 0.3 * i * i + 0.3 * k * k)) ** 0.5

    for r in df.select("p", "q", colour.difference(F.col("p"), F.col("q")).alias("d"), colour.luminance(F.col("p")).alias("l")).collect():
        assert abs(r.d - want(tuple(r.p), tuple(r.q))) < 1e-9 and abs(r.l - (0.29889531 * r.p.r + 0.58662247 * r.p.g + 0.11448223 * r.p.b)) < 1e-9


def test_grid(spark):
    white, ink = (255, 255, 255, 255), (40, 60, 20, 255)
    cells = [(0, "old", x, y, *white) for x in range(24) for y in range(16)]
    cells += [(0, "new", x, y, *(ink if 5 <= x < 14 and 4 <= y < 11 or (x, y) == (21, 2) else white)) for x in range(24) for y in range(16)]
    cells += [(1, "old", 3, 3, *ink), (1, "new", 4, 5, *ink)]  # moved by less than the reach; missing cells are white
    cells += [(2, "old", x, y, *ink) for x in range(6) for y in range(6)] + [(2, "new", 9, 9, *white)]
    df = spark.createDataFrame(cells, CELL)
    mask = M.grid_mask(df, ["page"])
    found = {r.page: (r.left, r.top, r.right, r.bottom) for r in M.grid_regions(mask, ["page"]).collect()}
    # only cells at least the reach away from any like one differ: new ink on white has white around, old ink has none
    assert found == {0: (7, 6, 12, 9), 2: (0, 0, 6, 6)}
    assert M.grid_regions(mask, ["page"], least=99).count() == 0


def test_grid_offset(spark):
    rng = random.Random(5)
    shade = {(x, y): rng.randrange(256) for x in range(-4, 44) for y in range(-4, 36)}
    cells = [(0, "old", x, y, *[shade[x, y]] * 3, 255) for x in range(40) for y in range(32)]
    cells += [(0, "new", x, y, *[shade[x - 1, y + 2]] * 3, 255) for x in range(40) for y in range(32)]
    cells += [(1, s, x, y, *[shade[x, y]] * 3, 255) for s in ("old", "new") for x in range(20) for y in range(20)]
    got = {r.page: (r.dx, r.dy, r.score) for r in M.grid_offset(spark.createDataFrame(cells, CELL), ["page"]).collect()}
    assert got == {0: (1.0, -2.0, 0.0), 1: (0.0, 0.0, 0.0)}


def test_page_offset(spark):
    schema = "page int, dx double, dy double"
    by_text = spark.createDataFrame([(1, 4.0, 3.0), (2, 0.5, -0.5), (3, 90.0, 0.0)], schema)
    by_grid = spark.createDataFrame([(1, 1.0, 1.0), (4, 2.0, 2.0)], schema)
    got = {r.page: (r.dx, r.dy) for r in M.page_offset(by_text, by_grid, ["page"], 600, 800).collect()}
    assert got == {1: (4, 3), 2: (0, 0), 3: (0, 0), 4: (2, 2)}


def test_sinks_round_trip(spark, tmp_path):
    from foliospark.sources import sinks

    pages = spark.createDataFrame([(1, 0, ['say "a", b', "same"], ["say c", "same"]), (1, 1, ["x"], None)], "pair_id long, page_index int, old_lines array<string>, new_lines array<string>")
    e = entries(pages)
    rows = C.change_rows(e)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.first().old_text == 'say "a", b' and back.columns == rows.columns
    modes = spark.createDataFrame([(1, "text")], "pair_id long, mode string")
    names = spark.createDataFrame([(1, "a", "b", "text")], "pair_id long, old_doc_id string, new_doc_id string, mode string")
    none = spark.createDataFrame([], "doc_id string, page_count long, title string")
    sinks.write_reports(C.nested_report(C.compare_aligned(pages, modes), names, none), str(tmp_path / "reports"))
    report = json.loads(spark.read.text(str(tmp_path / "reports")).first().value)
    assert report["pair_id"] == 1
    assert [p["status"] for p in report["pages"]] == ["modified", "removed"] and report["pages"][0]["entries"][0]["new_text"] == "say c"
    golden = C.changes(e).select("pair_id", (F.col("page_index") + 1).alias("page"), "entry_seq", "old_text", "new_text")
    sinks.write_ground_truth(golden, C.page_status(pages, e), str(tmp_path / "truth"))
    truth = spark.read.schema(tables.GROUND_TRUTH).json(str(tmp_path / "truth")).first()
    assert [(p.page, p.status, len(p.regions)) for p in truth.pages] == [(1, "modified", 1), (2, "removed", 0)]


def test_pages_with_few_edits_have_the_script_of_the_table():
    import random

    import numpy as np

    from foliospark.operators import linediff

    rng = random.Random(1)
    for _ in range(400):
        kinds = rng.choice([1, 2, 3, 8, 30])
        a = [rng.randrange(kinds) for _ in range(rng.randrange(25))]
        b = [rng.randrange(kinds) for _ in range(rng.randrange(25))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.9]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        assert linediff.by_frontiers(a, b, 1000) == linediff.by_table(a, b)
    old = [f"line {k % 5000}" for k in range(100_000)]
    new = list(old)
    for _ in range(50):
        new[rng.randrange(len(new))] = "other"
    assert len(linediff.common_lines(old, new)) >= 99_950


def test_comparison_refuses_what_it_cannot_compare(spark):
    from foliospark.operators import compare, scoring

    page = "doc_id long, page_index int, lines array<string>"
    pages = spark.createDataFrame([(1, 0, ["a"]), (2, 0, ["b"])], page)
    pair = "pair_id long, old_doc_id long, new_doc_id long, mode string"
    with pytest.raises(ValueError, match="visuel"):
        compare.compare(spark.createDataFrame([(1, 1, 2, "visuel")], pair), pages)
    with pytest.raises(ValueError, match="1 page 0"):
        compare.compare(spark.createDataFrame([(1, 1, 2, "text")], pair), pages.union(pages))
    pairs = spark.createDataFrame([(1, 1, 2, "text"), (2, 1, 9, "text"), (3, 8, 2, "visual"), (4, 8, 9, "hybrid")], pair)
    report = compare.compare(pairs, pages)
    assert sorted(tuple(r) for r in report.rejected.collect()) == [(2, "text", "new"), (3, "visual", "old"), (4, "hybrid", "both")]
    assert {r.pair_id for r in report.stats.collect()} | {r.pair_id for r in report.rejected.collect()} == {1, 2, 3, 4}
    truth = spark.createDataFrame([(1, 0, "modified", None, None, None)], "case_id long, page_index int, status string, text_status string, visual_status string, hybrid_status string")
    none = spark.createDataFrame([], "case_id long, page_index int, region_id int, old_line int, new_line int, old_text string, new_text string")
    assert {r.mode for r in scoring.case_scores(report, truth, none, only=["text"]).collect()} == {"text"}
    with pytest.raises(ValueError, match="unknown mode"):
        scoring.case_scores(report, truth, none, only=["txt"])


def test_sinks_keep_order_in_a_bounded_number_of_files(spark, tmp_path):
    from foliospark.sources import sinks

    rows = [(p, (p * 7) % 5 + 1, e, f'text "{e}", of {p}') for p in range(3000) for e in range(3)]
    changes = spark.createDataFrame(rows, "pair_id long, page long, entry_seq long, old_text string").repartition(7)
    sinks.write_change_list(changes, str(tmp_path / "list"), files=5)
    files = sorted((tmp_path / "list").glob("part-*.csv"))
    assert 1 < len(files) <= 5
    read = [r for f in files for r in spark.read.option("header", True).option("escape", '"').csv(str(f)).collect()]
    assert [(int(r.pair_id), int(r.page), int(r.entry_seq), r.old_text) for r in read] == sorted(rows)
    reports = spark.range(2000).selectExpr("concat('p', lpad(id, 4, '0')) as pair_id", "'text' as mode", "to_json(struct(id as n)) as report").repartition(3)
    sinks.write_reports(reports, str(tmp_path / "reports"), files=4)
    files = sorted((tmp_path / "reports").glob("part-*.txt"))
    lines = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert len(files) <= 4 and lines == [{"pair_id": f"p{k:04}", "n": k} for k in range(2000)]


def test_search_is_linear_in_a_word(spark):
    import time

    from foliospark.operators import misc

    long = "ab\U0001f600" * 30_000 + "needle" + "cd" * 100_000
    pages = spark.createDataFrame([(1, 0, f"short {long} end"), (2, 0, "Needle in a haystack"), (3, 0, "n e")], "doc_id long, page_index int, text string")
    asked = spark.createDataFrame([(1, "needle"), (2, "\U0001f600n"), (3, "e"), (4, " "), (5, "end")], "query_id long, query string")
    began = time.time()
    got = sorted((r.query_id, r.doc_id, r.match_count) for r in misc.search(pages, asked).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 1, 4), (3, 2, 3), (3, 3, 1), (5, 1, 1)]
    assert time.time() - began < 40


def test_frozen_comparison_scores_one_against_itself(spark, sf, tmp_path):
    from foliospark import catalog
    from foliospark.operators import scoring
    from foliospark.plans.shared import written
    from foliospark.sources import sinks, tables

    pages = written(catalog.revised_pages(tables.table(spark, sf, "documents").limit(60)), "pages")
    report = catalog.C.compare_aligned(pages, pages.select("pair_id").distinct().withColumn("mode", F.lit("text")))
    golden = report.entries.select("pair_id", (F.col("page_index") + 1).alias("page"), "entry_seq", *[F.when(F.col("kind") != k, F.col(c)).alias(c) for k, c in (("added", "old_text"), ("removed", "new_text"))])
    sinks.write_ground_truth(golden, report.pages, str(tmp_path / "frozen"))
    named = lambda df: df.withColumn("pair_id", F.concat(F.lit("pair "), "pair_id"))
    own = catalog.C.Report(named(report.pages), named(report.entries), named(report.stats))
    truth = tables.truth_of_cases(tables.frozen_cases(spark, str(tmp_path / "frozen")))
    assert truth[1].count() == golden.count() > 50
    scores = scoring.by_mode(scoring.case_scores(own, *truth)).collect()
    assert [(r.mode, r.text_f1, r.page_accuracy, r.false_positive_docs) for r in scores] == [("text", 1.0, 1.0, 0)]
    # and through folders of case files, with boxes
    for name, rect in (("moved", "[100, 100, 200, 160]"), ("same", None)):
        (tmp_path / "cases" / name).mkdir(parents=True)
        for file in ("old.pdf", "new.pdf"):
            (tmp_path / "cases" / name / file).write_bytes(b"%PDF")
        regions = [{"rect": json.loads(rect)}] if rect else []
        (tmp_path / "cases" / name / "ground_truth.json").write_text(json.dumps({"name": name, "description": "", "pages": [{"page": 1, "status": "modified" if rect else "match", "text_status": "match", "regions": regions}]}, indent=1))
    pages = spark.createDataFrame([("moved", 0, ["x"], ["x"]), ("same", 0, ["x"], ["x"])], "pair_id string, page_index int, old_lines array<string>, new_lines array<string>")
    seen = spark.createDataFrame([("moved", 0, 1, 110.0, 105.0, 190.0, 150.0)], "pair_id string, page_index int, region_id long, left double, top double, right double, bottom double")
    report = catalog.C.compare_aligned(pages, pages.select("pair_id").withColumn("mode", F.explode(F.array(F.lit("text"), F.lit("visual")))), seen)
    scores = {r.mode: r for r in scoring.by_mode(scoring.case_scores(report, *tables.truth_of_cases(tables.ground_truth(spark, str(tmp_path / "cases"))))).collect()}
    assert scores["visual"].region_f1 == 1.0 and scores["visual"].page_accuracy == 1.0 and scores["text"].page_accuracy == 1.0
