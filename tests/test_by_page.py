"""Comparisons and scores that are solved page by page against the ways over whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark import catalog
from foliospark.operators import compare, layout, misc, regions, scoring, tiles
from foliospark.operators.revisions import revised_pages
from foliospark.plans import order, shared
from foliospark.sources.tables import document_summary, pages_of

LINES = "pair_id long, page_index int, old_lines array<string>, new_lines array<string>"


def made_pages(spark):
    rng = random.Random(8)
    line = lambda: rng.choice(["a", "bb ccc", "a long line of words", "\U0001f600", "x"]) + rng.choice(["", str(rng.randrange(40))])
    page = lambda n: [line() for _ in range(n)]
    out = []
    for k in range(24):
        old = page(rng.choice([1, 3, 20, 20, 300 if k < 2 else 5]))
        new = [rng.choice([t, t, line()]) for t in old[rng.randrange(2):] + page(rng.randrange(3))]
        out += [(k % 9, k // 9, old, old if k % 6 == 5 else new)]
    return spark.createDataFrame([*out, (20, 0, ["x"], None), (20, 1, None, ["y"]), (21, 0, ["one"], ["line"] * 400)], LINES)


def shown(df, columns):
    return sorted(map(str, df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.select(*columns).dtypes]).collect()))


def test_pages_in_one_row_give_what_the_tables_give(spark, monkeypatch):
    pages = made_pages(spark)
    modes = pages.select("pair_id").distinct().withColumn("mode", F.explode(F.array(*map(F.lit, compare.MODES)))).filter("pair_id <> 4 OR mode = 'hybrid'")
    want = compare._compared(pages, None, compare._modes(modes))
    monkeypatch.setattr(regions, "HELD", 1000)
    got = compare.compare_aligned(pages, modes)
    for part in ("pages", "stats", "entries"):
        columns = getattr(want, part).columns
        assert shown(getattr(got, part), columns) == shown(getattr(want, part), columns) != []
    bare = compare.compare_aligned(pages, modes, texts=False)
    assert shown(bare.pages, want.pages.columns) == shown(want.pages, want.pages.columns)


def test_statuses_need_no_table_with_texts(spark, monkeypatch):
    kept = []
    real = compare.written
    monkeypatch.setattr(compare, "written", lambda df, name: kept.append(df.schema.simpleString()) or real(df, name))
    pages = spark.createDataFrame([(d, 0, [f"line {d % 3}", "same", f"x{d}"]) for d in range(4)], "doc_id long, page_index int, lines array<string>")
    pairs = spark.createDataFrame([(k, k, k + 1, m) for k in range(3) for m in compare.MODES], "pair_id long, old_doc_id long, new_doc_id long, mode string")
    want, n = compare.compare(pairs, pages), len(kept)
    got = compare.compare(pairs, pages, texts=False)
    assert len(kept) == n + 1 and "text" not in kept[n] and "lines" not in kept[n]
    assert shown(got.stats, want.stats.columns) == shown(want.stats, want.stats.columns)


def test_texts_of_all_modes_are_scored_once(spark):
    pages = made_pages(spark)
    modes = pages.select("pair_id").distinct().withColumn("mode", F.explode(F.array(*map(F.lit, compare.MODES))))
    report = compare.compare_aligned(pages, modes)
    lines = report.lines.filter("pair_id % 2 = 0 OR entry_seq % 3 = 0").select(F.col("pair_id").alias("case_id"), "page_index", F.col("entry_seq").alias("region_id"), "old_line", "new_line", "old_text", "new_text")
    truth = pages.select(F.col("pair_id").alias("case_id"), "page_index", F.lit("match").alias("status"), *[F.lit(None).cast("string").alias(f"{m}_status") for m in compare.MODES])
    got = scoring.case_scores(report, truth, lines)
    want = scoring.case_scores(compare.Report(report.pages, report.entries, report.stats), truth, lines)
    assert shown(got, want.columns) == shown(want, want.columns) != []
    assert scoring.case_scores(report, truth, lines, parts=()).columns == want.columns[:6]


def test_a_text_is_cut_into_lines_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = revised_pages(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("split(") == 1
    texts = [(10, "a\nb"), (11, "a"), (21, "\n".join(map(str, range(21)))), (31, " \n"), (41, None), (None, "x")]
    got = sorted((r.pair_id or 0, r.page_index, len(r.old_lines or []), r.old_lines is None, r.new_lines) for r in revised_pages(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    numbers = [str(k) for k in range(21)]
    assert got == [
        (0, 0, 1, False, ["x"]), (10, 0, 2, False, ["a", "b"]), (11, 0, 1, False, ["a"]), (11, 1, 0, True, ["appended page of 11"]),
        (21, 0, 20, False, numbers[:20]), (21, 1, 1, False, ["20"]), (21, 2, 0, True, ["appended page of 21"]),
    ]


def test_search_shuffles_no_texts(spark, sf):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "100000")  # less than the documents
        plan = catalog.search_hits(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan


def offsets_of_tables(pages):
    """Page offsets by joins over tables of lines."""
    known = catalog._text_offset(pages)
    rest = tiles.best_shifts(catalog._tiles(pages.join(known.select(*catalog.PAGE), catalog.PAGE, "left_anti"), 4), catalog.PAGE)
    return misc.page_offset(known, rest, catalog.PAGE, 612 * 300 / 72, 842 * 300 / 72)


def test_line_shifts_of_odd_pages(spark):
    rng = random.Random(3)
    words = ["a", "Bb", "ÉtÉ", "İx", "ΟΣ", "", "", "c\td", " ", "\x1c", "\U0001f600", "a"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))
    rows = []
    for k in range(160):
        old = [line() for _ in range(rng.randrange(1, 9))]
        new = [rng.choice([t, t.lower(), f"  {t} ", line()]) for t in old[rng.randrange(2):]] + [line() for _ in range(rng.randrange(3))]
        rows += [(rng.choice([k, -k, k - 3]) if k % 40 else None, k, old, old if k % 8 == 7 else new)]
    pages = spark.createDataFrame([*rows, (500, 0, ["x"], None), (501, 0, [" "], [" "]), (502, 0, ["x y"], ["z " * 30] * 30)], LINES).repartition(3)
    found = layout.line_shifts(pages, catalog.PAGE, "pair_id")
    got, want = misc._in_dots(found.filter("x IS NOT NULL"), catalog.PAGE), catalog._text_offset(pages)
    assert shown(got, want.columns) == shown(want, want.columns) != []
    assert got.filter("dx <> 0 OR dy <> 0").count() > 9
    size = 612 * 300 / 72, 842 * 300 / 72
    got, want = misc.offsets_by_page(pages, catalog.PAGE, "pair_id", *size), offsets_of_tables(pages)
    assert shown(got, want.columns) == shown(want, want.columns) and got.count() > found.filter("x IS NOT NULL").count()


def test_page_offset_keeps_lines_in_their_rows(spark, sf, monkeypatch, tmp_path):
    plans = []
    for module in (catalog, misc, tiles):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, name, real=real: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    made = catalog.page_offset(spark, sf)
    assert plans and not any("Exchange" in p for p in plans) and made.count() > 0
    texts = [(k % 50 - 5 if k % 17 else None, f"Line {k}\nline {k % 3}\n{'a b ' * (k % 5)}\nlast") for k in range(70)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.page_offset(spark, str(tmp_path))
    want = offsets_of_tables(revised_pages(spark.createDataFrame(texts, "doc_id long, text string")).localCheckpoint())
    assert shown(got, want.columns) == shown(want, want.columns) != []


def test_reports_of_whole_documents(spark, monkeypatch):
    rng = random.Random(11)
    line = lambda: rng.choice(["a", "bb  ccc", 'say "x", \\y', "\U0001f600 Ä", "a long line of words", " ", "tab\there"]) + rng.choice(["", str(rng.randrange(30))])
    ids = [*range(-3, 20), *(2**53 + k for k in range(12))]
    texts = [(d, rng.choice([None, "", " \n"]) if d % 6 == 5 else "\n".join(line() for _ in range(rng.choice([1, 7, 20, 21, 65]))), rng.choice([None, " T  i", ""])) for d in ids]
    texts[4] = (1, texts[3][1], "same")
    docs = spark.createDataFrame([*texts, (None, "x", "y")], "doc_id long, text string, title string").repartition(5)
    pairs = [(o, o, n, rng.sample(compare.MODES, rng.randrange(1, 4))) for o, n in zip(ids, ids[1:], strict=False)] + [(100, 3, 999, ["hybrid"]), (101, 999, 3, ["text"]), (102, 998, 999, ["text"]), (103, 2, 2, ["visual"])]
    pairs = spark.createDataFrame(pairs, "pair_id long, old_doc_id long, new_doc_id long, modes array<string>")
    apart = pairs.withColumn("mode", F.explode("modes")).drop("modes")
    at = F.timestamp_seconds(F.lit(0))
    want = compare.nested_report(compare.compare(apart, pages_of(docs).select("doc_id", "page_index", "lines")), apart, document_summary(docs.withColumnRenamed("title", "source")), at)
    want = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(compare, "written", None)  # no table in between
    monkeypatch.setattr(compare, "CHARS_HELD", 5000)
    monkeypatch.setattr(shared, "PART_BYTES", 500)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "3")  # a report's pages come in several batches
        made = compare.document_reports(pairs, docs, at)
        assert sorted(map(tuple, made.collect())) == want and len(want) > 40
        assert max(r.n_pages for r in made.collect()) == 4
        twice = docs.unionByName(spark.createDataFrame([(7, " ", "z")], docs.schema))
        assert sorted(map(tuple, compare.document_reports(pairs, twice, at).collect())) == want
    finally:
        spark.conf.set(key, before)
    with pytest.raises(ValueError, match="7 page 0"):
        compare.document_reports(pairs, docs.unionByName(spark.createDataFrame([(7, "more", "z")], docs.schema)), at)
    with pytest.raises(ValueError, match="unknown mode: txt"):
        compare.document_reports(pairs.withColumn("modes", F.array(F.lit("txt"))), docs, at)


def test_json_report_writes_no_texts(spark, sf, monkeypatch):
    kept = []
    for module in (compare, order):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, name, real=real: kept.append(df.schema.simpleString()) or real(df, name))
    plan = catalog.json_report(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert kept and not any("text" in k or "lines" in k for k in kept)
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan[: plan.index("Join")]  # nothing is shuffled once documents have met


def test_stray_boxes_of_large_ids(spark):
    pages = spark.createDataFrame([(2**53 + k, 0, ["x"], ["y"]) for k in range(21)], LINES)
    modes = compare._modes(pages.select("pair_id", F.lit("visual").alias("mode")))
    got, want = compare.compare_aligned(pages, modes.select("pair_id", F.explode("modes").alias("mode"))), compare._compared(pages, None, modes)
    assert shown(got.entries, want.entries.columns) == shown(want.entries, want.entries.columns) != []
