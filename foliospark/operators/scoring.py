"""Scores of a change detector against ground truth: texts, regions, pages, documents, modes, gates.

truth_pages (case_id, page_index, status), truth_texts / truth_boxes (case_id, region_id, ...), detections with a node number
each. Matches are whole-document and many-to-many.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import f1, normalised, numeral, precision, recall, valid
from foliospark.plans.shared import written
from .compare import Report, boxed, contained_pairs, parsed_modes
from .layout import flipped


def counts(truth: DataFrame, found: DataFrame, matches: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, tp, fp, fn): truths matched, detections never matched, truths never matched. `matches` holds (case, t, d)."""
    t = truth.groupBy(case).agg(F.count("*").alias("n_truth"))
    d = found.groupBy(case).agg(F.count("*").alias("n_found"))
    m = matches.groupBy(case).agg(F.count_distinct("t").alias("tp"), F.count_distinct("d").alias("hit"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = t.join(d, case, "full").join(m, case, "left")
    return both.select(case, zero(F.col("tp")).alias("tp"), (zero(F.col("n_found")) - zero(F.col("hit"))).alias("fp"), (zero(F.col("n_truth")) - zero(F.col("tp"))).alias("fn"))


def text_counts(truth: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn) of texts: a row of one side is matched if the other side of its case has its normalised new text, or its old
    one. Each side meets the distinct texts of the other, so repeated lines don't multiply. Rows without any text don't count."""
    keyed = lambda df: df.filter("old_text IS NOT NULL OR new_text IS NOT NULL").select(*by, *[F.nullif(normalised(F.col(f"{s}_text")), F.lit("")).alias(s) for s in ("old", "new")])
    t, d = keyed(truth), keyed(found)

    def matched(own: DataFrame, other: DataFrame) -> DataFrame:
        for s in ("old", "new"):
            known = other.filter(F.col(s).isNotNull()).select(*by, s).distinct().withColumn(f"has_{s}", F.lit(True))
            own = own.join(known, [*by, s], "left")
        return own.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.coalesce("has_old", F.lit(False)) | F.coalesce("has_new", F.lit(False))).alias("hit"))

    zero = lambda c: F.coalesce(c, F.lit(0))
    side = lambda df, name: df.withColumnsRenamed({"n": f"n_{name}", "hit": f"hit_{name}"})
    both = side(matched(t, d), "t").join(side(matched(d, t), "d"), by, "full")
    return both.select(*by, zero(F.col("hit_t")).alias("tp"), (zero(F.col("n_d")) - zero(F.col("hit_d"))).alias("fp"), (zero(F.col("n_t")) - zero(F.col("hit_t"))).alias("fn"))


def region_counts(truth: DataFrame, found: DataFrame, share: float) -> DataFrame:
    """(case_id, tp, fp, fn) of boxes, whatever their page: a box is matched if one of the other side shares `share` of the smaller one. Each distinct box of
    a case meets the other side's once, so that pages with equal lines don't multiply."""
    box = ["left", "top", "right", "bottom"]
    distinct = lambda df: df.groupBy("case_id", *box).agg(F.count("*").alias("n")).withColumn("node", F.xxhash64("case_id", *box))
    t, d = distinct(truth), distinct(found)
    pairs = written(contained_pairs(t, d, share), "contained")

    def side(df: DataFrame, node: str, name: str) -> DataFrame:
        hit = pairs.select("case_id", F.col(node).alias("node")).distinct().withColumn("hit", F.lit(True))
        return df.join(hit, ["case_id", "node"], "left").groupBy("case_id").agg(F.sum("n").alias(f"n_{name}"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias(f"hit_{name}"))

    zero = lambda c: F.coalesce(c, F.lit(0))
    both = side(t, "t", "t").join(side(d, "d", "d"), "case_id", "full")
    return both.select("case_id", zero(F.col("hit_t")).alias("tp"), (zero(F.col("n_d")) - zero(F.col("hit_d"))).alias("fp"), (zero(F.col("n_t")) - zero(F.col("hit_t"))).alias("fn"))


def status_for(mode: Column) -> Column:
    """The status expected in a mode: its override, else that of the page."""
    return F.coalesce(F.when(mode == "text", F.col("text_status")).when(mode == "visual", F.col("visual_status")).when(mode == "hybrid", F.col("hybrid_status")), F.col("status"))


def with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn), "valid": valid(tp, fp, fn)})


def page_classes(expected: DataFrame, detected: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(case_id or by, pages_total, pages_correct, page_accuracy): a page that only one side has is wrong; of a page that a side names
    more than once the last status by its order `ord` (if there is one) counts."""
    by = by or ["case_id"]

    def last(df: DataFrame, name: str) -> DataFrame:
        ordered = F.max_by("status", "ord") if "ord" in df.columns else F.max("status")
        return df.groupBy(*by, "page_index").agg(ordered.alias(name))

    each = last(expected, "want").join(last(detected, "got"), [*by, "page_index"], "full").groupBy(*by).agg(F.count("*").alias("pages_total"), F.count_if(F.col("want") == F.col("got")).alias("pages_correct"))
    return each.withColumn("page_accuracy", F.coalesce(F.try_divide("pages_correct", "pages_total"), F.lit(0.0)))


def false_positives(expected: DataFrame, stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(case_id or by, doc_false_positive): differences reported where every page should match."""
    by = by or ["case_id"]
    clean = expected.groupBy(*by).agg(F.bool_and(F.col("status") == "match").alias("clean"))
    return stats.select(*by, "has_differences").join(clean, by, "left").select(*by, (F.col("has_differences") & F.coalesce("clean", F.lit(True))).alias("doc_false_positive"))


def case_scores(report: Report, truth_pages: DataFrame, truth_regions: DataFrame, cases: list | None = None, share: float = 0.5, only: list[str] | None = None, parts: tuple[str, ...] = ("text", "region")) -> DataFrame:
    """(case_id, mode, pages_total, pages_correct, page_accuracy, doc_false_positive, text_tp ... region_fn): a report against truth of its own.

    Texts are scored in the modes text and hybrid, boxes in the mode visual where a case has a true box. `cases` keeps some
    cases only; if there are none of these it is an error. `only` keeps some modes; an unknown one is an error. All cases and modes are one plan.
    Of texts and boxes only the `parts` named are scored; the others' columns are left out.
    """
    asked = F.col("mode").isin(*parsed_modes(only))
    report = replace(report, entries=report.entries.filter(asked), pages=report.pages.filter(asked), stats=report.stats.filter(asked))
    by = ["case_id", "mode"]
    name = lambda df: df.withColumnRenamed("pair_id", "case_id")
    found, pages, stats = name(report.entries), name(report.pages), name(report.stats)
    if cases:
        keep = F.col("case_id").isin(*cases)
        truth_pages, truth_regions, found, pages, stats = (df.filter(keep) for df in (truth_pages, truth_regions, found, pages, stats))
        report = replace(report, lines=None if report.lines is None else report.lines.filter(F.col("pair_id").isin(*cases)))
        if truth_pages.isEmpty():
            raise ValueError(f"no case of that name: {', '.join(map(str, cases))}")
    modes = stats.select(*by)
    expected = truth_pages.join(modes, "case_id").withColumn("status", status_for(F.col("mode")))
    base = page_classes(expected, pages, by).join(false_positives(expected, stats, by), by, "left")
    as_text = F.col("mode").isin("text", "hybrid")
    named = lambda df, n: df.select(*by, *[F.col(k).alias(f"{n}_{k}") for k in ("tp", "fp", "fn")])
    if "text" in parts:
        if report.lines is None:
            text = text_counts(truth_regions.join(modes.filter(as_text), "case_id"), found.filter(as_text & (F.col("origin") == "text")), by)
        else:  # the modes' texts are the same: they are scored once
            text = text_counts(truth_regions, name(report.lines), ["case_id"]).join(modes.filter(as_text), "case_id")
        base = base.join(named(text, "text"), by, "left")
    if "region" in parts:
        boxes = true_boxes(truth_regions)
        region = region_counts(boxes, found.filter("mode = 'visual'"), share).join(boxes.select("case_id").distinct(), "case_id", "left_semi").withColumn("mode", F.lit("visual"))
        base = base.join(named(region, "region"), by, "left")
    return base


def true_boxes(truth_regions: DataFrame) -> DataFrame:
    """(case_id, node, left, top, right, bottom): boxes of a truth table, as given (rect: left, top, right, bottom from the top left corner, or null), or else of its changed lines,
    those of the new side where there is one."""
    if "rect" in truth_regions.columns:
        at = [F.get("rect", k).cast("double").alias(n) for k, n in enumerate(("left", "top", "right", "bottom"))]
        return truth_regions.filter("rect IS NOT NULL").select("case_id", F.xxhash64("case_id", "page_index", "region_id").alias("node"), *at)
    placed = boxed(truth_regions.filter("old_line IS NOT NULL OR new_line IS NOT NULL"))
    side = lambda n: F.coalesce(F.col(f"new_{n}"), F.col(f"old_{n}"))
    return placed.select("case_id", F.xxhash64("case_id", "page_index", "region_id").alias("node"), side("left").alias("left"), flipped(side("top")).alias("top"), side("right").alias("right"), flipped(side("bottom")).alias("bottom"))


def case_list(cases: DataFrame) -> DataFrame:
    """(name, description) in the order of names; no case at all is an error."""
    if cases.isEmpty():
        raise ValueError("no cases")
    return cases.select("name", "description").orderBy("name")


def case_strings(scores: DataFrame) -> DataFrame:
    """(case_id, mode, prf): precision, recall and F1 of the case's metric with three decimals, n/a without signal."""
    tp, fp, fn = (F.coalesce(F.col(f"text_{k}"), F.col(f"region_{k}")) for k in ("tp", "fp", "fn"))
    show = lambda x: numeral(x, "0.000")
    parts = F.concat_ws(" / ", show(precision(tp, fp)), show(recall(tp, fn)), show(f1(tp, fp, fn)))
    return scores.select("case_id", "mode", F.when(valid(tp, fp, fn), parts).otherwise("n/a").alias("prf"))


def by_mode(scores: DataFrame) -> DataFrame:
    """Micro-averages over the valid cases of a mode, pages and false positives summed."""
    metric = lambda n: [F.sum(F.when(F.col(f"{n}_tp") + F.col(f"{n}_fp") + F.col(f"{n}_fn") > 0, F.col(f"{n}_{k}"))).alias(f"{n}_{k}") for k in ("tp", "fp", "fn")]
    out = scores.groupBy("mode").agg(F.count("*").alias("cases"), *metric("text"), *metric("region"), F.sum("pages_total").alias("pages_total"), F.sum("pages_correct").alias("pages_correct"), F.count_if("doc_false_positive").alias("false_positive_docs"))
    rate = lambda n: F.when(F.col(f"{n}_tp").isNotNull(), f1(F.col(f"{n}_tp"), F.col(f"{n}_fp"), F.col(f"{n}_fn"))).alias(f"{n}_f1")
    return out.select("*", rate("text"), rate("region"), F.coalesce(F.try_divide("pages_correct", "pages_total"), F.lit(0.0)).alias("page_accuracy"))


def gate(modes: DataFrame, min_f1: float = 0.9, min_visual_f1: float = 0.85) -> DataFrame:
    """(metric, value, threshold, passed): modes without the metric are left out; nothing to judge passes."""
    if not (0 <= min_f1 <= 1 and 0 <= min_visual_f1 <= 1):
        raise ValueError("thresholds lie between 0 and 1")

    def row(name: str, value: Column, limit: float) -> DataFrame:
        return modes.agg(value.alias("value")).select(F.lit(name).alias("metric"), "value", F.lit(limit).alias("threshold"), F.coalesce(F.col("value") >= limit, F.lit(True)).alias("passed"))

    return row("text_f1", F.min("text_f1"), min_f1).unionByName(row("visual_region_f1", F.min(F.when(F.col("mode") == "visual", F.col("region_f1"))), min_visual_f1))


def label_rates(labels: DataFrame, truth: str, found: str) -> DataFrame:
    """One row: two 0/1 columns against each other."""
    t, d = F.col(truth) == 1, F.col(found) == 1
    return with_rates(labels.agg(F.count_if(t & d).alias("tp"), F.count_if(~t & d).alias("fp"), F.count_if(t & ~d).alias("fn")))
