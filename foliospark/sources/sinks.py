"""Sinks: change lists as CSV and TSV, reports as JSON lines by pair, golden ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """With a header; quotes are doubled, so commas and line breaks in texts survive."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').option("sep", sep).csv(path)


#: Files of a sink, however many pairs there are.
FILES = 64


def ordered(df: DataFrame, order: list[str], files: int = FILES) -> DataFrame:
    """df in at most `files` parts, in order within and from part to part."""
    return df.repartitionByRange(files, *order).sortWithinPartitions(*order)


def write_change_list(changes: DataFrame, path: str, files: int = FILES, sep: str = ",") -> None:
    """CSV files which, read one after the other by name, are the changes by pair, page and place on it (a header in each)."""
    write_csv(ordered(changes, [c for c in ("pair_id", "mode", "page", "entry_seq") if c in changes.columns], files), path, sep)


def write_reports(reports: DataFrame, path: str, files: int = FILES) -> None:
    """One JSON object a line, a line a pair and mode, in order over a bounded number of files."""
    key = [c for c in ("pair_id", "mode") if c in reports.columns]
    line = F.concat(F.lit('{"pair_id":'), F.to_json(F.array("pair_id")).substr(F.lit(2), F.length(F.to_json(F.array("pair_id"))) - 2), F.lit(","), F.expr("substring(report, 2)"))
    ordered(reports.select(*key, line.alias("value")), key, files).select("value").write.mode("errorifexists").text(path)


def write_ground_truth(golden: DataFrame, status: DataFrame, path: str) -> None:
    """The frozen changes of a comparison as ground truth: one JSON object a pair, pages from 1, no boxes."""
    regions = golden.groupBy("pair_id", "page").agg(F.array_sort(F.collect_list(F.struct("entry_seq", "old_text", "new_text"))).alias("r"))
    pages = status.select("pair_id", (F.col("page_index") + 1).alias("page"), "status").join(regions, ["pair_id", "page"], "left")
    page = F.struct("page", "status", F.transform(F.coalesce("r", F.array()), lambda x: F.struct(F.lit(None).cast("array<float>").alias("rect"), x.old_text.alias("old_text"), x.new_text.alias("new_text"))).alias("regions"))
    truth = pages.groupBy("pair_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    truth.select(F.concat(F.lit("pair "), F.col("pair_id")).alias("name"), F.lit("frozen comparison").alias("description"), "pages").write.mode("errorifexists").option("ignoreNullFields", False).json(path)
