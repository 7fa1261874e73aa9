"""Sources: lines and pages of text tables, document summaries, binary files, ground-truth folders."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import base_name, normalised, not_blank

PAGE_LINES = 20
#: Files of this length or more can't be read as one value.
LIMIT_BYTES = 2**31

GROUND_TRUTH = (
    "name string, description string, pages array<struct<page:int,status:string,text_status:string,visual_status:string,hybrid_status:string,"
    "regions:array<struct<rect:array<float>,old_text:string,new_text:string>>>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_page: int = PAGE_LINES) -> DataFrame:
    """(id_col, line_no, page_index, line_index, text): the normalised non-blank lines of each text, counted from 0.

    Lines are numbered inside their row: no exchange.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), normalised), lambda t: t != "")
    each = docs.select(id_col, F.posexplode(lines).alias("line_no", "text"))
    return each.select(id_col, "line_no", F.floor(F.col("line_no") / per_page).cast("int").alias("page_index"), (F.col("line_no") % per_page).alias("line_index"), "text")


def pages_of(docs: DataFrame, per_page: int = PAGE_LINES, more: Column | int = 0) -> DataFrame:
    """(doc_id, n_pages, page_index, lines: array<string>): the same lines, a row a page, and `more` rows beyond the last one, without lines. Pages are cut inside their row: no exchange."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), normalised), lambda t: t != "")
    whole = docs.select("doc_id", lines.alias("_l"))
    n = F.ceil(F.size("_l") / per_page).cast("int")
    # outer, and filtered behind it: from a filter on the number of lines, or one that Spark infers, each text would be cut into lines twice
    paged = whole.select("doc_id", n.alias("n_pages"), "_l", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n + more - 1))).alias("page_index")).filter("page_index IS NOT NULL")
    return paged.select("doc_id", "n_pages", "page_index", F.when(F.col("page_index") < F.col("n_pages"), F.slice("_l", F.col("page_index") * per_page + 1, F.lit(per_page))).alias("lines"))


def document_summary(docs: DataFrame, per_page: int = PAGE_LINES) -> DataFrame:
    """(doc_id, n_lines, page_count, title, display_title, rejected): a document without pages is rejected. The source stands in for the title."""
    return document_metadata(docs.select("doc_id", "text", F.col("source").alias("title")), per_page).drop("author", "subject")


def document_metadata(docs: DataFrame, per_page: int = PAGE_LINES) -> DataFrame:
    """(doc_id, n_lines, page_count, title, author, subject, display_title, rejected): title, author and subject are trimmed, and null where blank; those that docs doesn't
    have are null. What is displayed is the title, or else the base name of the path, or else `Untitled`."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), not_blank)
    given = lambda c: F.nullif(normalised(F.col(c).cast("string")), F.lit("")) if c in docs.columns else F.lit(None).cast("string")
    name = F.nullif(base_name(F.col("path")), F.lit("")) if "path" in docs.columns else F.lit(None).cast("string")
    count = F.size("_l").cast("long")
    return docs.select("doc_id", lines.alias("_l"), *[given(c).alias(c) for c in ("title", "author", "subject")], name.alias("_name")).select(
        "doc_id", count.alias("n_lines"), F.ceil(count / per_page).cast("long").alias("page_count"), "title", "author", "subject",
        F.coalesce("title", "_name", F.lit("Untitled")).alias("display_title"), (count == 0).alias("rejected"),
    )


SEGMENT = "doc_id bigint, page_index int, seg_id bigint, text string, left double, top double, right double, bottom double"


def segments(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Positioned segments as given; those without shown text are dropped."""
    return spark.read.schema(SEGMENT).format(form).load(path).filter(not_blank(F.col("text")))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def checked_binaries(spark: SparkSession, path: str, magic: str = "%PDF") -> DataFrame:
    """(path, length, reason) of the files below a path: empty, too large or not of the kind; null where accepted.

    Lengths come from the listing; contents are read of files only whose length is in bounds, so a large one is rejected unread. Spark leaves
    empty files out of its scans: they are the names of the listing that the scan lacks.
    """
    files = binary_files(spark, path)
    scanned = files.select("path", "length")
    fits = (F.col("length") > 0) & (F.col("length") < LIMIT_BYTES)
    heads = files.filter(fits).select("path", (F.substring("content", 1, len(magic)) == F.lit(magic).cast("binary")).alias("right"))
    names = spark.createDataFrame([(re.sub("^([a-z0-9]+:)/+", r"\1/", unquote(x)),) for x in files.inputFiles()], "path string")
    listed = names.join(scanned.withColumn("path", F.regexp_replace("path", "^([a-z0-9]+:)/+", "$1/")), "path", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") >= LIMIT_BYTES, "too large").when(~F.coalesce("right", F.lit(False)), "wrong kind")
    return listed.join(heads.withColumn("path", F.regexp_replace("path", "^([a-z0-9]+:)/+", "$1/")), "path", "left").select("path", "length", reason.alias("reason"))


def ground_truth(spark: SparkSession, corpus: str) -> DataFrame:
    """One row a case folder that holds ground_truth.json, old.pdf and new.pdf; broken JSON is an error."""
    listed = binary_files(spark, corpus).select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("case_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    cases = (
        spark.read.schema(GROUND_TRUTH).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "ground_truth.json").json(corpus)
        .withColumn("case_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    )
    for file in ("old.pdf", "new.pdf"):
        cases = cases.join(listed.filter(F.col("file") == file).select("case_id"), "case_id", "left_semi")
    return cases


def truth_rows(cases: DataFrame) -> DataFrame:
    """(case_id, page, status, text_status, visual_status, hybrid_status, region_id, rect, old_text, new_text): pages without regions stay."""
    pages = cases.select("case_id", F.explode("pages").alias("p")).select("case_id", "p.*")
    return pages.select("case_id", "page", "status", "text_status", "visual_status", "hybrid_status", F.posexplode_outer("regions").alias("region_id", "r")).select("*", "r.*").drop("r")


def frozen_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases as `sinks.write_ground_truth` leaves them, many in a file: (case_id: the name, name, description, pages). Broken JSON is an error."""
    return spark.read.schema(GROUND_TRUTH).option("mode", "FAILFAST").json(path).withColumn("case_id", F.col("name"))


def truth_of_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Case files as the truth of an evaluation: pages (case_id, page_index, status, text_status, visual_status, hybrid_status) and regions (case_id, page_index, region_id, rect,
    old_text, new_text), pages from 0 (a page number under one is the first page). Of a page that a case names twice both rows stay, with `ord`, and the last counts."""
    pages = cases.select("case_id", F.posexplode("pages").alias("ord", "p")).select("case_id", "ord", F.greatest(F.col("p.page") - 1, F.lit(0)).alias("page_index"), "p.*").drop("page")
    regions = pages.select("case_id", "page_index", "ord", F.posexplode("regions").alias("k", "r")).select("case_id", "page_index", F.xxhash64("ord", "k").alias("region_id"), "r.*")
    return pages.drop("regions"), regions
