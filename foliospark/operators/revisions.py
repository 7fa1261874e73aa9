"""A revision corpus with known edits, derived from any text table by integer arithmetic; no driver loop.

The last digit of doc_id picks the edit: 0 none; 1 a page more; 2 the last page gone (of two or more); 3 white space at the
ends of lines; 4 the first line of a page for three fresh ones; 5 the first three lines of a page of four or more for one fresh
one; otherwise lines are removed, changed or followed by a new one where (31 doc_id + 17 line_no) mod 23 is 0, 1 or 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import compare_key
from foliospark.plans.order import with_next
from foliospark.plans.shared import written
from foliospark.sources.tables import PAGE_LINES, pages_of


def revised_pages(docs: DataFrame) -> DataFrame:
    """(pair_id, page_index, old_lines, new_lines: array<string>, null where the side has no such page)."""
    rule = F.col("doc_id") % 10
    # the page more is a row of the same pass
    numbered = pages_of(docs, more=F.when(rule == 1, 1).otherwise(0)).withColumnRenamed("lines", "old_lines")
    gone = (rule == 2) & (F.col("n_pages") > 1) & (F.col("page_index") == F.col("n_pages") - 1)
    extra = F.array(F.concat(F.lit("appended page of "), F.col("doc_id")))
    new = F.when(F.col("page_index") == F.col("n_pages"), extra).when(gone, None).otherwise(_edited(rule))
    return numbered.select(F.col("doc_id").alias("pair_id"), "page_index", "old_lines", new.alias("new_lines"))


def _edited(rule: Column) -> Column:
    old, size = F.col("old_lines"), F.size("old_lines")
    where = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("page_index").cast("string"))
    fresh = lambda k: F.concat(F.lit(f"fresh {k} "), where)

    def line(t: Column, i: Column) -> Column:
        no = F.col("page_index") * PAGE_LINES + i
        h = (F.col("doc_id") * 31 + no * 17) % 23
        return (
            F.when(h == 0, F.array().cast("array<string>")).when(h == 1, F.array(F.concat(t, F.lit(" [rev]"))))
            .when(h == 2, F.array(t, F.concat(F.lit("inserted "), F.col("doc_id").cast("string"), F.lit(":"), no.cast("string")))).otherwise(F.array(t))
        )

    return (
        F.when(rule.isin(0, 1, 2), old)
        .when(rule == 3, F.transform(old, lambda t: F.concat(F.lit("  "), t, F.lit(" "))))
        .when(rule == 4, F.concat(F.array(fresh("a"), fresh("b"), fresh("c")), F.slice(old, F.lit(2), size)))
        .when((rule == 5) & (size >= 4), F.concat(F.array(fresh("d")), F.slice(old, F.lit(4), size)))
        .when(rule == 5, old)
        .otherwise(F.flatten(F.transform(old, line)))
    )


def truth(docs: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """What the edit rules did, whatever a detector finds: pages and regions.

    pages (case_id, page_index, status, text_status, visual_status, hybrid_status): the overrides are null where a mode has no say of
    its own; white space at the ends of lines shows on the page only. regions (case_id, page_index, region_id, old_line, new_line, old_text,
    new_text). Every 29th case holds a region that was never made (region_id -1), as annotators err. `once`: what the rules did is written, so that documents are read once.
    """
    numbered = pages_of(docs).withColumnRenamed("doc_id", "case_id").withColumn("rule", F.col("case_id") % 10)
    size, rule = F.size("lines"), F.col("rule")
    where = F.concat(F.col("case_id").cast("string"), F.lit(":"), F.col("page_index").cast("string"))
    region = lambda o, n, old, new: F.struct(o.cast("int").alias("old_line"), n.cast("int").alias("new_line"), old.cast("string").alias("old_text"), new.cast("string").alias("new_text"))
    none = F.lit(None)
    hashes = F.transform(F.sequence(F.lit(0), size - 1), lambda i: (F.col("case_id") * 31 + (F.col("page_index") * PAGE_LINES + i) * 17) % 23)

    def edit(h: Column, i: Column) -> Column:
        before = F.slice("_h", F.lit(1), i)  # a page's lines are few
        to = i + F.size(F.filter(before, lambda x: x == 2)) - F.size(F.filter(before, lambda x: x == 0))
        text, no = F.get("lines", i), F.col("page_index") * PAGE_LINES + i
        return (
            F.when(h == 0, region(i, none, text, none)).when(h == 1, region(i, to, text, F.concat(text, F.lit(" [rev]"))))
            .when(h == 2, region(none, to + 1, none, F.concat(F.lit("inserted "), F.col("case_id").cast("string"), F.lit(":"), no.cast("string"))))
        )

    fresh = lambda k: F.concat(F.lit(f"fresh {k} "), where)
    zero = F.lit(0)
    made = (
        F.when(rule == 4, F.array(*[region(zero, F.lit(k), F.get("lines", zero), fresh(c)) for k, c in enumerate("abc")]))
        .when((rule == 5) & (size >= 4), F.array(*[region(F.lit(k), zero, F.get("lines", F.lit(k)), fresh("d")) for k in range(3)]))
        .when(rule > 5, F.array_compact(F.transform("_h", edit)))
        .otherwise(F.array().cast("array<struct<old_line:int,new_line:int,old_text:string,new_text:string>>"))
    )
    edited = numbered.withColumn("_h", hashes).select("case_id", "page_index", "n_pages", "rule", made.alias("made"))
    if once:
        edited = written(edited, "edits")
        rule = F.col("rule")
    gone = (rule == 2) & (F.col("n_pages") > 1) & (F.col("page_index") == F.col("n_pages") - 1)
    status = F.when(gone, "removed").when(F.size("made") > 0, "modified").otherwise("match")
    kept = edited.select("case_id", "page_index", status.alias("status"), F.lit(None).cast("string").alias("text_status"), F.when(rule == 3, "modified").alias("visual_status"))
    last = edited.filter((rule == 1) & (F.col("page_index") == F.col("n_pages") - 1))
    more = last.select("case_id", F.col("n_pages").alias("page_index"), F.lit("added").alias("status"), F.lit(None).cast("string").alias("text_status"), F.lit(None).cast("string").alias("visual_status"))
    pages = kept.unionByName(more).withColumn("hybrid_status", F.lit(None).cast("string"))
    regions = edited.select("case_id", "page_index", F.posexplode("made").alias("region_id", "r")).select("case_id", "page_index", "region_id", "r.*")
    wrong = edited.filter((F.col("case_id") % 29 == 3) & (F.col("page_index") == 0)).select("case_id", "page_index", F.lit(-1).alias("region_id"), none.cast("int").alias("old_line"), none.cast("int").alias("new_line"), none.cast("string").alias("old_text"), F.lit("a line that nobody wrote").alias("new_text"))
    return pages, regions.unionByName(wrong)


def manifest(docs: DataFrame, by: str = "source") -> DataFrame:
    """(pair_id, old_doc_id, new_doc_id): each document against the next one of its `by`, in the order of their ids. A `by` of any size is spread over tasks."""
    known = docs.filter(F.col(by).isNotNull() & F.col("doc_id").isNotNull()).select(by, "doc_id")
    each = with_next(known, [by], ["doc_id"], "doc_id")
    return each.filter("next IS NOT NULL").select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("old_doc_id"), F.col("next").alias("new_doc_id"))


def paired(pairs: DataFrame, old_pages: DataFrame, new_pages: DataFrame | None = None) -> DataFrame:
    """(pair_id, page_index, old_lines, new_lines): page i of one document against page i of the other, a full outer join.

    pairs (pair_id, old_doc_id, new_doc_id), page tables (doc_id, page_index, lines); one table may hold both sides. A page that only one
    side has stays, with null on the other; a document without pages gives none. Further columns of pairs go along with its pages.
    """
    more = [c for c in pairs.columns if c not in ("pair_id", "old_doc_id", "new_doc_id")]
    side = lambda name, pages: pairs.select("pair_id", *[F.col(c).alias(f"_{name}_{c}") for c in more], F.col(f"{name}_doc_id").alias("doc_id")).join(pages, "doc_id").select("pair_id", "page_index", *[f"_{name}_{c}" for c in more], F.col("lines").alias(f"{name}_lines"))
    both = side("old", old_pages).join(side("new", old_pages if new_pages is None else new_pages), ["pair_id", "page_index"], "full")
    return both.select("pair_id", "page_index", *[F.coalesce(f"_old_{c}", f"_new_{c}").alias(c) for c in more], "old_lines", "new_lines")


def pairs(pages: DataFrame) -> DataFrame:
    """(pair_id, old_doc_id, new_doc_id, mode, old_pages, new_pages): the manifest of the corpus."""
    return pages.groupBy("pair_id").agg(F.count("old_lines").alias("old_pages"), F.count("new_lines").alias("new_pages")).select(
        "pair_id", F.concat("pair_id", F.lit(":old")).alias("old_doc_id"), F.concat("pair_id", F.lit(":new")).alias("new_doc_id"), F.lit("text").alias("mode"), "old_pages", "new_pages"
    )


def aligned(pages: DataFrame) -> DataFrame:
    """pages with side: common, removed (only old) or added (only new)."""
    return pages.withColumn("side", F.when(F.col("new_lines").isNull(), "removed").when(F.col("old_lines").isNull(), "added").otherwise("common"))


def keys(lines: Column) -> Column:
    return F.transform(lines, compare_key)
