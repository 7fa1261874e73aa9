"""SimHash document fingerprints with DataFrame functions only, and search within a Hamming radius.

Terms are pairs of neighbouring words (white space apart, letter case kept); a shorter text is one term. Each occurrence
of a term votes with the bits of its 64-bit hash, +w where set and -w where not; the weight w is the term's length up
to `MAX_WEIGHT` characters, so that pairs of long, rare words count for more than pairs of function words. A bit of the
fingerprint is 1 where the signed sum is positive.

Search: the 64 bits form radius + 3 blocks; for every choice of 3 blocks there is one table, keyed by these blocks
(a permutation that brings them to the front). Fingerprints within the radius agree in all bits of at least one choice;
a pair is taken from the first table in which it meets and verified there, so nothing is found twice and none is lost.

Scale: votes are summed where the words are, one record a text crosses the exchange; the tables hold distinct fingerprints
only, and are joined on 32-bit keys, one exchange for each side; AQE splits a hot key. The text itself is moved once,
to meet its successor.

Defined cases: null counts as the empty text, whose fingerprint is zero; equal texts have equal fingerprints; of rows
with equal doc_id the text decides the order; a null doc_id comes last; a single row is its own successor; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hamming, hex64, majority, shingles, vote_sums, words, written
from .order import following, with_guests
from .simhash_dedup import bit_masks

MAX_WEIGHT = 16


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, fp: long): the fingerprint of text_col; `keys` have to identify a row."""
    split = df.select(*keys, words(F.col(text_col)).alias("_w"))
    terms = split.select(*keys, F.explode_outer(shingles(F.col("_w"), 2)).alias("_s"))
    weight = F.least(F.length("_s"), F.lit(MAX_WEIGHT)).cast("long")
    votes = terms.select(*keys, F.when(F.col("_s").isNotNull(), F.xxhash64("_s")).alias("_h"), weight.alias("_g"))
    summed = votes.groupBy(*keys).agg(F.coalesce(F.sum("_g"), F.lit(0)).alias("_t"), *vote_sums(F.col("_h"), F.col("_g")))
    return summed.select(*keys, majority(F.col("_t")).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - hamming(a, b) / F.lit(64.0)


def neighbours(queries: DataFrame, table: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fp): for the distinct longs `fp` of queries, all other distinct `fp` of the table within the radius."""
    masks = bit_masks(radius)
    keyed = lambda df: df.select("fp").distinct().select("fp", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])))
    a, b = keyed(queries).alias("a"), keyed(table).alias("b")
    moved = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.lit(len(masks))
    for k in reversed(range(len(masks))):
        first = F.when(moved.bitwiseAND(F.lit(masks[k])) == 0, F.lit(k)).otherwise(first)
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.key") == F.col("b.key")) & (moved != 0) & (F.bit_count(moved) <= radius) & (F.col("a.k") == first)
    return a.hint("merge").join(b, on).select(F.col("a.fp").alias("query"), F.col("b.fp").alias("fp"))


def matches(rows: DataFrame, every: int = 20, radius: int = 3) -> DataFrame:
    """(query, fp, n, least, distance) for the fingerprints `query` of the rows (doc_id, fp) whose id is divisible by `every`.

    A row for every class of equal fingerprints within the radius of all rows, its own included: its number of rows and its smallest
    id. Copies aren't expanded: rows and classes meet by their fingerprints.
    """
    classes = written(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "classes")
    asked = rows.filter((F.col("doc_id") % every) == 0).select("fp").distinct()
    found = neighbours(asked, classes, radius).unionByName(asked.select(F.col("fp").alias("query"), "fp"))
    return found.join(classes, "fp").select("query", "fp", "n", "least", hamming(F.col("query"), F.col("fp")).alias("distance"))


def edited_likeness(docs: DataFrame, every: int = 20, radius: int = 3) -> DataFrame:
    """The op4 result: a row's fingerprint, that of its edited text and of the next document, and for ids divisible by
    `every` n_near, the number of other rows within the radius, copies included (null for the others)."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    linked = with_guests(base, "doc_id", F.col("text")).withColumn("_next", following("text"))
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")
    cut = linked.select(
        "doc_id", "_bucket", "_n", "_guest", size.cast("long").alias("n_chars"), "text",
        F.concat(F.substring(F.col("text"), F.lit(1), size - third), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), third)).alias("_edited"),
    )
    keys = ["doc_id", "_bucket", "_n", "_guest", "n_chars", "edited_sha256", "_which"]
    both = cut.select(
        *keys[:5], F.sha2("_edited", 256).alias("edited_sha256"),
        F.inline(F.array(F.struct(F.lit(0).alias("_which"), F.col("text").alias("_text")), F.struct(F.lit(1).alias("_which"), F.col("_edited").alias("_text")))),
    )
    needed = both.filter("NOT _guest OR _which = 0")
    each = fingerprints(needed, keys, "_text")
    pick = lambda k: F.max(F.when(F.col("_which") == k, F.col("fp")))
    row = written(each.groupBy("_bucket", "_n").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "_guest", "n_chars")], F.max(F.when(F.col("_which") == 1, F.col("edited_sha256"))).alias("edited_sha256"), pick(0).alias("fp"), pick(1).alias("edited")), "fingerprints")
    full = row.withColumn("_after", following("fp")).filter("NOT _guest")
    own = row.filter("NOT _guest")
    counts = written(matches(own.select("doc_id", "fp"), every, radius).groupBy(F.col("query").alias("fp")).agg((F.sum("n") - 1).alias("_near")), "near")
    out = full.join(counts.hint("merge"), "fp", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex64(F.col("fp")).alias("fingerprint"), hex64(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited")).alias("near_edited"), likeness(F.col("fp"), F.col("_after")).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("_near")).alias("n_near"),
    )
