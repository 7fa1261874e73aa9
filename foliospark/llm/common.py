"""Helpers that every operator of this subpackage shares: shared-folder tables, word splitting, 64-bit voting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.plans.shared import BATCH_ROWS, ensure_importable, for_long_rows, written  # noqa: F401  for the operators of this subpackage

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; `lower` is the fast path where there is nothing else to change."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Maximal runs of characters outside SPACES; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def shingles(tokens: Column, n: int) -> Column:
    """Space-joined runs of n words with repeats; with fewer words the whole sequence; none for no word.

    `tokens` has to be a column of its own (a projection before this one): inside the lambda any other
    expression would be evaluated anew for each word.
    """
    size = F.size(tokens)
    runs = F.transform(
        F.sequence(F.lit(0), size - n),
        lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]),
    )
    return (
        F.when(size >= n, runs)
        .when(size > 0, F.array(F.array_join(tokens, " ")))
        .otherwise(F.array().cast("array<string>"))
    )


#: Two 32-bit counters share one long: bit j of a hash is counted in the low lane, bit j + 32 in the high one.
LANES = 0x0000000100000001


def vote_sums(h: Column, weight: Column | None = None) -> list[Column]:
    """32 sums that count, for all 64 bits, the (weighted) hashes that set them. Counts stay exact below 2**31."""
    lane = [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES)) for j in range(32)]
    return [F.sum(x if weight is None else x * weight).alias(f"_v{j}") for j, x in enumerate(lane)]


def majority(total: Column) -> Column:
    """The 64-bit long whose bit is 1 where over half of `total` voted for it, from the columns of vote_sums."""
    out = F.lit(0).cast("long")
    for j in range(32):
        v = F.coalesce(F.col(f"_v{j}"), F.lit(0).cast("long"))
        low, high = v.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(v, 32)
        top = (1 << (j + 32)) - (1 << 64 if j == 31 else 0)
        out = out.bitwiseOR(F.when(low * 2 > total, F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
        out = out.bitwiseOR(F.when(high * 2 > total, F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Bytes of Arrow data that a mapped function gets at once (one row at least).
SLICE_BYTES = 8_000_000


def slices(batches):
    """The same rows in record batches of about SLICE_BYTES."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def mapped(df: DataFrame, source: str, name: str, kind: str, of, done=lambda: None) -> DataFrame:
    """df with column `name` of type `kind`: of(values of `source`), some megabytes at a time; done() when a task ends.

    A column of that name is replaced.
    """
    for_long_rows(df.sparkSession)
    typed = (df.drop(name) if name != source else df).withColumn(name, F.lit(None).cast(kind))

    def run(batches):
        try:
            for batch in slices(batches):
                k = batch.schema.get_field_index(name)
                values = pa.array(of(batch.column(source).to_pylist()), batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays([values if j == k else c for j, c in enumerate(batch.columns)], schema=batch.schema)
        finally:
            done()

    return typed.mapInArrow(run, typed.schema)
