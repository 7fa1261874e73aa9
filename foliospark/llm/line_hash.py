"""Line dedup through a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z in lower case. Keys of `MIN_CHARS` or more code points that stand in two or
more documents lose their lines in all of these but the one with the smallest id.

1. Texts become rows (128-bit digest of a key, document, line number); texts themselves stay where they are.
2. Digests are counted (fixed-width aggregates, map-side first): rows, smallest and largest document.
3. The digests that stand in several documents are dealt by their first half to shards of about `SHARD_KEYS`. A shard is a minimal perfect
   hash (levels of bit arrays; a key sits at the first level where no other key of the shard shares its bit, and its number is
   the rank of that bit) over three arrays in the order of these numbers: fingerprints (the second half of the digest), counts, owners.
4. Documents probe the arrays: rows travel to the shard of their digest, where the arrays are loaded once and probed a batch at a time. A
   probe whose fingerprint isn't the one at its number is of no shared line.

A key with more than one `HOT_PARTS`-th of all rows would make its shard's task long. There are fewer than `HOT_PARTS` such keys, whatever the size of
the table; these form a shard of their own (under 200 kB), which every task holds, so that their rows travel nowhere to be probed. All other
keys add at most one `HOT_PARTS`-th of the rows to a shard. Texts cross one exchange, to meet the numbers of the lines they lose.

Defined cases: null and empty texts are one empty line; a null id counts as the largest one, and rows with equal ids are one document, each keeping
the lines that this document keeps; rows that repeat are alike; an empty table gives an empty result; extra columns are ignored.
Keys are told apart by 128 bits (XXH3).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_long_rows, parallelism, slices, written

MIN_CHARS = 10
SHARD_KEYS, HOT_PARTS = 1 << 18, 4096
BLANKS = " \t\n\x0b\x0c\r"
LAST = 2**63 - 1
#: Levels that a perfect hash may have; each takes over half of what is left.
LEVELS = 64
ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(ODD[1])
    x = (x ^ x >> np.uint64(27)) * np.uint64(ODD[2])
    return x ^ x >> np.uint64(31)


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    turn = np.uint64(2 * level + 1)
    return (_mixed(h1 * turn + h2 * np.uint64(ODD[0]) + turn) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys (h1, h2); any other key gets one of these numbers or -1."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        ends = np.cumsum([0, *(int(b.sum()) for b in bits)])
        self.ranks = [np.cumsum(b, dtype=np.int32) - 1 + end for b, end in zip(bits, ends, strict=False)]

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        bits: list[np.ndarray] = []
        while len(h1):
            if len(bits) == LEVELS:
                raise ValueError("keys repeat")
            size = len(h1) + len(h1) // 2 + 8
            slot = _slots(h1, h2, len(bits), size)
            alone = np.bincount(slot, minlength=size) == 1
            bits.append(alone)
            left = ~alone[slot]
            h1, h2 = h1[left], h2[left]
        return cls(bits)

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        at = np.arange(len(h1))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            slot = _slots(h1[at], h2[at], level, len(bits))
            here = bits[slot]
            out[at[here]] = ranks[slot[here]]
            at = at[~here]
        return out


class LineIndex:
    """The arrays of a shard."""

    KIND = "sizes array<int>, bits binary, prints binary, counts binary, owners binary"

    def __init__(self, numbers: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.numbers, self.prints, self.counts, self.owners = numbers, prints, counts, owners

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> LineIndex:
        u1, u2 = h1.view(np.uint64), h2.view(np.uint64)
        numbers = PerfectHash.build(u1, u2)
        order = np.empty(len(u1), np.int64)
        order[numbers(u1, u2)] = np.arange(len(u1))
        return cls(numbers, u2[order], counts[order].astype(np.int64), owners[order])

    def stored(self) -> dict:
        bits = self.numbers.bits
        packed = b"".join(np.packbits(b).tobytes() for b in bits)
        return {"sizes": [len(b) for b in bits], "bits": packed, "prints": self.prints.tobytes(), "counts": self.counts.tobytes(), "owners": self.owners.tobytes()}

    @classmethod
    def loaded(cls, row: dict) -> LineIndex:
        bits, at = [], 0
        for size in row["sizes"]:
            width = -(-size // 8)
            bits.append(np.unpackbits(np.frombuffer(row["bits"], np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(PerfectHash(bits), np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["owners"], np.int64))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are in the shard, and their owners and counts (0 where they aren't)."""
        u2 = h2.view(np.uint64)
        at = self.numbers(h1.view(np.uint64), u2)
        known = at >= 0
        known[known] = self.prints[at[known]] == u2[known]
        owners, counts = (np.zeros(len(u2), np.int64) for _ in range(2))
        owners[known], counts[known] = self.owners[at[known]], self.counts[at[known]]
        return known, owners, counts


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, digest halves) of all keys of MIN_CHARS or more."""
    lists = pc.split_pattern(texts.fill_null(""), "\n")
    keys = pc.ascii_lower(pc.ascii_trim(lists.flatten(), BLANKS))
    size = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    long = pc.greater_equal(pc.utf8_length(keys), MIN_CHARS)
    row, first = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
    hashed = b"".join(map(xxhash.xxh3_128_digest, keys.filter(long).cast(pa.large_binary()).to_pylist()))
    return row[at], (np.arange(len(row)) - first)[at].astype(np.int32), np.frombuffer(hashed, "<i8").reshape(-1, 2)


LINES = "h1 bigint, h2 bigint, doc bigint, k1 bigint, k2 bigint, no int"


def line_rows(docs: DataFrame) -> DataFrame:
    """docs (k1, k2, doc, _text) as rows of LINES."""

    def run(batches):
        for batch in batches:
            for part in slices([batch]):
                row, no, h = digests(part.column("_text"))
                own = [pa.array(part.column(c).to_numpy()[row]) for c in ("doc", "k1", "k2")]
                columns = [pa.array(h[:, 0]), pa.array(h[:, 1]), *own, pa.array(no)]
                yield from pa.table(columns, ["h1", "h2", "doc", "k1", "k2", "no"]).to_batches(1 << 16)

    return docs.mapInArrow(run, LINES)


def _indexes(keys: DataFrame) -> DataFrame:
    """(shard, LineIndex.KIND): keys (shard, h1, h2, n, lo), dealt by shard."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def made():
            table = pa.Table.from_batches(held)
            h1, h2, n, lo = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "lo"))
            return pa.RecordBatch.from_pylist([{"shard": last} | LineIndex.build(h1, h2, n, lo).stored()], schema=kind)

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and shard[a] != last:
                    yield made()
                    held.clear()
                last = int(shard[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield made()

    kind = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("bits", "prints", "counts", "owners")]])
    return keys.repartition(4 * parallelism(keys.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(run, f"shard int, {LineIndex.KIND}")


FOUND = "k1 bigint, k2 bigint, no int"


def _lost(known: np.ndarray, owners: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    return known & (owners < batch.column("doc").to_numpy())


def _near(lines: DataFrame, hot: dict | None, shards: int) -> DataFrame:
    """LINES with shard: lines lost by the hot shard have no digest any more, other lines with hot keys are gone."""

    def run(batches):
        index = LineIndex.loaded(hot) if hot else None
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            known = lost = np.zeros(len(h1), bool)
            if index:
                known, owners, _ = index.probe(h1, h2)
                lost = _lost(known, owners, batch)
            # what is settled goes anywhere
            shard = np.where(lost, batch.column("k1").to_numpy(), h1) % shards
            columns = [pa.array(h1, mask=lost), *batch.columns[1:], pa.array(shard.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "shard"]).filter(pa.array(lost | ~known))

    return lines.mapInArrow(run, f"{LINES}, shard int")


def _probed(lines: DataFrame, indexes: DataFrame) -> DataFrame:
    """FOUND: the lines that are lost, from a shard's arrays and the lines that come to it."""
    fields = [f.name for f in indexes.schema if f.name != "shard"]
    both = lines.withColumn("here", F.lit(False)).unionByName(indexes.withColumn("here", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartition(4 * parallelism(lines.sparkSession), "shard").sortWithinPartitions("shard", F.desc("here"))

    def run(batches):
        index, of = None, None
        for batch in batches:
            shard, here = batch.column("shard").to_numpy(), batch.column("here").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(shard) != 0) | here[1:] | here[:-1]) + 1
            edges = [0, *cuts.tolist(), len(shard)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if a == b:
                    continue
                if here[a]:
                    of = int(shard[a])
                    index = LineIndex.loaded({c: part.column(c)[0].as_py() for c in fields})
                    continue
                settled = part.column("h1").is_null().to_numpy(zero_copy_only=False)
                lost = settled.copy()
                if of == int(shard[a]):
                    h1, h2 = (part.column(c).fill_null(0).to_numpy() for c in ("h1", "h2"))
                    known, owners, _ = index.probe(h1, h2)
                    lost |= ~settled & _lost(known, owners, part)
                yield part.select(["k1", "k2", "no"]).filter(pa.array(lost))

    return dealt.mapInArrow(run, FOUND)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS, hot_parts: int = HOT_PARTS) -> DataFrame:
    """(id_col, n_lines, n_dropped, kept) a row; see the contract at the head of this module."""
    spark = docs.sparkSession
    for_long_rows(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a document by its id and text: rows that share both lose the same lines
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), text.alias("_text"))
    keyed = keyed.withColumns({"k1": F.xxhash64("doc", "_text"), "k2": F.xxhash64("_text", "doc")})
    lines = written(line_rows(keyed.drop("_id")), "lines")
    counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    shared = written(counted.filter("lo < hi").drop("hi"), "shared_lines")
    least = lines.count() // hot_parts
    # fewer than hot_parts rows: each holds more than that share of all lines
    hot = [r.asDict() for r in shared.filter(F.col("n") > least).collect()]
    column = lambda c: np.array([r[c] for r in hot], np.int64)
    held = LineIndex.build(*map(column, ("h1", "h2", "n", "lo"))).stored() if hot else None
    rest = shared.filter(F.col("n") <= least)
    shards = max(parallelism(spark), -(-rest.count() // shard_keys))
    indexes = _indexes(rest.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")))
    found = _probed(_near(lines, held, shards), written(indexes, "line_indexes"))
    lost = found.groupBy("k1", "k2").agg(F.collect_set("no").alias("lost"))
    joined = keyed.select("_id", "_text", "k1", "k2").join(lost, ["k1", "k2"], "left").select("_id", "_text", F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))

    def keep(batches):
        for batch in slices(batches):
            kept, total, gone = [], [], []
            for t, numbers in zip(batch.column("_text").to_pylist(), batch.column("lost").to_pylist(), strict=True):
                if numbers:
                    drop, each = set(numbers), t.split("\n")
                    total.append(len(each))
                    t = "\n".join(x for k, x in enumerate(each) if k not in drop)
                else:
                    total.append(t.count("\n") + 1)
                gone.append(len(numbers))
                kept.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(keep, f"id {kind}, n_lines bigint, n_dropped bigint, kept string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """The op11 result."""
    return without_repeats(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
