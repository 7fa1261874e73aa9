"""Near copies by the share of common word shingles: SimHash fingerprints, then the segment-popcount embedding of whole shingle sets.

Each set has a SimHash, the majority bits of its hashes. Fingerprints within `RADIUS` bits are joined by the popcounts of their segments
(`simhash_dedup.links`); the texts they stand for are candidates, verified by intersecting their sets.

64 majority bits tell copies of similarity 0.8 apart from others only at a radius where no choice of bands is selective, so these
candidates hold the closest copies only. The others are found by the same embedding of
the whole set of hashed shingles, read as one bit vector: the Hamming distance of two such vectors is the
number of shingles that one side lacks, at most (1 - t) / (1 + t) of both sizes for a Jaccard similarity of t. The bits are dealt
into segments, and a text maps to its segments' counts (and sums). The Manhattan distance of two count vectors is a lower
bound of the Hamming distance, and a pair within it leaves segments unchanged: texts that share a segment's cell are
candidates, and are verified exactly by intersecting their sets.

Sizes are dealt into classes of ratio 1 / t; a class meets itself and the next one, with as many segments as the largest distance
of the two asks for: `SPARE` plus a quarter of it, which leaves a pair at the very threshold without a common cell in about
0.2 % of cases, and hardly ever above it.

Links: in each cell all texts are verified against one of them, the first by a hash, along with the candidates of the fingerprints. Those that aren't linked to it by any path
then meet the first among themselves, for `ROUNDS` rounds and in other orders; each text stands in dozens of cells with other company. What a cell still holds in several
components is then compared across these, so that no two texts of a cell stay apart unverified. There the lower bound decides first: the
parities of the counts of `PARITIES` finer segments differ at most as often as the sets do, so a pair with too many differing bits is no link, and
never becomes a row; the others are verified.

Scale: texts are tokenised in a narrow map and written as fingerprint and cells; some 90 cells a text of 450 words (16 bytes each) cross one exchange and are read in
order, a cell at a time, without being held, so a cell may be of any size; copies that equal each other word by word are one class, whose
cells leave a task once. Only texts with company have their sets fetched for verification. Edges grow with the rows of
cells; pairs are made only across components of a cell that the rounds left apart, never within a group of near copies.

Defined cases: texts without a word are copies of each other; with fewer words than a shingle the whole text is one shingle; a null text
counts as empty; a null id is a name like any other and comes last; of rows with equal id and equal words one stays; rows with
equal id and other words are texts of their own; an empty table gives an empty result; extra columns are kept.
Texts and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.components import components

from . import simhash_dedup
from .common import ascii_lower, for_long_rows, words, written

SHINGLE, SIMILARITY, ROUNDS = 5, 0.8, 3
#: Differing bits of two fingerprints that make their texts candidates.
RADIUS = 3
#: Hashes whose bits are counted at once.
VOTES = 65536
SPARE, PART = 12, 4
PARITIES = 1024
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX[3])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX[4])
    return h ^ (h >> np.uint64(32))


def shingle_set(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the runs of n words (of the whole text, if it has fewer), in order; hashes: those of the words."""
    size = max(len(hashes) - n + 1, min(len(hashes), 1))
    total = np.zeros(size, np.uint64)
    for k in range(min(n, len(hashes))):
        total = _mixed(total + hashes[k : k + size] * np.uint64(MIX[0]) + np.uint64(k + 1))
    return np.unique(total)


def fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set: the bits that over half of its hashes have, as a signed long."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(shingles), VOTES):
        part = np.ascontiguousarray(shingles[at : at + VOTES])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def segments(largest: int, similarity: float = SIMILARITY) -> int:
    """How many segments serve pairs of sets with at most `largest` elements each."""
    return int(2 * largest * (1 - similarity) / (1 + similarity)) // PART + SPARE


def cells(shingles: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The cells of a set: a 64-bit key for every segment that isn't empty, in its own size class and in the one below."""
    ratio = 1 / similarity
    own = int(math.log(len(shingles) + 0.5, ratio))
    out = []
    for level in (own, own - 1):
        m = np.uint64(segments(int(ratio ** (level + 2)) + 1, similarity))
        segment = (shingles >> np.uint64(20)) % m
        order = np.argsort(segment, kind="stable")
        start = np.flatnonzero(np.diff(segment[order], prepend=m))
        sums, counts = np.add.reduceat(shingles[order], start), np.diff(start, append=len(shingles)).astype(np.uint64)
        out.append(_mixed(_mixed(sums + segment[order][start] * np.uint64(MIX[1])) + counts * np.uint64(MIX[2]) + np.uint64(level + 2)))
    return np.concatenate(out)


def parities(shingles: np.ndarray) -> np.ndarray:
    """The parities of the segments' counts as bits of 64-bit numbers: two sets' differ in as many bits as the sets in elements, or fewer."""
    counts = np.bincount(((shingles >> np.uint64(7)) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(docs' columns, __fs_id: string, __fs_words: hashes of the words, __fs_class: their hash)."""
    split = docs.withColumn("__fs_words", F.transform(words(ascii_lower(F.col(text_col))), lambda w: F.xxhash64(w)))
    return split.withColumn("__fs_id", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).withColumn("__fs_class", F.xxhash64("__fs_words"))


def _profiles(hashed: DataFrame, n: int, similarity: float) -> DataFrame:
    """(c, fp, keys): a class with words, its fingerprint and its cells; a task gives a class once."""
    def emit(batches):
        seen: set[int] = set()
        for batch in batches:
            names, prints, keys = [], [], []
            for name, own in zip(batch.column("__fs_class").to_pylist(), _lists(batch.column("__fs_words")), strict=True):
                if name not in seen and len(own):
                    seen.add(name)
                    shingled = shingle_set(own, n)
                    names.append(name)
                    prints.append(fingerprint(shingled))
                    keys.append(cells(shingled, similarity).view(np.int64))
            if names:
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(prints, pa.int64()), lists], ["c", "fp", "keys"])

    return hashed.select("__fs_class", "__fs_words").mapInArrow(emit, "c bigint, fp bigint, keys array<bigint>")


def fingerprint_candidates(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) from rows (c, fp): texts whose fingerprints connect them within the radius, one text a fingerprint for all that share it."""
    heads = written(prints.groupBy("fp").agg(F.min("c").alias("head")), "heads")
    shared = prints.join(heads, "fp").filter("c <> head").select(F.col("c").alias("a"), F.col("head").alias("b"))
    of = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_head"))
    near = simhash_dedup.links(heads.select("fp"), radius).join(of("a"), "a").join(of("b"), "b")
    return shared.unionByName(near.select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))).distinct()


def _with_first(rows: DataFrame) -> DataFrame:
    """(key, c, first) of all but the first of each key's texts, from rows (key, c): read in order, nothing is held."""
    dealt = rows.repartition("key").sortWithinPartitions("key", "c")

    def walk(batches):
        last_key = last = first = None
        for batch in batches:
            key, c = batch.column("key").to_numpy(), batch.column("c").to_numpy()
            if not len(key):
                continue
            fresh = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
            again = np.concatenate([[key[0] == last_key and c[0] == last], (key[1:] == key[:-1]) & (c[1:] == c[:-1])])
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
            firsts = np.where(at >= 0, c[at], first if first is not None else 0)
            last_key, last, first = key[-1], c[-1], firsts[-1]
            keep = ~fresh & ~again & (c != firsts)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, c, firsts)], ["key", "c", "first"])

    return dealt.mapInArrow(walk, "key bigint, c bigint, first bigint")


def _turned(c: Column, turn: int) -> Column:
    return F.xxhash64(c, F.lit(turn))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that Jaccard similarity."""
    of = lambda side: sets.select(F.col("c").alias(side), F.col("set").alias(f"{side}_set"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    counted = both.select("a", "b", common.alias("i"), (F.size("a_set") + F.size("b_set")).alias("n"))
    return counted.filter(F.col("i") >= similarity * (F.col("n") - F.col("i"))).select("a", "b")


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, similarity: float = SIMILARITY, rounds: int = ROUNDS, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts (c, first: struct of the id's nullness, the id, c) and verified links (a, b) between classes; not `exact`: from the rounds alone."""
    for_long_rows(docs.sparkSession)
    hashed = _hashed(docs.select(id_col, text_col), id_col, text_col)
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "__fs_id")).alias("first")
    classes = written(hashed.groupBy(F.col("__fs_class").alias("c")).agg(first), "classes")
    profiles = written(_profiles(hashed, n, similarity), "profiles")
    candidates = written(fingerprint_candidates(profiles.select("c", "fp")), "candidates")
    company = written(_with_first(profiles.select(F.explode("keys").alias("key"), "c")), "company")
    names = company.select("c").union(company.select("first")).union(candidates.select("a")).union(candidates.select("b")).distinct().join(classes, "c").select(F.col("c").alias("__fs_class"), F.col("first.__fs_id").alias("__fs_id"))
    asked = docs.select(id_col, text_col)
    own = _hashed(asked, id_col, text_col).drop("__fs_words").join(names, ["__fs_class", "__fs_id"])

    def collect(batches):
        for batch in batches:
            sets = [shingle_set(x, n) for x in _lists(batch.column("h"))]
            bits = [parities(x) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("c"), *[pa.array([x.view(np.int64) for x in rows], pa.list_(pa.int64())) for rows in (sets, bits)]], ["c", "set", "bits"])

    held = own.select(F.col("__fs_class").alias("c"), F.transform(words(ascii_lower(F.col(text_col))), lambda w: F.xxhash64(w)).alias("h"))
    sets = written(held.mapInArrow(collect, "c bigint, set array<bigint>, bits array<bigint>").dropDuplicates(["c"]), "sets")
    links = written(_verified(company.select(F.col("c").alias("a"), F.col("first").alias("b")).unionByName(candidates).distinct(), sets, similarity), "links")
    cell = company.select("key", "c").unionByName(company.select("key", F.col("first").alias("c")).distinct())
    for turn in range(1, rounds):
        labels = written(components(links, "parts"), "labels")
        part = lambda c, as_: labels.select(F.col("node").alias(c), F.col("component").alias(as_))
        known = company.join(part("c", "pc"), "c", "left").join(part("first", "pf"), "first", "left")
        apart = written(known.filter(F.coalesce("pc", "c") != F.coalesce("pf", "first")).select("key", "c", F.coalesce("pc", "c").alias("pc")), "apart")
        heads = apart.groupBy("key").agg(F.min(F.struct(_turned(F.col("c"), turn).alias("h"), F.col("c").alias("first"), F.col("pc").alias("pf"))).alias("head")).select("key", "head.first", "head.pf")
        # and once more the other side: a text of the first one's own component
        others = company.join(part("c", "pc"), "c", "left").join(part("first", "pf"), "first", "left").filter(F.coalesce("pc", "c") == F.coalesce("pf", "first"))
        seconds = others.groupBy("key").agg(F.min(F.struct(_turned(F.col("c"), -turn).alias("h"), F.col("c").alias("first"), F.coalesce("pc", "c").alias("pf"))).alias("head")).select("key", "head.first", "head.pf")
        asked_pairs = apart.join(heads.unionByName(seconds), "key").filter("pc <> pf").select(F.col("c").alias("a"), F.col("first").alias("b")).distinct()
        links = written(links.unionByName(_verified(asked_pairs, sets, similarity)), "links")
        company = apart.join(heads, "key").filter("c <> first").select("key", "c", "first")
    if exact:
        links = written(links.unionByName(_verified(_across(cell, links, sets, similarity), sets, similarity)), "links")
    return classes, links


def _across(cell: DataFrame, links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts of one cell (key, c) that no links connect: those of a cell with several components, across these only, and within the lower bound."""
    labels = components(links, "parts").select(F.col("node").alias("c"), F.col("component").alias("p"))
    placed = written(cell.join(labels, "c", "left").withColumn("p", F.coalesce("p", "c")), "placed")
    mixed = placed.groupBy("key").agg(F.min("p").alias("low"), F.max("p").alias("high")).filter("low < high").select("key")
    sketch = sets.select("c", F.size("set").alias("n"), *[F.get("bits", F.lit(k)).alias(f"w{k}") for k in range(PARITIES // 64)])
    rest = placed.join(mixed, "key", "left_semi").join(sketch, "c")
    a, b = (rest.select("key", *[F.col(c).alias(f"{c}_{side}") for c in rest.columns if c != "key"]) for side in "ab")
    differing = sum((F.bit_count(F.col(f"w{k}_a").bitwiseXOR(F.col(f"w{k}_b"))) for k in range(1, PARITIES // 64)), F.bit_count(F.col("w0_a").bitwiseXOR(F.col("w0_b"))))
    near = differing * (1 + similarity) <= (F.col("n_a") + F.col("n_b")) * (1 - similarity) + 1e-6
    return a.join(b, "key").filter((F.col("p_a") < F.col("p_b")) & near).select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct()


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, similarity: float = SIMILARITY, rounds: int = ROUNDS, exact: bool = True) -> DataFrame:
    """docs without near copies: of each component of linked texts the row with the smallest id stays."""
    classes, links = similar_links(docs, id_col, text_col, n, similarity, rounds, exact)
    labels = components(links, "similar").withColumnRenamed("node", "c")
    member = classes.join(labels, "c", "left").select(F.coalesce("component", "c").alias("component"), F.struct("first.*", "c").alias("first"))
    kept = member.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.c").alias("__fs_class"), F.col("first.__fs_id").alias("__fs_id"))
    named = _hashed(docs, id_col, text_col).drop("__fs_words").join(written(kept, "kept"), ["__fs_class", "__fs_id"])
    return named.dropDuplicates(["__fs_class", "__fs_id"]).select(docs.columns)
