"""Line diff of page pairs: unchanged, removed, added and modified entries of a shortest edit script.

A page pair is a row with the lines of both sides. Where the two key arrays are equal (path a), or the keys are unique on
each side and the common ones keep their order (path b), the kept lines follow from array functions. Only the other pages
(path c: repeated or moved lines) go to Python, an Arrow batch at a time, for a longest common subsequence; it prefers, read
from the end, equal lines first and then the removal of old lines, so the script is the same on every run.

Pages with few edits are solved by furthest-reaching frontiers (Myers): after d edits one place a diagonal, all diagonals of a step at once, equal stretches
measured by prefix hashes of the lines' numbers. Some frontiers are kept, the others made again from these as the way back needs them. Where the edits
turn out to be so many that the table of common lengths is cheaper, that is used. Both give the same script.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.shared import ensure_importable
from .revisions import keys

KEPT = "array<struct<o:int,n:int>>"
#: Pairs of lines beyond which a page is left to the search whatever its lines are.
SEARCHED = 1_000_000
#: Rows of the table of common lengths that are held while they are traced.
ROWS_HELD = 64


def paths(pages: DataFrame, every: bool = False) -> DataFrame:
    """Common pages with their key arrays and path; with `every`, the others too, with null for it."""
    common = F.col("old_lines").isNotNull() & F.col("new_lines").isNotNull()
    keyed = (pages if every else pages.filter(common)).withColumn("ok", keys(F.col("old_lines"))).withColumn("nk", keys(F.col("new_lines")))
    unique = (F.size(F.array_distinct("ok")) == F.size("ok")) & (F.size(F.array_distinct("nk")) == F.size("nk"))
    where = F.filter(F.transform("ok", lambda k: F.array_position("nk", k)), lambda p: p > 0)
    long = F.size("ok").cast("long") * F.size("nk") > SEARCHED  # array_position looks at every line
    path = F.when(F.col("ok") == F.col("nk"), "a").when(long, "c").when(unique & (where == F.array_sort(where)), "b").otherwise("c")
    return keyed.withColumn("path", F.when(common, path) if every else path)


#: Cells of the table of common lengths up to which it is used at once, and how many of them cost as much as a place of a frontier.
SMALL, COST = 4096, 24
#: Steps of the hashes of line numbers.
_STEP = 0x9E3779B97F4A7C15


def common_lines(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, the one that the table of common lengths gives if read from the end."""
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(x, len(codes)) for x in side], np.int64) for side in (old, new))
    if len(a) * len(b) > SMALL:
        found = by_frontiers(a, b, int((len(a) * len(b) / COST) ** 0.5))
        if found is not None:
            return found
    return by_table(a, b)


class _Stretches:
    """Lengths of the equal stretches of two sequences from (ahead) or before (back) pairs of places, by hashes of their prefixes."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        n = max(len(a), len(b)) + 1
        powers = lambda base: np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))
        self.up, down = powers(_STEP), powers(pow(_STEP, -1, 1 << 64))
        self.n, self.m = len(a), len(b)
        # sums[i] = sums[i - 1] * step + x: the hash of a stretch is sums[end] - sums[start] * step ** length
        salt = np.uint64(0xBF58476D1CE4E5B9)
        mixed = [((x.astype(np.uint64) + np.uint64(1)) * salt) ^ ((x.astype(np.uint64) + np.uint64(1)) * salt >> np.uint64(29)) for x in (a, b)]
        self.sums = [np.append(np.uint64(0), np.cumsum(x * down[1 : len(x) + 1])) * self.up[: len(x) + 1] for x in mixed]

    def _equal(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        a, b = self.sums
        return a[x + size] - a[x] * self.up[size] == b[y + size] - b[y] * self.up[size]

    def _longest(self, most: np.ndarray, fits) -> np.ndarray:
        size = np.zeros_like(most)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            more = np.minimum(size + step, most)
            size = np.where(fits(more), more, size)
            step >>= 1
        return size

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._longest(np.minimum(self.n - x, self.m - y), lambda s: self._equal(x, y, s))

    def back(self, x: int, y: int) -> int:
        at = np.array([x]), np.array([y])
        return int(self._longest(np.minimum(*at), lambda s: self._equal(at[0] - s, at[1] - s, s))[0])


def by_frontiers(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]] | None:
    """Index pairs of the common subsequence, or None if more than `most` edits are needed.

    A frontier holds for the diagonals k = -d, -d + 2, ..., d (old place minus new place) the furthest old place that d edits reach, or -1.
    """
    n, m = len(a), len(b)
    stretch = _Stretches(a, b)

    def next_one(front: np.ndarray, d: int) -> np.ndarray:
        """Frontier d from frontier d - 1: an old line less (one diagonal up) or a new line more (one down), then equal lines."""
        k = np.arange(-d, d + 1, 2)
        if d == 0:
            x = np.zeros(1, np.int64)
        else:
            gone, come = np.append(-2, front) + 1, np.append(front, -2)
            gone[gone < 1], come[come < 0] = -1, -1
            gone[gone > n] = -1
            come[come - k > m] = -1
            x = np.maximum(gone, come)
        ok = (x >= 0) & (x - k <= m) & (x - k >= 0)
        x[~ok] = -1
        at = np.flatnonzero(ok)
        x[at] += stretch.ahead(x[at], x[at] - k[at])
        return x

    every = max(1, int(most**0.5))
    kept, front, d = {}, np.zeros(0, np.int64), 0
    while True:
        front = next_one(front, d)
        if d % every == 0:
            kept[d] = front
        if abs(n - m) <= d and (n - m + d) % 2 == 0 and front[(n - m + d) // 2] >= n:
            break
        d += 1
        if d > most:
            return None
    held: dict[int, np.ndarray] = {}

    def frontier(e: int) -> np.ndarray:
        if e not in held:
            held.clear()
            low = e - e % every
            now = kept[low]
            held[low] = now
            for step in range(low + 1, e + 1):
                now = held[step] = next_one(now, step)
        return held[e]

    out: list[tuple[int, int]] = []
    i, j = n, m
    while i and j:
        size = stretch.back(i, j)
        out += [(i - t, j - t) for t in range(1, size + 1)]
        i, j = i - size, j - size
        if not (i and j):
            break
        d -= 1
        place = i - 1 - j + d  # of the diagonal after the removal of old line i - 1
        if 0 <= place <= 2 * d and place % 2 == 0 and frontier(d)[place // 2] >= i - 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def by_table(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The same by the table of common lengths.

    Rows come from the row above; halves are traced from below, each from its own first row, so that a logarithm of rows is held at a time.
    """
    out: list[tuple[int, int]] = []

    def below(row: np.ndarray, i: int) -> np.ndarray:
        after = np.zeros_like(row)
        after[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b[: len(row) - 1] == a[i], row[:-1] + 1, 0)))
        return after

    def trace(low: int, high: int, row: np.ndarray) -> int:
        """Pairs of the old lines [low, high) with the new lines that `row`, the one before low, covers; returns how many of these are left."""
        if high - low > ROWS_HELD:
            middle, now = (low + high) // 2, row
            for i in range(low, middle):
                now = below(now, i)
            return trace(low, middle, row[: trace(middle, high, now) + 1])
        table = [row]
        for i in range(low, high):
            table.append(below(table[-1], i))
        i, j = high, len(row) - 1
        while i > low and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif table[i - 1 - low][j] >= table[i - low][j - 1]:
                i -= 1
            else:
                j -= 1
        return j

    trace(0, len(a), np.zeros(len(b) + 1, np.int32))
    return out[::-1]


def _searched(old: pa.Array, new: pa.Array) -> pa.Array:
    """The kept lines of pages by their keys; null where they aren't given."""
    found = [None if a is None else [{"o": o, "n": n} for o, n in common_lines(a, b)] for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)]
    return pa.array(found, pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32())])))


def kept_lines(pages: DataFrame, every: bool = False) -> DataFrame:
    """Common pages with path and kept: the index pairs of the lines that stay. All pages pass once; only the keys of path c reach Python."""
    ensure_importable(pages.sparkSession)
    place = lambda o, n: F.struct(o.cast("int").alias("o"), n.cast("int").alias("n"))
    equal = F.transform("ok", lambda k, i: place(i, i))
    moved = F.filter(F.transform("ok", lambda k, i: place(i, F.array_position("nk", k) - 1)), lambda p: p.n >= 0)
    asked = lambda c: F.when(F.col("path") == "c", F.col(c))
    searched = paths(pages, every).withColumn("found", F.arrow_udf(_searched, KEPT)(asked("ok"), asked("nk")))
    return searched.withColumn("kept", F.when(F.col("path") == "c", F.col("found")).when(F.col("path") == "a", equal).otherwise(moved).cast(KEPT)).drop("found")


def _gap(low_o: Column, high_o: Column, low_n: Column, high_n: Column) -> Column:
    """Entries between two kept lines: the shorter side of a replacement repeats its last line."""
    ol, nl = high_o - low_o, high_n - low_n
    entry = lambda kind, o, n: F.struct(F.lit(kind).alias("kind"), o.cast("int").alias("o"), n.cast("int").alias("n"))
    none = F.lit(None)
    run = lambda size: F.sequence(F.lit(0), size - 1)
    return (
        F.when((ol > 0) & (nl > 0), F.transform(run(F.greatest(ol, nl)), lambda k: entry("modified", low_o + F.least(k, ol - 1), low_n + F.least(k, nl - 1))))
        .when(ol > 0, F.transform(run(ol), lambda k: entry("removed", low_o + k, none)))
        .when(nl > 0, F.transform(run(nl), lambda k: entry("added", none, low_n + k)))
        .otherwise(F.array().cast("array<struct<kind:string,o:int,n:int>>"))
    )


def entries(pages: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(pair_id, page_index, path, entry_seq, kind, old_line, new_line, old_text, new_text) of all common pages, lines from 0, with columns of the page that are `carried` along."""
    # texts go into the entries first, so that no row of the result carries a page
    whole = F.transform(F.flatten(_steps()), lambda e: F.struct(e.kind.alias("kind"), e.o.alias("old_line"), e.n.alias("new_line"), F.get("old_lines", e.o).alias("old_text"), F.get("new_lines", e.n).alias("new_text")))
    made = _bounded(kept_lines(pages)).select("pair_id", "page_index", *carried, "path", F.posexplode(whole).alias("entry_seq", "e"))
    return made.select("pair_id", "page_index", *carried, "path", "entry_seq", "e.*")


def changed_lines(pages: DataFrame, texts: bool) -> DataFrame:
    """All pages, with `c`: the entries of a common page but the unchanged ones (entry_seq, kind, old_line, new_line, old_size and new_size: the lengths of the lines, and old_text and new_text
    if asked for); null on other pages. A row a page: no exchange."""
    numbered = F.transform(F.flatten(_steps()), lambda e, i: F.struct(i.alias("entry_seq"), e.kind.alias("kind"), e.o.alias("old_line"), e.n.alias("new_line")))
    line = lambda e, side: F.get(f"{side}_lines", e[f"{side}_line"])
    more = lambda e: [F.length(line(e, s)).alias(f"{s}_size") for s in ("old", "new")] + [line(e, s).alias(f"{s}_text") for s in ("old", "new") if texts]
    found = F.transform(F.filter(numbered, lambda e: e.kind != "unchanged"), lambda e: F.struct(*[e[c].alias(c) for c in ("entry_seq", "kind", "old_line", "new_line")], *more(e)))
    # of equal pages nothing is looked at
    changed = F.when(F.col("path").isNotNull(), F.when(F.col("path") == "a", F.array()).otherwise(found))
    kind = "array<struct<entry_seq:int,kind:string,old_line:int,new_line:int,old_size:int,new_size:int" + (",old_text:string,new_text:string>>" if texts else ">>")
    return _bounded(kept_lines(pages, every=True)).select(*pages.columns, changed.cast(kind).alias("c"))


def _bounded(kept: DataFrame) -> DataFrame:
    """With b: the kept lines between the bounds of the page."""
    bounds = F.concat(F.array(F.struct(F.lit(-1).alias("o"), F.lit(-1).alias("n"))), F.col("kept"), F.array(F.struct(F.size("ok").alias("o"), F.size("nk").alias("n"))))
    return kept.withColumn("b", bounds)


def _steps() -> Column:
    """The entries up to each kept line of b, and after the last one."""
    return F.transform(
        F.sequence(F.lit(1), F.size("b") - 1),
        lambda i: F.concat(
            _gap(F.get("b", i - 1).o + 1, F.get("b", i).o, F.get("b", i - 1).n + 1, F.get("b", i).n),
            F.when(i < F.size("b") - 1, F.array(F.struct(F.lit("unchanged").alias("kind"), F.get("b", i).o.alias("o"), F.get("b", i).n.alias("n")))).otherwise(F.array().cast("array<struct<kind:string,o:int,n:int>>")),
        ),
    )
def edit_lengths(pages: DataFrame) -> DataFrame:
    """(pair_id, page_index, n_old, n_new, n_kept, n_edits): how long the edit script of a common page is."""
    size = lambda c: F.size(c).cast("long")
    return kept_lines(pages).select("pair_id", "page_index", size("ok").alias("n_old"), size("nk").alias("n_new"), size("kept").alias("n_kept"), (size("ok") + size("nk") - 2 * size("kept")).alias("n_edits"))
