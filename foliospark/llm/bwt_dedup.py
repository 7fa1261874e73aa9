"""Repeated passages by run-length indexes over the Burrows-Wheeler transform.

A byte goes if a string of `LENGTH` bytes over it also starts anywhere else in the table. The work is dealt out by
content, so that equal strings meet in one index and no index grows with the corpus:

1. Winnowing: a window of LENGTH bytes is named by the smallest hash of its 64-byte grams. A run of windows with one name is a
   fragment; equal windows have equal names, so a repeat is found among the fragments of its name or nowhere.
2. Fragments with equal bytes are counted together; names that occur once are dropped, unless their gram repeats within them.
3. The distinct fragments of the other names are indexed, about a million bytes at a time: suffix order by prefix doubling,
   Burrows-Wheeler transform, its runs, and the matches at the sampled run ends. The matching statistics of all positions
   stream from these samples: a match can only begin to grow where a run ends, and shrinks by one a position elsewhere.
   Positions whose statistic reaches LENGTH start a repeated window. A fragment that occurs twice as a whole matches itself.
4. The windows go back to all places of their fragments, and the texts lose the bytes that these cover.

Scale: a text crosses an exchange twice, in two joins by its digest that AQE may split; everything else is fragments' names, some
40 bytes for every 170 bytes of text. Copies of a text add rows of names, but nothing to the indexes. A name with more than
`HOT` distinct fragments, or more than `INDEX_BYTES` symbols of them, has no index: no name of a part of a window would split
the contexts of one passage. Its windows are dealt by digests of their own (128 bits) and counted, equal ones of a fragment once,
so that again no match is lost. An index thus stays under 2**21 symbols, beyond which its positions would not fit; should the names
that it takes whole ever exceed that, their windows are counted in the task.

Defined cases: null counts as empty; texts shorter than LENGTH stay whole; matches never cross documents; rows that repeat
are documents of their own (and so remove each other); extra columns are ignored; an empty table gives an empty result.
Fragments are told apart by 128 bits of two polynomial hashes, texts by their MD5.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import for_long_rows, written

LENGTH, GRAM = 400, 64
#: Bytes of an index, and distinct fragments from which a name's windows are dealt singly.
INDEX_BYTES, HOT = 1_000_000, 1024
#: Windows of a text that are named at a time; bounds memory, not results.
CHUNK = 1 << 20
#: Bits of a position in an index.
PLACE_BITS = 21
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)
ANCHORS = "array<struct<h:bigint,f1:bigint,f2:bigint,s:int,e:int,own:boolean>>"


@lru_cache(maxsize=8)
def _powers(bits: int, base: int) -> np.ndarray:
    """base**k modulo 2**64 for all k below 2**bits."""
    out = np.ones(1 << bits, np.uint64)
    for b in range(bits):
        out[1 << b : 2 << b] = out[: 1 << b] * np.uint64(pow(base, 1 << b, 1 << 64))
    return out


def _sums(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums whose differences, times the returned powers, are hashes of the slices."""
    bits = max(14, int(len(data)).bit_length())
    down = _powers(bits, pow(base, -1, 1 << 64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=sums[1:])
    return sums, _powers(bits, base)


def _slice_hash(sums: np.ndarray, up: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = (sums[end] - sums[start]) * up[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by minima ahead and back within blocks."""
    n = len(h)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = h
    blocks = blocks.reshape(-1, width)
    ahead, back = np.minimum.accumulate(blocks, 1).ravel(), np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def grams(data: np.ndarray, gram: int = GRAM, base: int = BASES[0]) -> np.ndarray:
    sums, up = _sums(data, base)
    at = np.arange(len(data) - gram + 1)
    return _slice_hash(sums, up, at, at + gram)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return start, np.append(start[1:], len(values)) if len(values) else start


def fragments(text: bytes, length: int = LENGTH, gram: int = GRAM) -> list[dict]:
    """Runs [s, e) of windows with one name h, and the digest (f1, f2) of the bytes [s, e + length - 1) that they span.

    own: the naming gram stands in the fragment more than once, so that its windows may repeat within it.
    """
    data = np.frombuffer(text, np.uint8)
    windows = len(data) - length + 1
    return [f for low in range(0, windows, CHUNK) for f in _fragments(data[low : min(low + CHUNK, windows) + length - 1], low, length, gram)]


def _fragments(data: np.ndarray, offset: int, length: int, gram: int) -> list[dict]:
    """Those of a stretch of a text; one that goes on in the next stretch is two fragments of one name."""
    hashed, width = grams(data, gram), length - gram + 1
    named = _least(hashed, width)
    s, e = _runs(named)
    value, reach = named[s][:, None], np.arange(width)
    first = s + (hashed[s[:, None] + reach] == value).argmax(1)
    last = e + width - 2 - (hashed[(e + width - 2)[:, None] - reach] == value).argmax(1)
    f1, f2 = (_slice_hash(*_sums(data, b), s, e + length - 1).view(np.int64) for b in BASES[1:])
    columns = (named[s].view(np.int64), f1, f2, s + offset, e + offset, first != last)
    return [dict(zip(("h", "f1", "f2", "s", "e", "own"), row, strict=True)) for row in zip(*(c.tolist() for c in columns), strict=True)]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the symbols (under 2**PLACE_BITS, or an error) in the order of their first `depth` or more symbols.

    Prefix doubling: a suffix's rank is the place where its class of equal prefixes begins, and only the members of classes
    with more than one suffix are sorted on. Rank, next rank and position share one word, so that a plain sort does.
    """
    n = len(text)
    if n >= 1 << PLACE_BITS:
        raise ValueError(f"{n} symbols are too many for positions of {PLACE_BITS} bits")
    low, mask = np.uint64(PLACE_BITS), np.uint64((1 << PLACE_BITS) - 1)
    used = np.bincount(text) > 0
    dense = np.cumsum(used)[text]  # from one: the end of the text comes before all
    bits = int(used.sum()).bit_length()
    h = min(8, 2 * PLACE_BITS // bits)
    wide = np.zeros(n + h, np.uint64)
    wide[:n] = dense
    first = np.zeros(n, np.uint64)
    for k in range(h):
        first = first << np.uint64(bits) | wide[k : n + k]
    keys = first << low | np.arange(n, dtype=np.uint64)
    keys.sort()
    order = (keys & mask).astype(np.int64)
    rank = np.zeros(n + 1, np.uint64)  # of a class, plus one; the end of the text has none
    place, high = np.arange(n), keys >> low
    while True:
        begins = np.concatenate([[True], high[1:] != high[:-1]])
        at = place[np.maximum.accumulate(np.where(begins, np.arange(len(place)), 0))]
        rank[order[place]] = at.astype(np.uint64) + np.uint64(1)
        alone = begins & np.append(begins[1:], True)
        place = place[~alone]
        if h >= depth or not len(place):
            return order
        tied = order[place]
        keys = (rank[tied] - np.uint64(1)) << np.uint64(2 * PLACE_BITS) | rank[np.minimum(tied + h, n)] << low | tied.astype(np.uint64)
        keys.sort()
        order[place] = (keys & mask).astype(np.int64)
        high = keys >> low
        h *= 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes a and b (pairwise), up to a separator (0), eight symbols at a step."""
    used = np.bincount(text) > 0
    kind, size = (np.uint8, 8) if used.sum() < 256 else (np.uint16, 4)
    codes = np.zeros(len(text) + 16, kind)
    codes[: len(text)] = np.cumsum(used)[text]
    words = np.ndarray((len(text) + 1,), np.uint64, codes.data, 0, (codes.itemsize,))
    stops = np.append(np.flatnonzero(text == 0), len(text))
    limit = np.minimum(stops[np.searchsorted(stops, a)] - a, stops[np.searchsorted(stops, b)] - b)
    out, going = np.zeros(len(a), np.int64), np.flatnonzero(limit > 0)
    while len(going):
        differ = words[a[going] + out[going]] ^ words[b[going] + out[going]]
        equal = differ == 0
        lowest = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64)  # zero bits below the first difference
        out[going] += np.where(equal, size, lowest // (8 * codes.itemsize))
        going = going[equal & (out[going] < limit[going])]
    return np.minimum(out, limit)


class RunIndex:
    """Run-length Burrows-Wheeler transform of some fragments with the matches at its sampled run ends."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.sizes = sizes
        self.text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + 1
        self.text[self.start + sizes] = 0
        order = suffix_order(self.text, int(sizes.max()) + 1)  # shallower, a longer match could stand beyond a neighbour
        self.transform = self.text[order - 1]
        ends = np.flatnonzero(self.transform[1:] != self.transform[:-1])  # last row of each run but the final one
        self.runs = len(ends) + 1
        # a row's neighbour in another run: the samples. Rows at the rims of separators are samples too, being texts' first bytes.
        above, below = order[ends], order[ends + 1]
        same = common_prefix(self.text, above, below)
        first = np.flatnonzero(self.transform[1:] == 0)
        more = common_prefix(self.text, order[first], order[first + 1])
        again = np.flatnonzero(self.transform[:-1] == 0)
        back = common_prefix(self.text, order[again], order[again + 1])
        self.samples = [(above, same), (below, same), (order[first + 1], more), (order[again], back)]

    def statistics(self) -> np.ndarray:
        """At each position the length of the longest match with another position."""
        at = np.arange(len(self.text))
        reach = at.copy()
        for where, size in self.samples:
            np.maximum.at(reach, where, where + size)
        return np.maximum.accumulate(reach) - at


def window_digests(piece: bytes, length: int = LENGTH) -> np.ndarray:
    """A row (w1, w2) of two 64-bit hashes for every window."""
    data = np.frombuffer(piece, np.uint8)
    at = np.arange(len(data) - length + 1)
    return np.stack([_slice_hash(*_sums(data, base), at, at + length) for base in BASES[1:]], 1).view(np.int64)


def _counted_windows(pieces: list[bytes], many: list[bool], length: int) -> list[np.ndarray]:
    """For each fragment whether its windows occur elsewhere, by their digests: for what is too large for an index."""
    digests = [window_digests(p, length) for p in pieces]
    both = np.concatenate(digests)
    order = np.lexsort((both[:, 1], both[:, 0]))
    new = np.concatenate([[True], (both[order[1:]] != both[order[:-1]]).any(1)])
    group = np.cumsum(new) - 1
    found = np.empty(len(both), bool)
    found[order] = np.bincount(group)[group] > 1
    return [f | m for f, m in zip(np.split(found, np.cumsum([len(d) for d in digests])[:-1]), many, strict=True)]


def repeated_windows(pieces: list[bytes], many: list[bool], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each fragment the runs [a, b) of its windows that occur elsewhere; all of them where it occurs more than once itself."""
    if sum(map(len, pieces)) + len(pieces) >= 1 << PLACE_BITS:
        return [_true_runs(f) for f in _counted_windows(pieces, many, length)]
    index = RunIndex(pieces)
    found = index.statistics() >= length
    out = []
    for k, start in enumerate(index.start.tolist()):
        windows = int(index.sizes[k]) - length + 1
        if many[k]:
            out.append([(0, windows)])
            continue
        out.append(_true_runs(found[start : start + windows]))
    return out


def _true_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    s, e = _runs(flags)
    return list(zip(s[flags[s]].tolist(), e[flags[s]].tolist(), strict=True))


def _pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, f1, f2, many, hot, piece): the bytes of the wanted fragments."""
    joined = docs.join(wanted, ["_key", "_id"]).select("_key", "_id", "_text", "_list")

    def cut(batches):
        last = None
        for batch in batches:
            rows = []
            for key, name, text, wanted_here in zip(*(batch.column(c).to_pylist() for c in ("_key", "_id", "_text", "_list")), strict=True):
                if (key, name) == last:
                    continue  # a row that repeats (or equal texts without id): the join leaves them side by side
                last = key, name
                rows += [(w["h"], w["f1"], w["f2"], w["many"], w["hot"], text[w["s"] : w["e"] + LENGTH - 1]) for w in wanted_here]
            for k in range(0, len(rows), 4096):
                columns = list(zip(*rows[k : k + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.bool_(),) * 2 + (pa.binary(),), strict=True))], ["h", "f1", "f2", "many", "hot", "piece"])

    return joined.mapInArrow(cut, "h bigint, f1 bigint, f2 bigint, many boolean, hot boolean, piece binary")


def _hot_windows(pieces: DataFrame) -> DataFrame:
    """Windows of the fragments of hot names, (w1, w2, n, h, f1, f2, a, b), in three kinds of rows.

    A window that its fragment holds once: its digest, n = 1 and its place [a, b). One that repeats by the fragment alone: its digest with
    n = 2 and no place. The places [a, b) of the latter: no digest.
    """
    kinds = (*(pa.int64(),) * 6, pa.int32(), pa.int32())
    columns = ["w1", "w2", "n", "h", "f1", "f2", "a", "b"]

    def cut(batches):
        for batch in batches:
            for h, f1, f2, many, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digests = window_digests(piece)
                _, at, back, n = np.unique(digests, axis=0, return_index=True, return_inverse=True, return_counts=True)
                twice = (n > 1) | many
                for k in range(0, len(at), 65536):
                    part, two = at[k : k + 65536], twice[k : k + 65536]
                    same = [np.full(len(part), x, np.int64) for x in (h, f1, f2)]
                    values = [digests[part, 0], digests[part, 1], 1 + two.astype(np.int64), *same]
                    places = [pa.array(x.astype(np.int32), mask=two) for x in (part, part + 1)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, values), *places], columns)
                runs = _true_runs(twice[back.ravel()])
                for k in range(0, len(runs), 65536):
                    rows = zip(*[(None, None, None, h, f1, f2, a, b) for a, b in runs[k : k + 65536]], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], columns)

    return pieces.mapInArrow(cut, "w1 bigint, w2 bigint, n bigint, h bigint, f1 bigint, f2 bigint, a int, b int")


def _counted(windows: DataFrame) -> DataFrame:
    """(h, f1, f2, a, b): runs of repeated windows of hot names, relative to the fragment."""
    more = windows.filter("w1 IS NOT NULL").groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").drop("n")
    single = windows.filter("w1 IS NOT NULL AND a IS NOT NULL").join(more, ["w1", "w2"])
    # neighbouring windows keep the difference of place and number in the fragment
    row = F.row_number().over(Window.partitionBy("h", "f1", "f2").orderBy("a"))
    merged = single.select("h", "f1", "f2", "a", "b", (F.col("a") - row).alias("run")).groupBy("h", "f1", "f2", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.drop("run").unionByName(windows.filter("w1 IS NULL").select("h", "f1", "f2", "a", "b"))


def _matched(pieces: DataFrame, parts: int) -> DataFrame:
    """(h, f1, f2, a, b): runs of repeated windows, relative to the fragment, from indexes over whole names."""
    dealt = pieces.repartition(parts, "h").sortWithinPartitions("h", "f1", "f2")

    def index(batches):
        held: list[tuple] = []
        size = 0
        last = None

        def flush():
            out = []
            for row, runs in zip(held, repeated_windows([r[4] for r in held], [r[3] for r in held]), strict=True):
                out += [(*row[:3], a, b) for a, b in runs]
            columns = list(zip(*out, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.int32(),) * 2, strict=True)], ["h", "f1", "f2", "a", "b"])

        for batch in batches:
            for h, f1, f2, many, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, f1, f2) == last:
                    continue  # the same fragment, from a row that repeats
                if held and size >= INDEX_BYTES and h != last[0]:
                    yield flush()
                    held.clear()
                    size = 0
                last = (h, f1, f2)
                held.append((h, f1, f2, many, piece))
                size += len(piece) + 1
        if held:
            yield flush()

    return dealt.mapInArrow(index, "h bigint, f1 bigint, f2 bigint, a int, b int")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) a row; see the contract at the head of this module."""
    spark = docs.sparkSession
    for_long_rows(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("_id"), F.col(id_col).alias("_name"), F.unhex(F.md5(text)).alias("_key"), text.alias("_text"))

    def found(batches):
        for batch in batches:
            lists = pa.array([fragments(t) for t in batch.column("_text").to_pylist()], pa.list_(pa.struct([("h", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("own", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_id"), lists], ["_key", "_id", "anchors"])

    places = written(keyed.filter(F.length("_text") >= LENGTH).select("_key", "_id", "_text").mapInArrow(found, f"_key binary, _id bigint, anchors {ANCHORS}"), "fragments")
    each = places.select("_key", "_id", F.inline("anchors"))
    # fixed-width sums and minima only: aggregated by hash, map-side first. `least` is in both branches so that they share one exchange
    distinct = each.groupBy("h", "f1", "f2").agg(F.count("*").alias("m"), F.max("own").alias("own"), F.min("_id").alias("least"), F.min(F.col("e") - F.col("s") + LENGTH).alias("size"))
    counted = distinct.groupBy("h").agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.max("own").alias("some"), F.min("least").alias("any"), F.sum("size").alias("symbols")).filter("(n > 1 OR some) AND any IS NOT NULL")
    shared = written(distinct.drop("size").join(counted.select("h", ((F.col("k") > HOT) | (F.col("symbols") > INDEX_BYTES)).alias("hot")), "h"), "names")
    places_of = written(each.drop("own").join(shared.drop("own"), ["h", "f1", "f2"]), "places")
    first = places_of.filter(F.col("_id") == F.col("least"))  # one place is enough; rows that repeat are met again in the index
    wanted = first.groupBy("_key", "_id").agg(F.collect_set(F.struct("h", "f1", "f2", (F.col("m") > 1).alias("many"), "hot", "s", "e")).alias("_list"))
    pieces = _pieces(keyed.select("_key", "_id", "_text"), wanted)
    some_hot = not shared.filter("hot").isEmpty()
    if some_hot:
        pieces = written(pieces, "pieces")
    runs = written(_matched(pieces.filter("NOT hot").drop("hot"), parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "runs")
    if some_hot:
        # once each: a place that stands again is that of a row that repeats, and counted in `m`
        hot = pieces.filter("hot").select("h", "f1", "f2", "many", "piece").dropDuplicates(["h", "f1", "f2"])
        runs = runs.unionByName(written(_counted(written(_hot_windows(hot), "windows")), "hot_runs"))
    spans = places_of.join(runs, ["h", "f1", "f2"]).select("_key", F.struct((F.col("s") + F.col("a")).alias("low"), (F.col("s") + F.col("b") + (LENGTH - 1)).alias("high")).alias("span"))
    covered = spans.groupBy("_key").agg(F.collect_set("span").alias("spans"))
    joined = keyed.select("_name", "_key", "_text").join(covered, "_key", "left").select("_name", "_text", F.array_sort(F.coalesce("spans", F.array())).alias("spans"))

    def keep(batches):
        for batch in batches:
            rows = [remove(t, [(s["low"], s["high"]) for s in spans]) for t, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            kept, removed, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("_name"), pa.array([len(t.as_py()) for t in batch.column("_text")], pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    done = joined.mapInArrow(keep, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the sorted spans, how many bytes went, and in how many runs."""
    kept, at, gone, runs, end = [], 0, 0, 0, -1
    for low, high in spans:
        if low > end:
            runs += 1
        if high > at:
            low = max(low, at)
            kept.append(text[at:low])
            gone += high - low
            at = high
        end = max(end, high)
    kept.append(text[at:])
    return b"".join(kept), gone, runs


def digest(docs: DataFrame) -> DataFrame:
    """The op7 result."""
    return repeated_passages(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[bytes, int, int]]:
    """The same by a table of all windows; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            key = hashlib.blake2b(t[k : k + length], digest_size=16).digest()
            seen[key] = seen.get(key, 0) + 1
    return [remove(t, [(k, k + length) for k in range(len(t) - length + 1) if seen[hashlib.blake2b(t[k : k + length], digest_size=16).digest()] > 1]) for t in texts]
