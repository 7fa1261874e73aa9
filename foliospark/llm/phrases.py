"""Phrases of two or three words that stand together more often than their parts, from weighted acyclic automata of word n-grams.

1. A task cuts texts into pieces and words and counts n-grams of up to three words, some two million words of a language at a time. Sorted, they become count
   automata: paths of one and two words with their counts, and states behind the latter whose arcs (a third word, a count) say what follows. Equal
   states are one, so that the many prefixes with the same single continuation share it.
2. N-grams are dealt by prefix ranges: the hash of the first two words, of one for single words, falls into one of `ranges` equal intervals. All n-grams of
   a prefix meet in one range, where the automata of all tasks are united and their counts summed, a bounded number of paths at a time; a frequent first word is spread over
   all ranges by the second. Then counts under `least` go: no part of a candidate is among them.
3. A candidate's own range holds its first two words. Its other parts are asked for in their ranges: each range sends the distinct ones (so that a frequent word is asked
   for once a range), these form an automaton that is composed with the range's counts, and what paths they share are the replies. The pairs that end
   a candidate of three words carry its count along, so that a pair learns of the longest-lived candidate around it.
4. With the replies each range scores its candidates, in integers of any size, and hands on its best `top` of a language; windows over 64 parts and then over these rank them.

A range of 1/ranges of the distinct frequent n-grams, and its replies, are what a task holds. Defined cases: null and empty texts hold no word, a null lang is `und`,
rows that repeat count again, a text or word may be of any length (long texts are cut between words, and n-grams across cuts counted once); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import for_long_rows, parallelism, slices, written

LEAST, SHARE, TOP, SCALE = 10, 50, 2000, 1_000_000
#: Words of a language that a task counts at once (their ids take 21 bits), and bytes of text that are split at once.
WORDS, BYTES = 1_500_000, 1 << 20
ID_BITS = 21
#: Paths that a range holds before the automata that came to it are united.
HELD = 2_000_000
#: Parts of a language's candidates that are ranked before their best are.
PARTS = 64
CUT = b"\xff"  # no byte of UTF-8
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + BREAKS, b"abcdefghijklmnopqrstuvwxyz" + CUT * len(BREAKS))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def ranges_of(first: np.ndarray, second: np.ndarray | None, ranges: int) -> np.ndarray:
    """The range of a prefix, from the hashes of its words."""
    h = first if second is None else first * np.uint64(3) + _mixed(second)
    return (_mixed(h) >> np.uint64(33)).astype(np.int64) * ranges >> 31


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, np.int64)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], None
    at = _firsts(keys)
    return keys[at], np.add.reduceat(weights[order], at) if len(at) else weights[:0]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[k], first[k] + 1, ..., size[k] of them, for all k."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Automaton:
    """Counts of word sequences: `ones` (symbol, count), `twos` (symbol, symbol, count, state), and the arcs (symbol, count) of each state."""

    def __init__(self, symbols: pa.Array, ones: np.ndarray, ones_n: np.ndarray, a: np.ndarray, b: np.ndarray, twos_n: np.ndarray, state: np.ndarray, first: np.ndarray, c: np.ndarray, threes_n: np.ndarray):
        self.symbols, self.ones, self.ones_n = symbols, ones, ones_n
        self.a, self.b, self.twos_n, self.state = a, b, twos_n, state
        self.first, self.c, self.threes_n = first, c, threes_n

    @classmethod
    def built(cls, symbols: pa.Array, ones: np.ndarray, ones_n: np.ndarray, a: np.ndarray, b: np.ndarray, twos_n: np.ndarray, size: np.ndarray, c: np.ndarray, threes_n: np.ndarray) -> Automaton:
        """From sorted paths; the arcs after the k-th pair are the next size[k] of (c, threes_n). Pairs with equal arcs lead to one state."""
        begin = np.cumsum(size) - size
        state = np.zeros(len(a), np.int64)
        kept, widths = [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
        single = np.flatnonzero(size == 1)
        if len(single):
            at = begin[single]
            order = np.lexsort((threes_n[at], c[at]))
            new = np.append(True, (np.diff(c[at][order]) != 0) | (np.diff(threes_n[at][order]) != 0))
            state[single[order]] = np.cumsum(new)
            kept.append(at[order][new])
            widths.append(np.ones(int(new.sum()), np.int64))
        known: dict[bytes, int] = {}
        others, so_far = [], sum(map(len, widths))
        for k in np.flatnonzero(size > 1).tolist():
            part = slice(begin[k], begin[k] + size[k])
            key = c[part].tobytes() + threes_n[part].tobytes()
            found = known.setdefault(key, so_far + len(known))
            if found == so_far + len(others):
                others.append(k)
            state[k] = found
        if others:
            kept.append(_spread(begin[others], size[others]))
            widths.append(size[others])
        taken = np.concatenate(kept)
        return cls(symbols, ones, ones_n, a, b, twos_n, state, np.append(0, np.cumsum(np.concatenate(widths))), c[taken], threes_n[taken])

    def arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair how many arcs follow, and these of all pairs."""
        size = np.diff(self.first)[self.state]
        at = _spread(self.first[self.state], size)
        return size, self.c[at], self.threes_n[at]

    def stored(self) -> bytes:
        arrays = [self.ones, self.ones_n, self.a, self.b, self.twos_n, self.state, self.first, self.c, self.threes_n]
        words = self.symbols.to_pylist()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        head = np.array([len(x) for x in [*arrays, sizes]], np.int64)
        raw = b"".join([head.tobytes(), *(x.astype(np.int64).tobytes() for x in [*arrays, sizes]), *words])
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @classmethod
    def loaded(cls, blob: bytes) -> Automaton:
        raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
        head = np.frombuffer(raw, np.int64, 10)
        parts = np.split(np.frombuffer(raw, np.int64, int(head.sum()), 80), np.cumsum(head)[:-1])
        words = raw[80 + 8 * int(head.sum()) :]
        offsets = np.append(0, np.cumsum(parts[-1]))
        symbols = pa.Array.from_buffers(pa.large_binary(), int(head[-1]), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words)])
        return cls(symbols, *parts[:-1])

    def paths(self) -> int:
        return len(self.ones) + len(self.a) + len(self.c)


def united(automata: list[Automaton]) -> Automaton:
    """One automaton with the sums of the counts of all."""
    if len(automata) == 1:
        return automata[0]
    coded = pa.chunked_array([x.symbols for x in automata]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names = np.split(rank[coded.indices.to_numpy()], np.cumsum([len(x.symbols) for x in automata])[:-1])
    join = lambda each: np.concatenate([each(x, n) for x, n in zip(automata, names, strict=True)])
    ones, ones_n = _summed(join(lambda x, n: n[x.ones]), join(lambda x, n: x.ones_n))
    pairs = [n[x.a] << 32 | n[x.b] for x, n in zip(automata, names, strict=True)]
    twos, twos_n = _summed(np.concatenate(pairs), join(lambda x, n: x.twos_n))
    keys, counts = [], []
    for x, n, p in zip(automata, names, pairs, strict=True):
        size, c, w = x.arcs()
        keys.append(np.repeat(np.searchsorted(twos, p), size) << 32 | n[c])
        counts.append(w)
    threes, threes_n = _summed(np.concatenate(keys), np.concatenate(counts))
    size = np.bincount(threes >> 32, minlength=len(twos))
    low = (1 << 32) - 1
    return Automaton.built(coded.dictionary.take(order), ones, ones_n, twos >> 32, twos & low, twos_n, size, threes & low, threes_n)


def frequent(x: Automaton, least: int) -> Automaton:
    """The paths with counts of `least` or more; with a path its beginnings stay."""
    size, c, w = x.arcs()
    keep = x.twos_n >= least
    arc = w >= least
    size = np.bincount(np.repeat(np.arange(len(size)), size)[arc], minlength=len(size))[keep]
    one = x.ones_n >= least
    parts = [x.ones[one], x.a[keep], x.b[keep], c[arc]]
    used = np.unique(np.concatenate(parts))
    ones, a, b, c = (np.searchsorted(used, p) for p in parts)
    return Automaton.built(x.symbols.take(pa.array(used)), ones, x.ones_n[one], a, b, x.twos_n[keep], size, c, w[arc])


class Tally:
    """The words of one language in a task, as ids."""

    def __init__(self):
        self.ids: dict[bytes, int] = {CUT: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        ids = self.ids
        for w in set(words).difference(ids):
            ids[w] = len(ids)
        self.parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def taken(self, ranges: int):
        """(range, automaton) of all n-grams so far; the last two words stay as context, so that n-grams that end later are counted then."""
        text = np.concatenate(self.parts) if self.parts else np.empty(0, np.int64)
        words = sorted(self.ids.keys() - {CUT})
        rank = np.empty(len(self.ids), np.int64)
        rank[[0, *map(self.ids.__getitem__, words)]] = np.arange(len(self.ids))
        x = rank[text]
        old = self.old if hasattr(self, "old") else 0
        tail = [list(self.ids)[k] for k in text[-2:].tolist()]
        yield from _automata(x, old, words, ranges)
        self.__init__()
        self.add(tail)
        self.size, self.old = 0, len(tail)


def _automata(x: np.ndarray, old: int, words: list[bytes], ranges: int):
    """n-grams of ids (0 cuts; others from 1, in the order of the words) that end after the first `old` of them."""
    new = x[old:]
    counts = np.bincount(new, minlength=len(words) + 1)
    one = np.flatnonzero(counts[1:]) + 1
    second = max(old, 1)
    a, b = x[second - 1 : -1], x[second:]
    twos, twos_n = np.unique((a << ID_BITS | b)[(a > 0) & (b > 0)], return_counts=True)
    third = max(old, 2)
    a, b, c = x[third - 2 : -2], x[third - 1 : -1], x[third:]
    threes, threes_n = np.unique((a << 2 * ID_BITS | b << ID_BITS | c)[(a > 0) & (b > 0) & (c > 0)], return_counts=True)
    prefix = threes >> ID_BITS
    # the prefix of a triple whose pair ended before the context was kept has been counted: it stands here without a count
    every = np.union1d(twos, prefix)
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, twos)] = twos_n
    low = (1 << ID_BITS) - 1
    a, b, c = every >> ID_BITS, every & low, threes & low
    size = np.bincount(np.searchsorted(every, prefix), minlength=len(every))
    begin = np.cumsum(size) - size
    hashes = np.append(np.uint64(0), word_hashes(words))
    to_one, to_two = ranges_of(hashes[one], None, ranges), ranges_of(hashes[a], hashes[b], ranges)
    by_one, by_two = np.argsort(to_one, kind="stable"), np.argsort(to_two, kind="stable")
    cut_one, cut_two = (np.searchsorted(t[o], np.arange(ranges + 1)) for t, o in ((to_one, by_one), (to_two, by_two)))
    for r in range(ranges):
        ones, twos = one[by_one[cut_one[r] : cut_one[r + 1]]], by_two[cut_two[r] : cut_two[r + 1]]
        if not len(ones) + len(twos):
            continue
        arcs = _spread(begin[twos], size[twos])
        parts = [ones, a[twos], b[twos], c[arcs]]
        used = np.unique(np.concatenate(parts))
        symbols = pa.array([words[k - 1] for k in used.tolist()], pa.large_binary())
        ones, first, then, last = (np.searchsorted(used, p) for p in parts)
        yield r, Automaton.built(symbols, ones, counts[used[ones]], first, then, n[twos], size[twos], last, threes_n[arcs])


def _split(text: bytes):
    """The words of a text, with CUT between its pieces and at its end, some of its bytes at a time."""
    clean = text.translate(LOWER)
    at = 0
    while at < len(clean):
        end = len(clean)
        if end - at > BYTES:
            found = re.compile(rb"[ \t]").search(clean, at + BYTES)
            end = found.start() if found else end
        yield clean[at:end].replace(CUT, b" \xff ").split()
        at = end
    yield [CUT]


AUTOMATA = "range int, lang string, n bigint, blob binary"
_NAMES = ["range", "lang", "n", "blob"]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.binary()), strict=True)], _NAMES)


def _counted(texts: DataFrame, ranges: int) -> DataFrame:
    """(AUTOMATA) of tasks: lang and text (binary) as count automata by prefix range."""

    def run(batches):
        tallies: dict[str, Tally] = {}

        def handed(lang):
            rows = []
            for r, x in tallies[lang].taken(ranges):
                rows.append((r, lang, int(x.ones_n.sum()), x.stored()))
                if len(rows) == 64:
                    yield _record(rows)
                    rows = []
            if rows:
                yield _record(rows)

        total = 0
        for batch in slices(batches):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if len(text) > BYTES:
                    pieces = _split(text)
                else:
                    by.setdefault(lang, []).append(text)
                    continue
                tally = tallies.setdefault(lang, Tally())
                for words in pieces:
                    tally.add(words)
                    if tally.size >= WORDS:
                        yield from handed(lang)
            for lang, short in by.items():
                tally = tallies.setdefault(lang, Tally())
                held, size = [], 0
                for k, text in enumerate(short):
                    held.append(text)
                    size += len(text)
                    if size >= BYTES or k == len(short) - 1:
                        tally.add([*b"\n".join(held).translate(LOWER).replace(CUT, b" \xff ").split(), CUT])
                        held, size = [], 0
                        if tally.size >= WORDS:
                            yield from handed(lang)
            total = sum(t.size for t in tallies.values())
            if total >= 4 * WORDS:  # many languages: hand all on
                for lang in list(tallies):
                    yield from handed(lang)
                    del tallies[lang]
        for lang in list(tallies):
            yield from handed(lang)

    return texts.mapInArrow(run, AUTOMATA)


def _runs(batch: pa.RecordBatch):
    """Slices of a batch with one (range, lang)."""
    r, lang = batch.column("range").to_numpy(), batch.column("lang").dictionary_encode().indices.to_numpy()
    edges = [0, *(np.flatnonzero((np.diff(r) != 0) | (np.diff(lang) != 0)) + 1).tolist(), len(r)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield (int(r[a]), batch.column("lang")[a].as_py()), batch.slice(a, b - a)


def _united(automata: DataFrame, least: int) -> DataFrame:
    """(AUTOMATA), a row a range and language: all its automata in one, without rare paths; n stays the count of all single words."""
    dealt = automata.repartition(4 * parallelism(automata.sparkSession), "range").sortWithinPartitions("range", "lang")

    def run(batches):
        last, held, n, waiting = None, [], 0, 0

        def done():
            return _record([(*last, n, frequent(united(held), least).stored())])

        for batch in batches:
            for key, part in _runs(batch):
                if held and key != last:
                    yield done()
                    held, n, waiting = [], 0, 0
                last = key
                for blob in part.column("blob"):
                    x = Automaton.loaded(blob.as_py())
                    held.append(x)
                    waiting += x.paths()
                    if waiting > HELD and len(held) > 1:
                        held = [united(held)]
                        waiting = 0
                n += pc.sum(part.column("n")).as_py()
        if held:
            yield done()

    return dealt.mapInArrow(run, AUTOMATA)


PART = "range int, lang string, x binary, y binary, longer bigint, origin int"
_PART = ["range", "lang", "x", "y", "longer", "origin"]


def _parts(counted: DataFrame, ranges: int) -> DataFrame:
    """PART: what each range asks of others: distinct words, and pairs that end its triples with the largest count of these."""

    def run(batches):
        for batch in batches:
            for r, lang, blob in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "blob")), strict=True):
                q = Automaton.loaded(blob)
                hashes = word_hashes(q.symbols.to_pylist())
                size, c, n = q.arcs()
                ones = np.unique(np.concatenate([q.a, q.b, c]))
                key = np.repeat(q.b, size) << 32 | c
                order = np.argsort(key, kind="stable")
                key, at = key[order], _firsts(key[order])
                most = np.maximum.reduceat(n[order], at) if len(at) else n[:0]
                x, y = key[at] >> 32, key[at] & (1 << 32) - 1
                to = np.append(ranges_of(hashes[ones], None, ranges), ranges_of(hashes[x], hashes[y], ranges)).astype(np.int32)
                many = len(to)
                words = lambda ids: q.symbols.take(pa.array(ids)).cast(pa.binary())  # noqa: B023, E731
                second = pa.concat_arrays([pa.nulls(len(ones), pa.binary()), words(y)])
                columns = [pa.array(to), pa.array([lang] * many), words(np.append(ones, x)), second, pa.array(np.append(np.zeros(len(ones), np.int64), most)), pa.array(np.full(many, r, np.int32))]
                yield from pa.table(columns, _PART).to_batches(1 << 14)

    return counted.mapInArrow(run, PART)


def composed(asked: pa.RecordBatch, counts: Automaton) -> np.ndarray:
    """The counts of the asked paths (x, or x and y): the paths that both automata share."""
    x, y = (pc.index_in(asked.column(c).cast(pa.large_binary()), value_set=counts.symbols).fill_null(-1).to_numpy().astype(np.int64) for c in ("x", "y"))
    single = asked.column("y").is_null().to_numpy(zero_copy_only=False)

    def met(keys, weights, wanted):
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return np.where(keys[at] == wanted, weights[at], 0) if len(keys) else np.zeros(len(wanted), np.int64)

    return np.where(single, met(counts.ones, counts.ones_n, x), met(counts.a << 32 | counts.b, counts.twos_n, x << 32 | np.maximum(y, 0)))


REPLY = "range int, lang string, x binary, y binary, f bigint, longer bigint"


def _replies(parts: DataFrame, counted: DataFrame) -> DataFrame:
    """REPLY: counts for the ranges that asked; and for the pairs of a range the longest-lived triple that ends in them (f null)."""
    both = parts.withColumn("blob", F.lit(None).cast("binary")).unionByName(counted.select("range", "lang", "blob"), allowMissingColumns=True)
    dealt = both.repartition(4 * parallelism(parts.sparkSession), "range").sortWithinPartitions("range", "lang", F.col("blob").isNull())

    def run(batches):
        counts, of = None, None
        for batch in batches:
            for key, part in _runs(batch):
                if part.column("blob")[0].is_valid:
                    counts, of = Automaton.loaded(part.column("blob")[0].as_py()), key
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                f = composed(part, counts) if of == key else np.zeros(part.num_rows, np.int64)
                names = ["range", "lang", "x", "y", "f", "longer"]
                own = [part.column(c) for c in ("lang", "x", "y")]
                yield pa.RecordBatch.from_arrays([part.column("origin"), *own, pa.array(f), pa.array(np.zeros(len(f), np.int64))], names)
                pairs = part.filter(part.column("y").is_valid())
                if pairs.num_rows:
                    yield pa.RecordBatch.from_arrays([*(pairs.column(c) for c in ("range", "lang", "x", "y")), pa.nulls(pairs.num_rows, pa.int64()), pairs.column("longer")], names)

    return dealt.mapInArrow(run, REPLY)


SCORED = "range int, lang string, phrase string, a bigint, l bigint, r bigint, score bigint"


def scored(counts: Automaton, f: dict, longer: dict, share: int, top: int) -> list[tuple]:
    """The best (phrase, a, l, r, score) of a range; f holds the counts of parts from elsewhere, longer those of triples that end in a pair."""
    words = counts.symbols.to_pylist()
    size, c, n = counts.arcs()
    begin = (np.cumsum(size) - size).tolist()
    rows = []
    for k, (a, b, pair) in enumerate(zip(counts.a.tolist(), counts.b.tolist(), counts.twos_n.tolist(), strict=True)):
        x, y = words[a], words[b]
        after = range(begin[k], begin[k] + int(size[k]))
        most = longer.get((x, y), 0)
        for j in after:
            z, three = words[c[j]], int(n[j])
            most = max(most, three)
            cuts = [(f[x, None], f[y, z]), (pair, f[z, None])]
            score, cut = min((SCALE * three * three // (left * right), i) for i, (left, right) in enumerate(cuts))
            rows.append((b" ".join((x, y, z)), three, *cuts[cut], score))
        if 100 * most < share * pair:
            left, right = f[x, None], f[y, None]
            rows.append((x + b" " + y, pair, left, right, SCALE * pair * pair // (left * right)))
    rows.sort(key=lambda t: (-t[4], -t[1], t[0]))
    return rows[:top]


def _scored(replies: DataFrame, counted: DataFrame, share: int, top: int) -> DataFrame:
    both = replies.withColumn("blob", F.lit(None).cast("binary")).unionByName(counted.select("range", "lang", "blob"), allowMissingColumns=True)
    dealt = both.repartition(4 * parallelism(replies.sparkSession), "range", "lang").sortWithinPartitions("range", "lang", F.col("blob").isNull())

    def run(batches):
        counts, last, f, longer = None, None, {}, {}

        def done():
            rows = [(last[0], last[1], p.decode(), *rest) for p, *rest in scored(counts, f, longer, share, top)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["range", "lang", "phrase", "a", "l", "r", "score"])

        for batch in batches:
            for key, part in _runs(batch):
                if key != last:
                    if counts is not None:
                        yield done()
                    counts, last, f, longer = None, key, {}, {}
                for blob, x, y, n, most in zip(*(part.column(c).to_pylist() for c in ("blob", "x", "y", "f", "longer")), strict=True):
                    if blob is not None:
                        counts = Automaton.loaded(blob)
                    elif n is not None:
                        f[x, y] = n
                    else:
                        longer[x, y] = max(longer.get((x, y), 0), most)
        if counts is not None:
            yield done()

    return dealt.mapInArrow(run, SCORED)


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, ranges: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the op13 result; see the contract at the head of this module."""
    spark = docs.sparkSession
    for_long_rows(spark)
    ranges = ranges or 4 * parallelism(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = written(_united(_counted(texts, ranges), least), "counted")
    replies = _replies(_parts(counted, ranges), counted)
    found = written(_scored(replies, counted, share, top), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = found.withColumn("_k", F.row_number().over(Window.partitionBy("lang", F.col("range") % PARTS).orderBy(*order))).filter(F.col("_k") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(counted.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
