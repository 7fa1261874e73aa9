"""Prefix trie of conversations, from double-array tries of prefix shards.

A conversation is rebuilt as the first h turns of conversation c - c % 20 and its own turns after its first h, h = crc32(decimal c) % 4. Every distinct
sequence of first turns is a node, the root included.

1. Turns are hashed (128 bits of role and text) and ordered in their conversation; from here on no text moves. A conversation is a row of its turns'
   hashes and word counts; its path is named by prefix sums of these, again 128 bits. Equal conversations count as one sequence.
2. A prefix through which more than `SHARD_SEQUENCES` distinct sequences pass is an upper node. A sequence goes to the shard of its first prefix that isn't, so that a shard
   holds all sequences of its prefixes, and a hot first turn is split by what follows it.
3. In a shard turns get dense ids, and the sequences are packed into BASE and CHECK arrays: the child of state s by turn t is the
   state BASE[s] + t, if its CHECK is s. All sequences walk the arrays, level by level; nodes get their members, and sums go up from the leaves.
4. Nodes under a shard's prefixes are whole there. Upper nodes stand in several shards: their members, leaves and tokens are added over
   shards, and what was added once a shard (a text counts one time less than it has members) is set right from the table of upper nodes.

Ids of the conversations that end at a node are sorted in their partition and hashed as they stream by: a SHA-256 is one sequence of bytes, so a node where
many end is one task's work, in fixed memory. A conversation is held as one row, 24 bytes a turn, and a shard's sequences in a task.

Defined cases: null turns come first, and equal turn numbers are ordered by role and text; null role or text is empty; rows without a conv_id belong to no conversation
and are left out; rows that repeat are turns of their own; an empty table has no node, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import for_long_rows, parallelism, words, written

SHARD_SEQUENCES = 4096
#: A conversation inherits from the first of its block of so many ids.
BLOCK, INHERITED = 20, 4
#: Free states that are tried for a node with several children before it goes behind all others.
TRIES = 64
STEPS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array<struct<t1,t2,w>>) of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    clean = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("_r"), text.alias("_x"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_r", "_x")
    turn = F.struct(F.row_number().over(order).alias("n"), F.xxhash64("_r", "_x").alias("t1"), F.xxhash64("_x", F.lit(1), "_r").alias("t2"), F.size(words(F.col("_x"))).alias("w"))
    own = clean.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    slim = written(own.select("conv_id", F.transform("t", lambda x: F.struct(x.t1.alias("t1"), x.t2.alias("t2"), x.w.alias("w"))).alias("turns")), "turns")
    heads = slim.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, INHERITED - 1).alias("_head"))
    met = slim.withColumn("_base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "_base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % INHERITED).cast("int")
    return met.select("conv_id", F.concat(F.slice(F.coalesce("_head", F.slice("turns", F.lit(1), F.lit(0))), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _finished(x: np.ndarray, depth: np.ndarray) -> np.ndarray:
    x = x + depth.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)).view(np.int64)


def path_names(size: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of the given sizes, one behind the other: where each one's names begin, and the two halves of the names of its prefixes, from
    the empty one (0, 0) to the whole."""
    first = np.cumsum(size + 1) - size - 1
    place = np.arange(int(size.sum() + len(size))) - np.repeat(first, size + 1)
    powers = [np.ones(int(size.max(initial=0)) + 1, np.uint64) for _ in STEPS]
    out = []
    for t, step, power in zip((t1, t2), STEPS, powers, strict=True):
        power[1:] = np.cumprod(np.full(len(power) - 1, step, np.uint64))
        value = np.zeros(len(place), np.uint64)
        value[place > 0] = t.view(np.uint64)
        sums = np.cumsum(value * power[place])
        name = _finished(sums - np.repeat(sums[first] if len(first) else sums, size + 1), place)
        name[place == 0] = 0
        out.append(name)
    return first, out[0], out[1]


def _flat(lists: pa.ListArray, dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    return size, lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)


def _named(conversations: DataFrame) -> DataFrame:
    """(conv_id, q1, q2, t1, t2, w): conversations with the name of their whole path and their turns as arrays."""

    def run(batches):
        for batch in batches:
            turns = batch.column("turns")
            size = np.diff(turns.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
            t1, t2, w = turns.flatten().flatten()
            first, p1, p2 = path_names(size, t1.to_numpy(), t2.to_numpy())
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (t1, t2, w)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(p1[first + size]), pa.array(p2[first + size]), *lists], ["conv_id", "q1", "q2", "t1", "t2", "w"])

    return conversations.mapInArrow(run, "conv_id bigint, q1 bigint, q2 bigint, t1 array<bigint>, t2 array<bigint>, w array<int>")


def _prefixes(sequences: DataFrame) -> DataFrame:
    """(q1, q2, p1, p2): every sequence with each of its prefixes but the empty one."""

    def run(batches):
        for batch in batches:
            size, t1 = _flat(batch.column("t1"))
            first, p1, p2 = path_names(size, t1, _flat(batch.column("t2"))[1])
            inner = np.ones(len(p1), bool)
            inner[first] = False
            own = [pa.array(np.repeat(batch.column(c).to_numpy(), size)) for c in ("q1", "q2")]
            yield from pa.table([*own, pa.array(p1[inner]), pa.array(p2[inner])], ["q1", "q2", "p1", "p2"]).to_batches(1 << 16)

    return sequences.select("q1", "q2", "t1", "t2").mapInArrow(run, "q1 bigint, q2 bigint, p1 bigint, p2 bigint")


def _sharded(sequences: DataFrame, shards: int) -> DataFrame:
    """Sequences with shard: by the first prefix that isn't an upper node (`upper` of its prefixes are), or the whole."""

    def run(batches):
        for batch in batches:
            size, t1 = _flat(batch.column("t1"))
            first, p1, _ = path_names(size, t1, _flat(batch.column("t2"))[1])
            split = np.minimum(batch.column("upper").to_numpy() + 1, size)
            shard = (p1[first + split] % shards).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sequences.schema)
    return sequences.mapInArrow(run, f"{kind}, shard int")


class DoubleArray:
    """BASE and CHECK over dense turn ids (from 0); state 0 is the root, states without a parent have CHECK -1."""

    def __init__(self, size: np.ndarray, codes: np.ndarray):
        """Sequences of the given sizes, one behind the other."""
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.used, self.low = 1, 1  # states behind the last taken one are free; below `low` none is
        first, state = np.cumsum(size) - size, np.zeros(len(size), np.int64)
        kinds = int(codes.max(initial=0)) + 1
        for depth in range(int(size.max(initial=0))):
            going = np.flatnonzero(size > depth)
            pairs, at = np.unique(state[going] * kinds + codes[first[going] + depth], return_inverse=True)
            state[going] = self._placed(pairs // kinds, pairs % kinds)[at]

    def _room(self, end: int) -> None:
        if end > len(self.check):
            more = max(end, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def _free(self, n: int) -> np.ndarray:
        """The first n free states."""
        inner = self.low + np.flatnonzero(self.check[self.low : self.used] < 0)[:n]
        return np.append(inner, np.arange(self.used, self.used + n - len(inner)))

    def _take(self, states: np.ndarray, parents: np.ndarray) -> None:
        self._room(int(states.max()) + 1)
        self.check[states] = parents
        self.used = max(self.used, int(states.max()) + 1)

    def _placed(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """States for the children of this level, ordered by parent and code."""
        out = np.empty(len(parents), np.int64)
        start = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        end = np.append(start[1:], len(parents))
        many = np.flatnonzero(end - start > 1)
        for k in many[np.argsort(start[many] - end[many], kind="stable")]:  # the widest first
            a, b = start[k], end[k]
            steps = codes[a:b] - codes[a]
            spots = self._free(TRIES)
            self._room(int(spots[-1] + steps[-1]) + 1)
            fits = (self.check[spots[:, None] + steps] < 0).all(1)
            spot = int(spots[fits.argmax()]) if fits.any() else self.used
            out[a:b] = spot + steps
            self._take(out[a:b], np.full(b - a, parents[a]))
            self.base[parents[a]] = spot - codes[a]
        alone = start[end - start == 1]
        if len(alone):
            out[alone] = self._free(len(alone))
            self._take(out[alone], parents[alone])
            self.base[parents[alone]] = out[alone] - codes[alone]
        taken = self.check[self.low : self.used] >= 0
        self.low += int(taken.argmin()) if not taken.all() else len(taken)
        return out

    def walk(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states one turn on; -1 where the trie has none."""
        to = self.base[state] + codes
        inside = (to >= 0) & (to < self.used)
        to[~inside] = 0
        return np.where(inside & (self.check[to] == state) & (to > 0), to, -1)


NODE = (
    "p1 bigint, p2 bigint, depth bigint, a1 bigint, a2 bigint, lo bigint, n bigint, children bigint, leaves bigint, saved bigint, w bigint, upper boolean, parent_lo bigint,"
    "above array<struct<p1:bigint,p2:bigint>>"
)
_ABOVE = pa.list_(pa.struct([("p1", pa.int64()), ("p2", pa.int64())]))


def shard_nodes(rows: pa.Table) -> pa.Table:
    """The nodes (NODE) of one shard's sequences (t1, t2, w, n, lo, upper).

    Nodes that aren't upper ones are whole. Of the others: children, leaves and tokens below them that this shard holds whole, and n * w of the upper nodes at and
    below them; `above` names all their ancestors.
    """
    rows = rows.combine_chunks()
    column = lambda c: rows.column(c).chunk(0)
    size, t1 = _flat(column("t1"))
    t2, w = _flat(column("t2"))[1], _flat(column("w"))[1]
    weight, least, uppers = (column(c).to_numpy() for c in ("n", "lo", "upper"))
    begin, p1, p2 = path_names(size, t1, t2)
    order = np.lexsort((t2, t1))
    new = np.append(False, (np.diff(t1[order]) != 0) | (np.diff(t2[order]) != 0))[: len(order)]
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(new)
    trie = DoubleArray(size, codes)

    many = trie.used
    n, lo = np.zeros(many, np.int64), np.full(many, np.iinfo(np.int64).max, np.int64)
    depth, rep, tail = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many, np.int64)
    state, first = np.zeros(len(size), np.int64), np.cumsum(size) - size
    n[0], lo[0] = weight.sum(), least.min()
    levels = [np.zeros(1, np.int64)]
    for d in range(int(size.max(initial=0))):
        going = np.flatnonzero(size > d)
        state[going] = to = trie.walk(state[going], codes[first[going] + d])
        np.add.at(n, to, weight[going])
        np.minimum.at(lo, to, least[going])
        depth[to], rep[to], tail[to] = d + 1, going, w[first[going] + d]
        levels.append(np.unique(to))
    upper = depth <= uppers[rep]
    parent = trie.check[:many]
    children, leaves = np.zeros(many, np.int64), np.zeros(many, np.int64)
    saved = np.where(upper, n, n - 1) * tail
    inner = np.zeros(many, bool)
    for level in reversed(levels):
        leaves[level] += ~inner[level] & ~upper[level]
        if level[0]:
            above = parent[level]
            inner[above] = True
            np.add.at(children, above, (~upper[level]).astype(np.int64))
            np.add.at(leaves, above, leaves[level])
            np.add.at(saved, above, saved[level])
    at = np.concatenate(levels)
    own, up = begin[rep[at]] + depth[at], begin[rep[at]] + np.maximum(depth[at] - 1, 0)
    listed = [[{"p1": int(p1[k]), "p2": int(p2[k])} for k in range(begin[rep[s]], begin[rep[s]] + depth[s])] if upper[s] else None for s in at.tolist()]
    columns = [p1[own], p2[own], depth[at], p1[up], p2[up], lo[at], n[at], children[at], leaves[at], saved[at], tail[at], upper[at]]
    known = pa.array(lo[parent[at]], mask=upper[parent[at]])
    return pa.table([*map(pa.array, columns), known, pa.array(listed, _ABOVE)], ["p1", "p2", "depth", "a1", "a2", "lo", "n", "children", "leaves", "saved", "w", "upper", "parent_lo", "above"])


def _nodes(sharded: DataFrame) -> DataFrame:
    dealt = sharded.repartition(4 * parallelism(sharded.sparkSession), "shard").sortWithinPartitions("shard")

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and shard[a] != last:
                    yield from shard_nodes(pa.Table.from_batches(held)).to_batches(1 << 14)
                    held.clear()
                last = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from shard_nodes(pa.Table.from_batches(held)).to_batches(1 << 14)

    return dealt.mapInArrow(run, NODE)


def _ends(named: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256): the conversations that end at a node, ascending, hashed as they stream by."""
    dealt = named.select("q1", "q2", "conv_id").repartition(4 * parallelism(named.sparkSession), "q1", "q2").sortWithinPartitions("q1", "q2", "conv_id")

    def run(batches):
        last, sha = None, None
        for batch in batches:
            q1, q2 = batch.column("q1").to_numpy(), batch.column("q2").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(q1) != 0) | (np.diff(q2) != 0)) + 1).tolist(), len(q1)]
            done = []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = ",".join(map(str, batch.column("conv_id")[a:b].to_pylist()))
                if (q1[a], q2[a]) == last:
                    sha.update(f",{part}".encode())
                    continue
                if last is not None:
                    done.append((*map(int, last), sha.hexdigest()))
                last, sha = (q1[a], q2[a]), hashlib.sha256(part.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["p1", "p2", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(last[0])]), pa.array([int(last[1])]), pa.array([sha.hexdigest()])], ["p1", "p2", "ends_sha256"])

    return dealt.mapInArrow(run, "p1 bigint, p2 bigint, ends_sha256 string")


def trie_nodes(conversations: DataFrame, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """The op12 result: a row a node; see the contract at the head of this module."""
    spark = conversations.sparkSession
    for_long_rows(spark)
    named = written(_named(rebuilt(conversations)), "rebuilt")
    each = named.groupBy("q1", "q2").agg(F.count("*").alias("n"), F.min("conv_id").alias("lo"), *[F.first(c).alias(c) for c in ("t1", "t2", "w")])
    sequences = written(each, "sequences")
    prefixes = _prefixes(sequences)
    hot = written(prefixes.groupBy("p1", "p2").agg(F.count("*").alias("c")).filter(F.col("c") > shard_sequences).drop("c"), "upper")
    split = prefixes.join(hot, ["p1", "p2"]).groupBy("q1", "q2").agg(F.count("*").alias("upper"))
    shards = max(parallelism(spark), -(-sequences.count() // shard_sequences))
    ready = sequences.join(split, ["q1", "q2"], "left").withColumn("upper", F.coalesce("upper", F.lit(0)).cast("long")).select("t1", "t2", "w", "n", "lo", "upper")
    nodes = written(_nodes(_sharded(ready, shards)), "nodes")

    first = lambda c: F.first(c).alias(c)
    add = lambda c: F.sum(c).alias(c)
    merged = nodes.filter("upper").groupBy("p1", "p2").agg(*map(first, ("depth", "a1", "a2", "w", "above")), F.min("lo").alias("lo"), *map(add, ("n", "children", "leaves", "saved")))
    tops = written(merged, "tops")
    # each upper node's words were counted once a member: once too often, at itself and all its ancestors; and it is a child of the last of these
    chain = tops.select(F.inline(F.concat("above", F.array(F.struct("p1", "p2")))), F.col("w").alias("less"))
    below = tops.filter("depth > 0").groupBy(F.col("a1").alias("p1"), F.col("a2").alias("p2")).agg(F.count("*").alias("more"))
    whole = tops.join(chain.groupBy("p1", "p2").agg(F.sum("less").alias("less")), ["p1", "p2"]).join(below, ["p1", "p2"], "left")
    whole = whole.withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).withColumn("saved", F.col("saved") - F.col("less")).withColumn("leaves", F.greatest("leaves", F.lit(1)))
    columns = ["p1", "p2", "depth", "lo", "parent_lo", "n", "children", "leaves", "saved"]
    known = nodes.filter("NOT upper AND parent_lo IS NOT NULL").select(columns)
    under = nodes.filter("NOT upper AND parent_lo IS NULL").drop("parent_lo").unionByName(whole.filter("depth > 0"), allowMissingColumns=True)
    met = under.join(tops.select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("lo").alias("parent_lo")), ["a1", "a2"]).select(columns)
    root = whole.filter("depth = 0").withColumn("parent_lo", F.lit(None).cast("long")).select(columns)
    every = known.unionByName(met).unionByName(root).join(_ends(named), ["p1", "p2"], "left")
    return every.select(
        F.col("lo").alias("conv_id"), "depth", F.col("parent_lo").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
