"""Line hashes, conversation tries and phrase automata against brute force, SQL and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import conversation_trie, line_hash, phrases, queries, sql
from tests.duck import duck_rows, spark_rows

DOC = "doc_id long, text string, lang string"


@pytest.mark.parametrize("name", ["op11_line_hash", "op12_conversation_trie", "op13_phrase_automata"])
def test_queries_match_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == duck_rows(sql.ORACLES[name], sf)


# 11 line hash

def test_perfect_hash_is_minimal_and_strangers_are_told_apart():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(-(2**63), 2**63, (2, 5000))
    index = line_hash.LineIndex.loaded(line_hash.LineIndex.build(h1, h2, np.arange(5000), np.arange(5000) * 7).stored())
    assert sorted(index.numbers(h1.view(np.uint64), h2.view(np.uint64))) == list(range(5000))
    known, owners, counts = index.probe(h1, h2)
    assert known.all() and (owners == np.arange(5000) * 7).all() and (counts == np.arange(5000)).all()
    assert not index.probe(h1, h2 + 1)[0].any()
    empty = line_hash.LineIndex.build(*np.zeros((4, 0), np.int64))
    assert not line_hash.LineIndex.loaded(empty.stored()).probe(h1, h2)[0].any()


def lines_by_hand(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    last = 2**63 - 1
    seen = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(last if d is None else d)
    out = []
    for d, t in rows:
        each = (t or "").split("\n")
        kept = [x for x in each if len(key(x)) < 10 or min(seen[key(x)]) == (last if d is None else d)]
        out.append((d, len(each), len(each) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_parts", [1, 8, 4096])
def test_line_dedup_of_awkward_rows(spark, hot_parts):
    rng = random.Random(3)
    pool = ["A line that many hold", "  a LINE that many hold\t", "nine char", "ten charsx", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "", " ", " padded with nbsp", "padded with nbsp", "x" * 50_000]
    rows = [(k // 2 if k % 9 else None, "\n".join(rng.choice([*pool, f"own line no {rng.randrange(60)}"]) for _ in range(rng.randrange(6)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "A line that many hold"), (503, "A line that many hold"), (None, None), (600, "the only holder twice\nthe only holder twice\r\n")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], DOC).withColumn("kept", F.lit(1)).withColumn("k1", F.lit("x")).withColumn("n_lines", F.lit(None)).repartition(5)
    got = line_hash.without_repeats(docs, shard_keys=4, hot_parts=hot_parts).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr) == lines_by_hand(rows)
    assert line_hash.without_repeats(docs.limit(0)).count() == 0


# 12 conversation trie

def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))  # as in SQL, towards zero
        made[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * words
    return sorted((
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if made[c] == p).encode()).hexdigest())
        for p, m in members.items()), key=repr)


@pytest.mark.parametrize("limit", [1, 3, 4096])
def test_trie_of_awkward_conversations(spark, limit):
    rng = random.Random(5)
    rows = []
    for c in range(150):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["", None, "a b", "hello there you", f"own {rng.randrange(5)}"]) if t else rng.choice(["hi", "hi", "yo you"])))
    rows += [(None, 1, "user", "nobody's"), (-7, 0, "user", "below zero"), (-7, 0, "user", "below zero"), (1000, 0, "u", "a " * 20_000)]
    rows += [(2000 + c, t, "u", "same turn") for c in range(60) for t in range(4)] + [(3000, t, "u", f"long {t}") for t in range(500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("w", F.lit("x")).withColumn("depth", F.lit(1)).repartition(5)
    got = conversation_trie.trie_nodes(table, limit)
    assert sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr) == trie_by_hand(rows)
    assert conversation_trie.trie_nodes(table.limit(0)).count() == 0


def test_double_array_walks_its_sequences_and_no_others():
    rng = random.Random(2)
    sequences = [[rng.randrange(40) for _ in range(rng.randrange(6))] for _ in range(400)]
    size = np.array([len(s) for s in sequences])
    trie = conversation_trie.DoubleArray(size, np.array([x for s in sequences for x in s]))
    known = {tuple(s[:d]) for s in sequences for d in range(len(s) + 1)}
    states = {(): 0}
    for p in sorted(known, key=len):
        for x in range(41):
            to = int(trie.walk(np.array([states[p]]), np.array([x]))[0])
            assert (to >= 0) == ((*p, x) in known)
            if to >= 0:
                states[*p, x] = to
    assert len(set(states.values())) == len(known)


# 13 phrase automata

def pieces_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def phrases_by_hand(rows, least, top):
    f, n = defaultdict(int), defaultdict(int)
    for lang, text in rows:
        for p in pieces_of(text):
            n[lang or "und"] += len(p)
            for k in (1, 2, 3):
                for i in range(len(p) - k + 1):
                    f[lang or "und", tuple(p[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    found = defaultdict(list)
    for (lang, p), a in cand.items():
        if len(p) == 2 and any(len(q) == 3 and lang == other and p in (q[:2], q[1:]) and 100 * b >= 50 * a for (other, q), b in cand.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, each in found.items() for i, (score, a, p, left, right) in enumerate(sorted(each)[:top]))


@pytest.mark.parametrize("top", [7, 2000])
def test_phrases_of_awkward_texts(spark, top):
    rng = random.Random(7)
    words = ["a", "A", "b", "the", "The", "é", "É", "日本", "x\u00a0y", "\x00", "w" * 300, "ÿ"]
    draw = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "?!"]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "fr", None, "und"]), draw(rng.randrange(60))) for _ in range(60)] + [("en", None), (None, ""), ("de", " . "), ("en", "big deal here " * 4000), ("en", "big deal here " * 4000)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("x")).withColumn("range", F.lit(0)).repartition(5)
    got = phrases.collocations(docs, least=3, top=top, ranges=6)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == phrases_by_hand(rows, 3, top)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_parts_of_a_long_text_count_once(monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice("abcdefg") + rng.choice(["", "", "."]) for _ in range(5000))
    want = defaultdict(int)
    for p in pieces_of(text):
        for k in (1, 2, 3):
            for i in range(len(p) - k + 1):
                want[tuple(p[i : i + k])] += 1
    monkeypatch.setattr(phrases, "BYTES", 64)
    tally, parts = phrases.Tally(), []
    for k, words in enumerate(phrases._split(text.encode())):
        tally.add(words)
        if k % 3 == 0:
            parts += [phrases.Automaton.loaded(x.stored()) for _, x in tally.taken(4)]
    parts += [x for _, x in tally.taken(4)]
    whole = phrases.united(parts)
    names = [w.decode() for w in whole.symbols.to_pylist()]
    size, c, n = whole.arcs()
    got = {(names[s],): k for s, k in zip(whole.ones, whole.ones_n)} | {(names[a], names[b]): k for a, b, k in zip(whole.a, whole.b, whole.twos_n)}
    pair = np.repeat(np.arange(len(size)), size)
    got |= {(names[whole.a[i]], names[whole.b[i]], names[s]): k for i, s, k in zip(pair, c, n)}
    assert got == dict(want)
    kept = phrases.frequent(whole, 40)
    assert kept.twos_n.min() >= 40 and kept.paths() == sum(k >= 40 for k in want.values())


def test_equal_states_are_one():
    import pyarrow as pa

    i = lambda *x: np.array(x, np.int64)
    symbols = pa.array([b"a", b"b", b"c"], pa.large_binary())
    x = phrases.Automaton.built(symbols, i(0, 1, 2), i(9, 9, 9), i(0, 0, 1, 1, 2), i(0, 1, 0, 1, 0), i(5, 5, 5, 5, 5), i(1, 2, 1, 2, 0), i(2, 0, 1, 2, 0, 1), i(4, 1, 2, 4, 1, 2))
    assert x.state[0] == x.state[2] != 0 and x.state[1] == x.state[3] and x.state[4] == 0 and len(x.c) == 3
    assert phrases.united([x, x]).twos_n.tolist() == [10] * 5
