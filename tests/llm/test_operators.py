"""The operators of the llm subpackage against brute force, round trips and awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import bpe_trie, bwt_dedup, html_lstm, langid, mixing, mpegts, pii, simhash_dedup, simhash_search, warc
from foliospark.llm import queries, sql
from foliospark.plans import components
from tests.duck import duck_rows, spark_rows

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t", "a", "A b", "é" * 50, "x" * 30_000, "word " * 6000, "١٢٣ 日本語", "<|endoftext|> tail"]


def documents(spark, texts, extra=False):
    rows = [(k, t, ["en", "fr", None][k % 3], f"src{k % 4}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumn("fp", F.lit("clash")).withColumn("ids", F.lit(1)).withColumn("score", F.lit("s")) if extra else df


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


# 1 language ID

def enumerate_sum(word, weights, unknown):
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        p = weights.get(word[:n], unknown if n == 1 else 0)
        total += p * enumerate_sum(word[n:], weights, unknown) if p else 0
    return total


def test_forward_sums_all_segmentations():
    pieces = ("a", "b", "ab", "ba", "aba", langid.MARK, langid.MARK + "a", "c")
    p = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.05], [0.05, 0.3], [0.1, 0.1], [0.05, 0.05], [0.1, 0.1], [0.1, 0.1], [langid.UNKNOWN] * 2])
    words = ["a", "abab", "abcab", "zab", "bbbb"]
    got = np.exp(langid.log_scores(pieces, p, words))
    for k in range(2):
        want = [enumerate_sum(langid.MARK + w, dict(zip(pieces, p[:, k])), langid.UNKNOWN) for w in words]
        assert np.allclose(got[:, k], want, rtol=1e-9)
    long = "ab" * 100
    assert np.isfinite(langid.log_scores(pieces, p, [long])).all()
    assert np.allclose(langid._long_score(pieces, p, langid.MARK + "abab"), langid.log_scores(pieces, p, ["abab"])[0])


def test_language_accuracy_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, sample=60)
    asked = langid.predict(docs.withColumn("held", langid.fold() == 0), model).filter("held AND lang IS NOT NULL")
    rows = asked.select("lang", "lang_pred", "score").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = langid.predict(documents(spark, ODD, extra=True), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in odd] == [not re.search(r"[^\W\d_]", t or "") for t in ODD]
    assert langid.predict(documents(spark, ODD[:1]).limit(0), model).count() == 0
    assert langid.fit(docs.limit(0))["languages"] == []


# 2 BPE

def test_bpe_equals_library(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_trie.default_path())
    rng = random.Random(2)
    more = ["".join(rng.choice("ab \n\té1?!'ſ日<|endoftext|>") for _ in range(60)) for _ in range(200)]
    all_texts = [*texts[:60], *ODD, *more]
    got = {r.doc_id: r for r in bpe_trie.round_trip(documents(spark, all_texts, extra=True).select("doc_id", "text"), keep_ids=True).collect()}
    for k, t in enumerate(all_texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].n_tokens == len(ids)
        assert got[k].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    kept = bpe_trie.decode(bpe_trie.encode(documents(spark, ["a b", None], extra=True)))
    assert [r.decoded for r in kept.orderBy("doc_id").collect()] == ["a b", ""] and "fp" in kept.columns
    assert bpe_trie.round_trip(documents(spark, ["x"]).limit(0)).count() == 0


# 3 transport streams

@pytest.mark.parametrize("size", [0, 1, 576, 577, 9216, 9217, 9216 * 8, 9216 * 17 + 300])
def test_stream_round_trip(size):
    payload = mpegts.pad_payload("x" * size)
    media = mpegts.write_stream(payload)
    read = mpegts.read_stream(media)
    assert len(media) % 188 == 0 and read["payload"] == payload
    assert read["continuity_errors"] == read["table_errors"] == read["sync_errors"] == 0
    assert [u["pts"] for u in read["units"]] == [mpegts.TICKS * (k + 1) for k in range(len(read["units"]))]
    assert [u["random_access"] for u in read["units"]] == [k % mpegts.GROUP == 0 for k in range(len(read["units"]))]


def test_stream_damage():
    packets = [mpegts.write_stream(mpegts.pad_payload("y" * 30_000))[k : k + 188] for k in range(0, 10**6, 188)]
    packets = [p for p in packets if p]
    lost = mpegts.read_stream(b"".join(packets[:20] + packets[21:]))
    assert lost["continuity_errors"] == 1 and [u["damaged"] for u in lost["units"]][0]
    twice = mpegts.read_stream(b"".join(packets[:21] + packets[20:]))
    assert twice["duplicates"] == 1 and twice["payload"] == mpegts.pad_payload("y" * 30_000)
    assert mpegts.read_stream(None)["payload"] == b"" == mpegts.read_stream(b"junk" * 100)["payload"]


def test_stream_query(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op3_mpeg_transport_streams(spark, sf).collect()}
    for k, t in enumerate(texts):
        p = mpegts.pad_payload(t)
        assert (got[k].n_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(t.encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


# 4 fingerprints

def test_edited_likeness(spark):
    base = ["one two three four five six seven eight nine ten " * 3, None, "", "short", "one two three four five six seven eight nine ten " * 3, "é" * 10]
    got = {r.doc_id: r for r in simhash_search.edited_likeness(documents(spark, base, extra=True)).collect()}
    order = sorted(got, reverse=True)
    for k, i in enumerate(order):
        t, nxt = base[i] or "", base[order[(k + 1) % len(order)]] or ""
        n = len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0].fingerprint == got[4].fingerprint and got[1].fingerprint == got[2].fingerprint == "0" * 16
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert simhash_search.edited_likeness(documents(spark, ["x"]).limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    terms = [f"{a} {b}" for a, b in zip(words, words[1:])] or words
    total, votes = 0, np.zeros(64, np.int64)
    for term in terms:
        h, w = xxhash.xxh64_intdigest(term.encode(), seed=42), min(len(term), simhash_search.MAX_WEIGHT)
        total += w
        votes += w * (h >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.int64)
    return sum(1 << j for j in range(64) if 2 * votes[j] > total)


def test_fingerprints_and_likeness_equal_brute_force(spark, texts):
    rng = random.Random(13)
    cases = [*texts[:60], *ODD[:9], *[texts[k] for k in range(20)], *[" ".join([*texts[k].split()[:-1], "tail"]) for k in range(40) if len(texts[k].split()) > 30]]
    rng.shuffle(cases)
    got = {r.doc_id: r for r in simhash_search.edited_likeness(documents(spark, cases, extra=True)).collect()}
    own = [brute_fingerprint(t or "") for t in cases]
    like = lambda a, b: 1 - (a ^ b).bit_count() / 64
    for k, t in enumerate(cases):
        t, after = t or "", cases[k - 1] or ""  # falling ids, the first follows the last
        edited = brute_fingerprint(t[: len(t) - len(t) // 3] + after[: len(t) // 3])
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (f"{own[k]:016x}", f"{edited:016x}")
        assert (got[k].near_edited, got[k].near_next) == (like(own[k], edited), like(own[k], own[k - 1]))
        want = sum((own[k] ^ x).bit_count() <= 3 for x in own) - 1 if k % 20 == 0 else None
        assert got[k].n_near == want


def test_weighted_votes_by_hand(spark):
    text = "aa bb cc aa bb verylongword another"
    words = text.split()
    total, votes = 0, [0] * 64
    for a, b in zip(words, words[1:]):
        h, w = xxhash.xxh64_intdigest(f"{a} {b}".encode(), seed=42), min(len(a) + len(b) + 1, simhash_search.MAX_WEIGHT)
        total += w
        for j in range(64):
            votes[j] += w * (h >> j & 1)
    want = sum(1 << j for j in range(64) if 2 * votes[j] > total)
    got = simhash_search.fingerprints(documents(spark, [text]), ["doc_id"]).first().fp
    assert got % (1 << 64) == want


def test_search_finds_all_neighbours(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(6):
            x = s
            for j in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << j
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {(signed(a), signed(b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    assert {tuple(r) for r in simhash_search.neighbours(df, df).collect()} == want
    linked = {tuple(r) for r in simhash_dedup.links(df).collect()}
    assert linked <= want
    parts = lambda pairs: {r.node: r.component for r in components.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert parts(linked) == parts(want)


# 5 WARC

def test_warc_links_and_digests(spark):
    rows = [(1, "http://x/a?b", "<html><head><title>T &amp; t</title></head><body><p>One <b>two</b></p><script>x</script><p>three</p></body></html>"), (2, None, None), (3, "u\r\nv", "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.derive(warc.write_responses(pages)).collect()
    assert len(made) == 6
    for r in made:
        fields, block = warc.read_record(bytes(r.record))
        assert fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Target-URI"] == r.target_uri
        assert block == bytes(r.block) and warc.digest(block) == r.block_digest == fields["WARC-Block-Digest"] and r.valid
        assert r.source_headers["Content-Type"][0].startswith("text/html")
    text = {r.page_id: bytes(r.block).decode() for r in made if r.record_type == "conversion"}
    assert text == {1: "One two\nthree", 2: "", 3: "plain"}
    about = {r.page_id: bytes(r.block).decode() for r in made if r.record_type == "metadata"}
    assert "title: T & t\r\n" in about[1] and "source-status: HTTP/1.1 200 OK" in about[1]
    assert len({r.refers_to for r in made}) == 3 and warc.derivatives(None) == []
    assert not warc.derivatives(warc.response("u", "body").replace(b"body", b"bodX"))[0]["valid"]
    assert warc.summary(pages.limit(0)).count() == 0


# 6 personal data

def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda s: re.sub(r"\D", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), j, m.end(), k) for j, (k, r, ok) in enumerate(kinds) for m in re.finditer(r, t) if ok(m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_base_spans_equal_expressions(spark, texts):
    rng = random.Random(6)
    made = ["".join(rng.choice("a.@1 9-+(5)4é_%0") for _ in range(80)) for _ in range(400)]
    made += ["a@b.co_x@d.e", "1.2.3.4.5.6.7.8 0001.2.3.004", "4111 1111-1111 1111", "+1 (279) 555-0216x +1", "9" * 20_000, "a" * 20_000 + "@b.c"]
    cases = [*texts, *made, *ODD]
    got = {r.doc_id: r for r in pii.digest(documents(spark, cases, extra=True)).collect()}
    for k, t in enumerate(cases):
        want = base_spans(t or "")
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [s for s in got[k].spans.split(",") if s and not s.startswith("id:")] == want
    assert pii.digest(documents(spark, ["x"]).limit(0)).count() == 0


def test_patterns_discover_unseen_identifiers_and_redaction(spark):
    numbers = [f"41111111{k:07d}" for k in range(10)]
    cards = [n + next(c for c in "0123456789" if luhn(n + c)) for n in numbers]
    seen = [f"pay with card no: {c} today" for c in cards] * 2
    unseen = "pay with card no: 4111111111111112 today"  # the check digit is wrong: only the context tells
    clean = "the year 201920202021 was long"
    docs = documents(spark, [*seen, unseen, clean, "call +1 (279) 555-0216 or me@x.org", None])
    spans = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    at = len(seen)
    assert spans[at] == f"id:{unseen.index('4')}:{unseen.index(' today')}" and spans[at + 1] == ""
    text = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert text[at] == "pay with card no: [ID] today" and text[at + 1] == clean
    assert text[at + 2] == "call [PHONE] or [EMAIL]" and text[at + 3] is None


def test_patterns_discover_shapes_of_no_base_kind(spark):
    seen = [f"please write to {name}@x.org at once" for name in ("ann", "bob", "cleo", "dora", "ed", "fay", "gus", "hal")]
    staff = "please write to staff-QX.77-K4 at once"
    other = "the order ZK-2047-19 was late, version 2.10.33b came after 1999-12"
    rows = {r.doc_id: r for r in pii.digest(documents(spark, [*seen, staff, other])).collect()}
    found = rows[len(seen)].spans
    assert found == f"id:{staff.index('staff')}:{staff.index(' at once')}"
    assert rows[len(seen) + 1].spans == "" and all(rows[k].spans.startswith("email:") and "id:" not in rows[k].spans for k in range(len(seen)))


# 7 repeated passages

def test_repeats_equal_brute_force(spark, texts):
    rng = random.Random(7)
    parts = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(300, 1500))) for _ in range(8)]
    made = []
    for _ in range(25):
        t = list(rng.choice(parts) + rng.choice(parts))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "Z"
        made.append("".join(t))
    cases = [*texts[:80], *made, "a" * 3000, "ab" * 700, "abc" * 135, "q" * 399, None, "", made[0], "é" * 450]
    raw = [(t or "").encode() for t in cases]
    got = {r.doc_id: r for r in bwt_dedup.digest(documents(spark, cases, extra=True)).collect()}
    for k, (kept, removed, runs) in enumerate(bwt_dedup.brute_force(raw)):
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(raw[k]), removed, runs, hashlib.sha256(kept).hexdigest()), k
    assert bwt_dedup.digest(documents(spark, ["x"]).limit(0)).count() == 0


def test_hot_names_are_dealt_without_loss(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "HOT", 2)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(700)
    cases = [word(300) + shared + word(300) for _ in range(12)] + [word(900)]
    got = {r.doc_id: r for r in bwt_dedup.digest(documents(spark, cases)).collect()}
    for k, (kept, removed, runs) in enumerate(bwt_dedup.brute_force([t.encode() for t in cases])):
        assert (got[k].n_removed, got[k].n_spans) == (removed, runs) and got[k].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_passage_in_thousands_of_contexts_and_long_period(spark):
    rng = random.Random(10)
    word = lambda n: bytes(rng.choices(b"abcdefgh ", k=n)).decode()
    shared = word(420)
    cases = [word(400) + shared + word(400) for _ in range(6500)] + [word(97) * 31_000]
    got = {r.doc_id: r for r in bwt_dedup.digest(documents(spark, cases)).collect()}
    period = cases.pop().encode()
    for k, (kept, removed, runs) in enumerate(bwt_dedup.brute_force([t.encode() for t in cases])):
        assert (got[k].n_removed, got[k].n_spans) == (removed, runs) and got[k].kept_sha256 == hashlib.sha256(kept).hexdigest(), k
    assert (got[6500].n_removed, got[6500].n_spans) == (len(period), 1)


def test_no_index_beyond_its_positions(monkeypatch):
    rng = random.Random(11)
    word = lambda n: bytes(rng.choices(b"abcdefgh ", k=n))
    shared = word(450)
    pieces = [word(200) + shared + word(200) for _ in range(40)] + [b"xyz" * 300, word(900)]
    many = [False] * 41 + [True]
    want = bwt_dedup.repeated_windows(pieces, many)
    monkeypatch.setattr(bwt_dedup, "PLACE_BITS", 15)
    assert bwt_dedup.repeated_windows(pieces, many) == want
    with pytest.raises(ValueError):
        bwt_dedup.RunIndex(pieces)


def test_run_index_statistics_by_hand():
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 40))) for _ in range(12)] + [b"abab" * 6]
    index = bwt_dedup.RunIndex(pieces)
    got, text = index.statistics(), index.text
    joined = [int(x) for x in text]

    def common(i, j):
        n = 0
        while i + n < len(joined) and j + n < len(joined) and joined[i + n] == joined[j + n] != 0:
            n += 1
        return n

    want = [max(common(i, j) for j in range(len(joined)) if j != i) if joined[i] else 0 for i in range(len(joined))]
    assert [int(x) if joined[k] else 0 for k, x in enumerate(got)] == want and index.runs < len(joined)


# 8 mixing

def test_mixing_matches_sql(spark, sf):
    assert spark_rows(queries.op8_hierarchical_mixing(spark, sf)) == duck_rows(sql.ORACLES["op8_hierarchical_mixing"], sf)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("reference", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, F.lit(500), {"domain": {}, "lang": {}, "source": {}}, 1).collect()}
    assert got == {"a": 10, "b": 240, "c": 250}
    short = leaves.withColumn("tokens", F.when(F.col("domain") == "web", F.lit(10)).otherwise(F.col("tokens")).cast("long"))
    got = {r.source: r.budget for r in mixing.leaf_budgets(short, F.lit(500), {"domain": {}, "lang": {}, "source": {}}, 1).collect()}
    assert got == {"a": 10, "b": 10, "c": 480}


def test_mixed_rows_follow_copies(spark, sf):
    docs = documents(spark, ["w " * (3 + k % 7) for k in range(60)] + [None, ""])
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs, F.expr("tokens * 2"), max_epochs=3).collect()}
    out = mixing.mixed(docs, F.expr("tokens * 2"), max_epochs=3)
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert out.columns == docs.columns and got == {k: n for k, n in plan.items() if n}
    assert mixing.digest(docs.limit(0)).count() == 0


# 9 near copies

def brute_components(texts):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        fps.append(sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)))
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            low = min(label[b] for b in range(len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 3)
            changed |= low != label[a]
            label[a] = low
    return fps, label


def test_near_components_equal_brute_force(spark, texts):
    cases = [*texts[:120], *ODD, texts[0] + " x", texts[5].upper()]
    fps, label = brute_components(cases)
    got = {r.doc_id: r for r in simhash_dedup.near_components(documents(spark, cases, extra=True)).collect()}
    assert [got[k].fingerprint for k in range(len(cases))] == ["%016x" % x for x in fps]
    assert [got[k].component_id for k in range(len(cases))] == label
    assert simhash_dedup.near_components(documents(spark, ["x"]).limit(0)).count() == 0


def test_links_of_a_dense_group_grow_with_its_members(spark):
    rng = random.Random(12)
    near = [0] + [sum(1 << j for j in rng.sample(range(64), rng.randrange(1, 3))) for _ in range(900)]
    far = [sum(1 << j for j in rng.sample(range(64), rng.randrange(4, 7))) for _ in range(300)] + [rng.getrandbits(64) for _ in range(100)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in near + far})
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    bits = np.array(fps, np.int64).view(np.uint64)
    pairs = 0
    for k, x in enumerate(fps):
        for y in np.flatnonzero(np.bitwise_count(bits[k + 1 :] ^ bits[k]) <= 3):
            pairs += 1
            a, b = root(x), root(fps[k + 1 + int(y)])
            label[max(a, b)] = min(a, b)
    found = simhash_dedup.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {r.node: r.component for r in components.components(found).collect()}
    assert {x: got.get(x, x) for x in fps} == {x: root(x) for x in fps}
    assert found.count() < pairs / 5


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100}


# 10 pages

def test_labeller_on_tables_and_made_layouts(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_lstm.fit(pages)
    rows = html_lstm.extract(pages, weights).select("html", "text").collect()
    right = 0
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        cut = [" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", body)]
        right += r.text == "\n".join(filter(None, cut))
    assert right >= 0.97 * len(rows)
    page = (
        '<body><div class="cookie-notice">We use cookies. Accept all</div><header><a href="/">Site</a></header><div class="sidebar"><h3>Related</h3><p>Another story about this.</p></div>'
        "<article><h1>Title</h1><p>Some <b>first</b>\n paragraph &amp; text.<form action='/s'><label>Search now</label></form><p>Second paragraph, longer than the first one, ends here.</article>"
        '<section class="comments"><p>I like this article a lot, thanks.</p></section><aside>More from us</aside><footer>Copyright</footer>'
    )
    odd = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>" * 500), (5, "&#x41;</p></div><p")], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_lstm.extract(odd, weights).collect()}
    assert got[1] == "Title\nSome first paragraph & text.\nSecond paragraph, longer than the first one, ends here." and got[2] == got[3] == got[4] == ""


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    model = html_lstm.BiLstm(rng)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask = html_lstm.padded([rng.random((4, html_lstm.FEATURES)).astype(np.float32), rng.random((2, html_lstm.FEATURES)).astype(np.float32)])
    y = rng.integers(0, 2, mask.shape).astype(np.float32)
    grads = model.gradients(x, mask, y)

    def loss():
        p = np.clip(model.scores(x, mask), 1e-9, 1 - 1e-9)
        return float(-((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum())

    for name in ("fx", "fh", "bc", "out", "bh"):
        at = np.unravel_index(int(np.abs(grads[name]).argmax()), grads[name].shape)
        keep = model.w[name][at]
        model.w[name][at] = keep + 1e-2
        up = loss()
        model.w[name][at] = keep - 1e-2
        down = loss()
        model.w[name][at] = keep
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3 + 0.05 * abs(grads[name][at])


def test_null_and_repeated_ids(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten " * 12
    rows = [(None, text, "en", None, 1), (None, None, None, "src1", None), (3, text, "en", "src1", 1), (3, text, "en", "src1", 1), (3, "other", None, "src2", 1), (5, "mail a@b.co", "fr", "src2", 1)]
    docs = spark.createDataFrame(rows, DOC)
    four = sorted(((r.doc_id is None, r.doc_id or 0, r.edited_sha256, r.fingerprint) for r in simhash_search.edited_likeness(docs).collect()))
    assert len(four) == len(rows) and sum(r[0] for r in four) == 2
    seven = bwt_dedup.digest(docs).collect()
    assert len(seven) == len(rows) and sorted(r.n_removed for r in seven) == [0, 0, 0, len(text), len(text), len(text)]
    nine = simhash_dedup.near_components(docs).collect()
    assert len(nine) == len(rows) and {r.component_id for r in nine if r.fingerprint == next(x.fingerprint for x in nine if x.doc_id == 3 and x.component_id == 3 and sum(y.fingerprint == x.fingerprint for y in nine) > 1)} == {3}
    six = pii.digest(docs).collect()
    assert len(six) == len(rows) and sum(r.n_email for r in six) == 1
    eight = mixing.digest(docs).collect()
    assert len(eight) == len(rows) and all(r.copies >= 0 for r in eight)
    assert bpe_trie.round_trip(docs.select("doc_id", "text")).count() == len(rows)
    monkeypatch.setattr("foliospark.llm.order.parallelism", lambda s: 400)  # more ranges than rows
    again = sorted(((r.doc_id is None, r.doc_id or 0, r.edited_sha256, r.fingerprint) for r in simhash_search.edited_likeness(docs).collect()))
    assert again == four


def test_inner_names_leave_own_columns_alone(spark):
    docs = documents(spark, ["plain text here", "mail a@b.co"]).withColumns({c: F.lit(7) for c in ("_answer", "_coded", "_sha", "_spans", "_row", "_key", "_salt", "tokens", "domain")})
    model = {"pieces": ("a", langid.MARK), "languages": ["en"], "probability": np.array([[0.5], [0.4], [langid.UNKNOWN]])}
    out = mixing.mixed(bpe_trie.decode(bpe_trie.encode(pii.redact(langid.predict(docs, model)))).select(docs.columns), F.col("tokens"))
    rows = out.collect()
    assert out.columns == docs.columns and rows and all(r._answer == r._coded == r._sha == r._spans == r._row == r._key == r._salt == r.tokens == r.domain == 7 for r in rows)
    assert {r.text for r in rows} <= {"plain text here", "mail [EMAIL]"}
