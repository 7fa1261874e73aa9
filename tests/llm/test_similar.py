"""Near copies by shingle similarity against all pairs."""

import random
import re

import numpy as np

from foliospark.llm import similar
from tests.llm.test_operators import DOC, ODD, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n=5):
    w = word_list(text)
    return {" ".join(w[k : k + n]) for k in range(max(len(w) - n + 1, min(len(w), 1)))}


def kept_places(texts, similarity=0.8):
    """Places of the texts that stay, by all pairs; and the number of pairs linked."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    places: dict[str, list[int]] = {}
    for k, s in enumerate(sets):
        for x in s or {""}:
            places.setdefault(x, []).append(k)
    pairs = {(a, b) for p in places.values() for i, a in enumerate(p) for b in p[i + 1 :]}
    linked = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in linked:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [k for k in range(len(texts)) if root(k) == k], linked


def drafts(texts, rng):
    out = []
    for t in texts:
        w = t.split()
        if len(w) < 12:
            continue
        for _ in range(rng.randrange(1, 5)):
            v = list(w)
            for _ in range(rng.randrange(1, 2 + len(v) // 60)):
                k = rng.randrange(len(v))
                v[k : k + rng.randrange(2)] = [rng.choice(["inserted", "changed", w[rng.randrange(len(w))]])]
            out.append(" ".join(v))
    return out


def test_what_stays_equals_all_pairs(spark, sf):
    rng = random.Random(1)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()][:150]
    cases = [*texts, *drafts(texts, rng), *ODD, texts[3].upper(), "one two three four five six seven", "one two three four five six seven eight"]
    want, linked = kept_places(cases)
    got = sorted(r.doc_id for r in similar.first_of_each(documents(spark, cases, extra=True)).collect())
    assert len(linked) > 200 and set(got) >= set(want) and len(set(got) - set(want)) <= 0.01 * len(want)


def test_cells_meet_at_the_threshold():
    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for size in (9, 40, 450, 6000):
        met = 0
        for _ in range(100):
            common, a, b = draw(size - size // 9), draw(size // 9), draw(size // 9)
            x, y = (np.unique(np.concatenate([common, z])) for z in (a, b))
            met += bool(set(similar.cells(x).tolist()) & set(similar.cells(y).tolist()))
        assert met >= 99
        assert not set(similar.cells(draw(size)).tolist()) & set(similar.cells(draw(size)).tolist())


def test_parities_are_a_lower_bound():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for size, changed in ((0, 0), (0, 7), (1, 1), (150, 20), (150, 200), (9000, 900)):
        common = draw(size)
        x, y = (np.unique(np.concatenate([common, draw(changed)])) for _ in range(2))
        differing = sum(bin(v).count("1") for v in (similar.parities(x) ^ similar.parities(y)).view(np.uint64).tolist())
        assert differing <= len(np.setxor1d(x, y)) and (changed > 20 or differing >= 0.7 * len(np.setxor1d(x, y)))


def test_group_of_copies_with_edits_in_one_group(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    group = []
    for _ in range(300):
        v = list(words)
        for _ in range(rng.randrange(1, 9)):
            v[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        group.append(" ".join(v))
    others = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(60)]
    want, _ = kept_places(group + others)
    got = sorted(r.doc_id for r in similar.first_of_each(documents(spark, group + others)).collect())
    assert got == want
    rounds = [r.doc_id for r in similar.first_of_each(documents(spark, group + others), exact=False).collect()]
    # most pairs lie below the threshold, many at it: the rounds alone try links in some dozens of cells, not between all pairs
    assert set(rounds) >= set(want) and 360 - len(rounds) >= 0.95 * (360 - len(want))


def test_repeated_and_missing_ids(spark):
    text = "one two three four five six seven eight nine ten " * 4
    rows = [(3, text, "en", "s", 1), (3, "other words stand here in this row", "en", "s", 1), (3, text.upper(), "en", "s", 1), (None, text, "en", "s", 1), (None, "a text without a name", "en", "s", 1), (7, None, "en", "s", 1), (8, " ", "en", "s", 1)]
    got = similar.first_of_each(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower().strip()[:7]) for r in got) == [(0, "a text "), (3, "one two"), (3, "other w"), (7, "")]
    assert similar.first_of_each(spark.createDataFrame(rows, DOC).limit(0)).count() == 0


def test_fingerprints_give_candidates(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, (40, 300), dtype=np.uint64)
    sets = [np.unique(np.concatenate([b[: 300 - k], rng.integers(0, 1 << 64, k, dtype=np.uint64)])) for b in base for k in (0, 1, 3, 9)] + [base[0], np.array([5], np.uint64)]
    prints = [similar.fingerprint(s) for s in sets]
    for s, p in zip(sets, prints, strict=True):
        assert p & (1 << 64) - 1 == sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in s.tolist()) > len(s))

    def parts(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        return label

    near = [(a, b) for b in range(len(sets)) for a in range(b) if ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= similar.RADIUS]
    got = similar.fingerprint_candidates(spark.createDataFrame(list(enumerate(prints)), "c long, fp long")).collect()
    assert len(near) > 40 and parts((r.a, r.b) for r in got) == parts(near)


def test_candidates_of_fingerprints_are_verified(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(400)) for _ in range(20)]
    texts += [t + " more" for t in texts] + ["one two three"]
    classes, links = similar.similar_links(documents(spark, texts), rounds=1, exact=False)
    name = {r.c: r.first.id for r in classes.collect()}
    pairs = {tuple(sorted((name[r.a], name[r.b]))) for r in links.collect()}
    assert all(len(shingles(texts[a]) & shingles(texts[b])) >= 0.8 * len(shingles(texts[a]) | shingles(texts[b])) for a, b in pairs) and len(pairs) == 20
