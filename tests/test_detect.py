"""Visual changes from grids: moved pages, tiles, runs, and boxes that meet by a grid."""

import random
import time


from foliospark.operators import detect, misc, regions, scoring
from foliospark.operators.compare import contained_pairs

PAGE = ["pair_id", "page_index"]
CELL = "pair_id long, page_index int, side string, x int, y int, r int, g int, b int, a int"
OFFSET = "pair_id long, page_index int, dx double, dy double"


def grid(side, pixels, pair=1):
    return [(pair, 0, side, x, y, *c, 255) for (x, y), c in pixels.items() if c != (255, 255, 255)]


def bilinear(pixels, w, h, u, v):
    u, v = min(max(u, 0), w - 1), min(max(v, 0), h - 1)
    x, y = int(u), int(v)
    at = lambda i, j: pixels.get((min(i, w - 1), min(j, h - 1)), (255, 255, 255))
    parts = [(at(x, y), (1 - u + x) * (1 - v + y)), (at(x + 1, y), (u - x) * (1 - v + y)), (at(x, y + 1), (1 - u + x) * (v - y)), (at(x + 1, y + 1), (u - x) * (v - y))]
    return tuple(round(sum(c[k] * z for c, z in parts)) for k in range(3))


def delta(p, q):
    from foliospark.functions.colour import I, Q, Y

    y, i, k = (sum(w * (a - b) for w, a, b in zip(axis, p, q)) for axis in (Y, I, Q))
    return (y * y + 0.48 * i * i + 0.48 * k * k + y * y + 0.3 * i * i + 0.3 * k * k) ** 0.5


def mask_by_hand(old, new, w, h, dx, dy):
    diff = set()
    for x in range(w):
        for y in range(h):
            if 0 <= x + dx < w and 0 <= y + dy < h:
                p = old.get((x, y), (255, 255, 255))
                if all(delta(p, bilinear(new, w, h, x + dx + i, y + dy + j)) > 60 for i in range(-2, 3) for j in range(-2, 3)):
                    diff.add((x, y))
    return {(x, y) for x, y in diff if sum((x + i, y + j) in diff for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j) >= 3}


def test_mask_at_fractional_offsets(spark):
    rng = random.Random(6)
    w, h = 30, 22
    rect = lambda x, y, a, b, c: {(i, j): c for i in range(x, x + a) for j in range(y, y + b)}
    old = rect(5, 6, 9, 7, (0, 0, 0)) | rect(18, 3, 6, 12, (200, 30, 30)) | {(w - 1, h - 1): (0, 0, 0)}
    moved = {(x, y): bilinear(old, w, h, x - 1.25, y + 0.5) for x in range(w) for y in range(h)}
    noise = {(rng.randrange(w), rng.randrange(h)): tuple(rng.randrange(256) for _ in range(3)) for _ in range(300)} | {(w - 1, h - 1): (9, 9, 9)}
    changed = {k: v for k, v in moved.items()} | rect(8, 8, 8, 8, (0, 200, 0))
    pages = {1: (old, moved, 1.25, -0.5), 2: (old, noise, -2.5, 3.75), 3: (noise, old, 0.0, 0.0), 4: (old, changed, 1.25, -0.5), 5: (noise, noise, 40.0, 0.0), 6: (old, old, 0.0, 0.0)}
    cells = spark.createDataFrame([c for k, (o, n, _, _) in pages.items() for c in grid("old", o, k) + grid("new", n, k)], CELL)
    offsets = spark.createDataFrame([(k, 0, dx, dy) for k, (_, _, dx, dy) in pages.items() if k not in (3, 6)], OFFSET)
    got = {}
    for r in detect.mask(cells, PAGE, offsets, tile=8).collect():
        got.setdefault(r.pair_id, set()).add((r.x, r.y))
    for k, (o, n, dx, dy) in pages.items():
        assert got.get(k, set()) == mask_by_hand(o, n, w, h, dx, dy), k
    assert 1 not in got and 5 not in got and got[4]


def test_only_tiles_that_differ_are_looked_at(spark):
    rows = [(1, 0, s, x, y, (x * 7) % 256, (y * 5) % 256, 0, 255) for s in ("old", "new") for x in range(160) for y in range(160)]
    rows = [(*r[:5], 255, 0, 255, 255) if r[2] == "new" and 100 <= r[3] < 110 and 20 <= r[4] < 30 else r for r in rows]
    cells = spark.createDataFrame(rows, CELL)
    none = spark.createDataFrame([], OFFSET)
    tiles = {(r.tx, r.ty) for r in detect.changed_tiles(cells, PAGE, 16).collect()}
    assert tiles == {(x, y) for x in range(5, 8) for y in range(0, 3)}
    whole = {(r.x, r.y) for r in misc.grid_mask(cells, PAGE).collect()}
    assert whole and {(r.x, r.y) for r in detect.mask(cells, PAGE, none, tile=16).collect()} == whole


def test_regions_of_runs(spark):
    rng = random.Random(8)
    marked = {(rng.randrange(200), rng.randrange(30)) for _ in range(3500)}
    df = spark.createDataFrame([(1, 0, x, y) for x, y in marked], "pair_id long, page_index int, x int, y int")
    assert detect.runs(df, PAGE).count() == sum((x - 1, y) not in marked for x, y in marked)
    left, want = set(marked), []
    while left:
        stack, part = [left.pop()], []
        while stack:
            x, y = stack.pop()
            part.append((x, y))
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in left:
                    left.remove(q)
                    stack.append(q)
        if len(part) >= 8:
            xs, ys = zip(*part)
            want.append((min(xs) * 2.0, min(ys) * 2.0, (max(xs) + 1) * 2.0, (max(ys) + 1) * 2.0, len(part)))
    got = detect.regions(df, PAGE, scale=2.0).select("left", "top", "right", "bottom", "n_cells").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_many_boxes_of_a_page_meet_by_grid(spark):
    rng = random.Random(9)
    few = [(1, 0, k, x := rng.uniform(-50, 600), y := rng.uniform(-50, 600), x + rng.choice([0, 3, 90]), y + rng.choice([0, 5, 70])) for k in range(300)]
    kind = "pair_id long, page_index int, node long, left double, top double, right double, bottom double"
    near = lambda a, b: max(a[3] - b[5], b[3] - a[5]) <= 8 and max(a[4] - b[6], b[4] - a[6]) <= 8
    pairs = [(r.a, r.b) for r in regions.near_pairs(spark.createDataFrame(few, kind)).collect()]
    assert sorted(pairs) == [(a[2], b[2]) for a in few for b in few if a[2] < b[2] and near(a, b)]
    many = [(1, 0, k, float(k % 200) * 20, float(k // 200) * 20, float(k % 200) * 20 + 5, float(k // 200) * 20 + 5) for k in range(20_000)]
    began = time.time()
    assert regions.near_pairs(spark.createDataFrame(many, kind)).count() == 0
    assert time.time() - began < 60


def test_equal_lines_of_many_pages_are_scored_once(spark):
    box = "case_id long, node long, left double, top double, right double, bottom double"
    rows = [(1, p * 10 + k, 70.0, 40.0 * k, 300.0, 40.0 * k + 10) for p in range(5000) for k in range(10)]
    truth, found = spark.createDataFrame(rows, box), spark.createDataFrame([(c, n + 1, x + 3, y, r, b) for c, n, x, y, r, b in rows if n % 10 < 9] + [(1, -1, 400.0, 0.0, 500.0, 9.0)], box)
    assert contained_pairs(*(d.dropDuplicates(["left", "top"]) for d in (truth, found)), 0.5).count() == 9
    assert [tuple(r) for r in scoring.region_counts(truth, found, 0.5).collect()] == [(1, 45_000, 1, 5000)]
