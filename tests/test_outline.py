"""Outlines of any depth and shape."""

import random

import pytest

from foliospark.operators import misc, outline

NODE = "outline_id long, node_id long, parent_id long, ord long, title string, page_index int"


def by_hand(rows):
    out = {}
    for o in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == o}
        stack = [(n, 0) for n in sorted((n for n in nodes if nodes[n][2] is None), key=lambda n: (nodes[n][3], n), reverse=True)]
        while stack:
            n, level = stack.pop()
            out[o, n] = (level, sum(k[0] == o for k in out))
            stack += [(c, level + 1) for c in sorted((c for c in nodes if nodes[c][2] == n), key=lambda c: (nodes[c][3], c), reverse=True)]
    return out


def test_forests_in_reading_order(spark):
    rng = random.Random(4)
    rows = [(o, n, rng.randrange(n) if n and rng.random() < 0.9 else None, rng.randrange(3), rng.choice(["a", " ", None]), n) for o in range(6) for n in range(rng.choice([1, 5, 40]))]
    found = outline.flattened(spark.createDataFrame(rows, NODE), spark.createDataFrame([(o, 4) for o in range(5)], "outline_id long, page_count int"))
    nodes = found.nodes.collect()
    assert {(r.outline_id, r.node_id): (r.level, r.position) for r in nodes} == by_hand(rows)
    assert all(r.title in ("a", "(Untitled)") for r in nodes)
    assert all(r.page_index == (r.node_id if r.node_id < 4 and r.outline_id < 5 else None) for r in nodes)
    assert found.rejected.count() == 0


def test_a_deep_chain_keeps_all_its_nodes(spark):
    rows = [(1, n, n - 1 if n else None, 0, f"t{n}", 0) for n in range(10_000)]
    got = {r.node_id: (r.level, r.position) for r in outline.flattened(spark.createDataFrame(rows, NODE).repartition(4)).nodes.collect()}
    assert got == {n: (n, n) for n in range(10_000)}
    chain = spark.createDataFrame([(n, n - 1 if n else None, "t") for n in range(25)], "node_id long, parent_id long, title string")
    assert sorted((r.node_id, r.level) for r in misc.outline_levels(chain).collect()) == [(n, n) for n in range(25)]


def test_what_is_no_tree_is_rejected_with_a_reason(spark):
    rows = [(1, 1, None, 0, "root", 0), (1, 2, 1, 0, "child", 0), (1, 3, 4, 0, "ring", 0), (1, 4, 3, 0, "ring", 0), (1, 5, 4, 0, "under a ring", 0), (1, 6, 6, 0, "itself", 0)]
    rows += [(1, 7, 99, 0, "orphan", 0), (1, 8, 7, 0, "its child", 0), (1, 9, 1, 0, "twice", 0), (1, 9, 2, 0, "twice", 0), (1, None, 1, 0, "nameless", 0), (2, 1, None, 0, "other", 0), (2, 2, 5, 0, "a parent of another outline", 0)]
    found = outline.flattened(spark.createDataFrame(rows, NODE))
    assert sorted((r.outline_id, r.node_id, r.level, r.position) for r in found.nodes.collect()) == [(1, 1, 0, 0), (1, 2, 1, 1), (2, 1, 0, 0)]
    want = [(1, 3, "cycle"), (1, 4, "cycle"), (1, 5, "cycle"), (1, 6, "cycle"), (1, 7, "orphan"), (1, 8, "orphan"), (1, 9, "repeated id"), (1, 9, "repeated id"), (1, None, "no id"), (2, 2, "orphan")]
    assert sorted(((r.outline_id, r.node_id, r.reason) for r in found.rejected.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("rows", [[], [(1, 1, None, None, None, None)]])
def test_tiny_outlines(spark, rows):
    found = outline.flattened(spark.createDataFrame(rows, NODE))
    assert found.nodes.count() == len(rows) and found.rejected.count() == 0
