"""Connected components: how many tables they take, and tables of several parts against brute force."""

import random

from foliospark.plans import components


def found(spark, edges):
    return {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}


def reached(edges):
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {x: low if c == high else c for x, c in label.items()}
    return label


def test_few_edges_take_two_tables(spark, monkeypatch):
    names, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or write(df, name))
    edges = [(k + 1, k) for k in range(200)] + [(900, 901), (901, 900), (900, 901), (-5, 4000)]
    assert found(spark, edges) == reached(edges)
    assert len(names) == 2


def test_parts_and_rounds_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(components, "PART", 7)
    rng = random.Random(3)
    path = [(k, k + 1) for k in range(60)]
    rng.shuffle(path)
    edges = path + [(1000, 1000 + k) for k in range(1, 40)] + [(rng.randrange(2000, 2120), rng.randrange(2000, 2120)) for _ in range(70)]
    edges = [e for e in edges if e[0] != e[1]]
    assert found(spark, edges) == reached(edges)
    assert found(spark, edges[:7]) == reached(edges[:7])
    assert found(spark, []) == {}
