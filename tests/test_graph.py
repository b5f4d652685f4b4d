import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.operators import graph
from skein.operators.components import connected_components


def segments(spark, pairs):
    return spark.createDataFrame([(f"{u}_{v}_{k}", u, v) for k, (u, v) in enumerate(pairs)], "segment_id string, u long, v long")


SQUARE = [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3), (4, 1), (1, 4), (4, 5)]  # two-way square, one-way spur


def test_line_graph(spark):
    s = segments(spark, SQUARE)
    edges = {(r.segment_id_from, r.segment_id_to) for r in graph.line_edges(s).collect()}
    want = {(f"{a}_{b}_{i}", f"{c}_{d}_{j}") for i, (a, b) in enumerate(SQUARE) for j, (c, d) in enumerate(SQUARE) if b == c}
    assert edges == want
    assert ("1_2_0", "2_1_1") in edges  # turning back
    assert not any(a == "4_5_8" for a, _ in edges)  # a dead end leads nowhere
    assert sum(r.n_edges for r in graph.line_degree(s).collect()) == len(want)
    assert tuple(graph.edge_consistency(graph.line_edges(s), s).first()) == (len(want), 0)
    loop = segments(spark, [(7, 7)])
    assert [(r.segment_id_from, r.segment_id_to) for r in graph.line_edges(loop).collect()] == [("7_7_0", "7_7_0")]


def test_positions_and_index(spark):
    s = segments(spark, SQUARE)
    order = graph.positions(s, "segment_id")
    got = {r.segment_id: r.pos for r in order.collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    index = graph.edge_index(graph.line_edges(s), order, "segment_id", "segment_id_from", "segment_id_to")
    assert index.count() == graph.line_edges(s).count()
    tiled = graph.tiled(index, 9, 3)
    assert tiled.count() == 3 * index.count()
    assert {r.src_pos // 9 for r in tiled.collect()} == {0, 1, 2}


def test_profile_and_duplicates(spark):
    s = segments(spark, [*SQUARE, (6, 6)])
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6, 9)], "node long")
    r = graph.graph_profile(s, nodes).first()
    assert (r.n_nodes, r.n_isolated, r.n_dead_ends, r.n_segments, r.n_loops) == (7, 1, 1, 10, 1)
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (3, 1)], "a int, b int")
    got = {r.key: (r.n_values, r.n_rows) for r in graph.duplicates(rows, {"a": ["a"], "ab": ["a", "b"]}).collect()}
    assert got == {"a": (1, 3), "ab": (1, 2)}


def test_propagation_boundaries(spark):
    near = graph.adjacency(spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d")], "x string, y string"), "x", "y")
    assert {(r.node, r.neighbour) for r in near.collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("d", "d")}
    state = spark.createDataFrame([(n, 0, int(n in "ad")) for n in "abcde"], "node string, phase_id int, y int")
    height = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 1.0), ("d", 5.1)], "node string, elevation double")

    def predicted(intensity):
        pairs = spark.createDataFrame([(0, 1, intensity)], "phase_id int, next_phase int, intensity double")
        return {r.node: r.y_pred for r in graph.propagate(state, near, height, pairs, 50.0, 5.0).collect()}

    assert predicted(50.0) == {"a": 0, "b": 1, "c": 0, "d": 0, "e": 0}  # 5.0 is low, 50.0 is not too much rain
    assert set(predicted(50.1).values()) == {1}
    assert {r.node for r in graph.flooded_neighbours(near, spark.createDataFrame([("a",)], "node string")).collect()} == {"b"}


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(parent)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_weak_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == brute_components(edges)


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(None, 5), (7, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 501


def brute_strong(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    return {n: max(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], [(9, 8), (8, 7), (7, 8), (8, 9), (1, 9)]])
def test_strong_components(spark, edges):
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute_strong(edges)


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    assert tuple(graph.fingerprint(a, "k").first()) == (3, hashlib.sha256(b"a|b|c").hexdigest())
    assert graph.fingerprint(a.orderBy("k"), "k").first() == graph.fingerprint(a, "k").first()
    many = spark.range(30_000).selectExpr("concat(repeat('a', int(id % 3)), id) AS k")
    want = hashlib.sha256("|".join(sorted("a" * (i % 3) + str(i) for i in range(30_000))).encode()).hexdigest()
    assert tuple(graph.fingerprint(many.unionByName(many), "k").first()) == (30_000, want)
    b = spark.createDataFrame([("b",), ("x",)], "k string")
    assert tuple(graph.key_consistency(a, b, "k").first()) == (2, 1, 1)


def test_neighbour_mean(spark):
    near = graph.adjacency(spark.createDataFrame([(1, 2), (1, 3)], "x int, y int"), "x", "y")
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0), (4, 8.0)], "node int, f double")
    assert {r.node: r.f_near for r in graph.neighbour_mean(near, rows, "f").collect()} == {1: 3.0, 2: 1.0, 3: 1.0, 4: None}
