"""Traversals that are longer than any fixed number of steps."""

import pytest

from lodestone.operators import graph

SCHEMA = "src long, dst long, rtype string, weight double"


def test_shortest_path_has_no_bound(spark):
    edges = [(i, i + 1, "R", 1.0) for i in range(53)] + [(0, 53, "R", 100.0)]
    rows = graph.shortest_path(spark.createDataFrame(edges, SCHEMA).repartition(1), 0, 53).collect()
    assert [(r.id, r.cost) for r in rows] == [(53, 53.0)]
    short = spark.createDataFrame([(0, 1, "R", 1.0), (1, 2, "R", 1.5), (0, 2, "R", 4.0), (2, 3, "R", None), (3, 0, "R", 1.0)], SCHEMA)
    for one_task in (0, 100):
        assert [(r.id, r.cost, r.path) for r in graph.shortest_path(short, 0, 2, one_task=one_task).collect()] == [(2, 2.5, "0-[R]->1-[R]->2")]
        assert graph.shortest_path(short, 0, 3, one_task=one_task).count() == 0
    with pytest.raises(ValueError):
        graph.shortest_path(spark.createDataFrame([(0, 1, "R", -1.0), (1, 0, "R", -1.0)], SCHEMA), 0, 1)


def test_breadth_first_goes_to_the_end(spark):
    chain = spark.createDataFrame([(i, i + 1, "R", 1.0) for i in range(14)], SCHEMA).repartition(1)
    for one_task in (0, 1000):
        assert [r.depth for r in graph.bfs(chain, 0, one_task=one_task).collect()] == list(range(1, 16))
    assert graph.bfs(chain, 0, uniqueness="NONE").count() == 15
    with pytest.raises(ValueError):
        graph.bfs(spark.createDataFrame([(0, 1, "R", 1.0), (1, 0, "R", 1.0)], SCHEMA), 0, uniqueness="NONE")


def _depth_first(near, start, max_depth=None):
    seen, out = set(), []

    def go(x, depth):
        if x in seen or max_depth and depth > max_depth:
            return
        seen.add(x)
        out.append((x, depth))
        for y in sorted(near.get(x, [])):
            go(y, depth + 1)

    go(start, 1)
    return out


def test_depth_first_order_on_a_graph_with_cycles(spark):
    edges = [(0, -2), (0, -10), (-2, 3), (-10, 3), (3, 0), (3, 4), (4, -10), (4, 5), (-2, 5), (5, 0), (10, 9), (0, 10)]
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    df = spark.createDataFrame([(a, b, "R", 1.0) for a, b in edges], SCHEMA)
    for depth in (None, 3):
        got = graph.dfs(df, 0, max_depth=depth).collect()
        assert [(r.id, r.depth) for r in got] == _depth_first(near, 0, depth)
        assert [r.place for r in got] == list(range(len(got)))
    assert [r.id for r in graph.dfs(df, 0, expand=lambda x, d: x != 3, emit=lambda x, d: x != 0).collect()] == [-10, 3, -2, 5, 10, 9]
    assert graph.dfs(df, 0, uniqueness="NONE", max_depth=3).count() == graph.bfs(df, 0, uniqueness="NONE", max_depth=3).count()
    assert graph.dfs(df, 77).collect()[0].path == "77"
    with pytest.raises(ValueError):
        graph.dfs(df, 0, uniqueness="NONE").collect()


def test_edges_properties_and_persistence(spark, tmp_path):
    schema = "src long, dst long, rtype string, weight double, props map<string,string>"
    edges = graph.add_edge(spark.createDataFrame([], schema), 1, "KNOWS", 2, weight=2.0, props={"since": "1999"})
    edges = graph.add_edge(graph.add_edge(edges, 1, "KNOWS", 2, weight=3.0), 3, "KNOWS", 2)
    edges = graph.set_edge_property(edges, 1, "KNOWS", 2, "place", "x")
    assert [(r.src, r.weight, r.props) for r in edges.orderBy("src").collect()] == [(1, 3.0, {"place": "x"}), (3, None, None)]
    assert sorted(r.id for r in graph.connected_to(edges, 2, "KNOWS").collect()) == [1, 3]
    with pytest.raises(ValueError):
        graph.set_edge_property(edges, 2, "KNOWS", 1, "a", "b")
    people = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, "Cy")], "id long, name string")
    graph.save(people, edges, f"file://{tmp_path}/g")
    people, edges = graph.load(spark, f"file://{tmp_path}/g")
    got = graph.traverse(people, edges, "BFS", 1, "REPLY.NODENAME_AND_PATH", "EXPANDER.BOTH").collect()
    assert [(r.nodename, r.path, r.depth) for r in got] == [("Ann", "Ann", 1), ("Bob", "Ann-[KNOWS]->Bob", 2), ("Cy", "Ann-[KNOWS]->Bob<-[KNOWS]-Cy", 3)]
    with pytest.raises(ValueError):
        graph.traverse(people, edges, "BFS", 1, "WIDTH.3")


def test_both_ways_of_breadth_first_agree(spark):
    edges = [(a, b, t, 1.0) for a in range(12) for b, t in ((a * 7 % 12, "R"), ((a + 5) % 12, "S"), (a // 2, "R"))]
    df = spark.createDataFrame(edges, SCHEMA).repartition(2)
    for options in ({}, {"expander": "BOTH"}, {"rtype": "R", "max_depth": 3}, {"min_depth": 2, "emit": "id % 2 = 0"}):
        one, many = (graph.bfs(df, 1, one_task=n, **options).collect() for n in (1000, 0))
        assert [tuple(r) for r in one] == [tuple(r) for r in many]
    assert graph.bfs(df, 99).collect()[0].path == graph.bfs(df, 99, one_task=0).collect()[0].path == "99"


def test_loops_of_joins_send_no_edges_through_the_driver(spark, monkeypatch):
    plans, cut = [], graph._cut

    def recorded(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graph, "_cut", recorded)
    edges = spark.createDataFrame([(i, i // 3, "UP", 1.0) for i in range(1, 40)], SCHEMA)
    assert graph.bfs(edges, 0, "INCOMING", one_task=0).count() == 40
    assert graph.bfs(edges, 0, "INCOMING", expand="id > -1", one_task=0).count() == 40
    assert graph.shortest_path(edges, 39, 0, one_task=0).first().cost == 4.0
    assert len(plans) > 9 and not [p for p in plans if "Broadcast" in p]
