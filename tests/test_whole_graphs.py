"""Graph queries and operators over whole graphs, against brute force."""

import numpy as np
import pytest

from codeloom.operators import graph
from codeloom.plans import queries
from test_queries import SF


def ranked(nodes, edges):
    at = {n: i for i, n in enumerate(sorted(nodes))}
    m = np.zeros((len(at), len(at)))
    for s, d, w in edges:
        m[at[d], at[s]] += w
    out = m.sum(axis=0)
    m[:, out == 0] = 1
    m /= m.sum(axis=0)
    x = np.full(len(at), 1 / len(at))
    for _ in range(1000):
        x = 0.15 / len(at) + 0.85 * m @ x
    return {n: x[i] for n, i in at.items()}


def test_ranks_converge(spark):
    s, r, i = queries._facts(spark, SF)
    paths = [x.path for x in queries.facts.files(queries.read(spark, SF, "documents")).select("path").collect()]
    want = ranked(paths, [tuple(e) for e in graph.file_edges(s, r, i).select("src", "dst", "weight").collect()])
    best = sorted(want, key=lambda n: (-round(want[n], 9), n))[:10]
    got = queries.QUERIES["ranked_map_converged"](spark, SF).collect()
    assert got and {x.path for x in got} <= set(best)
    assert all(x.score == pytest.approx(want[x.path] * (1 + x.inbound), abs=1e-6 + 6e-6 * (1 + x.inbound)) for x in got)
    trade = queries.facts.trade_edges(spark, SF).select("src", "dst", "weight").collect()
    nations = [x.n_name for x in queries.read(spark, SF, "nation").collect()]
    want = ranked(nations, map(tuple, trade))
    assert {x.node: x.rank for x in queries.QUERIES["pagerank_trade_converged"](spark, SF).collect()} == pytest.approx(want, abs=7e-6)
    eight = sorted(want, key=lambda n: -want[n])[:8]
    assert {n for x in queries.QUERIES["drawn_edges_converged"](spark, SF).collect() for n in (x.src, x.dst)} <= set(eight)


def test_chains_of_cycles_are_all_found(spark):
    def chain(n):
        name = "{:03d}{}".format
        edges = [(name(i, a), name(i, b)) for i in range(n) for a, b in ("xy", "yx")] + [(name(i, "y"), name(i + 1, "x")) for i in range(n - 1)]
        return spark.createDataFrame(edges, "src string, dst string"), sorted((name(i, a), name(i, "x")) for i in range(n) for a in "xy")

    for n, small in ((100, 500_000), (5, 0)):
        edges, want = chain(n)
        assert sorted((r.node, r.component) for r in graph.cycle_groups(edges, small=small).collect()) == want
    assert graph.cycle_groups(edges.limit(0)).count() == 0


def test_paths_longer_than_64_hops_and_bounds(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(100)] + [("q", "r")], "src string, dst string")
    path = graph.shortest_path(edges, "000", "100").orderBy("step").collect()
    assert [r.node for r in path] == [f"{i:03d}" for i in range(101)] and all(r.forward for r in path[1:])
    assert graph.shortest_path(edges, "000", "q").count() == 0
    with pytest.raises(graph.Exhausted):
        graph.shortest_path(edges, "000", "100", bound=50)
    assert graph.shortest_path(edges, "000", "q", bound=100).count() == 0  # all 101 nodes seen: there is none
    few = edges.where("src < '006'")
    one, more = (sorted(map(tuple, graph.hops(few, "002", small=k).collect())) for k in (100, 0))
    assert one == more and max(h for _, h, _ in one) == 4
    assert [r.node for r in graph.shortest_path(few, "000", "004", small=0).orderBy("step").collect()] == ["000", "001", "002", "003", "004"]


def test_whole_file_graph_against_brute_force(spark):
    edges, first, last = queries._whole(spark, SF)
    pairs = [(e.src, e.dst) for e in edges.collect()]
    nodes = sorted({n for e in pairs for n in e})
    near = {n: set() for n in nodes}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want, front = {first: 0}, [first]
    while front:
        front = sorted({b for a in front for b in near[a]} - want.keys())
        want |= dict.fromkeys(front, max(want.values()) + 1)
    run = {n: queries.QUERIES[n](spark, SF).collect() for n in ("file_hops", "file_neighbourhood", "file_path", "file_cycles")}
    assert {r.node: r.hops for r in run["file_hops"]} == want
    assert {r.node: r.hops for r in run["file_neighbourhood"]} == {n: h for n, h in want.items() if h <= 2}
    steps = sorted((r.step, r.node) for r in run["file_path"])
    assert [i for i, _ in steps] == list(range(want[last] + 1)) and steps[0][1] == first and steps[-1][1] == last
    assert all(b in near[a] for (_, a), (_, b) in zip(steps, steps[1:]))
    reach = np.eye(len(nodes), dtype=np.float32)
    at = {n: i for i, n in enumerate(nodes)}
    for a, b in pairs:
        reach[at[a], at[b]] = 1
    for _ in range(12):
        reach = (reach @ reach > 0).astype(np.float32)
    both = (reach * reach.T) > 0
    assert {r.node: r.component for r in run["file_cycles"]} == {n: nodes[int(np.argmax(both[i]))] for n, i in at.items() if both[i].sum() > 1}


def test_hubs_stand_for_their_pairs(spark):
    import random

    rng = random.Random(3)
    links, into = set(), set()
    for h in range(30):
        some = rng.sample(range(60), 5)
        links |= {(f"f{a:02d}", f"h{h}", float(1 + a % 3)) for a in some[:3]}
        into |= {(f"h{h}", f"f{b:02d}") for b in some[3:]}
    out, to = spark.createDataFrame(sorted(links), "src string, hub string, weight double"), spark.createDataFrame(sorted(into), "hub string, dst string")
    pairs = out.join(to, "hub").groupBy("src", "dst").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "weight").cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    first = min(s for s, _, _ in links)
    assert sorted(rows(graph.hub_hops(out, to, first)), key=str) == sorted(rows(graph.hops(pairs, first)), key=str)
    assert rows(graph.hub_cycles(out, to)) == rows(graph.cycle_groups(pairs)) != []
    far = max(graph.hops(pairs, first).collect(), key=lambda r: (r.hops, r.node)).node
    assert rows(graph.hub_path(out, to, first, far)) == rows(graph.shortest_path(pairs, first, far))
    nodes = spark.createDataFrame([(f"f{i:02d}",) for i in range(60)], "node string")
    want = {r.node: r.rank for r in graph.pagerank(nodes, pairs).collect()}
    assert {r.node: r.rank for r in graph.pagerank(nodes, out, into=to).collect()} == pytest.approx(want, abs=1e-9)
    three = {r.node: r.rank for r in graph.pagerank(nodes, out, into=to, iterations=3, epsilon=None, small=0).collect()}
    assert three == pytest.approx({r.node: r.rank for r in graph.pagerank(nodes, pairs, iterations=3, epsilon=None).collect()}, abs=1e-9)


def test_a_hub_of_many_files_costs_no_pairs(spark):
    n = 100_000  # 1e10 pairs
    links = spark.range(n).selectExpr("concat('a', id) AS src", "'h' AS hub", "1.0D AS weight")
    into = spark.range(n).selectExpr("'h' AS hub", "concat('b', id) AS dst")
    assert graph.hub_hops(links, into, "a0", most=2).groupBy("hops").count().count() == 3
    assert graph.hub_cycles(links, into).count() == 0


def test_edge_counts_are_those_of_symbol_edges(spark):
    from codeloom.operators import resolve

    import random

    rng = random.Random(7)
    uses = spark.createDataFrame([(f"f{rng.randrange(12)}", f"n{rng.randrange(15)}") for _ in range(120)], "path string, name string")
    symbols = spark.createDataFrame([(f"f{rng.randrange(12)}", f"n{rng.randrange(15)}") for _ in range(25)], "path string, name string")
    imports = spark.createDataFrame([(f"f{rng.randrange(12)}", f"f{rng.randrange(12)}") for _ in range(20)], "src string, dst string")
    want: dict = {}
    for e in resolve.symbol_edges(uses, symbols, imports).collect():
        want.setdefault((e.src, e.relation, e.tier), []).append((e.dst, e.name))
    got = {(r.src, r.relation, r.tier): (r.edges, r["first"], r.last_name) for r in resolve.edge_counts(uses, symbols, imports).collect()}
    assert got == {k: (len(v), min(d for d, _ in v), max(n for _, n in v)) for k, v in want.items()} and len({t for _, _, t in got}) == 3
    many = spark.range(100_000)  # 1e10 edges
    counted = resolve.edge_counts(many.selectExpr("concat('u', id) AS path", "'n' AS name"), many.selectExpr("concat('d', id) AS path", "'n' AS name"), imports.limit(0))
    assert counted.where("edges = 100000 and first = 'd0'").count() == 100_000


def test_shared_callers_keep_no_row_for_each_word(spark, monkeypatch):
    kept, real = [], queries.graph.cut
    monkeypatch.setattr(queries.graph, "cut", lambda df: kept.append(df.columns) or real(df))
    queries.QUERIES["shared_callers"](spark, SF).collect()
    assert kept and ["path", "name", "line"] not in kept
