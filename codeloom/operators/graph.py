"""Weighted directed graphs as edge tables: build, rank, paths, cycles, communities, neighbourhoods.

Iterative operators keep node tables, never paths, and cut lineage by writing to the shared folder every few rounds; only
scalars reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.packing import first_members
from codeloom.operators.refs import occurrence_counts, reference_weight
from codeloom.plans.lineage import cut, drop

IMPORT_WEIGHT = 3.0


def file_links(symbols: DataFrame, refs: DataFrame, imports: DataFrame, noisy: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(src, hub, weight) and (hub, dst): the file graph through hubs, so that its size is that of the facts.

    A name is a hub between the files that mention it without defining it and those that define it; an imported file is a
    hub to itself. An edge's weight in file_edges is the sum over the hubs between its ends, without its rounding.
    """
    defs = symbols.select("name", "path").distinct()
    used = occurrence_counts(refs).join(defs.withColumn("_own", F.lit(True)), ["path", "name"], "left").join(defs.select("name").distinct(), "name", "left_semi")
    used = cut(used.select("path", "name", "n", "_own"))
    facts = defs.groupBy("name").agg(F.count(F.lit(1)).alias("candidates")).join(used.groupBy("name").agg(F.count(F.lit(1)).alias("spread")), "name")
    weighted = used.where("_own is null").join(facts, "name")
    noise: Column = F.lit(False)
    if noisy is not None:
        weighted = weighted.join(noisy.select("name").distinct().withColumn("_noisy", F.lit(True)), "name", "left")
        noise = F.coalesce("_noisy", F.lit(False))
    w = reference_weight(F.col("name"), F.col("n"), F.col("spread"), F.col("candidates"), noise)
    name, file = F.concat(F.lit("name:"), "name"), F.concat(F.lit("file:"), "dst")
    links = weighted.select(F.col("path").alias("src"), name.alias("hub"), w.alias("weight")).unionByName(imports.select("src", file.alias("hub"), F.lit(IMPORT_WEIGHT).alias("weight")))
    return links, defs.select(name.alias("hub"), F.col("path").alias("dst")).unionByName(imports.select(file.alias("hub"), "dst").distinct())


def file_edges(symbols: DataFrame, refs: DataFrame, imports: DataFrame, noisy: DataFrame | None = None) -> DataFrame:
    """src, dst, weight: mentions of names that other files define, by weight, plus 3 for each import.

    A file that defines a name itself contributes nothing for it. Weights are rounded to 9 places, so that the order of
    summation does not show. A row for each pair of files: what only walks the graph takes file_links.
    """
    links, into = file_links(symbols, refs, imports, noisy)
    return links.join(into, "hub").groupBy("src", "dst").agg(F.round(F.sum("weight"), 9).alias("weight"))


def check_graph(nodes: DataFrame, edges: DataFrame) -> None:
    """Refuses duplicate nodes and edges with unknown ends."""
    if not nodes.groupBy("node").count().where("count > 1").isEmpty():
        raise ValueError("duplicate nodes")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    if not ends.join(nodes, "node", "left_anti").isEmpty():
        raise ValueError("an edge ends at an unknown node")


def _rank_in_one_task(base: DataFrame, links: DataFrame, into: DataFrame, damping: float, iterations: int, epsilon: float | None) -> DataFrame:
    """The same iteration as below in one task, for graphs that surely fit."""
    none = F.lit(None).cast("string")
    rows = base.select(F.lit(0).alias("kind"), F.col("node").alias("a"), none.alias("b"), F.col("jump").alias("x"))
    rows = rows.union(links.select(F.lit(1), "src", "hub", "share")).union(into.select(F.lit(2), "dst", "hub", F.lit(None).cast("double")))

    def run(pdf):
        import numpy as np
        import pandas as pd

        own, edge, lead = (pdf[pdf["kind"] == k].sort_values(["a", "b"]) for k in range(3))
        names, hubs = pd.Index(own["a"]), pd.Index(lead["b"].unique())
        jump, n = own["x"].to_numpy(), len(own)
        src, hub, share = names.get_indexer(edge["a"]), hubs.get_indexer(edge["b"]), edge["x"].to_numpy()
        dst, via = names.get_indexer(lead["a"]), hubs.get_indexer(lead["b"])
        sink = np.ones(n, bool)
        sink[src] = False
        rank = np.full(n, 1 / n)
        for _ in range(iterations):
            got = np.bincount(dst, np.bincount(hub, rank[src] * share, len(hubs))[via], n)
            new = (1 - damping) * jump + damping * (got + rank[sink].sum() * jump)
            gap, rank = np.abs(new - rank).sum(), new
            if epsilon is not None and gap < epsilon:
                break
        return pd.DataFrame({"node": names, "rank": rank})

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "node string, rank double")


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, *, into: DataFrame | None = None, damping: float = 0.85, iterations: int = 100, epsilon: float | None = 1e-6, every: int = 5, small: int = 500_000) -> DataFrame:
    """node, rank. Personalised to `seeds` (node, weight) if any of them is a node, else uniform.

    Starts uniform; the rank of nodes without out-weight goes back to the personalisation. With `epsilon` the loop ends
    when the sum of changes falls below it, checked every round; without, exactly `iterations` rounds run, their lineage
    cut every `every` rounds. Graphs of at most `small` nodes and edges together, which are counted, run in one task.

    With `into` (hub, dst), `edges` lead to hubs (src, hub, weight), and each stands for an edge of its weight to every
    node of its hub; these edges are not made.
    """
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    base = nodes.select("node").distinct().join(F.broadcast(n))  # one row
    if seeds is not None:
        own = seeds.groupBy("node").agg(F.sum("weight").alias("s")).join(nodes, "node", "left_semi")
        total = own.agg(F.sum("s").alias("t"))
        base = base.join(own, "node", "left").join(F.broadcast(total))  # one row
        jump = F.when(F.col("t") > 0, F.coalesce("s", F.lit(0.0)) / F.col("t")).otherwise(1 / F.col("n"))
    else:
        jump = 1 / F.col("n")
    base = cut(base.select("node", "n", jump.alias("jump")))
    if into is None:  # every node is its own hub
        edges, into = edges.select("src", F.col("dst").alias("hub"), "weight"), edges.select(F.col("dst").alias("hub"), "dst").distinct()
    edges, into = cut(edges.select("src", "hub", "weight")), cut(into.select("hub", "dst"))
    ends = into.groupBy("hub").agg(F.count(F.lit(1)).alias("ends"))
    out = cut(edges.join(ends, "hub").groupBy("src").agg(F.sum(F.col("weight") * F.col("ends")).alias("out")).where("out > 0"))
    links = cut(edges.join(ends, "hub", "left_semi").join(out, "src").select("src", "hub", (F.col("weight") / F.col("out")).alias("share")))
    drop(edges)
    if base.count() + links.count() + into.count() <= small:
        return _rank_in_one_task(base, links, into, damping, iterations, epsilon)
    sinks = base.join(out, F.col("node") == F.col("src"), "left_anti").select("node")
    rank = base.select("node", (1 / F.col("n")).alias("rank"))
    for i in range(iterations):
        flow = links.join(rank, F.col("src") == F.col("node")).groupBy("hub").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        moved = flow.join(into, "hub").groupBy("dst").agg(F.sum("flow").alias("got"))
        lost = rank.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        new = base.join(moved, F.col("node") == F.col("dst"), "left").join(F.broadcast(lost))  # one row
        new = new.select("node", ((1 - damping) * F.col("jump") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("jump"))).alias("rank"))
        if epsilon is not None or i % every == every - 1:
            new = cut(new)
            if epsilon is not None:
                gap = new.alias("a").join(rank.alias("b"), "node").agg(F.sum(F.abs(F.col("a.rank") - F.col("b.rank")))).first()[0]
                if (gap or 0.0) < epsilon:
                    return new
        rank = new
    return rank


def top(ranks: DataFrame, k: int = 10) -> DataFrame:
    """The k highest, ties by node."""
    return ranks.orderBy(F.desc("rank"), "node").limit(k)


def _hops_in_one_task(both: DataFrame, source: str, bound: int, most: int | None) -> DataFrame:
    """The same search as below in one task, for graphs that surely fit."""

    def run(pdf):
        import pandas as pd

        near: dict[str, list[str]] = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            near.setdefault(a, []).append(b)
        found: dict[str, tuple[int, str | None]] = {source: (0, None)}
        front, i = [source], 0
        while front and len(found) <= bound and (most is None or i < most):
            i += 1
            fresh: dict[str, str] = {}
            for a in front:
                for b in near.get(a, ()):
                    if b not in found:
                        fresh[b] = min(a, fresh.get(b, a))
            found |= {b: (i, a) for b, a in fresh.items()}
            front = list(fresh)
        return pd.DataFrame({"node": list(found), "hops": [h for h, _ in found.values()], "parent": [a for _, a in found.values()]})

    # a row of the source's own, so that the task runs on graphs without edges too
    rows = both.union(both.sparkSession.createDataFrame([(source, source)], both.schema))
    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "node string, hops int, parent string")


def hops(edges: DataFrame, source: str, bound: int = 20_000, most: int | None = None, small: int = 500_000) -> DataFrame:
    """node, hops, parent: fewest hops from `source`, direction ignored; the parent is the least node one hop nearer.

    Stops when nothing new is found, after `most` hops if given, or past `bound` visited nodes (then farther nodes are
    missing, and the result has more than `bound` rows). Graphs of at most `small` edges, which are counted, run in one task.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    if both.count() <= small:
        return cut(_hops_in_one_task(both, source, bound, most))
    found = both.sparkSession.createDataFrame([(source, 0, None)], "node string, hops int, parent string")
    front, i = found, 0
    while most is None or i < most:
        i += 1
        step = both.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front = cut(step.join(found, "node", "left_anti").select("node", F.lit(i).alias("hops"), "parent"))
        if front.isEmpty():
            break
        found = cut(found.unionByName(front))
        if found.count() > bound:
            break
    return found


class Exhausted(Exception):
    """A search stopped at its bound, so that it does not know whether there is a path."""


def shortest_path(edges: DataFrame, source: str, target: str, bound: int = 20_000, small: int = 500_000) -> DataFrame:
    """step, node, forward: the path's nodes in order, `forward` whether its edge leads from the node before to this one. Empty if none.

    Raises Exhausted if the target is not among the nodes visited up to `bound` and edges lead on from these.
    """
    found = cut(hops(edges, source, bound, small=small))
    path = found.where(F.col("node") == target).select("node", "hops", "parent")
    if path.isEmpty() and found.count() > bound:
        ends = edges.select("src", "dst").union(edges.select("dst", "src"))
        if not ends.join(found.select(F.col("node").alias("src")), "src", "left_semi").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").isEmpty():
            raise Exhausted(f"stopped past {bound} visited nodes")
    path = _walk(found, target, small)
    direct = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node"), F.lit(True).alias("d")).distinct()
    return path.join(direct, ["parent", "node"], "left").select(F.col("hops").alias("step"), "node", F.coalesce("d", F.lit(False)).alias("forward"))


def _walk(found: DataFrame, target: str, small: int) -> DataFrame:
    """node, hops, parent of `found` from `target` back to the source."""
    path = found.where(F.col("node") == target).select("node", "hops", "parent")
    if found.count() <= small:

        def back(pdf):
            rows = {n: (h, None if a != a else a) for n, h, a in zip(pdf["node"], pdf["hops"], pdf["parent"], strict=True)}
            at, kept = target if target in rows else None, []
            while at is not None:
                kept.append(at)
                at = rows[at][1]
            return pdf[pdf["node"].isin(kept)][["node", "hops", "parent"]]

        path = cut(found.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(back, "node string, hops int, parent string"))
    else:
        have = path
        while True:
            have = cut(found.join(have.select(F.col("parent").alias("node")), "node", "left_semi"))
            if have.isEmpty():
                break
            path = cut(path.unionByName(have))
    return path


def hub_hops(links: DataFrame, into: DataFrame, source: str, most: int | None = None) -> DataFrame:
    """node, hops, parent as hops gives them for the edges from src to dst that (src, hub) and (hub, dst) stand for.

    Direction is ignored, so a hub is passed from its sources to its ends or from its ends to its sources, which are two
    hubs here. A hub is passed once: whoever it leads to is then found.
    """
    links, into = cut(links.select("src", "hub").distinct()), cut(into.select("hub", "dst").distinct())
    on, back = F.concat(F.lit(">"), "hub"), F.concat(F.lit("<"), "hub")
    up = links.select(F.col("src").alias("node"), on.alias("hub")).union(into.select("dst", back))
    down = into.select(on.alias("hub"), F.col("dst").alias("node")).union(links.select(back, "src"))
    found = links.sparkSession.createDataFrame([(source, 0, None)], "node string, hops int, parent string")
    passed = links.sparkSession.createDataFrame([], "hub string")
    front, i = found, 0
    while most is None or i < most:
        i += 1
        reached = cut(up.join(front.select("node"), "node").groupBy("hub").agg(F.min("node").alias("parent")).join(passed, "hub", "left_anti"))
        step = down.join(reached, "hub").groupBy("node").agg(F.min("parent").alias("parent"))
        front = cut(step.join(found, "node", "left_anti").select("node", F.lit(i).alias("hops"), "parent"))
        if front.isEmpty():
            break
        found, passed = cut(found.unionByName(front)), passed.unionByName(reached.select("hub"))
    return found


def hub_path(links: DataFrame, into: DataFrame, source: str, target: str, small: int = 500_000) -> DataFrame:
    """step, node, forward as shortest_path gives them, by hub_hops."""
    path = cut(_walk(hub_hops(links, into, source), target, small))
    ahead = path.select("parent", "node").join(links.select(F.col("src").alias("parent"), "hub"), "parent").join(into.withColumnRenamed("dst", "node"), ["hub", "node"])
    ahead = ahead.select("parent", "node", F.lit(True).alias("d")).distinct()
    return path.join(ahead, ["parent", "node"], "left").select(F.col("hops").alias("step"), "node", F.coalesce("d", F.lit(False)).alias("forward"))


def hub_cycles(links: DataFrame, into: DataFrame, small: int = 500_000) -> DataFrame:
    """node, component as cycle_groups gives them: the components with the hubs between, which are no nodes of the result.
    A marked file sorts before a marked hub, and a component with a hub has a file, so its least node is a file."""
    file, hub = (lambda c: F.concat(F.lit("a:"), c)), F.concat(F.lit("b:"), "hub")
    both = links.select(file("src").alias("src"), hub.alias("dst")).union(into.select(hub, file("dst")))
    found = cycle_groups(both, small).where(F.col("node").startswith("a:"))
    bare = lambda c: F.substr(c, F.lit(3)).alias(c)
    alone = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(alone, "component").select(bare("node"), bare("component"))


def neighbourhood(edges: DataFrame, seed: str, distance: int = 2) -> DataFrame:
    """node, hops: nodes within `distance` hops, direction ignored."""
    return hops(edges, seed, bound=1 << 62, most=distance).select("node", "hops")


def _cycles_in_one_task(left: DataFrame) -> DataFrame:
    """The components by Tarjan's algorithm in one task, for graphs that surely fit."""

    def run(pdf):
        import pandas as pd

        near: dict[str, list[str]] = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            near.setdefault(a, []).append(b)
        order: dict[str, int] = {}
        low: dict[str, int] = {}
        stack: list[str] = []
        on: set[str] = set()
        rows: list[tuple[str, str]] = []
        for root in near:
            if root in order:
                continue
            order[root] = low[root] = len(order)
            stack.append(root)
            on.add(root)
            calls = [(root, iter(near[root]))]
            while calls:
                a, rest = calls[-1]
                for b in rest:
                    if b not in order:
                        order[b] = low[b] = len(order)
                        stack.append(b)
                        on.add(b)
                        calls.append((b, iter(near.get(b, ()))))
                        break
                    if b in on:
                        low[a] = min(low[a], order[b])
                else:
                    calls.pop()
                    if calls:
                        low[calls[-1][0]] = min(low[calls[-1][0]], low[a])
                    if low[a] == order[a]:
                        at = len(stack) - 1
                        while stack[at] != a:
                            at -= 1
                        group = stack[at:]
                        del stack[at:]
                        on.difference_update(group)
                        if len(group) > 1:
                            rows += [(n, min(group)) for n in group]
        return pd.DataFrame(rows, columns=["node", "component"])

    return left.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "node string, component string")


def cycle_groups(edges: DataFrame, small: int = 500_000) -> DataFrame:
    """node, component: strongly connected components of at least two nodes, named by their least node.

    Graphs of at most `small` edges, which are counted, run in one task. Else trims nodes without in- or out-edges, then
    spreads the least label forward and finds who reaches that label's node backward within it; what is found is one
    component for each label left, and edges between labels lie in no cycle, so the rest goes on without them. Labels are
    hashes that change with the round, so that a chain of components falls apart in a few rounds. Every round finds at least
    one component, and rounds go on until no edge is left.
    """
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    if left.count() <= small:
        return cut(_cycles_in_one_task(left))
    done = left.sparkSession.createDataFrame([], "node string, component string")
    turn = 0
    while True:
        turn += 1
        while True:
            kept = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if kept.count() == left.count():
                drop(kept)
                break
            drop(left)
            left = kept
        if left.isEmpty():
            break
        label = F.concat(F.hex(F.xxhash64("node", F.lit(turn))), F.lit("|"), F.col("node"))
        colour = cut(left.select(F.col("src").alias("node")).distinct().withColumn("own", label).withColumn("colour", F.col("own")))
        while True:
            near = left.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("colour").alias("c"))
            new = cut(colour.join(near, F.col("node") == F.col("dst"), "left").select("node", "own", F.least("colour", "c").alias("now"), "colour"))
            colour = new.select("node", "own", F.col("now").alias("colour"))
            if new.where("now <> colour").isEmpty():
                break
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour"))
        inside = cut(inside)
        member = cut(colour.where("own = colour").select("node", "colour"))
        while True:
            back = inside.join(member.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            more = cut(member.unionByName(back).distinct())
            if more.count() == member.count():
                break
            member = more
        sizes = member.groupBy("colour").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("component"))
        done = cut(done.unionByName(member.join(sizes, "colour").where("n > 1").select("node", "component")))
        before = left
        left = cut(inside.join(member.select(F.col("node").alias("src")), "src", "left_anti").join(member.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        drop(before)
        drop(inside)
    return done


def symmetrise(edges: DataFrame) -> DataFrame:
    """a, b, weight: both directions summed; each unordered pair appears twice."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").union(edges.select("dst", "src", "weight")).where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def partition_score(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """community, members, internal, total, q: q is each community's share of modularity; they sum to Q.

    internal is the symmetrised weight inside, total the degrees; q = internal / 2m - resolution * (total / 2m) ** 2.
    """
    if not resolution > 0 or resolution == float("inf"):
        raise ValueError("resolution must be finite and above 0")
    both = symmetrise(edges)
    of = membership.select("node", "community")
    ends = both.join(of.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    sums = ends.groupBy(F.col("ca").alias("community")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("internal"), F.sum("weight").alias("total"))
    m2 = both.agg(F.sum("weight").alias("m2"))
    sizes = of.groupBy("community").agg(F.count(F.lit(1)).alias("members"))
    rows = sizes.join(sums, "community", "left").join(F.broadcast(m2))  # one row
    inside, total = F.coalesce("internal", F.lit(0.0)), F.coalesce("total", F.lit(0.0))
    q = inside / F.col("m2") - F.lit(resolution) * (total / F.col("m2")) * (total / F.col("m2"))
    return rows.select("community", "members", F.round(inside, 6).alias("internal"), F.round(total, 6).alias("total"), F.round(q, 6).alias("q"))


def community_labels(membership: DataFrame) -> DataFrame:
    """community, label: the deepest folder that holds more than half of the members' paths, else `repository root`."""
    parts = F.split("node", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix")))
    sizes = membership.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    some = membership.where(F.size(parts) > 1).select("community", F.explode(prefixes).alias("p"))
    counts = some.groupBy("community", "p.depth", "p.prefix").agg(F.count(F.lit(1)).alias("c")).join(sizes, "community").where("c >= floor(n / 2) + 1")
    best = counts.groupBy("community").agg(F.min(F.struct((-F.col("depth")).alias("d"), F.col("prefix"))).alias("b"))
    return sizes.join(best, "community", "left").select("community", F.col("n").alias("members"), F.coalesce("b.prefix", F.lit("repository root")).alias("label"))


def communities(edges: DataFrame, resolution: float = 1.0, max_passes: int = 50, max_nodes: int = 200_000, max_edges: int = 2_000_000) -> DataFrame:
    """node, community by one level of greedy local moves in node order; a community is named by its least node.

    Each move depends on the one before, so this is one task's work by nature; graphs of more than `max_nodes` nodes or
    `max_edges` edges are refused rather than gathered. Strict improvements above 1e-12 only, so the result does not depend on row order.
    """
    both = cut(symmetrise(edges))
    if both.select("a").distinct().count() > max_nodes or both.count() > 2 * max_edges:
        raise ValueError(f"greedy moves are sequential; at most {max_nodes} nodes and {max_edges} edges")

    def run(pdf):
        import pandas as pd

        near: dict[str, list[tuple[str, float]]] = {}
        for a, b, w in sorted(zip(pdf["a"], pdf["b"], pdf["weight"], strict=True)):
            near.setdefault(a, []).append((b, w))
        degree = {a: sum(w for _, w in x) for a, x in near.items()}
        m2 = sum(degree.values())
        home = {a: a for a in near}
        total = dict(degree)
        for _ in range(max_passes):
            moved = False
            for a in sorted(near):
                old = home[a]
                total[old] -= degree[a]
                to: dict[str, float] = {old: 0.0}
                for b, w in near[a]:
                    to[home[b]] = to.get(home[b], 0.0) + w
                gain = {c: w - resolution * degree[a] * total[c] / m2 for c, w in to.items()}
                best, value = old, gain[old]
                for c in sorted(gain):
                    if gain[c] > value + 1e-12:
                        best, value = c, gain[c]
                home[a] = best
                total[best] += degree[a]
                moved |= best != old
            if not moved:
                break
        least: dict[str, str] = {}
        for a in sorted(home):
            least.setdefault(home[a], a)
        return pd.DataFrame({"node": sorted(home), "community": [least[home[a]] for a in sorted(home)]})

    return both.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "node string, community string")


def drawn(edges: DataFrame, ranks: DataFrame, max_nodes: int = 200, max_edges: int = 600) -> DataFrame:
    """src, dst, kind, weight, ord: what a bounded drawing shows: edges between the best nodes, imports first, then by weight."""
    best = ranks.orderBy(F.desc("rank"), "node").limit(max_nodes).select("node")
    kept = edges.join(best.withColumnRenamed("node", "src"), "src", "left_semi").join(best.withColumnRenamed("node", "dst"), "dst", "left_semi")
    first = kept.orderBy("kind", F.desc("weight"), "src", "dst").limit(max_edges)
    return first.select("src", "dst", "kind", "weight", F.row_number().over(W.orderBy("kind", F.desc("weight"), "src", "dst")).alias("ord"))


def listed_cycles(components: DataFrame, limit: int = 20) -> DataFrame:
    """place, length, files of the first `limit` cycles (node, component), the shortest first, then by their least file."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("length"), F.min("node").alias("first"))
    best = sizes.orderBy("length", "first").limit(limit)
    rows = components.join(F.broadcast(best), "component")  # `limit` rows
    listed = rows.groupBy("component", "length", "first").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("files"))
    return listed.withColumn("place", F.row_number().over(W.orderBy("length", "first"))).select("place", "length", "files")


def listed_communities(members: DataFrame, shown: int = 12, limit: int = 20) -> DataFrame:
    """place, community, size, members: the first `limit` communities (node, community), the largest first, then by their
    least member; each with its first `shown` members."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    best = sizes.orderBy(F.desc("size"), "first").limit(limit)
    near = first_members(members.join(F.broadcast(best.select("community")), "community", "left_semi"), "community", "node", shown)  # `limit` rows
    text = near.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members"))
    placed = best.withColumn("place", F.row_number().over(W.orderBy(F.desc("size"), "first")))
    return placed.join(text, "community").select("place", "community", "size", "members")
