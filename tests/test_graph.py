import heapq
import random
from collections import defaultdict, deque

import pytest
from callatlas.plans import graph as G


def dijkstra(edges, roots):
    out = defaultdict(list)
    for a, b, w in edges:
        out[a].append((b, w))
    dist, pred, queue, settled = dict.fromkeys(roots, 0), {}, [(0, r) for r in sorted(roots)], set()
    while queue:
        d, u = heapq.heappop(queue)
        if u in settled:
            continue
        settled.add(u)
        for v, w in out[u]:
            if v not in dist or d + w < dist[v]:
                dist[v], pred[v] = d + w, u
                heapq.heappush(queue, (d + w, v))
    return {v: (d, pred.get(v)) for v, d in dist.items()}


def bfs(edges, roots):
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    seen, queue = {r: (0, r) for r in sorted(roots)}, deque(sorted(roots))
    while queue:
        u = queue.popleft()
        for v in out[u]:
            if v not in seen:
                seen[v] = (seen[u][0] + 1, seen[u][1])
                queue.append(v)
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_paths_match_a_heap_and_a_queue(spark, seed):
    rng = random.Random(seed)
    names = [f"m{k:02d}" for k in range(30)]
    pairs = list({(rng.choice(names), rng.choice(names)) for _ in range(55)})
    rng.shuffle(pairs)
    edges = [(a, b, rng.choice([1, 2, 3])) for a, b in pairs]
    roots = ["m03", "m11", "m29"]
    e = spark.createDataFrame([("x", a, b, w, k) for k, (a, b, w) in enumerate(edges)], "analysis_id string, caller string, callee string, weight bigint, ord bigint")
    r = spark.createDataFrame([("x", m) for m in roots], "analysis_id string, method string")
    reached = G.weighted_distances(e, r)
    want = dijkstra(edges, roots)
    assert {x["method"]: (x["dist"], x["pred"]) for x in reached.collect()} == want
    for x in G.paths(reached, most=3).collect():
        path, m = [], x["method"]
        while m:
            path.append(m)
            m = want[m][1]
        assert (x["hops"], list(x["path"])) == (len(path) - 1, path[::-1][:3])
    assert {x["method"]: (x["level"], x["root"]) for x in G.bfs_roots(e, r).collect()} == bfs(pairs, roots)


def test_slice_closure_and_ancestors(spark):
    units = spark.createDataFrame([("m", "a", ["b"]), ("m", "b", ["c", "a"]), ("m", "c", []), ("m", "d", ["e"]), ("m", "e", [])], "method string, unit_id string, succs array<string>")
    seeds = spark.createDataFrame([("s", "m", "c")], "seed_id string, method string, unit_id string")
    assert {r["unit_id"] for r in G.backward_slice(units, seeds).collect()} == {"a", "b", "c"}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "child string, parent string")
    assert {tuple(r) for r in G.closure(links).collect()} == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None)], "method string, pred string")
    marked = spark.createDataFrame([("c", "Main")], "method string, component string")
    assert {tuple(r) for r in G.nearest_ancestor(chain, marked).collect()} == {("a", "Main", 2), ("b", "Main", 1), ("c", "Main", 0)}


def test_strict_is_preferred_and_edges_unite(spark):
    schema = "analysis_id string, method string, dist bigint, pred string"
    strict = spark.createDataFrame([("x", "a", 5, "p")], schema)
    wide = spark.createDataFrame([("x", "a", 2, "q"), ("x", "b", 3, "a")], schema)
    assert {tuple(r) for r in G.strict_preferred(strict, wide).collect()} == {("x", "a", 5, "p", "strict"), ("x", "b", 3, "a", "augmented")}
    e = lambda rows: spark.createDataFrame(rows, "caller string, callee string, callsite string, ord int, kind string")
    united = G.union_edges(e([("a", "b", "u", 9, "first")]), e([("a", "b", "u", 1, "second"), ("a", "b", "v", 1, "second")]))
    assert {(r["callsite"], r["kind"]) for r in united.collect()} == {("u", "first"), ("v", "second")}
    dot = G.to_dot(spark.createDataFrame([("x", 0, "a", "b")], "analysis_id string, ord int, caller string, callee string")).first()["dot"]
    assert dot == 'digraph {\n  "a" -> "b";\n}'


def test_analyses_stay_apart(spark):
    """Edges a to b of one analysis and b to c of another make no path; so for links, chains, slices, listeners and hints."""
    from callatlas.operators import components as C
    from callatlas.operators import hits as H

    df = spark.createDataFrame
    edges = df([("x", "a", "b"), ("y", "b", "c")], "analysis_id string, caller string, callee string")
    starts = df([("x", "a"), ("y", "a")], "analysis_id string, method string")
    assert {(r["analysis_id"], r["method"]) for r in G.k_hop(edges, starts, 2).where("method <> 'a'").collect()} == {("x", "b")}
    links = df([("x", "a", "b"), ("y", "b", "c")], "analysis_id string, child string, parent string")
    assert {(r["analysis_id"], r["child"], r["ancestor"]) for r in G.closure(links).collect()} == {("x", "a", "b"), ("y", "b", "c")}
    chain = df([("x", "a", "b"), ("x", "b", None), ("y", "b", None)], "analysis_id string, method string, pred string")
    assert [(r["analysis_id"], r["method"]) for r in G.nearest_ancestor(chain, df([("y", "b", "k")], "analysis_id string, method string, component string")).collect()] == [("y", "b")]
    units = df([("x", "m", "1", ["2"]), ("y", "m", "0", ["1"])], "analysis_id string, method string, unit_id string, succs array<string>")
    assert {r["unit_id"] for r in G.backward_slice(units, df([("s", "x", "m", "2")], "seed_id string, analysis_id string, method string, unit_id string")).collect()} == {"1", "2"}
    both = df([("x", "a", "b", "", 0), ("y", "a", "b", "", 1)], "analysis_id string, caller string, callee string, callsite string, ord int")
    assert G.union_edges(both).count() == 2
    reg = df([("x", "<a.A: void m()>", "u", "L")], "analysis_id string, caller string, callsite string, listener string")
    imp = df([("x", "L", "a.A", "in"), ("y", "L", "a.A", "other")], "analysis_id string, listener string, class string, method string")
    assert [r["callee"] for r in C.listener_edges(reg, imp).collect()] == ["in"]
    hints = df([("y", "a.A", "h")], "analysis_id string, class string, hint string")
    assert {(r["analysis_id"], tuple(r["hints"])) for r in C.hints_for(df([("x", "a.A"), ("y", "a.A$1")], "analysis_id string, class string"), hints).collect()} == {("x", ()), ("y", ("h",))}
    e = df([(n, 1, "<a.A: void m()>", "<p.Sub: void s()>") for n in "xy"], "analysis_id string, ord int, caller string, callee string")
    catalog = df([("C1", "HIGH", 0.5, "<p.Q: void s()>")], "category_id string, priority string, weight double, signature string")
    sub = df([("x", "p.Sub", "p.Q")], "analysis_id string, class string, supertype string")
    assert [r["analysis_id"] for r in H.hierarchy_matches(e, catalog, sub).collect()] == ["x"]
