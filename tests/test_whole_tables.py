"""Queries over a few rows of our own, none of whose keys a modulo filter would keep, against brute force on all of them."""

import random
from collections import defaultdict

import pytest
from callatlas.plans.queries import QUERIES

from test_graph import bfs, dijkstra


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(7)
    orders = [(k, rng.randint(1, 9)) for k in range(1, 40) if k % 10]
    lines = [(k, n, 25 * rng.randint(1, 12), rng.randint(1, 6), rng.choice("ANR"), rng.choice("FO")) for k, _ in orders for n in range(1, rng.randint(2, 8))]
    suppliers = [(k, k % 3) for k in range(1, 7)]
    turns = [(c, n, rng.choice(["user", "assistant"])) for c in range(3) for n in range(12 * c + 2)]
    at = tmp_path_factory.mktemp("whole")
    for name, rows, schema in (
        ("orders", orders, "o_orderkey bigint, o_custkey bigint"),
        ("lineitem", lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string"),
        ("supplier", suppliers, "s_suppkey bigint, s_nationkey bigint"),
        ("customer", [(k,) for k in range(1, 10)], "c_custkey bigint"),
        ("part", [(25 * k, f"name {25 * k}", 25 * k) for k in range(1, 13)], "p_partkey bigint, p_name string, p_size int"),
        ("conversations", turns, "conv_id bigint, turn int, role string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at), orders, lines, suppliers, turns


@pytest.fixture(scope="module")
def purchases(tables):
    """weight and ord of each pair."""
    _, orders, lines, suppliers, _ = tables
    owner, weight, first = dict(orders), defaultdict(lambda: 9), defaultdict(lambda: 1 << 60)
    calls = [(f"s{s}", f"n{n}", 1, s) for s, n in suppliers]
    for k, n, p, s, flag, status in lines:
        calls += [(f"c{owner[k]}", f"p{p}", {"A": 1, "N": 2, "R": 3}[flag], k * 8 + n), (f"p{p}", f"s{s}", 1 if status == "F" else 2, k * 8 + n)]
    for a, b, w, o in calls:
        weight[a, b], first[a, b] = min(w, weight[a, b]), min(o, first[a, b])
    return weight, first


def test_distances_paths_and_levels_of_all_orders(spark, tables, purchases):
    weight, first = purchases
    roots = [f"c{k}" for k in range(1, 10)]
    want = dijkstra([(a, b, w) for (a, b), w in weight.items()], roots)
    assert {r["method"]: (r["dist"], r["pred"]) for r in QUERIES["weighted_distance"](spark, tables[0]).collect()} == want
    paths = {r["method"]: (r["dist"], r["path"]) for r in QUERIES["weighted_paths"](spark, tables[0]).collect()}

    def path(m):
        return m if want[m][1] is None else f"{path(want[m][1])}>{m}"

    assert paths == {m: (want[m][0], path(m)) for m in want}
    levels = bfs(sorted(weight, key=lambda e: first[e]), roots)
    assert {r["method"]: r["level"] for r in QUERIES["bfs_levels"](spark, tables[0]).collect()} == {m: x[0] for m, x in levels.items()}


def test_neighbours_of_every_hundredth_part(spark, tables, purchases):
    up, down, want = defaultdict(set), defaultdict(set), {}
    for a, b in purchases[0]:
        up[b].add(a)
        down[a].add(b)
    for start in ("p100", "p200", "p300"):
        one = {(m, "caller") for m in up[start]} | {(m, "callee") for m in down[start]}
        two = {x for m, _ in one for x in [(c, "caller") for c in up[m]] + [(c, "callee") for c in down[m]]} - one
        for hop, found in ((1, one), (2, two)):
            for _, d in found:
                want[start, d, hop] = want.get((start, d, hop), 0) + 1
    assert {(r["start"], r["direction"], r["hop"]): r["n"] for r in QUERIES["k_hop_callers_callees"](spark, tables[0]).collect()} == want


def test_slices_of_all_orders(spark, tables):
    have = {(k, n) for k, n, *_ in tables[2]}
    want = {(f"seed{k}", str(n)) for k, m in have if m == 4 for n in range(1, 5)}
    assert {tuple(r) for r in QUERIES["backward_slice_orders"](spark, tables[0]).collect()} == want


def test_flows_of_all_orders(spark, tables):
    want = {}
    for k, n, p, _, flag, _ in tables[2]:
        want.setdefault(k, []).append((n, p, flag))
    got = {r["flow_id"]: r for r in QUERIES["composed_flows"](spark, tables[0]).collect()}
    assert set(got) == set(want)
    for k, lines in want.items():
        text = ["not analysed" if flag == "R" else f"name {p}" for _, p, flag in sorted(lines)]
        sinks = [f"<android.p{p}>" for _, p, flag in sorted(lines) if flag == "R"]
        assert (got[k]["n_methods"], got[k]["summary"], got[k]["sink"]) == (len(lines), " → ".join(text), sinks[-1] if sinks else None)


def test_support_of_all_orders(spark, tables):
    have = {(k, n) for k, n, *_ in tables[2]}
    missing = {k: "|".join(str(n) for n in (1, 3, 5, 7) if (k, n) not in have) for k, _ in tables[1]}
    assert {tuple(r) for r in QUERIES["missing_support"](spark, tables[0]).collect()} == {x for x in missing.items() if x[1]}
    assert {tuple(r) for r in QUERIES["evidence_verified"](spark, tables[0]).collect()} == {(k, "VERIFIED" if (k, 1) in have else "FAILED") for k in missing}


def test_artifacts_of_all_turns(spark, tables):
    want = {(f"c{c}", "file", f"cacheDir/r{role}.db") for c, _, role in tables[4]} | {(f"c{c}", "log", f"T{n}:said") for c, n, _ in tables[4]}
    assert {tuple(r) for r in QUERIES["source_file_artifacts"](spark, tables[0]).collect()} == want
