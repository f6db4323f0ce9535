"""Graph operators against the plain fixpoint rules on random graphs, many in one job."""

import random
from collections import defaultdict

import pytest

from tracewright.operators import definitions as defs
from tracewright.operators import dominance as dom
from tracewright.operators import graphs as gr
from tracewright.operators import parent_map as pm

NODES = "graph_id string, node string, label string, ord int"
EDGES = "graph_id string, src string, dst string"
START, END = "Method Start: m", "Method End: m"


def frames(spark, graphs):
    """``{id: (labels by node, edges)}`` as node and edge tables."""
    nodes = [
        (g, n, label, i) for g, (labels, _) in graphs.items() for i, (n, label) in enumerate(labels.items())
    ]
    edges = [(g, a, b) for g, (_, es) in graphs.items() for a, b in es]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def starts_of(nodes):
    return nodes.where("label LIKE 'Method Start:%'").select("graph_id", "node")


def random_graphs(count, seed):
    rng = random.Random(seed)
    graphs = {}
    for g in range(count):
        n = rng.randint(2, 9)
        names = [f"n{i}" for i in range(n)]
        labels = {name: rng.choice(["for-cond: c", "x_1 = y_2", "x_3 = x_1", "if c"]) for name in names}
        labels[names[0]] = START
        labels[rng.choice(names[1:])] = END
        edges = {(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(n - 1, 2 * n))}
        graphs[f"g{g}"] = (labels, edges)
    return graphs


def maps(edges):
    succ, pred = defaultdict(set), defaultdict(set)
    for a, b in edges:
        succ[a].add(b)
        pred[b].add(a)
    return succ, pred


def greatest(nodes, fixed, rule):
    """Largest sets with ``sets[n] = {n} | meet``; ``fixed`` nodes have only themselves."""
    full = set(nodes)
    sets = {n: {n} if n in fixed else set(full) for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            if n in fixed:
                continue
            meet = set(full)
            for m in rule(n):
                meet &= sets[m]
            if sets[n] != meet | {n}:
                sets[n], changed = meet | {n}, True
    return sets


def reach(succ, start):
    seen, todo = {start}, [start]
    while todo:
        for m in succ[todo.pop()] - seen:
            seen.add(m)
            todo.append(m)
    return seen


def rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def expected_pairs(graphs, backward):
    """Pairs of reached nodes, and the nodes that are not reached."""
    pairs, lost = set(), set()
    for g, (labels, edges) in graphs.items():
        succ, pred = maps(edges)
        if backward:
            end = next(n for n, label in labels.items() if label == END)
            sinks = {end} | {n for n in labels if not succ[n]}
            sets = greatest(list(labels), sinks, lambda n: succ[n])
            back = {(b, a) for a, b in edges if a != end}
            reached = set().union(*(reach(maps(back)[0], s) for s in sinks))
        else:
            start = next(n for n, label in labels.items() if label == START)
            sets = greatest(list(labels), {start}, lambda n: pred[n])
            reached = reach(succ, start)
        pairs |= {(g, n, d) for n in reached for d in sets[n]}
        lost |= {(g, n) for n in labels if n not in reached}
        # the rule gives every node to an unreached one
        assert all(sets[n] == set(labels) for n in labels if n not in reached)
    return pairs, lost


#: All graphs in tasks, and the larger ones by rounds over tables.
WAYS = pytest.mark.parametrize("graph_rows", [200_000, 12])


@WAYS
@pytest.mark.parametrize("backward", [False, True])
def test_dominance_on_random_graphs(spark, backward, graph_rows):
    graphs = random_graphs(150, seed=11 + backward)
    nodes, edges = frames(spark, graphs)
    if backward:
        got = dom.postdominators(nodes, edges, graph_rows)
        tree = dom.postdominance_tree(nodes, edges, graph_rows)
    else:
        got = dom.dominators(edges, starts_of(nodes), graph_rows)
        tree = dom.dominance_tree(edges, starts_of(nodes), graph_rows)
    pairs, lost = expected_pairs(graphs, backward)
    assert rows(got, "graph_id", "node", "dom") == pairs
    assert rows(dom.unreached(nodes, got), "graph_id", "node") == lost
    closest = {}
    strict = defaultdict(set)
    for g, n, d in pairs:
        if n != d:
            strict[g, n].add(d)
    for (g, n), ds in strict.items():
        closest[g, n] = next(
            d for d in ds if not any((g, o, d) in pairs for o in ds if o != d)
        )
    idoms = {(r.graph_id, r.node): r.idom for r in dom.immediate(nodes, got).collect()}
    assert idoms == {(g, n): closest.get((g, n)) for g, (ls, _) in graphs.items() for n in ls}
    assert {(r.graph_id, r.node, r.idom) for r in tree.collect()} == {(g, n, closest.get((g, n))) for g, n, _ in pairs}


def walked_dependence(labels, edges):
    """Control dependence by walking up immediate postdominators, for one method."""
    succ, _ = maps(edges)
    start = next(n for n, label in labels.items() if label == START)
    inside = reach(succ, start)
    if not any(labels[n] == END for n in inside):
        return set()
    part = {n: labels[n] for n in labels if n in inside}
    links = {(a, b) for a, b in edges if a in inside and b in inside}
    succ, _ = maps(links)
    end = next(n for n, label in part.items() if label == END)
    sinks = {end} | {n for n in part if not succ[n]}
    back, _ = maps({(b, a) for a, b in links if a != end})
    reached = set().union(*(reach(back, s) for s in sinks))
    sets = greatest(list(part), sinks, lambda n: succ[n])
    ipdom = {}
    for n in part:
        strict = sets[n] - {n} if n in reached else set()
        ipdom[n] = next(
            (d for d in strict if not any(d in sets[o] for o in strict if o != d)), None
        )
    found = set()
    for x in part:
        if len(succ[x]) < 2:
            continue
        for y in succ[x]:
            if y == ipdom[x] and part[x].startswith("for-cond:"):
                found.add((x, y))
                continue
            w = y
            while w is not None and w not in (x, ipdom[x]):
                found.add((x, w))
                w = ipdom[w]
    covered = {d for _, d in found}
    return found | {(start, n) for n in part if n != start and n not in covered}


@WAYS
def test_control_dependence_on_random_graphs(spark, graph_rows):
    graphs = random_graphs(150, seed=5)
    nodes, edges = frames(spark, graphs)
    expected = {
        (g, c, d) for g, (labels, es) in graphs.items() for c, d in walked_dependence(labels, es)
    }
    got = dom.control_dependence(nodes, edges, graph_rows)
    assert rows(got, "graph_id", "controller", "dependent") == expected


@WAYS
def test_reaching_definitions_on_random_graphs(spark, graph_rows):
    graphs = random_graphs(100, seed=8)
    nodes, edges = frames(spark, graphs)
    made = {"x_1 = y_2": {("x", 1), ("y", 2)}, "x_3 = x_1": {("x", 3), ("x", 1)}}
    expected = set()
    for g, (labels, es) in graphs.items():
        _, pred = maps(es)
        gen = {n: made.get(label, set()) for n, label in labels.items()}
        out = {n: set(gen[n]) for n in labels}
        changed = True
        while changed:
            changed = False
            for n in labels:
                top = {v: max(k for w, k in gen[n] if w == v) for v, _ in gen[n]}
                arriving = set().union(*(out[p] for p in pred[n]))
                new = {(v, k) for v, k in arriving if k >= top.get(v, 0)} | gen[n]
                if new != out[n]:
                    out[n], changed = new, True
        expected |= {(g, n, v, k) for n in labels for v, k in out[n]}
    got = defs.reaching_definitions(nodes, edges, graph_rows)
    assert rows(got, "graph_id", "node", "var", "version") == expected


LINEAR = ({"1": START, "2": "a", "3": END}, [("1", "2"), ("2", "3")])
DIAMOND = (
    {"1": START, "2": "if", "3": "a", "4": "b", "5": END},
    [("1", "2"), ("2", "3"), ("2", "4"), ("3", "5"), ("4", "5")],
)
IF = (
    {"1": START, "2": "if x > 0", "3": "return x", "4": END},
    [("1", "2"), ("2", "3"), ("3", "4"), ("2", "4")],
)
WHILE = (
    {"1": START, "2": "while", "3": "body", "4": END},
    [("1", "2"), ("2", "3"), ("3", "2"), ("2", "4")],
)
NESTED = (
    {"1": START, "2": "if", "3": "while", "4": "body", "5": END},
    [("1", "2"), ("2", "3"), ("3", "4"), ("4", "3"), ("3", "5"), ("2", "5")],
)
LONG = (
    {f"n{i:02}": START if i == 0 else END if i == 39 else "s" for i in range(40)},
    [(f"n{i:02}", f"n{i + 1:02}") for i in range(39)],
)


def test_known_graphs_in_one_job(spark):
    nodes, edges = frames(
        spark, {"linear": LINEAR, "diamond": DIAMOND, "if": IF, "while": WHILE, "nested": NESTED}
    )
    pairs = dom.dominators(edges, starts_of(nodes))
    found = rows(pairs, "graph_id", "node", "dom")
    assert {("linear", "2", "1"), ("linear", "3", "1"), ("linear", "3", "2")} <= found
    idoms = dom.immediate_dominators(nodes, pairs)
    tree = rows(dom.dominator_tree(idoms), "graph_id", "src", "dst")
    assert {t for t in tree if t[0] == "diamond"} == {
        ("diamond", "1", "2"), ("diamond", "2", "3"), ("diamond", "2", "4"), ("diamond", "2", "5"),
    }
    assert {t for t in tree if t[0] == "linear"} == {("linear", "1", "2"), ("linear", "2", "3")}
    lines = {r.line for r in dom.dominator_listing(pairs).collect()}
    assert "3 is dominated by: 1 2 3" in lines
    control = rows(dom.control_dependence(nodes, edges), "graph_id", "controller", "dependent")
    assert ("if", "2", "3") in control and ("if", "2", "4") not in control
    assert ("while", "2", "3") in control
    assert ("nested", "2", "3") in control and ("nested", "3", "4") in control
    assert ("linear", "1", "2") in control


def test_long_chain_compacts_between_rounds(spark):
    nodes, edges = frames(spark, {"long": LONG})
    pairs = dom.dominators(edges, starts_of(nodes), graph_rows=0)
    assert pairs.count() == 40 * 41 // 2
    got = gr.reachable(edges, starts_of(nodes), graph_rows=0)
    assert got.count() == got.distinct().count() == 40


def test_deep_graphs_need_no_rounds(spark):
    n = 3000
    names = {f"n{i}": START if not i else END if i == n - 1 else "a" for i in range(n)}
    links = [(f"n{i}", f"n{i + 1}") for i in range(n - 1)]
    back = [(f"n{i}", f"n{i - i % 50}") for i in range(n) if i % 7 == 3]
    nodes, edges = frames(spark, {"deep": (names, links + back), "short": LINEAR})
    tree = {(r.graph_id, r.node): r.idom for r in dom.dominance_tree(edges, starts_of(nodes)).collect()}
    assert tree == {("deep", f"n{i}"): f"n{i - 1}" if i else None for i in range(n)} | {
        ("short", "1"): None,
        ("short", "2"): "1",
        ("short", "3"): "2",
    }
    assert gr.reachable(edges, starts_of(nodes)).count() == n + 3


def test_reachable_from_several_starts(spark):
    graphs = random_graphs(60, seed=21)
    nodes, edges = frames(spark, graphs)
    starts = nodes.where("ord % 3 = 1").select("graph_id", "node")
    found = [rows(gr.reachable(edges, starts, r), "graph_id", "node") for r in (200_000, 8, 0)]
    assert found[0] == found[1] == found[2]


def test_empty_graph(spark):
    nodes, edges = frames(spark, {})
    assert dom.control_dependence(nodes, edges).count() == 0
    assert gr.reachable(edges, starts_of(nodes)).count() == 0


def test_graph_without_exit_is_reported(spark):
    nodes, edges = frames(spark, {"open": ({"1": START, "2": "a"}, [("1", "2")]), "ok": LINEAR})
    assert rows(dom.graphs_without_exit(nodes), "graph_id") == {("open",)}
    assert {r.graph_id for r in dom.postdominators(nodes, edges).collect()} == {"ok"}


def test_two_methods_in_one_graph(spark):
    labels = {"a": START, "a2": "if", "a3": "b()", "ae": END, "b": "Method Start: b", "b2": "x"}
    edges = [("a", "a2"), ("a2", "a3"), ("a2", "ae"), ("a3", "ae"), ("b", "b2"), ("b2", "ae")]
    nodes, links = frames(spark, {"g": (labels, edges)})
    got = rows(dom.control_dependence(nodes, links), "controller", "dependent")
    assert got == {("a2", "a3"), ("a", "a2"), ("a", "ae"), ("b", "b2"), ("b", "ae")}


def test_adjacency_and_small_operators(spark):
    labels = {"1": START, "2": " Return x", "3": "lone", "4": "throw e"}
    nodes, edges = frames(spark, {"g": (labels, [("1", "2"), ("1", "2"), ("1", "4"), ("4", "1")])})
    near = {r.node: (r.predecessors, r.successors) for r in gr.adjacency(nodes, edges).collect()}
    assert near == {"1": (["4"], ["2", "4"]), "2": (["1"], []), "3": ([], []), "4": (["1"], ["1"])}
    assert rows(gr.branch_nodes(edges), "node", "n_successors") == {("1", 2)}
    assert rows(gr.terminal_nodes(nodes, edges), "node") == {("2",), ("3",), ("4",)}
    more, linked = gr.virtual_entry(nodes, edges)
    assert ("virtualEntry", "1") in rows(linked, "src", "dst")
    assert more.where("node = 'virtualEntry'").count() == 1
    kept = gr.subgraph_edges(edges.distinct(), nodes.where("node IN ('1', '4')"))
    assert rows(kept, "src", "dst") == {("1", "4"), ("4", "1")}


def test_call_sites(spark):
    labels = {
        "m": "Method Start: main", "f": "Method Start: f", "g": "Method Start: g",
        "1": "x = subf (1)", "2": "y = off(2) + g(f(3))", "3": "f(4)",
    }
    nodes, _ = frames(spark, {"p": (labels, [])})
    got = rows(gr.call_site_edges(nodes), "src", "dst")
    # "off(" contains "f(", as a plain text search has it
    assert got == {("virtualEntry", "m"), ("2", "f"), ("2", "g")}


def test_dot_lines(spark):
    nodes, edges = frames(spark, {"g": ({"a": 'f("x")', "b": "y\nz"}, [("a", "b"), ("a", "b")])})
    lines = gr.dot_lines(nodes, edges).orderBy("section", "at").collect()
    assert [r.line for r in lines] == [
        "digraph CFG {",
        r'  "a" [label="f\(\"x\"\)"];',
        '  "b" [label="y z"];',
        '  "a" -> "b";',
        "}",
    ]


def test_max_versions(spark):
    names = spark.createDataFrame(
        [("f", n) for n in ("x_1", "x_2_9", "x_10", "x", "xy_5", "x_a_3", "x_1_2_3")],
        "file string, name string",
    )
    wanted = spark.createDataFrame(
        [("f", v) for v in ("x", "x_2", "x_a", "z", "x_1")], "file string, var string"
    )
    got = rows(defs.max_versions(names, wanted, ["file"]), "var", "version")
    assert got == {("x", 10), ("x_2", 9), ("x_a", 3), ("z", 0), ("x_1", 2)}


def occurrences(spark, text):
    return pm.assignment_refs(spark.createDataFrame([("f", text)], "file string, text string"))


def parents(spark, text):
    return {r["var"]: r.refs for r in pm.parent_map(occurrences(spark, text)).collect()}


def test_parent_maps_from_text(spark):
    assert parents(spark, "int x_0 = 5;\nint y_1 = x_0 + 10;\nint z_1 = x_0 * y_1;") == {
        "x_0": [], "y_1": ["x_0"], "z_1": ["x_0", "y_1"],
    }
    assert parents(spark, "int result_1 = condition_1 ? a_1 : b_1;") == {
        "result_1": ["condition_1", "a_1", "b_1"]
    }
    assert parents(spark, "x_1 = 5;\nx_1 = y_1 + z_1;") == {"x_1": []}
    assert parents(spark, 'v = f(v, obj.field, "text", true, w) + w; u += v') == {
        "v": ["obj", "w"], "u": ["v"],
    }
    assert parents(spark, "if (a == b && c <= d) { }") == {}


def test_assignment_before_declaration_at_one_place(spark):
    rows_ = [("f", 1, 1, "declare", "x", ["b"]), ("f", 1, 1, "assign", "x", ["a"]), ("f", 2, 1, "assign", "x", ["c"])]
    df = spark.createDataFrame(
        rows_, "file string, line int, col int, kind string, var string, refs array<string>"
    )
    assert pm.parent_map(df).first().refs == ["a"]
