import difflib
import random

import pytest

from loomgraph import runtime
from loomgraph.operators import analysis, dedup
from loomgraph.plans.lowering import Graph, explained


def test_structural_search_binds_holes(spark):
    code = "def f(a):\n    if a is not None and a.x:\n        return g(a.x, a.x)\n    return g(a.x, a.y)\nprint(g(1, 1))\n"
    files = spark.createDataFrame([("a.py", code), ("b.py", "def (broken"), ("c.py", None)], "file string, text string")
    got = sorted((r["line"], r["found"], r["holes"]) for r in analysis.structural_search(files, "g($X, $X)").collect())
    assert got == [(3, "g(a.x, a.x)", {"X": "a.x"}), (5, "g(1, 1)", {"X": "1"})]
    assert [r["line"] for r in analysis.structural_search(files, "return g($A, $B)").orderBy("line").collect()] == [3, 4]
    with pytest.raises(ValueError, match="one statement"):
        analysis.structural_search(files, "a\nb")


def test_depth_first_walks_equal_a_stack(spark):
    r = random.Random(4)
    names = [f"n{i:02d}" for i in range(25)]
    edges = [(r.choice(names), r.choice(names)) for _ in range(40)] + [("hub", n) for n in names]
    nodes = spark.createDataFrame([(n,) for n in [*names, "hub"]], "id string")
    table = spark.createDataFrame([(i, a, b, "calls", "EXTRACTED", 1) for i, (a, b) in enumerate(edges)], "edge_id long, src string, dst string, relation string, confidence string, line int")
    near = {n: sorted({b for a, b in edges if a == n} | {a for a, b in edges if b == n}) for n in [*names, "hub"]}
    degree = {n: sum((a == n) + (b == n) for a, b in edges) for n in near}
    limit = max(10, sorted(degree.values())[int(len(degree) * 0.99)])
    got = {(x["start"], x["id"]): x["turn"] for x in analysis.guarded_dfs(nodes, table, nodes.where("id in ('n03', 'hub')"), 3, floor=10).collect()}
    for start in ("n03", "hub"):
        seen, todo = {}, [(start, 0)]
        while todo:
            n, d = todo.pop()
            if n in seen or d > 3:
                continue
            seen[n] = len(seen)
            if n == start or degree[n] < limit:
                todo += [(v, d + 1) for v in reversed(near[n]) if v not in seen]
        assert {i: t for (s, i), t in got.items() if s == start} == seen


def test_clones_equal_brute_force(spark):
    r = random.Random(7)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 30))
    base = [word() for _ in range(80)]
    rows = [(f"f{i}", [word() for _ in range(r.randint(40, 90))]) for i in range(8)] + [("x", base), ("y", [*base[:30], "new", *base[31:]]), ("z", [*base[:40], *[word() for _ in range(40)]]), ("w", base[:45])]
    got = {(x["a"], x["b"]): x["ratio"] for x in dedup.clones(spark.createDataFrame(rows, "name string, tokens array<string>")).collect()}
    long = [(n, t) for n, t in rows if len(t) >= 50]
    want = {}
    for a, s in long:
        for b, t in long:
            ratio = difflib.SequenceMatcher(None, s, t, autojunk=False).ratio()
            if a < b and ratio >= 0.9:
                want[a, b] = ratio
    assert got == want and want


def test_clones_of_copies_are_all_pairs_of_names(spark):
    """Copies, near copies of copies, and runs too frequent to be rare, against every pair of names."""
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 60))
    bases = [[word() for _ in range(60)] for _ in range(4)]
    rows = [(f"{'qz'[i % 2]}{i}{k}", [*b[: 10 * i], "new", *b[10 * i + 1 :]] if k % 3 == 0 else b) for i, b in enumerate(bases) for k in range(5)]
    rows += [(f"m{k}", [f"often{j}" for j in range(60)]) for k in range(23)]
    runs = {n: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} for n, t in rows}
    df = {}
    for own in runs.values():
        for x in own:
            df[x] = df.get(x, 0) + 1
    few = {n: {x for x in own if df[x] <= 20} for n, own in runs.items()}
    want = {}
    for a, s in rows:
        for b, t in rows:
            if a < b and few[a] & few[b] and 2 * len(few[a] & few[b]) >= min(len(few[a]), len(few[b])):
                ratio = difflib.SequenceMatcher(None, s, t, autojunk=False).ratio()
                if ratio >= 0.9:
                    want[a, b] = ratio
    found = dedup.clones(spark.createDataFrame(rows, "name string, tokens array<string>")).collect()
    assert {(x["a"], x["b"]): x["ratio"] for x in found} == want and len(found) == len(want) == 40
    # runs of the same rows are one row: far fewer than the runs and than their pairs
    held = [spark.read.parquet(p) for p in runtime._KEPT if "/runs-" in p]
    assert held and all(x.count() <= 40 for x in held[-1:])


def test_explained_rows_show_bindings_and_absence(spark):
    n = spark.createDataFrame([(x, x, x, "f", i, i, ["function"]) for i, x in enumerate("abcde")], "id string, label string, name string, source_file string, line int, line_end int, kinds array<string>")
    e = spark.createDataFrame([(i, "a", d, "calls", c, 1) for i, (d, c) in enumerate([("b", "INFERRED"), ("c", "EXTRACTED"), ("d", "EXTRACTED"), ("e", "EXTRACTED")])], "edge_id long, src string, dst string, relation string, confidence string, line int")
    g = Graph(n, e)
    (row,) = explained(g, "match (x)-[calls]->(y) return x, count(y)").collect()
    assert row["count_y"] == 4 and row["examples"] == ["x=a y=c", "x=a y=d", "x=a y=e"] and not row["absence"]
    assert all(r["absence"] for r in explained(g, "match (x) where not exists (x)-[]->() or x.line > 9 return x").collect())
    assert not any(r["absence"] for r in explained(g, "match (x) where not not exists (x)-[]->() return x").collect())
    (none,) = explained(g, "match (x) where x.id = 'q' return count(x)").collect()
    assert none["count_x"] == 0 and none["examples"] == []


def test_views_by_name(spark):
    n, e = spark.createDataFrame([("a", "tests/a.py")], "id string, source_file string"), spark.createDataFrame([], "src string, dst string")
    assert analysis.view("tests", n, e).count() == 1
    analysis.register_view("ids", lambda nodes, _: nodes.select("id"))
    assert analysis.view("ids", n, e).columns == ["id"]
    with pytest.raises(ValueError, match="no view"):
        analysis.view("nothing", n, e)
    assert analysis.contexts_of("Who calls the imported module?") == ["call", "import"]


def test_reaching_definitions_meet_one_table_a_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(analysis, "saved", lambda df, name="step", real=analysis.saved: (made.append(name), real(df, name))[1])
    hops = [(1, 2), (2, 3), (3, 2), (3, 3), (3, 4), (4, 5), (9, 1)]
    sets = [(1, 0, "x", 10), (1, 1, "x", 11), (1, 2, "y", 12), (3, 0, "x", 13), (4, 0, "y", 14), (4, 0, "z", 15)]
    flow = spark.createDataFrame([(f, a, b) for f in (1, 2) for a, b in hops], "fn long, src long, dst long")
    defs = spark.createDataFrame([(1, *s) for s in sets], "fn long, block long, place long, var string, definition long")
    want = {(11, 2), (11, 3), (12, 2), (12, 3), (12, 4), (13, 2), (13, 3), (13, 4), (13, 5), (14, 5), (15, 5)}
    got = [tuple(r) for r in analysis.reaching_definitions(flow, defs).collect()]
    assert sorted(got) == sorted((1, d, b) for d, b in want) and "kills" not in made
