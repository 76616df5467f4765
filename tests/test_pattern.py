import re

import pytest

from loomgraph.plans import pattern as P
from loomgraph.plans.lowering import Graph, Lowering, glob_to_regex, run


@pytest.fixture(scope="module")
def graph(spark):
    """A loop, a two-cycle, parallel edges, two equal paths of different confidence, an isolated node, a null line."""
    n = [("a", "A", 1), ("b", "B", 2), ("c", "C", 3), ("d", "D", None), ("e", "E", 5), ("z", "Z", 9)]
    nodes = spark.createDataFrame([(i, x, x, "f", ln, ln, ["function" if i < "d" else "class"]) for i, x, ln in n], "id string, label string, name string, source_file string, line int, line_end int, kinds array<string>")
    e = [("a", "a", "calls", "EXTRACTED", 1), ("a", "b", "calls", "INFERRED", 2), ("a", "b", "calls", "EXTRACTED", 3), ("b", "a", "calls", "EXTRACTED", 4)]
    e += [("a", "c", "calls", "INFERRED", 5), ("c", "d", "calls", "EXTRACTED", 6), ("b", "d", "calls", "EXTRACTED", 7), ("d", "e", "uses", "EXTRACTED", None)]
    edges = spark.createDataFrame([(i, *x) for i, x in enumerate(e)], "edge_id long, src string, dst string, relation string, confidence string, line int")
    lines = spark.createDataFrame([("f", 1, "INSERT x"), ("f", 2, "nothing")], "file string, line int, text string")
    return Graph(nodes, edges, lines)


def rows(graph, text, *names):
    return sorted(tuple(r[n] for n in names) for r in run(graph, text).collect())


def test_parallel_edges_count_once_and_the_sure_one_wins(graph):
    assert rows(graph, "match (x)-[calls]->(y) where x.id = 'a' return y", "y", "bindings", "status") == [
        ("a", 1, "strong_inference"),
        ("b", 1, "strong_inference"),
        ("c", 1, "weak_inference"),
    ]


def test_bounded_paths_take_the_least_depth_and_the_surest_path(graph):
    got = rows(graph, "match (x)-[*1..3]->(y) where x.id = 'a' return y", "y", "status")
    assert got == [("a", "strong_inference"), ("b", "strong_inference"), ("c", "weak_inference"), ("d", "strong_inference"), ("e", "strong_inference")]


def test_two_or_more_hops_use_no_edge_twice(graph):
    assert [r[0] for r in rows(graph, "match (x)-[calls*2]->(y) where x.id = 'a' return y", "y")] == ["a", "b", "c", "d"]
    assert [r[0] for r in rows(graph, "match (x)-[calls*2..3]->(y) where x.id = 'b' return y", "y")] == ["a", "b", "c", "d"]


def test_zero_hops_reach_the_start(graph):
    assert [r[0] for r in rows(graph, "match (x)-[uses*0..1]->(y) where x.id = 'd' return y", "y")] == ["d", "e"]


def test_exists_and_absence(graph):
    assert [r[0] for r in rows(graph, "match (x) where not exists (x)-[]->() return x", "x")] == ["e", "z"]
    assert [r[0] for r in rows(graph, "match (x:function) where exists (x)-[calls]->(:class) return x", "x")] == ["b", "c"]


def test_a_variable_met_again_is_an_equality(graph):
    assert rows(graph, "match (x)-[calls]->(y)-[calls]->(x) where x.line < y.line return x, y", "x", "y") == [("a", "b")]


def test_null_orders_as_false_and_differs_from_everything(graph):
    assert [r[0] for r in rows(graph, "match (x) where x.line >= 1 return x", "x")] == ["a", "b", "c", "e", "z"]
    assert ("d",) in rows(graph, "match (x) where x.line != 1 return x", "x")


def test_text_conditions_read_the_definition(graph):
    assert [r[0] for r in rows(graph, 'match (x:function) where x.text ~ "INSERT|UPDATE" return x', "x")] == ["a"]
    assert [r[0] for r in rows(graph, 'match (x:function) where not x.text ~ "INSERT" return x', "x")] == ["b", "c"]


def test_counts_are_distinct_and_empty_counts_are_one_row_of_zeros(graph):
    got = run(graph, "match (x)-[calls]->(y), (x)-[calls]->(z) return count(y), count(*)").collect()
    assert [(r["count_y"], r["count"]) for r in got] == [(4, 14)]
    none = run(graph, "match (x) where x.id = 'nope' return count(x)").collect()
    assert [r["count_x"] for r in none] == [0]


def test_built_queries_equal_written_ones(graph):
    built = P.build([P.path(P.node("x"), P.edge("calls"), P.node("y"))], P.id_in("x", ["a", "b"]), [P.Item("y")])
    text = "match (x)-[calls]->(y) where x.id = 'a' or x.id = 'b' return y"
    assert sorted(r["y"] for r in run(graph, built).collect()) == [r[0] for r in rows(graph, text, "y")]


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("return x", "come first"),
        ("match (x:wizard)", "no such kind"),
        ("match (x)-[calls*1..11]->(y)", "more than the 10"),
        ("match (x)-[*3..2]->(y)", "no number of edges"),
        ("match (x)-[e:calls]->(y)", "cannot be named"),
        ("match (x) where y.id = 'a'", "no pattern binds"),
        ("match (x) where x.line = 'a'", "with numbers"),
        ("match (x) where x.name ~ '('", "cannot be compiled"),
        ("match (x) limit 0", "above 0"),
        ("match (x) where x.text = 'a'", "nothing else"),
        ("match (x) where", "missing here"),
        ("match (x) where (x.id = 'a'", "never closed"),
        ("match (x) where x.id = 'a' x.id", "cannot stand in a condition"),
        ("match (x) where x.id == 'a'", "value"),
        ("match (x) where x.line ~ '1'", "field of characters"),
        ("match (x) where x.name ~ x.label", "field of characters"),
        ("match (x) where x.size = 1", "no field"),
        ("match (x)-[calls]->", "node is missing"),
        ("match (x)<-[calls]->(y)", "one way"),
        ("match (x) return x y", "RETURN lists"),
        ("match (x) return x where x.id = 'a'", "cannot stand after"),
        ("match (x) where " + "not " * 40 + "x.id = 'a'", "nested"),
        ("match (x) ?", "belongs to nothing"),
    ],
)
def test_errors_say_what_is_wrong(text, part):
    with pytest.raises(P.QueryError, match=part):
        P.parse(text)


def test_conditions_bind_as_written():
    c = lambda v: P.Compare(P.Ref("x", "id"), "=", v)
    tree = P.parse("MATCH (x) WHERE NOT x.id = 'a' and x.id='b' OR (x.id = 'c' or x.id = 'd') AND not not x.id = \"e'\\\"\" Return x.file, Count( x ), COUNT(*) limit 7")
    left = P.Logic("and", (P.Logic("not", (c("a"),)), c("b")))
    right = P.Logic("and", (P.Logic("or", (c("c"), c("d"))), P.Logic("not", (P.Logic("not", (c("e'\""),)),))))
    assert tree.where == P.Logic("or", (left, right)) and tree.limit == 7
    assert tree.items == [P.Item("x", "file"), P.Item("x", None, True), P.Item("*", None, True)]


def test_edges_and_nodes_are_read_whole():
    tree = P.parse("(a:Class|function)-[calls|uses*2]->()<-[*..4]-(b)-[ : count * 3.. ]-(:file), (b) where exists (a)-[*]->(:test) and not exists (b)<-[x]-()")
    (p, q) = tree.paths
    assert [n.kinds for n in p.nodes] == [("class", "function"), (), (), ("file",)] and [n.named for n in p.nodes] == [True, False, True, False]
    assert p.edges == (P.Edge(("calls", "uses"), "out", 2, 2), P.Edge((), "in", 1, 4), P.Edge(("count",), "both", 3, 10))
    assert q == P.Path((P.Node("b"),)) and len({n.var for n in p.nodes}) == 4 and [i.var for i in tree.items] == ["a", "b"]
    assert tree.where.parts[0].path.edges == (P.Edge((), "out", 1, 5),)


def test_globs():
    import re

    assert re.match(glob_to_regex("a*[0-9]?.py"), "abc7x.py") and not re.match(glob_to_regex("[!a]*"), "abc")


@pytest.fixture(scope="module")
def hub(spark):
    """One hub whose neighbours share lines, some null, some by unsure edges."""
    n = [("h", 0, "hub")] + [(f"x{i}", None if i % 11 == 0 else i % 7, "left") for i in range(40)] + [(f"y{i}", None if i % 9 == 0 else i % 5, "right") for i in range(30)]
    nodes = spark.createDataFrame([(i, i[0], i, "f", ln, ln, [k]) for i, ln, k in n], "id string, label string, name string, source_file string, line int, line_end int, kinds array<string>")
    e = [(i, "h", "in", "INFERRED" if int(i[1:]) % 3 == 0 else "EXTRACTED", 1) for i, _, k in n if k != "hub"]
    edges = spark.createDataFrame([(j, *x) for j, x in enumerate(e)], "edge_id long, src string, dst string, relation string, confidence string, line int")
    return Graph(nodes, edges, None, ("hub", "left", "right"))


def test_an_equality_of_fields_is_a_key_of_the_join(hub):
    text = "match (a:left)-[in]->(h:hub)<-[in]-(b:right) where a.line = b.line return a, b"
    lines = lambda k: {i: (None if i % (11 if k == 7 else 9) == 0 else i % k) for i in range(40 if k == 7 else 30)}
    want = sorted((f"x{i}", f"y{j}", 1) for i, a in lines(7).items() for j, b in lines(5).items() if a is not None and a == b)
    assert rows(hub, text, "a", "b", "bindings") == want
    plan = run(hub, text)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert any("hop_u" in j and "a.line" in j and "b.line" in j for j in joins), plan


@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "="])
@pytest.mark.parametrize("items", ["h, count(*)", "a"])
def test_nodes_that_are_only_counted_are_no_rows(hub, op, items):
    for text in (f"match (a)-[in]->(h:hub)<-[in]-(b:right) where a.line {op} b.line return {items}", f"match (b:right)-[in]->(h:hub)<-[in]-(a:left) where b.line {op} a.line return {items}"):
        listed = Lowering(hub, P.parse(text, hub.kinds)).result(explain=True).drop("absence", "examples")
        counted = Lowering(hub, P.parse(text, hub.kinds))
        assert sorted(map(tuple, counted.result().collect())) == sorted(map(tuple, listed.collect()))
        assert len(counted.folds) == 1 and counted.bindings().count() <= 140


def test_an_end_without_a_condition_is_counted_too(hub):
    assert rows(hub, "match (h:hub)<-[in]-(:left) return h, count(*)", "h", "count", "status") == [("h", 40, "weak_inference")]
