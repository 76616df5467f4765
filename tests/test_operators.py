import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.graph.components import components
from loomgraph.operators import claims, dedup, graphops, history, search, traverse
from loomgraph.plans import catalog_more
from loomgraph.plans.questions import ask
from loomgraph.streaming import flows


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 1), (300, 301)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[200] == 200 and got[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_strong_components_and_feedback(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    got = dict(map(tuple, graphops.strong_components(nodes, pairs).collect()))
    assert got == {"a": "c", "b": "c", "c": "c", "d": "e", "e": "e", "f": "f"}
    cut = graphops.feedback_edges(pairs, spark.createDataFrame(list(got.items()), "id string, component string")).collect()
    assert len(cut) == 2
    assert graphops.topological_order(["x", "y", "z"], {("z", "y"): 1, ("y", "x"): 2}) == ["z", "y", "x"]
    assert graphops.topological_order(["a", "b"], {("a", "b"): 3, ("b", "a"): 1}) == ["a", "b"]


def test_pagerank_sums_to_one(spark):
    nodes = spark.createDataFrame([(x,) for x in "abc"], "id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 4.0)], "src string, dst string, weight double")
    ranks = dict(map(tuple, graphops.pagerank(nodes, edges, rounds=30, tolerance=1e-6).collect()))
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks["c"] > ranks["b"] > ranks["a"]


def test_required_strings_never_lose_a_match():
    f = lambda *x: frozenset(x)
    cases = {"foo.*bar": [f("bar"), f("foo")], "(abc|abd)x": [f("abcx", "abdx")], "ab": [], "[a-z]+hello": [f("hello")], "(?:xyz)?qqq": [f("qqq")], "a|bcd": [], "(?:abc){2,}d": [f("abcabc")], "gr[ae]y": [f("gray", "grey")]}
    cases |= {"foo(?=zip)bar": [f("foobar")], "(abc.*|.xyz)": [f("abc", "xyz")], "x{3}y": [f("xxxy")], "(?i)hello": [f("hello")], "(?i)skip": [], "caf\u00e9 noir": [f(" noir"), f("caf")]}
    for pattern, want in cases.items():
        assert search.required(pattern) == want, pattern
    assert search.required("skip", ignore_case=True) == [] and search.required("hello", ignore_case=True) == [f("hello")]
    r = random.Random(3)
    for _ in range(400):
        piece = lambda d=0: r.choice(["a", "bc", "abc", "[ab]", "c?", "(?:ab)+", "a{2}", ".", "^", "x*", f"(?:{piece(d + 1)}|{piece(d + 1)})" if d < 2 else "b"])  # noqa: E731, B023
        pattern = "".join(piece() for _ in range(r.randint(1, 6)))
        needs = search.required(pattern)
        for _ in range(30):
            text = "".join(r.choice("abcx") for _ in range(r.randint(0, 14)))
            if re.search(pattern, text):
                assert all(any(x in text for x in need) for need in needs), (pattern, needs, text)


def test_indexed_search_equals_a_scan(spark):
    files = spark.createDataFrame([("a", "hello world\nhello hello"), ("b", "help"), ("c", None), ("d", "")], "file string, text string")
    own = files.select("file", F.coalesce("text", F.lit("")).alias("text"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for pattern in ("hello", "hel+p?", "wor(ld|d)", "x*"):
        assert rows(search.regex_search(own, pattern, search.postings(own))) == rows(search.regex_search(own, pattern))
    assert rows(search.regex_search(own, "hello"))[1][3] == 2
    assert rows(search.regex_search(own, "HELP", ignore_case=True)) == [("b", 1, "help", 1)]


def test_filters():
    free, tree = search.parse_filters('find it path:src -is:test /a+b/i ("x y" OR lang:py)')
    assert free == "find it" and tree[0] == "and" and tree[1][1] == ("not", search.Atom("is", "test"))
    for bad in ("is:odd", "/(/", "(path:a", "path:a OR"):
        with pytest.raises(search.FilterError):
            search.parse_filters(bad)
    for bad in ("__import__('os')", "a >", "a > 1 and", "(a > 1", "b > 1", "3", "a 1", "a = 1", "not " * 60 + "a"):
        with pytest.raises(search.FilterError):
            search.where_column(bad, {"a"})


def test_inventory_conditions(spark):
    rows = [(a, b) for a in range(4) for b in range(4)]
    df = spark.createDataFrame(rows, "a long, b long")
    for text in ("a", "not a", "a > 1 and b < 2 or not (a == b)", "0 < a <= b", "a != 2 and (b >= 1 or a)", "not a and not b == 3"):
        want = [(a, b) for a, b in rows if eval(text, {"a": a, "b": b})]  # noqa: S307
        assert sorted(map(tuple, df.where(search.where_column(text, {"a", "b"})).collect())) == sorted(want), text


def test_scalar_functions(spark):
    row = spark.range(1).select(
        T.fold_tr(F.lit("ÇIĞ Işık")).alias("fold"), T.split_identifier(F.lit("parseHTTPReply_v2")).alias("split"), T.stem(F.lit("parsing")).alias("stem"), T.clip(F.lit("a  b\nc d"), 5).alias("clip"),
        T.norm_label(F.lit("  Foo--Bar(baz) ")).alias("norm"), T.shingles(F.lit("abcd")).alias("grams"), T.entropy(F.lit("aabb")).alias("bits"), T.folder(F.lit("a/b/c.py"), 1).alias("folder"),
        T.extension(F.lit("a/b.TXT")).alias("ext"), T.weaker(F.lit("strong_inference"), F.lit("unknown")).alias("weak"), T.step_down(F.lit("strong_inference")).alias("down"), T.nfc(F.lit("e\u0301")).alias("nfc"),
        T.detect_language(F.lit("the cat and dog")).alias("lang"), T.is_test_file(F.lit("tests/a.py")).alias("test"), T.redact(F.lit("mail a@b.co token=abcdefghijklmnop")).alias("safe"),
        T.member_fingerprint(F.array(F.lit("b"), F.lit("a"))).alias("fp"), T.sql_tables(F.lit("select * from A join b -- from c")).alias("tables"), T.tokens_estimate(F.lit(5)).alias("est"),
        (T.failure_key(F.lit("at 0xdead took 5ms")) == T.failure_key(F.lit("at 0xbeef took 12ms"))).alias("same"), claims.call_on_line(F.lit("x = save(1)  # load()"), F.lit("save()")).alias("call"),
    ).first()
    assert row["fold"] == "cig isik" and row["split"] == ["parse", "http", "reply", "v", "2"] and row["stem"] == "pars" and row["clip"] == "a b …"
    assert row["norm"] == "foo bar baz" and row["grams"] == ["abc", "bcd"] and row["bits"] == 1.0 and row["folder"] == "a" and row["ext"] == ".txt"
    assert row["weak"] == "unknown" and row["down"] == "weak_inference" and row["nfc"] == "é" and row["lang"] == "en" and row["test"]
    assert row["safe"] == "mail [email] token=[secret]" and len(row["fp"]) == 16 and row["tables"] == ["a", "b"] and row["est"] == 2 and row["same"] and row["call"]


def test_similarity_and_entities(spark):
    assert abs(dedup.jaro("MARTHA", "MARHTA") - 0.9611) < 1e-3 and dedup.jaro("", "a") == 0 and dedup.jaro("x", "x") == 1
    rows = [(1, "Payment Gateway", "a", "concept", 1), (2, "payment-gateway", "b", "concept", 1), (3, "Payment Gatewey", "a", "concept", 1), (4, "run", "a", "code", 1), (5, "run", "b", "code", 2), (6, "Other thing", "c", "concept", 2)]
    got = dict(map(tuple, dedup.entities(spark.createDataFrame(rows, "node long, label string, file string, kind string, community int")).collect()))
    assert got[1] == got[2] and got.get(3, 1) == 1 and 4 not in got and 5 not in got


def test_clones(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [("a", base), ("b", [*base[:-2], "x", "y"]), ("c", [f"u{i}" for i in range(60)]), ("d", base[:10])]
    assert [tuple(r)[:2] for r in dedup.clones(spark.createDataFrame(rows, "name string, tokens array<string>")).collect()] == [("a", "b")]


def test_status_at_a_commit(spark):
    parents = spark.createDataFrame([("c", "b"), ("b", "a")], "commit string, parent string")
    t = spark.createDataFrame([(1, "a", 1, "active", False), (1, "c", 2, "stale", False), (2, "a", 1, "active", False), (3, "z", 1, "active", False), (4, "b", 1, "x", True)], "claim_id long, commit string, seq long, status string, dirty boolean")
    got = {r["claim_id"]: (r["status"], r["basis"]) for r in history.status_at_commit(t, parents, "c").collect()}
    assert got == {1: ("stale", "observed"), 2: ("active", "strong_inference"), 3: ("unknown", "unknown"), 4: ("unknown", "unknown")}


def test_claim_rules(spark):
    e = spark.createDataFrame([(1, "g", "supports", "strong_inference"), (1, "g", "supports", "weak_inference"), (1, "h", "supports", "strong_inference"), (2, "g", "supports", "strong_inference"), (2, "h", "refutes", "strong_inference")], "claim_id long, grp string, relation string, grade string")
    assert dict(map(tuple, claims.claim_status(e).collect())) == {1: "strong_inference", 2: "unknown"}
    facts = spark.createDataFrame([("a", "strong_inference"), ("b", "weak_inference")], "name string, status string")
    inputs = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "x"), ("z", "missing")], "name string, input string")
    assert dict(map(tuple, claims.derived(facts, inputs).collect())) == {"x": "weak_inference", "y": "weak_inference", "z": "unknown"}
    anchors = spark.createDataFrame([(1, "f", 5, "x = 1")], "anchor long, file string, line int, text string")
    lines = spark.createDataFrame([("f", 2, "x = 1"), ("f", 7, " x = 1 "), ("g", 5, "x = 1")], "file string, line int, text string")
    assert [tuple(r) for r in claims.relocate(anchors, lines).collect()] == [(1, 7)]


def test_the_store_only_grows(spark, tmp_path):
    store = claims.Store(spark, f"file://{tmp_path}/s")
    store.append("claims", spark.createDataFrame([(1, "active")], "claim_id long, status string"))
    store.append("claims", spark.createDataFrame([(1, "stale"), (2, "active")], "claim_id long, status string"))
    assert store.read("claims").count() == 3 and {r["claim_id"]: r["status"] for r in store.state("claims", ["claim_id"]).collect()} == {1: "stale", 2: "active"}


def test_routes_and_links(spark):
    calls = spark.createDataFrame([("GET", "/orders/7"), ("POST", "/orders"), ("GET", "/x")], "method string, path string")
    routes = spark.createDataFrame([("r", "GET", "/{id}"), ("r", "POST", "")], "router string, method string, path string")
    mounts = spark.createDataFrame([("app", "r", "/orders/")], "parent string, router string, prefix string")
    whole = graphops.compose_routes(mounts, routes)
    assert sorted((r["method"], r["path"], r["route"]) for r in graphops.join_routes(calls, whole).collect()) == [("GET", "/orders/7", "/orders/{id}"), ("POST", "/orders", "/orders")]


def test_changes_between_manifests_and_postings(spark):
    now, then = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha string"), spark.createDataFrame([("b", "x"), ("c", "3")], "path string, sha string")
    assert dict(map(tuple, flows.detect_changes(now, then).collect())) == {"a": "new", "b": "changed", "c": "deleted"}
    files = spark.createDataFrame([("a", "abcd"), ("b", "bcde"), ("c", "xyz")], "file string, text string")
    changed = spark.createDataFrame([("a", "new text")], "file string, text string")
    kept = flows.maintained_postings(search.postings(files), changed, spark.createDataFrame([("c",)], "file string"))
    fresh = search.postings(files.where("file = 'b'").unionByName(changed))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, fresh.collect()))


def test_innermost_spans(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 600), ("f", "inner", 300, 320), ("g", "other", 1, 9)], "file string, symbol string, start long, end long")
    points = spark.createDataFrame([("f", 310), ("f", 5), ("f", 700), ("h", 1)], "file string, line long")
    assert sorted((r["file"], r["line"], str(r["symbol"])) for r in traverse.innermost(spans, points).collect()) == [("f", 5, "outer"), ("f", 310, "inner"), ("f", 700, "None"), ("h", 1, "None")]


def test_questions_are_checked(spark):
    with pytest.raises(ValueError, match="unknown"):
        ask(None, [("who",)])


def test_link_counts_are_the_links_counted(spark):
    uses = spark.createDataFrame([("m", i % 3, f"o{i % 2}") for i in range(500)] + [("m", None, "o1")], "module string, name int, member string")
    definitions = spark.createDataFrame([("m", i % 4, f"{'so'[i % 2]}{i % 3}") for i in range(400)], "module string, name int, member string")
    want = graphops.group_links(uses, definitions).groupBy("user", "definer", "module", "name").agg(F.count("*").alias("n"))
    got = graphops.group_link_counts(uses, definitions)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # what reaches the join is at most one row a member, whatever the sizes
    assert "used" in got._jdf.queryExecution().optimizedPlan().toString()


def test_label_propagation_equals_a_plain_one(spark):
    """Ends that are no nodes, loops, both directions of an edge, repeated edges and nodes, ties."""
    r = random.Random(5)
    names = [f"n{i}" for i in range(30)]
    links = [(r.choice([*names, "stray1", "stray2"]), r.choice(names)) for _ in range(70)] + [("n1", "n1"), ("n2", "n3"), ("n3", "n2"), ("n2", "n3")]
    edges = spark.createDataFrame([(i, s, d, "x", "EXTRACTED", 1) for i, (s, d) in enumerate(links)], "edge_id long, src string, dst string, relation string, confidence string, line int")
    own = [*names, "n4", "alone"]
    both = {(s, d) for s, d in links if s != d} | {(d, s) for s, d in links if s != d}
    labels = [(n, n) for n in own]
    for _ in range(3):
        votes = {}
        for n, c in labels + [(u, c) for u, v in both for n, c in labels if n == v]:
            votes.setdefault(n, {}).setdefault(c, 0)
            votes[n][c] += 1
        labels = [(n, min(cs, key=lambda c: (-cs[c], c))) for n, cs in votes.items()]
    got = graphops.label_propagation(spark.createDataFrame([(n,) for n in own], "id string"), edges, 3)
    assert sorted(map(tuple, got.collect())) == sorted(labels)
    numbers, pairs = graphops.numbered(spark.createDataFrame([(n,) for n in own], "id string"), traverse.oriented(edges).where("u <> v").select("u", "v"))
    assert dict(pairs.dtypes) == {"u": "bigint", "v": "bigint"} and pairs.count() == len(both)
    assert [x[0] for x in numbers.orderBy("number").collect()] == sorted({*own, *(n for p in links for n in p)})


def test_only_texts_that_may_change_are_normalised_in_python(spark):
    texts = ["plain", "caf\u00e9 \u02ff", "e\u0301", "\u1112\u1161\u11ab", "\u212b", "", None, "a\nb" * 50] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.nfc(F.col("t")).alias("c"))
    assert [r["c"] for r in df.orderBy("i").collect()] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert "_composed(CASE WHEN" in df._jdf.queryExecution().analyzed().toString()


def test_reports_are_written_in_several_files_with_whole_records(spark):
    df = spark.createDataFrame([(i % 10, i, f"{i % 10} {i}") for i in range(200)], "a int, k int, value string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = catalog_more._written(spark, df, "a", "k", by="a")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = {}
    for r in spark.read.text(path).select(F.input_file_name().alias("f"), "value").collect():
        files.setdefault(r["f"], []).append(tuple(map(int, r["value"].split())))
    assert len(files) > 1 and all(rows == sorted(rows) for rows in files.values()) and sum(map(len, files.values())) == 200
    assert sum(len({a for a, _ in rows}) for rows in files.values()) == 10


def moved(spark, make) -> tuple[int, object]:
    """The rows that the exchanges of make() write, and what it returns."""
    sc = spark.sparkContext

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None).iterator()
        total = 0
        while stages.hasNext():
            total += stages.next().shuffleWriteRecords()
        return total

    before, held = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = make()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    return written() - before, out


def test_group_matrix_counts_references_before_they_meet_the_node(spark):
    nodes = spark.range(4000).select(F.concat(F.lit("a:"), "id").alias("id"), F.lit("a").alias("grp")).union(spark.createDataFrame([("hub:0", "b"), ("hub:1", "b")], "id string, grp string"))
    edges = spark.range(4000).select(F.concat(F.lit("a:"), "id").alias("src"), F.concat(F.lit("hub:"), F.col("id") % 2).alias("dst"))
    rows, got = moved(spark, lambda: graphops.group_matrix(nodes, edges, F.col("grp")).collect())
    assert [tuple(r) for r in got] == [("a", "b", 4000)]
    assert rows < 10_000  # the edges and the nodes once; before, the edges moved twice


def test_group_matrix_keeps_ids_apart_that_only_look_alike(spark):
    ids = ["a:1", "a:01", "a:+1", "a: 1", "a:1 ", "a:", "a", "1", "a:b:1", "a:b:", ":1", "", "a:-1", "a:9223372036854775808", "a:1.0", "=a", "a:0", "A:1"]
    nodes = spark.createDataFrame([(x, x) for x in ids] + [(None, "null")], "id string, grp string")
    edges = spark.createDataFrame([(x, y) for x in ids for y in ids] + [(None, "a"), ("a", None), ("a:2", "a:1"), ("a:1", "=a:1")], "src string, dst string")
    got = {(r["group_from"], r["group_to"]): r["refs"] for r in graphops.group_matrix(nodes, edges, F.col("grp")).collect()}
    assert got == {(x, y): 1 for x in ids for y in ids}


def test_personalised_pagerank_leaves_the_links_where_they_are(spark):
    nodes = spark.range(60).select(F.concat(F.lit("n"), "id").alias("id"))
    ends = spark.range(3000).select(F.concat(F.lit("n"), F.col("id") % 60).alias("src"), F.concat(F.lit("n"), (F.col("id") * 7 + F.floor(F.col("id") / 60)) % 60).alias("dst"), F.lit(1.0).alias("weight"))
    seeds = nodes.where("id in ('n0', 'n1')").withColumn("mass", F.lit(1.0))
    rows, got = moved(spark, lambda: graphops.personalised_pagerank(nodes, ends, seeds, rounds=4).collect())
    links = {}
    for r in ends.collect():
        links.setdefault(r["src"], []).append(r["dst"])
    rank = {"n0": 0.5, "n1": 0.5}
    for _ in range(4):
        flow = {}
        for a, r in rank.items():
            for b in links[a]:
                flow[b] = flow.get(b, 0.0) + r / len(links[a])
        rank = {k: 0.3 * (0.5 if k in ("n0", "n1") else 0.0) + 0.7 * flow.get(k, 0.0) for k in {*flow, "n0", "n1"}}
    assert {r["id"] for r in got} == set(rank) and all(abs(r["rank"] - rank[r["id"]]) < 1e-12 for r in got)
    assert rows < 9000  # the links once, and sums; before, once more for every round
