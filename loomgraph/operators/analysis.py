"""Program questions over graph and line tables: derived kinds, reaching definitions, guarded callers, renames, resource ids,
structural search, question analysis, local push, probes of claims, and named views."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import saved
from . import graphops
from .traverse import bounded_paths, degrees, hub_threshold, oriented, reach

# -- kinds and contexts ----------------------------------------------------------------------------------------------------


def with_kinds(nodes: DataFrame, edges: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """nodes with ``kinds`` derived from label, file_type and source_file: file, symbol, function, method, class, section,
    test, and handler for the ids of handlers (id).

    The two ends of ``method`` edges say which symbols are classes and methods. A node without a source file has no kind."""
    method = edges.where("relation = 'method'")
    owners, members = method.select(F.col("src").alias("id")).distinct().withColumn("owner", F.lit(True)), method.select(F.col("dst").alias("id")).distinct().withColumn("member", F.lit(True))
    own = nodes.join(owners, "id", "left").join(members, "id", "left")
    if handlers is not None:
        own = own.join(handlers.select("id").distinct().withColumn("served", F.lit(True)), "id", "left")
    path, label = F.coalesce("source_file", F.lit("")), F.coalesce("label", F.lit(""))
    base = F.element_at(F.split(path, "/"), -1)
    file = (path != "") & ((label == base) | (label == path) | (label.endswith(F.concat(F.lit("/"), base)) & path.endswith(label)))
    symbol = (path != "") & ~file & (F.col("file_type") == "code")
    function = symbol & label.endswith("()")
    rules = {
        "file": file,
        "symbol": symbol,
        "function": function,
        "method": function & (label.startswith(".") | F.coalesce("member", F.lit(False))),
        "class": symbol & ~function & F.coalesce("owner", F.lit(False)),
        "section": (path != "") & ~file & (F.col("file_type") == "document"),
        "test": (file | symbol) & T.is_test_file(path),
        "handler": F.coalesce("served", F.lit(False)) if handlers is not None else F.lit(False),
    }
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return own.withColumn("kinds", kinds).select(*[c for c in nodes.columns if c != "kinds"], "kinds")


# Words of a question that ask for edges of one context.
CONTEXT_WORDS = {"call": ("call", "calls", "called", "calling", "invoke", "invokes"), "import": ("import", "imports", "imported", "module", "modules"), "export": ("export", "exports", "exported"), "field": ("field", "fields"), "parameter": ("parameter", "parameters", "param", "params", "argument", "arguments"), "return": ("return", "returns", "returned")}


def contexts_of(question: str) -> list[str]:
    """The contexts a question names, in a fixed order."""
    said = set(re.findall(r"\w+", question.lower()))
    return [c for c, words in CONTEXT_WORDS.items() if said & set(words)]


def in_context(edges: DataFrame, contexts: list[str]) -> DataFrame:
    """edges of these contexts; all of them without any."""
    return edges.where(F.col("context").isin(*contexts)) if contexts else edges


# -- walks -----------------------------------------------------------------------------------------------------------------


def guarded_dfs(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int, floor: int = 50) -> DataFrame:
    """(start, id, turn): a depth-first walk from each start, neighbours in order of id, that does not leave hubs.

    The order of a walk is not relational, so it is made in a function; what that is given is bounded by joins first: only
    edges among nodes within ``depth`` of the start that a guarded breadth-first search reaches."""
    calm = saved(degrees(nodes, edges).where(F.col("degree") < hub_threshold(degrees(nodes, edges), floor)).select("id"), "calm")
    hops = saved(oriented(edges, "both").select("u", "v").distinct(), "hops")
    ball = starts.select(F.col("id").alias("start"), F.col("id")).distinct()
    ball = saved(ball, "ball")
    seen = ball
    for d in range(depth):
        outgoing = ball if d == 0 else ball.join(calm, "id", "left_semi")
        ball = saved(outgoing.join(hops, F.col("id") == F.col("u")).select("start", F.col("v").alias("id")).distinct().join(seen, ["start", "id"], "left_anti"), "ball")
        seen = seen.unionByName(ball)
    may = seen.join(calm.withColumn("calm", F.lit(True)), "id", "left").withColumn("leaves", F.coalesce("calm", F.lit(False)) | (F.col("id") == F.col("start")))
    inner = may.where("leaves").join(hops, F.col("id") == F.col("u")).select("start", "u", "v").unionByName(starts.select(F.col("id").alias("start"), F.col("id").alias("u"), F.lit(None).cast("string").alias("v")).distinct())

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        start, out = pdf["start"].iloc[0], {}
        near: dict[str, list[str]] = {}
        for u, v in zip(pdf["u"], pdf["v"], strict=True):
            if v is not None:
                near.setdefault(u, []).append(v)
        todo = [(start, 0)]
        while todo:
            node, d = todo.pop()
            if node in out or d > depth:
                continue
            out[node] = len(out)
            todo += [(v, d + 1) for v in sorted(near.get(node, ()), reverse=True) if v not in out]
        return pd.DataFrame({"start": start, "id": list(out), "turn": list(out.values())})

    return inner.groupBy("start").applyInPandas(walk, "start string, id string, turn int")


def guarded_callers(edges: DataFrame, targets: DataFrame, depth: int = 4) -> DataFrame:
    """(target, caller, depth, guards): what leads to the targets, and the conditions on the way, the caller's first.

    edges(edge_id, src, dst, relation, confidence, line, guard); an edge without a guard always runs."""
    found = bounded_paths(targets, oriented(edges, "in"), 1, depth).select(F.col("start").alias("target"), F.col("end").alias("caller"), "depth", "edge_ids")
    flat = found.select("target", "caller", "depth", F.posexplode("edge_ids").alias("n", "edge_id")).join(edges.select("edge_id", "guard"), "edge_id")
    steps = flat.groupBy("target", "caller", "depth").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "guard"))).alias("s"))
    return steps.select("target", "caller", "depth", F.filter(F.transform("s", lambda x: x["guard"]), lambda g: g.isNotNull()).alias("guards"))


def push_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.3, eps: float = 1e-4, rounds: int = 50) -> DataFrame:
    """(id, rank) by local push: a node whose residual is eps times its weighted degree or more keeps alpha of it and
    spreads the rest over edges(src, dst, weight), taken both ways; the others wait. All such nodes push in one round.

    Only nodes near the seeds(id, mass) are ever touched. Ends when none may push, or after ``rounds``."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst")
    links = saved(both.groupBy("src", "dst").agg(F.sum("weight").alias("w")), "links")
    degree = saved(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")), "degree")
    total = seeds.agg(F.sum("mass")).first()[0] or 1.0
    state = saved(seeds.select("id", F.lit(0.0).alias("p"), (F.col("mass") / F.lit(float(total))).alias("r")), "push")
    for _ in range(rounds):
        own = state.join(degree, "id", "left")
        active = own.where(F.col("r") >= F.lit(eps) * F.coalesce("deg", F.lit(1.0)))
        if active.isEmpty():
            break
        keep = active.select("id", F.when(F.col("deg").isNull(), F.col("r")).otherwise(alpha * F.col("r")).alias("p"), (-F.col("r")).alias("r"))
        spread = active.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(0.0).alias("p"), ((1 - alpha) * F.col("r") * F.col("w") / F.col("deg")).alias("r"))
        state = saved(reduce(DataFrame.unionByName, [state, keep, spread]).groupBy("id").agg(F.sum("p").alias("p"), F.sum("r").alias("r")), "push")
    return state.where("p > 0").select("id", F.col("p").alias("rank"))


def reaching_definitions(flow: DataFrame, definitions: DataFrame) -> DataFrame:
    """(fn, definition, block): the definitions that hold where a block begins.

    flow(fn, src, dst) between blocks; definitions(fn, block, place, var, definition), of which the last of a variable in a
    block leaves it. A definition goes on through blocks that do not define its variable. One fix-point for all functions."""
    last = definitions.groupBy("fn", "block", "var").agg(F.max_by("definition", "place").alias("definition"))
    # a hop knows the variables its block defines, so that a round meets one table
    kills = definitions.groupBy("fn", F.col("block").alias("src")).agg(F.collect_set("var").alias("kills"))
    hop = saved(flow.select("fn", "src", "dst").distinct().join(kills, ["fn", "src"], "left"), "flow")
    front = saved(last.withColumnRenamed("block", "src").join(hop, ["fn", "src"]).select("fn", "definition", "var", F.col("dst").alias("block")).distinct(), "reaching")
    seen = [front]
    while not front.isEmpty():
        on = (F.col("x.fn") == F.col("h.fn")) & (F.col("x.block") == F.col("h.src")) & ~F.coalesce(F.array_contains("h.kills", F.col("x.var")), F.lit(False))
        moved = front.alias("x").join(hop.alias("h"), on).select("x.fn", "x.definition", "x.var", F.col("h.dst").alias("block")).distinct()
        front = saved(moved.join(reduce(DataFrame.unionByName, seen), ["fn", "definition", "var", "block"], "left_anti"), "reaching")
        seen.append(front)
    return reduce(DataFrame.unionByName, seen).select("fn", "definition", "block")


# -- lines -----------------------------------------------------------------------------------------------------------------


def rename_preview(lines: DataFrame, old: str, new: str, known: DataFrame | None = None) -> DataFrame:
    """(file, line, text, after, sure): every line a rename touches, whole words only; sure where known(file, line) has a
    definition or a reference there, as other lines may mean something else by the name."""
    word = r"(?<![A-Za-z0-9_])" + re.escape(old) + r"(?![A-Za-z0-9_])"
    hit = lines.where(F.col("text").rlike(word)).select("file", "line", "text", F.regexp_replace("text", word, new.replace("\\", "\\\\").replace("$", "\\$")).alias("after"))
    if known is None:
        return hit.withColumn("sure", F.lit(False))
    return hit.join(known.select("file", "line").distinct().withColumn("k", F.lit(True)), ["file", "line"], "left").withColumn("sure", F.coalesce("k", F.lit(False))).drop("k")


def resource_links(lines: DataFrame, resources: DataFrame, shape: str = r"[a-z0-9_.-]+:[a-z0-9_./-]+") -> DataFrame:
    """(file, line, key, resource): quoted ids in lines(file, line, text) that resources(key, resource) define."""
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(f"[\"']({shape})[\"']"), F.lit(1)))
    return lines.select("file", "line", F.explode(ids).alias("key")).join(resources, "key").select("file", "line", "key", "resource")


def _holes(pattern: str) -> ast.AST:
    body = ast.parse(re.sub(r"\$([A-Z]\w*)", r"hole_\1", pattern)).body
    if len(body) != 1:
        raise ValueError("a pattern is one statement or expression")
    return body[0].value if isinstance(body[0], ast.Expr) else body[0]


def _fits(want: object, node: object, bound: dict[str, str]) -> bool:
    """Whether a syntax tree has the pattern's shape; a hole takes any expression, and the same one wherever it returns."""
    if isinstance(want, ast.Name) and want.id.startswith("hole_") and isinstance(node, ast.expr):
        shown = ast.unparse(node)
        return bound.setdefault(want.id[5:], shown) == shown
    if type(want) is not type(node):
        return False
    if isinstance(want, ast.AST):
        return all(_fits(getattr(want, f, None), getattr(node, f, None), bound) for f in want._fields if f not in ("ctx", "type_comment", "kind"))
    if isinstance(want, list):
        return len(want) == len(node) and all(_fits(a, b, bound) for a, b in zip(want, node, strict=True))
    return want == node


def structural_search(files: DataFrame, pattern: str) -> DataFrame:
    """(file, line, found, holes): where Python code in files(file, text) has the shape of a pattern with holes ``$X``.

    Files that do not parse have no rows."""
    _holes(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        want = _holes(pattern)
        for pdf in batches:
            rows = []
            for file, body in zip(pdf["file"], pdf["text"], strict=True):
                try:
                    tree = ast.parse(body or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for node in ast.walk(tree):
                    bound: dict[str, str] = {}
                    if _fits(want, node, bound):
                        rows.append((file, node.lineno, ast.unparse(node), bound))
            yield pd.DataFrame(rows, columns=["file", "line", "found", "holes"])

    return files.select("file", "text").mapInPandas(run, "file string, line int, found string, holes map<string,string>")


# -- questions -------------------------------------------------------------------------------------------------------------

# Words of questions that name nothing, and what short forms stand for.
STOP_WORDS = "a an and are as at be by can do does for from how i in is it its me of on or show that the this to was we what when where which who why will with you".split()
SHORT_FORMS = {"auth": "authentication", "cfg": "config", "config": "configuration", "db": "database", "fn": "function", "impl": "implementation", "init": "initialize", "param": "parameter", "repo": "repository", "req": "request", "resp": "response"}
EXACT, PART, STEM, EXPANDED = 1.0, 0.7, 0.5, 0.4


def analyze_question(spark: SparkSession, question: str, expansions: dict[str, list[str]] | None = None) -> DataFrame:
    """(term, weight) of a question: its words without stop words, the parts of identifiers, stems, and expansions of both.

    A small table for bm25f(); of several ways to a term the heaviest counts."""
    words = spark.createDataFrame([(w,) for w in re.findall(r"\w+", question)] or [("",)], "w string").where("w <> ''")
    low = T.fold_tr(F.col("w"))
    plain = words.where(~F.lower("w").isin(*STOP_WORDS))
    parts = plain.select(F.explode(T.split_identifier(F.col("w"))).alias("term"), F.lit(PART).alias("weight"))
    own = plain.select(low.alias("term"), F.lit(EXACT).alias("weight")).unionByName(parts)
    wide = {**{k: [v] for k, v in SHORT_FORMS.items()}, **(expansions or {})}
    more = spark.createDataFrame([(k, t) for k, ts in wide.items() for t in ts], "term string, other string")
    grown = own.join(F.broadcast(more), "term").select(F.col("other").alias("term"), (F.col("weight") * EXPANDED).alias("weight"))
    stems = own.select(T.stem(F.col("term")).alias("term"), (F.col("weight") * STEM).alias("weight"))
    every = reduce(DataFrame.unionByName, [own, stems, grown]).where((F.length("term") > 1) & ~F.col("term").isin(*STOP_WORDS))
    return every.groupBy("term").agg(F.round(F.max("weight"), 4).alias("weight"))


# Turkish endings, one of each kind, in their vowel forms with letters folded.
TURKISH_ENDINGS = "lar|ler|dan|den|tan|ten|nin|nun|in|un|da|de|ta|te|ya|ye|yi|yu|i|u|a|e|im|um|imiz|umuz|siz|suz|li|lu|lik|luk|ci|cu|ca|ce"


def turkish_stems(words: DataFrame, vocabulary: DataFrame, shortest: int = 2) -> DataFrame:
    """(word, stem) of words(word): the longest beginning in vocabulary(stem) whose rest is a chain of endings, else itself."""
    folded = words.select("word", T.fold_tr(F.col("word")).alias("w")).distinct()
    cuts = folded.where(F.length("w") >= shortest).select("word", "w", F.explode(F.sequence(F.lit(shortest), F.length("w"))).alias("n"))
    split = cuts.select("word", F.substring("w", F.lit(1), F.col("n")).alias("stem"), F.expr("substring(w, n + 1)").alias("rest")).where(F.col("rest").rlike(f"^(?:{TURKISH_ENDINGS})*$"))
    best = split.join(vocabulary.select("stem").distinct(), "stem", "left_semi").groupBy("word").agg(F.max_by("stem", F.length("stem")).alias("stem"))
    return folded.join(best, "word", "left").select("word", F.coalesce("stem", "w").alias("stem"))


# -- claims and views ------------------------------------------------------------------------------------------------------


def critique(claims: DataFrame, anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """(claim_id, probe, definitive) of claims that a probe refutes: cited text that is gone from its file (definitive), cited
    text that stands elsewhere in it now, a claim without any citation, and one that rests on a refuted claim.

    claims(claim_id, rests_on), anchors(claim_id, file, line, text)."""
    cited = anchors.alias("a").join(lines.alias("l"), (F.col("a.file") == F.col("l.file")) & (F.trim("a.text") == F.trim("l.text")), "left")
    at = cited.groupBy("a.claim_id", "a.file", "a.line").agg(F.count("l.line").alias("n"), F.max((F.col("l.line") == F.col("a.line")).cast("int")).alias("same"))
    gone = at.where("n = 0").select("claim_id", F.lit("text gone").alias("probe"), F.lit(True).alias("definitive"))
    moved = at.where("n > 0 and coalesce(same, 0) = 0").select("claim_id", F.lit("text moved").alias("probe"), F.lit(False).alias("definitive"))
    bare = claims.join(anchors.select("claim_id"), "claim_id", "left_anti").select("claim_id", F.lit("nothing cited").alias("probe"), F.lit(False).alias("definitive"))
    refuted = gone.select(F.col("claim_id").alias("id")).distinct()
    above = reach(refuted, claims.where("rests_on is not null").select(F.col("rests_on").alias("u"), F.col("claim_id").alias("v"))).where("distance > 0")
    rests = above.select(F.col("id").alias("claim_id"), F.lit("rests on a refuted claim").alias("probe"), F.lit(True).alias("definitive"))
    return reduce(DataFrame.unionByName, [gone, moved, bare, rests]).distinct()


#: Views of a graph by name; each takes (nodes, edges).
VIEWS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "hierarchy": lambda n, e: graphops.hierarchy(n),
    "dependencies": graphops.file_dependencies,
    "folders": lambda n, e: graphops.group_matrix(n, e, T.folder(F.col("source_file"), 1)),
    "tests": lambda n, e: n.where(T.is_test_file(F.col("source_file"))).select("id", "source_file"),
    "degrees": degrees,
}


def view(name: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    if name not in VIEWS:
        raise ValueError(f"no view {name!r}, only {', '.join(sorted(VIEWS))}")
    return VIEWS[name](nodes, edges)


def register_view(name: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    VIEWS[name] = build


def guard_column(relation: Column, line: Column) -> Column:
    """A guard written as relation@line, for graphs whose edges carry no conditions of their own."""
    return F.concat_ws("@", relation, line.cast("string"))
