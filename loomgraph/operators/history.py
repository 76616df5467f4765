"""History: co-change, hotspots, ownership, flaky tests, states at a time, coverage, affected packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lowering import glob_to_regex
from .traverse import innermost, reach


#: Owner rules, at most; they are broadcast.
MAX_RULES = 20_000


def co_changes(commits: DataFrame, most_files: int = 30, shared: int = 3, degree: float = 0.3, linked: DataFrame | None = None) -> DataFrame:
    """(target, other, shared, degree): files in at least ``shared`` commits with a target and ``degree`` of its commits.

    Commits of more than ``most_files`` files do not count, which also bounds the pairs a commit gives; pairs of
    linked(target, other) are left out."""
    rows = commits.select("commit", "path").distinct()
    small = rows.join(rows.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= most_files), "commit", "left_semi")
    own = small.groupBy("path").agg(F.count("*").alias("total"))
    a, b = small.withColumnRenamed("path", "target"), small.withColumnRenamed("path", "other")
    pairs = a.join(b, "commit").where("target <> other").groupBy("target", "other").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)
    out = pairs.join(own.withColumnRenamed("path", "target"), "target").withColumn("degree", F.col("shared") / F.col("total")).where(F.col("degree") >= degree)
    if linked is not None:
        out = out.join(linked, ["target", "other"], "left_anti")
    return out.select("target", "other", "shared", "degree")


def coupled(commits: DataFrame, edges: DataFrame, anchors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, signals): files near anchor files (path): changed together, linked either way, or named as a pair."""
    near = co_changes(commits, shared=2, degree=0.15).join(anchors.withColumnRenamed("path", "target"), "target", "left_semi").select(F.col("other").alias("path"), F.lit("co-change").alias("signal"))
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    by_edge = both.join(anchors.withColumnRenamed("path", "src"), "src", "left_semi").select(F.col("dst").alias("path"), F.lit("neighbour").alias("signal"))
    by_name = pairs.join(anchors.withColumnRenamed("path", "a"), "a", "left_semi").select(F.col("b").alias("path"), F.lit("pair").alias("signal"))
    found = near.unionByName(by_edge).unionByName(by_name).join(anchors, "path", "left_anti")
    return found.groupBy("path").agg(F.sort_array(F.collect_set("signal")).alias("signals"))


def hotspots(commits: DataFrame, complexity: DataFrame, limit: int) -> DataFrame:
    """(path, changes, complexity, score): commits times complexity, highest first, ties by path."""
    changes = commits.groupBy("path").agg(F.count_distinct("commit").alias("changes"))
    cost = complexity.groupBy("path").agg(F.sum("complexity").alias("complexity"))
    return changes.join(cost, "path").withColumn("score", F.col("changes") * F.col("complexity")).orderBy(F.desc("score"), "path").limit(limit)


def ownership(blame: DataFrame) -> DataFrame:
    """(file, author, lines, share, place): lines of each author of a file, the main author at place 1 (ties by author)."""
    own = blame.groupBy("file", "author").agg(F.sum("lines").alias("lines"))
    by = Window.partitionBy("file")
    return own.withColumn("share", F.col("lines") / F.sum("lines").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("lines"), "author")))


def bus_factor(blame: DataFrame) -> DataFrame:
    """(file, bus_factor): the fewest authors that hold more than half of the lines."""
    own = blame.groupBy("file", "author").agg(F.sum("lines").alias("lines"))
    by = Window.partitionBy("file")
    run = own.withColumn("upto", F.sum("lines").over(by.orderBy(F.desc("lines"), "author").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("lines").over(by))
    ranked = run.withColumn("place", F.row_number().over(by.orderBy(F.desc("lines"), "author"))).where(F.col("upto") * 2 > F.col("all"))
    return ranked.groupBy("file").agg(F.min("place").cast("long").alias("bus_factor"))


def knowledge_loss(blame: DataFrame, days: int) -> DataFrame:
    """(file, lost, total): lines of authors whose last change is more than ``days`` before the last of all."""
    end = blame.agg(F.max("last").alias("end"))
    active = blame.groupBy("author").agg(F.max("last").alias("seen"))
    rows = blame.join(active, "author").crossJoin(F.broadcast(end))
    gone = F.col("seen") < F.col("end") - F.make_interval(days=F.lit(days))
    return rows.groupBy("file").agg(F.sum(F.when(gone, F.col("lines")).otherwise(0)).alias("lost"), F.sum("lines").alias("total"))


def flaky(runs: DataFrame) -> DataFrame:
    """(test, trees): trees on which a test both passed and failed."""
    per = runs.groupBy("test", "tree").agg(F.count_distinct("outcome").alias("kinds"))
    return per.where("kinds = 2").groupBy("test").agg(F.count("*").alias("trees"))


def held_fixes(runs: DataFrame, least: int) -> DataFrame:
    """(test, passes, held): passes after the last failure; held if there are ``least``, all on trees that never failed."""
    last = runs.where("outcome = 'fail'").groupBy("test").agg(F.max("seq").alias("last_fail"))
    bad = runs.where("outcome = 'fail'").select("test", "tree", F.lit(1).alias("bad")).distinct()
    after = runs.join(last, "test").where("seq > last_fail").join(bad, ["test", "tree"], "left")
    done = after.groupBy("test").agg(F.count("*").alias("passes"), F.max(F.coalesce("bad", F.lit(0))).alias("bad"))
    return last.join(done, "test", "left").select("test", F.coalesce("passes", F.lit(0)).cast("long").alias("passes"), ((F.coalesce("passes", F.lit(0)) >= least) & (F.coalesce("bad", F.lit(0)) == 0)).alias("held"))


def loop_signals(attempts: DataFrame) -> DataFrame:
    """(session, seq, signal) of attempts(session, seq, tree, signature): tree_reverted where a tree comes back after
    another, a_b_a where a signature does, no_progress where one signature is on three trees by then."""
    by = Window.partitionBy("session").orderBy("seq")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = attempts.withColumn("trees", F.collect_set("tree").over(earlier)).withColumn("before", F.lag("tree").over(by)).withColumn("s1", F.lag("signature", 1).over(by)).withColumn("s2", F.lag("signature", 2).over(by))
    same = F.size(F.collect_set("tree").over(Window.partitionBy("session", "signature").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("same", same)
    signals = F.array_compact(
        F.array(
            F.when(F.array_contains("trees", F.col("tree")) & (F.col("tree") != F.col("before")), F.lit("tree_reverted")),
            F.when((F.col("signature") == F.col("s2")) & (F.col("signature") != F.col("s1")), F.lit("a_b_a")),
            F.when(F.col("same") >= 3, F.lit("no_progress")),
        )
    )
    return rows.select("session", "seq", F.explode(signals).alias("signal"))


def status_at(transitions: DataFrame, moment: Column) -> DataFrame:
    """(claim_id, status) by the last transition at or before a time."""
    return transitions.where(F.col("ts") <= moment).groupBy("claim_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))


def status_at_commit(transitions: DataFrame, parents: DataFrame, revision: str) -> DataFrame:
    """(claim_id, status, basis): recorded at the revision itself (observed), else at its nearest ancestors (strong_inference)
    that agree; unknown where none is recorded or they differ. transitions(claim_id, commit, seq, status, dirty)."""
    spark = transitions.sparkSession
    start = spark.createDataFrame([(revision,)], "id string")
    up = reach(start, parents.select(F.col("commit").alias("u"), F.col("parent").alias("v")))
    at = transitions.where(~F.coalesce("dirty", F.lit(False))).join(up, F.col("commit") == F.col("id"))
    near = at.withColumn("least", F.min("distance").over(Window.partitionBy("claim_id"))).where("distance = least")
    last = near.groupBy("claim_id", "commit", "distance").agg(F.max_by("status", "seq").alias("status"))
    one = last.groupBy("claim_id").agg(F.min("status").alias("low"), F.max("status").alias("high"), F.min("distance").alias("d"))
    known = one.select("claim_id", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("unknown").alias("status"), F.when(F.col("low") != F.col("high"), "unknown").when(F.col("d") == 0, "observed").otherwise("strong_inference").alias("basis"))
    rest = transitions.select("claim_id").distinct().join(known.select("claim_id"), "claim_id", "left_anti")
    return known.unionByName(rest.select("claim_id", F.lit("unknown").alias("status"), F.lit("unknown").alias("basis")))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("latest_r", F.row_number().over(w)).where("latest_r = 1").drop("latest_r")


def coverage_by_symbol(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, symbol, covered, measured) of hits(file, line, hits) by the innermost span that holds each line."""
    return innermost(spans, hits).groupBy("file", "symbol").agg(F.count(F.when(F.col("hits") > 0, 1)).alias("covered"), F.count("*").alias("measured"))


def coverage_change(now: DataFrame, base: DataFrame) -> DataFrame:
    """(file, symbol, change) in percentage points; a symbol on one side only counts as 0 on the other."""
    rate = lambda df, name: df.select("file", "symbol", (100.0 * F.col("covered") / F.col("measured")).alias(name))
    both = rate(now, "a").join(rate(base, "b"), ["file", "symbol"], "full")
    return both.select("file", "symbol", (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("change"))


def code_owners(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, owner) by the last of rules(line, regex, owner) that matches; null where none does. Rules are tried one by one
    on every path, so a file of more than MAX_RULES raises; one rule file of a repository has a few hundred."""
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} owner rules")
    hit = paths.join(F.broadcast(rules), F.expr("path rlike regex"), "left")
    return hit.groupBy("path").agg(F.max_by("owner", "line").alias("owner"))


def owner_regex(glob: str) -> str:
    """The pattern of a code-owners glob: anchored if it has an inner slash, a folder with all below it if it ends in one."""
    anchored = "/" in glob.rstrip("/")
    body = glob.strip("/")
    rx = glob_to_regex(body)[1:-1].replace("[\\s\\S]*[\\s\\S]*", "\u0000").replace("[\\s\\S]*", "[^/]*").replace("\u0000", ".*")
    return ("^" if anchored else "(^|/)") + rx + ("/" if glob.endswith("/") else "($|/)")


def affected_packages(changed: DataFrame, packages: DataFrame, depends: DataFrame) -> DataFrame:
    """(package, distance): packages(package, root) of changed files (path) by longest root, then those that depend on them.

    Every folder of a path is a key, so the prefix join is an equi-join; a package at the top ("") owns no dot folders."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keyed = changed.select("path", F.explode(prefixes).alias("root")).where(~((F.col("root") == "") & F.col("path").startswith(".")))
    own = keyed.join(packages, "root").groupBy("path").agg(F.max_by("package", F.length("root")).alias("package"))
    return reach(own.select(F.col("package").alias("id")), depends.select(F.col("needs").alias("u"), F.col("package").alias("v"))).select(F.col("id").alias("package"), "distance")


def carried_lines(lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """(file, line, new_line): old lines through hunks(file, old_start, old_len, new_len); null where a hunk replaced it."""
    by = Window.partitionBy("file").orderBy("old_start").rowsBetween(Window.unboundedPreceding, 0)
    moved = hunks.withColumn("shift", F.sum(F.col("new_len") - F.col("old_len")).over(by))
    h = moved.select(F.col("file").alias("h_file"), "old_start", "old_len", "shift")
    joined = lines.join(h, (F.col("file") == F.col("h_file")) & (F.col("line") >= F.col("old_start")), "left").groupBy("file", "line").agg(F.max_by(F.struct("old_start", "old_len", "shift"), "old_start").alias("h"))
    inside = F.col("line") < F.col("h.old_start") + F.col("h.old_len")
    return joined.select("file", "line", F.when(inside, F.lit(None)).otherwise(F.col("line") + F.coalesce("h.shift", F.lit(0))).cast("long").alias("new_line"))


def compare_revisions(parents: DataFrame, base: str, head: str) -> DataFrame:
    """(commit, side): commits only the head or only the base has."""
    spark = parents.sparkSession
    hop = parents.select(F.col("commit").alias("u"), F.col("parent").alias("v"))
    a = reach(spark.createDataFrame([(base,)], "id string"), hop).select("id")
    b = reach(spark.createDataFrame([(head,)], "id string"), hop).select("id")
    return b.join(a, "id", "left_anti").select(F.col("id").alias("commit"), F.lit("head").alias("side")).unionByName(a.join(b, "id", "left_anti").select(F.col("id").alias("commit"), F.lit("base").alias("side")))


def affected_tests(mappings: DataFrame, changed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(test, reason): the candidates to run for changed(path, qual). mappings(test, run, path, qual, complete, passed,
    phase): only a test's last run, complete and passed, outside fixtures, rules the test out."""
    last = mappings.groupBy("test").agg(F.max("run").alias("run"))
    now = mappings.join(last, ["test", "run"])
    sound = now.groupBy("test").agg(F.min((F.col("complete") & F.col("passed") & (F.col("phase") != "fixture")).cast("int")).alias("sound"))
    touched = now.join(changed, ["path", "qual"], "left_semi").select("test", F.lit(1).alias("touched")).distinct()
    rows = candidates.join(sound, "test", "left").join(touched, "test", "left")
    reason = F.when(F.col("touched") == 1, "ran a changed function").when(F.coalesce("sound", F.lit(0)) == 0, "no usable mapping")
    return rows.select("test", reason.alias("reason")).where("reason is not null")


def health(functions: DataFrame) -> DataFrame:
    """(name, score, band) of functions(name, lines, complexity, depth, params): 10 less a step for each threshold passed."""
    over = lambda c, *limits: sum(((F.col(c) > x).cast("int") for x in limits), F.lit(0))
    lost = over("lines", 60, 120) + over("complexity", 10, 20, 30) + over("depth", 4, 6) + over("params", 6)
    score = F.greatest(F.lit(1), F.lit(10) - lost)
    return functions.select("name", score.alias("score"), F.when(score >= 8, "healthy").when(score >= 5, "warning").otherwise("alert").alias("band"))


def usage_totals(log: DataFrame) -> DataFrame:
    """(surface, name, calls, seconds) with totals by surface and overall (nulls)."""
    return log.rollup("surface", "name").agg(F.count("*").alias("calls"), F.sum("seconds").alias("seconds"))


def benchmark_scores(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """(question, facts, found) of gold(question, fact, file, a, b) against cited answers(question, file, line)."""
    g, a = gold.alias("g"), answers.alias("a")
    hit = g.join(a, (F.col("g.question") == F.col("a.question")) & (F.col("g.file") == F.col("a.file")) & F.col("a.line").between(F.col("g.a"), F.col("g.b")), "left")
    per = hit.groupBy("g.question", "g.fact").agg(F.max(F.col("a.line").isNotNull().cast("int")).alias("ok"))
    return per.groupBy("question").agg(F.count("*").alias("facts"), F.sum("ok").alias("found"))
