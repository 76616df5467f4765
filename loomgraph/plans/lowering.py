"""Pattern queries as DataFrame plans: node scans, edge joins, semi and anti joins, one aggregate."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.traverse import bounded_paths, oriented
from . import pattern as P

# Statuses from best to worst, by rank, and how many lines and examples a row cites.
STATUSES = ("statically_verified", "strong_inference", "weak_inference", "unknown")
LINES_PER_NODE, EXAMPLES = 3, 3
#: Lines of a bucket in joins of definitions with lines.
LINE_BUCKET = 256
#: Rows that patterns without a common variable may give.
MAX_PRODUCT = 10_000_000
COLUMN = {"name": "name", "label": "label", "file": "source_file", "line": "line", "id": "id"}


@dataclass
class Graph:
    """nodes(id, label, name, source_file, line, kinds) and edges(edge_id, src, dst, relation, confidence, line);
    lines(file, line, text) for text conditions."""

    nodes: DataFrame
    edges: DataFrame
    lines: DataFrame | None = None
    kinds: tuple[str, ...] = P.CODE_KINDS
    relations: tuple[str, ...] | None = None


def glob_to_regex(glob: str) -> str:
    """A Java pattern of a whole shell glob: ``*`` any run, ``?`` one character, ``[..]`` a set, ``[!..]`` none of it."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[^{inner[1:]}]" if inner.startswith("!") else f"[{inner}]")
            i = end
        else:
            out.append(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", c))
        i += 1
    return "^" + "".join(out) + "$"


def _column(var: str, name: str) -> Column:
    return F.col(f"`{var}.{COLUMN[name]}`")


def comparison(c: P.Compare, of=_column) -> Column:
    """A comparison as a Column that is never null: null orders as false and differs from everything."""
    left = of(c.left.var, c.left.field)
    right = of(c.right.var, c.right.field) if isinstance(c.right, P.Ref) else F.lit(c.right)
    if c.op == "!=":
        return ~left.eqNullSafe(right)
    if c.op == "=":
        return F.coalesce(left == right, F.lit(False))
    if c.op in ("~", "glob"):
        return F.coalesce(left.rlike(c.right if c.op == "~" else glob_to_regex(c.right)), F.lit(False))
    made = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[c.op]
    return F.coalesce(made, F.lit(False))


def _conjuncts(c: object) -> list:
    if c is None:
        return []
    return [x for p in c.parts for x in _conjuncts(p)] if isinstance(c, P.Logic) and c.op == "and" else [c]


def _has(c: object, test) -> bool:
    return test(c) or (isinstance(c, P.Logic) and any(_has(p, test) for p in c.parts))


def _negates(c: object, x: object, turned: bool = False) -> bool:
    """Whether x stands under an odd number of NOTs in c."""
    if c is x:
        return turned
    return isinstance(c, P.Logic) and any(_negates(p, x, turned ^ (c.op == "not")) for p in c.parts)


def id_pins(c: object) -> list[str] | None:
    """Ids a condition pins a variable to: one ``id = ..`` or an OR of them."""
    if isinstance(c, P.Compare) and c.left.field == "id" and c.op == "=" and isinstance(c.right, str):
        return [c.right]
    if isinstance(c, P.Logic) and c.op == "or":
        parts = [id_pins(p) for p in c.parts]
        return sum(parts, []) if all(parts) else None
    return None


class Lowering:
    def __init__(self, graph: Graph, query: P.Query) -> None:
        self.graph, self.query, self.serial, self.extra = graph, query, 0, {}
        used = {e for p in self._paths() for x in p.edges for e in x.relations}
        known = graph.relations
        if known is not None and used - set(known):
            raise P.QueryError(f"unknown relation {sorted(used - set(known))[0]!r}")
        self.pushed: dict[str, list] = {}
        self.residual: list = []
        for c in _conjuncts(query.where):
            names = P.condition_vars(c)
            single = len(names) == 1 and not _has(c, lambda x: isinstance(x, P.Exists))
            (self.pushed.setdefault(next(iter(names)), []) if single else self.residual).append(c)
        self.absence = False
        self.folds: dict[str, P.Compare | None] = {}

    def _paths(self):
        def inner(c):
            if isinstance(c, P.Exists):
                yield c.path
            elif isinstance(c, P.Logic):
                for p in c.parts:
                    yield from inner(p)

        yield from self.query.paths
        yield from inner(self.query.where)

    def scan(self, n: P.Node, push: bool = True) -> DataFrame:
        """Candidates of a node: its kinds, then its own conditions, cheap ones first; columns <var>.<column>."""
        df = self.graph.nodes
        if n.var in self.extra:
            df = df.where(self.extra[n.var])
        if n.kinds:
            df = df.where(F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in n.kinds])))
        own = self.pushed.get(n.var, []) if push else []
        pins = [p for c in own if (p := id_pins(c))]
        for ids in pins:
            df = df.where(F.col("id").isin(ids))
        text = []
        for c in own:
            if _has(c, lambda x: isinstance(x, P.Compare) and x.left.field == "text"):
                text.append(c)
            elif not id_pins(c):
                df = df.where(self.boolean(c, lambda _, name: F.col(COLUMN[name]))[0])
        for c in text:
            df = self._by_text(df, c)
        wanted = ["id", "label", "name", "source_file", "line"]
        return df.select(*[F.col(x).alias(f"{n.var}.{x}") for x in wanted])

    def _by_text(self, df: DataFrame, c: object) -> DataFrame:
        """Nodes whose definition has (or, under NOT, has no) line that matches; the join is on file and line buckets."""
        if self.graph.lines is None:
            raise P.QueryError("this graph has no lines to search")
        flags, at = {}, []

        def collect(x: object) -> None:
            if isinstance(x, P.Compare) and x.left.field == "text" and x.right not in flags:
                flags[x.right] = f"t{len(flags)}"
                at.append(x.right)
            elif isinstance(x, P.Logic):
                for p in x.parts:
                    collect(p)

        collect(c)
        for rx in at:
            lines = self.graph.lines.where(F.col("text").rlike(rx)).select(F.col("file").alias("l_file"), F.col("line").alias("l_line"), F.floor(F.col("line") / LINE_BUCKET).alias("l_bucket"))
            end = F.coalesce(F.col("line_end"), F.col("line"))
            cut = df.where(F.col("line") <= end).select("id", "source_file", "line", end.alias("end"), F.explode(F.sequence(F.floor(F.col("line") / LINE_BUCKET), F.floor(end / LINE_BUCKET))).alias("bucket"))
            within = (F.col("source_file") == F.col("l_file")) & (F.col("bucket") == F.col("l_bucket")) & (F.col("l_line") >= F.col("line")) & (F.col("l_line") <= F.col("end"))
            found = cut.join(lines, within).select(F.col("id").alias("f_id")).distinct()
            df = df.join(found, F.col("id") == F.col("f_id"), "left").withColumn(flags[rx], F.col("f_id").isNotNull()).drop("f_id")

        def turn(x: object) -> Column:
            if isinstance(x, P.Compare):
                return F.col(flags[x.right]) if x.left.field == "text" else comparison(x, lambda _, name: F.col(COLUMN[name]))
            made = [turn(p) for p in x.parts]
            out = made[0] if x.op != "not" else ~made[0]
            for m in made[1:]:
                out = (out & m) if x.op == "and" else (out | m)
            return out

        return df.where(turn(c)).drop(*flags.values())

    def boolean(self, c: object, of=_column) -> tuple[Column, None]:
        if isinstance(c, P.Compare):
            return comparison(c, of), None
        made = [self.boolean(p, of)[0] for p in c.parts]
        out = ~made[0] if c.op == "not" else made[0]
        for m in made[1:]:
            out = (out & m) if c.op == "and" else (out | m)
        return out, None

    def hops(self, e: P.Edge, starts: DataFrame, few: bool, ends: DataFrame | None) -> DataFrame:
        """(u, v, inferred): pairs an edge pattern joins. few: the starts are restricted; ends: the ids the other end is
        restricted to. Edges are met by both before they are grouped, so a selective end prunes the shuffle."""
        all_hops = oriented(self.graph.edges, e.way, e.relations)
        if (e.low, e.high) != (1, 1):
            return bounded_paths(starts, all_hops, e.low, e.high).select(F.col("start").alias("u"), F.col("end").alias("v"), "inferred")
        if few:
            all_hops = all_hops.join(starts.select(F.col("id").alias("u")), "u", "left_semi")
        if ends is not None:
            all_hops = all_hops.join(ends.select(F.col("id").alias("v")), "v", "left_semi")
        return all_hops.groupBy("u", "v").agg(F.min("inferred").alias("inferred"))

    def fold(self) -> None:
        """Find the variables that are only counted: an end of a pattern met once, reached by one hop, not returned, and in no
        condition with others but one comparison with a node of its pattern. Their nodes become a weight, not rows."""
        shown = {i.var for i in self.query.items}
        met = [n.var for p in self.query.paths for n in p.nodes]
        line = lambda r: r.field == "line"
        for p in self.query.paths:
            for n, e in ((p.nodes[-1], p.edges[-1]), (p.nodes[0], p.edges[0])) if p.edges else ():
                own = [c for c in self.residual if n.var in P.condition_vars(c)]
                fits = all(
                    isinstance(c, P.Compare) and c.op in ("=", "<", "<=", ">", ">=") and isinstance(c.right, P.Ref) and line(c.left) == line(c.right) and {c.left.var, c.right.var} <= p.vars()
                    for c in own
                )
                if n.var not in shown and met.count(n.var) == 1 and (e.low, e.high) == (1, 1) and len(own) <= 1 and fits:
                    self.folds[n.var] = own[0] if own else None
                    self.residual = [c for c in self.residual if c not in own]
                    break

    def _counted(self, df: DataFrame, at: Column, pairs: DataFrame, right: DataFrame, var: str) -> DataFrame:
        """df joined with the number of nodes of a folded variable at each node, by status; an order comparison is a running
        sum over the values of a node, so pairs are never listed."""
        c = self.folds[var]
        by_u = at == F.col("hop_u")
        reached = pairs.join(right, F.col("v") == F.col(f"`{var}.id`"))
        if c is None:
            found, on = reached.groupBy("u", "inferred").agg(F.count("*").alias("k")), by_u
        else:
            mine, other, op = (c.left, c.right, c.op) if c.left.var == var else (c.right, c.left, c.op.translate(str.maketrans("<>", "><")))
            there = _column(other.var, other.field)
            on = by_u & (there == F.col("hop_key"))
            found = reached.select("u", "inferred", _column(var, mine.field).alias("key")).where("key is not null").groupBy("u", "inferred", "key").agg(F.count("*").alias("k"))
            if op != "=":
                asked = df.select(at.alias("u"), there.alias("key")).where("key is not null").distinct().join(found.select("u", "inferred").distinct(), "u")
                both = found.withColumn("asked", F.lit(False)).unionByName(asked.select("u", "inferred", "key", F.lit(0).cast("long").alias("k"), F.lit(True).alias("asked")))
                values = both.groupBy("u", "inferred", "key").agg(F.sum("k").alias("k"), F.max("asked").alias("asked"))
                before = Window.partitionBy("u", "inferred").orderBy(F.asc("key") if op[0] == "<" else F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
                total = F.sum("k").over(before) - (F.lit(0) if len(op) == 2 else F.col("k"))
                found = values.withColumn("total", total).where("asked and total > 0").select("u", "inferred", "key", F.col("total").alias("k"))
        found = found.select(*[F.col(x).alias(y) for x, y in (("u", "hop_u"), ("inferred", "hop_i"), ("key", "hop_key"), ("k", "hop_k")) if x in found.columns])
        df = df.join(found, on).withColumn("weight", F.col("weight") * F.col("hop_k")).withColumn("inferred", F.col("inferred") | F.col("hop_i"))
        return df.drop("hop_u", "hop_i", "hop_key", "hop_k")

    def path(self, p: P.Path, local: bool = False, outer: set[str] = frozenset(), given: dict[str, DataFrame] | None = None) -> DataFrame:
        """Bindings of a pattern: node columns and ``inferred``; a variable met again is an equality. given: for variables
        that are bound already, a table of their columns that their nodes are taken from."""
        given = given or {}
        folds = {} if local else self.folds
        if p.nodes[0].var in folds or (len(p.edges) == 1 and not local and self._ends_smaller(p)) or (p.nodes[0].var not in given and p.nodes[-1].var in given):
            p = P.Path(p.nodes[::-1], tuple(P.Edge(e.relations, {"out": "in", "in": "out"}.get(e.way, e.way), e.low, e.high) for e in p.edges[::-1]))

        def candidates(n: P.Node) -> DataFrame:
            if n.var not in given:
                return self.scan(n, push=not local or n.var in outer)
            known = given[n.var]
            if not n.kinds:
                return known
            return known.join(self.scan(n, False).select(F.col(f"`{n.var}.id`").alias("kind_id")), F.col(f"`{n.var}.id`") == F.col("kind_id"), "left_semi")

        narrow = lambda n: n.var in given or ((not local or n.var in outer) and bool(self.pushed.get(n.var)))
        first = p.nodes[0]
        df, few, seen = candidates(first).withColumn("inferred", F.lit(False)), narrow(first), {first.var}
        if folds:
            df = df.withColumn("weight", F.lit(1).cast("long"))
        for last, e, n in zip(p.nodes[:-1], p.edges, p.nodes[1:], strict=True):
            at = F.col(f"`{last.var}.id`")
            right = None if n.var in seen else candidates(n)
            ends = right.select(F.col(f"`{n.var}.id`").alias("id")) if right is not None and narrow(n) else None
            pairs = self.hops(e, df.select(at.alias("id")), few, ends)
            equal = [] if local or right is None or n.var in folds else self._equalities(n.var, seen)
            if n.var in folds:
                df = self._counted(df, at, pairs, right, n.var)
                continue
            if equal:
                # an equality of fields is a key of this join: without it every two nodes around a hub would meet first
                reached = pairs.select(F.col("u").alias("hop_u"), F.col("v").alias("hop_v"), F.col("inferred").alias("hop_i")).join(right, F.col("hop_v") == F.col(f"`{n.var}.id`"))
                df = df.join(reached, reduce(lambda a, b: a & b, equal, at == F.col("hop_u"))).withColumn("inferred", F.col("inferred") | F.col("hop_i")).drop("hop_u", "hop_v", "hop_i")
                few = few or narrow(n)
                seen.add(n.var)
                continue
            df = df.join(pairs.select(F.col("u").alias("hop_u"), F.col("v").alias("hop_v"), F.col("inferred").alias("hop_i")), at == F.col("hop_u"))
            df = df.withColumn("inferred", F.col("inferred") | F.col("hop_i")).drop("hop_u", "hop_i")
            if right is None:
                df = df.where(F.col(f"`{n.var}.id`") == F.col("hop_v"))
                if n.kinds:
                    df = df.join(self.scan(n, False).select(F.col(f"`{n.var}.id`").alias("hop_k")), F.col("hop_v") == F.col("hop_k"), "left_semi")
                df = df.drop("hop_v")
            else:
                df = df.join(right, F.col("hop_v") == F.col(f"`{n.var}.id`")).drop("hop_v")
            few = few or narrow(n)
            seen.add(n.var)
        return df

    def _equalities(self, var: str, seen: set[str]) -> list[Column]:
        """Equalities of a field of var with a field of a variable of its pattern that is bound before it."""
        own = [c for c in self.residual if isinstance(c, P.Compare) and c.op == "=" and isinstance(c.right, P.Ref)]
        own = [c for c in own if (c.left.field == "line") == (c.right.field == "line") and var in (c.left.var, c.right.var) and ({c.left.var, c.right.var} - {var}) <= seen and c.left.var != c.right.var]
        return [_column(c.left.var, c.left.field) == _column(c.right.var, c.right.field) for c in own]

    def _ends_smaller(self, p: P.Path) -> bool:
        """Whether a variable-length edge should be walked from its far end: that end is pinned, this one is not."""
        pinned = lambda v: any(id_pins(c) for c in self.pushed.get(v, []))
        return p.edges[0].high > 1 and pinned(p.nodes[1].var) and not pinned(p.nodes[0].var)

    def _columns(self, df: DataFrame, var: str) -> DataFrame:
        return df.select(*[F.col(f"`{var}.{c}`") for c in ("id", "label", "name", "source_file", "line")]).distinct()

    def bindings(self) -> DataFrame:
        """All patterns joined, the restricted ones first, so that what they bind narrows the others."""
        narrow = lambda p: sum(bool(self.pushed.get(v)) for v in p.vars())
        df, seen, few = None, set(), False
        rest = list(self.query.paths)
        while rest:
            p = max(rest, key=lambda x: (df is None or bool(seen & x.vars()), narrow(x)))
            rest.remove(p)
            shared = sorted(seen & p.vars())
            own = self.path(p, given={v: self._columns(df, v) for v in shared} if few else None)
            if df is None:
                df = own
            else:
                renamed = own.withColumnsRenamed({"inferred": "other_inferred", "weight": "other_weight"})
                for v in shared:
                    for c in ("label", "name", "source_file", "line"):
                        renamed = renamed.drop(f"{v}.{c}")
                    renamed = renamed.withColumnRenamed(f"{v}.id", f"{v}.id2")
                if shared:
                    on = F.lit(True)
                    for v in shared:
                        on = on & (F.col(f"`{v}.id`") == F.col(f"`{v}.id2`"))
                    df = df.join(renamed, on).drop(*[f"{v}.id2" for v in shared])
                else:
                    self._product(df, renamed)
                    df = df.crossJoin(renamed)
                df = df.withColumn("inferred", F.col("inferred") | F.col("other_inferred")).drop("other_inferred")
                if self.folds:
                    df = df.withColumn("weight", F.col("weight") * F.col("other_weight")).drop("other_weight")
            seen |= p.vars()
            few = few or bool(narrow(p))
        for c in self.residual:
            df = self.restrict(df, c, seen)
        return df

    def _product(self, a: DataFrame, b: DataFrame) -> None:
        """Patterns without a common variable multiply: raise if that gives more rows than MAX_PRODUCT."""
        n, m = a.count(), b.count()
        if n * m > MAX_PRODUCT:
            raise P.QueryError(f"patterns without a common variable would give {n} x {m} rows, {MAX_PRODUCT} are allowed")

    def witness(self, e: P.Exists, seen: set[str], df: DataFrame) -> tuple[DataFrame, list[str]]:
        shared = sorted(seen & e.path.vars())
        found = self.path(e.path, local=True, outer=set(shared), given={v: self._columns(df, v) for v in shared})
        return found.select(*[F.col(f"`{v}.id`").alias(f"x{i}") for i, v in enumerate(shared)]).distinct(), shared

    def restrict(self, df: DataFrame, c: object, seen: set[str]) -> DataFrame:
        negated = isinstance(c, P.Logic) and c.op == "not" and isinstance(c.parts[0], P.Exists)
        if isinstance(c, P.Exists) or negated:
            found, shared = self.witness(c.parts[0] if negated else c, seen, df)
            on = F.lit(True)
            for i, v in enumerate(shared):
                on = on & (F.col(f"`{v}.id`") == F.col(f"x{i}"))
            self.absence |= negated
            return df.join(found, on, "left_anti" if negated else "left_semi")
        flags: list[str] = []

        def turn(x: object) -> Column:
            nonlocal df
            if isinstance(x, P.Exists):
                found, shared = self.witness(x, seen, df)
                self.absence |= _negates(c, x)
                self.serial += 1
                flag = f"exists{self.serial}"
                marked = found.withColumn(flag, F.lit(True))
                on = F.lit(True)
                for i, v in enumerate(shared):
                    on = on & (F.col(f"`{v}.id`") == F.col(f"x{i}"))
                df = df.join(marked, on, "left").drop(*[f"x{i}" for i in range(len(shared))])
                flags.append(flag)
                return F.coalesce(F.col(flag), F.lit(False))
            if isinstance(x, P.Compare):
                return comparison(x)
            made = [turn(p) for p in x.parts]
            out = ~made[0] if x.op == "not" else made[0]
            for m in made[1:]:
                out = (out & m) if x.op == "and" else (out | m)
            return out

        condition = turn(c)
        return df.where(condition).drop(*flags)

    def examples(self, df: DataFrame, keys: list) -> DataFrame:
        """Up to EXAMPLES bindings of each row, sure ones first, then by id: one ``var=id`` list of words each."""
        names = list(dict.fromkeys(n.var for p in self.query.paths for n in p.nodes if n.named))
        shown = F.array_join(F.array(*[F.concat(F.lit(f"{v}="), F.col(f"`{v}.id`")) for v in names]), " ")
        flat = df.select(*keys, "inferred", shown.alias("shown")).distinct()
        own = [f"`{c}`" for c in flat.columns[: len(keys)]]
        first = Window.partitionBy(*own).orderBy("inferred", "shown") if own else Window.partitionBy(F.lit(0)).orderBy("inferred", "shown")
        few = flat.withColumn("place", F.row_number().over(first)).where(F.col("place") <= EXAMPLES)
        return few.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda x: x["shown"]).alias("examples"))

    def result(self, explain: bool = False) -> DataFrame:
        """The rows of the query, with ``bindings`` and ``status``; a plain variable is its id. With explain, also ``absence``,
        whether the query's rows rest on an edge that is not there, and ``examples``."""
        q = self.query
        if not explain and not self.folds:
            self.fold()
        df = self.bindings()
        rows = F.coalesce(F.sum("weight"), F.lit(0)) if self.folds else F.count("*")
        rank = F.when(F.col("inferred"), F.lit(2)).otherwise(F.lit(1))
        keys = [i for i in q.items if not i.count]
        key = [_column(i.var, i.field or "id").alias(i.name) for i in keys]
        counts = [i for i in q.items if i.count]
        measures = [(rows if i.var == "*" else F.count_distinct(_column(i.var, "id"))).cast("long").alias(i.name) for i in counts]
        # a row without COUNT has the best status of its bindings, a group with one the worst
        status = (F.max if counts else F.min)(rank)
        named = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.coalesce(status, F.lit(1)) + 1).alias("status")
        out = df.groupBy(*key).agg(*measures, rows.cast("long").alias("bindings"), named)
        columns = [i.name for i in q.items] + ["bindings", "status"]
        out = out.select(*dict.fromkeys(columns))
        if explain:
            shown = self.examples(df, key)
            on = reduce(lambda a, b: a & b, [F.col(f"o.`{i.name}`").eqNullSafe(F.col(f"s.`{i.name}`")) for i in keys], F.lit(True))
            both = out.alias("o").join(shown.alias("s"), on, "left")
            out = both.select(*[F.col(f"o.`{c}`") for c in out.columns], F.lit(self.absence).alias("absence"), F.coalesce("s.examples", F.array().cast("array<string>")).alias("examples"))
        if q.limit is not None:
            order = [F.desc("bindings")] if counts else []
            out = out.orderBy(*order, *[F.col(i.name) for i in keys]).limit(q.limit)
        return out


def run(graph: Graph, query: str | P.Query) -> DataFrame:
    """The rows of a query, given as text or as a built tree."""
    tree = P.parse(query, graph.kinds) if isinstance(query, str) else query
    return Lowering(graph, tree).result()


def explained(graph: Graph, query: str | P.Query, exists_where: dict[str, Column] | None = None) -> DataFrame:
    """The rows of a query with ``absence`` and ``examples``. exists_where: conditions on node columns for variables, which
    hold inside EXISTS too."""
    tree = P.parse(query, graph.kinds) if isinstance(query, str) else query
    lowered = Lowering(graph, tree)
    lowered.extra = dict(exists_where or {})
    return lowered.result(explain=True)


def run_capped(graph: Graph, query: str | P.Query, max_rows: int = 200) -> tuple[list, bool]:
    """At most max_rows rows on the driver and whether these are all."""
    rows = run(graph, query).limit(max_rows + 1).collect()
    return rows[:max_rows], len(rows) <= max_rows


def views(graph: Graph, query: str | P.Query) -> DataFrame:
    """Bindings with each returned variable as a struct (id, label, file, line), for callers that show nodes."""
    tree = P.parse(query, graph.kinds) if isinstance(query, str) else query
    df = Lowering(graph, tree).bindings()
    shown = [F.struct(*[_column(i.var, f).alias(f) for f in ("id", "label", "file", "line")]).alias(i.var) for i in tree.items if not i.count and i.field is None]
    return df.select(*shown, "inferred").distinct()


def cited_lines(graph: Graph, nodes: DataFrame, rx: str, most: int = LINES_PER_NODE) -> DataFrame:
    """(id, line, text) of the first lines of each node's definition that match."""
    end = F.coalesce(F.col("line_end"), F.col("n.line"))
    n, lines = nodes.alias("n"), graph.lines.where(F.col("text").rlike(rx)).alias("l")
    hits = n.join(lines, (F.col("n.source_file") == F.col("l.file")) & (F.col("l.line") >= F.col("n.line")) & (F.col("l.line") <= end)).select("id", F.col("l.line").alias("line"), F.col("l.text").alias("text"))
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("line"))).where(F.col("r") <= most).drop("r")
