"""Typed questions: closed templates over a graph, answered as one uniform table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graphops, traverse
from .lowering import Graph

MAX_BATCH = 20


def _row(df: DataFrame, name: str, subject: str, answer) -> DataFrame:
    return df.agg(answer.cast("string").alias("answer")).select(F.lit(name).alias("question"), F.lit(subject).alias("subject"), "answer")


def _one(g: Graph, node: str) -> DataFrame:
    return g.nodes.where(F.col("id") == node)


TEMPLATES: dict[str, Callable[..., DataFrame]] = {
    "callers_of": lambda g, n: _row(g.edges.where(F.col("dst") == n), "callers_of", n, F.count_distinct("src")),
    "callees_of": lambda g, n: _row(g.edges.where(F.col("src") == n), "callees_of", n, F.count_distinct("dst")),
    "exists_edge": lambda g, n, r: _row(g.edges.where((F.col("src") == n) & (F.col("relation") == r)), "exists_edge", n, F.count("*") > 0),
    "count_kind": lambda g, k: _row(g.nodes.where(F.array_contains("kinds", k)), "count_kind", k, F.count("*")),
    "location_of": lambda g, n: _row(_one(g, n), "location_of", n, F.min(F.concat_ws(":", "source_file", "line"))),
    "kind_of": lambda g, n: _row(_one(g, n), "kind_of", n, F.min(F.array_join("kinds", ","))),
    "label_of": lambda g, n: _row(_one(g, n), "label_of", n, F.min("label")),
    "degree_of": lambda g, n: _row(g.edges.where((F.col("src") == n) | (F.col("dst") == n)), "degree_of", n, F.count("*")),
    "reaches": lambda g, n, m: _row(traverse.reach(_one(g, n), traverse.oriented(g.edges)).where(F.col("id") == m), "reaches", n, F.count("*") > 0),
    "distance": lambda g, n, m: _row(traverse.reach(_one(g, n), traverse.oriented(g.edges)).where(F.col("id") == m), "distance", n, F.min("distance")),
    "impact_size": lambda g, n: _row(graphops.impact(g.edges, _one(g, n), 4, g.relations or graphops.IMPACT_RELATIONS), "impact_size", n, F.count("*")),
}


def ask(graph: Graph, questions: list[tuple]) -> DataFrame:
    """(question, subject, answer) of up to MAX_BATCH questions, each (template, argument, ...)."""
    if len(questions) > MAX_BATCH:
        raise ValueError(f"more than {MAX_BATCH} questions")
    unknown = [q[0] for q in questions if q[0] not in TEMPLATES]
    if unknown:
        raise ValueError(f"unknown question {unknown[0]!r}")
    return reduce(lambda a, b: a.unionByName(b), [TEMPLATES[name](graph, *args) for name, *args in questions])
