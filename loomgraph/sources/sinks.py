"""Writers: graphs as node-link JSON, GraphML, Cypher, notes, Mermaid and SVG; findings as SARIF."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ShrinkError(ValueError):
    """A graph that would lose more than half of its nodes."""


def node_link_json(nodes: DataFrame, edges: DataFrame, path: str, previous: int | None = None, force: bool = False) -> int:
    """One JSON object a line, nodes then edges, each sorted, so that equal graphs give equal files; the number of nodes.

    Refuses a graph of under half the nodes it had, unless forced."""
    n = nodes.count()
    if previous and n * 2 < previous and not force:
        raise ShrinkError(f"{n} nodes, {previous} before")
    rows = nodes.select(F.lit(0).alias("part"), F.col("id").alias("k"), F.to_json(F.struct(*sorted(nodes.columns))).alias("value"))
    links = edges.select(F.lit(1).alias("part"), F.concat_ws("\0", "src", "dst", "relation").alias("k"), F.to_json(F.struct(*sorted(edges.columns))).alias("value"))
    rows.unionByName(links).repartitionByRange("part", "k", "value").sortWithinPartitions("part", "k", "value").select("value").write.mode("overwrite").text(path)
    return n


def _xml(c: str) -> Column:
    out = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): the elements of a directed GraphML document; part orders header, nodes, edges and end."""
    spark = nodes.sparkSession
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'
    frame = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "part int, value string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml("id"), F.lit('"><data key="label">'), _xml("label"), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('"><data key="relation">'), _xml("relation"), F.lit("</data></edge>")).alias("value"))
    return frame.unionByName(n).unionByName(e)


def _quoted(c: str) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): statements that make the nodes, then the edges."""
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("MERGE (n:Node {id: "), _quoted("id"), F.lit("}) SET n.label = "), _quoted("label"), F.lit(";")).alias("value"))
    kind = F.upper(F.regexp_replace("relation", "[^A-Za-z0-9_]", "_"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit("MATCH (a:Node {id: "), _quoted("src"), F.lit("}), (b:Node {id: "), _quoted("dst"), F.lit("}) MERGE (a)-[:"), kind, F.lit("]->(b);")).alias("value"))
    return n.unionByName(e)


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, value): one Markdown note a source file with its symbols and links to other files' notes."""
    file = nodes.select("id", "source_file")
    out = edges.join(file.select(F.col("id").alias("src"), F.col("source_file").alias("file")), "src").join(file.select(F.col("id").alias("dst"), F.col("source_file").alias("to")), "dst").where("file <> to")
    links = out.groupBy("file").agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("- [["), F.col("to"), F.lit("]]")))), "\n").alias("links"))
    own = nodes.groupBy(F.col("source_file").alias("file")).agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("- "), F.col("label")))), "\n").alias("symbols"))
    return own.join(links, "file", "left").select("file", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("file")), F.col("symbols"), F.col("links")).alias("value"))


def mermaid(pairs: DataFrame, top: int = 60) -> str:
    """A flow chart of the heaviest (group_from, group_to, refs) links; a drawing, so the top is its feature."""
    rows = pairs.orderBy(F.desc("refs"), "group_from", "group_to").limit(top).collect()
    names = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in (r["group_from"], r["group_to"])}))}
    body = [f'  {i}["{n}"]'.replace('""', '"') for n, i in names.items()] + [f"  {names[r['group_from']]} -->|{r['refs']}| {names[r['group_to']]}" for r in rows]
    return "\n".join(["flowchart LR", *body])


def svg(pairs: DataFrame, top: int = 40) -> str:
    """A circle drawing of the most linked groups."""
    import math

    rows = pairs.orderBy(F.desc("refs"), "group_from", "group_to").limit(top).collect()
    names = sorted({x for r in rows for x in (r["group_from"], r["group_to"])})
    at = {n: (400 + 300 * math.cos(2 * math.pi * i / len(names)), 400 + 300 * math.sin(2 * math.pi * i / len(names))) for i, n in enumerate(names)}
    lines = [f'<line x1="{at[r["group_from"]][0]:.1f}" y1="{at[r["group_from"]][1]:.1f}" x2="{at[r["group_to"]][0]:.1f}" y2="{at[r["group_to"]][1]:.1f}" stroke="#999"/>' for r in rows]
    marks = [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="5"/><text x="{x + 7:.1f}" y="{y:.1f}" font-size="11">{html.escape(str(n))}</text>' for n, (x, y) in at.items()]
    return '<svg xmlns="http://www.w3.org/2000/svg" width="800" height="800">' + "".join(lines + marks) + "</svg>"


# Verdicts as SARIF levels.
LEVELS = {"VIOLATED": "error", "POSSIBLE": "warning", "REVIEW": "note", "TRIGGER": "note"}


def sarif(findings: DataFrame, tool: str) -> str:
    """A SARIF 2.1 log of findings(rule, verdict, message, file, line)."""
    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("verdict"))
    rows = findings.select("rule", F.coalesce(level, F.lit("none")).alias("level"), "message", "file", "line").orderBy("file", "line", "rule", "message").toLocalIterator()
    results = [
        {"ruleId": r["rule"], "level": r["level"], "message": {"text": r["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": r["line"]}}}]}
        for r in rows
    ]
    rules = [{"id": x} for x in sorted({r["ruleId"] for r in results})]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]}, indent=1)
