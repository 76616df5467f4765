"""Readers: graphs, corpora, coverage, findings, traces, logs, histories, manifests, as DataFrames."""

from __future__ import annotations

import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def node_link_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link JSON file; _src and _tgt are the true ends, and edges without both ends are dropped."""
    raw = spark.read.option("multiLine", True).json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*")
    links = raw.select(F.explode("links").alias("l")).select("l.*")
    end = lambda own, given: F.coalesce(F.col(own), F.col(given)) if own in links.columns else F.col(given)
    edges = links.withColumn("src", end("_src", "source")).withColumn("dst", end("_tgt", "target"))
    line = F.regexp_extract(F.col("source_location").cast("string"), r"L?(\d+)", 1) if "source_location" in links.columns else F.lit("")
    edges = edges.withColumn("line", F.when(line != "", line.cast("int"))).drop("_src", "_tgt", "source", "target")
    known = nodes.select("id").distinct()
    return nodes, edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")


def corpus(spark: SparkSession, root: str, ignore: str | None = None) -> DataFrame:
    """(path, class, sha, length) of the files below a folder that have a class; ignore: a pattern of paths left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    own = files.select("path", T.file_class(F.col("path")).alias("class"), F.sha2("content", 256).alias("sha"), "length").where("class is not null")
    return own.where(~F.col("path").rlike(ignore)) if ignore else own


_EXTRACTORS: dict[str, tuple[str, ...]] = {
    ".py": (r"^[ ]*(?:async )?def (?P<name>\w+)", r"^[ ]*class (?P<name>\w+)"),
    ".js": (r"^(?:export )?(?:async )?function (?P<name>\w+)", r"^(?:export )?class (?P<name>\w+)"),
    ".go": (r"^func (?:\([^)]*\) )?(?P<name>\w+)", r"^type (?P<name>\w+) struct"),
    ".rs": (r"^\s*(?:pub )?fn (?P<name>\w+)", r"^\s*(?:pub )?struct (?P<name>\w+)"),
}


def register_extractor(suffix: str, *patterns: str) -> None:
    """Definitions of files of a suffix: patterns, one a kind (function, class), whose group ``name`` is the name."""
    for p in patterns:
        if "name" not in re.compile(p).groupindex:
            raise ValueError("a pattern needs a group called name")
    _EXTRACTORS[suffix] = patterns


def symbols(files: DataFrame) -> DataFrame:
    """(file, name, kind, line) of the definitions in files(file, text), by the extractor of their suffix."""
    table = dict(_EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = {s: [re.compile(p) for p in ps] for s, ps in table.items()}
        for pdf in batches:
            rows = []
            for file, body in zip(pdf["file"], pdf["text"], strict=True):
                found = rules.get("." + file.rpartition(".")[2], [])
                for n, line in enumerate((body or "").split("\n"), 1):
                    for kind, rx in zip(("function", "class"), found, strict=False):
                        if m := rx.match(line):
                            rows.append((file, m["name"], kind, n))
            yield pd.DataFrame(rows, columns=["file", "name", "kind", "line"])

    return files.select("file", "text").mapInPandas(run, "file string, name string, kind string, line int")


def office_text(files: DataFrame) -> DataFrame:
    """(path, n, text): paragraphs of .docx, rows of .xlsx and slides of .pptx in files(path, content)."""
    parts = {".docx": (r"word/document\.xml", "p"), ".xlsx": (r"xl/sharedStrings\.xml", "si"), ".pptx": (r"ppt/slides/slide\d+\.xml", "p")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rule = parts.get("." + path.rpartition(".")[2].lower())
                if not rule:
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = sorted(n for n in z.namelist() if re.fullmatch(rule[0], n))
                        blocks = [e for n in names for e in ET.fromstring(z.read(n)).iter() if e.tag.rpartition("}")[2] == rule[1]]
                except (zipfile.BadZipFile, ET.ParseError):
                    continue
                lines = ["".join(t.text or "" for t in b.iter() if t.tag.rpartition("}")[2] == "t") for b in blocks]
                rows += [(path, n, x) for n, x in enumerate((x for x in lines if x.strip()), 1)]
            yield pd.DataFrame(rows, columns=["path", "n", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, n int, text string")


def _lines_in_order(spark: SparkSession, path: str):
    """The lines of text files with their file, and windows that run over the lines of one file; a file may be read in splits."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("report"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    return raw, Window.partitionBy("report").orderBy("split", "at")


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hits) of an lcov report: each record belongs to the source file named last before it."""
    raw, order = _lines_in_order(spark, path)
    file = F.when(F.col("value").startswith("SF:"), F.substring("value", 4, 10_000))
    named = raw.withColumn("file", F.last(file, ignorenulls=True).over(order))
    da = named.where(F.col("value").startswith("DA:"))
    return da.select("file", F.regexp_extract("value", r"^DA:(\d+)", 1).cast("int").alias("line"), F.regexp_extract("value", r"^DA:\d+,(\d+)", 1).cast("int").alias("hits"))


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hits) of a Cobertura report; of a line told twice, the most hits."""
    rows = spark.read.format("xml").option("rowTag", "class").schema("_filename string, lines struct<line: array<struct<_number: int, _hits: int>>>").load(path)
    flat = rows.select(F.col("_filename").alias("file"), F.explode("lines.line").alias("l")).select("file", F.col("l._number").alias("line"), F.col("l._hits").alias("hits"))
    return flat.groupBy("file", "line").agg(F.max("hits").alias("hits"))


def jacoco(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hits) of a JaCoCo report: a line counts as hit if it ran any instruction."""
    rows = spark.read.format("xml").option("rowTag", "sourcefile").schema("_name string, line array<struct<_nr: int, _ci: int>>").load(path)
    return rows.select(F.col("_name").alias("file"), F.explode("line").alias("l")).select("file", F.col("l._nr").alias("line"), F.col("l._ci").alias("hits"))


def coverage_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hits) of a coverage.py JSON report."""
    raw = spark.read.text(path, wholetext=True)
    files = raw.select(F.explode(F.from_json("value", "files map<string, struct<executed_lines: array<int>, missing_lines: array<int>>>")["files"]).alias("file", "f"))
    hit = files.select("file", F.explode("f.executed_lines").alias("line"), F.lit(1).alias("hits"))
    return hit.unionByName(files.select("file", F.explode("f.missing_lines").alias("line"), F.lit(0).alias("hits")))


_SARIF = (
    "runs array<struct<tool: struct<driver: struct<name: string, rules: array<struct<id: string, shortDescription: struct<text: string>>>>>, "
    "results: array<struct<ruleId: string, level: string, message: struct<text: string>, suppressions: array<struct<kind: string>>, "
    "locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>>>>>"
)


def sarif(spark: SparkSession, path: str) -> DataFrame:
    """(tool, rule, description, level, message, file, line) of findings that are not suppressed."""
    runs = spark.read.option("multiLine", True).schema(_SARIF).json(path).select(F.explode("runs").alias("r"))
    rows = runs.select("r.tool.driver.name", "r.tool.driver.rules", F.explode("r.results").alias("x")).where("x.suppressions is null or size(x.suppressions) = 0")
    rule = F.filter(F.coalesce("rules", F.array().cast("array<struct<id:string,shortDescription:struct<text:string>>>")), lambda d: d["id"] == F.col("x.ruleId"))
    at = F.get(F.col("x.locations"), F.lit(0))["physicalLocation"]
    return rows.select(
        F.col("name").alias("tool"), F.col("x.ruleId").alias("rule"), F.get(rule, F.lit(0))["shortDescription"]["text"].alias("description"), F.coalesce("x.level", F.lit("warning")).alias("level"),
        F.col("x.message.text").alias("message"), at["artifactLocation"]["uri"].alias("file"), at["region"]["startLine"].alias("line"),
    )


def sentry_frames(spark: SparkSession, path: str) -> DataFrame:
    """(event, n, file, line, function) of the frames of exception events."""
    schema = "event_id string, exception struct<values: array<struct<stacktrace: struct<frames: array<struct<filename: string, lineno: int, `function`: string>>>>>>"
    events = spark.read.option("multiLine", True).schema(schema).json(path)
    flat = events.select("event_id", F.explode("exception.values").alias("v")).select("event_id", F.posexplode("v.stacktrace.frames").alias("n", "f"))
    return flat.select(F.col("event_id").alias("event"), "n", F.col("f.filename").alias("file"), F.col("f.lineno").alias("line"), F.col("f.function").alias("function"))


def otel_spans(spark: SparkSession, path: str) -> DataFrame:
    """(trace, span, parent, name) of OpenTelemetry JSON."""
    schema = "resourceSpans array<struct<scopeSpans: array<struct<spans: array<struct<traceId: string, spanId: string, parentSpanId: string, name: string>>>>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    s = raw.select(F.explode("resourceSpans").alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("x"))
    return s.select(F.col("x.traceId").alias("trace"), F.col("x.spanId").alias("span"), F.col("x.parentSpanId").alias("parent"), F.col("x.name").alias("name"))


def stack_log(spark: SparkSession, path: str) -> DataFrame:
    """(trace, n, file, line, function) of Python and Java stack traces in a log; a trace starts at its header."""
    raw = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    head = F.col("value").rlike(r"^Traceback \(most recent|^(?:Exception in thread |Caused by: |[\w.]+(?:Exception|Error)(?::|$))").cast("int")
    own = raw.withColumn("trace", F.sum(head).over(Window.orderBy("at"))).where("trace > 0")
    py, java = r'File "([^"]+)", line (\d+), in (\S+)', r"^\s+at ([\w.$<>]+)\((\w+\.\w+):(\d+)\)"
    hit = own.where(F.col("value").rlike(py) | F.col("value").rlike(java))
    is_py = F.col("value").rlike(py)
    part = lambda a, b: F.when(is_py, F.regexp_extract("value", py, a)).otherwise(F.regexp_extract("value", java, b))
    rows = hit.select("trace", "at", part(1, 2).alias("file"), part(2, 3).cast("int").alias("line"), part(3, 1).alias("function"))
    return rows.select("trace", F.row_number().over(Window.partitionBy("trace").orderBy("at")).alias("n"), "file", "line", "function")


def frames_on_files(frames: DataFrame, files: DataFrame) -> DataFrame:
    """frames with the repository path (files.path) that ends like their file, the shortest of several."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    f, p = frames.withColumn("base", base("file")), files.select("path", base("path").alias("base"))
    hit = f.join(p, "base").where(F.concat(F.lit("/"), F.regexp_replace("file", r"^\.?/", "")).endswith(F.concat(F.lit("/"), F.col("path"))) | F.col("path").endswith(F.concat(F.lit("/"), F.col("file"))) | (F.col("path") == F.col("file")))
    return hit.groupBy(*frames.columns).agg(F.min_by("path", F.struct(F.length("path"), F.col("path"))).alias("path"))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, ts, author, path) of a log made by git with --name-only and the format ``@%H|%aI|%an``."""
    raw, order = _lines_in_order(spark, path)
    head = F.when(F.col("value").startswith("@"), F.substring("value", 2, 10_000))
    rows = raw.withColumn("head", F.last(head, ignorenulls=True).over(order)).where("value <> '' and not startswith(value, '@')")
    part = lambda n: F.split("head", r"\|")[n]
    return rows.select(part(0).alias("commit"), part(1).cast("timestamp").alias("ts"), part(2).alias("author"), F.col("value").alias("path"))


def blame_log(spark: SparkSession, path: str) -> DataFrame:
    """(author, lines) of the porcelain form of git blame: its author lines, counted."""
    raw = spark.read.text(path)
    return raw.where(F.col("value").startswith("author ")).groupBy(F.substring("value", 8, 1000).alias("author")).agg(F.count("*").alias("lines"))


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """(surface, name, seconds, chars, ok, broken) of a log of one JSON object a line; unreadable lines have broken set."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    row = raw.select(F.from_json("value", "surface string, name string, seconds double, chars long, ok boolean").alias("r"), F.when(F.try_parse_json("value").isNull(), F.col("value")).alias("broken"))
    return row.select("r.*", "broken")


def manifests(files: DataFrame) -> DataFrame:
    """(root, package, needs) of npm, Cargo, Python and Go manifests in files(path, text); needs is null for none."""

    def one(path: str, body: str) -> tuple[str | None, list[str]]:
        name = path.rpartition("/")[2]
        if name == "package.json":
            d = json.loads(body)
            return d.get("name"), sorted({k for part in ("dependencies", "devDependencies", "peerDependencies") for k in d.get(part, {})})
        if name == "Cargo.toml":
            d = tomllib.loads(body)
            return d.get("package", {}).get("name"), sorted(d.get("dependencies", {}))
        if name == "pyproject.toml":
            d = tomllib.loads(body).get("project", {})
            return d.get("name"), sorted(re.split(r"[\s<>=!~;\[]", x)[0] for x in d.get("dependencies", []))
        if name == "go.mod":
            found = re.findall(r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+v\d", body, re.M)
            m = re.search(r"^module\s+(\S+)", body, re.M)
            return (m[1] if m else None), sorted(found)
        return None, []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, body in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    package, needs = one(path, body or "")
                except (ValueError, AttributeError, TypeError):
                    continue
                if package:
                    root = path.rpartition("/")[0]
                    rows += [(root, package, n) for n in needs] or [(root, package, None)]
            yield pd.DataFrame(rows, columns=["root", "package", "needs"])

    return files.select("path", "text").mapInPandas(run, "root string, package string, needs string")


def topics(text: str, suffix: str = "") -> list[str]:
    """Topics of a JSON list of strings or objects with a name, of a JSON object's keys, or of the lines of a text."""
    if suffix == ".json":
        d = json.loads(text)
        rows = list(d) if isinstance(d, dict) else [x.get("name") if isinstance(x, dict) else x for x in d]
    else:
        rows = [x.strip(" -*\t") for x in text.splitlines() if not x.lstrip().startswith("#")]
    return list(dict.fromkeys(str(x).strip() for x in rows if x and str(x).strip()))


def ddl(files: DataFrame) -> DataFrame:
    """(file, tab, col, refs): columns of CREATE TABLE statements in files(file, text), and the table a column references."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, body in zip(pdf["file"], pdf["text"], strict=True):
                bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", body or "", flags=re.S)
                for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)\s*\(((?:[^()]|\([^()]*\))*)\)", bare, re.I):
                    for part in re.split(r",(?![^()]*\))", m[2]):
                        word = part.split()
                        if word and word[0].lower() not in ("primary", "foreign", "unique", "constraint", "check"):
                            ref = re.search(r"references\s+([\w.\"]+)", part, re.I)
                            rows.append((file, m[1].strip('"').lower(), word[0].strip('"').lower(), ref[1].strip('"').lower() if ref else None))
            yield pd.DataFrame(rows, columns=["file", "tab", "col", "refs"])

    return files.select("file", "text").mapInPandas(run, "file string, tab string, col string, refs string")
