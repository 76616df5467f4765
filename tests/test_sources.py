import json

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import readers, sinks


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_node_link_graphs_restore_direction_and_drop_loose_ends(spark, tmp_path):
    doc = {
        "nodes": [{"id": "a", "label": "A"}, {"id": "b", "label": "B"}],
        "links": [{"source": "a", "target": "b", "_src": "b", "_tgt": "a", "relation": "calls", "source_location": "L7"}, {"source": "a", "target": "x", "relation": "calls"}],
    }
    nodes, edges = readers.node_link_graph(spark, put(tmp_path, "g.json", json.dumps(doc)))
    assert nodes.count() == 2 and [(r["src"], r["dst"], r["line"]) for r in edges.collect()] == [("b", "a", 7)]


def test_coverage_reports(spark, tmp_path):
    lcov = readers.lcov(spark, put(tmp_path, "a.info", "SF:x.py\nDA:1,2\nDA:2,0\nend_of_record\nSF:y.py\nDA:5,1\n"))
    assert sorted(map(tuple, lcov.collect())) == [("x.py", 1, 2), ("x.py", 2, 0), ("y.py", 5, 1)]
    js = readers.coverage_json(spark, put(tmp_path, "c.json", json.dumps({"files": {"x.py": {"executed_lines": [1], "missing_lines": [2, 3]}}})))
    assert sorted(map(tuple, js.collect())) == [("x.py", 1, 1), ("x.py", 2, 0), ("x.py", 3, 0)]
    xml = '<coverage><packages><package><classes><class filename="x.py"><lines><line number="1" hits="0"/><line number="1" hits="4"/></lines></class></classes></package></packages></coverage>'
    assert [tuple(r) for r in readers.cobertura(spark, put(tmp_path, "c.xml", xml)).collect()] == [("x.py", 1, 4)]


def test_findings_keep_what_is_not_suppressed(spark, tmp_path):
    at = {"physicalLocation": {"artifactLocation": {"uri": "f.py"}, "region": {"startLine": 3}}}
    results = [{"ruleId": "r1", "message": {"text": "bad"}, "locations": [at]}, {"ruleId": "r2", "message": {"text": "known"}, "suppressions": [{"kind": "inSource"}], "locations": [at]}]
    doc = {"runs": [{"tool": {"driver": {"name": "t", "rules": [{"id": "r1", "shortDescription": {"text": "about"}}]}}, "results": results}]}
    assert [tuple(r) for r in readers.sarif(spark, put(tmp_path, "s.json", json.dumps(doc))).collect()] == [("t", "r1", "about", "warning", "bad", "f.py", 3)]


def test_logs_and_histories(spark, tmp_path):
    log = 'noise\nTraceback (most recent call last):\n  File "/app/src/a.py", line 3, in go\njava.lang.RuntimeException: x\n\tat com.x.Y.run(Y.java:12)\n'
    frames = readers.stack_log(spark, put(tmp_path, "l.txt", log))
    assert sorted(tuple(r)[2:] for r in frames.collect()) == [("/app/src/a.py", 3, "go"), ("Y.java", 12, "com.x.Y.run")]
    files = spark.createDataFrame([("src/a.py",), ("lib/Y.java",), ("other/b.py",)], "path string")
    assert sorted(r["path"] for r in readers.frames_on_files(frames, files).collect()) == ["lib/Y.java", "src/a.py"]
    commits = readers.commit_log(spark, put(tmp_path, "g.txt", "@c1|2024-01-02T03:04:05Z|Ann\n\na.py\nb.py\n@c2|2024-01-03T00:00:00Z|Bo\n\na.py\n"))
    assert sorted((r["commit"], r["author"], r["path"]) for r in commits.collect()) == [("c1", "Ann", "a.py"), ("c1", "Ann", "b.py"), ("c2", "Bo", "a.py")]
    usage = readers.usage_log(spark, put(tmp_path, "u.jsonl", '{"surface": "cli", "name": "q", "seconds": 1.5}\nnot json\n'))
    assert usage.where("broken is not null").count() == 1 and usage.where("surface = 'cli'").count() == 1


def test_manifests_definitions_and_tables(spark):
    files = spark.createDataFrame([("a/package.json", '{"name": "a", "dependencies": {"b": "1"}}'), ("b/Cargo.toml", '[package]\nname = "b"\n'), ("c/package.json", "{broken")], "path string, text string")
    assert sorted(map(tuple, readers.manifests(files).collect())) == [("a", "a", "b"), ("b", "b", None)]
    code = spark.createDataFrame([("x.py", "def go():\n    pass\nclass C:\n    def m(self): pass"), ("y.sql", "create table t (id int, u int references users(id), primary key (id));"), ("z.py", None)], "file string, text string")
    assert sorted(map(tuple, readers.symbols(code).collect())) == [("x.py", "C", "class", 3), ("x.py", "go", "function", 1), ("x.py", "m", "function", 4)]
    assert sorted(map(tuple, readers.ddl(code).collect())) == [("y.sql", "t", "id", None), ("y.sql", "t", "u", "users")]
    assert readers.topics('["a", {"name": "b"}, "a"]', ".json") == ["a", "b"] and readers.topics("# head\n- x\ny\n") == ["x", "y"]
    with pytest.raises(ValueError, match="name"):
        readers.register_extractor(".zz", "x")


def test_writers(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 'A<"', "f1"), ("b", "B'", "f2")], "id string, label string, source_file string")
    edges = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, relation string")
    out = f"file://{tmp_path}/g"
    assert sinks.node_link_json(nodes, edges, out) == 2
    assert [json.loads(r["value"])["id"] for r in spark.read.text(out).collect()[:2]] == ["a", "b"]
    with pytest.raises(sinks.ShrinkError):
        sinks.node_link_json(nodes, edges, out, previous=5)
    text = "".join(r["value"] for r in sinks.graphml(nodes, edges).orderBy("part").collect())
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(text).findall(".//{*}node")) == 2
    assert any("\\'" in r["value"] for r in sinks.cypher(nodes, edges).collect())
    assert {r["file"]: r["value"] for r in sinks.notes(nodes, edges).collect()}["f1"].endswith("- [[f2]]")
    pairs = spark.createDataFrame([("x", "y", 3)], "group_from string, group_to string, refs long")
    assert "n0 -->|3| n1" in sinks.mermaid(pairs) and sinks.svg(pairs).startswith("<svg")
    found = spark.createDataFrame([("r", "VIOLATED", "m", "f", 1)], "rule string, verdict string, message string, file string, line int")
    assert json.loads(sinks.sarif(found, "t"))["runs"][0]["results"][0]["level"] == "error"
    assert F is not None
