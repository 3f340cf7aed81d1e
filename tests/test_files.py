"""Import and export in every format, and the command line."""

import io
import json

import pytest

from tesserine import cli
from tesserine.api import Database
from tesserine.operators.graph import Graph
from tesserine.sources import files

GRAPH = {
    "nodes": [{"id": "a", "labels": ["Person"], "properties": {"name": "Ann", "age": 3}}, {"id": "b", "labels": ["Person", "Boss"], "properties": {"name": "Bo \"x\""}}, {"id": "c", "labels": [], "properties": {"name": "none"}}],
    "edges": [{"source": "a", "target": "b", "type": "KNOWS", "properties": {"since": 1}}, {"source": "a", "target": "b", "type": "KNOWS", "properties": {"since": 2}}, {"source": "b", "target": "c", "type": "works at", "properties": {}}],
}


@pytest.fixture
def db(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(GRAPH))
    made = Database(spark)
    made.graph = files.import_json(made.graph, f"file://{tmp_path}/g.json")
    return made


def text(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_json_there_and_back(db, spark, tmp_path):
    assert db.node_count() == 3 and db.edge_count() == 3
    files.export_json(db.graph, f"file://{tmp_path}/one")
    files.export_json(files.import_json(Graph(spark), f"file://{tmp_path}/g.json"), f"file://{tmp_path}/two")
    dump = text(tmp_path / "one").replace("\n", "")
    assert dump == text(tmp_path / "two").replace("\n", "")
    got = json.loads(dump)
    assert [n["properties"].get("name") for n in got["nodes"]] == ["Ann", 'Bo "x"', "none"]
    assert [(e["source"], e["target"], e["type"]) for e in got["edges"]] == sorted((e["source"], e["target"], e["type"]) for e in got["edges"])
    assert [e["properties"] for e in got["edges"]] == [{"since": 1}, {"since": 2}, {}]


def test_edges_without_ends_fail_or_are_skipped(spark, tmp_path):
    bad = {**GRAPH, "edges": [{"source": "a", "target": "zz", "type": "T", "properties": {}}]}
    (tmp_path / "g.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError):
        files.import_json(Graph(spark), f"file://{tmp_path}/g.json")
    assert files.import_json(Graph(spark), f"file://{tmp_path}/g.json", skip_errors=True).edges == {}


def test_lines_and_dot_and_labels(db, tmp_path):
    files.export_jsonl(db.graph, f"file://{tmp_path}/lines", "Person,Boss")
    lines = [json.loads(x) for x in text(tmp_path / "lines").splitlines()]
    assert sorted((x["kind"], x["value"].get("type", "")) for x in lines) == [("edge", "KNOWS"), ("edge", "KNOWS"), ("node", ""), ("node", "")]
    files.export_dot(db.graph, f"file://{tmp_path}/dot")
    dot = text(tmp_path / "dot").splitlines()
    assert dot[0] == "digraph G {" and dot[-1] == "}" and sum(" -> " in x for x in dot) == 3 and '  n1 [label="Person"];' in dot and any('[label="works at"]' in x for x in dot)


def test_csv_types(spark, tmp_path):
    (tmp_path / "n.csv").write_text("_id,_labels,i,big,huge,f,s\n1,A;B,5,1234567890123456789,99999999999999999999,1.5,x\n2,,,-9223372036854775808,1,2,\"a,\"\"b\"\"\"\n")
    (tmp_path / "e.csv").write_text("_source,_target,_type\n1,2,T\n")
    g = files.import_csv(Graph(spark), f"file://{tmp_path}/n.csv", f"file://{tmp_path}/e.csv")
    found = {tuple(r) for r in g.node_frame().select("i", "big", "huge", "f", "s").collect()}
    assert found == {(5, 1234567890123456789, "99999999999999999999", 1.5, "x"), (None, -9223372036854775808, "1", 2.0, 'a,"b"')}
    assert {frozenset(r[0]) for r in g.node_frame().select("__labels").collect()} == {frozenset("AB"), frozenset()} and g.edge_frame().count() == 1
    files.export_csv(g, f"file://{tmp_path}/out")
    again = files.import_csv(Graph(spark), f"file://{tmp_path}/out/nodes", f"file://{tmp_path}/out/edges")
    assert {tuple(r) for r in again.node_frame().select("i", "big", "huge", "f", "s").collect()} == found


def test_command_line(spark, tmp_path, capsys):
    root, out = f"file://{tmp_path}/db", io.StringIO()
    run = lambda *a, **k: cli.main([*a], spark, out, **k)
    (tmp_path / "g.json").write_text(json.dumps(GRAPH))
    assert run("create", root) == 0 and run("import", root, f"file://{tmp_path}/g.json") == 0
    assert run("query", root, "MATCH (p:Person) RETURN p.name AS name, p.age AS age ORDER BY name", "--format", "csv") == 0
    assert out.getvalue().endswith('nodes: 3\nedges: 3\nname,age\nAnn,3\n"Bo ""x""",\n')
    assert run("query", root, "MATCH (p {name: $n}) RETURN p.age AS age", "--params", '{"n": "Ann"}', "--format", "json") == 0
    assert out.getvalue().endswith('[{"age": 3}]\n')
    (tmp_path / "s.cypher").write_text("CREATE (:City {name: 'Z'});\nMATCH (c:City) RETURN c.name AS name;\n")
    assert run("exec", root, f"file://{tmp_path}/s.cypher") == 0 and "(1 rows)" in out.getvalue()
    for command in ("labels", "types", "schema", "count", "info", "check", "compact"):
        assert run(command, root) == 0, command
    assert '"node_count": 4' in out.getvalue() and "Boss" in out.getvalue() and "works at" in out.getvalue() and "ok" in out.getvalue()
    assert run("export", root, f"file://{tmp_path}/x", "--kind", "dot") == 0 and run("dump", root, f"file://{tmp_path}/y") == 0 and len(json.loads(text(tmp_path / "y"))["nodes"]) == 4
    assert run("query", root, "MATCH (n RETURN n") == 1 and run("count", f"file://{tmp_path}/none") == 1 and "error:" in capsys.readouterr().err
    shell = [".help", ".format json", "MATCH (n:City) RETURN n.name AS name", ".multiline on", "MATCH (n:City)", "RETURN count(n) AS n;", ".timing on", ".count", ".labels", ".history", ".nosuch", "nonsense;", ".exit", "RETURN 1;"]
    assert run(root, lines=shell) == 0
    said = out.getvalue()
    assert '[{"name": "Z"}]' in said and '[{"n": 1}]' in said and "unknown command" in said and "error:" in said and said.count("RETURN count(n) AS n") == 1
    assert run("version") == 0
