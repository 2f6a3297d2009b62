import json

import pytest
from pyspark.sql import functions as F

from flowgraph.operators import flows, lines
from flowgraph.sources import artifacts, manifest, writers
from flowgraph.streaming import ingest


def place(uri, line, c=1, e=None):
    return {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line, "startColumn": c, **({"endColumn": e} if e else {})}}}


def write(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


def test_sarif_flows(spark, tmp_path):
    at = lambda uri, line, c=1, e=2, role=None: {"location": place(uri, line, c, e), **({"taxa": [{"properties": {"CodeQL/DataflowRole": role}}]} if role else {})}
    thread = {"locations": [at("a.py", 1, 1, 2, "source"), at("a.py", 1), at("/usr/inc.h", 9), at("a.py", 2, 3, 8), at("b.py", 7, 1, 4, "sink")]}
    doc = {"runs": [{"results": [{"message": {"text": "m"}, "locations": [place("b.py", 7)], "codeFlows": [{"threadFlows": [thread]}]}, {"message": {"text": "none"}, "locations": []}]}, {"results": [{"message": {"text": "n"}, "locations": [place("file:///x%20y+z", 3)]}]}]}
    path = write(tmp_path / "r.sarif", doc)
    assert [(x.result_index, x.message, x.file, x.line) for x in artifacts.sarif_messages(spark, path).orderBy("result_index").collect()] == [(0, "m", "b.py", 7), (1, "none", None, None), (2, "n", "/x y+z", 3)]
    text = lines.explode_lines(spark.createDataFrame([("a.py", "s = input()\nx = clean(s)\n"), ("b.py", "\n")], "file string, text string"))
    fns = spark.createDataFrame([("f@a.py:1", "a.py", 1, 2, 0), ("g@a.py:1", "a.py", 1, 1, 1)], "function_id string, file_path string, start_line int, end_line int, ord int")
    found = flows.flow_rows(flows.complete_steps(flows.sarif_steps(artifacts.sarif_results(spark, path)), text, fns)).collect()
    assert len(found) == 1
    f = found[0]
    assert (f.flow_id, f.source_location, f.sink_location, f.step_count) == ("flow_0_0_0", "a.py:1", "b.py:7", 3)
    assert [(s.step_role, s.statement, s.function_id) for s in f.steps] == [("Step 1 [SOURCE]", "s = input()", "g@a.py:1"), ("Step 2", "x = clean(s)", "f@a.py:1"), ("Step 3 [SINK]", "// Line 7 out of range", "N/A")]
    assert f.steps[1].tainted_variable == "= cle"


def test_sarif_records(spark, tmp_path):
    said = ["INTER|http|POST|http://u/a|g.py:9|h@g.py:4", "ENDPOINT|http|GET|/x|f@u.py:3", "ENDPOINT|http|GET|/y|f", "a.py:3:1 -> f@u.py:3", "b.py:3:9 -> f@v.py:1", "f@u.py:3 -> u.py:1:2", "g@u.py:9 -> u.py:8:99"]
    path = write(tmp_path / "m.sarif", {"runs": [{"results": [{"message": {"text": m}, "locations": [place("p.py", k + 1)]} for k, m in enumerate(said)]}]})
    assert [(x.id, x.channel, x.line) for x in artifacts.interservice(spark, path).collect()] == [("out_0", "http://u/a", 9)]
    assert sorted((x.route, x.file, x.line) for x in artifacts.endpoints(spark, path).collect()) == [("/x", "u.py", 3), ("/y", "p.py", 3)]
    assert {(x.callsite_id, x.target_function_id) for x in artifacts.callsites(spark, path).collect()} >= {("f@a.py:3", "f@u.py:3"), ("f@b.py:3", "f@v.py:1")}
    text = lines.explode_lines(spark.createDataFrame([("u.py", "one\ntwo")], "file string, text string"))
    assert {x.function_id: x.router_source_code for x in artifacts.router_definitions(spark, path, text).collect()} == {"f@u.py:3": "one\ntwo", "g@u.py:9": "// Source not available: u.py:8:99"}


def test_missing_and_broken_files_are_empty(spark, tmp_path):
    assert artifacts.sarif_results(spark, str(tmp_path / "none")).count() == 0
    assert artifacts.flow_document(spark, write(tmp_path / "bad.json", "{nope")).count() == 0
    with pytest.raises(FileNotFoundError):
        artifacts.call_graph(spark, str(tmp_path))


def test_csv_records(spark, tmp_path):
    rows = ['a,b,c,"f@a.java:1|f|a.java|1|9|sig|A|p|@X, @Y"', 'a,b,c,"f@a.java:1|again|a.java|1|9|sig|A|p|"', 'a,b,c,"g|g|a.java|x|9|s||p|"', 'a,b,c,"h|h|a.java|1|9|s||p|"', "a,b,c", 'a,b,c,"short|x"']
    out = artifacts.function_records(spark, write(tmp_path / "f.csv", "\n".join(rows)), "java").orderBy("function_id").collect()
    assert [(x.function_id, x.name, x.class_name, x.package_name, x.annotations) for x in out] == [("f@a.java:1", "f", "A", "p", ["@X", "@Y"]), ("h", "h", None, "p", [])]
    cls = artifacts.class_records(spark, write(tmp_path / "c.csv", 'a,b,c,"C@x|C|x.java|1|9||@E|id:Long,name:Map<A:B>,bare"')).first()
    assert (cls.package_name, cls.annotations, [tuple(f) for f in cls.fields]) == (None, ["@E"], [("id", "Long"), ("name", "Map<A:B>")])


def test_call_graph_maps(spark, tmp_path):
    write(tmp_path / "functions.json", {"function_definitions": {"f@a:1": {"name": "f", "file_path": "a", "start_line": 1}}})
    write(tmp_path / "callsites.json", {"callsite_resolutions": {"f@b:2": "f@a:1"}})
    write(tmp_path / "routers.json", {"function_to_router": {"f@a:1": "r:1:2", "x": "gone"}, "router_definitions": {"r:1:2": "code"}})
    t = artifacts.call_graph(spark, str(tmp_path))
    f = t["functions"].first()
    assert (f.start_line, f.end_line, f.signature, f.class_name) == (1, 0, "", None)
    assert {x.function_id: x.router_source_code for x in t["routers"].collect()} == {"f@a:1": "code", "x": ""} and t["classes"].count() == 0


def test_documents_round_trip(spark, tmp_path):
    step = {"step_role": "Step 1", "statement": "s", "location": "a:1", "file": "a", "function_id": "f", "role": "source"}
    doc = {"grouped_flows": {"k": [{"flow_id": "f0", "source_location": "a:1", "sink_location": "b:2", "steps": [step]}], "l": [{"flow_id": "f1", "source_location": "c:1", "sink_location": "d:2", "steps": []}]}}
    found = artifacts.flow_document(spark, write(tmp_path / "d.json", doc))
    assert [(x.group_key, x.flow_id) for x in found.orderBy("ord").collect()] == [("k", "f0"), ("l", "f1")]
    for rows, n in ((found, 2), (found.limit(0), 0)):
        writers.write_document(writers.flow_document(rows), str(tmp_path / f"out{n}"))
        assert artifacts.flow_document(spark, str(tmp_path / f"out{n}")).count() == n


def test_source_tree(spark, tmp_path):
    (tmp_path / "src/a b").mkdir(parents=True)
    write(tmp_path / "src/a b/x+y.py", "one\ntwo\n")
    assert sorted(map(tuple, artifacts.source_lines(spark, str(tmp_path / "src")).collect())) == [("a b/x+y.py", 1, "one"), ("a b/x+y.py", 2, "two")]


def test_manifest(spark, tmp_path):
    pytest.importorskip("yaml")
    text = "services:\n- {name: a, app: one, aliases: Al}\n- {name: b, source: s, database: d, base_path: /v1}\n"
    rows = manifest.parse_manifest(text)
    assert [(r["service"], r["role"], r["aliases"]) for r in rows] == [("a", "gateway", ["Al"]), ("b", "internal", [])]
    df = manifest.services(spark, write(tmp_path / "services.yaml", text))
    assert [x.t for x in df.select(manifest.tokens().alias("t"), "ord").orderBy("ord").collect()] == [["a", "al", "one"], ["b"]]
    assert manifest.entry_services(df).count() == 1 and manifest.entry_services(df.withColumn("role", F.lit("internal"))).count() == 2
    assert manifest.services(spark, str(tmp_path / "solo")).first().role == "gateway"
    for bad in ("services: []", "services: [1]", "services: [{name: '-x', app: y}]", "services: [{app: x, role: king}]", "services: [{name: x}]", "services: [{app: x}, {app: x}]"):
        with pytest.raises(ValueError):
            manifest.parse_manifest(bad)


def test_gateway_files(spark):
    pytest.importorskip("yaml")
    files = [("conf/app-gateway.yaml", "spring:\n  cloud:\n    gateway:\n      routes: []"), ("compose.yml", "version: 1\nservices: {gateway: 1}"), ("docker/x.yaml", "routes: []"), ("b.yaml", "a: 1\n---\nroutes: []"), ("c.yaml", "routes: ["), ("build/d.yaml", "routes: []"), ("e.txt", "routes: []")]
    df = spark.createDataFrame(files, "file string, text string")
    assert [x.file for x in manifest.gateway_files(df).collect()] == ["b.yaml", "conf/app-gateway.yaml"]
    assert [x.file for x in manifest.first_gateway(df).collect()] == ["conf/app-gateway.yaml"]
    assert manifest.database_language("primaryLanguage: Java") == "java" and manifest.database_language("languages: [Go]") == "go" and manifest.database_language("x: 1") is None


def test_stages_and_services_written(spark, tmp_path):
    marks = str(tmp_path / "marks")
    assert not writers.stage_done(spark, marks, "app", "FLOWS")
    writers.mark_stage(spark, marks, "app", "FLOWS")
    assert writers.stage_done(spark, marks, "app", "FLOWS") and not writers.stage_done(spark, marks, "app", "SINKS")
    ops = spark.createDataFrame([("a", None), ("b", "s1"), ("c", "gone")], "name string, service string")
    writers.write_by_service(ops, spark.createDataFrame([("s0", 0), ("s1", 1)], "service string, ord int"), str(tmp_path / "ops"))
    assert {(x.name, x.service) for x in spark.read.json(str(tmp_path / "ops")).collect()} == {("a", "s0"), ("b", "s1")}


def test_stream_of_loads(spark, tmp_path):
    schema = "k int, v string"
    for n, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = ingest.append_loads(stream, str(tmp_path / "loads"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    assert sorted(map(tuple, ingest.current(spark, str(tmp_path / "loads"), ["k"]).collect())) == [(1, "a"), (2, "c")]
