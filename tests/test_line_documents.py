"""Documents whose elements stand on lines of their own."""

import json

import pytest
from pyspark.sql import functions as F

from flowgraph.operators import callgraph
from flowgraph.sources import artifacts, schemas, writers


def result(text):
    return json.dumps({"message": {"text": text}, "locations": []})


def elements(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord long, value string").repartition(3)


def the_file(path):
    return next(path.glob("part-*"))


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_results_by_lines(spark, tmp_path, monkeypatch, n):
    """One JSON file, read in many splits, with the results' places; no row holds all of it."""
    path = str(tmp_path / "r")
    writers.write_elements(elements(spark, [result(f"m,\n{k}") for k in range(n)]), path, schemas.SARIF_LINES)
    whole = json.loads(the_file(tmp_path / "r").read_text())
    assert [x["message"]["text"] for x in whole["runs"][0]["results"]] == [f"m,\n{k}" for k in range(n)]
    monkeypatch.setattr(artifacts, "_json", None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        found = artifacts.sarif_results(spark, path).select("result_index", "result.message.text")
        assert n < 5000 or found.rdd.getNumPartitions() > 4
        assert sorted(map(tuple, found.collect())) == [(k, f"m,\n{k}") for k in range(n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("broken", ['{"message":', '{"message":{"text":"b"}},{"message":{"text":"c"}}', None])
def test_a_broken_line_is_the_whole_files_matter(spark, tmp_path, broken):
    """A broken element or a missing end makes the file empty; two elements on a line are read as a whole."""
    rows = [schemas.SARIF_LINES.head, result("a"), "," + (broken or result("b")), *([schemas.SARIF_LINES.foot] if broken else [])]
    (tmp_path / "r.sarif").write_text("\n".join(rows))
    found = artifacts.sarif_messages(spark, str(tmp_path / "r.sarif")).orderBy("result_index").collect()
    assert [x.message for x in found] == (["a", "b", "c"] if broken and broken.endswith("}}") else [])


def test_checks_by_lines(spark, tmp_path, monkeypatch):
    method = '{"id":"m%d","method_location":{"file":"a.java","start_line":1,"end_line":2},"auth_checks":[{"expression":"ok","line":%d}]}'
    writers.write_elements(elements(spark, [method % (k, k) for k in range(300)]), str(tmp_path / "c"), schemas.CHECK_LINES)
    assert len(json.loads(the_file(tmp_path / "c").read_text())["methods_with_auth"]) == 300
    whole = artifacts._json(spark, str(tmp_path / "c"), "methods_with_auth array<struct<id:string>>").select(F.explode("methods_with_auth.id")).count()
    monkeypatch.setattr(artifacts, "_json", None)
    found = artifacts.check_document(spark, str(tmp_path / "c")).select("id", F.get("auth_checks", F.lit(0))["line"])
    assert whole == 300 and sorted(map(tuple, found.collect())) == sorted((f"m{k}", k) for k in range(300))


def test_library_by_lines_and_names_that_share_their_end(spark, tmp_path, monkeypatch, capsys):
    """Entries and names of one last part aren't compared with one another; the first entry of an end counts, whole names before it."""
    said = [("_note", "left out"), ('a."q".get', "1"), ("b.c.get", "2"), ("get", "3"), ("c.get", "4"), ("x.", "5")]
    rows = spark.createDataFrame([(n, k, v) for n, (k, v) in enumerate(said)], "ord long, k string, v string")
    writers.write_elements(rows.select("ord", writers.json_entry(F.col("k"), writers.json_value(F.col("v"))).alias("value")), str(tmp_path / "l"), schemas.LIBRARY_LINES)
    assert json.loads(the_file(tmp_path / "l").read_text())["semantics"] == dict(said)
    monkeypatch.setattr(artifacts, "_json", None)
    library = artifacts.library(spark, str(tmp_path / "l"))
    assert sorted((x.ord, x.fqn, x.text) for x in library.collect()) == [(n, *kv) for n, kv in enumerate(said)][1:]
    names = spark.createDataFrame([("get",), ("c.get",), ('"q".get',), ("et",), ("",), ("d.get",), ("b.c.get",), (None,)], "fqn string")
    found = callgraph.library_lookup(names, library)
    assert {x.fqn: x.text for x in found.collect()} == {"get": "3", "c.get": "4", '"q".get': "1", "et": None, "": "5", "d.get": None, "b.c.get": "2", None: None}
    found.explain(True)
    assert "EndsWith" not in capsys.readouterr().out


def test_flows_by_lines(spark, tmp_path, monkeypatch):
    """A group on a line; the groups and their flows keep their order."""
    shape = "group_key string, flow_id string, steps array<struct<location:string>>, ord long"
    rows = spark.createDataFrame([(f'k"{k % 40:02}', f"f{k}", [(f"a:{k}",)], -k) for k in range(400)], shape)
    writers.write_flow_document(rows, str(tmp_path / "f"), {"format": "x"})
    whole = json.loads(the_file(tmp_path / "f").read_text())
    assert whole["metadata"] == {"format": "x"} and [f["flow_id"] for f in whole["grouped_flows"]['k"07']] == [f"f{k}" for k in range(367, 0, -40)]
    monkeypatch.setattr(artifacts, "_json", None)
    found = [(x.group_key, x.flow_id, x.steps[0].location) for x in artifacts.flow_document(spark, str(tmp_path / "f")).orderBy("ord").collect()]
    assert found == [(f'k"{g:02}', f"f{k}", f"a:{k}") for g in range(40) for k in range(360 + g, -1, -40)]
    writers.write_flow_document(rows.limit(0), str(tmp_path / "none"))
    assert artifacts.flow_document(spark, str(tmp_path / "none")).count() == 0
