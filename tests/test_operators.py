import random

import pytest
from pyspark.sql import functions as F

from flowgraph.operators import callgraph, checks, components, endpoints, flows, lines, rows, verdicts

FN = "function_id string, name string, file_path string, start_line int, end_line int, class_name string, package_name string, ord int"


def lines_of(spark, files):
    return lines.explode_lines(spark.createDataFrame(files, "file string, text string"))


def test_lines(spark):
    df = lines_of(spark, [("a", "x\n\n y \n"), ("b", ""), ("c", "one\r\ntwo"), ("d", "\n\n")])
    assert sorted(map(tuple, df.collect())) == [("a", 1, "x"), ("a", 2, ""), ("a", 3, " y "), ("c", 1, "one"), ("c", 2, "two"), ("d", 1, ""), ("d", 2, "")]
    at = spark.createDataFrame([("a", 3), ("a", 2), ("a", 9), ("z", 1)], "file string, line int")
    assert {x.statement for x in lines.statement_at(at, df).collect()} == {"y", "// Empty line", "// Line 9 out of range", "// File not found: z"}
    spans = spark.createDataFrame([("k", "a", 2, 99), ("none", "a", 50, 60)], "key string, file string, start_line int, end_line int")
    assert {x.key: x.source for x in lines.bodies(spans, df).collect()} == {"k": "2:\n3: y ", "none": None}
    marked = lines.marked_body(spans, df, spark.createDataFrame([("a", 3)], "file string, line int"), 4).where("key = 'k'").first().source
    assert marked == "   2: \n   3:  y  // <--POTENTIAL AUTH CHECK"


def test_field_text(spark):
    df = lines_of(spark, [("a", "// int size;\nint other;\nint size =\n  3;\nint size2;")])
    assert tuple(lines.field_text(df, "a", "size").first()) == ("a", 3, "int size =\n  3;")
    assert lines.field_text(df, "a", "absent").count() == 0


def test_function_ends(spark):
    java = 'class A {\n  void f() { // }\n    s = "}";\n    if (x) { y(); }\n  }\n}\n'
    python = "def f(a,\n      b):\n    x\n\n    y\nz\n"
    df = spark.createDataFrame([("A.java", java, 2), ("a.py", python, 1), ("b.go", "func f() {", 1), ("c.js", "x", 9)], "file string, text string, start_line int")
    assert {x.file: x.end_line for x in lines.function_ends(df).collect()} == {"A.java": 5, "a.py": 5, "b.go": -1, "c.js": -1}


@pytest.fixture
def nested(spark):
    r = random.Random(1)
    fns = [(f"f{i}@{f}:{a}", f"f{i}", f, a, a + n, None, "p", i) for i in range(60) for f in [r.choice("xy")] for a in [r.randint(1, 200)] for n in [r.choice([0, 3, 40, 150])]]
    return spark.createDataFrame(fns, FN), fns


def test_containing_equals_a_plain_loop(spark, nested):
    df, fns = nested
    at = [(f"{f}{k}", f, k) for f in "xyz" for k in range(1, 300, 3)]
    places = spark.createDataFrame(at, "key string, file string, line int")
    inside = {k: [x for x in fns if x[2] == f and x[3] <= n <= x[4]] for k, f, n in at}
    best = {x.key: x.function_id for x in callgraph.containing_function(places, df, "key", "file", "line").collect()}
    assert best == {k: min(v, key=lambda x: (x[4] - x[3], -x[3], x[0]))[0] for k, v in inside.items() if v}
    last = {x.key: x.function_id for x in callgraph.last_function(places, df, "key", "file", "line").collect()}
    assert last == {k: max(v, key=lambda x: x[7])[0] for k, v in inside.items() if v}
    stats = callgraph.index_stats(df).first()
    assert tuple(stats) == (60, 2, len({(x[2], n) for x in fns for n in range(x[3], x[4] + 1)}))


def test_identifier_strategies(spark):
    df = spark.createDataFrame([("go@a/b.py:3", "go", "a/b.py", 3, 9, None, None, 0), ("go@c.py:1", "go", "c.py", 1, 2, None, None, 1), ("run@a/b.py:20", "run", "a/b.py", 20, 30, None, None, 2)], FN)
    ask = lambda i: [(x.function_id, x.strategy) for x in callgraph.find_identifier(df, i).collect()]
    assert ask("go@c.py:1") == [("go@c.py:1", 1)] and ask("o.go()@c.py:1") == [("go@c.py:1", 2)] and ask("x.go@a/b.py:5") == [("go@a/b.py:3", 4)]
    assert ask("go@a/b.py:99") == [("go@a/b.py:3", 5)] and ask("run@b.py:1") == [("run@a/b.py:20", 6)] and ask("go") == [("go@a/b.py:3", 7), ("go@c.py:1", 7)] and ask("none") == []


def test_valid_function(spark):
    base = ("id", "n", "A.java", 1, 9, "A", "p", 0)
    ask = lambda language, **k: spark.createDataFrame([tuple({**dict(zip(("function_id", "name", "file_path", "start_line", "end_line", "class_name", "package_name", "ord"), base)), **k}.values())], FN).select(callgraph.valid_function(language).alias("v")).first().v
    assert ask("java") and not ask("java", package_name="") and not ask("java", name="apply", class_name="Z") and ask("java", name="apply") and ask("java", name="<init>") and not ask("java", name="<x>")
    assert not ask("python", name="__doc__") and not ask("csharp", name="<a>") and not ask("go", name="_") and not ask("c++", name="__x") and not ask("js", start_line=0) and not ask("js", end_line=0) and not ask("js", name=" ")


def test_library_lookup(spark):
    lib = spark.createDataFrame([("_note.x", "no", 0), ("org.io.File.name", "first", 1), ("com.File.name", "second", 2), ("File.name", "exact", 3)], "fqn string, text string, ord int")
    ask = spark.createDataFrame([("File.name",), ("io.File.name",), ("none",), ("note.x",)], "fqn string")
    assert {x.fqn: x.text for x in callgraph.library_lookup(ask, lib).collect()} == {"File.name": "exact", "io.File.name": "first", "none": None, "note.x": None}


def test_components_equal_a_union_find(spark):
    r = random.Random(2)
    data = [(i, r.randrange(60), r.randrange(50)) for i in range(70)]
    root = list(range(70))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, s, k in data:
        for j, t, m in data:
            if s == t or k == m:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {x.flow: x.component for x in components.shared_components(spark.createDataFrame(data, "flow int, source int, sink int")).collect()}
    assert got == {i: find(i) for i in range(70)}


def test_collapse_and_roles(spark):
    df = spark.createDataFrame([("f", 0, "a", None, "step"), ("f", 1, "a", None, "step"), ("f", 2, "b", "x", "sink"), ("f", 3, "a", None, "step"), ("g", 0, "a", None, "step")], "flow string, pos int, location string, statement string, role string")
    out = rows.force_roles(rows.collapse_runs(df, ["flow"], "pos", ["location", "statement"]), ["flow"], "pos").orderBy("flow", "pos").collect()
    assert [(x.flow, x.pos, x.role, x.step_role) for x in out] == [("f", 0, "source", "Step 1 [SOURCE]"), ("f", 2, "sink", "Step 2 [SINK]"), ("f", 3, "sink", "Step 3 [SINK]"), ("g", 0, "sink", "Step 1 [SINK]")]


def test_merge_keeps_the_last(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, None), (3, "c")]))
    assert sorted(map(tuple, rows.merge(a, b, keys=["k"]).collect())) == [(1, "a"), (2, None), (3, "c")]


def test_check_records_and_report(spark):
    text = "Check Line: 3\nCheck Type: Authentication Check\nGuarded Operations: a.set(x)@4 | go@q@9 | | N\nReason: r: s\nCheck Line: x\nCheck Type: Not AuthN/AuthZ Check\n"
    rec = checks.check_records(spark.createDataFrame([("m", text), ("n", "")], "method_id string, response string"))
    got = rec.orderBy("check_no").collect()
    assert [(x.check_line, x.check_type, x.reason) for x in got] == [(3, "Authentication Check", "r: s"), (None, "Not AuthN/AuthZ Check", None)]
    pairs = checks.pairs(rec)
    assert sorted((x.operation, x.operation_line) for x in pairs.collect() if x.operation_line) == [("a.set(x)", 4)]
    report = checks.report(rec, pairs, spark.createDataFrame([("m",), ("n",)], "method_id string")).first()
    assert (report.total_methods, report.total_checks, report.genuine_checks, report.false_positives, report.pairs, report.accuracy_rate) == (2, 1, 1, 1, 3, 100.0)
    ops = checks.guarded_operations(rec.withColumn("file_path", F.lit("f.py")))
    assert {(x.name, x.line) for x in ops.collect()} == {("set", 4), ("go@q", 9), ("N", None)}


def test_check_places(spark):
    df = spark.createDataFrame([("a/b.py", 7, "isAdmin(u) OCCURRED IN FUNCTION f AT file:///src/a/b.py:3:1:3:9"), ("c.py", 2, "x OCCURRED IN FUNCTION g AT c.py:1:1:200:2"), ("d.py", 1, "nothing")], "check_file string, check_line int, message string")
    out = checks.check_methods(checks.check_places(df)).collect()
    assert [(x.id, x.n_checks) for x in out] == [("a/b.py@3-33", 1), ("c.py@1-61", 1)]


def test_verdicts(spark):
    v = [("g", True, "f1", 0, "a", "s", "True Positive", "sat", True, 2), ("g", True, "f2", 1, "b", "s", "True Positive", "unsat", True, 1), ("g", True, "f3", 2, "c", "t", "True Positive", "unsat", False, 1), ("h", True, "f4", 3, "d", "t", "False Positive", "skipped", False, 1), ("x", False, None, 4, None, None, None, None, None, 0)]
    df = spark.createDataFrame([(*r, ["i"]) for r in v], "group_id string, success boolean, flow_id string, ord int, source_location string, sink_location string, assessment string, satisfiable string, valid_syntax boolean, iterations int, requested array<string>")
    r = verdicts.report(df).first()
    assert (r.total_groups, r.total_flows, r.true_positives, r.true_positives_kept, r.errors, r.tp_sat, r.tp_unsat, r.tp_error, r.vulnerability_rate) == (3, 4, 3, 2, 1, 1, 1, 1, 75.0)
    assert verdicts.report(df, prune=False).first().true_positives_kept == 3
    assert [tuple(x) for x in verdicts.vulnerabilities(df).collect()] == [("V001", "s", ["a"], ["f1"]), ("V002", "t", ["c"], ["f3"])]
    assert verdicts.vulnerable_pairs(df).count() == 3 and verdicts.requested_ids(df).count() == 1
    text = spark.createDataFrame([("; only\n ; notes",), ("(declare x)",), ("(assert x)",), (None,)], "t string").select(verdicts.empty_constraints(F.col("t")).alias("e"))
    assert [x.e for x in text.collect()] == [True, True, False, True]


def test_heuristic_endpoints(spark):
    files = [
        ("A.java", '@RequestMapping("/api")\nclass A {\n  @PostMapping("/users/{id}")\n  public Result setRole(String id) {\n  @GetMapping("/api/x")\n  Foo get() {'),
        ("b.py", '@app.route("/in", methods=["POST"])\ndef take(x):\n@router.get("/out")\nasync def give():'),
        ("c.js", "app.post('/j', h)\nconst handler = 1"), ("d.go", 'r.GET("/g", Get)\nmux.HandleFunc("/h", H)'), ("e.cs", '[HttpPut("x")]\npublic async Task Put(int i)'),
    ]
    found = endpoints.heuristic_endpoints(lines_of(spark, files)).withColumn("protocol", F.lit("http"))
    got = {(x.file, x.method, x.route, x.handler_name) for x in endpoints.distinct_endpoints(found).collect()}
    assert {("A.java", "POST", "/api/users/{id}", "setRole"), ("A.java", "GET", "/api/x", "get"), ("b.py", "POST", "/in", "take"), ("b.py", "GET", "/out", "give"), ("c.js", "POST", "/j", "handler"), ("d.go", "GET", "/g", ""), ("d.go", None, "/h", ""), ("e.cs", "PUT", "/x", "Put")} <= got
    assert not any(r == "/api" for _, _, r, _ in got)
    tree = spark.createDataFrame([("src/a.py",), ("node_modules/x.js",), ("a/vendor/b.py",), ("a.txt",)], "file string")
    assert [x.file for x in endpoints.source_files(tree).collect()] == ["src/a.py"]


def test_group_summary(spark):
    step = "array<struct<function_id:string>>"
    df = spark.createDataFrame([("f1", "a", "s", [("x",), ("N/A",)]), ("f2", "b", "s", [("x",), ("y",)]), ("f3", "c", "t", [(None,)])], f"flow_id string, source_location string, sink_location string, steps {step}")
    out = {x.group_key: (x.flow_count, x.unique_sources, x.functions) for x in flows.summarize_groups(flows.group_key(df, "sinks")).collect()}
    assert out == {"s": (2, 2, ["x", "y"]), "t": (1, 1, [])}
    keys = {x.flow_id: x.group_key for x in flows.group_key(df, "shared").collect()}
    assert keys == {"f1": "shared_group_f1_(sinks:1)", "f2": "shared_group_f1_(sinks:1)", "f3": "isolated_f3"}


def test_class_files(spark):
    files = spark.createDataFrame([("a/Foo.java", "1"), ("b/Foo.java", "2"), ("c/Bar.java", "3")], "file string, text string")
    ask = spark.createDataFrame([("Foo@b/Foo.java:3",), ("Foo@z/Foo.java",), ("X@q/X.java",)], "identifier string")
    assert {x.identifier: x.text for x in lines.class_files(ask, files).collect()} == {"Foo@b/Foo.java:3": "2", "Foo@z/Foo.java": "1", "X@q/X.java": None}
