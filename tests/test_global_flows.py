import random

import pytest
from pyspark.sql import functions as F

from flowgraph.operators import graph, matching
from flowgraph.plans import global_flows as g
from flowgraph.plans.search import Application, Unsupported, normalize_operation, term_pattern

SERVICES = "service string, role string, tokens array<string>, base_path string, ord int"
STEP = "struct<statement:string,location:string,file:string,function_id:string>"
FLOWS = f"service string, flow_id string, kind string, source_location string, sink_location string, steps array<{STEP}>, ord int"
OUTBOUND = "service string, id string, protocol string, method string, channel string, file string, line int, location string, flow_ref string, ord int"
ENDPOINTS = "service string, protocol string, method string, route string, handler string, handler_name string, file string, line int, ord int"


def step(statement, location, function="N/A"):
    return (statement, location, location.split(":")[0], function)


@pytest.fixture
def two(spark):
    """A gateway's tainted request goes by HTTP to an endpoint of users, whose source reaches a sink."""
    services = [("gateway", "gateway", ["gateway"], None, 0), ("users", "internal", ["users"], None, 1)]
    flows = [
        ("gateway", "f0", "out", "gw.py:5", "gw.py:9", [step("body = req", "gw.py:5", "handle@gw.py:4"), step('post("http://users/api/users/7/role")', "gw.py:9", "handle@gw.py:4")], 0),
        ("users", "f1", "sink", "u.py:12", "u.py:20", [step("data", "u.py:12", "set@u.py:10"), step("db.update(data)", "u.py:20", "set@u.py:10")], 0),
        ("users", "f2", "sink", "other.py:3", "other.py:9", [step("x", "other.py:3"), step("drop(x)", "other.py:9")], 1),
    ]
    outbound = [("gateway", "out_0", "http", "POST", "http://users/api/users/7/role", "gw.py", 9, "gw.py:9", "f0", 0)]
    endpoints = [("gateway", "http", "POST", "/in", "handle@gw.py:4", "handle", "gw.py", 4, 0), ("users", "http", "POST", "/api/users/{id}/role", "set@u.py:10", "set", "u.py", 10, 0)]
    make = spark.createDataFrame
    return make(services, SERVICES), make(flows, FLOWS), make(outbound, OUTBOUND), make(endpoints, ENDPOINTS)


def test_one_hop(two):
    found = g.global_flows(*two).collect()
    assert len(found) == 1
    f = found[0]
    assert (f.flow_id, f.hop_count, f.services, f.channels) == ("gflow_0", 1, ["gateway", "users"], ["http://users/api/users/7/role"])
    assert f.source_location == "services/gateway/gw.py:5" and f.sink_location == "services/users/u.py:20"
    assert sum("inter-service call" in s.statement for s in f.steps) == 1 and f.step_count == len(f.steps) == 5
    assert f.steps[0].function_id == "handle@services/gateway/gw.py:4"
    s = g.summary(g.global_flows(*two)).first()
    assert (s.flow_count, s.unique_sinks, s.services, s.max_hop_count) == (1, 1, ["gateway", "users"], 1)


def test_score_and_unrelated_sources(two):
    nodes, edges = g.build_graph(*two)
    hop = edges.where("kind = 'inter_call'").collect()
    assert len(hop) == 1 and hop[0].score >= 0.8
    entered = {e.dst for e in edges.where("kind = 'enters' and src like 'endpoint:users%'").collect()}
    assert entered == {"source:users:u.py:12"}
    assert {n.kind for n in nodes.collect()} == {"entry", "source", "boundary", "endpoint", "sink"}


def test_unmatched_channel_gives_no_flow(two):
    services, flows, outbound, endpoints = two
    other = outbound.withColumn("channel", F.lit("http://users/nothing/here"))
    assert g.build_graph(services, flows, other, endpoints)[1].where("kind = 'inter_call'").count() == 0
    assert g.global_flows(services, flows, other, endpoints).count() == 0


def test_topic_hop(two):
    services, flows, outbound, endpoints = two
    sent = outbound.withColumn("channel", F.lit("user.created")).withColumn("protocol", F.lit("kafka"))
    heard = endpoints.withColumn("protocol", F.when(F.col("service") == "users", F.lit("rabbitmq")).otherwise(F.col("protocol"))).withColumn("route", F.when(F.col("service") == "users", F.lit("User.Created")).otherwise(F.col("route")))
    assert [e.score for e in g.build_graph(services, flows, sent, heard)[1].where("kind = 'inter_call'").collect()] == [1.0]
    assert [f.channels for f in g.global_flows(services, flows, sent, heard).collect()] == [["user.created"]]


def brute_paths(nodes, edges, depth):
    kind = {n: k for n, k, _ in nodes}
    service = {n: s for n, _, s in nodes}
    out = []

    def go(trail, seen, services):
        at = trail[-1]
        if kind[at] == "sink":
            out.append(tuple(trail))
            return
        if len(trail) > depth:
            return
        for s, d, k in edges:
            if s == at and d not in seen and not (k == "inter_call" and service[d] in services):
                go([*trail, d], seen | {d}, services | {service[d]})

    for n, k, s in nodes:
        if k == "entry":
            go([n], {n}, {s})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_simple_paths_equal_a_search(spark, seed):
    r = random.Random(seed)
    nodes = [(f"n{i}", ["entry", "sink", "source", "boundary"][min(i, 3) if i < 4 else r.randint(1, 3)], f"s{r.randrange(3)}") for i in range(11)]
    pairs = {(r.choice(nodes)[0], r.choice(nodes)[0]) for _ in range(26)}
    edges = [(a, b, r.choice(["intra_flow", "inter_call"])) for a, b in sorted(pairs) if a != b]
    n = spark.createDataFrame([(*x, i) for i, x in enumerate(nodes)], "id string, kind string, service string, ord int")
    e = graph.edges_of(spark.createDataFrame([(*x, 1.0, i) for i, x in enumerate(edges)], "src string, dst string, kind string, score double, ord int"))
    got = graph.simple_paths(n, e, depth=6, per_sink=10**6, total=10**6).orderBy("path_ord").collect()
    assert [(p.edges[0].src, *(x.dst for x in p.edges)) for p in got] == brute_paths(nodes, edges, 6)
    capped = graph.simple_paths(n, e, depth=6, per_sink=2, total=3).orderBy("path_ord").collect()
    seen, want = {}, []
    for p in brute_paths(nodes, edges, 6):
        seen[p[-1]] = seen.get(p[-1], 0) + 1
        if seen[p[-1]] <= 2:
            want.append(p)
    assert [(p.edges[0].src, *(x.dst for x in p.edges)) for p in capped] == want[:3]


def test_match_equals_the_full_product(spark):
    """Candidates by what must be shared lose no pair that scores."""
    r = random.Random(5)
    parts = ["a", "b", "{id}", "users", "api", "v1"]
    path = lambda: "/" + "/".join(r.choices(parts, k=r.randint(0, 4)))
    chan = "struct<kind:string,method:string,host:string,path:string,topic:string,raw:string>"
    def channel():
        kind = r.choice(["http", "http", "http", "kafka", "grpc"])
        topic = {"kafka": r.choice(["t.x", "T.X", "q"]), "grpc": r.choice(["p.S/Do", "/p.S/Do", "q.S/Do"])}.get(kind)
        return (kind, r.choice([None, "GET", "POST"]), r.choice([None, "users.local", "api:80", "localhost"]), path() if kind == "http" else "/", topic, "raw")
    outs = [(f"s{r.randrange(3)}", i, channel(), i) for i in range(80)]
    eps = []
    for i in range(60):
        c = channel()
        eps.append((f"s{r.randrange(3)}", i, (c[0], c[1], c[3], c[4]), i))
    services = spark.createDataFrame([("s0", ["users"], "/api"), ("s1", [], "/v1/"), ("s2", ["api"], None)], "service string, tokens array<string>, base_path string")
    out = spark.createDataFrame(outs, f"service string, id int, channel {chan}, ord int")
    ep = spark.createDataFrame(eps, "service string, ep int, endpoint struct<kind:string,method:string,path:string,topic:string>, ord int")
    from flowgraph.functions.channels import with_match_score

    e2 = ep.select(F.col("service").alias("to_service"), "ep", "endpoint").join(services.withColumnRenamed("service", "to_service"), "to_service")
    full = with_match_score(out.crossJoin(e2).where("service <> to_service")).where("score >= 0.4")
    want = {(x.id, x.ep, x.score) for x in full.collect()}
    got = matching.match(out, ep, services, most=10**6).collect()
    assert {(x.id, x.ep, x.score) for x in got} == want and len(got) == len(want) > 100


def test_handlers_and_sources(spark):
    eps = spark.createDataFrame([("s", "e1", "a/x.py", 10, 0), ("s", "e2", "a/x.py", 40, 1), ("s", "e3", "y.py", 5, 2), ("t", "e4", "z.py", 5, 3)], "service string, ep string, file string, line int, ord int")
    out = spark.createDataFrame([("s", "o1", "src/a/x.py", 30, 0), ("s", "o2", "a/x.py", 60, 1), ("s", "o3", "a/x.py", 400, 2), ("s", "o4", "a/x.py", 9, 3), ("s", "o5", "", 12, 4)], "service string, id string, file string, line int, ord int")
    assert {(x.ep, x.id) for x in matching.handler_calls(out, eps).collect()} == {("e1", "o1"), ("e2", "o2")}
    src = spark.createDataFrame([("s", "a/x.py:12"), ("s", "a/x.py:700"), ("s", "q.py:3"), ("t", "only.py:9"), ("t", "only.py:11")], "service string, source string")
    want = {("e1", "a/x.py:12", 0.9), ("e4", "only.py:9", 0.4), ("e4", "only.py:11", 0.4)}
    assert {(x.ep, x.source, x.score) for x in matching.endpoint_sources(eps, src).collect()} == want


def test_flow_calls_by_rank(spark):
    flows = spark.createDataFrame([("s", "f1", "a.py:3"), ("s", "f2", "b.py:4"), ("s", "f3", "c.py:9"), ("t", "f4", "x/d.py:1"), ("t", "f5", "e.py:1")], "service string, flow_id string, sink_location string")
    out = spark.createDataFrame([("s", "o1", "a.py", "b.py:4", "f1"), ("s", "o2", "b.py", "b.py:4", ""), ("t", "o3", "d.py", "", "")], "service string, id string, file string, location string, flow_ref string")
    assert {(x.flow_id, x.id) for x in matching.flow_calls(flows, out).collect()} == {("f1", "o1"), ("f2", "o1"), ("f2", "o2"), ("f4", "o3")}


def test_search(spark, two):
    services, flows, outbound, endpoints = two
    functions = spark.createDataFrame([("users", "set@u.py:10", "set", "u.py", 10, 25, "def set(x)", None, None), ("users", "inner@u.py:18", "inner", "u.py", 18, 22, "", None, None)], "service string, function_id string, name string, file_path string, start_line int, end_line int, signature string, class_name string, package_name string")
    calls = spark.createDataFrame([("users", "inner@u.py:12", "inner@u.py:18"), ("users", "gone@u.py:20", "gone@lib:1"), ("users", "bad", "x")], "service string, callsite_id string, target_function_id string")
    text = spark.createDataFrame([("users", "u.py", i, f"line {i}") for i in range(1, 31)], "service string, file string, line_no int, text string")
    app = Application({"services": services, "flows": flows, "outbound": outbound, "endpoints": endpoints, "functions": functions, "calls": calls, "lines": text})
    assert [x.id for x in app.qname("^(set|inner)$", service="users").collect()] == ["set@u.py:10", "inner@u.py:18"]
    assert app.qname("(", service="users").count() == 0 and app.qname("set").count() == 0
    assert {(x.caller_id, x.name) for x in app.qcg("set", service="users").collect()} == {("set@u.py:10", "inner"), ("set@u.py:10", "gone")}
    assert [x.function_id for x in app.qcg("gone@lib:1", "callers", "users").collect()] == []
    assert [x.function_id for x in app.qcg("inner@u.py:18", "callers", "users").collect()] == ["set@u.py:10"]
    assert {x.flow_id for x in app.qflow("data", "update", "users").collect()} == {"f1"} and app.qflow("", "", "users").count() == 2
    assert app.qinter().count() == 1 and app.qsource("users").count() == 3 and app.qglobalflow().count() == 1
    assert app.qast("callable", "users").count() == 2 and app.qast("call", "users").count() == 3
    with pytest.raises(Unsupported):
        app.qast("while")
    assert app.get_source("x.inner()@u.py:20", "users").first().source.startswith("18:line 18\n19:")
    assert app.get_source("q@u.py:2", "users", 1).first().source == "1:line 1\n2:line 2\n3:line 3"
    notes = spark.createDataFrame([("org.io.File.name", "gives the name", 0)], "fqn string, text string, ord int")
    app.tables["library"] = notes
    assert app.resolve_request("File.name", "users").first().source == "[LIBRARY] gives the name"
    assert app.resolve_request("inner@u.py:18", "users").first().source.startswith("18:line 18")
    assert app.get_type("set@u.py:10", "users").first().type == "def set(x)" and app.get_type("none", "users").first().type == "unknown"
    assert [x.location for x in app.get_location(spark.createDataFrame([("i", "f.py", 3), ("j", None, 4)], "id string, file string, line int")).orderBy("id").collect()] == ["f.py:3", "j"]
    assert normalize_operation(" Callsite ") == "call" and term_pattern("a.b") == "(?i).*a\\.b.*" and term_pattern(" ") == ".*" and term_pattern("a.*") == "a.*"
