import pytest
from pyspark.sql import functions as F

from flowgraph.functions import channels as ch
from flowgraph.functions import identifiers as ids
from flowgraph.functions import records


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first().o


def each(spark, pairs, f):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(pairs)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    got = {r.i: r.o for r in rows}
    assert [got[i] for i in range(len(pairs))] == [w for _, w in pairs]


def test_sanitize_identifier(spark):
    each(spark, [("obj.go@a/b.java:3", "go@a/b.java:3"), ("p->f()", "f"), ("A::b@x@y", "b@x@y"), ("a.b->c.d", "c.d"), ("plain", "plain"), (" x @", "x")], ids.sanitize_identifier)


def test_is_class_identifier(spark):
    each(spark, [("Foo@a/Foo.java", True), ("Foo@a/Bar.java:3", False), ("UserDto@a/X.java:1", True), ("Foo@a/Foo.py", False), ("Foo", False)], ids.is_class_identifier)


def test_parse_location(spark):
    out = spark.createDataFrame([("a.java:126:17:130:32",), ('"b.go":3:9',), ("c:1:2:3",), ("x:y:z",), ("d:1:2\nmore:9",), (None,)], "v string").select(ids.parse_location(F.col("v")).alias("l")).collect()
    assert [None if r.l is None else tuple(r.l) for r in out] == [("a.java", 126, 130, 17, 32), ("b.go", 3, 3, 9, 9), None, None, ("d", 1, 1, 2, 2), None]


def test_clean_uri(spark):
    each(spark, [("file:///a/b%20c+d", "/a/b c+d"), ("file:/x", "/x"), ("a%20b", "a%20b")], ids.clean_uri)


def test_paths(spark):
    each(spark, [("", "/"), (None, "/"), ("a/b/", "/a/b"), ("/x//?q=1#f", "/x"), (" /y#z?w ", "/y"), ("//", "/")], ids.norm_path)
    assert one(spark, "/a//b/?c", ids.segments) == ["a", "b"]


def test_requests_and_tags(spark):
    text = "<Request>a@b.c:1; Svc.doIt\nnope; just.some.text; com.x.Cls.go_1; Cls.Go</Request>"
    assert one(spark, text, ids.requests) == ["a@b.c:1", "Svc.doIt", "com.x.Cls.go_1"]
    each(spark, [("<assessment> True\nPositive </ASSESSMENT>", "True\nPositive"), ("none", "?")], lambda c: ids.first_tag(c, "assessment", "?"))


def test_call_name(spark):
    each(spark, [("svc.setRole(x)", "setRole"), ("bare", None)], ids.call_name)


def test_tolerant_json(spark):
    each(spark, [('{"a": 1}', '{"a": 1}'), ('say {"a": 2} so', '{"a": 2}'), ("none", None)], ids.tolerant_json)


@pytest.mark.parametrize(
    ("raw", "kind", "method", "want"),
    [
        ("http://users:8080/api/users/{id}?x=1", "http", "post", ("http", "POST", "users:8080", "/api/users/{id}", None)),
        ("'/a/b/'", "unknown", "trace", ("http", None, None, "/a/b", None)),
        ("user.created", "unknown", None, ("kafka", None, None, "/", "user.created")),
        ("jobs", "rabbitmq", None, ("rabbitmq", None, None, "/", "jobs")),
        ("/user.Svc/Set", "unknown", None, ("grpc", None, None, "/", "user.Svc/Set")),
        ("x", "unknown", None, ("unknown", None, None, "/", "x")),
        (None, "unknown", None, ("unknown", None, None, "/", None)),
        ("HTTP://H", "graphql", None, ("graphql", None, "h", "/", None)),
    ],
)
def test_parse_channel(spark, raw, kind, method, want):
    df = spark.createDataFrame([(raw, kind, method)], "r string, k string, m string").select(ch.parse_channel(F.col("r"), F.col("k"), F.col("m")).alias("c"))
    assert tuple(df.first().c)[:5] == want


def test_host_is_local(spark):
    each(spark, [(None, True), ("localhost:5000", True), ("users", False), ("::1", True), ("[::1]:80", False), ("127.0.0.1", True)], ch.host_is_local)


def plain_score(out, own):
    import re
    from decimal import ROUND_HALF_EVEN, Decimal

    wild = lambda s: re.match(r"^(\{.*\}|:.+|<.*>|\$\{.*\}|\[.*\]|\*+|__[A-Z_]+__)$", s)
    if not own:
        return 0.0 if out else 0.5
    if len(own) > len(out):
        return 0.0
    pairs = [(o, e) for o, e in zip(out[-len(own) :], own) if not wild(o) and not wild(e)]
    if any(o.lower() != e.lower() for o, e in pairs) or (not pairs and not all(wild(e) for e in own)):
        return 0.0
    base = Decimal("1") if len(out) == len(own) else Decimal("0.75")
    return float((base * (Decimal("0.5") + Decimal("0.5") * len(pairs) / len(own))).quantize(Decimal("0.0001"), ROUND_HALF_EVEN))


def test_path_score_equals_a_plain_loop(spark):
    import random

    r = random.Random(1)
    parts = ["a", "B", "b", "{id}", ":x", "*", "users", "__ID__"]
    rows = [(i, r.choices(parts, k=r.randint(0, 5)), r.choices(parts, k=r.randint(0, 4))) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, o array<string>, e array<string>")
    got = {x.i: x.path_score for x in ch.with_path_score(df, "o", "e").collect()}
    assert got == {i: plain_score(o, e) for i, o, e in rows}


def test_records(spark):
    inter = one(spark, "INTER|http||http://b/{{id}}|src/a.py:12|go@src/a.py:3", records.parse_inter)
    assert tuple(inter) == ("http", None, "http://b/{id}", "src/a.py", 12, "src/a.py:12", "go@src/a.py:3")
    each(spark, [("INTER|http|GET|get|a:1|f@a:1", None), ("INTER|http|GET", None), ("OTHER|a|b|c|d|e", None), ("INTER|http|GET|free text|a:1|f@a:1", None)], records.parse_inter)
    assert tuple(one(spark, "ENDPOINT|HTTP|post||make@a/b.py:7", records.parse_endpoint)) == ("http", "POST", "/", "make@a/b.py:7", "make", "a/b.py", 7)
    assert tuple(one(spark, "a/b.py:12:4 -> run@c/d.py:9", records.callsite_record)) == ("run@a/b.py:12", "run@c/d.py:9")
    each(spark, [("x -> y -> z", None), ("nothing", None)], records.callsite_record)
    assert tuple(one(spark, "f@a:1 -> r.py:3:9", records.router_record)) == ("f@a:1", "r.py:3:9")


def test_outbound_channels(spark):
    each(
        spark,
        [
            ('client.post("http://users/api", "/x")', ["http://users/api"]), ("get('/a/{id}') + get('/a/{id}')", ["/a/{id}"]), ('producer.send("user.created", "other.topic")', ["user.created"]),
            ('kafka("plain", "two-part")', ["two-part"]), ('x = "user.created"', []), (None, []),
        ],
        records.outbound_channels,
    )


def test_sink_categories(spark):
    each(spark, [("createUser", "user"), ("getPasswordHash", ""), ("resetPassword", "credential"), ("runShellCommand", "command"), ("grantRole", "permission"), ("restartServer", "system"), ("isSystemManager", "")], records.sink_categories)


def test_hints(spark):
    each(spark, [("api.createX(1)", "POST"), ("deleteAll(", "DELETE"), ("fetch(", "GET"), ("x", None)], records.infer_verb)
    each(spark, [("KafkaTemplate.send", "kafka"), ("the stub here", "grpc"), ("x", "http")], records.infer_protocol)
