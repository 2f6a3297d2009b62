"""Flows across services: from artifacts of each service to ranked, stitched flows.

Inputs are tables over all services with a service column:
services: service, role, tokens, base_path, ord         flows (from sources to sinks and to outbound calls): service,
flow_id, kind (`sink` or `out`), source_location, sink_location, steps, ord
outbound: service, id, protocol, method, channel, file, line, location, flow_ref, ord
endpoints: service, protocol, method, route, handler, handler_name, file, line, ord
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgraph.functions import fixed
from flowgraph.functions.channels import parse_channel
from flowgraph.operators import graph, matching, stitch
from flowgraph.operators.flows import sink_place
from flowgraph.operators.rows import numbered
from flowgraph.sources.manifest import entry_services
from flowgraph.sources.workspace import checkpoint


def _ref() -> Column:
    """An endpoint's name in its service: its handler, else its place."""
    return F.coalesce(F.nullif(F.col("handler"), F.lit("")), F.concat_ws(":", "file", F.col("line").cast("string")))


def _file(place: str) -> Column:
    return F.element_at(F.split(place, ":"), 1)


def build_graph(services: DataFrame, flows: DataFrame, outbound: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all services, as operators.graph has them; edges carry service, to_service, channel and steps."""
    node = graph.node_id
    endpoints = endpoints.withColumn("ep", _ref()).dropDuplicates(["service", "ep"])
    flows = flows.where("source_location <> ''").withColumn("sink_location", sink_place(F.col("steps"), F.col("sink_location")))
    tainted = flows.select("service", F.col("source_location").alias("source"), "ord").groupBy("service", "source").agg(F.min("ord").alias("ord"))
    sinks = flows.where("kind = 'sink' and sink_location <> ''")
    entries = entry_services(services).select("service")
    as_node = lambda df, kind, ref, ord_="ord": df.select(F.lit(kind).alias("kind"), "service", F.col(ref).alias("ref"), F.struct(F.lit(kind).alias("k"), "service", F.col(ord_).cast("string").alias("o"), F.col(ref).alias("r")).alias("ord"))

    entry_eps = endpoints.join(entries, "service", "left_semi").withColumn("ref", F.concat(F.lit("ep:"), "ep"))
    entry_src = tainted.join(entries, "service", "left_semi")
    nodes = graph.nodes_of(
        as_node(endpoints, "endpoint", "ep").select("kind", "service", "ref"), as_node(entry_eps, "entry", "ref").select("kind", "service", "ref"), as_node(entry_src, "entry", "source").select("kind", "service", "ref"),
        as_node(tainted, "source", "source").select("kind", "service", "ref"), outbound.select(F.lit("boundary").alias("kind"), "service", F.col("id").alias("ref")), sinks.select(F.lit("sink").alias("kind"), "service", F.col("sink_location").alias("ref")),
    )
    nodes = numbered(nodes, "ord", "kind", "service", "ref")

    channel = parse_channel(F.col("channel"), F.coalesce("protocol", F.lit("http")), F.col("method"))
    calls = outbound.withColumn("raw", F.col("channel")).withColumn("channel", channel)
    kind = F.coalesce("protocol", F.lit("http"))
    endpoint = F.struct(kind.alias("kind"), F.col("method").alias("method"), F.col("route").alias("path"), F.when(kind.isin(*fixed.MQ_KINDS, "grpc"), F.col("route")).alias("topic"))
    targets = endpoints.withColumn("endpoint", endpoint)

    def edge(df: DataFrame, src: Column, dst: Column, kind: str, score: Column | float = 1.0, **data: Column) -> DataFrame:
        data = {"service": F.col("service"), "to_service": F.col("service"), "channel": F.lit(None).cast("string"), "route": F.lit(None).cast("string"), "handler": F.lit(None).cast("string")} | data
        steps = data.pop("steps", F.lit(None).cast(f"array<{stitch.STEP}>"))
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(score).cast("double").alias("score") if isinstance(score, float) else score.cast("double").alias("score"), F.col("ord").cast("string").alias("ord"), *[c.alias(n) for n, c in data.items()], steps.cast(f"array<{stitch.STEP}>").alias("steps"))

    own = F.transform("steps", lambda s: F.struct(s["statement"].alias("statement"), s["location"].alias("location"), s["file"].alias("file"), s["function_id"].alias("function_id")))
    source = node("source", F.col("service"), F.col("source_location"))
    reached = matching.flow_calls(flows.where("kind = 'out'").select("service", "flow_id", "sink_location"), outbound.select("service", "id", "file", "location", "flow_ref"))
    out_flows = flows.where("kind = 'out'").join(reached.select("service", "flow_id", "id"), ["service", "flow_id"])
    handled = matching.handler_calls(outbound.select("service", "id", "file", "line", "ord"), endpoints).withColumn("ord", F.col("out_ord"))
    handled = handled.join(endpoints.select("service", "ep", "route", "handler_name"), ["service", "ep"])
    matched = matching.match(calls, targets, services.select("service", "tokens", "base_path"))
    raw = calls.select(F.col("service").alias("from_service"), "id", "raw")
    hops = matched.join(raw, ["from_service", "id"]).withColumn("service", F.col("from_service")).withColumn("ord", F.col("rank"))
    arriving = matched.select(F.col("to_service").alias("service"), "ep").distinct()
    wired = matching.endpoint_sources(endpoints.join(arriving, ["service", "ep"], "left_semi"), tainted).withColumn("ord", F.col("source"))

    edges = graph.edges_of(
        edge(sinks, source, node("sink", F.col("service"), F.col("sink_location")), "intra_flow", steps=own),
        edge(out_flows, source, node("boundary", F.col("service"), F.col("id")), "intra_flow", steps=own),
        edge(entry_eps, node("entry", F.col("service"), F.col("ref")), node("endpoint", F.col("service"), F.col("ep")), "enters"),
        edge(handled, node("endpoint", F.col("service"), F.col("ep")), node("boundary", F.col("service"), F.col("id")), "handler_calls", route=F.col("route"), handler=F.col("handler_name")),
        edge(entry_src.withColumn("ord", F.col("source")), node("entry", F.col("service"), F.col("source")), node("source", F.col("service"), F.col("source")), "enters"),
        edge(hops, node("boundary", F.col("service"), F.col("id")), node("endpoint", F.col("to_service"), F.col("ep")), "inter_call", F.col("score"), to_service=F.col("to_service"), channel=F.col("raw")),
        edge(wired, node("endpoint", F.col("service"), F.col("ep")), node("source", F.col("service"), F.col("source")), "enters", F.col("score")),
    )
    return nodes, edges


def _stitched(services: DataFrame, flows: DataFrame, outbound: DataFrame, endpoints: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    nodes, edges = build_graph(services, flows, outbound, endpoints)
    edges = checkpoint(edges)
    paths, truncated = graph.path_search(nodes, edges, depth)
    b = outbound.select(graph.node_id("boundary", F.col("service"), F.col("id")).alias("id"), F.col("file").alias("file"), F.col("line").alias("line"), F.col("channel").alias("channel"), F.lit(None).cast("string").alias("route"), F.lit(None).cast("string").alias("handler"))
    e = endpoints.withColumn("ep", _ref()).dropDuplicates(["service", "ep"]).select(graph.node_id("endpoint", F.col("service"), F.col("ep")).alias("id"), "file", "line", F.lit(None).cast("string").alias("channel"), "route", "handler")
    data = b.unionByName(e)
    side = lambda p: data.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("file", "line", "channel", "route", "handler")])
    full = stitch.edge_steps(edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left"))
    return stitch.best_flows(stitch.path_flows(paths, full)), truncated


def global_flows(services: DataFrame, flows: DataFrame, outbound: DataFrame, endpoints: DataFrame, depth: int = fixed.MAX_DEPTH) -> DataFrame:
    """Stitched flows across services, the best per sink, services and channels, numbered gflow_0, ..."""
    return _stitched(services, flows, outbound, endpoints, depth)[0]


def document(services: DataFrame, flows: DataFrame, outbound: DataFrame, endpoints: DataFrame, application: str, depth: int = fixed.MAX_DEPTH, manifest: str | None = None) -> DataFrame:
    """The document of an application's stitched flows, one row; writers.write_document makes it a file."""
    found, truncated = _stitched(services, flows, outbound, endpoints, depth)
    return stitch.global_document(checkpoint(found), services, application, truncated, manifest)


def summary(found: DataFrame) -> DataFrame:
    return stitch.summarize(found)
