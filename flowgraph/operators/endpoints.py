"""Endpoints and outbound calls found in source text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.functions import fixed
from flowgraph.functions.identifiers import present
from flowgraph.functions.records import infer_protocol, infer_verb, outbound_channels
from flowgraph.operators.rows import keep_first, numbered


def source_files(files: DataFrame, language: str = "", file: str = "file") -> DataFrame:
    """Files of a language, or of any known one, outside vendored folders."""
    endings = fixed.SOURCE_FILES.get(language.lower(), (".py", ".java", ".go", ".js", ".ts", ".cs"))
    wanted = reduce(lambda a, b: a | b, [F.endswith(file, F.lit(e)) for e in endings])
    return files.where(wanted & ~F.concat(F.lit("/"), F.col(file)).rlike(fixed.VENDOR_PATH))


def _verb(text: Column, route: tuple) -> Column:
    pattern, verb, _, without = route
    found = F.upper(F.regexp_replace(F.regexp_extract(text, pattern, verb), "[\"'\\s]", ""))
    found = F.element_at(F.split(found, ","), 1)
    good = found != ""
    return F.when(good & ~F.startswith(found, F.lit(without)) if without else good, found)


def route_lines(lines: DataFrame) -> DataFrame:
    """A row per line and pattern that finds a route there: file, line_no, way, method, route."""
    found = [
        lines.where(F.col("text").rlike(r[0])).select("file", "line_no", F.lit(k).alias("way"), _verb(F.col("text"), r).alias("method"), present(r[0], F.col("text"), r[2]).alias("route"))
        for k, r in enumerate(fixed.ROUTES)
    ]
    return reduce(DataFrame.unionByName, found).where("route is not null")


def handlers(lines: DataFrame, window: int = fixed.HANDLER_WINDOW) -> DataFrame:
    """For each line of each file the first function name in it and the next seven: file, line_no, name, handler_line."""
    names = F.coalesce(*[F.nullif(F.regexp_extract("text", fixed.HANDLER_NAME, g), F.lit("")) for g in (1, 2, 3)])
    entry = F.when(names.isNotNull() & ~F.lower(names).isin(*fixed.NOT_HANDLERS), F.struct("line_no", names.alias("name")))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(0, window - 1)
    found = lines.withColumn("_h", F.min(entry).over(w))
    return found.select("file", "line_no", F.col("_h.name").alias("name"), F.coalesce("_h.line_no", "line_no").alias("handler_line"))


def heuristic_endpoints(lines: DataFrame) -> DataFrame:
    """Endpoints by their decorators: file, line, method, route, handler, handler_name, and the order they stand in.

    The first class-level prefix among a file's first lines goes before routes that lack it; the prefix line itself,
    without a verb, is no endpoint.
    """
    prefix = lines.where(F.col("line_no") <= fixed.PREFIX_LINES).select("file", "line_no", present(fixed.ROUTE_PREFIX, F.col("text")).alias("_p")).where("_p is not null")
    prefix = prefix.groupBy(F.col("file").alias("_f")).agg(F.min_by("_p", "line_no").alias("_prefix"))
    found = route_lines(lines).join(handlers(lines), ["file", "line_no"]).join(prefix, F.col("file") == F.col("_f"), "left")
    bare = lambda c: F.trim(c, F.lit("/"))
    p, r = F.coalesce("_prefix", F.lit("")), F.col("route")
    found = found.where(~(F.col("method").isNull() & (p != "") & (bare(r) == bare(p))))
    joined = F.concat(F.lit("/"), bare(F.concat_ws("/", bare(p), bare(r))))
    route = F.when((p != "") & ~F.startswith(r, p), joined).when(F.startswith(r, F.lit("/")), r).otherwise(F.concat(F.lit("/"), r))
    place = lambda line: F.concat_ws(":", "file", line.cast("string"))
    handler = F.when(F.col("name").isNotNull(), F.concat_ws("@", "name", place(F.col("handler_line")))).otherwise(place(F.col("line_no")))
    return found.select("file", F.col("handler_line").alias("line"), "method", route.alias("route"), handler.alias("handler"), F.coalesce("name", F.lit("")).alias("handler_name"), F.struct("file", "line_no", "way").alias("ord"))


def distinct_endpoints(endpoints: DataFrame) -> DataFrame:
    """Endpoints that are the same in protocol, method, route, handler and file once, the first by ord; ids ep_0, ..."""
    once = keep_first(endpoints, ["protocol", "method", "route", "handler", "file"], "ord")
    return numbered(once, "id", "ord", pattern="ep_%d")


def heuristic_outbound(flows: DataFrame) -> DataFrame:
    """Outbound calls in the last statement of each flow: protocol, method, channel, file, line, location, flow_ref.

    A topic that a plain publish names counts as a message.
    """
    last = F.try_element_at("steps", F.lit(-1))
    rows = flows.where(F.size("steps") > 0).select("flow_id", "ord", "source_location", last.alias("_s"))
    said = rows.withColumn("_t", F.coalesce("_s.statement", F.lit(""))).select("*", F.posexplode(outbound_channels(F.col("_t"))).alias("channel_ord", "channel"))
    protocol = infer_protocol(F.col("_t"))
    topic = ~F.contains("channel", F.lit("://")) & ~F.startswith("channel", F.lit("/"))
    function = F.col("_s.function_id")
    return said.select(
        F.when((protocol == "http") & topic, F.lit("kafka")).otherwise(protocol).alias("protocol"), infer_verb(F.col("_t")).alias("method"), "channel", F.col("_s.file").alias("file"),
        F.coalesce(F.regexp_extract("_s.location", r":(\d+)$", 1).try_cast("int"), F.lit(0)).alias("line"), F.col("_s.location").alias("location"),
        F.when(function != fixed.NO_FUNCTION, function).otherwise(F.lit("")).alias("enclosing_function"), "source_location", F.col("flow_id").alias("flow_ref"), "ord", "channel_ord",
    )
