"""Readers of analysis artifacts: SARIF, extraction CSV, JSON maps, flow documents and source trees.

A missing or broken JSON file reads as an empty table of its schema, except where a table needs it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgraph.functions.identifiers import clean_uri
from flowgraph.functions.records import callsite_record, parse_endpoint, parse_inter, router_record
from flowgraph.operators.callgraph import valid_function
from flowgraph.operators.lines import explode_lines, in_spans
from flowgraph.operators.rows import keep_first, numbered, upsert
from flowgraph.sources import schemas


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents; broken ones are left out, and a path without files gives none."""
    full = f"{schema}, _corrupt_record string"
    try:
        read = spark.read.schema(full).option("multiLine", True).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        read = spark.createDataFrame([], full)
    return read.where("_corrupt_record is null").drop("_corrupt_record")


def _by_lines(spark: SparkSession, path: str, schema: str, form: schemas.Lines) -> DataFrame | None:
    """A document of one element for each element of the file, and its place _at; None where the file is not in that form.

    The lines are checked before: if one is broken or an end is missing, the file has to be read, and judged, as a whole.
    """
    try:
        text = spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    first = text.select(F.left("value", F.lit(len(form.head) + 1)).alias("value")).first()
    if len(text.inputFiles()) != 1 or not first or first.value != form.head:
        return None
    lines = text.select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    end = (F.col("value") == form.head) | F.startswith("value", F.lit(form.foot[0]))
    comma = F.startswith("value", F.lit(","))
    one = F.concat(F.lit(form.head), F.when(comma, F.substring("value", 2, 1 << 30)).otherwise(F.col("value")), F.lit(form.foot))
    read = F.from_json(one, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    seen = lines.select("_block", "_id", end.alias("_end"), (~end & ~comma).alias("_bare"), read.alias("_d")).select("*", F.expr(form.count.format("_d")).alias("_size"))
    bad = ~F.col("_end") & (F.col("_d._corrupt_record").isNotNull() | ~F.coalesce(F.col("_size") == 1, F.lit(False)))
    blocks = seen.groupBy("_block").agg(
        F.min("_id").alias("first"), F.max("_id").alias("last"), F.count("*").alias("n"), F.count_if("_end").alias("ends"), F.count_if("_bare").alias("bare"), F.count_if(bad).alias("bad"), F.max(F.when(F.col("_end"), F.col("_id"))).alias("end"),
    ).orderBy("_block").collect()
    total = lambda c: sum(b[c] for b in blocks)
    if total("bad") or total("ends") != 2 or total("bare") != (total("n") > 2) or blocks[-1].end != blocks[-1].last:
        return None
    shifts, before = [], 0
    for b in blocks:
        shifts.append((b["_block"], before - b["first"] - 1))
        before += b["n"]
    shift = F.broadcast(spark.createDataFrame(shifts, "_block long, _shift long"))  # a row per split of the file
    rows = lines.where(~end).join(shift, "_block")
    return rows.select(F.from_json(one, schema).alias("_d"), (F.col("_id") + F.col("_shift")).alias("_at")).select("_d.*", "_at")


def sarif_results(spark: SparkSession, path: str) -> DataFrame:
    """result_index, result: all results of all runs, numbered in their order."""
    by_lines = _by_lines(spark, path, schemas.SARIF, schemas.SARIF_LINES)
    if by_lines is not None:
        return by_lines.select(F.col("_at").cast("int").alias("result_index"), F.get(F.get("runs", F.lit(0))["results"], F.lit(0)).alias("result"))
    runs = _json(spark, path, schemas.SARIF).select(F.posexplode("runs").alias("_run", "_r"))
    rows = runs.select("_run", F.posexplode("_r.results").alias("_i", "result"))
    before = runs.select(F.col("_run").alias("_b"), F.size("_r.results").alias("_n"))
    offset = rows.select("_run").distinct().join(before, F.col("_b") < F.col("_run"), "left").groupBy("_run").agg(F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).cast("int").alias("_at"))
    return rows.join(offset, "_run").select((F.col("_i") + F.col("_at")).alias("result_index"), "result")


def sarif_messages(spark: SparkSession, path: str) -> DataFrame:
    """result_index, message and the file and line of the first location."""
    place = F.get("result.locations", F.lit(0))["physicalLocation"]
    return sarif_results(spark, path).select("result_index", F.col("result.message.text").alias("message"), clean_uri(place["artifactLocation"]["uri"]).alias("file"), place["region"]["startLine"].alias("line"))


def interservice(spark: SparkSession, path: str) -> DataFrame:
    """Outbound calls of a SARIF file, ids out_0, ... in their order."""
    rows = sarif_messages(spark, path).withColumn("_r", parse_inter(F.col("message"))).where("_r is not null")
    return numbered(rows, "id", "result_index", pattern="out_%d").select("id", "_r.*", F.col("result_index").alias("ord"))


def endpoints(spark: SparkSession, path: str) -> DataFrame:
    """Endpoints of a SARIF file; one without a place takes that of its result."""
    rows = sarif_messages(spark, path).withColumn("_r", parse_endpoint(F.col("message"))).where("_r is not null")
    missing = F.col("_r.file") == ""
    return rows.select("_r.protocol", "_r.method", "_r.route", "_r.handler", "_r.handler_name", F.when(missing, F.col("file")).otherwise(F.col("_r.file")).alias("file"), F.when(missing, F.col("line")).otherwise(F.col("_r.line")).alias("line"), F.col("result_index").alias("ord"))


def callsites(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a SARIF file; of one id the last result counts."""
    rows = sarif_messages(spark, path).withColumn("_r", callsite_record(F.col("message"))).where("_r is not null")
    return upsert(rows.select("_r.*", F.col("result_index").alias("load_ord")), ["callsite_id"])


def router_definitions(spark: SparkSession, path: str, lines: DataFrame) -> DataFrame:
    """Routers of a SARIF file with the source of their definition; a note where the span isn't in its file."""
    rows = sarif_messages(spark, path).withColumn("_r", router_record(F.col("message"))).where("_r is not null").select("_r.*").distinct()
    pattern = r"^(.*):(\d+):(\d+)$"
    part = lambda g: F.regexp_extract("router_definition_id", pattern, g)
    spans = rows.select("router_definition_id", part(1).alias("_file"), part(2).try_cast("int").alias("_a"), part(3).try_cast("int").alias("_b")).distinct()
    spans = spans.where("_a <= _b").withColumn("start_line", F.col("_a")).withColumn("end_line", F.col("_b"))
    inside = in_spans(spans, lines)
    entry = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    source = inside.groupBy("router_definition_id", "_a", "_b").agg(F.array_join(F.transform(entry, lambda x: x["text"]), "\n").alias("_s"), F.count("*").alias("_n"))
    whole = source.where(F.col("_n") == F.col("_b") - F.col("_a") + 1).select("router_definition_id", F.col("_s").alias("router_source_code"))
    return rows.join(whole, "router_definition_id", "left").select("function_id", "router_definition_id", F.coalesce("router_source_code", F.concat(F.lit("// Source not available: "), "router_definition_id")).alias("router_source_code"))


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The pipe-delimited record in the fourth column of each row, and the row's place."""
    read = spark.read.text(path).select(F.from_csv("value", "a string, b string, c string, record string", {"escape": '"'}).alias("_c"), F.monotonically_increasing_id().alias("ord"))
    return read.where("_c.record is not null").select(F.split("_c.record", r"\|").alias("p"), "ord")


def _at(k: int) -> Column:
    return F.trim(F.get("p", F.lit(k)))


def _words(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda s: F.trim(s)), lambda s: s != "")


def function_records(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Functions of an extraction CSV: nine parts at least and whole numbers for lines; valid ones, the first of an id.

    Each part is trimmed. An empty class is null, an empty package stays empty.
    """
    rows = _csv_records(spark, path).where(F.size("p") >= 9).select(
        _at(0).alias("function_id"), _at(1).alias("name"), _at(2).alias("file_path"), _at(3).try_cast("int").alias("start_line"), _at(4).try_cast("int").alias("end_line"),
        _at(5).alias("signature"), F.nullif(_at(6), F.lit("")).alias("class_name"), _at(7).alias("package_name"), _words(_at(8)).alias("annotations"), "ord",
    )
    good = rows.where("start_line is not null and end_line is not null").where(valid_function(language))
    return keep_first(good, ["function_id"], "ord").drop("ord")


def class_records(spark: SparkSession, path: str) -> DataFrame:
    """Classes of an extraction CSV: eight parts at least; fields are `name:type`, others are left out; an empty package is null."""
    field = lambda s: F.struct(F.trim(F.regexp_extract(s, "^([^:]*):", 1)).alias("name"), F.trim(F.regexp_extract(s, "^[^:]*:(.*)$", 1)).alias("type"))
    fields = F.transform(F.filter(_words(_at(7)), lambda s: F.contains(s, F.lit(":"))), field)
    rows = _csv_records(spark, path).where(F.size("p") >= 8).select(
        _at(0).alias("class_id"), _at(1).alias("name"), _at(2).alias("file_path"), _at(3).try_cast("int").alias("start_line"), _at(4).try_cast("int").alias("end_line"),
        F.nullif(_at(5), F.lit("")).alias("package_name"), _words(_at(6)).alias("annotations"), fields.alias("fields"), "ord",
    )
    return keep_first(rows.where("start_line is not null and end_line is not null"), ["class_id"], "ord").drop("ord")


#: Languages whose functions and classes can be mapped, by all their names.
MAPPED = {"java": "java", "python": "python", "go": "go", "cpp": "cpp", "c++": "cpp", "csharp": "csharp", "javascript": "javascript"}


def mapping(spark: SparkSession, functions: str, classes: str | None, language: str) -> dict[str, DataFrame]:
    """The functions table of a language's extraction, by that language's rules, and the classes where they were extracted."""
    if language not in MAPPED:
        raise ValueError(f"unsupported language: {language}")
    found = {"functions": function_records(spark, functions, MAPPED[language])}
    return found | {"classes": class_records(spark, classes)} if classes else found


def _map(spark: SparkSession, path: str, name: str, value: str) -> DataFrame:
    return _json(spark, path, f"{name} map<string,{value}>").select(F.explode(name).alias("k", "v"))


def function_map(spark: SparkSession, path: str) -> DataFrame:
    """Functions of a JSON map; a missing name is empty, missing lines are 0, class and package null."""
    value = "struct<name:string,file_path:string,start_line:int,end_line:int,signature:string,class_name:string,package_name:string>"
    rows = _map(spark, path, "function_definitions", value)
    return rows.select(
        F.col("k").alias("function_id"), F.coalesce("v.name", F.lit("")).alias("name"), F.coalesce("v.file_path", F.lit("")).alias("file_path"), F.coalesce("v.start_line", F.lit(0)).alias("start_line"),
        F.coalesce("v.end_line", F.lit(0)).alias("end_line"), F.coalesce("v.signature", F.lit("")).alias("signature"), "v.class_name", "v.package_name",
    )


def call_map(spark: SparkSession, path: str) -> DataFrame:
    return _map(spark, path, "callsite_resolutions", "string").select(F.col("k").alias("callsite_id"), F.col("v").alias("target_function_id"))


def router_map(spark: SparkSession, path: str) -> DataFrame:
    """Functions' routers with the source of their definitions, empty where that is missing."""
    routed = _map(spark, path, "function_to_router", "string").select(F.col("k").alias("function_id"), F.col("v").alias("router_definition_id"))
    source = _map(spark, path, "router_definitions", "string").select(F.col("k").alias("router_definition_id"), F.col("v").alias("router_source_code"))
    return routed.join(source, "router_definition_id", "left").select("function_id", "router_definition_id", F.coalesce("router_source_code", F.lit("")).alias("router_source_code"))


def class_map(spark: SparkSession, path: str) -> DataFrame:
    value = "struct<name:string,file_path:string,start_line:int,end_line:int,package_name:string,annotations:array<string>,fields:array<struct<name:string,type:string>>>"
    rows = _map(spark, path, "class_definitions", value)
    return rows.select(F.col("k").alias("class_id"), "v.name", "v.file_path", "v.start_line", "v.end_line", "v.package_name", F.coalesce("v.annotations", F.array().cast("array<string>")).alias("annotations"), F.coalesce("v.fields", F.array().cast("array<struct<name:string,type:string>>")).alias("fields"))


def call_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables of a folder of JSON maps; functions and calls must be there."""
    tables = {"functions": function_map(spark, f"{folder}/functions.json"), "calls": call_map(spark, f"{folder}/callsites.json")}
    for name, table in tables.items():
        if table.isEmpty():
            raise FileNotFoundError(f"{folder} has no {name}")
    return tables | {"routers": router_map(spark, f"{folder}/routers.json"), "classes": class_map(spark, f"{folder}/classes.json")}


def flow_document(spark: SparkSession, path: str) -> DataFrame:
    """Flows of a grouped document: group_key, the flow's columns, and ord, their place in it."""
    by_lines = _by_lines(spark, path, schemas.FLOW_DOCUMENT, schemas.FLOW_LINES)
    if by_lines is None:
        groups = _json(spark, path, schemas.FLOW_DOCUMENT).select(F.posexplode(F.map_entries("grouped_flows")).alias("_g", "_e"))
    else:
        groups = by_lines.select(F.col("_at").cast("int").alias("_g"), F.explode(F.map_entries("grouped_flows")).alias("_e"))
    rows = groups.select("_g", F.col("_e.key").alias("group_key"), F.posexplode("_e.value").alias("_i", "_f"))
    return rows.select("group_key", "_f.*", F.struct("_g", "_i").alias("ord"))


def outbound_document(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, f"outbound_calls array<{schemas.OUTBOUND}>").select(F.posexplode("outbound_calls").alias("ord", "_c")).select("_c.*", "ord")


def endpoint_document(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, f"endpoints array<{schemas.ENDPOINT}>").select(F.posexplode("endpoints").alias("ord", "_e")).select("_e.*", "ord")


def check_document(spark: SparkSession, path: str) -> DataFrame:
    """Methods with authorization checks."""
    shape = "methods_with_auth array<struct<id:string,method_location:struct<file:string,start_line:int,end_line:int>,method_source_with_lines:string,auth_checks:array<struct<expression:string,line:int>>>>"
    by_lines = _by_lines(spark, path, shape, schemas.CHECK_LINES)
    found = _json(spark, path, shape) if by_lines is None else by_lines
    return found.select(F.explode("methods_with_auth").alias("_m")).select("_m.*")


def library(spark: SparkSession, path: str) -> DataFrame:
    """fqn, text, ord of library notes; keys that begin with _ are remarks."""
    shape = "semantics map<string,string>"
    by_lines = _by_lines(spark, path, shape, schemas.LIBRARY_LINES)
    if by_lines is None:
        rows = _json(spark, path, shape).select(F.posexplode(F.map_entries("semantics")).alias("ord", "_e"))
    else:
        rows = by_lines.select(F.col("_at").cast("int").alias("ord"), F.explode(F.map_entries("semantics")).alias("_e"))
    return rows.select(F.col("_e.key").alias("fqn"), F.col("_e.value").alias("text"), "ord").where(~F.startswith("fqn", F.lit("_")))


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """file (below root) and text of every file."""
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^file:/*", "/")
    path = F.regexp_replace(F.try_url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    return read.select(F.replace(path, base, F.lit("")).alias("file"), F.col("value").alias("text"))


def source_lines(spark: SparkSession, root: str) -> DataFrame:
    return explode_lines(source_tree(spark, root))
