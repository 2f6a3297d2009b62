"""Flows: step rows from SARIF, flow rows, groups and their summaries.

steps: flow, pos, location, file, line, statement, role, function_id
flows: flow_id, ord, source_location, sink_location, step_count, steps (in order)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgraph.functions import fixed
from flowgraph.functions.identifiers import clean_uri
from flowgraph.operators.callgraph import last_function
from flowgraph.operators.components import shared_components
from flowgraph.operators.lines import statement_at, tainted_variable
from flowgraph.operators.rows import collapse_runs, force_roles


def location(physical: Column) -> Column:
    """Struct of file, start_line, end_line, start_column, end_column; a missing end is the start, a missing line 0."""
    region = physical["region"]
    line, column = F.coalesce(region["startLine"], F.lit(0)), F.coalesce(region["startColumn"], F.lit(0))
    return F.struct(
        F.coalesce(clean_uri(physical["artifactLocation"]["uri"]), F.lit("")).alias("file"), line.alias("start_line"), F.coalesce(region["endLine"], line).alias("end_line"),
        column.alias("start_column"), F.coalesce(region["endColumn"], column).alias("end_column"),
    )


def sarif_steps(results: DataFrame, root: str = "") -> DataFrame:
    """A row per location of each result's code flows and thread flows: flow `flow_r_c_t`, pos, role and place.

    results has result_index and result (sources.artifacts). Results without a location give none, and absolute paths
    outside root are left out.
    """
    flows = results.where(F.size("result.locations") > 0).select("result_index", F.posexplode("result.codeFlows").alias("_c", "_cf"))
    threads = flows.select("result_index", "_c", F.posexplode("_cf.threadFlows").alias("_t", "_tf"))
    steps = threads.select("result_index", "_c", "_t", F.posexplode("_tf.locations").alias("pos", "_l")).where("_l.location.physicalLocation is not null")
    roles = F.filter(F.transform("_l.taxa", lambda t: t["properties"]["CodeQL/DataflowRole"]), lambda r: r.isNotNull())
    out = steps.select(
        F.concat_ws("_", F.lit("flow"), "result_index", "_c", "_t").alias("flow"), F.struct("result_index", "_c", "_t").alias("ord"), "pos",
        F.coalesce(F.get(roles, F.lit(0)), F.lit("step")).alias("role"), location(F.col("_l.location.physicalLocation")).alias("_p"),
    ).select("flow", "ord", "pos", "role", "_p.*").withColumnRenamed("start_line", "line")
    return out.where(~F.startswith("file", F.lit("/")) | (F.lit(bool(root)) & F.startswith("file", F.lit(root.rstrip("/") + "/"))))


def complete_steps(steps: DataFrame, lines: DataFrame, functions: DataFrame) -> DataFrame:
    """steps with statement, tainted_variable, location and function_id; runs of one place collapsed, roles forced."""
    said = statement_at(steps, lines)
    text = lines.select(F.col("file").alias("_f"), F.col("line_no").alias("_n"), F.col("text").alias("_text"))
    said = said.join(text, (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_n")), "left")
    said = said.withColumn("tainted_variable", tainted_variable(F.col("_text"), F.col("start_column"), F.col("end_column"))).drop("_f", "_n", "_text")
    said = said.withColumn("location", F.concat_ws(":", "file", F.col("line").cast("string")))
    inside = last_function(said.select(F.concat_ws("#", "flow", "pos").alias("key"), "file", "line"), functions, "key", "file", "line")
    named = said.withColumn("_key", F.concat_ws("#", "flow", "pos")).join(inside.withColumnRenamed("key", "_k"), F.col("_key") == F.col("_k"), "left")
    named = named.withColumn("function_id", F.coalesce("function_id", F.lit(fixed.NO_FUNCTION))).drop("_key", "_k")
    return force_roles(collapse_runs(named, ["flow"], "pos", ["location", "statement"]), ["flow"], "pos")


def flow_rows(steps: DataFrame) -> DataFrame:
    """A row per flow with its steps; its source and sink are the places of the first steps with these roles."""
    step = F.struct("step_no", "step_role", "statement", "tainted_variable", "location", "file", "function_id", "role")
    at = lambda role: F.min_by("location", F.struct((F.col("role") != role), "step_no"))
    out = steps.groupBy("flow").agg(
        F.first("ord").alias("ord"), at("source").alias("source_location"), F.coalesce(F.min_by(F.when(F.col("role") == "sink", F.col("location")), F.when(F.col("role") == "sink", F.col("step_no")))).alias("sink_location"),
        F.count("*").cast("int").alias("step_count"), F.array_sort(F.collect_list(step)).alias("steps"),
    )
    return out.withColumnRenamed("flow", "flow_id")


def group_key(flows: DataFrame, by: str) -> DataFrame:
    """flows with group_key: the sink, the source, or the component of shared ones, which a lone flow names itself."""
    if by in ("sinks", "sources"):
        return flows.withColumn("group_key", F.col({"sinks": "sink_location", "sources": "source_location"}[by]))
    ids = flows.select("flow_id", F.col("source_location").alias("source"), F.col("sink_location").alias("sink"))
    found = shared_components(ids, "flow_id").withColumnRenamed("flow_id", "_f")
    joined = flows.join(found, flows.flow_id == F.col("_f")).drop("_f")
    sizes = joined.groupBy(F.col("component").alias("_c")).agg(F.count("*").alias("_n"), F.count_distinct("source_location").alias("_s"), F.count_distinct("sink_location").alias("_k"))
    shared = F.concat_ws(",", F.when(F.col("_s") < F.col("_n"), F.concat(F.lit("sources:"), "_s")), F.when(F.col("_k") < F.col("_n"), F.concat(F.lit("sinks:"), "_k")))
    key = F.when(F.col("_n") > 1, F.concat(F.lit("shared_group_"), "component", F.lit("_("), shared, F.lit(")"))).otherwise(F.concat(F.lit("isolated_"), "flow_id"))
    return joined.join(sizes, F.col("component") == F.col("_c")).withColumn("group_key", key).drop("_c", "_n", "_s", "_k", "component")


def _distinct(rows: DataFrame, name: str, lists: bool) -> DataFrame:
    """For each group_key how many distinct `value` there are, and, if asked for, these sorted."""
    once = rows.where("value is not null").distinct()
    found = [F.count("*").cast("int").alias(f"unique_{name}"), *([F.sort_array(F.collect_list("value")).alias(name)] if lists else [])]
    return once.groupBy("group_key").agg(*found)


def summarize_groups(flows: DataFrame, lists: bool = True) -> DataFrame:
    """For each group_key: flows, distinct sources, sinks and functions, and, unless lists is off, these sorted.

    Values are made distinct before they are counted, so no group's flows are gathered in one row.
    """
    functions = flows.select("group_key", F.explode(F.array_distinct(F.transform("steps", lambda s: s["function_id"]))).alias("value"))
    parts = {
        "sources": flows.select("group_key", F.col("source_location").alias("value")), "sinks": flows.select("group_key", F.col("sink_location").alias("value")),
        "functions": functions.where(~F.col("value").isin("", fixed.NO_FUNCTION)),
    }
    out = flows.groupBy("group_key").agg(F.count("*").alias("flow_count"))
    for name, rows in parts.items():
        out = out.join(_distinct(rows, name, lists).withColumnRenamed("group_key", "_g"), F.col("group_key").eqNullSafe(F.col("_g")), "left").drop("_g")
        out = out.withColumn(f"unique_{name}", F.coalesce(f"unique_{name}", F.lit(0)))
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>"))) if lists else out
    return out


def sink_place(steps: Column, sink_location: Column) -> Column:
    """Where a flow ends: its last step's place, and only without steps the place that it states."""
    return F.coalesce(F.when(F.size(steps) > 0, F.try_element_at(steps, F.lit(-1))["location"]).otherwise(sink_location), F.lit(""))


def first_groups(flows: DataFrame, most: int | None) -> DataFrame:
    """The flows of the first `most` groups, in the order in which their first flows stand; all for None."""
    if most is None:
        return flows
    first = flows.groupBy("group_key").agg(F.min("ord").alias("_o")).orderBy("_o", "group_key").limit(most).select("group_key")
    return flows.join(first, "group_key", "left_semi")


def summary(groups: DataFrame) -> DataFrame:
    """One row over all groups; functions are summed by group, so one that two groups share counts twice."""
    return groups.agg(F.count("*").alias("total_groups"), F.coalesce(F.sum("flow_count"), F.lit(0)).alias("total_flows"), F.coalesce(F.sum("unique_functions"), F.lit(0)).alias("total_unique_functions"))


def approximate_flows(flows: DataFrame, source: str = "", sink: str = "") -> DataFrame:
    """Flows whose first step mentions one term and whose last step the other; a blank term is in every flow."""

    def mentions(step: Column, term: str) -> Column:
        blob = F.lower(F.concat_ws(" ", step["statement"], step["function_id"], step["location"]))
        return F.lit(True) if not term.strip() else F.contains(blob, F.lower(F.trim(F.trim(F.lit(term)), F.lit("\"'"))))

    return flows.where(mentions(F.get("steps", F.lit(0)), source) & mentions(F.try_element_at("steps", F.lit(-1)), sink))
