"""Writers of documents: one JSON text per row, or one document of many rows where its readers want a single one."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgraph.sources import schemas


def write_rows(df: DataFrame, path: str) -> None:
    """A JSON text per row, over whatever stood there; many files, each a part."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_document(df: DataFrame, path: str) -> None:
    """A single row as one JSON file."""
    write_rows(df.coalesce(1), path)


def json_text(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def json_value(c: Column) -> Column:
    """The JSON text of a plain value, without a struct or list around it."""
    listed = json_text(F.array(c))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def json_entry(key: Column, value: Column) -> Column:
    """An entry of a JSON map as write_elements takes it; value is a JSON text."""
    return F.concat(json_value(key), F.lit(":"), value)


def write_elements(elements: DataFrame, path: str, form: schemas.Lines, foot: str | None = None) -> None:
    """One JSON file of a list or map, an element on each line between the form's head and foot, which no row holds in whole.

    elements: value, the JSON text of an element, and ord, its place. One task sorts and writes them, since they are one file.
    """
    ends = elements.sparkSession.range(2).select((F.col("id") * 2).alias("_part"), F.when(F.col("id") == 0, F.lit(form.head)).otherwise(F.lit(foot or form.foot)).alias("value"))
    rows = elements.select(F.lit(1).cast("long").alias("_part"), "value", "ord").unionByName(ends, allowMissingColumns=True)
    rows = rows.repartition(1).sortWithinPartitions("_part", "ord").withColumn("_n", F.monotonically_increasing_id())
    rows.select(F.when((F.col("_part") == 1) & (F.col("_n") > 1), F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value")).write.mode("overwrite").text(path)


def flow_document(flows: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    """One row: metadata, and grouped_flows, a map of group_key to its flows in order. Written even when empty.

    It gathers all flows in one row, as the format asks; write_rows keeps them apart.
    """
    fields = [c for c in flows.columns if c != "group_key"]
    rows = flows.groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in fields if c != "ord"]))).alias("flows"))
    meta = F.create_map(*[F.lit(x) for kv in (metadata or {"format": "flows"}).items() for x in kv])
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group_key", "flows")))).alias("grouped_flows")).select(meta.alias("metadata"), "grouped_flows")


def write_flow_document(flows: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """The file of flow_document with a group on each line, so that a row holds a group at most."""
    fields = [c for c in flows.columns if c != "group_key"]
    rows = flows.groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in fields if c != "ord"]))).alias("flows"))
    foot = "},\"metadata\":" + json.dumps(metadata or {"format": "flows"}) + "}"
    write_elements(rows.select(F.col("group_key").alias("ord"), json_entry(F.col("group_key"), json_text(F.col("flows"))).alias("value")), path, schemas.FLOW_LINES, foot)


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of nodes and edges; an edge's steps stand as their number."""
    e = edges.withColumn("step_count", F.greatest(F.size("steps"), F.lit(0))).drop("steps") if "steps" in edges.columns else edges
    all_ = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    return all_(nodes, "nodes").crossJoin(all_(e, "edges"))  # two single rows


def function_map(functions: DataFrame) -> DataFrame:
    return functions.agg(F.map_from_entries(F.collect_list(F.struct("function_id", F.struct(*[c for c in functions.columns if c != "function_id"])))).alias("function_definitions"))


def callsite_document(calls: DataFrame) -> DataFrame:
    """One row: the calls as a map, their number, and that of distinct targets."""
    return calls.agg(F.map_from_entries(F.collect_list(F.struct("callsite_id", "target_function_id"))).alias("callsite_resolutions"), F.count("*").alias("total"), F.count_distinct("target_function_id").alias("unique_targets"))


def write_by_service(operations: DataFrame, services: DataFrame, path: str) -> None:
    """Operations in a folder per service; those of none go to the first service, those of unknown ones are left out."""
    first = services.orderBy("ord").limit(1).select(F.col("service").alias("_first"))
    named = operations.crossJoin(F.broadcast(first)).withColumn("service", F.coalesce("service", "_first")).drop("_first")  # one row
    named.join(services.select("service"), "service", "left_semi").write.mode("overwrite").partitionBy("service").json(path)


def mark_stage(spark, path: str, app: str, stage: str) -> None:
    """Notes that a stage of an application is done."""
    spark.createDataFrame([(app, stage)], "app string, stage string").write.mode("append").parquet(path)


def stage_done(spark, path: str, app: str, stage: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.schema("app string, stage string").parquet(path).where((F.col("app") == app) & (F.col("stage") == stage)).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
