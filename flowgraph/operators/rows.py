"""Ordered row operators: keep-first, keep-last, runs, unions and numbering.

Orders are explicit columns; none depends on how rows are partitioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.sources.workspace import checkpoint


def _first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row for each key, the first by the order."""
    return _first(df, keys, list(order))


def upsert(df: DataFrame, keys: list[str], load: str = "load_ord") -> DataFrame:
    """One row for each key, that of the last load; later rows replace whole earlier ones."""
    others = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(load)).alias("_row"))
    return packed.select(*keys, "_row.*")


def merge(*loads: DataFrame, keys: list[str]) -> DataFrame:
    """The loads put together by upsert, in their order."""
    numbered = [df.withColumn("load_ord", F.lit(k)) for k, df in enumerate(loads)]
    return upsert(reduce(DataFrame.unionByName, numbered), keys).drop("load_ord")


def collapse_runs(df: DataFrame, group: list[str], order: str, same: list[str]) -> DataFrame:
    """Without rows that equal the row before them in `same`; nulls equal each other."""
    w = Window.partitionBy(*group).orderBy(order)
    repeat = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in same])
    first = F.row_number().over(w) == 1
    return df.withColumn("_keep", first | ~repeat).where("_keep").drop("_keep")


def force_roles(df: DataFrame, group: list[str], order: str, role: str = "role") -> DataFrame:
    """Steps numbered anew: the first is a source and the last a sink, a lone one a sink; step_role names number and role."""
    w = Window.partitionBy(*group).orderBy(order)
    last = F.lead(F.lit(1)).over(w).isNull()
    n = F.row_number().over(w)
    forced = F.when(last, F.lit("sink")).when(n == 1, F.lit("source")).otherwise(F.col(role))
    tag = F.when(forced.isin("source", "sink"), F.concat(F.lit(" ["), F.upper(forced), F.lit("]"))).otherwise(F.lit(""))
    return df.withColumn("step_no", n).withColumn("step_role", F.concat(F.lit("Step "), n.cast("string"), tag)).withColumn(role, forced)


def union_all(*branches: DataFrame) -> DataFrame:
    """Rows of all branches with their branch number; missing columns are null."""
    numbered = [df.withColumn("branch", F.lit(k)) for k, df in enumerate(branches)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def numbered(df: DataFrame, name: str, *order: str | Column, start: int = 0, pattern: str | None = None) -> DataFrame:
    """A gapless number over the whole table, or a text of it, by a total order.

    Rows are sorted by ranges and counted by partition, so no task sees more than its own range.
    """
    place = fresh_name("_place", df)
    rows = checkpoint(df.orderBy(*order).withColumn(place, F.monotonically_increasing_id()))
    parts = rows.groupBy(F.shiftright(place, 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    n = F.col("_before") + F.col(place) % F.lit(1 << 33) + start
    out = rows.join(F.broadcast(before), F.shiftright(place, 33) == F.col("_part"))  # a row per partition
    return out.withColumn(name, F.format_string(pattern, n) if pattern else n).drop(place, "_part", "_before")


def fresh_name(name: str, df: DataFrame) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
