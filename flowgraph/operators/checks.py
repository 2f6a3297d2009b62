"""Authorization checks: where they stand, what they guard, and the report on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.functions import fixed
from flowgraph.functions.identifiers import call_name, parse_location

GENUINE = ("Authentication Check", "Authorization Check")
NOT_ONE = "Not AuthN/AuthZ Check"


def check_places(results: DataFrame) -> DataFrame:
    """check_file, check_line, auth_expression and the method's file, start_line, end_line, from result messages.

    results: check_file, check_line, message, like `expression OCCURRED IN FUNCTION name AT place`; others give no row.
    A method of one line gets SPAN_DEFAULT more, a long one ends after SPAN_LIMIT.
    """
    said = F.split("message", " OCCURRED IN FUNCTION ")
    place = F.get(F.split(F.get(said, F.lit(1)), " AT "), F.lit(1))
    at = F.instr(place, F.col("check_file"))
    out = results.where(F.contains("message", F.lit("OCCURRED IN FUNCTION"))).select("check_file", "check_line", F.get(said, F.lit(0)).alias("auth_expression"), F.when(at > 0, parse_location(F.substring(place, at, F.length(place)))).alias("_m"))
    out = out.where("_m is not null").select("check_file", "check_line", "auth_expression", F.col("_m.file").alias("file"), F.col("_m.start_line").alias("start_line"), F.col("_m.end_line").alias("_end"))
    end = F.when(F.col("_end") == F.col("start_line"), F.col("start_line") + fixed.SPAN_DEFAULT).otherwise(F.col("_end"))
    return out.withColumn("end_line", F.least(end, F.col("start_line") + fixed.SPAN_LIMIT)).drop("_end")


def check_methods(places: DataFrame) -> DataFrame:
    """Methods `file@start-end` with their checks, by line; those with most checks first."""
    key = F.concat(F.col("file"), F.lit("@"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    checks = F.array_sort(F.collect_list(F.struct(F.col("check_line").alias("line"), F.col("auth_expression").alias("expression"))))
    out = places.groupBy(key.alias("id"), "file", "start_line", "end_line").agg(checks.alias("auth_checks"))
    return out.withColumn("n_checks", F.size("auth_checks")).orderBy(F.desc("n_checks"), "id")


def check_records(responses: DataFrame) -> DataFrame:
    """method_id, check_no, check_line, check_type, guarded_operations, reason from answers in `Key: value` lines.

    `Check Line:` opens a record; what follows belongs to it, the last value of a key counting.
    """
    lines = responses.select("method_id", F.posexplode(F.split("response", "\n")).alias("pos", "_l")).withColumn("_l", F.trim("_l"))
    keys = {"check_line": "Check Line:", "check_type": "Check Type:", "guarded_operations": "Guarded Operations:", "reason": "Reason:"}
    opens = F.startswith("_l", F.lit(keys["check_line"]))
    lines = lines.withColumn("check_no", F.sum(opens.cast("int")).over(Window.partitionBy("method_id").orderBy("pos")))
    value = F.trim(F.regexp_extract("_l", "^[^:]*:(.*)$", 1))
    last = lambda k: F.max_by(F.when(F.startswith("_l", F.lit(keys[k])), value), F.when(F.startswith("_l", F.lit(keys[k])), F.col("pos")))
    known = lines.where(F.col("_l").rlike("^(Check Line|Check Type|Guarded Operations|Reason):"))
    out = known.groupBy("method_id", "check_no").agg(*[last(k).alias(k) for k in keys])
    return out.withColumn("check_line", F.col("check_line").try_cast("int"))


def _operations(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\|"), lambda s: F.trim(s)), lambda s: s != "")


def pairs(records: DataFrame) -> DataFrame:
    """A row per operation that a genuine check guards: method_id, check_type, check_line, operation, operation_line.

    The operation ends at its first @.
    """
    good = records.where(F.col("check_type").isin(*GENUINE) & (F.coalesce("guarded_operations", F.lit("")) != "") & (F.col("guarded_operations") != "N/A"))
    rows = good.select("method_id", "check_type", "check_line", F.explode(_operations(F.col("guarded_operations"))).alias("_o"))
    name = F.trim(F.regexp_extract("_o", "^([^@]*)", 1))
    return rows.select("method_id", "check_type", "check_line", name.alias("operation"), F.regexp_extract("_o", r"^[^@]*@\s*(-?\d+)\s*$", 1).try_cast("int").alias("operation_line")).where("operation <> ''")


def operation_frequency(found: DataFrame, top: int = fixed.TOP_OPERATIONS) -> DataFrame:
    """The operations that most checks guard."""
    return found.groupBy("operation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "operation").limit(top)


def report(records: DataFrame, found: DataFrame, methods: DataFrame) -> DataFrame:
    """One row: checks, genuine and false ones, pairs, operations and rates."""
    checks = records.agg(F.count_if(F.col("check_line").isNotNull()).alias("total_checks"), F.count_if(F.col("check_type").isin(*GENUINE)).alias("genuine_checks"), F.count_if(F.col("check_type") == NOT_ONE).alias("false_positives"))
    ops = found.agg(F.count("*").alias("pairs"), F.count_distinct("operation").alias("unique_operations"))
    rate = lambda c: F.bround(100 * F.col(c) / F.greatest(F.col("total_checks"), F.lit(1)), 1)
    out = methods.agg(F.count_distinct("method_id").alias("total_methods")).crossJoin(checks).crossJoin(ops)  # three single rows
    return out.withColumn("accuracy_rate", rate("genuine_checks")).withColumn("false_positive_rate", rate("false_positives"))


def guarded_operations(records: DataFrame) -> DataFrame:
    """Distinct name, file_path, line of guarded operations, ending at their last @.

    The name is that before a parenthesis; a bare name is taken as it is.
    """
    rows = records.where("trim(guarded_operations) <> ''").select("file_path", F.explode(_operations(F.col("guarded_operations"))).alias("_o"))
    split = rows.select("file_path", F.trim(F.regexp_extract("_o", "^(.*?)(@[^@]*)?$", 1)).alias("_n"), F.regexp_extract("_o", r"@\s*(-?\d+)\s*$", 1).try_cast("int").alias("line")).where("_n <> ''")
    return split.select(F.coalesce(call_name(F.col("_n")), "_n").alias("name"), "file_path", "line").distinct()
