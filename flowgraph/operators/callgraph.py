"""The call graph: functions, calls, routers and classes, and joins among them.

functions: function_id, name, file_path, start_line, end_line, signature, class_name, package_name
calls: callsite_id, target_function_id          routers: function_id, router_definition_id, router_source_code
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.functions import fixed
from flowgraph.functions.identifiers import callsite_file, callsite_line, is_class_identifier, sanitize_identifier

#: Lines to a bin of the range joins: a function stands in each bin that it reaches into.
BIN = 64


def valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def search_names(df: DataFrame, pattern: str, limit: int = fixed.NAME_LIMIT, name: str = "name", key: str = "function_id") -> DataFrame:
    """Rows whose name holds the pattern, the first by file, line and key; none for a pattern that doesn't compile."""
    found = df.where(F.col(name).rlike(pattern)) if valid_pattern(pattern) else df.limit(0)
    return found.orderBy("file_path", "start_line", key).limit(limit)


def by_name(functions: DataFrame, name: str, routers: DataFrame | None = None) -> DataFrame:
    """Functions of exactly this name, with their router if any."""
    found = functions.where(F.col("name") == name)
    found = found.join(routers, "function_id", "left") if routers is not None else found
    return found.orderBy("file_path", "start_line", "function_id")


def by_id(df: DataFrame, value: str, key: str = "function_id") -> DataFrame:
    return df.where(F.col(key) == value)


def valid_function(language: str) -> Column:
    """Whether a function row is worth keeping, by the language it comes from."""
    name, package, cls = F.col("name"), F.coalesce("package_name", F.lit("")), F.coalesce("class_name", F.lit(""))
    stem = F.regexp_extract("file_path", r"([^/]*?)(\.[^./]*)?$", 1)
    rules = {
        "java": (~name.isin(*fixed.JAVA_LAMBDA_NAMES) | ((cls != "") & F.endswith(stem, cls))) & (~name.startswith("<") | name.isin(*fixed.JAVA_INITIALISERS)) & (package != ""),
        "python": ~name.isin(*fixed.PYTHON_NOISE),
        "csharp": ~(name.contains("<") & name.contains(">")),
        "go": (name != "_") & (package != ""),
        "cpp": ~name.startswith("__"),
    }
    rule = rules.get({"c++": "cpp"}.get(language, language), F.lit(True))
    return F.coalesce((F.trim(name) != "") & (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")) & rule, F.lit(False))


def resolve_calls(calls: DataFrame, functions: DataFrame, routers: DataFrame) -> DataFrame:
    """Calls with the function that they reach, and its router if any."""
    return calls.join(functions, calls.target_function_id == functions.function_id).join(routers, "function_id", "left")


def _call_places(calls: DataFrame) -> DataFrame:
    return calls.withColumn("call_file", callsite_file(F.col("callsite_id"))).withColumn("call_line", callsite_line(F.col("callsite_id")))


def containing(places: DataFrame, functions: DataFrame, file: str, line: str) -> DataFrame:
    """places joined with all functions that hold their line: a join on file and bin of lines, then the exact range."""
    spans = functions.withColumn("_bin", F.explode(F.sequence((F.col("start_line") / BIN).cast("int"), (F.col("end_line") / BIN).cast("int"))))
    binned = places.withColumn("_bin", (F.col(line) / BIN).cast("int"))
    on = (binned[file] == spans["file_path"]) & (binned["_bin"] == spans["_bin"]) & binned[line].between(spans["start_line"], spans["end_line"])
    return binned.join(spans, on).drop("_bin")


def containing_function(places: DataFrame, functions: DataFrame, key: str, file: str, line: str) -> DataFrame:
    """key and function_id of the smallest function around each place; of equals the latest start, then the least id."""
    found = containing(places.select(key, file, line), functions, file, line)
    best = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("start_line")).alias("start"), F.col("function_id").alias("id"))
    return found.groupBy(key).agg(F.min(best)["id"].alias("function_id"))


def last_function(places: DataFrame, functions: DataFrame, key: str, file: str, line: str, order: str = "ord") -> DataFrame:
    """key and function_id of the function around each place that was loaded last."""
    found = containing(places.select(key, file, line), functions, file, line)
    return found.groupBy(key).agg(F.max_by("function_id", order).alias("function_id"))


def callees(function: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """What the given functions call, by the lines they span; unresolved targets are named by their id."""
    placed = _call_places(calls).where("call_line is not null")
    caller = function.select(F.col("function_id").alias("caller_id"), F.col("file_path"), F.col("start_line"), F.col("end_line"))
    spans = caller.withColumnRenamed("caller_id", "function_id")
    inside = containing(placed, spans, "call_file", "call_line").select(F.col("function_id").alias("caller_id"), "callsite_id", "target_function_id", "call_line")
    known = functions.select(F.col("function_id").alias("target_function_id"), F.col("name"), F.col("file_path").alias("target_file"))
    out = inside.join(known, "target_function_id", "left")
    return out.withColumn("name", F.coalesce("name", F.regexp_extract("target_function_id", "^([^@]*)", 1)))


def callers(target_id: str, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions around the calls of a target, each once."""
    placed = _call_places(calls.where(F.col("target_function_id") == target_id)).where("call_line is not null")
    around = containing_function(placed, functions, "callsite_id", "call_file", "call_line")
    return functions.join(around.select("function_id").distinct(), "function_id", "left_semi")


def stats(functions: DataFrame, calls: DataFrame, routers: DataFrame, classes: DataFrame) -> DataFrame:
    """One row: the tables' sizes and the calls whose target is unknown."""
    orphans = calls.join(functions, calls.target_function_id == functions.function_id, "left_anti")
    tables = (("total_functions", functions), ("total_calls", calls), ("total_routers", routers), ("total_classes", classes), ("orphaned_calls", orphans))
    return reduce(lambda a, b: a.crossJoin(b), [df.agg(F.count("*").alias(name)) for name, df in tables])


def index_stats(functions: DataFrame) -> DataFrame:
    """One row: functions, distinct files, and distinct lines that lie in some function.

    Lines are counted as merged spans, not one by one.
    """
    w = Window.partitionBy("file_path").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = F.col("end_line") - F.greatest(F.col("start_line"), F.coalesce(reach + 1, F.col("start_line"))) + 1
    lines = functions.select("file_path", F.greatest(own, F.lit(0)).alias("own"))
    return lines.agg(F.count("*").alias("total_functions"), F.count_distinct("file_path").alias("unique_files"), F.coalesce(F.sum("own"), F.lit(0)).cast("long").alias("line_mappings"))


def find_identifier(functions: DataFrame, identifier: str) -> DataFrame:
    """The functions an identifier may mean, by the first way of reading it that finds any: strategy says which.

    1 the id itself, 2 the id of the bare name, 3 the bare name at the file and line, 4 in the file with the line
    inside, 5 in the file, 6 in a file that ends so, 7 anywhere.
    """
    one = functions.sparkSession.range(1).select(F.lit(identifier).alias("i"))
    clean = sanitize_identifier(F.col("i"))
    asked = one.select("i", clean.alias("c"), F.regexp_extract(clean, "^([^@]*)", 1).alias("n"), F.regexp_extract(clean, "@([^:]*)", 1).alias("f"), F.regexp_extract(clean, r":(\d+)$", 1).try_cast("int").alias("l"))
    joined = functions.crossJoin(F.broadcast(asked))  # one row
    name, file = F.col("name") == F.col("n"), F.col("file_path") == F.col("f")
    ways = (
        F.col("function_id") == F.col("i"), F.col("function_id") == F.col("c"), name & file & (F.col("start_line") == F.col("l")),
        name & file & F.col("l").between(F.col("start_line"), F.col("end_line")), name & file, name & (F.col("f") != "") & F.endswith("file_path", F.col("f")), name,
    )
    strategy = F.coalesce(*[F.when(way, F.lit(k)) for k, way in enumerate(ways, 1)])
    found = joined.withColumn("strategy", strategy).where("strategy is not null")
    best = found.agg(F.min("strategy").alias("_best"))
    return found.join(F.broadcast(best), F.col("strategy") == F.col("_best")).select(*functions.columns, "strategy").orderBy("file_path", "start_line", "function_id")


def of_services(tables: dict[str, DataFrame]) -> DataFrame:
    """The services' tables as one, with a service column; file paths and ids get the service's prefix."""

    def tagged(service: str, df: DataFrame) -> DataFrame:
        prefix = F.lit(f"services/{service}/")
        df = df.withColumn("service", F.lit(service))
        if "file_path" in df.columns:
            df = df.withColumn("file_path", F.when(F.startswith("file_path", prefix), F.col("file_path")).otherwise(F.concat(prefix, "file_path")))
        return df

    return reduce(DataFrame.unionByName, [tagged(s, df) for s, df in tables.items()])


def route_identifier(functions: DataFrame, identifier: Column) -> Column:
    """Whether a row's service may answer for an identifier: the one in its path, or any."""
    service = F.regexp_extract(identifier, "services/([^/]+)/", 1)
    return (service == "") | (F.col("service") == service)


def library_lookup(names: DataFrame, library: DataFrame) -> DataFrame:
    """names (fqn) with the library text of that name, else of the first entry, by ord, that ends with `.name`.

    library has fqn, text, ord; entries that begin with _ don't count. An entry is listed under its own name and all that
    follow one of its dots, so names are looked up and not compared.
    """
    library = library.where(~F.startswith("fqn", F.lit("_"))).select(F.col("fqn").alias("full"), "text", "ord")
    parts = F.split("full", r"\.")
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    listed = library.withColumn("fqn", F.explode(cut)).join(names.select("fqn").distinct(), "fqn", "left_semi")
    best = listed.groupBy("fqn").agg(F.min_by("text", F.struct(F.col("full") != F.col("fqn"), F.col("ord"))).alias("text"))
    return names.join(best, "fqn", "left")


def matching_calls(calls: DataFrame, patterns: list[str], name: str = "callee") -> DataFrame:
    """Calls whose lower-case callee matches any pattern in whole."""
    good = [p for p in patterns if valid_pattern(p)]
    return calls.where(F.lower(name).rlike("^(?:" + "|".join(f"(?:{p})" for p in good) + ")$")) if good else calls.limit(0)


def matching_operations(calls: DataFrame, operations: DataFrame) -> DataFrame:
    """Calls that some operation describes: each condition that it states - name, file or its base name, line - holds.

    The operations that state a line meet calls by it, the others by name; an operation without any holds for none.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    call, op = calls.alias("c"), operations.alias("o")
    either = lambda a, b: F.col(f"o.{a}").isNull() | (F.col(f"o.{a}") == F.col(f"c.{b}"))
    file = F.col("o.file").isNull() | (F.col("o.file") == F.col("c.file")) | (base(F.col("o.file")) == base(F.col("c.file")))
    by_line = call.join(op, (F.col("o.line") == F.col("c.line")) & either("name", "callee") & file, "left_semi")
    by_name = call.join(op, (F.col("o.name") == F.col("c.callee")) & F.col("o.line").isNull() & file, "left_semi")
    return by_line.unionByName(by_name).distinct()


def class_rows(identifiers: DataFrame) -> DataFrame:
    """identifiers that name a class by its file."""
    return identifiers.where(is_class_identifier(F.col("identifier")))
