"""The search primitives over an application's tables.

Each answers with a DataFrame; no service means the first one, and a table that isn't there an empty answer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgraph.functions import fixed
from flowgraph.functions.identifiers import library_name
from flowgraph.operators import callgraph, flows, lines
from flowgraph.operators.rows import keep_first, union_all
from flowgraph.plans.global_flows import global_flows

#: Names of syntax operations and what else they are called.
OPERATIONS = ("call", "method", "field_access", "assignment", "return", "string_literal", "conditional", "catch", "parameter", "new")
ALIASES = {
    "invocation": "call", "callsite": "call", "function": "method", "callable": "method", "attribute": "field_access", "field": "field_access",
    "assign": "assignment", "if": "conditional", "branch": "conditional", "except": "catch", "try": "catch", "param": "parameter",
    "string": "string_literal", "str": "string_literal", "constructor": "new",
}


class Unsupported(ValueError):
    """An operation that needs a syntax tree, which the tables don't hold."""


def term_pattern(term: str) -> str:
    """A pattern for a term: anything for a blank one, itself if it is one, else the term in any case."""
    if not term.strip():
        return ".*"
    return term if re.search(r"[\\^$*+?()\[\]{}|]", term) else f"(?i).*{re.escape(term)}.*"


def operation(c: Column) -> Column:
    """The operation that a name, in any case, stands for; null for an unknown one."""
    low = F.lower(F.trim(c))
    found = F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[low], low)
    return F.when(found.isin(*OPERATIONS), found)


def normalize_operation(name: str) -> str:
    low = name.strip().lower()
    found = ALIASES.get(low, low)
    if found not in OPERATIONS:
        raise Unsupported(name)
    return found


@dataclass
class Application:
    """An application's tables, each with a service column: functions, classes, calls, routers, flows, outbound, endpoints, lines, services."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def _table(self, name: str, service: str | None = None) -> DataFrame | None:
        df = self.tables.get(name)
        if df is None or "service" not in df.columns:
            return df
        chosen = service or self._first()
        return df if chosen is None else df.where(F.col("service") == chosen)

    def _first(self) -> str | None:
        services = self.tables.get("services")
        row = services.orderBy("ord").select("service").first() if services is not None else None
        return row.service if row else None

    @property
    def _spark(self):
        return next(iter(self.tables.values())).sparkSession

    def _empty(self, shape: str) -> DataFrame:
        return self._spark.createDataFrame([], shape)

    def qname(self, name: str, kinds: tuple[str, ...] = ("function", "class"), service: str | None = None, limit: int = fixed.NAME_LIMIT) -> DataFrame:
        """Functions, then classes, whose name holds the pattern, `limit` of each: kind, id, name, file, line, end_line."""
        found = []
        for kind, table, key in (("function", "functions", "function_id"), ("class", "classes", "class_id")):
            df = self._table(table, service)
            if kind in kinds and df is not None:
                hit = callgraph.search_names(df, name, limit, key=key)
                found.append(hit.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "name", F.col("file_path").alias("file"), F.col("start_line").alias("line"), "end_line"))
        return union_all(*found).drop("branch") if found else self._empty("kind string, id string, name string, file string, line int, end_line int")

    def qast(self, operation: str, service: str | None = None, limit: int = fixed.AST_LIMIT) -> DataFrame:
        """All methods, in file order, or all calls, by id; other operations need a syntax tree."""
        kind = normalize_operation(operation)
        if kind == "method":
            return self._table("functions", service).orderBy("file_path", "start_line", "function_id").limit(min(limit, fixed.FUNCTION_LIMIT))
        if kind == "call":
            return self._table("calls", service).orderBy("callsite_id").limit(limit)
        raise Unsupported(operation)

    def qcg(self, function: str, direction: str = "callees", service: str | None = None) -> DataFrame:
        """Callees or callers of a function, named by its id or, the first in file order, by its exact name."""
        functions, calls = self._table("functions", service), self._table("calls", service)
        chosen = callgraph.by_id(functions, function) if "@" in function else callgraph.by_name(functions, function).limit(1)
        if direction == "callees":
            return callgraph.callees(chosen, calls, functions)
        row = chosen.select("function_id").first()
        return callgraph.callers(row.function_id, calls, functions) if row else functions.limit(0)

    def qflow(self, source: str = "", sink: str = "", service: str | None = None) -> DataFrame:
        """Flows whose first step mentions the source and whose last one the sink."""
        return flows.approximate_flows(self._table("flows", service), source, sink)

    def qsource(self, service: str | None = None) -> DataFrame:
        """Distinct places where taint begins, then endpoints."""
        sources = self._table("flows", service).select(F.lit("source").alias("kind"), F.col("source_location").alias("location"), "ord")
        sources = keep_first(sources, ["location"], "ord").drop("ord")
        eps = self._table("endpoints", service)
        return union_all(sources, eps.select(F.lit("endpoint").alias("kind"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("location"), "route")) if eps is not None else sources

    def qinter(self, service: str | None = None) -> DataFrame:
        return self._table("outbound", service)

    def qglobalflow(self) -> DataFrame:
        return global_flows(*(self.tables[t] for t in ("services", "flows", "outbound", "endpoints")))

    def get_location(self, rows: DataFrame) -> DataFrame:
        """rows with location: their own, else file and line, else their id."""
        has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        place = F.when(has("file").isNotNull() & has("line").isNotNull(), F.concat_ws(":", has("file"), has("line").cast("string")))
        return rows.withColumn("location", F.coalesce(F.nullif(has("location"), F.lit("")), place, has("id")))

    def get_source(self, identifier: str, service: str | None = None, context: int = fixed.CONTEXT_LINES) -> DataFrame:
        """The numbered source of what an identifier means, else the lines around its place."""
        text, functions = self._table("lines", service), self._table("functions", service)
        found = callgraph.find_identifier(functions, identifier).limit(1)
        spans = found.select(F.col("function_id").alias("key"), F.col("file_path").alias("file"), "start_line", "end_line")
        if not spans.isEmpty():
            return lines.bodies(spans, text).select("key", "source")
        at = re.search(r"([^@]*):(\d+)$", identifier)
        places = self._spark.createDataFrame([(identifier, at[1], int(at[2]))] if at else [], "key string, file string, line int")
        return lines.numbered_text(lines.window_of(places, text, context), ["key"])

    def resolve_request(self, request: str, service: str | None = None) -> DataFrame:
        """The source that a request means, else what the library notes say of it; at most one row, key and source."""
        found = self.get_source(request, service, 0) if "@" in request else self._by_bare_name(request, service)
        notes = self.tables.get("library")
        if notes is None or not found.isEmpty():
            return found
        asked = self._spark.createDataFrame([(request,)], "key string").withColumn("fqn", library_name(F.col("key"))).where("fqn is not null")
        return callgraph.library_lookup(asked, notes).where("text is not null").select("key", F.concat(F.lit("[LIBRARY] "), "text").alias("source"))

    def _by_bare_name(self, request: str, service: str | None) -> DataFrame:
        name, owner = request.rpartition(".")[2], request.rpartition(".")[0].rpartition(".")[2]
        own = self._table("functions", service).where((F.col("name") == name) & (F.coalesce("class_name", F.lit("")) == owner))
        spans = own.orderBy("file_path", "start_line").limit(1).select(F.col("function_id").alias("key"), F.col("file_path").alias("file"), "start_line", "end_line")
        return lines.bodies(spans, self._table("lines", service)).select("key", "source")

    def get_type(self, function_id: str, service: str | None = None) -> DataFrame:
        """One row: the function's signature, or `unknown`."""
        found = self._table("functions", service).where(F.col("function_id") == function_id)
        return found.agg(F.coalesce(F.nullif(F.first("signature"), F.lit("")), F.lit("unknown")).alias("type"))


def clip(df: DataFrame, items: int = fixed.CLIP_ITEMS, chars: int = fixed.CLIP_CHARS) -> DataFrame:
    """The first rows as JSON texts, each cut to a length; for showing, not for work."""
    return df.limit(items).select(F.left(F.to_json(F.struct(*df.columns)), F.lit(chars)).alias("value"))
