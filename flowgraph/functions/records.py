"""Text records of extraction queries and hints in source text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowgraph.functions import fixed
from flowgraph.functions.identifiers import present


def undouble_braces(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def is_channel_like(c: Column) -> Column:
    """Whether a constant may name a channel: not blank, no common constant, no body, no free text."""
    c = F.trim(c)
    return (c != "") & ~F.lower(c).isin(*fixed.NOT_CHANNELS) & ~c.rlike(r"^\{|\n") & ~(F.contains(c, F.lit(" ")) & ~F.contains(c, F.lit("://")))


def _file_line(c: Column) -> tuple[Column, Column]:
    return F.trim(F.regexp_extract(c, "(?s)^(.*):[^:]*$", 1)), F.coalesce(present(r":\s*(\d+)\s*$", c).try_cast("int"), F.lit(0))


def parse_inter(message: Column) -> Column:
    """Struct of an `INTER|protocol|verb|channel|file:line|name@file:line` record, or null."""
    parts = F.split(undouble_braces(message), r"\|")
    at = lambda k: F.get(parts, F.lit(k))
    first = lambda c: F.trim(F.element_at(F.split(c, "\n"), 1))
    channel = first(at(3))
    file, line = _file_line(at(4))
    record = F.struct(
        F.coalesce(F.nullif(F.lower(F.trim(at(1))), F.lit("")), F.lit("http")).alias("protocol"), F.nullif(F.upper(F.trim(at(2))), F.lit("")).alias("method"),
        channel.alias("channel"), file.alias("file"), line.alias("line"), F.trim(at(4)).alias("location"), first(at(5)).alias("enclosing_function"),
    )
    return F.when(F.startswith(message, F.lit("INTER|")) & (F.size(parts) >= 6) & is_channel_like(channel), record)


def parse_endpoint(message: Column) -> Column:
    """Struct of an `ENDPOINT|protocol|verb|route|name@file:line` record, or null."""
    parts = F.split(undouble_braces(message), r"\|")
    at = lambda k: F.get(parts, F.lit(k))
    file, line = _file_line(F.coalesce(present("(?s)^[^@]*@(.*)$", at(4)), F.lit("")))
    record = F.struct(
        F.coalesce(F.nullif(F.lower(F.trim(at(1))), F.lit("")), F.lit("http")).alias("protocol"), F.nullif(F.upper(F.trim(at(2))), F.lit("")).alias("method"),
        F.coalesce(F.nullif(F.trim(at(3)), F.lit("")), F.lit("/")).alias("route"), F.trim(at(4)).alias("handler"),
        F.trim(F.element_at(F.split(at(4), "@"), 1)).alias("handler_name"), file.alias("file"), line.alias("line"),
    )
    return F.when(F.startswith(message, F.lit("ENDPOINT|")) & (F.size(parts) >= 5), record)


def _first_hint(c: Column, hints: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(c.rlike(pattern), F.lit(name)) for name, pattern in hints])


def infer_verb(c: Column) -> Column:
    return _first_hint(c, fixed.VERB_HINTS)


def infer_protocol(c: Column) -> Column:
    return F.coalesce(_first_hint(c, fixed.PROTOCOL_HINTS), F.lit("http"))


def outbound_channels(statement: Column) -> Column:
    """Distinct channels named in a statement: URLs, else quoted paths, else a published topic."""
    found = lambda pattern, group: F.regexp_extract_all(statement, F.lit(pattern), F.lit(group))
    urls, paths, named = found(fixed.URL, 0), found(fixed.QUOTED_PATH, 1), found(fixed.NAMED_TOPIC, 1)
    tokens = F.filter(found(fixed.QUOTED_TOKEN, 1), lambda t: t.rlike("[._-]"))
    publishes = infer_protocol(statement).isin(*fixed.MQ_KINDS) | statement.rlike(fixed.PUBLISH)
    topic = F.slice(F.when(F.size(named) > 0, named).otherwise(tokens), 1, 1)
    return F.array_distinct(F.when(F.size(urls) > 0, urls).when(F.size(paths) > 0, paths).when(publishes, topic).otherwise(F.array().cast("array<string>")))


def hrefs(html: Column) -> Column:
    """Targets of links in a page, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit("""href=["']([^"']+)["']"""), F.lit(1)))


def sink_category(name: Column, category: str) -> Column:
    """Whether a callee's name falls under a category of privileged operations."""
    low = F.lower(name)
    hit = low.rlike("|".join(f"({p})" for p in fixed.SINK_NAMES[category]))
    return hit & ~low.rlike(fixed.QUERY_VERBS) if category in fixed.QUERY_EXEMPT else hit


def sink_categories(name: Column) -> Column:
    """All categories of a callee's name, joined by commas."""
    return F.concat_ws(",", *[F.when(sink_category(name, c), F.lit(c)) for c in fixed.SINK_NAMES])


def type_category(owner: Column, method: Column, category: str) -> Column:
    """Whether a call is one of a category's on a library type; owner is the declaring type in full, a constructor's method is <init>."""
    named = lambda m: F.startswith(method, F.lit(m[:-1])) if m.endswith("%") else method == m
    ways = [(owner == t) & reduce(lambda a, b: a | b, map(named, methods)) for t, methods in fixed.TYPE_SINKS[category]]
    return F.coalesce(reduce(lambda a, b: a | b, ways), F.lit(False))


def type_categories(owner: Column, method: Column) -> Column:
    """All categories of a call on a library type, joined by commas."""
    return F.concat_ws(",", *[F.when(type_category(owner, method, c), F.lit(c)) for c in fixed.TYPE_SINKS])


def argument_category(method: Column, argument: Column) -> Column:
    """`command` or `database` for a plain verb whose argument's text is a command or changes a schema; else null."""
    low, said = F.lower(method), F.lower(F.coalesce(argument, F.lit("")))
    return F.when(low.rlike(fixed.COMMAND_NAMES) & said.rlike(rf"\b{fixed.COMMAND_WORDS}\b"), F.lit("command")).when(low.rlike(fixed.COMMAND_NAMES) & said.rlike(fixed.DDL_WORDS), F.lit("database"))


def annotated_sink(annotation: Column) -> Column:
    """Whether an annotation, its type in full, marks a privileged method."""
    return annotation.isin(*fixed.SINK_ANNOTATIONS) | (F.lower(F.element_at(F.split(annotation, r"\."), -1)) == fixed.PRIVILEGED)


def user_sink(owner: Column, method: Column) -> Column:
    """Whether a call outside the standard packages has a privileged name."""
    return ~F.coalesce(owner, F.lit("")).rlike(fixed.STANDARD_PACKAGES) & (sink_categories(method) != "")


def enhanced_sink(owner: Column, method: Column, annotation: Column) -> Column:
    """Whether a call is privileged by its library type, its name or its annotation."""
    return (type_categories(owner, method) != "") | user_sink(owner, method) | F.coalesce(annotated_sink(annotation), F.lit(False))


def is_auth_method(name: Column) -> Column:
    return name.rlike(fixed.AUTH_METHOD) & ~name.rlike(fixed.NO_AUTH_METHOD)


def is_security_framework(owner: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(owner, F.lit(p)) for p in fixed.SECURITY_PACKAGES])


def _auth_type(kind: Column) -> Column:
    return F.element_at(F.split(kind, r"\."), -1).isin("boolean", "Boolean") | is_security_framework(kind) | F.element_at(F.split(kind, r"\."), -1).rlike(fixed.AUTH_TYPE)


def auth_pattern(kind: Column, owner: Column, name: Column) -> Column:
    """Why what a condition reads tells of access control: a call's method, a variable or a field with its type; else null.

    kind is call, variable or field; owner is a call's declaring type, or the type of the variable or field.
    """
    return (
        F.when((kind == "call") & is_auth_method(name), F.lit("auth_method_call")).when((kind == "call") & is_security_framework(owner), F.lit("framework_security_call"))
        .when((kind == "variable") & name.rlike(fixed.AUTH_VARIABLE) & _auth_type(owner), F.lit("auth_variable_check")).when((kind == "field") & name.rlike(fixed.AUTH_FIELD) & _auth_type(owner), F.lit("auth_field_check"))
    )


def callsite_record(message: Column) -> Column:
    """Struct of callsite_id and target from `file:line:col -> name@file:line`; exactly one arrow, else null.

    The id joins the target's name and the call's place, so calls of one name on a line share it.
    """
    parts = F.split(message, " -> ")
    call, target = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    pattern = r"^(.*):(\d+)(?::(\d+))$"
    place = F.concat_ws(":", F.regexp_extract(call, pattern, 1), F.regexp_extract(call, pattern, 2))
    name = F.regexp_extract(target, "^(.*)@", 1)
    good = (F.size(parts) == 2) & call.rlike(pattern) & target.rlike(r"^.+@.+:\d+$")
    return F.when(good, F.struct(F.concat_ws("@", name, place).alias("callsite_id"), target.alias("target_function_id")))


def router_record(message: Column) -> Column:
    """Struct of function_id and router_definition_id (file:start:end) from `function -> file:start:end`."""
    parts = F.split(message, " -> ")
    good = (F.size(parts) == 2) & F.trim(F.get(parts, F.lit(1))).rlike(r"^.+:\d+:\d+$")
    return F.when(good, F.struct(F.trim(F.get(parts, F.lit(0))).alias("function_id"), F.trim(F.get(parts, F.lit(1))).alias("router_definition_id")))
