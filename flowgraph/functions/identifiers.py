"""Identifiers `name@file:line`, locations `file:line` and the strings around them, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowgraph.functions.fixed import CLASS_WORDS


def _int(c: Column) -> Column:
    return c.try_cast("int")


def present(pattern: str, c: Column, group: int = 1) -> Column:
    """The group of the first match, or null where it is empty or there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def sanitize_identifier(c: Column) -> Column:
    """The bare name, with its location: what follows the last of the first separator found of ->, :: and dot."""
    name, place = F.regexp_extract(c, "(?s)^([^@]*)", 1), present("(?s)^[^@]*@(.*)$", c)
    last = lambda sep: F.element_at(F.split(name, sep), -1)
    bare = F.when(F.contains(name, F.lit("->")), last("->")).when(F.contains(name, F.lit("::")), last("::")).when(F.contains(name, F.lit(".")), last(r"\.")).otherwise(name)
    bare = F.trim(F.regexp_replace(bare, r"\(\)$", ""))
    return F.when(place.isNotNull(), F.concat_ws("@", bare, place)).otherwise(bare)


def is_class_identifier(c: Column) -> Column:
    """Whether the identifier is `Name@File.java` with the file's name, or a name with a data-class word."""
    name, file = F.regexp_extract(c, "^([^@]*)@", 1), F.regexp_extract(c, "^[^@]*@([^:]*)", 1)
    stem = F.regexp_extract(file, r"([^/]*)\.java$", 1)
    word = reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in CLASS_WORDS])
    return F.contains(c, F.lit("@")) & F.endswith(file, F.lit(".java")) & ((name == stem) | word)


def parse_location(c: Column) -> Column:
    """Struct of file, start_line, end_line, start_column, end_column from file:line:col or file:line:col:line:col.

    Only the first line of the text counts; anything else, three colons included, is null.
    """
    line = F.trim(F.element_at(F.split(c, "\n"), 1))
    colons = F.length(line) - F.length(F.replace(line, F.lit(":"), F.lit("")))
    short, long = r"^(.*):\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*$", r"^(.*):\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*$"

    def made(pattern: str, groups: tuple[int, ...]) -> Column:
        parts = [_int(F.regexp_extract(line, pattern, g)) for g in groups]
        file = F.trim(F.regexp_extract(line, pattern, 1), F.lit('"'))
        names = ("start_line", "end_line", "start_column", "end_column")
        return F.when(line.rlike(pattern), F.struct(file.alias("file"), *[p.alias(n) for p, n in zip(parts, names, strict=True)]))

    return F.when(colons == 2, made(short, (2, 2, 3, 3))).when(colons >= 4, made(long, (2, 4, 3, 5)))


def callsite_file(c: Column) -> Column:
    return F.regexp_extract(c, "@(.*):([0-9]+)$", 1)


def callsite_line(c: Column) -> Column:
    return F.regexp_extract(c, "@(.*):([0-9]+)$", 2).try_cast("bigint")


def clean_uri(c: Column) -> Column:
    """file: URIs as paths, their percent codes resolved; a plus sign is no blank."""
    path = F.regexp_replace(c, "^file:/+", "/")
    return F.when(c.rlike("^file:/+"), F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(c)


def norm_path(c: Column) -> Column:
    path = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)[?#].*$", ""))
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))


def segments(path: Column) -> Column:
    """Non-empty parts of a normalised path."""
    return F.filter(F.split(norm_path(path), "/"), lambda s: s != "")


def call_name(c: Column) -> Column:
    """The name before the first parenthesis; null for a bare name."""
    return present(r"([A-Za-z_]\w*)\s*\(", c)


def sanitize_app_name(c: Column) -> Column:
    return F.translate(c, "-_.", "")


def loose_term(c: Column) -> Column:
    return F.trim(F.trim(F.lower(c)), F.lit("\"'"))


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([.^$*+?{}\[\]\\|()])", r"\\$1")


def library_name(c: Column) -> Column:
    """The full name that a request means in a library: a dotted one itself, one in an archive by its class's path.

    A bare name with a source path is the application's own and gives null.
    """
    name, path = F.regexp_extract(c, "^([^@]*)@", 1), F.regexp_replace(F.regexp_extract(c, "^[^@]*@(.*)$", 1), ":[^:]*$", "")
    inside = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"\.jar!/*(.*)$", 1), r"\.class$", ""), "/", ".")
    placed = F.when(F.contains(path, F.lit(".jar!")), F.concat_ws(".", inside, name)).when(F.contains(name, F.lit(".")), name)
    return F.when(F.contains(c, F.lit("@")), placed).otherwise(F.nullif(c, F.lit("")))


def looks_like_class_method(c: Column) -> Column:
    """`...Class.method`: a capital before the last dot and a small letter after it, letters, digits and _ only."""
    return c.rlike(r"(?U)(^|\.)\p{Lu}[\p{L}\p{N}]*\.\p{Ll}[\p{L}\p{N}_]*$")


def first_tag(c: Column, tag: str, default: str) -> Column:
    """The trimmed text of the first <tag>, in any case and over lines, or the default."""
    pattern = f"(?is)<{tag}>(.*?)</{tag}>"
    return F.when(c.rlike(pattern), F.regexp_replace(F.regexp_extract(c, pattern, 1), r"^\s+|\s+$", "")).otherwise(F.lit(default))


def all_tags(c: Column, tag: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))


def requests(c: Column) -> Column:
    """Identifiers asked for in <request> tags: split at ; or line ends, `name@place` or `Class.method` kept."""
    parts = F.flatten(F.transform(all_tags(c, "request"), lambda x: F.split(x, "[;\n]")))
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: F.contains(x, F.lit("@")) | looks_like_class_method(x))


def tolerant_json(c: Column) -> Column:
    """JSON text: the whole text, else its first span in braces or brackets."""
    span = F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.try_parse_json(c).isNotNull(), c).when(F.try_parse_json(span).isNotNull(), span)
