"""Source text by lines: statements, windows, bodies, marks and ends of functions.

lines: file, line_no (from 1), text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.functions import fixed

#: Lines to a bin of the range joins.
BIN = 64


def explode_lines(files: DataFrame, text: str = "text", file: str = "file") -> DataFrame:
    """A row per line of each file; a line break at the end opens no further line, an empty text has none."""
    body = F.regexp_replace(F.col(text), "\r\n?", "\n")
    parts = F.split(F.regexp_replace(body, r"\n\z", ""), "\n", -1)
    out = files.where(F.length(text) > 0).select(file, F.posexplode(parts).alias("_p", "text"))
    return out.select(F.col(file).alias("file"), (F.col("_p") + 1).alias("line_no"), "text")


def statement_at(places: DataFrame, lines: DataFrame) -> DataFrame:
    """places (file, line) with statement: the trimmed line, or a note why there is none."""
    files = lines.groupBy(F.col("file").alias("_f")).agg(F.max("line_no").alias("_last"))
    found = places.join(files, F.col("file") == F.col("_f"), "left").join(lines.select(F.col("file").alias("_g"), "line_no", "text"), (F.col("file") == F.col("_g")) & (F.col("line") == F.col("line_no")), "left")
    text = F.trim(F.col("text"))
    note = (
        F.when(F.col("_f").isNull(), F.concat(F.lit("// File not found: "), "file"))
        .when(F.col("text").isNull(), F.concat(F.lit("// Line "), F.col("line").cast("string"), F.lit(" out of range")))
        .when(text == "", F.lit("// Empty line"))
        .otherwise(text)
    )
    return found.withColumn("statement", note).drop("_f", "_g", "_last", "line_no", "text")


def tainted_variable(line: Column, start: Column, end: Column) -> Column:
    """The trimmed columns start to end, end excluded, of a line; columns begin at 1."""
    return F.trim(F.substring(line, start, F.greatest(end - start, F.lit(0))))


def in_spans(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """spans (_file, start_line, end_line, ...) joined with the lines in them, on file and a bin of lines."""
    binned = spans.withColumn("_bin", F.explode(F.sequence((F.greatest("start_line", F.lit(0)) / BIN).cast("int"), (F.greatest("start_line", "end_line", F.lit(0)) / BIN).cast("int"))))
    rows = lines.withColumn("_at", (F.col("line_no") / BIN).cast("int"))
    on = (F.col("_file") == F.col("file")) & (F.col("_bin") == F.col("_at")) & F.col("line_no").between(F.col("start_line"), F.col("end_line"))
    return binned.join(rows, on).drop("_bin", "_at")


def window_of(places: DataFrame, lines: DataFrame, context: int = fixed.CONTEXT_LINES) -> DataFrame:
    """Lines up to `context` around each place: key, file, line_no, text."""
    p = places.select("key", F.col("file").alias("_file"), (F.col("line") - context).alias("start_line"), (F.col("line") + context).alias("end_line"))
    return in_spans(p, lines).select("key", "file", "line_no", "text")


def numbered_text(rows: DataFrame, key: list[str], separator: str = ":") -> DataFrame:
    """source: the rows' lines in order, each as `number<separator>text`."""
    entry = F.struct("line_no", F.concat(F.col("line_no").cast("string"), F.lit(separator), "text").alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), "\n")
    return rows.groupBy(*key).agg(joined.alias("source"))


def bodies(spans: DataFrame, lines: DataFrame, separator: str = ":") -> DataFrame:
    """spans (key, file, start_line, end_line) with their numbered source; null where none of their lines is there."""
    inside = in_spans(spans.withColumnRenamed("file", "_file"), lines).select("key", "line_no", "text")
    return spans.join(numbered_text(inside, ["key"], separator), "key", "left")


def marked_body(spans: DataFrame, lines: DataFrame, checks: DataFrame, width: int = 0) -> DataFrame:
    """As bodies, `number: text`, with a mark at the end of the lines in checks (file, line)."""
    inside = in_spans(spans.withColumnRenamed("file", "_file"), lines)
    marks = checks.select(F.col("file").alias("_c"), F.col("line").alias("_l")).distinct()
    inside = inside.join(marks, (F.col("file") == F.col("_c")) & (F.col("line_no") == F.col("_l")), "left")
    text = F.when(F.col("_l").isNotNull(), F.concat_ws(" ", "text", F.lit(fixed.AUTH_MARK))).otherwise(F.col("text"))
    number = F.lpad(F.col("line_no").cast("string"), width, " ") if width else F.col("line_no").cast("string")
    entry = F.struct("line_no", F.concat(number, F.lit(": "), text).alias("t"))
    joined = inside.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), "\n").alias("source"))
    return spans.join(joined, "key", "left")


def class_files(identifiers: DataFrame, files: DataFrame) -> DataFrame:
    """identifiers (`Class@path:line`) with found and text: the file at that path, else the first that has its base name.

    files has file and text.
    """
    asked = identifiers.withColumn("_path", F.regexp_extract("identifier", "^[^@]*@([^:]*)", 1))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    near = asked.select("_path").distinct().join(files, base(F.col("_path")) == base(F.col("file")))
    order = F.struct(F.col("file") != F.col("_path"), F.col("file"))
    best = near.groupBy("_path").agg(F.min_by(F.struct(F.col("file").alias("found"), "text"), order).alias("_f"))
    return asked.join(best, "_path", "left").select(*identifiers.columns, "_f.found", "_f.text")


def field_text(lines: DataFrame, file: str, field: str, limit: int = fixed.FIELD_LINES) -> DataFrame:
    """One row, or none: the lines from the first that holds the field as a word outside a comment, to the first `;`."""
    own = lines.where(F.col("file") == file)
    word = rf"^(?!\s*//).*\b{re.escape(field)}\b"
    start = own.where(F.col("text").rlike(word)).agg(F.min("line_no").alias("_start")).where("_start is not null")
    near = own.join(F.broadcast(start), F.col("line_no").between(F.col("_start"), F.col("_start") + limit - 1))
    stop = F.min(F.when(F.contains("text", F.lit(";")), F.col("line_no"))).over(Window.partitionBy("file"))
    kept = near.withColumn("_stop", F.coalesce(stop, F.col("_start") + limit - 1)).where("line_no <= _stop")
    entry = F.struct("line_no", "text")
    return kept.groupBy("file").agg(F.min("_start").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), "\n").alias("source"))


def description(text: Column, limit: int = fixed.DESCRIPTION_CHARS) -> Column:
    """The text's beginning, cut at a blank within the limit."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_replace(F.left(flat, F.lit(limit)), r"\s\S*$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def _python_end(lines: list[str], start: int) -> int:
    """The last line, from 1, of the block whose header is at start: what is indented deeper, blank ends left out."""
    indent = lambda s: len(s) - len(s.lstrip())
    base, at = indent(lines[start - 1]), start
    while at < len(lines) and not lines[at - 1].rstrip().endswith(":"):
        at += 1
    end = at
    for k in range(at, len(lines)):
        if not lines[k].strip():
            continue
        if indent(lines[k]) <= base:
            break
        end = k + 1
    return end


#: What can hide a brace: comments, texts and characters; then braces themselves.
_BRACES = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`|[{}\n]""", re.S)


def _brace_end(lines: list[str], start: int) -> int:
    """The line, from 1, of the brace that closes the first one opened at or after start; -1 if none does."""
    depth, line = 0, start
    for m in _BRACES.finditer("\n".join(lines[start - 1 :])):
        token = m[0]
        line += token.count("\n")
        depth += (token == "{") - (token == "}")
        if token == "}" and depth <= 0:
            return line
    return -1


def _end_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ends = []
        for file, text, start in zip(batch.file, batch.text, batch.start_line, strict=True):
            lines = (text or "").split("\n")
            there = isinstance(file, str) and 0 < start <= len(lines)
            ends.append((_python_end if file.endswith(".py") else _brace_end)(lines, int(start)) if there else -1)
        yield batch.assign(end_line=ends)[["file", "start_line", "end_line"]]


def function_ends(starts: DataFrame) -> DataFrame:
    """starts (file, text, start_line) with end_line: by indentation for Python, by braces else; -1 if not found."""
    return starts.select("file", "text", "start_line").mapInPandas(_end_lines, "file string, start_line int, end_line int")
