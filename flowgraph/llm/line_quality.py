"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised - lower case, runs of blanks as one blank, trimmed - and hashed. For each host (source) a line's
frequency is the number of documents that hold it. A line above both limits, MIN_DOCS documents and SHARE of the
host's documents, is removed from them; a document that loses more than LOSS of its words is depleted and rejected.
Documents that fail the base rules are rejected whatever their lines.

A line counts once for a document before anything is shuffled, and partial counts are combined on each side of the
shuffle, so a line or host that holds a third of all rows costs no more than a row per task. Only lines above the
limits meet the documents' lines again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgraph.llm.common import documents

MIN_DOCS = 20
SHARE = 0.01
LOSS = 0.5
MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BLANKS = ["\t", "\n", "\x0b", "\f", "\r", " "]
SYMBOLS = list("#*$%&|<>")
WORD = r"[^\x20\x09-\x0D]+"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def _without(text: Column, characters: list[str]) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeated(h: Column) -> tuple[Column, Column]:
    """Hashes of 3-word windows with their places in order; and, of that as _ordered, the places of those found twice or more."""
    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    column = F.col("_ordered")
    twice = F.filter(column, lambda x, j: F.coalesce(F.get(column, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(column, j + 1)["h"] == x["h"], F.lit(False)))
    return ordered, F.sort_array(F.transform(twice, lambda x: x["i"]))


def features(docs: DataFrame) -> DataFrame:
    """docs without text, with word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words (long) and base_failed."""
    keep = [c for c in docs.columns if c != "text"]
    t = F.coalesce(F.col("text"), F.lit(""))
    dense = _without(t, BLANKS)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\f\r", "    "))) > 0)
    out = docs.select(
        *keep, F.length(dense).alias("word_chars"), (F.length(dense) - F.length(_without(dense, SYMBOLS))).alias("n_symbols"),
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"), lines.alias("_lines"),
    )
    words, n = F.col("_words"), F.size("_words")
    windows = F.when(n < 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    out = out.select(*keep, "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), n.alias("n_words"), windows.alias("_h"))
    ordered, places = _repeated(F.col("_h"))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.withColumn("_ordered", F.when(some, ordered)).drop("_h").withColumn("_at", F.when(F.col("_ordered").isNotNull(), places)).drop("_ordered")
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("_at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(*keep, *[F.col(c).cast("long").alias(c) for c in COUNTS]).withColumn("base_failed", failed)


def _lines(docs: DataFrame) -> Column:
    """The normalised lines that have a word."""
    t = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.trim(F.regexp_replace(x, BLANK_RUN, " "))), lambda x: x != "")


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(_host, _line) of the lines above both limits in docs (text, _host); each row of docs counts as a document."""
    once = docs.select("_host", F.explode(F.array_distinct(F.transform(_lines(docs), lambda x: F.xxhash64(x)))).alias("_line"))
    lines = once.groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") > min_docs)
    hosts = docs.groupBy("_host").agg(F.count("*").alias("_docs"))
    return lines.join(hosts, "_host").where(F.col("_n") > share * F.col("_docs")).select("_host", "_line")


def score(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, loss: float = LOSS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and n_lost_words, the words of removed lines, for each row of docs.

    docs has doc_id, text, source; other columns are ignored. A null text counts as empty and fails the base rules; a
    null source is a host of its own. Rows that are equal in all three get equal results, each its own row; they and
    rows that repeat an id each count as a document in line frequencies. An empty table gives no rows.
    """
    key = [F.col("doc_id").alias("_id"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_host"), F.xxhash64("text").alias("_hash")]
    keyed = docs.select("doc_id", "text", *key)
    bad = frequent_lines(keyed, min_docs, share)
    all_lines = keyed.select("_id", "_host", "_hash", F.explode(F.transform(_lines(keyed), lambda x: F.struct(F.xxhash64(x).alias("_line"), F.size(F.split(x, " ")).alias("_w")))).alias("_l"))
    lost = all_lines.select("_id", "_host", "_hash", "_l.*").join(bad, ["_host", "_line"])
    lost = lost.groupBy("_id", "_host", "_hash").agg(F.sum("_w").alias("_lost"))
    base = features(keyed)
    to = lost.select(F.col("_id").alias("_i"), F.col("_host").alias("_o"), F.col("_hash").alias("_x"), "_lost")
    found = base.join(to, F.expr("_id <=> _i and _host = _o and _hash <=> _x"), "left")
    #: Wholly equal rows have put their lines together; each has lost its part.
    rows = F.count("*").over(Window.partitionBy("_id", "_host", "_hash"))
    found = found.withColumn("n_lost_words", (F.coalesce("_lost", F.lit(0)) / rows).cast("long"))
    kept = ~F.col("base_failed") & (F.col("n_lost_words") <= loss * F.col("n_words"))
    return found.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "n_lost_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir, "doc_id", "text", "source"))


#: The same over the whole table, with the lines themselves in place of their hashes.
ORACLE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, coalesce('s' || source, '') as host from documents),
w as (select doc_id, t, host, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d),
l as (select doc_id, host, unnest(string_split(t, chr(10))) as line from d),
full_lines as (select * from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dups as (select doc_id, count(*) - count(distinct line) as n from full_lines group by doc_id),
spots as (select doc_id, ws, unnest(range(len(ws) - 2)) as i from w where len(ws) >= 4),
win as (select doc_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] as g from spots),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, count(distinct i + k.k) as n from twice, (select unnest([0, 1, 2]) as k) k group by doc_id),
normal as (select doc_id, host, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as line from full_lines),
hosts as (select host, count(*) as n from d group by host),
often as (select host, line from (select host, line, count(distinct doc_id) as n from normal group by host, line) join hosts h using (host) where {{0}}.n > {MIN_DOCS} and {{0}}.n > {SHARE} * h.n),
lost as (select doc_id, sum(len(string_split(line, ' '))) as n from normal join often using (host, line) group by doc_id),
b as (select w.doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dups.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, coalesce(lost.n, 0) as n_lost_words
  from w left join dups using (doc_id) left join covered using (doc_id) left join lost using (doc_id)),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  base_failed, not base_failed and n_lost_words <= {LOSS} * n_words as kept, n_lost_words::bigint as n_lost_words from f
""".replace("{0}", "c").replace("from (select host, line, count(distinct doc_id) as n from normal group by host, line)", "from (select host, line, count(distinct doc_id) as n from normal group by host, line) c")
