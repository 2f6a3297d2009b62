"""Channels between services - URLs, paths, topics, RPC names - and how well an endpoint receives one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgraph.functions import fixed
from flowgraph.functions.identifiers import norm_path, segments


def is_wild(segment: Column) -> Column:
    return segment.rlike(fixed.WILD_SEGMENT)


def looks_like_topic(raw: Column) -> Column:
    return ~raw.rlike("[/ ]") & raw.rlike(fixed.TOPIC) & raw.rlike("[._-]")


def looks_like_rpc(raw: Column) -> Column:
    return raw.rlike(fixed.RPC)


def parse_channel(raw: Column, kind: Column, method: Column | None = None) -> Column:
    """Struct of kind, method, host, path, topic, raw.

    A message kind, or an unknown one that looks like a topic, gives a topic; then RPC names; then anything with a
    scheme or a leading slash, or of a kind like HTTP, gives a path; the rest stays opaque.
    """
    raw = F.trim(F.trim(F.coalesce(raw, F.lit(""))), F.lit("\"'"))
    kind = F.coalesce(kind, F.lit("unknown"))
    verb = F.upper(F.trim(F.coalesce(method, F.lit("")) if method is not None else F.lit("")))
    verb = F.when(verb.isin(*fixed.HTTP_METHODS), verb)
    unknown = kind == "unknown"
    message = kind.isin(*fixed.MQ_KINDS) | (unknown & looks_like_topic(raw))
    rpc = (kind == "grpc") | (unknown & looks_like_rpc(raw))
    web = F.when(kind.isin(*fixed.HTTP_KINDS), kind).otherwise(F.lit("http"))
    url = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)"
    nothing = F.lit(None).cast("string")

    def made(kind: Column, host: Column, path: Column, topic: Column) -> Column:
        return F.struct(kind.alias("kind"), verb.alias("method"), host.alias("host"), path.alias("path"), topic.alias("topic"), raw.alias("raw"))

    return (
        F.when(message, made(F.when(kind.isin(*fixed.MQ_KINDS), kind).otherwise(F.lit("kafka")), nothing, F.lit("/"), raw))
        .when(rpc, made(F.lit("grpc"), nothing, F.lit("/"), F.ltrim(raw, F.lit("/"))))
        .when(F.contains(raw, F.lit("://")), made(web, F.nullif(F.lower(F.regexp_extract(raw, url, 1)), F.lit("")), norm_path(F.regexp_extract(raw, url, 2)), nothing))
        .when(F.startswith(raw, F.lit("/")) | kind.isin(*fixed.HTTP_KINDS), made(web, nothing, norm_path(raw), nothing))
        .otherwise(made(F.lit("unknown"), nothing, F.lit("/"), F.nullif(raw, F.lit(""))))
    )


def host_is_local(host: Column) -> Column:
    return host.isNull() | (host == "") | F.element_at(F.split(host, ":"), 1).isin(*fixed.LOCAL_HOSTS)


def without_prefix(parts: Column, prefix: Column) -> Column:
    """The segments after a prefix that they begin with, case and all."""
    n = F.size(prefix)
    return F.when((n > 0) & (F.slice(parts, 1, n) == prefix), F.slice(parts, n + 1, F.size(parts))).otherwise(parts)


def plain(parts: Column) -> Column:
    """Segments in lower case, wild ones as null."""
    return F.transform(parts, lambda s: F.when(~is_wild(s), F.lower(s)))


def aligned(out: Column, endpoint: Column) -> Column:
    """The tail of a channel's plain segments against an endpoint's: 1 for alike, 0 for wild, -1 for different, each."""
    tail = F.slice(out, F.greatest(F.size(out) - F.size(endpoint), F.lit(0)) + 1, F.size(endpoint))
    return F.zip_with(tail, endpoint, lambda o, e: F.when(o.isNull() | e.isNull(), 0).when(o == e, 1).otherwise(-1))


def with_path_score(df: DataFrame, out: str, endpoint: str, name: str = "path_score", are_plain: bool = False) -> DataFrame:
    """df with how well an endpoint's segments cover the tail of a channel's; 0 for not at all, rounded half to even.

    Steps are columns of their own, so that each is computed once; are_plain says that the segments are plain already.
    """
    if not are_plain:
        df = df.withColumns({"_o1": plain(F.col(out)), "_e1": plain(F.col(endpoint))})
        return with_path_score(df, "_o1", "_e1", name, True).drop("_o1", "_e1")
    n, m = F.size(out), F.size(endpoint)
    df = df.withColumn("_pairs", aligned(F.col(out), F.col(endpoint)))
    df = df.withColumn("_hits", F.size(F.filter("_pairs", lambda x: x == 1))).withColumn("_wrong", F.array_contains("_pairs", -1))
    literal = F.exists(endpoint, lambda e: e.isNotNull())
    base = F.when(m == n, fixed.EXACT_BASE).otherwise(fixed.SUFFIX_BASE)
    score = F.bround((base * (0.5 + 0.5 * F.col("_hits") / m)).cast("double"), 4)
    none = F.col("_wrong") | ((F.col("_hits") == 0) & literal)
    whole = F.when(m == 0, F.when(n == 0, 0.5).otherwise(0.0)).when(m > n, 0.0).when(none, 0.0).otherwise(score)
    return df.withColumn(name, whole).drop("_pairs", "_hits", "_wrong")


def path_parts(out: Column, own: Column, prefix: Column) -> Column:
    """What the score of a pair needs of its paths: a channel's segments, plain ones too, an endpoint's after the prefix, and that."""
    return F.struct(out.alias("out"), plain(out).alias("plain"), plain(own).alias("own"), prefix.alias("prefix"))


def with_match_score(df: DataFrame) -> DataFrame:
    """df with the score of its channel and endpoint (structs of kind, method, host, path, topic) for tokens and base_path."""
    c, e = (lambda f: F.col(f"channel.{f}")), (lambda f: F.col(f"endpoint.{f}"))
    topics = (F.length(c("topic")) > 0) & (F.length(e("topic")) > 0)
    same = F.lower(c("topic")) == F.lower(e("topic"))
    by_topic = F.when(e("kind").isin(*fixed.MQ_KINDS) & topics & same, 1.0).otherwise(0.0)
    a, b = (F.ltrim(F.lower(x("topic")), F.lit("/")) for x in (c, e))
    last = F.element_at(F.split(b, "/"), -1)
    by_rpc = F.when((e("kind") == "grpc") & topics, F.when(a == b, 1.0).when(F.endswith(a, F.concat(F.lit("/"), last)), fixed.RPC_SUFFIX)).otherwise(0.0)

    if "parts" not in df.columns:
        prefix = segments(F.col("base_path"))
        df = df.withColumn("parts", path_parts(segments(c("path")), without_prefix(segments(e("path")), prefix), prefix))
    own = F.col("parts.prefix")
    cut = F.when((F.size(own) > 0) & (F.slice("parts.out", 1, F.size(own)) == own), F.slice("parts.plain", F.size(own) + 1, F.size("parts.plain"))).otherwise(F.col("parts.plain"))
    df = with_path_score(df.withColumn("_out", cut).withColumn("_own", F.col("parts.own")), "_out", "_own", "_path", True)
    host = F.lower(F.coalesce(c("host"), F.lit("")))
    df = df.withColumn("_named", (host != "") & F.exists("tokens", lambda t: (t != "") & F.contains(host, F.lower(t))))
    df = df.withColumn("_other", F.coalesce(c("method") != e("method"), F.lit(False)))
    scored = F.col("_path") * F.when(F.col("_other"), fixed.VERB_MISMATCH).otherwise(1.0)
    scored = F.when(~host_is_local(c("host")) & F.col("_named"), F.least(F.lit(1.0), scored + fixed.HOST_BOOST)).otherwise(scored)
    alone = (F.size("_out") == 0) & F.col("_named") & e("kind").isin(*fixed.HTTP_KINDS)
    by_host = F.when(alone, fixed.HOST_ONLY * F.when(F.col("_other"), fixed.HOST_VERB_MISMATCH).otherwise(1.0)).otherwise(0.0)
    by_path = F.when(F.col("_path") > 0, scored).otherwise(by_host)
    mq = c("kind").isin(*fixed.MQ_KINDS) | e("kind").isin(*fixed.MQ_KINDS)
    rpc = (c("kind") == "grpc") | (e("kind") == "grpc")
    score = F.bround(F.coalesce(F.when(mq, by_topic).when(rpc, by_rpc).otherwise(by_path), F.lit(0.0)).cast("double"), 4)
    return df.withColumn("score", score).drop("parts", "_out", "_own", "_path", "_named", "_other")
