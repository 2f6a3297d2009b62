"""Service manifests and other small YAML files, read on the driver: they list services, not data."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgraph.functions import fixed
from flowgraph.sources import schemas

NAMES = ("services.yaml", "services.yml")
ROLES = ("gateway", "internal")
# Fixed values of gateway files.
GATEWAY_KEYS = (
    ("spring", "cloud", "gateway", "routes"), ("spring", "cloud", "gateway"), ("zuul", "routes"), ("routes",), ("services",), ("upstreams",),
    ("spec", "rules"), ("spec", "routes"), ("gateway", "routes"), ("api", "routes"), ("endpoints",),
)
GATEWAY_WORDS = ("routes", "gateway", "zuul", "paths", "endpoints", "ingress", "api-gateway", "routing", "proxy")
SKIPPED_FOLDERS = (
    ".git", ".svn", "__pycache__", "node_modules", "target", "build", ".gradle", "dist", ".idea",
    ".venv", "venv", "env", "bin", "obj", "pkg",
)


def _yaml():
    """PyYAML, which only manifests need."""
    try:
        import yaml
    except ModuleNotFoundError as missing:
        raise RuntimeError("reading YAML needs PyYAML") from missing
    return yaml


def service_row(entry: Any, number: int) -> dict:
    """A manifest's entry, checked: a name fit for a path, a known role, and an app or both folders."""
    if not isinstance(entry, dict):
        raise ValueError(f"service {number} is not a mapping")
    name = str(entry.get("name") or entry.get("app") or "")
    if not re.fullmatch("[A-Za-z0-9][A-Za-z0-9._-]{0,63}", name):
        raise ValueError(f"service {number} has no usable name: {name!r}")
    role = str(entry.get("role") or "internal").strip().lower()
    if role not in ROLES:
        raise ValueError(f"service {name}: a role is one of {', '.join(ROLES)}")
    if not entry.get("app") and not (entry.get("source") and entry.get("database")):
        raise ValueError(f"service {name} needs an app, or a source and a database")
    aliases = entry.get("aliases") or []
    return {
        "service": name, "key": str(entry.get("app") or name), "role": role, "source": entry.get("source"), "database": entry.get("database"),
        "aliases": [str(a) for a in ([aliases] if isinstance(aliases, str) else aliases)], "base_path": entry.get("base_path"), "language": entry.get("language"), "ord": number,
    }


def parse_manifest(text: str) -> list[dict]:
    """The services of a manifest; if none is a gateway, the first one is."""
    entries = (_yaml().safe_load(text) or {}).get("services")
    if not entries:
        raise ValueError("the manifest lists no services")
    rows = [service_row(e, k) for k, e in enumerate(entries)]
    names = [r["service"] for r in rows]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"services named twice: {', '.join(twice)}")
    if all(r["role"] != "gateway" for r in rows):
        rows[0]["role"] = "gateway"
    return rows


def find_manifest(path: str) -> Path | None:
    """A manifest file, or the one in a folder."""
    p = Path(path)
    return p if p.is_file() else next((p / n for n in NAMES if (p / n).is_file()), None)


def services(spark: SparkSession, path: str) -> DataFrame:
    """The services of an application; without a manifest it is one gateway service by its own name."""
    found = find_manifest(path)
    rows = parse_manifest(found.read_text()) if found else [service_row({"app": Path(path).name, "role": "gateway"}, 0)]
    return spark.createDataFrame(rows, schemas.SERVICES)


def tokens() -> Column:
    """What a host may contain to mean a service: its name, key and aliases in lower case, sorted, each once."""
    every = F.transform(F.concat(F.array("service", "key"), "aliases"), F.lower)
    return F.array_sort(F.array_distinct(F.filter(every, lambda t: t != "")))


def entry_services(df: DataFrame) -> DataFrame:
    """The gateways, or all services if there is none."""
    gateways = df.where("role = 'gateway'")
    return df.join(gateways.agg(F.count("*").alias("_n")), F.expr("role = 'gateway' or _n = 0")).drop("_n")


def database_language(text: str) -> str | None:
    """The primary language of a database description, else its first."""
    data = _yaml().safe_load(text) or {}
    found = data.get("primaryLanguage") or next(iter(data.get("languages") or []), None)
    return str(found).lower() if found else None


def has_nested_key(data: Any, keys: tuple[str, ...]) -> bool:
    for key in keys:
        if not isinstance(data, dict) or key not in data:
            return False
        data = data[key]
    return True


def is_gateway_config(data: Any) -> bool:
    """Whether a mapping configures routes and is no list of containers."""
    return isinstance(data, dict) and not {"version", "services"} <= data.keys() and any(has_nested_key(data, k) for k in GATEWAY_KEYS)


def has_gateway_content(path: str, text: str) -> bool:
    """Whether a YAML file configures a gateway: not too large, nothing of docker, a telling word, then its structure."""
    low = text.lower()
    if len(text.encode()) > fixed.GATEWAY_BYTES or "docker" in path.lower() or "docker" in low or not any(w in low for w in GATEWAY_WORDS):
        return False
    yaml = _yaml()
    try:
        return any(is_gateway_config(d) for d in yaml.safe_load_all(text))
    except yaml.YAMLError:
        return False


def _common(files: DataFrame, common: tuple[str, ...]) -> DataFrame:
    """The files at common places, with their rank among these."""
    rank = F.coalesce(*[F.when(F.col("file") == c, F.lit(k)) for k, c in enumerate(common)], F.lit(None).cast("int"))
    return files.withColumn("_rank", rank).where("_rank is not null")


def gateway_files(files: DataFrame, depth: int = 10, common: tuple[str, ...] = ()) -> DataFrame:
    """Files at common places, in their order, then YAML files that configure a gateway, by content, in path order; each once.

    files has file and text.
    """
    parts = F.split("file", "/")
    wanted = files.where(F.col("file").rlike(r"\.ya?ml$") & (F.size(parts) <= depth) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))))
    schema = wanted.schema

    def keep(batches):
        for b in batches:
            yield b[[has_gateway_content(f, t or "") for f, t in zip(b.file, b.text, strict=True)]]

    found = wanted.where(~F.col("file").isin(*common) if common else F.lit(True)).mapInPandas(keep, schema).withColumn("_rank", F.lit(len(common)))
    return _common(files, common).unionByName(found).orderBy("_rank", "file").drop("_rank")


def first_gateway(files: DataFrame, common: tuple[str, ...] = (), depth: int = 10) -> DataFrame:
    """The first file at a common place, else the first one outside skipped folders named `*gateway.yaml`, or none."""
    parts = F.split("file", "/")
    named = files.where(F.col("file").rlike(r"gateway\.yaml$") & (F.size(parts) <= depth + 1) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))))
    found = _common(files, common).unionByName(named.withColumn("_rank", F.lit(len(common))))
    return found.orderBy("_rank", F.size(F.split("file", "/")), "file").limit(1).drop("_rank")


#: Names of a description, in the order they are looked for.
READMES = (
    "README.md", "README.rst", "README.txt", "README", "readme.md", "readme.rst", "readme.txt", "readme",
    "Readme.md", "Readme.rst", "Readme.txt", "Readme",
)


def app_description(files: DataFrame, limit: int = fixed.DESCRIPTION_CHARS) -> DataFrame:
    """One row, or none: the text of the first README, a longer one cut at its last blank within the limit, with dots."""
    head = F.left("text", F.lit(limit))
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, "(?s)^(.*) ", 1)).otherwise(head)
    return _common(files, READMES).orderBy("_rank").limit(1).select("file", F.when(F.length("text") <= limit, F.col("text")).otherwise(F.concat(cut, F.lit("..."))).alias("description"))


def entry_points(results: DataFrame, confidence: float = 0.95) -> DataFrame:
    """A row per entry point of classified results: two arrays, external and internal, of (name, protocol, place)."""
    each = lambda kind: results.select(F.posexplode(kind).alias("ord", "_e"), F.lit(kind).alias("type")).select("type", "ord", "_e.*", F.lit(confidence).alias("confidence"))
    return each("external").unionByName(each("internal"))


def entry_point_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("protocol").alias("protocols")).orderBy("type")
