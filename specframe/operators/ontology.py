"""Controlled-vocabulary terms as a dimension table (id, name, def, is_a)."""

from __future__ import annotations

import gzip
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, name string, def string, is_a array<string>, other map<string, string>"
DEFAULT_VERSION, FALLBACK_VERSION = "4.1.79", "1.1.0"


def parse_obo(text: str) -> list[tuple]:
    """Rows of a vocabulary file's terms; ``is_a`` keeps all parents, of other repeated keys the last one counts."""
    rows, term = [], None
    for line in [*text.splitlines(), "[End]"]:
        line = line.strip()
        if line.startswith("["):
            if term and "id" in term:
                rows.append((term.pop("id"), term.pop("name", None), term.pop("def", None), term.pop("is_a", []), {k: v for k, v in term.items()}))
            term = {} if line == "[Term]" else None
        elif term is not None and ":" in line:
            key, value = (x.strip() for x in line.split(":", 1))
            if key == "is_a":
                term.setdefault("is_a", []).append(value)
            else:
                term[key] = value
    return rows


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """The terms of one vocabulary file, plain or gzip; some thousands of rows."""
    with open(path, "rb") as f:
        raw = f.read()
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    return spark.createDataFrame(parse_obo(raw.decode("utf-8")), SCHEMA)


def normalise_version(version: str) -> str:
    """Three parts, zeros at the end."""
    return ".".join((version.split(".") + ["0", "0"])[:3])


def resolve_version(given: str | None, available: set[str], by_year: dict[int, str] | None = None) -> str:
    """An available version for what a file says: a version, or a date whose year has one; else the fallback."""
    if not given:
        return DEFAULT_VERSION
    if m := re.search(r"\d\.\d{1,2}\.\d{1,2}", given):
        return m[0] if m[0] in available else FALLBACK_VERSION
    if m := re.search(r"(19|20)\d\d", given):
        found = (by_year or {}).get(int(m[0]), "")
        return found if found in available else FALLBACK_VERSION
    if re.fullmatch(r"\d+(\.\d+)?", given) and normalise_version(given) in available:
        return normalise_version(given)
    return FALLBACK_VERSION


def lookup(terms: DataFrame, key: str) -> DataFrame:
    """Terms whose id, else whose name, else whose definition is the key."""
    rank = F.when(F.col("id") == key, 0).when(F.col("name") == key, 1).when(F.col("def") == key, 2)
    return terms.withColumn("__rank", rank).where("__rank is not null").orderBy("__rank", "id").limit(1).drop("__rank")


def name_of(terms: DataFrame, accession: str) -> DataFrame:
    return terms.where(F.col("id") == accession).select("name")


def with_names(rows: DataFrame, terms: DataFrame, accession: str = "accession", name: str = "name") -> DataFrame:
    """Rows with the name of the term that a column refers to; those of unknown terms are left out."""
    return rows.join(terms.select(F.col("id").alias(accession), F.col("name").alias(name)), accession)


def is_a(terms: DataFrame, child: str, parent: str) -> DataFrame:
    """One row: whether the child names the parent directly; an unknown child doesn't."""
    hit = terms.where(F.col("id") == child).where(F.exists("is_a", lambda x: x.startswith(parent)))
    return hit.agg((F.count("*") > 0).alias("is_member"))


def parents(terms: DataFrame) -> DataFrame:
    """id, parent: one row for each direct parent."""
    return terms.select("id", F.explode("is_a").alias("p")).select("id", F.split("p", " ")[0].alias("parent"))


def ancestors(terms: DataFrame, depth: int = 32) -> DataFrame:
    """id, ancestor, distance at first: all ancestors; the vocabulary is small, so the frontier is joined step by step."""
    edges = parents(terms).persist()
    found = edges.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    frontier = found
    for step in range(2, depth + 1):
        up = edges.select(F.col("id").alias("ancestor"), F.col("parent"))
        frontier = frontier.join(up, "ancestor").select("id", F.col("parent").alias("ancestor"), F.lit(step).alias("distance")).distinct().persist()
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found.groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))


def search(terms: DataFrame, text: str) -> DataFrame:
    """field, id: a row for each of id, name and definition that holds the text, whatever the case."""
    q = text.lower()
    hits = [terms.where(F.lower(c).contains(q)).select(F.lit(c).alias("field"), "id") for c in ("id", "name", "def")]
    return hits[0].unionAll(hits[1]).unionAll(hits[2])


def add(terms: DataFrame, rows: list[tuple]) -> DataFrame:
    """The terms and some more."""
    return terms.unionByName(terms.sparkSession.createDataFrame(rows, SCHEMA))


def check(terms: DataFrame, accession: str, name: str) -> DataFrame:
    """One row: whether this id has this name."""
    return terms.where((F.col("id") == accession) & (F.col("name") == name)).agg((F.count("*") > 0).alias("matches"))


def mapping(terms: DataFrame, reverse: bool = False) -> DataFrame:
    """key, value: id to name, or name to id."""
    a, b = ("name", "id") if reverse else ("id", "name")
    return terms.select(F.col(a).alias("key"), F.col(b).alias("value")).dropDuplicates(["key"])
