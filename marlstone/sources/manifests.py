"""The other manifests, as JSON: file descriptions and rewordings; prompts, probe results and diagnostics."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import strip
from marlstone.sources.files import TOOL

#: The fixed schemas, by kind; a manifest's tool is the tool's name with the kind.
FILES = {
    "filedoc": "path string, language string, role string, skeleton string, entries array<string>, answer struct<range:string,description:string>",
    "reword": "path string, language string, role string, draft string, context string, answer string",
}
HEADS = {"filedoc": "description_spec string, project_doc string", "reword": "project_blurb string"}
VERSION = 1


def _struct(fields: str) -> str:
    out, depth = [], 0
    for part in fields.split(", "):
        name, kind = part.split(" ", 1)
        out.append(f"{name}:{kind}")
    return f"struct<{','.join(out)}>"


def write_manifest(files: DataFrame, path: str, kind: str, **head: str) -> None:
    """One JSON manifest for each repository part of the table: a line for each group `part` of files, in order of path.

    files: the columns of the kind, and `part`, which names the manifest a file belongs to. A new folder; Spark commits it
    whole, so a reader never sees half a manifest. Raises KeyError for an unknown kind.
    """
    columns = [x.split()[0] for x in FILES[kind].split(", ")]
    rows = files.groupBy("part").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("files"))
    fields = [F.lit(VERSION).alias("version"), F.lit(f"{TOOL}-{kind}").alias("tool"), *(F.lit(head.get(x.split()[0])).alias(x.split()[0]) for x in HEADS[kind].split(", ")), F.col("files")]
    rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The files of manifests of a kind, one row each, with the manifests' own fields; fails on another tool or version."""
    schema = f"version int, tool string, {HEADS[kind]}, files array<{_struct(FILES[kind])}>"
    m = spark.read.schema(schema).json(path)
    wrong = (F.coalesce("tool", F.lit("")) != f"{TOOL}-{kind}") | (F.coalesce("version", F.lit(0)) != VERSION)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit(f"not a {kind} manifest: "), F.coalesce("tool", F.lit("none"))))).otherwise(F.col("files"))
    heads = [x.split()[0] for x in HEADS[kind].split(", ")]
    return m.select(*heads, F.explode(checked).alias("f")).select(*heads, "f.*")


def unfilled(kind: str, answer: Column) -> Column:
    """Whether a file of a manifest waits: a description needs both its range and its text, a rewording its text."""
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    return blank(answer["range"]) | blank(answer["description"]) if kind == "filedoc" else blank(answer)


def read_prompts(spark: SparkSession, *folders: str) -> dict[str, str]:
    """Prompt texts by file name: of several folders the first that holds a file wins, file by file. A small set of files,
    read by the driver; a folder that isn't there is passed over."""
    out: dict[str, str] = {}
    for folder in folders:
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
            if name.endswith((".txt", ".md")) and name not in out:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    out[name] = f.read()
    return out


def overlaid(rows: DataFrame, key: list[str], place: Column, order: list[str], *values: str) -> DataFrame:
    """Of each key the values of the row in the place that comes first in the order; places not in it are passed over.

    Of several rows in one place the least values count. A null place is none.
    """
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(place == name, i).otherwise(rank)
    r = rows.withColumn("rank", rank).filter("rank is not null")
    return r.groupBy(*key).agg(F.min(F.struct("rank", *values)).alias("r")).select(*key, *(f"r.{v}" for v in values))


def write_results(results: DataFrame, path: str) -> None:
    """Rows as lines of JSON in a new folder, nulls written out, in one order."""
    results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).sort("value").write.text(path)


def cached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, kind, content_sha, text, hit): what a cache holds for the same content; a text of other content is no hit.

    cache: (path, kind, content_sha, text), of equal keys the least text counts. A null content_sha is never found.
    """
    c = cache.filter("text is not null").groupBy("path", "kind", "content_sha").agg(F.min("text").alias("text"))
    return wanted.select("path", "kind", "content_sha").distinct().join(c, ["path", "kind", "content_sha"], "left").withColumn("hit", F.col("text").isNotNull())
