"""Reading source trees and manifests, and writing annotated files to a new root."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import SOURCES
from marlstone.operators.loading import carried, line_ending

#: The fixed schema of a run manifest's requests.
REQUEST = (
    "id string, file string, qualname string, kind string, sig_hash string, snippet string, snippet_ref string, `def` struct<answer:string>, "
    "blocks struct<doc_summary:string,length_note:string,stmt_lines:array<int>,insertions:map<string,string>,chunks:array<struct<bidx:int,lines:array<int>,anchor:string,existing:string,preserve:boolean,answer:string>>>, fragment string"
)
MANIFEST = f"version int, tool string, files array<struct<path:string,language:string,line_ending:string>>, doc_style string, line_length int, fragments_issued int, fragment_of string, requests array<struct<{REQUEST.replace(' string', ':string').replace(' struct', ':struct')}>>"
TOOL = "marlstone"
ENDINGS = {"python": (".py",), "c": (".c", ".h"), "javascript": (".js", ".mjs", ".cjs")}


def read_files(spark: SparkSession, *patterns: str) -> DataFrame:
    """Files by glob, directory or path: (file_key, path, source_blob, source_lines, line_ending, language).

    Directories are read recursively and only for source endings; globs and single paths bypass that filter. A file
    that several patterns name comes out once. Contents stay bytes, lines are split by the file's own ending. Empty
    files are left out, as Spark's listing leaves them out.
    """
    out = None
    for p in patterns:
        is_dir = not any(x in p for x in "*?[") and os.path.isdir(p.removeprefix("file:"))
        r = spark.read.format("binaryFile")
        df = (r.option("recursiveFileLookup", "true") if is_dir else r).load(p).select("path", "content")
        if is_dir:
            df = df.filter(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(*SOURCES))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no pattern")
    key = F.regexp_replace("path", r"^file:(//)?", "")
    language = F.lit(None).cast("string")
    for name, ends in ENDINGS.items():
        language = F.when(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(*ends), name).otherwise(language)
    files = out.withColumn("file_key", key).dropDuplicates(["file_key"]).withColumn("line_ending", line_ending(F.col("content")))
    sep = F.when(F.col("line_ending") == "crlf", "\r\n").when(F.col("line_ending") == "cr", "\r").otherwise("\n")
    lines = F.transform(F.split(carried(F.col("content")), sep), lambda x: F.encode(x, "ISO-8859-1"))
    return files.select("file_key", "path", F.col("content").alias("source_blob"), lines.alias("source_lines"), "line_ending", language.alias("language"))


def write_files(files: DataFrame, root: str, strip: str = "") -> None:
    """Writes source_lines with the file's ending below a new root; the prefix `strip` is cut from file_key.

    Each file is written under another name first and then renamed, so a reader never sees half a file and a repeated
    task does no harm. Raises ValueError for a key that leads out of the root. The root has to be shared by executors.
    """

    def run(rows: Iterator) -> None:
        for r in rows:
            sep = {"crlf": b"\r\n", "cr": b"\r"}.get(r.line_ending, b"\n")
            to = os.path.normpath(os.path.join(root, r.file_key.removeprefix(strip).lstrip("/")))
            if not to.startswith(os.path.normpath(root) + os.sep):
                raise ValueError(f"{r.file_key} is not below {strip or '/'}")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(sep.join(bytes(x) for x in r.source_lines))
            os.replace(part, to)

    files.select("file_key", "line_ending", "source_lines").filter("source_lines is not null").foreachPartition(run)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The requests of JSON manifests, one row each, with the manifest's line_length; version 1 is read as version 2.

    Fails on a manifest of another tool or a later version. A missing line_length stays null.
    """
    m = spark.read.schema(MANIFEST).json(path, multiLine=True)
    wrong = (F.coalesce(F.col("tool"), F.lit("")) != TOOL) | ~F.coalesce(F.col("version"), F.lit(0)).isin(1, 2)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("not a manifest of this tool: "), F.coalesce(F.col("tool"), F.lit("none"))))).otherwise(F.col("requests"))
    return m.select(F.explode(checked).alias("r"), "line_length", "fragment_of").select("r.*", "line_length", "fragment_of")


def write_manifests(requests: DataFrame, path: str, line_length: int | None = None) -> None:
    """One JSON manifest for each file: a line of its requests, in order of id. A new folder; Spark commits it whole."""
    columns = [c for c in requests.columns if c not in ("line_length", "fragment_of")]
    rows = requests.groupBy("file").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*columns)))).alias("r"))
    head = F.concat(F.lit(f'{{"version":2,"tool":"{TOOL}","line_length":{line_length if line_length is not None else "null"},"requests":['), F.array_join("r", ","), F.lit("]}"))
    rows.select(head.alias("value")).write.text(path)
