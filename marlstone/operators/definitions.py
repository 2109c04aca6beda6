"""Definitions of C and JavaScript sources, and what stands around definitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marlstone.operators import braces
from marlstone.operators.patch import is_blank, is_comment
from marlstone.tables import spread

_CALLS = "array<struct<name:string,kind:string,line:int>>"
_SCHEMA = f"file string, name string, qualname string, kind string, signature string, start_line int, end_line int, depth int, parent_qualname string, code string, own_doc string, calls {_CALLS}"
SYMBOL = ("file", "qualname", "kind", "signature", "start_line", "end_line", "depth", "parent_qualname", "existing_doc", "calls")


def lexed_definitions(files: DataFrame, languages: tuple[str, ...] = braces.LANGUAGES) -> DataFrame:
    """All definitions that lexing finds: name, qualname, kind, signature, lines, depth, parent, code, own_doc and calls.

    Sources that don't parse give what their brackets allow. A null blob or another language gives none. A file that is
    delivered twice gives its rows twice.
    """
    arrow = to_arrow_schema(StructType.fromDDL(_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, blob, language in zip(*(b.column(i).to_pylist() for i in range(3))):
                text = blob.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
                for d in braces.definitions(text, language):
                    calls = [dict(zip(("name", "kind", "line"), c)) for c in d.calls]
                    rows.append((key, d.name, d.qualname, d.kind, d.signature, d.start_line, d.end_line, d.depth, d.parent, d.code, d.own_doc, calls))
            cols = list(zip(*rows)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], names=arrow.names)

    rows = files.select("file_key", "source_blob", "language").filter(F.col("source_blob").isNotNull() & F.col("language").isin(*languages))
    return spread(rows).mapInArrow(run, _SCHEMA)


def source_symbols(files: DataFrame) -> DataFrame:
    """The symbols of sources of all languages, in the columns of a symbols table; a row for each definition.

    Python files are parsed and give nothing where they don't parse; C and JavaScript files are lexed. A C prototype is
    left out where its own file defines the routine. A docstring or comment that is not there is null. Rows are distinct
    by (file, qualname, start_line), so files delivered twice count once.
    """
    from marlstone.operators.parse import python_definitions

    py = python_definitions(files).select("file", "qualname", "kind", "signature", F.col("def_line").alias("start_line"), "end_line", "depth", "parent_qualname", "existing_doc", "calls")
    lexed = lexed_definitions(files, ("c", "javascript")).withColumnRenamed("own_doc", "existing_doc").select(*SYMBOL).dropDuplicates(["file", "qualname", "start_line"])
    prototypes = lexed.filter("kind = 'declaration'")
    defined = lexed.filter("kind = 'function'").select("file", "qualname").distinct()
    rest = lexed.filter("kind <> 'declaration'").unionByName(prototypes.join(defined, ["file", "qualname"], "left_anti"))
    return py.dropDuplicates(["file", "qualname", "start_line"]).unionByName(rest)


def comment_flags(lines: Column, language: Column) -> Column:
    """Of each line whether it is a comment line."""
    return F.transform(lines, lambda x: ~is_blank(x) & is_comment(x, language))


def comments_above(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, qualname, start_line, first_comment): where the comment lines right above a definition begin.

    files: (file_key, comment), each file once, with its `comment_flags`. Definitions without any comment are left out.
    A run is unbroken: a blank or code line ends it, so code between two block comments is never taken for a comment.
    Rows of symbols that repeat come out once.
    """
    s = symbols.select("file", "qualname", "start_line").filter("start_line > 1").distinct()
    f = files.select(F.col("file_key").alias("file"), "comment").filter("comment is not null")
    above = F.reverse(F.slice("comment", 1, F.least(F.col("start_line") - 1, F.size("comment"))))
    run = F.array_position(above, False)
    n = F.when(run == 0, F.size(above)).otherwise(run - 1)
    inside = F.col("start_line") - 1 <= F.size("comment")
    return s.join(f, "file").filter(inside).select("file", "qualname", "start_line", (F.col("start_line") - n).cast("int").alias("first_comment")).filter("first_comment < start_line")


def routine_hashes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, qualname, start_line, text_hash): of each live definition the hash of its lines, joined by line feeds: the
    first 16 hex digits of the SHA-256 of its bytes.

    files: (file_key, source_lines), each file once. A definition whose lines the file does not have is left out. The
    definitions of a file meet its lines as one array, so no line travels twice.
    """
    spans = symbols.select("file", "qualname", "start_line", "end_line").filter("start_line >= 1 and end_line >= start_line").distinct()
    spans = spans.groupBy("file").agg(F.collect_list(F.struct("qualname", "start_line", "end_line")).alias("spans"))
    f = files.select(F.col("file_key").alias("file"), "source_lines").filter("source_lines is not null")
    text = lambda x: F.array_join(F.transform(F.slice("source_lines", x["start_line"], x["end_line"] - x["start_line"] + 1), lambda b: F.decode(b, "ISO-8859-1")), "\n")
    within = F.filter("spans", lambda x: x["end_line"] <= F.size("source_lines"))
    hashed = F.transform(within, lambda x: F.struct(x["qualname"].alias("qualname"), x["start_line"].alias("start_line"), F.substring(F.sha2(F.encode(text(x), "ISO-8859-1"), 256), 1, 16).alias("text_hash")))
    return spans.join(f, "file").select("file", F.explode(hashed).alias("h")).select("file", "h.*")


def context_window(lines: Column, first: Column, last: Column, around: int = 8, reach: int = 24) -> Column:
    """struct(first, last): the lines around a range, and upwards to the nearest line of smaller indent within reach."""
    indent = lambda x: F.length(x) - F.length(F.ltrim(x))
    base = indent(F.coalesce(F.try_element_at(lines, first), F.lit("")))
    low = F.greatest(F.lit(1), first - reach)
    rows = F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)))
    outer = F.array_max(F.filter(rows, lambda i: (i >= low) & (i < first) & (F.trim(F.try_element_at(lines, i)) != "") & (indent(F.try_element_at(lines, i)) < base)))
    start = F.greatest(F.lit(1), first - around)
    return F.struct(F.least(start, F.coalesce(outer, start)).alias("first"), F.least(F.size(lines), last + around).alias("last"))


def scores(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(n_found, n_true, n_both, precision, recall, f1) of distinct keys; a rate without cases is 1."""
    f = found.select(*keys).distinct().withColumn("f", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    n = f.join(t, keys, "full").agg(F.count("f").alias("n_found"), F.count("t").alias("n_true"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("n_both"))
    rate = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    n = n.withColumn("precision", rate("n_both", "n_found")).withColumn("recall", rate("n_both", "n_true"))
    total = F.col("precision") + F.col("recall")
    return n.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total))
