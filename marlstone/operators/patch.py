"""Insertion-only patching of source lines, guarded so that no code line changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a comment line begins with after its indent, as hex of bytes: # for Python, // /* * for the others.
COMMENT_HEX = {"python": "23", "c": "2F2F|2F2A|2A", "javascript": "2F2F|2F2A|2A"}


def is_blank(line: Column) -> Column:
    """Whether a line of bytes holds only blanks, tabs and form feeds."""
    return F.hex(line).rlike("^(20|09|0C|0B|0D)*$")


def is_comment(line: Column, language: Column) -> Column:
    """Whether a line of bytes is a comment line of its language: it begins with a mark after its indent."""
    out = F.lit(False)
    for name, marks in COMMENT_HEX.items():
        out = out | ((language == name) & F.hex(line).rlike(f"^(20|09)*({marks})"))
    return out


def code_lines(lines: Column, language: Column) -> Column:
    """Lines that are neither blank nor comments, in order: what a patch may never change."""
    return F.filter(lines, lambda x: ~is_blank(x) & ~is_comment(x, language))


def code_signature(lines: Column, language: Column) -> Column:
    """SHA-256 of the code lines."""
    return F.sha2(F.array_join(F.transform(code_lines(lines, language), F.hex), "|"), 256)


def spliced(lines: Column, insertions: Column) -> Column:
    """Lines with texts inserted above them: insertions is array of struct(line_no, text binary), in order of lines.

    A text goes above its line; several above one line keep their order; numbers beyond the lines go to the end.
    """
    n = F.size(lines)
    own = F.transform(lines, lambda x, i: F.struct((i + 1).alias("k"), F.lit(1).alias("r"), F.lit(0).alias("o"), x.alias("x")))
    new = F.transform(insertions, lambda x, i: F.struct(F.least(x["line_no"], n + 1).alias("k"), F.lit(0).alias("r"), i.alias("o"), x["text"].alias("x")))
    return F.transform(F.array_sort(F.concat(own, new)), lambda s: s["x"])


def annotated(files: DataFrame, notes: DataFrame) -> DataFrame:
    """Files with comments put above lines: (file_key, language, source_lines, n_inserted, preserved).

    notes: (file_key, line_no, text). A note takes the indent of its line and the comment mark of the language. Where
    the guard fails (the code lines differ) the file comes out unchanged and preserved is false. A file without notes
    is unchanged; a null source_lines stays null. All notes of a file are gathered in its row.
    """
    mark = {"python": "# ", "c": "// ", "javascript": "// "}
    g = notes.filter("text is not null and line_no >= 1").groupBy("file_key").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("notes"))
    f = files.select("file_key", "language", "source_lines").join(g, "file_key", "left")
    prefix = F.lit("# ")
    for name, m in mark.items():
        prefix = F.when(F.col("language") == name, m).otherwise(prefix)
    line = lambda x: F.try_element_at(F.col("source_lines"), x["line_no"])
    lead = lambda x: F.unhex(F.regexp_extract(F.coalesce(F.hex(line(x)), F.lit("")), "^((?:20|09)*)", 1))
    # a note of several lines becomes as many comment lines
    texts = F.flatten(F.transform(F.col("notes"), lambda x: F.transform(F.split(x["text"], "\n"), lambda t: F.struct(x["line_no"].alias("line_no"), F.concat(lead(x), F.encode(F.concat(prefix, t), "UTF-8")).alias("text")))))
    f = f.withColumn("new", F.when(F.col("notes").isNull(), F.col("source_lines")).otherwise(spliced(F.col("source_lines"), texts)))
    same = F.col("language").isNull() | (code_signature(F.col("new"), F.col("language")) == code_signature(F.col("source_lines"), F.col("language")))
    ok = F.coalesce(same, F.lit(False))
    return f.select("file_key", "language", F.when(ok, F.col("new")).otherwise(F.col("source_lines")).alias("source_lines"), F.coalesce(F.when(ok, F.size("new") - F.size("source_lines")), F.lit(0)).alias("n_inserted"), ok.alias("preserved"))
