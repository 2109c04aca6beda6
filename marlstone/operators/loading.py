"""Loading of source files: line endings, languages, lines, targets and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import strip


def carried(blob: Column) -> Column:
    """Bytes as text, a character a byte: reversible, whatever the encoding."""
    return F.decode(blob, "ISO-8859-1")


def ending_counts(blob: Column) -> tuple[Column, Column, Column]:
    """CRLF, lone CR and lone LF of a blob."""
    t = carried(blob)
    n = lambda x, y: (F.length(x) - F.length(F.replace(x, F.lit(y), F.lit(""))))
    crlf = F.expr("0") + n(t, "\r\n") / 2
    crlf = crlf.cast("int")
    return crlf, (n(t, "\r") - crlf).cast("int"), (n(t, "\n") - crlf).cast("int")


def line_ending(blob: Column) -> Column:
    """crlf, cr or lf: CRLF only by a strict majority, CR only if more than LF."""
    crlf, cr, lf = ending_counts(blob)
    return F.when(crlf > F.greatest(cr, lf), "crlf").when(cr > lf, "cr").otherwise("lf")


def delivered_once(files: DataFrame, *values: Column | str) -> DataFrame:
    """(file_key, values): of each file_key the values of its last delivery; without values, all columns.

    Values are worked out row by row before deliveries are compared, so only they are shuffled and the scan reads no more
    than they need. Name what a query needs; whole sources should not travel.
    """
    rows = files.select("file_key", "loaded_at", "path", F.struct(*(values or [c for c in files.columns if c != "file_key"])).alias("r"))
    return rows.groupBy("file_key").agg(F.max_by("r", F.struct("loaded_at", "path")).alias("r")).select("file_key", "r.*")


#: A pattern, the language it votes for and its weight; languages in the order of their rules.
VOTES = (
    (r"^(#include|#define )", "c", 2),
    (r"(?s)^(extern|static)(?!.*(public|final)).*;$", "c", 2), (r"(?s)^(extern|static)(?!.*(public|final)).*;$", "cpp", 2),
    (r"using namespace|^template<", "cpp", 3), (r"^(public:|private:|protected:)", "cpp", 2),
    (r"(?s)^(def |class ).*:$", "python", 3), (r"(?s)^(import |from ).*[^;]$", "python", 2),
    (r"^(function |export |const |let |var )", "js", 2), (r"(?s)^import .* from .*;$", "js", 2), (r"document\.|window\.|console\.|JSON\.|=>", "js", 3),
    (r"(?s)class .*\{$", "js", 1), (r"(?s)class .*\{$", "java", 1), (r"^package ", "java", 3), (r"^package ", "go", 2),
    (r"^(import java\.|import javax\.)", "java", 3), (r"^public class ", "java", 3), (r"System\.out\.|public static void main", "java", 3),
    (r"^(import \(|func )", "go", 3), (r"fmt\.|^go ", "go", 2), (r"^echo |^(fi|done|esac)$", "sh", 2),
    (r"(?i)^(SUB |FUNCTION |DIM |PRINT )", "vb", 3), (r"(?i)^(MODULE |IMPORTS |PUBLIC CLASS )", "vb", 2),
)


def guessed_languages(files: DataFrame, keys: str | list[str], text: Column) -> DataFrame:
    """(keys, language, votes): what the lines of a text vote for; a known shebang decides alone.

    Of equal votes the language that got its first vote earliest wins (by line, then in the order of the rules);
    `text` where nothing votes. Lines are voted on within the row, so nothing is shuffled. A null text is `text`.
    """
    names = list(dict.fromkeys(v[1] for v in VOTES))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), strip), lambda x: x != "")
    keys = [keys] if isinstance(keys, str) else keys
    t = files.select(*keys, lines.alias("lines"))
    first = F.lower(F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")))
    shebang = F.when(first.startswith("#!"), F.when(first.contains("python"), "python").when(first.contains("bash") | first.endswith("/sh"), "sh").when(first.contains("node"), "js"))

    def votes(name: str):
        rules = [(p, w) for p, n, w in VOTES if n == name]
        return lambda x: sum((F.when(x.rlike(p), w).otherwise(0) for p, w in rules), F.lit(0))

    columns = []
    for rank, name in enumerate(names):
        got = F.transform("lines", votes(name))
        t = t.withColumn(f"v_{name}", got)
        total = F.aggregate(f"v_{name}", F.lit(0), lambda a, b: a + b)
        since = F.coalesce(F.array_position(F.transform(f"v_{name}", lambda v: v > 0), True), F.lit(0))
        columns.append(F.struct(total.alias("votes"), (-since).alias("since"), F.lit(-rank).alias("rank"), F.lit(name).alias("language")))
    best = F.array_max(F.array(*columns))
    t = t.select(*keys, shebang.alias("shebang"), best.alias("best"))
    known = F.when(F.col("shebang").isNotNull(), F.col("shebang")).when(F.col("best.votes") > 0, F.col("best.language")).otherwise("text")
    return t.select(*keys, known.alias("language"), F.when(F.col("shebang").isNull(), F.col("best.votes")).otherwise(0).alias("votes"))


def run_files(targets: DataFrame, references: DataFrame) -> DataFrame:
    """(file_key, is_target): every file once; a file that is both is a target."""
    t = targets.select("file_key").withColumn("is_target", F.lit(True))
    r = references.select("file_key").withColumn("is_target", F.lit(False))
    return t.union(r).groupBy("file_key").agg(F.max("is_target").alias("is_target"))
