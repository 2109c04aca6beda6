"""Queries over run_files: loading, line endings, comments, roles, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import loading, parse, patch
from marlstone.plans.catalog import query
from marlstone.tables import table

ONCE = "f AS (SELECT file_key, arg_max({'v': path}, (loaded_at, path)).v AS path, arg_max({'v': source_blob}, (loaded_at, path)).v AS source_blob, arg_max({'v': source_lines}, (loaded_at, path)).v AS source_lines, arg_max({'v': language}, (loaded_at, path)).v AS language, arg_max({'v': content_sha}, (loaded_at, path)).v AS content_sha, arg_max({'v': repo}, (loaded_at, path)).v AS repo FROM run_files GROUP BY file_key)"
BLANK = "'^(20|09|0C|0B|0D)*$'"
COMMENT = "((language = 'python' AND regexp_matches(h, '^(20|09)*(23)')) OR (language IN ('c', 'javascript') AND regexp_matches(h, '^(20|09)*(2F2F|2F2A|2A)')))"
LINES = f"WITH {ONCE}, l AS (SELECT file_key, coalesce(language, '') AS language, generate_subscripts(source_lines, 1) AS line_no, hex(unnest(source_lines)) AS h FROM f)"


def _files(spark: SparkSession, sf_dir: str, *values) -> DataFrame:
    return loading.delivered_once(table(spark, sf_dir, "run_files"), *values)


def _lined(value):
    """A value that is null where a file has no lines."""
    return F.when(F.size("source_lines") > 0, value)


@query(
    """WITH f AS (SELECT DISTINCT file_key, regexp_replace(hex(source_blob), '(..)', '\\1 ', 'g') AS t FROM run_files WHERE source_blob IS NOT NULL
), c AS (SELECT file_key, (length(t) - length(replace(t, '0D 0A ', ''))) // 6 AS crlf, (length(t) - length(replace(t, '0D ', ''))) // 3 AS crs, (length(t) - length(replace(t, '0A ', ''))) // 3 AS lfs FROM f)
SELECT file_key, CAST(crlf AS INTEGER) AS n_crlf, CAST(crs - crlf AS INTEGER) AS n_cr, CAST(lfs - crlf AS INTEGER) AS n_lf,
  CASE WHEN crlf > greatest(crs - crlf, lfs - crlf) THEN 'crlf' WHEN crs > lfs THEN 'cr' ELSE 'lf' END AS line_ending FROM c"""
)
def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    crlf, cr, lf = loading.ending_counts(F.col("source_blob"))
    f = table(spark, sf_dir, "run_files").filter("source_blob is not null")
    return f.select("file_key", crlf.alias("n_crlf"), cr.alias("n_cr"), lf.alias("n_lf"), loading.line_ending(F.col("source_blob")).alias("line_ending")).distinct()


@query("SELECT file_key, bool_or(is_target) AS is_target FROM run_files GROUP BY file_key")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "run_files")
    return loading.run_files(f.filter("is_target"), f.filter("not is_target"))


@query(
    f"""WITH {ONCE} SELECT file_key, path, regexp_extract(file_key, '(\\.[^./]+)?$', 0) AS extension,
  regexp_matches(file_key, '\\.(py|c|h|js|mjs|cjs)$') AS taken,
  CASE WHEN regexp_matches(lower(file_key), '\\.(h|hh|hpp)$') THEN 'header' WHEN regexp_matches(lower(file_key), '\\.(c|cc|cpp)$') THEN 'implementation' ELSE 'other' END AS role FROM f"""
)
def gathered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "run_files").select("file_key", "path", "loaded_at")
    f = f.groupBy("file_key").agg(F.max_by("path", F.struct("loaded_at", "path")).alias("path"))
    extension = F.regexp_extract("file_key", r"(\.[^./]+)?$", 0)
    return f.select("file_key", "path", extension.alias("extension"), extension.isin(*T.SOURCES).alias("taken"), T.file_role(F.col("file_key")).alias("role"))


@query(
    f"""{LINES} SELECT file_key, count(*) AS n_lines, count(*) FILTER (regexp_matches(h, {BLANK})) AS n_blank,
  count(*) FILTER (NOT regexp_matches(h, {BLANK}) AND {COMMENT}) AS n_comment, CAST(max(length(h) // 2) AS INTEGER) AS longest FROM l GROUP BY file_key"""
)
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda keep: F.size(F.filter("source_lines", keep)).cast("long")
    language = F.coalesce("language", F.lit(""))
    profile = F.struct(
        F.size("source_lines").cast("long").alias("n_lines"),
        n(patch.is_blank).alias("n_blank"),
        n(lambda x: ~patch.is_blank(x) & patch.is_comment(x, language)).alias("n_comment"),
        F.array_max(F.transform("source_lines", F.octet_length)).alias("longest"),
    )
    return _files(spark, sf_dir, _lined(profile).alias("p")).filter("p is not null").select("file_key", "p.*")


@query(
    f"""{LINES} SELECT file_key, count(*) AS n_code, sha256(string_agg(h, '|' ORDER BY line_no)) AS signature
FROM l WHERE NOT regexp_matches(h, {BLANK}) AND NOT {COMMENT} GROUP BY file_key"""
)
def code_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.coalesce("language", F.lit(""))
    code = patch.code_lines(F.col("source_lines"), language)
    out = _files(spark, sf_dir, F.size(code).cast("long").alias("n_code"), patch.code_signature(F.col("source_lines"), language).alias("signature"))
    return out.filter("n_code > 0")


@query(
    f"""{LINES}, z AS (SELECT file_key, min(line_no) FILTER (NOT regexp_matches(h, {BLANK}) AND NOT {COMMENT}) AS code FROM l GROUP BY 1
), c AS (SELECT l.file_key, coalesce(bool_or(regexp_matches(h, '^(20|09)*2F2F') AND line_no > code), false) AS line, coalesce(bool_or(regexp_matches(h, '^(20|09)*2F2A') AND line_no > code), false) AS block FROM l JOIN z ON z.file_key = l.file_key WHERE language IN ('c', 'javascript') GROUP BY 1)
SELECT file_key, CASE WHEN line AND NOT block THEN 'line' ELSE 'block' END AS style FROM c"""
)
def comment_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style that comments below the first code have; what stands above it, a banner, does not count."""
    code = F.array_position(F.transform("source_lines", lambda x: ~patch.is_blank(x) & ~patch.is_comment(x, F.coalesce("language", F.lit("")))), True)
    below = F.when(code > 0, F.slice("source_lines", F.greatest(code, F.lit(1)).cast("int"), F.size("source_lines"))).otherwise(F.array().cast("array<binary>"))
    any_ = lambda p: F.exists(below, lambda x: F.hex(x).rlike(p))
    style = F.when(any_("^(20|09)*2F2F") & ~any_("^(20|09)*2F2A"), "line").otherwise("block")
    return _files(spark, sf_dir, _lined(F.when(F.col("language").isin("c", "javascript"), style)).alias("style")).filter("style is not null")


@query(
    f"""{LINES}, z AS (SELECT file_key, coalesce(min(line_no) FILTER (NOT regexp_matches(h, {BLANK}) AND NOT regexp_matches(h, '^(20|09)*23')), max(line_no) + 1) AS first_code FROM l WHERE language = 'python' GROUP BY 1)
SELECT file_key, CAST(first_code - 1 AS INTEGER) AS zone_end FROM z"""
)
def header_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.transform("source_lines", lambda x: ~patch.is_blank(x) & ~patch.is_comment(x, F.lit("python")))
    at = F.array_position(code, True)
    end = F.when(at > 0, at - 1).otherwise(F.size("source_lines")).cast("int")
    return _files(spark, sf_dir, _lined(F.when(F.col("language") == "python", end)).alias("zone_end")).filter("zone_end is not null")


@query(
    f"""{LINES}, m AS (SELECT file_key, line_no, regexp_matches(h, {BLANK}) AS blank FROM l
), g AS (SELECT *, line_no - row_number() OVER (PARTITION BY file_key, blank ORDER BY line_no) AS run FROM m)
SELECT file_key, CAST(min(line_no) AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line FROM g WHERE NOT blank GROUP BY file_key, run"""
)
def line_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("source_lines")
    blank = lambda i: F.coalesce(patch.is_blank(F.try_element_at("source_lines", i)), F.lit(True))
    numbers = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    starts = F.filter(numbers, lambda i: ~blank(i) & ((i == 1) | blank(F.greatest(i - 1, F.lit(1)))))
    ends = F.filter(numbers, lambda i: ~blank(i) & ((i == n) | blank(F.least(i + 1, n))))
    f = _files(spark, sf_dir, _lined(F.arrays_zip(starts.alias("first_line"), ends.alias("last_line"))).alias("bands"))
    return f.select("file_key", F.explode("bands").alias("b")).select("file_key", "b.first_line", "b.last_line")


@query(
    f"""WITH {ONCE}, k AS (SELECT content_sha, count(*) AS n_files, min(file_key) AS first_key FROM f WHERE content_sha IS NOT NULL GROUP BY 1)
SELECT f.file_key, f.content_sha, k.n_files, f.file_key = k.first_key AS computes FROM f JOIN k ON k.content_sha = f.content_sha"""
)
def content_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir, "content_sha").filter("content_sha is not null")
    k = f.groupBy("content_sha").agg(F.count("*").alias("n_files"), F.min("file_key").alias("first_key"))
    return f.join(k, "content_sha").select("file_key", "content_sha", "n_files", (F.col("file_key") == F.col("first_key")).alias("computes"))


#: The name of a document that speaks for a project before any other, and the stems of the next ones.
PREFERRED, STEMS = "claude.md", ("readme", "licence", "license", "copying")
_RANK = f"CASE WHEN name = '{PREFERRED}' THEN 0 " + " ".join(f"WHEN regexp_replace(name, '[.][^.]*$', '') = '{x}' THEN {i + 1}" for i, x in enumerate(STEMS)) + f" ELSE {len(STEMS) + 1} END"


@query(
    f"""WITH {ONCE}, d AS (SELECT DISTINCT repo, regexp_replace(file_key, '/[^/]*$', '') AS dir FROM f WHERE language IS NOT NULL
), c AS (SELECT file_key, regexp_replace(file_key, '/[^/]*$', '') AS dir, lower(regexp_extract(file_key, '[^/]*$', 0)) AS name FROM f WHERE language IS NULL
), up AS (SELECT DISTINCT d.dir, k AS level, array_to_string(list_slice(string_split(d.dir, '/'), 1, len(string_split(d.dir, '/')) - k), '/') AS above FROM d, range(0, 9) t(k) WHERE len(string_split(d.dir, '/')) - k >= 4
), r AS (SELECT up.dir, c.file_key, row_number() OVER (PARTITION BY up.dir ORDER BY level, {_RANK}, name NOT LIKE '%.md', name, file_key) AS k FROM up JOIN c ON c.dir = up.above)
SELECT dir, file_key AS project_doc FROM r WHERE k = 1"""
)
def project_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that speaks for each directory with sources: the nearest at or above it, at most eight levels up and not
    above the repository; at one level by its name, Markdown first. Only files without a language are documents."""
    f = table(spark, sf_dir, "run_files").select("file_key", "language").distinct()
    dir_, name = F.regexp_replace("file_key", r"/[^/]*$", ""), F.lower(F.regexp_extract("file_key", r"[^/]*$", 0))
    dirs = f.filter("language is not null").select(dir_.alias("dir")).distinct()
    up = dirs.withColumn("level", F.explode(F.sequence(F.lit(0), F.least(F.lit(8), F.size(F.split("dir", "/")) - 4)))).withColumn("above", F.expr("substring_index(dir, '/', size(split(dir, '/')) - level)"))
    stem, rank = F.regexp_replace(name, "[.][^.]*$", ""), F.lit(len(STEMS) + 1)
    for i, x in reversed(list(enumerate(STEMS))):
        rank = F.when(stem == x, i + 1).otherwise(rank)
    docs = f.filter("language is null").select(dir_.alias("above"), F.when(name == PREFERRED, 0).otherwise(rank).alias("rank"), (~name.endswith(".md")).alias("plain"), name.alias("name"), "file_key")
    best = docs.groupBy("above").agg(F.min(F.struct("rank", "plain", "name", "file_key")).alias("doc"))
    return up.join(best, "above").groupBy("dir").agg(F.min_by("doc.file_key", "level").alias("project_doc"))


#: The votes once more, as conditions on a line x: language, rank of the language, weight and condition.
_BALLOT = (
    ("c", 0, 2, "regexp_matches(x, '^(#include|#define )')"), ("c", 0, 2, "regexp_matches(x, '^(extern|static)') AND ends_with(x, ';') AND NOT regexp_matches(x, '^(extern|static).*(public|final)')"),
    ("cpp", 1, 2, "regexp_matches(x, '^(extern|static)') AND ends_with(x, ';') AND NOT regexp_matches(x, '^(extern|static).*(public|final)')"), ("cpp", 1, 3, "contains(x, 'using namespace') OR starts_with(x, 'template<')"), ("cpp", 1, 2, "regexp_matches(x, '^(public|private|protected):')"),
    ("python", 2, 3, "regexp_matches(x, '^(def |class )') AND ends_with(x, ':')"), ("python", 2, 2, "regexp_matches(x, '^(import |from ).*[^;]$')"),
    ("js", 3, 2, "regexp_matches(x, '^(function|export|const|let|var) ')"), ("js", 3, 2, "regexp_matches(x, '^import .* from .*;$')"), ("js", 3, 3, "contains(x, 'document.') OR contains(x, 'window.') OR contains(x, 'console.') OR contains(x, 'JSON.') OR contains(x, '=>')"), ("js", 3, 1, "contains(x, 'class ') AND ends_with(x, '{')"),
    ("java", 4, 1, "contains(x, 'class ') AND ends_with(x, '{')"), ("java", 4, 3, "starts_with(x, 'package ')"), ("java", 4, 3, "regexp_matches(x, '^import javax?\\.')"), ("java", 4, 3, "starts_with(x, 'public class ')"), ("java", 4, 3, "contains(x, 'System.out.') OR contains(x, 'public static void main')"),
    ("go", 5, 2, "starts_with(x, 'package ')"), ("go", 5, 3, "starts_with(x, 'import (') OR starts_with(x, 'func ')"), ("go", 5, 2, "contains(x, 'fmt.') OR starts_with(x, 'go ')"),
    ("sh", 6, 2, "starts_with(x, 'echo ') OR x IN ('fi', 'done', 'esac')"), ("vb", 7, 3, "regexp_matches(upper(x), '^(SUB|FUNCTION|DIM|PRINT) ')"), ("vb", 7, 2, "regexp_matches(upper(x), '^(MODULE |IMPORTS |PUBLIC CLASS )')"),
)
_BALLOTS = ", ".join(f"{{'n': '{n}', 'r': {r}, 'w': CASE WHEN {c} THEN {w} ELSE 0 END}}" for n, r, w, c in _BALLOT)


@query(
    f"""WITH b AS (SELECT file_key, arg_max({{'v': source_blob}}, (loaded_at, path)).v AS b FROM run_files GROUP BY file_key),
t AS (SELECT file_key, coalesce(decode(unhex(replace(regexp_replace(regexp_replace(hex(b), '(..)', '\\1 ', 'g'), '[89A-F]. ', '3F ', 'g'), ' ', ''))), '') AS t FROM b),
s AS (SELECT file_key, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines FROM t),
h AS (SELECT file_key, lines, CASE WHEN NOT starts_with(coalesce(lines[1], ''), '#!') THEN NULL WHEN contains(lower(lines[1]), 'python') THEN 'python' WHEN contains(lower(lines[1]), 'bash') OR ends_with(lower(lines[1]), '/sh') THEN 'sh' WHEN contains(lower(lines[1]), 'node') THEN 'js' END AS bang FROM s),
l AS (SELECT file_key, generate_subscripts(lines, 1) AS k, unnest(lines) AS x FROM h WHERE bang IS NULL),
v AS (SELECT file_key, k, unnest([{_BALLOTS}]) AS v FROM l),
n AS (SELECT file_key, v.n AS language, v.r AS rank, sum(v.w) AS votes, min(k) AS since FROM v WHERE v.w > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY votes DESC, since, rank) AS place FROM n)
SELECT h.file_key, coalesce(bang, r.language, 'text') AS language, CAST(coalesce(r.votes, 0) AS INTEGER) AS votes FROM h LEFT JOIN r ON r.file_key = h.file_key AND place = 1"""
)
def guessed_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "run_files")
    voted = loading.guessed_languages(f, ["file_key", "loaded_at", "path"], loading.carried(F.col("source_blob")))
    return loading.delivered_once(voted, "language", "votes")


@query()
def python_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.python_definitions(table(spark, sf_dir, "run_files")).dropDuplicates(["file", "qualname", "def_line"])


@query()
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.python_imports(table(spark, sf_dir, "run_files")).distinct()


@query()
def python_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.paragraphs(table(spark, sf_dir, "run_files"))
