"""Queries over the bodies of routines: statements, paragraphs, targets, emitted requests, views and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import blocks, queue, windows
from marlstone.plans.catalog import query
from marlstone.plans.manifest import LATEST
from marlstone.tables import table, written

_LINES = f"WITH {LATEST}, b AS (SELECT file, id, string_split(snippet, chr(10)) AS lines, blocks.stmt_lines AS stmts, blocks.chunks AS chunks FROM q WHERE snippet IS NOT NULL AND blocks.stmt_lines IS NOT NULL)"


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "snippet", F.col("blocks.stmt_lines").alias("stmts"), F.col("blocks.chunks").alias("chunks"))
    return q.filter("snippet is not null and stmts is not null").withColumn("lines", F.split("snippet", "\n")).drop("snippet")


@query(
    f"""{_LINES}, l AS (SELECT file, id, stmts, greatest(4, length(CAST(len(lines) AS VARCHAR))) AS g, generate_subscripts(lines, 1) AS k, unnest(lines) AS x FROM b
), c AS (SELECT *, k = 1 AS head, k > 1 AND list_contains(stmts, CAST(k AS INTEGER)) AS legal FROM l
), i AS (SELECT *, sum(CASE WHEN legal OR head THEN 1 ELSE 0 END) OVER (PARTITION BY file, id ORDER BY k) AS island FROM c
), r AS (SELECT *, count(*) FILTER (NOT legal AND NOT head) OVER (PARTITION BY file, id, island) AS n, min(CASE WHEN NOT legal AND NOT head THEN k END) OVER (PARTITION BY file, id, island) AS first FROM i
), v AS (SELECT file, id, k, CASE WHEN legal THEN lpad(CAST(k AS VARCHAR), CAST(g AS INTEGER), ' ') || '| ' || x WHEN head OR n <= 6 THEN repeat(' ', g) || '| ' || x WHEN k = first THEN repeat(' ', g) || '| « ' || n || ' lines elided »' END AS y FROM r)
SELECT file, id, sha256(string_agg(y, chr(10) ORDER BY k)) AS view_sha FROM v WHERE y IS NOT NULL GROUP BY ALL"""
)
def numbered_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bodies(spark, sf_dir)
    view = blocks.numbered_body(F.col("lines"), F.col("stmts"), F.lit(1), F.size("lines"))
    return b.select("file", "id", F.sha2(view, 256).alias("view_sha"))


@query(
    f"""{_LINES}, c AS (SELECT file, id, stmts, len(lines) AS n, generate_subscripts(chunks, 1) AS k, unnest(chunks) AS c FROM b
), p AS (SELECT file, id, n, k, c.lines[1] AS a, c.lines[2] AS b FROM c WHERE c.lines IS NOT NULL AND list_contains(stmts, c.lines[1])
), u AS (SELECT file, id, n, a, arg_min(b, k) AS b FROM p GROUP BY ALL)
SELECT file, id, a AS first, CAST(least(greatest(b, a), n, coalesce(lead(a) OVER (PARTITION BY file, id ORDER BY a) - 1, n)) AS INTEGER) AS last FROM u"""
)
def parsed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply that names the chunks of a request as ranges, read against the statement lines."""
    b = _bodies(spark, sf_dir)
    reply = F.array_join(F.transform(F.filter("chunks", lambda c: c["lines"].isNotNull()), lambda c: F.concat(c["lines"][0].cast("string"), F.lit(" - "), c["lines"][1].cast("string"))), "; ")
    s = blocks.parsed_segments(F.coalesce(reply, F.lit("")), F.col("stmts"), F.size("lines"))
    has = F.coalesce(F.exists("chunks", lambda c: c["lines"].isNotNull()), F.lit(False))
    return b.filter(has).select("file", "id", F.explode(s).alias("s")).select("file", "id", "s.first", "s.last")


#: Statements as the lines of a snippet show them, with what stands before.
_SHOWN = f"""{_LINES}, s AS (SELECT file, id, len(lines) AS n, lines, generate_subscripts(stmts, 1) AS i, unnest(stmts) AS start, stmts FROM b
), t AS (SELECT file, id, n, i, start, lines[start] AS x, (CASE WHEN i < len(stmts) THEN stmts[i + 1] ELSE n + 1 END) - start AS size FROM s WHERE start BETWEEN 1 AND n
), d AS (SELECT *, length(x) - length(regexp_replace(x, '^ +', '')) AS depth, starts_with(trim(x, ' '), 'return') AS is_return, starts_with(trim(x, ' '), 'def ') AS is_def, ends_with(rtrim(x), ':') OR ends_with(rtrim(x), '{{') AS opens FROM t)"""


@query(
    f"""{_SHOWN}, e AS (SELECT DISTINCT file, id, n, start, depth, is_return, is_def, CASE WHEN opens THEN size ELSE 0 END AS opens_block FROM d
), w AS (SELECT *, lag(depth) OVER v AS before, lag(is_def) OVER v AS was_def, row_number() OVER v AS k FROM e WINDOW v AS (PARTITION BY file, id ORDER BY start)
), r AS (SELECT DISTINCT file, id, n, start FROM w WHERE k = 1 OR coalesce(was_def, false) OR (is_return AND before = depth) OR opens_block >= 3 OR before > depth)
SELECT file, id, start AS first_line, CAST(coalesce(lead(start) OVER (PARTITION BY file, id ORDER BY start) - 1, n) AS INTEGER) AS last_line FROM r"""
)
def structural_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the snippets of all requests, from their statement lines as the text shows them."""
    b = _bodies(spark, sf_dir)
    n = F.size("lines")
    x = F.col("x")
    s = b.select("file", "id", n.alias("n"), "lines", "stmts", F.posexplode("stmts").alias("i", "start")).filter((F.col("start") >= 1) & (F.col("start") <= F.col("n")))
    size = F.coalesce(F.try_element_at("stmts", F.col("i") + 2), F.col("n") + 1) - F.col("start")
    s = s.select("file", "id", "n", "stmts", "start", F.element_at("lines", F.col("start")).alias("x"), size.alias("size"))
    opens = F.rtrim(x).endswith(":") | F.rtrim(x).endswith("{")
    routine = F.concat_ws("\n", "file", "id").alias("routine_id")
    depth = F.length(x) - F.length(F.regexp_replace(x, "^ +", ""))
    stmts = s.select(routine, "start", depth.alias("depth"), F.trim(x).startswith("return").alias("is_return"), F.trim(x).startswith("def ").alias("is_def"), F.when(opens, F.col("size")).otherwise(0).alias("opens_block"), F.lit(False).alias("first_in_scope"), F.lit(0).alias("closed_block"), F.lit(None).cast("int").alias("merge_anchor"), F.lit(False).alias("force_break")).distinct()
    routines = b.select(routine, F.lit(False).alias("has_doc"), F.col("stmts").alias("boundary_lines"), n.alias("body_end"))
    out = windows.structural_breaks(written(stmts, "statements"), routines)
    return out.select(F.split("routine_id", "\n")[0].alias("file"), F.split("routine_id", "\n")[1].alias("id"), "first_line", "last_line")


@query()
def routine_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all routines of all languages, from the statements of their sources."""
    s = blocks.statements(table(spark, sf_dir, "run_files")).withColumn("routine_id", F.concat_ws("\n", "file", "qualname", "header_start"))
    s = written(s, "statements")
    routines = s.groupBy("routine_id").agg(F.first("has_doc").alias("has_doc"), F.first("boundary_lines").alias("boundary_lines"), F.first("body_end").alias("body_end"))
    stmts = s.drop("file", "qualname", "header_start", "has_doc", "boundary_lines", "body_end").distinct()
    out = windows.structural_breaks(stmts, routines)
    parts = F.split("routine_id", "\n")
    return out.select(parts[0].alias("file"), parts[1].alias("qualname"), parts[2].cast("int").alias("start_line"), "first_line", "last_line")


@query()
def block_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_targets(table(spark, sf_dir, "run_files")).dropDuplicates(["file", "qualname", "header_start"])


@query()
def emitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = blocks.emitted_requests(table(spark, sf_dir, "run_files")).dropDuplicates(["file", "id"])
    return r.select("file", "id", "qualname", "kind", "sig_hash", "snippet", "def", F.col("blocks.doc_summary").alias("doc_summary"), F.col("blocks.stmt_lines").alias("stmt_lines"), F.col("blocks.chunks").alias("chunks"))


@query()
def import_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.import_bullets(table(spark, sf_dir, "run_files")).distinct()


@query()
def pattern_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each anonymised line of Python occurs, files counted once."""
    p = blocks.line_patterns(table(spark, sf_dir, "run_files")).distinct()
    return p.groupBy("pattern").agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT DISTINCT file, qualname, start_line, end_line, kind FROM symbols WHERE end_line IS NOT NULL AND start_line IS NOT NULL
), p AS (SELECT file AS run, row_number() OVER (PARTITION BY file ORDER BY start_line, qualname, kind, end_line) AS step, start_line AS n, CAST(end_line - start_line + 1 AS DOUBLE) AS metric, kind <> 'declaration' AS ok FROM d
), s AS (SELECT *, max(CASE WHEN ok THEN metric END) OVER (PARTITION BY run ORDER BY step) AS best FROM p
), t AS (SELECT *, min(CASE WHEN NOT ok OR (best - metric) / best >= 0.5 THEN step END) OVER (PARTITION BY run) AS stop FROM s)
SELECT run, arg_max(n, (metric, step)) AS best_n, max(metric) AS best_metric FROM t WHERE ok AND (stop IS NULL OR step <= stop) GROUP BY run"""
)
def best_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe's rule over the routines of each file, as steps whose metric is their length."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "symbols").select("file", "qualname", "start_line", "end_line", "kind").filter("end_line is not null and start_line is not null").distinct()
    step = F.row_number().over(Window.partitionBy("file").orderBy("start_line", "qualname", "kind", "end_line"))
    p = d.select(F.col("file").alias("run"), step.alias("step"), F.col("start_line").alias("n"), (F.col("end_line") - F.col("start_line") + 1).cast("double").alias("metric"), (F.col("kind") != "declaration").alias("ok"))
    return windows.best_probe(p, 0.5)
