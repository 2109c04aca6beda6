"""Queries over a project as a whole: targets, overlays, caches, overrides, stubs, diagnostics, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import first_line
from marlstone.operators import graph, loading, order
from marlstone.plans.catalog import query
from marlstone.plans.graph import UNIQUE, _symbols
from marlstone.plans.text import _LINES
from marlstone.sources import manifests
from marlstone.tables import table, written

_FIRST = "coalesce(list_filter(list_transform(regexp_split_to_array(coalesce({}, ''), '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], '')"


@query("SELECT file_key FROM run_files WHERE is_target EXCEPT SELECT file_key FROM run_files WHERE NOT is_target")
def targets_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are no references as well."""
    f = table(spark, sf_dir, "run_files")
    return f.filter("is_target").select("file_key").distinct().join(f.filter("not is_target").select("file_key"), "file_key", "left_anti")


@query(
    f"""WITH {UNIQUE}, c AS (SELECT file, qualname, kind, {_FIRST.format("existing_doc")} AS doc FROM u WHERE kind IN ('declaration', 'function') AND regexp_matches(file, '\\.[ch]$')
), d AS (SELECT qualname, count(*) AS n FROM c WHERE kind = 'function' GROUP BY 1
), h AS (SELECT qualname, min(doc) AS doc FROM c WHERE kind = 'declaration' AND doc <> '' AND regexp_matches(file, '\\.h$') GROUP BY 1)
SELECT c.file, c.qualname, CASE WHEN d.n = 1 THEN coalesce(h.doc, c.doc) ELSE c.doc END AS doc, d.n = 1 AND h.doc IS NOT NULL AS overridden
FROM c JOIN d ON d.qualname = c.qualname LEFT JOIN h ON h.qualname = c.qualname WHERE c.kind = 'function'"""
)
def header_doc_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documentation of a header says of the one routine that implements it stands for the routine's own."""
    s = _symbols(spark, sf_dir, "kind", first_line(F.col("existing_doc")).alias("doc")).filter(F.col("kind").isin("declaration", "function") & F.col("file").rlike(r"\.[ch]$"))
    s = written(s, "symbols")
    defs = s.filter("kind = 'function'")
    n = defs.groupBy("qualname").agg(F.count("*").alias("n"))
    heads = s.filter((F.col("kind") == "declaration") & (F.col("doc") != "") & F.col("file").endswith(".h")).groupBy("qualname").agg(F.min("doc").alias("said"))
    j = defs.join(n, "qualname").join(heads, "qualname", "left")
    once = F.col("n") == 1
    return j.select("file", "qualname", F.when(once, F.coalesce("said", "doc")).otherwise(F.col("doc")).alias("doc"), (once & F.col("said").isNotNull()).alias("overridden"))


@query(
    f"""WITH {UNIQUE}, g AS (SELECT file, qualname, arg_max({{'v': signature}}, (start_line, loaded_at)).v AS signature FROM symbols GROUP BY ALL
), k AS (SELECT c.file, c.parent_qualname AS parent, c.qualname, c.start_line, coalesce(g.signature, c.kind || ' ' || c.qualname) || ' ...' AS stub FROM u c JOIN u p ON p.file = c.file AND p.qualname = c.parent_qualname JOIN g ON g.file = c.file AND g.qualname = c.qualname)
SELECT file, parent, count(*) AS n_children, string_agg(stub, chr(10) ORDER BY start_line, qualname) AS stubs FROM k GROUP BY ALL"""
)
def child_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for the routines within a routine or class where only the outer one is shown."""
    s = written(_symbols(spark, sf_dir, "kind", "signature", "parent_qualname", "start_line"), "symbols")
    return graph.child_stubs(s)


@query(
    """WITH a AS (SELECT file_key, arg_min({'v': content_sha}, (loaded_at, path)).v AS old, arg_max({'v': content_sha}, (loaded_at, path)).v AS now, arg_max({'v': repo}, (loaded_at, path)).v AS repo FROM run_files GROUP BY 1
), c AS (SELECT file_key, old, 'Summary of ' || file_key AS text FROM a WHERE old IS NOT NULL AND length(file_key) % 2 = 0)
SELECT a.file_key AS path, 'full' AS kind, a.now AS content_sha, c.text, c.text IS NOT NULL AS hit FROM a LEFT JOIN c ON c.file_key = a.file_key AND c.old = a.now"""
)
def cached_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files looked up in a cache that knows every other of them, as it was first delivered."""
    f = table(spark, sf_dir, "run_files")
    a = f.groupBy(F.col("file_key").alias("path")).agg(F.min_by(F.struct("content_sha"), F.struct("loaded_at", "path")).alias("old"), F.max_by(F.struct("content_sha"), F.struct("loaded_at", "path")).alias("now"))
    a = written(a.select("path", F.lit("full").alias("kind"), "old.content_sha", F.col("now.content_sha").alias("now")), "shas")
    cache = a.filter(F.length("path") % 2 == 0).select("path", "kind", "content_sha", F.concat(F.lit("Summary of "), "path").alias("text"))
    return manifests.cached(a.select("path", "kind", F.col("now").alias("content_sha")), cache)


@query(
    """WITH r AS (SELECT source, lang, project, doc_id, CASE project WHEN 'harbor-monolith' THEN 0 WHEN 'required-lease-80' THEN 1 WHEN 'active-index-159' THEN 2 END AS rank FROM documents)
SELECT source, lang, arg_min(project, (rank, project, doc_id)) AS project, arg_min(doc_id, (rank, project, doc_id)) AS doc_id FROM r WHERE rank IS NOT NULL GROUP BY ALL"""
)
def overlaid_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source and language the text of the first of three projects that has one: an overlay in order of priority."""
    return manifests.overlaid(table(spark, sf_dir, "documents"), ["source", "lang"], F.col("project"), ["harbor-monolith", "required-lease-80", "active-index-159"], "project", "doc_id")


@query(
    """WITH f AS (SELECT file_key, arg_max({'v': source_lines}, (loaded_at, path)).v AS l, arg_max({'v': line_ending}, (loaded_at, path)).v AS e, arg_max({'v': content_sha}, (loaded_at, path)).v AS s, arg_max({'v': repo}, (loaded_at, path)).v AS r, arg_max({'v': language}, (loaded_at, path)).v AS g FROM run_files GROUP BY 1)
SELECT file_key, unnest(list_filter([CASE WHEN l IS NULL THEN 'no lines' END, CASE WHEN e IS NULL THEN 'no line ending' END, CASE WHEN s IS NULL THEN 'no hash' END, CASE WHEN r IS NULL THEN 'no repository' END, CASE WHEN g IS NULL THEN 'no language' END], lambda x: x IS NOT NULL)) AS warning FROM f"""
)
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings as rows: what is missing of each file."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), w) for c, w in (("source_lines", "no lines"), ("line_ending", "no line ending"), ("content_sha", "no hash"), ("repo", "no repository"), ("language", "no language"))]))
    return loading.delivered_once(table(spark, sf_dir, "run_files"), missing.alias("w")).select("file_key", F.explode("w").alias("warning"))


@query(
    f"""WITH {UNIQUE}, p AS (SELECT file, qualname, row_number() OVER (PARTITION BY file ORDER BY depth DESC, start_line DESC, qualname) AS pos FROM u WHERE existing_doc IS NOT NULL)
SELECT u.file, u.qualname, CAST(row_number() OVER (PARTITION BY u.file ORDER BY p.pos IS NULL, p.pos, u.start_line, u.qualname) AS INTEGER) AS position FROM u LEFT JOIN p ON p.file = u.file AND p.qualname = u.qualname"""
)
def applied_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with a given order (documented ones, deepest first) before the others by line."""
    s = written(_symbols(spark, sf_dir, "depth", "start_line", F.col("existing_doc").isNotNull().alias("told")), "symbols")
    listed = s.filter("told").select("file", "qualname", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("depth"), F.desc("start_line"), "qualname")).alias("pos"))
    return order.ordered_items(s.drop("told", "depth"), listed, "qualname", ["file"], ["start_line", "qualname"]).select("file", "qualname", "position")


_SHAPE = r"CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\s*#') THEN 'heading' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s') THEN 'item' WHEN regexp_matches(line, '^\s*```') THEN 'fence' ELSE 'text' END"


@query(
    f"""WITH {_LINES}, s AS (SELECT doc_id, k, {_SHAPE} AS shape FROM e), t AS (SELECT shape, lead(shape) OVER (PARTITION BY doc_id ORDER BY k) AS next_shape FROM s
), n AS (SELECT shape, next_shape, count(*) AS n FROM t WHERE next_shape IS NOT NULL GROUP BY ALL)
SELECT shape, next_shape, n, round(n / CAST(sum(n) OVER (PARTITION BY shape) AS DOUBLE), 9) AS rate FROM n"""
)
def transition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.plans.text import line_transitions

    n = line_transitions(spark, sf_dir)
    return n.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("shape")), 9))  # one row a pair of shapes


@query(
    f"""WITH {_LINES}, o AS (SELECT doc_id, k, line, k = 1 OR trim(lag(line) OVER (PARTITION BY doc_id ORDER BY k)) = '' AS opens FROM e
), w AS (SELECT opens, string_split(regexp_replace(lower(regexp_replace(line, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), ' ') AS w FROM o WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''
), b AS (SELECT count(*) FILTER (opens) / CAST(count(*) AS DOUBLE) AS base FROM w
), g AS (SELECT n, array_to_string(w[1:n], ' ') AS gram, opens FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n
), c AS (SELECT n, gram, count(*) AS n_lines, count(*) FILTER (opens) AS n_open FROM g GROUP BY ALL HAVING count(*) >= 20
), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY n_open / CAST(n_lines AS DOUBLE) DESC, n_lines DESC, gram) AS place FROM c)
SELECT n, gram, n_lines, n_open, round(n_open / CAST(n_lines AS DOUBLE), 9) AS rate, round(n_open / CAST(n_lines AS DOUBLE) / base, 9) AS lift FROM r, b WHERE place <= 30"""
)
def opener_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty openings of one to three words that most often begin a paragraph, and how much more often than any line."""
    from marlstone.functions.text import strip

    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.split("text", "\n").alias("l"))
    flat = d.select(F.explode(F.transform("l", lambda x, i: F.struct(x.alias("x"), ((i == 0) | (F.trim(F.coalesce(F.try_element_at("l", i), F.lit("x"))) == "")).alias("opens")))).alias("s"))
    w = flat.select("s.opens", F.split(F.regexp_replace(F.lower(strip(F.col("s.x"))), r"\s+", " "), " ").alias("w"), strip(F.col("s.x")).alias("x")).filter("x <> ''")
    base = w.agg((F.count_if("opens") / F.count("*")).alias("base")).first()[0]  # one number
    g = w.select("opens", "w", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")).filter("size(w) >= n").select("n", F.array_join(F.slice("w", 1, F.col("n")), " ").alias("gram"), "opens")
    c = g.groupBy("n", "gram").agg(F.count("*").alias("n_lines"), F.count_if("opens").alias("n_open")).filter("n_lines >= 20")
    rate = F.col("n_open") / F.col("n_lines")
    return graph.top_of_each(c.withColumn("r", rate), ["n"], [F.desc("r"), F.desc("n_lines"), F.asc("gram")], 30).select("n", "gram", "n_lines", "n_open", F.round(rate, 9).alias("rate"), F.round(rate / F.lit(base), 9).alias("lift"))
