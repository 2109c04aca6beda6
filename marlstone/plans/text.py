"""Queries over documents: predicates, budgets, chunks and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import windows
from marlstone.plans.catalog import query
from marlstone.tables import table

BUDGET = 120
#: The marks once more, for the SQL.
_LEGAL = "regexp_matches(low, 'spdx-license-identifier|copyright|[(]c[)]|©|all rights reserved|permission is hereby granted|redistribution and use|without warranty|warranties or conditions|licensed under|general public license|(apache|mit|bsd|mozilla public) license|gnu ')"
_MARKER = r"(?m)^\s*([0-9]+[.)]\s|[*+•-]\s|##?#?#?#?#?\s|\*\*[^*\n]+\*\*\s*:)"
_LINES = "l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, generate_subscripts(lines, 1) AS k, unnest(lines) AS line, len(lines) AS n FROM l)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null")


def _lines() -> Column:
    return F.split("text", "\n")


@query(f"WITH t AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL) SELECT doc_id, ({_LEGAL}) AS legal, len(regexp_extract_all(text, '{_MARKER}')) >= 2 AS listy FROM t")
def legal_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.looks_legal(F.col("text")).alias("legal"), T.looks_listy(F.col("text")).alias("listy"))


@query(r"""SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s*(?:\d+[.)]|[-*+•]|#{1,6})\s+', ''), '\*\*([^*\n]+)\*\*', '\1', 'g')), chr(10))) AS plain_sha FROM documents WHERE text IS NOT NULL""")
def without_list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(T.without_list_markers(F.col("text")), 256).alias("plain_sha"))


@query("SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 2.0) AS INTEGER) AS n_tokens, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE text IS NOT NULL")
def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.estimated_tokens(F.col("text")).alias("n_tokens"), F.size(_lines()).cast("long").alias("n_lines"))


@query(f"WITH {_LINES}, s AS (SELECT doc_id, k, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS used FROM e) SELECT doc_id, count(*) FILTER (used - 1 <= {BUDGET * 2}) AS n_kept FROM s GROUP BY doc_id")
def head_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.size(windows.head_crop(_lines(), BUDGET)).cast("long").alias("n_kept"))


@query(
    f"""WITH {_LINES}, h AS (
  SELECT doc_id, k, n, line, CAST(ceil(octet_length(encode(line)) / 2.0) AS BIGINT) + 1 AS cost FROM e
), d AS (
  SELECT l.doc_id, len(lines) AS n, CAST(ceil(octet_length(encode(array_to_string(lines, chr(10)))) / 2.0) AS BIGINT) AS all_tokens, CAST(ceil(octet_length(encode(lines[1])) / 2.0) AS BIGINT) AS head_tokens,
    CAST(ceil(octet_length(encode('... ' || (len(lines) - 1) || ' lines omitted ...')) / 2.0) AS BIGINT) AS marker FROM l
), b AS (SELECT *, {BUDGET} - head_tokens - marker AS rest, CAST(floor(({BUDGET} - head_tokens - marker) * 0.5) AS BIGINT) AS head_budget FROM d
), r AS (
  SELECT h.doc_id, h.k, sum(cost) OVER (PARTITION BY h.doc_id ORDER BY h.k) AS down, sum(cost) OVER (PARTITION BY h.doc_id ORDER BY h.k DESC) AS up FROM h WHERE k > 1
), c AS (
  SELECT b.doc_id, b.n, any_value(b.all_tokens) AS all_tokens, any_value(b.rest) AS rest, count(*) FILTER (r.down <= b.head_budget) AS n_head, count(*) FILTER (r.up <= b.rest - b.head_budget) AS n_tail0
  FROM b LEFT JOIN r ON r.doc_id = b.doc_id GROUP BY b.doc_id, b.n
), f AS (SELECT *, least(n_tail0, n - 1 - n_head) AS n_tail FROM c)
SELECT doc_id, CASE WHEN all_tokens <= {BUDGET} OR n = 1 OR (rest > 0 AND n - 1 - n_head - n_tail <= 0) THEN n - 1 WHEN rest <= 0 THEN 0 ELSE n_head END AS n_head,
  CASE WHEN all_tokens <= {BUDGET} OR n = 1 OR (rest > 0 AND n - 1 - n_head - n_tail <= 0) OR rest <= 0 THEN 0 ELSE n_tail END AS n_tail,
  CASE WHEN all_tokens <= {BUDGET} OR n = 1 OR (rest > 0 AND n - 1 - n_head - n_tail <= 0) THEN 0 WHEN rest <= 0 THEN n - 1 ELSE n - 1 - n_head - n_tail END AS n_omitted FROM f"""
)
def elided_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", windows.elided(_lines(), 1, BUDGET).alias("e"))
    return d.select("doc_id", *[F.col(f"e.{x}").cast("long").alias(x) for x in ("n_head", "n_tail", "n_omitted")])


#: Lines in turn: c is the number of the chunk at hand, open whether it holds a line, used its cost so far.
_CHUNKED = f"""WITH RECURSIVE {_LINES}, p AS (
  SELECT doc_id, k, n, line, CAST(ceil(octet_length(encode(line)) / 2.0) AS BIGINT) + 1 AS cost, greatest(1, CAST(floor({BUDGET} * greatest(1, length(line) // greatest(1, CAST(ceil(octet_length(encode(line)) / 2.0) AS BIGINT))) * 0.9) AS BIGINT)) AS piece FROM e
), r AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS c, false AS open, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS own FROM l
  UNION ALL SELECT p.doc_id, p.k, CASE WHEN cost > {BUDGET} THEN r.c + r.open::INT + greatest(length(line) - 1, 0) // piece + 1 WHEN shut THEN chunk + 1 ELSE chunk END,
    CASE WHEN cost > {BUDGET} OR shut THEN false ELSE true END, CASE WHEN cost > {BUDGET} OR shut THEN 0 ELSE now END, CASE WHEN cost > {BUDGET} THEN r.c + r.open::INT ELSE chunk END
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1, LATERAL (SELECT r.c + (r.open AND r.used + cost > {BUDGET})::INT AS chunk, CASE WHEN r.open AND r.used + cost <= {BUDGET} THEN r.used + cost ELSE cost END AS now) x, LATERAL (SELECT trim(line, ' ') = '' AND now >= {BUDGET} * 0.75 AS shut) y
), t AS (SELECT r.doc_id, r.own, p.k, line, cost, piece FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k
), c AS (SELECT doc_id, CAST(own AS INTEGER) AS chunk_no, string_agg(line, chr(10) ORDER BY k) AS chunk FROM t WHERE cost <= {BUDGET} GROUP BY ALL
  UNION ALL SELECT doc_id, CAST(own + i AS INTEGER), substr(line, CAST(i * piece + 1 AS BIGINT), piece) FROM (SELECT *, unnest(range(greatest(length(line) - 1, 0) // piece + 1)) AS i FROM t WHERE cost > {BUDGET})
), chunks AS (SELECT doc_id, chunk_no, chunk, CAST(ceil(octet_length(encode(chunk)) / 2.0) AS INTEGER) AS n_tokens FROM c)"""


@query(_CHUNKED + " SELECT doc_id, chunk_no, chunk, n_tokens FROM chunks")
def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", F.posexplode(windows.chunks(_lines(), BUDGET)).alias("chunk_no", "chunk"))
    return d.select("doc_id", "chunk_no", "chunk", T.estimated_tokens(F.col("chunk")).alias("n_tokens"))


@query(
    _CHUNKED
    + f""", m AS (SELECT doc_id, chunk_no AS i, n_tokens + 8 AS cost, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks
), g AS (SELECT doc_id, -1 AS i, 0 AS grp, 0 AS held, 0 AS used FROM (SELECT DISTINCT doc_id FROM m)
  UNION ALL SELECT m.doc_id, m.i, g.grp + (g.held >= 2 AND g.used + cost > {3 * BUDGET})::INT, CASE WHEN g.held >= 2 AND g.used + cost > {3 * BUDGET} THEN 1 ELSE g.held + 1 END, CASE WHEN g.held >= 2 AND g.used + cost > {3 * BUDGET} THEN cost ELSE g.used + cost END FROM g JOIN m ON m.doc_id = g.doc_id AND m.i = g.i + 1
), o AS (SELECT g.doc_id, g.i, g.grp, m.n, max(g.grp) OVER (PARTITION BY g.doc_id) AS most FROM g JOIN m ON m.doc_id = g.doc_id AND m.i = g.i)
SELECT doc_id, i AS part, CASE WHEN n > 1 AND most = 0 THEN (i + 1 > n // 2)::INT ELSE grp END AS group_no FROM o"""
)
def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = windows.chunks(_lines(), BUDGET)
    d = _documents(spark, sf_dir).select("doc_id", F.transform(chunks, lambda c: T.estimated_tokens(c)).alias("costs"))
    return d.select("doc_id", F.posexplode(windows.groups(F.col("costs"), 3 * BUDGET)).alias("part", "group_no"))


@query(r"""SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], '(no description)') AS summary FROM documents WHERE text IS NOT NULL""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.first_line(F.col("text"), "(no description)").alias("summary"))


@query(
    r"""WITH t AS (SELECT doc_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS x FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, x, regexp_extract(x, '([0-9]{1,9})\s*(?:-|to|–)\s*([0-9]{1,9})', 1) AS a, regexp_extract(x, '([0-9]{1,9})\s*(?:-|to|–)\s*([0-9]{1,9})', 2) AS b, regexp_extract(x, '([0-9]{1,9})', 1) AS one FROM t),
c AS (SELECT doc_id, x, one, greatest(1, least(TRY_CAST(CASE WHEN a <> '' THEN a ELSE one END AS INTEGER), 40)) AS f, greatest(1, least(TRY_CAST(CASE WHEN b <> '' THEN b ELSE one END AS INTEGER), 40)) AS l FROM r)
SELECT doc_id, f AS first, l AS last FROM c WHERE NOT starts_with(x, 'none') AND one <> '' AND f <= l"""
)
def classified_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", T.classified_range(F.col("text"), F.lit(40)).alias("r")).filter("r is not null")
    return d.select("doc_id", "r.first", "r.last")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(u, '\bKEEP\b') THEN 'KEEP' WHEN regexp_matches(u, '\bSKIP\b') THEN 'SKIP' END AS verdict
FROM (SELECT doc_id, upper(coalesce(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], '')) AS u FROM documents WHERE text IS NOT NULL)""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.verdict(F.col("text"), "KEEP", "SKIP").alias("verdict"))


@query(
    r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(array_to_string(list_transform(lines, lambda x: rtrim('    # ' || x, ' ')), chr(10))) AS hash_sha,
  sha256(CASE WHEN len(lines) = 1 THEN rtrim('  // ' || lines[1], ' ') ELSE '  /*' || chr(10) || array_to_string(list_transform(lines, lambda x: rtrim('   * ' || x, ' ')), chr(10)) || chr(10) || '   */' END) AS block_sha FROM t"""
)
def rendered_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.comment_lines(F.col("text"), F.lit("    "), "# ")
    b = T.comment_lines(F.col("text"), F.lit("  "), "// ", "/*", " * ", " */")
    return _documents(spark, sf_dir).select("doc_id", F.sha2(F.array_join(a, "\n"), 256).alias("hash_sha"), F.sha2(F.array_join(b, "\n"), 256).alias("block_sha"))


@query("SELECT doc_id, replace(replace('About {lang} in {project}: {lang}', '{lang}', coalesce(lang, '')), '{project}', coalesce(project, '')) AS prompt FROM documents")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    p = T.filled(F.lit("About {lang} in {project}: {lang}"), lang=blank(F.col("lang")), project=blank(F.col("project")))
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("prompt"))


_SHAPE = r"CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\s*#') THEN 'heading' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s') THEN 'item' WHEN regexp_matches(line, '^\s*```') THEN 'fence' ELSE 'text' END"


def _shape(c: Column) -> Column:
    return F.when(F.trim(c) == "", "blank").when(c.rlike(r"^\s*#"), "heading").when(c.rlike(r"^\s*([-*+]|\d+[.)])\s"), "item").when(c.rlike(r"^\s*```"), "fence").otherwise("text")


@query(f"WITH {_LINES}, s AS (SELECT doc_id, k, {_SHAPE} AS shape FROM e), t AS (SELECT shape, lead(shape) OVER (PARTITION BY doc_id ORDER BY k) AS next_shape FROM s) SELECT shape, next_shape, count(*) AS n FROM t WHERE next_shape IS NOT NULL GROUP BY ALL")
def line_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = F.transform(_lines(), _shape)
    pairs = F.arrays_zip(F.slice(shapes, 1, F.size(shapes) - 1).alias("shape"), F.slice(shapes, 2, F.size(shapes)).alias("next_shape"))
    p = _documents(spark, sf_dir).filter(F.size(_lines()) > 1).select(F.explode(pairs).alias("p"))
    return p.groupBy("p.shape", "p.next_shape").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_LINES}, w AS (SELECT string_split(regexp_replace(lower(regexp_replace(line, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), ' ') AS w FROM e WHERE trim(line) <> ''
), g AS (SELECT n, array_to_string(w[1:n], ' ') AS gram FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)
SELECT n, gram, count(*) AS n_lines FROM g GROUP BY ALL HAVING count(*) >= 20"""
)
def opener_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _documents(spark, sf_dir).select(F.explode(_lines()).alias("line")).filter("trim(line) <> ''")
    w = F.split(F.regexp_replace(F.lower(T.strip(F.col("line"))), r"\s+", " "), " ")
    g = line.select(w.alias("w")).select("w", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")).filter("size(w) >= n")
    return g.select("n", F.array_join(F.slice("w", 1, F.col("n")), " ").alias("gram")).groupBy("n", "gram").agg(F.count("*").alias("n_lines")).filter("n_lines >= 20")
