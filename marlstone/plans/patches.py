"""Queries that patch sources: header zones and descriptions, documentation, notes, walls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import replies as R
from marlstone.functions import text as T
from marlstone.operators import headers, loading, patching, queue
from marlstone.operators.graph import unique_symbols
from marlstone.operators.loading import carried
from marlstone.plans.catalog import query
from marlstone.plans.graph import UNIQUE
from marlstone.plans.manifest import LATEST, routine_hashes
from marlstone.tables import table, written

_WS = "(20|09|0C|0D)"
#: Lines of C and JavaScript files up to the first code, with the state of block comments: in hex of bytes.
ZONES = f"""f AS (SELECT file_key, arg_max({{'v': source_lines}}, (loaded_at, path)).v AS source_lines, arg_max({{'v': language}}, (loaded_at, path)).v AS language FROM run_files GROUP BY file_key
), l AS (SELECT file_key, generate_subscripts(source_lines, 1) AS k, hex(unnest(source_lines)) AS h FROM f WHERE language IN ('c', 'javascript')
), t AS (SELECT file_key, k, h, regexp_replace(regexp_replace(h, '^{_WS}*', ''), '{_WS}*$', '') AS s FROM l
), o AS (SELECT *, starts_with(s, '2F2A') AND NOT contains(regexp_replace(s[5:], '(..)', '\\1 ', 'g'), '2A 2F ') AS opens, contains(regexp_replace(s, '(..)', '\\1 ', 'g'), '2A 2F ') AS closes FROM t
), p AS (SELECT *, max(CASE WHEN opens THEN k END) OVER w AS o, max(CASE WHEN closes THEN k END) OVER w AS c FROM o WINDOW w AS (PARTITION BY file_key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), z AS (SELECT *, coalesce(o > coalesce(c, 0), false) AS inside FROM p
), d AS (SELECT *, NOT inside AND s <> '' AND NOT starts_with(s, '2F2A') AND NOT starts_with(s, '2F2F') AND NOT (k = 1 AND starts_with(s, '2321')) AS code FROM z
), e AS (SELECT file_key, min(CASE WHEN code THEN k END) AS stop FROM d GROUP BY 1)"""


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform("source_lines", carried)
    zone = F.when(F.size("source_lines") > 0, headers.header_zone(lines, F.coalesce("language", F.lit(""))))
    return loading.delivered_once(table(spark, sf_dir, "run_files"), "language", zone.alias("zone")).filter("language is not null and zone is not null")


@query(
    f"""WITH {ZONES}, g AS (SELECT d.file_key, k, inside, s, h, regexp_extract(h, '^((20|09)*)', 1) AS lead, regexp_replace(regexp_replace(s, '^(2A)+', ''), '^(20|09)*', '') AS starred, regexp_replace(regexp_replace(s, '^(2F)+', ''), '^(20|09)*', '') AS slashed, closes
  FROM d JOIN e ON e.file_key = d.file_key WHERE stop IS NULL OR k < stop)
SELECT file_key, CAST(k AS INTEGER) AS line_no, CASE WHEN inside AND starts_with(s, '2A') THEN lead || '2A20' WHEN inside THEN lead ELSE lead || '2F2F20' END AS prefix_hex,
  CASE WHEN inside AND starts_with(s, '2A') THEN starred WHEN inside THEN s ELSE slashed END AS inner_hex
FROM g WHERE (inside AND NOT closes AND (CASE WHEN starts_with(s, '2A') THEN starred ELSE s END) <> '') OR (NOT inside AND starts_with(s, '2F2F') AND slashed <> '')"""
)
def header_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _zones(spark, sf_dir).filter("language in ('c', 'javascript')").select("file_key", F.explode("zone.entries").alias("e"))
    hexed = lambda c: F.hex(F.encode(c, "ISO-8859-1"))
    return z.select("file_key", "e.line_no", hexed(F.col("e.prefix")).alias("prefix_hex"), hexed(F.col("e.inner")).alias("inner_hex"))


@query()
def described_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description for every file: in place of its header's first text where that is no legal line, else added."""
    f = table(spark, sf_dir, "run_files")
    lines = F.transform("source_lines", carried)
    z = loading.delivered_once(f, "language", F.when(F.size("source_lines") > 0, lines).alias("lines")).filter("language is not null and lines is not null").withColumnRenamed("file_key", "file")
    z = z.withColumn("zone", headers.header_zone(F.col("lines"), F.col("language"))).withColumn("first", F.when((F.size("zone.entries") > 0) & ~T.looks_legal(F.try_element_at("zone.entries", F.lit(1))["inner"]), F.lit(1)))
    d = headers.described(z.withColumn("last", F.col("first")).withColumn("description", F.concat(F.lit("Holds what "), F.regexp_extract("file", "([^/]*)$", 1), F.lit(" needs, and says so in words that wrap where a line is full, as every description of a file should be able to do without harm."))))
    return d.select("file", "placed", F.size("lines").alias("n_lines"), F.sha2(F.encode(F.array_join("lines", "\n"), "ISO-8859-1"), 256).alias("sha"))


@query(
    f"""WITH RECURSIVE {ZONES}, g AS (SELECT d.file_key, k, row_number() OVER (PARTITION BY d.file_key ORDER BY k) AS n, regexp_replace(regexp_replace(CASE WHEN inside AND starts_with(s, '2A') THEN regexp_replace(regexp_replace(s, '^(2A)+', ''), '^(20|09)*', '') WHEN inside THEN s ELSE regexp_replace(regexp_replace(s, '^(2F)+', ''), '^(20|09)*', '') END, '(..)', '\\1 ', 'g'), '(20 |09 )+', '20 ', 'g') AS x
  FROM d JOIN e ON e.file_key = d.file_key WHERE (stop IS NULL OR k < stop) AND ((inside AND NOT closes AND regexp_replace(regexp_replace(s, '^(2A)+', ''), '^(20|09)*', '') <> '') OR (NOT inside AND starts_with(s, '2F2F') AND regexp_replace(regexp_replace(s, '^(2F)+', ''), '^(20|09)*', '') <> ''))
), m AS (SELECT file_key, max(n) AS n FROM g GROUP BY 1 HAVING max(n) >= 2
), w AS (SELECT g.file_key, string_agg(replace(x, '2D 20 ', '2D '), '20 ' ORDER BY g.n) AS draft FROM g JOIN m ON m.file_key = g.file_key WHERE g.n IN (m.n - 1, m.n) GROUP BY 1
), wd AS (SELECT file_key, regexp_replace(replace(regexp_replace(draft, '(20 )+', '20 ', 'g'), '2D 20 ', '2D '), '(^20 | ?20 $)', '', 'g') AS draft FROM w
), r AS (SELECT file_key, n AS first, n AS last, x AS joined FROM g UNION ALL SELECT r.file_key, r.first, g.n, r.joined || '20 ' || g.x FROM r JOIN g ON g.file_key = r.file_key AND g.n = r.last + 1
), q AS (SELECT r.file_key, r.first, r.last, row_number() OVER (PARTITION BY r.file_key ORDER BY r.first, r.last) AS place FROM r JOIN wd ON wd.file_key = r.file_key AND regexp_replace(replace(regexp_replace(joined, '(20 )+', '20 ', 'g'), '2D 20 ', '2D '), '(^20 | ?20 $)', '', 'g') = wd.draft)
SELECT file_key AS file, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM q WHERE place = 1"""
)
def located_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two texts of each C and JavaScript header as a draft, located in the header again."""
    z = written(_zones(spark, sf_dir).filter("language in ('c', 'javascript')").select(F.col("file_key").alias("file"), F.transform("zone.entries", lambda e: e["inner"]).alias("t")), "zones")
    entries = z.select("file", F.posexplode("t").alias("at", "text")).select("file", (F.col("at") + 1).alias("entry_no"), "text")
    drafts = z.filter("size(t) >= 2").select("file", F.array_join(F.slice("t", F.size("t") - 1, 2), "  ").alias("draft"))
    return headers.located_drafts(entries, drafts)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_key, line_no, text): the answers of definitions that bind to live ones, cleaned; declines are left out."""
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "qualname", "sig_hash", "def", "issued_at")
    a = queue.rebound(q, routine_hashes(spark, sf_dir)).filter(~queue.blank(F.col("answer")) & ~T.declines(F.col("answer")))
    text = F.when(F.col("file").endswith(".py"), R.docstring_body(F.col("answer"))).otherwise(R.comment_body(F.col("answer"), "c"))
    return a.select(F.col("file").alias("file_key"), F.col("start_line").alias("line_no"), text.alias("text")).filter("text <> ''")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loading.delivered_once(table(spark, sf_dir, "run_files"), "language", "source_lines").filter("language is not null and source_lines is not null")


@query()
def documented_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the documentation that its open requests got: docstrings, or comments above the header."""
    d = patching.documented(_sources(spark, sf_dir), _notes(spark, sf_dir))
    sha = F.sha2(F.encode(F.array_join(F.transform("source_lines", carried), "\n"), "ISO-8859-1"), 256)
    return d.select("file_key", "n_applied", "n_refused", "n_inline", F.size("source_lines").alias("n_lines"), sha.alias("sha"))


@query()
def noted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the notes of its requests' chunks above their statements, bound by the hash of the routine."""
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "qualname", "sig_hash", "blocks")
    live = routine_hashes(spark, sf_dir).groupBy("file", "qualname", F.col("text_hash").alias("sig_hash")).agg(F.min("start_line").alias("start_line"))
    c = q.select("file", "id", "qualname", "sig_hash", F.explode("blocks.chunks").alias("c")).join(live, ["file", "qualname", "sig_hash"])
    text = F.when(F.col("file").endswith(".py"), R.comment_body(F.col("c.answer"), "python")).otherwise(R.comment_body(F.col("c.answer"), "c"))
    notes = c.filter("c.answer is not null and c.lines is not null").select(F.col("file").alias("file_key"), F.col("id").alias("routine"), (F.col("start_line") + F.col("c.lines")[0] - 1).alias("line_no"), text.alias("text"))
    d = patching.noted(_sources(spark, sf_dir), notes)
    return d.select("file_key", "n_applied", "n_refused", F.size("source_lines").alias("n_lines"))


@query(
    f"""WITH {LATEST}, f AS (SELECT file_key, arg_max({{'v': source_lines}}, (loaded_at, path)).v AS source_lines, arg_max({{'v': language}}, (loaded_at, path)).v AS language FROM run_files GROUP BY file_key
), a AS (SELECT file, regexp_extract(id, '^fn:(.*):[^:]*$', 1) AS qualname, def.answer AS answer FROM q WHERE def IS NOT NULL AND regexp_replace(coalesce(def.answer, ''), '\\s+', '', 'g') <> ''
  AND NOT starts_with(upper(regexp_replace(regexp_replace(split_part(regexp_replace(def.answer, '^\\s+|\\s+$', '', 'g'), chr(10), 1), '^\\s+|\\s+$', '', 'g'), '^[`"''*.: ]+|[`"''*.: ]+$', '', 'g')), 'NONE')
), t AS (SELECT file, qualname, min(answer) AS text FROM a GROUP BY ALL
), s AS (SELECT file, qualname, min(start_line) AS line_no FROM symbols GROUP BY ALL
), n AS (SELECT s.file, sum(len(string_split(text, chr(10)))) AS n FROM t JOIN s ON s.file = t.file AND s.qualname = t.qualname WHERE line_no >= 1 GROUP BY 1)
SELECT file_key, CAST(CASE WHEN source_lines IS NULL THEN 0 ELSE coalesce(n, 0) END AS INTEGER) AS n_inserted, source_lines IS NOT NULL OR language IS NULL AS preserved, CAST(CASE WHEN source_lines IS NOT NULL THEN len(source_lines) + coalesce(n, 0) END AS INTEGER) AS n_lines FROM f LEFT JOIN n ON n.file = f.file_key"""
)
def annotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.operators import patch

    f = loading.delivered_once(table(spark, sf_dir, "run_files"), "language", "source_lines")
    found = table(spark, sf_dir, "symbols").groupBy("file", "qualname").agg(F.min("start_line").alias("line_no"))
    answers = queue.slots(queue.first_deliveries(table(spark, sf_dir, "requests"), "def", "blocks")).filter("slot = 'def'").filter(~queue.blank(F.col("answer")) & ~T.declines(F.col("answer")))
    ids = answers.select("file", F.regexp_extract("id", r"^fn:(.*):[^:]*$", 1).alias("qualname"), "answer").groupBy("file", "qualname").agg(F.min("answer").alias("text"))
    notes = ids.join(found, ["file", "qualname"]).select(F.col("file").alias("file_key"), "line_no", "text")
    return patch.annotated(f, notes).select("file_key", "n_inserted", "preserved", F.when(F.col("source_lines").isNotNull(), F.size("source_lines")).alias("n_lines"))


@query(
    f"""WITH {ZONES}, {UNIQUE}, g AS (SELECT file, qualname, arg_max({{'v': signature}}, (start_line, loaded_at)).v AS signature FROM symbols GROUP BY ALL
), zl AS (SELECT d.file_key, k, h FROM d JOIN e ON e.file_key = d.file_key WHERE stop IS NULL OR k < stop
), zt AS (SELECT file_key, max(k) FILTER (NOT regexp_matches(h, '^{_WS}*$')) AS last FROM zl GROUP BY 1
), hd AS (SELECT zl.file_key, regexp_replace(string_agg(h, '0A' ORDER BY k), '{_WS}*$', '') AS x FROM zl JOIN zt ON zt.file_key = zl.file_key AND k <= last GROUP BY 1
), mc AS (SELECT l.file_key, string_agg(CASE WHEN regexp_matches(h, '5C(20|09)*$') THEN regexp_replace(h, '((20|09)*(5C)+(20|09)*)$', '') || '202E2E2E' ELSE regexp_replace(h, '(20|09)+$', '') END, '0A' ORDER BY k) AS x
  FROM l JOIN f ON f.file_key = l.file_key WHERE f.language = 'c' AND regexp_matches(h, '^(20|09)*23(20|09)*646566696E65') AND NOT regexp_matches(h, '^(20|09)*23(20|09)*646566696E65(3[0-9]|[46][1-9A-F]|[57][0-9A]|5F)') GROUP BY 1
), sy AS (SELECT u.*, g.signature, repeat('    ', greatest(coalesce(depth, 0), 0)) AS ind FROM u JOIN g ON g.file = u.file AND g.qualname = u.qualname
  WHERE NOT regexp_matches(u.file, '\\.py$') AND NOT (u.kind = 'declaration' AND EXISTS (SELECT 1 FROM u v WHERE v.kind = 'function' AND v.file = u.file AND v.qualname = u.qualname))
), bl AS (SELECT file, start_line, qualname, CASE WHEN trim(coalesce(existing_doc, ''), ' ') = '' THEN '' ELSE array_to_string(list_transform(string_split(existing_doc, chr(10)), lambda x: rtrim(ind || regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g'), ' ')), chr(10)) || chr(10) END || ind || coalesce(signature, kind || ' ' || qualname) AS b FROM sy
), bd AS (SELECT file, hex(encode(string_agg(b, chr(10) || chr(10) ORDER BY start_line, qualname))) AS x, count(*) AS n_symbols FROM bl GROUP BY 1)
SELECT bd.file, n_symbols, sha256(unhex(array_to_string(list_filter([hd.x, mc.x, bd.x], lambda y: coalesce(y, '') <> ''), '0A0A'))) AS skeleton_sha FROM bd LEFT JOIN hd ON hd.file_key = bd.file LEFT JOIN mc ON mc.file_key = bd.file"""
)
def file_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons of C and JavaScript files: header, macros, documentation and signatures."""
    lines = F.when(F.size("source_lines") > 0, F.transform("source_lines", carried))
    keep = F.when(F.col("language").isin("c", "javascript"), F.struct(lines.alias("lines"), F.col("language").alias("language")))
    f = loading.delivered_once(table(spark, sf_dir, "run_files"), keep.alias("r")).filter("r.lines is not null").select(F.col("file_key").alias("file"), "r.*")
    f = f.withColumn("zone", headers.header_zone(F.col("lines"), F.col("language")))
    s = unique_symbols(table(spark, sf_dir, "symbols"), "kind", "signature", "start_line", "depth", "existing_doc").filter(~F.col("file").endswith(".py"))
    return headers.skeletons(f, written(s, "symbols")).select("file", "n_symbols", F.sha2(F.encode("skeleton", "ISO-8859-1"), 256).alias("skeleton_sha"))
