"""Queries over replies: cleaners, wrapping, the estimate's ratio, tokens of message lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import replies as R
from marlstone.operators import queue
from marlstone.plans.catalog import query
from marlstone.plans.manifest import LATEST, SLOTS
from marlstone.tables import table

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _fence(x: str) -> str:
    """SQL of a reply without its fence."""
    s = _strip(x)
    return f"CASE WHEN regexp_matches({s}, '^```[^\\n]*\\n(.*)\\n```$', 's') THEN {_strip(f'''regexp_extract({s}, '^```[^\\n]*\\n(.*)\\n```$', 1, 's')''')} ELSE {s} END"


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "def", "blocks")
    return queue.slots(q).select("file", "id", "slot", "answer").filter("answer is not null")


_FENCED = f"a AS (SELECT file, id, slot, answer, {_fence('answer')} AS t FROM s WHERE answer IS NOT NULL)"


@query(
    SLOTS
    + f""", {_FENCED}, b AS (SELECT file, id, slot, CASE WHEN starts_with(t, '\"\"\"') AND ends_with(t, '\"\"\"') AND length(t) >= 6 THEN t[4:-4] WHEN starts_with(t, '''''''') AND ends_with(t, '''''''') AND length(t) >= 6 THEN t[4:-4] ELSE t END AS t FROM a
), l AS (SELECT file, id, slot, list_transform(string_split(t, chr(10)), lambda x: CASE WHEN {_strip("x")} = '' THEN '' ELSE x END) AS lines FROM b
), n AS (SELECT file, id, slot, lines, coalesce(list_min(list_transform(list_filter(lines, lambda x: x <> ''), lambda x: length(x) - length(regexp_replace(x, '^[ \\t]+', '')))), 0) AS n FROM l)
SELECT file, id, slot, {_strip("array_to_string(list_transform(lines, lambda x: x[n + 1:]), chr(10))")} AS body FROM n"""
)
def docstring_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select("file", "id", "slot", R.docstring_body(F.col("answer")).alias("body"))


@query(
    SLOTS
    + f""", {_FENCED}, l AS (SELECT file, id, slot, t, list_transform(string_split(t, chr(10)), lambda x: {_strip("x")}) AS lines FROM a
), u AS (SELECT file, id, slot, t, {_strip('''array_to_string(list_transform(list_transform(lines, lambda x: CASE WHEN starts_with(x, '//') OR starts_with(x, '/*') OR starts_with(x, '*/') THEN regexp_replace(x[3:], '^\\s+|\\s+$', '', 'g') ELSE x END), lambda x: CASE WHEN x = '*' THEN '' ELSE x END), chr(10))''')} AS body FROM l)
SELECT file, id, slot, CASE WHEN t = '' OR upper(trim(t, '`\"''* ')) = 'NONE' OR body = '' OR upper(body) = 'NONE' THEN NULL ELSE body END AS body FROM u"""
)
def comment_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select("file", "id", "slot", R.comment_body(F.col("answer"), "c").alias("body"))


@query(
    SLOTS
    + f""", {_FENCED}, l AS (SELECT file, id, slot, coalesce(list_filter(list_transform(string_split(t, chr(10)), lambda x: {_strip("x")}), lambda x: x <> '')[1], '') AS x FROM a
), u AS (SELECT file, id, slot, trim(trim(CASE WHEN starts_with(x, '#') THEN {_strip("x[2:]")} ELSE x END, '`\"''* '), ' ') AS x FROM l)
SELECT file, id, slot, CASE WHEN upper(x) IN ('', 'NONE', 'SKIP', 'N/A', 'TRIVIAL') THEN '' ELSE x END AS summary FROM u"""
)
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select("file", "id", "slot", R.summary_line(F.col("answer"), "python").alias("summary"))


@query(
    SLOTS
    + f""", a AS (SELECT file, id, slot, {_strip("answer")} AS t FROM s WHERE answer IS NOT NULL
), b AS (SELECT file, id, slot, CASE WHEN starts_with(t, '```') THEN {_strip("regexp_replace(regexp_replace(t, '^```[a-zA-Z0-9_-]*\\n?', ''), '\\n?```$', '')")} ELSE t END AS t FROM a
), l AS (SELECT file, id, slot, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_strip("x")}), lambda x: x NOT IN ('/*', '*/', '/**')) AS lines FROM b)
SELECT file, id, slot, {_strip("array_to_string(list_transform(lines, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^/[*]+\\s?', ''), '\\s?[*]+/$', ''), '^([*]|//|#)\\s?', '')), chr(10))")} AS description FROM l"""
)
def description_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select("file", "id", "slot", R.description_body(F.col("answer")).alias("description"))


@query(
    SLOTS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, w AS (SELECT file, id, slot, list_filter(string_split(regexp_replace(answer, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM s WHERE answer IS NOT NULL
), r AS (SELECT file, id, slot, words, 0 AS k, 0 AS n_lines, 0 AS used, 0 AS longest FROM w
  UNION ALL SELECT file, id, slot, words, k + 1, CASE WHEN used > 0 AND used + 1 + length(words[k + 1]) <= 60 THEN n_lines ELSE n_lines + 1 END,
    CASE WHEN used > 0 AND used + 1 + length(words[k + 1]) <= 60 THEN used + 1 + length(words[k + 1]) ELSE length(words[k + 1]) END,
    greatest(longest, CASE WHEN used > 0 AND used + 1 + length(words[k + 1]) <= 60 THEN used + 1 + length(words[k + 1]) ELSE length(words[k + 1]) END) FROM r WHERE k < len(words))
SELECT file, id, slot, n_lines, CAST(longest AS INTEGER) AS longest FROM r WHERE k = len(words)"""
)
def wrapped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _slots(spark, sf_dir).select("file", "id", "slot", R.wrapped(F.col("answer"), 60).alias("w"))
    return s.select("file", "id", "slot", F.size("w").alias("n_lines"), F.coalesce(F.array_max(F.transform("w", lambda x: F.length(x))), F.lit(0)).alias("longest"))


@query(f"""WITH {LATEST}, m AS (SELECT octet_length(encode(snippet)) AS n, length(regexp_replace(snippet, '[^A-Za-z0-9_]+', ' ', 'g')) - length(replace(regexp_replace(snippet, '[^A-Za-z0-9_]+', ' ', 'g'), ' ', '')) AS w FROM q WHERE snippet IS NOT NULL)
SELECT round(sum(n) FILTER (w > 0) / CAST(sum(w) FILTER (w > 0) AS DOUBLE), 6) AS ratio FROM m""")
def recalibrated_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate's ratio, recalibrated to the words of all snippets."""
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "snippet").filter("snippet is not null")
    spaced = F.regexp_replace("snippet", "[^A-Za-z0-9_]+", " ")
    words = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return q.agg(F.round(R.bytes_per_token(F.col("snippet"), words), 6).alias("ratio"))


@query(f"""WITH {LATEST} SELECT file, id, CAST(ceil(octet_length(encode(coalesce(snippet, ''))) / 2.0) + 4 + ceil(octet_length(encode(coalesce(def.answer, ''))) / 2.0) + 4 AS BIGINT) AS n_tokens FROM q""")
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "snippet", "def")
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return q.select("file", "id", R.message_tokens(F.array(m("user", F.col("snippet")), m("assistant", F.col("def.answer"))), framing=4).alias("n_tokens"))
