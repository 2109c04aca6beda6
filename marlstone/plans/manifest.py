"""Queries over requests: slots, completeness, claims, merges, snippets and chat prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import chat
from marlstone.functions import text as T
from marlstone.operators import definitions, loading, queue
from marlstone.plans.catalog import query
from marlstone.tables import table, written

#: The first delivery of each (file, id); a struct keeps null columns.
LATEST = """q AS (SELECT DISTINCT ON (file, id) * FROM requests ORDER BY file, id, received_at NULLS LAST, issued_at NULLS LAST)"""
SLOTS = f"""WITH {LATEST}, s AS (
  SELECT file, id, 'def' AS slot, def.answer AS answer FROM q WHERE def IS NOT NULL
  UNION ALL SELECT file, id, 'b' || c.bidx, c.answer FROM (SELECT file, id, unnest(blocks.chunks) AS c FROM q))"""
BLANK = "regexp_replace(coalesce({}, ''), '\\s+', '', 'g') = ''"
WAITS = f"((def IS NOT NULL AND {BLANK.format('def.answer')}) OR coalesce(len(list_filter(blocks.chunks, lambda c: {BLANK.format('c.answer')})) > 0, false))"


def _latest(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    return queue.first_deliveries(table(spark, sf_dir, "requests"), *columns)


@query(SLOTS + " SELECT file, id, slot, answer FROM s")
def answer_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.slots(_latest(spark, sf_dir, "def", "blocks")).select("file", "id", "slot", "answer")


@query(SLOTS + f" SELECT count(*) AS n_slots, count(*) FILTER ({BLANK.format('answer')}) AS n_unfilled, count(DISTINCT file) AS n_files FROM s")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = queue.slots(_latest(spark, sf_dir, "def", "blocks")).select("file", queue.blank(F.col("answer")).alias("open"))
    by_file = s.groupBy("file").agg(F.count("*").alias("n"), F.count_if("open").alias("open"))
    return by_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_slots"), F.coalesce(F.sum("open"), F.lit(0)).alias("n_unfilled"), F.count("*").alias("n_files"))


@query(SLOTS + f" SELECT id || ':' || slot AS label, file FROM s WHERE {BLANK.format('answer')}")
def unfilled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = queue.slots(_latest(spark, sf_dir, "def", "blocks")).filter(queue.blank(F.col("answer")))
    return s.select(F.concat("id", F.lit(":"), "slot").alias("label"), "file")


@query(f"WITH {LATEST} SELECT count(*) FILTER (fragment IS NOT NULL) AS n_claimed, count(*) FILTER (fragment IS NOT NULL AND {WAITS}) AS n_outstanding, count(DISTINCT fragment) AS n_fragments FROM q")
def outstanding_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _latest(spark, sf_dir, "fragment", queue.unfilled(F.col("def"), F.col("blocks")).alias("waits"))
    return q.agg(F.count("fragment").alias("n_claimed"), F.count_if(F.col("fragment").isNotNull() & F.col("waits")).alias("n_outstanding"), F.countDistinct("fragment").alias("n_fragments"))


@query(
    f"""WITH {LATEST}, w AS (SELECT file, id, row_number() OVER (ORDER BY issued_at NULLS FIRST, file, id) AS rank FROM q WHERE {WAITS} AND fragment IS NULL)
SELECT file, id, rank, CAST((rank - 1) // 8 AS BIGINT) AS batch FROM w"""
)
def claim_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.batches(_latest(spark, sf_dir, "def", "blocks", "fragment", "issued_at"), 8)


@query(f"WITH {LATEST} SELECT file, id, CASE WHEN NOT {WAITS} THEN fragment END AS fragment FROM q")
def released_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.released(_latest(spark, sf_dir, "def", "blocks", "fragment")).select("file", "id", "fragment")


@query(
    f"""WITH {LATEST}, o AS (SELECT file, id, snippet FROM q WHERE snippet IS NOT NULL), k AS (SELECT snippet, arg_min({{'id': id, 'file': file}}, (id, file)) AS k FROM o GROUP BY snippet)
SELECT o.file, o.id, CASE WHEN k.k.id = o.id AND k.k.file = o.file THEN o.snippet END AS snippet, CASE WHEN NOT (k.k.id = o.id AND k.k.file = o.file) THEN k.k.id END AS snippet_ref FROM o JOIN k ON k.snippet = o.snippet"""
)
def shared_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.shared_snippets(_latest(spark, sf_dir, "snippet"))


@query(
    f"""WITH {LATEST}, k AS (SELECT id, min(snippet) AS found FROM requests WHERE snippet IS NOT NULL GROUP BY id)
SELECT q.file, q.id, coalesce(q.snippet, k.found) AS snippet FROM q LEFT JOIN k ON k.id = q.snippet_ref"""
)
def inlined_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.inlined_snippets(_latest(spark, sf_dir, "snippet", "snippet_ref"), table(spark, sf_dir, "requests"))


@query(
    f"""WITH s AS (
  SELECT file, id, fragment, received_at AS came, 'def' AS slot, def.answer AS answer FROM requests WHERE def IS NOT NULL
  UNION ALL SELECT file, id, fragment, came, 'b' || c.bidx, c.answer FROM (SELECT file, id, fragment, received_at AS came, unnest(blocks.chunks) AS c FROM requests)
), f AS (SELECT *, row_number() OVER (PARTITION BY file, id, slot ORDER BY {BLANK.format('answer')}, fragment IS NOT NULL, coalesce(fragment, ''), came IS NULL, came, answer) AS k FROM s)
SELECT file, id, slot, CASE WHEN NOT ({BLANK.format('answer')}) THEN answer END AS answer FROM f WHERE k = 1"""
)
def merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.merged_answers(table(spark, sf_dir, "requests"))


#: Of each definition the hash of its lines.
HASHES = f"""f AS (SELECT file_key, arg_max({{'v': source_lines}}, (loaded_at, path)).v AS source_lines FROM run_files GROUP BY file_key
), spans AS (SELECT DISTINCT file, qualname, start_line, end_line FROM symbols WHERE start_line >= 1 AND end_line >= start_line
), hashes AS (SELECT s.file, s.qualname, s.start_line, substr(sha256(unhex(array_to_string(list_transform(f.source_lines[s.start_line:s.end_line], lambda x: hex(x)), '0A'))), 1, 16) AS text_hash
  FROM spans s JOIN f ON f.file_key = s.file WHERE s.end_line <= len(f.source_lines))"""


@query(f"WITH {HASHES} SELECT file, qualname, start_line, text_hash FROM hashes")
def routine_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = loading.delivered_once(table(spark, sf_dir, "run_files"), "source_lines")
    return definitions.routine_hashes(files, table(spark, sf_dir, "symbols"))


@query(
    f"""WITH {LATEST}, {HASHES}, live AS (SELECT file, qualname, text_hash, min(start_line) AS start_line FROM hashes GROUP BY ALL
), a AS (SELECT file, qualname, sig_hash, def.answer AS answer, row_number() OVER (PARTITION BY file, qualname, sig_hash ORDER BY coalesce(issued_at, TIMESTAMP '1970-01-01') DESC, id DESC) AS k FROM q WHERE def IS NOT NULL)
SELECT live.file, live.qualname, live.start_line, a.answer FROM live JOIN a ON a.file = live.file AND a.qualname = live.qualname AND a.sig_hash = live.text_hash AND a.k = 1"""
)
def rebound_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _latest(spark, sf_dir, "qualname", "sig_hash", "def", "issued_at")
    return queue.rebound(q, routine_hashes(spark, sf_dir))


@query(
    f"""WITH {LATEST}, {HASHES} SELECT q.file, q.id, q.qualname FROM q WHERE def IS NOT NULL AND file IN (SELECT file FROM hashes)
AND NOT EXISTS (SELECT 1 FROM hashes h WHERE h.file = q.file AND h.qualname = q.qualname AND h.text_hash = q.sig_hash)"""
)
def stale_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for definitions of live files whose text has changed since."""
    live = written(routine_hashes(spark, sf_dir), "hashes")
    q = _latest(spark, sf_dir, "qualname", "sig_hash", F.col("def").isNotNull().alias("asks")).filter("asks")
    q = q.join(live.select("file").distinct(), "file", "left_semi")
    return q.join(live.select("file", "qualname", F.col("text_hash").alias("sig_hash")), ["file", "qualname", "sig_hash"], "left_anti").select("file", "id", "qualname")


@query(
    f"""WITH {LATEST}, s AS (SELECT file, id, generate_subscripts(blocks.stmt_lines, 1) - 1 AS ordinal, unnest(blocks.stmt_lines) AS line FROM q
), i AS (SELECT file, id, e.key AS key, e.value AS text FROM (SELECT file, id, unnest(map_entries(blocks.insertions)) AS e FROM q))
SELECT DISTINCT s.file, s.id, CAST(s.ordinal AS INTEGER) AS ordinal, s.line, i.text FROM s JOIN i ON i.file = s.file AND i.id = s.id AND TRY_CAST(i.key AS INTEGER) = s.line"""
)
def statement_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.statement_insertions(_latest(spark, sf_dir, "blocks"))


@query(
    f"""WITH {LATEST} SELECT file, id, 'fn:' || qualname || ':' || sig_hash AS request_id, id = 'fn:' || qualname || ':' || sig_hash AS same,
  substr(sha256(snippet), 1, 16) AS text_hash FROM q"""
)
def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _latest(spark, sf_dir, "qualname", "sig_hash", "snippet")
    rid = T.request_id(F.col("qualname"), F.col("sig_hash"))
    return q.select("file", "id", rid.alias("request_id"), (F.col("id") == rid).alias("same"), T.text_hash(F.col("snippet")).alias("text_hash"))


@query(SLOTS + """, t AS (SELECT file, id, slot, answer, lower(regexp_replace(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), '[.!]+$', '')) AS a,
  upper(regexp_replace(regexp_replace(split_part(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), chr(10), 1), '^\\s+|\\s+$', '', 'g'), '^[`"''*.: ]+|[`"''*.: ]+$', '', 'g')) AS head FROM s WHERE answer IS NOT NULL)
SELECT file, id, slot, head LIKE 'NONE%' AS declines,
  a IN ('ok', 'okay', 'understood', 'ready', 'sure', 'yes', 'done', 'got it', 'acknowledged') OR (NOT contains(answer, chr(10)) AND length(a) < 60 AND regexp_matches(a, '^(understood|acknowledged|okay|ok,|ok |got it)')) AS acknowledges,
  CASE WHEN regexp_extract(answer, '[0-9]', 0) = '' THEN 2 ELSE least(3, greatest(1, CAST(regexp_extract(answer, '[0-9]', 0) AS INTEGER))) END AS score FROM t""")
def reply_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = queue.slots(_latest(spark, sf_dir, "def", "blocks")).filter("answer is not null")
    a = F.col("answer")
    return s.select("file", "id", "slot", T.declines(a).alias("declines"), T.acknowledges(a).alias("acknowledges"), T.score(a).alias("score"))


_CONTENTS = """, m AS (SELECT file, id, regexp_replace(coalesce(snippet, ''), '^\\s+|\\s+$', '', 'g') AS u, regexp_replace(coalesce(def.answer, ''), '^\\s+|\\s+$', '', 'g') AS a FROM q),
p AS (SELECT file, id, 'Document the routine.' AS s, u, a FROM m)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    q = _latest(spark, sf_dir, "snippet", "def")
    return q.select("file", "id", F.array(m("system", F.lit(" Document the routine. ")), m("user", F.col("snippet")), m("assistant", F.col("def.answer")), m("tool", F.lit("x")), m("user", F.lit("Shorter."))).alias("messages"))


def _prompts(name: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = chat.prompt(F.col("messages"), name)
        return _messages(spark, sf_dir).select("file", "id", F.sha2(p, 256).alias("prompt_sha"), T.estimated_tokens(p).alias("n_tokens"))

    return f


def _tagged_sql(before: str, between: str, after: str, end: str) -> str:
    turn = lambda role, c: f"'{before}{role}{between}' || {c} || '{after}'"
    text = f"{turn('system', 's')} || CASE WHEN u <> '' THEN {turn('user', 'u')} ELSE '' END || CASE WHEN a <> '' THEN {turn('assistant', 'a')} ELSE '' END || " + turn("user", "'Shorter.'") + f" || '{end}'"
    text = text.replace("\n", "' || chr(10) || '")
    return f"WITH {LATEST}{_CONTENTS}, t AS (SELECT file, id, {text} AS p FROM p) SELECT file, id, sha256(p) AS prompt_sha, CAST(ceil(octet_length(encode(p)) / 2.0) AS INTEGER) AS n_tokens FROM t"


def _instructed_sql(system: bool) -> str:
    sys = "'<<SYS>>' || chr(10) || s || chr(10) || '<</SYS>>' || chr(10) || chr(10) || " if system else ""
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    block = lambda x: f"'[INST] ' || {strip(x)} || ' [/INST]'"
    answered = f"{block(sys + 'u')} || a || {block(chr(39) + 'Shorter.' + chr(39))}"
    asked = f"CASE WHEN u <> '' THEN {block('u')} ELSE '' END || {block(sys + chr(39) + 'Shorter.' + chr(39))}"
    return f"WITH {LATEST}{_CONTENTS}, t AS (SELECT file, id, CASE WHEN a <> '' THEN {answered} ELSE {asked} END AS p FROM p) SELECT file, id, sha256(p) AS prompt_sha, CAST(ceil(octet_length(encode(p)) / 2.0) AS INTEGER) AS n_tokens FROM t"


query(_tagged_sql("<|im_start|>", "\n", "<|im_end|>", "<|im_start|>assistant\n"), "chat_chatml")(_prompts("chatml"))
query(_tagged_sql("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n"), "chat_llama3")(_prompts("llama3"))
query(_tagged_sql("<|", "|>\n", "<|end|>\n", "<|assistant|>\n"), "chat_phi3")(_prompts("phi3"))
query(_instructed_sql(True), "chat_llama2")(_prompts("llama2"))
query(_instructed_sql(False), "chat_mistral")(_prompts("mistral"))


@query(
    SLOTS
    + """, w AS (SELECT DISTINCT file, id, slot, unnest(regexp_extract_all(span, '\\w{2,}')) AS word FROM (SELECT file, id, slot, unnest(regexp_extract_all(answer, '`([^`]*)`', 1)) AS span FROM s)
), corpus AS (SELECT DISTINCT unnest(regexp_extract_all(snippet, '\\w{2,}')) AS word FROM requests WHERE snippet IS NOT NULL
), miss AS (SELECT DISTINCT word FROM w WHERE NOT EXISTS (SELECT 1 FROM corpus c WHERE contains(c.word, w.word)))
SELECT w.file, w.id, w.slot, string_agg(word, ',' ORDER BY word) AS ungrounded FROM w WHERE word IN (SELECT word FROM miss) GROUP BY ALL"""
)
def ungrounded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.operators.grounding import ungrounded

    s = queue.slots(_latest(spark, sf_dir, "def", "blocks"))
    corpus = table(spark, sf_dir, "requests").filter("snippet is not null").select("snippet")
    return ungrounded(s, ["file", "id", "slot"], "answer", corpus, "snippet")
