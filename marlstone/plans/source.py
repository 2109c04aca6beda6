"""Queries that join sources, symbols and requests, and those around the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import chat
from marlstone.functions import text as T
from marlstone.operators import definitions, loading, model, queue
from marlstone.plans.catalog import query
from marlstone.plans.files import BLANK, COMMENT, ONCE
from marlstone.plans.manifest import LATEST, WAITS
from marlstone.tables import table


@query(
    f"""WITH {ONCE}, l AS (SELECT file_key, language, len(source_lines) AS n, generate_subscripts(source_lines, 1) AS line_no, hex(unnest(source_lines)) AS h FROM f WHERE language IS NOT NULL
), s AS (SELECT DISTINCT file, qualname, start_line FROM symbols WHERE start_line > 1
), c AS (SELECT s.file, s.qualname, s.start_line, max(line_no) FILTER (regexp_matches(h, {BLANK}) OR NOT {COMMENT}) AS stop FROM s JOIN l ON l.file_key = s.file AND l.line_no < s.start_line AND s.start_line - 1 <= l.n GROUP BY ALL)
SELECT file, qualname, start_line, CAST(coalesce(stop, 0) + 1 AS INTEGER) AS first_comment FROM c WHERE coalesce(stop, 0) + 1 < start_line"""
)
def comments_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.when(F.col("language").isNotNull(), definitions.comment_flags(F.col("source_lines"), F.col("language")))
    files = loading.delivered_once(table(spark, sf_dir, "run_files"), plain.alias("comment"))
    return definitions.comments_above(files, table(spark, sf_dir, "symbols"))


@query(
    f"""WITH {LATEST}, c AS (SELECT file, id, string_split(snippet, chr(10)) AS lines, unnest(blocks.chunks) AS chunk FROM q WHERE snippet IS NOT NULL
), r AS (SELECT file, id, chunk.bidx AS bidx, lines, chunk.lines[1] AS a, chunk.lines[2] AS b FROM c
), i AS (SELECT *, length(coalesce(lines[a], '')) - length(ltrim(coalesce(lines[a], ''), ' ')) AS base FROM r
), o AS (SELECT file, id, bidx, lines, a, b, list_max(list_filter(range(greatest(1, a - 24), a), lambda k: trim(lines[k], ' ') <> '' AND length(lines[k]) - length(ltrim(lines[k], ' ')) < base)) AS up FROM i)
SELECT file, id, bidx, CAST(least(greatest(1, a - 8), coalesce(up, greatest(1, a - 8))) AS INTEGER) AS first, CAST(least(len(lines), b + 8) AS INTEGER) AS last FROM o"""
)
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "snippet", "blocks").filter("snippet is not null")
    c = q.select("file", "id", F.split("snippet", "\n").alias("lines"), F.explode("blocks.chunks").alias("c"))
    w = definitions.context_window(F.col("lines"), F.col("c.lines")[0], F.col("c.lines")[1])
    return c.select("file", "id", F.col("c.bidx").alias("bidx"), w.alias("w")).select("file", "id", "bidx", "w.first", "w.last")


@query(f"WITH {LATEST}, {ONCE} SELECT f.file_key, count(*) AS n_requests, count(*) FILTER ({WAITS}) AS n_waiting FROM f JOIN q ON q.file = f.file_key GROUP BY 1")
def requests_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = queue.unfilled(F.col("def"), F.col("blocks"))
    n = queue.first_deliveries(table(spark, sf_dir, "requests"), waits.alias("waits")).groupBy(F.col("file").alias("file_key")).agg(F.count("*").alias("n_requests"), F.count_if("waits").alias("n_waiting"))
    return n.join(table(spark, sf_dir, "run_files").select("file_key").distinct(), "file_key", "left_semi")


@query("SELECT DISTINCT file_key FROM run_files WHERE is_target AND file_key NOT IN (SELECT file FROM symbols)")
def targets_without_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "run_files").filter("is_target").select("file_key").distinct()
    return t.join(table(spark, sf_dir, "symbols").select(F.col("file").alias("file_key")).distinct(), "file_key", "left_anti")


@query(
    f"""WITH {LATEST} SELECT file, qualname, sig_hash, count(*) AS n_requests, bool_or(def IS NOT NULL) AS has_def, CAST(coalesce(sum(len(blocks.chunks)), 0) AS BIGINT) AS n_chunks, min(id) AS id FROM q GROUP BY ALL"""
)
def merged_routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    has, chunks = F.col("def").isNotNull().alias("has"), F.when(F.col("blocks.chunks").isNotNull(), F.size("blocks.chunks")).alias("chunks")
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "qualname", "sig_hash", has, chunks)
    n = F.sum("chunks")
    return q.groupBy("file", "qualname", "sig_hash").agg(F.count("*").alias("n_requests"), F.max("has").alias("has_def"), F.coalesce(n, F.lit(0)).cast("long").alias("n_chunks"), F.min("id").alias("id"))


@query(
    r"""WITH s AS (SELECT DISTINCT file, qualname, start_line, signature FROM symbols WHERE signature IS NOT NULL)
SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(signature, '\s+', ' ', 'g'), '[A-Za-z_]\w*\(', 'f(', 'g'), '\b[A-Za-z_]\w*\b', 'v', 'g'), '[0-9]+', '0', 'g') AS pattern, count(*) AS n FROM s GROUP BY 1"""
)
def signature_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols").select("file", "qualname", "start_line", "signature").filter("signature is not null").distinct()
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("signature", r"\s+", " "), r"[A-Za-z_]\w*\(", "f("), r"\b[A-Za-z_]\w*\b", "v"), "[0-9]+", "0")
    return s.groupBy(p.alias("pattern")).agg(F.count("*").alias("n"))


@query("SELECT file, arg_max(qualname, (depth, end_line - start_line, -start_line, qualname)) AS qualname FROM symbols WHERE end_line IS NOT NULL GROUP BY file")
def deepest_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols").filter("end_line is not null")
    return s.groupBy("file").agg(F.max_by("qualname", F.struct("depth", F.col("end_line") - F.col("start_line"), -F.col("start_line"), "qualname")).alias("qualname"))


@query(
    f"""WITH {LATEST}, t AS (SELECT file, id, CAST(ceil(octet_length(encode(snippet)) / 2.0) AS INTEGER) AS n_tokens FROM q WHERE snippet IS NOT NULL)
SELECT file, id, n_tokens, 512 - 200 - 40 AS budget, n_tokens > 512 - 200 - 40 AS over FROM t"""
)
def snippet_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = model.snippet_budget(512, "paragraph", 40)
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), T.estimated_tokens(F.col("snippet")).alias("n_tokens")).filter("n_tokens is not null")
    return q.select("file", "id", "n_tokens", F.lit(budget).alias("budget"), (F.col("n_tokens") > budget).alias("over"))


_MODELS = "(VALUES ('Qwen2.5-7B.gguf'), ('Meta-Llama-3-8B.gguf'), ('llama-2-13b.gguf'), ('mistral-7b.gguf'), ('Mixtral-8x7B.gguf'), ('Phi-3-mini.gguf'), ('other.gguf')) AS m(model)"


@query(
    f"""SELECT model, CASE WHEN regexp_matches(lower(model), 'qwen') THEN 'chatml' WHEN regexp_matches(lower(model), 'llama-?_?3') THEN 'llama3' WHEN regexp_matches(lower(model), 'mi[sx]tral') THEN 'mistral'
  WHEN regexp_matches(lower(model), 'phi-?3') THEN 'phi3' WHEN regexp_matches(lower(model), 'llama') THEN 'llama2' ELSE 'chatml' END AS format FROM {_MODELS}"""
)
def chat_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT model FROM {_MODELS}").select("model", chat.format_of(F.col("model")).alias("format"))


@query()
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions.source_symbols(table(spark, sf_dir, "run_files"))


@query()
def lexed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = definitions.lexed_definitions(table(spark, sf_dir, "run_files"), ("c", "javascript"))
    return found.select("file", "qualname", "kind", "signature", "start_line", "end_line", "own_doc", "calls").dropDuplicates(["file", "qualname", "start_line"])


@query()
def definition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the definitions read from sources are those of the symbols table, over the files that have symbols.

    Lines with several definitions (minified sources, which the table leaves out) count on neither side.
    """
    symbols = table(spark, sf_dir, "symbols").select("file", "qualname", "kind", "start_line").distinct()
    own = definitions.source_symbols(table(spark, sf_dir, "run_files")).select("file", "qualname", "kind", "start_line")
    crowded = own.groupBy("file", "start_line").agg(F.count("*").alias("n")).filter("n > 1")
    own = own.join(symbols.select("file").distinct(), "file", "left_semi").join(crowded, ["file", "start_line"], "left_anti")
    symbols = symbols.join(crowded, ["file", "start_line"], "left_anti")
    out = None
    for language, ending in (("python", r"\.py$"), ("c", r"\.[ch]$"), ("javascript", r"\.[cm]?js$")):
        of = F.col("file").rlike(ending)
        one = definitions.scores(own.filter(of), symbols.filter(of), ["file", "qualname", "kind", "start_line"]).withColumn("language", F.lit(language))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.summaries(table(spark, sf_dir, "documents"), "doc_id", "text", 200)


@query(
    f"""WITH {LATEST}, w AS (SELECT file, id, coalesce(snippet, '') AS s FROM q WHERE {WAITS}
), p AS (SELECT file, id, '<|im_start|>system' || chr(10) || 'Document the routine.<|im_end|>' || CASE WHEN regexp_replace(s, '\\s+', '', 'g') <> '' THEN '<|im_start|>user' || chr(10) || regexp_replace(s, '^\\s+|\\s+$', '', 'g') || '<|im_end|>' ELSE '' END || '<|im_start|>assistant' || chr(10) AS p FROM w)
SELECT file, id, left(split_part(regexp_replace(string_split(p, chr(10) || chr(10))[-1], '^\\s+|\\s+$', '', 'g'), chr(10), 1), 80) AS reply FROM p"""
)
def drafted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "snippet", "def", "blocks").filter(queue.unfilled(F.col("def"), F.col("blocks")))
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    p = chat.prompt(F.array(m("system", F.lit("Document the routine.")), m("user", F.col("snippet"))), "chatml")
    return model.generated(q.select("file", "id", p.alias("prompt")), "prompt").select("file", "id", "reply")


@query()
def structurally_elided(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.operators.elision import structurally_elided as elide

    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "snippet").filter(F.col("snippet").isNotNull() & F.col("file").endswith(".py"))
    e = q.select("file", "id", "snippet", elide(F.col("snippet"), 150).alias("elided"))
    return e.select("file", "id", "elided", T.estimated_tokens(F.col("snippet")).alias("n_before"), T.estimated_tokens(F.col("elided")).alias("n_after"))
