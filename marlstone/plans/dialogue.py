"""Queries around the model: priming, verified documentation, notes, one-liners. The model is a stub unless one is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import chat
from marlstone.functions import text as T
from marlstone.operators import dialogue, graph, queue
from marlstone.operators.order import dependency_order
from marlstone.plans.catalog import query
from marlstone.plans.graph import CONTRACTS, RESOLVED, _called, _contracts, _precedence_nodes
from marlstone.plans.manifest import LATEST
from marlstone.tables import table, written

_LINE1 = "coalesce(list_filter(list_transform(regexp_split_to_array(coalesce({}, ''), '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], '{}')"


@query(
    f"""WITH {LATEST}, p AS (SELECT file, id, 'Document routines.' AS s, 'The file is ' || regexp_extract(file, '[^/]*$', 0) || '.' AS who, {_LINE1.format("blocks.doc_summary", "")} AS sum, coalesce(snippet, '') AS task FROM q
), t AS (SELECT file, id, '<|im_start|>system' || chr(10) || s || '<|im_end|>' || '<|im_start|>user' || chr(10) || who || '<|im_end|><|im_start|>assistant' || chr(10) || 'Understood.<|im_end|>'
  || '<|im_start|>user' || chr(10) || regexp_replace('An overview of what the program does:' || chr(10) || chr(10) || sum, '\\s+$', '') || '<|im_end|><|im_start|>assistant' || chr(10) || 'Understood.<|im_end|>'
  || CASE WHEN regexp_replace(task, '\\s+', '', 'g') <> '' THEN '<|im_start|>user' || chr(10) || regexp_replace(task, '^\\s+|\\s+$', '', 'g') || '<|im_end|>' ELSE '' END || '<|im_start|>assistant' || chr(10) || 'Understood.<|im_end|><|im_start|>assistant' || chr(10) AS p FROM p)
SELECT file, id, sha256(p) AS prompt_sha FROM t"""
)
def priming_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "snippet", F.col("blocks.doc_summary").alias("summary"))
    who = F.concat(F.lit("The file is "), F.regexp_extract("file", "([^/]*)$", 1), F.lit("."))
    m = dialogue.priming(q, F.lit("Document routines."), T.first_line(F.col("summary")), F.col("snippet"), who)
    return m.select("file", "id", F.sha2(chat.prompt(F.col("messages"), "chatml"), 256).alias("prompt_sha"))


#: What the stub says to a prompt: the first line of its last part, cut to eighty characters.
_SAYS = "left(split_part(regexp_replace(string_split({p}, chr(10) || chr(10))[-1], '^\\s+|\\s+$', '', 'g'), chr(10), 1), 80)"


@query(
    RESOLVED
    + CONTRACTS
    + f""", {LATEST}, m AS (SELECT DISTINCT callee_file AS file, callee AS qualname FROM edges e WHERE NOT EXISTS (SELECT 1 FROM contracts c WHERE c.file = e.callee_file AND c.qualname = e.callee AND c.contract <> '')
), k AS (SELECT file, qualname, min(snippet) AS code FROM q WHERE snippet IS NOT NULL GROUP BY ALL
), a AS (SELECT m.file, m.qualname, {_SAYS.format(p="('Say in one line what this routine does.' || chr(10) || chr(10) || code)")} AS reply FROM m JOIN k ON k.file = m.file AND k.qualname = m.qualname)
SELECT file, qualname, {_LINE1.format("reply", "")} AS contract FROM a"""
)
def callee_one_liners(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _called(spark, sf_dir)
    missing = graph.missing_contracts(graph.call_edges(s), _contracts(s))
    code = queue.first_deliveries(table(spark, sf_dir, "requests"), "qualname", "snippet").filter("snippet is not null").select("file", "qualname", F.col("snippet").alias("code"))
    return dialogue.one_liners(missing, code)


@query(
    f"""WITH {LATEST}, w AS (SELECT file, id, snippet FROM q WHERE snippet IS NOT NULL AND def IS NOT NULL AND regexp_replace(coalesce(def.answer, ''), '\\s+', '', 'g') = ''
), a AS (SELECT file, id, snippet, {_SAYS.format(p="('Document this routine for its callers.' || chr(10) || chr(10) || snippet)")} AS d FROM w)
SELECT file, id, CASE WHEN regexp_replace(d, '\\s+', '', 'g') = '' THEN '(no documentation could be written)' ELSE regexp_replace(d, '^\\s+|\\s+$', '', 'g') END AS doc FROM a"""
)
def drafted_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documentation of open definitions, with the stub's words; verified_docs has the status as well."""
    return verified_docs(spark, sf_dir).select("file", "id", "doc")


@query()
def verified_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "snippet", "def").filter(F.col("snippet").isNotNull() & F.col("def").isNotNull() & queue.blank(F.col("def.answer")))
    return dialogue.definition_docs(q, ["file", "id"], "snippet")


@query()
def verified_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes for the open chunks of all requests, from the lines of each chunk."""
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "snippet", "blocks").filter("snippet is not null")
    c = q.select("file", "id", F.split("snippet", "\n").alias("lines"), F.explode("blocks.chunks").alias("c")).filter(queue.blank(F.col("c.answer")) & F.col("c.lines").isNotNull())
    code = F.array_join(F.slice("lines", F.col("c.lines")[0], F.greatest(F.col("c.lines")[1] - F.col("c.lines")[0] + 1, F.lit(0))), "\n")
    return dialogue.block_notes(c.select("file", "id", F.col("c.bidx").alias("bidx"), code.alias("code")), ["file", "id", "bidx"])


@query()
def staged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation of open definitions from the leaves up: what callees came to is a note in their callers' prompts."""
    from marlstone.operators.model import generated

    s = _called(spark, sf_dir)
    edges = written(graph.call_edges(s), "edges")
    o = dependency_order(_precedence_nodes(s)).select(F.split("node", "\n")[0].alias("file"), F.split("node", "\n")[1].alias("qualname"), "level")
    q = queue.first_deliveries(table(spark, sf_dir, "requests"), "qualname", "snippet", "def").filter(F.col("snippet").isNotNull() & F.col("def").isNotNull() & queue.blank(F.col("def.answer")))
    rows = q.select("file", "qualname", "id", "snippet").dropDuplicates(["file", "qualname"])

    def step(level: DataFrame, done: DataFrame | None) -> DataFrame:
        known = _contracts(s).filter("contract <> ''")
        if done is not None:  # what was written in this run counts before what was there
            new = done.select("file", "qualname", F.col("contract"))
            known = known.join(new.select("file", "qualname"), ["file", "qualname"], "left_anti").unionByName(new)
        notes = graph.callee_notes(edges, known).select("file", F.col("caller").alias("qualname"), "notes")
        asked = level.join(notes, ["file", "qualname"], "left").withColumn("prompt", F.concat_ws("\n\n", F.lit("Document the routine."), "notes", "snippet"))
        return generated(asked, "prompt").select("file", "qualname", "id", "prompt", T.first_line(F.col("reply")).alias("contract"))

    return dialogue.staged(rows, o, step, 8).select("file", "qualname", "id", F.sha2("prompt", 256).alias("prompt_sha"), "contract")
