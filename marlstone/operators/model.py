"""The text-writing model behind a batch function, and what is built around it: answers and hierarchical summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import estimated_tokens, looks_listy, without_list_markers
from marlstone.operators.windows import chunks, groups
from marlstone.tables import written

#: A backend answers a batch of prompts; it is made once in each Python worker.
Backend = Callable[[list[str]], list[str]]
#: Tokens kept free for a reply, by its length.
REPLY = {"line": 64, "paragraph": 200, "paragraphs": 512}


def stub() -> Backend:
    """A model that needs none: the first line of the prompt's last part, cut to eighty characters."""
    return lambda prompts: [(p or "").rpartition("\n\n")[2].strip().split("\n")[0][:80] for p in prompts]


def generated(rows: DataFrame, prompt: str, reply: str = "reply", backend: Callable[[], Backend] = stub) -> DataFrame:
    """Rows with a reply to the prompt column; a null prompt has a null reply. Equal prompts are asked once a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([f for f in rows.schema.fields if f.name != reply] + [StructField(reply, StringType())])
    rows = rows.drop(reply)
    names = to_arrow_schema(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = backend()
        for b in batches:
            prompts = b.column(names.index(prompt)).to_pylist()
            distinct = list(dict.fromkeys(p for p in prompts if p is not None))
            got = dict(zip(distinct, ask(distinct) if distinct else []))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([got.get(p) for p in prompts], pa.string())], names=names)

    return rows.mapInArrow(run, schema)


def snippet_budget(context: int, reply: str, fixed: int = 0) -> int:
    """Tokens left for a snippet: the context without the reply's room and the fixed part; 0 at least."""
    return max(0, context - REPLY[reply] - fixed)


def summaries(texts: DataFrame, key: str, text: str, budget: int, backend: Callable[[], Backend] = stub, most_rounds: int = 24) -> DataFrame:
    """(key, summary): chunks are summarised, the summaries merged in groups within the budget until one is left.

    Every round shrinks the list of a text, so rounds are few; texts that are done leave the loop. A text within the
    budget is summarised at once; a null one has a null summary. Replies that are lists lose their marks.
    """
    ask = lambda df: generated(df, "prompt", backend=backend)
    parts = texts.select(F.col(key).alias("k"), F.posexplode_outer(chunks(F.split(text, "\n"), budget)).alias("part", "body"))
    none = parts.filter("body is null").select("k", F.lit(None).cast("string").alias("summary"))
    now = parts.filter("body is not null").select("k", "part", F.concat(F.lit("Summarise this part.\n\n"), "body").alias("prompt"))
    done = none
    for _ in range(most_rounds):
        said = written(ask(now).select("k", "part", "reply"), "summaries")
        lists = said.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "reply"))).alias("r"))
        done = done.unionByName(lists.filter("size(r) = 1").select("k", F.col("r")[0]["reply"].alias("summary")))
        left = lists.filter("size(r) > 1")
        if left.isEmpty():
            break
        costs = F.transform("r", lambda x: estimated_tokens(x["reply"]))
        fit = (F.size("r") <= 2) | (F.aggregate(costs, F.lit(0), lambda a, c: a + c + 8) <= budget)
        number = F.when(fit, F.transform("r", lambda x: F.lit(0))).otherwise(groups(costs, budget))
        rows = left.select("k", F.explode(F.arrays_zip("r.part", "r.reply", number.alias("g"))).alias("x")).select("k", "x.g", F.struct("x.part", "x.reply").alias("p"))
        merged = rows.groupBy("k", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["reply"]), "\n").alias("body"))
        now = merged.select("k", F.col("g").alias("part"), F.concat(F.lit("Merge these summaries.\n\n"), "body").alias("prompt"))
    else:
        raise RuntimeError("rounds ran out")
    clean = F.when(looks_listy(F.col("summary")), without_list_markers(F.col("summary"))).otherwise(F.col("summary"))
    return done.select(F.col("k").alias(key), clean.alias("summary"))
