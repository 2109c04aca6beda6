"""The work queue of answer requests: slots, claims, batches, merges and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.tables import written


def blank(c: Column) -> Column:
    """Whether an answer is missing: null or only white space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "") == ""


def first_deliveries(requests: DataFrame, *columns: str) -> DataFrame:
    """(file, id, columns): of each (file, id) the first delivery; without columns, all of them.

    Rows without received_at come last. Name the columns that a query needs: the others are neither read nor shuffled.
    """
    order = F.struct(F.col("received_at").isNull(), F.col("received_at"), F.col("issued_at").isNull(), F.col("issued_at"))
    rows = requests.select("file", "id", order.alias("order"), F.struct(*(columns or [c for c in requests.columns if c not in ("file", "id")])).alias("r"))
    return rows.groupBy("file", "id").agg(F.min_by("r", "order").alias("r")).select("file", "id", "r.*")


def slots(requests: DataFrame) -> DataFrame:
    """(file, id, slot, answer) of every slot: `def`, and `b` with the chunk's number; preserve and anchor with it."""
    d = requests.filter(F.col("def").isNotNull()).select("file", "id", F.lit("def").alias("slot"), F.col("def.answer").alias("answer"), F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("boolean").alias("preserve"))
    b = requests.select("file", "id", F.explode("blocks.chunks").alias("c")).select("file", "id", F.concat(F.lit("b"), F.col("c.bidx")).alias("slot"), F.col("c.answer").alias("answer"), F.col("c.anchor").alias("anchor"), F.col("c.preserve").alias("preserve"))
    return d.unionByName(b)


def unfilled(c_def: Column, blocks: Column) -> Column:
    """Whether a request waits for an answer: of its definition, or of any chunk; insertions never count."""
    d = c_def.isNotNull() & blank(c_def["answer"])
    return d | F.coalesce(F.exists(blocks["chunks"], lambda c: blank(c["answer"])), F.lit(False))


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """rank (from 1) in the order of columns that are unique together, without gathering rows in one task.

    Rows are range-partitioned and sorted, partitions counted, and each partition's ranks shifted by the rows before.
    """
    parted = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranked")
    counts = sorted(map(tuple, parted.groupBy("part").count().collect()))  # one row for each partition
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    shift = df.sparkSession.createDataFrame(before, "part int, before long")
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parted.withColumn("local", local).join(F.broadcast(shift), "part").withColumn("rank", F.col("local") + F.col("before")).drop("part", "local", "before")


def batches(requests: DataFrame, size: int) -> DataFrame:
    """Requests that wait and are not claimed, in their order, in batches of a size: (file, id, rank, batch)."""
    open_ = requests.filter(unfilled(F.col("def"), F.col("blocks")) & F.col("fragment").isNull()).select("file", "id", "issued_at")
    ranked = global_rank(open_, "issued_at", "file", "id")
    return ranked.select("file", "id", "rank", F.floor((F.col("rank") - 1) / size).alias("batch"))


def shared_snippets(requests: DataFrame) -> DataFrame:
    """(file, id, snippet, snippet_ref): of equal snippets the least (id, file) keeps the text, the others refer to it."""
    own = requests.filter("snippet is not null").select("file", "id", "snippet", F.sha2("snippet", 256).alias("h"))
    keeper = own.groupBy("h").agg(F.min(F.struct("id", "file")).alias("k"))
    j = own.join(keeper, "h")
    keeps = (F.col("k.id") == F.col("id")) & (F.col("k.file") == F.col("file"))
    return j.select("file", "id", F.when(keeps, F.col("snippet")).alias("snippet"), F.when(~keeps, F.col("k.id")).alias("snippet_ref"))


#: Parts of the rows that refer to one snippet.
SALTS = 16


def inlined_snippets(requests: DataFrame, carriers: DataFrame, salts: int = SALTS) -> DataFrame:
    """(file, id, snippet): a null snippet is looked up by snippet_ref among the carriers' ids; null where it leads nowhere.

    Requests with a snippet of their own are not joined. Very many requests may refer to one id, so they are spread over
    salts, and each wanted carrier comes once for each salt.
    """
    own = requests.filter(F.col("snippet").isNotNull() | F.col("snippet_ref").isNull()).select("file", "id", "snippet")
    lacks = requests.filter(F.col("snippet").isNull() & F.col("snippet_ref").isNotNull()).select("file", "id", "snippet_ref")
    wanted = lacks.select(F.col("snippet_ref").alias("id")).distinct()
    k = carriers.filter("snippet is not null").select("id", "snippet").join(wanted, "id", "left_semi").groupBy(F.col("id").alias("snippet_ref")).agg(F.min("snippet").alias("snippet"))
    k = k.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = lacks.withColumn("salt", F.pmod(F.xxhash64("file", "id"), F.lit(salts)).cast("int")).join(k, ["snippet_ref", "salt"], "left")
    return own.unionByName(found.select("file", "id", "snippet"))


def merged_answers(requests: DataFrame) -> DataFrame:
    """(file, id, slot, answer): the first answer that isn't blank wins; the master's rows (no fragment) come first,
    fragments by name. A slot that nobody filled has a null answer."""
    s = slots(requests.withColumn("id", F.struct("id", "fragment", "received_at"))).select("file", F.col("id.id").alias("id"), F.col("id.fragment").alias("fragment"), F.col("id.received_at").alias("at"), "slot", "answer")
    order = F.struct(F.col("fragment").isNotNull(), F.coalesce("fragment", F.lit("")), F.col("at").isNull(), F.col("at"), F.col("answer"))
    return s.groupBy("file", "id", "slot").agg(F.min_by("answer", F.when(~blank(F.col("answer")), order)).alias("answer"))


def released(requests: DataFrame) -> DataFrame:
    """Requests with the claims of those that wait given back."""
    return requests.withColumn("fragment", F.when(unfilled(F.col("def"), F.col("blocks")), F.lit(None)).otherwise(F.col("fragment")))


def rebound(requests: DataFrame, live: DataFrame) -> DataFrame:
    """Answers of definitions bound to live ones by (file, qualname, hash): (file, qualname, start_line, answer).

    live: (file, qualname, start_line, text_hash). A request whose sig_hash no live definition has is stale and binds to
    nothing. Of several live definitions with one key the first takes the answer; of several requests with one key the
    last one counts (by issued_at, then id).
    """
    order = F.struct(F.coalesce("issued_at", F.lit("1970-01-01").cast("timestamp_ntz")), "id")
    last = requests.filter(F.col("def").isNotNull()).groupBy("file", "qualname", "sig_hash").agg(F.max_by("def.answer", order).alias("answer"))
    first = live.groupBy("file", "qualname", F.col("text_hash").alias("sig_hash")).agg(F.min("start_line").alias("start_line"))
    return first.join(last, ["file", "qualname", "sig_hash"]).select("file", "qualname", "start_line", "answer")


def statement_insertions(requests: DataFrame) -> DataFrame:
    """Insertions by ordinal: (file, id, ordinal, line, text) of keys that are statement lines; an empty text is a
    paragraph break and stays empty."""
    stmts = requests.select("file", "id", F.posexplode("blocks.stmt_lines").alias("ordinal", "line"))
    ins = requests.select("file", "id", F.explode("blocks.insertions").alias("key", "text")).withColumn("line", F.expr("try_cast(key as int)"))
    return stmts.join(ins, ["file", "id", "line"]).select("file", "id", "ordinal", "line", "text").distinct()
