"""Filling fixed-capacity containers with items (problem 6): length-histogram planning.

Best-fit-decreasing runs over the counts of each length, not over documents, so the plan's size depends on the
capacity alone. Documents then take the planned slots by their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.tokens import VOCABULARY, counts
from marlstone.tables import spread, written


@dataclass(frozen=True)
class Plan:
    """Of each length the runs of slots: first rank, first container, slots in a container, first token."""

    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    containers: int


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit-decreasing over a histogram of lengths.

    Equal containers are kept as one group with a count. A length goes to the group with the least room that takes
    it, as often as fits, so every step closes a group or a length: the groups are at most a few for each length.
    """
    open_: dict[int, list[tuple[int, tuple | None]]] = {}
    rooms = np.zeros(capacity + 1, dtype=bool)
    closed: list[tuple[int, tuple | None]] = []

    def put(room: int, count: int, items: tuple | None) -> None:
        if not count:
            return
        if room:
            open_.setdefault(room, []).append((count, items))
            rooms[room] = True
        else:
            closed.append((count, items))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within the capacity {capacity}")
        while n:
            fit = length + int(rooms[length:].argmax())
            if rooms[fit]:
                count, items = open_[fit].pop()
                if not open_[fit]:
                    rooms[fit] = False
            else:
                fit, count, items = capacity, -(-n // (capacity // length)), None
            each = fit // length
            full = min(count, n // each)
            put(fit - each * length, full, ((length, each), items))
            n, count = n - full * each, count - full
            if count and n:
                put(fit - n * length, 1, ((length, n), items))
                n, count = 0, count - 1
            put(fit, count, items)
    closed += [x for groups in open_.values() for x in groups]

    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for count, items in closed:
        parts = []
        while items:
            part, items = items
            parts.append(part)
        at = 0
        for length, each in reversed(parts):
            runs.setdefault(length, []).append((taken.get(length, 0), base, each, at))
            taken[length] = taken.get(length, 0) + each * count
            at += length * each
        base += count
    return Plan({k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in runs.items()}, base)


def place(p: Plan, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Container and first token within it, for 0-based ranks within their lengths."""
    container, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, edges):
        if len(rows):
            length = int(lengths[rows[0]])
            first, base, each, at = p.slots[length]
            i = np.searchsorted(first, ranks[rows], "right") - 1
            k = ranks[rows] - first[i]
            container[rows], offset[rows] = base[i] + k // each[i], at[i] + k % each[i] * length
    return container, offset


def token_counts(documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of each row, by the tokenizer of the vocabulary file; 0 tokens for a null or empty text."""
    name = "text_key"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(counts(b.column(1).to_pylist(), vocabulary), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=[name, "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(F.col(key).alias(name), text)).mapInArrow(run, f"{name} {kind}, n_tokens bigint")


#: Parts that the documents of one length are ranked in.
SALTS = 64


def sizes(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The token counts (text_key, n_tokens) as a table, for one packing or several."""
    return written(token_counts(documents, key, text, vocabulary), "token-counts")


def pack(documents: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, sized: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """Every document's place: (key, piece_no, token_start, n_tokens, container_id, container_offset).

    A document of more than `capacity` tokens alone is cut into pieces of `capacity` tokens and a rest; all others
    stay whole. Rows without tokens (null or empty text) need no room: container_id is null, n_tokens 0. Rows with a
    null key are packed too. Every input row is placed once: repeated rows count as often as they come.
    What reaches the driver, and is sent to the executors, is the histogram of lengths and its plan: at most `capacity`
    lengths, whatever the corpus or the number of partitions. sized: the documents' `sizes`, if they are known already.
    Raises ValueError for a capacity below 1.
    """
    if capacity < 1:
        raise ValueError("the capacity has to be at least 1")
    spark = documents.sparkSession
    sized = sizes(documents, key, text, vocabulary) if sized is None else sized
    pieces = sized.withColumn("piece_no", F.explode(F.expr(f"sequence(0L, greatest(0L, cast(ceil(n_tokens / {capacity}) as bigint) - 1))")))
    pieces = pieces.select("text_key", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece_no") * capacity).alias("n_tokens"))
    # one length may hold most rows: ranks are counted within salts of a length, and shifted by the salts before
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("text_key", "piece_no"), F.lit(salts)).cast("int"))
    full = pieces.filter("n_tokens > 0")
    cells = written(full.groupBy("n_tokens", "salt").agg(F.count("*").alias("n")), "length-cells")
    histogram = {length: n for length, n in cells.groupBy("n_tokens").agg(F.sum("n")).collect()}  # at most `capacity` rows
    planned = spark.sparkContext.broadcast(plan(histogram, capacity))

    @F.pandas_udf("container_id bigint, container_offset bigint")
    def take(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        container, offset = place(planned.value, length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"container_id": container, "container_offset": offset})

    earlier = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most `salts` rows
    shift = cells.select("n_tokens", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # rows that neither hash nor key tells apart are alike, so any order of them gives the same result
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("text_key", "piece_no")) - 1)
    placed = ranked.join(shift, ["n_tokens", "salt"]).withColumn("at", take("n_tokens", F.col("rank").cast("bigint") + F.col("before")))
    columns = [F.col("text_key").alias(key), "piece_no", "token_start", "n_tokens"]
    none = pieces.filter("n_tokens = 0").select(*columns, F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("bigint").alias("container_offset"))
    return placed.select(*columns, "at.container_id", "at.container_offset").unionByName(none)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(n_containers, n_items, n_tokens, fill): fill is the used part of all containers' room; null without any."""
    each = packed.filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return each.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"))
