"""Mixing sources to target weights (problem 7): Poisson replication.

Each document draws its count by inverting a Poisson distribution at a number hashed from its id, so the draw needs no
state and comes out alike on every run. The mean of each source is calibrated: for every count k the mean at which a
document reaches k copies follows from its number alone, and a histogram of tokens over these thresholds tells the
tokens drawn at any mean. The histogram's size is fixed, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.tokens import VOCABULARY, counts
from marlstone.tables import spread, written

#: So many means are told apart, from the least on.
GRID_SIZE, LEAST_MEAN = 16384, 1e-5
SEED = 20310


def grid(repeats: int) -> np.ndarray:
    """Means at which thresholds are told apart: up to one that takes nearly every record as often as it may be used."""
    return np.exp(np.linspace(np.log(LEAST_MEAN), np.log(max(60.0, repeats + 12 * repeats**0.5)), GRID_SIZE))


def source_name(c: Column) -> Column:
    """A source's name without differences of case, blanks and hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def _number(key: str, text: str, seed: int) -> Column:
    """In (0, 1), from the key; from the text where there is none."""
    h = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key), F.lit(seed))).otherwise(F.xxhash64(F.col(text), F.lit(seed)))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)


def _cdf(n: int, mean: np.ndarray | float):
    """P(N <= n) of a Poisson distribution."""
    mean = np.asarray(mean, dtype=float)
    return np.minimum(1.0, sum(np.exp(i * np.log(mean) - mean - lgamma(i + 1)) for i in range(n + 1)))


def sizes(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(s, u, n) of every record: source, the number it draws by, and tokens; a table, so that tokens are counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts(b.column(2).to_pylist(), vocabulary), pa.int64())], names=["s", "u", "n"])

    rows = documents.select(source_name(F.col(source)).alias("s"), _number(key, text, seed).alias("u"), text)
    return written(spread(rows).mapInArrow(run, "s string, u double, n bigint"), "mix-sizes")


@dataclass(frozen=True)
class Mix:
    """means: of each source the Poisson mean, infinity where every record is used as often as it may be."""

    means: dict[str, float]
    shares: dict[str, float]
    repeats: dict[str, int]
    tokens: dict[str, int]
    records: dict[str, int]


def calibrate(sized: DataFrame, targets: dict[str, tuple[float, int]]) -> Mix:
    """The mean of each source, so that the mixture is as large as the caps allow and its shares are as asked.

    sized: the records' `sizes`. Sources that can give no tokens are not drawn and do not bound the size; the others
    keep their shares to one another, which thereby grow in proportion. A share is met to within one record's tokens
    and the distance of two means of the grid.
    """
    most = {s: m for s, (_, m) in targets.items()}
    means_ = grid(max(most.values(), default=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = [-_cdf(k, means_) for k in range(max(most.values(), default=0))]
        total: dict[tuple[str, int, int], list[int]] = {}
        for b in batches:
            number = b.column(1).to_numpy()
            bins = [np.searchsorted(x, -number, "right") for x in below]
            for i, (s, n) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                for k in range(-1, most[s]):
                    x = total.setdefault((s, k, 0 if k < 0 else int(bins[k][i])), [0, 0])
                    x[0] += n
                    x[1] += 1
        cols = list(zip(*((*k, *v) for k, v in total.items()))) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])], names=["s", "k", "bin", "tokens", "records"])

    rows = sized.filter(F.col("s").isin(list(targets)))
    cells = rows.mapInArrow(run, "s string, k int, bin int, tokens bigint, records bigint").groupBy("s", "k", "bin").agg(F.sum("tokens").alias("tokens"), F.sum("records").alias("records"))
    have, n, at = {s: 0 for s in targets}, {s: 0 for s in targets}, {s: np.zeros(GRID_SIZE + 1) for s in targets}
    for s, k, i, tokens, records in map(tuple, cells.collect()):  # bounded by sources x repeats x grid
        if k < 0:
            have[s], n[s] = tokens, records
        else:
            at[s][i] += tokens
    wanted = [s for s, (share, most_) in targets.items() if share > 0 and most_ * have[s] > 0]
    size = min((most[s] * have[s] / targets[s][0] for s in wanted), default=0)
    means = {}
    for s in targets:
        aim, got = targets[s][0] * size, np.cumsum(at[s][:-1])
        if s not in wanted:
            means[s] = 0.0
        elif aim >= most[s] * have[s] * (1 - 1e-12):
            means[s] = float("inf")
        else:
            i = int(np.searchsorted(got, aim))
            i = i - 1 if i and (i >= GRID_SIZE or got[i] - aim > aim - got[i - 1]) else i
            means[s] = float(means_[i])
    return Mix(means, {s: t[0] for s, t in targets.items()}, most, have, n)


def _copies(m: Mix, name: Column, number: Column) -> Column:
    """Inverse of the Poisson distribution function, at most the source's cap."""
    out = F.lit(0)
    for s, mean in m.means.items():
        steps = [0.0 if mean == float("inf") else float(_cdf(k, mean)) for k in range(m.repeats[s])] if mean else []
        out = F.when(name == s, sum(((number > x).cast("int") for x in steps), F.lit(0))).otherwise(out)
    return out


def draw(documents: DataFrame, m: Mix, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """Each record as often as it was drawn, in a global random order: the input's columns and mix_copy (from 0).

    Records whose source is null or has no target are not part of the mixture. mix_order is the random position's key.
    Columns of the input named mix_copy, mix_copies or mix_order are replaced. An empty input gives an empty mixture.
    """
    number = _number(key, text, seed)
    rows = documents.drop("mix_copy", "mix_order").withColumn("mix_copies", _copies(m, source_name(F.col(source)), number)).filter("mix_copies > 0")
    rows = rows.withColumn("mix_copy", F.explode(F.expr("sequence(0, mix_copies - 1)"))).drop("mix_copies")
    return rows.withColumn("mix_order", F.xxhash64(key, "mix_copy", F.lit(seed + 1))).orderBy("mix_order", key, "mix_copy")


def shares(sized: DataFrame, m: Mix) -> DataFrame:
    """What the draw of the records with these `sizes` reaches: (source, target_share, share, n_tokens, n_draws,
    n_records, most_copies, max_repeats)."""
    rows = sized.withColumn("c", _copies(m, F.col("s"), F.col("u"))).filter("c > 0")
    got = rows.groupBy("s").agg(F.sum(F.col("n") * F.col("c")).alias("n_tokens"), F.sum("c").alias("n_draws"), F.max("c").alias("most_copies"))
    aims = sized.sparkSession.createDataFrame([(s, m.shares[s], m.records[s], m.repeats[s]) for s in m.means], "source string, target_share double, n_records bigint, max_repeats int")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_draws", "most_copies")]
    out = aims.join(got, aims.source == got.s, "left").select("source", "target_share", *zero, "n_records", "max_repeats")
    total = F.sum("n_tokens").over(Window.partitionBy())  # one row for each target
    return out.withColumn("share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0)).select("source", "target_share", "share", "n_tokens", "n_draws", "most_copies", "n_records", "max_repeats")
