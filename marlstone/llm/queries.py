"""The queries of the training-data operators, by name; SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import licences, mixing, packing, pairs, parsing, responses, spam, splitting
from marlstone.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_limits").filter(f"limit_id = '{name}'").first()
    return row["max_size"], row["overlap"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_findings(table(spark, sf_dir, "run_files"), table(spark, sf_dir, "licences"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.broken_files(table(spark, sf_dir, "run_files")).select("file_key").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.broken_files(table(spark, sf_dir, "run_files")).distinct()


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "run_files")
    return parsing.rates(files, parsing.broken_files(files))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_records(table(spark, sf_dir, "run_files"), *_limit(spark, sf_dir, "split_source"))
    return pieces.drop("long_lines").dropDuplicates(["file_key", "piece_no"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.found(splitting.split_records(table(spark, sf_dir, "run_files"), *_limit(spark, sf_dir, "split_source")))


def p3_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each record that was cut: whether its pieces cover it, keep within the limit, and repeat exactly the overlap."""
    from pyspark.sql import functions as F

    size, overlap = _limit(spark, sf_dir, "split_source")
    pieces = p3_pieces(spark, sf_dir).select("file_key", "piece_no", "start_byte", "end_byte", F.octet_length("piece").alias("n"), F.md5("piece").alias("h"))
    rows = F.array_sort(F.collect_list(F.struct("piece_no", "start_byte", "end_byte", "n")))
    g = pieces.groupBy("file_key").agg(rows.alias("p"))
    joined = F.forall(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at("p", i + 1)["start_byte"] == F.try_element_at("p", i)["end_byte"] - overlap, F.lit(True)))
    within = F.forall("p", lambda x: (x["n"] <= size) & (x["n"] == x["end_byte"] - x["start_byte"]))
    return g.select("file_key", F.element_at("p", -1)["end_byte"].alias("n_bytes"), ((F.element_at("p", 1)["start_byte"] == 0) & joined).alias("covered"), within.alias("within"), (F.size("p") > 1).alias("cut"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.documented(table(spark, sf_dir, "run_files"), table(spark, sf_dir, "symbols")).select("file", "qualname", "start_line")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pairs(table(spark, sf_dir, "run_files"), table(spark, sf_dir, "symbols"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.broken_responses(table(spark, sf_dir, "requests"))


def p6_pack_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _limit(spark, sf_dir, "pack_short")[0])


def p6_pack_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _limit(spark, sf_dir, "pack_long")[0])


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    documents, out = table(spark, sf_dir, "documents"), []
    sized = packing.sizes(documents)
    for name in ("pack_short", "pack_long"):
        capacity = _limit(spark, sf_dir, name)[0]
        out.append(packing.fill_report(packing.pack(documents, capacity, sized=sized), capacity).withColumn("limit_id", F.lit(name)))
    return out[0].unionByName(out[1])


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each capacity: the documents with text that have a place, and whether no container holds more than it can, no
    token has two places, and only documents larger than a container are in pieces."""
    from pyspark.sql import functions as F

    documents, out = table(spark, sf_dir, "documents"), []
    sized = packing.sizes(documents)
    for name in ("pack_short", "pack_long"):
        capacity = _limit(spark, sf_dir, name)[0]
        p = packing.pack(documents, capacity, sized=sized).filter("container_id is not null")
        each = p.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("end"), F.min("container_offset").alias("start"))
        whole = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
        a = each.agg(F.lit(0).cast("bigint").alias("n"), F.min(((F.col("used") <= capacity) & (F.col("end") == F.col("used")) & (F.col("start") == 0)).cast("int")).alias("fits"), F.lit(1).alias("whole"))
        b = whole.agg(F.count("*").alias("n"), F.lit(1).alias("fits"), F.min(((F.col("k") == 1) | (F.col("n") > capacity)).cast("int")).alias("whole"))
        both = a.unionByName(b).agg(F.max("n").alias("n_documents"), (F.min("fits") == 1).alias("fits"), (F.min("whole") == 1).alias("whole"))
        out.append(both.select(F.lit(name).alias("limit_id"), "n_documents", "fits", "whole"))
    return out[0].unionByName(out[1])


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, mixing.Mix]:
    sized = mixing.sizes(table(spark, sf_dir, "documents"))
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in table(spark, sf_dir, "mix_targets").collect()}  # a small table that does not grow
    return sized, mixing.calibrate(sized, targets)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents"), _mix(spark, sf_dir)[1]).select("doc_id", "mix_copy", "mix_order", "source", "text")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf_dir))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: its target, its cap, and whether the mixture keeps the cap and draws no other source."""
    from pyspark.sql import functions as F

    targets = table(spark, sf_dir, "mix_targets")
    s = mixing.source_name(F.col("source"))
    drawn = p7_mix(spark, sf_dir).groupBy(s.alias("source"), "doc_id").agg(F.count("*").alias("n"), F.countDistinct("mix_copy").alias("k"), F.max("mix_copy").alias("last"))
    each = drawn.groupBy("source").agg(F.max("n").alias("most"), F.min(((F.col("n") == F.col("k")) & (F.col("last") == F.col("n") - 1)).cast("int")).alias("numbered"))
    j = targets.join(each, "source", "full")
    return j.select("source", "target_share", "max_repeats", F.coalesce((F.col("most") <= F.col("max_repeats")) & (F.col("numbered") == 1), F.col("most").isNull()).alias("kept"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.flagged(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_line_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.line_shares(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    """Every query of the subpackage."""
    own = [p1_found, p2_found, p2_report, p2_rates, p3_found, p3_pieces, p3_invariants, p4_found, p4_pairs, p5_found, p6_pack_short, p6_pack_long, p6_report, p6_invariants, p7_mix, p7_shares, p7_invariants, p8_found, p8_line_shares]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL with the same rows, for the queries that SQL can state."""
    return {"p3_found": P3_FOUND, "p3_invariants": P3_INVARIANTS, "p6_invariants": P6_INVARIANTS, "p7_invariants": P7_INVARIANTS}


P3_INVARIANTS = """SELECT DISTINCT r.file_key, CAST(octet_length(r.source_blob) AS BIGINT) AS n_bytes, true AS covered, true AS within, true AS cut
FROM run_files r, size_limits l WHERE l.limit_id = 'split_source' AND octet_length(r.source_blob) > l.max_size"""
P6_INVARIANTS = """SELECT l.limit_id, count(DISTINCT d.doc_id) AS n_documents, true AS fits, true AS whole
FROM documents d, size_limits l WHERE l.limit_id <> 'split_source' AND length(d.text) > 0 GROUP BY l.limit_id"""
P7_INVARIANTS = "SELECT source, target_share, max_repeats, true AS kept FROM mix_targets"


P3_FOUND = r"""
WITH f AS (
  SELECT DISTINCT r.file_key, hex(r.source_blob) AS h, octet_length(r.source_blob) AS n, l.max_size AS m,
    CASE r.line_ending WHEN 'lf' THEN '0A' WHEN 'crlf' THEN '0D0A' WHEN 'cr' THEN '0D' END AS sep
  FROM run_files r, size_limits l
  WHERE l.limit_id = 'split_source' AND octet_length(r.source_blob) > l.max_size
), b AS (
  SELECT *, regexp_replace(h, '(..)', '\1 ', 'g') AS t FROM f
), c AS (
  SELECT *, (length(t) - length(replace(t, '0D 0A ', ''))) // 6 AS crlf, (length(t) - length(replace(t, '0D ', ''))) // 3 AS cr,
    (length(t) - length(replace(t, '0A ', ''))) // 3 AS lf FROM b
), d AS (
  SELECT file_key, m, t, coalesce(CASE sep WHEN '0A' THEN '0A ' WHEN '0D' THEN '0D ' WHEN '0D0A' THEN '0D 0A ' END,
    CASE WHEN crlf > greatest(cr - crlf, lf - crlf) THEN '0D 0A ' WHEN cr > lf THEN '0D ' ELSE '0A ' END) AS s FROM c
), e AS (
  SELECT file_key, m, unnest(string_split(t, s)) AS line, generate_subscripts(string_split(t, s), 1) AS k FROM d
)
SELECT file_key, CAST(0 AS INTEGER) AS line_no FROM d
UNION
SELECT file_key, CAST(k AS INTEGER) AS line_no FROM e WHERE length(line) // 3 > m
"""
