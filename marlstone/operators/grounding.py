"""The grounding gate: quoted words of a text that occur nowhere in a corpus, also not within a longer word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"\w{2,}"


def ungrounded(texts: DataFrame, keys: list[str], text: str, corpus: DataFrame, body: str) -> DataFrame:
    """(keys, ungrounded): the words in backticks that no corpus text holds, sorted and joined by commas.

    A word of the corpus grounds every part of it. Distinct words meet by equality first; only words not found so are
    looked up among the parts of corpus words, cut where their first letters stand, so no text is compared with another
    and a long word costs time in proportion to its length.
    """
    spans = F.regexp_extract_all(text, F.lit("`([^`]*)`"), F.lit(1))
    quoted = texts.select(*keys, F.explode(spans).alias("span")).select(*keys, F.explode(F.regexp_extract_all("span", F.lit(f"({WORD})"))).alias("word")).distinct()
    words = corpus.select(F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(f"({WORD})")))).alias("word")).distinct()
    missing = quoted.select("word").distinct().join(words, "word", "left_anti")
    # a corpus word is cut only where a missing word could begin in it: at its first letters, and to its length
    found = []
    for k, of_length in ((2, F.length("word") == 2), (3, F.length("word") > 2)):
        starts = missing.filter(of_length).select(F.substring("word", 1, k).alias("g"), F.length("word").alias("n")).distinct()
        places = words.filter(F.length("word") > k).select("word", F.explode(F.sequence(F.lit(1), F.length("word") - k + 1)).alias("at")).select("word", "at", F.expr(f"substring(word, at, {k})").alias("g"))
        found.append(places.join(starts, "g").filter(F.col("at") + F.col("n") - 1 <= F.length("word")).select(F.expr("substring(word, at, n)").alias("word")))
    parts = found[0].unionByName(found[1])
    lost = missing.join(parts, "word", "left_anti")
    return quoted.join(lost, "word", "left_semi").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("word")), ",").alias("ungrounded"))
