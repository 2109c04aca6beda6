"""Source files that do not parse (problem 2): a packrat grammar for each language, consuming the whole input."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.grammars import c, javascript, python
from marlstone.llm.grammars.peg import Grammar
from marlstone.llm.grammars.python import Malformed
from marlstone.llm.licences import repository_of
from marlstone.tables import spread

LANGUAGES = ("python", "c", "javascript")
#: Frames of the matcher, which Python keeps on its heap: enough for some 200,000 levels of nesting, and 1.4 GB. A source
#: nested deeper than that counts as not valid, as it does for compilers, whose bounds are lower.
FRAMES = 4_000_000
_CONFLICT = re.compile(r"(?m)^(<{7}|={7}|>{7}|\|{7})(?: |$)")


@lru_cache(maxsize=3)
def _grammar(language: str) -> Grammar:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
    return {"python": python, "c": c, "javascript": javascript}[language].grammar()


def _text(blob: bytes) -> str:
    """C and JavaScript: bytes that are not UTF-8 are no errors; line ends become one character."""
    return blob.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def valid(blob: bytes, language: str) -> bool:
    """Whether the grammar of the language consumes all of the source."""
    g = _grammar(language)
    if g.full():
        g.reset()
    try:
        if language == "python":
            return g.accepts(python.symbols(python.decoded(blob), g), "file")
        if language == "javascript":
            return g.accepts(javascript.symbols(_text(blob), g), "file", "A")
        text = _text(blob)
        return c.check(text[1:] if text.startswith("﻿") else text, g)[0]
    except (Malformed, RecursionError):
        return False


def exactly_valid(blob: bytes) -> bool:
    """What Python's own compiler says of a source that the grammar refused."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(blob, "source", "exec", dont_inherit=True)
        except (SyntaxError, ValueError, OverflowError, MemoryError, RecursionError):
            return False
    return True


def broken(blob: bytes, language: str) -> bool:
    """Whether a source is not valid: refused by its grammar and, for Python, by the compiler as well."""
    return not valid(blob, language) and (language != "python" or not exactly_valid(blob))


def _deepest(g: Grammar, symbol: str, index: int, places: dict, symbols: str) -> int:
    """Follows a failure into the group it lies in; the place of the furthest symbol."""
    place, furthest = 0, {}
    for k, v in g.failed.items():
        furthest[k[0]] = max(v, furthest.get(k[0], -1))
    while True:
        at = places.get(symbol) or []
        if not at:
            break
        place = at[min(index, len(at) - 1)]
        here = symbols[index] if index < len(symbols) else ""
        if here not in g.kind or here not in furthest:
            break
        index, symbol = furthest[here], here
        symbols = g.content[symbol]
    return place


def failure(blob: bytes, language: str) -> tuple[int, str]:
    """Of a source that is not valid: the line (1-based) of the furthest failure, and its cause.

    Causes: conflict (markers of a merge), truncated (it ends within a group, text or statement), language (it is
    valid in another of the languages), syntax (anything else).
    """
    text, ended, line = _text(blob), False, 1
    g = _grammar(language)
    known, g.known, g.failed, g.diagnose = g.known, {}, {}, True
    try:
        places: dict = {}
        try:
            if language == "python":
                text = python.decoded(blob)
                s, start, ctx = python.symbols(text, g, places), "file", ""
            elif language == "javascript":
                s, start, ctx = javascript.symbols(text, g, places), "file", "A"
            else:
                parts = c.structure(text)
                s, start, ctx = c.symbols(c.preprocessed(parts, {}), g, places), "file", ""
            if not g.accepts(s, start, ctx):
                at = _deepest(g, "", g.reached, places, s)
                line = at + 1 if language == "c" else text.count("\n", 0, at) + 1
                ended = g.reached >= len(s)
        except Malformed as e:
            line = e.at + 1 if language == "c" else text.count("\n", 0, e.at) + 1
            ended = "without end" in e.why or e.why == "#if without #endif"
        except RecursionError:
            pass
    finally:
        g.known, g.diagnose = known, False
    if len({m[1][0] for m in _CONFLICT.finditer(text)} & set("<>=")) >= 2:
        return line, "conflict"
    if any(other != language and text.strip() and valid(blob, other) for other in LANGUAGES):
        return line, "language"
    return line, "truncated" if ended else "syntax"


_SCHEMA = "file_key string, language string, line_no int, cause string"


def broken_files(files: DataFrame) -> DataFrame:
    """(file_key, language, line_no, cause) of the records that are not valid in their language.

    Reads file_key, source_blob and language. Rows without a blob or with another language or none are left out. A
    record delivered twice comes out twice, with equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, blob, language in zip(*(b.column(i).to_pylist() for i in range(3))):
                if broken(blob, language):
                    rows.append((key, language, *failure(blob, language)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.string(), pa.string(), pa.int32(), pa.string()])], names=["file_key", "language", "line_no", "cause"])

    rows = files.select("file_key", "source_blob", "language").filter(F.col("source_blob").isNotNull() & F.col("language").isin(*LANGUAGES))
    return spread(rows).mapInArrow(run, _SCHEMA)


def rates(files: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, rate, n_conflict, n_truncated, n_language, n_syntax), files counted once."""
    bad = found.groupBy("file_key").agg(F.min("cause").alias("cause"))
    all_ = files.filter(F.col("source_blob").isNotNull() & F.col("language").isin(*LANGUAGES)).select("file_key", "language").distinct()
    joined = all_.join(bad, "file_key", "left").withColumn("repo", repository_of(F.col("file_key")))
    causes = [F.count_if(F.col("cause") == x).alias(f"n_{x}") for x in ("conflict", "truncated", "language", "syntax")]
    out = joined.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count("cause").alias("n_invalid"), *causes)
    return out.withColumn("rate", F.col("n_invalid") / F.col("n_files"))
