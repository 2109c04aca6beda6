"""What a model's or a writer's reply comes down to: fences, quotes, comment marks and indents taken off. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import strip

FENCE = r"(?s)^```[^\n]*\n(.*)\n```$"
#: Comment marks by language: line mark, opening, continuation, closing.
STYLES = {"python": ("#", None, None, None), "c": ("//", "/*", "*", "*/"), "javascript": ("//", "/*", "*", "*/")}
#: One-line replies that say there is nothing to note.
NOTHING = ("", "NONE", "SKIP", "N/A", "TRIVIAL")
_DRESS = "`\"'* "


def _bare(c: Column, marks: str = _DRESS) -> Column:
    """Without any of the marks at either end."""
    return F.btrim(c, F.lit(marks))


def without_fence(c: Column) -> Column:
    """The inside of a code fence that holds all of a reply, else the reply; stripped."""
    s = strip(c)
    inside = F.regexp_extract(s, FENCE, 1)
    return F.when(s.rlike(FENCE), strip(inside)).otherwise(s)


def dedented(c: Column) -> Column:
    """Lines without the indent that all share; blank lines become empty, and the whole is stripped."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.when(strip(x) == "", F.lit("")).otherwise(x))
    indent = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^[ \t]+", ""))
    shared = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda x: x != ""), indent)), F.lit(0))
    return strip(F.array_join(F.transform(lines, lambda x: F.substring(x, shared + 1, F.length(x))), "\n"))


def docstring_body(c: Column) -> Column:
    """A docstring's bare body: no fence, no triple quotes around it, no shared indent."""
    s = without_fence(c)
    for q in ('"""', "'''"):
        quoted = s.startswith(q) & s.endswith(q) & (F.length(s) >= 6)
        s = F.when(quoted, F.substring(s, F.lit(4), F.length(s) - 6)).otherwise(s)
    return dedented(s)


def _undressed(x: Column, marks: tuple[str, ...]) -> Column:
    """A line without the first mark of the list that it begins with."""
    out = x
    for m in reversed(marks):
        out = F.when(x.startswith(m), strip(F.substring(x, F.lit(len(m) + 1), F.length(x)))).otherwise(out)
    return out


def comment_body(c: Column, language: str) -> Column:
    """A comment's bare text; null for an empty reply or one that says NONE, before or after its dress is taken off."""
    line, opening, middle, closing = STYLES[language]
    marks = tuple(x for x in (line, opening, closing) if x)
    text = without_fence(c)
    lines = F.transform(F.split(text, "\n"), lambda x: _undressed(strip(x), marks))
    if middle:
        lines = F.transform(lines, lambda x: F.when(x == middle, F.lit("")).otherwise(x))
    out = strip(F.array_join(lines, "\n"))
    return F.when((text == "") | (F.upper(_bare(text)) == "NONE") | (out == "") | (F.upper(out) == "NONE"), None).otherwise(out)


def summary_line(c: Column, language: str) -> Column:
    """The first line of a reply without its dress; empty where it says that there is nothing to note, or is null."""
    line, opening, _, closing = STYLES[language]
    marks = tuple(x for x in (line, opening, closing) if x)
    lines = F.filter(F.transform(F.split(without_fence(F.coalesce(c, F.lit(""))), "\n"), strip), lambda x: x != "")
    first = F.trim(_bare(_undressed(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), marks)))
    return F.when(F.upper(first).isin(*NOTHING), "").otherwise(first)


def description_body(c: Column) -> Column:
    """A file description without fence and comment marks: openings and closings go, and one mark at each line's start."""
    s = strip(c)
    s = F.when(s.startswith("```"), strip(F.regexp_replace(F.regexp_replace(s, r"^```[a-zA-Z0-9_-]*\n?", ""), r"\n?```$", ""))).otherwise(s)
    lines = F.filter(F.transform(F.split(s, "\n"), strip), lambda x: ~x.isin("/*", "*/", "/**"))
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^/\*+\s?", ""), r"\s?\*+/$", ""), r"^(\*|//|#)\s?", "")
    return strip(F.array_join(F.transform(lines, plain), "\n"))


def wrapped(c: Column, width: Column | int) -> Column:
    """The words of a text in lines of at most that many characters (a longer word has a line of its own); no words give
    no lines."""
    room = F.lit(width) if isinstance(width, int) else width
    words = F.filter(F.split(F.regexp_replace(c, r"\s+", " "), " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(s: Column, w: Column) -> Column:
        fits = (s["now"] == "") | (F.length(s["now"]) + 1 + F.length(w) <= room)
        longer = F.when(s["now"] == "", w).otherwise(F.concat(s["now"], F.lit(" "), w))
        return F.struct(F.when(fits, s["out"]).otherwise(F.array_append(s["out"], s["now"])).alias("out"), F.when(fits, longer).otherwise(w).alias("now"))

    return F.aggregate(words, start, step, lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.array_append(s["out"], s["now"])))


def bytes_per_token(texts: Column, tokens: Column, default: float = 2.0) -> Column:
    """The ratio that token estimates are recalibrated to: bytes seen over tokens counted, an aggregate; the default where
    no tokens were counted."""
    seen = F.sum(F.when(tokens > 0, F.octet_length(texts)))
    return F.coalesce(seen / F.sum(F.when(tokens > 0, tokens)), F.lit(default))


def message_tokens(messages: Column, ratio: float = 2.0, framing: int = 0) -> Column:
    """The estimated tokens of a list of messages, and so many more for each."""
    cost = lambda m: F.ceil(F.octet_length(F.coalesce(m["content"], F.lit(""))) / F.lit(ratio)).cast("long") + framing
    return F.aggregate(F.transform(messages, cost), F.lit(0).cast("long"), lambda a, x: a + x)
