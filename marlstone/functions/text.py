"""Column functions over texts, lines and replies. All stay inside the JVM; null gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of legal texts; a line that holds one is never offered for rewriting.
LEGAL_MARKERS = (
    "spdx-license-identifier", "copyright", "(c)", "©", "all rights reserved", "permission is hereby granted", "redistribution and use", "without warranty",
    "warranties or conditions", "licensed under", "general public license", "apache license", "mit license", "bsd license", "mozilla public license", "gnu ",
)
#: A line that opens with a list or heading marker.
LIST_MARKER = r"(?m)^\s*(?:\d+[.)]\s|[-*+•]\s|#{1,6}\s|\*\*[^*\n]+\*\*\s*:)"
#: Replies that only acknowledge, and how such replies begin.
ACKNOWLEDGEMENTS = ("ok", "okay", "understood", "ready", "sure", "yes", "done", "got it", "acknowledged")
ACKNOWLEDGING = ("understood", "acknowledged", "okay", "ok,", "ok ", "got it")
#: Endings of header and implementation files, and the endings of files that are taken from a directory.
HEADERS, IMPLEMENTATIONS, SOURCES = (".h", ".hh", ".hpp"), (".c", ".cc", ".cpp"), (".py", ".c", ".h", ".js", ".mjs", ".cjs")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def looks_legal(c: Column) -> Column:
    """Whether any legal marker occurs, whatever its case."""
    low = F.lower(c)
    out = F.lit(False)
    for x in LEGAL_MARKERS:
        out = out | low.contains(x)
    return out


def list_markers(c: Column) -> Column:
    """How many lines open with a list or heading marker."""
    return F.size(F.regexp_extract_all(c, F.lit(LIST_MARKER), F.lit(0)))


def looks_listy(c: Column) -> Column:
    """Whether a text is a list: one marker may be chance, two are not."""
    return list_markers(c) >= 2


def without_list_markers(c: Column) -> Column:
    """Each line without its marker and bold marks; wording and order are kept."""
    line = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*+•]|#{1,6})\s+", ""), r"\*\*([^*\n]+)\*\*", "$1")
    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def acknowledges(c: Column) -> Column:
    """Whether a reply is nothing but an acknowledgement; false for null and empty ones."""
    s = F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[.!]+$", ""))
    starts = F.lit(False)
    for x in ACKNOWLEDGING:
        starts = starts | s.startswith(x)
    return s.isin(*ACKNOWLEDGEMENTS) | ((F.instr(F.coalesce(c, F.lit("")), "\n") == 0) & (F.length(s) < 60) & starts)


def declines(c: Column) -> Column:
    """Whether a reply's first line says NONE, in whatever dressing; false for null."""
    head = F.regexp_replace(strip(F.split(strip(F.coalesce(c, F.lit(""))), "\n")[0]), r"^[`\"'*.: ]+|[`\"'*.: ]+$", "")
    return F.upper(head).startswith("NONE")


def first_line(c: Column, default: str = "") -> Column:
    """The first line that isn't blank, stripped; the default where there is none, also for null."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(default))


def score(c: Column, default: int = 2) -> Column:
    """The first digit of a reply, within 1 to 3; the default where there is none."""
    d = F.regexp_extract(F.coalesce(c, F.lit("")), r"([0-9])", 1)
    return F.when(d == "", default).otherwise(F.least(F.lit(3), F.greatest(F.lit(1), d.cast("int"))))


def verdict(c: Column, *words: str) -> Column:
    """Of the words, in this order, the first that the reply's first line holds as a word; null for none."""
    line = F.upper(first_line(c))
    out = F.lit(None).cast("string")
    for w in reversed(words):
        out = F.when(line.rlike(rf"\b{w}\b"), w).otherwise(out)
    return out


def classified_range(c: Column, n: Column) -> Column:
    """A reply's line range as struct(first, last) within 1..n; null for NONE, no number, or an inverted range."""
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    pattern = r"([0-9]{1,9})\s*(?:-|to|–)\s*([0-9]{1,9})"
    a, b, one = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2), F.regexp_extract(text, r"([0-9]{1,9})", 1)
    within = lambda x: F.greatest(F.lit(1), F.least(x.cast("int"), n))
    first, last = within(F.when(a != "", a).otherwise(one)), within(F.when(b != "", b).otherwise(one))
    return F.when((n > 0) & ~text.startswith("none") & (one != "") & (first <= last), F.struct(first.alias("first"), last.alias("last")))


def estimated_tokens(c: Column, bytes_per_token: float = 2.0) -> Column:
    """Tokens a text may have: its UTF-8 bytes over a fixed ratio, rounded up."""
    return F.ceil(F.octet_length(c) / F.lit(bytes_per_token)).cast("int")


def filled(template: Column, **fields: Column) -> Column:
    """A template with each {name} replaced in turn; a value that holds a later name is expanded again."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def indent(c: Column) -> Column:
    """Leading blanks of a line."""
    return F.length(c) - F.length(F.ltrim(c))


def comment_lines(c: Column, indent_: Column, prefix: str, opening: str | None = None, middle: str | None = None, closing: str | None = None) -> Column:
    """A text as comment lines: one line, or a style without a block form, takes the prefix; else the block form."""
    lines = F.split(c, "\n")
    plain = F.transform(lines, lambda x: F.rtrim(F.concat(indent_, F.lit(prefix), x)))
    if opening is None:
        return plain
    inner = F.transform(lines, lambda x: F.rtrim(F.concat(indent_, F.lit(middle or prefix), x)))
    block = F.concat(F.array(F.concat(indent_, F.lit(opening))), inner, F.array(F.concat(indent_, F.lit(closing or ""))))
    return F.when(F.size(lines) == 1, plain).otherwise(block)


def file_role(path: Column) -> Column:
    """header, implementation or other, by the path's ending."""
    low = F.lower(path)
    any_of = lambda ends: F.array_contains(F.array(*[F.endswith(low, F.lit(x)) for x in ends]), True)
    return F.when(any_of(HEADERS), "header").when(any_of(IMPLEMENTATIONS), "implementation").otherwise("other")


def text_hash(c: Column) -> Column:
    """The first 16 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def request_id(qualname: Column, sig_hash: Column) -> Column:
    return F.concat(F.lit("fn:"), qualname, F.lit(":"), sig_hash)
