"""Patches of sources that replace what they wrote before: docstrings, header comments and notes within bodies.

Each file is patched in one pass over its lines; a guard compares the code before and after, by the lexer for C and
JavaScript and by the syntax tree for Python. Where all notes together fail it, they are tried one by one, so a bad note
costs no other. Applying the same notes again changes nothing.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import braces
from marlstone.operators.parse import _WithoutDocs

#: The mark of a line comment by language.
MARKS = {"python": "#", "c": "//", "javascript": "//"}


class Patched(NamedTuple):
    lines: list[str]
    applied: int
    refused: int
    inline: int  #: definitions whose body shares the header's line have no place for a docstring


def _code(lines: list[str], language: str, docs: bool) -> object:
    """What a patch may not change: for Python the syntax tree (docs: docstrings too), for others the code without comments."""
    text = "\n".join(lines)
    if language == "python":
        try:
            tree = ast.parse(text.encode("latin-1"))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
        return ast.dump(tree if docs else _WithoutDocs().visit(tree))
    parts, at = [], 0
    for a, b in braces.lexed(text, language).comments:
        parts += [text[at:a], " "]
        at = b
    bare = "".join([*parts, text[at:]])
    return [x for x in (line.strip() for line in bare.split("\n")) if x]


def _comment_lines(lines: list[str], language: str) -> tuple[braces.Lexed, set[int], dict[int, int]]:
    """The lexed source, the numbers (1-based) of lines that hold nothing but a comment, and of each the line where it begins."""
    text = "\n".join(lines)
    x = braces.lexed(text, language)
    only: dict[int, int] = {}
    for a, b in x.comments:
        first, last = bisect_right(x.lines, a), bisect_right(x.lines, max(a, b - 1))
        if not text[x.lines[first - 1] : a].strip() and not text[b : (x.lines[last] if last < len(x.lines) else len(text) + 1)].strip():
            only.update(dict.fromkeys(range(first, last + 1), first))
    return x, set(only), only


def _attached(lines: list[str], line_no: int, comments: set[int], begins: dict[int, int], indent: str | None = None) -> int:
    """The first line of the comment right above a line, the line itself if there is none: one block or a run of line
    comments; with an indent only what stands at it."""
    at = line_no
    while at - 1 in comments:
        first = begins[at - 1]
        block = lines[first - 1].lstrip().startswith("/*")
        if block and at < line_no or indent is not None and lines[first - 1][: len(lines[first - 1]) - len(lines[first - 1].lstrip())] != indent:
            break
        at = first
        if block:
            break
    return at


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip())]


def _rendered(text: str, indent: str, language: str, block: bool) -> list[str]:
    body = text.split("\n")
    if not block:
        return [f"{indent}{MARKS[language]} {x}".rstrip() for x in body]
    return [f"{indent}/**", *(f"{indent} * {x}".rstrip() for x in body), f"{indent} */"]


def _header_end(x: braces.Lexed, start: int) -> int | None:
    """The line that the header of a Python definition ends on."""
    at = start
    while at < len(x.code) and x.code[at] not in ":\n":
        at = x.partner.get(at, at) + 1
    return bisect_right(x.lines, at) if x.code[at : at + 1] == ":" else None


def _with_docstrings(lines: list[str], notes: list[tuple[int, str]]) -> tuple[list[str], int]:
    try:
        tree = ast.parse("\n".join(lines).encode("latin-1"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return lines, 0
    nodes = {n.lineno: n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
    x, out, inline = braces.lexed("\n".join(lines), "python"), list(lines), 0
    for line_no, text in sorted(notes, reverse=True):
        node = nodes.get(line_no)
        if node is None:
            continue
        first = node.body[0]
        begins = lines[first.lineno - 1].encode("latin-1")[: first.col_offset].decode("latin-1")
        if begins.strip():
            inline += 1
            continue
        indent = _indent(lines[line_no - 1]) + "    "
        new = [f'{indent}"""', *(f"{indent}{t}".rstrip() for t in text.split("\n")), f'{indent}"""']
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            out[first.lineno - 1 : first.end_lineno] = new
        else:
            end = _header_end(x, x.lines[line_no - 1] + len(_indent(lines[line_no - 1])))
            if end is not None:
                out[end:end] = [*new, ""]
    return out, inline


def _with_headers(lines: list[str], language: str, notes: list[tuple[int, str]]) -> list[str]:
    x, comments, begins = _comment_lines(lines, language)
    marks = {lines[n - 1].lstrip()[:2] for n in comments if begins[n] == n}
    block, out = marks != {"//"}, list(lines)
    for line_no, text in sorted(notes, reverse=True):
        if not 1 <= line_no <= len(lines):
            continue
        new = _rendered(text, _indent(lines[line_no - 1]), language, block)
        first = _attached(lines, line_no, comments, begins)
        if first == line_no and language == "javascript":
            new = ["", *new]
        out[first - 1 : line_no - 1] = new
    return out


def _with_notes(lines: list[str], language: str, notes: list[tuple[int, str | None]]) -> list[str]:
    _, comments, begins = _comment_lines(lines, language)
    out = list(lines)
    for line_no, text in sorted(notes, key=lambda n: n[0], reverse=True):
        if not 1 <= line_no <= len(lines):
            continue
        indent = _indent(lines[line_no - 1])
        first = _attached(lines, line_no, comments, begins, indent)
        body = _rendered(text, indent, language, False) if text else lines[first - 1 : line_no - 1]
        above = lines[first - 2] if first > 1 else ""
        gap = [""] if above.strip() and not above.rstrip().endswith(("{", ":")) else []
        out[first - 1 : line_no - 1] = [*gap, *body]
    return out


def _guarded(lines: list[str], language: str, groups: list[list], patch, docs: bool) -> tuple[list[str], int, int]:
    """(lines, groups applied, groups refused): all groups at once, or, where the guard fails, those that pass it alone."""
    before = _code(lines, language, docs)
    if before is None:
        return lines, 0, len(groups)
    passes = lambda got: _code(got, language, docs) == before
    out = patch([n for g in groups for n in g])
    if passes(out):
        return out, len(groups), 0
    good = [g for g in groups if passes(patch(g))]
    out = patch([n for g in good for n in g])
    return (out, len(good), len(groups) - len(good)) if passes(out) else (lines, 0, len(groups))


def documented_lines(lines: list[str], language: str, notes: list[tuple[int, str]]) -> Patched:
    """Lines with the documentation of definitions put in or replaced: (line of the definition, text), lines 1-based.

    Python takes docstrings below the header, C and JavaScript comments above it, in the style that the file has. Of
    several notes for one line the last counts. A Python source that does not parse refuses all.
    """
    notes = list(dict(notes).items())
    if language == "python":
        inline = 0

        def patch(ns: list[tuple[int, str]]) -> list[str]:
            nonlocal inline
            out, k = _with_docstrings(lines, ns)
            inline = k  # of the last patch, the one that is kept
            return out

        out, applied, refused = _guarded(lines, language, [[n] for n in notes], patch, False)
        return Patched(out, max(0, applied - inline), refused, inline if applied else 0)
    out, applied, refused = _guarded(lines, language, [[n] for n in notes], lambda ns: _with_headers(lines, language, ns), True)
    return Patched(out, applied, refused, 0)


def noted_lines(lines: list[str], language: str, notes: list[tuple[str, int, str | None]]) -> Patched:
    """Lines with notes above statements: (routine, line, text), lines 1-based; an empty text is a break only.

    A note replaces the comment that stands right above its line at the same indent; without a text that comment stays.
    A blank line goes above, but not below another one, the first line or a line that opens a block. All notes of a
    routine are applied or none.
    """
    groups: dict[str, dict[int, str | None]] = {}
    for routine, line_no, text in notes:
        groups.setdefault(routine, {})[line_no] = text
    rows = [list(g.items()) for g in groups.values()]
    out, applied, refused = _guarded(lines, language, rows, lambda ns: _with_notes(lines, language, ns), True)
    return Patched(out, applied, refused, 0)


_OUT = "file_key string, language string, source_lines array<binary>, n_applied int, n_refused int, n_inline int"


def _patched(files: DataFrame, notes: DataFrame, work) -> DataFrame:
    """Each file with its notes, an array column; files without notes come out as they are, null lines stay null."""
    f = files.select("file_key", "language", "source_lines").join(notes, "file_key", "left").select("file_key", "language", "source_lines", "notes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import warnings

        warnings.simplefilter("ignore")
        names = [x.split()[0] for x in _OUT.split(", ")]
        for b in batches:
            out: list[list] = [[], [], [], []]
            for language, lines, rows in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if lines is None or not rows or language not in MARKS:
                    got = Patched(lines, 0, 0, 0)
                else:
                    p = work([x.decode("latin-1") for x in lines], language, rows)
                    got = Patched([x.encode("latin-1") for x in p.lines], *p[1:])
                for col, v in zip(out, got):
                    col.append(v)
            types = [pa.list_(pa.binary()), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(out, types))], names=names)

    return f.mapInArrow(run, _OUT)


def _bytes(c: str):
    """A text as characters of one byte each, as lines are carried."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def documented(files: DataFrame, notes: DataFrame) -> DataFrame:
    """(file_key, language, source_lines, n_applied, n_refused, n_inline): files with `documented_lines`.

    files: (file_key, language, source_lines), each once; notes: (file_key, line_no, text), those without a line or text
    are left out. The notes of a file are gathered in its row.
    """
    n = notes.filter("text is not null and line_no >= 1").select("file_key", "line_no", _bytes("text").alias("text")).distinct()
    g = n.groupBy("file_key").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("notes"))
    return _patched(files, g, lambda lines, language, rows: documented_lines(lines, language, [(r["line_no"], r["text"]) for r in rows]))


def noted(files: DataFrame, notes: DataFrame) -> DataFrame:
    """The same with `noted_lines`; notes: (file_key, routine, line_no, text), a null or blank text is a break only.
    n_applied and n_refused count routines."""
    text = F.when(F.trim("text") != "", _bytes("text"))
    n = notes.filter("line_no >= 1").select("file_key", "routine", "line_no", text.alias("text")).distinct()
    g = n.groupBy("file_key").agg(F.array_sort(F.collect_list(F.struct("line_no", "routine", "text"))).alias("notes"))
    return _patched(files, g, lambda lines, language, rows: noted_lines(lines, language, [(r["routine"] or "", r["line_no"], r["text"]) for r in rows]))


_BREAK = re.compile(r"\s*\Z")


def wall(lines: list[str], language: str) -> list[str]:
    """A source without docs, comments and blank lines; strings, and a licence or other leading comment, stay.

    For Python docstrings go too, `pass` standing in where a body would be empty; a source that does not parse keeps its
    docstrings.
    """
    text = "\n".join(lines)
    x = braces.lexed(text, language)
    drop: list[tuple[int, int]] = list(x.comments)
    fill: dict[int, str] = {}
    if language == "python":
        try:
            tree = ast.parse(text.encode("latin-1"))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            tree = None
        for n in ast.walk(tree) if tree else ():
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.body:
                d = n.body[0]
                if isinstance(d, ast.Expr) and isinstance(d.value, ast.Constant) and isinstance(d.value.value, str):
                    a, b = x.lines[d.lineno - 1] + d.col_offset, x.lines[d.end_lineno - 1] + d.end_col_offset
                    drop.append((a, b))
                    if len(n.body) == 1:
                        fill[a] = "pass"
    first = next((i for i, c in enumerate(x.code) if not c.isspace()), len(text))
    out, at = [], 0
    for a, b in sorted(drop):
        if a >= at and a > first:
            out += [text[at:a], fill.get(a, "")]
            at = b
    out.append(text[at:])
    kept = "".join(out).split("\n")
    return [line.rstrip() for line in kept if not _BREAK.match(line)]
