"""Structural elision of Python snippets: the deepest suites are collapsed until a snippet fits its budget."""

from __future__ import annotations

import ast
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 24
#: What stands for a collapsed suite; the count of its lines follows.
MARK = "...  # {n} lines"


def _tokens(text: str) -> int:
    return -(-len(text.encode("utf-8", "surrogatepass")) // 2)


def _suites(tree: ast.AST) -> list[tuple[int, int, int, int]]:
    """(depth, first line, last line, column) of suites that a mark can stand for: on lines of their own, not yet
    collapsed, and not the outermost definition's header."""
    out, todo = [], [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        for name in ("body", "orelse", "finalbody"):
            suite = getattr(node, name, None)
            if not isinstance(suite, list) or not suite or not isinstance(suite[0], ast.stmt):
                continue
            inner = depth + (not isinstance(node, ast.Module))
            todo += [(s, inner) for s in suite]
            elided = len(suite) == 1 and isinstance(suite[0], ast.Expr) and isinstance(suite[0].value, ast.Constant) and suite[0].value.value is ...
            if inner and not elided and suite[0].lineno > getattr(node, "lineno", 0):
                out.append((inner, suite[0].lineno, suite[-1].end_lineno, suite[0].col_offset))
        todo += [(x, depth) for name in ("handlers", "cases") for x in getattr(node, name, None) or []]
    return out


def collapsed(snippet: str, budget: int) -> str:
    """The snippet with its deepest, then longest, suites collapsed one after the other until it fits the budget.

    After at most 24 rounds, or where a snippet does not parse or nothing is left to collapse, whole lines are cropped
    from its end. A snippet that fits is unchanged.
    """
    if _tokens(snippet) <= budget:
        return snippet
    margin = len(snippet) - len(snippet.lstrip(" "))
    text = textwrap.dedent(snippet)
    for _ in range(ROUNDS):
        if _tokens(text) <= budget:
            break
        try:
            suites = _suites(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError):
            break
        if not suites:
            break
        _, first, last, column = max(suites, key=lambda s: (s[0], s[2] - s[1], -s[1]))
        lines = text.split("\n")
        lines[first - 1 : last] = [" " * column + MARK.format(n=last - first + 1)]
        text = "\n".join(lines)
    lines = textwrap.indent(text, " " * margin).split("\n")
    while lines and _tokens("\n".join(lines)) > budget:
        lines.pop()
    return "\n".join(lines)


def structurally_elided(snippet: Column, budget: int) -> Column:
    """`collapsed` as a column; null gives null."""
    return F.pandas_udf(lambda s: pd.Series([None if x is None else collapsed(x, budget) for x in s]), "string")(snippet)
