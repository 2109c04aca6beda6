"""Definitions, calls, imports and statements of Python sources: one parse for each file, one row for each finding."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.tables import spread

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _kind(node: ast.AST) -> str:
    return {ast.FunctionDef: "def", ast.AsyncFunctionDef: "async def", ast.ClassDef: "class"}[type(node)]


def _accessor(node: ast.AST) -> str | None:
    for d in getattr(node, "decorator_list", ()):
        if isinstance(d, ast.Name) and d.id == "property":
            return "getter"
        if isinstance(d, ast.Attribute) and d.attr in ("setter", "getter", "deleter"):
            return d.attr
    return None


def _calls(node: ast.AST) -> list[dict]:
    out, todo = [], list(ast.iter_child_nodes(node))[::-1]
    while todo:
        n = todo.pop()
        if isinstance(n, (*_DEFS, ast.Lambda)):
            continue
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                out.append({"name": f.id, "kind": "free", "line": n.lineno})
            elif isinstance(f, ast.Attribute):
                own = isinstance(f.value, ast.Name) and f.value.id == "self"
                out.append({"name": f.attr, "kind": "self" if own else "method", "line": n.lineno})
        todo.extend(list(ast.iter_child_nodes(n))[::-1])
    return out


class _WithoutDocs(ast.NodeTransformer):
    def _plain(self, node: ast.AST) -> ast.AST:
        self.generic_visit(node)
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            node.body = node.body[1:] or [ast.Pass()]
        return node

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = visit_Module = _plain


def node_signature(node: ast.AST) -> str:
    """The first 12 hex digits of the SHA-256 of a definition's tree, whose docstrings are taken out: comments, layout and
    docs don't change it. It depends on the interpreter's version, so it is not kept beyond a run."""
    return hashlib.sha256(ast.dump(node).encode("utf-8", "surrogatepass")).hexdigest()[:12]


def _header(node: ast.AST) -> str:
    types = f"[{', '.join(map(ast.unparse, node.type_params))}]" if getattr(node, "type_params", None) else ""
    if isinstance(node, ast.ClassDef):
        bases = [ast.unparse(x) for x in (*node.bases, *node.keywords)]
        return f"class {node.name}{types}" + (f"({', '.join(bases)})" if bases else "")
    a = node.args
    plain = not (a.defaults or a.kwonlyargs or a.vararg or a.kwarg or a.posonlyargs or any(x.annotation for x in a.args))
    args = ", ".join(x.arg for x in a.args) if plain else ast.unparse(a)
    return f"{_kind(node)} {node.name}{types}({args})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def definitions(source: bytes, signed: bool = False) -> list[tuple]:
    """(qualname, kind, start, end, depth, parent, doc, calls, def line, signature, node signature, inline) of a Python
    source; none if it does not parse. The start is that of the first decorator; inline: the body shares the header's line.
    The node signature is worked out only if asked for."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out, todo = [], [(tree, None, 0)]
    nodes: dict[int, ast.AST] = {}
    while todo:
        node, parent, depth = todo.pop()
        for n in ast.iter_child_nodes(node):
            if isinstance(n, _DEFS):
                role = _accessor(n)
                plain = f"{parent}.{n.name}" if parent else n.name
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                out.append((f"{plain}.{role}" if role else plain, _kind(n), start, n.end_lineno, depth, parent, ast.get_docstring(n), _calls(n), n.lineno, _header(n), None, n.body[0].lineno == n.lineno))
                nodes[len(out) - 1] = n
                todo.append((n, plain, depth + 1))
            else:
                todo.append((n, parent, depth))
    if signed:
        _WithoutDocs().visit(tree)
        out = [(*x[:10], node_signature(nodes[i]), x[11]) for i, x in enumerate(out)]
    return sorted(out, key=lambda x: (x[2], x[0]))


def imports(source: bytes) -> list[tuple[int, str]]:
    """(line, text) of each import, in line order."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for n in ast.walk(tree):
        name = lambda a: f"{a.name} as {a.asname}" if a.asname else a.name
        if isinstance(n, ast.Import):
            out += [(n.lineno, name(a)) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [(n.lineno, f"{name(a)} from {'.' * n.level}{n.module or ''}") for a in n.names]
    return sorted(out)


def statements(source: bytes) -> list[tuple]:
    """(routine, start, end, depth, is_return, is_def, opens_block, first_in_scope, closed_block, body_end, has_doc,
    boundary) of the statements of each routine's body; nested routines are one statement."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []

    def body(routine: str, stmts: list, depth: int, end: int, doc: bool, top: bool) -> int:
        before = None
        for i, s in enumerate(stmts):
            inner = [] if isinstance(s, _DEFS) else [x for name in ("body", "orelse", "finalbody") for x in [getattr(s, name, None)] if isinstance(x, list) and x and isinstance(x[0], ast.stmt)]
            inner += [h.body for h in getattr(s, "handlers", [])] + [c.body for c in getattr(s, "cases", [])]
            size = max([x[-1].end_lineno - x[0].lineno + 1 for x in inner], default=0)
            closed = before or 0
            out.append((routine, s.lineno, s.end_lineno, depth, isinstance(s, ast.Return), isinstance(s, _DEFS), size, top and i == 0, closed, end, doc, top or i > 0))
            for x in inner:
                body(routine, x, depth + 1, end, doc, False)
            before = size
        return before or 0

    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            stmts = n.body
            doc = ast.get_docstring(n) is not None
            body(f"{n.name}@{n.lineno}", stmts[1:] if doc else stmts, 0, n.end_lineno, doc, True)
    return out


_CALL = "array<struct<name:string,kind:string,line:int>>"
_DEF = f"file string, qualname string, kind string, start_line int, end_line int, depth int, parent_qualname string, existing_doc string, calls {_CALL}, def_line int, signature string, node_sig string, inline boolean"


def _mapped(files: DataFrame, find, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = files.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import warnings

        warnings.simplefilter("ignore")
        for b in batches:
            rows = [(k, *x) for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in find(blob)]
            cols = list(zip(*rows)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], names=arrow.names)

    python = files.filter("language = 'python' and source_blob is not null").select("file_key", "source_blob")
    return spread(python).mapInArrow(run, schema)


def python_definitions(files: DataFrame, signed: bool = False) -> DataFrame:
    """Definitions of all Python files, with their calls, docstrings and signatures; none of files that don't parse.

    start_line is the first decorator's, def_line that of the `def` or `class` itself.
    """
    return _mapped(files, partial(definitions, signed=signed), _DEF)


def python_imports(files: DataFrame) -> DataFrame:
    """Imports of all Python files: (file, line, text)."""
    return _mapped(files, imports, "file string, line int, text string")


def python_statements(files: DataFrame) -> DataFrame:
    """Statements of all routines of Python files, for the paragraph operator."""
    return _mapped(files, statements, "file string, routine string, start int, end int, depth int, is_return boolean, is_def boolean, opens_block int, first_in_scope boolean, closed_block int, body_end int, has_doc boolean, boundary boolean")


def paragraphs(files: DataFrame) -> DataFrame:
    """Paragraph ranges of all Python routines: (file, routine, first_line, last_line)."""
    from marlstone.operators.windows import structural_breaks

    s = python_statements(files).withColumn("routine_id", F.concat_ws("\n", "file", "routine")).distinct()
    stmts = s.select("routine_id", "start", "depth", "is_return", "is_def", "opens_block", "first_in_scope", "closed_block", F.lit(None).cast("int").alias("merge_anchor"), F.lit(False).alias("force_break")).dropDuplicates(["routine_id", "start"])
    routines = s.groupBy("routine_id").agg(F.max("has_doc").alias("has_doc"), F.collect_set(F.when(F.col("boundary"), F.col("start"))).alias("boundary_lines"), F.max("body_end").alias("body_end"))
    b = structural_breaks(stmts, routines)
    return b.select(F.split("routine_id", "\n")[0].alias("file"), F.split("routine_id", "\n")[1].alias("routine"), "first_line", "last_line")
