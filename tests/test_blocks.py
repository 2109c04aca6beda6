import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import blocks, dialogue, graph, windows
from marlstone.sources import manifests

PY = '''def f(a):
    """Doc."""
    x = 1; y = 2
    for i in a:
        g(i)
        h(i)
        k(i)
    # one
    # two
    z = 3
    if z: w = 1
    def inner():
        pass
    if x:
        w = 1
        return w
    return x
'''
C = """int f(int a)
{
    int i, n = 3;
    const char *t = "";
    a = n ? 1 : 2;
    switch (a) {
    case 1:
        n = 1;
        break;
    default:
        n = 0;
    }
    if (a) n = 2; else if (n) { b(); c(); } else d();
    do { a--; } while (a);
    return a;
}
"""
JS = """function f(a) {
  let b = 3, items = [];
  let c = 0;
  items = g(
    a,
    b
  )
  b = 4
  try {
    c = h(b);
  } catch (e) {
    c = null;
  }
  function inner() { return 1; }
  return c;
}
"""


def test_targets():
    t = blocks.targets(PY, "python")[0]
    assert (t.header_start, t.body_end, t.boundary_lines) == (1, 17, [4, 6, 7, 10, 11, 12, 14, 15, 16, 17]) and 3 not in t.boundary_lines
    assert t.segments == [(4, 9), (10, 11), (12, 13), (14, 14), (15, 16), (17, 17)] or t.segments[0] == (4, 9)
    c = blocks.targets(C, "c")[0]
    assert [s.start for s in c.statements if s.force_break] == [5] and c.segments == [(3, 4), (5, 5), (6, 15)] and {s.start: s.opens_block for s in c.statements if s.depth == 0}[6] == 7
    j = blocks.targets(JS, "javascript")[0]
    assert j.boundary_lines == [2, 3, 4, 8, 9, 14, 15] and [s.start for s in j.statements if s.is_def] == [14] and [(s.start, s.end) for s in j.statements if s.start == 4] == [(4, 7)]
    assert blocks.targets("def f(:", "python") == [] and blocks.targets("int f(", "c") == [] and blocks.targets("", "javascript") == []


@pytest.mark.parametrize("language", ["python", "c", "javascript"])
def test_statements_of_anything(language):
    rng = random.Random(8)
    words = ["if (a) ", "{", "}", "else ", "x = 1;", "\n", "for (;;) ", "return 1", "case 1: ", "do ", "while (b)", "(", ")", "int f(int a) {", "function g() {", "def f():\n    ", "try ", "catch (e) "]
    for _ in range(200):
        text = "".join(rng.choice(words) for _ in range(30))
        n = text.count("\n") + 1
        for t in blocks.targets(text, language):
            assert all(1 <= s.start <= s.end <= n for s in t.statements)
            assert all(a <= b for a, b in t.segments[:-1]) and [a for a, _ in t.segments] == sorted({a for a, _ in t.segments})


def test_deep_bodies_are_read():
    depth = 400
    text = "int f(void) {\n" + "if (a) {\n" * depth + "b();\n" + "}\n" * depth + "}\n"
    assert max(s.depth for s in blocks.targets(text, "c")[0].statements) == depth


def test_paragraphs_agree_with_the_windows(spark):
    files = spark.createDataFrame([("a.py", PY.encode(), "python"), ("b.c", C.encode(), "c"), ("c.js", JS.encode(), "javascript"), ("d", None, "c")], "file_key string, source_blob binary, language string")
    s = blocks.statements(files).withColumn("routine_id", F.concat_ws("\n", "file", "qualname", "header_start"))
    routines = s.groupBy("routine_id").agg(F.first("has_doc").alias("has_doc"), F.first("boundary_lines").alias("boundary_lines"), F.first("body_end").alias("body_end"))
    stmts = s.drop("file", "qualname", "header_start", "has_doc", "boundary_lines", "body_end")
    got = {}
    for r in windows.structural_breaks(stmts, routines).collect():
        got.setdefault(tuple(r.routine_id.split("\n")[:2]), []).append((r.first_line, r.last_line))
    want = {(f, t.qualname): t.segments for f, x, g in (("a.py", PY, "python"), ("b.c", C, "c"), ("c.js", JS, "javascript")) for t in blocks.targets(x, g)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_emitted_requests(spark):
    files = spark.createDataFrame([("a.py", PY.encode(), "python"), ("b.c", b"int f(void) {\n  // one\n  // two\n  x();\n}\n", "c")], "file_key string, source_blob binary, language string")
    got = {(r.file, r.qualname): r for r in blocks.emitted_requests(files).collect()}
    r = got["a.py", "f"]
    assert r.id == f"fn:f:{r.sig_hash}" and r.snippet == PY.rstrip("\n") and r.blocks.doc_summary == "Doc." and r["def"].answer is None
    kept = [c for c in r.blocks.chunks if c.preserve]
    assert [(c.anchor, c.answer, c.existing) for c in kept] == [("z = 3", "NONE", "    # one\n    # two")]
    assert got["b.c", "f"].blocks.chunks[0].answer == "NONE"
    assert not any(c.preserve for x in blocks.emitted_requests(files, False).collect() for c in x.blocks.chunks)


def test_numbered_bodies_and_segments(spark):
    lines = ["def f():", *[f"    a{i}" for i in range(9)]]
    d = spark.createDataFrame([(lines, [2, 10])], "l array<string>, b array<int>")
    v = d.select(blocks.numbered_body(F.col("l"), F.col("b"), F.lit(1), F.lit(10)).alias("v")).first().v
    assert v.split("\n") == ["    | def f():", "   2|     a0", "    | « 7 lines elided »", "  10|     a8"]
    p = lambda t, b, n: [tuple(x) for x in spark.createDataFrame([(t, b)], "t string, b array<int>").select(blocks.parsed_segments(F.col("t"), F.col("b"), F.lit(n)).alias("s")).first().s]
    assert p("2-4, 5–9; 5-6", [2, 5, 7], 8) == [(2, 4), (5, 8)] and p("at 7 and 2", [2, 5, 7], 8) == [(2, 6), (7, 8)] and p("3-4", [2], 8) == [] and p("", [2], 8) == [] and p("5-3", [5], 8) == [(5, 5)]


def test_imports_and_patterns():
    assert blocks.imports('import a from "b";\n// import c from "d"\nimport { x,\n y } from \'e\';\nconst f = require("g")\nimport "h"', "javascript") == [(1, "a from b"), (3, "{ x, y } from e"), (5, "f from g"), (6, "h")]
    assert blocks.imports('#include <a.h>\n/* #include "b.h" */\n# include "c.h"\n', "c") == [(1, "a.h (system)"), (3, "c.h (local)")] and blocks.imports("import os\n", "python") == [(1, "os")]
    assert list(blocks.anonymised("x = f(1, 'a') + y.z\nif x: pass\n")) == [(1, "v + f ( 0 , 0 ) + v . v"), (2, "if v : pass")] and list(blocks.anonymised("x = (")) == []


def test_patterns_of_sources_with_nulls(spark):
    nul = ["def f():\n    if x:\n        y = 1\n    z\0\0", "if x:\n  y\n \0\n", "x = '\0'\n", "\0", "# \0\ny = 1\n"]
    assert [list(blocks.anonymised(t)) for t in nul] == [[]] * len(nul)
    rows = [(f"{i}.py", bytearray(t.encode()), "python") for i, t in enumerate([*nul, "if x:\n    y = f(2)\n"])]
    files = spark.createDataFrame(rows, "file_key string, source_blob binary, language string").coalesce(1)
    assert sorted(map(tuple, blocks.line_patterns(files).collect())) == [("5.py", 1, "if v :"), ("5.py", 2, "v + f ( 0 )")]


def scripted(*rules):
    """A model that answers by what a prompt says, the first rule that fits."""

    def make():
        return lambda prompts: [next(reply for word, reply in rules if word in p) for p in prompts]

    return make


def test_definition_docs(spark):
    d = spark.createDataFrame([(1, "def f(): return alpha", "x"), (2, "def lazy(): pass", "x"), (3, "def bad(): pass", "x"), (4, None, "x"), (5, "def story(): pass", "x")], "i int, code string, doc string")
    m = scripted(("reply could not be used", "ok"), ("occur nowhere", "Uses `gone` still."), ("A reader objected", "Mended."), ("Text: Claims", "It claims too much."), ("Text: ", "NONE"), ("lazy", "Understood."), ("bad", "Uses `gone`."), ("story", "Claims all."), ("", "Uses `alpha`."))
    got = {r.i: (r.doc, r.status) for r in dialogue.definition_docs(d, ["i"], backend=m).collect()}
    assert got == {1: ("Uses `alpha`.", "ok"), 2: (dialogue.PLACEHOLDER, "failed"), 3: ("Uses `gone` still.", "unverified"), 4: (dialogue.PLACEHOLDER, "failed"), 5: ("Mended.", "ok")}
    assert dialogue.definition_docs(d.limit(0), ["i"]).count() == 0


def test_block_notes(spark):
    d = spark.createDataFrame([(i, f"{n}()") for i, n in enumerate(["fine", "none", "ghost", "low", "dull", "better"])], "i int, code string")
    m = scripted(
        ("from 1 to 3?\n\nLine: Low", "1"), ("from 1 to 3", "3"), ("add anything to the code? YES or NO.\n\nLine: Dull", "NO"), ("add anything", "YES"), ("only repeated the code. Say why the part is there, or reply NONE.\n\ndull", "Dull again"), ("only repeated", "Why it is there"),
        ("\n\nnone", "NONE"), ("\n\nghost", "Calls `gone`"), ("\n\nlow", "Low"), ("\n\ndull", "Dull"), ("\n\nbetter", "Dull"), ("", "# Keeps the order"),
    )
    got = {r.i: (r.note, r.status) for r in dialogue.block_notes(d, ["i"], backend=m).collect()}
    assert got == {0: ("Keeps the order", "note"), 1: (None, "none"), 2: (None, "ungrounded"), 3: (None, "low"), 4: (None, "obvious"), 5: ("Why it is there", "note")}
    assert {r.status for r in dialogue.block_notes(d, ["i"], threshold=4).collect()} == {"low"}


def test_one_liners_ask_once(spark):
    missing = spark.createDataFrame([("a", "f"), ("a", "f"), ("a", "gone")], "callee_file string, callee string")
    code = spark.createDataFrame([("a", "f", "x"), ("a", "f", "w"), ("b", "f", "y")], "file string, qualname string, code string")
    assert [tuple(r) for r in dialogue.one_liners(missing, code).collect()] == [("a", "f", "w")]


def test_priming(spark):
    d = spark.createDataFrame([("a.py", None), ("b.py", "The tree.")], "f string, b string")
    p = dialogue.priming(d, F.lit("Brief."), F.lit("Sum."), F.lit("Task."), F.col("f"), F.col("b"), F.lit("House."))
    got = {r.f: [(m.role, m.content) for m in r.messages] for r in p.collect()}
    assert got["a.py"][0] == ("system", "Brief.\n\nHouse.") and len(got["a.py"]) == 7 and len(got["b.py"]) == 9 and got["b.py"][2] == ("assistant", dialogue.ACK)


def test_staged(spark):
    rows = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c")], "file string, qualname string")
    levels = spark.createDataFrame([("f", "b", 1), ("f", "c", 5)], "file string, qualname string, level int")
    step = lambda r, done: r.withColumn("seen", F.lit(0 if done is None else done.count()))
    assert {r.qualname: r.seen for r in dialogue.staged(rows, levels, step, 3).collect()} == {"a": 0, "b": 1, "c": 2}
    assert dialogue.staged(rows.limit(0), levels, step, 3).count() == 0


def test_child_stubs(spark):
    s = spark.createDataFrame([("f", "A", "class", "class A", None, 1), ("f", "A.b", "def", "def b()", "A", 2), ("f", "A.c", "def", None, "A", 3), ("g", "A.d", "def", "def d()", "A", 1)], "file string, qualname string, kind string, signature string, parent_qualname string, start_line int")
    assert [tuple(r) for r in graph.child_stubs(s).collect()] == [("f", "A", 2, "def b() ...\ndef A.c ...")]


def test_manifests_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("m", "b.c", "c", "implementation", None, ["é"], ("1-2", " ")), ("m", "a.c", "c", "header", "s", [], ("1", "text")), ("n", "x.c", "c", None, None, None, (None, None))], f"part string, {manifests.FILES['filedoc'].replace('answer struct<range:string,description:string>', 'answer struct<range:string,description:string>')}")
    manifests.write_manifest(f, str(tmp_path / "d"), "filedoc", project_doc="About.")
    back = manifests.read_manifest(spark, str(tmp_path / "d"), "filedoc")
    got = {r.path: r for r in back.withColumn("waits", manifests.unfilled("filedoc", F.col("answer"))).collect()}
    assert {k: r.waits for k, r in got.items()} == {"a.c": False, "b.c": True, "x.c": True} and got["b.c"].entries == ["é"] and got["a.c"].project_doc == "About."
    with pytest.raises(Exception, match="not a reword manifest"):
        manifests.read_manifest(spark, str(tmp_path / "d"), "reword").collect()
    r = spark.createDataFrame([("m", "a.c", "c", "header", "draft", "ctx", None)], f"part string, {manifests.FILES['reword']}")
    manifests.write_manifest(r, str(tmp_path / "r"), "reword")
    assert manifests.read_manifest(spark, str(tmp_path / "r"), "reword").filter(manifests.unfilled("reword", F.col("answer"))).count() == 1


def test_overlays_caches_prompts_results(spark, tmp_path):
    d = spark.createDataFrame([("t", "low", "x"), ("t", "high", "y"), ("t", "high", "a"), ("u", "none", "z"), ("u", None, "z")], "name string, place string, text string")
    assert [tuple(r) for r in manifests.overlaid(d, ["name"], F.col("place"), ["high", "low"], "text").collect()] == [("t", "a")]
    w = spark.createDataFrame([("p", "full", "s1"), ("p", "short", "s1"), ("q", "full", None)], "path string, kind string, content_sha string")
    c = spark.createDataFrame([("p", "full", "s1", "b"), ("p", "full", "s1", "a"), ("p", "short", "s0", "old"), ("q", "full", None, "x")], "path string, kind string, content_sha string, text string")
    assert {(r.path, r.kind): (r.text, r.hit) for r in manifests.cached(w, c).collect()} == {("p", "full"): ("a", True), ("p", "short"): (None, False), ("q", "full"): (None, False)}
    for folder, name, text in (("a", "x.txt", "own"), ("b", "x.txt", "other"), ("b", "y.md", "more"), ("b", "z.py", "no")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    assert manifests.read_prompts(spark, str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "gone")) == {"x.txt": "own", "y.md": "more"}
    manifests.write_results(spark.createDataFrame([(32, None), (64, 1.5)], "n int, tps double"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"n":32,"tps":null}', '{"n":64,"tps":1.5}']
