import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import replies as R
from marlstone.operators import definitions, headers, patching, queue

C = ["/* banner */", "#include <x.h>", "static int x; /* note */", "int f(void)", "{", "    return x;", "}", "// old", "// words", "int g(void) { return 1; }", "/**", " * Kept.", " */", "", "int h(void);"]
PY = ["@d", "def f(a,", "      b):", "    # hi", "    return a", "def g(): return 1", "class A:", "    'x'", "    y = '# no comment'", "    def m(self):", "        return '''", "# text", "'''"]


def one(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).first().x


def test_headers_replace_what_they_wrote():
    notes = [(4, "Gives x."), (10, "Gives one.\nAlways."), (15, "Apart.")]
    p = patching.documented_lines(C, "c", notes)
    assert (p.applied, p.refused) == (3, 0) and p.lines[:3] == C[:3] and "// old" not in p.lines and "/**" in p.lines
    at = {x: i + 1 for i, x in enumerate(p.lines)}
    again = patching.documented_lines(p.lines, "c", [(at["int f(void)"], "Gives x."), (at["int g(void) { return 1; }"], "Gives one.\nAlways."), (at["int h(void);"], "Apart.")])
    assert again.lines == p.lines
    line = patching.documented_lines(["// a", "int f(void) { return 0; }"], "c", [(2, "New.")])
    assert line.lines == ["// New.", "int f(void) { return 0; }"]
    js = patching.documented_lines(["x();", "function f() {}"], "javascript", [(2, "Says.")])
    assert js.lines == ["x();", "", "/**", " * Says.", " */", "function f() {}"] and patching.documented_lines(js.lines, "javascript", [(6, "Says.")]).lines == js.lines


def test_docstrings_replace_what_they_wrote():
    p = patching.documented_lines(PY, "python", [(2, "Does."), (6, "Inline."), (7, "A.\n\nB")])
    assert (p.applied, p.refused, p.inline) == (2, 0, 1) and p.lines[3:7] == ['    """', "    Does.", '    """', ""] and "    'x'" not in p.lines
    at = {x: i + 1 for i, x in enumerate(p.lines)}
    assert patching.documented_lines(p.lines, "python", [(at["def f(a,"], "Does."), (at["class A:"], "A.\n\nB")]).lines == p.lines
    assert patching.documented_lines(["def f(:"], "python", [(1, "x")]) == (["def f(:"], 0, 1, 0)


def test_a_bad_note_costs_no_other():
    p = patching.documented_lines(["int f(void) { return 0; }", "int g(void) { return 0; }", "// a */", "/* b"], "c", [(1, "Fine."), (2, "Ends */ int y;")])
    assert (p.applied, p.refused) == (1, 1) and "/**" in p.lines and not any("int y" in x for x in p.lines)
    q = patching.documented_lines(["def f():", "    return 1", "def g():", "    return 2"], "python", [(1, 'Ends """ + x + """'), (3, "Fine.")])
    assert (q.applied, q.refused) == (1, 1) and "    Fine." in q.lines


def test_notes_within_bodies():
    js = ["function f() {", "  g();", "  // old", "  h();", "    // deeper", "  return `a // b`;", "}"]
    p = patching.noted_lines(js, "javascript", [("f", 2, "first"), ("f", 4, "new"), ("f", 6, None), ("f", 99, "lost")])
    assert p.lines == ["function f() {", "  // first", "  g();", "", "  // new", "  h();", "    // deeper", "", "  return `a // b`;", "}"] and (p.applied, p.refused) == (1, 0)
    again = patching.noted_lines(p.lines, "javascript", [("f", 3, "first"), ("f", 6, "new"), ("f", 9, None)])
    assert again.lines == p.lines


@pytest.mark.parametrize("language", ["c", "python"])
def test_patches_never_change_code_whatever_they_say(language):
    rng = random.Random(5)
    lines = C if language == "c" else PY
    for _ in range(60):
        notes = [(rng.randrange(1, len(lines) + 1), "".join(rng.choice(["a", "\n", "*/", "/*", '"""', "#", "\\", " x", "// "]) for _ in range(6)) or "x") for _ in range(4)]
        before = patching._code(lines, language, False)
        assert patching._code(patching.documented_lines(lines, language, notes).lines, language, False) == before
        p = patching.noted_lines(lines, language, [("r", n, t) for n, t in notes])
        assert patching._code(p.lines, language, True) == patching._code(lines, language, True)


def test_walls():
    assert patching.wall(["#!/x", "# Copyright", "", "def f():", "    '''doc'''", "    # c", "    x = '# no' # yes", "", "def g():", "    'only'"], "python") == ["#!/x", "# Copyright", "def f():", "    x = '# no'", "def g():", "    pass"]
    w = patching.wall(["/* lic */", "", "int f(void) { // c", "", "  /* d */ return '\"'; }"], "c")
    assert w == ["/* lic */", "int f(void) {", "   return '\"'; }"] and patching.wall(w, "c") == w


FILES = "file_key string, language string, source_lines array<binary>, n_applied int, notes string"


def test_patches_on_tables(spark):
    b = lambda xs: [x.encode("latin-1") for x in xs]
    f = spark.createDataFrame([("c", "c", b(C) + [b"// \xff"], 1, "z"), ("n", "c", None, 1, "z"), ("e", "python", [], 1, "z"), ("u", None, [b"x"], 1, "z")], FILES)
    n = spark.createDataFrame([("c", 4, "Gibt ü."), ("c", 4, "Gibt ü."), ("c", None, "lost"), ("c", 5, None), ("n", 1, "x"), ("u", 1, "x"), ("gone", 1, "x")], "file_key string, line_no int, text string")
    got = {r.file_key: r for r in patching.documented(f, n).collect()}
    assert set(got) == {"c", "n", "e", "u"} and " * Gibt ü.".encode() in [bytes(x) for x in got["c"].source_lines] and bytes(got["c"].source_lines[-1]) == b"// \xff"
    assert got["n"].source_lines is None and got["u"].n_applied == 0 and patching.documented(f.limit(0), n).count() == 0
    m = n.withColumn("routine", F.lit(None).cast("string"))
    assert {r.file_key: r.n_applied for r in patching.noted(f, m).collect()} == {"c": 1, "n": 0, "e": 0, "u": 0}


def zone(spark, lines, language):
    d = spark.createDataFrame([(lines, language)], "l array<string>, g string")
    z = d.select(headers.header_zone(F.col("l"), F.col("g")).alias("z")).first().z
    return None if z is None else ([tuple(e) for e in z.entries], z.insert_at, z.prefix, z.fresh)


def test_header_zones(spark):
    c = ["/*", " * Copyright 2020", " *", " * Reads rows.", " */", "// more", "", "/* one line */", "#include <x.h>", "// late"]
    assert zone(spark, c, "c") == ([(2, " * ", "Copyright 2020"), (4, " * ", "Reads rows."), (6, "// ", "more")], 8, "// ", False)
    assert zone(spark, ["#!/usr/bin/env node", "x();"], "javascript") == ([], 1, "", True) and zone(spark, ["", " "], "c") is None and zone(spark, [], "c") is None and zone(spark, None, "c") is None
    py = ["#!/x", "# note", '"""', "Reads", "", "  more", '"""', "x = 1"]
    assert zone(spark, py, "python") == ([(4, "", "Reads"), (6, "  ", "more")], 6, "  ", False)
    assert zone(spark, ["# note", "x = 1"], "python") == ([], 1, "", True) and zone(spark, ['"""All in one."""', "x"], "python")[0] == []


def test_skeletons(spark):
    lines = ["/* Top. */", "", "#define A 1", "#define B(x) \\", "    (x)", "#defined 3", "int f(void);", "int f(void) { return 0; }", ""]
    h = spark.createDataFrame([("a.c", "c", lines), ("n.c", "c", None)], "file string, language string, lines array<string>").withColumn("zone", headers.header_zone(F.col("lines"), F.col("language")))
    s = spark.createDataFrame([("a.c", "f", "function", "int f(void)", 8, 0, "/** Gives ü. */"), ("a.c", "g", "declaration", None, 9, None, " "), ("b.py", "A", "class", "class A", 1, 0, "Holds."), ("b.py", "A.f", "def", "def f()", 2, 1, "Does.\n  More.")], "file string, qualname string, kind string, signature string, start_line int, depth int, existing_doc string")
    got = {r.file: (r.skeleton.encode("latin-1").decode(), r.n_symbols) for r in headers.skeletons(h, s).collect()}
    assert got["a.c"] == ("/* Top. */\n\n#define A 1\n#define B(x) ...\n\n/** Gives ü. */\nint f(void)\n\ndeclaration g", 2)
    assert got["b.py"] == ("class A\n    Holds.\n\n    def f()\n        Does.\n        More.", 2) and headers.skeletons(h, s.limit(0)).count() == 0


def test_descriptions(spark):
    rows = [
        ("a", "c", ["/*", " * Copyright 2020", " * old", " */", "int x;"], 2, 2, "new words"), ("l", "c", ["/*", " * Copyright 2020", " * old", " */", "int x;"], 1, 2, "new"), ("f", "c", ["int x;"], None, None, "new"),
        ("p", "c", ["// old", "int x;"], None, None, "/* new */"), ("y", "python", ["x = 1"], None, None, "new"), ("b", "c", ["// a"], None, None, " "), ("z", "c", [" "], None, None, "new"), ("o", "c", ["// a", "x;"], 1, 9, "new"),
    ]
    d = spark.createDataFrame(rows, "file string, language string, lines array<string>, first int, last int, description string").withColumn("zone", headers.header_zone(F.col("lines"), F.col("language")))
    got = {r.file: (r.placed, r.lines) for r in headers.described(d).collect()}
    assert got["a"] == ("replaced", ["/*", " * Copyright 2020", " * new words", " */", "int x;"]) and got["l"] == (None, rows[1][2])
    assert got["f"] == ("fresh", ["/*", " * new", " */", "", "int x;"]) and got["p"] == ("appended", ["// old", "//", "// new", "int x;"]) and got["y"] == ("fresh", ['"""', "new", '"""', "", "x = 1"])
    assert got["b"][0] is got["z"][0] is got["o"][0] is None


def test_recorded_ranges(spark):
    live = spark.createDataFrame([("a", ["// one", "// two", "x;"]), ("b", ["// else", "x;"])], "file string, lines array<string>").select("file", headers.header_zone(F.col("lines"), F.lit("c")).alias("zone"))
    rec = spark.createDataFrame([("a", ["one", "two"], "2-9", "d"), ("b", ["other"], "1", "d")], "file string, entries array<string>, range string, description string")
    assert {r.file: (r.first, r.last, r.bound) for r in headers.recorded_ranges(rec, live).collect()} == {"a": (2, 2, True), "b": (1, 1, False)}


def test_reply_cleaners(spark):
    c = F.col("t")
    assert one(spark, R.docstring_body(c), '```python\n"""\n    Does.\n\n      More.\n    """\n```') == "Does.\n\n  More." and one(spark, R.docstring_body(c), None) is None
    assert one(spark, R.comment_body(c, "c"), "/*\n * not a mark\n*\n*/") == "* not a mark" and one(spark, R.comment_body(c, "c"), " `NONE` ") is None and one(spark, R.comment_body(c, "python"), "# NONE") is None and one(spark, R.comment_body(c, "c"), "// a // b") == "a // b"
    assert one(spark, R.summary_line(c, "python"), "\n# `Reads rows`\nmore") == "Reads rows" and one(spark, R.summary_line(c, "c"), "N/A") == "" and one(spark, R.summary_line(c, "c"), None) == ""
    assert one(spark, R.description_body(c), "```c\n/**\n * Reads.\n// Writes.\n*/\n```") == "Reads.\nWrites."
    assert one(spark, R.wrapped(c, 9), " aa bb  cccccccccccc dd\n ee ") == ["aa bb", "cccccccccccc", "dd ee"] and one(spark, R.wrapped(c, 5), " ") == []


def test_rebinding_leaves_stale_answers_out(spark):
    import hashlib

    lines = [b"def f():", b"    return 1", b"def f():", b"    return 1", b"def g():", b"    return '\xff'"]
    files = spark.createDataFrame([("a", lines), ("n", None)], "file_key string, source_lines array<binary>")
    symbols = spark.createDataFrame([("a", "f", 1, 2), ("a", "f", 3, 4), ("a", "g", 5, 6), ("a", "g", 5, 99), ("gone", "f", 1, 2), ("a", "x", None, 2)], "file string, qualname string, start_line int, end_line int")
    live = definitions.routine_hashes(files, symbols)
    h = hashlib.sha256(b"def f():\n    return 1").hexdigest()[:16]
    assert {(r.qualname, r.start_line) for r in live.collect()} == {("f", 1), ("f", 3), ("g", 5)} and live.filter("qualname = 'f'").first().text_hash == h
    req = "file string, id string, qualname string, sig_hash string, `def` struct<answer:string>, issued_at timestamp_ntz"
    q = spark.createDataFrame([("a", "1", "f", h, ("old",), None), ("a", "2", "f", h, ("new",), None), ("a", "3", "g", "stale", ("lost",), None), ("a", "4", "f", h, None, None)], req)
    assert [(r.qualname, r.start_line, r.answer) for r in queue.rebound(q, live).collect()] == [("f", 1, "new")]


def test_snippets_looked_up_by_reference(spark):
    s = "file string, id string, snippet string, snippet_ref string"
    q = spark.createDataFrame([("a", "1", "text", None), ("a", "2", None, "1"), ("b", "3", None, "nowhere"), ("b", "4", None, None), (None, None, None, "1")], s)
    got = {(r.file, r.id): r.snippet for r in queue.inlined_snippets(q, q, 3).collect()}
    assert got == {("a", "1"): "text", ("a", "2"): "text", ("b", "3"): None, ("b", "4"): None, (None, None): "text"}
