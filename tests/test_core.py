import random
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marlstone.functions import chat
from marlstone.functions import text as T
from marlstone.operators import braces, definitions, graph, grounding, headers, loading, model, order, parse, patch, queue, windows
from marlstone.plans import catalog
from marlstone.sources import files as sources
from marlstone.streaming import intake


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_predicates(spark):
    legal = ["Copyright 2020", "SPDX-License-Identifier: X", "Apache License", "MIT License", "the GNU thing", "© me", "Permission is hereby granted", "Redistribution and use", "without warranty", "All rights reserved"]
    prose = ["Parses the header of a packet", "Keeps a cache of rows", "See the notes", ""]
    assert all(one(spark, T.looks_legal(F.col("t")), t=x) for x in legal) and not any(one(spark, T.looks_legal(F.col("t")), t=x) for x in prose)
    assert one(spark, T.looks_listy(F.col("t")), t="1. **a**\n2. b") and one(spark, T.looks_listy(F.col("t")), t="# A\n## B") and not one(spark, T.looks_listy(F.col("t")), t="a - b - c")
    assert one(spark, T.without_list_markers(F.col("t")), t="- a\n2) **b** c") == "a\nb c"
    assert [one(spark, T.acknowledges(F.col("t")), t=x) for x in ("OK.", "Understood!", "ok, I will", "oklahoma", "", None)] == [True, True, True, False, False, False]
    assert [one(spark, T.declines(F.col("t")), t=x) for x in ("NONE", "`none`.", "None: it is clear", "No", None)] == [True, True, True, False, False]
    assert [one(spark, T.score(F.col("t")), t=x) for x in ("3", "score: 9", "0", "none", None)] == [3, 3, 1, 2, 2]
    assert one(spark, T.verdict(F.col("t"), "NO", "YES"), t="\nyes or no") == "NO" and one(spark, T.verdict(F.col("t"), "NO"), t="nothing") is None


def test_classified_ranges(spark):
    cases = {"2-4": (2, 4), "range: 1 to 2": (1, 2), "3": (3, 3), "NONE": None, "none.": None, "": None, "4-99": (4, 5), "0-2": (1, 2), "5-2": None}
    for reply, want in cases.items():
        got = one(spark, T.classified_range(F.col("t"), F.lit(5)), t=reply)
        assert (tuple(got) if got else None) == want, reply
    assert one(spark, T.classified_range(F.col("t"), F.lit(0)), t="1") is None


def test_rendering_and_filling(spark):
    assert one(spark, T.comment_lines(F.col("t"), F.lit("  "), "# "), t="a\n\nb") == ["  # a", "  #", "  # b"]
    assert one(spark, T.comment_lines(F.col("t"), F.lit(""), "// ", "/*", " * ", " */"), t="a\nb") == ["/*", " * a", " * b", " */"]
    assert one(spark, T.comment_lines(F.col("t"), F.lit(""), "// ", "/*", " * ", " */"), t="a") == ["// a"]
    assert one(spark, T.filled(F.col("t"), a=F.lit("{b}!"), b=F.lit("x")), t="{a} {b} {c}") == "x! x {c}"


MESSAGES = [("system", " be brief "), ("user", "a"), ("user", "b"), ("assistant", "c"), ("tool", "z"), ("user", " "), ("user", "d")]


@pytest.mark.parametrize(
    "name, want",
    [
        ("qwen", "<|im_start|>system\nbe brief<|im_end|><|im_start|>user\na<|im_end|><|im_start|>user\nb<|im_end|><|im_start|>assistant\nc<|im_end|><|im_start|>user\nd<|im_end|><|im_start|>assistant\n"),
        ("mixtral", "[INST] a [/INST][INST] b [/INST]c[INST] d [/INST]"),
        ("llama-2", "[INST] a [/INST][INST] <<SYS>>\nbe brief\n<</SYS>>\n\nb [/INST]c[INST] d [/INST]"),
        ("phi3", "<|system|>\nbe brief<|end|>\n<|user|>\na<|end|>\n<|user|>\nb<|end|>\n<|assistant|>\nc<|end|>\n<|user|>\nd<|end|>\n<|assistant|>\n"),
    ],
)
def test_chat(spark, name, want):
    d = spark.createDataFrame([(MESSAGES,)], "m array<struct<role:string,content:string>>")
    assert d.select(chat.prompt(F.col("m"), name).alias("p")).first().p == want
    with pytest.raises(KeyError):
        chat.prompt(F.col("m"), "unknown")


def test_elision_and_crops(spark):
    lines = [f"header {i}" for i in range(2)] + [f"line {i:02}" for i in range(60)]
    e = lambda b: one(spark, windows.elided(F.col("l"), 2, b), l=lines)
    assert e(10_000).n_omitted == 0 and e(1)[:] == (0, 0, 60)
    x = e(100)
    assert x.n_head > 0 and x.n_tail > 0 and x.n_head + x.n_tail + x.n_omitted == 60
    assert one(spark, windows.head_crop(F.col("l"), 8), l=lines) == lines[:1]
    assert one(spark, windows.head_crop(F.col("l"), 10_000), l=lines) == lines and one(spark, windows.head_crop(F.col("l"), 0), l=["a"]) == []


def reference_chunks(lines, budget):
    cost = lambda x: -(-len(x.encode()) // 2)
    out, now, used = [], [], 0
    for x in lines:
        c = cost(x) + 1
        if c > budget:
            if now:
                out.append("\n".join(now))
            now, used = [], 0
            n = max(1, int(budget * max(1, len(x) // max(1, cost(x))) * 0.9))
            out += [x[i : i + n] for i in range(0, len(x), n)] or [x]
            continue
        if now and used + c > budget:
            out.append("\n".join(now))
            now, used = [], 0
        now.append(x)
        used += c
        if not x.strip() and used >= budget * 0.75:
            out.append("\n".join(now))
            now, used = [], 0
    return out + (["\n".join(now)] if now else [])


def test_chunks_against_brute_force(spark):
    rng = random.Random(1)
    cases = [["x" * rng.choice([0, 1, 9, 30, 200]) for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<string>")
    for r in d.select("i", windows.chunks(F.col("l"), 40).alias("c")).collect():
        assert r.c == reference_chunks(cases[r.i], 40)


def test_groups(spark):
    g = lambda c, b: spark.createDataFrame([(c,)], "c array<int>").select(windows.groups(F.col("c"), b).alias("g")).first().g
    assert g([10, 10, 10, 10, 10], 40) == [0, 0, 1, 1, 2] and g([900, 900], 10) == [0, 1] and g([1, 1, 1], 999) == [0, 1, 1] and g([5], 1) == [0] and g([], 5) == []


def test_structural_breaks(spark):
    s = spark.sql("SELECT 'a' AS routine_id, start, depth, is_return, is_def, opens_block, first_in_scope, closed_block, CAST(NULL AS INT) AS merge_anchor, false AS force_break FROM (VALUES (2,0,false,false,0,true,0),(3,0,false,false,0,false,0),(4,0,false,false,4,false,0),(6,1,false,false,0,false,0),(8,0,false,false,0,false,4),(9,0,true,false,0,false,0)) t(start,depth,is_return,is_def,opens_block,first_in_scope,closed_block)")
    r = spark.sql("SELECT 'a' AS routine_id, true AS has_doc, array(2,3,4,6,8,9) AS boundary_lines, 9 AS body_end")
    assert sorted(x.first_line for x in windows.structural_breaks(s, r).collect()) == [2, 4, 8, 9]
    got = windows.structural_breaks(s, r.withColumn("has_doc", F.lit(False))).collect()
    assert sorted((x.first_line, x.last_line) for x in got) == [(2, 3), (4, 7), (8, 8), (9, 9)]


def test_probe_stops_early(spark):
    rows = [("r", 1, 32, 10.0, True), ("r", 2, 64, 14.0, True), ("r", 3, 128, 14.0, True), ("r", 4, 256, 13.5, True), ("r", 5, 512, 9.0, True), ("r", 6, 1024, 20.0, True), ("x", 1, 32, 5.0, True), ("x", 2, 64, 6.0, False), ("x", 3, 128, 9.0, True)]
    got = windows.best_probe(spark.createDataFrame(rows, "run string, step int, n int, metric double, ok boolean")).collect()
    assert {(r.run, r.best_n, r.best_metric) for r in got} == {("r", 128, 14.0), ("x", 32, 5.0)}


SYMBOL = "file string, qualname string, kind string, parent_qualname string, start_line int, depth int, end_line int, loaded_at timestamp, calls array<struct<name:string,kind:string,line:int>>"


def symbols(spark, rows):
    t = datetime(2030, 1, 1)
    return spark.createDataFrame([(f, q, k, p, i, 0, i, t, [(n, kind, i) for n, kind in calls] if calls is not None else None) for i, (f, q, k, p, calls) in enumerate(rows)], SYMBOL)


def edges(spark, rows):
    return {(r.file, r.caller, r.callee_file, r.callee) for r in graph.call_edges(symbols(spark, rows)).collect()}


def test_call_resolution(spark):
    f = lambda file, name, calls=(): (file, name, "def", None, [(c, "free") for c in calls])
    assert edges(spark, [f("a", "clamp"), f("b", "clamp"), f("a", "go", ["clamp"])]) == {("a", "go", "a", "clamp")}
    assert edges(spark, [f("a", "clamp"), f("b", "clamp"), f("c", "go", ["clamp"])]) == set()
    assert edges(spark, [f("a", "clamp"), f("c", "go", ["clamp"])]) == {("c", "go", "a", "clamp")}
    assert edges(spark, [f("a", "x", ["y"]), f("a", "y", ["x", "y"])]) == {("a", "x", "a", "y"), ("a", "y", "a", "x")}
    m = lambda c, name: ("a", f"{c}.{name}", "def", c, None)
    k = lambda c: ("a", c, "class", None, [])
    rows = [k("A"), k("B"), m("A", "draw"), m("B", "draw"), m("A", "paint"), ("a", "go", "def", None, [("draw", "method"), ("paint", "method")]), ("a", "A.run", "def", "A", [("draw", "self"), ("gone", "self")])]
    assert edges(spark, rows) == {("a", "go", "a", "A.paint"), ("a", "A.run", "a", "A.draw")}
    assert edges(spark, []) == set()


def test_callee_notes_are_capped(spark):
    rows = [("a", f"f{i}", "def", None, []) for i in range(10)] + [("a", "go", "def", None, [(f"f{i}", "free") for i in range(10)])]
    s = symbols(spark, rows)
    c = s.select("file", "qualname", F.lit("does").alias("contract"))
    r = graph.callee_notes(graph.call_edges(s), c, 3).first()
    assert r.n_notes == 3 and r.notes.split("\n") == ["f0: does", "f1: does", "f2: does"]


def levels(df):
    return {r.node: (r.component, r.level) for r in df.collect()}


ORDER = [("core", "util"), ("util", "base"), ("app", "core"), ("app", "util"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("n", "n"), ("x", "base"), (None, "a"), ("core", "util")]


@pytest.mark.parametrize("local", [0, 3, 1000])
def test_dependency_order(spark, local):
    e = spark.createDataFrame(ORDER, "src string, dst string")
    want = {"base": ("base", 0), "util": ("util", 1), "core": ("core", 2), "app": ("app", 3), "x": ("x", 1), "y": ("x", 1), "z": ("x", 1), "w": ("w", 2)}
    assert levels(order.dependency_order(e, local)) == want
    assert order.dependency_order(e.limit(0), local).count() == 0


def test_dependency_order_of_long_chains_and_cycles(spark):
    chain = [(f"n{i + 1}", f"n{i}") for i in range(1000)] + [(f"c{i:02}", f"c{(i + 1) % 50:02}") for i in range(50)] + [("c07", "n500"), ("last", "c31")]
    got = levels(order.dependency_order(spark.createDataFrame(chain, "src string, dst string")))
    assert got["n1000"] == ("n1000", 1000) and {got[f"c{i:02}"] for i in range(50)} == {("c00", 501)} and got["last"][1] == 502


def test_components_by_rounds_and_in_one_task_agree(spark):
    rng = random.Random(4)
    for k in range(2):
        e = spark.createDataFrame([(f"v{rng.randrange(14)}", f"v{rng.randrange(14)}") for _ in range(22)], "src string, dst string")
        a, b = ({(r.node, r.component) for r in order.components(e, local).collect()} for local in (0, 1000))
        assert a == b


def test_ordered_items(spark):
    items = spark.createDataFrame([("f", "a", 1), ("f", "b", 2), ("f", "c", 3), ("f", "c", 4)], "file string, name string, line int")
    first = spark.createDataFrame([("f", "c", 1), ("f", "a", 2), ("g", "b", 1)], "file string, name string, pos int")
    got = {(r.name, r.line): r.position for r in order.ordered_items(items, first, "name", ["file"], ["line"]).collect()}
    assert got == {("c", 3): 1, ("c", 4): 2, ("a", 1): 3, ("b", 2): 4}


def test_scans_are_narrow():
    """What the plans of queries read: sources never twice over, requests without their snippets where none are asked for."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    read = lambda name: " ".join(x for x in catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x)
    for name in ("line_profile", "code_signatures", "header_zones", "comment_styles", "line_bands"):
        assert "source_lines" in read(name) and not any(x in read(name) for x in ("source_blob", "content_sha", "repo", "scanned_at")), name
    assert not any(x in read("completeness") for x in ("snippet", "sig_hash", "kind"))
    assert "source" not in read("content_cache").replace("/source", "") and "signature" not in read("deepest_first")


REQUEST = sources.REQUEST + ", issued_at timestamp_ntz, received_at timestamp_ntz"


def requests(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) if len(r) == 9 else r for r in rows], REQUEST)


def request(i, answer, chunks=(), snippet=None, ref=None):
    return (i, "f.py", i, "def", "h", snippet, ref, (answer,), (None, None, None, None, [(k, None, None, None, None, a) for k, a in chunks]))


def test_work_queue(spark):
    q = requests(spark, [request("alpha", None, [(0, None), (2, " ")], "def alpha"), request("beta", "", (), None, "alpha"), request("gamma", "done", [(0, None)]), request("zeta", "done", [(0, "yes")])])
    got = {r.id: (r["rank"], r.batch) for r in queue.batches(q, 2).collect()}
    assert got == {"alpha": (1, 0), "beta": (2, 0), "gamma": (3, 1)}
    assert queue.batches(q.limit(0), 2).count() == 0
    assert {(r.id, r.slot) for r in queue.slots(q).filter(queue.blank(F.col("answer"))).collect()} == {("alpha", "def"), ("alpha", "b0"), ("alpha", "b2"), ("beta", "def"), ("gamma", "b0")}


def test_merge_keeps_the_first_answer(spark):
    r = lambda answer, fragment: (*request("a", answer, [(0, None if fragment != "f2" else "late")]), fragment, None, None)
    q = requests(spark, [r(" ", None), r("second", "f2"), r("first", "f1")])
    assert {x.slot: x.answer for x in queue.merged_answers(q).collect()} == {"def": "first", "b0": "late"}


def test_snippets_are_shared(spark):
    q = requests(spark, [request("b", None, (), "same"), request("a", None, (), "same"), request("c", None, (), "other"), request("d", None)])
    assert {r.id: (r.snippet, r.snippet_ref) for r in queue.shared_snippets(q).collect()} == {"a": ("same", None), "b": (None, "a"), "c": ("other", None)}


def test_patches_never_change_code(spark):
    lines = [b"/* banner */", b"#include <x.h>", b"static int x; /* note */", b"int f(void)", b"{", b"    return \xff;", b"}"]
    d = spark.createDataFrame([("k", "c", lines), ("n", "c", None), ("e", "python", [])], "file_key string, language string, source_lines array<binary>")
    n = spark.createDataFrame([("k", 4, "Gives x.\nNever fails."), ("k", 6, "note"), ("k", 99, "end"), ("k", None, "lost"), ("k", 1, None)], "file_key string, line_no int, text string")
    got = {r.file_key: r for r in patch.annotated(d, n).collect()}
    new = [bytes(x) for x in got["k"].source_lines]
    assert got["k"].preserved and got["k"].n_inserted == 4 and [x for x in new if x in lines] == lines
    assert new[3:6] == [b"// Gives x.", b"// Never fails.", b"int f(void)"] and new[7] == b"    // note" and new[-1] == b"// end"
    s = spark.createDataFrame([("k", "f", 4), ("k", "g", 2)], "file string, qualname string, start_line int")
    flags = d.select("file_key", definitions.comment_flags(F.col("source_lines"), F.col("language")).alias("comment"))
    assert {(r.qualname, r.first_comment) for r in definitions.comments_above(flags, s).collect()} == {("g", 1)}


def test_line_endings_and_languages(spark):
    d = spark.createDataFrame([(1, b"a\r\nb\r\nc\n"), (2, b"a\rb\rc\n"), (3, b"a\nb"), (4, b"a\r\nb\n"), (5, b"")], "i int, b binary")
    assert {r.i: r.e for r in d.select("i", loading.line_ending(F.col("b")).alias("e")).collect()} == {1: "crlf", 2: "cr", 3: "lf", 4: "lf", 5: "lf"}
    t = spark.createDataFrame([(1, "#!/usr/bin/env node\ndef f():"), (2, "#include <x.h>\nstatic int y;"), (3, "def f():\n    pass\nimport os"), (4, "const a = () => 1;"), (5, "words"), (6, None), (7, "package main\nfunc f() {")], "i int, t string")
    assert {r.i: r.language for r in loading.guessed_languages(t, "i", F.col("t")).collect()} == {1: "js", 2: "c", 3: "python", 4: "js", 5: "text", 6: "text", 7: "go"}


SOURCE = b'''def clamp(x):
    return min(x)


class Acc:
    def add(self, x):
        y = clamp(x)
        self.store(y)
        return y.transpose()

    def store(self, y):
        def inner():
            return clamp(1)
        return inner

    @property
    def size(self):
        return 1
'''


def test_python_definitions():
    d = {x[0]: x for x in parse.definitions(SOURCE)}
    assert list(d) == ["clamp", "Acc", "Acc.add", "Acc.store", "Acc.store.inner", "Acc.size.getter"]
    assert [(c["name"], c["kind"], c["line"]) for c in d["Acc.add"][7]] == [("clamp", "free", 7), ("store", "self", 8), ("transpose", "method", 9)]
    assert d["Acc.store"][7] == [] and [c["name"] for c in d["Acc.store.inner"][7]] == ["clamp"]
    assert parse.definitions(b"def f(:") == [] and parse.imports(b"import a as b\nfrom .c import d\n") == [(1, "a as b"), (2, "d from .c")]


def lexed(text, language):
    return {d.qualname: d for d in braces.definitions(text, language)}


def test_c_definitions():
    c = """/** Adds. */
static int add(int a) { return f(a) + '}'; }
int g(void);
struct s { int (*cb)(int); } one = { 0 };
#ifdef A
int pick(int a) {
#else
int pick(long a) {
#endif
    if (a) { x.call(a); } /* { */ return h("{", a);
}
extern "C" {
const char *
name(void)
{ return 0; }
}
typedef int (*fn)(int);
int (*pointer)(int);
static int *table(int n), other;
int value = call(3);
"""
    d = lexed(c, "c")
    assert {k: (x.kind, x.start_line, x.end_line) for k, x in d.items()} == {"add": ("function", 2, 2), "g": ("declaration", 3, 3), "pick": ("function", 6, 11), "name": ("function", 13, 15)}
    assert d["add"].own_doc == "/** Adds. */" and d["add"].calls == [("f", "free", 2)] and d["name"].signature == "const char * name(void)" and [x[0] for x in d["pick"].calls] == ["h"]


def test_javascript_definitions():
    js = """// Gives one.
export default async function one(a = {b: 1}) { const inner = () => two(); function deep() { return 1; } return this.x(deep()); }
const f = async (a) => {
  return `a ${b + `}${c}`} {` + /[/'"{]/.test(a) + g(a);
};
const e = x => h(x), z = 1;
let v = function named(q) { if (q) { r(); } };
/** A class. */
class K extends Base {
  /* Says. */
  static async say(a) { super.say(); this.go(a); }
  get size() { return 1 / 2; }
}
const box = {
  // Opens.
  open(a) { return a; },
  shut: function (a) { return a; },
  slip: (a) => a + 1,
  n: 3,
};
if (a) { call(function () { nothing(); }); }
"""
    d = lexed(js, "javascript")
    want = {"one": ("function", 2, 2), "one.inner": ("var_arrow", 2, 2), "one.deep": ("function", 2, 2), "f": ("var_arrow", 3, 5), "e": ("var_arrow", 6, 6), "v": ("var_func", 7, 7), "K": ("class", 9, 13), "K.say": ("method", 11, 11), "K.size": ("method", 12, 12), "box.open": ("obj_method", 16, 16), "box.shut": ("obj_method", 17, 17), "box.slip": ("obj_method", 18, 18)}
    assert {k: (x.kind, x.start_line, x.end_line) for k, x in d.items()} == want
    assert d["one"].own_doc == "// Gives one." and d["K.say"].own_doc == "/* Says. */" and d["K"].own_doc == "/** A class. */"
    assert d["one"].calls == [("x", "self", 2), ("deep", "free", 2)] and d["f"].calls == [("test", "method", 4), ("g", "free", 4)] and d["e"].code == "const e = x => h(x)"


def test_python_definitions_by_lexing():
    d = lexed(SOURCE.decode() + "# end\n\ndef last(a,\n  b='):'): return call(a)\n", "python")
    assert list(d) == ["clamp", "Acc", "Acc.add", "Acc.store", "Acc.store.inner", "Acc.size", "last"]
    assert (d["Acc"].start_line, d["Acc"].end_line, d["Acc.store"].end_line) == (5, 18, 14) and d["last"].calls == [("call", "free", 22)]
    assert d["last"].signature == "def last(a, b='):')" and d["Acc.store"].calls == []


@pytest.mark.parametrize("language", braces.LANGUAGES)
def test_lexing_takes_anything(language):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["def f(a):\n", "int f(a) {", "}", "{", "(", ")", "`", "${", "'", '"', "\n", "#if 0\n", "#else\n", "#endif\n", "/*", "*/", "//", "/", "class A", " => ", "x = ", "\\", ";"]) for _ in range(40))
        x = braces.lexed(text, language)
        assert len(x.code) == len(text) and [i for i, c in enumerate(x.code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        for d in braces.definitions(text, language):
            assert 1 <= d.start_line <= d.end_line <= text.count("\n") + 1


def test_source_symbols(spark):
    rows = [("a.py", SOURCE, "python"), ("a.py", SOURCE, "python"), ("b.c", b"int f(void);\nint f(void) { return g(); }\nint h(int a);\n", "c"), ("c.js", b"function k() {}", "javascript"), ("d.py", b"def (", "python"), ("e.py", None, "python"), ("f", b"x", None)]
    got = definitions.source_symbols(spark.createDataFrame([(*r, 1) for r in rows], "file_key string, source_blob binary, language string, kind int"))
    assert got.columns == list(definitions.SYMBOL)
    found = {(r.file, r.qualname): r for r in got.collect()}
    assert len(found) == got.count() == 9 and found["b.c", "f"].kind == "function" and found["b.c", "h"].kind == "declaration" and found["c.js", "k"].existing_doc is None
    assert found["a.py", "Acc.size.getter"].start_line == 17 and found["a.py", "clamp"].signature == "def clamp(x)"


def test_node_signatures():
    sig = lambda s: parse.definitions(s, True)[0][10]
    assert sig(b"def f(a):\n    return a") == sig(b'def f( a ):\n    """Doc."""\n    # note\n    return a') != sig(b"def f(a):\n    return b")
    x = parse.definitions(b"@d\nclass A(B, m=1):\n    async def f(self, *a, b: int = 1) -> str: return 1")
    assert [(r[2], r[8], r[9], r[11]) for r in x] == [(1, 2, "class A(B, m=1)", False), (3, 3, "async def f(self, *a, b: int=1) -> str", True)]


def test_context_window(spark):
    lines = ["def f():", "    if a:", "        b", "", *["        c"] * 30]
    w = lambda a, b: tuple(one(spark, definitions.context_window(F.col("l"), F.lit(a), F.lit(b)), l=lines))
    assert w(12, 13) == (2, 21) and w(34, 34) == (26, 34) and w(1, 1) == (1, 9)


def test_grounding(spark):
    t = spark.createDataFrame([(1, "Calls `load_row(x1)` and `gone_word`"), (2, "plain"), (3, None), (4, "`oad_r`")], "i int, t string")
    c = spark.createDataFrame([("def load_row(x1): pass",), (None,)], "s string")
    assert {r.i: r.ungrounded for r in grounding.ungrounded(t, ["i"], "t", c, "s").collect()} == {1: "gone_word"}


def test_description_splice(spark):
    z = [("a", ["/*", " * Copyright 2020", " * old words", " */", "int x;"], 3, 3, "new words " * 20, " * "), ("l", ["# Copyright", "# b"], 1, 2, "new", "# "), ("n", ["# a"], None, None, "new", "# "), ("b", ["# a"], 1, 1, "  ", "# ")]
    d = spark.createDataFrame(z, "file string, lines array<string>, first int, last int, description string, prefix string")
    got = {r.file: r for r in headers.spliced_descriptions(d).collect()}
    assert got["a"].replaced and got["a"].lines[:2] == ["/*", " * Copyright 2020"] and got["a"].lines[-1] == "int x;" and all(len(x) <= 118 for x in got["a"].lines)
    assert not any(got[k].replaced for k in "lnb") and got["l"].lines == ["# Copyright", "# b"]


def test_summaries(spark):
    d = spark.createDataFrame([(1, "short"), (2, "\n\n".join(f"paragraph {i} " * 20 for i in range(30))), (3, None), (4, "")], "i int, t string")
    got = {r.i: r.summary for r in model.summaries(d, "i", "t", 60).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == "short" and got[3] is None and got[2]
    assert model.summaries(d.limit(0), "i", "t", 60).count() == 0


def test_files_round_trip(spark, tmp_path):
    root = tmp_path / "in"
    (root / "d").mkdir(parents=True)
    blobs = {"a.py": b"x = 1\r\ny = '\xff'\r\n", "d/b.c": b"int x;\rint y;\r", "d/c.txt": b"no source", "e.js": b";"}
    for k, v in blobs.items():
        (root / k).write_bytes(v)
    f = sources.read_files(spark, str(root), f"{root}/d/*.txt")
    got = {r.file_key.removeprefix(f"{root}/"): r for r in f.collect()}
    assert set(got) == set(blobs) and got["d/b.c"].line_ending == "cr" and got["a.py"].language == "python" and got["d/c.txt"].language is None
    out = tmp_path / "out"
    sources.write_files(f, str(out), str(root))
    assert {k: (out / k).read_bytes() for k in blobs} == blobs
    with pytest.raises(Exception, match="not below"):
        sources.write_files(f.withColumn("file_key", F.lit("/../x")), str(out), "")


def test_manifest_round_trip(spark, tmp_path):
    q = requests(spark, [request("a", None, [(0, "é")], "def a"), request("b", "x")]).drop("issued_at", "received_at")
    sources.write_manifests(q, str(tmp_path / "m"), 100)
    back = sources.read_manifest(spark, str(tmp_path / "m"))
    assert {r.id: (r["def"].answer, r.line_length) for r in back.collect()} == {"a": (None, 100), "b": ("x", 100)}
    assert back.filter("id = 'a'").first().blocks.chunks[0].answer == "é"
    (tmp_path / "w.json").write_text('{"version": 2, "tool": "other", "requests": []}')
    with pytest.raises(Exception, match="not a manifest"):
        sources.read_manifest(spark, str(tmp_path / "w.json")).collect()


def test_stream_counts_deliveries_once(spark, tmp_path):
    t = datetime(2030, 1, 1, 12)
    rows = [(*request("a", None), None, t, t), (*request("a", None), None, t, t), (*request("b", "x"), None, t, t), (*request("c", "x"), None, None, t)]
    requests(spark, rows).coalesce(1).write.parquet(str(tmp_path / "q"))
    s = intake.request_stream(spark, str(tmp_path / "q"), spark.read.parquet(str(tmp_path / "q")).schema)
    w = intake.first_deliveries(s).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    w.processAllAvailable()
    w.stop()
    assert sorted(r.id for r in spark.table("once").collect()) == ["a", "b"]
    u = intake.untimed(s).writeStream.format("memory").queryName("untimed").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).start()
    u.processAllAvailable()
    u.stop()
    assert [r.id for r in spark.table("untimed").collect()] == ["c"]
    v = intake.open_by_window(s).writeStream.format("memory").queryName("open").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    v.processAllAvailable()
    v.stop()
    r = spark.table("open").first()
    assert (r.n_requests, r.n_open) == (3, 2)


def test_queries_and_sql_name_the_same():
    q, s = catalog.queries(), catalog.oracle_sql()
    assert set(s) <= set(q) and catalog.FLAGSHIP in q and len(q) > 110 and len(s) > 90


def test_extra_columns_do_no_harm(spark):
    d = spark.createDataFrame([Row(i=1, t="a\nb", n_lines=5, prompt="x", reply="old")])
    assert model.generated(d, "prompt").first().reply == "x"


def test_structural_elision():
    from marlstone.operators.elision import collapsed

    text = "def f(a):\n    if a:\n        for x in a:\n            g(x)\n            h(x)\n    else:\n        k(a)\n    return a\n"
    assert collapsed(text, 999) == text
    assert collapsed(text, 52) == "def f(a):\n    if a:\n        for x in a:\n            ...  # 2 lines\n    else:\n        k(a)\n    return a\n"
    small = collapsed("    " + text.replace("\n", "\n    "), 20)
    assert small.startswith("    def f(a):") and "..." in small and len(small) <= 40
    assert collapsed("def f(:\n" * 9, 10) == "def f(:\ndef f(:" and collapsed("x" * 99, 5) == ""
