import random

import pytest

from marlstone.llm import parsing
from marlstone.llm.grammars import c, javascript, python
from marlstone.llm.grammars.python import Malformed


def accepts(language, text):
    return parsing.valid(text.encode(), language)


GOOD = {
    "python": ["", "x = 1\n", "if x:\n    pass\nelse:\n    y\n", "async def f():\n    await g()\n    return 1\n", 'f"{a!r:>{w}} {{}} {b["x"]}"\n', "match a:\n    case [1, *_] | {'k': v} if v:\n        pass\n", "with (open(a) as b, c):\n    pass\n", "lambda *a, k=1, **z: (yield)\n", "def f[T: int](a, /, b, *, c) -> T: ...\n", "a, *b = c = d\n", "x: int = 3\n", "@a.b(1)\nclass A(B, m=C):\n    x = 1\n", "print(*a, **b)\n", "a[1:2, ::3]\n", "try:\n    x\nexcept* E as e:\n    y\nfinally:\n    z\n", "type X = int\n"],
    "c": ["", "int x;", "int f(void) { return 0; }", "#ifdef A\nint f(void) {\n#else\nint g(void) {\n#endif\n return 1; }", "#define BEGIN {\n#define END }\nint f(void) BEGIN return 1; END", "struct a { int b : 3; } c = { .b = 1 };", "typedef int (*fn)(int, char *);", "enum e { A, B = 2, };", "int f(int a) { for (int i = 0; i < a; i++) if (a) b(); else c(); do x(); while (y); return (foo_t) z; }", "_Static_assert(1, \"x\");", "int a[] = { [0] = 1, 2 };", "#if 0\n)))\n#endif\nint x;", "static const foo_t *bar(const char *s, ...);", "void f(void) { again: x = 1; goto again; switch (a) { case 1: break; default: ; } }"],
    "javascript": ["", "let x = 1;", "a\nb", "export default function () {}", "for (const [a, b] of c) {}", "x = `a${`b${c}`}d`", "a = b / c / d; e = /[/]/g.test(f)", "class A extends B { #p = 1; static { x } get y() { return this.#p } async *z() {} }", "const f = async ({ a, b = 1, ...c }) => { await d }", "import a, { b as c } from 'x'", "if (a) b\nelse c", "a ??= b?.c?.[d] ?? e", "l: for (;;) { break l }", "await x", "#!/bin/node\nx"],
}
BAD = {
    "python": ["x = \n", "if x:\npass\n", "(", "return 1\n", "a + b = c\n", "f'{x'\n", "def f(:\n    pass\n", "<<<<<<< HEAD\n", "x = 'a\n", "  x = 1\n", "break\n", "await x\n", "class A:\n", "try:\n    x\n", "a = 08\n", "print 'x'\n", "else:\n    x\n"],
    "c": ["int f( { }", "int f(void) { return 0;", "x = 1 2;", "#if A\nint x;", "int f(void) { <<<<<<< HEAD\n }", "'ab", "/* x", "int f(void) { int x = ; }", "def f(a):\n    return a\n", "#ifdef A\n)\n#else\n(\n#endif", "int f(void) { a: int x; }", "else x;", "int 3x;", "foo bar baz;"],
    "javascript": ["let x = ;", "return 1", "{ \"a\": 1 }", "const a", "a b", "function () {}", "`a${b`", "/[/", "if (a) {", "import x from", "class A { x( }", "x = y +", "'\\x4'", "break", "yield = 1", "<<<<<<< a", "throw\na", "for (;;", "() => {} || x"],
}


@pytest.mark.parametrize("language", GOOD)
def test_valid_sources(language):
    assert [t for t in GOOD[language] if not accepts(language, t)] == []


@pytest.mark.parametrize("language", BAD)
def test_invalid_sources(language):
    assert [t for t in BAD[language] if accepts(language, t)] == []


def test_python_agrees_with_the_compiler_on_mutants():
    rng, sources = random.Random(1), [open(m.__file__, "rb").read() for m in (python, c, javascript, parsing)]
    wrong = 0
    for _ in range(250):
        b = bytearray(rng.choice(sources))
        for _ in range(rng.randrange(1, 3)):
            i = rng.randrange(len(b))
            b[i : i + rng.randrange(0, 3)] = rng.choice([b"", b"(", b")", b":", b"\n", b" ", b"'", b"x", b"="])
        got, want = not parsing.broken(bytes(b), "python"), parsing.exactly_valid(bytes(b))
        wrong += got != want
    assert wrong <= 3  # what depends on names, such as a parameter given twice


def test_results_do_not_depend_on_what_was_read_before():
    inner = "class A { main(s, p) { let r = 8; } }"
    bare = "main(s, p) { let r = 8; }"
    assert accepts("javascript", inner) and not accepts("javascript", bare)
    parsing._grammar("javascript").reset()
    assert not accepts("javascript", bare) and accepts("javascript", inner)


def test_settings_of_many_macros():
    parts = "".join(f"#ifndef M{i}\nint f{i}(void) {{ return {i}; }}\n#else\nx y z;\n#endif\n#ifdef N{i}\nint a{i};\n#else\nint 3;\n#endif\n" for i in range(9))
    assert accepts("c", parts)
    assert not accepts("c", parts + "}")


def test_failures_have_lines_and_causes():
    assert parsing.failure(b"int a;\nint f(void) {\n<<<<<<< HEAD\n x();\n=======\n y();\n>>>>>>> b\n}\n", "c")[1] == "conflict"
    assert parsing.failure(b"x = 1\ny = (1,\n", "python") == (2, "truncated")
    assert parsing.failure(b"def f(a):\n    return a\n", "javascript")[1] == "language"
    assert parsing.failure(b"let a = 1;\nlet b = 2 2;\n", "javascript") == (2, "syntax")
    assert parsing.failure(b"f(function () {\n  a b\n})\n", "javascript") == (2, "syntax")


def test_deep_nesting_and_odd_bytes():
    assert not parsing.broken(b"[" * 3000 + b"]" * 3000, "javascript")
    assert parsing.broken(b"x = '\xff'\n", "python") and not parsing.broken(b"x = '\xff'\n", "javascript")
    assert parsing.broken(b"\x00", "python") and not parsing.broken(b"\xef\xbb\xbfint x;\r\n", "c")
    with pytest.raises(Malformed):
        python.decoded(b"# coding: nothing\n")


def by_all_settings(text):
    from itertools import product

    g = parsing._grammar("c")
    try:
        parts = c.structure(text)
    except Malformed:
        return False
    names = c.tested(parts)
    for values in product((False, True), repeat=len(names)):
        try:
            if g.accepts(c.symbols(c.preprocessed(parts, dict(zip(names, values))), g), "file"):
                return True
        except Malformed:
            pass
    return False


def test_settings_where_several_macros_have_to_differ():
    text = "".join(f"#ifdef M{i}\nint a{i};\n#endif\n" for i in range(3, 9)) + "#ifdef M1\n#error\n#endif\n#ifdef M2\n#error\n#endif\n#ifndef M9\n#error\n#endif\n#ifndef M10\n#error\n#endif\n"
    assert accepts("c", text) and not accepts("c", text + "#ifdef M9\n#error\n#endif\n")
    body = "".join(f"#ifdef N{i}\n  f(&x[{i}], a);\n#else\n  if (x) {{ y = {i}; }} else\n#endif\n" for i in range(40))
    table = "".join(f"#ifdef T{i}\n  {{ {i}, A }},\n#else\n  B{i},\n#endif\n" for i in range(40))
    logs = "".join(f"#ifdef L{i}\n#define LOG{i}(x) f(x);\n#else\n#define LOG{i}(x)\n#endif\n" for i in range(40)) + "void g(void) {\n" + "".join(f"LOG{i}(1)\n" for i in range(40))
    text = f"int t[] = {{\n{table}}};\nint h(void) {{\n{body}  ;\n}}\n{logs}}}\n"
    assert accepts("c", text + "#ifdef N3\n)\n#endif\n#ifndef L7\n)\n#endif\n#ifdef T2\n)\n#endif\n")
    assert not accepts("c", text + "}\n") and not accepts("c", text + "#ifdef N3\n)\n#else\nx y z;\n#endif\n")


def test_settings_agree_with_trying_all():
    rng = random.Random(3)
    pieces = ["int a;", "int f(void) {", "}", "x = 1;", "if (a) b();", "else", "{", "};", "struct s {", "int m : 2;", "int t[] = {", "1, A,", "{ 2 },", "enum e {", "A = 1,", "f(", "a, b", ");", "#error", "#define BEGIN {", "#define BEGIN", "#define P(x) x;", "#undef BEGIN", "BEGIN", "P(int p)", "P(q())", "case 1:", "a * b, c[3] = {1};", "return x", ";", "do", "while (x);", "int k(a) int a;", "{ a; }", "for (;;)", ","]
    seen = [0, 0]
    for _ in range(4000):
        lines, depth = [], 0
        for _ in range(rng.randrange(4, 22)):
            r = rng.random()
            if r < 0.25:
                lines.append(f"#if{rng.choice(['def', 'ndef'])} M{rng.randrange(4)}")
                depth += 1
            elif r < 0.4 and depth:
                lines.append(rng.choice(["#else", "#elif defined(M1)"]) if not lines[-1].startswith("#el") else "#endif")
                depth -= lines[-1] == "#endif"
            elif r < 0.55 and depth:
                lines.append("#endif")
                depth -= 1
            else:
                lines.append(rng.choice(pieces))
        text = "\n".join(lines + ["#endif"] * depth) + "\n"
        want = by_all_settings(text)
        seen[want] += 1
        assert accepts("c", text) == want, text
    assert min(seen) > 200


@pytest.mark.parametrize("depth", [3_000, 20_000])
def test_deep_nesting_is_judged(depth):
    a = lambda x, y, z: x * depth + y + z * depth
    assert parsing.broken(b"x = " + a(b"[", b"1 2", b"]") + b";\n", "javascript") and not parsing.broken(b"x = " + a(b"[", b"1", b"]") + b";\n", "javascript")
    assert parsing.broken(b"int x = " + a(b"(", b"1 2", b")") + b";\n", "c") and not parsing.broken(b"int x = " + a(b"(", b"1", b")") + b";\n", "c")
    assert parsing.broken(b"if (a) b(); else " * depth + b"c() d;\n", "javascript")


def test_nesting_beyond_the_frames_is_no_crash(monkeypatch):
    import sys

    before = sys.getrecursionlimit()
    parsing.valid(b"x;", "javascript")
    try:
        sys.setrecursionlimit(3_000)
        assert parsing.broken(b"y = " + b"[g(" * 2_000 + b"2" + b")]" * 2_000 + b";\n", "javascript")
        assert parsing.failure(b"z = " + b"[h(" * 2_000 + b"3 4" + b")]" * 2_000 + b";\n", "javascript")[0] == 1
    finally:
        sys.setrecursionlimit(max(before, parsing.FRAMES))
    assert not parsing.broken(b"w = [[1]];\n", "javascript")
