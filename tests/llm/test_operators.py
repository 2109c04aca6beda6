import random
from datetime import datetime

import pytest

from marlstone.llm import licences, mixing, packing, pairs, parsing, responses, spam, splitting
from marlstone.llm.automaton import SuffixAutomaton, best_chain

RUN = "file_key string, repo string, path string, source_blob binary, source_lines array<binary>, line_ending string, language string, is_target boolean, content_sha string, scanned_at timestamp, loaded_at timestamp, salt int, n_tokens string, doc_id string"


def run_files(spark, rows):
    return spark.createDataFrame([(k, None, None, b, None, e, lang, None, None, None, None, 1, "x", "y") for k, b, e, lang in rows], RUN)


LICENCES = [
    ("AA-1.0", "Aspen Licence, version 1", ["Aspen v1"], "This file may be used under the terms of the Aspen Licence, version 1.", "Anyone may run the work and hand it on to others without payment.\n\nEvery copy keeps this page at its place."),
    ("AA-2.0", "Aspen Licence, version 2", None, None, "Anyone may run the work and hand it on to others without payment.\n\nEvery copy keeps this page at its place.\n\nChanged copies carry another name on their first page."),
    ("BB", "Birch Terms", ["Birch"], "This file may be used under the terms of the Birch Terms.", "Use is limited to teaching and to study in schools of any kind."),
]


@pytest.mark.parametrize(
    "text, ids",
    [
        ("Use of this file is permitted according to the Aspen Licence, version 1.", {"AA-1.0"}), ("License terms: Birch Terms", {"BB"}), ("May be redistributed per AA-1.0.", {"AA-1.0"}), ("We choose the Aspen v1.", {"AA-1.0"}), ("The licence of this file is BB.", {"BB"}),
        ("Copying is allowed in accordance with the Birch Terms.", {"BB"}), ("Offered under Aspen v1 to anyone.", {"AA-1.0"}), ("You can use this, subject to the Birch Terms.", {"BB"}),
        ("Unlike files under the terms of the Birch Terms, this file is private.", set()), ("This file is not licensed under the Birch Terms.", set()), ("Reads headers and reports tags such as BB.", set()), ("Tells Birch Terms texts from drafts.", set()), ("Formerly released under Aspen v1.", set()), ("Checks whether other files are used under the Birch Terms.", set()),
    ],
)
def test_licences_declared_in_other_words(text, ids):
    t = licences.Templates(tuple((i, a, tuple(o or ()), n or "", b) for i, a, o, n, b in LICENCES))
    assert set().union(*(x for x, _ in licences.statements(text, t))) == ids


def licence_table(spark):
    return spark.createDataFrame(LICENCES, "licence_id string, title string, other_names array<string>, notice string, body string")


def found(spark, rows):
    out = licences.licence_findings(run_files(spark, rows), licence_table(spark)).collect()
    assert len(out) == len(set(out))
    return {(r.scope, r.item.removeprefix("/srv/t/")): (r.licence, r.flag) for r in out}


def test_licences(spark):
    body1, body2 = LICENCES[0][4], LICENCES[1][4]
    rows = [
        ("/srv/t/r/LICENSE", body1.upper().encode(), "lf", None),
        ("/srv/t/r/deps/x/COPYING", ("* " + body2.replace("\n\n", "\n* ").replace("another", "anothe")).encode(), "lf", None),
        ("/srv/t/r/a.py", b"# nothing here\nx = 1\n", "lf", "python"),
        ("/srv/t/r/a.py", b"# nothing here\nx = 1\n", "lf", "python"),
        ("/srv/t/r/deps/x/src/b.c", None, None, "c"),
        ("/srv/t/r/c.c", b"/* SPDX-License-Identifier: BB */ int x;", "lf", "c"),
        ("/srv/t/r/d.js", b"// SPDX-License-Identifier: (BB OR AA-1.0)\n", "lf", "javascript"),
        ("/srv/t/r/e.js", b"// Licensed under Birch.\n// SPDX-License-Identifier: AA-1.0\n", "lf", "javascript"),
        ("/srv/t/r/f.js", b"// Licensed under the Secret Agreement of nobody.\n", "lf", "javascript"),
        ("/srv/t/r/g.js", b"// Reads tags such as Birch Terms; see the LICENSE file.\n", "lf", "javascript"),
        ("/srv/t/r/h.py", b"x = 1\n# SPDX-License-Identifier: BB\n", "lf", "python"),
        ("/srv/t/q/package.json", b'{"license": "Birch Terms"}', "lf", None),
        ("/srv/t/q/LICENSE.md", b"You may look at it.", "lf", None),
        ("/srv/t/q/a.c", b"", "lf", "c"),
        ("/srv/t/n/a.c", b"\xff\xfe", "lf", "c"),
        (None, b"", "lf", "c"),
    ]
    got = found(spark, rows)
    assert got == {
        ("file", "r/a.py"): ("AA-1.0", "ok"),
        ("file", "r/deps/x/src/b.c"): ("AA-2.0", "ok"),
        ("file", "r/c.c"): ("BB", "conflict"),
        ("file", "r/d.js"): ("AA-1.0 OR BB", "ok"),
        ("file", "r/e.js"): ("AA-1.0 AND BB", "conflict"),
        ("file", "r/f.js"): ("unknown", "unknown"),
        ("file", "r/g.js"): ("AA-1.0", "ok"),
        ("file", "r/h.py"): ("AA-1.0", "ok"),
        ("file", "q/a.c"): ("unknown", "unknown"),
        ("file", "n/a.c"): ("none", "none"),
        ("repo", "r"): ("AA-1.0", "ok"),
        ("repo", "q"): ("BB AND unknown", "conflict"),
        ("repo", "n"): ("none", "none"),
    }
    assert found(spark, []) == {}


def test_partial_bodies_are_rejected():
    t = licences.Templates(tuple((r[0], r[1], tuple(r[2] or ()), r[3] or "", r[4]) for r in LICENCES))
    bodies = lambda x: [t.ids[k] for k in t.bodies(t.automaton.statistics(t.words(x)[0]))[0]]
    assert bodies(LICENCES[0][4]) == ["AA-1.0"] and bodies(LICENCES[1][4]) == ["AA-2.0"]
    assert bodies(LICENCES[0][4].split("\n")[0]) == [] and bodies("") == []
    assert bodies(LICENCES[0][4] + "\n\n" + LICENCES[2][4]) == ["AA-1.0", "BB"]
    assert bodies((LICENCES[0][4] + " ") * 3000) == ["AA-1.0"]


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        seqs = [[rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(3)]
        text = [rng.choice("abc") for _ in range(12)]
        a, subs = SuffixAutomaton(seqs), {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for i, (v, n) in enumerate(a.statistics(text)):
            best = max([k for k in range(i + 2) if not k or tuple(text[i + 1 - k : i + 1]) in subs])
            assert n == best
            for k, e in a.ends[v] if n else ():
                assert seqs[k][e - n : e] == text[i + 1 - n : i + 1]
    assert best_chain([(0, 0, 3), (5, 3, 2), (4, 9, 5)], 10)[0] == 8 and best_chain([], 1) == (0, [])


def test_splitting_keeps_all_bytes():
    rng = random.Random(5)
    for k in range(60):
        sep = rng.choice([b"\n", b"\r\n", b"\r"])
        lines = [bytes(rng.choice(b"ab {}\xc3\xa9") for _ in range(rng.choice([0, 3, 30, 200, 900]))) for _ in range(rng.randrange(1, 60))]
        blob, limit, overlap = sep.join(lines), rng.choice([300, 500]), rng.choice([0, 40, 200])
        named = {b"\n": "lf", b"\r\n": "crlf", b"\r": "cr"}[sep]
        pieces, long, _ = splitting.split(blob, named, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(blob)
        assert all(0 < e - s <= limit for s, e, _ in pieces) or not blob
        assert all(b[0] == a[1] - overlap for a, b in zip(pieces, pieces[1:]))
        if len(blob) > limit:
            assert long == [i + 1 for i, x in enumerate(blob.split(sep)) if len(x) > limit]
    blob = b"\n\n".join(b"x = 1\n" * 5 for _ in range(20))
    assert {c for _, _, c in splitting.split(blob, "lf", 200, 20)[0][:-1]} == {"paragraph"}


def test_splitting_is_optimal_on_small_records():
    rng = random.Random(7)
    for _ in range(30):
        blob = b"\n".join(b"x" * rng.randrange(1, 12) if rng.random() < 0.8 else b"" for _ in range(12))
        limit, overlap = 30, 4
        if len(blob) <= limit:
            continue
        pos, cost, _ = splitting.boundaries(blob, b"\n", limit - overlap)
        n, least = len(blob), -(-(len(blob) - overlap) // (limit - overlap))

        def best(cuts, k, even):
            at = cuts[-1] if cuts else 0
            start = at - overlap if cuts else 0
            out = [((n - start - even) / limit) ** 2] if len(cuts) == k - 1 and n - start <= limit else []
            if len(cuts) < k - 1:
                out += [cost[i] + ((p - start - even) / limit) ** 2 + best([*cuts, int(p)], k, even) for i, p in enumerate(pos) if p > at and p - start <= limit]
            return min(out, default=float("inf"))

        for k in range(least, least + 2):
            got = splitting._cut(pos, cost, n, limit, overlap, k)
            want = best([], k, (n + (k - 1) * overlap) / k) + splitting.PER_PIECE * k
            assert got is None and want == float("inf") or abs(got[0] - want) < 1e-9


def test_splitting_takes_as_many_pieces_as_pay():
    lines = b"\n".join([b"x = " + b"ab " * 1498 + b"z"] * 10)
    pieces, _, starts = splitting.split(lines, "lf", 8000, 400)
    assert len(pieces) == 10 and {e for _, e, _ in pieces[:-1]} == set(starts[1:])
    short = b"\n".join([b"  y" * 200] * 60)  # the least number by bytes can't be had between lines
    pieces, _, starts = splitting.split(short, "lf", 1010, 10)
    assert {e for _, e, _ in pieces[:-1]} <= set(starts)


def test_lines_that_had_to_be_cut_come_from_the_cuts():
    blob = b"a" * 150 + b"\n" + b"b\n" * 20 + b"c" * 99 + b"\n" + b"d" * 101
    pieces, long, starts = splitting.split(blob, "lf", 100, 10)
    assert long == [1, 23] and all(any(starts[n - 1] < e < starts[n - 1] + 100 for _, e, _ in pieces) for n in long)


def test_split_records(spark):
    long = b"y" * 130 + b"\n" + b"a b\n" * 30
    rows = [("k", long, None, "c"), ("k", long, None, "c"), ("n", None, "lf", "c"), ("s", b"x", "lf", None), (None, long, "lf", None)]
    p = splitting.split_records(run_files(spark, rows), 100, 10)
    assert {(r.file_key, r.line_no) for r in splitting.found(p).collect()} == {("k", 0), ("k", 1), (None, 0), (None, 1)}
    mine = sorted((r.piece_no, bytes(r.piece)) for r in p.filter("file_key = 'k'").distinct().collect())
    assert mine[0][1] + b"".join(x[10:] for _, x in mine[1:]) == long
    assert splitting.split_records(run_files(spark, []), 100, 10).count() == 0
    with pytest.raises(ValueError):
        splitting.split_records(run_files(spark, []), 10, 10)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, project string, fetched_at timestamp, salt int, n_tokens int, container_id int, mix_copy int, prose int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, None, None, 1, 2, 3, 4, 5) for i, t, s in rows], DOCS)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["word"] * rng.choice([1, 5, 5, 5, 70, 300])), "a") for i in range(300)]
    rows += [(None, "no key", "a"), (None, "no key", "a"), (1, "word", "a"), (900, None, "a"), (901, "", None), (902, "word " * 5000, "a"), (903, "<|endoftext|>", "a")]
    cap = 128
    out = packing.pack(documents(spark, rows), cap).collect()
    placed = [r for r in out if r.container_id is not None]
    assert sorted(r.doc_id for r in out if r.container_id is None) == [900, 901]
    used = {}
    for r in placed:
        used.setdefault(r.container_id, []).append((r.container_offset, r.n_tokens))
        assert r.n_tokens <= cap
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= cap
    total = sum(packing.counts([t for _, t, _ in rows]))
    assert sum(r.n_tokens for r in placed) == total and len(used) <= total / cap * 1.05 + 2
    assert sum(r.doc_id is None for r in placed) == 2 and sum(r.doc_id == 902 for r in placed) == -(-packing.counts(["word " * 5000])[0] // cap)
    assert packing.pack(documents(spark, []), cap).count() == 0
    assert packing.fill_report(packing.pack(documents(spark, []), cap), cap).first().fill is None
    with pytest.raises(ValueError):
        packing.pack(documents(spark, []), 0)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(100):
        cap = rng.randrange(1, 40)
        items = sorted((rng.randrange(1, cap + 1) for _ in range(rng.randrange(0, 60))), reverse=True)
        rooms = []
        for x in items:
            fit = min([r for r in rooms if r >= x], default=None)
            if fit is None:
                rooms.append(cap - x)
            else:
                rooms[rooms.index(fit)] -= x
        hist = {x: items.count(x) for x in items}
        assert packing.plan(hist, cap).containers == len(rooms)


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randrange(1, 40), rng.choice(["a", "A", " a", "b-x", "B X", "c", None, "other"])) for i in range(4000)]
    rows += [(None, "no key", "a"), (5000, None, "a"), (5001, "", "b_x")]
    d, targets = documents(spark, rows), {"a": (0.5, 1), "b_x": (0.3, 3), "c": (0.2, 2), "gone": (0.0, 4)}
    z = mixing.sizes(d)
    m = mixing.calibrate(z, targets)
    drawn = mixing.draw(d, m).collect()
    assert [r.mix_order for r in drawn] == sorted(r.mix_order for r in drawn)
    got = {r.source: r for r in mixing.shares(z, m).collect()}
    for s, (share, most) in targets.items():
        assert abs(got[s].share - share) < 0.01 and got[s].most_copies <= most
    copies = {}
    for r in drawn:
        copies[r.doc_id, r.text] = copies.get((r.doc_id, r.text), 0) + 1
    assert max(copies.values()) <= 3 and sum(r.n_draws for r in got.values()) == len(drawn)
    assert any(x == float("inf") for x in m.means.values())  # the mixture is as large as the caps allow
    empty = documents(spark, [])
    none = mixing.sizes(empty)
    assert mixing.draw(empty, mixing.calibrate(none, targets)).count() == 0
    assert {r.share for r in mixing.shares(none, mixing.calibrate(none, targets)).collect()} == {0.0}


def test_mixing_takes_large_caps():
    m = mixing.grid(150)
    assert m[-1] > 290 and 0 <= mixing._cdf(149, m[-1]) < 1e-9 and abs(float(mixing._cdf(0, 2.0)) - 0.1353352832) < 1e-9


def test_mixing_without_one_of_the_sources(spark):
    d = documents(spark, [(i, "word " * 20, "ab"[i % 2]) for i in range(2000)] + [(3000, None, "c")])
    z = mixing.sizes(d)
    m = mixing.calibrate(z, {"a": (0.45, 1), "b": (0.3, 1), "c": (0.15, 2), "gone": (0.1, 2)})
    got = {r.source: r for r in mixing.shares(z, m).collect()}
    assert abs(got["a"].share - 0.6) < 0.01 and abs(got["b"].share - 0.4) < 0.01 and got["a"].n_draws == 1000
    assert got["c"].share == got["gone"].share == 0 and got["gone"].target_share == 0.1


@pytest.mark.parametrize(
    "doc, told",
    [
        ("Returns how many rows were dropped", True), ("/** Not safe to call twice */", True), ("Fold the loader unless it was merged; the patch stays stale", True), ("Lädt die Datei neu", True), ("// Cheap after the first call. TODO: more", True),
        (":param a0: the mapper to copy", True), (None, False), ("", False), ("/** * */", False), ("\u200b", False), ("-->", False), ("This function load batch.", False), ("load_batch(a0, b1)", False), ("`load_batch`", False), ("Load batch...", False),
        ("Args:\n    a0: a0\nReturns:", False), ("// @param {number} a0\n// @returns {Object}", False), ("(int, int) -> int", False), ("TODO: document", False), ("_summary_", False), ("See above.", False), ("{@inheritDoc}", False), ("ditto", False),
        ("noqa: C901", False), ("@private", False), ("/* eslint-disable-next-line no-unused-vars */", False), ("return shift(record);", False), ("read(mirror, 2)", False), ("if (x) target = 0;", False), ("n/a", False),
    ],
)
def test_documentation_that_tells(doc, told):
    assert pairs.tells("Loader.load_batch", "def load_batch(self, a0, b1: int = f(')'))", doc) is told


SYMBOLS = "file string, qualname string, kind string, signature string, start_line int, end_line int, depth int, parent_qualname string, existing_doc string, calls array<struct<name:string,kind:string,line:int>>, loaded_at timestamp, name string, code string"


def test_pairs(spark):
    t = datetime(2030, 1, 1)
    s = lambda q, kind, line, doc, sig=None: ("/srv/t/r/a.c", q, kind, sig, line, line, 0, None, doc, None, t, "x", "y")
    rows = [s("f", "function", 3, "/* Tells what the caller owns. */"), s("f", "function", 3, "/* Tells what the caller owns. */"), s("A", "class", 1, "Tells much."), s("g", None, 9, "Tells much."), s("h", "function", 7, None), (None, None, "def", None, None, None, None, None, "Tells a lot here.", None, None, None, None)]
    d = spark.createDataFrame(rows, SYMBOLS)
    code = b"int x;\n/* Tells what the caller owns. */\nstatic int f(int a) {\n  char *s = \"}\"; // }\n  return a;\n}\n/** Closes the door. */ int g(void) { return 0; }\n\n// Opens the door.\nint k(void) { return 1; }\n"
    files = run_files(spark, [("/srv/t/r/a.c", code, "lf", "c")] * 2)
    assert {(r.file, r.qualname) for r in pairs.documented(files, d).collect()} == {("/srv/t/r/a.c", "f"), (None, None)}
    got = {r.qualname: r for r in pairs.pairs(files, d).collect()}
    assert set(got) == {"f", "k", None} and got["k"].description == "Opens the door."
    assert got["f"].code.startswith("static int f") and got["f"].code.endswith("}") and got["f"].description == "Tells what the caller owns."
    assert got[None].code is None and got[None].description == "Tells a lot here."
    assert pairs.documented(files, d.limit(0)).count() == 0 and pairs.documented(files.limit(0), d).count() == 2
    # what the source attaches counts: a symbol's doc that the source doesn't show there tells nothing
    bare = run_files(spark, [("/srv/t/r/a.c", b"\n\nstatic int f(int a) { return a; }\n", "lf", "c")])
    assert {r.qualname for r in pairs.documented(bare, d).collect()} == {None}


@pytest.mark.parametrize(
    "doc, told",
    [
        ("Not documented yet.", False), ("See the C version for details.", False), ("Name says it all.", False), ("Trivial helper.", False), ("Please document me!", False), ("What you would expect.", False), ("Documented elsewhere.", False), ("Self evident", False), ("Stub.", False), ("As above", False),
        ("Add rows to the queue.", True), ("Insert the key.", True), ("Puts the rows back in order.", True), ("Write the header first.", True), ("Never blocks.", True), ("Expects an open socket.", True), ("Frees the rows.", True), ("Counts bytes, not characters.", True), ("Thread-safe.", True), ("Caller owns the result.", True),
    ],
)
def test_documentation_in_other_words(doc, told):
    assert pairs.tells("parse_row", "int parse_row(int a)", doc) is told


def test_functions_are_delimited():
    js = "// adds\nfunction add(a, b) { return '}' + `}${a}` + /[}]/.exec(b); }\nclass A {\n  /** says */\n  say(x) { if (x) { y() } }\n}\nconst z = (a) => { return a; };\n"
    got = {f.name: (f.code, f.own_doc) for f in pairs.functions(js, "javascript")}
    assert got["add"][0].endswith("exec(b); }") and got["add"][1] == "// adds" and got["say"] == ("say(x) { if (x) { y() } }", "/** says */") and "z" in got
    py = 'class A:\n    def f(self):\n        """Doc."""\n        return "def g(): {"\n\n\ndef h(): pass\n'
    assert [(f.name, f.start_line, f.end_line, f.own_doc) for f in pairs.functions(py, "python")] == [("f", 2, 4, "Doc."), ("h", 7, 7, None)]


PROMPT = responses.Prompt(["def load(a, b):\n    # keep the order of things as it was before\n    return merge(a, b) + [x for x in b if x]\n", "Routine is short: comment only what the code does not say.", "load"])


@pytest.mark.parametrize(
    "answer, what",
    [
        ("Merges both lists and keeps the order.", None), ("Sorry entries, as the log calls them, cannot be dropped.", None), ("Refuses a wide bucket: I/O on it cannot be dropped", None), ("NONE of the caches survives.", None), ("The `größe` key keeps its café spelling.", None), ("`def load(a, b)` is kept for callers that still hold a list.", None),
        ("", "empty"), ("/** */", "empty"), ("```\n```", "empty"), ("\u200b", "empty"), ("—", "empty"),
        ("I cannot help with that request.", "refusal"), ("Happy to help, but I only see a part.", "refusal"), ("Please provide the full file, then I will gladly explain it.", "refusal"), ("Cannot explain this: my guidelines forbid guessing.", "refusal"),
        ("return merge(a, b) + [x for x in b if x]", "copy"), ("# def load(a, b):\n#     return merge(a, b)", None), ("Routine is short: comment only what the code does not say.", "copy"), ("keep the order of things as it was before", "copy"), ("load", "copy"),
        ("Liest 3 Einträge und verwirft die übrigen.", "language"), ("Czyta wpisy i pomija resztę.", "language"), ("ロックは解除されます。", "language"), ("Sans verrou, le fichier reste inchangé.", "language"),
        ("Merges the lists because the", "truncated"), ("Calls `load", "truncated"), ("Merges the lists (see `load`", "truncated"), ("Merges the lists,", "truncated"), ("For example:\n```\nload(", "truncated"),
    ],
)
def test_defects(answer, what):
    assert responses.defect(answer, PROMPT) == what


REQUESTS = "id string, file string, qualname string, kind string, sig_hash string, snippet string, snippet_ref string, `def` struct<answer:string>, blocks struct<doc_summary:string,length_note:string,stmt_lines:array<int>,insertions:map<string,string>,chunks:array<struct<bidx:int,lines:array<int>,anchor:string,existing:string,preserve:boolean,answer:string>>>, fragment string, issued_at timestamp, received_at timestamp, salt int, found string, defect string"


def test_broken_responses(spark):
    code = "int f(int a) { return merge(a, 1) + merge(a, 2); }"
    chunk = lambda k, a: (k, None, None, None, None, a)
    base = lambda i, snippet, ref, d, chunks: (i, "f.c", None, None, None, snippet, ref, d, (None, None, None, None, chunks) if chunks is not None else None, None, None, None, 1, "z", "z")
    rows = [
        base("1", code, None, (code,), None), base("1", code, None, (code,), None), base("2", None, "1", (code,), [chunk(0, "NONE"), chunk(1, None), chunk(2, " "), chunk(None, "I cannot help.")]), base("3", None, "nowhere", (code,), []),
        base("4", None, None, None, [None]), base(None, None, None, (None,), None), base("6", "x " * 60_000, None, ("The lock is held until the row was validated by the caller.",), None), base("7", "", None, ("The lock is held until the row was vali",), None),
    ]
    got = {(r.id, r.slot, r.defect) for r in responses.broken_responses(spark.createDataFrame(rows, REQUESTS)).collect()}
    assert got == {("1", "def", "copy"), ("2", "def", "copy"), ("2", "b2", "empty"), ("2", "b3", "refusal"), ("7", "def", "truncated")}
    assert responses.broken_responses(spark.createDataFrame([], REQUESTS)).count() == 0


def test_responses_cut_off_do_not_depend_on_the_size_of_the_corpus(spark):
    def flagged(times):
        texts = ["It counts the row in characters and not in bytes.", "It keeps the issue of the row as it is.", "The segment is read before the segments are."] * 150
        texts += ["It may be char of any kind.", "Each of the rows, and the.", "Keep the segment"] * 2
        rows = [(f"{k}-{i}", "f.c", None, None, None, "int f;", None, (x,), None, None, None, None, 1, "z", "z") for k in range(times) for i, x in enumerate(texts)]
        rows += [(f"{x}{k}", "f.c", None, None, None, "int f;", None, (x,), None, None, None, None, 1, "z", "z") for k in range(times) for x in ("It counts the node in char", "It keeps the iss", "It reads the segment")]
        return {r.id.rstrip("0123456789") for r in responses.broken_responses(spark.createDataFrame(rows, REQUESTS)).collect() if r.defect == "truncated"}

    want = {"It counts the node in char", "It keeps the iss"}
    assert flagged(1) == want and flagged(20) == want


PROSE = "The lock is held until the row was read. It returns nothing if the cache is empty, and the caller still owns the file."


@pytest.mark.parametrize(
    "text, spam_",
    [
        (PROSE, False), (PROSE * 30, False), ("", False), ("  \n \n", False), ("The panel is the only panel that a glyph may hold. A volatile panel is not a panel in the sense of this guide. " * 4, False), ("```\nmerge_row(key, 3)\nload_key(row, 4)\n```", False),
        ("\n".join(f"10:{i:02} INFO open_row key={i}" for i in range(20)), False), ("\n".join(f"  --open-row{i}  Keep the row until the key is merged." for i in range(9)), False), ("\n".join(f"- `load{i}`: It returns the row, or nothing if the key was merged." for i in range(9)), False), ("カウンタは以前失われていた区間も保持します。" * 9, False),
        (f"{PROSE} See https://a.example/x/y and https://b.example/z.", False), ("a-" * 40_000, False),
        ("\n".join(f"https://www.a.example/x/y{i}.html" for i in range(30)), True), ("\n".join(f'<a href="http://a.example/{i}">row key</a>' for i in range(20)), True), ("\n".join(f"hxxp://a[.]example[.]test/x{i}" for i in range(20)), True), ("\n".join(f"- [row key](https://a.example/{i})" for i in range(20)), True),
        ("code linter, doc builder, " * 40, True), ("best code linter free code linter buy code linter online " * 20, True), ("[ivory] [pool] [official deal] " * 30, True), ("#row\n#key\n#lock\n#cache\n" * 10, True), ("Profile pro » Filter top » Window discount » " * 15, True), ("\n".join(f"Row key | SKU {i}123 | black | XL | {i}.99" for i in range(20)), True),
        ("The best shoes are the shoes that you want. If you want the best shoes, buy the best shoes at the shop for shoes, as the shoes are the best of the shoes. " * 3, True),
        ("整形 ツール 格安; コード 検査 無料; " * 30, True), (PROSE + "\n\n" + "code linter | doc builder | " * 60, True), (PROSE * 8 + "\n\ncode linter | doc builder | code linter", False),
    ],
)
def test_spam(text, spam_):
    s = spam.shares(text)
    assert (s["links"] + s["tags"] + s["menu"] > spam.SHARE) is spam_


def test_packing_shifts_are_no_driver_matter(spark, monkeypatch):
    d = documents(spark, [(i, "word " * (1 + i % 7), None) for i in range(900)])
    want = packing.fill_report(packing.pack(d, 16), 16).first()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        sized = packing.sizes(d)
        for salts in (1, 3, 64):
            p = packing.pack(d, 16, sized=sized, salts=salts)
            assert packing.fill_report(p, 16).first() == want and p.select("container_id", "container_offset").distinct().count() == 900
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_spam_on_tables(spark):
    d = documents(spark, [(1, "code linter, doc builder, " * 40, None), (2, None, None), (3, "", None), (None, "#a #b #c\n" * 9, None), (1, "code linter, doc builder, " * 40, None)])
    assert sorted((r.doc_id or 0) for r in spam.flagged(d).collect()) == [0, 1, 1]
    assert spam.flagged(documents(spark, [])).count() == 0


def test_broken_files(spark):
    rows = [("/srv/t/r/a.c", b"int f( {", "lf", "c"), ("/srv/t/r/a.c", b"int f( {", "lf", "c"), ("/srv/t/r/b.py", b"x = 1\n", "lf", "python"), ("/srv/t/r/c.js", None, "lf", "javascript"), ("/srv/t/r/d.go", b"((", "lf", "go"), ("/srv/t/r/LICENSE", b"((", "lf", None), (None, b"(", "lf", "c")]
    files = run_files(spark, rows)
    bad = parsing.broken_files(files)
    assert {(r.file_key, r.line_no) for r in bad.collect()} == {("/srv/t/r/a.c", 1), (None, 1)}
    rate = {(r.repo, r.language): (r.n_files, r.n_invalid, r.rate) for r in parsing.rates(files.filter("file_key is not null"), bad).collect()}
    assert rate == {("r", "c"): (1, 1, 1.0), ("r", "python"): (1, 0, 0.0)}
    assert parsing.broken_files(run_files(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "I'm not in a position to comment on this.", "There isn't enough information for me to say anything useful.", "I'd rather not guess what this does.", "Without the callers I can't say.", "I do not understand this routine well enough.", "Would you mind sharing the header first?", "This is outside my area, sorry.",
        "I need to see the rest before I can comment.", "It's impossible for me to tell from this fragment.", "Apologies, but no.", "We are unable to say more, sorry.", "Can someone send the rest of the file?", "Unable to describe `load`.", "I have no access to the callers.",
    ],
)
def test_refusals_in_other_words(text):
    assert responses.refuses(text)


@pytest.mark.parametrize(
    "text",
    [
        "Prints 'please provide a path' and exits with status 2.", "Skips to the footer without seeing the header rows.", 'Returns "I cannot open the file" as the message.', "Callers cannot help but hold the lock.", "Sorry entries are skipped.", "We cannot hold the lock here, since the pool may block.", "Refuses a request that has not enough rows.",
        "Asks the caller for more context lines.", "The I/O thread cannot be stopped.", "Let the caller know that the row was dropped.", "More details are in the header.", "Requests without enough information are rejected.", "The policy decides which rows are kept.", "Index i must not pass n.",
    ],
)
def test_descriptions_that_speak_of_refusing(text):
    assert not responses.refuses(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Fungsi ini mengembalikan baris yang sudah dibaca dan tidak menutup berkas.", True), ("Leann an fheidhm seo ar aghaidh go dti an deireadh agus ni stopann si.", True), ("Visszaadja a sort, ha meg nem olvastak be, es nem zarja le a fajlt.", True), ("Tra ve dong da doc va khong dong tep.", True), ("Funkcija vraca redak ako nije procitan.", True), ("Geeft de regel terug als die nog niet gelezen is.", True),
        ("Keeps a café key.", False), ("The naïve façade is kept.", False), ("Return a row.", False), ("We use la and de as labels of rows.", False), ("Note: i, u and z are axes.", False), ("no data", False), ("Merges rows; drops stale ones", False),
    ],
)
def test_languages_in_other_words(text, want):
    assert responses.foreign(text) is want


def test_repositories_lie_where_they_are_said_to(spark):
    rows = [("/data/a/b/r/LICENSE", LICENCES[2][4].encode(), "lf", None), ("/data/a/b/r/src/x.c", b"int x;", "lf", "c")]
    out = {(r.scope, r.item): (r.licence, r.flag) for r in licences.licence_findings(run_files(spark, rows), licence_table(spark), above=3).collect()}
    assert out == {("file", "/data/a/b/r/src/x.c"): ("BB", "ok"), ("repo", "r"): ("BB", "ok")}


def test_pieces_with_null_endings_and_exact_limits(spark):
    rows = [("a", b"x" * 100, None, "c"), ("b", b"x" * 101, None, "c"), ("c", b"\n" * 150, "lf", "c")]
    got = {r.file_key: r.n for r in splitting.split_records(run_files(spark, rows), 100, 10).groupBy("file_key").count().withColumnRenamed("count", "n").collect()}
    assert got == {"b": 2, "c": 2}
