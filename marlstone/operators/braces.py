"""Definitions of brace languages and Python by lexing.

A state machine tells code from strings and comments in one pass over the source and pairs the brackets of the code as it
goes; definitions are then read off the brackets. Broken sources give what their brackets allow.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

LANGUAGES = ("python", "c", "javascript")
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: What the machine stops at while in code.
_STOP = {"python": re.compile(r"[#'\"()\[\]{}]"), "c": re.compile(r"[/#'\"()\[\]{}]"), "javascript": re.compile(r"[/`'\"()\[\]{}]")}
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'")
_TRIPLE = re.compile(r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*\\?(?:'''|\Z)|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\\?(?:\"\"\"|\Z)")
_COMMENT = {"python": re.compile(r"#[^\n]*"), "c": re.compile(r"//(?:[^\n\\]|\\\n?)*|/\*[\s\S]*?(?:\*/|\Z)"), "javascript": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)")}
_DIRECTIVE = re.compile(r"#(?:[^\n\\/]|\\[\s\S]|/(?![/*]))*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*\\?(?P<end>`|\$\{|\Z)")
_REGEX = re.compile(r"/(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_LAST_WORD = re.compile(r"[\w$]+$")
#: Words after which a slash begins a regular expression.
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "instanceof", "new", "do", "else", "throw", "yield", "await"}
_CONDITION = re.compile(r"\s*#\s*(ifdef|ifndef|if|elif|else|endif)\b\s*(.*)")
_NOT_LINE = re.compile(r"[^\n]+")


class Lexed(NamedTuple):
    code: str  #: the text with strings, comments, directives and left-out branches blanked; line ends are kept
    comments: list[tuple[int, int]]
    partner: dict[int, int]  #: of every paired bracket, the other one
    lines: list[int]  #: where each line begins


def _blanked(text: str) -> str:
    return _NOT_LINE.sub(lambda m: " " * len(m.group()), text) if "\n" in text else " " * len(text)


def lexed(text: str, language: str) -> Lexed:
    """One pass over a source. Of C's conditional branches the first counts (of `#if 0` the second)."""
    find, comment, n = _STOP[language].search, _COMMENT[language].match, len(text)
    parts: list[str] = []
    comments: list[tuple[int, int]] = []
    partner: dict[int, int] = {}
    open_: list[tuple[str, int]] = []  # "`" stands for a place within a template
    branches: list[bool] = []  # of each open conditional: whether the branch counts
    taken: list[bool] = []
    counts, since, look = True, 0, 0  # what comes from `since` on is not copied yet

    def blank(start: int, end: int) -> None:
        """Copies the code before a place, and blanks what stands there."""
        nonlocal since, look
        parts.append(text[since:start] if counts else _blanked(text[since:start]))
        parts.append(_blanked(text[start:end]))
        since = look = end

    def template(i: int) -> None:
        m = _TEMPLATE.match(text, i)
        if m["end"] == "${":
            open_.append(("`", m.end()))
        blank(i, m.end())

    while look < n:
        m = find(text, look)
        if m is None:
            break
        at, c = m.start(), m.group()
        look = at + 1
        if c in "([{":
            if counts:
                open_.append((c, at))
        elif c in ")]}":
            if not counts:
                continue
            if c == "}" and open_ and open_[-1][0] == "`":
                open_.pop()
                blank(at, at + 1)
                template(at + 1)
                continue
            want = _PAIRS[c]
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == "`":
                    break
                if open_[k][0] == want:
                    partner[at], partner[open_[k][1]] = open_[k][1], at
                    del open_[k:]
                    break
        elif c in "'\"":
            m = (_TRIPLE.match(text, at) if language == "python" else None) or _STRING.match(text, at)
            if m:
                blank(at, m.end())
        elif c == "`":
            blank(at, at + 1)
            template(at + 1)
        elif c == "#" and language == "c":
            if not text[text.rfind("\n", 0, at) + 1 : at].strip(" \t"):
                m = _DIRECTIVE.match(text, at)
                blank(at, m.end())
                _branch(m.group(), branches, taken)
                counts = all(branches)
        else:
            m = comment(text, at)
            if m:
                comments.append(m.span())
                blank(at, m.end())
            elif language == "javascript":
                head = text[max(0, at - 200) : at].rstrip()
                last, word = head[-1:], _LAST_WORD.search(head)
                m = _REGEX.match(text, at)
                if m and (word[0] in BEFORE_REGEX if word else last not in (")", "]")):
                    blank(at, m.end())
    parts.append(text[since:] if counts else _blanked(text[since:]))
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    return Lexed("".join(parts), comments, partner, lines)


def _branch(directive: str, branches: list[bool], taken: list[bool]) -> None:
    m = _CONDITION.match(directive)
    if not m:
        return
    if m[1].startswith("if"):
        counts = not (m[1] == "if" and m[2].strip() == "0")
        branches.append(counts)
        taken.append(counts)
    elif branches and m[1] == "endif":
        branches.pop()
        taken.pop()
    elif branches:
        branches[-1] = not taken[-1]
        taken[-1] = True


class Definition(NamedTuple):
    """A definition; lines are 1-based. The code is that of the source, own_doc the comment right above (Python: the docstring)."""

    name: str
    qualname: str
    kind: str
    start_line: int
    end_line: int
    depth: int
    parent: str | None
    signature: str
    code: str
    own_doc: str | None
    calls: list[tuple[str, str, int]]
    start: int  #: where it begins and ends in the text
    end: int


_CALL = re.compile(r"(\bthis\s*\.\s*|\bself\s*\.\s*|[.>]\s*)?(?<![\w$])([A-Za-z_$][\w$]*)\s*\(")
#: Words that a bracket follows without being called.
NOT_CALLED = {"if", "for", "while", "switch", "return", "sizeof", "catch", "function", "do", "else", "typeof", "await", "yield", "new", "in", "of", "case", "throw", "super", "defined", "and", "or", "not", "lambda", "elif", "assert", "with", "except", "_Alignof", "alignof", "def", "class", "is"}
_WORD_BEFORE = re.compile(r"([\w$#]+)\s*$")


def _line(x: Lexed, at: int) -> int:
    return bisect_right(x.lines, at)


def _calls(x: Lexed, start: int, end: int, inner: list[tuple[int, int]], language: str) -> list[tuple[str, str, int]]:
    """(name, kind, line) of the calls within a body; definitions within it are opaque."""
    out, at = [], start
    for a, b in [*inner, (end, end)]:
        for m in _CALL.finditer(x.code, at, max(at, a)):
            before = (m[1] or "").strip()
            if m[2] in NOT_CALLED and not before:
                continue
            kind = "free" if not before else "self" if before[:4] in ("this", "self") else "method"
            if language == "c" and kind != "free":
                continue
            out.append((m[2], kind, _line(x, m.start(2))))
        at = max(at, b)
    return out


def _above(text: str, x: Lexed, start: int, ends: dict[int, int]) -> str | None:
    """The comments that end right above a place: one block comment, or a run of line comments; no blank between."""
    at = x.lines[_line(x, start) - 1] - 1
    if at < 0 or text[at + 1 : start].strip(" \t"):
        return None
    first, last = None, at + 1
    while at > 0:
        e = at
        while e > 0 and text[e - 1] in " \t\r":
            e -= 1
        s = ends.get(e)
        if s is None or text[x.lines[_line(x, s) - 1] : s].strip(" \t"):
            break
        if first is not None and text.startswith("/*", s):
            break
        first, at = s, x.lines[_line(x, s) - 1] - 1
        if text.startswith("/*", s):
            break
    return None if first is None else text[first:last].strip()


def _signature(text: str) -> str:
    return " ".join(text.split())


def _made(text: str, x: Lexed, language: str, found: list[tuple], with_calls: bool) -> list[Definition]:
    """Definitions from (start, header end, end, name, kind, scope, parameter end): qualified, documented, with calls."""
    ends = {e: s for s, e in x.comments}
    found = sorted(found)
    out, scopes = [], []  # scopes: (end, qualname) of what opens a scope for names
    for k, (start, header, end, name, kind, opens, body) in enumerate(found):
        while scopes and scopes[-1][0] <= start:
            scopes.pop()
        parent = scopes[-1][1] if scopes else None
        qualname = f"{parent}.{name}" if parent else name
        if kind != "binding":
            inner, j = [], k + 1
            while with_calls and j < len(found) and found[j][0] < end:
                if found[j][4] != "binding":
                    inner.append((found[j][0], found[j][2]))
                j += 1
            calls = [] if kind in ("class", "declaration") or not with_calls else _calls(x, body, end, inner, language)
            code = text[start:end]
            out.append(Definition(name, qualname, kind, _line(x, start), _line(x, max(start, end - 1)), len(scopes), parent, _signature(text[start:header]), code, _above(text, x, start, ends), calls, start, end))
        if opens:
            scopes.append((end, qualname))
    return out


# C


_TYPE_BEFORE = re.compile(r"[\w*]\s*$")
_EXTERN = re.compile(r"\bextern\s*$")
_STATEMENT = re.compile(r"[;{}]")
#: Words that stand before a bracket in a header or statement of C without being the routine's name.
NOT_NAMES = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "typeof", "__attribute__", "__declspec", "_Alignas", "alignas", "asm", "__asm__", "_Static_assert", "static_assert", "case", "goto"}


def _c(text: str, x: Lexed) -> list[tuple]:
    code, partner, out = x.code, x.partner, []

    def named(close: int, start: int) -> tuple[str, int] | None:
        """The routine's name before the bracket that closes here, and where its parameters open."""
        while close >= 0 and code[close] == ")" and close in partner:
            opening = partner[close]
            m = _WORD_BEFORE.search(code, max(start, opening - 300), opening)
            if not m:
                return None
            if m[1] not in NOT_NAMES:
                return (m[1], opening) if _TYPE_BEFORE.search(code, start, m.start()) and "=" not in code[start : m.start()] else None
            close = m.start() - 1
            while close >= start and code[close].isspace():
                close -= 1
        return None

    def walk(at: int, end: int) -> None:
        start = at
        while True:
            m = _STATEMENT.search(code, at, end)
            if not m:
                return
            i, c = m.start(), m.group()
            # brackets before it may hold semicolons and braces of their own
            skip = next((partner[k] + 1 for k in range_of(at, i) if partner.get(k, -1) > i), None)
            if skip is not None:
                at = skip
                continue
            begin = start
            while begin < i and code[begin].isspace():
                begin += 1
            last = i - 1
            while last > begin and code[last].isspace():
                last -= 1
            if c == "{":
                close = partner.get(i)
                if close is None:
                    at = start = i + 1
                    continue
                got = named(last, begin) if last > begin else None
                if _EXTERN.search(code, begin, i):
                    walk(i + 1, close)
                elif got:
                    out.append((begin, last + 1, close + 1, got[0], "function", False, partner[got[1]] + 1))
                elif last > begin and (code[last] == "=" or re.match(r"(?:typedef\s+)?(?:(?:static|const|volatile|extern)\s+)*(?:struct|union|enum)\b", code[begin:i])):
                    at = close + 1  # a type or a value: its statement goes on to the semicolon
                    continue
                at = start = close + 1
            elif c == ";":
                if last > begin and not re.match(r"typedef\b|return\b|goto\b", code[begin:i]):
                    got = named(last, begin)
                    if got:
                        out.append((begin, last + 1, i + 1, got[0], "declaration", False, i))
                at = start = i + 1
            else:
                at = start = i + 1

    opens = sorted(k for k, v in partner.items() if k < v and code[k] in "([")

    def range_of(a: int, b: int) -> list[int]:
        return opens[bisect_right(opens, a - 1) : bisect_right(opens, b - 1)]

    walk(0, len(code))
    return out


# JavaScript


_CLASS = re.compile(r"(?<![\w$.])class(?:\s+(?!extends\b)([\w$]+))?(?:\s+extends\s+[^{]*)?\s*\Z")
_FUNCTION = re.compile(r"(?<![\w$.])((?:async\s+)?function)\b\s*\*?\s*([\w$]*)\s*\Z")
_BOUND = re.compile(r"(?<![\w$.])((?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*=)\s*(?:async\s*)?\Z")
_PAIR = re.compile(r"(?:^|[{,])\s*([\w$]+)\s*:\s*(?:async\s*)?\Z")
_METHOD = re.compile(r"(?:^|[{};,])?\s*((?:static\s+)?(?:async\s+)?(?:get\s+|set\s+)?\*?\s*([\w$#]+))\s*\Z")
_LITERAL = re.compile(r"(?<![\w$.])(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*=\s*\Z")
_EXPORT = re.compile(r"(?<![\w$.])(export\s+(?:default\s+)?)\Z")
_ARROW = re.compile(r"=>")
#: Words that a bracketed head and a block follow without being a routine.
CONTROL = {"if", "for", "while", "switch", "catch", "with", "do", "else", "return", "function", "await"}


def _javascript(text: str, x: Lexed) -> list[tuple]:
    code, partner, out = x.code, x.partner, []
    bodies: dict[int, str] = {}  # where a class body or a bound object literal opens

    def back(i: int) -> int:
        while i >= 0 and code[i].isspace():
            i -= 1
        return i

    def since(i: int) -> int:
        """Where the statement, or what is left of it before this place, begins at the earliest."""
        low = max(0, i - 2000)
        return max(code.rfind(";", low, i), code.rfind("{", low, i), code.rfind("}", low, i), code.rfind(")", low, i), low - 1) + 1

    def exported(i: int) -> int:
        m = _EXPORT.search(code, max(0, i - 40), i)
        return m.start(1) if m else i

    def end_of(at: int) -> int:
        """Where an expression that begins here ends."""
        i = at
        while i < len(code):
            c = code[i]
            if c in "([{" and i in partner:
                i = partner[i]
            elif c in ";,)]}":
                return i
            i += 1
        return len(code)

    def enclosing(i: int) -> str | None:
        return bodies.get(around[-1]) if around else None

    opens = sorted(k for k, v in partner.items() if k < v and code[k] == "{")
    arrows = [m.start() for m in _ARROW.finditer(code)]
    around: list[int] = []
    events = sorted([(i, "{") for i in opens] + [(i, "=>") for i in arrows])
    for i, what in events:
        while around and partner[around[-1]] < i:
            around.pop()
        last = back(i - 1)
        if what == "=>":
            body = i + 2
            while body < len(code) and code[body].isspace():
                body += 1
            block = code[body : body + 1] == "{" and body in partner
            if last >= 0 and code[last] == ")" and last in partner:
                head = partner[last]
            else:
                m = _WORD_BEFORE.search(code, since(last), last + 1)
                if not m:
                    continue
                head = m.start(1)
            end = partner[body] + 1 if block else end_of(body)
            m = _BOUND.search(code, since(head), head)
            if m:
                out.append((m.start(1), i + 2, end, m[2], "var_arrow", False, i + 2))
                continue
            m = _PAIR.search(code, max(0, since(head) - 1), head)
            if m and enclosing(i) == "object":
                out.append((m.start(1), i + 2, end, m[1], "obj_method", False, i + 2))
            continue
        around.append(i)
        if last < 0:
            continue
        if code[last] == ")" and last in partner:
            head = partner[last]
            f = _FUNCTION.search(code, since(head), head)
            if f and f[2]:
                m = _BOUND.search(code, since(f.start(1)), f.start(1))
                if m:
                    out.append((m.start(1), last + 1, partner[i] + 1, m[2], "var_func", False, last + 1))
                elif _stands(code, back(f.start(1) - 1)):
                    out.append((exported(f.start(1)), last + 1, partner[i] + 1, f[2], "function", True, last + 1))
                continue
            if f:
                m = _BOUND.search(code, since(f.start(1)), f.start(1))
                if m:
                    out.append((m.start(1), last + 1, partner[i] + 1, m[2], "var_func", False, last + 1))
                    continue
                m = _PAIR.search(code, max(0, since(f.start(1)) - 1), f.start(1))
                if m and len(around) > 1 and bodies.get(around[-2]) == "object":
                    out.append((m.start(1), last + 1, partner[i] + 1, m[1], "obj_method", False, last + 1))
                continue
            outer = bodies.get(around[-2]) if len(around) > 1 else None
            if outer:
                m = _METHOD.search(code, max(around[-2] + 1, since(head)), head)
                if m and m[2] not in CONTROL:
                    before = back(m.start(1) - 1)
                    if before == around[-2] or code[before] in "};,":
                        out.append((m.start(1), last + 1, partner[i] + 1, m[2], "method" if outer == "class" else "obj_method", False, last + 1))
            continue
        m = _CLASS.search(code, since(i), i)
        if m:
            bodies[i] = "class"
            start, name = m.start(), m[1]
            if not name:
                b = _BOUND.search(code, since(start), start)
                name, start = (b[2], b.start(1)) if b else (None, start)
            if name:
                out.append((exported(start), back(i - 1) + 1, partner[i] + 1, name, "class", True, i + 1))
            continue
        m = _LITERAL.search(code, since(i), i)
        if m:
            bodies[i] = "object"
            out.append((m.start(), i, partner[i] + 1, m[1], "binding", True, i + 1))
    return out


def _stands(code: str, last: int) -> bool:
    """Whether a function that begins after this place is a declaration, not part of an expression."""
    return last < 0 or code[last] in ";{}" or bool(re.search(r"(?:export|default|else|\))\Z", code[max(0, last - 8) : last + 1])) or code[last] not in "=(,:?!&|+-*/%<>[~^."


# Python


_DEF = re.compile(r"((?:async[ \t]+)?def|class)[ \t]+(\w+)")
_DOC = re.compile(r"\s*(?:\#[^\n]*\n\s*)*(?i:[ru]?)('''|\"\"\"|'|\")")
_INDENT = re.compile(r"(?m)^([ \t]*)[^\s]")


def _python(text: str, x: Lexed, with_calls: bool) -> list[Definition]:
    code, partner = x.code, x.partner
    found: list[list] = []
    open_: list[tuple[int, int]] = []  # (column, number in found) of definitions whose blocks go on
    brackets = iter(sorted(k for k, v in partner.items() if k < v and code.find("\n", k, v) >= 0))
    bracket, inside = next(brackets, None), -1

    def close(n: int, end: int) -> None:
        body = text[found[n][0] : end].rstrip()
        while (k := body.rfind("\n") + 1) and body[k:].lstrip().startswith("#"):
            body = body[:k].rstrip()
        found[n][2] = found[n][0] + len(body)

    for line in _INDENT.finditer(code):
        start = line.end() - 1
        while bracket is not None and bracket < start:  # lines within brackets do not end anything
            inside = max(inside, partner[bracket])
            bracket = next(brackets, None)
        if start <= inside:
            continue
        column = len(line[1].expandtabs())
        while open_ and open_[-1][0] >= column:
            close(open_.pop()[1], line.start())
        if code[start] not in "adc":
            continue
        m = _DEF.match(code, start)
        if not m:
            continue
        at = m.end()
        while at < len(code) and code[at] != ":" and code[at] != "\n":
            at = partner.get(at, at) + 1
        if code[at : at + 1] != ":":
            continue
        open_.append((column, len(found)))
        found.append([start, at, len(code), m[2], "async def" if m[1].startswith("async") else m[1], None])
    while open_:
        close(open_.pop()[1], len(code))
    for f in found:
        q = _DOC.match(text, f[1] + 1)
        if q and q.end() <= f[2]:
            end = text.find(q[1], q.end())
            f[5] = text[q.end() : end] if end >= 0 else None
    out, scopes = [], []
    for k, (start, at, end, name, kind, doc) in enumerate(found):
        while scopes and scopes[-1][0] <= start:
            scopes.pop()
        parent = scopes[-1][1] if scopes else None
        qualname = f"{parent}.{name}" if parent else name
        inner, j = [], k + 1
        while with_calls and kind != "class" and j < len(found) and found[j][0] < end:
            inner.append((found[j][0], found[j][2]))
            j += 1
        calls = _calls(x, at, end, inner, "python") if with_calls and kind != "class" else []
        out.append(Definition(name, qualname, kind, _line(x, start), _line(x, max(start, end - 1)), len(scopes), parent, _signature(text[start:at]), text[start:end], doc, calls, start, end))
        scopes.append((end, qualname))
    return out


def definitions(text: str, language: str, with_calls: bool = True) -> list[Definition]:
    """The definitions of a source, in order of their starts; of line endings only \\n counts."""
    x = lexed(text, language)
    if language == "python":
        return _python(text, x, with_calls)
    return _made(text, x, language, (_c if language == "c" else _javascript)(text, x), with_calls)


def functions(text: str, language: str, with_calls: bool = True) -> list[Definition]:
    """The definitions that have a body of their own: neither classes nor declarations."""
    return [d for d in definitions(text, language, with_calls) if d.kind not in ("class", "declaration")]
