"""Preprocessor, lexer and parsing-expression grammar of C11 (syntax only)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from marlstone.llm.grammars.conditions import FILE, OPEN_CURLY, Dead, Places, Sets
from marlstone.llm.grammars.peg import Grammar
from marlstone.llm.grammars.python import Malformed

GRAMMAR = r"""
file <- [UNITS ext]
ext <- ';' / assertion / function / declaration / (NAME P<anything*>)+ (';' / function / declarator attributes C<block> / declaration / NAME P<args?> ';')
function <- specs declarator attributes declaration* C<block>
assertion <- '_Static_assert' P<assign ',' STR+> ';'
declaration <- specs (initialised (',' initialised)*)? ';' / assertion
initialised <- declarator attributes ('=' init)?
attributes <- ('__attribute__' P<anything*> / '__asm__' P<anything*> / 'asm' P<anything*>)*
anything <- P<anything*> / B<anything*> / C<anything*> / any
specs <- storage* typed storage*
storage <- 'static' / 'extern' / 'typedef' / 'register' / 'auto' / 'inline' / '__inline' / '__inline__' / '_Noreturn' / '_Thread_local' / qualifier / '_Alignas' P<typename / assign> / '__attribute__' P<anything*> / '__extension__'
qualifier <- 'const' / 'volatile' / 'restrict' / '__restrict' / '__restrict__' / '__volatile__' / '__const' / '_Atomic' !P<anything*>
typed <- (builtin storage*)+ / ('struct' / 'union') attributes NAME? C<field*> attributes / ('struct' / 'union') attributes NAME / 'enum' attributes NAME? C<enumerators> attributes / 'enum' NAME / '_Atomic' P<typename> / ('typeof' / '__typeof__') P<typename / expr> / NAME
builtin <- 'void' / 'char' / 'short' / 'int' / 'long' / 'float' / 'double' / 'signed' / 'unsigned' / '_Bool' / '_Complex' / '__signed__' / '__int128'
enumerators <- enumerator (',' enumerator)* ','?
enumerator <- NAME ('=' cond)?
field <- specs (member (',' member)*)? ';' / assertion / ';'
member <- declarator? ':' cond attributes / declarator attributes
declarator <- pointer* attributes direct
pointer <- '*' (qualifier / '__attribute__' P<anything*>)*
direct <- (NAME / P<declarator>) suffix*
suffix <- P<params?> / B<extent?>
extent <- ('static' / qualifier)* (assign / '*')?
params <- param (',' param)* (',' '...')?
param <- specs (declarator / abstract?) attributes / specs attributes
abstract <- pointer+ inner? / inner
inner <- P<abstract> suffix* / suffix+
typename <- specs abstract?
init <- C<inits?> / assign
inits <- designated (',' designated)* ','?
designated <- ((B<cond ('...' cond)?> / '.' NAME)+ '=')? init
block <- [UNITS item]
item <- statement / declaration
statement <- C<block> / NAME ':' attributes statement / 'case' cond ('...' cond)? ':' statement / 'default' ':' statement
  / 'if' P<expr> statement ('else' statement)? / 'switch' P<expr> statement / 'while' P<expr> statement / 'do' statement 'while' P<expr> ';' / 'for' P<forhead> statement
  / 'goto' NAME ';' / 'continue' ';' / 'break' ';' / 'return' expr? ';' / ('asm' / '__asm__') ('volatile' / '__volatile__' / 'goto')* P<anything*> ';' / expr? ';'
forhead <- (declaration / expr? ';') expr? ';' expr?
expr <- assign (',' assign)*
assign <- unary assignop assign / cond
cond <- binary ('?' expr? ':' cond)?
binary <- cast (binop cast)*
cast <- P<typename> cast / unary
unary <- ('++' / '--') unary / unop cast / 'sizeof' P<typename> !C<inits?> / 'sizeof' unary / '_Alignof' P<typename> / '&&' NAME / postfix
postfix <- (P<typename> C<inits?> / primary) (B<expr> / P<args?> / ('.' / '->') NAME / '++' / '--')*
primary <- NAME / NUM / CHAR / (STR / NAME &STR STR)+ / P<expr> / P<C<block>> / '_Generic' P<assign (',' (typename / 'default') ':' assign)+>
args <- arg (',' arg)*
arg <- assign / typename
"""

KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef "
    "union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Noreturn _Static_assert _Thread_local __attribute__ __extension__ __asm__ __volatile__ "
    "__inline __inline__ __restrict __restrict__ __const __signed__ __typeof__ __int128"
)
OPERATORS = "+ - * / % & | ^ ~ ! < > <= >= == != && || << >> ++ -- = += -= *= /= %= &= |= ^= <<= >>= ? : ; , . ... -> # ##"
SETS = {
    "assignop": "= *= /= %= += -= <<= >>= &= ^= |=",
    "binop": "* / % + - << >> < > <= >= == != & ^ | && ||",
    "unop": "& * + - ~ !",
    "any": f"NAME NUM STR CHAR {KEYWORDS} {OPERATORS}",
}

_TOKEN = re.compile(
    r"(?P<k>[ \t\f\v\n]+|//[^\n]*|/\*[\s\S]*?\*/)"
    r"|(?P<s>(?:u8|u|U|L)?\"(?:[^\"\\\n]|\\[^\n])*\")"
    r"|(?P<c>(?:u|U|L)?'(?:[^'\\\n]|\\[^\n])+')"
    r"|(?P<w>[^\W\d]\w*|\$\w*)"
    r"|(?P<n>\.?\d(?:[eEpP][+-]|[\w.])*)"
    r"|(?P<b>[()\[\]{}])"
    r"|(?P<o><<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||<<|>>|[-+*/%&|^<>=!]=|\#\#|[-+*/%&|^~!<>=?:;,.\#])"
)
_NUMBER = re.compile(r"(?:0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+[fFlL]?|(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?[fFlL]?|\d+[eE][+-]?\d+[fFlL]?|(?:0[xX][0-9a-fA-F]+|0[bB][01]+|0[0-7]*|[1-9]\d*)(?:[uU](?:ll|LL|[lL])?|(?:ll|LL|[lL])[uU]?)?)$")
_DIRECTIVE = re.compile(r"[ \t]*(?:#|%:)[ \t]*(\w*)[ \t]*(.*)", re.S)
_ESCAPE = re.compile(r"\\(?:['\"?\\abfnrtv]|[0-7]{1,3}|x[0-9a-fA-F]+|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})")


def grammar() -> Grammar:
    g = Grammar(GRAMMAR, f"NAME NUM STR CHAR {KEYWORDS} asm typeof {OPERATORS}", SETS, units=";", goes_on="else while ;")
    return g


def _comment_free(text: str) -> str:
    """Comments as blanks of the same line count, strings kept; raises Malformed at a comment without end."""

    def blank(m: re.Match) -> str:
        x = m.group()
        if x[0] != "/":
            return x
        if x.startswith("/*") and (len(x) < 4 or not x.endswith("*/")):
            raise Malformed(m.start(), "comment without end")
        return " " + "\n" * x.count("\n")

    return re.sub(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\[^\n])*'", blank, text)


class Part:
    """A run of plain lines, or a conditional group with its branches."""

    __slots__ = ("branches", "start", "text")

    def __init__(self, text: str = "", start: int = 0, branches: list | None = None):
        self.text, self.start, self.branches = text, start, branches


def _spliced(text: str) -> list[tuple[int, str]]:
    """Logical lines with the number of their first line."""
    out, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        at, x = i, lines[i]
        while x.endswith("\\") and i + 1 < len(lines):
            i += 1
            x = x[:-1] + lines[i]
        out.append((at, x))
        i += 1
    return out


def structure(text: str) -> list[Part]:
    """The source as plain parts and nested conditional groups; raises Malformed where they don't pair."""
    top: list[Part] = []
    stack: list[tuple[list[Part], Part, int]] = []
    now, buf, first = top, [], 0

    def flush() -> None:
        nonlocal buf
        if buf:
            now.append(Part("\n".join(buf), first))
        buf = []

    for at, line in _spliced(_comment_free(text)):
        m = _DIRECTIVE.match(line) if "#" in line or "%:" in line else None
        if not m:
            if not buf:
                first = at
            buf.append(line)
            continue
        d, rest = m[1], m[2].strip()
        if d in ("if", "ifdef", "ifndef"):
            flush()
            if not rest:
                raise Malformed(at, "condition missing")
            group = Part(start=at, branches=[])
            now.append(group)
            stack.append((now, group, at))
            now = []
            group.branches.append((d, rest, now))
        elif d in ("elif", "else"):
            flush()
            if not stack or stack[-1][1].branches[-1][0] == "else":
                raise Malformed(at, "#else without #if")
            now = []
            stack[-1][1].branches.append((d, rest, now))
        elif d == "endif":
            flush()
            if not stack:
                raise Malformed(at, "#endif without #if")
            now = stack.pop()[0]
        else:
            flush()
            now.append(Part(start=at, text="", branches=[("directive", d, rest)]))
    flush()
    if stack:
        raise Malformed(stack[-1][2], "#if without #endif")
    return top


def _condition(kind: str, rest: str) -> tuple[str, bool] | bool:
    """A constant, or the tested thing and whether it is negated."""
    if kind in ("ifdef", "ifndef"):
        return rest.split()[0], kind == "ifndef"
    x = rest.strip()
    neg = False
    while True:
        y = x
        if x.startswith("(") and x.endswith(")") and _wraps(x):
            x = x[1:-1].strip()
        if x.startswith("!") and re.fullmatch(r"!\s*(\w+|\(.*\)|defined\s*\(?\s*\w+\s*\)?)", x) and (x[1:].strip()[0] != "(" or _wraps(x[1:].strip())):
            x, neg = x[1:].strip(), not neg
        if x == y:
            break
    m = re.fullmatch(r"defined\s*\(?\s*(\w+)\s*\)?", x)
    if m:
        return m[1], neg
    m = re.fullmatch(r"(0[xX][0-9a-fA-F]+|\d+)[uUlL]*", x)
    if m:
        return bool(int(m[1], 0 if m[1][:2].lower() == "0x" else 10)) != neg
    return x, neg


def _wraps(x: str) -> bool:
    depth = 0
    for i, c in enumerate(x):
        depth += (c == "(") - (c == ")")
        if not depth:
            return i == len(x) - 1
    return False


def tested(parts: list[Part], defined: frozenset = frozenset()) -> list[str]:
    """What the conditions test, in order; include guards are not among it."""
    out: dict[str, None] = {}

    def walk(ps: list[Part]) -> None:
        for p in ps:
            for b in p.branches or ():
                if b[0] == "directive":
                    continue
                if b[0] != "else":
                    c = _condition("if" if b[0] == "elif" else b[0], b[1])
                    if not isinstance(c, bool) and not _guards(b, c):
                        out[c[0]] = None
                walk(b[2])

    walk(parts)
    return list(out)


def _guards(branch: tuple, c: tuple[str, bool]) -> bool:
    inner = next((p for p in branch[2] if p.branches or p.text.strip()), None)
    return bool(c[1] and inner and inner.branches and inner.branches[0][:2] == ("directive", "define") and inner.branches[0][2].split("(")[0].split()[:1] == [c[0]])


def preprocessed(parts: list[Part], setting: dict[str, bool]) -> list[tuple[int, str]]:
    """Runs of plain text with their lines, macros' definitions among them as ('define', text)."""
    out: list = []

    def walk(ps: list[Part]) -> None:
        for p in ps:
            if not p.branches:
                out.append((p.start, p.text))
                continue
            if p.branches[0][0] == "directive":
                out.append((p.start, p.branches[0]))
                continue
            for b in p.branches:
                if b[0] == "else":
                    walk(b[2])
                    break
                c = _condition("if" if b[0] == "elif" else b[0], b[1])
                if c if isinstance(c, bool) else _guards(b, c) or setting.get(c[0], False) != c[1]:
                    walk(b[2])
                    break

    walk(parts)
    return out


DIRECTIVES = {"define", "undef", "include", "pragma", "line", "error", "warning", "ident", "include_next", "import", ""}


def _called(params: list[str], body: str, text: str, pos: int, line: int) -> tuple[str, int] | None:
    """What a macro with parameters becomes, and where its call ends; None where no call follows."""
    m = re.compile(r"\s*\(").match(text, pos)
    if not m:
        return None
    i, depth, args, start = m.end(), 1, [], m.end()
    while i < len(text) and depth:
        t = _TOKEN.match(text, i)
        if t is None:
            raise Malformed(line, "no token")
        y = t.group()
        if y in ("(", "[", "{"):
            depth += 1
        elif y in (")", "]", "}"):
            depth -= 1
        if not depth or y == "," and depth == 1:
            args.append(text[start:i])
            start = t.end()
        i = t.end()
    if depth:
        raise Malformed(line, "macro call without end")
    values = dict(zip(params, args))
    if params and params[-1] == "__VA_ARGS__":
        values["__VA_ARGS__"] = ",".join(args[len(params) - 1 :])
    body = re.sub(r"\#\s*(\w+)", lambda q: '""' if q[1] in values else q.group(), re.sub(r"\s*\#\#\s*", "", body) if not values else body)
    body = re.sub(r"(\w+)\s*\#\#\s*(\w+)", lambda q: f"{values.get(q[1], q[1]).strip()}{values.get(q[2], q[2]).strip()}", body)
    return re.sub(r"[^\W\d]\w*", lambda q: f" {values[q.group()]} " if q.group() in values else q.group(), body), i


def _directive(d: str, rest: str, line: int, text_of: str) -> tuple[str, tuple | None] | None:
    """The macro that a directive sets, and its parameters and body, or None for an end of it; Malformed for an error."""
    if d not in DIRECTIVES or d == "error":
        raise Malformed(line, "unknown directive" if d != "error" else "#error")
    if d == "define":
        m = re.match(r"([^\W\d]\w*)(\(([^()]*)\))?\s*", rest)
        if not m:
            raise Malformed(line, "macro without a name")
        if m[1] in text_of:
            params = [p.strip() for p in m[3].split(",") if p.strip()] if m[2] else None
            return m[1], (tuple("__VA_ARGS__" if p == "..." else p for p in params) if m[2] else None, rest[m.end() :])
    elif d == "undef":
        return rest.strip(), None
    elif d == "include" and not re.match(r"<[^>]+>\s*$|\"[^\"]+\"\s*$|[^\W\d]\w*", rest):
        raise Malformed(line, "nothing included")
    return None


def symbols(runs: list, g: Grammar, places: dict | None = None) -> str:
    """Symbols of preprocessed text; places, if given, gets for each group the lines of its symbols."""
    tok = g.tokens
    word, name, num, string, char = tok.get, tok["NAME"], tok["NUM"], tok["STR"], tok["CHAR"]
    out: list[str] = []
    at: list[int] = []
    stack: list[tuple] = []
    macros: dict[str, tuple[tuple[str, ...] | None, str]] = {}
    scan = _TOKEN.match

    def close(x: str, line: int) -> None:
        nonlocal out, at
        kind = {")": "P", "]": "B", "}": "C"}[x]
        if not stack or stack[-1][0] != kind:
            raise Malformed(line, "closing bracket without its opening one")
        symbol = g.intern(kind, "".join(out))
        if places is not None:
            places[symbol] = at
        _, out, at, start = stack.pop()
        out.append(symbol)
        at.append(start)

    def read(text: str, line: int, hidden: frozenset = frozenset()) -> None:
        nonlocal out, at
        pos, n = 0, len(text)
        while pos < n:
            m = scan(text, pos)
            if m is None:
                raise Malformed(line, "no token")
            k, pos = m.lastgroup, m.end()
            if k == "w":
                x = m.group()
                if macros and x in macros and x not in hidden:
                    pos = expand(x, text, pos, line, hidden)
                    continue
                out.append(word(x, name))
                at.append(line)
            elif k == "k":
                line += m.group().count("\n") if not hidden else 0
            elif k == "o":
                out.append(tok[m.group()])
                at.append(line)
            elif k == "b":
                x = m.group()
                if x in "([{":
                    stack.append(({"(": "P", "[": "B", "{": "C"}[x], out, at, line))
                    out, at = [], []
                else:
                    close(x, line)
            elif k == "n":
                if not _NUMBER.match(m.group()):
                    raise Malformed(line, "no number")
                out.append(num)
                at.append(line)
            else:
                x = m.group()
                if "\\" in x and _ESCAPE.sub("", x).count("\\"):
                    raise Malformed(line, "unknown escape")
                out.append(string if k == "s" else char)
                at.append(line)

    def expand(x: str, text: str, pos: int, line: int, hidden: frozenset) -> int:
        params, body = macros[x]
        if params is None:
            read(body, line, hidden | {x})
            return pos
        got = _called(params, body, text, pos, line)
        if got is None:
            out.append(name)
            at.append(line)
            return pos
        read(got[0], line, hidden | {x})
        return got[1]

    text_of = "\n".join(x for _, x in runs if isinstance(x, str))
    for line, run in runs:
        if isinstance(run, str):
            read(run, line)
            continue
        _, d, rest = run
        told = _directive(d, rest, line, text_of)
        if told and told[1]:
            macros[told[0]] = told[1]
        elif told:
            macros.pop(told[0], None)
    if stack:
        raise Malformed(stack[-1][3], "bracket without end")
    if places is not None:
        places[""] = at
    return "".join(out)


class _Search:
    """All settings at once: the places reached, each with the settings that lead there."""

    def __init__(self, parts: list[Part], names: list[str], g: Grammar):
        self.parts, self.g, self.sets, self.places = parts, g, Sets(), Places(g)
        self.order = {x: i for i, x in enumerate(names)}
        self.text_of = "\n".join(_texts(parts))
        #: of each macro its definitions (None: none), each with the settings under which it holds
        self.macros: dict[str, dict[tuple | None, int]] = {}

    def valid(self) -> bool:
        return any(self.places.accepted(frames) for frames in self.walk(self.parts, {(FILE,): 1}, 1))

    def walk(self, ps: list[Part], now: dict[tuple, int], path: int) -> dict[tuple, int]:
        """The places after the parts, from the places before them; path: all settings that come here."""
        less, both = self.sets.less, self.sets.both
        for p in ps:
            if not now:
                return now
            if not p.branches:
                now = self.text(p.text, now)
            elif p.branches[0][0] == "directive":
                try:
                    told = _directive(*p.branches[0][1:], p.start, self.text_of)
                except Malformed:
                    return {}
                if told:
                    old = self.macros.get(told[0], {None: 1})
                    new = {d: x for d, s in old.items() if (x := less(s, path))}
                    new[told[1]] = self.sets.either(new.get(told[1], 0), path)
                    self.macros[told[0]] = new
            else:
                after: dict[tuple, int] = {}
                left = path
                for b in p.branches:
                    c = True if b[0] == "else" else _condition("if" if b[0] == "elif" else b[0], b[1])
                    if isinstance(c, bool) or _guards(b, c):
                        here = int(not isinstance(c, bool) or c)
                    else:
                        here = self.sets.where(self.order[c[0]], not c[1])
                    taken = {f: x for f, s in now.items() if (x := both(s, here))}
                    self.join(after, self.walk(b[2], taken, both(left, here)))
                    now = {f: x for f, s in now.items() if (x := less(s, here))}
                    left = less(left, here)
                self.join(after, now)
                now = after
        return now

    def join(self, into: dict[tuple, int], more: dict[tuple, int]) -> None:
        for f, s in more.items():
            into[f] = self.sets.either(into.get(f, 0), s)

    def text(self, text: str, now: dict[tuple, int]) -> dict[tuple, int]:
        """Reads a run of plain text; where a macro's definition depends on the setting, the places part, and those
        that come to the same one are joined again at the next such macro."""
        at: dict[int, dict[tuple, int]] = {0: now}
        while min(at) < len(text):
            pos = min(at)
            for frames, s in at.pop(pos).items():
                todo = [s]
                while todo:
                    s = todo.pop()
                    try:
                        end, got = self.read(text, pos, frames, s)
                    except _Parting as e:
                        todo += e.sets
                        continue
                    except (Malformed, Dead):
                        continue
                    self.join(at.setdefault(end, {}), {got: s})
            if not at:
                return {}
        return at[len(text)]

    def definition(self, x: str, s: int) -> tuple | None:
        """What a macro stands for under the settings."""
        some = [(d, y) for d, z in self.macros[x].items() if (y := self.sets.both(s, z))]
        if len(some) > 1:
            raise _Parting([y for _, y in some])
        return some[0][0]

    def read(self, text: str, pos: int, frames: tuple, s: int) -> tuple[int, tuple]:
        """Reads on up to the next macro that depends on the setting, at least a token."""
        tok, stack, new = self.g.tokens, list(frames), [[] for _ in frames]
        word, name, scan, macros = tok.get, tok["NAME"], _TOKEN.match, self.macros

        def through(text: str, pos: int, hidden: frozenset) -> int:
            first = True
            while pos < len(text):
                m = scan(text, pos)
                if m is None:
                    raise Malformed(0, "no token")
                k, x, start, pos = m.lastgroup, m.group(), pos, m.end()
                if k == "w":
                    if x in macros and x not in hidden:
                        if not hidden and not first and len(macros[x]) > 1:
                            return start
                        d = self.definition(x, s)
                        if d is not None:
                            params, body = d
                            got = (body, pos) if params is None else _called(params, body, text, pos, 0)
                            if got is None:
                                new[-1].append(name)
                            else:
                                pos = got[1]
                                through(got[0], 0, hidden | {x})
                            if not hidden:
                                return pos
                            continue
                    new[-1].append(word(x, name))
                elif k == "k":
                    continue
                elif k == "o":
                    new[-1].append(tok[x])
                elif k == "b":
                    if x in "([{":
                        stack.append(OPEN_CURLY if x == "{" else ("P" if x == "(" else "B", ""))
                        new.append([])
                    else:
                        if stack[-1][0] != {")": "P", "]": "B", "}": "C"}[x]:
                            raise Malformed(0, "closing bracket without its opening one")
                        symbol = self.places.closed(self.places.settled(stack.pop(), "".join(new.pop())))
                        new[-1].append(symbol)
                elif k == "n":
                    if not _NUMBER.match(x):
                        raise Malformed(0, "no number")
                    new[-1].append(tok["NUM"])
                else:
                    if "\\" in x and _ESCAPE.sub("", x).count("\\"):
                        raise Malformed(0, "unknown escape")
                    new[-1].append(tok["STR" if k == "s" else "CHAR"])
                first = False
            return pos

        end = through(text, pos, frozenset())
        return end, tuple(self.places.settled(f, "".join(n)) if n else f for f, n in zip(stack, new))


class _Parting(Exception):
    """A macro's definition differs among the settings."""

    def __init__(self, sets: list[int]):
        super().__init__()
        self.sets = sets


def _texts(parts: list[Part]) -> Iterator[str]:
    for p in parts:
        if not p.branches:
            yield p.text
        for b in p.branches or ():
            if b[0] != "directive":
                yield from _texts(b[2])


def check(text: str, g: Grammar) -> tuple[bool, int, str]:
    """Whether some setting of the macros tested gives a valid file; else the line of the failure with none set and why."""
    parts = structure(text)
    names = tested(parts)
    why: tuple[int, str] = (-1, "grammar")
    try:
        if g.accepts(symbols(preprocessed(parts, {}), g), "file"):
            return True, 0, ""
    except Malformed as e:
        why = e.at, e.why
    if names and _Search(parts, names, g).valid():
        return True, 0, ""
    return False, *why
