"""A packrat machine for parsing-expression grammars over token symbols.

A lexer turns source into symbols, one character a token; every bracketed group becomes one symbol that stands for its
contents. Equal contents get the same symbol, so what was found about a group, under a rule and a context, holds for
every later occurrence, in any file: the packrat table is kept by content, not only by position.

Notation: 'text' a token; NAME other tokens; P<rule> a group in round brackets whose whole contents match the rule
(B square, C curly, I indented, F replacement field, T template); e? e* e+ &e !e; sequence; a / b ordered choice;
~ no line end here; $ a line end or the end here; @XY(e) e in exactly the context XY; +X(e) e with X added;
?X only in context X; [UNITS rule] as many of the rule as follow, each looked up by its text first.
"""

from __future__ import annotations

import re

#: Symbols of groups: curly and indented ones end a unit, so they have a range of their own.
CURLY, OTHER, LAST = 0x10000, 0x70000, 0x10FFFF
#: Contents known at once; beyond that the tables start anew between two files.
MOST_GROUPS = 250_000
#: No token.
END = "\x00"
NEWLINE = "\x01"

_LEX = re.compile(r"\s*(?:(<-)|'([^']+)'|([PBCIFT])<|(\[UNITS )|@(\w*)\(|\+(\w)\(|\?([A-Z])(?!\w)|([A-Za-z_]\w*)|(.))")


class Grammar:
    """A grammar's rules, ready to match. Rules are named; `tokens` gives each token text its symbol."""

    def __init__(self, text: str, kinds: str, sets: dict[str, str] | None = None, units: str = "", goes_on: str = "", skip_lines: bool = False):
        self.skip = skip_lines
        self.tokens: dict[str, str] = {}
        self._next = 0x20
        for k in kinds.split():
            self.tokens[k] = NEWLINE if k == "NL" else self._symbol()
        self.rules: dict[str, object] = {}
        parsed = self._read(text)
        self.sets = {k: {self.tokens[x] for x in v.split() if x in self.tokens} for k, v in (sets or {}).items()}
        self.unit_end = re.compile("[%s%s-%s]" % (re.escape("".join(self._token(x) for x in units.split())), chr(CURLY), chr(OTHER - 1)))
        self.goes_on = {self._token(x) for x in goes_on.split()}
        self.contexts: list[str] = []
        self.reset()
        self.far, self.diagnose = 0, False
        self._first: dict[str, set | None] = {}
        self.source = parsed
        self.number = {r: i for i, r in enumerate(parsed)}
        self.fn: list = [None] * len(parsed)
        self.asked: dict[str, list[tuple[int, tuple]]] = {}  # by kind of group: the rules that its contents are asked for
        for r, e in parsed.items():
            self.fn[self.number[r]] = self._memoised(self.number[r], self._build(e))

    def reset(self) -> None:
        self.group: dict[tuple[str, str], str] = {}
        self.kind: dict[str, str] = {}
        self.content: dict[str, str] = {}
        self.known: dict[tuple, bool] = {}
        self.unit: dict[tuple, bool] = {}
        self.curly, self.other = CURLY, OTHER
        self.memo: dict = {}

    def _symbol(self) -> str:
        self._next += 1
        return chr(self._next)

    def _token(self, text: str) -> str:
        if text not in self.tokens:
            self.tokens[text] = self._symbol()
        return self.tokens[text]

    def intern(self, kind: str, content: str) -> str:
        """The symbol of a group with these contents."""
        got = self.group.get((kind, content))
        if got is None:
            if kind in "CI":
                got, self.curly = chr(self.curly), self.curly + 1
            else:
                got, self.other = chr(self.other), self.other + 1
            self.group[kind, content] = got
            self.kind[got], self.content[got] = kind, content
        return got

    def full(self) -> bool:
        return len(self.group) + len(self.unit) > MOST_GROUPS

    # reading the notation

    def _read(self, text: str) -> dict[str, tuple]:
        words = [m.groups() for m in _LEX.finditer(text) if m.group().strip()]
        at, out = 0, {}

        def choice() -> tuple:
            nonlocal at
            alts = [sequence()]
            while at < len(words) and words[at][8] == "/":
                at += 1
                alts.append(sequence())
            return alts[0] if len(alts) == 1 else ("alt", alts)

        def sequence() -> tuple:
            nonlocal at
            parts = []
            while at < len(words):
                w = words[at]
                if w[8] in ("/", ")", ">", "]") or (w[7] and at + 1 < len(words) and words[at + 1][0]):
                    break
                parts.append(prefixed())
            return parts[0] if len(parts) == 1 else ("seq", parts)

        def prefixed() -> tuple:
            nonlocal at
            w = words[at]
            if w[8] in ("&", "!"):
                at += 1
                return ("and" if w[8] == "&" else "not", prefixed())
            e = primary()
            while at < len(words) and words[at][8] in ("?", "*", "+"):
                e = ({"?": "opt", "*": "star", "+": "plus"}[words[at][8]], e)
                at += 1
            return e

        def closed(close: str) -> tuple:
            nonlocal at
            e = choice()
            assert words[at][8] == close, (words[at - 3 : at + 3], close)
            at += 1
            return e

        def primary() -> tuple:
            nonlocal at
            w = words[at]
            at += 1
            if w[1]:
                return "token", self._token(w[1])
            if w[2]:
                return "group", w[2], closed(">")
            if w[3]:
                return "units", closed("]")
            if w[4] is not None:
                return "context", w[4], False, closed(")")
            if w[5]:
                return "context", w[5], True, closed(")")
            if w[6]:
                return "only", w[6]
            if w[7]:
                return "name", w[7]
            if w[8] == "(":
                return closed(")")
            if w[8] == "~":
                return ("near",)
            if w[8] == "$":
                return ("ended",)
            raise ValueError(f"unexpected {w} after {words[at - 4 : at]}")

        while at < len(words):
            name = words[at][7]
            assert name and words[at + 1][0], words[at : at + 3]
            at += 2
            out[name] = choice()
        return out

    # what an expression may start with: token symbols and group kinds; None: anything, or nothing at all

    def _starts(self, e: tuple) -> set | None:
        k = e[0]
        if k == "token":
            return {e[1]}
        if k == "group":
            return {e[1]}
        if k == "name":
            r = e[1]
            if r not in self.source:
                return self.sets[r] if r in self.sets else {self.tokens[r]}
            if r not in self._first:
                self._first[r] = None
                self._first[r] = self._starts(self.source[r])
            return self._first[r]
        if k == "alt":
            all_ = [self._starts(x) for x in e[1]]
            return None if any(x is None for x in all_) else set().union(*all_)
        if k == "seq":
            out: set = set()
            for x in e[1]:
                if x[0] in ("not", "only"):
                    continue
                if x[0] in ("opt", "star"):
                    s = self._starts(x[1])
                    if s is None:
                        return None
                    out |= s
                    continue
                s = self._starts(x)
                return None if s is None else out | s
            return None
        if k == "plus":
            return self._starts(e[1])
        if k == "context":
            return self._starts(e[3])
        return None

    # building matchers: f(s, i, ctx) gives the end or -1

    def _memoised(self, n: int, f):
        def call(s, i, ctx):
            key = (n, i, ctx)
            memo = self.memo
            got = memo.get(key)
            if got is None:
                got = memo[key] = f(s, i, ctx)
            return got

        return call

    def _ask(self, symbol: str, n: int, ctx: str) -> bool:
        """Whether a group's contents match a rule."""
        key = (symbol, n, ctx)
        got = self.known.get(key)
        if got is None:
            outer, far, was = self.memo, self.far, self.inside
            self.memo, self.far, self.inside = {}, 0, False
            s = self.content[symbol]
            i = self.fn[n](s + END, 0, ctx)
            if self.skip:
                while 0 <= i < len(s) and s[i] == NEWLINE:
                    i += 1
            got = self.known[key] = i == len(s)
            if self.diagnose and not got:
                self.failed[key] = max(self.far, i)
            self.memo, self.far, self.inside = outer, far, was
        return got

    def _build(self, e: tuple):
        k, skip = e[0], self.skip
        if k == "name" and e[1] in self.source:
            n = self.number[e[1]]
            fn = self.fn
            return lambda s, i, ctx: fn[n](s, i, ctx)
        if k == "name" and e[1] in self.sets or k in ("token", "name"):
            want = {e[1]} if k == "token" else self.sets[e[1]] if e[1] in self.sets else {self.tokens[e[1]]}

            def token(s, i, ctx):
                c = s[i]
                if skip:
                    while c == NEWLINE:
                        i += 1
                        c = s[i]
                if c in want:
                    return i + 1
                if i > self.far:
                    self.far = i
                return -1

            return token
        if k == "group":
            kind, inner = e[1], e[2]
            name = f"<{kind}{len(self.fn)}>"
            n = len(self.fn)
            self.number[name] = n
            self.asked.setdefault(kind, []).append((n, inner))
            self.fn.append(None)
            self.fn[n] = self._build(inner)
            kinds = self

            def group(s, i, ctx):
                c = s[i]
                if skip:
                    while c == NEWLINE:
                        i += 1
                        c = s[i]
                if kinds.kind.get(c) == kind and kinds._ask(c, n, ctx):
                    return i + 1
                if i > kinds.far:
                    kinds.far = i
                return -1

            return group
        if k == "seq":
            fs = [self._build(x) for x in e[1]]

            def seq(s, i, ctx):
                for f in fs:
                    i = f(s, i, ctx)
                    if i < 0:
                        return -1
                return i

            return seq
        if k == "alt":
            fs = [(self._build(x), self._starts(x)) for x in e[1]]
            table: dict[str, list] = {}

            def alt(s, i, ctx):
                c, j = s[i], i
                if skip:
                    while c == NEWLINE:
                        j += 1
                        c = s[j]
                h = self.kind.get(c, c)
                some = table.get(h)
                if some is None:
                    some = table[h] = [f for f, first in fs if first is None or h in first]
                for f in some:
                    got = f(s, i, ctx)
                    if got >= 0:
                        return got
                if j > self.far:
                    self.far = j
                return -1

            return alt
        if k in ("opt", "star", "plus"):
            f, least, many = self._build(e[1]), k == "plus", k != "opt"

            def repeat(s, i, ctx):
                got = f(s, i, ctx)
                if got < 0:
                    return -1 if least else i
                while many and got > i:
                    i = got
                    got = f(s, i, ctx)
                    if got < 0:
                        return i
                return got

            return repeat
        if k in ("and", "not"):
            f, want = self._build(e[1]), k == "and"

            def look(s, i, ctx):
                far = self.far
                ok = f(s, i, ctx) >= 0
                self.far = far
                return i if ok == want else -1

            return look
        if k == "near":
            return lambda s, i, ctx: -1 if s[i] == NEWLINE else i
        if k == "ended":

            def ended(s, i, ctx):
                c = s[i]
                return i if c == NEWLINE or c == END and i == len(s) - 1 and not self.inside else -1

            return ended
        if k == "context":
            flags, add, f = e[1], e[2], self._build(e[3])
            if add:
                return lambda s, i, ctx: f(s, i, ctx if flags in ctx else "".join(sorted(ctx + flags)))
            flags = "".join(sorted(flags))
            return lambda s, i, ctx: f(s, i, flags)
        if k == "only":
            return lambda s, i, ctx: i if e[1] in ctx else -1
        if k == "units":
            f, item = self._build(e[1]), e[1]

            def units(s, i, ctx):
                n = len(s) - 1
                while i < n and not self.diagnose:
                    end, done = i, False
                    for _ in range(4):
                        m = self.unit_end.search(s, end)
                        if not m:
                            break
                        end = m.end()
                        j = end
                        while s[j] == NEWLINE and skip:
                            j += 1
                        if s[j] in self.goes_on or self.kind.get(s[j]) == "I":
                            continue
                        text = s[i:end]
                        ok = self.unit.get((item, text, ctx))
                        if ok is None:
                            outer, self.memo = self.memo, {}
                            was, self.inside = self.inside, True
                            ok = f(text + END, 0, ctx) == len(text)
                            self.memo, self.inside = outer, was
                            self.unit[item, text, ctx] = ok
                        if ok:
                            i, done = end, True
                            break
                    if not done:
                        break
                while i < n:
                    got = f(s, i, ctx)
                    if got <= i:
                        break
                    i = got
                return i

            return units
        raise ValueError(e)

    inside = False
    failed: dict = {}

    def accepts(self, symbols: str, start: str, ctx: str = "") -> bool:
        """Whether the rule consumes all symbols."""
        self.memo, self.far, self.inside = {}, 0, False
        i = self.fn[self.number[start]](symbols + END, 0, ctx)
        if self.skip:
            while 0 <= i < len(symbols) and symbols[i] == NEWLINE:
                i += 1
        self.reached = max(self.far, i)
        return i == len(symbols)
