"""Parsing C under all settings of its tested macros at once.

The places reached in the grammar are kept with the set of settings that lead there, as a binary decision diagram. Two
settings that lead to the same place are one from there on, so the cost grows with the places that differ, not with
the number of settings. Nothing is left out; only sources whose settings all lead elsewhere remain costly.
"""

from __future__ import annotations

from marlstone.llm.grammars.peg import END, Grammar


class Sets:
    """Sets of settings, as ids of reduced ordered decision diagrams: 0 is none, 1 is all."""

    def __init__(self):
        self.node: list[tuple[int, int, int]] = [(1 << 60, 0, 0), (1 << 60, 1, 1)]
        self.id: dict[tuple[int, int, int], int] = {}
        self.done: dict[tuple[int, int], int] = {}

    def _make(self, v: int, lo: int, hi: int) -> int:
        if lo == hi:
            return lo
        got = self.id.get((v, lo, hi))
        if got is None:
            got = self.id[v, lo, hi] = len(self.node)
            self.node.append((v, lo, hi))
        return got

    def where(self, v: int, value: bool) -> int:
        """The settings in which the v-th macro has the value."""
        return self._make(v, int(not value), int(value))

    def less(self, a: int, b: int) -> int:
        """Those of a that are not in b."""
        if a == 0 or b == 1 or a == b:
            return 0
        if b == 0:
            return a
        got = self.done.get((a, b))
        if got is None:
            (v, lo, hi), (w, lo2, hi2) = self.node[a], self.node[b]
            x = min(v, w)
            a0, a1 = (lo, hi) if v == x else (a, a)
            b0, b1 = (lo2, hi2) if w == x else (b, b)
            got = self.done[a, b] = self._make(x, self.less(a0, b0), self.less(a1, b1))
        return got

    def both(self, a: int, b: int) -> int:
        return self.less(a, self.less(1, b))

    def either(self, a: int, b: int) -> int:
        return self.less(1, self.less(self.less(1, a), b))


class _Spied(str):
    """Remembers the furthest place that was looked at."""

    far = -1

    def __getitem__(self, i):
        self.far = len(self) if isinstance(i, slice) else max(self.far, i)
        return str.__getitem__(self, i)


class Dead(Exception):
    """Whatever follows, the source is not valid."""


#: An open curly group: what is still undecided of it as a block (and whether its units are over), as fields, as
#: initialisers, as enumerators (each None once it can't be that) and whether it may be anything.
OPEN_CURLY = ("C", (False, ""), "", (False, ""), (False, ""), True)
#: The file itself: whether its units are over, and what is undecided.
FILE = ("file", (False, ""))


class Places:
    """Places in the grammar of C: open groups, each with what of it is not decided yet."""

    def __init__(self, g: Grammar):
        self.g = g
        self.comma, self.name = g.tokens[","], g.tokens["NAME"]
        self.seen: dict[tuple[str, str], tuple[int, int]] = {}
        self.alone: dict[tuple[str, str], bool] = {}

    def _run(self, rule: str, s: str) -> tuple[int, int]:
        """Where the rule ends at the start of s, and the furthest place it looked at: s may go on beyond."""
        got = self.seen.get((rule, s))
        if got is None:
            g, x = self.g, _Spied(s + END)
            outer, g.memo = g.memo, {}
            far, was, g.inside = g.far, g.inside, False
            end = g.fn[g.number[rule]](x, 0, "")
            g.memo, g.far, g.inside = outer, far, was
            got = self.seen[rule, s] = end, x.far
        return got

    def _whole(self, rule: str, s: str) -> bool:
        return self._run(rule, s)[0] == len(s)

    def _repeated(self, rule: str, s: str, units: bool, over: bool) -> tuple[bool, str] | None:
        """Drops the repetitions that are decided; None where the next one can't be."""
        g = self.g
        while s:
            if units and not over:
                end, taken = 0, False
                for _ in range(4):
                    m = g.unit_end.search(s, end)
                    if not m or m.end() >= len(s):
                        break
                    end = m.end()
                    if s[end] in g.goes_on:
                        continue
                    if self._whole(rule, s[:end]):
                        s, taken = s[end:], True
                        break
                if taken:
                    continue
            end, far = self._run(rule, s)
            if far < len(s):
                if end <= 0:
                    return None
                s, over = s[end:], units
                continue
            if rule == "item":  # terms of a comma expression are alike, unless it may be a declaration
                end, far = self._run("assign", s)
                if 0 < end < len(s) and far < len(s) and s[end] == self.comma:
                    no, far = self._run("declaration", s)
                    if no < 0 and far < len(s):
                        rest, n = s[end + 1 :], 1
                        end, far = self._run("assign", rest)
                        while 0 < end < len(rest) and far < len(rest) and rest[end] == self.comma:
                            rest, n = rest[end + 1 :], n + 1
                            end, far = self._run("assign", rest)
                        s = self.name + self.comma + rest
            break
        return over, s

    def _listed(self, rule: str, s: str, begun: bool) -> tuple[bool, str] | None:
        """Drops the members of a list that are decided, with the commas after them."""
        while s:
            end, far = self._run(rule, s)
            if far >= len(s) or end == len(s):
                break
            if end <= 0 or s[end] != self.comma:
                return None
            s, begun = s[end + 1 :], True
        return begun, s

    def _any(self, s: str) -> bool:
        return all(self._whole("anything", x) for x in s)

    def settled(self, frame: tuple, new: str) -> tuple:
        """The open group with more contents, less all that is decided."""
        kind = frame[0]
        if kind == "file":
            got = self._repeated("ext", frame[1][1] + new, True, frame[1][0])
            if got is None:
                raise Dead
            return kind, got
        if kind != "C":
            return kind, frame[1] + new
        _, block, fields, inits, names, any_ = frame
        block = block and self._repeated("item", block[1] + new, True, block[0])
        got = None if fields is None else self._repeated("field", fields + new, False, False)
        inits = inits and self._listed("designated", inits[1] + new, inits[0])
        names = names and self._listed("enumerator", names[1] + new, names[0])
        return kind, block, got and got[1], inits, names, any_ and self._any(new)

    def _rest(self, rule: str, s: str) -> bool:
        while s:
            end = self._run(rule, s)[0]
            if end <= 0:
                return False
            s = s[end:]
        return True

    def closed(self, frame: tuple) -> str:
        """The symbol of a group whose contents are over: groups that no rule tells apart share one."""
        g, kind = self.g, frame[0]
        if kind == "C":
            _, block, fields, inits, names, any_ = frame
            answers = {
                ("name", "block"): block is not None and (self._rest("item", block[1]) if block[0] else self._whole("block", block[1])),
                ("star", ("name", "field")): fields is not None and self._rest("field", fields),
                ("opt", ("name", "inits")): inits is not None and (not inits[1] or self._whole("inits", inits[1])),
                ("name", "enumerators"): names is not None and (names[0] if not names[1] else self._whole("enumerators", names[1])),
                ("star", ("name", "anything")): any_,
            }
            told = tuple(answers[inner] for _, inner in g.asked[kind])
        else:
            symbol = g.intern(kind, frame[1])
            told = tuple(g._ask(symbol, n, "") for n, _ in g.asked[kind])
        symbol = g.intern(kind, END + "".join("01"[x] for x in told))
        for (n, _), x in zip(g.asked[kind], told):
            g.known[symbol, n, ""] = x
        return symbol

    def accepted(self, frames: tuple) -> bool:
        """Whether the source may end here."""
        if len(frames) > 1:
            return False
        over, s = frames[0][1]
        return self._rest("ext", s) if over else self._whole("file", s)
