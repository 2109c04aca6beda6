"""Generalized suffix automaton over sequences of words, maximal exact matches and their chains."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """All substrings of several sequences; each state knows where, in which sequence, its substrings end."""

    def __init__(self, sequences: Sequence[Sequence[Hashable]]):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(sequences):
            last = 0
            for i, x in enumerate(seq):
                last = self._extend(last, x)
                self.ends[last].append((k, i + 1))
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]].extend(self.ends[v])

    def _clone(self, p: int, x: Hashable, q: int) -> int:
        c = len(self.len)
        self.len.append(self.len[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.ends.append([])
        self.link[q] = c
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, x: Hashable) -> int:
        q = self.next[last].get(x)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, x, q)
        cur = len(self.len)
        self.len.append(self.len[last] + 1)
        self.next.append({})
        self.link.append(0)
        self.ends.append([])
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, x, q)
        return cur

    def statistics(self, text: Sequence[Hashable]) -> list[tuple[int, int]]:
        """For each position the state and the length of the longest match that ends there."""
        out, v, n = [], 0, 0
        nexts, link, lens = self.next, self.link, self.len
        for x in text:
            to = nexts[v].get(x)
            while to is None and v:
                v = link[v]
                n = lens[v]
                to = nexts[v].get(x)
            if to is None:
                v = n = 0
            else:
                v, n = to, n + 1
            out.append((v, n))
        return out

    def matches(self, stats: Sequence[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
        """Maximal exact matches of at least that length: (start, end, state)."""
        out = []
        for i, (v, n) in enumerate(stats):
            if n >= least and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                out.append((i + 1 - n, i + 1, v))
        return out


def best_chain(anchors: list[tuple[int, int, int]], reach: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The collinear chain of anchors (text start, template start, length) that covers most of the template.

    Anchors may overlap; the overlap counts once. Two that follow each other start at most `reach` apart in the text,
    so a long text costs time in proportion. Returns the covered length and the chain.
    """
    anchors = sorted(set(anchors))
    score, back = [a[2] for a in anchors], [-1] * len(anchors)
    for i, (s, t, n) in enumerate(anchors):
        for j in range(i - 1, -1, -1):
            s2, t2, n2 = anchors[j]
            if s - s2 > reach:
                break
            if s2 < s and t2 < t and s2 + n2 < s + n and t2 + n2 < t + n:
                gain = n - max(0, s2 + n2 - s, t2 + n2 - t)
                if gain > 0 and score[j] + gain > score[i]:
                    score[i], back[i] = score[j] + gain, j
    if not anchors:
        return 0, []
    i = max(range(len(anchors)), key=score.__getitem__)
    covered, chain = score[i], []
    while i >= 0:
        chain.append(anchors[i])
        i = back[i]
    return covered, chain[::-1]
