"""The licence of each code file and repository (problem 1).

A generalized suffix automaton over all licence texts and names gives the maximal exact matches of a text; chains of
them that cover nearly a whole body locate the licences a text embeds, and partial coverage is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.automaton import SuffixAutomaton, best_chain
from marlstone.tables import spread, written

#: A body counts as given if at least this part of its words is covered.
COVERAGE = 0.93
#: Matches shorter than this many words don't count towards a body.
LEAST_MATCH = 3
#: So many words of licence bodies in a comment state terms, even where no known body is covered.
TERMS_WORDS = 14
UNKNOWN = "unknown"
SALTS = 16

LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying)([.-](txt|md|rst))?$"
PACKAGE_FILE = r"^(package\.json|pyproject\.toml|setup\.cfg)$"

_WORD = re.compile(r"[a-z0-9]+(?:[.'’][a-z0-9]+)*")


#: Words after which a licence's name declares the file's terms; the article may follow.
DECLARES = (
    ("spdx", "licence", "identifier"), ("licenced", "under"), ("licenced", "as"), ("distributed", "under"), ("released", "under"), ("released", "as"),
    ("available", "under"), ("used", "under"), ("copied", "under"), ("terms", "of"), ("conditions", "of"), ("governed", "by"), ("covered", "by"), ("subject", "to"), ("provided", "under"), ("published", "under"),
)
#: Of these, the ones that state unknown terms where no known name follows.
STATES = (("spdx", "licence", "identifier"), ("licenced", "under"), ("governed", "by"))


#: Words that speak of what may be done with a file; a sentence with one can declare its terms.
DECLARING = set(
    "licence licences licenced licensing use used uses using distribute distributed distribution redistribute redistributed redistribution release released publish published copy copied copying provide provided available offer offered "
    "share shared permit permitted permission govern governed cover covered subject terms conditions provisions grant granted choose chose elect elected applies apply dedicated modify modified made rights spdx".split()
)
#: What leads from there to a licence's name, and the words one of which then comes right before; none: any.
LINKS = {
    "under": (), "per": (), "choose": (), "chose": (), "elect": (), "by": ("governed", "covered", "permitted", "granted", "licenced", "available"), "to": ("according", "subject", "pursuant", "dedicated"), "with": ("accordance",),
    "as": ("released", "licenced", "published", "distributed", "provided", "available", "shared", "offered"), "of": ("terms", "conditions", "provisions", "rules"), "is": ("licence", "licences"), "are": ("terms", "conditions"),
}
#: Words that make a sentence speak of other files, or of what does not hold.
CONTRAST = set("not no never unlike without except neither nor instead rather formerly previously old older other others than compatible incompatible similar such".split())
_ARTICLES = ("the", "a", "an", "either", "both")
_SENTENCE_END = re.compile(r"[.;!?](?:\s|\Z)|\n\W*\n")


class Templates:
    """The known licences, prepared once for each Python worker."""

    def __init__(self, rows: tuple[tuple[str, str, tuple[str, ...], str, str], ...]):
        self.ids = [r[0] for r in rows]
        sequences, self.body, names = [], {}, []
        for k, (licence_id, title, others, notice, body) in enumerate(rows):
            self.body[len(sequences)] = k
            sequences.append(self.raw_words(body))
            for name in (licence_id, title, *others):
                names.append((len(sequences), k))
                sequences.append(self.raw_words(name))
            sequences.append(self.raw_words(notice))
        self.sequences = sequences
        self.vocabulary = {w for s in (*sequences, *DECLARES) for w in s}
        self.deleted: dict[str, set[str]] = {}
        for w in self.vocabulary:
            if len(w) >= 4 and w.isalpha():
                for i in range(len(w)):
                    self.deleted.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        self.fixed: dict[str, str] = {}
        self.automaton = SuffixAutomaton(sequences)
        whole = {(s, len(sequences[s])): k for s, k in names}
        self.names_at: list[list[tuple[int, int]]] = [[] for _ in self.automaton.len]
        for v, ends in enumerate(self.automaton.ends):
            low = self.automaton.len[self.automaton.link[v]] if v else 0
            found = {(e, whole[s, e]) for s, e in ends if (s, e) in whole and low < e <= self.automaton.len[v]}
            self.names_at[v] = sorted(found, reverse=True)

    @staticmethod
    def raw_words(text: str) -> list[str]:
        return _WORD.findall(text.lower().replace("license", "licence").replace("’", "'"))

    def fix(self, w: str) -> str:
        """A word with one slip becomes the only known word it can be."""
        if w in self.vocabulary or len(w) < 3 or not w.isalpha():
            return w
        got = self.fixed.get(w)
        if got is None:
            near = set(self.deleted.get(w, ()))
            for i in range(len(w)):
                x = w[:i] + w[i + 1 :]
                if len(w) > 4:
                    if x in self.vocabulary:
                        near.add(x)
                    near |= {y for y in self.deleted.get(x, ()) if len(y) == len(w) and sum(a != b for a, b in zip(w, y)) <= 2}
            got = next(iter(near)) if len(near) == 1 else w
            if len(self.fixed) < 200_000:
                self.fixed[w] = got
        return got

    def words(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        text = text.lower().replace("license", "licence").replace("’", "'")
        spans = [m.span() for m in _WORD.finditer(text)]
        return [self.fix(text[a:b]) for a, b in spans], spans

    def bodies(self, stats: list[tuple[int, int]]) -> tuple[list[int], int]:
        """Licences whose bodies the text gives, and how many words of bodies it has besides."""
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        seen: set[int] = set()
        for s, e, v in self.automaton.matches(stats, LEAST_MATCH):
            for k, end in self.automaton.ends[v]:
                if k in self.body:
                    anchors.setdefault(k, []).append((s, end - (e - s), e - s))
                    if e - s >= 6:
                        seen.update(range(s, e))
        out: list[int] = []
        used: set[int] = set()
        while anchors:
            best = None
            for k in list(anchors):
                covered, chain = best_chain(anchors[k], 2 * len(self.sequences[k]))
                if covered < COVERAGE * len(self.sequences[k]):
                    del anchors[k]
                elif best is None or covered > best[0]:
                    best = covered, k, chain
            if best is None:
                break
            out.append(self.body[best[1]])
            for s, _, n in best[2]:
                used.update(range(s, s + n))
            anchors = {k: [a for a in v if not used.intersection(range(a[0], a[0] + a[2]))] for k, v in anchors.items() if k != best[1]}
        return sorted(set(out)), len(seen - used)

    def names(self, stats: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """Known names in a text: start to (end, licence); of names that start alike the longest."""
        out: dict[int, tuple[int, int]] = {}
        for i, (v, n) in enumerate(stats):
            while v > 0:
                for size, k in self.names_at[v]:
                    if size <= n and out.get(i + 1 - size, (0,))[0] < i + 1:
                        out[i + 1 - size] = i + 1, k
                v = self.automaton.link[v]
                n = self.automaton.len[v] if v > 0 else 0
        return out


@lru_cache(maxsize=4)
def templates(rows: tuple) -> Templates:
    return Templates(rows)


_SKIP = {"the", "a", "an", "either", "both", "terms", "of", "conditions", "version"}
_POINTER = {"file", "files", "copying", "see", "accompanying", "found", "root", "directory"}


def _context(words: list[str], spans: list[tuple[int, int]], text: str, at: int) -> tuple[str, ...] | None:
    """The declaring words right before a position, if any."""
    i = at
    while i and words[i - 1] in _ARTICLES and at - i < 3:
        i -= 1
    for c in DECLARES:
        if tuple(words[max(0, i - len(c)) : i]) == c:
            return c
    if i and words[i - 1] == "licence" and i < len(words):
        a, b = spans[i - 1]
        between = text[b : spans[i][0]]
        if ":" in between or "=" in between or text[max(0, a - 1) : a] in ("@", "\\"):
            return ("licence",)
    return None


def _declared(words: list[str], spans: list[tuple[int, int]], text: str, at: int) -> bool:
    """Whether the sentence around a licence's name that begins here declares it: it speaks of what may be done, leads to
    the name by a link, and neither denies it nor speaks of others."""
    i = at
    while i and words[i - 1] in _ARTICLES and at - i < 3:
        i -= 1
    if not i:
        return False
    start = i
    while start and not (start < len(words) and _SENTENCE_END.search(text[spans[start - 1][1] : spans[start][0]])):
        start -= 1
    if start == i:
        return False
    before = words[start:i]
    if CONTRAST.intersection(before):
        return False
    gap = text[spans[i - 1][1] : spans[i][0]]
    if (":" in gap or "=" in gap) and "licence" in before[-3:]:
        return True
    link = before[-1]
    if link not in LINKS or not DECLARING.intersection(before):
        return False
    near = before[:-1] if link in ("is", "are") else before[-3:-1]
    return not LINKS[link] or bool(set(near).intersection(LINKS[link]))


def statements(text: str, t: Templates) -> list[tuple[frozenset[str], bool]]:
    """What a comment declares: sets of ids, and whether each set is a choice; {'unknown'} for terms not known.

    A known name counts where its own sentence declares it, or right after a fixed declaring phrase; a phrase that states
    terms without a known name states unknown ones.
    """
    words, spans = t.words(text)
    if not words:
        return []
    stats = t.automaton.statistics(words)
    out: list[tuple[frozenset[str], bool]] = []
    bodies, rest = t.bodies(stats)
    out += [(frozenset([t.ids[k]]), False) for k in bodies]
    names, low, i = t.names(stats), text.lower().replace("license", "licence"), 0
    while i < len(words):
        got, context = names.get(i), _context(words, spans, low, i)
        if got and (context == ("licence",) or _declared(words, spans, low, i) or context and not _denied(words, spans, low, i)):
            ids, choice, joined = [t.ids[got[1]]], False, False
            i = got[0]
            while i < len(words):
                j = i
                link = words[j] if words[j] in ("or", "and") else None
                if not link:
                    break
                j += 1
                while j < len(words) and words[j] in ("under", "the", "terms", "of") and j - i < 6:
                    j += 1
                more = names.get(j)
                if not more:
                    break
                ids.append(t.ids[more[1]])
                choice, joined, i = choice or link == "or", joined or link == "and", more[0]
            out += [(frozenset(ids), True)] if choice and not joined else [(frozenset([x]), False) for x in ids]
            continue
        if context and not got:
            after = [w for w in words[i : i + 8]]
            named = context in STATES or context == ("licence",)
            if context == ("terms", "of"):
                named = tuple(words[max(0, i - 6) : i])[-6:-2] in {("be", "used", "under", "the")} or tuple(words[max(0, i - 5) : i - 1])[-5:] == ("be", "used", "under", "the", "terms")
            if named and after and words[i] not in _SKIP and words[i] not in ("or", "and") and not (_POINTER & set(after[:5])) and (context[0] == "spdx" or len(after) > 1):
                out.append((frozenset([UNKNOWN]), False))
        i += 1
    if not out and rest >= TERMS_WORDS:
        out.append((frozenset([UNKNOWN]), False))
    return out


def _denied(words: list[str], spans: list[tuple[int, int]], text: str, at: int) -> bool:
    """Whether the sentence before a name denies or speaks of others."""
    start = at
    while start and not _SENTENCE_END.search(text[spans[start - 1][1] : spans[start][0]] if start < len(words) else ""):
        start -= 1
    return bool(CONTRAST.intersection(words[start:at]))


def leading_comment(blob: bytes, language: str) -> str:
    """The comments before the first code; '#!' lines and byte order marks are left out."""
    i, n, parts = 3 if blob[:3] == b"\xef\xbb\xbf" else 0, len(blob), []
    eol = re.compile(rb"\r\n|\r|\n")

    def line_end(k: int) -> int:
        m = eol.search(blob, k)
        return m.start() if m else n

    if blob[i : i + 2] == b"#!":
        i = line_end(i)
    while i < n:
        c = blob[i : i + 1]
        if c in b" \t\r\n\f\v":
            i += 1
        elif language == "python" and c == b"#" or language != "python" and blob[i : i + 2] == b"//":
            e = line_end(i)
            parts.append(blob[i:e])
            i = e
        elif language != "python" and blob[i : i + 2] == b"/*":
            e = blob.find(b"*/", i + 2)
            e = n if e < 0 else e + 2
            parts.append(blob[i:e])
            i = e
        else:
            break
    return b"\n".join(parts).decode("utf-8", "replace")


def package_field(name: str, text: str) -> str | None:
    """The licence field of a package file, or None."""
    if name == "package.json":
        import json

        try:
            x = json.loads(text)
        except ValueError:
            m = re.search(r'"licen[cs]e"\s*:\s*"([^"]*)"', text)
            return m[1] if m else None
        x = x.get("license", x.get("licence")) if isinstance(x, dict) else None
        if isinstance(x, dict):
            x = x.get("type")
        return x if isinstance(x, str) else None
    m = re.search(r"(?m)^\s*licen[cs]e\s*=\s*(.+?)\s*$", text)
    if not m:
        return None
    q = re.search(r"""(?:text|file)\s*=\s*["']([^"']*)["']""", m[1])
    return q[1] if q else m[1].strip("\"'")


def stated(kind: str, name: str, blob: bytes, language: str | None, t: Templates) -> tuple[list[str], bool]:
    """The ids a record states ('unknown' for other terms) and whether they are a choice."""
    if kind == "file":
        groups = list(dict.fromkeys(statements(leading_comment(blob, language), t)))
        known = [g for g in groups if UNKNOWN not in g[0]]
        groups = known or groups
        if len(groups) == 1:
            return sorted(groups[0][0]), groups[0][1]
        return sorted(set().union(*(g[0] for g in groups))), False
    text = blob.decode("utf-8", "replace")
    if kind == "licence":
        words, _ = t.words(text)
        got, _ = t.bodies(t.automaton.statistics(words))
        return [t.ids[k] for k in got] or [UNKNOWN], False
    field = package_field(name, text)
    if not field or not field.strip():
        return [], False
    words, _ = t.words(field)
    names, i, ids = t.names(t.automaton.statistics(words)), 0, []
    while i < len(words):
        if i in names:
            ids.append(t.ids[names[i][1]])
            i = names[i][0]
        elif words[i] in ("or", "and", "the"):
            i += 1
        else:
            return [UNKNOWN], False
    return sorted(set(ids)), "or" in words and "and" not in words


def _set_text(ids: Column, word: str) -> Column:
    return F.array_join(F.array_sort(ids), f" {word} ")


#: Folders above a repository's own in a resolved path.
ABOVE = 2


def repository_of(file_key: Column, above: int = ABOVE) -> Column:
    """The repository's name: the part of a resolved path after so many folders; empty outside of any repository."""
    return F.regexp_extract(file_key, rf"^(?:/[^/]+){{{above}}}/([^/]+)/", 1)


def licence_findings(files: DataFrame, licences: DataFrame, above: int = ABOVE) -> DataFrame:
    """(scope, item, licence, flag) of every file with a language and of every repository.

    Reads file_key, language and source_blob; repositories are named by file_key, `above` folders down, so a null repo
    does no harm. A null
    source_blob states nothing; rows with a null file_key or outside any repository are left out. Rows delivered twice
    give one row. Licences: the known ones, a small table that is held in memory.
    """
    known = tuple((r["licence_id"], r["title"] or r["licence_id"], tuple(x for x in r["other_names"] or () if x), r["notice"] or "", r["body"] or "") for r in licences.select("licence_id", "title", "other_names", "notice", "body").collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = templates(known)
        for b in batches:
            keys, kinds, blobs, languages = (b.column(i).to_pylist() for i in range(4))
            ids, choices = [], []
            for key, kind, blob, language in zip(keys, kinds, blobs, languages):
                got, choice = stated(kind, key.rpartition("/")[2], blob or b"", language, t)
                ids.append(got)
                choices.append(choice)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.string())), pa.array(choices, pa.bool_())], names=["file_key", "kind", "ids", "choice"])

    name = F.regexp_extract("file_key", r"([^/]*)$", 1)
    kind = F.when(F.col("language").isNotNull(), "file").when(name.rlike(LICENCE_FILE), "licence").when(name.rlike(PACKAGE_FILE), "package")
    rows = files.select("file_key", kind.alias("kind"), "source_blob", "language").filter("kind is not null and file_key is not null")
    rows = rows.filter(repository_of(F.col("file_key"), above) != "")
    said = written(spread(rows).mapInArrow(run, "file_key string, kind string, ids array<string>, choice boolean"), "licence-statements")
    said = said.withColumn("dir", F.regexp_replace("file_key", r"/[^/]*$", "")).withColumn("repo", repository_of(F.col("file_key"), above))
    root = F.size(F.split("dir", "/")) == above + 2
    # a directory's licence files state its terms: all of them together
    by_dir = said.filter("kind = 'licence'").groupBy("dir").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    packages = said.filter(F.col("kind") == "package").filter(root).filter("size(ids) > 0").groupBy("repo").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("package_ids"))

    # distinct directories, not files, look for the nearest directory at or above that has licence files
    dirs = said.filter("kind = 'file'").select("dir", "repo").distinct()
    depth = F.size(F.split("dir", "/"))
    up = dirs.withColumn("depth", F.explode(F.sequence(F.lit(above + 2), depth))).withColumn("above", F.expr("substring_index(dir, '/', depth)"))
    near = up.join(by_dir.select(F.col("dir").alias("above"), "ids"), "above").groupBy("dir").agg(F.max_by("ids", "depth").alias("ids"))
    governed = dirs.join(near, "dir", "left").join(packages, "repo", "left").select("dir", F.coalesce("ids", "package_ids").alias("governing"))
    # one directory may hold a third of all files, so both sides of the last join are salted
    salted = governed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = said.filter("kind = 'file'").dropDuplicates(["file_key"]).withColumn("salt", F.pmod(F.xxhash64("file_key"), F.lit(SALTS)).cast("int"))
    f = own.join(salted, ["dir", "salt"], "left")

    g = F.coalesce("governing", F.array().cast("array<string>"))
    g_known = F.array_remove(g, UNKNOWN)
    ids = F.col("ids")
    unknown = F.array_contains(ids, UNKNOWN)
    disagrees = (F.size(g_known) > 0) & ~F.arrays_overlap(g_known, ids)
    single = (F.size(ids) == 1) | F.col("choice")
    licence = F.when(F.size(ids) == 0, F.when(F.size(g) == 0, "none").otherwise(_set_text(g, "AND"))).when(unknown, UNKNOWN).when(single, _set_text(ids, "OR")).otherwise(_set_text(ids, "AND"))
    governing_flag = F.when(F.size(g) == 0, "none").when(F.size(g) > 1, "conflict").when(F.array_contains(g, UNKNOWN), UNKNOWN).otherwise("ok")
    flag = F.when(F.size(ids) == 0, governing_flag).when(unknown, UNKNOWN).when(~single | disagrees, "conflict").otherwise("ok")
    of_files = f.select(F.lit("file").alias("scope"), F.col("file_key").alias("item"), licence.alias("licence"), flag.alias("flag"))

    at_root = said.filter(F.col("kind") != "file").filter(root).groupBy("repo").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    repos = said.select("repo").distinct().join(at_root, "repo", "left")
    r = F.coalesce("ids", F.array().cast("array<string>"))
    of_repos = repos.select(F.lit("repo").alias("scope"), F.col("repo").alias("item"), F.when(F.size(r) == 0, "none").otherwise(_set_text(r, "AND")).alias("licence"), F.when(F.size(r) == 0, "none").when(F.size(r) > 1, "conflict").when(F.array_contains(r, UNKNOWN), UNKNOWN).otherwise("ok").alias("flag"))
    return of_files.unionByName(of_repos)
