"""Functions paired with their documentation (problem 4).

A state machine that knows strings and comments lexes each source, matched brackets (in Python indents) delimit its
functions, and the comment right above a function, or its docstring, is attached to it. What is attached is judged by
what it says beyond the function's name and signature; documentation that tells a reader nothing is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.braces import LANGUAGES, functions
from marlstone.tables import spread, written

#: English function words; alone they say nothing.
PLAIN = set(
    "a an the this that these those it its itself he she they them their we us our you your i me my is are was were be been being am do does did done doing has have had having can could may might must shall should will would "
    "of for to and or in on with by as at from into onto over under up down out off about than then so if else when while where which who whom whose what how why not no nor neither either both all any each every some such only just also too very "
    "but because since until unless though although there here now more most less least much many few other another same own per via etc".split()
)
#: Words for parts of code, and for what every routine does.
STRUCTURE = set(
    "function functions func method methods routine procedure subroutine helper constructor implementation implements implemented return returns returned returning param params parameter parameters arg args argument arguments "
    "rtype type types raise raises throw throws yields yield value values result results input inputs output outputs void int integer integers float double long short char unsigned signed bool boolean str string strings number "
    "object none null undefined array list dict tuple bytes optional promise const static self cls async def n".split()
)
#: Words about documentation itself, its absence, or how little a routine needs any.
EMPTY = set(
    "todo fixme xxx tbd tba hack wip docstring docs doc document documents documentation documented undocumented describe describes described description summary comment comments placeholder stub boilerplate template "
    "missing pending later soon coming come comes follow follows following available unavailable needed needs need written explain explains explained explanation explanatory obvious obviously clear clearly trivial trivially "
    "straightforward simple simply plain evident exactly thing things stuff nothing something whatever anything see look read refer says say said suggests suggest implies imply means mean name names named title expected usual usually "
    "expect expects standard behaviour behavior behaves version code source above below before previous elsewhere details detail info information ditto idem inherited inherits inherit equivalent counterpart analogous identical like similar self yet "
    "know known please sorry unknown unclear unspecified progress".split()
)
#: What placeholders ask a writer to do; said of anything but documentation it is an action like others.
ASKING = set("add insert write fill put complete provide update finish document describe explain".split())
#: Instructions and tags for tools.
TOOLS = re.compile(
    r"(?i)(?:noqa|nosec|pylint|flake8|mypy|pyright|isort|yapf|fmt|black|ruff|bandit|type:\s*ignore|pragma:|coverage:|nolint|clang-format|clang-tidy|cppcheck|lint|splint|coverity|istanbul|c8\b|v8 ignore|eslint|jshint|jslint|tslint|prettier|"
    r"webpack|@ts-|@flow|@jsx|@private|@public|@protected|@internal|@deprecated|@override|@ignore|@hidden|@abstract|@static|@async|@generator|@readonly|@final|@api|@package|@nocollapse|@nodoc|@suppress|:meta\b|:nodoc:|sphinx|doctest:|gcov|lcov)"
)
_TAG_TAIL = re.compile(r"^@?[\w:#=,./@ \-]*$")
_POINTER = re.compile(r"(?i)^(?:\{@\w+[^}]*\}|@inheritdoc|ditto|idem|inherited|inherits?(?: docs?)?|(?:see|cf\.?|refer to|same as|as|like|copied from|documented in|documented at)\b.{0,60})$")
_POINTED = set("above below before previous header docs documentation base class parent super interface overview wiki readme manual file module there elsewhere spec the in also see same as at for details section and of method function or to it other counterpart declaration implementation its".split())
_CODE = re.compile(
    r"^(?:[\w.\[\]>-]+\s*(?:[-+*/%&|^]|<<|>>)?=(?!=)\s*\S.*|(?:return|throw|raise|yield|await|del|goto|break|continue|assert|import|from|let|var|const)\b.*[;(].*|return\s+[\w.]+\s*;?|(?:if|while|for|switch)\s*\(.*[;{]?|.*[;{}]\s*|[\w.]+\(.*\)\s*;?|#\s*(?:include|define|if|endif).*|(?:def|class|function)\s+\w+.*[:{]|@\w+\(.*\))$"
)
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_TAG = re.compile(r"^\s*(?:[:@\\](?:param|parameter|arg|argument|type|rtype|return|returns|raises|throws|property|template|typedef)\b|(?:Args|Arguments|Parameters|Params|Returns|Return|Raises|Yields)\s*:?\s*$)", re.I)


def unwrapped(doc: str) -> str:
    """A doc comment without its marks; a docstring as it is."""
    s = doc.strip()
    if s.startswith("/*"):
        s = re.sub(r"^/\*+!?|\*+/$", "", s)
        s = "\n".join(re.sub(r"^\s*\*(?!\*)\s?", "", x) for x in s.split("\n"))
    elif s.startswith("//"):
        s = "\n".join(re.sub(r"^\s*///?!?\s?", "", x) for x in s.split("\n"))
    elif s.startswith("#"):
        s = "\n".join(re.sub(r"^\s*#+\s?", "", x) for x in s.split("\n"))
    return s.strip()


def _stem(w: str) -> str:
    for end in ("ing", "ies", "ed", "es", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


@lru_cache(maxsize=65536)
def _split(name: str) -> frozenset[str]:
    return frozenset(_stem(x) for part in re.split(r"[\W_]+", name) for x in _CAMEL.sub(" ", part).lower().split())


def parameters(signature: str | None) -> list[str]:
    """Names and types of a signature's parameters: brackets are matched, strings skipped."""
    if not signature:
        return []
    start = signature.find("(")
    if start < 0:
        return []
    depth, at, parts, quote = 0, start, [], ""
    for i in range(start, len(signature)):
        c = signature[i]
        if quote:
            quote = "" if c == quote and signature[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                parts.append(signature[at + 1 : i])
                break
    return re.findall(r"[^\W\d]\w*", " ".join(parts))


def _says(words: list[str], own: set[str]) -> bool:
    """Whether words hold anything beyond the routine's own names, function words, words for code and empty ones."""
    asks, empty, rest = 0, 0, 0
    for w in words:
        low = w.lower().strip("_")
        stem = _stem(low)
        if low in ASKING:
            asks += stem not in own
        elif low in EMPTY:
            empty += 1
        elif len(low) < 2 or low in PLAIN or low in STRUCTURE or stem in own:
            rest += low in STRUCTURE
        else:
            parts = _split(w)
            if not parts or not all(p in own or p in STRUCTURE or p in PLAIN for p in parts):
                return True
    return asks > 0 and not empty and rest > 0


def tells(qualname: str | None, signature: str | None, doc: str | None) -> bool:
    """Whether documentation tells a reader anything about the routine.

    It doesn't if null, empty or only marks, if it only repeats the routine's name or its parameters' names and types,
    is a placeholder or a pointer elsewhere, only an instruction or tag for a tool, or code.
    """
    if not doc:
        return False
    text = unwrapped(doc)
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if _WORD.search(x)]
    if not lines:
        return False
    if all(TOOLS.match(x) and (_TAG_TAIL.match(x) and len(x.split()) <= 8 or x.startswith("@") is False and len(x.split()) <= 6) for x in lines):
        return False
    own = set()
    for part in re.split(r"[.:#]", qualname or ""):
        own |= _split(part)
        own.add(_stem(part.lower()))
    names = parameters(signature)
    own |= {_stem(x.lower()) for x in names}
    for x in names:
        own |= _split(x)
    if all(_CODE.match(x) for x in lines) and not (len(lines) == 1 and re.search(r"[a-z] [a-z]+ [a-z]+ [a-z]", lines[0]) and not re.search(r"[;={}]", lines[0])):
        return False
    if len(lines) == 1 and _POINTER.match(lines[0].rstrip(".!")):
        words = [w.lower() for w in _WORD.findall(re.sub(r"`[^`]*`|\{@\w+[^}]*\}|\S*[_/.:]\w\S*", "", lines[0]))][1:]
        if all(w in _POINTED or w in EMPTY or w in PLAIN or w in STRUCTURE or _stem(w) in own for w in words) or len(words) <= 1:
            return False
    tagged = False
    for x in lines:
        if TOOLS.match(x) and len(x.split()) <= 4:
            continue
        if _TAG.match(x):
            tagged = True
            x = re.sub(r"\{[^}]*\}", " ", x)
            x = re.sub(r"^(\s*[:@\\](?:param|parameter|arg|argument|property|type)\b)\s*\w+", " ", x)
        elif tagged:
            m = re.match(r"\s*[-*]?\s*`?(\w+)`?\s*(?:\([^)]*\))?\s*:", x)
            x = re.sub(rf"\b{m[1]}\b", " ", x[m.end() :]) if m else x
        if _says(re.findall(r"[^\W\d]\w*", x), own):
            return True
    return False


_FUNCTIONS = "file string, name string, start_line int, told boolean, qualname string, signature string, code string, description string"


def extracted(files: DataFrame, with_code: bool = True) -> DataFrame:
    """Every function that a source shows: (file, name, start_line, told, qualname, signature, code, description).

    told: whether the documentation attached to it tells something. The last four are null where it doesn't, and code and
    description also without with_code, so that no text travels in vain. Rows of files delivered twice come twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FUNCTIONS.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for key, blob, language in zip(*(b.column(i).to_pylist() for i in range(3))):
                text = blob.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
                for f in functions(text, language, with_calls=False):
                    told = tells(f.qualname, f.signature, f.own_doc)
                    more = (f.qualname, f.signature, f.code, unwrapped(f.own_doc)) if told and with_code else (None,) * 4
                    rows.append((key, f.name, f.start_line, told, *more))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    rows = files.select("file_key", "source_blob", "language").filter(F.col("source_blob").isNotNull() & F.col("language").isin(*LANGUAGES))
    return spread(rows).mapInArrow(run, _FUNCTIONS)


def _told(qualname: pd.Series, signature: pd.Series, doc: pd.Series) -> pd.Series:
    return pd.Series([tells(*x) for x in zip(qualname.tolist(), signature.tolist(), doc.tolist())], dtype=bool)


_KEY = ["file", "start_line", "name"]


def _asked(symbols: DataFrame) -> DataFrame:
    """(file, qualname, start_line, name) of the symbols that may be paired: routines with some documentation."""
    s = symbols.select("file", "qualname", "start_line", "kind", "existing_doc")
    s = s.filter(~F.col("kind").isin("class", "declaration") & F.col("existing_doc").isNotNull() & (F.length(F.trim("existing_doc")) > 0))
    return s.select("file", "qualname", "start_line", F.regexp_extract("qualname", r"([^.]+)$", 1).alias("name")).distinct()


def _matched(symbols: DataFrame, shown: DataFrame) -> DataFrame:
    """The asked symbols with what their source says: told is null where it doesn't show the function. A table."""
    told = shown.groupBy(*_KEY).agg(F.max("told").alias("told"))
    return written(_asked(symbols).join(told, _KEY, "left"), "matched")


def _alone(symbols: DataFrame, matched: DataFrame) -> DataFrame:
    """Symbols that no source shows, by their own documentation: file, qualname, start_line, signature, existing_doc."""
    key = ["file", "qualname", "start_line"]
    lost = matched.filter("told is null").select(*(F.col(k).alias(f"k_{k}") for k in key))
    s = symbols.select(*key, "kind", "signature", "existing_doc").filter(~F.col("kind").isin("class", "declaration"))
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key]
    s = s.join(lost, same[0] & same[1] & same[2], "left_semi")
    return s.filter(F.pandas_udf(_told, "boolean")("qualname", "signature", "existing_doc")).drop("kind").dropDuplicates(key)


def documented(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Functions and methods of the symbols whose documentation tells something: file, qualname, start_line, shown.

    The documentation is what the lexer attaches to the function in its source. Where the source doesn't show the
    function (the file is gone or broken), shown is false and the symbol's own existing_doc is judged. Symbols without
    documentation, of the kinds `class` and `declaration`, or of a null kind are left out. Rows delivered twice come out
    once. A null signature has no parameters to repeat. Only keys are shuffled, no sources or texts.
    """
    matched = _matched(symbols, extracted(files, with_code=False))
    key = ["file", "qualname", "start_line"]
    seen = matched.filter("told").select(*key, F.lit(True).alias("shown"))
    return seen.unionByName(_alone(symbols, matched).select(*key, F.lit(False).alias("shown")))


def pairs(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, qualname, start_line, signature, code, description) of the documented functions.

    Every function that a source shows comes with its code and the documentation attached to it, under the symbols' name
    where they have it, else the lexer's; a symbol that no source shows has a null code. Sources are lexed once.
    """
    found = written(extracted(files), "functions")
    matched = _matched(symbols, found)
    named = matched.filter("told").select(*_KEY, F.col("qualname").alias("said"))
    own = found.filter("told").dropDuplicates(_KEY).join(named, _KEY, "left")
    of_sources = own.select("file", F.coalesce("said", "qualname").alias("qualname"), "start_line", "signature", "code", "description")
    clean = F.pandas_udf(lambda x: x.map(unwrapped), "string")
    alone = _alone(symbols, matched).select("file", "qualname", "start_line", "signature", F.lit(None).cast("string").alias("code"), clean("existing_doc").alias("description"))
    return of_sources.unionByName(alone)
