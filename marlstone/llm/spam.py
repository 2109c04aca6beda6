"""Keyword-stuffed and link-list pages (problem 8).

A hidden Markov model labels the lines of a text as prose, link list, tag list or menu; a text is flagged by the share
of its words in lines that are no prose. What a line looks like is one of a few symbols; the model decides what it is
by its neighbours. Parameters are fixed values, so a text's result depends on that text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.responses import STOPWORDS, folded
from marlstone.tables import spread

STATES = ("prose", "links", "tags", "menu")
SYMBOLS = ("sentence", "stuffed", "link", "items", "short", "code", "other")
#: Emission probabilities by state, in the order of SYMBOLS, and the chance to stay in a state.
EMISSION = {
    "prose": (0.60, 0.01, 0.02, 0.02, 0.05, 0.20, 0.10),
    "links": (0.02, 0.02, 0.80, 0.03, 0.08, 0.01, 0.04),
    "tags": (0.02, 0.42, 0.02, 0.42, 0.08, 0.01, 0.03),
    "menu": (0.02, 0.02, 0.06, 0.12, 0.70, 0.01, 0.07),
}
STAY = 0.85
#: A text is flagged if more than this share of its words stands in lines that are no prose.
SHARE = 0.5
#: Lines are read in pieces of at most so many words.
PIECE = 30
#: A keyword makes up this part of a text's words and comes this often; stuffed lines consist of keywords by half.
KEYWORD, TIMES, STUFFED = 0.035, 4, 0.45
#: Keywords are stuffing, not a theme, if they make up this part of a text's words, or this part of its words other than
#: stop words; the second also makes a line stuffed, so stop words between the keywords are no disguise.
MASS, CONTENT = 0.3, 0.6

_FUNCTION = {w for ws in STOPWORDS.values() for w in ws.split()}
_WORD = re.compile(r"[ぁ-ゟ]+|[゠-ヿー]+|[一-鿿々]+|[^\W_ぁ-ヿ一-鿿]+")
_URL = re.compile(
    r"<a\s[^>]{0,400}>|</a>|\[[^\]\n]{0,80}\]\((?=\w+:)|(?:h(?:tt|xx)ps?|ftp)\s?[:：]\s?/{0,2}\S+(?:\s?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]| dot )\s?[\w/?=&#%~-]+)*|www\S*(?:\s?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]| dot )\s?[\w/?=&#%~-]+)*"
    r"|(?<![\w-])[\w-]{1,63}(?:(?:\.|\[\.\]|\(\.\)|\s?\(dot\)\s?|\s?\[dot\]\s?| dot )[\w-]{1,63}){1,4}(?:/[\w./?=&#%~-]*)|(?<![\w-])[\w-]{1,63}(?:\.|\[\.\]|\(\.\)| dot )(?:com|org|net|test|example|invalid|io|info|biz|shop|site|online|xyz)\b\S*",
    re.I,
)
_CODE = re.compile(r"^\s*(?:[>$]\s)?(?:\S*\d\d?:\d\d\b.*|\d{4}-\d\d-\d\d.*|\[?(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b.*|-{1,2}[A-Za-z][\w-]*(?:[ =,].*)?$|[\w.]+\([^)]*\)[;:{]?\s*$|[\w.\[\]]+\s*[-+*/|&]?=\s*\S.*|.*[;{}]\s*$|(?:return|import|from|def|class|if|for|while|else|elif|end|fi|done)\b.*[:;({]\s*.*|\$ .*|[A-Z_]{3,}=.*|at .*\(.*:\d+\)|Traceback.*|\|?[-=+|: ]{4,}\|?$)")
_MARKED = re.compile(r"(?:^|\s)#[^\s#]+|\[[^\[\]\n]{1,40}\]")
_SEPARATOR = re.compile(r"\s*(?:[,;|»›·•‣▪>/~*]|、|・|，|\s-\s|\s–\s|\t|::|->|→)\s*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")


#: A text without any of these, and without a dot before a letter, holds no URL, so it need not be searched for one.
_MARKS_OF_URLS = ("://", "www", "](", "[.", "(.", " dot", "[dot", "(dot", "<a", "</a", "：", "ttp", "ftp", "xxp", "WWW", "<A")
_DOTTED = re.compile(r"\.\w")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _without_urls(text: str) -> str:
    return _URL.sub(" ", text) if any(x in text for x in _MARKS_OF_URLS) or _DOTTED.search(text) else text


def split_words(line: str) -> tuple[list[str], list[str]]:
    """The words of a line, and those outside of URLs."""
    ws, bare = words(line), _without_urls(line)
    return ws, ws if bare is line else words(bare)


def _plain(w: str) -> bool:
    """Whether a word is a stop word of some language, or of Hiragana."""
    return w in _FUNCTION or not w.isascii() and ("ぁ" <= w[0] <= "ゟ" or folded(w) in _FUNCTION)


def _function_share(ws: list[str]) -> float:
    return (sum(map(_FUNCTION.__contains__, ws)) + sum("ぁ" <= w[0] <= "ゟ" or folded(w) in _FUNCTION for w in ws if not w.isascii())) / len(ws)


def pieces(text: str) -> Iterator[str]:
    """Lines; long ones by sentences, and long sentences by runs of words at separators or blanks."""
    for line in text.splitlines():
        if not line.strip():
            continue
        if line.count(" ") <= PIECE and len(line) <= 8 * PIECE:
            yield line
            continue
        for s in _SENTENCE.split(line):
            if s.count(" ") <= PIECE and len(s) <= 12 * PIECE:
                if s.strip():
                    yield s
                continue
            at = 0
            while at < len(s):
                end = min(len(s), at + 7 * PIECE)
                if end < len(s):
                    cuts = [m.end() for m in _SEPARATOR.finditer(s, at + 3 * PIECE, end)]
                    blank = s.rfind(" ", at + 1, end)
                    end = cuts[-1] if cuts else blank + 1 if blank > at else end
                if s[at:end].strip():
                    yield s[at:end]
                at = end


def symbol(line: str, keywords: set[str], fenced: bool = False, parts: tuple[list[str], list[str]] | None = None) -> tuple[str, int]:
    """What a line looks like, and its words; parts: the words of the line, and those outside of URLs, if known."""
    ws, plain = parts or split_words(line)
    n = len(ws)
    if fenced or line.lstrip().startswith(("```", "~~~")):
        return "code", n
    if not n:
        return "other", 0
    if len(plain) < 0.6 * n and not (len(plain) >= 4 and _function_share(plain) >= 0.3):
        return "link", n
    if len(plain) < n:
        ws = plain or ws
    share = _function_share(ws)
    if ("#" in line or "[" in line) and share < 0.5 and sum(len(words(m.group())) for m in _MARKED.finditer(line)) >= 0.7 * len(ws):
        return "items", n
    if share >= 0.3 and not keywords:  # whether code or not: prose
        return "sentence", n
    if re.match(r"\s*\S*\d\d?:\d\d\b", line) and _CODE.match(line):
        return "code", n
    if keywords and len(ws) > 2:
        stuffing = sum(w in keywords for w in ws)
        if stuffing >= STUFFED * len(ws) or stuffing > 1 and stuffing >= CONTENT * sum(not _plain(w) for w in ws):
            return "stuffed", n
    items = [x for x in _SEPARATOR.split(line.strip(" .*-•|\t")) if x.strip()]
    if _CODE.match(line):
        return "code", n
    if len(items) >= 3 and n <= 4.5 * len(items) and share < 0.2:
        return "items", n
    if re.match(r"\s*#{1,6}\s|\s*=+\s*$", line) or len(ws) < 2 and line.rstrip()[-1:] in ":.":
        return "other", n
    if share >= 0.12 or line.rstrip()[-1:] in ".!?:。！？" and len(ws) >= 4:
        return "sentence", n
    if len(ws) <= 6:
        return "short", n
    return "items" if share < 0.05 else "sentence", n


_LOG_EMIT = [[log(EMISSION[s][k]) for s in STATES] for k in range(len(SYMBOLS))]
_LOG_STAY, _LOG_MOVE = log(STAY), log((1 - STAY) / (len(STATES) - 1))
_START = [log(x) for x in (0.7, 0.1, 0.1, 0.1)]
_INDEX = {s: i for i, s in enumerate(SYMBOLS)}


def labels(symbols: list[str]) -> list[str]:
    """The most likely states of the lines (Viterbi)."""
    if not symbols:
        return []
    k = len(STATES)
    score = [a + b for a, b in zip(_START, _LOG_EMIT[_INDEX[symbols[0]]])]
    back: list[list[int]] = []
    for x in symbols[1:]:
        best = max(range(k), key=score.__getitem__)
        moved, emit = score[best] + _LOG_MOVE, _LOG_EMIT[_INDEX[x]]
        step = [j if score[j] + _LOG_STAY >= moved else best for j in range(k)]
        score = [max(score[j] + _LOG_STAY, moved) + emit[j] for j in range(k)]
        back.append(step)
    at = max(range(k), key=score.__getitem__)
    out = [at]
    for step in reversed(back):
        at = step[at]
        out.append(at)
    return [STATES[i] for i in reversed(out)]


def _keywords(words_: Iterable[str]) -> set[str]:
    """The keywords of a text's words, if they are stuffing; else none."""
    all_words = list(words_)
    total = len(all_words)
    count = Counter(w for w in all_words if not _plain(w))
    out = {w for w, n in count.items() if n >= TIMES and n >= KEYWORD * total}
    mass = sum(count[w] for w in out)
    return out if mass >= MASS * total or mass and mass >= CONTENT * count.total() else set()


def shares(text: str) -> dict[str, float]:
    """The share of a text's words in lines of each label; all zero for a text without words."""
    lines = list(pieces(text))
    parts = [split_words(x) for x in lines]
    keywords = _keywords(w for _, plain in parts for w in plain)
    if keywords:  # sentences that come again are no stuffing: of each, numbers aside, one counts
        distinct = {re.sub(r"\d+", "0", x.strip().lower()): x for line in lines for x in _SENTENCE.split(line)}
        keywords = _keywords(w for x in distinct.values() for w in split_words(x)[1])
    looks, sizes, fenced = [], [], False
    for line, known in zip(lines, parts):
        fence = line.lstrip().startswith(("```", "~~~"))
        s, n = symbol(line, keywords, fenced or fence, known)
        fenced ^= fence
        looks.append(s)
        sizes.append(n)
    out = dict.fromkeys(STATES, 0.0)
    for label, n in zip(labels(looks), sizes):
        out[label] += n
    n = sum(sizes) or 1
    return {k: v / n for k, v in out.items()}


_SCHEMA = "doc_id {}, prose double, links double, tags double, menu double"


def line_shares(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, prose, links, tags, menu): shares of words by label; zeros for null, empty and blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [shares(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[s] for r in rows], pa.float64()) for s in STATES)], names=["doc_id", *STATES])

    kind = documents.schema[key].dataType.simpleString()
    out = spread(documents.select(F.col(key).alias("doc_id"), text)).mapInArrow(run, _SCHEMA.format(kind))
    return out.withColumnRenamed("doc_id", key)


def flagged(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents most of whose words are no prose: key, and the shares of words by label."""
    return line_shares(documents, key, text).filter(F.col("links") + F.col("tags") + F.col("menu") > SHARE)
