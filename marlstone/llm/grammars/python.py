"""Lexer and parsing-expression grammar of Python 3.13."""

from __future__ import annotations

import codecs
import re

from marlstone.llm.grammars.peg import Grammar

GRAMMAR = r"""
file <- [UNITS stmt]
body <- [UNITS stmt]
stmt <- compound / simple (';' simple)* ';'? NL
suite <- NL I<body> / simple (';' simple)* ';'? NL
simple <- 'pass' / ?L ('break' / 'continue') / ?F 'return' exprs? / 'raise' (expr ('from' expr)?)? / 'assert' expr (',' expr)?
  / 'del' target (',' target)* ','? / 'global' name (',' name)* / 'nonlocal' name (',' name)* / import / typealias / annotated / augmented / assigned / yield / exprs
import <- 'import' dotted ('as' name)? (',' dotted ('as' name)?)*
  / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / P<imported (',' imported)* ','?> / imported (',' imported)*)
imported <- name ('as' name)?
dotted <- name ('.' name)*
typealias <- 'type' name B<typeparams>? '=' expr
typeparams <- typeparam (',' typeparam)* ','?
typeparam <- ('*' / '**')? name (':' expr)? ('=' star)?
annotated <- (chain / name / P<target>) ':' expr ('=' (yield / exprs))?
augmented <- (chain / name) augop (yield / exprs)
assigned <- (targets '=')+ (yield / exprs) !'='
targets <- startarget (',' startarget)* ','?
startarget <- '*'? target
target <- chain / name / P<targets?> / B<targets?>
chain <- atom (P<args?>* ('.' name / B<slices>))+
compound <- 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)?
  / 'while' named ':' +L(suite) ('else' ':' suite)?
  / (?A 'async')? 'for' targets 'in' exprs ':' +L(suite) ('else' ':' suite)?
  / (?A 'async')? 'with' (P<withitem (',' withitem)* ','?> ':' / withitem (',' withitem)* ':') suite
  / 'try' ':' suite (except+ ('else' ':' suite)? ('finally' ':' suite)? / 'finally' ':' suite)
  / ('@' named NL)* ('class' name B<typeparams>? P<args?>? ':' @(suite) / 'def' name B<typeparams>? P<params?> ('->' expr)? ':' @F(suite) / 'async' 'def' name B<typeparams>? P<params?> ('->' expr)? ':' @AF(suite))
  / 'match' subject ':' NL I<case+>
subject <- starnamed ',' (starnamed (',' starnamed)* ','?)? / named
except <- 'except' '*'? (expr ('as' name)?)? ':' suite
withitem <- expr 'as' target / expr
case <- 'case' patterns ('if' named)? ':' suite
patterns <- pattern (',' pattern)* ','?
pattern <- '*' name / orpattern ('as' name)?
orpattern <- closed ('|' closed)*
closed <- '-'? NUM (('+' / '-') NUM)? / string+ / 'None' / 'True' / 'False' / dotted P<patternargs?>? / P<patterns?> / B<patterns?> / C<mapping?>
patternargs <- patternarg (',' patternarg)* ','?
patternarg <- name '=' pattern / pattern
mapping <- mapped (',' mapped)* ','?
mapped <- '**' name / closed ':' pattern
exprs <- star (',' star)* ','?
star <- '*' arith / expr
starnamed <- '*' arith / named
named <- name ':=' expr / expr
yield <- ?F 'yield' ('from' expr / exprs)?
expr <- 'lambda' (lparam (',' lparam)* ','?)? ':' @F(expr) / or ('if' or 'else' expr)?
lparam <- ('*' name / '**' name / name / '*' / '/') ('=' expr)?
or <- not (('or' / 'and') not)*
not <- 'not' not / arith (compare arith)*
compare <- comparison / 'not' 'in' / 'in' / 'is' 'not'?
arith <- unary (arithop unary)*
unary <- ('+' / '-' / '~')* power
power <- (?A 'await')? atom trailer* ('**' unary)?
trailer <- '.' name / P<args?> / B<slices>
atom <- name / NUM / string+ / 'None' / 'True' / 'False' / '...' / P<inround?> / B<insquare?> / C<incurly?>
string <- STR / T<field*>
field <- F<(yield / exprs) '='? ('!' name)? (':' field*)?>
inround <- yield / named comp / starnamed ',' (starnamed (',' starnamed)* ','?)? / named
insquare <- named comp / starnamed (',' starnamed)* ','?
incurly <- pair comp / pair (',' pair)* ','? / named comp / starnamed (',' starnamed)* ','?
pair <- '**' arith / expr ':' expr
comp <- ('async'? 'for' targets 'in' or ('if' or)*)+
args <- named comp ','? / positional (',' positional)* (',' keyword)* ','? / keyword (',' keyword)* ','?
positional <- '*' expr / named !'='
keyword <- name '=' expr / '*' expr / '**' expr
slices <- slice (',' slice)* ','?
slice <- expr? ':' expr? (':' expr?)? / starnamed
params <- param (',' param)* ','?
param <- '**' name (':' expr)? / '*' (name (':' star)?)? / '/' / name (':' expr)? ('=' expr)?
"""

KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
SOFT = "match case type"
OPERATORS = "+ - * ** / // % @ << >> & | ^ ~ := < > <= >= == != , : . ... ; = -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= !"

SETS = {
    "name": "NAME match case type",
    "augop": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=",
    "comparison": "== != < > <= >=",
    "arithop": "| ^ & << >> + - * / // % @",
}

_STRING = r"""(?:(?i:[bu]|br|rb|r)?(?:'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|"(?!"")(?:[^"\\\n]|\\[\s\S])*"))"""
_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
_TOKEN = re.compile(
    r"(?P<skip>[ \t\f]+|\\\n|#[^\n]*)"
    r"|(?P<f>(?i:f|fr|rf)(?:'''|\"\"\"|'|\"))"
    r"|(?P<s>" + _STRING + r")"
    r"|(?P<w>[^\W\d]\w*)"
    r"|(?P<n>" + _NUMBER + r")"
    r"|(?P<l>\n[ \t\f]*)"
    r"|(?P<o>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|==|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^~<>,:.;=!])"
    r"|(?P<b>[()\[\]{}])"
)
_CODING = re.compile(rb"^[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)")


def grammar() -> Grammar:
    g = Grammar(GRAMMAR, "NAME NUM STR NL " + KEYWORDS + " " + SOFT + " " + OPERATORS, SETS, units="NL", goes_on="elif else except finally")
    return g


class Malformed(Exception):
    """What no token can be: with the place."""

    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at, self.why = at, why


def decoded(blob: bytes) -> str:
    """A source's text, with line ends as one character; raises Malformed where the bytes are not text."""
    if b"\0" in blob:
        raise Malformed(blob.index(b"\0"), "null byte")
    bom = blob.startswith(codecs.BOM_UTF8)
    body = blob[3:] if bom else blob
    name = "utf-8"
    lines = re.split(rb"\r\n|\r|\n", body[:4096] if len(body) > 4096 else body, maxsplit=2)[:2]
    for i, x in enumerate(lines):
        m = _CODING.match(x)
        if m:
            name = m[1].decode("ascii", "replace")
            break
        if i == 0 and x.strip() and not x.lstrip().startswith(b"#"):
            break
    try:
        name = codecs.lookup(name).name
    except LookupError:
        raise Malformed(0, "unknown encoding") from None
    if bom and name not in ("utf-8", "utf-8-sig"):
        raise Malformed(0, "byte order mark and another encoding")
    try:
        text = body.decode(name)
    except UnicodeDecodeError as e:
        raise Malformed(e.start, "bytes that are not text") from None
    return text.replace("\r\n", "\n").replace("\r", "\n")


def symbols(text: str, g: Grammar, places: dict | None = None) -> str:
    """The text's symbols; places, if given, gets for each group the positions of its symbols."""
    if not text.endswith("\n"):
        text += "\n"
    tok = g.tokens
    word, name, num, string, nl = tok.get, tok["NAME"], tok["NUM"], tok["STR"], "\x01"
    # each open group: its kind, its symbols, their places, and for strings the quote, whether raw, and its start
    out: list[str] = []
    at: list[int] = []
    stack: list[tuple] = []
    indents = [0]
    alts = [0]  # columns with tabs as one: both have to agree
    pos, n = 0, len(text)

    def close(kind: str) -> None:
        nonlocal out, at
        symbol = g.intern(kind, "".join(out))
        if places is not None:
            places[symbol] = at
        _, out, at, start = stack.pop()[:4]
        out.append(symbol)
        at.append(start)

    def opened(kind: str, start: int, *more) -> None:
        nonlocal out, at
        stack.append((kind, out, at, start, *more))
        out, at = [], []

    def fstring(i: int) -> int:
        """Reads on within an f-string (or a field's format): up to its end, or a field's start."""
        kind, _, _, start, quote, raw = stack[-1]
        while True:
            if i >= n:
                raise Malformed(start, "string without end")
            c = text[i]
            if c == "\\" and kind == "T":
                i += 1 if raw and text[i + 1 : i + 2] in ("{", "}") else 1 if text[i + 1 : i + 2] in "{}" else 2
            elif text.startswith(quote, i):
                if kind == "S":
                    raise Malformed(i, "field without end")
                close("T")
                return i + len(quote)
            elif c == "\n" and len(quote) == 1:
                raise Malformed(start, "string without end")
            elif c == "{":
                if kind == "T" and text[i + 1 : i + 2] == "{":
                    i += 2
                elif kind == "T" and not raw and text.startswith("\\N{", i - 2):
                    i = text.find("}", i) + 1 or n
                else:
                    opened("F", i, quote, raw)
                    return i + 1
            elif c == "}":
                if kind == "T":
                    if text[i + 1 : i + 2] != "}":
                        raise Malformed(i, "single '}' in a string")
                    i += 2
                else:
                    end = stack.pop()
                    fields, places_ = out, at
                    set_out(end[1] + fields, end[2] + places_)
                    close("F")
                    return i + 1
            else:
                i += 1

    def set_out(a: list, b: list) -> None:
        nonlocal out, at
        out, at = a, b

    m = re.match(r"[ \t\f]*", text)
    first = text[: m.end()]
    if first and text[m.end() : m.end() + 1] not in ("\n", "#", ""):
        col = len(first.rpartition("\f")[2].expandtabs(8))
        if col:
            raise Malformed(0, "unexpected indent")
    scan = _TOKEN.match
    mode = "code"
    while pos < n:
        if mode == "text":
            pos = fstring(pos)
            mode = "text" if stack and stack[-1][0] in "TS" else "code"
            continue
        m = scan(text, pos)
        if m is None:
            raise Malformed(pos, "no token")
        k, start, pos = m.lastgroup, pos, m.end()
        if k == "w":
            x = m.group()
            out.append(word(x, name))
            at.append(start)
            if not x.isascii() and not x.isidentifier():
                raise Malformed(start, "no identifier")
        elif k == "skip":
            if m.group()[0] == "\\" and pos >= n:
                raise Malformed(start, "end after a backslash")
        elif k == "o":
            x = m.group()
            if stack and stack[-1][0] == "F":
                if x == ":=":
                    x, pos = ":", start + 1
                if x[0] == ":" and not (tok["lambda"] in out and out.count(tok["lambda"]) > out.count(tok[":"])):
                    out.append(tok[":"])
                    at.append(start)
                    quote, raw = stack[-1][4:6]
                    opened("S", start, quote, raw)
                    mode, pos = "text", start + 1
                    continue
            out.append(tok[x])
            at.append(start)
        elif k == "b":
            x = m.group()
            if x in "([{":
                opened(x, start)
                continue
            top = stack[-1][0] if stack else ""
            if top == "F" and x == "}":
                close("F")
                mode = "text" if stack and stack[-1][0] in "TS" else "code"
                continue
            if {")": "(", "]": "[", "}": "{"}[x] != top:
                raise Malformed(start, "closing bracket without its opening one")
            close({"(": "P", "[": "B", "{": "C"}[top])
        elif k == "s":
            out.append(string)
            at.append(start)
            x = m.group()
            if "\\" in x and not x.isascii() is None:
                _check_string(x, start)
            elif x[0] in "bB" or x[1:2] in "bB" and x[0] in "rR":
                if not x.isascii():
                    raise Malformed(start, "bytes with other than ASCII characters")
        elif k == "n":
            x = m.group()
            nxt = text[pos : pos + 1]
            if (nxt.isalnum() or nxt == "_") and not re.match(r"(and|else|for|if|in|is|not|or)\b", text[pos : pos + 5]):
                raise Malformed(start, "no number")
            if len(x) > 1 and x[0] == "0" and x[1] in "0123456789_" and not re.search(r"[.eEjJ]", x) and x.strip("0_"):
                raise Malformed(start, "leading zeros")
            out.append(num)
            at.append(start)
        elif k == "f":
            x = m.group()
            q = x.lstrip("fFrR")
            opened("T", start, q, "r" in x.lower())
            mode = "text"
        elif k == "l":
            if any(s[0] in "([{F" for s in stack):
                continue
            nxt = text[pos : pos + 1]
            if out and out[-1] != nl and not (g.kind.get(out[-1]) == "I"):
                out.append(nl)
                at.append(start)
            if nxt in ("\n", "#", ""):
                if nxt or pos < n:
                    continue
            if nxt == "\\" and text[pos + 1 : pos + 2] == "\n":
                pass
            indent = m.group()[1:]
            indent = indent.rpartition("\f")[2]
            col, alt = (len(indent.expandtabs(8)), len(indent)) if "\t" in indent else (len(indent), len(indent))
            if pos >= n:
                col = alt = 0
            if col == indents[-1]:
                if alt != alts[-1]:
                    raise Malformed(pos, "tabs and blanks mixed")
                continue
            if col > indents[-1]:
                if alt <= alts[-1]:
                    raise Malformed(pos, "tabs and blanks mixed")
                indents.append(col)
                alts.append(alt)
                opened("I", pos)
                continue
            while col < indents[-1]:
                indents.pop()
                alts.pop()
                close("I")
            if col != indents[-1] or alt != alts[-1]:
                raise Malformed(pos, "indent that fits no block")
    if any(s[0] != "I" for s in stack):
        raise Malformed(next(s[3] for s in stack if s[0] != "I"), "bracket without end")
    while stack:
        close("I")
    if places is not None:
        places[""] = at
    return "".join(out)


_ESCAPE = re.compile(r"\\(?:N\{[^}]*\}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[^NxuU]|\n)|\\", re.S)


def _check_string(x: str, start: int) -> None:
    """Escapes that are errors: cut short ones, unknown character names, numbers beyond Unicode."""
    prefix = x[: min(x.find("'") % 99, x.find('"') % 99)].lower()
    if "b" in prefix and not x.isascii():
        raise Malformed(start, "bytes with other than ASCII characters")
    if "r" in prefix:
        return
    for m in re.finditer(r"\\(.)", x, re.S):
        c = m[1]
        if c == "x" and not re.match(r"[0-9a-fA-F]{2}", x[m.end() : m.end() + 2]):
            raise Malformed(start, "escape cut short")
        if "b" not in prefix and c in "uUN":
            rest = x[m.end() :]
            if c == "u" and not re.match(r"[0-9a-fA-F]{4}", rest) or c == "U" and not re.match(r"00(0[0-9a-fA-F]|10)[0-9a-fA-F]{4}", rest):
                raise Malformed(start, "escape cut short")
            if c == "N":
                import unicodedata

                name = re.match(r"\{([^}]+)\}", rest)
                try:
                    unicodedata.lookup(name[1]) if name else None
                except KeyError:
                    name = None
                if not name:
                    raise Malformed(start, "unknown character name")
