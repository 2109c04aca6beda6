"""Lexer and parsing-expression grammar of ECMAScript 2022 modules."""

from __future__ import annotations

import re

from marlstone.llm.grammars.peg import NEWLINE, Grammar
from marlstone.llm.grammars.python import Malformed

GRAMMAR = r"""
file <- [UNITS item]
item <- import / export / statement
block <- [UNITS statement]
eos <- ';' / $
import <- 'import' STR eos / 'import' imports 'from' STR eos
imports <- binding (',' (namespace / named))? / namespace / named
namespace <- '*' 'as' binding
named <- C<(specifier (',' specifier)* ','?)?>
specifier <- (WORD / STR) 'as' binding / binding
export <- 'export' ('*' ('as' (WORD / STR))? 'from' STR eos / C<(exported (',' exported)* ','?)?> 'from' STR eos / C<(local (',' local)* ','?)?> eos
  / 'default' (function / class / !function !class assign eos) / variable eos / fndecl / classdecl)
exported <- (WORD / STR) ('as' (WORD / STR))?
local <- ident ('as' (WORD / STR))?
statement <- C<block> / ';' / variable eos / fndecl / classdecl / if / for / while / do / return / jump / throw / try / switch / label / 'debugger' eos / !('function' / 'class' / 'async' ~ 'function' / C<anything>) expr eos
variable <- 'let' declarator (',' declarator)* / 'var' declarator (',' declarator)* / 'const' constant (',' constant)*
declarator <- pattern '=' assign / binding ('=' assign)?
constant <- (pattern / binding) '=' assign
pattern <- B<arraypattern> / C<(objectpart (',' objectpart)* ','?)?>
arraypattern <- ','* (element (','+ element)* ','*)?
element <- '...' bound / bound ('=' assign)?
objectpart <- '...' binding / property ':' bound ('=' assign)? / binding ('=' assign)?
bound <- pattern / binding
binding <- ident
if <- 'if' P<expr> body ('else' body)?
body <- !(class / 'let' / 'const' / 'async' ~ 'function' / 'function') statement
for <- 'for' (?A 'await')? P<forhead> +L(body)
forhead <- ('var' / 'let' / 'const') bound ('of' assign / 'in' expr) / (assignpattern / target) ('of' assign / 'in' expr) / (('var' / 'let' / 'const') declarator (',' declarator)* / expr)? ';' expr? ';' expr?
while <- 'while' P<expr> +L(body)
do <- 'do' +L(body) 'while' P<expr> ';'?
return <- ?F 'return' (~ expr)? eos
jump <- ?L 'continue' (~ ident)? eos / 'break' ~ ident eos / ?L 'break' eos / ?S 'break' eos
throw <- 'throw' ~ expr eos
try <- 'try' C<block> ('catch' P<bound>? C<block> ('finally' C<block>)? / 'finally' C<block>)
switch <- 'switch' P<expr> +S(C<case*>)
case <- ('case' expr / 'default') ':' caseitem*
caseitem <- !('case' / 'default') statement
label <- ident ':' body
fndecl <- &('async' ~ 'function' '*'? binding / 'function' '*'? binding) function
classdecl <- &('class' binding) class
function <- 'async' ~ 'function' '*' binding? @AFG(P<params?> C<block>) / 'async' ~ 'function' binding? @AF(P<params?> C<block>) / 'function' '*' binding? @FG(P<params?> C<block>) / 'function' binding? @F(P<params?> C<block>)
params <- (param ',')* '...' bound / param (',' param)* ','?
param <- bound ('=' assign)?
class <- 'class' binding? ('extends' call)? C<members>
members <- [UNITS member]
member <- ';' / 'static' @A(C<block>) / 'static' method / method / 'static' property_ ('=' @(assign))? eos / property_ ('=' @(assign))? eos
property_ <- PRIVATE / property
property <- WORD / STR / NUM / B<assign>
method <- 'get' property_ P<empty> @F(C<block>) / 'set' property_ @F(P<param ','?> C<block>) / 'async' ~ '*' property_ @AFG(P<params?> C<block>) / 'async' ~ property_ @AF(P<params?> C<block>) / '*' property_ @FG(P<params?> C<block>) / property_ @F(P<params?> C<block>)
empty <- !(EVERY / P<anything> / B<anything> / C<anything> / T<anything>)
anything <- (P<anything> / B<anything> / C<anything> / T<anything> / EVERY)*
expr <- assign (',' assign)*
assign <- arrow / ?G 'yield' (~ ('*' assign / assign))? / target assignop assign / assignpattern '=' assign / conditional
assignpattern <- B<array> / C<(cover (',' cover)* ','?)?>
cover <- '...' assign / property ':' assign / ident ('=' assign)?
arrow <- 'async' ~ (ident / @AF(P<params?>)) ~ '=>' (@AF(C<block>) / !C<anything> @AF(assign)) / (ident / P<params?>) ~ '=>' (@F(C<block>) / !C<anything> @F(assign))
conditional <- binary ('?' assign ':' assign)?
binary <- operand (binop operand)*
operand <- PRIVATE &'in' / unary
unary <- unop unary / ?A 'await' unary / update
update <- ('++' / '--') target / target ~ ('++' / '--') / call
target <- chain / ident / P<target>
chain <- head (P<args?>* (TPL_ / '.' property_n / B<expr>) )+
property_n <- PRIVATE / WORD
call <- head suffix*
suffix <- '.' property_n / '?.' (P<args?> / B<expr> / property_n) / B<expr> / P<args?> / TPL_
TPL_ <- T<piece*>
piece <- C<expr>
head <- 'new' '.' 'target' / 'new' construct / primary
construct <- 'new' '.' 'target' / 'new' construct / primary ('.' property_n / B<expr> / TPL_)* P<args?>?
args <- arg (',' arg)* ','?
arg <- '...' assign / assign
primary <- 'this' / 'null' / 'true' / 'false' / function / class / ident / NUM / STR / REGEX / TPL_ / B<array> / C<object?> / P<expr> / 'super' &('.' / B<expr> / P<args?>) / 'import' (P<assign ','?> / '.' 'meta')
array <- ','* (arg (','+ arg)* ','*)?
object <- entry (',' entry)* ','?
entry <- '...' assign / objectmethod / property ':' assign / ident
objectmethod <- 'get' property P<empty> @F(C<block>) / 'set' property @F(P<param ','?> C<block>) / 'async' ~ '*' property @AFG(P<params?> C<block>) / 'async' ~ property @AF(P<params?> C<block>) / '*' property @FG(P<params?> C<block>) / property @F(P<params?> C<block>)
"""

RESERVED = "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with implements interface let package private protected public static yield"
CONTEXTUAL = "as async from get meta of set target"
OPERATORS = "{ } ( ) [ ] . ... ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= =>"
SETS = {
    "ident": f"NAME {CONTEXTUAL}",
    "WORD": f"NAME {CONTEXTUAL} {RESERVED}",
    "assignop": "= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=",
    "binop": "< > <= >= == != === !== + - * / % ** << >> >>> & | ^ && || ?? instanceof in",
    "unop": "delete void typeof + - ~ !",
    "EVERY": f"NAME NUM STR REGEX PRIVATE {CONTEXTUAL} {RESERVED} {OPERATORS}",
}

_ID = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|\u200c|\u200d|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_TOKEN = re.compile(
    r"(?P<k>[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+)"
    r"|(?P<l>(?:[\n\u2028\u2029][ \t]*)+|//[^\n\u2028\u2029]*)"
    r"|(?P<c>/\*[\s\S]*?\*/)"
    r"|(?P<w>" + _ID + r")"
    r"|(?P<n>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:0|[1-9]\d*(?:_\d+)*)n|(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)"
    r"|(?P<s>'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\")"
    r"|(?P<p>\#" + _ID + r")"
    r"|(?P<b>[()\[\]{}])"
    r"|(?P<t>`)"
    r"|(?P<o>\?\.(?!\d)|>>>=|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|\.\.\.|=>|\+\+|--|\*\*|<<|>>|&&|\|\||\?\?|[-+*/%&|^<>=!]=|[-+*/%&|^<>=!~?:;,.])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\u2028\u2029]|\\[^\n\u2028\u2029]|\[(?:[^\]\\\n\u2028\u2029]|\\[^\n\u2028\u2029])*\])+/([\w$]*)")
_ESCAPES = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?!(?:[0-9a-fA-F]{4}|\{0*(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4}\}))|[1-9]|0(?=\d))")
_AFTER_VALUE = {"this", "null", "true", "false", "super", *CONTEXTUAL.split()}


def grammar() -> Grammar:
    kinds = f"NAME NUM STR REGEX PRIVATE NL {CONTEXTUAL} {RESERVED} {OPERATORS}"
    return Grammar(GRAMMAR, kinds, SETS, units=";", goes_on="else while catch finally ; . ( , ? : = => ?. + - * / && || ?? in of instanceof < >", skip_lines=True)


def symbols(text: str, g: Grammar, places: dict | None = None) -> str:
    """The text's symbols; places, if given, gets for each group the positions of its symbols."""
    tok = g.tokens
    get, name, num, string, regex, private = tok.get, tok["NAME"], tok["NUM"], tok["STR"], tok["REGEX"], tok["PRIVATE"]
    out: list[str] = []
    at: list[int] = []
    stack: list[tuple] = []
    # whether a '/' starts a regular expression, and the word before an opening bracket
    value, before, closed_head = False, "", False
    pos, n = 0, len(text)
    if text.startswith("\ufeff"):
        pos = 1
    if text.startswith("#!", pos):
        m = re.compile(r"[\n\u2028\u2029]").search(text, pos)
        pos = m.start() if m else n
    scan = _TOKEN.match

    def opened(kind: str, start: int) -> None:
        nonlocal out, at
        stack.append((kind, out, at, start, before))
        out, at = [], []

    def close(kind: str) -> str:
        nonlocal out, at
        symbol = g.intern(kind, "".join(out).rstrip(NEWLINE) if kind != "T" else "".join(out))
        if places is not None:
            places[symbol] = at
        _, out, at, start, word = stack.pop()
        out.append(symbol)
        at.append(start)
        return word

    def template(i: int) -> int:
        """Reads on within a template: to its end, or into a substitution."""
        start = stack[-1][3]
        while True:
            m = re.compile(r"[`\\]|\$\{").search(text, i)
            if not m:
                raise Malformed(start, "template without end")
            c, i = m.group(), m.end()
            if c == "\\":
                i += 1
            elif c == "`":
                close("T")
                return i
            else:
                opened("$", i - 2)
                return i

    while pos < n:
        m = scan(text, pos)
        if m is None:
            raise Malformed(pos, "no token")
        k, start, pos = m.lastgroup, pos, m.end()
        if k == "k":
            continue
        if k == "l":
            if text[start] != "/" and out and out[-1] != NEWLINE:
                out.append(NEWLINE)
                at.append(start)
            continue
        if k == "c":
            if out and out[-1] != NEWLINE and re.search(r"[\n\u2028\u2029]", m.group()):
                out.append(NEWLINE)
                at.append(start)
            continue
        if k == "w":
            x = m.group()
            if "\\" in x:
                plain = re.sub(r"\\u\{?([0-9a-fA-F]+)\}?", lambda q: chr(int(q[1], 16)) if int(q[1], 16) < 0x110000 else " ", x)
                if not plain.replace("$", "a").replace("\u200c", "a").isidentifier() or plain in RESERVED.split():
                    raise Malformed(start, "no identifier")
                x = "\\"
            after_dot = before in (".", "?.")
            out.append(get(x, name) if x not in OPERATORS else name)
            at.append(start)
            value = after_dot or out[-1] == name or x in _AFTER_VALUE
            before = "." if after_dot else x
            if after_dot:
                before = "name"
            nxt = text[pos : pos + 1]
            if nxt == "\\":
                raise Malformed(pos, "no identifier")
            continue
        if k == "o":
            x = m.group()
            if x[0] == "/" and not value:
                r = _REGEX.match(text, start)
                if not r:
                    raise Malformed(start, "regular expression without end")
                pos = r.end()
                if len(set(r[1])) != len(r[1]) or r[1].strip("dgimsuy") or not _pattern_ok(text[start + 1 : r.start(1) - 1], "u" in r[1]):
                    raise Malformed(start, "no regular expression")
                out.append(regex)
                at.append(start)
                value, before = True, "name"
                continue
            out.append(tok[x])
            at.append(start)
            value = x in ("++", "--") and value
            before = x
            continue
        if k == "b":
            x = m.group()
            if x in "([{":
                opened(x, start)
                value, before = False, x
                continue
            top = stack[-1][0] if stack else ""
            if x == "}" and top == "$":
                close("C")
                pos = template(pos)
                if not (stack and stack[-1][0] == "$"):
                    value, before = True, "name"
                else:
                    value, before = False, "{"
                if text[pos - 1] == "`":
                    value, before = True, "name"
                continue
            if {")": "(", "]": "[", "}": "{"}[x] != top:
                raise Malformed(start, "closing bracket without its opening one")
            word = close({"(": "P", "[": "B", "{": "C"}[top])
            value = x == "]" or x == ")" and word not in ("if", "while", "for", "with") or x == "}" and word in ("=", "(", ",", "return", ":", "[", "?", "&&", "||", "??")
            before = x
            continue
        if k == "t":
            opened("`", start)
            pos = template(pos)
            value, before = (True, "name") if text[pos - 1] == "`" else (False, "{")
            continue
        if k == "n":
            if re.compile(r"[\w$\\]").match(text, pos):
                raise Malformed(start, "no number")
            out.append(num)
        elif k == "s":
            x = m.group()
            if "\\" in x and _ESCAPES.search(x.replace("\\\\", "")):
                raise Malformed(start, "no escape")
            out.append(string)
        else:
            out.append(private)
        at.append(start)
        value, before = True, "name"
    if stack:
        raise Malformed(stack[-1][3], "template without end" if stack[-1][0] in "`$" else "bracket without end")
    if places is not None:
        places[""] = at
    return "".join(out).rstrip(NEWLINE)


def _pattern_ok(p: str, unicode_: bool) -> bool:
    """Whether groups and classes of a regular expression pair, and nothing is repeated that can't be."""
    depth, i, in_class, atom = 0, 0, False, False
    while i < len(p):
        c = p[i]
        if c == "\\":
            m = re.compile(r"\\(?:[upP]\{[^}]*\}|k<[^>]*>)").match(p, i)
            i = m.end() if m else i + 2
            atom = True
            continue
        if in_class:
            in_class = c != "]"
            i += 1
            continue
        if c == "[":
            in_class = atom = True
        elif c == "(":
            depth += 1
            m = re.compile(r"\?(?:[:=!]|<[=!]|<[A-Za-z_$][\w$]*>)").match(p, i + 1)
            if p[i + 1 : i + 2] == "?" and not m:
                return False
            i = m.end() - 1 if m else i
            atom = False
        elif c == ")":
            depth -= 1
            atom = True
            if depth < 0:
                return False
        elif c in "*+?":
            if not atom:
                return False
            atom = False
            if p[i + 1 : i + 2] == "?":
                i += 1
        elif c in "|^":
            atom = False
        elif c == "{" and re.compile(r"\{\d+(,\d*)?\}").match(p, i):
            if not atom:
                return False
            i = p.index("}", i)
            atom = False
            if p[i + 1 : i + 2] == "?":
                i += 1
        elif unicode_ and c in "{}]":
            return False
        else:
            atom = c != "$"
        i += 1
    return depth == 0 and not in_class
