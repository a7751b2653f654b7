"""Python 3.10 to 3.13 as grammars for generalised LL: one for logical lines, one for blocks of lines.

A logical line is a string with one character per token, so equal lines are recognised once. What a line can be (a
simple statement, the head of an `if` with or without a body, ...) is the alphabet of the block grammar. Operator
precedence isn't kept, as it doesn't change which lines are valid.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from tidesift.llm.gll import Grammar

DIALECTS = ("3.10", "3.11", "3.12", "3.13")
ALL, FROM_311, FROM_312, FROM_313 = 15, 14, 12, 8

# fixed values: the keywords and operators of the language
KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global "
    "if import in is lambda nonlocal not or pass raise return try while with yield"
).split()
SOFT = ("match", "case", "type")
OPERATORS = (
    "**= //= >>= <<= ... != == <= >= -> := += -= *= /= %= &= |= ^= @= ** // << >> "
    "( ) [ ] { } , : . ; @ = + - * / % & | ^ ~ < >"
).split()
#: Tokens that aren't spelled: names, numbers (with and without an imaginary part), strings, bytes, and the parts of
#: formatted strings. fs12 opens one that only 3.12 and later allow.
KINDS = "name num imag str bytes fs fs12 f{ f= f! f: f} fe".split()

TERMINALS = {name: chr(0x100 + i) for i, name in enumerate([*KINDS, *KEYWORDS, *SOFT, *OPERATORS])}

_LIST = "{0} (',' {0})* [',']"

LINE = {
    # kinds of lines: a lower-case first letter means that the body, if there is one, is on the same line
    "simple": "small (';' small)* [';']",
    "if_": "'if' named ':'",
    "if_1": "if_ simple",
    "elif_": "'elif' named ':'",
    "elif_1": "elif_ simple",
    "else_": "'else' ':'",
    "else_1": "else_ simple",
    "while_": "'while' named ':'",
    "while_1": "while_ simple",
    "for_": "['async'] 'for' star_targets 'in' star_exprs ':'",
    "for_1": "for_ simple",
    "try_": "'try' ':'",
    "try_1": "try_ simple",
    "except_": "'except' [expr ['as' id]] ':'",
    "except_1": "except_ simple",
    "exceptstar_": f"@{FROM_311} 'except' '*' expr ['as' id] ':'",
    "exceptstar_1": "exceptstar_ simple",
    "finally_": "'finally' ':'",
    "finally_1": "finally_ simple",
    "with_": "['async'] 'with' with_item (',' with_item)* ':' | ['async'] 'with' '(' " + _LIST.format("with_item") + " ')' ':'",
    "with_1": "with_ simple",
    "def_": "['async'] 'def' id [type_params] '(' [params] ')' ['->' expr] ':'",
    "def_1": "def_ simple",
    "class_": "'class' id [type_params] ['(' [args [',']] ')'] ':'",
    "class_1": "class_ simple",
    "match_": "'match' subject ':'",
    "case_": "'case' patterns ['if' named] ':'",
    "case_1": "case_ simple",
    "decorator": "'@' named",
    # simple statements
    "small": (
        "star_exprs | assignment | 'return' [star_exprs] | import | 'raise' [expr ['from' expr]] | 'pass' | 'break' | "
        "'continue' | 'del' " + _LIST.format("del_target") + " | yield | 'assert' expr [',' expr] | "
        f"'global' id (',' id)* | 'nonlocal' id (',' id)* | @{FROM_312} 'type' id [type_params] '=' expr"
    ),
    "assignment": (
        "(star_targets '=')+ value | id ':' expr ['=' value] | '(' single ')' ':' expr ['=' value] | "
        "place ':' expr ['=' value] | single augmented value"
    ),
    "value": "yield | star_exprs",
    "augmented": " | ".join(f"'{x}'" for x in OPERATORS if re.fullmatch(r"[^=!<>:]+=|<<=|>>=", x)),
    "import": (
        "'import' dotted ['as' id] (',' dotted ['as' id])* | 'from' from 'import' '*' | "
        "'from' from 'import' '(' " + _LIST.format("import_as") + " ')' | 'from' from 'import' import_as (',' import_as)*"
    ),
    "import_as": "id ['as' id]",
    "from": "dots dotted | dotted | dots",
    "dots": "('.' | '...')+",
    "dotted": "id ('.' id)*",
    "with_item": "expr ['as' star_target]",
    # targets
    "id": "'name' | 'match' | 'case' | 'type'",
    "place": "atom (trailer)* '.' id | atom (trailer)* '[' slices ']'",
    "single": "id | place | '(' single ')'",
    "target": "id | place | '(' target ')' | '(' [star_tuple] ')' | '[' [star_targets] ']'",
    "star_target": "target | '*' target",
    "star_targets": _LIST.format("star_target"),
    "star_tuple": "star_target ',' [star_targets]",
    "del_target": "id | place | '(' del_target ')' | '(' [del_tuple] ')' | '[' [del_list] ']'",
    "del_list": _LIST.format("del_target"),
    "del_tuple": "del_target ',' [del_list]",
    # expressions
    "star_exprs": _LIST.format("star_expr"),
    "star_expr": "expr | '*' arith",
    "star_named": "named | '*' arith",
    "star_nameds": _LIST.format("star_named"),
    "named": "expr | id ':=' expr",
    "expr": "disj ['if' disj 'else' expr] | 'lambda' [lambda_params] ':' expr",
    "disj": "inv (and_or inv)*",
    "and_or": "'and' | 'or'",
    "inv": "'not' inv | arith (compare arith)*",
    "compare": "'==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not'",
    "arith": "unary (binary unary)*",
    "binary": "'+' | '-' | '*' | '/' | '//' | '%' | '@' | '<<' | '>>' | '&' | '|' | '^' | '**'",
    "unary": "('+' | '-' | '~')* ['await'] atom (trailer)*",
    "trailer": "'.' id | '(' [args [',']] ')' | '(' generator ')' | '[' slices ']'",
    "atom": (
        "id | number | 'True' | 'False' | 'None' | '...' | strings | '(' group ')' | '[' [star_nameds] ']' | "
        "'[' generator ']' | '{' [braces] '}'"
    ),
    "number": "'num' | 'imag'",
    "group": "yield | named | generator | star_named ',' [star_nameds] |",
    "generator": "named clauses",
    "clauses": "(['async'] 'for' star_targets 'in' disj ('if' disj)*)+",
    "braces": "star_nameds | generator | " + _LIST.format("pair") + " | expr ':' expr clauses",
    "pair": "expr ':' expr | '**' arith",
    "yield": "'yield' 'from' expr | 'yield' [star_exprs]",
    "slices": "slice | " + _LIST.format("slice_item"),
    "slice": "[expr] ':' [expr] [':' [expr]] | named",
    "slice_item": f"slice | @{FROM_311} '*' arith",
    "strings": "(text)+ | ('bytes')+",
    "text": f"'str' | 'fs' (field)* 'fe' | @{FROM_312} 'fs12' (field)* 'fe'",
    "field": "'f{' value ['f='] ['f!' id] ['f:' (field)*] 'f}'",
    # calls and parameters
    "args": (
        "positional (',' positional)* (',' keyword)* (',' last)* | keyword (',' keyword)* (',' last)* | last (',' last)*"
    ),
    "positional": "named | '*' expr",
    "keyword": "id '=' expr | '*' expr",
    "last": "id '=' expr | '**' expr",
    **{
        f"{p}params": (
            f"{p}leading [',' {p}starred] [','] | {p}starred [',']"
        )
        for p in ("", "lambda_")
    },
    **{
        f"{p}leading": (
            f"{p}param (',' {p}param)* [',' '/' (',' {p}param)*] (',' {p}default)* | "
            f"{p}param (',' {p}param)* (',' {p}default)+ ',' '/' (',' {p}default)* | "
            f"{p}default (',' {p}default)* [',' '/' (',' {p}default)*]"
        )
        for p in ("", "lambda_")
    },
    **{
        f"{p}starred": (
            f"'*' {p}rest (',' {p}any)* [',' '**' {p}param] | '*' (',' {p}any)+ [',' '**' {p}param] | '**' {p}param"
        )
        for p in ("", "lambda_")
    },
    **{f"{p}any": f"{p}param | {p}default" for p in ("", "lambda_")},
    **{f"{p}default": f"{p}param '=' expr" for p in ("", "lambda_")},
    "param": "id [':' expr]",
    "rest": f"id [':' expr] | @{FROM_311} id ':' '*' arith",
    "lambda_param": "id",
    "lambda_rest": "id",
    "type_params": f"@{FROM_312} '[' " + _LIST.format("type_param") + " ']'",
    "type_param": (
        f"id [':' expr] | '*' id | '**' id | @{FROM_313} id [':' expr] '=' expr | @{FROM_313} '*' id '=' star_expr | "
        f"@{FROM_313} '**' id '=' expr"
    ),
    # patterns
    "subject": "named | star_named ',' [star_nameds]",
    "patterns": "pattern | open",
    "open": "piece ',' [pieces]",
    "pieces": _LIST.format("piece"),
    "piece": "pattern | '*' id",
    "pattern": "closed ('|' closed)* ['as' id]",
    "closed": (
        "literal | dotted | '(' pattern ')' | '(' [open] ')' | '[' [pieces] ']' | '{' [mapping] '}' | "
        "dotted '(' [class_args [',']] ')'"
    ),
    "literal": "['-'] number | ['-'] 'num' sign 'imag' | ('str')+ | ('bytes')+ | 'None' | 'True' | 'False'",
    "sign": "'+' | '-'",
    "mapping": "item (',' item)* [',' '**' id] [','] | '**' id [',']",
    "item": "literal ':' pattern | id '.' dotted ':' pattern",
    "class_args": "pattern (',' pattern)* (',' id '=' pattern)* | id '=' pattern (',' id '=' pattern)*",
}

_KINDS = [k for k in LINE if k == "decorator" or k == "simple" or k.endswith(("_", "_1")) and not k.startswith("lambda")]
_LINE_KIND = {k: chr(0x200 + i) for i, k in enumerate([*_KINDS, "suite", "cases"])}


def _part(kind: str) -> str:
    return f"('{kind}_' 'suite' | '{kind}_1')"


#: The statements of a block. An indented block inside it is one symbol, recognised before it.
BLOCK = {
    "file": "(statement)*",
    "suite": "(statement)+",
    "cases": f"({_part('case')})+",
    "statement": (
        f"'simple' | {_part('if')} ({_part('elif')})* [{_part('else')}] | {_part('while')} [{_part('else')}] | "
        f"{_part('for')} [{_part('else')}] | {_part('with')} | ('decorator')* {_part('def')} | "
        f"('decorator')* {_part('class')} | try | 'match_' 'cases'"
    ),
    "try": (
        f"{_part('try')} ({_part('except')})+ [{_part('else')}] [{_part('finally')}] | "
        f"@{FROM_311} {_part('try')} ({_part('exceptstar')})+ [{_part('else')}] [{_part('finally')}] | "
        f"{_part('try')} {_part('finally')}"
    ),
}

LINE_GRAMMAR = Grammar(LINE, TERMINALS, ALL)
BLOCK_GRAMMAR = Grammar(BLOCK, _LINE_KIND, ALL)
_STARTS = [(LINE_GRAMMAR.number(k), _LINE_KIND[k]) for k in _KINDS]
_FILE, _SUITE, _CASES = (BLOCK_GRAMMAR.number(k) for k in ("file", "suite", "cases"))
_INDENT, _DEDENT = "\x01", "\x02"
#: Lines that end in a simple statement
_OPEN_ENDED = {_LINE_KIND[k] for k in _KINDS if k == "simple" or k.endswith("_1")}

_PLAIN = "[{}]".format("".join(TERMINALS[k] for k in ("name", "num", "str")))
_ROW = f"(?:{_PLAIN}|{TERMINALS[',']})*"
_ITEM = "|".join(
    [
        _PLAIN,
        f"[{TERMINALS['str']}{TERMINALS['num']}]{TERMINALS[':']}{_PLAIN}",
        *(f"{re.escape(TERMINALS[a])}{_ROW}{re.escape(TERMINALS[b])}" for a, b in ("()", "[]")),
    ]
)
#: Equal items of a comma list, each between commas. One stands for all: no rule counts such items.
_RUNS = re.compile(f"(?<={TERMINALS[',']})((?:{_ITEM}){TERMINALS[',']})\\1+")


class _Symbols:
    """One character for each set of (kind, dialects) that a line or a block can be."""

    def __init__(self) -> None:
        self._of: dict[tuple[tuple[str, int], ...], str] = {}
        self.kinds: dict[str, str] = {}
        self.dialects: dict[str, dict[str, int]] = {}

    def __getitem__(self, kinds: tuple[tuple[str, int], ...]) -> str:
        if kinds not in self._of:
            symbol = self._of[kinds] = chr(0x1000 + len(self._of))
            self.kinds[symbol] = "".join(k for k, _ in kinds)
            self.dialects[symbol] = dict(kinds)
        return self._of[kinds]


_SYMBOLS = _Symbols()
_SIMPLE = _SYMBOLS[((_LINE_KIND["simple"], ALL),)]


@lru_cache(maxsize=100_000)
def _kinds(line: str) -> dict[int, int]:
    """{number of a kind of line: the dialects in which the line is one}"""
    return LINE_GRAMMAR.recognise([s for s, _ in _STARTS], _RUNS.sub(r"\1", _RUNS.sub(r"\1", line)))[0]


@lru_cache(maxsize=100_000)
def line_symbol(line: str) -> str:
    """The symbol for what a logical line can be, and in which dialects; '' if it can't be anything. Only a simple
    statement follows a semicolon, so statements are recognised one by one."""
    head, *rest = line.split(TERMINALS[";"])
    if rest and not rest[-1]:
        rest.pop()
    found = _kinds(head)
    simple = ALL
    for statement in rest:
        simple &= _kinds(statement).get(_STARTS[0][0], 0)
    kinds = tuple(
        (symbol, both)
        for s, symbol in _STARTS
        if (both := found.get(s, 0) & (simple if not rest or symbol in _OPEN_ENDED else 0))
    )
    return _SYMBOLS[kinds] if kinds else ""


_MANY_SIMPLE = re.compile(f"{_SIMPLE}{{2,}}")
_INNERMOST = re.compile(f"{_INDENT}([^{_INDENT}{_DEDENT}]*){_DEDENT}")


def _recognise_block(starts: list[int], block: str) -> dict[int, int]:
    kinds, dialects = _SYMBOLS.kinds, _SYMBOLS.dialects
    return BLOCK_GRAMMAR.recognise(starts, [kinds[x] for x in block], [dialects[x] for x in block])[0]


@lru_cache(maxsize=100_000)
def block_symbol(block: str) -> str:
    """The symbol of an indented block whose own blocks are symbols; '' if it is none."""
    found = _recognise_block([_SUITE, _CASES], block)
    kinds = tuple((_LINE_KIND[k], found[s]) for k, s in (("suite", _SUITE), ("cases", _CASES)) if s in found)
    return _SYMBOLS[kinds] if kinds else ""


@lru_cache(maxsize=100_000)
def file_dialects(block: str) -> int:
    """The dialects in which a sequence of lines and blocks is a file."""
    return _recognise_block([_FILE], block).get(_FILE, 0)


def _blocks(lines: str) -> int:
    """The dialects that accept a file given as line symbols and the marks of indents, innermost blocks first. Several
    simple statements in a row are as good as one."""
    lines = _MANY_SIMPLE.sub(_SIMPLE, lines)
    while _INDENT in lines:
        bad = False

        def one(m: re.Match) -> str:
            nonlocal bad
            symbol = block_symbol(m[1])
            bad |= not symbol
            return symbol

        lines = _INNERMOST.sub(one, lines)
        if bad:
            return 0
    return file_dialects(_MANY_SIMPLE.sub(_SIMPLE, lines))


_STRING_START = re.compile(r"([A-Za-z]{0,2})('''|\"\"\"|'|\")")
_BODY = {
    "'''": r"[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''",
    '"""': r'[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"""',
    "'": r"[^'\\\n]*(?:\\.[^'\\\n]*)*'",
    '"': r'[^"\\\n]*(?:\\.[^"\\\n]*)*"',
}
_BODY = {k: re.compile(v, re.S) for k, v in _BODY.items()}
_DIGITS = "[0-9](?:_?[0-9])*"
_TOKEN = re.compile(
    r"(?P<skip>[ \t\f]+|\\\n)|(?P<newline>\n)|(?P<comment>#[^\n]*)"
    r"|(?P<name>[^\W\d]\w*)"
    rf"|(?P<number>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    rf"|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS}|{_DIGITS})(?:[eE][+-]?{_DIGITS})?[jJ]?)"
    rf"|(?P<quote>['\"])|(?P<op>{'|'.join(re.escape(x) for x in OPERATORS)})"
)
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)")
_PREFIXES = {"", "r", "u", "b", "br", "rb", "f", "fr", "rf"}
_BAD_ESCAPE = re.compile(
    r"\\(?:(x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N(?!\{[^{}]+\}))|.)", re.S
)
_BAD_BYTE_ESCAPE = re.compile(r"\\(?:(x(?![0-9a-fA-F]{2}))|.)", re.S)


class Invalid(Exception):
    """No dialect has such a token."""


def _check_escapes(body: str, raw: bool, is_bytes: bool) -> None:
    if is_bytes and not body.isascii():
        raise Invalid("bytes")
    if not raw and "\\" in body and any(m[1] for m in (_BAD_BYTE_ESCAPE if is_bytes else _BAD_ESCAPE).finditer(body)):
        raise Invalid("escape")


def _string(text: str, i: int, out: list[str]) -> int:
    """Append the tokens of the string that starts at i; return where it ends."""
    m = _STRING_START.match(text, i)
    prefix, quote = m[1].lower(), m[2]
    if prefix not in _PREFIXES:
        raise Invalid("prefix")
    if "f" in prefix:
        return _formatted(text, m.end(), quote, "r" in prefix, out)
    end = _BODY[quote].match(text, m.end())
    if not end:
        raise Invalid("unterminated string")
    _check_escapes(text[m.end() : end.end() - len(quote)], "r" in prefix, "b" in prefix)
    out.append(TERMINALS["bytes" if "b" in prefix else "str"])
    return end.end()


def _formatted(text: str, i: int, quote: str, raw: bool, out: list[str]) -> int:
    """As _string, for a formatted string whose quote ends at i."""
    opened = len(out)
    out.append(TERMINALS["fs"])
    end, only_new = _literal(text, i, quote, raw, out, False)
    if only_new:
        out[opened] = TERMINALS["fs12"]
    out.append(TERMINALS["fe"])
    return end + len(quote)


def _literal(text: str, i: int, quote: str, raw: bool, out: list[str], spec: bool) -> tuple[int, bool]:
    """Read literal text and fields up to the closing quote, or in a format specification up to its `}`."""
    n, only_new, since = len(text), False, i
    while True:
        if i >= n:
            raise Invalid("unterminated string")
        c = text[i]
        if text.startswith(quote, i):
            if spec:
                raise Invalid("unterminated field")
            _check_escapes(text[since:i], raw, False)
            return i, only_new
        if c == "\\":
            if not raw and text.startswith("\\N{", i):
                i = text.find("}", i) + 1 or n
            else:
                i += 1 if raw and text[i + 1 : i + 2] in "{}" else 2
        elif c == "\n" and len(quote) == 1:
            raise Invalid("unterminated string")
        elif c == "{" and not (text.startswith("{{", i) and not spec):
            _check_escapes(text[since:i], raw, False)
            i, new = _field(text, i + 1, quote, raw, out)
            only_new |= new
            since = i
        elif c == "}" and spec:
            return i, only_new
        elif c in "{}":
            if not text.startswith(c + c, i):
                raise Invalid("single brace")
            i += 2
        else:
            i += 1


def _field(text: str, i: int, quote: str, raw: bool, out: list[str]) -> tuple[int, bool]:
    """Read a replacement field whose `{` ends at i. True: only 3.12 and later allow it."""
    out.append(TERMINALS["f{"])
    opened, n, start = [], len(text), i
    while True:
        if i >= n:
            raise Invalid("unterminated field")
        c = text[i]
        if not opened and c in "}:!=" and not text.startswith(("!=", "=="), i):
            break
        m = _TOKEN.match(text, i)
        if not m:
            raise Invalid("token")
        i = _token(text, m, out, opened)
    inner = text[start:i]
    new = "\\" in inner or "#" in inner or quote in inner or len(quote) == 1 and "\n" in inner
    if text[i] == "=":
        out.append(TERMINALS["f="])
        i += 1
        while i < n and text[i] in " \t\n":
            i += 1
    if text[i : i + 1] == "!":
        m = re.compile(r"!\s*([^\W\d]\w*)\s*").match(text, i)
        if not m:
            raise Invalid("conversion")
        out += [TERMINALS["f!"], TERMINALS["name"]]
        i = m.end()
    if text[i : i + 1] == ":":
        out.append(TERMINALS["f:"])
        i, nested = _literal(text, i + 1, quote, raw, out, True)
        new |= nested
    if text[i : i + 1] != "}":
        raise Invalid("unterminated field")
    out.append(TERMINALS["f}"])
    return i + 1, new


_PAIRS = {")": "(", "]": "[", "}": "{"}


def _token(text: str, m: re.Match, out: list[str], opened: list[str]) -> int:
    """Append the token of a match (nothing for space, comments and line ends); return where it ends."""
    kind, end = m.lastgroup, m.end()
    if kind == "name":
        word = m[0]
        if end < len(text) and text[end] in "'\"" and len(word) <= 2 and word.lower() in _PREFIXES:
            return _string(text, m.start(), out)
        symbol = TERMINALS.get(word) if word in _WORDS else TERMINALS["name"]
        if not word.isascii() and not word.isidentifier():
            raise Invalid("name")
        out.append(symbol)
    elif kind == "number":
        word = m[0]
        if end < len(text) and (text[end] == "_" or text[end].isalnum()) and not _AFTER_NUMBER.match(text, end):
            raise Invalid("number")
        if word[0] == "0" and word.replace("_", "").isdigit() and word.strip("0_"):
            raise Invalid("number")
        out.append(TERMINALS["imag" if word[-1] in "jJ" else "num"])
    elif kind == "quote":
        return _string(text, m.start(), out)
    elif kind == "op":
        op = m[0]
        if op in "([{":
            opened.append(op)
        elif op in _PAIRS and (not opened or opened.pop() != _PAIRS[op]):
            raise Invalid("bracket")
        out.append(TERMINALS[op])
    elif kind == "skip" and m[0][0] == "\\" and end == len(text):
        raise Invalid("end after a backslash")
    return end


_WORDS, _OPERATORS = {*KEYWORDS, *SOFT}, {*OPERATORS}


def _indent(text: str, i: int) -> tuple[int, int, int]:
    """(where the line's first token or line end is, its column with tabs of 8, and with tabs of 1)"""
    column = narrow = 0
    while i < len(text):
        c = text[i]
        if c == " ":
            column += 1
            narrow += 1
        elif c == "\t":
            column = (column // 8 + 1) * 8
            narrow += 1
        elif c == "\f":
            column = narrow = 0
        else:
            break
        i += 1
    return i, column, narrow


_SPLIT = re.compile(
    r"\n[ \t\f]*|[ \t\f]+|\\\n|#[^\n]*"
    + "".join(rf"|[rRbBuUfF]{{0,2}}{q}{_BODY[q].pattern}" for q in ("'''", '"""', "'", '"'))
    + rf"|[^\W\d]\w*|0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    + rf"|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS}|{_DIGITS})(?:[eE][+-]?{_DIGITS})?[jJ]?"
    + "|" + "|".join(re.escape(x) for x in OPERATORS),
    re.S,
)


class _Tokens(dict):
    """{a token's text: its symbols}, filled as texts come and emptied when large."""

    def __missing__(self, token: str) -> str:
        if token[0] == "\n":
            symbols = token
        elif token[0] in " \t\f\\#":
            symbols = ""
        elif token in _OPERATORS:  # the grammar pairs brackets
            symbols = TERMINALS[token]
        else:
            out: list[str] = []
            if _token(token, _TOKEN.match(token), out, []) != len(token):
                raise Invalid("string")
            symbols = "".join(out)
        if len(token) <= 80:
            if len(self) > 300_000:
                self.clear()
            self[token] = symbols
        return symbols


class _Nesting(dict):
    """{the symbols of a physical line: how many brackets it opens, less those it closes}"""

    def __missing__(self, line: str) -> int:
        net = sum(line.count(TERMINALS[x]) for x in "([{") - sum(line.count(TERMINALS[x]) for x in ")]}")
        if len(self) > 100_000:
            self.clear()
        self[line] = net
        return net


_tokens, _nesting = _Tokens(), _Nesting()

def _accepted(text: str) -> int:
    """The dialects that accept a text, by whole-file splitting; 0 also where only `recognise` can tell."""
    text = "\n" + text
    pieces = _SPLIT.findall(text)
    if sum(map(len, pieces)) != len(text):
        return 0
    try:
        symbols = "".join(map(_tokens.__getitem__, pieces))
    except Invalid:
        return 0
    out: list[str] = []
    columns, depth, before = [""], 0, ""
    for line in symbols.split("\n"):
        if depth:
            before += line.lstrip(" \t\f")
            depth += _nesting[line]
            if depth > 0:
                continue
            bare, before, depth = before, "", 0
        else:
            bare = line.lstrip(" \t\f")
            if not bare:
                continue
            space = line[: len(line) - len(bare)]
            depth = _nesting[line]
            if space != columns[-1]:
                if space.strip(" "):
                    return 0
                if len(space) > len(columns[-1]):
                    columns.append(space)
                    out.append(_INDENT)
                else:
                    while len(space) < len(columns[-1]):
                        columns.pop()
                        out.append(_DEDENT)
                    if space != columns[-1]:
                        return 0
            if depth > 0:
                before = bare
                continue
            depth = 0
        symbol = line_symbol(bare)
        if not symbol:
            return 0
        out.append(symbol)
    if depth:
        return 0
    return _blocks("".join(out) + _DEDENT * (len(columns) - 1))


@dataclass(frozen=True)
class Verdict:
    """dialects: the bits of those that accept the text. If none does, stage says at what it failed, and line where, if
    it failed within a line."""

    dialects: int
    line: int | None = None
    stage: str | None = None


def recognise(text: str) -> Verdict:
    """Whether a text is a valid file, for all dialects together. The empty text is."""
    if "\0" in text:
        return Verdict(0, text.count("\n", 0, text.index("\0")) + 1, "null byte")
    if accepted := _accepted(text):
        return Verdict(accepted)
    n, i = len(text), 0
    lines: list[int] = []
    symbols: list[str] = []
    columns = [(0, 0)]
    try:
        while i < n:
            begin = i
            i, column, narrow = _indent(text, i)
            if i >= n or text[i] in "\n#":
                i = n if (i := text.find("\n", i)) < 0 else i + 1
                continue
            out: list[str] = []
            opened: list[str] = []
            lines.append(begin)
            while i < n:
                m = _TOKEN.match(text, i)
                if not m:
                    raise Invalid("token")
                i = _token(text, m, out, opened)
                if m.lastgroup == "newline" and not opened:
                    break
            if opened:
                raise Invalid("bracket")
            if not out:
                continue
            if (column, narrow) != columns[-1]:
                if column > columns[-1][0] and narrow > columns[-1][1]:
                    columns.append((column, narrow))
                    symbols.append(_INDENT)
                else:
                    while column < columns[-1][0]:
                        columns.pop()
                        symbols.append(_DEDENT)
                    if (column, narrow) != columns[-1]:
                        raise Invalid("indent")
            symbol = line_symbol("".join(out))
            if not symbol:
                raise Invalid("line")
            symbols.append(symbol)
    except Invalid as e:
        return Verdict(0, text.count("\n", 0, lines[-1] if lines else 0) + 1, str(e))
    accepted = _blocks("".join(symbols) + _DEDENT * (len(columns) - 1))
    return Verdict(accepted) if accepted else Verdict(0, None, "block")
