import ast

import pytest

from tidesift.llm.gll import Grammar
from tidesift.llm.python_grammar import recognise
from tidesift.llm.unparsable import judged_sources, parse_rates, unparsable_files


def test_ambiguous_and_left_recursive_grammar():
    g = Grammar({"s": "s s | 'a' | 'b' [s]", "t": "@1 'a' 'b' | @2 'b' (t)*"}, {"a": "a", "b": "b"}, 3)
    s, t = g.number("s"), g.number("t")
    assert g.recognise([s], "ababa")[0] == {s: 3} and g.recognise([s], "")[0] == {} and g.recognise([s], "abc")[0] == {}
    assert g.recognise([t], "ab")[0] == {t: 1} and g.recognise([t], "bbb")[0] == {t: 2} and g.recognise([t], "bab")[0] == {}


VALID = '''
x
x = y = 1, *z
x: int = yield
(x.y): int
x[1:2, ::3, *a] += 1
del (a), b[0], [c.d]
return *a, b
f(a, *b, c=1, *d, **e)
f(x for x in y)
lambda a, /, b=1, *c, d, **e: (yield)
async def f(a, /, b: int = 1, *, c, **d) -> int: return await x ** -y
with (open(a) as b, c): pass
if (n := 10) > 5: pass
match x:
    case {"a": [1, *_], **r} | A(b, c=-1+2j) if y: pass
    case (a, b) | None: pass
match = case[1] + type
type X[T: int = str, *Ts = *a, **P] = list[T]
try: pass
except* E as e: pass
try: pass
finally: pass
f"{x!r:>{w}} {y=} {'a' + f'{z}'} {{}}"
f"{a["b"]}"
rb"\\xzz" b"y"
0x_f, 1_0.5e-3j, 0o7, 0_0, .5
from . import (a as b, c,)
from ... a.b import *
@a.b[c](d)
class A[T](B, metaclass=C): x: int; y = 1;
for x, *y in *a, b:
  pass
else:
\tpass
print(*a, sep="")
a if b else c if d else lambda: 0
not a in b is not c
[x async for x in y if z if w]
{**a, b: c for_ in d} if 0 else {*a, b}
'''.replace("{**a, b: c for_ in d}", "{**a, b: c}")
INVALID = [
    "x = ", "f() = 1", "x + 1 = 2", "(*a)", "f(a=1, b)", "f(x for x in y, 1)", "f(**a, *b)", "def f(a=1, b): pass", "def f(*, **k): pass", "lambda *: 0", "x := 1", "a b",
    "if x: pass\nelif", "try: pass", "else: pass", "for x in y", "print 'a'", "exec 'a'", "raise E, 'a'", "except E, e: pass", "x = 0777", "1abc", "1__0", "'a' b'b'", "b'é'",
    "'\\x1'", "'\\N{'", "f'{a b}'", "f'{}'", "f'{a'", "f'}'", "'abc", "'''abc", "(a]", "a)", "  x", "if x:\n\ty\n        z", "if x:\n    y\n  z", "import a.b as c.d", "from a import (b", "del f()",
    "with a as f(): pass", "match x:\n    pass", "case x: pass", "class A(: pass", "<<<<<<< HEAD", "a = $", "a ? b", "\0", "x: y: z", "[a]: int", "return x y", "async x", "{a: b, c}", "@a\nx = 1", "﻿x",
]


def _statements():
    block = []
    for line in VALID.strip("\n").split("\n"):
        if block and (line[:1] in " \t" or line.startswith(("except", "finally", "else", "class A"))):
            block.append(line)
        else:
            if block:
                yield "\n".join(block)
            block = [line]
    yield "\n".join(block)


@pytest.mark.parametrize("text", [*_statements(), "", "\n\n# x", "x \\\n + 1", "if x:\n\f    y\n", "if x: pass\n\\\n", VALID])
def test_valid(text):
    try:
        ast.parse(text)
    except SyntaxError:
        pytest.skip("the running Python lacks it")
    assert recognise(text).dialects


@pytest.mark.parametrize("text", INVALID)
def test_invalid(text):
    with pytest.raises((SyntaxError, ValueError)):
        ast.parse(text)
    assert not recognise(text).dialects


def test_dialects():
    assert recognise("try: pass\nexcept* E: pass").dialects == 14
    assert recognise("type X = int").dialects == 12 and recognise("f'{a['b']}'").dialects == 12
    assert recognise("def f[T = int](): pass").dialects == 8 and recognise("x = 1").dialects == 15
    assert recognise("a[*b]\ntype X = 1").dialects == 12


def test_against_the_parser_on_damaged_files():
    import random

    with open(ast.__file__) as f:
        text = f.read()
    random.seed(3)
    for _ in range(150):
        a = random.randrange(len(text) - 400)
        piece = text[a : a + 400]
        b = random.randrange(400)
        piece = piece[piece.find("\n") + 1 :][:b] + random.choice(["", ")", "'", " x", "\n", ":", "=", ","]) + piece[b + random.randrange(3) :]
        try:
            ast.parse(piece)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        assert bool(recognise(piece).dialects) == valid, piece


def test_operator(spark, make_files):
    files = make_files(("a/x", "a.py", "x = (\n"), ("a/x", "b.py", b"x = '\xff'\r\n"), ("a/x", "c.py", ""), ("b/y", "d.py", None), ("b/y", "e.txt", "x = ("), ("b/y", "f.py", "print 'x'\n"), ("b/y", "f.py", "print 'x'\n"), ("b/y", "g.py", "x = [" + "1, " * 60000 + "]"))
    bad = unparsable_files(files)
    assert sorted(r.file_id for r in bad.collect()) == [1, 6, 7]
    rates = {r.target: (r.n_files, r.n_unparsable) for r in parse_rates(judged_sources(files)).collect()}
    assert rates == {"a/x": (3, 1), "b/y": (3, 2)}
    assert unparsable_files(files.limit(0)).count() == 0
