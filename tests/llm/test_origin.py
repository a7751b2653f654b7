import random
import re

import pytest
from pyspark.sql import functions as F

from tidesift.llm.origin import (
    Likeness, _digest, _follows, band_keys, data_share, file_layout, foreign_files, head_kind, judged_files, layout_kind, shingles,
)

OWN = '"""Generated images are written to the output folder."""\nimport os\n\nHEADER = "# AUTO-GENERATED FILE, DO NOT EDIT"\n\n\ndef first(value):\n    """Do not edit the mask in place; make a copy."""\n    return value + 1\n'
GENERATED = "".join(f"def op_x_{i:04d}(ctx):\n    return ctx.call({i})\n\n" for i in range(30))
MINIFIED = "import os,sys;" + "".join(f"a{i}=lambda x:x+{i};b=[c for c in d if c];" for i in range(60)) + "\n"
R = random.Random(1)
BLOB = 'import math\n\nLUT = "' + "".join(R.choice("abcdefXYZ0123456789+/") for _ in range(3000)) + '"\n'
NUMBERS = "DATA = [\n" + "".join("    " + ", ".join(str(R.randrange(256)) for _ in range(16)) + ",\n" for _ in range(60)) + "]\n"
TABLE = OWN + "PALETTE = [\n" + "".join(f"    ({R.randrange(9)}, {R.randrange(9)}),\n" for _ in range(8)) + "]\n"


@pytest.mark.parametrize(
    "text, suffix, kind",
    [
        (OWN, ".py", None), (TABLE, ".py", None), (GENERATED, ".py", "generated"), (MINIFIED, ".py", "minified"), (BLOB, ".py", "data_blob"), (NUMBERS, ".py", "data_blob"), ("", ".py", None),
        ("!function(e,t){" + "var a=b?c:!0;for(let i=0;i<x;i++)y+=x[i];" * 60 + "}", ".js", "minified"), (f'export default "{BLOB[20:2000]}";\n', ".js", "data_blob"),
        ("".join(f'export const x_{i:03d} = {{ id: {i}, kind: "{R.choice("ab")}" }};\n' for i in range(40)), ".js", "generated"), ("function a(b) {\n  return b;\n}\n" * 20, ".js", None),
    ],
)
def test_layout(text, suffix, kind):
    assert layout_kind(text, suffix)[0] == kind


@pytest.mark.parametrize("head, kind", [
    ("# @generated\n", "generated"), ("# Code generated by xgen 1.2. DO NOT EDIT.\n", "generated"), ('"""\nGenerated from x.proto at build time, do not modify by hand\n"""\n', "generated"), ("# Automatisch erzeugt, nicht von Hand ändern.\n", "generated"),
    ("# Fichier généré par l'exporteur X\n", "generated"), ("# source: a/b.idl  rev 3\n", "generated"), ("# Copied from foolib 1.2 (upstream commit abc)\n", "vendored"), ("# taken over unchanged from the foolib distribution\n", "vendored"),
    ("# bundled copy, upstream: https://x.example/foolib  tag v1\n", "vendored"), ("# Copyright (c) 2024 owner\n# SPDX-License-Identifier: MIT\n", None), ("# part of owner nodes, keep in sync with README\n", None), ("# Compatible with minified graphs too.\n", None),
    ('"""Strip the third_party prefix from a node name."""\n', None), ('"""Parse the header of an auto-generated preset file."""\n', None), ("", None),
])
def test_heads(head, kind):
    assert head_kind(head + "\nx = 1\n", ".py")[0] == kind


def test_data_share():
    assert data_share([]) == 0.0 and data_share(["1, 2, 3"]) == 1.0 and data_share(["value = other(1)"]) == 0.0
    assert data_share(["None, 1,", "b'ab', 'c'", "Nonesuch = 2"]) == (8 + 10) / 30


@pytest.mark.parametrize("statement, joint, suffix", [("a{0}=b({0})", ",", ".js"), ("a{0}=b({0})", ";", ".js"), ("s{0}.t(u,\"x y\")", "&&", ".js"), ("a{0}=lambda x:x+{0}", ";", ".py")])
def test_minified_however_joined(statement, joint, suffix):
    text = joint.join(statement.format(i) for i in range(500))
    kind, stats = layout_kind(text, suffix)
    assert kind == "minified" and stats["max_line"] == len(text)


def test_long_strings_are_not_minified():
    prompt = 'PROMPT = "' + "one more remark on it, " * 40 + '"\n'
    icon = 'ICON = "' + "".join(R.choice("abcdefXYZ0123456789+/") for _ in range(300)) + '"\n'
    assert layout_kind(OWN + prompt, ".py")[0] is None and layout_kind(OWN * 6 + icon, ".py")[0] is None
    assert layout_kind("const D=[" + ",".join(str(R.randrange(999)) for _ in range(400)) + "];", ".js")[0] == "data_blob"


@pytest.mark.parametrize("a", ["0", "7", "9", "09", "19", "99", "199", "0999", "1" * 30, "9" * 30, "29", "10"])
def test_numbers_that_follow(a):
    for b in {str(int(a) + k) for k in (0, 1, 2, 10)} | {str(int(a) + 1).zfill(len(a)), a, "0" + a}:
        assert _follows(a, b) == (b == str(int(a) + 1).zfill(len(a))), (a, b)


def source(seed, n=12):
    r = random.Random(seed)
    word = lambda: r.choice("mask frame node cache image tile graph batch seed queue".split()) + str(r.randrange(50))
    return "".join(f"def {word()}({word()}):\n    {word()} = {word()}[{r.randrange(99)}]\n    return {word()}\n\n\n" for _ in range(n))


def test_likeness_against_sets():
    like = Likeness()
    base = source(1).split("\n")
    for changed in (0, 1, 3, 8, 20):
        other = [f"changed{i} = {i}" if i % 45 < changed else x for i, x in enumerate(base)]
        sets = []
        for text in ("\n".join(base), "\n".join(other)):
            words = re.findall(r"\w+", text)
            sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
            assert len(shingles(text, like)) == len(sets[-1])
        x, y = (set(shingles(t, like).tolist()) for t in ("\n".join(base), "\n".join(other)))
        assert len(x & y) == len(sets[0] & sets[1])
        shared = set(band_keys(shingles("\n".join(base), like), like)) & set(band_keys(shingles("\n".join(other), like), like))
        assert shared or len(x & y) < 0.8 * len(x | y)
    assert len(shingles("one two", like)) == 0


def test_operator(spark, make_files):
    library, own, long = source(2), source(3), source(4, 30)
    head = "# Copied from foolib 1.2 (upstream commit abc)\n"
    rows = [
        ("owner/a", "x.py", OWN, None), ("owner/a", "gen.py", GENERATED, "generated"), ("owner/a", "gen.py", GENERATED, "generated"), ("owner/a", "vendors/y.py", own, None), ("owner/b", "y.py", own, None),
        ("owner/a", "third_party/foolib/core.py", OWN, "vendored"), ("owner/a", "core/six.py", library, "vendored"), ("other/b", "bs4/__init__.py", head + library.replace("mask1", "mask2"), "vendored"),
        ("third/c", "nodes/core.py", "# changed\n" + library + "# PATCH 1\nx = 1\n", "vendored"), ("foolib/d", "nodes/main.py", "# Copyright 2020 The foolib developers\n" + library, None), ("owner/a", "empty.py", "", None), ("other/b", "empty.py", "", None),
        ("owner/a", "null.js", None, None), ("owner/a", "vendor/null.js", None, "vendored"), ("owner/a", "t.txt", BLOB, 0), ("owner/a", "lut.py", BLOB, "data_blob"), (None, "z.py", long, None), ("one/e", "lone.py", head + own.replace("mask", "bell"), "vendored"),
    ]
    files = make_files(*[r[:3] for r in rows]).withColumn("kind", F.lit("x")).withColumn("owner", F.lit(1))
    judged = {r.file_id: r.kind for r in judged_files(files).collect()}
    assert judged == {i: r[3] for i, r in enumerate(rows, 1) if r[3] != 0}
    got = sorted((r.file_id, r.kind) for r in foreign_files(files).collect())
    assert got == [(i, r[3]) for i, r in enumerate(rows, 1) if r[3]]
    assert file_layout(files).count() == sum(1 for r in rows if r[2] is not None and r[1] != "t.txt")
    assert foreign_files(files.limit(0)).count() == 0


def test_carried_texts_against_all_pairs(spark, make_files):
    """Texts of several owners, changed here and there, against a comparison of all pairs."""
    r, like, rows = random.Random(8), Likeness(), []
    for i in range(60):
        lines = source(100 + i % 12).split("\n")
        for _ in range(r.choice((0, 0, 1, 4, 12, 30))):
            lines[r.randrange(len(lines))] = f"other{r.randrange(1000)} = {r.randrange(1000)}"
        rows.append((f"o{r.randrange(4)}/t", f"f{i}.py", "\n".join(lines)))
    sets = [set(shingles(x[2], like).tolist()) for x in rows]
    expected = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if rows[i][0] != rows[j][0] and len(a & b) >= 0.8 * len(a | b):
                expected.add(i + 1)
    got = {x.file_id for x in foreign_files(make_files(*rows)).collect()}
    assert got <= expected and len(got) >= 0.9 * len(expected) > 10


def test_carried_texts_among_unlike_ones_of_one_origin(spark, make_files):
    """Pairs of near copies that share each band with texts of the least owner that aren't alike to any: all pairs count."""
    r, like, rows = random.Random(3), Likeness(), []
    base = source(500, 30).split("\n")
    least, *owners = sorted((f"o{i}" for i in range(20)), key=lambda x: _digest(x)[0])
    for i in range(130):
        lines = [f"own{r.randrange(1000)} = {r.randrange(1000)}" if r.random() < 0.03 else x for x in base]
        for owner in (least,) if i < 100 else r.sample(owners, 2):
            lines = list(lines)
            lines[r.randrange(len(lines))] = f"other{r.randrange(1000)} = {r.randrange(1000)}"
            rows.append((f"{owner}/t", f"f{len(rows)}.py", "\n".join(lines)))
    lone = source(501)
    rows += [("one/t", "a.py", lone), ("two/t", "b.py", lone), ("two/t", "c.py", source(502))]
    sets = [set(shingles(x[2], like).tolist()) for x in rows]
    expected = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if rows[i][0] != rows[j][0] and len(a & b) >= 0.8 * len(a | b):
                expected.add(i + 1)
    assert 60 <= len(expected) < len(rows) - 30
    assert {x.file_id for x in foreign_files(make_files(*rows)).collect()} == expected
