import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidesift.operators import literal
from tidesift.operators.deps import advisory_findings, manifest_counts, manifest_lines, name_findings, near_names, parsed_dependencies
from tidesift.operators.digest import digest_findings, digest_groups
from tidesift.operators.literal import literal_findings, literal_hits
from tidesift.operators.risk import COUNTERS, risk_findings, scored, target_counters
from tidesift.operators.syntax import entropy, is_mixed, read_syntax, syntax_findings, syntax_rows
from tidesift.operators.url import first_mentions, url_findings, url_mentions
from tidesift.sources.signatures import PATTERN_SCHEMA
from tidesift.sources.texts import decode_text, with_text


def test_digests(spark, make_files):
    files = make_files(("a/x", "f", b"\x00\xff"), ("b/y", "g", b"\x00\xff"), ("b/y", "h", b""), ("c/z", "i", None), ("c/z", "j", "other"))
    value = hashlib.sha256(b"\x00\xff").hexdigest()
    signatures = spark.createDataFrame(
        [("S1", "first", value, ["k"], "low", None, 1), ("S2", "last", value, ["k"], "low", ["r"], 2)],
        "sig_id string, sig_name string, value string, category array<string>, severity string, references array<string>, ordinal bigint",
    )
    found = digest_findings(files, signatures).collect()
    assert sorted((r.target, r.file, r.severity) for r in found) == [("a/x", "f", "critical"), ("b/y", "g", "critical")]
    assert all("S2" in r.title and r.references == ["r"] for r in found)
    assert [(r.n_files, r.n_owners) for r in digest_groups(files).collect()] == [(2, 2)]
    assert digest_findings(files.limit(0), signatures).count() == 0


def test_decoding():
    assert decode_text(b"a\r\nb\rc\xff\xe9d\n") == "a\nb\ncd\n"
    assert decode_text("﻿é".encode()) == "﻿é"


def test_decoding_as_an_expression(spark, make_files):
    r = random.Random(6)
    pieces = [b"a", b"\r", b"\n", b"\r\n", "é".encode(), "→".encode(), "😀".encode(), "\ufffd".encode(), b"\xff", b"\xe9", b"\xe2\x86", b"\xf0\x9f", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\x80", b"\0"]
    contents = [b"", *("".join(map(chr, range(1, 128))).encode(),), *(bytes(r.randrange(256) for _ in range(60)) for _ in range(100))]
    contents += [b"".join(r.choice(pieces) for _ in range(r.randint(1, 12))) for _ in range(300)]
    texts = with_text(make_files(*[("a/x", f"{i}.py", c) for i, c in enumerate(contents)]).repartition(2))
    assert {x.rel_path: x.text for x in texts.collect()} == {f"{i}.py": decode_text(c) for i, c in enumerate(contents)}


def test_urls(spark, make_files):
    text = "see HTTPS://Bad.example/x/ and\nhttps://bad.example/x\nwss://ok.example, 'http://q.example/'\n"
    files = with_text(make_files(("a/x", "b.py", text), ("a/x", "a.md", "https://bad.example/x"), ("a/x", "c.png", text), ("b/y", "n.txt", None)))
    mentions = {(r.url, r.rel_path, r.line, r.n_mentions) for r in first_mentions(url_mentions(files)).collect()}
    assert ("https://bad.example/x", "a.md", 1, 2) in mentions
    assert ("wss://ok.example,", "b.py", 3, 1) in mentions and ("http://q.example/'", "b.py", 3, 1) in mentions
    feed = spark.createDataFrame([("https://BAD.example/x//",), (None,)], "url string")
    found = {(r.snippet, r.file, r.line, r.severity) for r in url_findings(files, feed).collect()}
    assert found == {("https://bad.example/x", "a.md", 1, "high"), ("HTTPS://Bad.example/x/", "b.py", 1, "high")}


def test_near_names_against_all_pairs(spark):
    def distance(a, b):
        rows = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, rows[0] = rows[0], i
            for j, y in enumerate(b, 1):
                last, rows[j] = rows[j], min(rows[j] + 1, rows[j - 1] + 1, last + (x != y))
        return rows[-1]

    r = random.Random(9)
    word = lambda a, b: "".join(r.choice("abé-") for _ in range(r.randint(a, b))).strip("-") or "abab"
    known, typed = {word(1, 8) for _ in range(40)}, {word(3, 9) for _ in range(150)} | {"x" * 5000, "", "abc"}
    known = {"-".join(x for x in k.split("-") if x) for k in known} - {""}
    expected = {}
    for t in typed - known:
        near = min(((distance(t, k), k) for k in known if len(t) >= 4 and abs(len(t) - len(k)) <= 2), default=(9, ""))
        if near[0] <= 2:
            expected[t] = (near[1], near[0])
    names = spark.createDataFrame([(t,) for t in sorted(typed)] * 2 + [(None,)], "name string")
    got = near_names(names, spark.createDataFrame([(k,) for k in sorted(known)], "name string")).collect()
    assert {x.name: (x.near, x.distance) for x in got} == expected and len(got) == len(expected) > 20
    assert near_names(names, names.limit(0)).count() == 0


def test_many_patterns_and_a_stop(spark, make_files, monkeypatch):
    monkeypatch.setattr(literal, "BLOCK_PATTERNS", 70)
    texts = with_text(make_files(("a/x", "b.py", "one p7 two\np150 p1"), ("a/x", "c.py", "p199")))
    patterns = _patterns(spark, *[f"p{i}" for i in range(200)])
    hits = literal_hits(texts, patterns, "file_id").collect()
    assert sorted((x.file_id, x.line, x.pattern) for x in hits) == [(1, 1, "p7"), (1, 2, "p1"), (1, 2, "p15"), (1, 2, "p150"), (2, 1, "p1"), (2, 1, "p19"), (2, 1, "p199")]
    found = literal_findings(texts, patterns, max_characters=12).collect()
    assert sorted((x.file, x.line, x.target) for x in found) == [("b.py", 1, "a/x"), ("c.py", 1, "a/x"), ("c.py", 1, "a/x"), ("c.py", 1, "a/x")]


def _patterns(spark, *names):
    rows = [(p, f"c{i}", "odd" if i == 0 else "high", None, i) for i, p in enumerate(names)]
    return spark.createDataFrame([*rows, (names[0], "later", "low", "CWE-1", 99), ("", "none", "low", None, 100)], PATTERN_SCHEMA)


def test_literals_by_join_and_by_automaton(spark, make_files):
    text = "x\npickle.loads cloudpickle.loads\nloads\n\ncloudpickle.loads cloudpickle.loads" + "\n" + "y" * 5000
    files = make_files(("a/x", "b.py", text), ("a/x", "c.py", ""), ("a/x", "d.py", None))
    texts = with_text(files)
    few = ["pickle.loads", "cloudpickle.loads", "loads", "a.b"]
    expected = {(2, p) for p in few[:3]} | {(3, "loads")} | {(5, p) for p in few[:3]}
    for names in (few, few + [f"unused{i}" for i in range(100)]):
        hits = literal_hits(texts, _patterns(spark, *names), "file_id").collect()
        assert {(r.line, r.pattern) for r in hits} == expected and len(hits) == len(expected)
        assert {(r.category, r.severity) for r in hits if r.pattern == "pickle.loads"} == {("c0", "medium")}
    found = literal_findings(texts, _patterns(spark, *few)).where("line = 3").collect()
    assert [(r.file, r.snippet, r.category) for r in found] == [("b.py", "loads", "c2")]
    many = "".join(f"{'ab' * (i % 5)}\n" for i in range(300)) + "abab"
    texts = with_text(make_files(("a/x", "b.py", many)))
    one = {(r.line, r.pattern) for r in literal_hits(texts, _patterns(spark, "ab", "baba", "abab"), "file_id").collect()}
    names = ["ab", "baba", "abab", *(f"unused{i}" for i in range(100))]
    assert one == {(r.line, r.pattern) for r in literal_hits(texts, _patterns(spark, *names), "file_id").collect()}


SOURCE = '''import pickle, os.path
from ctypes.util import find
import subprocess as sp
eval(base64.b64decode(x).decode())
exec(bytes.fromhex("00"))
exec(codecs.decode(y))
subprocess.run(a, shell=True)
subprocess.run(a, shell=1)
sp.run(a)
getattr(a, "b")
getattr(a, b + c)
z = chr(101) + chr(118) + chr(97) + chr(108)
w = "po" + "p" + "en"
v = "pop" + "en"
json.loads(base64.b64decode(q))
b64decode(base64.b64decode(q))
def lol(_xk, O0): io = 1
class раyload: pass
'''


def test_syntax(spark, make_files):
    rows = read_syntax(with_text(make_files(("a/x", "m.py", SOURCE), ("a/x", "bad.py", "def (:\n"), ("a/x", "nul.py", "a\0b"))))
    found = {(r.line, r.category, r.severity) for r in syntax_findings(rows).collect()}
    assert found == {
        (1, "unsafe_deserialization", "medium"), (2, "native_invocation", "medium"), (4, "code_execution", "critical"),
        (4, "encoded_payload", "medium"), (5, "code_execution", "critical"), (6, "code_execution", "high"), (6, "encoded_payload", "low"),
        (7, "shell_execution", "critical"), (8, "shell_execution", "high"), (11, "dynamic_attribute_access", "medium"),
        (12, "code_obfuscation_chr_chain", "critical"), (13, "code_obfuscation_split_concat", "high"),
        (15, "encoded_payload", "medium"), (15, "code_obfuscation_decoder_chain", "high"), (16, "encoded_payload", "medium"),
        (17, "code_obfuscation_suspicious_ident", "low"), (18, "code_obfuscation_mixed_script", "critical"),
    }
    parses = {r.rel_path: r.flag for r in rows.where("kind = 'file'").collect()}
    assert parses == {"m.py": True, "bad.py": False, "nul.py": False}


def test_syntax_helpers():
    assert entropy("") == 0.0 and entropy("aaaa") == 0.0 and entropy("abcd") == 2.0
    assert is_mixed("pаy") and not is_mixed("pay") and not is_mixed("пау")
    assert [r[1] for r in syntax_rows("x='" + "".join(chr(33 + i) for i in range(10, 58)).replace("\\", "") + "'")] == ["high_entropy"]
    assert any(r[1] == "minified" for r in syntax_rows("a=1;" * 200))
    assert syntax_rows("(" * 5000) is None and syntax_rows("") == []


REQUIREMENTS = "requets==2.0  # c\n-r x\nnumpy\nhttps://e.example/x.whl\ngit+https://e.example/y.git\ntorcch[a]>=1\nabc\npythhorch\r\n"
PYPROJECT = '[project]\nname="p"\ndependencies=["numpyy==1.0", "z @ git+https://e.example/z.git", 3]\n[project.optional-dependencies]\nx=["requests"]\n'


def _manifests(make_files):
    return with_text(
        make_files(
            ("a/x", "requirements.txt", REQUIREMENTS), ("a/x", "sub/pyproject.toml", PYPROJECT), ("a/x", "pyproject.toml", "not = [toml"),
            ("a/x", "dev.requirements.txt", "numpi"), ("a/x", "other.txt", "requets"), ("b/y", "REQUIREMENTS.TXT".lower(), None),
        )
    )


def test_dependencies(spark, make_files):
    lines = manifest_lines(_manifests(make_files))
    deps = parsed_dependencies(lines)
    got = {(r.source_file, r.line, r.name, r.version) for r in deps.collect()}
    assert got == {
        ("requirements.txt", 1, "requets", "2.0"), ("requirements.txt", 3, "numpy", None), ("requirements.txt", 6, "torcch", None),
        ("requirements.txt", 7, "abc", None), ("requirements.txt", 8, "pythhorch", None), ("dev.requirements.txt", 1, "numpi", None),
        ("sub/pyproject.toml", 0, "numpyy", "1.0"), ("sub/pyproject.toml", 0, "z", None), ("sub/pyproject.toml", 0, "requests", None),
    }
    known = spark.createDataFrame([(n,) for n in ("requests", "numpy", "torch", "PyTorch", "abd", None)], "name string")
    found = {(r.snippet, r.severity) for r in name_findings(deps, known).collect()}
    assert found == {("requets", "high"), ("torcch", "high"), ("pythhorch", "medium"), ("numpi", "high"), ("numpyy", "high")}
    counts = manifest_counts(lines).collect()
    assert [(r.target, r.requirements_count, r.requirements_vcs_count, r.requirements_url_count) for r in counts] == [("a/x", 10, 1, 3)]
    ties = near_names(spark.createDataFrame([("abcx",)], "name string"), spark.createDataFrame([("abcz",), ("abcy",)], "name string"))
    assert [tuple(r) for r in ties.collect()] == [("abcx", "abcy", 1)]


def test_advisories(spark):
    deps = spark.createDataFrame([("t", "a", "1.0"), ("t", "a", "1.0"), ("t", "b", None)], "target string, name string, version string")
    advisories = spark.createDataFrame(
        [("A", "1.0", "V-1", "MODERATE", False, "s"), ("a", "2.0", "V-2", None, True, "s"), ("b", None, "V-3", None, True, None)],
        "name string, version string, advisory_id string, severity string, has_score boolean, summary string",
    )
    found = {(r.snippet, r.severity, r.explanation) for r in advisory_findings(deps, advisories).collect()}
    assert found == {("a==1.0", "medium", "s"), ("b", "high", "V-3")}


def test_counters_and_score(spark, make_files):
    files = make_files(("a/x", "m.py", SOURCE + "A" * 120 + "\n"), ("a/x", "n.png", b"\x00"), ("b/y", "readme.md", "hi"))
    texts = with_text(files)
    got = {r.target: r for r in target_counters(read_syntax(texts), files, manifest_lines(texts)).collect()}
    a, b = got["a/x"], got["b/y"]
    assert (a.eval_calls, a.exec_calls, a.shell_calls, a.shell_true_count, a.exec_with_decoder_count) == (1, 2, 2, 1, 1)
    assert (a.decoder_calls, a.dynamic_getattr_count, a.suspicious_import_count, a.total_import_count) == (4, 1, 2, 4)
    assert (a.long_base64_string_count, a.long_hex_string_count, a.py_file_count, a.total_file_count) == (1, 1, 1, 2)
    assert b.total_loc == 0 and b.total_file_count == 1
    zero = dict.fromkeys(COUNTERS, 0) | {"target": "z"}
    rows = [zero, zero | {"target": "e", "exec_calls": 1, "total_loc": 100}, zero | {"target": "m", "exec_calls": 9, "eval_calls": 9, "shell_true_count": 1, "total_loc": 10},
            zero | {"target": "x", "exec_with_decoder_count": 1, "suspicious_import_count": 3, "network_calls": 5, "requirements_vcs_count": 2, "exec_calls": 3, "long_hex_string_count": 9, "eval_calls": 2, "total_loc": 1}]
    df = spark.createDataFrame(rows, ", ".join(["target string", *(f"{c} bigint" for c in COUNTERS)]))
    scores = scored(df)
    got = {r.target: (round(r.score, 9), r.reasons) for r in scores.collect()}
    assert got["z"] == (0.0, []) and got["e"] == (0.15, ["exec calls (1)"])
    assert got["m"][0] == 0.85 and got["m"][1][:2] == ["exec calls (9)", "shell=True (1)"]
    assert got["x"][0] == 1.0 and len(got["x"][1]) == 6 and got["x"][1][0] == "decoded and evaluated (1)"
    assert {(r.target, r.severity) for r in risk_findings(scores).collect()} == {("m", "critical"), ("x", "critical")}
    assert scores.where(F.col("dangerous_call_density") > 100).count() == 2


@pytest.mark.parametrize("more", [0, 100])  # joined to lines, and searched with an automaton
def test_literals_after_padding(spark, more):
    text = "x" * 1000 + "\n"
    texts = spark.createDataFrame([(1, text * 2200 + "late eval(x)\n"), (2, "y" * 2_200_000 + "eval(")], "k bigint, text string")
    rows = [("eval(", "code", "high", "CWE-95", 0)] + [(f"none{i}", "other", "low", "CWE-1", i + 1) for i in range(more)]
    patterns = spark.createDataFrame(rows, "pattern string, category string, severity string, cwe string, ordinal int")
    assert sorted((r.k, r.line, r.pattern) for r in literal_hits(texts, patterns, "k").select("k", "line", "pattern").collect()) == [(1, 2201, "eval("), (2, 1, "eval(")]
