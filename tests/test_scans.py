import hashlib
import json

import pytest

from tidesift import cli, render
from tidesift.operators.workflow import string_widgets, widget_text, widget_urls
from tidesift.plans.pipeline import DETECTORS, scan, scan_workflows
from tidesift.sources.signatures import Signatures, built_in_patterns, load_signatures

LOADER = "import os\nexec(base64.b64decode(x))\n"


@pytest.fixture(scope="module")
def signatures(spark):
    value = hashlib.sha256(b"known").hexdigest()
    digests = spark.createDataFrame(
        [("S", "n", value, ["k"], "low", None, 1)],
        "sig_id string, sig_name string, value string, category array<string>, severity string, references array<string>, ordinal bigint",
    )
    return Signatures(
        digests, spark.createDataFrame([("https://bad.example/x",)], "url string"), spark.createDataFrame([("requests",)], "name string"), built_in_patterns(spark)
    )


def test_scan_all_targets(spark, make_files, signatures):
    files = make_files(
        ("o/clean", "__init__.py", "def add(first, second):\n    return first + second\n"), ("o/clean", "requirements.txt", "requests\n"),
        ("o/known", "f.bin", b"known"), ("o/known", "a.py", LOADER), ("o/loader", "a.py", LOADER),
        ("o/typo", "requirements.txt", "requets\n"), ("o/url", "a.md", "see https://bad.example/x/\n"),
    )
    done = scan(files, signatures)
    got = {r.target: (r.label, r.layers_run[-1]) for r in done.verdicts.collect()}
    assert got == {"o/clean": ("clean", "L5"), "o/known": ("malicious", "L0"), "o/loader": ("malicious", "L3"), "o/typo": ("malicious", "L5"), "o/url": ("malicious", "L5")}
    assert {r.layer for r in done.findings.where("target = 'o/known'").collect()} == {"L0"}
    assert {r.layer for r in done.findings.where("target = 'o/loader'").collect()} == {"L2", "L3"}
    only = scan(files, signatures, ["L4"])
    assert {r.target for r in only.findings.collect()} == {"o/typo"}
    assert {r.label for r in scan(files, signatures, []).verdicts.collect()} == {"clean"}
    own = {"L0": lambda x: DETECTORS["L0"](x).limit(0)}
    assert scan(files, signatures, ["L0"], own).findings.count() == 0
    text = "\n".join(render.markdown(done.findings, done.verdicts, "o/loader", done.seconds))
    assert text.startswith("# o/loader: malicious\n") and "critical, code_execution, CWE-95" in text and "don't install it" in text and "(L0 " in text
    report = json.loads("".join(render.json_report(done.findings, done.verdicts, "o/typo", done.started_at, done.seconds)))
    assert set(report["scan"]["layer_duration_ms"]) == {"L0", "L1", "L2", "L3", "L4", "L5"} and report["scan"]["duration_ms"] > 0
    assert report["scan"]["started_at"].startswith("20")
    assert report["verdict"]["label"] == "malicious" and report["findings"][0]["category"] == "typosquatting"
    lines = render.report_lines(done.findings, done.verdicts).collect()
    assert sum(r.part == 0 for r in lines) == 5 and all(json.loads(r.json) for r in lines)


UI = {"nodes": [{"id": 4, "type": "Http", "widgets_values": ["get https://bad.example/x.", 3, ["https://n.example"], None]}, {"id": 5, "type": "D", "widgets_values": {"k": "v"}}, "skip", {"type": "E"}]}
PROMPT = {"9": {"class_type": "Run", "inputs": {"code": "os.system('x')\nos.system('y')", "n": 1}}, "10": {"class_type": "N"}}


def test_workflows(spark, signatures):
    flows = spark.createDataFrame(
        [(1, "t", "u.json", json.dumps(UI)), (2, "t", "p.json", json.dumps(PROMPT)), (3, "t", "bad", "{"), (4, "t", "c", '{"nodes": []}'), (5, None, None, None)],
        "workflow_id bigint, target string, source string, body string",
    )
    widgets = string_widgets(flows)
    got = {(r.workflow_id, r.node_id, r.idx, r.value) for r in widgets.collect()}
    assert got == {(1, "4", 0, "get https://bad.example/x."), (1, "5", 0, "k"), (2, "9", -1, "os.system('x')\nos.system('y')")}
    assert [r.url for r in widget_urls(widgets).collect()] == ["https://bad.example/x"]
    assert {r.text for r in widget_text(widgets).where("workflow_id = 2").collect()} == {"os.system('x')\nos.system('y')"}
    done = scan_workflows(flows, signatures)
    assert {(r.target, r.layer, r.severity, r.category) for r in done.findings.collect()} == {("1", "WL1", "critical", "malicious_url_in_widget"), ("2", "WL2", "high", "shell_execution")}
    assert {r.target: r.label for r in done.verdicts.collect()} == {"1": "malicious", "2": "malicious", "4": "clean"}


def test_command_line(spark, tmp_path, capfd, monkeypatch):
    monkeypatch.setattr(cli, "load_signatures", lambda s, f: load_signatures(s, str(tmp_path / "signatures")))
    monkeypatch.setattr(cli, "_session", lambda: spark)
    (tmp_path / "signatures").mkdir()
    for name, text in (("good", "value = 1\n"), ("bad", LOADER)):
        (tmp_path / "all" / name).mkdir(parents=True)
        (tmp_path / "all" / name / "__init__.py").write_text(text)
    assert cli.main(["scan", str(tmp_path / "all" / "good")]) == 0
    assert "# good: clean" in capfd.readouterr().out
    assert cli.main(["scan", str(tmp_path / "all" / "bad"), "--format", "json", "--layers", "L3"]) == 2
    assert json.loads(capfd.readouterr().out)["verdict"]["label"] == "malicious"
    assert cli.main(["scan", str(tmp_path / "all"), "--batch", "--fail-on", "none"]) == 0
    out = capfd.readouterr().out
    assert "| good | clean |" in out and "The worst of these is malicious." in out
    (tmp_path / "settings.toml").write_text('[scanner]\nfail_on = "none"\n')
    assert cli.main(["scan", str(tmp_path / "all" / "bad"), "--config", str(tmp_path / "settings.toml")]) == 0
    assert cli.main(["scan", str(tmp_path / "all" / "bad"), "--config", str(tmp_path / "settings.toml"), "--fail-on", "malicious"]) == 2
    capfd.readouterr()
    assert cli.main(["scan", str(tmp_path / "missing")]) == 3
    flow = tmp_path / "w.json"
    flow.write_text(json.dumps(UI))
    assert cli.main(["scan-workflow", str(flow)]) == 0
    flow.write_text("{")
    assert cli.main(["scan-workflow", str(flow)]) == 3
    assert cli.main(["doctor"]) == 0 and "patterns: 0" in capfd.readouterr().out


def test_advisories(spark, make_files, tmp_path):
    lines = [
        {"name": "Foo_Lib", "version": "1.2", "advisory_id": "A-1", "severity": "MODERATE", "summary": "s"},
        {"name": "foo-lib", "version": None, "advisory_id": "A-2", "has_score": True},
        {"name": "bar", "version": "9", "advisory_id": "A-3", "severity": "low"},
        {"name": None, "advisory_id": "A-4"},
    ]
    (tmp_path / "advisories.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    known = load_signatures(spark, str(tmp_path))
    files = make_files(("o/a", "requirements.txt", "foo.lib==1.2\nbar==8\nfoo.lib==1.2\n"), ("o/b", "x/requirements.txt", "foo-lib>=1\n"), ("o/c", "a.py", "x = 1\n"))
    found = scan(files, known, ["L4"]).findings
    assert sorted((r.target, r.severity, r.snippet, r.references[0][-3:]) for r in found.collect()) == [
        ("o/a", "high", "foo-lib==1.2", "A-2"), ("o/a", "medium", "foo-lib==1.2", "A-1"), ("o/b", "high", "foo-lib", "A-2"),
    ]


def test_scratch_tables_are_dropped(spark, make_files, signatures):
    import os

    from tidesift.session import _scratch, drop_scratch

    assert scan(make_files(("o/a", "a.py", LOADER)), signatures, ["L3"]).verdicts.count() == 1
    paths = [p.removeprefix("file://") for p in _scratch]
    assert paths and any(map(os.path.exists, paths))
    drop_scratch(spark)
    assert not any(map(os.path.exists, paths)) and not _scratch
