import json
import struct
import zlib

import pytest

from tidesift.sources.config import load_config
from tidesift.sources.png import embedded_workflows, png_texts
from tidesift.sources.signatures import load_signatures, signature_folder
from tidesift.sources.tree import read_tree


def test_tree_keeps_hidden_names_and_prunes_below_the_root(spark, tmp_path):
    root = tmp_path / "venv" / "node"
    for path in ("__init__.py", "_e.py", ".hidden.py", "sub/_u/d.py", "node_modules/x.js", "sub/__pycache__/y.pyc", "a.PY", "noext"):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(path.encode())
    files = {r.rel_path: r for r in read_tree(spark, str(root)).collect()}
    assert set(files) == {"__init__.py", "_e.py", ".hidden.py", "sub/_u/d.py", "a.PY", "noext"}
    assert files["__init__.py"].content == b"__init__.py" and files["__init__.py"].suffix == ".py"
    assert files["a.PY"].suffix == ".PY" and files["noext"].suffix == "" and files["a.PY"].target == "node"
    assert read_tree(spark, str(root / "a.PY")).count() == 6
    (root.parent / ".skipped").mkdir()
    assert {r.target for r in read_tree(spark, str(root.parent), batch=True).select("target").distinct().collect()} == {"node"}
    with pytest.raises(Exception, match="nowhere"):
        read_tree(spark, str(tmp_path / "nowhere")).count()


def test_signatures(spark, tmp_path):
    (tmp_path / "known_malware.jsonl").write_text(
        '// comment\n\n{"id":"S1","name":"n","type":"exact_hash","value":"aa","category":["c"],"references":["r"]}\n{broken\n'
        '{"id":"S2","type":"other","value":"bb"}\n{"id":"S3","type":"fuzzy_hash","value":"cc"}\n'
    )
    (tmp_path / "malicious_urls.txt").write_text("# c\n\n https://x.example \nhttps://x.example\n")
    (tmp_path / "top_pypi_packages.txt").write_text("Foo_Bar\nfoo-bar\n# c\nb\n")
    (tmp_path / "patterns.json").write_text(json.dumps({"categories": {"b": {"patterns": ["x", "y"]}, "a": {"severity": "high", "cwe": "C", "patterns": ["x"]}}}))
    s = load_signatures(spark, str(tmp_path))
    assert {(r.sig_id, r.value, tuple(r.category)) for r in s.digests.collect()} == {("S1", "aa", ("c",)), ("S3", "cc", ())}
    assert [r.url for r in s.urls.collect()] == ["https://x.example"]
    assert sorted(r.name for r in s.names.collect()) == ["b", "foo-bar"]
    assert [tuple(r) for r in s.patterns.orderBy("ordinal").collect()] == [("x", "b", "medium", None, 0), ("y", "b", "medium", None, 1), ("x", "a", "high", "C", 2)]
    empty = load_signatures(spark, str(tmp_path / "none"))
    assert empty.digests.count() == empty.urls.count() == empty.names.count() == empty.patterns.count() == 0


def test_signature_folder(monkeypatch, tmp_path):
    monkeypatch.setenv("TIDESIFT_SIGNATURES", "/x")
    assert signature_folder() == "/x" and signature_folder("/y") == "/y"
    monkeypatch.delenv("TIDESIFT_SIGNATURES")
    (tmp_path / "signatures").mkdir()
    (tmp_path / "sub").mkdir()
    monkeypatch.chdir(tmp_path / "sub")
    assert signature_folder() == str(tmp_path / "signatures")


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    assert load_config().fail_on == "suspicious"
    path = tmp_path / "c.toml"
    path.write_text('[scanner]\ndefault_layers = "0, 2"\nfail_on = "malicious"\n[telemetry]\nenabled = true\n')
    c = load_config(path)
    assert (c.default_layers, c.fail_on, c.telemetry, c.groups["telemetry"]["enabled"]) == ("L0,L2", "malicious", False, False)
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "missing.toml")
    path.write_text('[scanner]\nfail_on = "sometimes"\n')
    with pytest.raises(ValueError):
        load_config(path)


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + b"crc!"


def png(*chunks):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + b"".join(chunks) + chunk(b"IEND", b"")


def test_png(spark, make_files):
    packed = zlib.compress(b'{"b": 2}')
    full = png(
        chunk(b"tEXt", b"prompt\0old"), chunk(b"tEXt", b"prompt\0new"), chunk(b"zTXt", b"z\0\0" + packed),
        chunk(b"iTXt", b"workflow\0\1\0en\0tr\0" + packed), chunk(b"iTXt", b"bad"), chunk(b"iTXt", b"plain\0\0\0\0\0ok"), chunk(b"zTXt", b"broken\0\0zz"),
    )
    assert png_texts(full) == {"prompt": "new", "z": '{"b": 2}', "workflow": '{"b": 2}', "plain": "ok"}
    assert png_texts(b"GIF") is None and png_texts(full[:40]) == {}
    rows = embedded_workflows(make_files(("a", "x.png", full), ("a", "y.PNG", png(chunk(b"tEXt", b"k\0v"))), ("a", "z.png", b"no"), ("a", "n.png", None))).collect()
    got = {r.rel_path: (r.body, r.reason) for r in rows}
    assert got == {"x.png": ('{"b": 2}', None), "y.PNG": (None, "no workflow"), "z.png": (None, "not a png"), "n.png": (None, "not a png")}


def test_png_that_inflates_too_far(spark, make_files, monkeypatch):
    from tidesift.sources import png

    monkeypatch.setattr(png, "MAX_INFLATED", 1000)
    data = b"workflow\0\0" + zlib.compress(b"x" * 5000)
    content = png.SIGNATURE + struct.pack(">I", len(data)) + b"zTXt" + data + b"\0\0\0\0"
    with pytest.raises(png.TooLarge):
        png_texts(content)
    monkeypatch.undo()
    data = b"workflow\0\0" + zlib.compress(b"x" * (png.MAX_INFLATED + 1))
    content = png.SIGNATURE + struct.pack(">I", len(data)) + b"zTXt" + data + b"\0\0\0\0"
    assert [(r.body, r.reason) for r in embedded_workflows(make_files(("a/x", "w.png", content))).collect()] == [(None, "too large")]
