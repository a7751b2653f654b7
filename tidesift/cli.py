"""Command line: scan a folder or a batch of folders, scan a workflow file, list the signatures in use."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidesift import __version__, render
from tidesift.operators.verdict import FAIL_ON, exit_code, selected_layers, worst_label
from tidesift.plans.pipeline import scan, scan_workflows
from tidesift.sources.config import load_config
from tidesift.sources.png import embedded_workflows
from tidesift.sources.signatures import load_signatures
from tidesift.sources.tree import read_tree


def _session() -> SparkSession:
    return SparkSession.builder.appName("tidesift").config("spark.ui.enabled", "false").getOrCreate()


def _exit(spark: SparkSession, label: str, fail_on: str) -> int:
    return spark.range(1).select(exit_code(F.lit(label), fail_on).alias("code")).first().code


def _scan(a: argparse.Namespace) -> int:
    if not os.path.exists(a.target) or a.batch and not os.path.isdir(a.target):
        print(f"no such target: {a.target}", file=sys.stderr)
        return 3
    config = load_config(a.config)
    layers = selected_layers(a.layers if a.layers is not None else config.default_layers)
    fail_on = a.fail_on or config.fail_on
    spark = _session()
    files = read_tree(spark, a.target, a.batch)
    done = scan(files, load_signatures(spark, a.signatures), layers)
    judged = done.verdicts.persist()
    if a.batch:
        worst = worst_label(judged).first()
        if not worst.n_targets:
            print(f"no folders below {a.target}", file=sys.stderr)
            return 0
        lines = (
            (r.json for r in render.batch_json(judged).orderBy("target").toLocalIterator())
            if a.format == "json"
            else render.batch_markdown(judged, worst.worst)
        )
        render.emit(lines)
        return _exit(spark, worst.worst, fail_on)
    row = judged.first()
    if row is None:  # an empty folder is clean
        print("**Verdict:** `clean`, no files")
        return 0
    if a.format == "json":
        render.emit(render.json_report(done.findings, judged, row.target, done.started_at, done.seconds), "")
    else:
        render.emit(render.markdown(done.findings, judged, row.target, done.seconds))
    return _exit(spark, row.label, fail_on)


def _scan_workflow(a: argparse.Namespace) -> int:
    if not os.path.isfile(a.target):
        print(f"no such file: {a.target}", file=sys.stderr)
        return 3
    spark = _session()
    name = os.path.basename(a.target)
    with open(a.target, "rb") as f:
        content = f.read()
    if name.lower().endswith(".png"):
        one = spark.createDataFrame([(1, name, name, ".png", content)], "file_id bigint, target string, rel_path string, suffix string, content binary")
        bodies = embedded_workflows(one).select("body")
    else:
        bodies = spark.createDataFrame([(content.decode("utf-8", "ignore"),)], "body string")
    flows = bodies.select(F.lit(1).cast("bigint").alias("workflow_id"), F.lit(name).alias("target"), F.lit(name).alias("source"), "body")
    done = scan_workflows(flows, load_signatures(spark, a.signatures))
    row = done.verdicts.first()
    if row is None:
        print(f"not a workflow: {a.target}", file=sys.stderr)
        return 3
    if a.format == "json":
        render.emit(render.json_report(done.findings, done.verdicts, row.target, done.started_at), "")
    else:
        render.emit(render.markdown(done.findings, done.verdicts, row.target))
    return _exit(spark, row.label, a.fail_on or load_config(a.config).fail_on)


def _doctor(a: argparse.Namespace) -> int:
    known = load_signatures(_session(), a.signatures)
    for name in ("digests", "urls", "names", "patterns", "advisories"):
        print(f"{name}: {0 if (rows := getattr(known, name)) is None else rows.count()}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("tidesift", description=__doc__)
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(required=True)
    for name, run in (("scan", _scan), ("scan-workflow", _scan_workflow), ("doctor", _doctor)):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--signatures", help="folder of signature files")
        if name != "doctor":
            p.add_argument("target")
            p.add_argument("--format", choices=("json", "markdown"), default="markdown")
            p.add_argument("--fail-on", choices=sorted(FAIL_ON), help="the least verdict that isn't 0; by default what the settings say")
            p.add_argument("--config")
        if name == "scan":
            p.add_argument("--layers", help="comma list, such as L0,L1")
            p.add_argument("--batch", action="store_true", help="each folder below the target is a target")
    a = parser.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
