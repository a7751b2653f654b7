"""Reports of scans as JSON and Markdown."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidesift import __version__
from tidesift.schema import FINDING_COLUMNS

SCHEMA_VERSION = "1.0"
ADVICE = {"install": "may be installed", "review": "look at it first", "do_not_install": "don't install it"}


def report_lines(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Reports as a table of JSON lines: target, part (0: the verdict, 1: a finding) and json. Written out, they are the
    report of all targets without any target's findings being gathered in one row."""
    head = verdicts.select(
        "target",
        F.lit(0).alias("part"),
        F.to_json(
            F.struct(
                F.lit(SCHEMA_VERSION).alias("schema_version"),
                F.struct(F.lit("tidesift").alias("name"), F.lit(__version__).alias("version")).alias("scanner"),
                F.struct("target", *[c for c in ("layers_run",) if c in verdicts.columns]).alias("scan"),
                F.struct("label", "score", "confidence").alias("verdict"),
                "recommendation",
                "findings_count",
            )
        ).alias("json"),
    )
    columns = [c for c in FINDING_COLUMNS if c != "target"]
    return head.unionByName(
        findings.select("target", F.lit(1).alias("part"), F.to_json(F.struct(*columns)).alias("json"))
    )


def _finding(n: int, r: Row) -> Iterator[str]:
    place = "" if not r.file else f" in `{r.file}`" if r.line is None else f" in `{r.file}`, line {r.line}"
    yield f"{n}. {r.title}{place}"
    yield f"   - {r.severity}, {r.category}" + (f", {r.cwe}" if r.cwe else "") + f" (`{r.id}`)"
    yield f"   - {r.explanation}"
    for line in (r.snippet or "").splitlines():
        yield f"   > {line}"
    for x in r.references or ():
        yield f"   - see {x}"


def _took(seconds: Mapping[str, float]) -> str:
    return ", ".join(f"{layer} {s:.1f} s" for layer, s in seconds.items())


def markdown(findings: DataFrame, verdicts: DataFrame, target: str, seconds: Mapping[str, float] | None = None) -> Iterator[str]:
    """The report of one target, line by line; its findings are fetched one after another, not all at once. A section per
    layer, the findings numbered through. seconds: how long each layer took."""
    v = verdicts.where(F.col("target") == target).first()
    if v is None:
        raise LookupError(target)
    yield from (f"# {target}: {v.label}", "")
    yield f"Score {v.score:.2f} with {v.confidence} confidence: {ADVICE[v.recommendation]}."
    if "layers_run" in verdicts.columns:
        yield f"tidesift {__version__} ran {', '.join(v.layers_run) or 'no layer'}" + (f" ({_took(seconds)})." if seconds else ".")
    yield ""
    if not v.findings_count:
        yield "There are no findings."
    layer = None
    ordered = findings.where(F.col("target") == target).orderBy("layer", "file", "line", "id")
    for n, r in enumerate(ordered.toLocalIterator(), 1):
        if r.layer != layer:
            layer = r.layer
            yield from (f"## Layer {layer}", "")
        yield from _finding(n, r)


def json_report(
    findings: DataFrame,
    verdicts: DataFrame,
    target: str,
    started_at: datetime | None = None,
    seconds: Mapping[str, float] | None = None,
) -> Iterator[str]:
    """The report of one target as one JSON document, in pieces. With seconds it says how long each layer took, and all."""
    v = verdicts.where(F.col("target") == target).first()
    if v is None:
        raise LookupError(target)
    scan = {"target": target, "layers_run": list(v.layers_run) if "layers_run" in verdicts.columns else []}
    if started_at is not None:
        scan["started_at"] = started_at.isoformat()
    if seconds is not None:
        ms = {layer: round(1000 * s) for layer, s in seconds.items()}
        scan |= {"duration_ms": sum(ms.values()), "layer_duration_ms": ms}
    head = {
        "schema_version": SCHEMA_VERSION,
        "scanner": {"name": "tidesift", "version": __version__},
        "scan": scan,
        "verdict": {"label": v.label, "score": v.score, "confidence": v.confidence},
        "recommendation": v.recommendation,
    }
    yield json.dumps(head, ensure_ascii=False)[:-1] + ', "findings": ['
    comma = ""
    for r in findings.where(F.col("target") == target).orderBy("layer", "file", "line", "id").toLocalIterator():
        yield comma + json.dumps({k: x for k, x in r.asDict().items() if k != "target"}, ensure_ascii=False)
        comma = ", "
    yield "]}"


def batch_json(verdicts: DataFrame) -> DataFrame:
    """One JSON object per target: node, verdict, recommendation, findings_count."""
    verdict = F.struct("label", "score", "confidence").alias("verdict")
    return verdicts.select("target", F.to_json(F.struct(F.col("target").alias("node"), verdict, "recommendation", "findings_count")).alias("json"))


def batch_markdown(verdicts: DataFrame, worst: str | None) -> Iterator[str]:
    """What is the worst of all, and a table with a row per target."""
    yield from (f"The worst of these is {worst or 'clean'}.", "", "| target | label | score | findings | advice |", "|:---|:---|---:|---:|:---|")
    for r in verdicts.orderBy("target").toLocalIterator():
        yield f"| {r.target} | {r.label} | {r.score:.2f} | {r.findings_count} | {ADVICE[r.recommendation]} |"


def emit(lines: Iterator[str], end: str = "\n") -> None:
    """Write lines to the standard output, as UTF-8 bytes where it isn't a terminal."""
    raw = getattr(sys.stdout, "buffer", None)
    for line in lines:
        if raw is not None and not sys.stdout.isatty():
            raw.write((line + end).encode("utf-8"))
        else:
            sys.stdout.write(line + end)
    (raw or sys.stdout).flush()
