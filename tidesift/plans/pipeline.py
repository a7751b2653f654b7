"""Whole scans: files or workflows to findings, findings to verdicts."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.operators.deps import advisory_findings, manifest_lines, name_findings, parsed_dependencies
from tidesift.operators.digest import digest_findings
from tidesift.operators.literal import literal_findings
from tidesift.operators.nested import parse_workflows
from tidesift.operators.risk import risk_findings, scored, target_counters
from tidesift.operators.syntax import read_syntax, syntax_findings
from tidesift.operators.url import url_findings
from tidesift.operators.verdict import cascade, layers_run, verdicts
from tidesift.operators.workflow import string_widgets, widget_literal_findings, widget_url_findings
from tidesift.schema import FINDING, LAYERS
from tidesift.session import shared_path
from tidesift.sources.signatures import Signatures
from tidesift.sources.texts import with_text

@dataclass(frozen=True)
class Inputs:
    """What detectors read: the files, their texts, rows of syntax and manifest lines of them, and the signatures."""

    files: DataFrame
    texts: DataFrame
    lines: DataFrame
    signatures: Signatures
    parsed: Future[DataFrame]

    @property
    def rows(self) -> DataFrame:
        """Rows of syntax, a table that is written while detectors that don't ask for it run."""
        return self.parsed.result()


def dependency_findings(x: Inputs) -> DataFrame:
    """Names that are nearly known ones, and what advisories say of the dependencies."""
    deps = parsed_dependencies(x.lines)
    found = name_findings(deps, x.signatures.names)
    return found if x.signatures.advisories is None else found.unionByName(advisory_findings(deps, x.signatures.advisories))


#: A detector of one's own takes the inputs and gives findings.
Detector = Callable[[Inputs], DataFrame]

DETECTORS: dict[str, Detector] = {
    "L0": lambda x: digest_findings(x.files, x.signatures.digests),
    "L1": lambda x: url_findings(x.texts, x.signatures.urls),
    "L2": lambda x: literal_findings(x.texts, x.signatures.patterns),
    "L3": lambda x: syntax_findings(x.rows),
    "L4": dependency_findings,
    "L5": lambda x: risk_findings(scored(target_counters(x.rows, x.files, x.lines))),
}


_WITHOUT_SYNTAX = {"L0", "L1", "L2", "L4"}


@dataclass(frozen=True)
class Scan:
    """findings as they exist after the cascade; verdicts with layers_run, one row per target; when the scan started, and
    how many seconds each layer took for all targets together."""

    findings: DataFrame
    verdicts: DataFrame
    started_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    seconds: Mapping[str, float] = field(default_factory=dict)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, so that what reads them several times computes them once and survives
    the loss of an executor."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def all_findings(
    files: DataFrame,
    signatures: Signatures,
    layers: Sequence[str] = LAYERS,
    detectors: Mapping[str, Detector] = DETECTORS,
    seconds: dict[str, float] | None = None,
) -> DataFrame:
    """The findings of all selected layers together, no cascade applied. Sources are parsed once, for all detectors, which
    run side by side, each into a table of its own. seconds: gets how long each layer took."""
    texts = with_text(files)
    chosen = [x for x in dict.fromkeys(layers) if x in detectors]
    paths = {x: shared_path(files.sparkSession, f"findings-{x}") for x in chosen}

    def run(layer: str, inputs: Inputs) -> None:
        began = time.perf_counter()
        detectors[layer](inputs).write.parquet(paths[layer])
        if seconds is not None:
            seconds[layer] = time.perf_counter() - began

    with ThreadPoolExecutor(len(chosen) + 1) as pool:
        asks = any(x not in _WITHOUT_SYNTAX or detectors[x] is not DETECTORS[x] for x in chosen)
        parsed = pool.submit(stored if asks else lambda df, _: df, read_syntax(texts), "syntax")
        inputs = Inputs(files, texts, manifest_lines(texts), signatures, parsed)
        for done in [pool.submit(run, x, inputs) for x in chosen]:
            done.result()
    return files.sparkSession.read.schema(FINDING).parquet(*paths.values())


def scan(
    files: DataFrame,
    signatures: Signatures,
    layers: Sequence[str] = LAYERS,
    detectors: Mapping[str, Detector] = DETECTORS,
) -> Scan:
    """Scan all targets of a table of files (file_id, target, rel_path, suffix, content, n_bytes) at once.

    Detectors run over all files; the cascade then drops, per target, what would not have run after a critical finding.
    Without any layer every target is clean.
    """
    started, seconds = datetime.now(timezone.utc), {}
    targets = files.select("target").distinct()
    if not any(x in detectors for x in layers):
        none = files.sparkSession.createDataFrame([], FINDING)
        return Scan(none, verdicts(none, targets).join(layers_run(none, targets, layers=layers), "target"))
    found = all_findings(files, signatures, layers, detectors, seconds)
    kept = cascade(found, layers=layers)
    judged = verdicts(kept, targets).join(layers_run(found, targets, layers=layers), "target")
    return Scan(kept, judged, started, seconds)


def scan_workflows(workflows: DataFrame, signatures: Signatures) -> Scan:
    """Scan workflow files (workflow_id, target, source, body). Both detectors always run; a verdict per workflow_id, in
    the column target. A body that isn't a workflow has no findings and no verdict."""
    widgets = string_widgets(workflows)
    source = workflows.select("workflow_id", F.col("workflow_id").cast("string").alias("target"), "source")
    found = widget_url_findings(widgets, signatures.urls, source).unionByName(
        widget_literal_findings(widgets, signatures.patterns, source)
    )
    parsed = parse_workflows(workflows).select(F.col("_id").cast("string").alias("target"))
    return Scan(found, verdicts(found, parsed))
