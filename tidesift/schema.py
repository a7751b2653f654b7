"""Columns and ordered values that all detectors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: severities from least to most, and the layers in the order in which they run
SEVERITIES = ("info", "low", "medium", "high", "critical")
LAYERS = ("L0", "L1", "L2", "L3", "L4", "L5")

FINDING = (
    "target string, id string, layer string, severity string, category string, title string, file string, line int, "
    "snippet string, explanation string, cwe string, references array<string>"
)
FINDING_COLUMNS = [part.split()[0] for part in FINDING.split(", ")]


def severity_rank(severity: Column) -> Column:
    """0 for info to 4 for critical, whatever the case; null for anything else."""
    order = F.array(*map(F.lit, SEVERITIES))
    return F.nullif(F.array_position(order, F.lower(severity)), F.lit(0)).cast("int") - 1


def severity_of(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank)


def known_severity(severity: Column) -> Column:
    """The severity in lower case, medium where it is none."""
    return F.when(F.lower(severity).isin(*SEVERITIES), F.lower(severity)).otherwise("medium")


def as_findings(
    df: DataFrame,
    layer: str,
    kind: str,
    *,
    severity: Column,
    category: Column,
    title: Column,
    explanation: Column,
    file: Column | None = None,
    line: Column | None = None,
    snippet: Column | None = None,
    cwe: Column | None = None,
    references: Column | None = None,
) -> DataFrame:
    """Rows in the shape of findings. The id is derived from what was found and where, so it is the same on every run
    and needs no counting within a target."""
    text = F.lit(None).cast("string")
    file, snippet, cwe = (text if c is None else c for c in (file, snippet, cwe))
    line = F.lit(None).cast("int") if line is None else line.cast("int")
    references = F.array().cast("array<string>") if references is None else references
    where = F.concat_ws("\x1f", "target", category, title, file, line.cast("string"), snippet)
    return df.select(
        "target",
        F.concat(F.lit(f"{layer}-{kind}-"), F.substring(F.sha2(where, 256), 1, 12)).alias("id"),
        F.lit(layer).alias("layer"),
        severity.alias("severity"),
        category.alias("category"),
        title.alias("title"),
        file.alias("file"),
        line.alias("line"),
        snippet.alias("snippet"),
        explanation.alias("explanation"),
        cwe.alias("cwe"),
        references.alias("references"),
    )
