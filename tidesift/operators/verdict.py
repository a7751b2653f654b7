"""Cascade and verdicts over findings of any detectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesift.schema import LAYERS, severity_rank
from tidesift.session import small_side

# fixed values: label, score and confidence by the greatest severity, and what is recommended for a label
VERDICTS = {
    4: ("malicious", 0.98, "high"),
    3: ("malicious", 0.85, "high"),
    2: ("suspicious", 0.55, "medium"),
    1: ("suspicious", 0.25, "low"),
    0: ("suspicious", 0.25, "low"),
}
CLEAN = ("clean", 0.0, "high")
RECOMMENDED = {"clean": "install", "malicious": "do_not_install", "suspicious": "review", "error": "review"}
LABEL_RANK = {"clean": 0, "suspicious": 1, "error": 1, "malicious": 2}
FAIL_ON = {"none": 99, "suspicious": 1, "malicious": 2}


def layer_order(layers: Sequence[str] = LAYERS) -> Column:
    """The place of the column layer in a selection; null for others. A layer named twice counts at its first place."""
    place = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    return F.nullif(place, F.lit(0))


def selected_layers(text: str) -> list[str]:
    """The known layers of a comma list, in its order; unknown ones are dropped."""
    return [x for part in text.split(",") if (x := part.strip()) in LAYERS]


def cascade(findings: DataFrame, by: str = "target", layers: Sequence[str] = LAYERS) -> DataFrame:
    """The findings that exist when a target's layers run in order and stop after the first with a critical finding.

    Findings of layers that aren't selected are left out. The first critical layers, one row for each target that has
    any, are aggregated before they are shuffled, so a hot target costs one row per task.
    """
    placed = findings.withColumn("_ord", layer_order(layers)).where("_ord is not null")
    stop = (
        placed.where(severity_rank(F.col("severity")) == 4)
        .groupBy(F.col(by).alias("_by"))
        .agg(F.min("_ord").alias("_stop"))
    )
    kept = placed.join(small_side(stop), placed[by].eqNullSafe(stop["_by"]), "left")
    return kept.where("_stop is null or _ord <= _stop").drop("_ord", "_by", "_stop")


def layers_run(findings: DataFrame, targets: DataFrame, by: str = "target", layers: Sequence[str] = LAYERS) -> DataFrame:
    """by and layers_run: the selected layers up to the first with a critical finding, for every target."""
    placed = findings.withColumn("_ord", layer_order(layers)).where(severity_rank(F.col("severity")) == 4)
    stop = placed.groupBy(by).agg(F.min("_ord").alias("_stop"))
    every = F.array(*map(F.lit, layers))
    return targets.join(stop, by, "left").select(
        by, F.slice(every, F.lit(1), F.coalesce("_stop", F.lit(len(layers))).cast("int")).alias("layers_run")
    )


def verdict_columns(rank: Column) -> list[Column]:
    """label, score, confidence and recommendation from the greatest severity rank, null where there are no findings."""
    columns = []
    for i, name in enumerate(("label", "score", "confidence")):
        column = F.when(rank.isNull(), F.lit(CLEAN[i]))
        for r, values in VERDICTS.items():
            column = column.when(rank == r, F.lit(values[i]))
        columns.append(column.alias(name))
    label = F.when(rank.isNull(), F.lit(CLEAN[0]))
    for r, values in VERDICTS.items():
        label = label.when(rank == r, F.lit(values[0]))
    columns.append(recommendation(label).alias("recommendation"))
    return columns


def recommendation(label: Column) -> Column:
    column = F.when(F.lit(False), F.lit(""))
    for name, what in RECOMMENDED.items():
        column = column.when(label == name, what)
    return column


def verdicts(findings: DataFrame, targets: DataFrame, by: str = "target") -> DataFrame:
    """One row per target of `targets`: label, score, confidence, recommendation, findings_count.

    A target without findings is clean; any finding, info too, makes it suspicious at least. A severity that is none
    counts as a finding of the least kind. Targets of findings that `targets` doesn't have give no row.
    """
    worst = findings.groupBy(by).agg(
        F.max(F.coalesce(severity_rank(F.col("severity")), F.lit(0))).alias("_rank"),
        F.count("*").alias("findings_count"),
    )
    judged = targets.select(by).distinct().join(worst, by, "left")
    return judged.select(by, *verdict_columns(F.col("_rank")), F.coalesce("findings_count", F.lit(0)).alias("findings_count"))


def worst_label(judged: DataFrame, *groups: str) -> DataFrame:
    """The worst label of each group of verdicts, or of all, and how many targets have which."""
    rank = F.when(F.lit(False), 0)
    for label, r in LABEL_RANK.items():
        rank = rank.when(F.col("label") == label, r)
    counts = [F.count(F.when(F.col("label") == x, 1)).alias(f"n_{x}") for x in ("clean", "suspicious", "malicious")]
    worst = F.max(rank)
    label = F.when(worst == 2, "malicious").when(worst == 1, "suspicious").when(worst == 0, "clean")
    return judged.groupBy(*groups).agg(label.alias("worst"), F.count("*").alias("n_targets"), *counts)


def exit_code(label: Column | str, fail_on: str = "malicious") -> Column:
    """0, 1 (suspicious) or 2 (malicious), 0 below what fail_on names."""
    label = F.col(label) if isinstance(label, str) else label
    rank = F.when(F.lit(False), 0)
    for name, r in LABEL_RANK.items():
        rank = rank.when(label == name, r)
    return F.when(rank >= FAIL_ON[fail_on], rank).otherwise(0)
