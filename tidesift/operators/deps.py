"""Declared dependencies: from manifests, and against names and advisories that are known."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesift.functions.text import VCS, lines_of, normal_name, requirement, requirement_text, stripped
from tidesift.schema import as_findings, known_severity
from tidesift.session import ship_package, small_side

NEAREST, SHORTEST = 2, 4


def _name() -> Column:
    return F.lower(F.element_at(F.split("rel_path", "/"), -1))


def _toml_dependencies(texts: DataFrame) -> DataFrame:
    """target, source_file and entry for each dependency of a pyproject.toml that can be read, the optional ones too."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tomllib

        for batch in batches:
            rows: list[tuple] = []
            for target, path, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    project = tomllib.loads(text).get("project")
                except (tomllib.TOMLDecodeError, RecursionError):
                    continue
                if not isinstance(project, dict):
                    continue
                named, extra = project.get("dependencies"), project.get("optional-dependencies")
                groups = [named, *(extra.values() if isinstance(extra, dict) else ())]
                rows += [(target, path, e) for g in groups if isinstance(g, list) for e in g if isinstance(e, str)]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["target", "source_file", "entry"])

    manifests = texts.where((_name() == "pyproject.toml") & F.col("text").isNotNull())
    return manifests.select("target", "rel_path", "text").mapInArrow(run, "target string, source_file string, entry string")


def manifest_lines(texts: DataFrame) -> DataFrame:
    """target, source_file, line (0 for pyproject.toml), entry and strict (from a file named exactly requirements.txt, or
    pyproject.toml) of everything that manifests declare. Comments, blank lines and options are left out."""
    name = _name()
    lists = texts.where((name == "requirements.txt") | name.endswith(".requirements.txt"))
    lines = lists.select(
        "target", F.col("rel_path").alias("source_file"), (name == "requirements.txt").alias("strict"), F.posexplode(lines_of(F.col("text")))
    ).select("target", "source_file", (F.col("pos") + 1).alias("line"), requirement_text(F.col("col")).alias("entry"), "strict")
    tables = _toml_dependencies(texts).select("target", "source_file", F.lit(0).alias("line"), "entry", F.lit(True).alias("strict"))
    return lines.where("entry is not null").unionByName(tables)


def parsed_dependencies(lines: DataFrame) -> DataFrame:
    """target, source_file, line, name (normalised), version (only where pinned with ==). Entries of requirements files
    that are URLs or version-control addresses are skipped; those of pyproject.toml are read up to their name."""
    address = F.col("entry").contains("://") | F.col("entry").rlike(VCS)
    marked = stripped(F.regexp_replace("entry", "(?s);.*$", ""))
    return (
        lines.where((F.col("line") == 0) | ~address)
        .select("target", "source_file", "line", requirement(marked).alias("_r"))
        .where("_r is not null")
        .select("target", "source_file", "line", "_r.name", "_r.version")
    )


def manifest_counts(lines: DataFrame) -> DataFrame:
    """Per target: requirements_count, requirements_vcs_count, requirements_url_count."""
    return (
        lines.where("strict")
        .groupBy("target")
        .agg(
            F.count("*").alias("requirements_count"),
            F.count(F.when(F.col("entry").rlike(VCS), 1)).alias("requirements_vcs_count"),
            F.count(F.when(F.col("entry").contains("://"), 1)).alias("requirements_url_count"),
        )
    )


def _shortened(name: Column) -> Column:
    """Hashes of a name and of what is left of it without one or NEAREST of its letters."""

    def without(s: Column) -> Column:
        letters = F.sequence(F.lit(1), F.length(s))
        return F.when(F.length(s) > 0, F.transform(letters, lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))).otherwise(
            F.array(s)
        )

    every = F.array(name)
    last = every
    for _ in range(NEAREST):
        last = F.array_distinct(F.flatten(F.transform(last, without)))
        every = F.concat(every, last)
    return F.array_distinct(F.transform(every, lambda s: F.xxhash64(s)))


def near_names(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """name, near and distance: for each different name that isn't known itself and has SHORTEST characters, the nearest
    known name within NEAREST edits, the first by alphabet among equally near ones.

    Names within NEAREST edits have a common form with at most so many letters left out of each. Both sides are joined
    on these forms, so a name meets only known names that may be near, and no form is common; distances are then
    computed for each pair once.
    """
    reference = known.select(normal_name(F.col("name")).alias("near")).where("near <> ''").distinct()
    longest = reference.agg(F.max(F.length("near"))).first()[0] or 0
    typed = names.select(F.col(name).alias("_n")).where(F.length("_n").between(SHORTEST, longest + NEAREST)).distinct()
    typed = typed.join(small_side(reference), F.col("_n") == F.col("near"), "left_anti")
    forms = reference.select("near", F.explode(_shortened(F.col("near"))).alias("_form"))
    pairs = typed.select("_n", F.explode(_shortened(F.col("_n"))).alias("_form")).join(small_side(forms), "_form").select("_n", "near").distinct()
    return (
        pairs.withColumn("distance", F.levenshtein(F.col("_n"), F.col("near"), NEAREST))
        .where("distance > 0")
        .groupBy(F.col("_n").alias(name))
        .agg(F.min(F.struct("distance", "near")).alias("_m"))
        .select(name, "_m.near", "_m.distance")
    )


def name_findings(deps: DataFrame, known: DataFrame) -> DataFrame:
    """A finding per declared dependency whose name is nearly a known one: high at one edit, medium at two."""
    near = near_names(deps, known)
    hits = deps.join(small_side(near), "name")
    return as_findings(
        hits,
        "L4",
        "typo",
        severity=F.when(F.col("distance") == 1, "high").otherwise("medium"),
        category=F.lit("typosquatting"),
        title=F.concat(F.lit("`"), "name", F.lit("` is nearly `"), "near", F.lit("`")),
        file=F.col("source_file"),
        line=F.col("line"),
        snippet=F.col("name"),
        explanation=F.concat(F.lit("It is "), F.col("distance").cast("string"), F.lit(" edits away from a known package.")),
        cwe=F.lit("CWE-1357"),
    )


def advisory_severity(severity: Column, has_score: Column) -> Column:
    """The severity an advisory names (MODERATE is medium); high where it only has a score, medium where it has neither."""
    named = F.lower(severity)
    return (
        F.when(named == "moderate", "medium")
        .when(named.isin("low", "medium", "high", "critical"), named)
        .when(has_score, "high")
        .otherwise("medium")
    )


def advisory_findings(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """A finding per different (name, version) of a target and advisory for it. advisories: name, version (null: every
    version), advisory_id, severity, has_score, summary. A live service is replaced by this table."""
    asked = deps.select("target", "name", "version").distinct()
    known = advisories.select(
        normal_name(F.col("name")).alias("name"),
        F.col("version").alias("_v"),
        "advisory_id",
        advisory_severity(F.col("severity"), F.coalesce("has_score", F.lit(False))).alias("_severity"),
        "summary",
    )
    hits = asked.join(small_side(known), "name").where("_v is null or _v = version")
    what = F.concat("name", F.coalesce(F.concat(F.lit("=="), "version"), F.lit("")))
    return as_findings(
        hits,
        "L4",
        "osv",
        severity=known_severity(F.col("_severity")),
        category=F.lit("known_vulnerability"),
        title=F.concat("advisory_id", F.lit(" applies to `"), what, F.lit("`")),
        snippet=what,
        explanation=F.substring(F.coalesce("summary", "advisory_id"), 1, 300),
        references=F.array(F.concat(F.lit("https://osv.dev/vulnerability/"), "advisory_id")),
    )
