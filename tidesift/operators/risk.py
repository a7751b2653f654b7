"""Risk per target: counters of what its files hold, and a score over them as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesift.operators.deps import manifest_counts
from tidesift.operators.syntax import COUNTED_DECODERS, DESERIALISERS, IMPORTS, NETWORK, SHELL
from tidesift.schema import as_findings

# fixed values: the columns of counters, by the names that reports use
COUNTERS = (
    "eval_calls", "exec_calls", "compile_calls", "import_dunder_calls", "shell_calls", "deserialization_calls",
    "decoder_calls", "network_calls", "shell_true_count", "exec_with_decoder_count", "dynamic_getattr_count",
    "suspicious_import_count", "total_import_count", "long_base64_string_count", "long_hex_string_count", "py_file_count",
    "total_file_count", "total_loc", "max_file_bytes", "syntax_error_count", "requirements_vcs_count",
    "requirements_url_count", "requirements_count",
)
MEDIUM, HIGH, CRITICAL = 0.35, 0.60, 0.85

# fixed values: signal -> (counter, most, base, per occurrence) of contributions that grow with their counter, in the
# order in which they are added
GROWING = {
    "exec calls": ("exec_calls", 0.25, 0.10, 0.05),
    "eval calls": ("eval_calls", 0.20, 0.08, 0.04),
    "compile calls": ("compile_calls", 0.10, 0.05, 0.02),
    "__import__ calls": ("import_dunder_calls", 0.10, 0.04, 0.02),
    "shell calls": ("shell_calls", 0.20, 0.08, 0.04),
    "shell=True": ("shell_true_count", 0.25, 0.25, 0.0),
    "deserialisation calls": ("deserialization_calls", 0.20, 0.08, 0.04),
    "decoded and evaluated": ("exec_with_decoder_count", 0.35, 0.35, 0.0),
    "suspicious imports": ("suspicious_import_count", {3: 0.15, 1: 0.07}),
    "computed getattr": ("dynamic_getattr_count", {3: 0.10, 1: 0.05}),
    "long base64 runs": ("long_base64_string_count", 0.25, 0.0, 0.08),
    "long hexadecimal runs": ("long_hex_string_count", 0.20, 0.0, 0.06),
    "network calls": ("network_calls", {5: 0.10}),
    "version-control requirements": ("requirements_vcs_count", 0.10, 0.10, 0.0),
    "URL requirements": ("requirements_url_count", 0.10, 0.10, 0.0),
}
DENSITY, DENSE = 5.0, 0.15


def target_counters(rows: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per target of `files` with all COUNTERS. rows: of read_syntax; lines: of manifest_lines.

    Each input is aggregated per target before the three small results are joined; a target without Python files or
    manifests has zeros there.
    """

    def of(kind: str, *names: str) -> Column:
        return F.count(F.when((F.col("kind") == kind) & F.col("name").isin(*names), 1))

    evaluated = (F.col("kind") == "builtin") & F.col("name").isin("eval", "exec") & F.col("argument").isin(*COUNTED_DECODERS)
    shell = (F.col("kind") == "call") & F.col("name").isin(*SHELL) & F.col("name").startswith("subprocess.") & F.col("flag")
    module = F.split("name", r"\.")[0]
    code = rows.groupBy("target").agg(
        of("builtin", "eval").alias("eval_calls"),
        of("builtin", "exec").alias("exec_calls"),
        of("builtin", "compile").alias("compile_calls"),
        of("builtin", "__import__").alias("import_dunder_calls"),
        of("call", *SHELL).alias("shell_calls"),
        of("call", *DESERIALISERS).alias("deserialization_calls"),
        of("call", *COUNTED_DECODERS).alias("decoder_calls"),
        of("call", *NETWORK).alias("network_calls"),
        F.count(F.when(shell, 1)).alias("shell_true_count"),
        F.count(F.when(evaluated, 1)).alias("exec_with_decoder_count"),
        of("getattr", "getattr").alias("dynamic_getattr_count"),
        F.count(F.when((F.col("kind") == "import") & module.isin(*IMPORTS), 1)).alias("suspicious_import_count"),
        F.count(F.when(F.col("kind") == "import", 1)).alias("total_import_count"),
        F.sum("base64_runs").alias("long_base64_string_count"),
        F.sum("hex_runs").alias("long_hex_string_count"),
        F.count(F.when(F.col("kind") == "file", 1)).alias("py_file_count"),
        F.sum("loc").alias("total_loc"),
        F.max("n_bytes").alias("max_file_bytes"),
        F.count(F.when((F.col("kind") == "file") & ~F.col("flag"), 1)).alias("syntax_error_count"),
    )
    every = files.groupBy("target").agg(F.count("*").alias("total_file_count"))
    joined = every.join(code, "target", "left").join(manifest_counts(lines), "target", "left")
    return joined.select("target", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTERS])


def dangerous_calls() -> Column:
    names = ("eval_calls", "exec_calls", "compile_calls", "import_dunder_calls", "shell_calls", "deserialization_calls")
    return sum((F.col(n) for n in names[1:]), F.col(names[0]))


def call_density() -> Column:
    """Dangerous calls per 100 lines; 0 without lines."""
    return F.when(F.col("total_loc") > 0, 100.0 * dangerous_calls() / F.col("total_loc")).otherwise(0.0)


def import_ratio() -> Column:
    return F.when(F.col("total_import_count") > 0, F.col("suspicious_import_count") / F.col("total_import_count")).otherwise(0.0)


def _contributions() -> list[tuple[str, Column, Column]]:
    """(signal, its contribution, its occurrences) in order"""
    out = []
    for signal, (counter, *how) in GROWING.items():
        n = F.col(counter)
        if isinstance(how[0], dict):
            value = F.when(F.lit(False), 0.0)
            for least, worth in how[0].items():
                value = value.when(n >= least, worth)
            value = value.otherwise(0.0)
        else:
            most, base, each = how
            value = F.when(n > 0, F.least(F.lit(most), F.lit(base) + n * each)).otherwise(0.0)
        out.append((signal, value, n.cast("double")))
    out.append(("dense dangerous calls", F.when(call_density() > DENSITY, DENSE).otherwise(0.0), call_density()))
    return out


def scored(counters: DataFrame) -> DataFrame:
    """The counters with dangerous_calls_total, dangerous_call_density, suspicious_import_ratio, score (contributions
    added in order, at most 1) and reasons: the six greatest, in that order, equal ones as they are added."""
    parts = _contributions()
    score = parts[0][1]
    for _, value, _ in parts[1:]:
        score = score + value
    signals = F.array(
        *[
            F.struct(value.alias("worth"), F.lit(i).alias("place"), F.lit(signal).alias("signal"), n.alias("n"))
            for i, (signal, value, n) in enumerate(parts)
        ]
    )
    best = F.sort_array(
        F.transform(
            F.filter(signals, lambda s: s.worth > 0),
            lambda s: F.struct((-s.worth).alias("less"), s.place.alias("place"), s.signal.alias("signal"), s.n.alias("n")),
        )
    )
    reasons = F.transform(
        F.slice(best, 1, 6), lambda s: F.concat(s.signal, F.lit(" ("), F.regexp_replace(F.format_string("%.1f", s.n), r"\.0$", ""), F.lit(")"))
    )
    return counters.select(
        "*",
        dangerous_calls().alias("dangerous_calls_total"),
        call_density().alias("dangerous_call_density"),
        import_ratio().alias("suspicious_import_ratio"),
        F.least(F.lit(1.0), score).alias("score"),
        reasons.alias("reasons"),
    )


def risk_findings(scores: DataFrame) -> DataFrame:
    """A finding per target whose score reaches MEDIUM, with its severity by the score."""
    value = F.col("score")
    return as_findings(
        scores.where(value >= MEDIUM),
        "L5",
        "heuristic",
        severity=F.when(value >= CRITICAL, "critical").when(value >= HIGH, "high").otherwise("medium"),
        category=F.lit("aggregate_risk"),
        title=F.concat(F.lit("Risk score "), F.format_string("%.2f", value)),
        explanation=F.concat(F.lit("Signals, greatest first: "), F.array_join("reasons", "; "), F.lit(".")),
    )
