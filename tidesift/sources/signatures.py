"""Signature tables: digests, URLs, names and literal patterns, from files in a folder or built in."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesift.functions.text import normal_name
from tidesift.session import path_exists

#: The environment variable that names the folder of signature files
FOLDER_VARIABLE = "TIDESIFT_SIGNATURES"
# fixed values: the names of signature files
DIGESTS, URLS, NAMES, PATTERNS = "known_malware.jsonl", "malicious_urls.txt", "top_pypi_packages.txt", "patterns.json"
#: A file of advisories beside them, in the place of a live service
ADVISORIES = "advisories.jsonl"
ADVISORY_SCHEMA = "name string, version string, advisory_id string, severity string, has_score boolean, summary string"
DIGEST_SCHEMA = (
    "id string, name string, type string, value string, category array<string>, severity string, first_seen string, "
    "references array<string>, similar_to string"
)
PATTERN_SCHEMA = "pattern string, category string, severity string, cwe string, ordinal int"

# fixed values: literals that are used where no folder of signatures is given
BUILT_IN = {
    ("code_execution", "high", "CWE-95"): ("eval(", "exec(", "__import__(", "compile("),
    ("shell_execution", "high", "CWE-78"): ("os.system(", "os.popen(", "subprocess.", "shell=True", "pty.spawn("),
    ("encoded_payload", "high", "CWE-506"): ("base64.b64decode", "marshal.loads", "zlib.decompress", "pickle.loads", "cloudpickle.loads"),
    ("network_call", "medium", "CWE-913"): ("requests.post(", "urllib.request.urlopen", "socket.socket("),
    ("exfiltration_channel", "critical", "CWE-200"): ("discord.com/api/webhooks", "api.telegram.org/bot", "webhook.site"),
    ("system_credentials", "critical", "CWE-522"): (".ssh/id_rsa", ".aws/credentials", "/etc/shadow"),
    ("persistence", "high", "CWE-506"): ("crontab -", "/etc/rc.local", "CurrentVersion\\\\Run"),
    ("mining", "critical", "CWE-400"): ("stratum+tcp://", "xmrig"),
    ("info_gathering", "low", "CWE-200"): ("platform.node()", "getpass.getuser()"),
}


@dataclass(frozen=True)
class Signatures:
    """digests: sig_id, sig_name, value, category, severity, references, ordinal; urls: url; names: name; patterns: pattern,
    category, severity, cwe, ordinal; advisories: those of ADVISORY_SCHEMA, or none."""

    digests: DataFrame
    urls: DataFrame
    names: DataFrame
    patterns: DataFrame
    advisories: DataFrame | None = None


def signature_folder(given: str | None = None) -> str | None:
    """The folder given, else the one the environment names, else `signatures` here or above; None if there is none."""
    if given or (given := os.environ.get(FOLDER_VARIABLE)):
        return given
    here = Path.cwd()
    return next((str(p / "signatures") for p in (here, *here.parents) if (p / "signatures").is_dir()), None)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digest signatures of a file of JSON lines. Blank lines, `//` lines, broken JSON and other types are skipped, and
    rows without id or value; a missing file is an empty table. ordinal follows the order of the lines."""
    if not path_exists(spark, path):
        return _no_digests(spark)
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("ordinal"))
    rows = lines.where((F.col("line") != "") & ~F.col("line").startswith("//")).select(
        F.from_json("line", DIGEST_SCHEMA).alias("s"), "ordinal"
    )
    return rows.where("s.type in ('exact_hash', 'fuzzy_hash') and s.id is not null and s.value is not null").select(
        F.col("s.id").alias("sig_id"),
        F.coalesce("s.name", F.lit("")).alias("sig_name"),
        "s.value",
        F.coalesce("s.category", F.array().cast("array<string>")).alias("category"),
        F.coalesce("s.severity", F.lit("critical")).alias("severity"),
        F.coalesce("s.references", F.array().cast("array<string>")).alias("references"),
        "ordinal",
    )


def _no_digests(spark: SparkSession) -> DataFrame:
    schema = "sig_id string, sig_name string, value string, category array<string>, severity string, references array<string>, ordinal bigint"
    return spark.createDataFrame([], schema)


def read_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The different lines of a text file; blank ones and those that start with `#` are skipped."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{column} string")
    lines = spark.read.text(path).select(F.trim("value").alias(column))
    return lines.where((F.col(column) != "") & ~F.col(column).startswith("#")).distinct()


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """The different normalised names of a list."""
    return read_list(spark, path, "name").select(normal_name(F.col("name")).alias("name")).distinct()


def pattern_rows(categories: dict[str, dict]) -> list[tuple]:
    """One row per pattern, in the order of the document; severity medium where none is given."""
    rows: list[tuple] = []
    for name, c in categories.items():
        for p in c.get("patterns") or ():
            rows.append((p, name, c.get("severity") or "medium", c.get("cwe"), len(rows)))
    return rows


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """The patterns of a JSON file. Its order decides between categories, so the driver reads it."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], PATTERN_SCHEMA)
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(pattern_rows(json.loads(text).get("categories") or {}), PATTERN_SCHEMA)


def built_in_patterns(spark: SparkSession) -> DataFrame:
    rows = [(p, c, s, w) for (c, s, w), patterns in BUILT_IN.items() for p in patterns]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], PATTERN_SCHEMA)


def read_advisories(spark: SparkSession, path: str) -> DataFrame | None:
    """Advisories of a file of JSON lines: name, version (null: every version), advisory_id, severity, has_score, summary.
    Lines without a name or an id, and broken ones, are skipped; None if there is no file."""
    if not path_exists(spark, path):
        return None
    rows = spark.read.text(path).select(F.from_json("value", ADVISORY_SCHEMA).alias("a")).select("a.*")
    return rows.where("name is not null and advisory_id is not null")


def load_signatures(spark: SparkSession, folder: str | None = None) -> Signatures:
    """All tables of a folder of signature files; without one, the patterns built in and empty tables."""
    folder = signature_folder(folder)
    if folder is None:
        return Signatures(
            _no_digests(spark), spark.createDataFrame([], "url string"), spark.createDataFrame([], "name string"), built_in_patterns(spark)
        )
    return Signatures(
        read_digests(spark, f"{folder}/{DIGESTS}"),
        read_list(spark, f"{folder}/{URLS}", "url"),
        read_names(spark, f"{folder}/{NAMES}"),
        read_patterns(spark, f"{folder}/{PATTERNS}"),
        read_advisories(spark, f"{folder}/{ADVISORIES}"),
    )
