"""Queries over documents and dependencies: literals, text measures, names and requirement lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesift.functions.text import (
    VCS,
    entropy,
    has_no_vowel,
    is_odd_identifier,
    normal_name,
    requirement,
    requirement_text,
    run_count,
    space_share,
)
from tidesift.operators.deps import near_names
from tidesift.operators.literal import literal_hits
from tidesift.operators.verdict import verdicts
from tidesift.session import spread, table
from tidesift.sources.signatures import PATTERN_SCHEMA

#: Patterns for documents; some lie inside others, and one is in two categories.
PATTERNS = [
    ("dynamic import", "dynamic_import", "medium", "CWE-470"),
    ("import", "info_gathering", "low", "CWE-200"),
    ("pickled model", "unsafe_deserialization", "high", "CWE-502"),
    ("webhook", "exfiltration_channel", "critical", "CWE-200"),
    ("webhook", "network_call", "medium", "CWE-913"),
    ("lookalike identifier", "obfuscation", "high", "CWE-1007"),
    ("hard-wired address", "network_call", "medium", "CWE-913"),
]


def _patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*p, i) for i, p in enumerate(PATTERNS)], PATTERN_SCHEMA)


def document_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = literal_hits(table(spark, sf_dir, "documents"), _patterns(spark), "doc_id")
    return hits.select("doc_id", F.col("line").cast("int").alias("line"), "pattern", "category", "severity", "cwe")


def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdicts(literal_hits(docs, _patterns(spark), "doc_id"), docs, "doc_id")


def document_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.round(entropy(F.col("text")), 6).alias("entropy"))


def document_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(space_share(F.col("text")), 9).alias("space"))


def document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        run_count(text, "[A-Za-z0-9+/=_-]{12,}").cast("bigint").alias("word_runs"),
        run_count(text, "[0-9a-fA-F]{5,}").cast("bigint").alias("hex_runs"),
    )


def document_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").where("text is not null")
    return (
        texts.groupBy(F.sha2("text", 256).alias("sha256"))
        .agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc_id"))
        .where("n_documents > 1")
    )


def odd_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z_]+)"), 1)).alias("word"))
    return (
        words.groupBy("word")
        .agg(F.count("*").alias("n"))
        .select("word", "n", is_odd_identifier(F.col("word")).alias("odd"), has_no_vowel(F.col("word")).alias("no_vowel"))
    )


def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = table(spark, sf_dir, "dependencies").where("name is not null")
    return deps.groupBy(normal_name(F.col("name")).alias("normal")).agg(
        F.count("*").alias("n"), F.count_distinct("name").alias("n_spellings")
    )


def requirement_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "dependencies").select("dep_id", requirement(requirement_text(F.col("name"))).alias("r"))
    return parsed.where("r is not null").select("dep_id", "r.name", "r.version")


def requirement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "dependencies").select("target", requirement_text(F.col("name")).alias("entry"))
    return (
        entries.where("entry is not null")
        .groupBy("target")
        .agg(
            F.count("*").alias("requirements_count"),
            F.count(F.when(F.col("entry").rlike(VCS), 1)).alias("requirements_vcs_count"),
            F.count(F.when(F.col("entry").contains("://"), 1)).alias("requirements_url_count"),
        )
    )


def near_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = table(spark, sf_dir, "dependencies").select(normal_name(F.col("name")).alias("name"))
    return near_names(deps, table(spark, sf_dir, "package_baseline"))


QUERIES = {
    q.__name__: q
    for q in (
        document_literals, document_verdicts, document_entropy, document_space, document_runs, document_copies,
        odd_identifiers, normal_names, requirement_names, requirement_counts, near_dependencies,
    )
}

_VALUES = ", ".join(f"({i}, '{p}', '{c}', '{s}', '{w}')" for i, (p, c, s, w) in enumerate(PATTERNS))
_HITS = f"""
  SELECT doc_id, CAST(i AS INT) AS line, p.pattern, category, severity, cwe
  FROM (SELECT doc_id, string_split(substr(text, 1, 2097152), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
    unnest(range(1, len(lines) + 1)) AS u(i),
    (SELECT pattern, arg_min(category, o) AS category, arg_min(severity, o) AS severity, arg_min(cwe, o) AS cwe
     FROM (VALUES {_VALUES}) AS v(o, pattern, category, severity, cwe) GROUP BY pattern) p
  WHERE contains(lines[i], p.pattern)
"""
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def normal_sql(column: str) -> str:
    return f"regexp_replace(lower({strip_sql(column)}), '[-_.]+', '-', 'g')"


_BARE = strip_sql("split_part(name, '#', 1)")
entry_sql = f"CASE WHEN {_BARE} <> '' AND NOT starts_with({_BARE}, '-') THEN {_BARE} END"
requirement_sql = r"'^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\s*\[[^\]]*\])?\s*(==|>=|<=|!=|~=|<|>)?\s*([A-Za-z0-9._+*-]*)'"

SQL = {
    "document_literals": _HITS,
    "document_verdicts": f"""SELECT d.doc_id,
        CASE WHEN r IS NULL THEN 'clean' WHEN r >= 3 THEN 'malicious' ELSE 'suspicious' END AS label,
        CAST(CASE WHEN r IS NULL THEN 0.0 WHEN r = 4 THEN 0.98 WHEN r = 3 THEN 0.85 WHEN r = 2 THEN 0.55 ELSE 0.25 END AS DOUBLE) AS score,
        CASE WHEN r IS NULL OR r >= 3 THEN 'high' WHEN r = 2 THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN r IS NULL THEN 'install' WHEN r >= 3 THEN 'do_not_install' ELSE 'review' END AS recommendation,
        coalesce(n, 0) AS findings_count
        FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n,
          max(list_position(['info','low','medium','high','critical'], severity) - 1) AS r FROM ({_HITS}) GROUP BY doc_id) h
        ON d.doc_id = h.doc_id""",
    "document_entropy": """WITH c AS (SELECT doc_id, c, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, '')) AS c
          FROM documents) WHERE c <> '' GROUP BY doc_id, c),
        e AS (SELECT doc_id, sum(k) AS n, sum(k * log2(k)) AS s FROM c GROUP BY doc_id)
        SELECT d.doc_id, round(CASE WHEN d.text = '' THEN 0.0 WHEN d.text IS NOT NULL THEN log2(n) - s / n END, 6) AS entropy
        FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id""",
    "document_space": f"""SELECT doc_id, round(CASE WHEN text = '' THEN 1.0 WHEN text IS NOT NULL THEN
        CAST(length(text) - length(regexp_replace(text, '{_SPACE}', '', 'g')) AS DOUBLE) / length(text) END, 9) AS space
        FROM documents""",
    "document_runs": """SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{12,}')) AS word_runs,
        len(regexp_extract_all(text, '[0-9a-fA-F]{5,}')) AS hex_runs FROM documents""",
    "document_copies": """SELECT sha256(text) AS sha256, count(*) AS n_documents, min(doc_id) AS first_doc_id FROM documents
        WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "odd_identifiers": r"""SELECT word, count(*) AS n, regexp_matches(word, '^_+$') OR regexp_matches(word, '^_*[ol01iIO]{2,5}$')
          OR regexp_matches(word, '^_+[^_aeiouyAEIOUY][^aeiouyAEIOUY]{1,2}$') AS odd,
        NOT regexp_matches(lower(word), '[aeiouy]') AS no_vowel
        FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_]+')) AS word FROM documents) GROUP BY word""",
    "normal_names": f"""SELECT {normal_sql('name')} AS normal, count(*) AS n, count(DISTINCT name) AS n_spellings
        FROM dependencies WHERE name IS NOT NULL GROUP BY 1""",
    "requirement_names": f"""WITH e AS (SELECT dep_id, {entry_sql} AS entry FROM dependencies),
        r AS (SELECT dep_id, regexp_extract(entry, {requirement_sql}, 1) AS n, regexp_extract(entry, {requirement_sql}, 2) AS o,
              regexp_extract(entry, {requirement_sql}, 3) AS v FROM e)
        SELECT dep_id, {normal_sql('n')} AS name,
          CASE WHEN o = '==' AND regexp_full_match(v, '[A-Za-z0-9._+-]+') THEN v END AS version FROM r WHERE n <> ''""",
    "requirement_counts": f"""WITH e AS (SELECT target, {entry_sql} AS entry FROM dependencies)
        SELECT target, count(*) AS requirements_count,
          count(*) FILTER (regexp_matches(entry, '^(git|hg|svn|bzr)\\+')) AS requirements_vcs_count,
          count(*) FILTER (contains(entry, '://')) AS requirements_url_count
        FROM e WHERE entry IS NOT NULL GROUP BY target""",
    "near_dependencies": f"""WITH k AS (SELECT DISTINCT {normal_sql('name')} AS near FROM package_baseline),
        n AS (SELECT DISTINCT {normal_sql('name')} AS name FROM dependencies),
        p AS (SELECT name, near, levenshtein(regexp_replace(name, '[^\\x00-\\x7f]', '?', 'g'), near) AS distance FROM n, k
          WHERE length(name) >= 4 AND abs(length(name) - length(near)) <= 2 AND name NOT IN (SELECT near FROM k))
        SELECT name, arg_min(near, (distance, near)) AS near, min(distance) AS distance FROM p WHERE distance <= 2 GROUP BY name""",
}
