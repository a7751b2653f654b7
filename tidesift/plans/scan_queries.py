"""Queries that run the detectors over plug-in files and workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesift.functions.text import normal_name, requirement, requirement_text
from tidesift.operators.deps import advisory_findings, manifest_lines, name_findings, parsed_dependencies
from tidesift.operators.digest import digest_findings, digest_groups
from tidesift.operators.literal import literal_findings
from tidesift.operators.risk import COUNTERS, DENSE, DENSITY, GROWING, risk_findings, scored, target_counters
from tidesift.operators.syntax import read_syntax, syntax_findings
from tidesift.operators.url import first_mentions, url_findings, url_mentions
from tidesift.operators.workflow import (
    root_nodes,
    string_widgets,
    widget_literal_hits,
    widget_text,
    widget_urls,
)
from tidesift.plans.finding_queries import JUDGED as _JUDGED
from tidesift.plans.pipeline import scan, scan_workflows
from tidesift.plans.text_queries import entry_sql, normal_sql as _normal, requirement_sql as _REQ, strip_sql as _strip
from tidesift.session import small_side, table
from tidesift.sources.png import embedded_workflows
from tidesift.sources.signatures import BUILT_IN, PATTERN_SCHEMA, Signatures, built_in_patterns
from tidesift.sources.texts import with_text


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "plugin_files")


def _shared_digests(files: DataFrame) -> DataFrame:
    """Signatures from the data: files that were delivered more than once."""
    shared = digest_groups(files.where("n_bytes > 0"))
    return shared.select(
        F.concat(F.lit("SIG-"), "first_file_id").alias("sig_id"),
        F.lit("delivered again").alias("sig_name"),
        F.col("sha256").alias("value"),
        F.array(F.lit("shared")).alias("category"),
        F.lit("low").alias("severity"),
        F.array().cast("array<string>").alias("references"),
        F.col("first_file_id").alias("ordinal"),
    )


def _shared_urls(texts: DataFrame) -> DataFrame:
    """A feed from the data: URLs that Markdown files mention."""
    return url_mentions(texts.where("suffix = '.md'")).select("url").distinct()


def _signatures(spark: SparkSession, sf_dir: str, files: DataFrame) -> Signatures:
    return Signatures(
        _shared_digests(files), _shared_urls(with_text(files)), table(spark, sf_dir, "package_baseline").select("name"), built_in_patterns(spark)
    )


def l0_digest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_groups(_files(spark, sf_dir))


def l0_digest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return digest_findings(files, _shared_digests(files)).select("target", "file", "severity", "category", "layer")


def l1_url_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_mentions(url_mentions(with_text(_files(spark, sf_dir))))


def l1_url_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = with_text(_files(spark, sf_dir))
    return url_findings(texts, _shared_urls(texts)).select("target", "file", "line", "severity", "snippet")


def l2_literal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = literal_findings(with_text(_files(spark, sf_dir)), built_in_patterns(spark))
    pattern = F.regexp_extract("explanation", r"`(.*)`", 1)
    return found.select("target", "file", "line", "category", "severity", pattern.alias("pattern"), "snippet", "cwe")


def l2_name_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that name packages of the baseline: too many patterns for a join by substring."""
    names = table(spark, sf_dir, "package_baseline").select(
        F.col("name").alias("pattern"), F.lit("package_name").alias("category"), F.lit("info").alias("severity"),
        F.lit(None).cast("string").alias("cwe"), F.col("pkg_id").cast("int").alias("ordinal"),
    )
    found = literal_findings(with_text(_files(spark, sf_dir)), names)
    return found.groupBy("target", "file", "line", "title", "severity", "snippet").agg(F.count("*").alias("n"))


def l3_syntax_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_findings(read_syntax(with_text(_files(spark, sf_dir))))


#: Pieces of source: the text, the findings expected of it (line, category, severity, cwe), and the counters that it raises
PIECES: list[tuple[str, list[tuple[int, str, str, str | None]], dict[str, int]]] = [
    ("y = eval(x)\n", [(1, "code_execution", "high", "CWE-95")], {"eval_calls": 1}),
    (
        "\nexec(base64.b64decode(x).decode())\n",
        [(2, "code_execution", "critical", "CWE-95"), (2, "encoded_payload", "medium", "CWE-506")],
        {"exec_calls": 1, "decoder_calls": 1, "exec_with_decoder_count": 1},
    ),
    ("subprocess.run(c, shell=True)\n", [(1, "shell_execution", "critical", "CWE-78")], {"shell_calls": 1, "shell_true_count": 1}),
    ("subprocess.run(c, shell=s)\nos.system(c)\n", [(1, "shell_execution", "high", "CWE-78"), (2, "shell_execution", "high", "CWE-78")], {"shell_calls": 2}),
    (
        "import pickle, ctypes.util\n",
        [(1, "unsafe_deserialization", "medium", None), (1, "native_invocation", "medium", None)],
        {"suspicious_import_count": 2, "total_import_count": 2},
    ),
    ("import json\nfrom marshal import loads\n", [(2, "unsafe_deserialization", "medium", None)], {"suspicious_import_count": 1, "total_import_count": 2}),
    ("getattr(o, n)\ngetattr(o, 'n')\n", [(1, "dynamic_attribute_access", "medium", "CWE-470")], {"dynamic_getattr_count": 1}),
    ("z = chr(101) + chr(118) + chr(97) + chr(108)\n", [(1, "code_obfuscation_chr_chain", "critical", "CWE-506")], {}),
    ("z = 'ev' + 'a' + 'l'\nw = 'ev' + 'al'\n", [(1, "code_obfuscation_split_concat", "high", "CWE-506")], {}),
    ("z = 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnop0123456789'\n", [(1, "code_obfuscation_high_entropy", "medium", "CWE-506")], {}),
    ("def ll(a):\n    return a\n\n\n_ = 1\n", [(1, "code_obfuscation_suspicious_ident", "low", "CWE-1109"), (5, "code_obfuscation_suspicious_ident", "low", "CWE-1109")], {}),
    ("p\u0430yload = 1\n", [(1, "code_obfuscation_mixed_script", "critical", "CWE-1007")], {}),
    (
        "zlib.decompress(base64.b64decode(x))\n",
        [(1, "code_obfuscation_decoder_chain", "high", "CWE-506"), (1, "encoded_payload", "medium", "CWE-506")],
        {"decoder_calls": 1},
    ),
    ("a=[" + "1," * 200 + "1]", [(1, "code_obfuscation_minified", "medium", "CWE-506")], {}),
    ("z = (\n", [], {"syntax_error_count": 1}),
    (
        "compile(s, f, 'exec')\n__import__(m)\n",
        [(1, "code_execution", "medium", "CWE-95"), (2, "dynamic_import", "medium", "CWE-470")],
        {"compile_calls": 1, "import_dunder_calls": 1},
    ),
    ("pickle.loads(x)\nsp.run(c)\n", [(1, "unsafe_deserialization", "high", "CWE-502")], {"deserialization_calls": 1}),
    ("codecs.decode(x, 'hex')\nrequests.get(u)\n", [(1, "encoded_payload", "low", "CWE-506")], {"decoder_calls": 1, "network_calls": 1}),
    ("z = '" + "ab" * 60 + "'\n", [], {"long_base64_string_count": 1, "long_hex_string_count": 1}),
    ("", [], {}),
]
_PIECE_COUNTERS = sorted({c for _, _, counts in PIECES for c in counts})


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each dependency, with the piece that its number stands for."""
    texts = F.array(*[F.lit(text) for text, _, _ in PIECES])
    deps = table(spark, sf_dir, "dependencies").select("dep_id", "target")
    return deps.select(
        F.col("dep_id").alias("file_id"), "target", F.concat(F.col("dep_id").cast("string"), F.lit(".py")).alias("rel_path"), F.lit(".py").alias("suffix"),
        F.get(texts, (F.col("dep_id") % len(PIECES)).cast("int")).cast("binary").alias("content"), F.lit(None).cast("bigint").alias("n_bytes"),
    )


def piece_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of syntax find in pieces of source."""
    found = syntax_findings(read_syntax(with_text(_pieces(spark, sf_dir))))
    return found.select("target", "file", "line", "category", "severity", "cwe", "layer")


def piece_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of risk over pieces of source."""
    files = _pieces(spark, sf_dir)
    texts = with_text(files)
    counted = target_counters(read_syntax(texts), files, manifest_lines(texts))
    return counted.select("target", "py_file_count", "total_file_count", "total_loc", "max_file_bytes", *_PIECE_COUNTERS)


def l4_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_dependencies(manifest_lines(with_text(_files(spark, sf_dir))))


def l4_name_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = parsed_dependencies(manifest_lines(with_text(_files(spark, sf_dir))))
    return name_findings(deps, table(spark, sf_dir, "package_baseline"))


def dependency_name_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed dependencies whose names are nearly those of the baseline."""
    deps = table(spark, sf_dir, "dependencies").select("target", "source_file", "line", normal_name(F.col("name")).alias("name"))
    found = name_findings(deps, table(spark, sf_dir, "package_baseline"))
    return found.select("target", "file", "line", "severity", "title", "snippet")


def dependency_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed requirements that advisories apply to. The advisories are made from the baseline: one for each version that a
    dependency of that name is pinned to, and one for all versions of names with a hyphen."""
    base = table(spark, sf_dir, "package_baseline").select("pkg_id", "name")
    parsed = table(spark, sf_dir, "dependencies").select("target", requirement(requirement_text(F.col("name"))).alias("_r"))
    deps = parsed.where("_r is not null").select("target", "_r.name", "_r.version")
    pinned = deps.where("version is not null").select("name", "version").distinct().join(small_side(base), "name")
    every = base.where(F.col("name").contains("-")).withColumn("version", F.lit(None).cast("string"))
    known = pinned.unionByName(every).select(
        "name", "version",
        F.concat(F.lit("ADV-"), "pkg_id", F.coalesce(F.concat(F.lit("-"), "version"), F.lit(""))).alias("advisory_id"),
        F.when(F.col("version").isNull(), "MODERATE").alias("severity"),
        F.col("version").startswith("1").alias("has_score"),
        F.col("name").alias("summary"),
    )
    return advisory_findings(deps, known).select("target", "severity", "title", "snippet", F.array_join("references", " ").alias("refs"))


def pyproject_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed dependencies, each written into a pyproject.toml of its own, and read back."""
    quoted = F.to_json(F.array("name"))
    texts = table(spark, sf_dir, "dependencies").where("name is not null").select(
        F.col("dep_id").cast("string").alias("target"),
        F.lit("pyproject.toml").alias("rel_path"),
        F.concat(F.lit('[project]\nname = "x"\ndependencies = '), quoted, F.lit("\n")).alias("text"),
    )
    return parsed_dependencies(manifest_lines(texts)).select("target", "source_file", "line", "name", "version")


def png_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow bodies, each embedded in a PNG file, and read back."""
    data = F.concat(F.lit("workflow\0").cast("binary"), F.col("body").cast("binary"))
    size = F.unhex(F.lpad(F.hex(F.length(data).cast("bigint")), 8, "0"))
    end = F.unhex(F.lit("0000000049454E44AE426082"))
    files = table(spark, sf_dir, "workflows").select(
        F.col("workflow_id").alias("file_id"), "target", F.lit("w.png").alias("rel_path"), F.lit(".png").alias("suffix"),
        F.when(F.col("body").isNotNull(), F.concat(F.unhex(F.lit("89504E470D0A1A0A")), size, F.lit("tEXt").cast("binary"), data, F.unhex(F.lit("00000000")), end)).alias("content"),
    )
    return embedded_workflows(files).select(F.col("file_id").alias("workflow_id"), "body", "reason")


def _risk_of_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk score over counters that are taken from findings: one by the line of each finding, lines of code by the
    length of its title."""
    found = table(spark, sf_dir, "scan_findings").select("scan_id", F.coalesce("line", F.lit(0)).alias("line"), F.length("title").alias("n"))
    counts = [F.count(F.when(F.col("line") % len(COUNTERS) == i, 1)).alias(c) for i, c in enumerate(COUNTERS) if c != "total_loc"]
    return scored(found.groupBy("scan_id").agg(*counts, F.sum("n").alias("total_loc")))


def finding_risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that follow from the risk scores."""
    scores = _risk_of_findings(spark, sf_dir).withColumn("target", F.col("scan_id").cast("string"))
    return risk_findings(scores).select("target", "layer", "severity", "category", "file")


def finding_risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _risk_of_findings(spark, sf_dir)
    signals = F.transform("reasons", lambda r: F.regexp_replace(r, r" \([^)]*\)$", ""))
    return scores.select(
        "scan_id", "dangerous_calls_total", F.round("dangerous_call_density", 9).alias("density"),
        F.round("suspicious_import_ratio", 9).alias("import_ratio"), F.round("score", 9).alias("score"), F.array_join(signals, "; ").alias("signals"),
    )


def l5_risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    texts = with_text(files)
    return scored(target_counters(read_syntax(texts), files, manifest_lines(texts)))


def scan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return scan(files, _signatures(spark, sf_dir, files)).verdicts


#: Literals that occur in widgets
WIDGET_PATTERNS = [("http", "network_call", "medium", "CWE-913"), ("https://", "network_call", "low", None), ("euler", "info_gathering", "info", None)]


def _widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_widgets(table(spark, sf_dir, "workflows"))


def workflow_root_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return root_nodes(table(spark, sf_dir, "workflows")).select("workflow_id", "form", "node_id", "node_type")


def workflow_node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = root_nodes(table(spark, sf_dir, "workflows"))
    return nodes.groupBy("node_type").agg(F.count("*").alias("n_nodes"), F.count_distinct("workflow_id").alias("n_workflows"))


def workflow_widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _widgets(spark, sf_dir).select("workflow_id", "node_id", "node_type", "idx", "value")


def workflow_widget_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widget_text(_widgets(spark, sf_dir))


def workflow_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widget_urls(_widgets(spark, sf_dir)).select("workflow_id", "node_id", "url").distinct()


def workflow_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([(*p, i) for i, p in enumerate(WIDGET_PATTERNS)], PATTERN_SCHEMA)
    hits = widget_literal_hits(_widgets(spark, sf_dir), patterns)
    return hits.select("workflow_id", "node_id", "pattern", "category", "severity")


def workflow_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = table(spark, sf_dir, "workflows")
    feed = widget_urls(_widgets(spark, sf_dir)).groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url")
    known = Signatures(_shared_digests(_files(spark, sf_dir)), feed, feed, built_in_patterns(spark))
    return scan_workflows(flows, known).verdicts


QUERIES = {
    q.__name__: q
    for q in (
        l0_digest_groups, l0_digest_findings, l1_url_mentions, l1_url_findings, l2_literal_findings, l3_syntax_findings,
        l4_dependencies, l4_name_findings, l5_risk_scores, scan_targets, workflow_root_nodes, workflow_node_types,
        workflow_widgets, workflow_widget_text, workflow_urls, workflow_literals, workflow_verdicts, l2_name_literals,
        piece_findings, piece_counters, dependency_name_findings, dependency_advisories, pyproject_dependencies, png_workflows, finding_risk_scores,
        finding_risk_levels,
    )
}

_GROUPS = """
  SELECT sha256(content) AS sha256, count(*) AS n_files, count(DISTINCT target) AS n_targets,
    count(DISTINCT split_part(target, '/', 1)) AS n_owners, min(file_id) AS first_file_id
  FROM plugin_files WHERE content IS NOT NULL {0} GROUP BY 1 HAVING count(*) > 1
"""
# its JSON functions take commas before closing brackets, which no JSON has
_FLOWS = """
flows AS (SELECT workflow_id, CAST(body AS JSON) AS b FROM workflows WHERE json_valid(body)
  AND NOT regexp_matches(regexp_replace(body, '"([^"\\\\]|\\\\.)*"', '0', 'g'), ',\\s*[\\]}]')),
formed AS (SELECT workflow_id, b, CASE WHEN json_type(b, '/nodes') = 'ARRAY' THEN 'ui'
    WHEN json_type(b) = 'OBJECT' AND len(json_keys(b)) > 0 AND list_bool_and(list_transform(json_keys(b), lambda k:
      json_type(b, '/' || replace(replace(k, '~', '~0'), '/', '~1') || '/class_type') IS NOT NULL)) THEN 'prompt' END AS form
  FROM flows),
nodes AS (
  SELECT workflow_id, form, i AS pos, json_extract_string(n, '/id') AS node_id, json_extract_string(n, '/type') AS node_type, n
  FROM (SELECT workflow_id, form, i, json_extract(b, '/nodes/' || i) AS n
        FROM formed, unnest(range(CAST(json_array_length(b, '/nodes') AS BIGINT))) AS u(i) WHERE form = 'ui') WHERE json_type(n) = 'OBJECT'
  UNION ALL
  SELECT workflow_id, form, row_number() OVER (PARTITION BY workflow_id ORDER BY k) - 1, k, json_extract_string(n, '/class_type'), n
  FROM (SELECT workflow_id, form, k, json_extract(b, '/' || replace(replace(k, '~', '~0'), '/', '~1')) AS n
        FROM (SELECT workflow_id, form, b, unnest(json_keys(b)) AS k FROM formed WHERE form = 'prompt'))),
listed AS (
  SELECT workflow_id, pos, node_id, node_type, i AS idx, json_extract(n, '/widgets_values/' || i) AS v
  FROM nodes, unnest(range(CAST(json_array_length(n, '/widgets_values') AS BIGINT))) AS u(i)
  WHERE form = 'ui' AND json_type(n, '/widgets_values') = 'ARRAY'
  UNION ALL
  SELECT workflow_id, pos, node_id, node_type, -1, json_extract(n, '/inputs/' || replace(replace(k, '~', '~0'), '/', '~1'))
  FROM (SELECT *, unnest(json_keys(n, '/inputs')) AS k FROM nodes WHERE form = 'prompt' AND json_type(n, '/inputs') = 'OBJECT')),
widgets AS (
  SELECT workflow_id, pos, node_id, node_type, CAST(idx AS INT) AS idx, json_extract_string(v, '$') AS value FROM listed
  WHERE json_type(v) = 'VARCHAR'
  UNION ALL
  SELECT workflow_id, pos, node_id, node_type, CAST(r - 1 AS INT), k FROM (
    SELECT workflow_id, pos, node_id, node_type, k, row_number() OVER (PARTITION BY workflow_id, pos, node_id ORDER BY k) AS r
    FROM (SELECT *, unnest(json_keys(n, '/widgets_values')) AS k FROM nodes
          WHERE form = 'ui' AND json_type(n, '/widgets_values') = 'OBJECT')))
"""

# file contents as text: the valid sequences of UTF-8 among the bytes in hexadecimal, and line feeds as line ends
_UTF8 = "|".join(
    (
        "[0-7][0-9A-F]", "(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]", "E0[AB][0-9A-F][89AB][0-9A-F]", "E[1-9A-CEF](?:[89AB][0-9A-F]){2}",
        "ED[89][0-9A-F][89AB][0-9A-F]", "F0[9AB][0-9A-F](?:[89AB][0-9A-F]){2}", "F[1-3](?:[89AB][0-9A-F]){3}", "F48[0-9A-F](?:[89AB][0-9A-F]){2}",
    )
)


def decoded_sql(content: str) -> str:
    return f"""replace(replace(decode(unhex(array_to_string(list_filter(regexp_extract_all(hex({content}), '{_UTF8}|..'),
        lambda x: regexp_full_match(x, '{_UTF8}')), ''))), chr(13) || chr(10), chr(10)), chr(13), chr(10))"""


_TEXTS = f"""
texts AS (SELECT target, rel_path, suffix, {decoded_sql("content")} AS text
  FROM plugin_files WHERE content IS NOT NULL AND suffix IN ('.py', '.txt', '.toml', '.md', '.yaml', '.yml', '.json')),
lines AS (SELECT target, rel_path, suffix, CAST(i AS INT) AS line, l[i] AS text FROM (SELECT *, string_split(text, chr(10)) AS l FROM texts),
  unnest(range(1, len(l) + 1)) AS u(i))
"""
_FOUND_URLS = r"""
m AS (SELECT target, rel_path, line, u AS url FROM (SELECT *, unnest(regexp_extract_all(text,
    '(?i)(?:https?://|wss?://)[a-zA-Z0-9\-._~:/?#@!$&''()*+,;=%]+')) AS u FROM lines)),
first AS (SELECT target, url, arg_min(rel_path, (rel_path, line)) AS rel_path, arg_min(line, (rel_path, line)) AS line, count(*) AS n_mentions
  FROM m GROUP BY target, url)
"""
_CUT = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1} - 3) || '...' ELSE {0} END".format
_LINE = _CUT(_strip("l.text"), 200)


def _known(rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"(VALUES {values}) AS k(pattern, category, severity, cwe, o)"


_BUILT_IN = _known([(p, *kind, i) for i, (kind, p) in enumerate((kind, p) for kind, ps in BUILT_IN.items() for p in ps)])
_DEPS = rf"""
d AS (SELECT target, {_normal('n')} AS name, CASE WHEN o = '==' AND regexp_full_match(v, '[A-Za-z0-9._+-]+') THEN v END AS version
  FROM (SELECT target, regexp_extract(entry, {_REQ}, 1) AS n, regexp_extract(entry, {_REQ}, 2) AS o, regexp_extract(entry, {_REQ}, 3) AS v
        FROM (SELECT target, {entry_sql} AS entry FROM dependencies)) WHERE n <> '')
"""
_NEAR = rf"""
k AS (SELECT DISTINCT {_normal('name')} AS near FROM package_baseline),
n AS (SELECT DISTINCT {_normal('name')} AS name FROM dependencies),
near AS (SELECT name, arg_min(near, (distance, near)) AS near, min(distance) AS distance FROM (
    SELECT name, near, levenshtein(regexp_replace(name, '[^\x00-\x7f]', '?', 'g'), near) AS distance FROM n, k
    WHERE length(name) >= 4 AND abs(length(name) - length(near)) <= 2 AND name NOT IN (SELECT near FROM k)) WHERE distance <= 2 GROUP BY name)
"""
_MANIFESTS = rf"""
entries AS (
  SELECT target, rel_path, line, {_strip("split_part(text, '#', 1)")} AS entry FROM lines
  WHERE lower(split_part(rel_path, '/', -1)) = 'requirements.txt' OR ends_with(lower(rel_path), '.requirements.txt')
  UNION ALL
  SELECT target, rel_path, 0, unnest(regexp_extract_all(regexp_extract(text, '(?s)\ndependencies = \[(.*?)\n\]', 1), '"([^"]*)"', 1)) FROM texts
  WHERE lower(split_part(rel_path, '/', -1)) = 'pyproject.toml'),
parsed AS (SELECT target, rel_path, line, regexp_extract(e, {_REQ}, 1) AS n, regexp_extract(e, {_REQ}, 2) AS o, regexp_extract(e, {_REQ}, 3) AS v
  FROM (SELECT *, {_strip("split_part(entry, ';', 1)")} AS e FROM entries WHERE entry <> '' AND NOT starts_with(entry, '-')
    AND (line = 0 OR NOT contains(entry, '://') AND NOT regexp_matches(entry, '^(git|hg|svn|bzr)\+'))))
"""


def _worth(counter: str, *how: object) -> str:
    if isinstance(how[0], dict):
        return "CASE " + " ".join(f"WHEN {counter} >= {n} THEN {w}::DOUBLE" for n, w in how[0].items()) + " ELSE 0.0::DOUBLE END"
    most, base, each = how
    return f"CASE WHEN {counter} > 0 THEN least({most}::DOUBLE, {base}::DOUBLE + {counter} * {each}::DOUBLE) ELSE 0.0::DOUBLE END"


_COUNTED = f"""c AS (SELECT scan_id, {", ".join(f"count(*) FILTER (coalesce(line, 0) % {len(COUNTERS)} = {i}) AS {c}" for i, c in enumerate(COUNTERS) if c != "total_loc")},
  sum(length(title)) AS total_loc FROM scan_findings GROUP BY scan_id)"""
_PIECE_ROWS = _known([(c, s, w or "", i, line) for i, (_, rows, _) in enumerate(PIECES) for line, c, s, w in rows]).replace(
    "k(pattern, category, severity, cwe, o)", "k(category, severity, cwe, piece, line)"
)
_PIECE_TOTALS = ", ".join(
    f"({i}, {text.count(chr(10)) + 1}, {len(text.encode())}, {', '.join(str(counts.get(c, 0)) for c in _PIECE_COUNTERS)})"
    for i, (text, _, counts) in enumerate(PIECES)
)

_DANGEROUS = "eval_calls + exec_calls + compile_calls + import_dunder_calls + shell_calls + deserialization_calls"
_PER_LINES = f"CASE WHEN total_loc > 0 THEN 100.0::DOUBLE * ({_DANGEROUS}) / total_loc ELSE 0.0::DOUBLE END"
_SIGNALS = {signal: _worth(counter, *how) for signal, (counter, *how) in GROWING.items()} | {
    "dense dangerous calls": f"CASE WHEN {_PER_LINES} > {DENSITY} THEN {DENSE}::DOUBLE ELSE 0.0::DOUBLE END"
}

SQL = {
    "l0_digest_groups": _GROUPS.format(""),
    "l0_digest_findings": f"""SELECT target, rel_path AS file, 'critical' AS severity, 'known_malware' AS category, 'L0' AS layer
        FROM plugin_files WHERE sha256(content) IN (SELECT sha256 FROM ({_GROUPS.format('AND n_bytes > 0')}))""",
    "workflow_root_nodes": f"WITH {_FLOWS} SELECT workflow_id, form, node_id, node_type FROM nodes",
    "workflow_node_types": f"""WITH {_FLOWS} SELECT node_type, count(*) AS n_nodes, count(DISTINCT workflow_id) AS n_workflows
        FROM nodes GROUP BY node_type""",
    "workflow_widgets": f"WITH {_FLOWS} SELECT workflow_id, node_id, node_type, idx, value FROM widgets",
    "workflow_urls": rf"""WITH {_FLOWS} SELECT DISTINCT workflow_id, node_id, regexp_replace(url, '[.,;:!?]+$', '') AS url FROM
        (SELECT workflow_id, node_id, unnest(regexp_extract_all(value, '(?i)https?://[^\s"''<>()\[\]{{}}]+')) AS url FROM widgets)""",
    "workflow_literals": f"""WITH {_FLOWS} SELECT DISTINCT workflow_id, node_id, pattern, category, severity FROM widgets,
        (VALUES {", ".join(f"('{p}', '{c}', '{s}')" for p, c, s, _ in WIDGET_PATTERNS)}) AS v(pattern, category, severity)
        WHERE contains(value, pattern)""",
    "l1_url_mentions": f"WITH {_TEXTS}, {_FOUND_URLS} SELECT target, url, rel_path, line, n_mentions FROM first",
    "l1_url_findings": f"""WITH {_TEXTS}, {_FOUND_URLS} SELECT target, rel_path AS file, line, 'high' AS severity, url AS snippet FROM first
        WHERE lower(rtrim(url, '/')) IN (SELECT lower(rtrim(url, '/')) FROM m WHERE ends_with(rel_path, '.md'))""",
    "l2_literal_findings": f"""WITH {_TEXTS} SELECT target, rel_path AS file, line, category, severity, pattern, {_LINE} AS snippet, cwe
        FROM lines l, {_BUILT_IN} WHERE contains(l.text, pattern)""",
    "l2_name_literals": f"""WITH {_TEXTS} SELECT target, rel_path AS file, line, 'package_name: `' || {_CUT("name", 60)} || '` is in the text' AS title,
        'info' AS severity, {_LINE} AS snippet, count(*) AS n FROM lines l, package_baseline WHERE contains(l.text, name) GROUP BY ALL""",
    "piece_findings": f"""SELECT target, dep_id || '.py' AS file, k.line, category, severity, nullif(cwe, '') AS cwe, 'L3' AS layer
        FROM dependencies, {_PIECE_ROWS} WHERE dep_id % {len(PIECES)} = piece""",
    "piece_counters": f"""SELECT target, count(*) AS py_file_count, count(*) AS total_file_count, CAST(sum(loc) AS BIGINT) AS total_loc,
          CAST(max(bytes) AS BIGINT) AS max_file_bytes, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _PIECE_COUNTERS)}
        FROM dependencies JOIN (VALUES {_PIECE_TOTALS}) AS k(piece, loc, bytes, {", ".join(_PIECE_COUNTERS)}) ON dep_id % {len(PIECES)} = piece GROUP BY target""",
    "l4_dependencies": f"""WITH {_TEXTS}, {_MANIFESTS} SELECT target, rel_path AS source_file, line, {_normal("n")} AS name,
        CASE WHEN o = '==' AND regexp_full_match(v, '[A-Za-z0-9._+-]+') THEN v END AS version FROM parsed WHERE n <> ''""",
    "dependency_name_findings": f"""WITH {_NEAR} SELECT target, source_file AS file, line, CASE WHEN distance = 1 THEN 'high' ELSE 'medium' END AS severity,
        '`' || near.name || '` is nearly `' || near || '`' AS title, near.name AS snippet
        FROM dependencies JOIN near ON {_normal("dependencies.name")} = near.name""",
    "dependency_advisories": f"""WITH {_DEPS}, a AS (
          SELECT name, version, 'ADV-' || pkg_id || '-' || version AS id, CASE WHEN starts_with(version, '1') THEN 'high' ELSE 'medium' END AS severity
          FROM (SELECT DISTINCT name, version FROM d WHERE version IS NOT NULL) JOIN package_baseline USING (name)
          UNION ALL SELECT name, NULL, 'ADV-' || pkg_id, 'medium' FROM package_baseline WHERE contains(name, '-'))
        SELECT d.target, a.severity, id || ' applies to `' || d.name || coalesce('==' || d.version, '') || '`' AS title,
          d.name || coalesce('==' || d.version, '') AS snippet, 'https://osv.dev/vulnerability/' || id AS refs
        FROM (SELECT DISTINCT * FROM d) d JOIN a ON d.name = a.name AND (a.version IS NULL OR a.version = d.version)""",
    "pyproject_dependencies": f"""WITH e AS (SELECT dep_id, {_strip("split_part(name, ';', 1)")} AS e FROM dependencies WHERE name IS NOT NULL),
        r AS (SELECT dep_id, regexp_extract(e, {_REQ}, 1) AS n, regexp_extract(e, {_REQ}, 2) AS o, regexp_extract(e, {_REQ}, 3) AS v FROM e)
        SELECT CAST(dep_id AS VARCHAR) AS target, 'pyproject.toml' AS source_file, 0 AS line, {_normal("n")} AS name,
          CASE WHEN o = '==' AND regexp_full_match(v, '[A-Za-z0-9._+-]+') THEN v END AS version FROM r WHERE n <> ''""",
    "png_workflows": "SELECT workflow_id, body, CASE WHEN body IS NULL THEN 'not a png' END AS reason FROM workflows",
    "finding_risk_levels": f"""WITH {_COUNTED}, v AS (SELECT scan_id, {" + ".join(_SIGNALS.values())} AS score FROM c)
        SELECT CAST(scan_id AS VARCHAR) AS target, 'L5' AS layer, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.6 THEN 'high' ELSE 'medium' END AS severity,
          'aggregate_risk' AS category, CAST(NULL AS VARCHAR) AS file FROM v WHERE score >= 0.35""",
    "finding_risk_scores": f"""WITH {_COUNTED},
        s AS (SELECT scan_id, place, signal, worth FROM c, LATERAL (VALUES {", ".join(f"({i}, '{n}', {w})" for i, (n, w) in enumerate(_SIGNALS.items()))}) AS v(place, signal, worth)),
        t AS (SELECT scan_id, string_agg(signal, '; ' ORDER BY r) AS signals FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY worth DESC, place) AS r
              FROM s WHERE worth > 0) WHERE r <= 6 GROUP BY scan_id)
        SELECT c.scan_id, {_DANGEROUS} AS dangerous_calls_total, round({_PER_LINES}, 9) AS density,
          round(CASE WHEN total_import_count > 0 THEN suspicious_import_count / total_import_count ELSE 0.0 END, 9) AS import_ratio,
          round(least(1.0::DOUBLE, {" + ".join(_SIGNALS.values())}), 9) AS score, coalesce(signals, '') AS signals FROM c LEFT JOIN t ON c.scan_id = t.scan_id""",
    "workflow_widget_text": f"""WITH {_FLOWS} SELECT workflow_id, CAST(pos AS INT) AS node_pos, string_agg(value, chr(10) ORDER BY idx, value) AS text
        FROM widgets GROUP BY workflow_id, pos""",
    "workflow_verdicts": rf"""WITH {_FLOWS},
        urls AS (SELECT workflow_id, node_id, node_type, regexp_replace(url, '[.,;:!?]+$', '') AS url FROM (SELECT workflow_id, pos, node_id, node_type, idx,
          unnest(list_distinct(regexp_extract_all(value, '(?i)https?://[^\s"''<>()\[\]{{}}]+'))) AS url FROM widgets)),
        f AS (SELECT workflow_id, 4 AS r FROM (SELECT DISTINCT workflow_id, node_id, node_type, url FROM urls
            WHERE url IN (SELECT url FROM urls GROUP BY url HAVING count(*) > 1))
          UNION ALL SELECT workflow_id, list_position(['info','low','medium','high','critical'], severity) - 1 FROM (
            SELECT DISTINCT workflow_id, node_id, pattern, severity FROM widgets, {_BUILT_IN} WHERE contains(value, pattern))),
        j AS (SELECT workflow_id, max(r) AS r, count(*) AS n FROM f GROUP BY workflow_id)
        SELECT CAST(v.workflow_id AS VARCHAR) AS target, {_JUDGED}, coalesce(n, 0) AS findings_count
        FROM (SELECT DISTINCT workflow_id FROM formed WHERE form IS NOT NULL) v LEFT JOIN j ON v.workflow_id = j.workflow_id""",
}
