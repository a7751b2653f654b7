"""Queries over findings of earlier scans: verdicts, cascades, histograms, and the same as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesift.operators.url import first_mentions, url_mentions
from tidesift.operators.verdict import cascade, exit_code, layers_run, verdicts, worst_label
from tidesift.functions.text import normal_url
from tidesift.render import batch_json, report_lines
from tidesift.schema import FINDING_COLUMNS, LAYERS, SEVERITIES, severity_of, severity_rank
from tidesift.session import shared_path, small_side, table
from tidesift.streaming.arrivals import distinct_arrivals, severity_windows


def scan_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "scan_findings")
    return verdicts(found, found, "scan_id")


def target_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "scan_findings"), table(spark, sf_dir, "plugin_targets"))


def scan_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(table(spark, sf_dir, "scan_findings"), "scan_id").select("scan_id", "id", "layer", "severity", "title")


def cascade_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "scan_findings")
    return verdicts(cascade(found, "scan_id"), found, "scan_id")


def scan_layers_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "scan_findings")
    run = layers_run(found, found.select("scan_id").distinct(), "scan_id")
    return run.withColumn("layers_run", F.array_join("layers_run", ","))


def selected_layers_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cascade(table(spark, sf_dir, "scan_findings"), "scan_id", ("L4", "L2", "L0"))
    return found.groupBy("scan_id", "layer").agg(F.count("*").alias("n_findings"))


def owner_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = target_verdicts(spark, sf_dir).withColumn("owner", F.split("target", "/")[0])
    return worst_label(judged, "owner")


def scan_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = scan_verdicts(spark, sf_dir)
    codes = [exit_code("label", x).alias(f"exit_{x}") for x in ("none", "suspicious", "malicious")]
    return judged.select("scan_id", *codes)


def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "scan_findings").withColumn("rank", severity_rank(F.col("severity")))
    return found.groupBy("layer", "rank").agg(F.count("*").alias("n_findings")).select(
        "layer", severity_of(F.col("rank")).alias("severity"), "n_findings"
    )


def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "scan_findings").withColumn("severity", F.lower("severity"))
    return found.groupBy("target", "category").pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1))).fillna(0, list(SEVERITIES))


def latest_scan_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "scan_findings")
    latest = found.groupBy("target").agg(F.max(F.struct("started_at", "scan_id")).alias("_l")).select("target", "_l.scan_id")
    return verdicts(found.join(small_side(latest), ["target", "scan_id"], "left_semi"), latest)


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "scan_findings")
    return found.select("target", F.coalesce("file", F.lit("")).alias("rel_path"), F.array_join("refs", "\n").alias("text"), "severity")


def reference_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs that findings refer to, with their first place per target."""
    return first_mentions(url_mentions(_refs(spark, sf_dir)))


def listed_reference_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As reference_urls, for those URLs that a critical finding anywhere refers to."""
    refs = _refs(spark, sf_dir)
    feed = url_mentions(refs.where(severity_rank(F.col("severity")) == 4)).select(F.upper("url").alias("url"))
    listed = feed.select(normal_url(F.col("url")).alias("_u")).distinct()
    mentions = url_mentions(refs).withColumn("_u", normal_url(F.col("url")))
    return first_mentions(mentions.join(small_side(listed), "_u", "left_semi"))


def _reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The findings of scans in the shape of findings, by scan, and their verdicts."""
    found = table(spark, sf_dir, "scan_findings").withColumn("target", F.col("scan_id").cast("string")).withColumnRenamed("refs", "references")
    found = found.select(*FINDING_COLUMNS)
    return found, verdicts(found, found)


def finding_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of scans as JSON lines, read back."""
    lines = report_lines(*_reported(spark, sf_dir))
    schema = (
        "schema_version string, verdict struct<label:string,score:double,confidence:string>, recommendation string, findings_count bigint, "
        "id string, layer string, severity string, title string, file string, line int, snippet string, cwe string, references array<string>"
    )
    read = lines.select("target", "part", F.from_json("json", schema).alias("j"))
    return read.select(
        "target", "part", "j.schema_version", "j.verdict.label", "j.verdict.score", "j.recommendation", "j.findings_count",
        "j.id", "j.layer", "j.severity", "j.title", "j.file", "j.line", "j.snippet", "j.cwe", F.array_join("j.references", " ").alias("refs"),
    )


def batch_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch report of all scans, read back."""
    schema = "node string, verdict struct<label:string,score:double,confidence:string>, recommendation string, findings_count bigint"
    read = batch_json(_reported(spark, sf_dir)[1]).select(F.from_json("json", schema).alias("j"))
    return read.select("j.node", "j.verdict.label", "j.verdict.score", "j.verdict.confidence", "j.recommendation", "j.findings_count")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/scan_findings.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def _drained(spark: SparkSession, result: DataFrame, mode: str) -> DataFrame:
    """What a stream gives when everything that is there has been read, as a table."""
    out = shared_path(spark, "stream")
    write = "overwrite" if mode == "complete" else "append"
    run = (
        result.writeStream.outputMode(mode)
        .trigger(availableNow=True)
        .option("checkpointLocation", shared_path(spark, "progress"))
        .foreachBatch(lambda df, _: df.write.mode(write).parquet(out))
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(out)


def stream_severity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _drained(spark, severity_windows(_stream(spark, sf_dir)), "complete")
    return windows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def stream_distinct_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = distinct_arrivals(_stream(spark, sf_dir)).select("scan_id", "target", "id", "layer", "category", "title")
    return _drained(spark, arrived, "append")


QUERIES = {
    q.__name__: q
    for q in (
        scan_verdicts, target_verdicts, scan_cascade, cascade_verdicts, scan_layers_run, selected_layers_cascade, owner_worst,
        scan_exit_codes, severity_histogram, category_pivot, latest_scan_verdicts, reference_urls, listed_reference_urls,
        stream_severity_windows, stream_distinct_findings, finding_reports, batch_reports,
    )
}

_RANK = "coalesce(list_position(['info','low','medium','high','critical'], lower(severity)) - 1, 0)"
JUDGED = """
  CASE WHEN r IS NULL THEN 'clean' WHEN r >= 3 THEN 'malicious' ELSE 'suspicious' END AS label,
  CAST(CASE WHEN r IS NULL THEN 0.0 WHEN r = 4 THEN 0.98 WHEN r = 3 THEN 0.85 WHEN r = 2 THEN 0.55 ELSE 0.25 END AS DOUBLE) AS score,
  CASE WHEN r IS NULL OR r >= 3 THEN 'high' WHEN r = 2 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN r IS NULL THEN 'install' WHEN r >= 3 THEN 'do_not_install' ELSE 'review' END AS recommendation
"""
_CASCADE = f"""
  SELECT * FROM (
    SELECT *, CAST(substr(layer, 2) AS INT) AS o,
      min(CASE WHEN {_RANK} = 4 THEN CAST(substr(layer, 2) AS INT) END) OVER (PARTITION BY scan_id) AS stop
    FROM scan_findings) WHERE o <= coalesce(stop, 999)
"""
_TARGET_VERDICTS = f"""
  SELECT t.target, {JUDGED}, coalesce(n, 0) AS findings_count
  FROM (SELECT DISTINCT target FROM plugin_targets) t
  LEFT JOIN (SELECT target, max({_RANK}) AS r, count(*) AS n FROM scan_findings GROUP BY target) f ON t.target = f.target
"""
_MENTIONS = """
  SELECT target, coalesce(file, '') AS rel_path, severity, CAST(i AS INT) AS line, refs[i] AS url
  FROM scan_findings, unnest(range(1, len(refs) + 1)) AS u(i)
"""
_FIRST = """
  SELECT target, url, arg_min(rel_path, (rel_path, line)) AS rel_path, arg_min(line, (rel_path, line)) AS line,
    count(*) AS n_mentions FROM m GROUP BY target, url
"""

SQL = {
    "scan_verdicts": f"""SELECT scan_id, {JUDGED}, n AS findings_count FROM
        (SELECT scan_id, max({_RANK}) AS r, count(*) AS n FROM scan_findings GROUP BY scan_id)""",
    "target_verdicts": _TARGET_VERDICTS,
    "scan_cascade": f"SELECT scan_id, id, layer, severity, title FROM ({_CASCADE})",
    "cascade_verdicts": f"""SELECT scan_id, {JUDGED}, n AS findings_count FROM
        (SELECT scan_id, max({_RANK}) AS r, count(*) AS n FROM ({_CASCADE}) GROUP BY scan_id)""",
    "scan_layers_run": f"""SELECT scan_id, array_to_string(['L0','L1','L2','L3','L4','L5'][1:coalesce(
        min(CASE WHEN {_RANK} = 4 THEN CAST(substr(layer, 2) AS INT) + 1 END), 6)], ',') AS layers_run
        FROM scan_findings GROUP BY scan_id""",
    "selected_layers_cascade": f"""WITH o AS (SELECT *, list_position(['L4','L2','L0'], layer) AS p FROM scan_findings),
        s AS (SELECT *, min(CASE WHEN {_RANK} = 4 THEN p END) OVER (PARTITION BY scan_id) AS stop FROM o WHERE p IS NOT NULL)
        SELECT scan_id, layer, count(*) AS n_findings FROM s WHERE p <= coalesce(stop, 9) GROUP BY scan_id, layer""",
    "owner_worst": f"""WITH v AS ({_TARGET_VERDICTS}) SELECT split_part(target, '/', 1) AS owner,
        CASE max(CASE label WHEN 'malicious' THEN 2 WHEN 'suspicious' THEN 1 ELSE 0 END)
          WHEN 2 THEN 'malicious' WHEN 1 THEN 'suspicious' ELSE 'clean' END AS worst, count(*) AS n_targets,
        count(*) FILTER (label = 'clean') AS n_clean, count(*) FILTER (label = 'suspicious') AS n_suspicious,
        count(*) FILTER (label = 'malicious') AS n_malicious FROM v GROUP BY 1""",
    "scan_exit_codes": f"""SELECT scan_id, 0 AS exit_none, CASE WHEN max({_RANK}) >= 3 THEN 2 ELSE 1 END AS exit_suspicious,
        CASE WHEN max({_RANK}) >= 3 THEN 2 ELSE 0 END AS exit_malicious FROM scan_findings GROUP BY scan_id""",
    "severity_histogram": """SELECT layer, lower(severity) AS severity, count(*) AS n_findings FROM scan_findings
        GROUP BY 1, 2""",
    "category_pivot": "SELECT target, category, "
    + ", ".join(f"count(*) FILTER (lower(severity) = '{s}') AS {s}" for s in SEVERITIES)
    + " FROM scan_findings GROUP BY target, category",
    "latest_scan_verdicts": f"""WITH l AS (SELECT target, arg_max(scan_id, (started_at, scan_id)) AS scan_id FROM scan_findings
        GROUP BY target) SELECT target, {JUDGED}, n AS findings_count FROM (SELECT target, max({_RANK}) AS r, count(*) AS n
        FROM scan_findings SEMI JOIN l USING (target, scan_id) GROUP BY target)""",
    "reference_urls": f"WITH m AS ({_MENTIONS}) {_FIRST}",
    "listed_reference_urls": f"""WITH a AS ({_MENTIONS}), m AS (SELECT * FROM a WHERE lower(rtrim(url, '/')) IN
        (SELECT lower(rtrim(url, '/')) FROM a WHERE {_RANK} = 4)) {_FIRST}""",
    "stream_severity_windows": f"""SELECT strftime(make_timestamp(CAST(floor(epoch(started_at) / 604800) * 604800000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS window_start, layer,
        count(*) AS n_findings, count(*) FILTER ({_RANK} = 4) AS n_critical, max({_RANK}) AS worst_rank
        FROM scan_findings GROUP BY 1, 2""",
    "finding_reports": f"""SELECT target, 0 AS part, '1.0' AS schema_version, label, score, recommendation, n AS findings_count, NULL AS id, NULL AS layer,
          NULL AS severity, NULL AS title, NULL AS file, CAST(NULL AS INT) AS line, NULL AS snippet, NULL AS cwe, NULL AS refs
        FROM (SELECT CAST(scan_id AS VARCHAR) AS target, {JUDGED}, n FROM (SELECT scan_id, max({_RANK}) AS r, count(*) AS n FROM scan_findings GROUP BY scan_id))
        UNION ALL SELECT CAST(scan_id AS VARCHAR), 1, NULL, NULL, NULL, NULL, NULL, id, layer, severity, title, file, line, snippet, cwe, array_to_string(refs, ' ')
        FROM scan_findings""",
    "batch_reports": f"""SELECT CAST(scan_id AS VARCHAR) AS node, {JUDGED}, n AS findings_count
        FROM (SELECT scan_id, max({_RANK}) AS r, count(*) AS n FROM scan_findings GROUP BY scan_id)""",
    "stream_distinct_findings": "SELECT DISTINCT scan_id, target, id, layer, category, title FROM scan_findings",
}
assert set(LAYERS) == {"L0", "L1", "L2", "L3", "L4", "L5"}  # the SQL spells them out
