"""Queries over raw dependency records and nested workflow bodies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesift.operators.nested import flatten_workflows, node_table, value_table
from tidesift.operators.rows import split_records
from tidesift.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_records(table(spark, sf_dir, "dependency_raw")).rejected.select("raw_id", "reason")


def p2_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_records(table(spark, sf_dir, "dependency_raw")).sound.withColumn(
        "declared_at", F.date_format("declared_at", "yyyy-MM-dd")
    )


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = split_records(table(spark, sf_dir, "dependency_raw")).rejected
    errors = rejected.select("reason", F.explode("errors").alias("error"))
    return errors.groupBy("reason", "error").agg(F.count("*").alias("n_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_workflows(table(spark, sf_dir, "workflows"), tables=("vals",))
    return value_table(flat).select("workflow_id", "parent_ptr", "node_ptr", "value_ptr")


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_table(flatten_workflows(table(spark, sf_dir, "workflows"), tables=("nodes",)))


_Q = r"""(?:"[^"]*(?:""[^"]*)*")"""
_FIELD = rf"""(?:{_Q}|[^",]*)"""
_PARSED = rf"""
raw AS (
  SELECT raw_id, raw_line, regexp_matches(raw_line, '\A(?:{_FIELD},)*{_FIELD}\z') AS quoted_ok FROM dependency_raw),
cells AS (
  SELECT raw_id, quoted_ok, list_transform(
    regexp_extract_all(raw_line || ',', '({_FIELD}),', 1),
    lambda c: CASE WHEN starts_with(c, '"') THEN replace(substr(c, 2, length(c) - 2), '""', '"')
                   ELSE regexp_replace(c, '\A[ \t]+|[ \t]+\z', '', 'g') END) AS f
  FROM raw),
judged AS (
  SELECT raw_id, f, CASE
    WHEN NOT quoted_ok THEN 'quoting'
    WHEN quoted_ok IS NULL OR len(f) <> 6 THEN 'columns'
    WHEN f[1] = '' OR f[2] = '' OR NOT regexp_matches(f[3], '\A[0-9]{{1,5}}\z')
      OR NOT regexp_matches(f[4],
        '\A[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?(?:\[[A-Za-z0-9._-]+(?:,[A-Za-z0-9._-]+)*\])?\z')
      OR NOT regexp_matches(f[5], '\A(?:[0-9]+(?:\.[0-9]+)*(?:(?:a|b|rc)[0-9]+)?(?:\.post[0-9]+)?(?:\.dev[0-9]+)?'
        || '(?:\+[a-z0-9]+(?:\.[a-z0-9]+)*)?)?\z')
      OR NOT regexp_matches(f[6], '\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\z') OR try_cast(f[6] AS DATE) IS NULL
      OR starts_with(f[6], '0000') THEN 'value' END AS reason
  FROM cells)
"""

# the JSON functions take commas before closing brackets, which no JSON has
_ITEMS = """
RECURSIVE bodies AS (SELECT workflow_id, CAST(body AS JSON) AS b FROM workflows WHERE json_valid(body)
  AND NOT regexp_matches(regexp_replace(body, '"([^"\\\\]|\\\\.)*"', '0', 'g'), ',\\s*[\\]}]')),
items AS (
  SELECT workflow_id, form, b AS v, CAST(NULL AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS node, CAST(NULL AS VARCHAR) AS parent,
    '' AS ptr, false AS own, true AS root
  FROM (SELECT workflow_id, b, CASE WHEN json_type(b, '/nodes') = 'ARRAY' THEN 'ui' WHEN json_type(b) = 'OBJECT'
      AND len(json_keys(b)) > 0 AND list_bool_and(list_transform(json_keys(b), lambda k:
        json_type(b, '/' || replace(replace(k, '~', '~0'), '/', '~1') || '/class_type') IS NOT NULL)) THEN 'prompt' END AS form
    FROM bodies) WHERE form IS NOT NULL
  UNION ALL
  SELECT workflow_id, form, c, CASE WHEN json_type(v) = 'OBJECT' THEN step END,
    CASE WHEN o THEN coalesce(node, '') || ptr || '/' || e ELSE node END,
    CASE WHEN o THEN coalesce(node, '') ELSE parent END, CASE WHEN o THEN '' ELSE ptr || '/' || e END, o, false
  FROM (SELECT *, json_type(c) = 'OBJECT' AND (json_type(v) = 'ARRAY' AND k IS NOT DISTINCT FROM 'nodes'
          OR form = 'prompt' AND root) AS o
        FROM (SELECT *, json_extract(v, '/' || e) AS c
              FROM (SELECT *, replace(replace(step, '~', '~0'), '/', '~1') AS e
                    FROM (SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v) WHEN 'ARRAY' THEN
                            list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda x: CAST(x AS VARCHAR)) END) AS step
                          FROM items))))
)
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_sound": p2_sound,
    "p2_reasons": p2_reasons,
    "p5_found": p5_found,
    "p5_nodes": p5_nodes,
}

_NAME = r"\A[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?(?:\[[A-Za-z0-9._-]+(?:,[A-Za-z0-9._-]+)*\])?\z"
_VERSION = r"\A(?:[0-9]+(?:\.[0-9]+)*(?:(?:a|b|rc)[0-9]+)?(?:\.post[0-9]+)?(?:\.dev[0-9]+)?(?:\+[a-z0-9]+(?:\.[a-z0-9]+)*)?)?\z"
_BROKEN_RULES = {
    "target is empty": "f[1] = ''",
    "source_file is empty": "f[2] = ''",
    "line isn''t one to five digits": r"NOT regexp_matches(f[3], '\A[0-9]{1,5}\z')",
    "name isn''t well formed": f"NOT regexp_matches(f[4], '{_NAME}')",
    "version isn''t well formed": f"NOT regexp_matches(f[5], '{_VERSION}')",
    "declared_at isn''t a calendar date": r"NOT regexp_matches(f[6], '\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z') OR try_cast(f[6] AS DATE) IS NULL "
    "OR starts_with(f[6], '0000')",
}

SQL = {
    "p2_reasons": f"""WITH {_PARSED} SELECT reason, error, count(*) AS n_records FROM (
        SELECT reason, reason AS error FROM judged WHERE reason IN ('quoting', 'columns')
        {" ".join(f"UNION ALL SELECT reason, '{e}' FROM judged WHERE reason = 'value' AND ({rule})" for e, rule in _BROKEN_RULES.items())}) GROUP BY reason, error""",
    "p2_found": f"WITH {_PARSED} SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_found": f"""WITH {_ITEMS} SELECT workflow_id, parent AS parent_ptr, node AS node_ptr, ptr AS value_ptr FROM items
        WHERE node IS NOT NULL AND json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL')""",
    "p5_nodes": f"""WITH {_ITEMS} SELECT workflow_id, parent AS parent_ptr, node AS node_ptr, json_extract_string(v, '/id') AS node_id,
        json_extract_string(v, CASE WHEN json_type(v, '/class_type') IS NULL THEN '/type' ELSE '/class_type' END) AS node_type
        FROM items WHERE own""",
    "p2_sound": f"""WITH {_PARSED} SELECT raw_id, f[1] AS target, f[2] AS source_file, CAST(f[3] AS INTEGER) AS line,
        f[4] AS name, nullif(f[5], '') AS version, f[6] AS declared_at FROM judged WHERE reason IS NULL""",
}
