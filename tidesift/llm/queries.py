"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesift.llm.encodings import garbled_documents
from tidesift.llm.leakage import leaked_passages, removal_spans
from tidesift.llm.mixing import copies_of, mixing_rates, mixture, shares_reached, token_counts
from tidesift.llm.names import mapped_names, name_candidates
from tidesift.llm.origin import file_layout, foreign_files, judged_files
from tidesift.llm.secrets import credentials, redacted_files
from tidesift.llm.unparsable import judged_sources, parse_rates, unparsable_files
from tidesift.plans.scan_queries import decoded_sql
from tidesift.plans.text_queries import strip_sql
from tidesift.session import shared_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials(table(spark, sf_dir, "plugin_files")).select("file_id", "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_files(table(spark, sf_dir, "plugin_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_files(table(spark, sf_dir, "plugin_files"))


def p3_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_layout(table(spark, sf_dir, "plugin_files"))


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those statistics of layout that SQL can say."""
    layout = file_layout(table(spark, sf_dir, "plugin_files"))
    return layout.select("file_id", *[F.round(c, 9).alias(c) for c in ("mean_line", "max_line", "white", "alnum")])


def p3_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_files(table(spark, sf_dir, "plugin_files")).where("kind is null").select("file_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps, reference = table(spark, sf_dir, "dependencies"), table(spark, sf_dir, "package_baseline")
    return mapped_names(deps, reference).select("dep_id", "pkg_id")


def p4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_candidates(table(spark, sf_dir, "dependencies"), table(spark, sf_dir, "package_baseline"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unparsable_files(table(spark, sf_dir, "plugin_files")).select("file_id")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rates(judged_sources(table(spark, sf_dir, "plugin_files")))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_spans(_passages(spark, sf_dir))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def _stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and of a size that is known."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _mixing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = _stored(token_counts(table(spark, sf_dir, "documents")), "token-counts")
    return sizes, _stored(mixing_rates(sizes, table(spark, sf_dir, "source_weights")), "rates")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, rates = _mixing(spark, sf_dir)
    return shares_reached(mixture(sizes, rates), rates)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, rates = _mixing(spark, sf_dir)
    return mixture(sizes, rates)


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rates = _mixing(spark, sf_dir)
    return copies_of(table(spark, sf_dir, "documents"), rates).select("doc_id", "source", "copy_no", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p3_found": p3_found,
    "p3_layout": p3_layout,
    "p3_lines": p3_lines,
    "p3_handwritten": p3_handwritten,
    "p4_found": p4_found,
    "p4_candidates": p4_candidates,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p7_spans": p7_spans,
    "p7_items": p7_items,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_copies": p8_copies,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_WORDS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))".format
_MARKUP = r"'<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z][A-Za-z0-9]+|#[0-9]+|#[xX][0-9A-Fa-f]+);'"


def _readings(table_name: str, key: str) -> str:
    """The words of each text, as it is and without markup."""
    return f"""SELECT {key} AS k, 0 AS r, {_WORDS("text")} AS w FROM {table_name} WHERE text IS NOT NULL
      UNION ALL SELECT {key}, 1, {_WORDS(f"regexp_replace(text, {_MARKUP}, ' ', 'gs')")} FROM {table_name}
        WHERE text IS NOT NULL AND regexp_replace(text, {_MARKUP}, ' ', 'gs') <> text"""


# alignments of a document and an item that have six words in common, a score for each of their words (one in ten may be
# replaced), and passages of at least 18 words whose scores don't add up to less than nothing
_LEAKED = f"""
docs AS ({_readings("documents", "doc_id")}),
items AS (SELECT * FROM ({_readings("eval_items", "item_id")}) WHERE len(w) >= 18),
doc_words AS (SELECT k, r, i AS p, w[i] AS word FROM docs, unnest(range(1, len(w) + 1)) AS u(i)),
item_words AS (SELECT k, r, i AS p, w[i] AS word FROM items, unnest(range(1, len(w) + 1)) AS u(i)),
doc_runs AS (SELECT k, r, i AS p, array_to_string(w[i:i + 5], ' ') AS run FROM docs, unnest(range(1, len(w) - 4)) AS u(i)),
item_runs AS (SELECT k, r, i AS p, array_to_string(w[i:i + 5], ' ') AS run FROM items, unnest(range(1, len(w) - 4)) AS u(i)),
aligned AS (SELECT DISTINCT d.k AS doc_id, d.r AS dr, i.k AS item_id, i.r AS ir, d.p - i.p AS shift FROM doc_runs d JOIN item_runs i USING (run)),
scored AS (SELECT a.*, i.p, CASE WHEN d.word = i.word THEN 1 ELSE -9 END AS s FROM aligned a
  JOIN item_words i ON i.k = item_id AND i.r = ir JOIN doc_words d ON d.k = doc_id AND d.r = dr AND d.p = i.p + shift),
summed AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, dr, item_id, ir, shift ORDER BY p) AS total FROM scored),
judged AS (SELECT doc_id, item_id, total, min(total - s) OVER (PARTITION BY doc_id, dr, item_id, ir, shift ORDER BY p
  ROWS BETWEEN UNBOUNDED PRECEDING AND 17 PRECEDING) AS least FROM summed),
leaked AS (SELECT DISTINCT doc_id, item_id FROM judged WHERE total >= least)
"""

SQL: dict[str, str] = {
    # bytes beyond ASCII count as letters
    "p3_lines": rf"""WITH t AS (SELECT file_id, {decoded_sql("content")} AS text FROM plugin_files WHERE content IS NOT NULL AND suffix IN ('.py', '.js')),
        b AS (SELECT file_id, text, CAST(octet_length(encode(text)) AS DOUBLE) AS n,
          length(text) - length(regexp_replace(text, '[\t-\r\x1c-\x20]', '', 'g')) AS w,
          length(text) - length(regexp_replace(text, '[^0-9A-Za-z\x{{80}}-\x{{10ffff}}]', '', 'g')) AS other FROM t),
        l AS (SELECT file_id, list_filter(string_split(text, chr(10)), lambda x: {strip_sql("x")} <> '') AS l FROM t)
        SELECT b.file_id, round(CASE WHEN len(l) > 0 THEN list_sum(list_transform(l, lambda x: length(x))) / len(l) ELSE 0.0 END, 9) AS mean_line,
          round(CAST(coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS DOUBLE), 9) AS max_line,
          round(w / greatest(n, 1), 9) AS white, round((n - other) / greatest(n, 1), 9) AS alnum FROM b JOIN l ON b.file_id = l.file_id""",
    "p7_found": f"WITH {_LEAKED} SELECT doc_id, item_id FROM leaked",
    "p7_items": f"WITH {_LEAKED} SELECT item_id, count(*) AS n_documents FROM leaked GROUP BY item_id",
}
