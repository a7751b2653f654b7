"""Workflow files: their root nodes, what their widgets hold, and detectors over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.functions.text import WIDGET_URL, cut_within
from tidesift.operators.literal import literal_hits
from tidesift.operators.nested import parse_workflows
from tidesift.schema import as_findings
from tidesift.session import small_side

_NODES = """
if(_form = 'ui',
   filter(transform(try_variant_get(_map['nodes'], '$', 'array<variant>'), (v, i) -> named_struct(
     'pos', i, 'key', cast(null as string), 'm', try_variant_get(v, '$', 'map<string,variant>'))), n -> n.m is not null),
   transform(map_entries(_map), (e, i) -> named_struct(
     'pos', i, 'key', e.key, 'm', try_variant_get(e.value, '$', 'map<string,variant>'))))
"""

#: A widget's place and value: elements of an array, keys of an object, letters of a string; an input has place -1.
_WIDGETS = """
concat(
  if(_form = 'ui', coalesce(
    transform(try_variant_get(n.m['widgets_values'], '$', 'array<variant>'), (v, i) -> named_struct('idx', i, 'v', v)),
    cast(array() as array<struct<idx:int,v:variant>>)), cast(array() as array<struct<idx:int,v:variant>>)),
  if(_form = 'prompt', coalesce(
    transform(map_entries(try_variant_get(n.m['inputs'], '$', 'map<string,variant>')),
              e -> named_struct('idx', -1, 'v', e.value)),
    cast(array() as array<struct<idx:int,v:variant>>)), cast(array() as array<struct<idx:int,v:variant>>)))
"""


def root_nodes(workflows: DataFrame, key: str = "workflow_id", body: str = "body") -> DataFrame:
    """key, form, node_pos, node_id, node_type and n_widgets of each root node. Entries of a node list that aren't objects
    are skipped; in prompt form the node's id is its key."""
    return _opened(workflows, key, body).select(
        F.col("_id").alias(key), F.col("_form").alias("form"), "node_pos", "node_id", "node_type", F.size("_w").alias("n_widgets")
    )


def _opened(workflows: DataFrame, key: str, body: str) -> DataFrame:
    parsed = parse_workflows(workflows, key, body)
    opened = parsed.withColumn("_nodes", F.expr(_NODES)).select("_id", "_form", F.explode("_nodes").alias("n"))
    text = "try_variant_get({}, '$', 'string')".format
    return opened.select(
        "_id",
        "_form",
        F.col("n.pos").alias("node_pos"),
        F.expr(f"coalesce(n.key, {text('n.m[' + repr('id') + ']')})").alias("node_id"),
        F.expr(f"if(_form = 'ui', {text('n.m[' + repr('type') + ']')}, {text('n.m[' + repr('class_type') + ']')})").alias("node_type"),
        F.expr(_WIDGETS).alias("_w"),
        F.expr("n.m['widgets_values']").alias("_raw"),
    )


def string_widgets(workflows: DataFrame, key: str = "workflow_id", body: str = "body") -> DataFrame:
    """key, node_pos, node_id, node_type, idx and value of each widget of a root node that is a string; idx is -1 for
    inputs. Values inside nested lists and objects aren't widgets; a widget object counts with its keys."""
    opened = _opened(workflows, key, body)
    meta = [F.col("_id").alias(key), "node_pos", "node_id", "node_type"]
    listed = opened.select(*meta, F.explode("_w").alias("w")).where("schema_of_variant(w.v) = 'STRING'")
    keys = opened.select(
        *meta, F.posexplode(F.expr("map_keys(try_variant_get(if(_form = 'ui', _raw, null), '$', 'map<string,variant>'))")).alias("idx", "value")
    )
    return listed.select(
        key, "node_pos", "node_id", "node_type", "w.idx", F.expr("try_variant_get(w.v, '$', 'string')").alias("value")
    ).unionByName(keys)


def widget_text(widgets: DataFrame, key: str = "workflow_id") -> DataFrame:
    """key, node_pos and the node's widget strings joined by line feeds, in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return widgets.groupBy(key, "node_pos").agg(F.array_join(F.transform(ordered, lambda w: w.value), "\n").alias("text"))


def widget_urls(widgets: DataFrame) -> DataFrame:
    """The widgets' URLs, without punctuation at their end: the widget's columns and url."""
    found = widgets.where(F.col("value").contains("://")).withColumn(
        "url", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(WIDGET_URL), 1)))
    )
    return found.withColumn("url", F.regexp_replace("url", r"[.,;:!?]+\z", "")).drop("value")


def widget_url_findings(widgets: DataFrame, feed: DataFrame, source: DataFrame, key: str = "workflow_id") -> DataFrame:
    """A critical finding per node and listed URL, exactly as written. source: key, target and source of the files."""
    listed = feed.select("url").distinct()
    hits = widget_urls(widgets).join(small_side(listed), "url", "left_semi").select(key, "node_id", "node_type", "url").distinct()
    return as_findings(
        hits.join(source, key),
        "WL1",
        "url",
        severity=F.lit("critical"),
        category=F.lit("malicious_url_in_widget"),
        title=F.concat(F.lit("Listed URL in a widget: "), cut_within(F.col("url"), 80)),
        file=F.col("source"),
        snippet=F.col("url"),
        explanation=F.concat(F.lit("Node "), F.coalesce("node_id", F.lit("?")), F.lit(" ("), F.coalesce("node_type", F.lit("?")), F.lit(") points to it.")),
        cwe=F.lit("CWE-829"),
    )


def widget_literal_hits(widgets: DataFrame, patterns: DataFrame, key: str = "workflow_id") -> DataFrame:
    """key, node_id, node_type, pattern, category, severity, cwe and value: each pattern once a node, with the first widget
    that holds it."""
    placed = widgets.select(F.struct(key, "node_id", "node_type", "node_pos", "idx", "value").alias("_k"), F.col("value").alias("text"))
    hits = literal_hits(placed, patterns, "_k")
    first = hits.groupBy(f"_k.{key}", "_k.node_id", "pattern").agg(
        F.min(F.struct("_k.node_pos", "_k.idx", "_k.value", "_k.node_type", "category", "severity", "cwe")).alias("_f")
    )
    return first.select(key, "node_id", "_f.node_type", "pattern", "_f.category", "_f.severity", "_f.cwe", "_f.value")


def widget_literal_findings(widgets: DataFrame, patterns: DataFrame, source: DataFrame, key: str = "workflow_id") -> DataFrame:
    """A finding per node and pattern in any of its widgets, with the severity of the pattern's category."""
    return as_findings(
        widget_literal_hits(widgets, patterns, key).join(source, key),
        "WL2",
        "pat",
        severity=F.col("severity"),
        category=F.col("category"),
        title=F.concat("category", F.lit(": `"), cut_within(F.col("pattern"), 60), F.lit("` in a widget of "), F.coalesce("node_type", F.lit("?"))),
        file=F.col("source"),
        snippet=cut_within(F.col("value"), 200),
        explanation=F.concat(F.lit("A widget of node "), F.coalesce("node_id", F.lit("?")), F.lit(" holds `"), "pattern", F.lit("`.")),
        cwe=F.col("cwe"),
    )
