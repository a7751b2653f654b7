"""URLs in text, and those that a feed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.functions.text import URL, cut_after, normal_url
from tidesift.schema import as_findings
from tidesift.session import small_side


def url_mentions(texts: DataFrame) -> DataFrame:
    """target, rel_path, line and url for each URL of each line. A URL never spans lines, so lines are searched one by
    one; equal URLs of a line give one row."""
    hinted = texts.where(F.col("text").contains("://"))
    lines = hinted.select("target", "rel_path", F.posexplode(F.split("text", "\n", -1)).alias("_i", "_line"))
    found = lines.where(F.col("_line").contains("://")).select(
        "target",
        "rel_path",
        (F.col("_i") + 1).alias("line"),
        F.explode(F.array_distinct(F.regexp_extract_all("_line", F.lit(URL), 1))).alias("url"),
    )
    return found


def first_mentions(mentions: DataFrame) -> DataFrame:
    """Per target and URL as written: the first place, by path and line, and n_mentions."""
    return (
        mentions.groupBy("target", "url")
        .agg(F.min(F.struct("rel_path", "line")).alias("_first"), F.count("*").alias("n_mentions"))
        .select("target", "url", "_first.rel_path", "_first.line", "n_mentions")
    )


def url_findings(texts: DataFrame, feed: DataFrame) -> DataFrame:
    """A high finding per target and listed URL, at its first place. Case and slashes at the end don't matter.

    The feed is matched before places are grouped, so only listed URLs are shuffled. Null text gives nothing.
    """
    listed = feed.select(normal_url(F.col("url")).alias("_u")).distinct()
    mentions = url_mentions(texts).withColumn("_u", normal_url(F.col("url")))
    hits = first_mentions(mentions.join(small_side(listed), "_u", "left_semi"))
    return as_findings(
        hits,
        "L1",
        "url",
        severity=F.lit("high"),
        category=F.lit("known_malicious_url"),
        title=F.lit("A listed URL is mentioned"),
        file=F.col("rel_path"),
        line=F.col("line"),
        snippet=cut_after(F.col("url"), 200),
        explanation=F.lit("The feed of malicious destinations lists this URL."),
    )
