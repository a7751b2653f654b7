"""Literal patterns in lines of text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.functions.text import cut_within, stripped
from tidesift.schema import as_findings, known_severity
from tidesift.session import ship_package, small_side

#: How many patterns a join by substring is used for. Both ways give the same rows.
SUBSTRING_PATTERNS = 64
#: So many patterns are sent to a task at a time; more are searched in several passes.
BLOCK_PATTERNS = 100_000


def first_patterns(patterns: DataFrame) -> DataFrame:
    """One row per pattern: that of its first category by ordinal. Empty patterns are dropped."""
    named = patterns.where(F.length("pattern") > 0)
    keep = F.min_by(F.struct("category", "severity", "cwe", "ordinal"), "ordinal")
    return named.groupBy("pattern").agg(keep.alias("_p")).select(
        "pattern", "_p.category", known_severity(F.col("_p.severity")).alias("severity"), "_p.cwe"
    )


@lru_cache(maxsize=8)
def _automaton(patterns: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in patterns:
        found.add_word(p, p)
    found.make_automaton()
    return found


def _search(texts: DataFrame, patterns: tuple[str, ...], key: str) -> DataFrame:
    """key, line, text of the line and pattern, each pattern once a line, with one automaton for all patterns."""
    ship_package(texts.sparkSession)
    sent = texts.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _automaton(sent.value)
        for batch in batches:
            keys, lines, texts_, hits = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                seen: dict[tuple[int, str], int] = {}
                at = number = 0
                for end, pattern in search.iter(text):
                    start = end - len(pattern) + 1
                    if start >= at:
                        number += text.count("\n", at, start)
                        at, here = start, number
                    else:  # a longer pattern that ends here began before
                        here = number - text.count("\n", start, at)
                    seen.setdefault((here, pattern), start)
                for (number_, pattern), start in seen.items():
                    begin, stop = text.rfind("\n", 0, start) + 1, text.find("\n", start)
                    keys.append(i)
                    lines.append(number_ + 1)
                    texts_.append(text[begin : stop if stop >= 0 else len(text)])
                    hits.append(pattern)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keys, pa.int64())),
                    pa.array(lines, pa.int32()),
                    pa.array(texts_, pa.string()),
                    pa.array(hits, pa.string()),
                ],
                [key, "line", "line_text", "pattern"],
            )

    kind = dict(texts.dtypes)[key]
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, line int, line_text string, pattern string")


def literal_hits(texts: DataFrame, patterns: DataFrame, key: str, max_characters: int | None = None) -> DataFrame:
    """key, line, line_text, pattern, category, severity, cwe: every pattern in every line, overlapping ones too, each
    once a line. Texts are searched to their end, however long they are; max_characters, if given, is where the search
    stops in each.

    Few patterns are joined to lines by substring, in the JVM; more are searched with one automaton per task and block.
    Either way the texts stay where they are, and only patterns are sent. The key may be a struct of what is to be kept
    beside the hits.
    """
    if max_characters is not None:
        texts = texts.select(key, F.substring("text", 1, max_characters).alias("text"))
    first = first_patterns(patterns)
    names = first.select("pattern").orderBy("pattern").toLocalIterator()
    blocks = iter(lambda: tuple(r.pattern for r in islice(names, BLOCK_PATTERNS)), ())
    block = next(blocks, ())
    if len(block) > SUBSTRING_PATTERNS or any("\n" in n for n in block):
        found = _search(texts, block, key)
        for block in blocks:
            found = found.unionByName(_search(texts, block, key))
        return found.join(small_side(first), "pattern").select(key, "line", "line_text", "pattern", "category", "severity", "cwe")
    lines = texts.select(key, F.posexplode(F.split("text", "\n", -1)).alias("_i", "line_text"))
    return lines.join(F.broadcast(first), F.col("line_text").contains(F.col("pattern"))).select(
        key, (F.col("_i") + 1).alias("line"), "line_text", "pattern", "category", "severity", "cwe"
    )


def literal_findings(texts: DataFrame, patterns: DataFrame, max_characters: int | None = None) -> DataFrame:
    """A finding per file, pattern and line, with the severity of the pattern's category. texts: target, rel_path and
    text."""
    placed = texts.select(F.struct("target", "rel_path").alias("_k"), "text")
    hits = literal_hits(placed, patterns, "_k", max_characters)
    return as_findings(
        hits.select("_k.target", "_k.rel_path", *hits.columns[1:]),
        "L2",
        "pat",
        severity=F.col("severity"),
        category=F.col("category"),
        title=F.concat("category", F.lit(": `"), cut_within(F.col("pattern"), 60), F.lit("` is in the text")),
        file=F.col("rel_path"),
        line=F.col("line"),
        snippet=cut_within(stripped(F.col("line_text")), 200),
        explanation=F.concat(F.lit("The text holds `"), "pattern", F.lit("`, one of the patterns of "), "category", F.lit(".")),
        cwe=F.col("cwe"),
    )
