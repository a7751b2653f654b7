"""File contents as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesift.sources.tree import TEXT_SUFFIXES

_MARK, _KEPT = "\ufffd", "\ufdd0\ufdd1\ufdd0"


def decode_text(content: bytes) -> str:
    """UTF-8 with invalid bytes dropped, and every line end a line feed."""
    text = content.decode("utf-8", "ignore")
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def decoded(content: Column) -> Column:
    """As decode_text, as an expression. Invalid bytes become marks, which are taken out; marks that the text has itself are
    held as noncharacters meanwhile."""
    raw = content.cast("string")
    repaired = F.make_valid_utf8(F.replace(raw, F.lit(_MARK), F.lit(_KEPT)))
    bare = F.replace(F.replace(repaired, F.lit(_MARK), F.lit("")), F.lit(_KEPT), F.lit(_MARK))
    return F.regexp_replace(F.when(F.is_valid_utf8(raw), raw).otherwise(bare), "\r\n?", "\n")


def with_text(files: DataFrame, suffixes: tuple[str, ...] = TEXT_SUFFIXES) -> DataFrame:
    """file_id, target, rel_path, suffix, n_bytes and text of the files with one of the suffixes; null for null content.
    All are expressions, so what reads only some files or columns of it reads no more of the table."""
    size = F.coalesce(F.col("n_bytes").cast("bigint"), F.length("content").cast("bigint")).alias("n_bytes")
    kept = files.where(F.col("suffix").isin(*suffixes))
    return kept.select("file_id", "target", "rel_path", "suffix", size, decoded(F.col("content")).alias("text"))
