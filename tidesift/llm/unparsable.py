"""Source files that no dialect of their language accepts."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.llm.files import map_files


def _parses(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return True


def judged_sources(files: DataFrame, confirm: bool = False) -> DataFrame:
    """One row per `.py` file: file_id, target, suffix, valid (whether its text is in one of the dialects), line_no (where it
    fails within a line, else null) and stage.

    Each text is read by generalised LL with a shared stack, for Python 3.10 to 3.13 together. confirm: a rejected file
    that the parser of the running Python takes counts as valid. An empty file is valid; null content gives no row, as
    there is no text to judge; files delivered twice are judged each.
    """

    def one(key: int, text: str, target: str | None, suffix: str) -> Iterator[tuple]:
        from tidesift.llm.python_grammar import recognise

        verdict = recognise(text)
        valid = bool(verdict.dialects) or confirm and _parses(text)
        yield key, target, suffix, valid, *((None, None) if valid else (verdict.line, verdict.stage))

    schema = "file_id bigint,target string,suffix string,valid boolean,line_no int,stage string"
    return map_files(files, (".py",), one, schema, ("target", "suffix"))


def unparsable_files(files: DataFrame, confirm: bool = False) -> DataFrame:
    """One row per `.py` file whose text is in none of the dialects: file_id, line_no and stage. See judged_sources."""
    return judged_sources(files, confirm).where("not valid").select("file_id", "line_no", "stage")


def parse_rates(judged: DataFrame) -> DataFrame:
    """Rates of unparsable files per target and suffix, from rows of judged_sources: n_files, n_unparsable and rate, counted
    before anything is shuffled. Targets without such files have rate 0; files without a target form a group of their
    own."""
    return (
        judged.groupBy("target", "suffix")
        .agg(F.count("*").alias("n_files"), F.count(F.when(~F.col("valid"), 1)).alias("n_unparsable"))
        .withColumn("rate", F.col("n_unparsable") / F.col("n_files"))
    )
