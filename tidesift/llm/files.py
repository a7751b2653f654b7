"""What the operators on plugin files share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.session import ship_package, spread
from tidesift.sources.texts import decode_text

_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
    "array<bigint>": pa.list_(pa.int64()),
}


def map_files(
    files: DataFrame,
    suffixes: tuple[str, ...],
    one: Callable[..., Iterator[tuple]],
    schema: str,
    extra: tuple[str, ...] = (),
    nulls: bool = False,
) -> DataFrame:
    """The rows that `one(file_id, text, *extra)` yields for each file with one of the suffixes and non-null content; with
    nulls, for one with null content too, with text None.

    Only these columns are read, and nothing is shuffled. Arrow batches are read one after another, so a task holds
    one batch of files.
    """
    ship_package(files.sparkSession)
    names, kinds = zip(*(part.split() for part in schema.split(",")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [_ARROW[kind] for kind in kinds]
        for batch in batches:
            rows: list[tuple] = []
            ids, *others = (batch.column(i).to_pylist() for i in range(batch.num_columns) if i != 1)
            for key, content, *rest in zip(ids, batch.column(1), *others):
                raw = content.as_py()
                rows += one(key, None if raw is None else decode_text(raw), *rest)
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    kept = files.where(F.col("suffix").isin(*suffixes))
    kept = kept if nulls else kept.where(F.col("content").isNotNull())
    return spread(kept.select("file_id", "content", *extra)).mapInArrow(run, schema)
