"""Folders of plug-ins as a table of files.

The built-in file sources skip names that start with `_` or `.`, `__init__.py` among them, so this is a Python data
source: the driver lists, each partition reads the bytes of many files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidesift.session import ship_package

# fixed values: folders that are left out, and suffixes of text files
PRUNED = {".git", "__pycache__", ".venv", "venv", "node_modules"}
TEXT_SUFFIXES = (".py", ".txt", ".toml", ".md", ".yaml", ".yml", ".json")
SCHEMA = "target string, rel_path string, suffix string, content binary, n_bytes bigint"
#: A partition reads files of about so many bytes, and at most so many of them.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 2_000


@dataclass
class Share(InputPartition):
    """Some files: (target, absolute path, path below the target)."""

    files: list[tuple[str, str, str]]


def _walk(root: str) -> Iterator[tuple[str, str, int]]:
    for folder, subfolders, names in os.walk(root):
        subfolders[:] = sorted(d for d in subfolders if d not in PRUNED)
        for name in sorted(names):
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                yield path, os.path.relpath(path, root).replace(os.sep, "/"), os.path.getsize(path)


class TreeReader(DataSourceReader):
    def __init__(self, path: str, batch: bool):
        self.path, self.batch = path, batch

    def partitions(self) -> list[Share]:
        root = os.path.abspath(self.path)
        if not os.path.exists(root):
            raise FileNotFoundError(root)
        if os.path.isfile(root):
            root = os.path.dirname(root)
        if self.batch:
            targets = sorted(e.name for e in os.scandir(root) if e.is_dir() and not e.name.startswith("."))
            places = [(t, os.path.join(root, t)) for t in targets]
        else:
            places = [(os.path.basename(root), root)]
        shares, now, size = [], [], 0
        for target, place in places:
            for path, rel, n in _walk(place):
                now.append((target, path, rel))
                size += n
                if size >= PARTITION_BYTES or len(now) >= PARTITION_FILES:
                    shares.append(Share(now))
                    now, size = [], 0
        return [*shares, Share(now)] if now or not shares else shares

    def read(self, partition: Share) -> Iterator[tuple]:
        for target, path, rel in partition.files:
            with open(path, "rb") as f:
                content = f.read()
            yield target, rel, PurePosixPath(rel).suffix, content, len(content)


class TreeSource(DataSource):
    """format("plugin_tree"): option path, and batch=true where each folder below it is a target of its own."""

    @classmethod
    def name(cls) -> str:
        return "plugin_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("batch", "false").lower() == "true")


def read_tree(spark: SparkSession, path: str, batch: bool = False) -> DataFrame:
    """The files below a folder: target, rel_path, suffix, content, n_bytes, and file_id derived from target and path.

    PRUNED folders below the root are left out; the root itself may lie in one. A file given as the root stands for its
    folder; a missing root is an error.
    """
    ship_package(spark)
    spark.dataSource.register(TreeSource)
    files = spark.read.format("plugin_tree").option("path", path).option("batch", str(batch).lower()).load()
    return files.withColumn("file_id", F.xxhash64("target", "rel_path"))
