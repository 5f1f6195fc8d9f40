"""A file tree as a DataFrame: a Python data source whose filters act before a file's content is read."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftstone.runtime import ship
from siftstone.sources.ignore import Rules, directories, looks_binary, rule_lines, skipped_by_name

SCHEMA = "path string, abs_path string, size bigint, mtime double, content binary"
#: Directories of a partition, about; a directory's files are read by one task.
DIRECTORIES = 64


class Folders(InputPartition):
    def __init__(self, folders: list[str]):
        self.folders = folders


def indexable(root: str, relative: str, rules: Rules, most: int) -> bool:
    """Whether a file of a tree is to be indexed; the cheap tests come first, its first bytes last."""
    full = os.path.join(root, relative)
    if os.path.islink(full) or not os.path.isfile(full) or skipped_by_name(relative) or rules.ignores(relative):
        return False
    try:
        if os.stat(full).st_size > most:
            return False
        with open(full, "rb") as f:
            return not looks_binary(f.read(4096))
    except OSError:
        return False


class TreeReader(DataSourceReader):
    """Plans by directories, which the driver lists; files are listed, judged and read where a partition runs."""

    def __init__(self, options: dict):
        self.root, self.most, self.folders = options["path"], int(options.get("maxfilebytes", 1_000_000)), int(options.get("directories", DIRECTORIES))
        self.rules = Rules.of(json.loads(options.get("rules", "[]")))

    def partitions(self) -> list[InputPartition]:
        found = [os.path.relpath(d, self.root) for d in directories(Path(self.root))]
        return [Folders(found[i : i + self.folders]) for i in range(0, len(found), self.folders)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in partition.folders:
            for name in sorted(os.listdir(os.path.join(self.root, folder))):
                relative = os.path.normpath(os.path.join(folder, name)).replace(os.sep, "/")
                if indexable(self.root, relative, self.rules, self.most):
                    full = os.path.join(self.root, relative)
                    try:
                        stat = os.stat(full)
                        with open(full, "rb") as f:
                            yield relative, full, stat.st_size, stat.st_mtime, f.read()
                    except OSError:
                        yield relative, full, None, None, None  # seen, but not to be read now


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def scan_tree(spark: SparkSession, root: str, max_file_bytes: int = 1_000_000) -> DataFrame:
    """path, abs_path, size, mtime, content (bytes; null if unreadable) of the indexable files below a directory that all executors see.

    Ignore rules are gathered here, where the user's own excludes are known, and go along as an option.
    """
    ship(spark)
    spark.dataSource.register(TreeSource)
    at = Path(root).resolve()
    return spark.read.format("filetree").option("maxFileBytes", max_file_bytes).option("rules", json.dumps(rule_lines(at))).load(str(at))


def decoded(files: DataFrame, repo: str) -> DataFrame:
    """repo, path, abs_path, file_hash, size, mtime, text, readable; not readable are files whose bytes aren't UTF-8 or weren't there."""
    text = F.col("content").cast("string")
    readable = F.coalesce(F.is_valid_utf8(text), F.lit(False))
    return files.select(F.lit(repo).alias("repo"), "path", "abs_path", F.sha2("content", 256).alias("file_hash"), "size", "mtime", F.when(readable, text).alias("text"), readable.alias("readable"))
