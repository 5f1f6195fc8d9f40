"""The stored index: versioned Parquet tables, a folder for each repository, and numbered manifests of which the last one counts.

A run ends by renaming a new manifest to the next number. No manifest is ever replaced: a reader sees whole versions only, a run that fails or
stops anywhere leaves the index as it was, and of two runs that end with the same number one fails. Versions that the last manifest no longer
names stay until the KEPT manifests that name them are gone, for readers that are still at it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from contextlib import suppress
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.schemas import TABLES


#: Manifests that are kept, the last one included.
KEPT = 3


@dataclass(frozen=True)
class Repo:
    repo_id: int
    name: str
    path: str
    created_at: str
    updated_at: str
    version: int = 0
    #: Number of chunks and of their tokens, for BM25 over all repositories.
    chunks: int = 0
    tokens: int = 0
    files: int = 0


@dataclass(frozen=True)
class Manifest:
    repos: tuple[Repo, ...] = ()
    settings: dict[str, str] = field(default_factory=dict)
    next_id: int = 1
    #: Number of the stored manifest that this one was made from; 0 for none.
    number: int = 0

    def by_name(self, name: str) -> Repo | None:
        return next((r for r in self.repos if r.name == name), None)

    def by_path(self, path: str) -> Repo | None:
        return next((r for r in self.repos if r.path == path), None)

    def with_repo(self, repo: Repo) -> Manifest:
        rest = tuple(r for r in self.repos if r.repo_id != repo.repo_id)
        return replace(self, repos=tuple(sorted((*rest, repo), key=lambda r: r.name)), next_id=max(self.next_id, repo.repo_id + 1))

    def without(self, repo: Repo) -> Manifest:
        return replace(self, repos=tuple(r for r in self.repos if r.repo_id != repo.repo_id))


class Store:
    """Tables below a path on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def init(self) -> None:
        self._fs.mkdirs(self._path(f"{self.path}/tables"))

    # the manifests

    def numbers(self) -> list[int]:
        """Numbers of the manifests there are, ascending."""
        at = self._path(f"{self.path}/manifests")
        if not self._fs.exists(at):
            return []
        names = [str(f.getPath().getName()) for f in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"[0-9]+[.]json", n))

    def manifest(self) -> Manifest:
        found = self.numbers()
        return self._read(found[-1]) if found else Manifest()

    def _read(self, number: int) -> Manifest:
        stream = self._fs.open(self._path(f"{self.path}/manifests/{number:012d}.json"))
        try:
            said = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Manifest(tuple(Repo(**r) for r in said["repos"]), said["settings"], said["next_id"], number)

    def commit(self, manifest: Manifest) -> Manifest:
        """Write the manifest aside, then rename it to the number after the one that it was made from; FileExistsError if another run was first."""
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        number = manifest.number + 1
        new, at = self._path(f"{self.path}/manifests/_new-{uuid.uuid4().hex}"), self._path(f"{self.path}/manifests/{number:012d}.json")
        stream = self._fs.create(new, False)
        stream.write(bytearray(json.dumps({"repos": [asdict(r) for r in manifest.repos], "settings": manifest.settings, "next_id": manifest.next_id}).encode()))
        stream.close()
        if self._fs.exists(at) or not self._fs.rename(new, at):
            self._fs.delete(new, False)
            raise FileExistsError(f"another run has changed the index in {self.path}")
        for old in self.numbers()[:-KEPT]:
            self._fs.delete(self._path(f"{self.path}/manifests/{old:012d}.json"), False)
        return replace(manifest, number=number)

    def update(self, change: Callable[[Manifest], Manifest], tries: int = 20) -> Manifest:
        """Commit a change of the last manifest; made anew from the next one if another run commits first."""
        for _ in range(tries - 1):
            with suppress(FileExistsError):
                return self.commit(change(self.manifest()))
        return self.commit(change(self.manifest()))

    def prune(self, repo: Repo) -> None:
        """Delete versions of a repository before its present one that no manifest names any more."""
        named = {r.version for n in self.numbers() for r in self._read(n).repos if r.repo_id == repo.repo_id}
        for table in TABLES:
            at = self._path(f"{self.path}/tables/{table}/repo_id={repo.repo_id}")
            for f in self._fs.listStatus(at) if self._fs.exists(at) else ():
                version = int(str(f.getPath().getName()).removeprefix("version="))
                if version < repo.version and version not in named:
                    self._fs.delete(f.getPath(), True)

    # tables

    def folder(self, table: str, repo: Repo, version: int | None = None) -> str:
        return f"{self.path}/tables/{table}/repo_id={repo.repo_id}/version={repo.version if version is None else version}"

    def read(self, table: str, repos: tuple[Repo, ...]) -> DataFrame:
        """Rows of a table for some repositories, with their present names as repo; only their folders are listed."""
        live = [r for r in repos if r.version]
        if not live:
            return self.spark.createDataFrame([], TABLES[table]).withColumn("repo", F.lit("").cast("string"))
        schema = self.spark.createDataFrame([], f"{TABLES[table]}, repo_id int, version int" + (", bucket int" if table == "postings" else "")).schema
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/tables/{table}").parquet(*[self.folder(table, r) for r in live])
        if table == "symbols":  # versions written before there were kinds have none
            rows = rows.withColumn("kind", F.coalesce("kind", F.lit("")))
        names = self.spark.createDataFrame([(r.repo_id, r.name) for r in live], "repo_id int, repo string")
        if len(live) == 1:
            return rows.drop("repo_id", "version").withColumn("repo", F.lit(live[0].name))
        return rows.join(F.broadcast(names), "repo_id").drop("repo_id", "version")  # a row for each repository of the manifest

    def write(self, table: str, repo: Repo, version: int, rows: DataFrame, partition: str | None = None) -> None:
        out = rows.write.mode("overwrite")
        (out.partitionBy(partition) if partition else out).parquet(self.folder(table, repo, version))

    def drop(self, repo: Repo) -> None:
        """Delete all versions of a repository."""
        for table in TABLES:
            self._fs.delete(self._path(f"{self.path}/tables/{table}/repo_id={repo.repo_id}"), True)
