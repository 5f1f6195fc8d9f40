"""The engine's front: index repositories and query them. Everything heavy is a Spark plan; here is what decides and renders."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import UTC, datetime
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone import __version__
from siftstone.config import Options, store_path
from siftstone.functions.text import kind_filter, query_phrases
from siftstone.operators import catalogue, lexical, snapshot
from siftstone.operators.symbols import kind_chunks
from siftstone.plans import ingest
from siftstone.plans import search as plan
from siftstone.runtime import session, ship
from siftstone.sources.embedders import identity_of
from siftstone.sources.files import decoded, scan_tree
from siftstone.sources.store import Manifest, Repo, Store


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


@dataclass
class Skip:
    """Why a search used no vectors."""

    reason: str | None = None
    backend: str | None = None


class Engine:
    """An index in a folder. embedder: see sources.embedders; None indexes and searches without vectors."""

    def __init__(self, path: str | Path | None = None, embedder=None, spark: SparkSession | None = None, options: Options | None = None):
        self.path, self.embedder, self.options = str(path or store_path()), embedder, options or Options()
        self.spark = spark or session()
        ship(self.spark)
        self.store = Store(self.spark, self.path)
        self.last = Skip()

    # --- what all operations need

    def init(self) -> Manifest:
        self.store.init()
        return self.store.manifest()

    def known(self, manifest: Manifest, repo: str | None) -> tuple[Repo, ...]:
        """The repositories in scope; ValueError for an unknown name."""
        if not repo:
            return manifest.repos
        if (found := manifest.by_name(repo)) is None:
            raise ValueError(f"unknown repo: {repo}. indexed repos: {', '.join(r.name for r in manifest.repos) or '(none)'}")
        return (found,)

    def table(self, name: str, repo: str | None = None) -> DataFrame:
        """A stored table as a DataFrame, for queries of one's own."""
        return self.store.read(name, self.known(self.init(), repo))

    # --- indexing

    def resolve(self, manifest: Manifest, path: str, name: str | None, now: str) -> Repo:
        """The repository of a directory: known by its path, whatever its name; a name refers to one path only."""
        wanted = name or PurePosixPath(path).name
        mine, other = manifest.by_path(path), manifest.by_name(wanted)
        if mine is None:
            if other is not None:
                raise ValueError(f"repo name '{wanted}' already refers to {other.path}; pass a different --name for this directory")
            return Repo(manifest.next_id, wanted, path, now, now)
        if name is None or mine.name == name:
            return replace(mine, updated_at=now)
        if other is not None:
            raise ValueError(f"repo name '{wanted}' already refers to {other.path}")
        return replace(mine, name=wanted, updated_at=now)

    def identity(self, manifest: Manifest) -> snapshot.Identity:
        dim, model, backend = identity_of(self.embedder)
        known = manifest.settings
        stored = int(known["vector_dim"]) if "vector_dim" in known else None
        return snapshot.Identity(stored, known.get("embed_model"), known.get("embed_backend"), dim, model, backend, self.embedder is not None)

    def index_repo(self, repo_path: str | Path, name: str | None = None) -> dict:
        """Bring a directory's index up to date; unchanged files stay as they are, and the new version appears at once."""
        root = Path(repo_path).resolve()
        if not root.is_dir():
            raise ValueError(f"repo path is not a directory: {root}")
        now = utc_now()
        self.init()
        manifest = self.store.update(lambda m: m.with_repo(self.resolve(m, str(root), name, now)))
        repo = manifest.by_path(str(root))
        scratch = f"{self.path}/tmp/{repo.repo_id}-{manifest.number}"
        try:
            return self._index(manifest, repo, root, now, scratch)
        finally:
            self.store._fs.delete(self.store._path(scratch), True)

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _index(self, manifest: Manifest, repo: Repo, root: Path, now: str, scratch: str) -> dict:
        identity = self.identity(manifest)
        present = self._kept(decoded(scan_tree(self.spark, str(root), self.options.max_file_bytes), repo.name), f"{scratch}/present")
        old = {t: self.store.read(t, (repo,)) for t in ("files", "chunks", "symbols", "postings")}
        actions = self._kept(snapshot.diff(present, old["files"], snapshot.vector_state(old["chunks"]), identity), f"{scratch}/actions")
        counted = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
        todo = actions.where(F.col("action").isin("new", "changed")).select("path")
        fresh = counted.get("new", 0) + counted.get("changed", 0)
        result = {"repo": repo.name, "path": str(root), "indexed_files": fresh, "indexed_chunks": 0, "skipped_files": counted.get("skipped", 0), "unchanged_files": counted.get("unchanged", 0), "deleted_files": counted.get("deleted", 0), "embedded_chunks": 0, "embedding_failures": 0, "degraded": False, "db_path": self.path}
        settings = dict(manifest.settings)
        if fresh or counted.get("deleted"):
            texts = present.join(F.broadcast(todo) if fresh <= 1_000_000 else todo, "path", "left_semi")
            files = self._kept(ingest.parsed(texts, repo.name, self.options), f"{scratch}/parsed")
            if self.embedder is not None and fresh:
                vectors = self._kept(ingest.embedded(files, self.embedder, self.options), f"{scratch}/embedded")
                failed = F.filter(F.zip_with("vectors", "asked", lambda v, a: v.isNull() & a), lambda x: x)
                totals = vectors.agg(F.sum(F.size(F.filter("vectors", lambda v: v.isNotNull()))), F.sum(F.size(failed)), F.max("degraded"), F.max(F.array_max(F.transform("vectors", lambda v: F.size(v))))).first()
                result |= {"embedded_chunks": totals[0] or 0, "embedding_failures": totals[1] or 0, "degraded": bool(totals[2])}
                if (totals[3] or 0) > 0:
                    settings["vector_dim"] = str(totals[3])
            else:
                vectors = self.spark.createDataFrame([], ingest.EMBEDDED)
            staged = texts.drop("repo").join(files, "path").join(vectors.select("path", "vectors"), "path", "left")
            repo = self._publish(repo, manifest.number, old, ingest.rows_of(staged, now), actions, result)
        dim, model, backend = identity_of(self.embedder)
        settings |= {k: v for k, v in (("embed_model", model), ("embed_backend", backend)) if v is not None}
        begun = manifest.by_path(repo.path).version

        def ended(latest: Manifest) -> Manifest:
            now = latest.by_path(repo.path)
            if now is None or now.version != begun:
                raise RuntimeError(f"{repo.name} was changed by another run")
            return replace(latest.with_repo(repo), settings=latest.settings | settings)

        self.store.update(ended)  # last, so that an interrupted run is done again
        self.store.prune(repo)
        return result

    def _publish(self, repo: Repo, version: int, old: dict[str, DataFrame], new: ingest.NewRows, actions: DataFrame, result: dict) -> Repo:
        """Write the next version's tables: what stays of the old ones and the new rows."""
        stays = actions.where(F.col("action").isin("unchanged", "skipped")).select("path")
        kept_chunks = old["chunks"].join(stays, "path", "left_semi")
        buckets = self.options.posting_buckets
        tables = {
            "files": old["files"].join(stays, "path", "left_semi").drop("repo").unionByName(new.files),
            "chunks": kept_chunks.drop("repo").unionByName(new.chunks),
            "symbols": old["symbols"].join(stays, "path", "left_semi").drop("repo").unionByName(new.symbols),
        }
        for name, rows in tables.items():
            self.store.write(name, repo, version, rows)
        postings = old["postings"].join(kept_chunks.select("chunk_id"), "chunk_id", "left_semi").select("term", "chunk_id", "field", "pos").unionByName(new.postings)
        by_term = postings.withColumn("bucket", ingest.bucket(buckets)).repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).sortWithinPartitions("bucket", "term", "chunk_id", "field", "pos")
        self.store.write("postings", repo, version, by_term, "bucket")
        repo = replace(repo, version=version)
        n, tokens = self.store.read("chunks", (repo,)).agg(F.count("*"), F.sum("doc_len")).first()
        files = self.store.read("files", (repo,)).count()
        result["indexed_chunks"] = n - kept_chunks.count()
        return replace(repo, chunks=n, tokens=tokens or 0, files=files)

    def reindex_all(self) -> dict:
        """Index every known repository again, by name; those whose directory is gone are passed over."""
        out = []
        for r in self.init().repos:
            if Path(r.path).is_dir():
                out.append(self.index_repo(r.path, r.name))
            else:
                out.append({"repo": r.name, "path": r.path, "skipped": True, "error": "path missing"})
        return {"reindexed": sum("skipped" not in r for r in out), "repos": out, "db_path": self.path}

    def remove_repo(self, name: str) -> dict:
        manifest = self.init()
        if not name:
            raise ValueError("a repo name is needed")
        (repo,) = self.known(manifest, name)
        self.store.update(lambda m: m.without(repo))
        self.store.drop(repo)
        return {"repo": name, "deleted_files": repo.files}

    # --- search

    def search(self, query: str, repo: str | None = None, limit: int = 10, mode: str = "hybrid", path: str | None = None, lang: str | None = None, kind: str | None = None) -> list[dict]:
        """The best chunks for a query, as dicts of schemas.HIT."""
        found = self.search_plan(query, repo, limit, mode, path, lang, kind)
        return [] if found is None else [r.asDict(recursive=True) for r in found.collect()]

    def search_plan(self, query: str, repo: str | None = None, limit: int = 10, mode: str = "hybrid", path: str | None = None, lang: str | None = None, kind: str | None = None) -> DataFrame | None:
        """search() as a DataFrame; None if there is nothing to be found."""
        manifest = self.init()
        scope = self.known(manifest, repo)
        if not query or not query.strip():
            return None
        limit, mode, self.last = catalogue.clamp(limit, 100), mode or "hybrid", Skip()
        if not any(r.version for r in manifest.repos):
            if mode in ("hybrid", "vector"):
                self.last.reason = "embeddings-disabled" if self.embedder is None else "no-embedded-chunks"
            return None
        chunks = self.store.read("chunks", scope)
        vector = self.query_vector(query, chunks) if mode in ("hybrid", "vector") else None
        terms = {t for p in query_phrases(query) for t in p}
        buckets = sorted({ingest.bucket_of(t, self.options.posting_buckets) for t in terms})
        of = lambda repos: self.store.read("postings", repos).where(F.col("bucket").isin(buckets))
        wanted = kind_filter(kind)
        corpus = lexical.Corpus(sum(r.chunks for r in manifest.repos), sum(r.tokens for r in manifest.repos))
        tables = plan.Scope(chunks, of(scope), self.store.read("chunks", manifest.repos), of(manifest.repos), corpus, None if wanted is None else kind_chunks(self.store.read("symbols", scope), wanted))
        backend = self.options.vector_backend
        if vector and backend == "knn_l2" and manifest.settings.get("vector_dim") != str(len(vector)):
            backend = "cosine_scan"
        self.last.backend = backend if vector else None
        return plan.search(tables, query, mode, limit, path, lang, vector, backend, self.options.doubtful, self.options.lexical_candidates)

    def query_vector(self, query: str, chunks: DataFrame) -> list[float] | None:
        """The query's vector, unless there is none or nothing to compare it with; self.last says why."""
        if self.embedder is None:
            self.last.reason = "embeddings-disabled"
            return None
        try:
            vector = [float(x) for x in self.embedder.embed(query)]
        except Exception:
            vector = []
        if not vector:
            self.last.reason = "query-embedding-failed"
        elif chunks.where("embedding IS NOT NULL").select("chunk_id").isEmpty():
            self.last.reason = "no-embedded-chunks"
        return None if self.last.reason else vector

    # --- catalogue

    def list_files(self, repo: str | None = None, glob: str | None = None, limit: int = 50, lang: str | None = None) -> list[dict]:
        rows = catalogue.list_files(self.table("files", repo), glob, lang, limit)
        return self._dicts(rows.select("repo", "path", "language", "file_hash", "size", "indexed_at"))

    def list_languages(self) -> list[str]:
        return [r[0] for r in catalogue.distinct_lower(self.table("files"), "language").collect()]

    def list_kinds(self) -> list[str]:
        return [r[0] for r in catalogue.distinct_lower(self.table("symbols"), "kind").collect()]

    def list_repos(self) -> list[dict]:
        manifest = self.init()
        return self._summaries(manifest.repos)

    def _summaries(self, repos: tuple[Repo, ...]) -> list[dict]:
        if not repos:
            return []
        names = self.spark.createDataFrame([(r.name, r.path, r.updated_at) for r in repos], "name string, path string, updated_at string")
        return self._dicts(catalogue.repo_summaries(names, self.store.read("files", repos), self.store.read("chunks", repos)))

    def read_file(self, repo: str, path: str, start_line: int | None = None, end_line: int | None = None) -> dict:
        """Lines of an indexed file as it was when it was indexed."""
        clean = PurePosixPath(path).as_posix()
        if clean == ".." or clean.startswith("../"):
            raise ValueError("path must be repo-relative")
        found = self._dicts(catalogue.file_range(self.table("files", repo), clean, start_line, end_line)) if repo else []
        if not found:
            raise FileNotFoundError(f"{repo}:{clean} is not indexed")
        return found[0]

    def symbols(self, repo: str | None = None, query: str | None = None, path: str | None = None, limit: int = 50, lang: str | None = None, kind: str | None = None) -> list[dict]:
        manifest = self.init()
        scope = self.known(manifest, repo)
        return self._dicts(catalogue.find_symbols(self.store.read("symbols", scope), self.store.read("files", scope), query, path, lang, kind, limit))

    def status(self, repo: str | None = None) -> dict:
        manifest = self.init()
        scope = self.known(manifest, repo)
        each = self._summaries(scope)
        total = {k: sum(r[k] for r in each) for k in ("files", "chunks", "embedded_chunks")}
        dim = manifest.settings.get("vector_dim")
        return {
            "version": __version__, "db_path": self.path, "repos": len(scope), **total, "vector_query_backend": self.options.vector_backend if dim else "cosine_scan", "vector_dim": dim and int(dim),
            "embed_model": manifest.settings.get("embed_model"), "embeddings": "disabled" if self.embedder is None else "enabled",
            "degraded": self.embedder is not None and total["embedded_chunks"] < total["chunks"], "per_repo": each,
        }

    @staticmethod
    def _dicts(rows: DataFrame) -> list[dict]:
        times = [c for c, kind in rows.dtypes if kind == "timestamp"]
        shown = rows.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c in times}) if times else rows
        return [r.asDict(recursive=True) for r in shown.collect()]


__all__ = ["Engine", "Skip", "utc_now"]
