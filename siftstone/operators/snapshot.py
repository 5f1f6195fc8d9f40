"""What an index run has to do: the stored files against those that are there now."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Identity:
    """What made the stored vectors, and what would make new ones; None: unknown."""

    stored_dim: int | None = None
    stored_model: str | None = None
    stored_backend: str | None = None
    dim: int | None = None
    model: str | None = None
    backend: str | None = None
    embeds: bool = False

    @property
    def stale(self) -> bool:
        """Whether every file has to be embedded anew."""
        other_model = None not in (self.stored_model, self.model) and self.stored_model != self.model
        other_backend = self.backend is not None and self.stored_backend != self.backend
        other_dim = None not in (self.stored_dim, self.dim) and self.stored_dim != self.dim
        return other_model or other_backend or other_dim


def vector_state(chunks: DataFrame) -> DataFrame:
    """repo, path, n_chunks, least and largest dimension (null vectors as 0)."""
    dim = F.when(F.col("embedding").isNull(), 0).otherwise(F.size("embedding"))
    return chunks.groupBy("repo", "path").agg(F.count("*").alias("n_chunks"), F.min(dim).alias("least_dim"), F.max(dim).alias("most_dim"))


def unchanged(identity: Identity) -> Column:
    """Whether a stored file with the hash of the present one can stay, over columns of stored, present and vector_state."""
    same = F.col("file_hash") == F.col("old_hash")
    no_chunks = F.coalesce("n_chunks", F.lit(0)) == 0
    if not identity.embeds:
        vectors = F.lit(True)
    elif identity.stale:
        vectors = F.lit(False)
    else:
        known = identity.dim if identity.dim is not None else identity.stored_dim
        uniform = (F.col("least_dim") == F.col("most_dim")) & (F.col("least_dim") > 0)
        vectors = uniform if known is None else uniform & (F.col("least_dim") == known)
    return F.coalesce(same, F.lit(False)) & F.when(no_chunks, F.coalesce(F.col("size"), F.lit(0)) == 0).otherwise(F.coalesce(vectors, F.lit(False)))


def diff(present: DataFrame, stored: DataFrame, state: DataFrame, identity: Identity) -> DataFrame:
    """path, action: new, changed, unchanged, skipped (couldn't be read; what is stored stays), deleted.

    present has repo, path, file_hash, size, readable; stored has repo, path, file_hash; state is vector_state() of the stored chunks. One full
    outer join on (repo, path).
    """
    old = stored.select("repo", "path", F.col("file_hash").alias("old_hash")).join(state, ["repo", "path"], "left")
    both = present.withColumn("here", F.lit(True)).join(old, ["repo", "path"], "full_outer")
    action = (
        F.when(F.col("here").isNull(), "deleted")
        .when(~F.col("readable"), "skipped")
        .when(F.col("old_hash").isNull(), "new")
        .when(unchanged(identity), "unchanged")
        .otherwise("changed")
    )
    return both.select("repo", "path", action.alias("action"))


def missing(stored: DataFrame, present: DataFrame) -> DataFrame:
    """Stored files that aren't there any more."""
    return stored.join(present.select("repo", "path"), ["repo", "path"], "left_anti")
