"""Connected components of a graph given by its links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import HOT_SHARE, dropped, join_counted, written


#: Links of a written file, about; rounds over few links shouldn't write many small files.
ROWS_A_FILE = 250_000


def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Join rows (a, b) with the least node m of each a; rows of an `a` that many have aren't dealt out by it."""
    least = written(least, "least")
    total, most = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most <= max(1000, total * HOT_SHARE):
        return rows.join(least.drop("n"), "a")
    return join_counted(rows, least, "a", "n", total, "inner").drop("n")


def large_star(links: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest among the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; links lead from larger to smaller nodes."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = with_least(links, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links (a, b); each round is a written table.

    Repeated links and loops do no harm. Rounds grow as the logarithm of the longest path.
    """
    now = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda x: tuple(x.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
    state = mark(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        large = written(large_star(now).coalesce(1 + state[0] // ROWS_A_FILE), "links")
        after = written(small_star(large).coalesce(1 + state[0] // ROWS_A_FILE), "links")
        new = mark(after)
        dropped(now)
        dropped(large)
        now = after
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
