"""What the operators of this subpackage share: the shared folder, written tables, row ids, hot keys."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that a Python worker gets at a time, at most (a single longer row still comes whole).
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Make Python workers fit: they import this package even if it didn't come with --py-files, and use bounded memory.

    Texts may be long, so batches are bounded by bytes too; freed memory goes back to the system, as workers live on.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    for name, value in (("MALLOC_ARENA_MAX", "2"), ("MALLOC_TRIM_THRESHOLD_", "1000000"), ("MALLOC_MMAP_THRESHOLD_", "1000000"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(name, value)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(str(spark.conf.get(name)).removesuffix("b")) <= most:
            spark.conf.set(name, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where it is unset and everything runs in one machine (tests, local mode) a temporary folder is set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="siftstone-")).as_uri()
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/siftstone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Paths of the tables that written() has made and nothing has deleted, in order.
TABLES: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        TABLES.remove(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that no later read needs."""
    folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
    _delete(df.sparkSession, [p for p in TABLES if p.rsplit("/", 1)[-1] in folders])


def only(df: DataFrame, since: int) -> DataFrame:
    """Write a result and delete the tables that were written after the first `since` ones, as it needs them no more."""
    out = written(df, "result")
    _delete(df.sparkSession, TABLES[since:-1])
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def is_scan(df: DataFrame) -> bool:
    """Whether a frame only reads Parquet files, so that each of its rows has a place: a file and a number in it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" +-:") for line in plan.strip().splitlines()]
    return lines[-1].startswith("Relation") and lines[-1].endswith(" parquet") and all(line.split(" ")[0] in ("Project", "Filter") for line in lines[:-1])


#: Seeds of the hash of file names that are tried at once.
SEEDS = 8


def with_rid(df: DataFrame, name: str = "rid") -> DataFrame:
    """Add a row id that is the same at every evaluation, however the files are split; frames that aren't plain scans are written first.

    The id is made of a row's place alone: a hash of its file's name, and below it the row's number in that file. How many bits the numbers take
    follows from the longest file; of some seeds one is taken for which no two files share a hash. Only these figures reach the driver.
    """
    if not is_scan(df):
        df = written(df, "rows")
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = df.select(file.alias("file"), row.alias("row")).groupBy("file").agg(F.max("row").alias("last"))
    bits = max(1, int(files.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]).bit_length())
    head = lambda name, seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), name), bits + 1)
    for first in range(0, 64 * SEEDS, SEEDS):
        seeds = range(first, first + SEEDS)
        n, *different = files.agg(F.count("*"), *[F.count_distinct(head(F.col("file"), s)) for s in seeds]).first()
        if n in different:
            seed = seeds[different.index(n)]
            return df.withColumn(name, F.shiftleft(head(file, seed), bits) + row)
    raise RuntimeError("file names have no different hashes")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of a table of documents, null texts as empty ones; other columns are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of a column as text, modulo."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """Join left with a right side that has one row a key and, in `count`, about how many left rows share the key.

    The keys that hold more than HOT_SHARE of `total` rows, of which there are at most 1 / HOT_SHARE, are
    broadcast; only the others are dealt out by key. No left row of a hot key is shuffled.
    """
    least = max(1000.0, total * HOT_SHARE)
    hot = right.where(F.col(count) > least)
    cold = right.where(F.col(count) <= least)
    marks = F.broadcast(hot.select(F.col(key).alias("__hot")))
    is_hot = left.join(marks, left[key] == marks["__hot"], "left")
    first = is_hot.where(F.col("__hot").isNotNull()).drop("__hot").join(F.broadcast(hot), key, "inner")
    rest = is_hot.where(F.col("__hot").isNull()).drop("__hot").join(cold, key, how)
    return first.unionByName(rest)


#: Row ids that are broadcast, at most (16 MB); longer lists are joined.
SENT_IDS = 2_000_000


def picked(df: DataFrame, ids: DataFrame, how: str, name: str = "rid", most: int = SENT_IDS) -> DataFrame:
    """Rows of df whose row id is ("left_semi") or isn't ("left_anti") among ids.rid; ids are counted, and broadcast if few."""
    ids = ids.select(F.col("rid").alias(name))
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, name, how)
