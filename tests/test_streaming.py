import time

import pytest
from pyspark.sql import functions as F

from siftstone.streaming import watch


class Counting:
    """Stands for an engine; fails at its second run."""

    def __init__(self, spark):
        self.spark, self.runs = spark, 0

    def index_repo(self, path, name):
        self.runs += 1
        if self.runs == 2:
            raise OSError("gone for now")
        return {"run": self.runs}


def test_watch_goes_on_after_errors(spark, capsys):
    engine, seen = Counting(spark), []
    query = watch.watch(engine, "/x", interval=0.2, seen=seen.append)
    end = time.time() + 60
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.1)
    query.stop()
    assert seen[:2] == [{"run": 1}, {"run": 3}] and "gone for now" in capsys.readouterr().err
    with pytest.raises(ValueError, match="positive"):
        watch.watch(engine, "/x", interval=0)


def test_merge(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = spark.createDataFrame([(2, "x", 1, False), (2, "y", 2, False), (3, "z", 1, True), (4, "n", 1, False), (5, "m", 1, False), (5, "m", 2, True)], "k int, v string, t int, gone boolean")
    assert sorted(map(tuple, watch.merge(stored, changes, ["k"], ["t"], "gone").collect())) == [(1, "a"), (2, "y"), (4, "n")]


def test_a_stream_gives_what_the_batch_gives(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    query = watch.windowed_counts(stream, late="30 days").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    batch = watch.windowed_counts(events)
    assert spark.table("counted").exceptAll(batch).isEmpty() and batch.exceptAll(spark.table("counted")).isEmpty()
    assert watch.first_rows(events, ["event_type"], ["ts", "event_id"]).count() == events.select("event_type").distinct().count() and batch.agg(F.sum("n")).first()[0] == events.count()
