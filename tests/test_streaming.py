import time

from logstrata.model import LOG
from logstrata.operators.resolve import latest
from logstrata.queries import _drained, _streamed
from logstrata.sources.storage import Store
from logstrata.streaming import folds


def test_late_rows_change_nothing(spark):
    rows = spark.createDataFrame([("a", "new", 5), ("a", "old", 2), ("b", None, 3)], LOG)
    got = _drained(spark, folds.newest(_streamed(spark, rows)), "update")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "new", 5), ("b", None, 3)]


def test_ingest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(f"k{i % 7}", f"v{i}", i + 1) for i in range(70)], LOG)
    folds.ingest(_streamed(spark, rows), store).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, latest(rows).collect()))


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], LOG)
    for checkpoint in ("one", "two"):  # a new checkpoint delivers batch 0 again
        folds.ingest(_streamed(spark, rows), store).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        assert store.log().count() == 2 and store.last_batch("log") == 0


def test_state_with_a_time_to_live(spark, tmp_path):
    """A key is forgotten after its time: an older version, which its state would hide, then counts as news."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], LOG).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(LOG).parquet(str(source))
    run = folds.newest(stream, ttl_ms=2000).writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.parquet(f"{out}/{n}"))

    def rows():
        done = sorted((p.parent for p in (tmp_path / "out").glob("*/_SUCCESS")), key=lambda p: int(p.name))
        return [tuple(r) for p in done for r in spark.read.schema(LOG).parquet(str(p)).collect()]

    def wait(n):
        for _ in range(60):
            if len(rows()) >= n:
                break
            run.awaitTermination(1)

    # timers go on, so it has always something to do: its output is awaited, and it is stopped
    run = run.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        wait(1)
        time.sleep(4)
        spark.createDataFrame([("a", "old", 1)], LOG).coalesce(1).write.mode("append").parquet(str(source))
        wait(2)
    finally:
        run.stop()
    assert rows() == [("a", "y", 2), ("a", "old", 1)]


def test_state_without_a_time_keeps_the_newest(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", "y", 2)], LOG).coalesce(1).write.parquet(str(source))
    spark.createDataFrame([("a", "old", 1)], LOG).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = [tuple(r) for r in _drained(spark, folds.newest(stream), "update").collect()]
    assert ("a", "y", 2) in got and len(got) <= 2
