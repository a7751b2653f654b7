import datetime
import os

from tidesift.plans.finding_queries import stream_distinct_findings, stream_severity_windows
from tidesift.streaming.arrivals import distinct_arrivals, severity_windows


def test_streams_give_what_a_batch_gives(spark, tmp_path):
    day = datetime.datetime(2024, 1, 4, tzinfo=datetime.timezone.utc)
    row = (1, "t", "i", "L2", "HIGH", "c", "x", day, day)
    other = (1, "t", "j", "L2", "critical", "c", "y", day + datetime.timedelta(days=30), day)
    df = spark.createDataFrame([row, row, other], "scan_id bigint, target string, id string, layer string, severity string, category string, title string, started_at timestamp, loaded_at timestamp")
    df.write.parquet(str(tmp_path / "scan_findings.parquet"))
    assert stream_distinct_findings(spark, str(tmp_path)).count() == 2
    got = [tuple(r) for r in stream_severity_windows(spark, str(tmp_path)).orderBy("window_start").collect()]
    assert got == [("2024-01-04 00:00:00", "L2", 2, 0, 3), ("2024-02-01 00:00:00", "L2", 1, 1, 4)]


def test_arrivals_over_several_batches(spark, tmp_path):
    """A copy is dropped as long as its first row is held, 60 days at least; a row later than the watermark always is."""
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    schema = "scan_id bigint, target string, id string, layer string, category string, title string, severity string, loaded_at timestamp, started_at timestamp"
    batches = [[("a", 0)], [("b", 100), ("a", 1)], [("b", 101)], [("a", 2), ("c", 102), ("d", 3)], [("c", 103), ("b", 300)], [("b", 301), ("e", 250)], [("b", 302)]]
    for i, rows in enumerate(batches):
        made = [(1, "t", key, "L2", "c", "x", "critical", start + datetime.timedelta(days=d), start + datetime.timedelta(days=d)) for key, d in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        for f in (tmp_path / "in" / f"{i}").glob("*.parquet"):
            f.rename(tmp_path / f"{i}.parquet")
            os.utime(tmp_path / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*.parquet"))

    def drained(result, name):
        run = result.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
        run.option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name)

    arrived = drained(distinct_arrivals(stream), "arrived").collect()
    assert sorted((r.id, (r.loaded_at.replace(tzinfo=datetime.timezone.utc) - start).days) for r in arrived) == [("a", 0), ("b", 100), ("b", 302), ("c", 102), ("e", 250)]
    windows = drained(severity_windows(stream, late="10 days"), "windows").agg({"n_findings": "sum"}).first()[0]
    assert windows == 7  # those from b 300 on wait in an open window; a 2 and d 3 came too late


def test_empty_stream(spark, tmp_path):
    schema = "scan_id bigint, target string, id string, layer string, category string, title string, severity string, loaded_at timestamp, started_at timestamp"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "none"))
    for result, name in ((distinct_arrivals(stream), "none_arrived"), (severity_windows(stream), "none_windows")):
        run = result.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
        run.option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        assert spark.table(name).count() == 0
