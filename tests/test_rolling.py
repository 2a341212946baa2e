"""Result files rolled by size, age and number, and shown together."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from flowlens.sinks import rolling as R


def lines(spark, n=1000):
    return spark.range(n, numPartitions=3).select((F.col("id") % 10 == 0).alias("failed"), F.format_string("line %06d", "id").alias("value"))


def read(folder):
    return {os.path.basename(p): open(p).read().splitlines() for p in sorted(glob.glob(f"{folder}/*.txt"))}


@pytest.mark.parametrize("limits,most", [({"roll_bytes": 600}, 50), ({"roll_records": 7}, 7), ({}, 10**6)])
def test_files_are_rolled_and_hold_each_line_once(spark, tmp_path, limits, most):
    df = lines(spark)
    R.rolling(df.write, df, f"{tmp_path}/good", f"{tmp_path}/bad", **limits).mode("append").save()
    good, bad = read(tmp_path / "good"), read(tmp_path / "bad")
    assert sorted(x for f in good.values() for x in f) == [f"line {i:06d}" for i in range(1000) if i % 10]
    assert sorted(x for f in bad.values() for x in f) == [f"line {i:06d}" for i in range(0, 1000, 10)]
    assert max(len(f) for f in good.values()) <= most and (len(good) > 10) == bool(limits)
    assert os.listdir(tmp_path / "good") == [f for f in os.listdir(tmp_path / "good") if f.endswith(".txt")]


def test_old_files_are_closed(tmp_path, monkeypatch):
    now = [0.0]
    monkeypatch.setattr(R.time, "monotonic", lambda: now[0])
    part = R._Part(str(tmp_path), "x", {"bytes": 1e9, "records": 1e9, "seconds": 60})
    for _ in range(6):
        part.write([b"line\n"])
        now[0] += 25
    part.close()
    assert len(part.names) == 2


def test_failed_jobs_show_nothing(spark, tmp_path):
    df = lines(spark).withColumn("value", F.when(F.col("value") == "line 000999", F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception):
        R.rolling(df.write, df, f"{tmp_path}/good").mode("append").save()
    assert read(tmp_path / "good") == {}
    df = lines(spark)
    R.rolling(df.write, df, f"{tmp_path}/good").mode("append").save()
    assert sum(map(len, read(tmp_path / "good").values())) == 900  # failed lines have no folder


def test_micro_batches_that_run_again(spark, tmp_path):
    """The second query has lost the checkpoint's last commit and repeats the batch."""
    for k in range(3):
        lines(spark, 10 * (k + 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(R.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run():
        writer = R.rolling(stream.writeStream, stream, f"{tmp_path}/good", f"{tmp_path}/bad").outputMode("append")
        writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    run()
    before = read(tmp_path / "good"), read(tmp_path / "bad")
    assert sum(map(len, before[0].values())) == 54 and sum(map(len, before[1].values())) == 6
    for name in glob.glob(f"{tmp_path}/cp/commits/*2*") + glob.glob(f"{tmp_path}/cp/commits/.*2*"):
        os.remove(name)
    run()
    assert (read(tmp_path / "good"), read(tmp_path / "bad")) == before
