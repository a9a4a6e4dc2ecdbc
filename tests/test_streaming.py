import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailwatch.operators.distribution import histogram
from mailwatch.schema import INFERENCE_LOG
from mailwatch.sources.logs import flatten_features
from mailwatch.streaming import sink, windows

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    rows = [
        (str(i), T0 + timedelta(minutes=20 * i), "m", "1", "spam" if i % 4 == 0 else "ham", (i % 10) / 10, float(i % 7), "1", "p", "", "",
         json.dumps({"a": float(i % 23)}), "{}")
        for i in range(300)
    ]
    spark.createDataFrame(rows, INFERENCE_LOG).repartition(6).write.parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(INFERENCE_LOG).option("maxFilesPerTrigger", 2).parquet(path)


def run(writer):
    query = writer.start()
    assert query.awaitTermination(120)
    return query


def test_log_sink_is_complete_and_restartable(spark, source, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        run(sink.log_stream(stream(spark, source), out, check, once=True))
    got = spark.read.parquet(out)
    assert got.count() == 300 and got.select("inference_id").distinct().count() == 300
    assert (tmp_path / "out/year=2024/month=01/day=02").is_dir()


def test_failed_batches_go_to_the_dead_letter_table(spark, source, tmp_path):
    tries = []

    def broken(batch, batch_id):
        tries.append(batch_id)
        if batch_id == 1:
            raise OSError("disk full")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/ok/batch={batch_id}")

    run(sink.guarded_log_stream(stream(spark, source), "", str(tmp_path / "dead"), str(tmp_path / "c"), write=broken, once=True))
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert tries.count(1) == 2 and dead.select("error").first()["error"].startswith("disk full")
    assert dead.count() + spark.read.parquet(str(tmp_path / "ok")).count() == 300


def collect_stream(spark, df, name, tmp_path):
    run(df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True))
    return sorted(map(tuple, spark.table(name).collect()))


def test_counters_equal_their_batch_twin(spark, source, tmp_path):
    batch = sorted(map(tuple, windows.prediction_counters(spark.read.parquet(source)).collect()))
    assert collect_stream(spark, windows.prediction_counters(stream(spark, source)), "counters", tmp_path) == batch


def test_sliding_counts_equal_their_batch_twin(spark, source, tmp_path):
    table = spark.read.parquet(source)
    hist = histogram(flatten_features(table), 5).cache()
    long = lambda df: flatten_features(df, ["timestamp"])
    twin = windows.sliding_from_hourly(windows.hourly_bin_counts(long(table), hist), 24)
    direct = windows.sliding_bin_counts(long(table), hist)
    assert sorted(map(tuple, twin.collect())) == sorted(map(tuple, direct.collect()))
    streamed = collect_stream(spark, windows.sliding_bin_counts(long(stream(spark, source)), hist), "sliding", tmp_path)
    assert streamed == sorted(map(tuple, twin.collect()))
    psi = windows.window_psi(twin, hist)
    assert psi.where("psi < 0").count() == 0 and psi.count() == twin.select("window_start", "feature").distinct().count()


def test_retention(spark, source):
    series = windows.prediction_counters(spark.read.parquet(source))
    kept = windows.retained(series, F.lit(T0 + timedelta(hours=99)).cast("timestamp"))
    assert kept.agg(F.min("window_start")).first()[0] >= T0 + timedelta(hours=75)


def test_streamed_psi_equals_the_tables(spark, source, tmp_path):
    table = spark.read.parquet(source)
    hist = histogram(flatten_features(table), 5).cache()
    long = lambda df: flatten_features(df, ["timestamp"])
    want = {(r["window_start"], r["feature"]): r for r in windows.sliding_psi(long(table), hist).collect()}
    twin = windows.window_psi(windows.sliding_from_hourly(windows.hourly_bin_counts(long(table), hist), 24), hist)
    assert {(r["window_start"], r["feature"]): pytest.approx(r["psi"]) for r in twin.collect()} == {k: r["psi"] for k, r in want.items()}
    ordered = str(tmp_path / "ordered")
    table.orderBy("timestamp").coalesce(1).write.option("maxRecordsPerFile", 60).parquet(ordered)
    psi = windows.sliding_psi(long(stream(spark, ordered)), hist)
    run(psi.writeStream.outputMode("append").format("memory").queryName("psi").option("checkpointLocation", str(tmp_path / "psi")).trigger(availableNow=True))
    got = spark.table("psi").collect()
    # Windows are told once the watermark has passed their end.
    assert len(got) > 40
    for r in got:
        assert r["psi"] == pytest.approx(want[r["window_start"], r["feature"]]["psi"])
    assert len({(r["window_start"], r["feature"]) for r in got}) == len(got)
