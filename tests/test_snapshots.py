"""Upserts of a stored snapshot: same rows as one pass, untouched buckets keep their files, failed runs change nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailwatch.operators.latest import materialize
from mailwatch.sources.snapshots import Snapshot

T0 = datetime(2024, 1, 1)


def at(hours):
    return F.lit((T0 + timedelta(hours=hours)).isoformat(sep=" ")).cast("timestamp")


def history(spark, n=400):
    draw = random.Random(3)
    rows = [(draw.randrange(90) if i % 17 else None, T0 + timedelta(hours=draw.randrange(240)), i) for i in range(n)]
    return spark.createDataFrame(rows, "k long, event_timestamp timestamp, v long").repartition(3)


def rows(df):
    return sorted((r["k"] if r["k"] is not None else -1, r["event_timestamp"], r["v"]) for r in df.collect())


def test_upserts_equal_one_pass(spark, tmp_path):
    df = history(spark)
    kept = Snapshot(spark, str(tmp_path / "s"), ("k",), tie=("v",), buckets=8)
    assert kept.read(df.schema).count() == 0 and kept.watermark() is None
    for end in (60, 150, 150, 239):
        kept.upsert(df, at(end))
        want = materialize(df, ["k"], at(-1), at(end), tie=("v",))
        assert rows(kept.read(df.schema)) == rows(want)
        assert kept.watermark() == T0 + timedelta(hours=end)
    assert rows(kept.read(df.schema, version=1)) == rows(materialize(df, ["k"], at(-1), at(60), tie=("v",)))


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    df = history(spark)
    kept = Snapshot(spark, str(tmp_path / "s"), ("k",), tie=("v",), buckets=8)
    assert kept.upsert(df, at(240)) == list(range(8))
    before = {r["bucket"]: r["run"] for r in kept.manifest()}
    late = spark.createDataFrame([(5, T0 + timedelta(hours=300), 1000), (5, T0 + timedelta(hours=310), 1001)], df.schema)
    touched = kept.upsert(df.unionByName(late), at(320))
    after = {r["bucket"]: r["run"] for r in kept.manifest()}
    assert len(touched) == 1 and {b for b in range(8) if before[b] != after[b]} == set(touched)
    written = [p.name for p in (tmp_path / "s" / "data" / after[touched[0]]).iterdir() if p.name.startswith("bucket")]
    assert written == [f"bucket={touched[0]}"]
    assert kept.read(df.schema).where("k = 5").select("v").first()[0] == 1001
    assert kept.upsert(df, at(330)) == [] and kept.watermark() == T0 + timedelta(hours=330)


def test_a_failed_run_changes_nothing(spark, tmp_path):
    df = history(spark)
    kept = Snapshot(spark, str(tmp_path / "s"), ("k",), tie=("v",), buckets=4)
    kept.upsert(df, at(100))
    want = rows(kept.read(df.schema))
    broken = df.withColumn("v", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception):
        kept.upsert(broken, at(200))
    assert rows(kept.read(df.schema)) == want and kept.watermark() == T0 + timedelta(hours=100)
    kept.upsert(df, at(200))
    assert rows(kept.read(df.schema)) == rows(materialize(df, ["k"], at(-1), at(200), tie=("v",)))
