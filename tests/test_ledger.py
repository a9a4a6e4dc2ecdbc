"""The ledger sink: batches handed over twice, tries that die half-way, failing writes and failing fallbacks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailwatch.sources import mail
from mailwatch.streaming.ledger import Ledger, ledger_stream

SCHEMA = "inference_id string, timestamp timestamp, prediction string"


def rows(spark, first, n=20):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(str(i), at + timedelta(minutes=9 * i), "spam") for i in range(first, first + n)], SCHEMA)


def ids(df):
    return sorted(int(r["inference_id"]) for r in df.collect())


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    schema = rows(spark, 0).schema
    assert ledger.log(schema).count() == 0 and ledger.dead_letters(schema).count() == 0
    for _ in range(2):
        ledger.take(rows(spark, 0), 0)
        ledger.take(rows(spark, 20), 1)
    Ledger(spark, str(tmp_path)).take(rows(spark, 0), 0)  # another driver
    assert ids(ledger.log(schema)) == list(range(40))
    assert len(list((tmp_path / "log").glob("batch=*/*"))) == 2
    assert {(r["batch_id"], r["state"], r["n"]) for r in ledger.manifest().collect()} == {(0, "stored", 20), (1, "stored", 20)}
    assert ledger.log(schema).where("hour = '03'").count() == 6 + 1 and ledger.log(schema).where("batch_id = 1").count() == 20


def test_a_try_that_dies_before_its_manifest_line_is_not_read(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    schema = rows(spark, 0).schema

    class Stopped(Ledger):
        def _commit(self, *_):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Stopped(spark, str(tmp_path)).take(rows(spark, 0), 0)
    assert list((tmp_path / "log").glob("batch=0/*/*.parquet")) and ledger.log(schema).count() == 0
    ledger.take(rows(spark, 0), 0)
    assert ids(ledger.log(schema)) == list(range(20))
    with pytest.raises(RuntimeError):  # two runs at once: the second line is refused
        ledger._commit(0, "other", "stored", 20, None)
    assert ledger.manifest().count() == 1


def test_failures_are_tried_again_then_diverted(spark, tmp_path):
    tries = []

    def flaky(batch, path):
        tries.append(path)
        if len(tries) != 2:
            raise OSError("disk full\nand more")
        batch.write.parquet(path)

    ledger = Ledger(spark, str(tmp_path), tries=2, write=flaky)
    schema = rows(spark, 0).schema
    ledger.take(rows(spark, 0), 0)  # fails once, then works
    ledger.take(rows(spark, 20), 1)  # fails twice
    assert len(tries) == 4 and ids(ledger.log(schema)) == list(range(20))
    dead = ledger.dead_letters(schema)
    assert ids(dead) == list(range(20, 40)) and {r["error"] for r in dead.collect()} == {"disk full"}
    (tmp_path / "dead").rename(tmp_path / "dead-away")
    (tmp_path / "dead").write_text("not a folder")
    with pytest.raises(Exception):  # nothing can be written: the batch stays open, the stream fails
        ledger.take(rows(spark, 40), 2)
    assert ledger.manifest().where("batch_id = 2").count() == 0


def test_stream_with_and_without_its_checkpoint(spark, tmp_path):
    for k in range(4):
        rows(spark, 20 * k).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    ledger = Ledger(spark, str(tmp_path / "out"))
    for checkpoint in ("a", "a", "b"):
        assert ledger_stream(arriving, ledger, str(tmp_path / checkpoint), once=True).start().awaitTermination(120)
    assert ids(ledger.log(rows(spark, 0).schema)) == list(range(80)) and ledger.manifest().count() == 4


def test_messages_as_files(spark, tmp_path):
    messages = [("/x/spam_1/m1", b"Subject: a\n\nbody"), ("/x/ham/m2", b""), ("/x/ham/.hidden", b"z"), ("/x/ham/m3", None)]
    df = spark.createDataFrame(messages, "path string, content binary").repartition(2)
    for _ in range(2):  # a repeated task writes the same files
        done = {r["path"].rsplit("/", 2)[-1]: r["bytes"] for r in mail.write_messages(df, str(tmp_path / "raw")).collect()}
    assert done == {"m1": 16, "m2": 0, ".hidden": 1}
    found = mail.scan_messages(spark, str(tmp_path / "raw")).select(mail.corpus_name(F.col("path")).alias("c"), "content").collect()
    assert sorted((r["c"], bytes(r["content"])) for r in found) == [("spam_1", b"Subject: a\n\nbody")]
