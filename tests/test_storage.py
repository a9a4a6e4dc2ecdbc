import math
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailwatch.operators import joins, latest, predicates
from mailwatch.operators import tfidf
from mailwatch.config import TfidfConfig
from mailwatch.plans.baseline import baseline_from_table, baseline_table, generate_baseline
from mailwatch.schema import INFERENCE_LOG
from mailwatch.sources import logs, reports, tables


def ts(text):
    return F.lit(text).cast("timestamp")


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (str(i), datetime(2024, 1, 1 + i // 24, i % 24, 30), "m", "1", "spam" if i % 3 == 0 else "ham", i / 100, 1.0, "1.0.0",
         "production", "", "", json.dumps({"a": i}) if i != 5 else "{bad", "{}")
        for i in range(72)
    ]
    return spark.createDataFrame(rows, INFERENCE_LOG)


def test_log_partitions_and_pruned_window(spark, log, tmp_path):
    path = str(tmp_path / "log")
    logs.write_log(log, path)
    assert (tmp_path / "log/year=2024/month=01/day=02/hour=07").is_dir()
    # A window under 24 hours across midnight reads both days; both ends are inclusive.
    got = logs.scan_log(spark, path, ts("2024-01-01 22:30:00"), ts("2024-01-02 01:30:00"))
    assert sorted(int(r["inference_id"]) for r in got.collect()) == [22, 23, 24, 25]
    plan = got._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(timestamp" in plan
    assert {f.split("/hour=")[0][-2:] for f in got.inputFiles()} == {"01", "02"}
    assert logs.scan_log(spark, path, ts("2030-01-01"), ts("2030-01-02")).count() == 0


def test_bad_json_rows_stay_aligned(log):
    wide = logs.wide_features(log, ["a"])
    assert wide.count() == 72 and wide.where("a is null").count() == 1
    assert tuple(logs.bad_feature_rows(log).first()) == (72, 1)
    assert logs.flatten_features(log, ["inference_id"]).count() == 71


def test_log_rows_from_scorings(spark):
    scored = spark.createDataFrame([("e1", None, 0.9, "spam", 2.0)], "email_id string, sender_domain string, spam_probability double, prediction_label string, a double")
    row = logs.log_rows(scored, ["a"], "m", "2", ts("2024-01-01"), F.col("email_id"), F.lit(1)).first()
    assert row["sender_domain"] == "" and json.loads(row["features_json"]) == {"a": 2.0} and row["prediction"] == "spam"


def test_email_sink_by_label(spark, tmp_path):
    from mailwatch.schema import EMAILS

    values = {f.name: None for f in EMAILS.fields}
    df = spark.createDataFrame([tuple({**values, "email_id": i, "label": l}.values()) for i, l in (("1", "spam"), ("2", "ham"))], EMAILS)
    tables.write_emails(df, str(tmp_path / "emails"))
    assert (tmp_path / "emails/label=spam").is_dir()
    assert tables.read_emails(spark, str(tmp_path / "emails")).count() == 2
    assert tables.read_emails(spark, str(tmp_path / "emails"), "ham").first()["email_id"] == "2"


def test_feature_sink_and_csv(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(id % 7 as string) k", "id v")
    tables.write_features(df, str(tmp_path / "f"), "k")
    assert spark.read.parquet(str(tmp_path / "f")).count() == 100
    tables.export_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["k", "v"]


def test_baseline_versions(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "spam"), (3.0, "ham"), (None, "ham")], "a double, label string")
    path = str(tmp_path / "baseline")
    for version, at in (("1", "2024-01-01"), ("2", "2024-02-01")):
        b = generate_baseline(train, ["a", "missing"], "m", version, ts(at))
        assert b.metadata.first()["feature_count"] == 1 and b.metadata.first()["num_samples"] == 3
        tables.save_baseline(baseline_table(b, "m", version, ts(at)), path)
    table = tables.load_baseline(spark, path, "m")
    assert {str(r["model_version"]) for r in table.collect()} == {"2"}
    again = baseline_from_table(table)
    assert again.stats.first()["mean"] == 2.0 and again.histogram.count() == 20
    assert tables.load_baseline(spark, path, "m", "1").count() == 1


def test_report_history(spark, tmp_path):
    rows = [(f"r{d}", datetime(2024, 1, d, 5), "m", d / 10) for d in (1, 5, 6, 7)]
    df = spark.createDataFrame(rows, "report_id string, generated_at timestamp, model_name string, drift_score double")
    reports.write_reports(df, str(tmp_path / "r"))
    got = reports.recent_reports(reports.read_reports(spark, str(tmp_path / "r")), F.lit("2024-01-07").cast("date"), 2)
    assert [r["report_id"] for r in got.collect()] == ["r7", "r6"]


def test_vocabulary_round_trip_and_zero_rows(spark, tmp_path):
    docs = spark.createDataFrame([("spark spark streams",), ("spark plans",), ("the",), (None,)], "body_text string")
    config = TfidfConfig(min_df=1, max_df=1.0, stop_words=("the",))
    model = tfidf.fit(docs, config=config)
    assert list(model.terms) == ["plans", "spark", "spark plans", "spark spark", "spark streams", "streams"]
    tables.save_artifact(model.to_frame(spark), str(tmp_path / "v"))
    again = tfidf.TfidfModel.from_frame(spark.read.parquet(str(tmp_path / "v")), config)
    assert again == model
    found = [r["tfidf"] for r in again.weights(docs).collect()]
    assert [round(sum(h["weight"] ** 2 for h in v), 9) for v in found] == [1.0, 1.0, 0, 0]
    assert [[h["idx"] for h in v] for v in found] == [[1, 3, 4, 5], [0, 1, 2], [], []]
    first = {h["idx"]: h["weight"] for h in found[0]}
    idf = dict(enumerate(model.idf))
    assert first[1] / first[5] == pytest.approx((1 + math.log(2)) * idf[1] / idf[5])
    empty = tfidf.fit(docs, config=TfidfConfig(min_df=5))
    assert empty.terms == () and empty.weights(docs).first()["tfidf"] == []
    wide = tfidf.wide_columns(again.weights(docs), size=8)
    assert wide.columns[1:] == [f"tfidf_{i}" for i in range(8)] and wide.first()["tfidf_7"] == 0.0 and wide.first()["tfidf_1"] == first[1]


def test_predicates(spark):
    df = spark.createDataFrame([("1", 1, 2.0), (None, 0, 1.0)], "email_id string, label int, x double")
    with pytest.raises(ValueError, match="subject"):
        predicates.require_columns(df, ["email_id", "subject"])
    with pytest.raises(ValueError, match="1 labels"):
        predicates.require_binary_labels(df.withColumn("label", F.col("label") * 2))
    assert predicates.require_binary_labels(df) is df
    assert predicates.feature_columns(df) == ["x"]
    assert predicates.with_default(df, "event_timestamp", ts("2024-01-01")).columns[-1] == "event_timestamp"
    assert predicates.entity_table(df, ts("2024-01-01")).count() == 1
    assert joins.common_columns(df, df.select("x", "label")) == ["label", "x"]
    row = predicates.result_rows(spark.createDataFrame([("7", 0.81239, 1)], "id string, spam_probability double, spam_label int")).first()
    assert tuple(row) == ("7", "", "", 0.8124, "spam", "high")


def test_dedupe_keeps_row_counts(spark):
    mails = spark.createDataFrame([("a", "f2", 1), ("a", "f1", 2), ("b", "f3", 3)] + [("hot", f"h{i:03d}", i) for i in range(200)], "email_id string, filename string, v int")
    once = latest.dedupe_content(mails)
    assert {r["email_id"]: r["filename"] for r in once.collect()} == {"a": "f1", "b": "f3", "hot": "h000"}
    assert joins.left_join_suffixed(once, once, "email_id", "_feat").count() == 3


def test_sender_join_is_optional_and_salting_is_exact(spark):
    e = spark.createDataFrame([(str(i), "hot" if i % 3 else f"d{i}") for i in range(60)], "email_id string, sender_domain string")
    s = spark.createDataFrame([("hot", 9)], "sender_domain string, email_count int")
    assert joins.join_sender_features(e, None) is e
    assert joins.join_sender_features(e.drop("sender_domain"), s).columns == ["email_id"]
    plain = joins.join_sender_features(e, s)
    salted = joins.salted_lookup(e, s, "sender_domain", "email_id", salts=4).select(*plain.columns)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)
