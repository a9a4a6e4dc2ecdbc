import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailwatch.operators.joins import lookup_with_defaults, point_in_time_join
from mailwatch.operators.latest import materialize, materialize_incremental
from mailwatch.plans.feature_store import FeatureStore

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, event_timestamp timestamp_ntz, v int"


def brute(entities, features, ttl):
    out = {}
    for i, k, at in entities:
        hits = [(t, v) for fk, t, v in features if fk == k and t <= at and (ttl is None or at - t <= ttl)]
        out[i] = max(hits)[1] if hits else None
    return out


@pytest.mark.parametrize("slot", ["hour", "day", "month"])
@pytest.mark.parametrize("ttl", [None, timedelta(hours=30)])
def test_point_in_time_join_against_brute_force(spark, slot, ttl):
    """A hot key, ties of timestamps, keys without features; any slot size gives the same rows."""
    rng = random.Random(11)
    key = lambda: "hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}"
    at = lambda: T0 + timedelta(hours=rng.randrange(24 * 40))
    seen, features = set(), []
    for n in range(150):
        row = (key(), at(), n)
        if row[:2] not in seen:
            seen.add(row[:2])
            features.append(row)
    entities = [(i, key() if i % 10 else "absent", at()) for i in range(200)]
    e = spark.createDataFrame(entities, "i int, k string, event_timestamp timestamp_ntz")
    f = spark.createDataFrame(features, SCHEMA)
    got = {r["i"]: r["v"] for r in point_in_time_join(e, f, ["k"], ttl, ["v"], slot=slot).collect()}
    assert got == brute(entities, features, ttl)


def test_ttl_and_equality_boundaries(spark):
    f = spark.createDataFrame([("a", T0, 1)], SCHEMA)
    times = [T0, T0 + timedelta(days=30), T0 + timedelta(days=30, seconds=1), T0 - timedelta(seconds=1)]
    e = spark.createDataFrame([(i, "a", t) for i, t in enumerate(times)], "i int, k string, event_timestamp timestamp_ntz")
    got = {r["i"]: r["v"] for r in point_in_time_join(e, f, ["k"], timedelta(days=30), ["v"]).collect()}
    assert got == {0: 1, 1: 1, 2: None, 3: None}


def test_duplicate_entities_are_kept(spark):
    f = spark.createDataFrame([("a", T0, 1)], SCHEMA)
    e = spark.createDataFrame([("a", T0)] * 5, "k string, event_timestamp timestamp_ntz")
    assert point_in_time_join(e, f, ["k"], None, ["v"]).count() == 5


def test_materialization(spark):
    f = spark.createDataFrame([("a", T0 + timedelta(days=d), d) for d in range(6)] + [("b", T0, 7)], SCHEMA)
    day = lambda d: F.lit(T0 + timedelta(days=d)).cast("timestamp_ntz")
    snap = materialize(f, ["k"], day(1), day(3))
    assert [tuple(r)[2] for r in snap.collect()] == [3]
    merged = materialize_incremental(snap, f, ["k"], day(3), day(4))
    assert [tuple(r)[2] for r in merged.collect()] == [4]


def test_partial_rows_merge_over_defaults(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "d string")
    feats = spark.createDataFrame([("a", 5, None), ("b", None, 0.5)], "d string, n int, r double")
    got = {r["d"]: (r["n"], r["r"]) for r in lookup_with_defaults(keys, feats, ["d"], {"n": 122.0, "r": 0.15}).collect()}
    assert got == {"a": (5.0, 0.15), "b": (122.0, 0.5), "z": (122.0, 0.15)}


def test_registry(spark):
    senders = spark.createDataFrame([("d", T0, 1, 1, 0, 1.0)], "sender_domain string, event_timestamp timestamp_ntz, email_count int, spam_count int, ham_count int, spam_ratio double")
    store = FeatureStore({"sender_features": senders})
    assert store.resolve(["sender_domain_features:spam_ratio", "email_text_features:word_count"]) == {
        "sender_domain_features": ["spam_ratio"], "email_text_features": ["word_count"],
    }
    for bad in ("sender_domain_features:nope", "nowhere:x"):
        with pytest.raises(KeyError):
            store.resolve([bad])
    e = spark.createDataFrame([("d", T0), ("d", T0 + timedelta(days=31))], "sender_domain string, event_timestamp timestamp_ntz")
    got = store.get(e, "serving")
    assert got.columns == ["sender_domain", "event_timestamp", "email_count", "spam_count", "ham_count", "spam_ratio"]
    assert sorted(r["email_count"] or 0 for r in got.collect()) == [0, 1]
    assert store.get(e, references=["sender_domain_features:spam_ratio"]).columns[-1] == "spam_ratio"
    stats = {r["view"]: r for r in store.statistics(spark).collect()}
    assert stats["sender_domain_features"]["rows"] == 1 and stats["email_tfidf_features"]["features"] == 500
    assert stats["email_tfidf_features"]["online"] is False and stats["email_text_features"]["ttl_days"] == 365
    assert sum(stats[v]["features"] for v in stats if v not in ("sender_domain_features", "email_tfidf_features")) == 20
    assert store.read("sender_domain_features").count() == 1
