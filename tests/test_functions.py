from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailwatch.functions import clock, labels, structure, text
from mailwatch.functions.features import PROFILES, SCALARS, feature_rows, scalar_columns, vector_names
from mailwatch.functions.numeric import finite_or_zero, nan_to_null


def value(spark, column, cell, kind="string"):
    return spark.createDataFrame([(cell,)], f"c {kind}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "cell, count",
    [(None, 0), ("", 0), ("   ", 0), ("a b", 2), ("a b c", 3), ("a\x1cb", 2), ("ÀÉ b", 2), ("😀 x", 2)],
)
def test_word_count(spark, cell, count):
    assert value(spark, text.word_count("c"), cell) == count == len((cell or "").split())


@pytest.mark.parametrize("cell", [None, "", "ÀÉ b", "ABC", "123 !", "Abǅ", "ﬁ"])
def test_uppercase_ratio(spark, cell):
    letters = [c for c in cell or "" if c.isalpha()]
    expected = sum(c.isupper() for c in letters) / len(letters) if letters else 0.0
    assert value(spark, text.uppercase_ratio("c"), cell) == pytest.approx(expected)


@pytest.mark.parametrize(
    "cell, urls, addresses",
    [
        (None, 0, 0),
        ("see <https://a.b/c> and http://x", 2, 0),
        ("write to a.b@c.example. Thanks", 0, 1),
        ("a@b.com1x@c.de", 0, 2),
        ("no@tld x@y.z", 0, 0),
        ("http:// ", 0, 0),
    ],
)
def test_urls_and_addresses(spark, cell, urls, addresses):
    assert value(spark, text.url_count("c"), cell) == urls
    assert value(spark, text.address_count("c"), cell) == addresses


def test_counts_and_lengths(spark):
    assert value(spark, text.occurrences("c", "!"), "a!!b!") == 3
    assert value(spark, text.occurrences("c", "?"), None) == 0
    assert value(spark, text.char_count("c"), "😀é") == 2
    assert value(spark, text.avg_word_length("c"), "ab  c") == 1.5
    assert value(spark, text.avg_word_length("c"), " ") == 0.0


@pytest.mark.parametrize("cell, n", [("Unsubscribe", 2), ("free free", 1), ("opt-out NOW", 1), (None, 0), ("Act Now, buy now", 2)])
def test_phrases(spark, cell, n):
    assert value(spark, text.spam_phrase_count("c"), cell) == n


@pytest.mark.parametrize(
    "cell, reply, forward, train, serve",
    [
        ("RE: x", 1, 0, 0, 0), ("Fw: x", 0, 1, 0, 0), ("FWD:x", 0, 1, 0, 0), ("AB", 0, 0, 0, 1),
        ("ABC", 0, 0, 1, 1), ("123", 0, 0, 0, 0), (None, 0, 0, 0, 0),
    ],
)
def test_subjects(spark, cell, reply, forward, train, serve):
    assert value(spark, structure.subject_is_reply("c"), cell) == reply
    assert value(spark, structure.subject_is_forward("c"), cell) == forward
    assert value(spark, structure.subject_all_caps("c", 3), cell) == train
    assert value(spark, structure.subject_all_caps("c", 1), cell) == serve


def test_html_ratio(spark):
    df = spark.createDataFrame([(None, None), ("", "abc"), ("ab", "abcd"), ("ab", None)], "t string, h string")
    got = [r[0] for r in df.select(structure.html_to_text_ratio("t", "h")).collect()]
    assert got == [0.0, 3.0, 2.0, 0.0]


@pytest.mark.parametrize(
    "cell, domain, serving, digit", [("a1@B.c", "B.c", "b.c", 1), ("a@x@y2", "y2", "y2", 0), ("Plain", "", "plain", 0), (None, "", "", 0)]
)
def test_addresses(spark, cell, domain, serving, digit):
    assert value(spark, structure.domain_of("c"), cell) == domain
    assert value(spark, structure.serving_domain_of("c"), cell) == serving
    assert value(spark, structure.has_digit(structure.local_part("c")), cell) == digit


@pytest.mark.parametrize(
    "when, hour, dow, weekend, night",
    [
        (datetime(2024, 1, 6, 21, 59), 21, 5, 1, 0), (datetime(2024, 1, 7, 22, 0), 22, 6, 1, 1),
        (datetime(2024, 1, 8, 5, 59), 5, 0, 0, 1), (datetime(2024, 1, 8, 6, 0), 6, 0, 0, 0),
    ],
)
def test_clock(spark, when, hour, dow, weekend, night):
    df = spark.createDataFrame([(when,)], "c timestamp_ntz")
    row = df.select(clock.hour_of_day("c", -1), clock.day_of_week("c", -1), clock.is_weekend("c", -1), clock.is_night_hour("c", -1)).first()
    assert tuple(row) == (hour, dow, weekend, night)


def test_iso_dates(spark):
    assert value(spark, F.unix_seconds(clock.parse_iso("c")), "1970-01-01T00:00:10Z") == 10
    assert value(spark, clock.parse_iso("c"), "10 o'clock") is None


def test_profiles_differ_only_where_documented(spark):
    row = ("1", None, None, None, "AB", "user", None, None, None, None)
    cols = "email_id string, label string, body_text string, body_html string, subject string, sender_email string, sender_domain string, x_mailer string, received_hop_count int, date timestamp"
    df = spark.createDataFrame([row], cols)
    got = {p: df.select(*[c.alias(n) for n, c in scalar_columns(p).items()]).first().asDict() for p in PROFILES}
    times = lambda p: [got[p][f] for f in ("hour_of_day", "day_of_week", "is_weekend", "is_night_hour")]
    assert times("train") == [-1, -1, -1, -1] and times("serve") == times("batch") == [12, 2, 0, 0]
    assert [got[p]["subject_all_caps"] for p in ("train", "serve", "batch")] == [0, 1, 1]
    assert [got[p]["sender_domain_length"] for p in ("train", "serve", "batch")] == [0, 4, 0]
    assert PROFILES["serve"].sender == {"email_count": 122, "spam_count": 18, "ham_count": 104, "spam_ratio": 0.15}
    assert PROFILES["batch"].sender["spam_ratio"] == 0.5


def test_feature_rows_keep_every_row_and_column(spark):
    cols = "email_id string, label string, body_text string, body_html string, subject string, sender_email string, sender_domain string, x_mailer string, received_hop_count int, date timestamp"
    df = spark.createDataFrame([("1",) + (None,) * 9, ("2", "spam", "x", "", "s", "a@b", "b", "m", 3, None)], cols)
    out = feature_rows(df, F.lit("2024-01-01").cast("timestamp"))
    assert out.columns == ["email_id", "label", *SCALARS, "event_timestamp"] and out.count() == 2
    assert out.where(" or ".join(f"{c} is null" for c in SCALARS)).count() == 0
    assert len(vector_names()) == 528 and vector_names()[24] == "tfidf_0" and vector_names()[-1] == "spam_ratio"


def test_labels_and_confidence(spark):
    enc = lambda c, **k: value(spark, labels.encode_label("c", **k), c)
    assert (enc("spam"), enc("ham"), enc("SPAM"), enc("SPAM", ignore_case=True), enc("x")) == (1, 0, None, 1, None)
    probe = lambda f, p: value(spark, f("c"), p, "double")
    assert [probe(labels.confidence_online, p) for p in (0.9, 0.1, 0.7, 0.3, 0.5)] == ["high", "high", "medium", "medium", "low"]
    assert [probe(labels.confidence_result, p) for p in (0.8, 0.81, 0.6, 0.61, 0.4)] == ["medium", "high", "low", "medium", "low"]
    assert [probe(labels.decide, p) for p in (0.7, 0.69)] == [1, 0]
    assert [probe(labels.psi_band, p) for p in (0.09, 0.1, 0.2, 0.21)] == ["none", "minor", "minor", "significant"]


def test_numeric_rules(spark):
    for cell, clean, finite in [(float("nan"), None, 0.0), (None, None, 0.0), (float("inf"), float("inf"), 0.0), (-2.5, -2.5, -2.5)]:
        assert value(spark, nan_to_null("c"), cell, "double") == clean
        assert value(spark, finite_or_zero("c"), cell, "double") == finite
