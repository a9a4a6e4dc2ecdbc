"""The vocabulary from frequent words only is the one from all terms."""

import random

import pytest
from pyspark.sql import functions as F

from mailwatch.catalog import textual
from mailwatch.config import TfidfConfig
from mailwatch.operators import tfidf


def corpus(spark, words, docs=60, seed=4):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    rows = [(" ".join(rng.choices(names, [1 / (i + 1) for i in range(words)], k=rng.randrange(0, 30))) or None,) for _ in range(docs)]
    return spark.createDataFrame([*rows, ("ever w0 w1 w0 w1",), ("",)], "text string").repartition(3)


@pytest.mark.parametrize("words, size, low, high, max_df", [(40, 12, 1, 2, 0.95), (40, 12, 1, 3, 0.5), (9, 30, 1, 2, 1.0), (300, 2, 1, 2, 0.3), (20, 8, 2, 2, 1.0), (30, 5, 1, 1, 1.0)])
def test_same_vocabulary(spark, words, size, low, high, max_df):
    docs = corpus(spark, words)
    config = TfidfConfig(max_features=size, ngrams=(low, high), min_df=2, max_df=max_df)
    want = tfidf.select_vocabulary(tfidf.document_frequency(docs, "text", config), size).collect()
    got = tfidf.vocabulary(docs, "text", config).collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want] and len(got) > 1


def test_ties_beyond_the_limit_count_all_terms(spark):
    docs = spark.createDataFrame([(" ".join(f"t{i}" for i in range(40)),)] * 3, "text string")
    config = TfidfConfig(max_features=2, min_df=1, max_df=1.0)
    assert [r["term"] for r in tfidf.vocabulary(docs, "text", config).collect()] == ["t0", "t0 t1"]


def test_rare_pairs_are_not_made(spark):
    docs = spark.createDataFrame([("aa bb rare aa bb cc",)], "text string")
    assert tfidf._terms_among(docs, "text", TfidfConfig(stop_words=()), ["aa", "bb"]).first()["terms"] == ["aa", "bb", "aa", "bb", "aa bb", "aa bb"]


def test_statistics(spark):
    docs = spark.createDataFrame([("aa bb aa",), ("aa",), (None,)], "text string")
    rows = tfidf.term_statistics(docs, "text", TfidfConfig(stop_words=())).collect()
    assert {r["term"]: (r["df"], r["cf"]) for r in rows} == {"aa": (2, 3), "bb": (1, 1), "aa bb": (1, 1), "bb aa": (1, 1)}


def test_texts_are_split_once(spark, tmp_path):
    """A filter derived from the rows of hits, or of terms, would make them once more."""
    corpus(spark, 20).selectExpr("monotonically_increasing_id() AS doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (textual._counts, textual._weights, textual._terms, textual._frequency):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1, query


def test_terms_are_counted_without_sorting_them(spark):
    docs = spark.createDataFrame([("bb aa bb",), ("aa cc",)], "text string")
    found = tfidf._statistics(docs.select(F.expr("CASE WHEN text LIKE 'bb%' THEN array('b', NULL, 'a', 'b', NULL) END AS terms")))
    assert {(r["term"], r["df"], r["cf"]) for r in found.collect()} == {("a", 1, 1), ("b", 1, 2)}
    assert "sort_array" not in found._jdf.queryExecution().optimizedPlan().toString()
