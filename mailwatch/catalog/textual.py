"""Corpus-fitted text features over whole documents."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..config import TfidfConfig
from ..functions.stop_words import ENGLISH
from ..operators import tfidf
from ..sources.tables import spread
from .views import table

CONFIG = TfidfConfig()


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def _sql(body: str) -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
    return rf"""
WITH stops AS (SELECT unnest([{stops}]) AS w),
tok AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS w,
    generate_subscripts(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), 1) AS pos
  FROM documents
),
kept AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos
  FROM tok WHERE w NOT IN (SELECT w FROM stops)
),
terms AS (
  SELECT doc_id, w AS term FROM kept
  UNION ALL
  SELECT a.doc_id, a.w || ' ' || b.w FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
),
n AS (SELECT count(*) AS n_docs FROM documents),
stats AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM terms GROUP BY term),
bounded AS (SELECT term, df, cf, n_docs FROM stats, n WHERE df >= 5 AND df <= 0.95e0 * n_docs),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, term, df, cf, n_docs,
    ln((1.0e0 + n_docs) / (1.0e0 + df)) + 1.0e0 AS idf
  FROM (SELECT * FROM bounded ORDER BY cf DESC, term LIMIT 500)
),
tf AS (
  SELECT doc_id, idx, count(*) AS n, (1.0e0 + ln(count(*))) AS tf, any_value(idf) AS idf
  FROM terms JOIN vocab USING (term) GROUP BY doc_id, idx
),
weights AS (
  SELECT doc_id, idx, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS weight FROM tf
)
{body}"""


def _tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(tfidf.tokens("text"), " ").alias("tokens"))


def _kept(spark, sf):
    words = tfidf.without_stop_words(tfidf.tokens("text"), tfidf.stop_list(CONFIG))
    return _docs(spark, sf).select("doc_id", F.array_join(words, " ").alias("words"))


def _terms(spark, sf):
    return tfidf.with_terms(_docs(spark, sf), "text", CONFIG).select(F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull()).groupBy("term").agg(
        F.count(F.lit(1)).alias("n")
    )


def _frequency(spark, sf):
    return tfidf.document_frequency(_docs(spark, sf), "text", CONFIG).select("term", "df", "cf")


def _vocabulary(spark, sf):
    return tfidf.vocabulary(_docs(spark, sf), "text", CONFIG).select("idx", "term", "df", "cf", F.round("idf", 6).alias("idf"))


def _counts(spark, sf):
    docs = _docs(spark, sf)
    cells = tfidf.fit(docs, "text", CONFIG).hits(docs, "text").select("doc_id", F.inline_outer("hits")).where(F.col("idx").isNotNull())
    return cells.select("doc_id", "idx", F.col("n").cast("long").alias("n"), F.round(1.0 + F.log("n"), 6).alias("tf"))


def _weights(spark, sf):
    docs = _docs(spark, sf)
    long = tfidf.fit(docs, "text", CONFIG).transform_long(docs, "doc_id", "text")
    return long.select("doc_id", "idx", F.round("weight", 6).alias("weight"))


def _norms(spark, sf):
    docs = _docs(spark, sf)
    rows = tfidf.fit(docs, "text", CONFIG).weights(docs, "text", "v")
    square = F.aggregate("v", F.lit(0.0), lambda a, h: a + h["weight"] * h["weight"])
    return rows.select("doc_id", F.round(F.sqrt(square), 6).alias("norm"))


def _unseen(spark, sf):
    """A vocabulary fitted on documents applied to another corpus, conversations."""
    model = tfidf.fit(_docs(spark, sf), "text", CONFIG)
    turns = table(spark, sf, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), "text"
    )
    long = model.transform_long(turns, "turn_id", "text")
    return long.groupBy("turn_id").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("weight_sum")
    )


_UNSEEN_SQL = r""",
tok2 AS (
  SELECT turn_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (
    SELECT conv_id || ':' || turn AS turn_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ws FROM conversations)
),
kept2 AS (
  SELECT turn_id, w, row_number() OVER (PARTITION BY turn_id ORDER BY pos) AS pos
  FROM tok2 WHERE w NOT IN (SELECT w FROM stops)
),
terms2 AS (
  SELECT turn_id, w AS term FROM kept2
  UNION ALL
  SELECT a.turn_id, a.w || ' ' || b.w FROM kept2 a JOIN kept2 b ON a.turn_id = b.turn_id AND b.pos = a.pos + 1
),
tf2 AS (
  SELECT turn_id, idx, (1.0e0 + ln(count(*))) * any_value(idf) AS w
  FROM terms2 JOIN vocab USING (term) GROUP BY turn_id, idx
)
SELECT turn_id, count(*) AS terms, round(sum(w / norm), 6) AS weight_sum
FROM (SELECT turn_id, w, sqrt(sum(w * w) OVER (PARTITION BY turn_id)) AS norm FROM tf2) GROUP BY turn_id"""

QUERIES = {
    "d01_tokens": (
        _tokens,
        r"SELECT doc_id, coalesce(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), ' '), '') AS tokens FROM documents",
    ),
    "d02_stop_words_removed": (
        _kept,
        _sql("""SELECT d.doc_id, coalesce(words, '') AS words FROM documents d
                LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS words FROM kept GROUP BY doc_id) k
                USING (doc_id)"""),
    ),
    "d03_ngrams": (_terms, _sql("SELECT term, count(*) AS n FROM terms GROUP BY term")),
    "d04_document_frequency": (_frequency, _sql("SELECT term, df, cf FROM bounded")),
    "d05_vocabulary": (_vocabulary, _sql("SELECT idx, term, df, cf, round(idf, 6) AS idf FROM vocab")),
    "d06_sublinear_tf": (_counts, _sql("SELECT doc_id, idx, n, round(tf, 6) AS tf FROM tf")),
    "d07_smooth_idf": (
        lambda spark, sf: _vocabulary(spark, sf).select("term", "idf"),
        _sql("SELECT term, round(idf, 6) AS idf FROM vocab"),
    ),
    "d08_row_norms": (
        _norms,
        _sql("""SELECT d.doc_id, CASE WHEN t.doc_id IS NULL THEN 0.0e0 ELSE 1.0e0 END AS norm
                FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM tf) t USING (doc_id)"""),
    ),
    "d09_weights": (_weights, _sql("SELECT doc_id, idx, round(weight, 6) AS weight FROM weights")),
    "d10_zero_block": (
        lambda spark, sf: tfidf.zero_block(_docs(spark, sf), "v").select(
            "doc_id", F.size(vector_to_array("v")).alias("size"),
            F.aggregate(vector_to_array("v"), F.lit(0.0), lambda a, x: a + x).alias("mass"),
        ),
        "SELECT doc_id, CAST(500 AS INTEGER) AS size, 0.0e0 AS mass FROM documents",
    ),
    "d09_weights_unseen_corpus": (_unseen, _sql(_UNSEEN_SQL)),
}
