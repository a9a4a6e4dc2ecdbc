"""Corpus-fitted TF-IDF: vocabulary by one term aggregate, vectors without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TfidfConfig
from ..functions.stop_words import ENGLISH
from ..functions.text import text_or_empty

#: Letters, digits of every kind and the underscore; combining marks end a token.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of at least two word characters (Unicode)."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def without_stop_words(words: Column, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of the word list, joined by one space.

    Longer grams grow from shorter ones by pairing each with the word that follows it, so
    the word list is read a fixed number of times and never inside a lambda. A gram with a null word is null.
    """
    grams, parts = words, [words] if low == 1 else []
    for n in range(2, high + 1):
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, F.lit(1), count), F.slice(words, F.lit(n), count), lambda g, w: F.concat(g, F.lit(" "), w)
        )
        if n >= low:
            parts.append(grams)
    return F.concat(*parts)


def stop_list(config: TfidfConfig) -> list[str]:
    return list(config.stop_words) if config.stop_words is not None else list(ENGLISH)


def with_terms(docs: DataFrame, text: str, config: TfidfConfig, out: str = "terms") -> DataFrame:
    """Adds the term list of every document."""
    words = without_stop_words(tokens(text), stop_list(config))
    low, high = config.ngrams
    # Two projections: the word list is referenced several times by the n-grams.
    return docs.withColumn("_words", words).withColumn(out, ngrams(F.col("_words"), low, high)).drop("_words")


def term_statistics(docs: DataFrame, text: str, config: TfidfConfig) -> DataFrame:
    """Per term: documents containing it (df) and occurrences (cf).

    One pass: every document contributes its terms and, behind them, its distinct terms; both are combined map-side before the
    shuffle on the term.
    """
    return _statistics(with_terms(docs, text, config).select("terms"))


def _statistics(terms: DataFrame) -> DataFrame:
    lists = terms.select(F.size("terms").alias("_n"), F.concat("terms", F.array_distinct("terms")).alias("_all"))
    # Outer: from an inner one the optimizer derives a filter on the array and makes the array once more for it.
    rows = lists.select("_n", F.posexplode_outer("_all").alias("_at", "term")).where(F.col("term").isNotNull())
    each = F.col("_at") < F.col("_n")
    return rows.groupBy("term").agg(F.count_if(~each).alias("df"), F.count_if(each).alias("cf"))


def document_frequency(docs: DataFrame, text: str, config: TfidfConfig) -> DataFrame:
    """Terms inside the df bounds, with the corpus size alongside."""
    return _bounded(term_statistics(docs, text, config), docs, config)


def _bounded(stats: DataFrame, docs: DataFrame, config: TfidfConfig) -> DataFrame:
    size = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return stats.where(F.col("df") >= config.min_df).withColumn("n_docs", size.scalar()).where(
        F.col("df") <= F.lit(float(config.max_df)) * F.col("n_docs")
    )


def vocabulary(docs: DataFrame, text: str, config: TfidfConfig) -> DataFrame:
    """The chosen terms of the corpus, as :func:`select_vocabulary` takes them from all terms.

    A longer gram occurs no more often than any of its words. So once there are as many words in the df bounds as terms are
    wanted, grams of words rarer than the last of those cannot be chosen, and only the others are counted. If too few words are
    in the bounds, or very many are as frequent as the last, all terms are counted.
    """
    low, high = config.ngrams
    if low == 1 and high > 1:
        most = 8 * config.max_features
        words = term_statistics(docs, text, replace(config, ngrams=(1, 1))).withColumn("n_docs", docs.agg(F.count(F.lit(1))).scalar())
        common = words.orderBy(F.col("cf").desc(), "term").limit(most + 1).collect()
        chosen = [r for r in common if config.min_df <= r["df"] <= config.max_df * r["n_docs"]][: config.max_features]
        least = chosen[-1]["cf"] if len(chosen) == config.max_features > 0 else None
        frequent = [r["term"] for r in common if least is not None and r["cf"] >= least]
        if 0 < len(frequent) <= most:
            grams = _bounded(_statistics(_terms_among(docs, text, replace(config, ngrams=(2, high)), frequent)), docs, config)
            top = docs.sparkSession.createDataFrame([r.asDict() for r in chosen], grams.schema)
            return select_vocabulary(top.unionByName(grams.where(F.col("cf") >= least)), config.max_features)
    return select_vocabulary(document_frequency(docs, text, config), config.max_features)


def _terms_among(docs: DataFrame, text: str, config: TfidfConfig, words: Sequence[str], out: str = "terms") -> DataFrame:
    """Adds the list of those terms of every document that consist of the given words only."""
    kept = F.transform(without_stop_words(tokens(text), stop_list(config)), lambda w: F.when(w.isin(list(words)), w))
    low, high = config.ngrams
    grams = docs.withColumn("_words", kept).withColumn(out, ngrams(F.col("_words"), low, high)).drop("_words")
    return grams.withColumn(out, F.filter(out, lambda t: t.isNotNull()))


def select_vocabulary(terms: DataFrame, size: int) -> DataFrame:
    """Top terms by occurrences (ties alphabetical), indexed alphabetically, with idf."""
    top = terms.orderBy(F.col("cf").desc(), "term").limit(size)
    # At most `size` rows remain, so the index comes from one small sorted array.
    ordered = top.agg(F.array_sort(F.collect_list(F.struct("term", "df", "cf", "n_docs"))).alias("v"))
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return ordered.select(F.posexplode("v").alias("idx", "t")).select("idx", "t.*").withColumn("idf", idf)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row however often, and in whatever lambda, it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary: at most ``max_features`` terms with their idf."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    config: TfidfConfig

    def counts(self, docs: DataFrame, text: str, out: str = "counts") -> DataFrame:
        """Adds the vector of occurrences of each vocabulary term, in vocabulary order."""
        model = CountVectorizerModel.from_vocabulary(list(self.terms), "terms", out)
        # No other words than those of the vocabulary become strings of the JVM, and no other pairs are made.
        words = sorted({w for t in self.terms for w in t.split(" ")})
        return model.transform(_terms_among(docs, text, self.config, words)).drop("terms")

    def hits(self, docs: DataFrame, text: str = "body_text", out: str = "hits") -> DataFrame:
        """Adds (idx, n) of the vocabulary terms that a text has, in order of idx."""
        if not self.terms:
            return docs.withColumn(out, F.array().cast("array<struct<idx:int,n:double>>"))
        # A sparse vector: its positions and values.
        pairs = _once(F.unwrap_udt("_counts"), lambda v: F.arrays_zip(v["indices"].alias("idx"), v["values"].alias("n")))
        return self.counts(docs, text, "_counts").withColumn(out, pairs).drop("_counts")

    def weights(self, docs: DataFrame, text: str = "body_text", out: str = "tfidf") -> DataFrame:
        """Adds the L2-normalised weights (idx, weight) of the terms that a text has; no shuffle, any corpus, rows kept as they are.

        Work and size follow the hits of a text, not the vocabulary. A document without vocabulary terms gets an empty list.
        """
        if not self.terms:
            return docs.withColumn(out, F.array().cast("array<struct<idx:int,weight:double>>"))
        idf = F.array(*[F.lit(v) for v in self.idf])
        raw = F.transform("_hits", lambda h: F.struct(h["idx"].alias("idx"), ((F.lit(1.0) + F.log(h["n"])) * F.get(idf, h["idx"])).alias("weight")))

        def normalised(cells: Column) -> Column:
            square = F.aggregate(cells, F.lit(0.0), lambda a, h: a + h["weight"] * h["weight"])
            return _once(F.sqrt(square), lambda n: F.transform(cells, lambda h: F.struct(h["idx"].alias("idx"), (h["weight"] / n).alias("weight"))))

        return self.hits(docs, text, "_hits").withColumn(out, _once(raw, normalised)).drop("_hits")

    def transform_long(self, docs: DataFrame, key: str, text: str = "body_text") -> DataFrame:
        """Weights as (key, idx, weight): one row per hit."""
        return self.weights(docs.select(key, text), text, "_w").select(key, F.inline_outer("_w")).where(F.col("idx").isNotNull())

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, float(v)) for i, (t, v) in enumerate(zip(self.terms, self.idf))]
        return spark.createDataFrame(rows, "idx int, term string, idf double")

    @classmethod
    def from_frame(cls, frame: DataFrame, config: TfidfConfig) -> "TfidfModel":
        rows = sorted(frame.select("idx", "term", "idf").collect(), key=lambda r: r["idx"])
        return cls(tuple(r["term"] for r in rows), tuple(r["idf"] for r in rows), config)


def fit(docs: DataFrame, text: str = "body_text", config: TfidfConfig = TfidfConfig()) -> TfidfModel:
    """Fit on the corpus; only the ≤ max_features chosen terms and at most 8 times as many frequent words reach the driver."""
    return TfidfModel.from_frame(vocabulary(docs, text, config), config)


def wide_columns(df: DataFrame, column: str = "tfidf", size: int = 500) -> DataFrame:
    """tfidf_0 … tfidf_{size-1} columns from the weights; terms that a text lacks are 0."""
    values = df.withColumn("_cells", F.map_from_entries(column)).drop(column)
    cells = [F.coalesce(F.try_element_at("_cells", F.lit(i)), F.lit(0.0)).alias(f"tfidf_{i}") for i in range(size)]
    return values.select(*[c for c in values.columns if c != "_cells"], *cells)


def zero_block(df: DataFrame, out: str = "tfidf", size: int = 500) -> DataFrame:
    """The dense block used when no fitted vocabulary exists."""
    return df.withColumn(out, array_to_vector(F.array_repeat(F.lit(0.0), size)))
