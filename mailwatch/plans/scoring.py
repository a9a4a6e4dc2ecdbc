"""Batch scoring: features → vector → probability → decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import PROFILES, SCALARS, SENDER, scalar_columns
from ..functions.labels import decide, label_name
from ..functions.numeric import finite_or_zero
from ..operators.joins import lookup_with_defaults
from ..operators.scaling import VectorScaler, assemble
from ..operators.tfidf import TfidfModel
from ..session import scratch_folder


def decided(scored: DataFrame, timestamp: Column, model_version: str, threshold: float = 0.7) -> DataFrame:
    """Adds label, label name, timestamp text and model version to ``spam_probability``."""
    return scored.withColumns(
        {
            "spam_label": decide("spam_probability", threshold),
            "prediction_label": label_name(decide("spam_probability", threshold)),
            "prediction_timestamp": F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss"),
            "model_version": F.lit(model_version),
        }
    )


def probability(model: Transformer, df: DataFrame, out: str = "spam_probability") -> DataFrame:
    """P(class 1)."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def full_features(
    emails: DataFrame, senders: DataFrame | None, tfidf: TfidfModel | None, profile: str = "batch",
    keep: Sequence[str] = ("email_id",),
) -> DataFrame:
    """Scalars, TF-IDF weights and sender features of every message, defaults per profile.

    Senders are looked up before anything is vectorised, so that no vector crosses an exchange.
    """
    defaults = PROFILES[profile].sender
    if senders is None:
        df = emails.withColumns({c: F.lit(float(v)) for c, v in defaults.items()})
    else:
        df = lookup_with_defaults(emails, senders, ["sender_domain"], defaults)
    if tfidf is not None:
        df = tfidf.weights(df, "body_text", "tfidf")
    block = ["tfidf"] if tfidf is not None else []
    scalars = [c.alias(n) for n, c in scalar_columns(profile).items()]
    domain = [] if "sender_domain" in keep else ["sender_domain"]
    return df.select(*keep, *domain, *scalars, *block, *defaults)


def sparse_cells(features: DataFrame, terms: int, out: str = "features") -> DataFrame:
    """Replaces the feature columns by one sparse vector, as a struct of its positions and values.

    Scalars come first, then the ``terms`` places of the vocabulary, then sender features. NULL, NaN, ±Inf and 0 take no place.
    """
    def cells(names: Sequence[str], first: int) -> Column:
        return F.array(*[F.struct(F.lit(first + i).alias("i"), finite_or_zero(n).alias("v")) for i, n in enumerate(names)])

    words = F.transform("tfidf", lambda h: F.struct((h["idx"] + len(SCALARS)).alias("i"), h["weight"].alias("v")))
    every = F.concat(cells(SCALARS, 0), words, cells(SENDER, len(SCALARS) + terms))
    rest = [c for c in features.columns if c not in {*SCALARS, *SENDER, "tfidf"}]
    rows = features.select(*rest, F.filter(every, lambda c: c["v"] != 0).alias("_cells"))
    parts = {"type": F.lit(0).cast("tinyint"), "size": F.lit(len(SCALARS) + terms + len(SENDER)), "indices": F.col("_cells.i"), "values": F.col("_cells.v")}
    return rows.select(*rest, F.struct(*[c.alias(n) for n, c in parts.items()]).alias(out))


def stored_vectors(features: DataFrame, terms: int, out: str = "features") -> DataFrame:
    """The sparse vectors as a table of the shared folder, written once and read by fit and scoring alike.

    A stored vector has the layout of :func:`sparse_cells`, so reading the column as vectors is all the conversion there is.
    """
    spark = features.sparkSession
    rows = sparse_cells(features, terms, out)
    path = scratch_folder(spark, "vectors")
    rows.write.parquet(path)
    fields = [T.StructField(f.name, VectorUDT() if f.name == out else f.dataType) for f in rows.schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def vectors(features: DataFrame, scaler: VectorScaler | None = None) -> DataFrame:
    """The dense vector of scalars and sender features in fixed order, scaled when a scaler is given."""
    raw = assemble(features, SCALARS, None, SENDER)
    return raw if scaler is None else scaler.transform(raw)


def scored_vectors(
    stored: DataFrame, model: Transformer, scaler: VectorScaler | None, timestamp: Column, model_version: str, threshold: float = 0.7
) -> DataFrame:
    """Decisions for a table of vectors; sparse ones are scaled without the shift."""
    rows = stored if scaler is None else scaler.scale_only(stored)
    return decided(probability(model, rows), timestamp, model_version, threshold)


def score_table(
    emails: DataFrame, model: Transformer, senders: DataFrame | None, tfidf: TfidfModel | None, scaler: VectorScaler | None,
    timestamp: Column, model_version: str, threshold: float = 0.7,
) -> DataFrame:
    """The whole job: narrow feature projections, one sender lookup, vectors that are stored if they hold words."""
    features = full_features(emails, senders, tfidf)
    if tfidf is None:
        return decided(probability(model, vectors(features, scaler)), timestamp, model_version, threshold)
    return scored_vectors(stored_vectors(features, len(tfidf.terms)), model, scaler, timestamp, model_version, threshold)
