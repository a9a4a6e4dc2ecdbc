"""Entities, feature views and services as projections and joins over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import SENDER, TFIDF_SIZE
from ..operators.joins import point_in_time_join


@dataclass(frozen=True)
class Entity:
    name: str
    join_keys: tuple[str, ...]


@dataclass(frozen=True)
class FeatureView:
    name: str
    entity: Entity
    features: tuple[str, ...]
    ttl: timedelta | None
    source: str
    online: bool = True
    timestamp: str = "event_timestamp"


@dataclass(frozen=True)
class FeatureService:
    name: str
    views: tuple[str, ...]


EMAIL = Entity("email", ("email_id",))
DOMAIN = Entity("sender_domain", ("sender_domain",))
YEAR, MONTH = timedelta(days=365), timedelta(days=30)

# --- fixed values: columns of the named views --------------------------------------
VIEWS = (
    FeatureView(
        "email_text_features", EMAIL,
        ("url_count", "uppercase_ratio", "exclamation_count", "question_mark_count", "word_count",
         "char_count", "spam_keyword_count", "has_unsubscribe"),
        YEAR, "email_features",
    ),
    FeatureView(
        "email_structural_features", EMAIL,
        ("has_html", "html_to_text_ratio", "subject_length", "subject_has_re", "subject_has_fwd",
         "has_x_mailer", "sender_domain_length", "received_hop_count"),
        YEAR, "email_features",
    ),
    FeatureView(
        "email_temporal_features", EMAIL,
        ("hour_of_day", "day_of_week", "is_weekend", "is_night_hour"),
        YEAR, "email_features",
    ),
    FeatureView(
        "email_tfidf_features", EMAIL, tuple(f"tfidf_{i}" for i in range(TFIDF_SIZE)),
        YEAR, "email_features", online=False,
    ),
    FeatureView("sender_domain_features", DOMAIN, tuple(SENDER), MONTH, "sender_features"),
)
SERVICES = (
    FeatureService("serving", ("sender_domain_features",)),
    FeatureService("batch", tuple(v.name for v in VIEWS)),
    FeatureService("training", tuple(v.name for v in VIEWS[:4])),
    # Everything but the wide block, which serving computes itself.
    FeatureService("inference", tuple(v.name for v in VIEWS if v.name != "email_tfidf_features")),
)
# -----------------------------------------------------------------------------------


@dataclass
class FeatureStore:
    """Views over named source tables; ``tables`` maps a source name to a DataFrame."""

    tables: Mapping[str, DataFrame]
    views: Sequence[FeatureView] = VIEWS
    services: Sequence[FeatureService] = SERVICES

    def view(self, name: str) -> FeatureView:
        for v in self.views:
            if v.name == name:
                return v
        raise KeyError(f"unknown feature view: {name}")

    def service(self, name: str) -> FeatureService:
        for s in self.services:
            if s.name == name:
                return s
        raise KeyError(f"unknown feature service: {name}")

    def resolve(self, references: Sequence[str]) -> dict[str, list[str]]:
        """``view:feature`` references → features per view, in request order."""
        wanted: dict[str, list[str]] = {}
        for ref in references:
            name, _, feature = ref.partition(":")
            if feature not in self.view(name).features:
                raise KeyError(f"unknown feature: {ref}")
            wanted.setdefault(name, []).append(feature)
        return wanted

    def read(self, name: str) -> DataFrame:
        """The view as a projection of its source."""
        v = self.view(name)
        return self.tables[v.source].select(*v.entity.join_keys, v.timestamp, *v.features)

    def get(
        self, entities: DataFrame, service: str | None = None, references: Sequence[str] = (), tie: Sequence[str] = ()
    ) -> DataFrame:
        """Point-in-time features of the entities, in service (or request) order.

        Views on the same source, key and ttl are looked up together, so a service costs one
        as-of join per source and not one per view.
        """
        if service is not None:
            wanted = {n: list(self.view(n).features) for n in self.service(service).views}
        else:
            wanted = self.resolve(references)
        groups: dict[tuple, list[str]] = {}
        for name, columns in wanted.items():
            v = self.view(name)
            groups.setdefault((v.source, v.entity.join_keys, v.ttl, v.timestamp), []).extend(columns)
        out = entities
        for (source, keys, ttl, ts), columns in groups.items():
            out = point_in_time_join(
                out, self.tables[source], keys, ttl, columns, feature_ts=ts, tie=tie
            )
        return out.select(*entities.columns, *[c for cols in wanted.values() for c in cols])

    def statistics(self, spark: SparkSession) -> DataFrame:
        """One row per view: feature count, online flag, ttl in days, rows of its source."""
        sources = sorted({v.source for v in self.views if v.source in self.tables})
        counts = None
        for s in sources:
            one = self.tables[s].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(s).alias("source"), "rows")
            counts = one if counts is None else counts.unionByName(one)
        registry = spark.createDataFrame(
            [
                (v.name, v.source, len(v.features), v.online, v.ttl.days if v.ttl else None)
                for v in self.views
            ],
            "view string, source string, features int, online boolean, ttl_days int",
        )
        return registry.join(counts, "source", "left") if counts is not None else registry.withColumn("rows", F.lit(None).cast("long"))
