"""Joins of entities with feature tables.

Sides are never force-broadcast: adaptive execution picks a broadcast join when the
measured side fits ``spark.sql.autoBroadcastJoinThreshold`` and a sort-merge join with
split skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def left_join_suffixed(left: DataFrame, right: DataFrame, on: str, suffix: str) -> DataFrame:
    """Left equi-join; names present on both sides keep the left one, the right gets ``suffix``."""
    clashes = {c for c in right.columns if c != on and c in left.columns}
    renamed = right.select(*[F.col(c).alias(c + suffix) if c in clashes else F.col(c) for c in right.columns])
    return left.join(renamed, on, "left")


def join_sender_features(entities: DataFrame, sender: DataFrame | None, on: str = "sender_domain") -> DataFrame:
    """Sender aggregates by domain; a missing table or column leaves the entities unchanged."""
    if sender is None or on not in entities.columns:
        return entities
    return left_join_suffixed(entities, sender, on, "_sender")


def lookup_with_defaults(
    keys: DataFrame, features: DataFrame, on: Sequence[str], defaults: Mapping[str, float]
) -> DataFrame:
    """Left lookup; absent rows and NULL cells take the column's default."""
    wanted = features.select(*on, *[F.col(c).alias(f"_f_{c}") for c in defaults])
    joined = keys.join(wanted, list(on), "left")
    return joined.select(
        *keys.columns,
        *[F.coalesce(F.col(f"_f_{c}").cast("double"), F.lit(float(d))).alias(c) for c, d in defaults.items()],
    )


def salted_lookup(
    left: DataFrame, right: DataFrame, on: str, salt_from: str, salts: int = 16
) -> DataFrame:
    """Left join for a key so hot that even a split partition is too large.

    Left rows of a key spread over ``salts`` partitions; the right side (one row per key)
    is repeated once per salt.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [on, "_salt"], "left").drop("_salt")


def point_in_time_join(
    entities: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    ttl: timedelta | None,
    feature_columns: Sequence[str],
    entity_ts: str = "event_timestamp",
    feature_ts: str = "event_timestamp",
    tie: Sequence[str] = (),
    slot: str = "hour",
) -> DataFrame:
    """Latest feature row per entity with feature_ts ≤ entity_ts and age ≤ ttl.

    Works on (key, time slot) pieces instead of whole keys: inside a slot a window finds
    the newest feature row; rows without one take the newest row of the last earlier slot,
    carried forward over a table of one row per key and slot. A key that owns a third of
    all rows is thereby spread over its slots, and equal (key, entity_ts) pairs are looked
    up once.
    """
    keys = list(keys)
    feats = features.select(
        *keys,
        F.col(feature_ts).alias("_fts"),
        F.struct(F.col(feature_ts).alias("ts"), *[F.col(c).alias(c) for c in feature_columns]).alias("_row"),
        F.struct(*[F.col(c) for c in (tie or feature_columns)]).alias("_tie"),
    )
    # One candidate per (key, timestamp).
    feats = feats.groupBy(*keys, "_fts").agg(F.max_by("_row", "_tie").alias("_row"))
    slot_of = lambda c: F.date_trunc(slot, F.col(c).cast("timestamp"))
    feats = feats.withColumn("_slot", slot_of("_fts"))
    moments = (
        entities.select(*keys, F.col(entity_ts).alias("_ets"))
        .distinct()
        .withColumn("_slot", slot_of("_ets"))
    )

    # Newest feature row of each slot, carried forward to the slots that follow.
    per_slot = feats.groupBy(*keys, "_slot").agg(F.max_by("_row", "_fts").alias("_last"))
    wanted = moments.select(*keys, "_slot").distinct().withColumn("_last", F.lit(None).cast(per_slot.schema["_last"].dataType))
    by_slot = Window.partitionBy(*keys).orderBy("_slot")
    carried = (
        wanted.unionByName(per_slot)
        .groupBy(*keys, "_slot")
        .agg(F.max("_last").alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(by_slot.rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "_slot", "_carry")
    )

    empty = F.lit(None).cast(feats.schema["_row"].dataType)
    stream = feats.select(*keys, "_slot", F.col("_fts").alias("_ts"), "_row", F.lit(0).alias("_kind")).unionByName(
        moments.select(*keys, "_slot", F.col("_ets").alias("_ts"), empty.alias("_row"), F.lit(1).alias("_kind"))
    )
    in_slot = Window.partitionBy(*keys, "_slot").orderBy("_ts", "_kind")
    found = (
        stream.withColumn("_hit", F.last("_row", ignorenulls=True).over(in_slot))
        .where(F.col("_kind") == 1)
        .join(carried, [*keys, "_slot"], "left")
        .select(*keys, F.col("_ts").alias(entity_ts), F.coalesce("_hit", "_carry").alias("_hit"))
    )
    if ttl is not None:
        fresh = F.col("_hit.ts") >= F.col(entity_ts) - F.lit(ttl)
        found = found.withColumn("_hit", F.when(fresh, F.col("_hit")))
    joined = entities.join(found, [*keys, entity_ts], "left")
    return joined.select(*entities.columns, *[F.col(f"_hit.{c}").alias(c) for c in feature_columns])


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of several same-schema parts, matched by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in set(b.columns)]
