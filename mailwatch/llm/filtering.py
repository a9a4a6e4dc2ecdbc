"""Leaving rows out by what their text decides, whatever their ids are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import pinned

#: Up to this many keys (8 MB) go to all tasks, so that texts stay in place; more are joined by a shuffle.
SENT = 500_000

#: A 64-bit hash of the text. Rows of equal text are decided alike, so it stands for the row where only the text counts.
KEY = "_text_key"


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds KEY; a null text counts as an empty one."""
    return docs.withColumn(KEY, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _met(docs: DataFrame, ids: DataFrame, on: tuple[str, ...], how: str) -> DataFrame:
    """Rows of docs by whether the values of on, null being a value, are among ids."""
    ids = pinned(ids.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(on)]).distinct())
    found = ids.count()
    if not found:  # the texts need not be read for that
        return docs if how == "left_anti" else docs.where(F.lit(False))
    if found <= SENT:
        ids = F.broadcast(ids)
    same = [docs[c].eqNullSafe(ids[f"_{i}"]) for i, c in enumerate(on)]
    return docs.join(ids, same, how)


def without(docs: DataFrame, ids: DataFrame, *on: str) -> DataFrame:
    """The rows of docs whose values of on are not among ids."""
    return _met(docs, ids, on, "left_anti")


def one_of_each_text(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each text, of the smallest id (none comes last), with KEY; all rows without a word, whose KEY is null."""
    word = F.coalesce(F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = keyed(docs, text).withColumn(KEY, F.when(word, F.col(KEY)))
    place = F.struct(F.col(id).isNull().alias("nameless"), F.col(id).alias("id"))
    counts = pinned(rows.where(F.col(KEY).isNotNull()).groupBy(KEY, id).agg(F.count(F.lit(1)).alias("n")))
    first = counts.groupBy(KEY).agg(F.min(place).alias("first"))
    counts = counts.join(first, KEY).withColumn("leads", F.col(id).eqNullSafe(F.col("first.id")))
    single = without(rows, counts.where(~F.col("leads") | (F.col("n") > 1)), id, KEY)
    # Rows that agree in id and text meet by an aggregate, which combines in every task.
    again = counts.where(F.col("leads") & (F.col("n") > 1))
    repeated = _met(rows, again, (id, KEY), "left_semi").groupBy(id, KEY).agg(F.first(F.struct(*rows.columns)).alias("row"))
    return single.unionByName(repeated.select("row.*"))
