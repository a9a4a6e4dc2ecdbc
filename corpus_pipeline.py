"""From raw documents to packed training sequences.

Stages, each over all that the one before kept: language identification drops documents that are of no
language, as they have no letter; near-duplicate removal keeps one document of each group; decontamination
drops documents that hold benchmark passages; packing cuts and places the tokens of the rest. The first
three decide every row by its text; rows without an id, or that share one, are judged like all others.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailwatch.llm import language
from mailwatch.llm.arrow_batches import few_rows
from mailwatch.llm.decontamination import contamination, judged
from mailwatch.llm.filtering import KEY, keyed, one_of_each_text, without
from mailwatch.llm.near_duplicates import near_duplicates
from mailwatch.llm.packing import packed_documents
from mailwatch.llm.scratch import new_folder, pinned

#: Trained networks, tokenizers and similarity joins have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def _keyless(stage):
    """The stage for documents that have a column of the key's name, too: it comes out as it went in."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if KEY not in docs.columns:
            return stage(spark, docs, sf_dir)
        free = KEY
        while free in docs.columns:
            free += "_"
        return stage(spark, docs.withColumnRenamed(KEY, free), sf_dir).withColumnRenamed(free, KEY)

    return run


@_keyless
def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the network can tell a language; only a null, empty or letterless text is of none.

    How sure the network is decides nothing: that depends on how many languages it has learned. Without any labelled
    document no language is told, and every text with a letter stays. Texts go to the network but not back: those
    rejected are left out by a hash of the text. An empty table stays empty.
    """
    few_rows(spark)
    model = language.fit(docs.where(~language.held_out("doc_id")))
    rows = keyed(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language.identified(rows, model, keep=(KEY,))
    return without(rows, found.where(F.col("lang_pred") == language.UNDETERMINED), KEY).select(*docs.columns)


@_keyless
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, of the smallest id (none comes last); rows without a word are in no group."""
    few_rows(spark)
    rows = one_of_each_text(docs)
    found = near_duplicates(rows, id=KEY).where(F.col(KEY).isNotNull()).select(KEY, "component_id")
    members = pinned(rows.select("doc_id", KEY).join(found, KEY))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", KEY)
    first = members.groupBy("component_id").agg(F.min(place).alias("first"))
    gone = members.join(first, "component_id").where(F.col(KEY) != F.col(f"first.{KEY}"))
    return without(rows, gone, KEY).select(*docs.columns)


@_keyless
def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth of the words.

    Rows of equal text are decided alike, whatever their ids. A null or empty text stays, and so do all with an empty benchmark.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs)
    return without(rows, judged(contamination(rows, benchmark, id=KEY)).where("contaminated"), KEY).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every document; a null or empty text is its end token alone, a text of any length is cut whole."""
    few_rows(spark)
    return packed_documents(docs)


STAGES = [
    ("language_id", keep_identified),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that every stage kept; each stage is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
