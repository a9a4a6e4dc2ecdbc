"""Token counts of documents in flat, unindexed token files.

A file is nothing but ids of fixed width, with an end id after each document. Files are read in blocks
of fixed size by many tasks; each block tells where ends stand in it. What a document has in earlier
blocks follows from the last end before its block, a running maximum over the blocks of a file, taken
first over stretches of blocks and then within them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_batches import few_rows, small
from .binary_files import make_folder, read_range, whole_file
from .scratch import new_folder, pinned
from .tokens import ordinary_encoder

#: ``<|endoftext|>`` of the vocabulary; its string in a text is ordinary text here.
END = 50256
_BLOCK = 4 << 20
_STRETCH = 1024


def write_flat(docs: DataFrame, folder: str, *, id: str = "doc_id", text: str = "text", dtype: str = "<u2", end: int = END) -> DataFrame:
    """Writes one flat file a partition of docs and returns (id, file, ordinal), the order of documents in them.

    A null text is a document without tokens. A partition without rows leaves no file.
    """
    make_folder(folder)
    given = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = given.schema["_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, done = TaskContext.get().partitionId(), 0
        parts = small(parts, "_text")
        first = next((p for p in parts if p.num_rows), None)
        if first is None:
            return
        name = f"tokens-{number:06d}.bin"
        with whole_file(f"{folder}/{name}") as out:
            part: pa.RecordBatch | None = first
            while part is not None:
                for ids in ordinary_encoder().ids(part.column("_text").to_pylist()):
                    out.write(np.append(ids, np.uint32(end)).astype(dtype).tobytes())
                n = part.num_rows
                yield pa.record_batch(
                    {"_id": part.column("_id"), "file": pa.array([name] * n), "ordinal": pa.array(np.arange(done, done + n))}
                )
                done += n
                part = next(parts, None)

    return pinned(given.mapInArrow(run, f"_id {kind}, file string, ordinal long").withColumnRenamed("_id", id))


def _scan(dtype: str, end: int, block: int):
    """For each block: its number of tokens, and where in it ends stand."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, number, length in zip(*(part.column(c).to_pylist() for c in ("path", "block", "length"))):
                data = np.frombuffer(read_range(path, number * block, min(block, length - number * block)), dtype)
                ends = np.flatnonzero(data == end).astype(np.int32)
                yield pa.record_batch(
                    {
                        "path": pa.array([path]), "block": pa.array([number], pa.int64()), "n": pa.array([len(data)], pa.int64()),
                        "ends": pa.array([ends], pa.list_(pa.int32())),
                    }
                )

    return run


def token_counts(spark: SparkSession, folder: str, *, dtype: str = "<u2", end: int = END, block: int = _BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in the flat files of a folder.

    start is its first token's place in the file and n_tokens excludes the end. Tokens after the last end
    are a document that is not closed. Documents may span any number of blocks; empty files have none.
    A file whose size is no multiple of the width of an id is refused.
    """
    width = np.dtype(dtype).itemsize
    if block % width:
        raise ValueError("a block holds whole ids")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    torn = files.where(F.col("length") % width != 0).limit(1).collect()
    if torn:
        raise ValueError(f"{torn[0]['path']} does not hold whole ids")
    blocks = files.where("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block).cast("long"))).alias("block")
    )
    # A given number of partitions stays, however small the list of blocks is.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = pinned(
        blocks.repartition(parts, "path", "block").mapInArrow(_scan(dtype, end, block), "path string, block long, n long, ends array<int>")
    )
    size = block // width
    marks = found.select(
        "path", "block", F.floor(F.col("block") / _STRETCH).alias("stretch"), F.size("ends").cast("long").alias("k"),
        F.when(F.size("ends") > 0, F.col("block") * size + F.element_at("ends", -1) + 1).alias("last"),
    )
    stretches = marks.groupBy("path", "stretch").agg(F.sum("k").alias("k"), F.max("last").alias("last"))
    over = Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = stretches.select("path", "stretch", F.sum("k").over(over).alias("k_before"), F.max("last").over(over).alias("last_before"))
    inside = Window.partitionBy("path", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.join(before, ["path", "stretch"]).select(
        "path", "block",
        (F.coalesce("k_before", F.lit(0)) + F.coalesce(F.sum("k").over(inside), F.lit(0))).alias("done"),
        F.coalesce(F.max("last").over(inside), "last_before", F.lit(0)).alias("open"),
    )
    rows = found.join(carried, ["path", "block"]).select("path", "done", "open", "block", F.posexplode("ends").alias("i", "at"), "ends")
    stop = F.col("block") * size + F.col("at")
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("block") * size + F.get("ends", F.col("i") - 1) + 1)
    closed = rows.select(
        "path", (F.col("done") + F.col("i")).alias("ordinal"), start.alias("start"), (stop - start).alias("n_tokens"), F.lit(True).alias("closed")
    )
    totals = marks.groupBy("path").agg(F.sum("k").alias("ordinal"), F.coalesce(F.max("last"), F.lit(0)).alias("start"))
    sizes = files.select("path", (F.col("length") / width).cast("long").alias("all"))
    rest = totals.join(sizes, "path").where(F.col("all") > F.col("start"))
    unclosed = rest.select("path", "ordinal", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(unclosed).select(F.substring_index("path", "/", -1).alias("file"), "ordinal", "start", "n_tokens", "closed")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as flat token files, then counted from these alone; the order written tells their ids."""
    few_rows(spark)
    folder = new_folder(spark, "tokens")
    order = write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return order.join(token_counts(spark, folder), ["file", "ordinal"], "full").select("doc_id", "file", "ordinal", "start", "n_tokens", "closed")
