"""Training-order materialisation of token sequences as fixed-stride binary shards.

Slots are reserved before anything is tokenised: a text of n bytes has at most n tokens and an end, so
the number of its sequences is bounded, and the bounds are numbered through. A keyed Feistel permutation
with cycle-walking maps these numbers onto global slots without a table. A shard holds the sequences of
a range of slots in their order, each in a record of equal size; reserved slots that no sequence needs
take no room. Texts are tokenised once, and a reader that stopped goes on at a place it can compute.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_batches import few_rows, small
from .binary_files import make_folder, read_range, whole_file
from .hashing import mix
from .scratch import new_folder, pinned
from .tokens import ordinary_encoder

END = 50256
_HEAD = np.dtype([("id", "<i8"), ("start", "<i8"), ("piece", "<i4"), ("length", "<i4")])


@dataclass(frozen=True)
class OrderConfig:
    """key and rounds of the permutation; length: tokens of a sequence; dtype: an id's width; shard: reserved slots a file."""

    key: int = 0x5EED
    rounds: int = 6
    length: int = 512
    dtype: str = "<u2"
    shard: int = 65_536

    @property
    def stride(self) -> int:
        return _HEAD.itemsize + self.length * np.dtype(self.dtype).itemsize


def permuted(numbers: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slot of each number: a permutation of 0 … size - 1 that the key decides.

    Two halves of equal width are mixed in turn over the next power of four; a result beyond size is
    permuted again until it falls inside, which takes fewer than four steps on average.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.array(numbers, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            with np.errstate(over="ignore"):
                turn = mix(right + np.uint64((key * 2 + 1) * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95 & (1 << 64) - 1))
            left, right = right, left ^ ((turn >> np.uint64(20)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _placed(starts: dict[int, tuple[int, int]], total: int, config: OrderConfig):
    """(slot, body) of every sequence; starts has the first number and the count of numbers of each partition."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, used = None, 0
        for part in small(parts, "text"):
            number = part.column("row")[0].as_py() >> 33
            first, reserved = starts[number]
            numbers, bodies = [], []
            tokens = ordinary_encoder().ids(part.column("text").to_pylist())
            for doc, bound, ids in zip(part.column("id").to_pylist(), part.column("bound").to_pylist(), tokens):
                ids = np.append(ids, np.uint32(END)).astype(config.dtype)
                for piece, start in enumerate(range(0, len(ids), config.length)):
                    cut = ids[start : start + config.length]
                    numbers.append(first + used + piece)
                    bodies.append(np.array([(doc, start, piece, len(cut))], _HEAD).tobytes() + cut.tobytes())
                used += bound
            slots = permuted(np.array(numbers, np.uint64), total, config.key, config.rounds)
            yield pa.record_batch({"slot": pa.array(slots), "body": pa.array(bodies, pa.binary())})
        if number is not None and used != starts[number][1]:
            raise RuntimeError("the input was partitioned differently when its slots were reserved")

    return run


def _written(folder: str, config: OrderConfig):
    """Writes the rows of one partition, which are those of one shard in order of slots."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = next((p for p in parts if p.num_rows), None)
        if part is None:
            return
        shard, written = part.column("slot")[0].as_py() // config.shard, 0
        with whole_file(f"{folder}/shard-{shard:08d}.bin") as out:
            while part is not None:
                out.write(b"".join(b.ljust(config.stride, b"\0") for b in part.column("body").to_pylist()))
                written += part.num_rows
                part = next(parts, None)
        yield pa.record_batch({"shard": pa.array([shard], pa.int64()), "n": pa.array([written], pa.int64())})

    return run


def materialised(docs: DataFrame, folder: str, *, id: str = "doc_id", text: str = "text", config: OrderConfig = OrderConfig()) -> DataFrame:
    """Writes all sequences of docs to folder in their training order; returns (shard, n, before), what each file holds.

    before is the number of sequences in the shards ahead. A document is the ids of its text (none for
    null) and an end, cut into pieces of length tokens; the last may be shorter and is filled up with
    zeros in its record. ids must be whole numbers; a null id is written as the smallest one. Other
    columns are ignored. An empty table writes nothing. docs is read twice, lengths first, and must be
    partitioned alike both times, as files and checkpoints are; the job fails if it is not.
    """
    make_folder(folder)
    given = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("bound", F.floor(F.octet_length("text") / config.length).cast("long") + 1)
    # One row a partition of the scan.
    reserved = given.groupBy(F.shiftright("row", 33).alias("number")).agg(F.sum("bound").alias("n")).collect()
    total, starts = 0, {}
    for r in sorted(reserved, key=lambda r: r["number"]):
        starts[r["number"]], total = (total, r["n"]), total + r["n"]
    placed = given.mapInArrow(_placed(starts, total, config), "slot long, body binary")
    shards = max(1, -(-total // config.shard))
    ranged = placed.repartitionById(shards, F.floor(F.col("slot") / config.shard).cast("int")).sortWithinPartitions("slot")
    done = pinned(ranged.mapInArrow(_written(folder, config), "shard long, n long"))
    # One row a shard.
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, config: OrderConfig = OrderConfig(), start: int = 0) -> DataFrame:
    """(position, shard, id, piece, start, length, tokens) of the sequences from position start on, range by range."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder).select("path")
    numbered = files.withColumn("shard", F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long"))
    wanted = numbered.join(manifest.where(F.col("before") + F.col("n") > start), "shard")
    step = 4096

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, shard, before, first, n in zip(*(part.column(c).to_pylist() for c in ("path", "shard", "before", "first", "n"))):
                data = read_range(path, first * config.stride, n * config.stride)
                rows = np.frombuffer(data, np.uint8).reshape(-1, config.stride)
                head = np.ascontiguousarray(rows[:, : _HEAD.itemsize]).view(_HEAD).ravel()
                body = np.ascontiguousarray(rows[:, _HEAD.itemsize :]).view(config.dtype).astype(np.int32)
                tokens = [b[:k] for b, k in zip(body, head["length"])]
                yield pa.record_batch(
                    {
                        "position": pa.array(before + first + np.arange(len(rows))), "shard": pa.array(np.full(len(rows), shard)),
                        "id": pa.array(head["id"]), "piece": pa.array(head["piece"]), "start": pa.array(head["start"]),
                        "length": pa.array(head["length"].astype(np.int64)), "tokens": pa.array(tokens, pa.list_(pa.int32())),
                    }
                )

    begin = F.greatest(F.lit(start) - F.col("before"), F.lit(0))
    spans = wanted.withColumn("first", F.explode(F.sequence(begin, F.col("n") - 1, F.lit(step).cast("long"))))
    spans = spans.select("path", "shard", "before", "first", F.least(F.lit(step), F.col("n") - F.col("first")).alias("n"))
    schema = "position long, shard long, id long, piece int, start long, length long, tokens array<int>"
    # A given number of partitions stays, however small the list of spans is.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spans.repartition(parts, "shard", "first").mapInArrow(run, schema)


def digested(rows: DataFrame) -> DataFrame:
    """Replaces tokens by ids_crc32, of their little-endian unsigned 32-bit form."""
    kept = [c for c in rows.columns if c != "tokens"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            tokens = part.column("tokens")
            ends = np.concatenate([[0], np.cumsum(np.asarray(tokens.value_lengths()))])
            flat = np.asarray(tokens.flatten()).astype("<u4").tobytes()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch({**{c: part.column(c) for c in kept}, "ids_crc32": pa.array(crc, pa.int64())})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "tokens")
    return rows.mapInArrow(run, f"{schema}, ids_crc32 long")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written in training order, and what a sequential reader finds at every position."""
    few_rows(spark)
    folder = new_folder(spark, "order")
    manifest = materialised(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    rows = read_shards(spark, folder, manifest)
    return digested(rows).withColumnRenamed("id", "doc_id")
