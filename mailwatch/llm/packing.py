"""Best-fit packing of token sequences with exact complements first.

Lengths are whole numbers up to the capacity, so a table of counts a length, whose size does not
depend on the data, decides everything: the plan says how many sequences of which composition are
made. Pieces are then ranked within their length, bucket by bucket, and look up their place by rank;
no piece passes through the driver and no length through one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_batches import few_rows, small
from .scratch import pinned
from .tokens import END, VOCABULARY, encoder

CAPACITY = 1024
_BUCKET = 20_000


class _Stock:
    """Available lengths with an index of the sums that one, two or three of them reach."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self._index: tuple[np.ndarray, np.ndarray] | None = None

    def take(self, parts: list[int], times: int) -> None:
        for n, k in Counter(parts).items():
            self.counts[n] -= k * times
            if self.counts[n] < 3:
                self._index = None

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether two, and whether three, available lengths sum to each number."""
        if self._index is None:
            one = (self.counts > 0).astype(np.float64)
            two = np.convolve(one, one)[: len(one)] > 0.5
            self._index = two, np.convolve(one, two)[: len(one)] > 0.5
        return self._index

    def complement(self, gap: int, free: np.ndarray) -> list[int]:
        """One, two or three lengths, largest first, that fill the gap exactly from what is free; else none."""
        if free[gap] > 0:
            return [int(gap)]
        two, three = self.index()
        if two[gap] and (found := self._pair(gap, gap, free)):
            return found
        if three[gap]:
            for a in np.flatnonzero(free[1:gap])[::-1] + 1:
                if two[gap - a]:
                    free[a] -= 1
                    found = self._pair(gap - a, a, free)
                    free[a] += 1
                    if found:
                        return [int(a), *found]
        return []

    @staticmethod
    def _pair(total: int, most: int, free: np.ndarray) -> list[int]:
        a = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
        good = (free[a] > 0) & (free[total - a] > 0)
        good &= (2 * a != total) | (free[a] > 1)
        if not good.any():
            return []
        first = int(a[good.argmax()])
        return [first, int(total) - first]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths, how many sequences) for counts[length] pieces of each length from 1 to capacity.

    The longest piece left opens a sequence. If one, two or three others fill its gap exactly, that
    combination is used as often as its lengths last; otherwise the longest that fits is added (best
    fit) and the rest of the gap is tried again.
    """
    stock = _Stock(np.array(counts, np.int64))
    made = []
    for longest in range(capacity, 0, -1):
        while stock.counts[longest] > 0:
            free = stock.counts.copy()
            parts, gap = [longest], capacity - longest
            free[longest] -= 1
            while gap:
                exact = stock.complement(gap, free)
                if exact:
                    parts += exact
                    break
                fitting = np.flatnonzero(free[1 : gap + 1])
                if not len(fitting):
                    break
                best = int(fitting[-1]) + 1
                parts.append(best)
                free[best] -= 1
                gap -= best
            times = int(min(stock.counts[n] // k for n, k in Counter(parts).items()))
            stock.take(parts, times)
            made.append((parts, times))
    return made


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset: every piece gets a place in a sequence of at most capacity.

    Sequences are filled without gaps from offset 0. order names columns that tell pieces of equal
    length apart; rows equal in them are interchangeable. Lengths outside 1 to capacity are refused.
    An empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    # At most capacity rows.
    for r in pieces.groupBy(F.col(length).alias("n")).agg(F.count(F.lit(1)).alias("k")).collect():
        if r["n"] is None or not 0 < r["n"] <= capacity:
            raise ValueError(f"a piece of length {r['n']} does not fit into 1 to {capacity}")
        counts[r["n"]] = r["k"]
    used: Counter = Counter()
    slots, base = [], 0
    for parts, times in plan(counts, capacity):
        offset = 0
        for n in parts:
            slots.append((n, used[n], used[n] + times, base - used[n], offset))
            used[n] += times
            offset += n
        base += times
    places = spark.createDataFrame(slots, "_n long, _from long, _to long, _shift long, offset long")

    buckets = int(-(-counts.sum() // _BUCKET)) or 1
    keys = [F.col(c) for c in order]
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = spread.groupBy(F.col(length).alias("_n"), "_bucket").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy("_n").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_n", "_bucket", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(length, "_bucket").orderBy(*keys)
    ranked = spread.withColumn("_at", F.row_number().over(inside) - 1).join(
        starts.withColumnsRenamed({"_n": "_m", "_bucket": "_b"}),
        (F.col(length) == F.col("_m")) & (F.col("_bucket") == F.col("_b")),
    )
    ranked = ranked.withColumn("_rank", F.col("_at") + F.col("_start"))
    # The plan has a row for each slot of each composition; its size depends on the capacity alone.
    placed = ranked.join(
        F.broadcast(places), (F.col(length) == F.col("_n")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    )
    return placed.select(*pieces.columns, (F.col("_rank") + F.col("_shift")).alias("sequence_id"), "offset")


def cut(docs: DataFrame, *, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the token pieces of every row of docs.

    A row is the ids of its whole text (none for null) and the end id. Only rows longer than the
    capacity are cut; all pieces but the first have its full length. Other columns are ignored.
    """
    given = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = given.schema["_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(parts, "_text"):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoder(vocabulary).ids(part.column("_text").to_pylist())):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                at, step = 0, len(ids) % capacity or capacity
                for k in range(-(-len(ids) // capacity)):
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(step)
                    crc.append(zlib.crc32(ids[at : at + step].tobytes()))
                    at, step = at + step, capacity
            yield pa.record_batch(
                {
                    "_id": part.column("_id").take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    found = given.mapInArrow(run, f"_id {kind}, piece int, start long, length long, ids_crc32 long")
    return found.withColumnRenamed("_id", id)


def packed_documents(docs: DataFrame) -> DataFrame:
    return pack(pinned(cut(docs)))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows(spark)
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
