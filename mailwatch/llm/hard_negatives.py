"""Hard negatives for contrastive training, by slots between the upper limits of the positives.

Every anchor's positives each allow negatives up to a share of their score. The limits in descending
order split the scores into disjoint slots, and a row of another label falls into one slot only: that
of the last positive whose limit admits it. Tasks keep the first rows of every slot, so what is kept
does not grow with the rows they read; a positive's negatives are the first of its own slot and all
lower ones, a descending merge, cut at the positive's lower limit.

Anchors and rows meet in a grid of (block of anchors, cell of rows): each row of the table is sent to
as many tasks as there are blocks, each anchor to as many as there are cells. A task holds its block
with the entries kept so far and reads the rows of its cell chunk by chunk. Nothing is sent to the
driver but two counts, and equal ids, labels or vectors land in no common task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import pinned
from .vectors import first_of_groups, matrix, slices, usable, widened

_PACK = "kind int, chunk long, n long, code string, numbers binary, ids binary, labels binary, keys binary, upper binary, lower binary"
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class MiningConfig:
    """Each of the first ``positives`` rows of an anchor's label asks for ``negatives`` rows of other labels
    with low * positive_score <= 100 * score <= high * positive_score (whole percent).

    block and cell are the numbers of anchors and of rows that meet in one task at most, tasks the least
    number of cells over the whole grid while a cell keeps 2,048 rows.
    """

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    block: int = 1 << 16
    cell: int = 1 << 20
    tasks: int = 24


def _limits(percent: int, up: bool) -> Column:
    """percent of each positive's score, rounded up or down, without leaving 64 bits."""
    part = f"{percent} * pmod(z.score, 100L)"
    rest = f"(({part} + 99) div 100)" if up else f"({part} div 100)"
    return F.expr(f"transform(positives, z -> {percent} * ((z.score - pmod(z.score, 100L)) div 100) + {rest})")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond 64 bits become the nearest 64-bit number."""
    width = max(a.shape[1], b.shape[1])
    x, y = widened(a, width).astype("f8"), widened(b, width).astype("f8")
    if max(width, 1) * np.abs(x).max(initial=0) * np.abs(y).max(initial=0) < 2.0**53:
        return (x @ y.T).astype(np.int64)
    exact = widened(a, width).astype(object) @ widened(b, width).astype(object).T
    return np.clip(exact, -_MOST, _MOST).astype(np.int64)


def _packs(kind: int):
    """Chunks of rows as one value each, in the narrowest integers that hold their components."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for part in parts:
            for piece in slices(part, "e"):
                e = matrix(piece.column("e"), "i8")
                top = max(int(e.max(initial=0)), -int(e.min(initial=0)) - 1)
                code = next(c for c, bits in (("i2", 15), ("i4", 31), ("i8", 64)) if top < 1 << bits)
                flat = {c: np.asarray(piece.column(c)).astype("i8").tobytes() for c in ("id", "label")}
                anchor = {c: b"" for c in ("keys", "upper", "lower")}
                if kind == 0:
                    anchor["keys"] = np.asarray(piece.column("key")).astype("i8").tobytes()
                    if "upper" in piece.schema.names:
                        anchor["upper"] = matrix(piece.column("upper"), "i8", 1).tobytes()
                        anchor["lower"] = np.asarray(piece.column("lower")).astype("i8").tobytes()
                own = int(piece.column("p")[0].as_py())
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "kind": kind, "chunk": (own << 33) + number, "n": len(e), "code": code, "numbers": e.astype(code).tobytes(),
                            "ids": flat["id"], "labels": flat["label"], **anchor,
                        }
                    ],
                    schema=pa.schema(
                        [("kind", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("code", pa.string())]
                        + [(c, pa.binary()) for c in ("numbers", "ids", "labels", "keys", "upper", "lower")]
                    ),
                )
                number += 1

    return run


def _packed(rows: DataFrame, kind: int) -> DataFrame:
    return rows.withColumn("p", F.spark_partition_id()).mapInArrow(_packs(kind), _PACK)


class _Block:
    """Anchors of one task with the first rows of each of their slots."""

    def __init__(self, keep: int):
        self.keep, self.parts, self.ready = keep, [], False

    def add(self, row: dict) -> None:
        self.parts.append(row)

    def start(self) -> None:
        rows = [(r, np.frombuffer(r["numbers"], r["code"]).reshape(r["n"], -1).astype("i8")) for r in self.parts]
        width = max(e.shape[1] for _, e in rows)
        self.e = np.concatenate([widened(e, width) for _, e in rows])
        self.ids, self.labels, self.keys = (
            np.concatenate([np.frombuffer(r[c], "i8") for r, _ in rows]) for c in ("ids", "labels", "keys")
        )
        self.upper = None
        if rows[0][0]["upper"]:
            most = [np.frombuffer(r["upper"], "i8").reshape(r["n"], -1) for r, _ in rows]
            wide = max(u.shape[1] for u in most)
            self.upper = np.concatenate([np.pad(u, ((0, 0), (0, wide - u.shape[1])), constant_values=_LEAST) for u in most])
            self.lower = np.concatenate([np.frombuffer(r["lower"], "i8") for r, _ in rows])
        self.slots = 1 if self.upper is None else self.upper.shape[1]
        self.scores = np.full((len(self.e) * self.slots, self.keep), _LEAST)
        self.found = np.full((len(self.e) * self.slots, self.keep), _MOST)
        self.held = np.zeros(len(self.e) * self.slots, np.int64)
        self.parts, self.ready = [], True

    def meet(self, row: dict, step: int = 256) -> None:
        if not self.ready:
            self.start()
        e = np.frombuffer(row["numbers"], row["code"]).reshape(row["n"], -1).astype("i8")
        ids, labels = np.frombuffer(row["ids"], "i8"), np.frombuffer(row["labels"], "i8")
        for first in range(0, len(self.e), step):
            own = slice(first, first + step)
            s = _products(self.e[own], e)
            same = self.labels[own, None] == labels
            if self.upper is None:
                ok, slot = same & (self.ids[own, None] != ids), np.zeros(s.shape, np.int64)
            else:
                slot = sum((s <= u[:, None]).astype(np.int64) for u in self.upper[own].T) - 1
                ok = ~same & (slot >= 0) & (s >= self.lower[own, None])
            group = (np.arange(first, first + len(s)) * self.slots)[:, None] + np.maximum(slot, 0)
            full = self.held == self.keep
            worst = np.where(full, self.scores[:, -1], _LEAST)
            ok &= s >= worst[group]
            at = np.nonzero(ok)
            self.merge(group[at], s[at], ids[at[1]])

    def merge(self, groups: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(groups):
            return
        met = np.unique(groups)
        have = np.arange(self.keep) < self.held[met, None]
        groups = np.concatenate([np.repeat(met, self.held[met]), groups])
        scores = np.concatenate([self.scores[met][have], scores])
        ids = np.concatenate([self.found[met][have], ids])
        at, place = first_of_groups(groups, scores, ids, self.keep)
        self.scores[groups[at], place], self.found[groups[at], place] = scores[at], ids[at]
        self.held[met] = np.minimum(np.bincount(np.searchsorted(met, groups), minlength=len(met)), self.keep)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            return
        step = 1 << 14
        for first in range(0, len(self.held), step):
            held = self.held[first : first + step]
            some = np.flatnonzero(held)
            have = np.arange(self.keep) < held[some, None]
            group = some + first
            offsets = pa.array(np.concatenate([[0], np.cumsum(held[some])]), pa.int32())
            yield pa.record_batch(
                {
                    "key": pa.array(self.keys[group // self.slots], pa.int64()),
                    "slot": pa.array((group % self.slots).astype("i4"), pa.int32()),
                    "scores": pa.ListArray.from_arrays(offsets, pa.array(self.scores[group][have])),
                    "ids": pa.ListArray.from_arrays(offsets, pa.array(self.found[group][have])),
                }
            )


def _meeting(keep: int):
    """Reads the places of one task in order: first the anchors of a place, then the chunks of its cell."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block = None, _Block(keep)
        for part in parts:
            for i in range(part.num_rows):
                row = part.slice(i, 1).to_pylist()[0]
                if row["place"] != place:
                    yield from block.rows()
                    place, block = row["place"], _Block(keep)
                if row["kind"] == 0:
                    block.add(row)
                elif block.ready or block.parts:
                    block.meet(row)
        yield from block.rows()

    return run


def _first_rows(anchors: DataFrame, chunks: DataFrame, blocks: int, cells: int, keep: int) -> DataFrame:
    """The first rows of each (anchor, slot) over all cells, as (score, other) in order."""
    dealt = F.xxhash64("chunk")
    here = anchors.withColumn("block", F.pmod(dealt, F.lit(blocks))).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    there = chunks.withColumn("cell", F.pmod(dealt, F.lit(cells))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = here.unionByName(there).withColumn("place", (F.col("block") * cells + F.col("cell")).cast("int")).drop("block", "cell")
    grid = placed.repartitionById(blocks * cells, "place").sortWithinPartitions("place", "kind")
    parts = grid.mapInArrow(_meeting(keep), "key long, slot int, scores array<long>, ids array<long>")
    entries = F.transform(
        F.arrays_zip("scores", "ids"), lambda z: F.struct((-z["scores"]).alias("behind"), z["ids"].alias("other"))
    )
    merged = parts.groupBy("key", "slot").agg(F.slice(F.array_sort(F.flatten(F.collect_list(entries))), 1, keep).alias("top"))
    return merged.select(
        "key", "slot", F.transform("top", lambda z: F.struct((-z["behind"]).alias("score"), z["other"].alias("other"))).alias("top")
    )


def hard_negatives(
    df: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    config: MiningConfig = MiningConfig(),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` marks.

    A component x counts as floor(scale * x), and a score is the exact inner product of those numbers, with ties
    to smaller ids. An anchor's positives are its first rows of the same label and another id, all if there are
    fewer; an anchor without any, and a positive without negatives in its window, return nothing. Rows with a null id,
    label or vector, or with a null, NaN or infinite component take no part. A shorter vector counts as filled with
    zeros, an empty one has score 0 with all. A row that occurs twice counts twice, as anchor too, but rows of an
    anchor's own id are never its positives. Components or scores beyond 64 bits become the nearest 64-bit number.
    An empty table gives no rows; other columns are not read.
    """
    rows = df.select(
        F.col(id).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        F.col(vector).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    rows = rows.withColumn("e", F.transform("v", lambda x: F.floor(F.lit(config.scale) * x.cast("double")))).drop("v")
    anchors = pinned(rows.where("anchor").select(F.monotonically_increasing_id().alias("key"), "id", "label", "e"))
    chunks = pinned(_packed(rows.select("id", "label", "e"), 1))
    n = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-anchors.count() // config.block))
    cells = max(1, -(-n // config.cell), min(-(-config.tasks // blocks), -(-n // 2048)))

    alike = _first_rows(_packed(anchors, 0), chunks, blocks, cells, config.positives)
    limits = alike.select("key", F.col("top").alias("positives"))
    limits = limits.withColumn("upper", _limits(config.high, up=False)).withColumn("lowers", _limits(config.low, up=True))
    wanted = pinned(anchors.join(limits, "key").withColumn("lower", F.array_min("lowers")))
    packed = _packed(wanted.select("key", "id", "label", "e", "upper", "lower"), 0)
    others = _first_rows(packed, chunks, blocks, cells, config.negatives)

    slots = others.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("slot", "top"))).alias("slots"))
    each = wanted.select("key", F.col("id").alias("anchor_id"), F.posexplode(F.arrays_zip("positives", "lowers")).alias("slot", "own"))
    each = each.join(slots, "key").select(
        "anchor_id", F.col("own.positives.other").alias("positive_id"), F.col("own.positives.score").alias("positive_score"),
        F.expr(f"slice(flatten(transform(filter(slots, z -> z.slot >= slot), z -> z.top)), 1, {config.negatives})").alias("first"),
        F.col("own.lowers").alias("least"),
    )
    found = each.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.expr("filter(first, z -> z.score >= least)")).alias("i", "z"))
    return found.select(
        "anchor_id", "positive_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("z.other").alias("negative_id"),
        "positive_score", F.col("z.score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100; each seventh label is moved on by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label=label)


SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
met AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM met WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
),
negatives AS (
    SELECT p.*, m.other AS negative_id, m.score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY m.score DESC, m.other) AS rank
    FROM positives p JOIN met m USING (anchor_id)
    WHERE NOT m.same AND 30 * positive_score <= 100 * m.score AND 100 * m.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
"""
