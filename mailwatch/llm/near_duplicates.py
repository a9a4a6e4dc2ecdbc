"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian comparison, exact check.

Documents with equal shingle sets are one class from the start. Classes that share a bucket in some
band are candidates; within a bucket all are first compared with its smallest member only. What that
leaves in different components is compared inside the buckets, where pairs already connected need no
look. A comparison reads the signatures batch by batch and stops once the posterior probability that
the pair is similar enough falls below the chosen miss probability; survivors are checked on their
full shingle sets. So a group of n copies costs no n² rows, and no link is dropped by size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_batches import few_rows, small
from .components import components
from .hashing import BLANKS, batches, mix, shingle_hashes, stream, word_hashes
from .scratch import pinned


@dataclass(frozen=True)
class NearConfig:
    """similar: links need 100 * intersection >= similar * union, in whole percent.

    bands x rows decide what becomes a candidate: at 85 % similarity a pair shares no bucket with a
    chance of 4e-7. lanes is the signature length of the comparison, read in steps of batch, and miss
    the posterior probability below which a comparison ends. block is about the number of bucket
    members that meet in one task; larger buckets are cut into pairs of blocks. Up to sent ids of
    documents that share a bucket are broadcast.
    """

    shingle: int = 5
    similar: int = 85
    bands: int = 25
    rows: int = 5
    lanes: int = 1024
    batch: int = 64
    miss: float = 1e-6
    block: int = 1024
    sent: int = 500_000


def _minima(shingles: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n min-wise hash values (uint32) of one set."""
    a = (stream(seed, n) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (stream(seed + 1, n) >> np.uint64(32)).astype(np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 4096):
            out = np.minimum(out, (a[:, None] * x[None, i : i + 4096] + b[:, None]).min(axis=1))
    return out


def _sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for start, end in batches(texts):
        hashes, edges = shingle_hashes(*word_hashes(texts[start:end], BLANKS), size)
        for i in range(end - start):
            yield np.unique(hashes[edges[i] : edges[i + 1]])


def _sums(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell equal sets, as two signed numbers."""
    with np.errstate(over="ignore"):
        two = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(s.sum(dtype=np.uint64).astype(np.int64)), int(two.astype(np.int64))


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _summaries(config: NearConfig):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = stream(41, config.rows)
        salts = stream(43, config.bands)
        for part in small(parts, "text"):
            sizes, ones, twos, bands = [], [], [], []
            for s in _sets(_bytes(part.column("text")), config.shingle):
                sizes.append(len(s))
                one, two = _sums(s)
                ones.append(one)
                twos.append(two)
                if not len(s):
                    bands.append(None)
                    continue
                low = _minima(s, config.bands * config.rows, 51).reshape(config.bands, config.rows)
                with np.errstate(over="ignore"):
                    bands.append(mix((low.astype(np.uint64) * weights).sum(axis=1) + salts).astype(np.int64))
            yield pa.record_batch(
                {
                    "id": part.column("id"), "n": pa.array(sizes, pa.int64()), "one": pa.array(ones, pa.int64()),
                    "two": pa.array(twos, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())),
                }
            )

    return run


def _details(config: NearConfig):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(parts, "text"):
            found = list(_sets(_bytes(part.column("text")), config.shingle))
            ones, twos = zip(*map(_sums, found)) if found else ((), ())
            lanes = [_minima(s, config.lanes, 61).astype(np.uint8).tobytes() for s in found]
            yield pa.record_batch(
                {
                    "id": part.column("id"), "one": pa.array(ones, pa.int64()), "two": pa.array(twos, pa.int64()),
                    "lanes": pa.array(lanes, pa.binary()),
                    "shingles": pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64())),
                }
            )

    return run


@cache
def least_matches(similar: int, lanes: int, batch: int, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest equal lanes with which a pair may still be similar enough.

    Lanes hold one byte, so lanes of different values agree by chance once in 256. With a uniform
    prior on the agreement, its posterior is a beta distribution, integrated here on a fine grid.
    """
    level = similar / 100 + (1 - similar / 100) / 256
    grid = (np.arange(200_000) + 0.5) / 200_000
    upper = grid >= level
    logs, rest = np.log(grid), np.log1p(-grid)
    out = []
    for n in range(batch, lanes + 1, batch):
        low, high = 0, n
        while low < high:
            m = (low + high) // 2
            weight = m * logs + (n - m) * rest
            weight = np.exp(weight - weight.max())
            low, high = (low, m) if weight[upper].sum() >= miss * weight.sum() else (m + 1, high)
        out.append(low)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, config: NearConfig) -> np.ndarray:
    """Indexes of the rows of a and b (same shape, one byte a lane) that pass every batch."""
    left = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(config.similar, config.lanes, config.batch, config.miss)):
        cut = slice(k * config.batch, (k + 1) * config.batch)
        equal = equal + (a[left, cut] == b[left, cut]).sum(axis=1, dtype=np.int32)
        keep = equal >= least
        left, equal = left[keep], equal[keep]
        if not len(left):
            break
    return left


def _lanes(column: pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, lanes)


def _compare(config: NearConfig):
    """Keeps the pairs of rows whose signatures survive."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                keep = survivors(
                    _lanes(part.column("lanes_a"), config.lanes), _lanes(part.column("lanes_b"), config.lanes), config
                )
                yield part.select(["a", "b"]).take(pa.array(keep))

    return run


def _within(config: NearConfig):
    """Surviving pairs of one bucket (or pair of its blocks) between different components, each from one bucket only."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("node").to_numpy()
        n = table.column("n").to_numpy()
        comp = table.column("component").to_numpy()
        side = table.column("block").to_numpy()
        band = int(table.column("band")[0].as_py())
        first, second = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
        lanes = np.frombuffer(b"".join(table.column("lanes").to_pylist()), np.uint8).reshape(-1, config.lanes)
        bands = np.asarray(table.column("bands").to_pylist(), np.int64).reshape(len(ids), config.bands)
        names, sizes = np.unique(comp, return_counts=True)
        main = names[sizes.argmax()]
        left, right = [], []
        rows = np.flatnonzero(side == first)
        others = np.flatnonzero(side == second)
        for x in np.flatnonzero(comp != main):
            # A pair of two small components is met from both sides and kept from the smaller id.
            if side[x] == first and first != second:
                rivals = others
            elif side[x] == second and first != second:
                rivals = rows
            else:
                rivals = others
            ok = (comp[rivals] != comp[x]) & ((comp[rivals] == main) | (ids[rivals] > ids[x]))
            ok &= 100 * np.minimum(n[rivals], n[x]) >= config.similar * np.maximum(n[rivals], n[x])
            rivals = rivals[ok]
            if band:
                rivals = rivals[~(bands[rivals, :band] == bands[x, :band]).any(axis=1)]
            if not len(rivals):
                continue
            found = rivals[survivors(np.broadcast_to(lanes[x], (len(rivals), config.lanes)), lanes[rivals], config)]
            left.append(np.minimum(ids[found], ids[x]))
            right.append(np.maximum(ids[found], ids[x]))
        none = [np.empty(0, np.int64)]
        return pa.table({"a": np.concatenate(left or none), "b": np.concatenate(right or none)})

    return run


def _links(pairs: DataFrame, details: DataFrame, config: NearConfig) -> DataFrame:
    """The pairs (a, b) that are similar enough, checked on the full sets."""
    a = details.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = details.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return pairs.join(b, "b").join(a, "a").where(100 * both >= config.similar * either).select("a", "b")


def _detailed(texts: DataFrame, active: DataFrame, config: NearConfig) -> DataFrame:
    """Signature lanes and full sets of the classes that share a bucket, from the text of their smallest id."""
    ids = active.select(F.col("rep").alias("id")).distinct()
    # Up to this many ids (8 MB) are sent to all tasks, so that texts stay in place; more are joined by a shuffle.
    if ids.count() <= config.sent:
        ids = F.broadcast(ids)
    rows = texts.join(ids, "id", "left_semi").mapInArrow(
        _details(config), "id long, one long, two long, lanes binary, shingles array<long>"
    )
    keys = active.select("node", F.col("rep").alias("id"), "n", "one", "two", "bands")
    return rows.join(keys, ["id", "one", "two"]).select("node", "n", "bands", "lanes", "shingles").dropDuplicates(["node"])


def _labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds the component of each node; a node without links is its own."""
    groups = groups.select(F.col("node").alias("_node"), "component")
    return rows.join(groups, F.col("node") == F.col("_node"), "left").select(
        *rows.columns, F.coalesce("component", "node").alias("component")
    )


def near_duplicates(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", config: NearConfig = NearConfig()
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Ids are whole numbers. Documents are linked when their sets of distinct shingles (words of
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; the whole sequence when there are fewer words) are
    similar enough; component_id is the smallest id reachable and kept tells whether the row is that one.
    A text that is null, empty or blank has no shingles and is linked with nothing. Rows that share an
    id share a component only if their texts are linked; a row without an id is kept, linked with
    nothing and has no component. Other columns are ignored.
    """
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    summary = pinned(texts.mapInArrow(_summaries(config), "id long, n long, one long, two long, bands array<long>"))
    full = summary.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = full.groupBy("n", "one", "two").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"))
    classes = pinned(classes.withColumn("node", F.monotonically_increasing_id()))

    buckets = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("band", "bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    shared = shared.where(F.col("first") < F.col("last")).select("band", "bucket", "first")
    members = pinned(buckets.join(shared, ["band", "bucket"]).select("node", "band", "bucket", "first"))
    details = pinned(_detailed(texts, classes.join(members.select("node").distinct(), "node"), config))
    lanes = details.select("node", "lanes")

    stars = members.where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    met = (
        stars.distinct()
        .join(lanes.select(F.col("node").alias("b"), F.col("lanes").alias("lanes_b")), "b")
        .join(lanes.select(F.col("node").alias("a"), F.col("lanes").alias("lanes_a")), "a")
    )
    links = pinned(_links(met.mapInArrow(_compare(config), "a long, b long"), details, config))

    # Buckets whose members are still in different components.
    labelled = pinned(_labelled(members.select("node", "band", "bucket"), components(links, "a", "b")))
    unsettled = labelled.groupBy("band", "bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")
    )
    unsettled = unsettled.where(F.col("low") < F.col("high")).select(
        "band", "bucket", F.ceil(F.col("size") / config.block).cast("int").alias("blocks")
    )
    placed = labelled.join(unsettled, ["band", "bucket"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    # A member meets its own block and every other one, in the task of the pair (i <= j).
    spread = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns(
        {"i": F.least("block", "other"), "j": F.greatest("block", "other")}
    )
    tasks = spread.join(details.select("node", "n", "bands", "lanes"), "node").select(
        "node", "n", "component", "block", "band", "bucket", "i", "j", "lanes", "bands"
    )
    more = tasks.groupBy("band", "bucket", "i", "j").applyInArrow(_within(config), "a long, b long").distinct()
    late = pinned(_links(more, details, config))

    by_class = _labelled(classes.select("node", "n", "one", "two", "rep"), components(links.unionByName(late), "a", "b"))
    roots = by_class.groupBy("component").agg(F.min("rep").alias("root"))
    by_class = by_class.join(roots, "component").select("n", "one", "two", "root")
    found = summary.join(by_class, ["n", "one", "two"], "left").select(
        "id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("root")).otherwise(F.col("id")).alias("root")
    )
    return found.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"),
        F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"),
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
),
link AS (
  SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT reach.doc_id, edge.y FROM reach JOIN edge ON reach.root = edge.x
),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)"""
