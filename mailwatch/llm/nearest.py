"""Approximate nearest neighbours by balanced posting lists, as in disk-based inverted indexes.

Inner products become distances by one more component that brings every vector to the same length.
A bounded sample of the distinct vectors is halved again and again along the direction between two
centres, always at the median, so lists have about equal shares of the sample. The centroids are small
enough for every task: rows are assigned, and queries choose lists, by their distances to all of them.
A vector near a border is also filed under further centroids, unless one of those taken already is closer
to the new centroid than the vector is. A query reads all lists whose centroid is at most ``ratio`` times
as far as the nearest one; that ratio is taken from the sample, whose neighbours are known, and there is
no limit on the number of lists.

Equal vectors are one entry of the index with their smallest ids, as ties go to smaller ids, so a vector
that half the rows share costs what any other does. A task holds a block of queries that start from near
lists, with the best rows that each has met so far, and the lists that any of them reads pass by: a zone of
them is cut, within a list if need be, where it would be more than a task should read. So neither vectors
nor answers are multiplied by the number of lists that a query reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import pinned
from .vectors import matrix, slices, usable, widened


@dataclass(frozen=True)
class NearestConfig:
    """n neighbours a query. A list has about ``list_size`` vectors; there are at most ``lists`` of them, and
    the sample that places them has about ``sample`` vectors and ``numbers`` components (all, if there are fewer; never over twice that). ``recall`` is the share of
    a probed sample's true neighbours that the ratio must reach there. A vector is filed under at most ``copies``
    centroids, none farther than ``border`` times the nearest. A task holds at most ``block`` queries (fewer of long vectors),
    and some ``part`` to ``zone`` vectors pass by them, ``part`` at a time at most.
    """

    n: int = 20
    list_size: int = 256
    lists: int = 8192
    sample: int = 32_768
    numbers: int = 1 << 22
    recall: float = 0.98
    probes: int = 256
    copies: int = 4
    border: float = 1.1
    part: int = 8192
    zone: int = 1 << 20
    block: int = 16_384
    seed: int = 7


def _halves(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for the half of the rows that lies towards the second of two centres; where the rows at the cut are near copies, of centres that begin far apart."""
    a, b = x[rng.integers(len(x))], x[rng.integers(len(x))]
    mark, cut = _settled(x, a, b, 6)
    if cut < 0.05:
        mark, _ = _settled(x, a, x[((x - a) ** 2).sum(axis=1).argmax()], 12)
    return mark


def _settled(x: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """The halves after so many rounds, and how far apart the rows on both sides of the cut are, in distances of the centres."""
    for _ in range(rounds):
        order = np.argsort(x @ (b - a), kind="stable")
        mark = np.zeros(len(x), bool)
        mark[order[len(x) // 2 :]] = True
        a, b = x[~mark].mean(axis=0), x[mark].mean(axis=0)
    low, high = x[order[len(x) // 2 - 1]], x[order[len(x) // 2]]
    return mark, float(np.linalg.norm(high - low) / max(np.linalg.norm(b - a), 1e-300))


def balanced_centroids(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Means of about ``lists`` parts of the rows, whose sizes differ by one at most on each level of halving."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < lists and min(map(len, parts)) > 1:
        next_parts = []
        for rows in parts:
            mark = _halves(x[rows], rng)
            next_parts += [rows[~mark], rows[mark]]
        parts = next_parts
    return np.stack([x[rows].mean(axis=0) for rows in parts])


class CentroidGraph:
    """Centroids with the distances of many vectors at once to all of them; ``degree`` and ``seed``, once of its links, change nothing."""

    def __init__(self, centroids: np.ndarray, degree: int = 0, seed: int = 0):
        self.c = centroids.astype("f4")
        self.squares = (self.c.astype("f8") ** 2).sum(axis=1).astype("f4")

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Distance of every row to every centroid: one product of matrices, less work than any walk from centroid to centroid."""
        q = q.astype("f4")
        own = (q.astype("f8") ** 2).sum(axis=1).astype("f4")
        d = q @ self.c.T
        d *= -2
        d += self.squares
        d += own[:, None]
        return np.sqrt(np.maximum(d, 0, out=d), out=d)

    def filed(self, x: np.ndarray, copies: int, border: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list of each row and others near the border."""
        d = self.distances(x)
        tried = min(4 * copies, len(self.c))
        order = np.argpartition(d, tried - 1, axis=1)[:, :tried]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), axis=1, kind="stable"), 1)
        far = np.take_along_axis(d, order, 1)
        taken = np.zeros(order.shape, bool)
        taken[:, 0] = True
        for j in range(1, tried):
            ok = (far[:, j] <= border * far[:, 0]) & (taken.sum(axis=1) < copies)
            for i in range(j):
                apart = np.linalg.norm(self.c[order[:, i]] - self.c[order[:, j]], axis=1)
                ok &= ~(taken[:, i] & (apart < far[:, j]))
            taken[:, j] = ok
        rows, at = np.nonzero(taken)
        return rows, order[rows, at]

    def probed(self, q: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): all lists whose centroid is at most ratio times as far as the nearest one."""
        d = self.distances(q)
        return np.nonzero(d <= ratio * d.min(axis=1, keepdims=True) * (1 + 1e-6))


@dataclass(frozen=True)
class Lists:
    """A fitted index: the graph, the common length of vectors, their width, and the ratio for probes."""

    graph: CentroidGraph
    length: float
    width: int
    ratio: float

    def stored(self, x: np.ndarray) -> np.ndarray:
        """Vectors of the index, in units of the common length, with the component that fills it up."""
        x = widened(x, self.width) / self.length
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1, keepdims=True)))], axis=1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries brought to the common length; that changes no order of inner products."""
        q = widened(q, self.width)
        q = q / np.abs(q).max(axis=1, keepdims=True)
        return np.pad(q / np.linalg.norm(q, axis=1, keepdims=True), ((0, 0), (0, 1)))


def fit(nodes: DataFrame, config: NearestConfig = NearestConfig()) -> Lists | None:
    """Centroids, graph and ratio from a sample of the distinct vectors in ``nodes`` (v); None without any."""
    count, length, width = nodes.agg(
        F.count(F.lit(1)), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.max(F.size("v"))
    ).first()
    if not count:
        return None
    size = max(2, min(config.sample, config.numbers // width))
    share = min(1.0, 1.05 * size / count)
    drawn = nodes.where(F.pmod(F.xxhash64("v", F.lit(config.seed)), F.lit(1 << 40)) < int(share * (1 << 40))).select("v")
    x = matrix(drawn.limit(2 * size).toArrow().column("v"), "f4", width)
    if not len(x):
        x = matrix(nodes.limit(1).toArrow().column("v"), "f4", width)
    x = x[np.lexsort([x[:, i] for i in range(min(width, 8))])]
    lists = Lists(None, float(length), width, 1.0)
    stored = lists.stored(x)
    wanted = max(1, min(config.lists, -(-count // config.list_size), len(x)))
    graph = CentroidGraph(balanced_centroids(stored, wanted, config.seed))
    return Lists(graph, float(length), width, _ratio(x, stored, Lists(graph, float(length), width, 1.0), config))


def _ratio(x: np.ndarray, stored: np.ndarray, lists: Lists, config: NearestConfig) -> float:
    """The least ratio with which some sampled queries meet the wanted share of their neighbours in the sample."""
    if len(x) == 1:
        return 1.0
    rng = np.random.default_rng(config.seed)
    picked = rng.permutation(len(x))[: config.probes]
    n = min(config.n, len(x) - 1)
    best = np.empty((len(picked), n), np.int64)
    for i, own in enumerate(picked):
        scores = x @ x[own]
        scores[own] = -np.inf
        best[i] = np.argpartition(scores, len(x) - n)[len(x) - n :]
    need, back = np.unique(best, return_inverse=True)
    filed = [lists.graph.filed(stored[need[i : i + 512]], config.copies, config.border) for i in range(0, len(need), 512)]
    rows, at = np.concatenate([r + 512 * i for i, (r, _) in enumerate(filed)]), np.concatenate([c for _, c in filed])
    wanted = np.empty(best.shape)
    for i, q in enumerate(lists.asked(x[picked])):
        far = np.linalg.norm(q - lists.graph.c, axis=1)
        nearest = np.full(len(need), np.inf)
        np.minimum.at(nearest, rows, far[at] / max(far.min(), 1e-12))
        wanted[i] = nearest[back.reshape(best.shape)[i]]
    return float(np.quantile(wanted, config.recall, method="higher"))


def _steps(part: pa.RecordBatch, own: Lists) -> Iterator[pa.RecordBatch]:
    return slices(part, "v", max(1, min(1024, (1 << 21) // len(own.graph.c))))


def _filed(lists, config: NearestConfig):
    """Rows of (node, v, first) filed under their lists."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lists.value
        for part in parts:
            for piece in _steps(part, own):
                rows, found = own.graph.filed(own.stored(matrix(piece.column("v"), "f8", own.width)), config.copies, config.border)
                taken = piece.select(["node", "v", "first"]).take(pa.array(rows, pa.int64()))
                yield pa.record_batch([pa.array(found.astype("i4")), *taken.columns], names=["list", *taken.schema.names])

    return run


def _asked(lists):
    """Queries (node, v) with their nearest list, and a bit for each list that they read."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lists.value
        for part in parts:
            for piece in _steps(part, own):
                q = own.asked(matrix(piece.column("v"), "f8", own.width))
                rows, read = own.graph.probed(q, own.ratio)
                marks = np.zeros((len(q), len(own.graph.c)), bool)
                marks[rows, read] = True
                home = own.graph.distances(q).argmin(axis=1).astype("i4")
                yield pa.record_batch(
                    {"node": piece.column("node"), "v": piece.column("v"), "home": pa.array(home), "reads": pa.array([m.tobytes() for m in np.packbits(marks, axis=1)], pa.binary())}
                )

    return run


class Blocks:
    """The block of each query: near homes together, ``size`` queries at most of whole lists; larger lists have blocks of their own."""

    def __init__(self, counts: np.ndarray, size: int):
        self.first, self.shares = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // size))
        block, have = 0, 0
        for k, n in enumerate(counts.tolist()):
            if have and have + n > size:
                block, have = block + 1, 0
            self.first[k], have = block, have + n
            if n > size:
                block, have = block + int(self.shares[k]), 0
        self.number = block + (have > 0)

    def of(self, home: np.ndarray, node: np.ndarray) -> np.ndarray:
        return self.first[home] + node % self.shares[home]


class Zones:
    """Groups of a block and the lists from low to high (a share of a list that is too long), with at most about ``size`` vectors each."""

    def __init__(self, needs: np.ndarray, counts: np.ndarray, size: int):
        self.shares = np.maximum(1, -(-counts // size))
        #: By (block, list): the first group that its rows go to, -1 where no query of the block reads it.
        self.first = np.full(needs.shape, -1, np.int32)
        block_of, low, high = [], [], []
        for b, need in enumerate(needs):
            have = size
            for k in np.flatnonzero(need & (counts > 0)).tolist():
                n, shares = int(counts[k]), int(self.shares[k])
                if have + n > size:
                    block_of += [b] * shares
                    low += [k] * shares
                    high += [k + 1] * shares
                    have = n if shares == 1 else size
                    self.first[b, k] = len(low) - shares
                else:
                    have += n
                    high[-1] = k + 1
                    self.first[b, k] = len(low) - 1
        self.block, self.low, self.high = (np.array(x, np.int64) for x in (block_of, low, high))


def _needs(blocks: Blocks):
    """The lists that any query of a block reads, of one task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for part in parts:
            if not part.num_rows:
                continue
            of, bits = blocks.of(np.asarray(part.column("home")), np.asarray(part.column("node"))), _bits(part)
            for b in np.unique(of).tolist():
                own = np.bitwise_or.reduce(bits[of == b], axis=0)
                found[b] = found[b] | own if b in found else own
        yield pa.record_batch({"block": pa.array(list(found), pa.int32()), "reads": pa.array([x.tobytes() for x in found.values()], pa.binary())})

    return run


def _bits(part: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("reads").to_pylist()), np.uint8).reshape(part.num_rows, -1)


def _queries_sent(blocks: Blocks, zones):
    """Queries for each zone of their block in which they read a list, with the bits from the byte of its first list on."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Zones = zones.value
        for part in parts:
            if not part.num_rows:
                continue
            of, bits = blocks.of(np.asarray(part.column("home")), np.asarray(part.column("node"))), _bits(part)
            for g in np.flatnonzero(np.isin(own.block, of)).tolist():
                a, b = own.low[g] >> 3, (own.high[g] + 7) >> 3
                inside = np.unpackbits(bits[:, a:b], axis=1)[:, own.low[g] - 8 * a : own.high[g] - 8 * a]
                rows = np.flatnonzero((of == own.block[g]) & inside.any(axis=1))
                if len(rows):
                    yield _sent(part, rows, np.full(len(rows), g), 0, np.full(len(rows), -1), [x.tobytes() for x in bits[rows, a:b]])

    return run


def _members_sent(zones):
    """Filed rows for each block that reads their list."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Zones = zones.value
        for part in parts:
            for piece in slices(part, "v"):
                at, node = np.asarray(piece.column("list")), np.asarray(piece.column("node"))
                for first in own.first:
                    rows = np.flatnonzero(first[at] >= 0)
                    if len(rows):
                        group = first[at[rows]] + node[rows] % own.shares[at[rows]]
                        yield _sent(piece, rows, group, 1, at[rows], None, piece.column("first").take(pa.array(rows)))

    return run


_SENT = "group int, kind int, list int, node long, first long, v array<double>, reads binary"


def _sent(part: pa.RecordBatch, rows: np.ndarray, group: np.ndarray, kind: int, at: np.ndarray, reads: list[bytes] | None, first=None) -> pa.RecordBatch:
    taken = part.select(["node", "v"]).take(pa.array(rows, pa.int64()))
    return pa.record_batch(
        {
            "group": pa.array(group.astype("i4")), "kind": pa.array(np.full(len(rows), kind, "i4")), "list": pa.array(at.astype("i4")),
            "node": taken.column("node"), "first": pa.nulls(len(rows), pa.int64()) if first is None else first, "v": taken.column("v"),
            "reads": pa.nulls(len(rows), pa.binary()) if reads is None else pa.array(reads, pa.binary()),
        }
    )


def _answers(zones, width: int, keep: int):
    """The first rows that each query of a group meets in the lists of the zone that it reads; queries come first and are held."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Zones = zones.value
        group, held, top = None, [], None
        for part in parts:
            groups, kinds, at = (np.asarray(part.column(c)) for c in ("group", "kind", "list"))
            cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0) | (np.diff(at) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, part.num_rows]):
                if a == b:
                    continue
                if groups[a] != group:
                    if top:
                        yield top.rows()
                    group, held, top = groups[a], [], None
                run_rows = part.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(run_rows.select(["node", "v", "reads"]))
                elif held or top:
                    top = top or _Top(pa.Table.from_batches(held).combine_chunks().to_batches()[0], int(own.low[group]) >> 3, width, keep)
                    held = []
                    top.meet(int(at[a]), run_rows)
        if top:
            yield top.rows()

    return run


class _Top:
    """The first rows that each of some queries has met: larger scores, then smaller ids."""

    def __init__(self, queries: pa.RecordBatch, first_byte: int, width: int, keep: int):
        self.query, self.q, self.bits = queries.column("node"), matrix(queries.column("v"), "f8", width), _bits(queries)
        self.first_byte, self.keep, n = first_byte, keep, queries.num_rows
        self.norms = np.linalg.norm(self.q, axis=1)
        self.have, self.least = np.zeros(n, np.int64), np.full(n, -np.inf)
        self.scores, self.firsts, self.nodes = np.zeros((n, keep)), np.zeros((n, keep), np.int64), np.zeros((n, keep), np.int64)
        self.found, self.waiting = [], 0

    def meet(self, at: int, members: pa.RecordBatch) -> None:
        asks = np.flatnonzero(self.bits[:, (at >> 3) - self.first_byte] & (128 >> (at & 7)))
        for piece in slices(members, "v", 8192):
            x = matrix(piece.column("v"), "f8", self.q.shape[1])
            first, node = np.asarray(piece.column("first")), np.asarray(piece.column("node"))
            longest, k = np.linalg.norm(x, axis=1).max(), min(self.keep, len(x))
            step = max(1, (1 << 20) // len(x))
            for own in (asks[i : i + step] for i in range(0, len(asks), step)):
                q, least = self.q[own], self.least[own]
                scores = q @ x.T
                many = np.flatnonzero(np.count_nonzero(scores >= least[:, None], axis=1) > k)
                if len(many):
                    least[many] = np.maximum(least[many], np.partition(scores[many], len(x) - k, axis=1)[:, len(x) - k])
                # A product of matrices may round equal sums apart: take a little more, then sum each pair alike.
                rows, met = np.nonzero(scores >= (least - 1e-12 * self.norms[own] * longest)[:, None])
                exact = [(q[rows[i : i + 4096]] * x[met[i : i + 4096]]).sum(axis=1) for i in range(0, len(rows), 4096)]
                if exact:
                    self.found.append((own[rows], np.concatenate(exact), first[met], node[met]))
                    self.waiting += len(rows)
                if self.waiting > self.scores.size:
                    self.merge()

    def merge(self) -> None:
        if not self.found:
            return
        rows, scores, firsts, nodes = (np.concatenate(x) for x in zip(*self.found))
        self.found, self.waiting = [], 0
        touched = np.unique(rows)
        at, place = np.nonzero(np.arange(self.keep) < self.have[touched][:, None])
        at = touched[at]
        rows = np.concatenate([rows, at])
        scores, firsts, nodes = (np.concatenate([x, y[at, place]]) for x, y in ((scores, self.scores), (firsts, self.firsts), (nodes, self.nodes)))
        order = np.lexsort((nodes, firsts, -scores, rows))
        # A vector filed in several lists is met again with the same score, so equal entries stand side by side.
        same = (np.diff(rows[order]) == 0) & (np.diff(nodes[order]) == 0)
        order = order[np.concatenate([[True], ~same])]
        of = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        place = np.arange(len(of)) - np.repeat(starts, np.diff([*starts, len(of)]))
        kept = place < self.keep
        order, of, place = order[kept], of[kept], place[kept]
        self.scores[of, place], self.firsts[of, place], self.nodes[of, place] = scores[order], firsts[order], nodes[order]
        self.have[touched] = np.bincount(of, minlength=len(self.have))[touched]
        full = touched[self.have[touched] == self.keep]
        self.least[full] = self.scores[full, -1]

    def rows(self) -> pa.RecordBatch:
        self.merge()
        at, place = np.nonzero(np.arange(self.keep) < self.have[:, None])
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.have)]), pa.int32())
        lists = {c: pa.ListArray.from_arrays(offsets, pa.array(x[at, place])) for c, x in (("scores", self.scores), ("nodes", self.nodes), ("firsts", self.firsts))}
        return pa.record_batch({"query": self.query, **lists})


def _counts(rows: DataFrame, column: str, lists: Lists) -> np.ndarray:
    """Rows of each list."""
    out = np.zeros(len(lists.graph.c), np.int64)
    for r in rows.groupBy(column).count().collect():
        out[r[0]] = r[1]
    return out


def nearest(
    df: DataFrame, query: Column, id: str = "vec_id", vector: str = "embedding", config: NearestConfig = NearestConfig()
) -> DataFrame:
    """(query_id, rank, id, score): the n rows of largest inner product found for each row that ``query`` marks.

    The score is the sum of products in double precision; ties go to the smaller id. Rows of the query's own id are no
    candidates. Rows with a null id, with a null, empty or zero vector, or with a null, NaN or infinite component take no
    part. A shorter vector counts as filled with zeros. A row that occurs twice counts twice, up to n + 1 times as a
    candidate, and each repeated query row returns its own neighbours. An empty table gives no rows; other columns are
    not read.
    """
    spark, keep = df.sparkSession, config.n + 1
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("w"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable("w"))
    rows = rows.withColumn("v", F.transform("w", lambda x: x.cast("double") + F.lit(0.0))).drop("w")
    rows = rows.where(F.exists("v", lambda x: x != 0))
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.select("v", "id").withColumn("place", first).where(F.col("place") <= keep)
    nodes = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = pinned(nodes.select(F.monotonically_increasing_id().alias("node"), "v", "ids", F.col("ids")[0].alias("first")))
    lists = fit(nodes, config)
    if lists is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)

    asking = pinned(rows.where("asks").select(F.col("id").alias("query_id"), "v").join(nodes.select("v", "node"), "v").select("query_id", "node"))
    queries = nodes.join(asking.select("node").distinct(), "node").select("node", "v")
    sent = spark.sparkContext.broadcast(lists)
    filed = T.StructType([T.StructField("list", T.IntegerType()), *(nodes.schema[c] for c in ("node", "v", "first"))])
    members = pinned(nodes.select("node", "v", "first").mapInArrow(_filed(sent, config), filed))
    asked = pinned(queries.mapInArrow(_asked(sent), "node long, v array<double>, home int, reads binary"))
    blocks = Blocks(_counts(asked, "home", lists), max(1, min(config.block, (1 << 21) // lists.width)))
    needs = np.zeros((blocks.number, len(lists.graph.c)), bool)
    for r in asked.mapInArrow(_needs(blocks), "block int, reads binary").toLocalIterator():
        needs[r["block"]] |= np.unpackbits(np.frombuffer(r["reads"], np.uint8))[: needs.shape[1]].astype(bool)
    counts = _counts(members, "list", lists)
    share = int((needs @ counts).sum()) // (2 * spark.sparkContext.defaultParallelism)
    zones = Zones(needs, counts, max(1, min(config.zone, max(config.part, share))))
    if not len(zones.block):
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    places = spark.sparkContext.broadcast(zones)
    both = asked.mapInArrow(_queries_sent(blocks, places), _SENT).unionByName(members.mapInArrow(_members_sent(places), _SENT))
    met = both.repartitionById(len(zones.block), F.col("group")).sortWithinPartitions("group", "kind", "list")
    answers = met.mapInArrow(_answers(places, lists.width, keep), "query long, scores array<double>, nodes array<long>, firsts array<long>")

    # A vector filed in several zones is met again with the same score, so equal entries stand side by side.
    entries = F.transform(
        F.arrays_zip("scores", "firsts", "nodes"),
        lambda z: F.struct((-z["scores"]).alias("behind"), z["firsts"].alias("first"), z["nodes"].alias("node")),
    )
    enough = F.slice(F.array_sort(F.flatten(F.collect_list(entries))), 1, keep * config.copies)
    best = answers.groupBy("query").agg(enough.alias("top")).select("query", F.slice(F.array_distinct("top"), 1, keep).alias("top"))
    each = best.select("query", F.explode("top").alias("z")).select("query", "z.behind", F.col("z.node").alias("node"))
    each = each.join(nodes.select("node", "ids"), "node")
    named = F.transform("ids", lambda i: F.struct(F.col("behind"), i.alias("id")))
    around = each.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list(named))).alias("around"))
    own = F.slice(F.filter("around", lambda z: z["id"] != F.col("query_id")), 1, config.n)
    out = asking.join(around, asking["node"] == around["query"]).select("query_id", F.posexplode(own).alias("i", "z"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("z.id").alias("id"), (-F.col("z.behind")).alias("score"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every row whose vec_id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, F.col("vec_id") % 20 == 0).withColumnRenamed("id", "vec_id")
