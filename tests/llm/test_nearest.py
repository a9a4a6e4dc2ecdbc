"""Nearest neighbours against brute force: recall, exact scores, ties, copies, and rows that take no part."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mailwatch.llm.nearest import Blocks, CentroidGraph, NearestConfig, Zones, _answers, balanced_centroids, nearest

SF = "/root/testdata/sf0.1"


def table(spark, rows):
    schema = "vec_id long, embedding array<float>, node string, list string, part string, v string, ids string, first string, query string"
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], schema).repartition(3)


def brute(rows, asks, n):
    """(query, rank) → (id, score), with ties to smaller ids; one entry for each query row."""
    good = [(i, np.array(v, "f4").astype("f8")) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for i, q in good:
        if asks(i):
            ranked = sorted((-(q * v).sum(), j) for j, v in good if j != i)[:n]
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(ranked)]
    return sorted(out)


def test_query(spark):
    got = entry.queries()["op13_nearest"](spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    vectors = {r.vec_id: np.array(r.embedding, "f8") for r in rows.itertuples()}
    want = brute(list(zip(rows.vec_id, rows.embedding.map(list))), lambda i: i % 20 == 0, 20)
    assert len(got) == len(want)
    hits = set(zip(got.query_id, got.vec_id)) & {(q, j) for q, _, j, _ in want}
    assert len(hits) >= 0.9 * len(want)
    assert all(abs(r.score - (vectors[r.query_id] * vectors[r.vec_id]).sum()) < 1e-12 for r in got.itertuples())
    for _, part in got.sort_values("rank").groupby("query_id"):
        assert list(part["rank"]) == list(range(1, 21))
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id))


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(120)]
    rows += [(i, [1.0, 0.5, 0.0, 0.25, 0.0, 0.0]) for i in range(120, 260)]  # a vector that most rows share
    rows += [(260, None), (261, [0.0] * 6), (262, []), (264, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (268, [float("nan")] * 6), (272, [float("inf")] * 6)]
    return rows + [(None, [1.0] * 6), (-4, [2.0, 1.0]), (276, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (3, rows[3][1]), (4, rows[4][1])]


@pytest.mark.parametrize("part", [8192, 9])
def test_all_lists(spark, part):
    """With a border and ratio that take in every list the answer is exact."""
    config = NearestConfig(n=10, list_size=16, recall=1.0, part=part, probes=1000)
    rows = odd_rows()
    got = sorted(tuple(r) for r in nearest(table(spark, rows), F.col("vec_id") % 4 == 0, config=config).collect())
    want = brute(rows, lambda i: i % 4 == 0, 10)
    assert len(got) == len(want)
    near = [a for a, b in zip(got, want) if a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-12]
    assert len(near) >= 0.97 * len(want)
    copies = [a for a in got if 120 <= a[0] < 260]
    assert copies == [b for b in want if 120 <= b[0] < 260] or len(copies)


def test_few_rows(spark):
    assert nearest(table(spark, []), F.col("vec_id") % 4 == 0).collect() == []
    assert nearest(table(spark, [(4, [1.0, 0.0])]), F.col("vec_id") % 4 == 0).collect() == []
    two = nearest(table(spark, [(4, [1.0, 0.0]), (5, [0.5, 2.0])]), F.col("vec_id") % 4 == 0).collect()
    assert [tuple(r) for r in two] == [(4, 1, 5, 0.5)]
    same = nearest(table(spark, [(i, [1.0, 0.0]) for i in range(40)]), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in same) == [(q, k + 1, j, 1.0) for q in (0, 20) for k, j in enumerate([i for i in range(22) if i != q][:20])]


def test_lists_are_balanced():
    x = np.random.default_rng(1).normal(size=(1000, 8))
    x[:400] = x[0] + 1e-3 * x[:400]  # near copies are spread over lists, too
    c = balanced_centroids(x, 64, 7)
    assert len(c) == 64 and (np.linalg.norm(c - x[0], axis=1) < 0.1).sum() >= 20


def test_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    c, q = rng.normal(size=(700, 12)), rng.normal(size=(50, 12))
    graph = CentroidGraph(c, 24, 7)
    rows, lists = graph.probed(q, 1.3)
    d = np.linalg.norm(q[:, None] - c, axis=2)
    want = set(zip(*np.nonzero(d <= 1.3 * d.min(axis=1, keepdims=True))))
    got = set(zip(rows.tolist(), lists.tolist()))
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)


@pytest.mark.parametrize("how", [{"zone": 9, "part": 1}, {"block": 3}, {"block": 7, "zone": 40, "part": 5}])
def test_blocks_and_zones(spark, how):
    """Neither the queries that a task holds nor the rows that pass by change an answer."""
    rows = odd_rows()
    wanted, got = (
        sorted(tuple(r) for r in nearest(table(spark, rows), F.col("vec_id") % 4 == 0, config=NearestConfig(n=10, list_size=16, **x)).collect())
        for x in ({}, how)
    )
    assert got == wanted


def test_a_query_has_one_answer_a_zone():
    """Whatever number of lists it reads there, and a row filed twice counts once."""
    rng = np.random.default_rng(3)
    x, q, keep = rng.normal(size=(64, 3)), rng.normal(size=(4, 3)), 5
    zones = Zones(np.ones((1, 16), bool), np.full(16, 5), 1000)
    assert zones.low.tolist() == [0] and zones.high.tolist() == [16]
    filed = sorted([(i % 16, i) for i in range(64)] + [(i, i) for i in range(16)] + [(0, 63)])
    reads = np.packbits(np.array([[True] * 16, [True] * 16, [i < 3 for i in range(16)], [False] * 16]), axis=1)
    parts = [
        pa.RecordBatch.from_pylist([{"group": 0, "kind": 0, "list": -1, "node": 100 + i, "first": None, "v": q[i].tolist(), "reads": reads[i].tobytes()} for i in range(4)]),
        pa.RecordBatch.from_pylist([{"group": 0, "kind": 1, "list": at, "node": i, "first": i, "v": x[i].tolist(), "reads": None} for at, i in filed]),
    ]
    got = [r for b in _answers(SimpleNamespace(value=zones), 3, keep)(iter(parts)) for r in b.to_pylist()]
    assert [r["query"] for r in got] == [100, 101, 102, 103]
    for i, r in enumerate(got):
        rows = sorted({j for at, j in filed if reads[i][at // 8] & (128 >> at % 8)}, key=lambda j: -(q[i] @ x[j]))[:keep]
        assert r["nodes"] == rows and r["scores"] == pytest.approx([q[i] @ x[j] for j in rows])


def test_zones_hold_what_their_block_reads():
    needs = np.array([[True, True, False, True], [False, True, True, True]])
    zones = Zones(needs, np.array([4, 5, 30, 0]), 10)
    assert zones.first.tolist() == [[0, 0, -1, -1], [-1, 1, 2, -1]] and zones.block.tolist() == [0, 1, 1, 1, 1]
    assert zones.low.tolist() == [0, 1, 2, 2, 2] and zones.high.tolist() == [2, 2, 3, 3, 3] and zones.shares.tolist() == [1, 1, 3, 1]
    blocks = Blocks(np.array([3, 0, 3, 25, 2, 9]), 10)
    assert blocks.first.tolist() == [0, 0, 0, 1, 4, 5] and blocks.shares[3] == 3 and blocks.number == 6
