"""Hard negatives against SQL and against brute force, with nulls, ties, repeats, hot rows and clashing names."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mailwatch.llm.hard_negatives import MiningConfig, _limits, hard_negatives
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, key long, place int, kind string, n string, e string, slot int, top int"


def table(spark, rows):
    """Rows with an extra column for names that the operator uses inside."""
    return spark.createDataFrame([(*r, 1, 1, "x", "x", "x", 1, 1) for r in rows], SCHEMA).repartition(3)


def brute(rows, anchor, config=MiningConfig()):
    good = [
        (i, [math.floor(config.scale * x) for x in v], c) for i, v, c in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, v, c in good:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in good if j != i)
        for p, j, _ in [s for s in scored if s[2] == c][: config.positives]:
            window = [s for s in scored if s[2] != c and config.low * -p <= 100 * -s[0] <= config.high * -p]
            out += [(i, j, k + 1, s[1], -p, -s[0]) for k, s in enumerate(window[: config.negatives])]
    return sorted(out)


def got(df, config=MiningConfig(), step=4):
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % step == 0, config=config).collect())


def test_same_as_sql(spark):
    rows = entry.queries()["op11_hard_negatives"](spark, SF).toPandas()
    assert len(rows) and compare(rows, connect(SF).execute(entry.oracle_sql()["op11_hard_negatives"]).fetchdf()) is None


def vectors(n, seed=3):
    import random

    draw = random.Random(seed)
    return [(i, [round(draw.uniform(-1, 2), 2) for _ in range(4)], draw.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("config", [MiningConfig(), MiningConfig(block=7, cell=20, tasks=6), MiningConfig(positives=3, negatives=2, low=50, high=70, cell=9)])
def test_brute_force(spark, config):
    rows = vectors(160)
    rows += [(160, None, 1), (164, [0.5, None, 1.0, 1.0], 1), (168, [float("nan")] * 4, 1), (172, [float("inf"), 0.0, 0.0, 0.0], 2),
             (176, [1.0] * 4, None), (None, [1.0] * 4, 1), (180, [], 1), (184, [1.5], 2), (-4, [0.7, 0.7, 0.7, 0.7], 0), (188, [0.0] * 4, 0)]
    assert got(table(spark, rows), config) == brute(rows, lambda i: i % 4 == 0, config)


def test_repeats_and_ties(spark):
    same = [(i, [0.25, 0.5, 0.75, 1.0], 0) for i in range(60)] + [(i, [0.25, 0.25, 0.5, 0.75], 1) for i in range(60, 200)]
    rows = same + [(201, [1.0, 1.0, 1.0, 1.0], 0), (201, [1.0, 1.0, 1.0, 1.0], 0), (200, [0.5] * 4, 1), (200, [0.5] * 4, 1)]
    config = MiningConfig(block=16, cell=32, tasks=8)
    assert got(table(spark, rows), config) == brute(rows, lambda i: i % 4 == 0, config)


def test_one_label_has_all_rows(spark):
    rows = [(i, v, 0) for i, v, _ in vectors(40)]
    assert got(table(spark, rows)) == []
    assert got(table(spark, [(4, [1.0], 0)])) == [] and got(table(spark, [])) == []


def test_large_components(spark):
    rows = [(0, [3e6, 1.0], 0), (1, [3e6, 2.0], 0), (2, [2e6, 1.0], 1), (3, [2e6, 3.0], 1), (5, [1e30, 0.0], 2)]
    df = spark.createDataFrame([(*r, 1, 1, "x", "x", "x", 1, 1) for r in rows], SCHEMA.replace("array<float>", "array<double>"))
    assert got(df) == brute(rows, lambda i: i % 4 == 0) != []  # exact beyond 2^53; the last row's score stops at 2^63 - 1


def test_limits_stay_in_range(spark):
    scores = [0, 1, -1, 99, 100, 101, -101, 2**62, -(2**62), 2**63 - 1]
    df = spark.createDataFrame([([(s,) for s in scores],)], "positives array<struct<score: long>>")
    row = df.select(_limits(90, up=False).alias("u"), _limits(30, up=True).alias("l")).first()
    assert row["u"] == [90 * s // 100 for s in scores] and row["l"] == [-(-30 * s // 100) for s in scores]
