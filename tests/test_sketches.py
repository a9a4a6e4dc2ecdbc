"""Quantile sketches, exact small-sample p-values, and plans that read their source once."""

import itertools
import random
import re

import pytest

from mailwatch.functions.divergence import lattice_pvalue
from mailwatch.operators import distribution, ordered, sketches
from mailwatch.operators import drift as D


@pytest.mark.parametrize("n,m", [(2, 2), (3, 5), (4, 4), (5, 3), (1, 6)])
def test_exact_pvalue_counts_all_merges(n, m):
    reached = []
    for places in itertools.combinations(range(n + m), n):
        i = j = top = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in places else (i, j + 1)
            top = max(top, abs(i * m - j * n))
        reached.append(top)
    for h in sorted({*reached, 0, n * m + 1}):
        assert lattice_pvalue(h, n, m) == pytest.approx(sum(r >= h for r in reached) / len(reached), abs=1e-12)


def test_known_pvalues(spark, long):
    """Two samples of four without overlap reach 1 in 2 of 70 merges; large ones use the limit distribution."""
    pair = long(apart=[1, 2, 3, 4], near=[1, 3, 5, 7]), long(apart=[5, 6, 7, 8], near=[2, 4, 6, 8])
    got = {r["feature"]: r for r in D.ks_two_sample(*pair).collect()}
    assert got["apart"]["ks_pvalue"] == pytest.approx(2 / 70) and got["near"]["ks_pvalue"] == pytest.approx(1.0)
    assert {r["ks_method"] for r in got.values()} == {"exact"}
    assert lattice_pvalue(100 * 100, 100, 100) == pytest.approx(2.2087606931995e-59, rel=1e-9)  # 2 / C(200, 100)
    draw = random.Random(2)
    a, b = ([draw.gauss(0, 1) for _ in range(300)] for _ in range(2))
    exact, limit = (D.ks_two_sample(long(f=a), long(f=b), exact=e).first() for e in (300, 299))
    assert (exact["ks_method"], limit["ks_method"]) == ("exact", "asymptotic")
    assert exact["ks_statistic"] == limit["ks_statistic"] and exact["ks_pvalue"] == pytest.approx(limit["ks_pvalue"], abs=0.05)


def scans(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    return len(re.findall("Scan parquet", plan))


def test_source_is_read_once_and_nothing_runs_early(spark, tmp_path):
    draw = random.Random(1)
    rows = [(f, draw.choice([None, float(draw.randrange(400))])) for f in "abc" for _ in range(3000)]
    spark.createDataFrame(rows, "feature string, value double").repartition(3).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    context = spark.sparkContext
    context.setJobGroup("planning", "planning")
    queries = [ordered.ecdf(source), distribution.feature_statistics(source), distribution.feature_statistics(source, approximate=True)]
    pair = source.where("value < 300"), source.where("value >= 100 or value is null")
    queries += [D.ks_two_sample(*pair), D.wasserstein(*pair), D.table_drift(*pair)]
    assert not context.statusTracker().getJobIdsForGroup("planning")
    context.setJobGroup("running", "running")
    assert [scans(q) for q in queries] == [1, 2, 1, 2, 2, 4]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_running_totals_of_any_ranges(spark, ranges):
    draw = random.Random(ranges)
    rows = [(f, float(v), draw.randrange(4)) for f in ("a", "b") for v in draw.sample(range(5000), 1200)] + [("c", 1.5, 2), ("d", 0.0, 0)]
    df = spark.createDataFrame(rows, "feature string, value double, n int").repartition(4)
    got = {(r["feature"], r["value"]): r for r in ordered.running_totals(df, ["feature"], "value", ["n"], ranges).collect()}
    for f in "abcd":
        before, own = 0, sorted((v, n) for g, v, n in rows if g == f)
        for k, (v, n) in enumerate(own):
            r = got.pop((f, v))
            assert (r["before_n"], r["total_n"]) == (before, sum(n for _, n in own))
            assert r["next_value"] == (own[k + 1][0] if k + 1 < len(own) else None)
            before += n
    assert not got


def test_cut_points_do_not_depend_on_the_order_of_rows(spark):
    rows = [("f", float(i), 1) for i in range(20_000)]
    cuts = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "feature string, value double, n int").repartition(parts)
        cuts.append(ordered._cut_points(df, ["feature"], "value", ["n"], 10).first()["_cuts"])
    assert cuts[0] == cuts[1] and 6 <= len(cuts[0]) <= 14
    widths = [b - a for a, b in zip([0, *cuts[0]], [*cuts[0], 20_000])]
    assert max(widths) < 3 * 20_000 / 10


def test_sketches_merge_and_come_back_from_storage(spark, tmp_path):
    rows = [(d, f, float((i * 7919) % 5000) + 100 * d) for d in range(4) for f in ("a", "b") for i in range(3000)]
    rows += [(9, "a", None), (9, "none", None), (9, "b", float("nan"))]
    long = spark.createDataFrame(rows, "day int, feature string, value double")
    sketches.sketch_table(long, ["day", "feature"]).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 8
    whole = {r["feature"]: r for r in sketches.sketch_quantiles(sketches.merged(stored), {"lo": 0, "q25": 0.25, "mid": 0.5, "q99": 0.99, "hi": 1}).collect()}
    for f in ("a", "b"):
        values = sorted(v for d, g, v in rows if g == f and v is not None and v == v)
        r = whole[f]
        assert (r["n"], r["lo"], r["hi"]) == (len(values), values[0], values[-1])
        for name, q in (("q25", 0.25), ("mid", 0.5), ("q99", 0.99)):
            assert abs(sum(v <= r[name] for v in values) / len(values) - q) < 0.01
    stats = {r["feature"]: r for r in distribution.feature_statistics(long, approximate=True).collect()}
    assert stats["none"]["sketch"] is None and stats["none"]["median"] == 0.0 and stats["a"]["sketch"] is not None


def test_distances_of_sketches(spark, long):
    draw = random.Random(5)
    a, b = [draw.gauss(0, 1) for _ in range(4000)], [draw.gauss(0.5, 1) for _ in range(3000)]
    pair = long(shift=a, same=a, flat=[1.0] * 50), long(shift=b, same=a, flat=[1.0] * 70, other=[1.0])
    near = {r["feature"]: r for r in sketches.sketch_distances(*[sketches.sketch_table(side) for side in pair]).collect()}
    ks = {r["feature"]: r["ks_statistic"] for r in D.ks_two_sample(*pair).collect()}
    area = {r["feature"]: r["wasserstein"] for r in D.wasserstein(*pair).collect()}
    assert set(near) == {"shift", "same", "flat"}
    for f, r in near.items():
        assert r["ks_statistic"] == pytest.approx(ks[f], abs=0.01) and r["wasserstein"] == pytest.approx(area[f], abs=0.02)
