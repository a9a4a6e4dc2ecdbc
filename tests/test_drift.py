import math
import random

import pytest
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import functions as F

from mailwatch.config import DriftConfig
from mailwatch.functions.divergence import kolmogorov_pvalue
from mailwatch.operators import drift as D
from mailwatch.operators import ordered
from mailwatch.operators.distribution import feature_statistics, histogram, prediction_distribution

rng = random.Random(3)


def normal(mean, std, n=1500):
    return [rng.gauss(mean, std) for _ in range(n)]


def by_feature(df, column):
    return {r["feature"]: r[column] for r in df.collect()}


@pytest.fixture(scope="module")
def pair(long):
    base = normal(100, 15)
    b = long(same=base, slight=base, big=base, wide=base)
    c = long(same=list(base), slight=normal(105, 15), big=normal(130, 15), wide=normal(100, 30))
    return b, c


def test_psi_bands(pair):
    psi = by_feature(D.psi_samples(*pair), "psi")
    assert psi["same"] == pytest.approx(0.0, abs=1e-12)
    assert 0.01 < psi["slight"] < 0.5 and psi["big"] > 0.5 and psi["wide"] > 0.2
    assert min(psi.values()) >= 0


def test_psi_edges(long):
    b = long(flat=[5, 5, 5], lonely=[1, 2], nan=[1, float("nan"), 3, 2])
    c = long(flat=[5, 5], lonely=[None], nan=[1, 2, 3, float("nan")])
    psi = by_feature(D.psi_samples(b, c), "psi")
    assert psi["flat"] == 0.0 and psi["lonely"] == 0.0
    assert psi["nan"] == pytest.approx(0.0, abs=1e-12)


def bins_table(spark, base, cur, feature="f"):
    rows = [(feature, i, b, c) for i, (b, c) in enumerate(zip(base, cur))]
    return spark.createDataFrame(rows, "feature string, bin int, p_base double, p_cur double")


P, Q = [0.1, 0.2, 0.4, 0.2, 0.1], [0.05, 0.15, 0.5, 0.2, 0.1]


def test_psi_and_jsd_from_proportions(spark):
    t = bins_table(spark, P, Q)
    expected = sum((c - b) * math.log(c / b) for b, c in zip(P, Q))
    assert D.psi_proportions(t).first()["psi"] == pytest.approx(expected, abs=1e-9)
    forward, back = (D.jensen_shannon(bins_table(spark, x, y)).first()["jsd"] for x, y in ((P, Q), (Q, P)))
    assert forward == pytest.approx(back) and 0 < forward < math.log(2)
    apart = D.jensen_shannon(bins_table(spark, [1.0, 0.0], [0.0, 1.0])).first()["jsd"]
    assert apart == pytest.approx(math.log(2), abs=1e-3)
    uneven = spark.createDataFrame([("f", 0, 0.5, 0.5), ("f", 1, 0.5, None)], "feature string, bin int, p_base double, p_cur double")
    assert D.psi_proportions(uneven).first()["psi"] == 0.0


def test_ks(pair, long, spark):
    ks = {r["feature"]: r for r in D.ks_two_sample(*pair).collect()}
    assert ks["same"]["ks_statistic"] == 0.0 and ks["same"]["ks_pvalue"] == 1.0
    assert ks["big"]["ks_pvalue"] < 1e-6 and 0 <= ks["big"]["ks_statistic"] <= 1
    tiny = D.ks_two_sample(long(f=[1]), long(f=[2, 3])).first()
    assert (tiny["ks_statistic"], tiny["ks_pvalue"]) == (0.0, 1.0)
    p = spark.range(1).select(kolmogorov_pvalue(F.lit(0.0136), F.lit(10000)).alias("p")).first()["p"]
    assert p == pytest.approx(0.0495, abs=2e-4)


def test_ks_normal_matches_spark_ml(spark, long):
    cur = long(f=normal(2, 3, 800))
    stats = spark.createDataFrame([("f", 1.8, 3.1)], "feature string, mean double, std double")
    ours = D.ks_normal(cur, stats).first()
    theirs = KolmogorovSmirnovTest.test(cur.select("value"), "value", "norm", 1.8, 3.1).first()
    assert ours["ks_statistic"] == pytest.approx(theirs["statistic"], abs=1e-6)


def test_wasserstein(long):
    base = normal(100, 15)
    d = by_feature(D.wasserstein(long(same=base, up=base), long(same=list(base), up=[v + 10 for v in base])), "wasserstein")
    assert d["same"] == 0.0 and d["up"] == pytest.approx(10.0)
    assert D.wasserstein(long(f=[None]), long(f=[1, 2])).first()["wasserstein"] == 0.0


def counts(spark, base, cur):
    rows = [("f", i, b, c) for i, (b, c) in enumerate(zip(base, cur))]
    return spark.createDataFrame(rows, "feature string, bin int, n_base long, n_cur long")


def test_chi_square(spark):
    close = D.chi_square_pvalues(counts(spark, [100, 200, 150, 100], [105, 195, 155, 95])).first()
    apart = D.chi_square_pvalues(counts(spark, [100, 200, 150, 100], [50, 300, 100, 100])).first()
    assert close["p_value"] > 0.05 > apart["p_value"]
    assert apart["statistic"] == pytest.approx(91.6667, abs=1e-3)
    hidden = D.chi_square_pvalues(counts(spark, [10, 0], [5, 5])).first()
    assert (hidden["statistic"], hidden["p_value"], hidden["masked_mass"]) == (0.0, 1.0, True)
    empty = D.chi_square_pvalues(counts(spark, [10, 10], [0, 0])).first()
    assert (empty["statistic"], empty["p_value"]) == (0.0, 1.0)


def test_shift_outliers_quality(long, spark):
    assert D.mean_shift(long(f=[1, 3]), long(f=[4, 6]), normalize=True).first()["mean_shift"] == 3.0
    assert D.mean_shift(long(f=[2, 2]), long(f=[5]), normalize=True).first()["mean_shift"] == 3.0
    stats = spark.createDataFrame([("f", 10.0, 1.0, 0.0, 10.0), ("g", 7.0, 0.0, 0.0, 10.0)], "feature string, mean double, std double, min double, max double")
    out = {r["feature"]: r for r in D.outliers(long(f=[10, 10, 20, None], g=[1, 99]), stats).collect()}
    assert (out["f"]["outlier_count"], out["f"]["lower_bound"], out["f"]["upper_bound"]) == (1, 7.0, 13.0)
    assert out["f"]["outlier_pct"] == pytest.approx(100 / 3)
    assert tuple(out["g"])[1:] == (0, 0.0, 7.0, 7.0)
    q = {r["feature"]: r for r in D.feature_quality(long(f=[1, 2, float("nan"), 4, float("nan")], g=[1, 2, 15, 4, -5]), stats).collect()}
    assert (q["f"]["missing_count"], q["f"]["missing_pct"]) == (2, 40.0)
    assert (q["g"]["out_of_range_count"], q["g"]["out_of_range_pct"]) == (2, 40.0)


def test_drift_score(spark):
    f = spark.createDataFrame([("a", 0.15), ("b", 0.25), ("c", 0.10)], "feature string, psi double")
    p = spark.createDataFrame([(0.3,)], "psi double")
    score = lambda *a, **k: D.drift_score(*a, **k).first()["drift_score"]
    assert score(f) == pytest.approx(1 - math.exp(-0.5 / 3))
    assert score(f, p) == pytest.approx(1 - math.exp(-(0.5 + 0.6) / 4)) and score(f, p) > score(f)
    assert score(f, p, {"a": 2.0}) == pytest.approx(1 - math.exp(-0.65 / 4))
    assert score(f.where("psi > 9"), p) == 0.0


def test_monitored_features():
    names = [f"t{i}" for i in range(5)] + ["url_count", "word_count"]
    assert D.monitored_features(names, DriftConfig(top_features=3)) == ["url_count", "word_count", "t0"]
    assert D.monitored_features(names, DriftConfig(top_features=1)) == ["url_count", "word_count"]
    assert D.monitored_features(names, DriftConfig(excluded_features=("t0",)))[2] == "t1"


def test_feature_drift_levels(long):
    base = normal(150, 80, 3000)
    levels = {f"s{s}": [v + s for v in normal(150, 80)] for s in (0, 10, 25, 50)}
    b, c = long(**{k: base for k in levels}), long(**levels)
    rows = {r["feature"]: r for r in D.feature_drift(feature_statistics(b), histogram(b), c, baseline=b).collect()}
    assert rows["s50"]["psi"] > rows["s25"]["psi"] > rows["s0"]["psi"]
    assert rows["s50"]["drift_detected"] and not rows["s0"]["drift_detected"]
    assert rows["s50"]["mean_shift"] > 30


def test_statistics_literals(long):
    values = [1, 2, 3, float("nan"), 5, float("nan"), 7, 8, 9, 10]
    rows = {r["feature"]: r for r in feature_statistics(long(f=values, empty=[None, None], flat=[5, 5])).collect()}
    f = rows["f"]
    assert (f["missing_count"], f["missing_ratio"], f["mean"], f["unique_count"]) == (2, 0.2, 5.625, 8)
    assert (f["median"], f["q25"], f["q75"]) == (6.0, 2.75, 8.25)
    e = rows["empty"]
    assert (e["mean"], e["missing_ratio"], e["unique_count"]) == (0.0, 1.0, 0)
    bins = histogram(long(flat=[5, 5], f=[0, 1, 2, 10], empty=[None]), 20).collect()
    flat = sorted((r for r in bins if r["feature"] == "flat"), key=lambda r: r["bin"])
    assert (flat[0]["bin_start"], flat[-1]["bin_end"], sum(r["count"] for r in flat)) == (4.5, 5.5, 2)
    top = [r for r in bins if r["feature"] == "f" and r["bin"] == 19]
    assert top[0]["count"] == 1 and not [r for r in bins if r["feature"] == "empty"]
    assert sum(r["density"] for r in bins if r["feature"] == "f") == pytest.approx(1.0)


def test_prediction_distribution_empty(spark):
    none = spark.createDataFrame([], "spam_probability double")
    assert tuple(prediction_distribution(none).first()) == (0.5, 0.0, 0.5)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_running_totals_do_not_depend_on_cut_points(spark, ranges):
    """One value holds a third of all rows; every cutting gives brute-force sums."""
    values = [7.0] * 400 + [rng.uniform(0, 100) for _ in range(500)] + [rng.randrange(5) for _ in range(300)]
    df = spark.createDataFrame([("f", float(v)) for v in values], "feature string, value double")
    got = {r["value"]: (r["before_n"], r["next_value"]) for r in ordered.ecdf(df, ranges=ranges).collect()}
    distinct = sorted(set(map(float, values)))
    for i, v in enumerate(distinct):
        nxt = distinct[i + 1] if i + 1 < len(distinct) else None
        assert got[v] == (sum(w < v for w in values), nxt)
    assert len(got) == len(distinct)
