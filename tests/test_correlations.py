"""Correlations from blocks of rows, against a plain computation for every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailwatch.operators.aggregates import correlations


def test_pairs_with_gaps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) + 1e7 * np.arange(5)
    x[rng.random(x.shape) < 0.2] = np.nan
    names = ["a", "b", "c", "d", "e"]
    rows = [[None if np.isnan(v) and i % 2 else float(v) for v in r] + [3.0, None] for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "flat", "none"])).repartition(5)
    got = {(r["left"], r["right"]): r["correlation"] for r in correlations(df, [*names, "flat", "none"]).collect()}
    assert len(got) == 21
    for i, a in enumerate(names):
        for j in range(i + 1, 5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got[a, names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert all(v is None for k, v in got.items() if "flat" in k or "none" in k)
    empty = correlations(df.limit(0), ["a", "b", "c"]).collect()
    assert len(empty) == 3 and all(r["correlation"] is None for r in empty) and correlations(df, ["a"]).count() == 0


def test_as_wide_as_the_feature_table(spark):
    """All pairs of 528 columns come from one aggregate."""
    base = spark.range(400).select(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) + F.col("id") * (k % 3)).cast("double").alias(f"f{k}") for k in range(528)])
    found = correlations(base, base.columns)
    assert found.count() == 528 * 527 // 2
    row = found.where("left = 'f1' and right = 'f4'").first()
    assert row["correlation"] == pytest.approx(base.agg(F.corr("f1", "f4")).first()[0], abs=1e-9)
