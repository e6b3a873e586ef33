"""Rolling medians, ranks and quantiles, including series and values that own the data."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verispark.operators import order_stats, rolling

T0 = dt.datetime(2020, 2, 28)


def reports(n_hot=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("hot", T0 + dt.timedelta(minutes=int(m)), i) for i, m in enumerate(np.sort(rng.integers(0, 20000, n_hot)))]
    # Sparse series: single-row days, gaps of days, repeated stamps.
    rows += [("thin", T0 + dt.timedelta(days=3 * i, hours=int(i % 5)), 1000 + i) for i in range(15)]
    rows += [("same", T0, 2000 + i) for i in range(6)] + [("one", T0, 3000)]
    pdf = pd.DataFrame(rows, columns=["station", "t", "id"])
    pdf["v"] = np.round(rng.normal(10, 3, len(pdf)), 1)
    pdf["ok"] = rng.random(len(pdf)) > 0.2
    return pdf


def brute(pdf, values):
    ordered = pdf.assign(v_=values).sort_values(["station", "t", "id"])
    group = ordered.groupby("station").v_
    roll = group.rolling(5, center=True, min_periods=1)
    return pd.DataFrame({"id": ordered.id.to_numpy(), "median": roll.median().to_numpy(), "n": roll.count().to_numpy()}).set_index("id").sort_index()


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_centred_median_across_bucket_borders(spark, bucket):
    pdf = reports()
    df = spark.createDataFrame(pdf)
    got = rolling.centred_median(df, "station", ["t", "id"], "v", bucket=bucket).toPandas().set_index("id").sort_index()
    want = brute(pdf, pdf.v)
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got.rolling_median, want["median"])
    np.testing.assert_array_equal(got.rolling_count, want.n)


def test_both_quality_modes(spark):
    pdf = reports(seed=2)
    df = spark.createDataFrame(pdf)
    masked = rolling.rolling_quality(df, "station", ["t", "id"], "v", F.col("ok"), "masked_rows").toPandas().set_index("id").sort_index()
    want = brute(pdf, pdf.v.where(pdf.ok))
    np.testing.assert_allclose(masked.rolling_median, want["median"])
    valid = rolling.rolling_quality(df, "station", ["t", "id"], "v", F.col("ok"), "valid_rows").toPandas().set_index("id").sort_index()
    assert len(valid) == len(pdf)
    kept = pdf[pdf.ok]
    want = brute(kept, kept.v)
    np.testing.assert_allclose(valid.rolling_median.dropna(), want["median"])
    p = pdf.set_index("id").sort_index()
    flag = p.ok & (valid.rolling_count >= 3) & ((p.v - valid.rolling_median).abs() <= 4)
    assert (valid.qc_valid == flag).all()


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        rolling.rolling_quality(spark.createDataFrame(reports()), "station", ["t", "id"], "v", F.col("ok"), "other")


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold most rows."""
    rng = np.random.default_rng(1)
    g = np.where(rng.random(3000) < 0.6, "big", np.where(rng.random(3000) < 0.5, "mid", "tiny"))
    x = np.where(rng.random(3000) < 0.4, 7.0, np.round(rng.normal(0, 50, 3000), 1))
    y = x + rng.normal(0, 20, 3000)
    return pd.DataFrame({"g": g, "x": x, "y": np.round(y, 0)})


@pytest.mark.parametrize("limit", [0, None])
def test_quantiles(spark, skewed, limit):
    got = order_stats.grouped_quantiles(spark.createDataFrame(skewed), ["g"], "x", {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}, limit).toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["a", "b", "c", "d"]].to_numpy(float), np.quantile(part.x, [0, 0.31, 0.5, 1]))
        assert got.n_values[g] == len(part)


@pytest.mark.parametrize("limit", [0, None])
def test_average_ranks_and_spearman(spark, skewed, limit):
    df = spark.createDataFrame(skewed.assign(i=np.arange(len(skewed))))
    ranks = order_stats.average_ranks(df, ["g"], "x", "rank", limit).toPandas().set_index("i").sort_index()
    np.testing.assert_allclose(ranks["rank"], skewed.groupby("g").x.rank())
    rho = order_stats.spearman(df, ["g"], "x", "y", limit=limit).toPandas().set_index("g").spearman
    for g, part in skewed.groupby("g"):
        assert rho[g] == pytest.approx(part.x.rank().corr(part.y.rank()), abs=1e-9)


@pytest.mark.parametrize("limit", [0, None])
def test_bins_follow_interpolated_edges(spark, skewed, limit):
    got = order_stats.quantile_bins(spark.createDataFrame(skewed.assign(i=np.arange(len(skewed)))), ["g"], "x", 4, "bin", limit).toPandas().set_index("i").sort_index()
    want = skewed.groupby("g").x.transform(lambda v: pd.qcut(v, 4, labels=False, duplicates="drop") + 1)
    np.testing.assert_array_equal(got.bin, want)


def test_spearman_without_spread_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, x double, y double")
    assert order_stats.spearman(df, ["g"], "x", "y").head().spearman is None


@pytest.mark.parametrize("limit", [None, 0])
def test_quantiles_mean_the_same_on_both_branches(spark, limit):
    inf, nan = float("inf"), float("nan")
    groups = {"a": [1.0, 2.0, 3.0, inf], "b": [-inf, 5.0, nan, None, inf], "c": [inf, inf], "d": [nan, None], "e": [2.0], "f": [1.0, 1.0, 4.0, 4.0, 9.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {x.g: x for x in order_stats.grouped_quantiles(df, ["g"], "v", {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}, limit).collect()}
    assert set(got) == {"a", "b", "c", "e", "f"}
    assert (got["a"].q25, got["a"].q50, got["a"].q75, got["a"].q100) == (1.75, 2.5, inf, inf)
    assert (got["b"].n_values, got["b"].q0, got["b"].q50, got["b"].q100) == (3, -inf, 5.0, inf)
    assert (got["c"].q25, got["c"].q100, got["e"].q75, got["f"].q50, got["f"].q75) == (inf, inf, 2.0, 4.0, 4.0)
    ranks = {(x.g, x.v): x.k for x in order_stats.average_ranks(df, ["g"], "v", "k", limit).collect()}
    assert ranks[("d", None)] is None and ranks[("a", inf)] == 4.0 and ranks[("f", 1.0)] == 1.5


def test_reports_that_share_a_time_all_count(spark):
    rows = [("s", dt.datetime(2020, 1, 1, 23, 50), v) for v in (4.0, 1.0, 2.0)] + [("s", dt.datetime(2020, 1, 2, 0, 10), 5.0)]
    rows += [("t", dt.datetime(2020, 1, 1, 23, 50), 7.0)] * 3 + [("t", dt.datetime(2020, 1, 2), 1.0)] * 2
    out = rolling.centred_median(spark.createDataFrame(rows, "k string, at timestamp_ntz, v double"), "k", ["at"], "v")
    got = {(x.k, x.v, x.at.day): (x.rolling_median, x.rolling_count) for x in out.collect()}
    assert out.count() == 9 and got[("s", 5.0, 2)] == (4.0, 3) and got[("s", 2.0, 1)] == (3.0, 4)
    assert got[("t", 1.0, 2)][0] in (1.0, 4.0, 7.0)
