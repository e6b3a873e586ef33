"""Bootstrap draws: agreement of forms, exact size, and valid interval widths."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verispark.functions.mixing import mixed_array
from verispark.operators import resample

DAY0 = dt.date(2020, 1, 1)


def series(n, seed=1, phi=0.5):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for i in range(n):
        x[i] = (phi * x[i - 1] if i else 0) + rng.normal()
    return x


def frame(spark, values, name="x"):
    rows = [(DAY0 + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"day date, {name} double")


def starts(n, draws, width, seed):
    p = 2147483647
    blocks = -(-n // width)
    out = np.empty((draws, blocks), dtype=np.int64)
    for d in range(draws):
        for b in range(blocks):
            x = (d * 7919 + b * 104729 + seed) % p
            out[d, b] = pow((pow(x, 5, p) * 48271 + 11) % p, 5, p) % n
    return out


def indices(n, draws, width, seed):
    return ((starts(n, draws, width, seed)[:, :, None] + np.arange(width)) % n).reshape(draws, -1)[:, :n]


@pytest.mark.parametrize("n,width", [(10, 1), (23, 7), (21, 7), (5, 7), (30, 4)])
def test_arcs_equal_indices(spark, n, width):
    values = series(n)
    got = resample.block_bootstrap(frame(spark, values), [], "day", ["x"], 40, width, 99).orderBy("draw").toPandas()
    want = values[indices(n, 40, width, 99)].mean(axis=1)
    np.testing.assert_allclose(got.x.to_numpy(), want, rtol=1e-12, atol=1e-12)


def test_missing_days_leave_sum_and_count(spark):
    values = series(20)
    values[[3, 11]] = np.nan
    got = resample.block_bootstrap(frame(spark, values), [], "day", ["x"], 30, 4, 5).orderBy("draw").toPandas()
    want = np.nanmean(values[indices(20, 30, 4, 5)], axis=1)
    np.testing.assert_allclose(got.x.to_numpy(), want, rtol=1e-12)


def test_weights_sum_to_length(spark):
    sizes = spark.createDataFrame([("a", 17), ("b", 40)], "g string, n_days int")
    w = resample.day_weights(sizes, ["g"], 25, 6, 3).groupBy("g", "draw").agg(F.sum("k").alias("k")).toPandas()
    assert len(w) == 50
    assert (w[w.g == "a"].k == 17).all() and (w[w.g == "b"].k == 40).all()


def test_index_and_weight_forms_agree(spark):
    daily = frame(spark, series(31))
    arcs = resample.block_bootstrap(daily, [], "day", ["x"], 20, 5, 8).toPandas().set_index("draw").x
    days = resample.day_ordinals(daily, [], "day")
    sizes = days.groupBy().agg(F.max("n_days").alias("n_days"))
    w = resample.day_weights(sizes, [], 20, 5, 8).join(days, "day_idx")
    weights = w.groupBy("draw").agg((F.sum(F.col("k") * F.col("x")) / F.sum("k")).alias("x")).toPandas().set_index("draw").x
    np.testing.assert_allclose(arcs.sort_index(), weights.sort_index(), rtol=1e-12)


@pytest.mark.parametrize("width,seed", [(1, 11), (7, 12), (7, 20260101)])
def test_interval_width_matches_a_true_generator(spark, width, seed):
    """A lattice-like index would pass every oracle and still give wrong intervals."""
    n, draws = 360, 2000
    values = series(n, seed=4)
    got = resample.block_bootstrap(frame(spark, values), [], "day", ["x"], draws, width, seed)
    low, high = resample.interval("x")
    row = got.agg(low.alias("lo"), high.alias("hi")).head()
    widths = []
    for s in range(6):
        rng = np.random.default_rng(s)
        st = rng.integers(0, n, size=(draws, -(-n // width)))
        idx = ((st[:, :, None] + np.arange(width)) % n).reshape(draws, -1)[:, :n]
        q = np.quantile(values[idx].mean(axis=1), [0.025, 0.975])
        widths.append(q[1] - q[0])
    assert abs((row.hi - row.lo) / np.mean(widths) - 1) < 0.10


def test_nested_draws(spark):
    rng = np.random.default_rng(3)
    n, units, weights = 12, ["a", "b", "c"], {"a": 2.0, "b": 1.0, "c": 5.0}
    cube = rng.normal(size=(n, 3))
    rows = [(DAY0 + dt.timedelta(days=i), u, weights[u], float(cube[i, j])) for i in range(n) for j, u in enumerate(units)]
    rows += [(DAY0 + dt.timedelta(days=n), "a", 2.0, 100.0)]  # incomplete day: must not count
    df = spark.createDataFrame(rows, "day date, unit string, w double, x double")
    got = resample.nested_bootstrap(df, "day", "unit", "w", ["x"], 15, 4, 7, 70).orderBy("draw").toPandas()
    t, s = indices(n, 15, 4, 7), indices(3, 15, 1, 70)
    w = np.array([weights[u] for u in units])
    want = [np.average(cube[t[d]][:, s[d]].ravel(), weights=np.tile(w[s[d]], n)) for d in range(15)]
    np.testing.assert_allclose(got.x.to_numpy(), want, rtol=1e-10)


def test_cell_day_draws_skip_absent_cells(spark):
    rng = np.random.default_rng(5)
    cube = rng.normal(size=(4, 9))
    cube[1, :8] = np.nan
    rows = [("m", f"c{i}", DAY0 + dt.timedelta(days=j), None if np.isnan(cube[i, j]) else float(cube[i, j]))
            for i in range(4) for j in range(9)]
    df = spark.createDataFrame(rows, "model string, cell string, day date, x double")
    got = resample.cell_day_bootstrap(df, ["model"], "cell", "day", ["x"], 25, 3, 1, 2).orderBy("draw").toPandas()
    t, s = indices(9, 25, 3, 1), indices(4, 25, 1, 2)
    import warnings
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = [np.nanmean(np.nanmean(cube[:, t[d]], axis=1)[s[d]]) for d in range(25)]
    np.testing.assert_allclose(got.x.to_numpy(), want, rtol=1e-10)


def test_weighted_rank_draws_equal_real_copies(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"block": [f"b{i % 4}" for i in range(20)], "x": rng.integers(0, 6, 20).astype(float), "y": rng.normal(size=20)})
    got = resample.weighted_spearman_draws(spark.createDataFrame(pdf), [], "block", "x", "y", 12, 9).orderBy("draw").toPandas()
    s = indices(4, 12, 1, 9)
    for d in range(12):
        drawn = pd.concat([pdf[pdf.block == f"b{i}"] for i in s[d]])
        assert got.rho[d] == pytest.approx(drawn.x.rank().corr(drawn.y.rank()), abs=1e-10)


def test_sup_t_ignores_a_constant_dimension(spark):
    rng = np.random.default_rng(7)
    draws = rng.normal(size=(400, 2))
    rows = [(d, k, float(draws[d, i])) for d in range(400) for i, k in enumerate("ab")] + [(d, "c", 1.0) for d in range(400)]
    df = spark.createDataFrame(rows, "draw int, dim string, v double")
    point = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 1.0)], "dim string, point double")
    out = resample.sup_t_band(df, point, [], ["dim"], "v").toPandas().set_index("dim")
    se = draws.std(axis=0, ddof=1)
    want = np.quantile(np.abs(draws / se).max(axis=1), 0.95)
    assert out.critical["a"] == pytest.approx(want)
    assert out.band_low["c"] == pytest.approx(1.0)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_distributed_unit_numbers_equal_the_window(spark, by):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 500), "u": [f"u{i}" for i in rng.integers(0, 200, 500)]})
    df = spark.createDataFrame(pdf)
    plain = resample.unit_ordinals(df, by, "u").toPandas().sort_values([*by, "u"]).reset_index(drop=True)
    spread = resample.unit_ordinals(df, by, "u", limit=0).toPandas().sort_values([*by, "u"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, spread[plain.columns], check_dtype=False)


def test_day_counts_are_the_drawn_blocks():
    for n, width in ((11, 3), (7, 7), (5, 9), (1, 2)):
        counts = resample.day_counts(4, 9, n, width, 77)
        for row, draw in zip(counts, range(4, 9), strict=True):
            want = np.zeros(n)
            for block in range(-(-n // width)):
                start = int(mixed_array(np.array([draw]), np.array([block]), 77)[0, 0] % n)
                for o in range(min(width, n - block * width)):
                    want[(start + o) % n] += 1
            assert (row == want).all() and row.sum() == n


def test_unit_means_over_gaps_and_values_that_are_not_finite(spark):
    rng = np.random.default_rng(3)
    rows = [(u, day, float(rng.normal())) for u in range(7) for day in range(20) if rng.random() < 0.7]
    rows += [(7, 3, float("inf")), (7, 4, 1.0), (8, 3, float("inf")), (8, 5, float("-inf")), (9, 6, float("nan")), (9, 7, 2.0), (10, 8, None), (None, 2, 4.0)]
    rows += [(r[0], r[1], 0.5) for r in rows[:5]]  # two rows of one day weigh as two
    frame = spark.createDataFrame(rows, "unit int, day int, v double")
    got = {(r.draw, r.unit): r.v for r in resample.unit_means(frame, ["unit"], "day", ["v"], 30, 4, 5).collect()}
    days = sorted({r[1] for r in rows})
    counts = resample.day_counts(0, 30, len(days), 4, 5)
    for draw in range(30):
        for unit in {r[0] for r in rows}:
            weight = np.array([counts[draw, days.index(d)] for u, d, v in rows if u == unit and v is not None])
            values = np.array([v for u, d, v in rows if u == unit and v is not None])
            if weight.sum() == 0:
                assert (draw, unit) not in got
                continue
            some = weight > 0
            want = (weight[some] * values[some]).sum() / weight.sum()
            assert got[draw, unit] == pytest.approx(want, nan_ok=True)


def test_ranks_along_a_fixed_order_equal_the_windows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(g, int(rng.integers(0, 9)), float(rng.integers(0, 6)), None if rng.random() < 0.1 else float(rng.normal())) for g in ("a", "b") for _ in range(60)]
    rows += [("one", 1, 2.0, 3.0), ("flat", 1, 2.0, 3.0), ("flat", 2, 2.0, 4.0)]
    frame = spark.createDataFrame(rows, "g string, block int, x double, y double")

    def run():
        return {(r.g, r.draw): r.rho for r in resample.weighted_spearman_draws(frame, ["g"], "block", "x", "y", 40, 9).collect()}

    fast = run()
    monkeypatch.setattr(resample, "MATRIX_VALUES", 10)
    slow = run()
    assert set(fast) == set(slow) and len(fast) >= 120
    for key, rho in slow.items():
        assert fast[key] == (pytest.approx(rho, abs=1e-9) if rho is not None else None)


def test_average_ranks_down_columns():
    values = np.array([[3.0, 1.0], [1.0, 1.0], [3.0, 0.0], [2.0, 1.0]])
    assert (resample.average_rank_columns(values) == np.array([[3.5, 3.0], [1.0, 3.0], [3.5, 1.0], [2.0, 3.0]])).all()


def test_no_shuffle_carries_draws(spark):
    frame = spark.range(100).selectExpr("id % 5 as unit", "id % 20 as day", "cast(id as double) as v")
    plan = resample.unit_means(frame, ["unit"], "day", ["v"], 500, 7, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]
