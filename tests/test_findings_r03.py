"""Findings of the third review: larger tables, crowds and odd values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verispark.operators import resample, support


def _km(a, b):
    (la, oa), (lb, ob) = a, b
    inner = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(ob - oa) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, max(0.0, inner))))


@pytest.mark.parametrize("every_centre", [False, True])
def test_neighbourhood_means_against_plain_sums_and_without_pairs(spark, every_centre):
    places = {k: (-88.0 + (k * 37) % 176, (k * 73) % 360 - 180.0) for k in range(60)}
    places.update({60: places[3], 61: places[3], 62: None})
    values = {(s, t): None if (s + t) % 11 == 0 else math.inf if (s, t) == (5, 1) else float(s % 7 + t) for s in places for t in range(5) if (s * 5 + t) % 3}
    stations = spark.createDataFrame([(k, *(p or (None, None))) for k, p in places.items()], "station_id long, latitude double, longitude double")
    series = spark.createDataFrame([(s, t, v) for (s, t), v in values.items()], "station_id long, t int, v double")
    weights = [support.Weight("own", 0.0), support.Weight("flat", 4000.0), support.Weight("bell", 6000.0, 1500.0, by_area=True)]
    means = support.neighbourhood_means(series, stations, ["t"], [("v", w) for w in weights], ["v"], every_centre, blocks=2)
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan

    def mean(c, t, weight):
        num = den = 0.0
        for s, place in places.items():
            v = values.get((s, t))
            if v is None or (s != c if weight.reach_km == 0 else not place or not places[c] or _km(places[c], place) > weight.reach_km):
                continue
            w = math.exp(-0.5 * (_km(places[c], place) / weight.sigma_km) ** 2) * math.cos(math.radians(place[0])) if weight.sigma_km else 1.0
            num, den = num + w * v, den + w
        return num / den if den else None

    want = {}
    for c in places:
        for t in range(5):
            row = [mean(c, t, w) for w in weights]
            if (c, t) in values or every_centre and any(x is not None for x in row):
                want[c, t] = [*row, values.get((c, t))]
    if every_centre:
        want = {k: row for k, row in want.items() if any(x is not None for x in row[:3])}
    got = {(r.centre_id, r.t): [r.v__own, r.v__flat, r.v__bell, r.v] for r in means.collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert [x if x is None else pytest.approx(x, rel=1e-9) for x in row] == got[key], key


def test_slice_at_its_edge_is_the_one_of_the_sql(spark):
    import duckdb

    from verispark.plans.places import BANDS, CELLS_SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE nation AS SELECT 0::BIGINT AS n_nationkey, 'n' AS n_name, 0::BIGINT AS n_regionkey")
    con.execute("CREATE TABLE supplier AS SELECT range AS s_suppkey, 0::BIGINT AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM range(36000)")
    where = con.execute(CELLS_SQL + " SELECT latitude, longitude, cell_id FROM cells ORDER BY station_id").fetchall()
    df = spark.createDataFrame(where, "latitude double, longitude double, want string")
    assert df.where(BANDS.cell_id(F.col("latitude"), F.col("longitude")) != F.col("want")).count() == 0


def test_a_file_per_station_however_many_tasks_hold_its_rows(spark, tmp_path):
    from verispark.sources import reports

    rows = spark.range(600, numPartitions=6).select("id", (F.col("id") % 5).alias("station"))
    reports.write_station_csv(rows, str(tmp_path / "csv"), "station")
    assert len(list((tmp_path / "csv").glob("station=*/*.csv"))) == 5
    back = reports.read_station_csv(spark, str(tmp_path / "csv"), "id bigint", key_pattern=r"station=([^/]+)/")
    assert sorted((r.id, r.station_id) for r in back.collect()) == [(i, str(i % 5)) for i in range(600)]


def test_a_task_ranks_few_draws_at_a_time_and_blocks_do_not_grow_with_units(spark, monkeypatch):
    rows = spark.range(300).select((F.col("id") % 40).alias("block"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("y"))
    whole = {r.draw: r.rho for r in resample.weighted_spearman_draws(rows, [], "block", "x", "y", 130, 9).collect()}
    ranks = resample.tied_ranks

    def bounded(weights, order, group):
        assert weights.size <= 900
        return ranks(weights, order, group)

    monkeypatch.setattr(resample, "tied_ranks", bounded)
    monkeypatch.setattr(resample, "RANK_VALUES", 900, raising=False)
    few = resample.weighted_spearman_draws(rows, [], "block", "x", "y", 130, 9)
    assert {r.draw: r.rho for r in few.collect()} == whole and len(whole) == 130


def test_draws_of_days_are_ranked_without_a_sort_of_units_by_draw(spark):
    rows = [(u, t, float((u * 7 + t * t) % 13), float((u * 5 + t * 3) % 11) if (u + t) % 6 else None) for u in range(30) for t in range(9) if (u, t) != (4, 2)]
    daily = spark.createDataFrame(rows, "unit long, day int, a double, b double")
    rho = resample.drawn_day_spearman(daily, "unit", "day", ["a", "b"], F.col("a"), {"b": F.col("b"), "same": -F.col("a")}, 130, 2, 9)
    plan = rho._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and plan.count("hashpartitioning(unit") == 1
    counts = resample.day_counts(0, 130, 9, 2, 9)
    got = {(r.draw, r.covariate): r.rho for r in rho.collect()}
    assert len(got) == 260
    for draw in range(130):
        means = []
        for k in (2, 3):
            held = np.array([[r[k] if r[k] is not None else np.nan for r in rows if r[1] == t and r[0] == u] or [np.nan] for u in range(30) for t in range(9)]).reshape(30, 9)
            weight = counts[draw] * ~np.isnan(held)
            with np.errstate(invalid="ignore"):
                means.append((weight * np.nan_to_num(held)).sum(axis=1) / weight.sum(axis=1))
        a, b = means
        good = ~(np.isnan(a) | np.isnan(b))
        ranks = [resample.average_rank_columns(np.round(v[good], 12)[:, None])[:, 0] for v in (a, b)]
        assert got[draw, "b"] == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=0.02)
        assert got[draw, "same"] == pytest.approx(-1.0)


def test_a_case_is_sent_to_its_cell_day_before_it_becomes_a_row_per_model(spark, sf):
    from verispark.plans import catalogue

    plan = catalogue.agg_hierarchical(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sent = [i for i, line in enumerate(plan) if "RepartitionByExpression [cell" in line]
    assert sent and all(any("Expand" in above for above in plan[:i]) and not any("Expand" in below for below in plan[i:i + 4]) for i in sent)


def test_rows_that_are_sorted_for_the_first_of_a_site_hold_each_column_once(spark, sf):
    from verispark.operators import contracts

    df = spark.createDataFrame([(1, 2, "b", 5.0), (1, 2, "a", 7.0), (1, 1, "c", None), (2, None, "x", 1.0), (2, 0, "y", 2.0)], "k int, o int, t string, v double")
    first = contracts.first_per_key(df, ["k"], ["o", "t"])
    assert {tuple(r) for r in first.collect()} == {(1, 1, "c", None), (2, None, "x", 1.0)}
    assert "_o0" not in first._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_rows_of_a_station_average_before_its_neighbours_do(spark):
    stations = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0)], "station_id long, latitude double, longitude double")
    series = spark.createDataFrame([(1, 0, 1.0, 4.0), (1, 0, 3.0, None), (1, 0, None, 8.0), (2, 0, 8.0, None), (2, 1, None, 5.0)], "station_id long, t int, v double, w double")
    got = support.neighbourhood_means(series, stations, ["t"], [("v", support.Weight("own", 0.0)), ("v", support.Weight("flat", 500.0))], ["w"], blocks=3)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 6.0, 2.0, 5.0), (2, 0, None, 8.0, 5.0), (2, 1, 5.0, None, None)]


@pytest.mark.parametrize("name", ["smoothing_curves", "smoothing_decisions", "support_scorecard", "support_targets", "support_optima"])
def test_series_of_the_supports_are_shuffled_once(spark, sf, name, monkeypatch):
    from verispark.plans import smoothing

    panels, means = [], support.neighbourhood_means
    monkeypatch.setattr(support, "neighbourhood_means", lambda *a, **k: panels.append(means(*a, **k)) or panels[-1])
    made = getattr(smoothing, name)(spark, sf)
    plan = panels[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(station_id" not in plan and "Sort [_block" not in plan
    if name == "support_targets":
        assert "hashpartitioning(weighting#" in (plan := made._jdf.queryExecution().executedPlan().toString()) and "Expand" not in plan and "centre_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_copies_at_a_place_are_linked_by_their_first_and_lose_no_pair(spark, tmp_path):
    from verispark.plans import places

    balances = [*[100.0] * 200, *[-5.0] * 40, 130.0, 159.9, 160.1, 900.0, 9000.0]
    rows = [(k, 3 if k % 50 else 4, b, "MACHINERY" if k % 3 else "BUILDING") for k, b in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = places.geo_close_pairs(spark, str(tmp_path)).collect()
    assert len(got) < 300 and all(r.station_a < r.station_b for r in got)
    first = {r.station_b: r.station_a for r in got if r.copies}
    links = {frozenset((r.station_a, r.station_b)): (r.distance_km, r.elevation_gap_m, r.same_site) for r in got if not r.copies}
    own = {r.station_b: (r.distance_km, r.elevation_gap_m, r.same_site) for r in got if r.copies}
    spot = {f"c{k:09d}": ((n - 12) * 6.0 + b / 199999, n * 15.0 - 180.0 + b / 399983, b / 2 if b >= 0 else None) for k, n, b, _ in rows}
    names = sorted(spot)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            km, (*_, high), (*_, low) = _km(spot[a][:2], spot[b][:2]), spot[a], spot[b]
            gap = None if high is None or low is None else abs(high - low)
            fa, fb = first.get(a, a), first.get(b, b)
            found = own[b] if fa == fb else links.get(frozenset((fa, fb)))
            assert (found is None) == (km > 0.5), (a, b)
            if found:
                assert found == (pytest.approx(km, abs=2e-6), gap if gap is None else pytest.approx(gap, abs=2e-6), gap is None or gap <= 30), (a, b)


@pytest.mark.parametrize("stations, near", [(40, 2), (1000, 300), (60000, 2500), (200000, 3000)])
def test_smallest_residues_are_found_without_mixing_every_station(stations, near, monkeypatch):
    from verispark.functions.mixing import PRIME, mixed_array, unmixed

    ids = np.sort(np.random.default_rng(stations).choice(stations, near, replace=False)) + 17
    draws = (np.arange(20)[None, :] * 1000003 + np.array([5, 77, 9000])[:, None] * 613 + 1500).ravel()
    assert (unmixed(mixed_array(draws, ids[:9], 43)) == (draws[:, None] * 7919 + ids[None, :9] * 104729 + 43) % PRIME).all()
    want = np.sort(ids[np.argsort(mixed_array(draws, ids, 43), axis=1)[:, :3]], axis=1)
    mixed = []
    monkeypatch.setattr(support, "mixed_array", lambda d, *a: mixed.append(len(d)) or mixed_array(d, *a))
    assert (np.sort(support._least_mixed(draws, ids, 3, 43, 17, stations), axis=1) == want).all()
    assert sum(mixed) <= (60 if stations < 60000 else 20)


def test_thinned_totals_against_every_pair_and_without_a_join(spark):
    from verispark.functions.mixing import mixed_array

    rows = [(k, *((-80.0 + k * 37 % 160, k * 73 % 360 - 180.0) if k % 9 else (10.0, 20.0)), 1 + k % 4 if k % 5 else None, k / 2.0 if k % 5 else None) for k in range(90)]
    rows.append((90, None, 3.0, 2, 1.0))
    stations = spark.createDataFrame(rows, "station_id long, latitude double, longitude double, n long, total double")
    totals = support.thinned_totals(stations, (1500.0, 3000.0), 7, 3, 5, blocks=4)
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroups" not in plan
    got = {(r.draw, r.support_km): (r.n_centres, r.n_pairs, r.station_sum, r.total) for r in totals.collect()}
    for draw in range(7):
        for radius in (1500.0, 3000.0):
            centres, sums = 0, np.zeros(3)
            for c, la, lo, *_ in rows[:90]:
                near = np.array([s for s, a, o, *_ in rows[:90] if _km((la, lo), (a, o)) <= radius])
                kept = near[np.argsort(mixed_array(np.array([draw * 1000003 + c * 613 + int(radius)]), near, 5)[0])[:3]]
                met = [rows[s] for s in kept if rows[s][3]]
                centres += bool(met)
                sums += np.sum([[x[3], x[0] * x[3], x[4]] for x in met], axis=0) if met else 0
            assert got[draw, radius] == (centres, sums[0], sums[1], pytest.approx(sums[2]))


def test_rows_of_a_block_travel_as_few_compressed_columns(spark, monkeypatch):
    monkeypatch.setattr(support, "PACKED", 700)
    rows = spark.range(3000, numPartitions=2).select(
        (F.col("id") % 50 - 25).alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("t"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 11 / 100).alias("v"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("x"), F.col("id"))).alias("s"),
        (F.col("id") % 4).cast("int").alias("_block"))
    dealt = support.dealt_columns(rows, "_block", 6, "k")
    assert dealt.rdd.getNumPartitions() == 6 and dealt.dtypes == rows.drop("_block").dtypes
    got = sorted((tuple(r) for r in dealt.withColumn("p", F.spark_partition_id()).collect()), key=repr)
    assert got == sorted((tuple(r) for r in rows.select("k", "t", "v", "s", "_block").collect()), key=repr)
    sent = "".join(x for x in dealt._jdf.queryExecution().optimizedPlan().toString().splitlines() if "pack" in x and "unpack" not in x)
    assert sent.count("_columns") == 1


def test_values_that_are_stated_by_their_sources_are_those_values(spark):
    places = spark.createDataFrame([(k, -60.0 + 9 * k, 20.0 * k - 120.0) for k in range(12)], "station_id long, latitude double, longitude double")
    cases = spark.createDataFrame([(k, t, float(k * t % 5), None if (k + t) % 6 == 0 else 0.1 * t) for k in range(12) for t in range(7)], "station_id long, t int, a double, b double")
    stated = {"v": F.col("a") * (1 - F.col("b")), "w": F.col("a") / 3}
    wanted = [("v", support.Weight("flat", 3000.0)), ("v", support.Weight("bell", 4000.0, 900.0, by_area=True))]
    whole = support.neighbourhood_means(cases.select("station_id", "t", *[c.alias(v) for v, c in stated.items()]), places, ["t"], wanted, ["w"], blocks=3)
    behind = support.neighbourhood_means(cases, places, ["t"], wanted, ["w"], blocks=3, values=stated)
    assert sorted(tuple(r) for r in behind.collect()) == sorted(tuple(r) for r in whole.collect()) and whole.columns == behind.columns


@pytest.mark.parametrize("name, sources", [("smoothing_curves", 5), ("support_optima", 5), ("support_targets", 1)])
def test_a_block_is_sent_what_its_values_are_made_of(spark, sf, name, sources, monkeypatch):
    from verispark.plans import smoothing

    panels, means = [], support.neighbourhood_means
    monkeypatch.setattr(support, "neighbourhood_means", lambda *a, **k: panels.append(means(*a, **k)) or panels[-1])
    getattr(smoothing, name)(spark, sf)
    packed = [x for x in panels[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow pack(" in x]
    assert len(packed) == 1 and "alpha" not in packed[0] and "ref_point" not in packed[0]
    assert sum(f"{c}#" in packed[0].split(")#")[0] for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity", "p_retailprice")) == sources


def test_days_of_silent_centres_are_summed_without_a_sort(spark, sf):
    from verispark.plans import smoothing

    plan = smoothing.support_targets(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "bit_or" in plan


def test_centres_are_counted_beyond_words_and_below_zero(spark, monkeypatch):
    from verispark.plans import smoothing

    ids = [-130, -64, -1, 0, 63, 64, 65, 5000]
    rows = [(k, t, *[None if (k + t + j) % 3 == 0 else float(k % 7 + t + j) for j in range(len(smoothing.WEIGHTS))]) for k in ids for t in range(4)] + [(9, 0, *[None] * len(smoothing.WEIGHTS))]
    schema = "centre_id long, t int, " + ", ".join(f"ref_point__{w} double" for w in smoothing.WEIGHTS)
    monkeypatch.setattr(smoothing, "ladder_panel", lambda *a, **k: spark.createDataFrame(rows, schema).repartition(3))
    got = {(r.weighting, r.support_km): (r.n, r.n_centres, r.mean_target, r.sd_target) for r in smoothing.support_targets(spark, "").collect()}
    assert len(got) == 6
    for j, (w, radius) in enumerate((w, radius) for w in ("uniform", "gaussian") for radius in smoothing.RADII):
        held = [(r[0], r[2 + j]) for r in rows if r[2 + j] is not None]
        values = [v for _, v in held]
        assert got[w, radius] == (len(held), len({k for k, _ in held}), pytest.approx(np.mean(values), abs=1e-6), pytest.approx(np.std(values), abs=1e-6))


def test_days_and_taxed_items_reach_the_join(spark, sf):
    from verispark.plans import domain

    sources = domain.common_sources(spark, sf, ["ref_point"])
    plan = sources._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "cast(l_shipdate" not in plan[:join] and "cast(l_shipdate" in plan[join:] and "(l_tax#" in plan[join:].split("Filter")[1]
    assert sources.columns == ["station_id", "valid_day", "l_extendedprice"] and sources.count() == domain.common_panel(spark, sf).count()
