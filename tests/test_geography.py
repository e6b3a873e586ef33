"""Distances, neighbours, sites, kernels and interpolation against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verispark.functions import geo
from verispark.operators import box_tree, kernel, neighbours, regions, risk, sites, support


def haversine(a_lat, a_lon, b_lat, b_lon):
    a_lat, a_lon, b_lat, b_lon = map(np.radians, (a_lat, a_lon, b_lat, b_lon))
    h = np.sin((b_lat - a_lat) / 2) ** 2 + np.cos(a_lat) * np.cos(b_lat) * np.sin((b_lon - a_lon) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def matrix(a, b):
    return haversine(a.latitude.to_numpy()[:, None], a.longitude.to_numpy()[:, None], b.latitude.to_numpy()[None, :], b.longitude.to_numpy()[None, :])


def points(n, seed, prefix="p", spread=None):
    rng = np.random.default_rng(seed)
    if spread:
        lat, lon = 89.5 + rng.normal(0, spread, n), 179.9 + rng.normal(0, spread * 20, n)
        lat = np.minimum(lat, 90)
    else:
        lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    return pd.DataFrame({"station_id": [f"{prefix}{i:04d}" for i in range(n)], "latitude": lat, "longitude": lon})


@pytest.mark.parametrize("radius,spread", [(1500.0, None), (40.0, 0.3)])
def test_radius_pairs_over_pole_and_dateline(spark, radius, spread):
    p = points(120, 1, spread=spread)
    got = neighbours.radius_pairs(spark.createDataFrame(p), spark.createDataFrame(p), radius, "station_id", "station_id").toPandas()
    d = matrix(p, p)
    want = {(p.station_id[i], p.station_id[j]) for i, j in np.argwhere(d <= radius)}
    assert set(zip(got.l_id, got.r_id)) == want and len(got) == len(want)


def test_nearest_is_exact_however_far(spark):
    a = pd.concat([points(60, 2), points(30, 5, "q", spread=0.2)], ignore_index=True)
    b = pd.concat([points(25, 3, "r"), points(25, 3, "s"), points(40, 6, "t", spread=0.2)], ignore_index=True)  # places twice, and a crowd
    got = neighbours.nearest_match(spark.createDataFrame(a), spark.createDataFrame(b), "station_id", "station_id").toPandas().set_index("station_id")
    d = matrix(a, b)
    for i, name in enumerate(a.station_id):
        assert got.nearest_km[name] == pytest.approx(d[i].min(), abs=1e-6)
        assert got.nearest_id[name] == b.station_id[np.flatnonzero(d[i] <= d[i].min() + 1e-9)].min()


def brute_sites(p, radius, tolerance, identifier=False):
    d = matrix(p, p)
    z = p.altitude_m.to_numpy()
    gap = np.abs(z[:, None] - z[None, :])
    link = (d <= radius) & (np.isnan(gap) | (gap <= tolerance))
    if identifier:
        ids = p.site_identifier.fillna("").to_numpy()
        link |= (ids[:, None] == ids[None, :]) & (ids[:, None] != "")
    label = np.arange(len(p))
    while True:
        new = np.array([label[link[i]].min() for i in range(len(p))])
        if (new == label).all():
            return p.station_id.to_numpy()[label]
        label = new


@pytest.mark.parametrize("seed,identifier", [(1, False), (2, True), (3, False)])
def test_sites_match_transitive_closure(spark, seed, identifier):
    rng = np.random.default_rng(seed)
    n = 260
    centre = rng.integers(0, 6, n)
    p = pd.DataFrame({
        "station_id": [f"s{i:04d}" for i in range(n)], "latitude": 40 + centre * 0.5 + rng.normal(0, 0.012, n),
        "longitude": 179.99 + rng.normal(0, 0.02, n), "altitude_m": np.where(rng.random(n) < 0.05, np.nan, rng.uniform(0, 900, n)),
        "network": rng.choice(["x", "y", "z"], n)})
    p.loc[n // 2:n // 2 + 20, ["latitude", "longitude", "altitude_m"]] = p.loc[0, ["latitude", "longitude", "altitude_m"]].to_list()  # copies
    if identifier:
        p["site_identifier"] = np.where(rng.random(n) < 0.1, rng.choice(["A", "B", "C"], n), None)
    schema = "station_id string, latitude double, longitude double, altitude_m double, network string" + (", site_identifier string" if identifier else "")
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), schema)
    found, membership = sites.build_sites(df, 1.0, 30.0, ("y",), ("z",), "site_identifier" if identifier else None)
    m = membership.toPandas().set_index("station_id").site_id
    want = pd.Series(brute_sites(p, 1.0, 30.0, identifier), index=p.station_id)
    assert (m.sort_index() == want.sort_index()).all()
    assert found.count() == want.nunique()


def test_level_disagreement_keeps_records_apart(spark):
    rows = [("a", 50.0, 1.0, 100.0, "n"), ("b", 50.001, 1.0, 140.0, "n"), ("c", 50.0, 1.001, 105.0, None)]
    df = spark.createDataFrame(rows, "station_id string, latitude double, longitude double, altitude_m double, network string")
    found, membership = sites.build_sites(df, 1.0, 30.0)
    groups = membership.groupBy("site_id").agg(F.sort_array(F.collect_list("station_id")).alias("m")).toPandas()
    assert sorted(map(tuple, groups.m)) == [("a", "c"), ("b",)]
    assert found.where("site_id = 'a'").head().networks == "n|unknown"


def test_representative_takes_first_present_value_per_column(spark):
    rows = [("a", 50.0, 1.0, None, "low"), ("b", 50.0, 1.0, 7.0, "high"), ("c", 50.0, 1.0, 9.0, "low")]
    df = spark.createDataFrame(rows, "station_id string, latitude double, longitude double, altitude_m double, network string")
    site = sites.build_sites(df, 1.0, 30.0, ("low",))[0].head()
    assert (site.station_id, site.altitude_m, site.n_members) == ("a", 9.0, 3)


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    hub = [("h", f"l{i:03d}") for i in range(80)]
    out = sites.connected_components(spark.createDataFrame(chain + hub, "a string, b string")).toPandas()
    assert out.component.nunique() == 2 and len(out) == 61 + 81
    assert out.set_index("node").component["n060"] == "n000"


def test_equal_area_cells_cover_the_sphere(spark):
    bands = geo.EqualAreaBands(500.0)
    total = 4 * np.pi * 6371.0088 ** 2
    assert sum(a * n for a, n in zip(bands.cell_areas_km2, bands.slices)) == pytest.approx(total)
    areas, counts = np.array(bands.cell_areas_km2), np.array(bands.slices)
    assert np.sqrt((counts * (areas / (total / counts.sum()) - 1) ** 2).sum() / counts.sum()) < 0.05
    df = spark.createDataFrame([(90.0, 10.0), (-90.0, -0.1), (0.0, 359.999), (0.0, -180.0), (0.0, 180.0)], "latitude double, longitude double")
    cells = [r.c for r in df.select(bands.cell_id(F.col("latitude"), F.col("longitude")).alias("c")).collect()]
    assert cells[0][:4] == f"b{bands.bands - 1:03d}" and cells[1][:4] == "b000" and cells[3] == cells[4]


def test_projection_on_the_central_meridian(spark):
    df = spark.createDataFrame([(40.0, 9.0), (0.0, 9.0), (40.0, 10.0)], "lat double, lon double")
    east, north = geo.transverse_mercator(F.col("lat"), F.col("lon"), 9.0)
    rows = df.select(east.alias("e"), north.alias("n")).collect()
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    lat = np.linspace(0, np.radians(40), 200001)
    arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5, lat)
    assert rows[0].e == pytest.approx(500000, abs=1e-6) and rows[0].n == pytest.approx(0.9996 * arc, abs=1e-3)
    assert rows[1].n == pytest.approx(0, abs=1e-6) and 585000 < rows[2].e < 586000


@pytest.fixture(scope="module")
def lattice():
    """A thinned Fibonacci lattice with a field of two waves."""
    k = np.arange(1500)
    pdf = pd.DataFrame({"source_id": k, "latitude": np.degrees(np.arcsin(1 - 2 * (k + 0.5) / 1500)), "longitude": k * 137.50776405 % 360 - 180})
    pdf["value"] = 4.0 + np.cos(np.radians(3 * pdf.latitude)) * np.sin(np.radians(2 * pdf.longitude + 25))
    return pdf


def test_kernel_against_all_distances(spark, lattice):
    places = [(11, -33.5, 179.9), (12, -33.5, -180.1), (13, 71.2, 25.8), (14, -88.9, 100.0), (15, 6.3, -52.4), (16, 71.2, 385.8)]
    targets = pd.DataFrame(places, columns=["target_id", "latitude", "longitude"])
    sigma = 640.0
    w = kernel.kernel_weights(spark.createDataFrame(targets), spark.createDataFrame(lattice[["source_id", "latitude", "longitude"]]), [sigma])
    field = spark.createDataFrame(lattice[["source_id", "value"]]).withColumn("time", F.lit(7)).withColumn("flat", F.lit(-2.5))
    smooth = kernel.apply_kernel(w, field, ["time"], "value").toPandas().set_index("target_id").smoothed
    flat = kernel.apply_kernel(w, field, ["time"], "flat").toPandas().smoothed
    assert np.abs(flat + 2.5).max() < 1e-12
    # One place under two names of its longitude.
    assert abs(smooth[13] - smooth[16]) < 1e-12
    for t in targets.itertuples():
        km = haversine(t.latitude, t.longitude, lattice.latitude, lattice.longitude)
        share = np.where(km <= 4 * sigma, np.exp(-0.5 * (km / sigma) ** 2) * np.maximum(np.cos(np.radians(lattice.latitude)), 0), 0.0)
        assert smooth[t.target_id] == pytest.approx((share * lattice.value).sum() / share.sum(), abs=1e-10)


def test_bilinear_has_no_wrap_and_clips(spark):
    grid = np.arange(12, dtype=float).reshape(3, 4) ** 1.5
    cells = spark.createDataFrame([(0, i, j, float(grid[i, j])) for i in range(3) for j in range(4)], "time int, lat_idx int, lon_idx int, value double")
    targets = pd.DataFrame({"target_id": range(5), "latitude": [10.0, 15.0, 19.9, 20.0, 12.5], "longitude": [0.0, 95.0, 355.0, 180.0, -10.0]})
    got = kernel.bilinear(cells, spark.createDataFrame(targets), ["time"], "value", 10.0, 5.0, 3, 0.0, 90.0, 4).orderBy("target_id").toPandas().interpolated
    lats, lons = 10 + 5.0 * np.arange(3), 90.0 * np.arange(4)
    for k, t in targets.iterrows():
        x = t.longitude % 360
        i = int(np.clip(np.searchsorted(lats, t.latitude) - 1, 0, 1))
        j = int(np.clip(np.searchsorted(lons, x) - 1, 0, 2))
        fy, fx = (t.latitude - lats[i]) / 5, (x - lons[j]) / 90
        want = (1 - fy) * ((1 - fx) * grid[i, j] + fx * grid[i, j + 1]) + fy * ((1 - fx) * grid[i + 1, j] + fx * grid[i + 1, j + 1])
        assert got[k] == pytest.approx(want)


def test_nearest_index_tie_goes_up_whatever_the_store_order(spark):
    df = spark.createDataFrame([(12.5, 359.0)], "lat double, lon double")
    up = df.select(kernel.nearest_index(F.col("lat"), [10.0, 15.0]).alias("i")).head().i
    down = df.select(kernel.nearest_index(F.col("lat"), [15.0, 10.0]).alias("i")).head().i
    assert (up, down) == (1, 0)
    assert df.select(kernel.nearest_index(F.col("lon"), [0.0, 90.0, 180.0, 270.0], True).alias("i")).head().i == 0


def test_planar_filter_keeps_constants(spark):
    df = spark.createDataFrame([(1, [3.0] * 30)], "id int, f array<double>")
    out = kernel.patch_structure(kernel.planar_smooth(df, "f", 5, 6, [100.0], 80.0, 60.0, ["id"]), ["id"], 5, 6, 1).head()
    assert out.roughness == pytest.approx(0, abs=1e-12)


def test_every_rule_of_the_risk_cascade(spark):
    columns = "station_id string, network string, latitude double, longitude double, altitude_m double, report_type string, documented_non_operational boolean, wmo_id string"
    reference = spark.createDataFrame([("ref-1", -41.3, 174.8, 12.0, "93434"), ("ref-2", 64.1, -179.995, 5.0, "25399")],
                                      "station_id string, latitude double, longitude double, altitude_m double, wmo_id string")
    registry = {"airfields": "potentially_assimilated", "gardens": "confirmed_independent", "schools": "low_risk_candidate"}
    rows = [("beside", "gardens", -41.302, 174.801, 20.0, "LOCAL", True, None, "potentially_assimilated"),
            ("over the dateline", "gardens", 64.1, 179.995, 6.0, "", True, None, "potentially_assimilated"),
            ("beside but high above", "gardens", -41.302, 174.801, 400.0, "", None, None, "confirmed_independent"),
            ("same number", "schools", 10.0, 10.0, 1.0, "LOCAL", True, "93434", "potentially_assimilated"),
            ("own number", "schools", 11.0, 10.0, 1.0, "LOCAL", True, "70001", "potentially_assimilated"),
            ("sends bulletins", "gardens", 12.0, 10.0, 1.0, "metar", True, None, "potentially_assimilated"),
            ("known network", "Airfields ", 13.0, 10.0, 1.0, "LOCAL", True, None, "potentially_assimilated"),
            ("documented", "schools", 14.0, 10.0, 1.0, "", True, None, "low_risk_candidate"),
            ("undocumented", "schools", 15.0, 10.0, 1.0, "", False, None, "unknown"),
            ("local type", "hobby", 16.0, 10.0, 1.0, "LOCAL", False, None, "low_risk_candidate"),
            ("no place", "gardens", None, None, 1.0, "", None, None, "confirmed_independent"),
            ("nothing known", None, 17.0, 10.0, None, None, None, None, "unknown")]
    out = risk.classify(spark.createDataFrame([r[:-1] for r in rows], columns), reference, registry, ("wmo_id",), 1.0, 30.0, ("METAR",), ("LOCAL",))
    assert {r.station_id: r.risk_class for r in out.collect()} == {r[0]: r[-1] for r in rows}


def test_segments_far_and_near(spark):
    rng = np.random.default_rng(4)
    seg = rng.uniform(0, 3e5, size=(12, 4))
    pts = rng.uniform(-5e5, 8e5, size=(40, 2))
    s = spark.createDataFrame(seg.tolist(), "ax double, ay double, bx double, by double")
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = neighbours.nearest_segment_km(p, s, "id").toPandas().set_index("id").distance_km
    for i, q in enumerate(pts):
        best = np.inf
        for ax, ay, bx, by in seg:
            v, w = np.array([bx - ax, by - ay]), q - [ax, ay]
            t = np.clip(w @ v / (v @ v), 0, 1)
            best = min(best, np.hypot(*(w - t * v)))
        assert got[i] == pytest.approx(best / 1000, rel=1e-9)


def test_points_without_a_segment_or_a_place_stay(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9e9, 0.0), (3, None, 1.0), (4, float("nan"), 1.0)], "id int, x double, y double")
    segments = spark.createDataFrame([(0.0, 3e3, 1e3, 3e3)], "ax double, ay double, bx double, by double")
    got = {r.id: r.distance_km for r in neighbours.nearest_segment_km(points, segments, "id").collect()}
    assert got[1] == pytest.approx(3.0) and got[2] == pytest.approx(9e6 - 1, rel=1e-6) and got[3] is None and got[4] is None
    none = neighbours.nearest_segment_km(points, segments.limit(0), "id").collect()
    assert {r.id: r.distance_km for r in none} == {1: None, 2: None, 3: None, 4: None}


def test_far_clusters_and_crowds_cost_little(spark):
    rng = np.random.default_rng(12)

    def cluster(lat, lon, n, spread):
        return pd.DataFrame({"id": range(n), "latitude": lat + rng.normal(0, spread, n), "longitude": lon + rng.normal(0, spread, n)})

    def tree(pdf):
        x = [np.cos(np.radians(pdf.latitude)) * np.cos(np.radians(pdf.longitude)), np.cos(np.radians(pdf.latitude)) * np.sin(np.radians(pdf.longitude)), np.sin(np.radians(pdf.latitude))]
        rows = list(zip(pdf.id.tolist(), *[c.tolist() for c in x], *[c.tolist() for c in x]))
        return box_tree.build(spark.createDataFrame(rows, "id long, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double"), "xyz")

    for left, right in ((cluster(40, 5, 600, 0.5), cluster(-30, 150, 600, 0.5)), (cluster(40, 5, 600, 1e-6), cluster(40, 5, 600, 1e-6)),
                        (cluster(10, 10, 600, 20), cluster(10, 10, 600, 20))):
        pairs = box_tree.candidates(tree(left), tree(right)).count()
        assert 600 <= pairs < 60 * 600
        got = {r.id: (r.nearest_id, r.nearest_km) for r in neighbours.nearest_match(spark.createDataFrame(left), spark.createDataFrame(right), "id", "id").collect()}
        for t in left.itertuples():
            km = haversine(t.latitude, t.longitude, right.latitude, right.longitude)
            assert got[t.id][1] == pytest.approx(km.min(), rel=1e-6, abs=1e-9) and km[got[t.id][0]] == pytest.approx(km.min(), rel=1e-6, abs=1e-9)


def test_infinite_coordinates_have_no_neighbour(spark):
    inf = float("inf")
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, inf, 0.0), (3, 0.0, -inf), (4, 1e300, 0.0)], "id int, x double, y double")
    segments = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (inf, 0.0, 1.0, 1.0), (0.0, 5.0, None, 1.0)], "ax double, ay double, bx double, by double")
    got = {r.id: r.distance_km for r in neighbours.nearest_segment_km(points, segments, "id").collect()}
    assert got[1] == pytest.approx(0.001) and got[2] is None and got[3] is None and got[4] == pytest.approx(1e297)
    places = points.select("id", F.col("x").alias("latitude"), F.col("y").alias("longitude")).where("id < 4")
    near = {r.id: r.nearest_id for r in neighbours.nearest_match(places, places, "id", "id").collect()}
    assert near == {1: 1, 2: None, 3: None}
    assert [r.nearest_id for r in neighbours.nearest_match(places, places.limit(0), "id", "id").collect()] == [None] * 3


def test_nearest_match_keeps_every_point_and_crosses_cube_planes(spark):
    rng = np.random.default_rng(8)
    a = pd.DataFrame({"id": range(120), "latitude": 30.5 + rng.uniform(-0.2, 0.2, 120), "longitude": rng.uniform(-0.2, 0.2, 120)})
    b = pd.DataFrame({"id": range(120), "latitude": 30.5 + rng.uniform(-0.2, 0.2, 120), "longitude": 0.3 + rng.uniform(-0.1, 0.1, 120)})
    left = spark.createDataFrame([*a.itertuples(index=False, name=None), (900, None, 1.0), (901, float("nan"), 1.0)], "id long, latitude double, longitude double")
    got = {r.id: (r.nearest_id, r.nearest_km) for r in neighbours.nearest_match(left, spark.createDataFrame(b), "id", "id").collect()}
    assert len(got) == 122 and got[900] == (None, None) and got[901] == (None, None)
    for t in a.itertuples():
        km = haversine(t.latitude, t.longitude, b.latitude, b.longitude)
        assert got[t.id][0] == int(km.argmin()) and got[t.id][1] == pytest.approx(km.min())


def test_fine_cells_keep_their_numbers(spark):
    for size in (10.0, 4.0):
        bands = geo.EqualAreaBands(size)
        df = spark.createDataFrame([(0.0, 0.0), (50.0, 3.0), (50.1, 3.0), (89.0, 10.0), (-89.9, 359.9)], "lat double, lon double")
        cell = df.select("lat", "lon", bands.cell_id(F.col("lat"), F.col("lon")).alias("c"))
        lat, lon = bands.centre(F.col("c"))
        rows = cell.withColumns({"clat": lat, "clon": lon}).collect()
        assert len({r.c for r in rows}) == 5
        for r in rows:
            assert haversine(r.lat, r.lon, r.clat, r.clon) < size


def test_support_zero_is_the_centre_and_absent_values_leave_the_norm(spark):
    st = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.3), (3, 0.0, 5.0)], "station_id int, latitude double, longitude double")
    obs = spark.createDataFrame([(1, 1, 10.0), (2, 1, 20.0), (3, 1, 99.0), (1, 2, None), (2, 2, 30.0)], "station_id int, t int, v double")
    pairs = support.support_pairs(st, (0.0, 50.0), ("uniform",))
    got = {(r.centre_id, r.t, r.support_km): r.target for r in support.support_targets(obs, pairs, ["t"], "v", (0.0, 50.0), ("uniform",)).collect()}
    assert got[(1, 1, 0.0)] == 10.0 and got[(1, 1, 50.0)] == 15.0 and got[(1, 2, 50.0)] == 30.0 and (1, 2, 0.0) not in got


def test_farthest_points_survives_many_picks(spark):
    p = points(60, 9).assign(altitude_m=0.0, n=np.arange(60))
    out = regions.farthest_points(spark.createDataFrame(p), "station_id", ("latitude", "longitude", "altitude_m"), "n", 40).toPandas()
    z = np.column_stack([(p[c] - p[c].mean()) / (p[c].std(ddof=0) or 1) for c in ("latitude", "longitude", "altitude_m")])
    chosen = [59]
    while len(chosen) < 40:
        gap = np.round(np.sqrt(((z[:, None] - z[chosen][None]) ** 2).sum(-1)).min(1), 9)
        gap[chosen] = -1
        chosen.append(int(np.flatnonzero(gap == gap.max())[0]))
    assert list(out.sort_values("pick").station_id) == [f"p{i:04d}" for i in chosen]


def test_the_first_column_owns_an_identifier(spark):
    reference = spark.createDataFrame([("b", "100", "7"), ("a", "200", "100"), ("c", "100", None), ("01234012345", None, None), ("d", "01234", None)], "station_id string, wmo_id string, isd_station_id string")
    wanted = spark.createDataFrame([(1, "100"), (2, "7"), (3, "12345"), (4, "01234"), (5, "a"), (6, "012340")], "station_id int, wmo_id string")
    got = {r.station_id: r.identifier_overlap_ids for r in risk.identifier_matches(wanted, reference, ("wmo_id",), ("wmo_id", "isd_station_id")).collect()}
    # 100 is b's and c's in the first column and a's in the second; parts of compound keys come last, bare ids are none.
    assert got == {1: "b", 2: "b", 3: "01234012345", 4: "d", 6: "01234012345"}


def test_a_target_without_a_source_fails(spark, lattice):
    grid = spark.createDataFrame([(1, 0.0, 0.0)], "source_id int, latitude double, longitude double")
    targets = spark.createDataFrame([(1, 0.0, 1.0), (2, 60.0, 100.0)], "target_id int, latitude double, longitude double")
    assert kernel.kernel_weights(targets.where("target_id = 1"), grid, [100.0]).count() == 1
    with pytest.raises(Exception, match="no source within reach of target 2"):
        kernel.kernel_weights(targets, grid, [100.0]).collect()


def test_lloyd_reaches_a_fixed_point(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (6, 1), (2, 8))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(900, None, 1.0)], "id int, x double, y double")
    centres = regions.lloyd(df.where("x is not null"), ("x", "y"), [tuple(xy[0]), tuple(xy[1]), tuple(xy[50])])
    own = ((xy[:, None] - np.array(centres)[None]) ** 2).sum(-1).argmin(1)
    for k in range(3):
        assert np.allclose(xy[own == k].mean(0), centres[k], atol=1e-8)
    rows = regions.kmeans_regions(df, "id", "x", "y", 3).collect()
    assert {r.region for r in rows if r.id < 40} == {"r02"} and {r.region for r in rows if 40 <= r.id < 80} == {"r01"} and {r.region for r in rows if 80 <= r.id < 120} == {"r00"}
    assert [r.region for r in rows if r.id == 900] == [None]
