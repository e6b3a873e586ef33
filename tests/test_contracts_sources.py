"""Contracts, findings, file readers and records."""

import gzip
import datetime as dt
import json
import os
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verispark.functions import calendar as cal
from verispark.functions import quality, text
from verispark.operators import audit, contracts, contrast, panel, regression, score
from verispark.session import scratch_path
from verispark.sources import archives, chunks, records, reports, tables


def test_columns_and_cardinality(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert contracts.checked_join(a, b, ["k"], "many_to_one").count() == 3
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(a, b, ["k"], "one_to_one")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(a, ["nope"])
    with pytest.raises(contracts.ContractError):
        contracts.exact_columns(a, ["k"])
    assert contracts.guarded_join(a, b, ["k"]).count() == 3
    with pytest.raises(Exception, match="repeats"):
        contracts.guarded_join(b, a, ["k"]).collect()
    assert contracts.same_keys(a, b, ["k"]).isEmpty()


def test_first_per_key_on_a_key_that_owns_everything(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), (F.col("id") % 97).alias("o"), F.col("id").alias("v"))
    row = contracts.first_per_key(df, ["k"], ["o", "v"]).head()
    assert (row.o, row.v) == (0, 0)


def test_common_cases_and_support(spark):
    rows = [("s1", 1, "a", 1.0), ("s1", 1, "b", 2.0), ("s1", 2, "a", 1.0), ("s2", 1, "a", 1.0), ("s2", 1, "b", None)]
    df = spark.createDataFrame(rows, "site string, t int, model string, x double")
    assert {(r.site, r.t) for r in panel.common_cases(df, ["site", "t"], "model").collect()} == {("s1", 1), ("s2", 1)}
    assert {(r.site, r.t) for r in panel.common_support(df, ["site", "t"], ["x"], "model", 2).collect()} == {("s1", 1)}


def test_three_rmse_flavours_differ(spark):
    rows = [(1, 0.0, 3.0), (1, 0.0, 1.0), (2, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "day int, f double, r double").withColumn("g", F.lit("m"))
    row = score.day_weighted(score.daily_components(df, ["g"], "day", "f", "r"), ["g"]).head()
    assert row.rmse_cases == pytest.approx(np.sqrt(14 / 3))
    assert row.rmse_daily_mean == pytest.approx((np.sqrt(5) + 2) / 2)
    assert row.rmse_day_weighted == pytest.approx(np.sqrt(4.5))


def test_findings(spark):
    st = spark.createDataFrame([(95.0, 10.0, 0.0), (None, 1.0, 9000.0), (0.0, 0.0, None)], "latitude double, longitude double, altitude_m double")
    got = {r.check: r.severity for r in audit.coordinate_findings(st).unionByName(audit.elevation_findings(st)).collect()}
    assert got == {"coordinates_present": "fail", "coordinates_in_range": "fail", "coordinates_not_swapped": "fail", "coordinates_not_null_island": "warn",
                   "elevation_present": "fail", "elevation_plausible": "fail", "elevation_not_sentinel_zero": "warn"}
    assert audit.elevation_findings(st.drop("altitude_m")).head().severity == "fail"
    for values, want in (([280.0, 290.0], "fail"), ([60.0, 70.0], "fail"), ([10.0, float("nan")], "pass"), ([None], "unknown")):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert audit.temperature_unit_finding(df, "v").head().severity == want


def test_leave_one_out_sums_equal_refits(spark):
    rng = np.random.default_rng(0)
    rows = [(f"u{rng.integers(5)}", int(rng.integers(6)), float(rng.normal())) for _ in range(80)] + [("u9", 99, 5.0)]
    df = spark.createDataFrame(rows, "u string, d int, x double")
    got = {r.held_out: r.x for r in contrast.leave_one_out_days(df, "u", "d", ["x"]).collect()}
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=["u", "d", "x"])
    for u in pdf.u.unique():
        assert got[u] == pytest.approx(pdf[pdf.u != u].groupby("d").x.mean().mean())


def test_regressions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    y = x @ [1.0, -2.0, 0.3] + rng.normal(size=40)
    df = spark.createDataFrame([("g", *map(float, row), float(v)) for row, v in zip(x, y)], "g string, a double, b double, c double, y double")
    got = {r.covariate: r for r in regression.standardised_regression(df, ["g"], "y", ["a", "b", "c"]).collect()}
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    beta = np.linalg.lstsq(z, t, rcond=None)[0]
    assert [got[k].standardised_beta for k in "abc"] == pytest.approx(list(beta))
    assert got["a"].r_squared == pytest.approx(1 - ((t - z @ beta) ** 2).sum() / (t ** 2).sum())
    flat = spark.createDataFrame([("g", "u1", 1.0, 2.0), ("g", "u2", 1.0, 3.0), ("g", "u3", 2.0, 5.0)], "g string, u string, x double, y double")
    out = {r.excluded: (r.slope, r.informative) for r in regression.leave_one_out_slopes(flat, ["g"], "u", "x", "y").collect()}
    assert out["u3"] == (None, False) and out["u1"][0] == pytest.approx(2.0)
    assert flat.limit(1).agg(regression.guarded_slope("y", "x").alias("s")).head().s is None


def test_ties_go_to_the_first_model(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "`r__zeta` double, `r__alpha` double")
    assert df.select(contrast.best_of(["zeta", "alpha"], "r").alias("w")).head().w == "zeta"
    curve = spark.createDataFrame([("m", 0.0, 0.1 + 0.2), ("m", 25.0, 0.3)], "m string, s double, v double")
    assert contrast.optimum(curve, ["m"], "s", "v").head().optimal_sigma == 0.0


def test_scorecard_inversions(spark):
    rows = [("g", 0.0, "a", 1.0), ("g", 0.0, "b", 2.0), ("g", 0.0, "c", 3.0), ("g", 9.0, "a", 3.0), ("g", 9.0, "b", 2.0), ("g", 9.0, "c", 1.0)]
    card = {r.s: r for r in contrast.scorecard(spark.createDataFrame(rows, "g string, s double, model string, score double"), ["g"], "s", ["a", "b", "c"]).collect()}
    assert (card[9.0].ranking, card[9.0].inversions_vs_point, card[9.0].spearman_vs_point, card[9.0].winner_changed) == ("c|b|a", 3, -1.0, True)
    assert card[0.0].winner_margin == 1.0


def test_text_and_time_functions(spark):
    df = spark.createDataFrame([(" ab 1 ", "Sí", "1,5", "[0 1]", "9999-99-99"), ("N/A", None, "x", None, "2020-13-01")], "i string, t string, n string, m string, d string")
    rows = df.select(text.clean_identifier(F.col("i")).alias("i"), text.truthy(F.col("t")).alias("t"), text.decimal_comma(F.col("n")).alias("n"),
                     quality.mask_flag(F.col("m")).alias("m"), cal.open_ended_date(F.col("d")).alias("d")).collect()
    assert tuple(rows[0]) == ("AB1", True, 1.5, False, None) and tuple(rows[1]) == (None, False, None, None, None)
    v = spark.createDataFrame([("01234012345",), ("72000099999",), ("x",)], "i string").select(text.identifier_variants(F.col("i")).alias("v")).collect()
    assert v[0].v == ["01234012345", "012340", "12345", "01234"] and v[1].v == ["72000099999", "720000", "72000"] and v[2].v == ["X"]
    s = spark.createDataFrame([(3.5,), (-12.25,)], "v double").select(text.signed_fixed(F.col("v")).alias("s")).collect()
    assert [r.s for r in s] == ["+03.5000", "-12.2500"]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "k int, x double")
    tables.write_table(tables.nan_to_null(df), path, sort_by=["k"])
    assert [r.x for r in spark.read.parquet(path).orderBy("k").collect()] == [None, 3.0]
    with pytest.raises(Exception):
        tables.write_table(df, path)
    assert tables.table_exists(spark, path) and not tables.table_exists(spark, path + "x")
    assert tables.materialise(df.limit(0), path).count() == 2
    assert tables.describe(df) == [("k", "int"), ("x", "double")]
    tables.write_csv(df, str(tmp_path / "c"), sort_by=["k"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_csv_readers(spark, tmp_path):
    (tmp_path / "007.csv").write_text("DATE,TMP\n2020-01-01 00:00:00,1.5\nbad,2\n")
    out = reports.read_station_csv(spark, str(tmp_path / "*.csv"), "DATE string, TMP double").collect()
    assert {r.station_id for r in out} == {"007"} and len(out) == 2
    (tmp_path / "meta.txt").write_text("station_id,height\n0042,3.5\n")
    meta = reports.read_metadata_csv(spark, str(tmp_path / "meta.txt"), ["station_id"])
    assert meta.head().station_id == "0042" and dict(meta.dtypes)["height"] == "double"
    (tmp_path / "latin.txt").write_bytes("ESTAÇÃO:;SÃO JOSÉ\n".encode("latin-1"))
    assert reports.read_lines(spark, str(tmp_path / "latin.txt"), "ISO-8859-1").head().line == "ESTAÇÃO:;SÃO JOSÉ"


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("produkt_1.txt", "STATIONS_ID;MESS_DATUM;Q;T\n   44;2020010100;    3;  1.5;eor\n")
        z.writestr("Metadaten.txt", "x")
    lines = archives.read_zip_lines(spark, str(tmp_path / "a.zip"), prefix="produkt_")
    row = reports.parse_product_lines(lines, 0, 1, 2, 3).head()
    assert (row.native_station_id, row.qc_level, row.value) == ("00044", 3.0, 1.5)
    assert not archives.safe_member("../x") and not archives.safe_member("/x") and archives.safe_member("a/b.txt")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(Exception, match="unsafe"):
        archives.read_zip_lines(spark, str(tmp_path / "b.zip"), single=False).collect()


@pytest.mark.parametrize("codec", [None, "zlib", "gzip", "zstd"])
def test_chunk_store(spark, tmp_path, codec):
    data = np.arange(5 * 2 * 3 * 4, dtype="<f4").reshape(5, 2, 3, 4)
    stored = np.ascontiguousarray(np.swapaxes(data, 2, 3))  # longitude first
    pack = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress}
    if codec == "zstd":
        import zstandard
        pack["zstd"] = zstandard.ZstdCompressor().compress
    root = tmp_path / "store"
    (root / "t2m").mkdir(parents=True)
    (root / "latitude").mkdir()
    comp = {"id": codec} if codec else None
    meta = {"t2m/.zarray": {"shape": [5, 2, 4, 3], "chunks": [2, 1, 4, 3], "dtype": "<f4", "order": "C", "compressor": comp},
            "t2m/.zattrs": {"_ARRAY_DIMENSIONS": ["time", "lead", "longitude", "latitude"]},
            "latitude/.zarray": {"shape": [3], "chunks": [2], "dtype": "<f8", "order": "C", "compressor": comp}}
    (root / ".zmetadata").write_text(json.dumps({"metadata": meta}))
    for i in range(3):
        for j in range(2):
            block = np.zeros((2, 1, 4, 3), "<f4")
            part = stored[2 * i:2 * i + 2, j:j + 1]
            block[:len(part)] = part
            (root / "t2m" / f"{i}.{j}.0.0").write_bytes(pack[codec](block.tobytes()))
    for i, values in enumerate(([10.0, 15.0], [20.0, 0.0])):
        (root / "latitude" / str(i)).write_bytes(pack[codec](np.array(values, "<f8").tobytes()))
    got = archives.read_chunked_field(spark, str(root), "t2m").toPandas()
    assert len(got) == data.size
    assert (got.value.to_numpy() == data[got.time_idx, got.lead_idx, got.lat_idx, got.lon_idx]).all()
    assert archives.read_coordinate(spark, str(root), "latitude", archives.store_metadata(spark, str(root))) == [10.0, 15.0, 20.0]


def test_chunk_source_opens_only_what_filters_want(spark, tmp_path):
    origin, rng = dt.datetime(2021, 3, 1), np.random.default_rng(2)
    cells = [(t, k, i, j, float(rng.normal())) for t in range(50) for k in range(2) for i in range(2) for j in range(3) if rng.random() < 0.9 and t // 10 != 3]
    frame = spark.createDataFrame(cells, "time_idx int, lead_idx int, lat_idx int, lon_idx int, value double")
    root = str(tmp_path / "store")
    chunks.write_field(frame, root, "v", origin, 50, [0.0, 6.0], (2, 3), (10, 1))
    field = chunks.read_field(spark, root, "v")
    assert field.rdd.getNumPartitions() == 10
    got = {(r.valid_time, r.lead_h, r.lat_idx, r.lon_idx): r.value for r in field.where("not isnan(value)").collect()}
    assert got == {(origin + dt.timedelta(hours=t), 6.0 * k, i, j): v for t, k, i, j, v in cells}
    window = field.where((F.col("valid_time") >= origin + dt.timedelta(hours=12)) & (F.col("valid_time") < origin + dt.timedelta(hours=20)) & (F.col("lead_h") == 6.0))
    assert window.rdd.getNumPartitions() == 1
    for name in os.listdir(tmp_path / "store" / "v"):
        if name != "1.1.0.0":
            (tmp_path / "store" / "v" / name).write_bytes(b"unreadable")
    assert window.count() == 8 * 6
    assert field.where(F.col("lead_h").isin(6.0) & (F.col("valid_time") == origin + dt.timedelta(hours=13))).count() == 6
    assert field.where(F.col("valid_time") > origin + dt.timedelta(days=9)).count() == 0
    with pytest.raises(Exception, match="rror"):
        field.where(F.col("lead_h") == 0.0).count()


def test_chunk_source_reads_either_axis_order_and_three_axes(spark, tmp_path):
    data = np.arange(3 * 2 * 4, dtype="<f4").reshape(3, 4, 2)  # time, longitude, latitude
    root = tmp_path / "s"
    for folder in ("v", "time"):
        (root / folder).mkdir(parents=True)
    meta = {"v/.zarray": {"shape": [3, 4, 2], "chunks": [2, 4, 2], "dtype": "<f4", "order": "C", "compressor": None}, "v/.zattrs": {"_ARRAY_DIMENSIONS": ["time", "longitude", "latitude"]},
            "time/.zarray": {"shape": [3], "chunks": [3], "dtype": "<i8", "order": "C", "compressor": None}, "time/.zattrs": {"units": "days since 2020-01-01"}}
    (root / ".zmetadata").write_text(json.dumps({"metadata": meta}))
    (root / "time" / "0").write_bytes(np.arange(3, dtype="<i8").tobytes())
    for k in range(2):
        block = np.zeros((2, 4, 2), "<f4")
        block[:len(data[2 * k:2 * k + 2])] = data[2 * k:2 * k + 2]
        (root / "v" / f"{k}.0.0").write_bytes(block.tobytes())
    rows = chunks.read_field(spark, str(root), "v").collect()
    assert len(rows) == data.size and all(r.value == data[(r.valid_time - dt.datetime(2020, 1, 1)).days, r.lon_idx, r.lat_idx] for r in rows)


def test_zip_members_are_read_by_range(spark, tmp_path):
    long_lines = [f"line {i} é" for i in range(120_000)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.txt", "\r\n".join(long_lines).encode("latin-1"))
        z.writestr("two.txt", "x\n\ny", compress_type=zipfile.ZIP_STORED)
        z.writestr("empty.txt", "")
        z.writestr("other.bin", b"\x00" * 10)
    members = archives.zip_members(spark, str(tmp_path / "*.zip"), suffix=".txt", single=False).collect()
    assert sorted(m.member for m in members) == ["empty.txt", "one.txt", "two.txt"]
    lines = archives.read_zip_lines(spark, str(tmp_path / "*.zip"), suffix=".txt", single=False, batch=1000)
    got = {}
    for r in lines.collect():
        got.setdefault(r.member, []).append(r.line)
    assert got == {"one.txt": long_lines, "two.txt": ["x", "", "y"]}
    with open(tmp_path / "a.zip", "rb") as stream:
        pieces = list(archives.inflated(stream, next(m.header for m in members if m.member == "one.txt"), next(m.packed for m in members if m.member == "one.txt"), 8))
    assert max(map(len, pieces)) <= archives.PIECE


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1], [2, 0]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[50, 50], [51, 51]], [[1, 0], [1, 2]]]}}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    out = archives.read_geojson_segments(spark, str(tmp_path / "c.json"), -1, -1, 3, 3)
    assert out.count() == 3


def test_records(spark, tmp_path):
    parameters = {"a": {"x": 1}, "b": [1, 2], "free": 3}
    sealed = records.seal(parameters, ["a", "b"])
    assert records.seal_differences({**parameters, "free": 9}, sealed) == []
    assert records.seal_differences({**parameters, "b": [2, 1]}, sealed) == ["b"]
    doc = records.write_manifest(str(tmp_path / "m.json"), {"p": {"sha": "1"}}, parameters, {}, {}, {})
    records.verify_input({"sha": "1"}, doc, ["inputs", "p"])
    with pytest.raises(ValueError):
        records.verify_input({"sha": "2"}, doc, ["inputs", "p"])
    df = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    assert records.table_fingerprint(df, ["k", "v"]).head() == records.table_fingerprint(df.orderBy(F.desc("k")), ["k", "v"]).head()


def test_sign_test(spark):
    row = spark.range(1).select(contrast.sign_test(F.lit(9), F.lit(10)).alias("p"), contrast.sign_test(F.lit(0), F.lit(10)).alias("q")).head()
    assert row.p == pytest.approx(11 / 1024) and row.q == pytest.approx(1.0)


def test_a_path_without_scheme_belongs_to_the_default_store(spark, tmp_path):
    from verispark.session import qualified
    settings = spark._jsc.hadoopConfiguration()
    before = settings.get("fs.defaultFS")
    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}" and qualified(spark, f"file://{tmp_path}").startswith("file:/")
    try:
        settings.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
        settings.set("fs.defaultFS", "viewfs://store/")
        assert qualified(spark, "/in/stages") == "viewfs://store/in/stages"
    finally:
        settings.set("fs.defaultFS", before)
