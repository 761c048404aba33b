"""Reading, writing, names, catalogues, options and the whole chain."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom import sensors
from rainloom.functions import fall_velocity
from rainloom.plans import options, pipeline, summary
from rainloom.sources import files

T0 = datetime(2020, 1, 31, 23, 58)


def test_products(spark, tmp_path):
    df = spark.createDataFrame([("A", T0 + timedelta(minutes=k), k, 1.0) for k in range(5)], "station_id string, time timestamp, N int, R double")
    path = str(tmp_path / "L1")
    files.write_product(df, path, ["station_id"], "year/month")
    with pytest.raises(Exception):
        files.write_product(df, path, ["station_id"], "year/month")
    files.write_product(df.where("N > 3"), path, ["station_id"], "year/month", force=True)  # only that month is replaced
    assert sorted(r.N for r in files.open_table(spark, path, ["N"]).collect()) == [0, 1, 4]
    found = files.open_dataset(spark, str(tmp_path), "L1", start="2020-02-01 00:00:00", variables=["N"])
    assert [r.N for r in found.collect()] == [4] and found.columns == ["station_id", "time", "N"]
    assert files.remove_product(spark, path) and not files.remove_product(spark, path)


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x;1\ny;2;3\nz;4\n")
    rows = files.read_delimited(spark, str(tmp_path / "a.txt"), ["a", "b"], ";")
    assert sorted((r.a, r.b) for r in rows.where("_corrupt_record is null").collect()) == [("x", "1"), ("z", "4")] and rows.count() == 3
    lines = files.read_lines(spark, str(tmp_path / "a.txt"))
    assert [r.payload for r in lines.orderBy("line_no").collect()] == ["x;1", "y;2;3", "z;4"]
    assert [r.c for r in files.fixed_width(lines, {"c": (2, 3)}, skip=1).orderBy("line_no").collect()] == ["2", "4"]
    assert files.csv_options({"delimiter": ";", "dtype": "str"}) == {"sep": ";"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2020-01-01 00:00:00;5\n")
    files.register_reader("RD80", "TEST/ONE")(files.delimited_reader(["t", "n"], ";", F.try_to_timestamp("t"), ["n"]))
    assert files.available_readers("RD80", "TEST") == ["TEST/ONE"]
    row = files.reader("RD80", "TEST/ONE")(spark, [str(tmp_path / "a.txt")]).first()
    assert (row.time, row.n) == (datetime(2020, 1, 1), "5")
    with pytest.raises(ValueError):
        files.reader("RD80", "TEST/TWO")


def test_names(spark):
    name = files.define_filename("L2M", "CAMP_X", "ST1", datetime(2020, 1, 1), datetime(2020, 1, 2), "ROLL5MIN", "GAMMA_ML")
    parts = files.parse_filename("/a/b/" + name)
    assert parts["product"] == "L2M" and parts["model"] == "GAMMA_ML" and parts["resolution"] == "ROLL5MIN" and parts["station_name"] == "ST1"
    row = spark.createDataFrame([("/a/" + name,), ("other.txt",)], "p string").select(*[c.alias(n) for n, c in files.filename_columns(F.col("p")).items()]).collect()
    assert row[0].campaign_name == "CAMP_X" and row[0].start_time == datetime(2020, 1, 1) and row[1].product is None


def test_catalogue(spark, tmp_path):
    (tmp_path / "s1.yml").write_text("data_source: EPFL\ncampaign_name: C\nstation_name: '10'\nsensor_name: PARSIVEL\nmeasurement_interval: 30\nlatitude: 46.5\nlongitude: 6\nplatform_type: fixed\ndeployment_status: ongoing\narchive_data_url: http://x\nowner: me\n")
    (tmp_path / "s2.yml").write_text("data_source: X\ncampaign_name: D\nstation_name: b\nsensor_name: Nope\nlatitude: 99\n")
    stations = files.read_metadata(spark, str(tmp_path)).cache()
    assert stations.where("station_name = '10'").first().measurement_interval == [30] and stations.where("station_name = '10'").first().extra["owner"] == "me"
    assert [r.station_name for r in files.select_stations(stations, data_sources="EPFL", sensor_name=["PARSIVEL"]).collect()] == ["10"]
    assert files.select_stations(stations, with_url=True).count() == 1
    assert {r.rule for r in files.metadata_violations(stations).where("station_name = 'b'").collect()} == {"sensor_name is unknown", "latitude is out of bounds", "deployment_status is unknown", "measurement_interval is missing"}
    assert files.metadata_violations(stations).where("station_name = '10'").count() == 0


def test_issues(spark):
    times, periods = files.read_issues(spark, "timesteps:\n- 2020-01-01 00:00:00\ntime_periods:\n- [2020-01-02 00:00:00, 2020-01-03 00:00:00]\n")
    assert times.first().time == datetime(2020, 1, 1) and periods.first().end == datetime(2020, 1, 3)
    assert [f.count() for f in files.read_issues(spark, "")] == [0, 0]
    for bad in ("other: 1", "time_periods:\n- [2020-01-04 00:00:00, 2020-01-03 00:00:00]"):
        with pytest.raises(ValueError):
            files.read_issues(spark, bad)


def test_options():
    found = options.product_options("L2E", "PARSIVEL", "5MIN", {"global": {"product_options": {"minimum_nbins": 2}}, "PARSIVEL": {"product_options": {"minimum_nbins": 3}}, "5MIN": {"archive_options": {"strategy": "event"}}})
    assert found["product_options"]["minimum_nbins"] == 3 and found["product_options"]["minimum_ndrops"] == 1 and found["archive_options"]["strategy"] == "event"
    with pytest.raises(ValueError):
        options.product_options("L2E", layers={"global": {"product_options": {"fall_velocity_model": "none"}}})
    assert options.is_possible("5MIN", 60) and not options.is_possible("ROLL1MIN", 60) and not options.is_possible("90S", 60)


def test_chain(spark, tmp_path):
    random = np.random.default_rng(0)
    d, v = sensors.diameter_bins("PARSIVEL2"), sensors.velocity_bins("PARSIVEL2")
    speed = np.nan_to_num(fall_velocity.rain_speed(d.center))
    rows = []
    for k in range(10):
        m = np.zeros((32, 32), int)
        for i in range(3, 22):
            for x in random.normal(speed[i], 0.2, random.poisson(900 * np.exp(-2.5 * d.center[i]) * d.width[i])):
                m[np.searchsorted(v.upper, max(x, 0)), i] += 1
        rows.append(("A", datetime(2020, 1, 1) + timedelta(minutes=k), ",".join(map(str, m.ravel())), "60", "12.5"))
    raw = spark.createDataFrame(rows, "station_id string, time timestamp, raw_drop_number string, sample_interval string, sensor_temperature string")
    run = pipeline.Run("PARSIVEL2", [60], ["1MIN", "5MIN"], {"M": {"psd_model": "GammaPSD", "optimization": "MOM", "methods": ["M346"]}}, archive=str(tmp_path))
    made = run.all(raw)
    assert set(made) == {"L0A", "L0B", "L0C", "L1_1MIN", "L1_5MIN", "L2E_1MIN", "L2E_5MIN", "L2M_M_1MIN", "L2M_M_5MIN"}
    l2e = made["L2E_1MIN"].where("velocity_method = 'theoretical_velocity'").orderBy("time").collect()
    assert len(l2e) == 10 and all(abs(r.R - r.Rm) < 1e-9 and r.hydrometeor_type == 2 for r in l2e)
    five = made["L2E_5MIN"].where("velocity_method = 'theoretical_velocity'").orderBy("time").collect()
    # Times end their interval: the first is alone in its block, the last block lacks one step.
    assert [r.N for r in five] == [l2e[0].N, sum(r.N for r in l2e[1:6]), sum(r.N for r in l2e[6:])] and [r.qc_resampling for r in five] == [0.8, 0.0, 0.2]
    assert five[1].R == pytest.approx(sum(r.R for r in l2e[1:6]) / 5)
    assert made["L2M_M_1MIN"].count() > 0 and run.failures == {}
    tables = run.summary(made["L2E_1MIN"], "1MIN")
    assert set(tables) == set(summary.TABLES)
    clean = [r for r in l2e if r.Nbins >= 3 and r.sigma_m >= 0.2 and r.Nbins_missing_fraction <= 0.3 and r.Dmin <= 1 and r.R > 0.01]
    cells = tables["spectrum"].where("column = 'drop_number'").orderBy("cell").collect()
    assert clean and [c.total for c in cells] == [sum(r.drop_number[k] for r in clean) for k in range(len(cells))]
    assert tables["rain"].first().n_rainy_minutes == len([r for r in l2e if r.R > 0])
    assert {r.variable: round(r.MAX, 2) for r in tables["distributions"].collect()}["R"] == round(max(r.R for r in clean), 2)
    assert tables["points"].count() == sum(x != 0 for r in clean for x in r.drop_number_concentration)
    assert spark.read.parquet(str(tmp_path / "SUMMARY" / "1MIN" / "events")).columns == tables["events"].columns


def test_failures_are_told(spark):
    """A product that cannot be made, and what needs it, are left out; nothing is raised."""
    run = pipeline.Run("PARSIVEL2", [60])
    assert run.all(spark.createDataFrame([("A",)], "station_id string")) == {} and set(run.failures) == {"L0A"}


def test_guarded(spark):
    result, error = pipeline.guarded(lambda s: s.read.parquet("/none"), spark)
    assert result is None and error


def test_lines_of_a_split_file(spark, tmp_path):
    """A file read in many parts numbers its lines as one read whole does."""
    (tmp_path / "a.txt").write_text("".join(f"line {k}\n" for k in range(3_000)))
    (tmp_path / "b.txt").write_text("only\n\nthree")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = {r.line_no: r.payload for r in rows if r.file_path.endswith("a.txt")}
    assert a == {k + 1: f"line {k}" for k in range(3_000)}
    assert sorted((r.line_no, r.payload) for r in rows if r.file_path.endswith("b.txt")) == [(1, "only"), (2, ""), (3, "three")]
