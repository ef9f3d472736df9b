"""Headers, encodings and admission of telemetry files; sinks."""

import pytest
from pyspark.sql import functions as F

from roadlens.operators import cleaning
from roadlens.sources import columns, sinks, telemetry_files


@pytest.mark.parametrize(
    "header, want",
    [
        (["Timestamp", "Vehicle Speed Sensor [km/h]", "Engine RPM [RPM]", "Absolute Throttle Position [%]"], {"timestamp": "Timestamp", "speed": "Vehicle Speed Sensor [km/h]", "rpm": "Engine RPM [RPM]", "throttle": "Absolute Throttle Position [%]"}),
        (["Time", "Speed (OBD)(km/h)", "Trip Distance(km)"], {"speed": "Speed (OBD)(km/h)", "trip_distance": "Trip Distance(km)", "timestamp": "Time"}),
        (["User ID", "Trip ID", "Speed (km/h)", "speed"], {"speed": "Speed (km/h)", "user_id": "User ID", "trip_id": "Trip ID"}),
    ],
)
def test_mapping(header, want):
    assert columns.mapping(header) == want


def test_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,Speed (km/h),rpm\n2024-01-01 00:00:00,\"50,5 km/h\",800 RPM\n2024-01-01 00:00:01,nan,x\n")
    (tmp_path / "b.CSV").write_bytes("Time,speed,Engine Coolant Temperature(°C)\n2024-01-01 00:00:00,1,2\n".encode("latin-1"))
    (tmp_path / "two.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("a,b,c\n")
    (tmp_path / "sub dir ü").mkdir()
    (tmp_path / "sub dir ü" / "zero.csv").write_bytes(b"")
    samples, files = telemetry_files.read(spark, str(tmp_path))
    states = {r["path"].rsplit("/")[-1]: (r["encoding"], r["reject_reason"]) for r in files.collect()}
    assert states == {"a.csv": ("UTF-8", None), "b.CSV": ("ISO-8859-1", None), "two.csv": ("UTF-8", "too few columns"), "empty.csv": ("UTF-8", "empty"), "zero.csv": (None, "zero bytes")}
    assert sorted((r["speed"], r["rpm"], r["coolant_temp"]) for r in samples.fillna(-1.0).collect()) == [(-1.0, -1.0, -1.0), (1.0, -1.0, 2.0), (50.5, 800.0, -1.0)]


def test_no_files(spark, tmp_path):
    (tmp_path / "two.csv").write_text("a,b\n1,2\n")
    samples, _ = telemetry_files.read(spark, str(tmp_path))
    assert samples.count() == 0 and "speed" in samples.columns


def test_vehicle_numbers(spark):
    rows = [("mp09 ab1234",), ("(MH12-cd 5678)",), ("ka 01  ef--9012",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(cleaning.vehicle_standard(F.col("v"))).collect()]
    assert got == ["MP09-AB1234", "MH12-CD-5678", "KA-01-EF-9012", "", None]


def test_alerts_are_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 6)], "trip_id long, alert_type string, value int")
    path = str(tmp_path / "alerts")
    sinks.append_alerts(rows.filter("trip_id = 1"), path)
    sinks.append_alerts(rows, path)
    assert sinks.stored(spark, path).count() == 2
    sinks.append(rows, path, "other writer")  # who saw nothing stored
    assert sorted(map(tuple, sinks.stored_alerts(spark, path).collect())) == [(1, "a", 5), (2, "b", 6)]


def test_batch_survives_failures(spark, data, tmp_path, monkeypatch):
    """A batch that fails before its commit leaves nothing, one that is tried again after it is stored once."""
    from roadlens.sources import views as V

    trips, path = V.trips(spark, data), str(tmp_path / "trips")
    n, moved = trips.count(), sinks._moved
    sinks.append_trips(trips.filter("id % 2 = 0"), path, "one")
    with monkeypatch.context() as m:
        m.setattr(sinks, "_moved", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sinks.append_trips(trips.filter("id % 2 = 1"), path, "two")
    assert sinks.stored(spark, path).count() < n
    for _ in range(2):
        sinks.append_trips(trips.filter("id % 2 = 1"), path, "two")
    assert sinks.stored(spark, path).count() == n and sinks.stored(spark, path).select("id").distinct().count() == n
    # two writers of one batch, both past the first look: one commits
    for k in range(2):
        trips.limit(3).withColumn("trip_month", F.lit("2000-01")).write.partitionBy("trip_month").parquet(f"{path}/_staged/x{k}")
    assert [moved(spark, f"{path}/_staged/x{k}", f"{path}/batch=three") for k in range(2)] == [True, False]
    assert not sinks.append(trips.limit(3), path, "three")
    assert sinks.stored(spark, path).count() == n + 3


def test_dry_run_writes_nothing(spark, data, tmp_path):
    from roadlens.sources import views as V

    trips = V.trips(spark, data)
    assert sinks.append_trips(trips, None) is trips and not any(tmp_path.iterdir())


def test_places_and_paths(spark):
    from roadlens.functions import places

    texts = ["1.5,2", " -90 , 180 ", "91,0", "0,181", "a,b", "1,2,3", "", None, "NaN,1", "1e1,2E0"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] and tuple(r[0]) for r in rows.select(places.place(F.col("t"))).collect()]
    assert got == [(1.5, 2.0), (-90.0, 180.0), None, None, None, None, None, None, None, (10.0, 2.0)]
    paths = ["[1.5,2.0]", "[0.0,0.0],[0.0,90.0],[90.0,0.0]", "[1,2", "[1,2],", "[1,2][3,4]", "[1,2],[95,0]", "path_to_gps_data", "[]", None, "[[1,2]]"]
    rows = spark.createDataFrame([(t,) for t in paths], "t string").select("t", places.path(F.col("t")).alias("p"))
    got = rows.select("t", places.path_text(F.col("p")).alias("again"), places.length_km(F.col("p")).alias("km")).collect()
    assert [r["again"] for r in got] == [*paths[:2], *[None] * 8]
    assert got[0]["km"] == 0 and abs(got[1]["km"] - 6371 * 3.141592653589793) < 1e-6 and all(r["km"] is None for r in got[2:])


def test_export_falls_back_to_all(spark, data, tmp_path):
    from roadlens.sources import views as V

    trips = V.trips(spark, data)
    sinks.export(trips, trips.limit(0), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == trips.count()


def test_late_first_row(spark, tmp_path):
    """A header or blank beginning of any length doesn't make a file empty."""
    wide = ",".join(f"column_{k}" for k in range(9000))
    (tmp_path / "wide.csv").write_text(f"{wide}\n" + ",".join("1" * 9000) + "\n")
    (tmp_path / "late.csv").write_text("a,b,c\r\n" + "\r\n" * 70_000 + "1,2,3\r\n")
    (tmp_path / "blank.csv").write_text("a,b,c\n" + "  \n" * 70_000)
    (tmp_path / "nothing.csv").write_text("\n")
    (tmp_path / "latin.csv").write_bytes("a,b,°\n1,2,é\n".encode("latin-1"))
    found = {r["path"].rsplit("/", 1)[1]: r for r in telemetry_files.manifest(spark, str(tmp_path)).collect()}
    assert {k: r["reject_reason"] for k, r in found.items()} == {"wide.csv": None, "late.csv": None, "blank.csv": "empty", "nothing.csv": "empty", "latin.csv": None}
    assert found["wide.csv"]["header"] == wide and found["late.csv"]["header"] == "a,b,c"
    assert (found["latin.csv"]["header"], found["latin.csv"]["encoding"]) == ("a,b,°", "ISO-8859-1")


def test_splits(spark, tmp_path):
    """Files cut into many splits keep their rows, order, header and encoding; one bad byte anywhere decides the encoding."""
    rows = "".join(f"2024-01-01 00:00:00,{k},x,{k % 7}\n" for k in range(4000))
    (tmp_path / "a.csv").write_text("\ufeffTime,speed,note,rpm\r\n" + rows.replace("\n", "\r\n"))
    (tmp_path / "b.csv").write_bytes(b"speed,Time,rpm\n" + b"".join(b"%d,2024-01-01 00:00:00,1\n" % k for k in range(4000)) + b"1,\xe9,2\n")
    (tmp_path / "c.csv").write_text('driver,"speed",rpm\n"a ""b"", c",1,2\n\n   \ndriver,"speed",rpm\nd,2\ne,3,4,5,6\n')
    (tmp_path / "none.csv").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        samples, files = telemetry_files.read(spark, str(tmp_path))
        got = {}
        for r in samples.orderBy("source_file", "ordinal").collect():
            got.setdefault(r["source_file"].rsplit("/", 1)[1], []).append(r)
        found = {r["path"].rsplit("/", 1)[1]: r for r in files.collect()}
        assert samples.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: (r["encoding"], r["n_rows"], r["reject_reason"]) for k, r in found.items()} == {
        "a.csv": ("UTF-8", 4000, None), "b.csv": ("ISO-8859-1", 4001, None), "c.csv": ("UTF-8", 4, None), "none.csv": (None, 0, "zero bytes"),
    }
    assert [r["speed"] for r in got["a.csv"]] == list(range(4000)) and [r["rpm"] for r in got["a.csv"]] == [k % 7 for k in range(4000)]
    assert [r["speed"] for r in got["b.csv"]] == [*range(4000), 1] and got["b.csv"][-1]["timestamp"] == "é"
    assert [(r["user_id"], r["speed"], r["rpm"]) for r in got["c.csv"]] == [(None, 1.0, 2.0), (None, 2.0, None), (None, 3.0, 4.0)]


def test_paths_too_many_to_send(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("Time,speed,rpm\n1,2,3\n")
    monkeypatch.setattr(telemetry_files, "PATH_BYTES", 0)
    samples, _ = telemetry_files.read(spark, str(tmp_path))
    assert [(r["speed"], r["rpm"]) for r in samples.collect()] == [(2.0, 3.0)]


def test_ingest_plans(spark, tmp_path):
    """No file is read whole and no line is shuffled."""
    (tmp_path / "a.csv").write_text("Time,speed,rpm\n1,2,3\n")
    samples, _ = telemetry_files.read(spark, str(tmp_path))
    text = samples._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in text and "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Python" not in text
