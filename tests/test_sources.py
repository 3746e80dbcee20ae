"""File readers: quoted CSV with blanks, preamble CSV, tagged folders, versioned tables."""

import os

import pytest

from cabmart.sources import files, schemas, tables


def test_csv_blank_before_quote(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "vendor.csv")
    with open(p, "w") as f:
        f.write('id,vendor\n1, "Creative Mobile Technologies, LLC"\n2, "Curb Mobility, LLC"\n7, "Helix"\n')
    rows = files.read_csv(spark, p, "vendor_id").orderBy("id").collect()
    assert [(r.id, r.vendor) for r in rows] == [
        (1, "Creative Mobile Technologies, LLC"), (2, "Curb Mobility, LLC"), (7, "Helix")]


def test_csv_after_preamble_and_tagged_folders(spark, tmpdir_path):
    for borough, rows in (("Bronx", ["2024-01-01T00:00,1.5,80,0.5,0.0,0.0,10.2",
                                     "2024-01-01T01:00,,81,0.1,0.2,0.0,11.0"]),
                          ("Queens", ["2024-01-01T00:00,2.0,70,1.0,0.0,0.1,5.0"])):
        d = os.path.join(tmpdir_path, f"Weather_{borough}")
        os.makedirs(d)
        with open(os.path.join(d, "part.csv"), "w") as f:
            f.write("latitude,longitude,elevation\n40.8,-73.9,20\n\n")
            f.write("time,temperature_2m (°C),relative_humidity_2m (%),apparent_temperature (°C),"
                    "rain (mm),snowfall (cm),wind_speed_10m (km/h)\n")
            f.write("\n".join(rows) + "\n")
    want = schemas.schema("weather")
    read = lambda: files.read_headed_folders(
        spark, os.path.join(tmpdir_path, "Weather_*", "*.csv"), want, "borough_name", r"(Weather_[^/]+)/",
        {"Weather_Bronx": "The Bronx"}, r"^Weather_")
    both = read()
    counts = {r.borough_name: r["count"] for r in both.groupBy("borough_name").count().collect()}
    assert counts == {"The Bronx": 2, "Queens": 1} and both.columns == ["borough_name", *want.names]
    assert both.filter("borough_name = 'The Bronx'").orderBy("time").collect()[1]["temperature_2m (°C)"] is None
    # a file with another column order, and one column less, goes by its own header
    d = os.path.join(tmpdir_path, "Weather_Far Side")
    os.makedirs(d)
    with open(os.path.join(d, "part.csv"), "w") as f:
        f.write("x\n\n\ntime,rain (mm),temperature_2m (°C)\n2024-01-01T00:00,9.5,-3.0\n")
    far = read().filter("borough_name = 'Far Side'").collect()[0]
    assert (far["rain (mm)"], far["temperature_2m (°C)"], far["wind_speed_10m (km/h)"]) == (9.5, -3.0, None)
    with open(os.path.join(d, "odd.csv"), "w") as f:
        f.write("time,pressure\n2024-01-01T00:00,1\n")
    with pytest.raises(ValueError, match="pressure"):
        read()


def test_trip_files_of_different_types(spark, tmpdir_path):
    from cabmart.sources.raw import FileRoles
    for name, kind in (("a", "double"), ("b", "bigint")):
        (spark.range(3).selectExpr(f"cast(id as {kind}) as passenger_count", "id as VendorID").coalesce(1)
         .write.parquet(os.path.join(tmpdir_path, "taxi_trip", f"{name}.parquet")))
    got = FileRoles(spark, tmpdir_path).trips()
    assert got.schema == schemas.schema("taxi_trip")
    assert sorted(r.passenger_count for r in got.collect()) == [0.0, 0.0, 1.0, 1.0, 2.0, 2.0]


def test_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace
    from cabmart.session import ensure_checkpoint_dir
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)


def test_catalogue_names_every_source_and_table():
    assert set(schemas.RAW) == {"borough", "neighborhood", "taxi_trip", "weather", "payment_type", "vendor_id", "ratecode_id"}
    assert len(schemas.ODS) == 7 and len(schemas.MART) == 6
    for name in (*schemas.RAW, *schemas.ODS, *schemas.MART):
        assert len(schemas.schema(name)) > 0


def test_versioned_tables(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "t")
    assert tables.read_current(spark, root) is None
    assert tables.read_current(spark, root, "a int").count() == 0
    tables.write_version(spark.range(3).selectExpr("cast(id as int) a"), root)
    tables.write_version(spark.range(5).selectExpr("cast(id as int) a"), root)
    assert tables.versions(spark, root) == [0, 1]
    assert tables.read_current(spark, root).count() == 5
