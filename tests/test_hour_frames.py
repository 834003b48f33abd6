"""Files of hours: names, steps, append, and what a failed job leaves."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from aeroflux.operators import gridding, met
from aeroflux.operators.grids import Grid
from aeroflux.sources import hourframes

T0 = dt.datetime(2005, 1, 1)
SCHEMA = "grid string, hour_ts timestamp, layer int, row int, col int, pollutant string, prefix string, value double, unit string"


def hours(spark, count=10, first=0):
    rows = [(g, T0 + dt.timedelta(hours=first + h), 0, r, c, "NOX", "", float(h + r + c), "kg") for g in ("d01", "d02") for h in range(count) for r in range(3) for c in range(2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def visible(path):
    return sorted(n.rsplit("-", 1)[0] for n in hourframes.read_manifest(path))


def test_files_hold_so_many_steps(spark, tmp_path):
    path = str(tmp_path / "out")
    frame, rows = hours(spark)
    hourframes.write_frames(frame, path, "2005-01-01", 4)
    assert visible(path) == [f"{g}_2005-01-01_{h:02d}_00_00" for g in ("d01", "d02") for h in (0, 4, 8)]
    assert sum(hourframes.read_manifest(path).values()) == len(rows)
    back = hourframes.read_frames(spark, path)
    assert sorted(tuple(r) for r in back.drop("file").collect()) == sorted(rows)
    assert all(r["file"] == f"{r['grid']}_2005-01-01_{r['hour_ts'].hour // 4 * 4:02d}_00_00" for r in back.collect())
    assert not os.path.exists(f"{path}/_pending") or os.listdir(f"{path}/_pending") == []
    # steps of two hours, and hours before the start have files of their own
    hourframes.write_frames(frame, path, "2005-01-01 02:00:00", 2, step_hours=2)
    assert visible(path) == sorted(f"{g}_{d}_00_00" for g in ("d01", "d02") for d in ("2004-12-31_22", "2005-01-01_02", "2005-01-01_06"))
    assert hourframes.read_frames(spark, path).count() == len(rows)


def test_append_and_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    assert hourframes.read_frames(spark, path).count() == 0
    first, rows = hours(spark, 4)
    more, others = hours(spark, 4, first=4)
    hourframes.write_frames(first, path, "2005-01-01", 4)
    hourframes.write_frames(more, path, "2005-01-01", 4, mode="append")
    assert hourframes.read_frames(spark, path).count() == len(rows) + len(others) and len(visible(path)) == 4
    hourframes.write_frames(first.limit(0), path, "2005-01-01", 4)
    assert visible(path) == [] and hourframes.read_frames(spark, path).count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    frame, rows = hours(spark)
    hourframes.write_frames(frame, path, "2005-01-01", 4)
    before = sorted(os.listdir(path))
    # one task fails after others have written
    bad = frame.withColumn("value", F.when((F.col("grid") == "d02") & (F.hour("hour_ts") == 9) & (F.col("row") == 2), F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken row"):
        hourframes.write_frames(bad, path, "2005-01-01", 4)
    assert sorted(n for n in os.listdir(path) if n != "_pending") == [n for n in before if n != "_pending"]
    assert not os.path.exists(f"{path}/_pending") or os.listdir(f"{path}/_pending") == []
    assert hourframes.read_frames(spark, path).count() == len(rows)


def test_a_file_of_two_tasks_fails(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.dataSource.register(hourframes.HourFrames)
    frame, _ = hours(spark, 1)
    with pytest.raises(Exception, match="two tasks wrote one file"):
        frame.select(F.lit("x").alias("file"), "*").repartition(2).write.format("hourframes").mode("overwrite").option("path", path).save()
    assert hourframes.read_manifest(path) == {}


def test_values_per_area(spark):
    grid = Grid("d01", 2, 2, 4.0, 2.0, 0.0, 0.0)
    frame = spark.createDataFrame([("d01", 8.0, "kmol"), ("d01", 8.0, "kg")], "grid string, value double, unit string")
    gas, particle = gridding.over_areas(frame, [grid]).collect()
    assert (gas["value"], gas["unit"]) == (1000.0, "mol/km2/h")
    assert particle["value"] == pytest.approx(8e9 / 4000 / 2000 / 3600) and particle["unit"] == "ug/m2/s"
    with pytest.raises(Exception, match="no domain d09"):
        gridding.over_areas(frame.withColumn("grid", F.lit("d09")), [grid]).collect()


def test_layers_follow_the_air(spark):
    """Calm air lifts the plume over two layers, a gale keeps it in the first; hours between frames take the earlier one."""
    level = lambda h, k, wind: (1, 1, T0 + dt.timedelta(hours=h), k, k * 100.0, 280.0, wind, False, 0.0)
    air = spark.createDataFrame([level(h, k, w) for h, w in ((2, 1.0), (5, 900.0)) for k in range(6)], "row int, col int, frame_ts timestamp, k int, height double, temp double, wind double, stable boolean, s1 double")
    stacks = spark.createDataFrame([(7, r, 1, T0 + dt.timedelta(hours=h), 50.0, 2.0, 400.0, 20.0, h) for h in range(8) for r in (1, 2)], "id int, row int, col int, hour_ts timestamp, height_m double, diam_m double, temp_k double, vel_ms double, h int")
    got = {(r["row"], r["h"]): r["layer"] for r in met.plume_layer_by_hour(stacks, air, ["row", "col"], 6).collect()}
    high = got[1, 2]
    assert high > 0 and [got[1, h] for h in range(8)] == [0, 0, high, high, high, 0, 0, 0]
    assert {got[2, h] for h in range(8)} == {0}
    old = {(r["row"], r["h"]): r["layer"] for r in met.plume_layer_by_hour(stacks, air, ["row", "col"], 6, oldest_hours=1).collect()}
    assert [old[1, h] for h in range(6)] == [0, 0, high, high, 0, 0]
