"""Queries of the final product: hours of areas and plumes in files of so many steps, in air that changes by the hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroflux.operators import grids, gridding, met
from aeroflux.operators import surrogates as sg
from aeroflux.operators.temporal import steps
from aeroflux.plans.spatial_queries import CELLS_OF_STACKS, EDGED, GRID, NORMAL, SHAPE, WIDE, shaped, shared_path, surrogate_of
from aeroflux.plans.temporal_queries import HOURLY, hourly_of
from aeroflux.plans.views import numbers, oracle, run, view
from aeroflux.sources import hourframes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A frame every 5 hours from 11:00, the last but one missing in every third column of air.
FRAMES = f"""SELECT row_i AS row, col_i AS col, k, TIMESTAMP '1996-06-30 11:00:00' + f.i * INTERVAL 5 HOUR AS frame_ts, ph_sum, theta + f.i * (k % 3) AS theta, u + 3.0 * f.i AS u, v FROM {{met}} CROSS JOIN {numbers(6, "f(i)")} WHERE NOT (f.i = 3 AND row_i % 3 = 0)"""
AIR = f"""SELECT row, col, k, frame_ts, (ph_sum - first_value(ph_sum) OVER w) / 9.80665 AS height, (theta + 300) * power((100000.0 * exp(-0.04 * k)) / 101300.0, 0.2854) AS temp, sqrt(u * u + v * v) AS wind,
coalesce((theta - lag(theta) OVER w) / nullif((ph_sum - lag(ph_sum) OVER w) / 9.80665, 0), 0.0) AS grad, power((100000.0 * exp(-0.04 * k)) / 101300.0, 0.2854) AS exner FROM ({FRAMES}) m WINDOW w AS (PARTITION BY row, col, frame_ts ORDER BY k)"""
POINTS = "SELECT source_id, cast(source_id % 20 AS int) AS row, cast(source_id % 10 AS int) AS col, height_m, diam_m, vel_ms, temp_k FROM {stacks}"
STEPS = "(SELECT unnest(generate_series(TIMESTAMP '1996-06-30 10:00:00', TIMESTAMP '1996-07-01 09:00:00', INTERVAL 1 HOUR)) AS hour_ts)"
#: For each stack and frame the layer, as in the query of plumes.
LAYERS = f"""air AS ({AIR}), top AS (SELECT max(k) + 1 AS kemit FROM air),
st AS (SELECT s.*, f.frame_ts FROM ({POINTS}) s JOIN (SELECT DISTINCT row, col, frame_ts FROM air) f ON f.row = s.row AND f.col = s.col),
own AS (SELECT s.source_id, s.row, s.col, s.frame_ts, greatest(height_m, 0) AS h, greatest(diam_m, 0) AS d, least(greatest(vel_ms, 0), 40) AS v, temp_k AS t, coalesce(min(CASE WHEN a.height >= greatest(height_m, 0) THEN a.k - 1 END), (SELECT kemit - 2 FROM top)) AS k FROM st s JOIN air a ON a.row = s.row AND a.col = s.col AND a.frame_ts = s.frame_ts AND a.k BETWEEN 1 AND (SELECT kemit - 1 FROM top) GROUP BY ALL),
raised AS (SELECT o.*, greatest(a.wind, 1) AS w, greatest(o.t, a.temp + 10) AS ts, a.temp AS ta, a.grad >= 0.005 AS stable, a.grad / a.temp * a.exner AS s1 FROM own o JOIN air a ON a.row = o.row AND a.col = o.col AND a.frame_ts = o.frame_ts AND a.k = o.k),
high AS (SELECT *, h + CASE WHEN ts - ta < 50 AND v > w AND v > 10 THEN d * power(v, 1.4) / power(w, 1.4) WHEN stable THEN 29.0 * power((ts - ta) * 9.80665 / ts * v * d * d / 4 / s1, 1.0 / 3) / power(w, 1.0 / 3) ELSE 7.4 * power((ts - ta) * 9.80665 / ts * v * d * d / 4 * h * h, 1.0 / 3) / w END AS z FROM raised),
layers AS (SELECT g.source_id, g.frame_ts, coalesce(min(CASE WHEN a.height >= g.z THEN a.k - 1 END), (SELECT kemit - 2 FROM top)) AS layer FROM high g JOIN air a ON a.row = g.row AND a.col = g.col AND a.frame_ts = g.frame_ts AND a.k BETWEEN 1 AND (SELECT kemit - 1 FROM top) GROUP BY g.source_id, g.frame_ts),
plumes AS (SELECT s.source_id, s.hour_ts, coalesce(l.layer, 0) AS layer FROM (SELECT s.source_id, s.row, s.col, h.hour_ts, (SELECT max(frame_ts) FROM (SELECT DISTINCT row, col, frame_ts FROM air) f WHERE f.row = s.row AND f.col = s.col AND f.frame_ts <= h.hour_ts) AS frame_ts FROM ({POINTS}) s CROSS JOIN {STEPS} h) s LEFT JOIN layers l ON l.source_id = s.source_id AND l.frame_ts = s.frame_ts)"""


def with_parts(text: str) -> str:
    """SQL with the plumes' parts behind the views that it needs."""
    whole = oracle(f"{LAYERS.replace('air AS (', 'SELECT (', 1)}\n{text}")
    head, rest = whole.split("\nSELECT (", 1)
    return f"{head},\nair AS ({rest}"


def air_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, FRAMES)
    by = ["row", "col", "frame_ts"]
    high = met.layer_heights(rows, by, F.col("ph_sum")).withColumn("wind", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))
    return met.stability(high, by, F.col("theta"), F.lit(100000.0) * F.exp(F.col("k") * -0.04), F.col("height"))


def stacks_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("1996-06-30 10:00:00").cast("timestamp")
    return steps(run(spark, sf_dir, POINTS), start, start + F.make_dt_interval(F.lit(1)))


def plumes_by_hour(spark, sf_dir):
    """Layers of plumes in each hour of a day; before the first frame they are 0, a missing frame is stood in for by the one before it."""
    air = air_by_frame(spark, sf_dir)
    layered = met.plume_layer_by_hour(stacks_by_hour(spark, sf_dir), air, ["row", "col"], air.agg(F.max("k") + 1).first()[0])
    return layered.select("source_id", "hour_ts", "layer")


QUERIES["plumes_by_hour"] = plumes_by_hour
ORACLE_SQL["plumes_by_hour"] = with_parts("SELECT source_id, hour_ts, layer FROM plumes")


def hours_in_files(spark, sf_dir):
    """A day of areas and plumes in files of 7 steps for each of two domains, per area of their cells, written by the data source and read again."""
    air = air_by_frame(spark, sf_dir)
    out = gridding.FrameOutput(shared_path(spark, "frames"), air, ("row", "col"), air.agg(F.max("k") + 1).first()[0], (GRID, WIDE), "1996-06-30 10:00:00", 7)
    points = stacks_by_hour(spark, sf_dir).select("*", F.lit("SO2").alias("pollutant"), F.lit("").alias("prefix"), (F.col("diam_m") * F.col("vel_ms") * 0.7310585).alias("amount"), F.lit("kg").alias("unit"))
    places = grids.points_to_cells(run(spark, sf_dir, EDGED), WIDE, "lon", "lat")
    gridding.gridded_output(out, shaped(hourly_of(spark, sf_dir)), sg.normalise_surrogate(surrogate_of(spark, sf_dir)), ["shape_id"], points, places, ["source_id"])
    back = hourframes.read_frames(spark, out.path)
    return back.select("file", "grid", "hour_ts", "layer", "row", "col", "pollutant", "prefix", F.round("value", 4).alias("value"), "unit")


QUERIES["hours_in_files"] = hours_in_files
ORACLE_SQL["hours_in_files"] = with_parts(
    f"""SELECT grid || '_' || strftime(TIMESTAMP '1996-06-30 10:00:00' + cast(floor(date_diff('hour', TIMESTAMP '1996-06-30 10:00:00', hour_ts) / 7.0) AS int) * INTERVAL 7 HOUR, '%Y-%m-%d_%H_%M_%S') AS file,
grid, hour_ts, layer, row, col, pollutant, prefix, round(sum(value) * 1e9 / CASE grid WHEN 'g5' THEN 5000.0 * 5000.0 ELSE 1000.0 * 500.0 END / 3600.0, 4) AS value, 'ug/m2/s' AS unit FROM (
SELECT i.hour_ts, n.grid, 0 AS layer, n.row, n.col, i.pollutant, i.prefix, i.amount * n.weight AS value FROM ({HOURLY}) i JOIN ({NORMAL}) n ON n.shape_id = {SHAPE}
UNION ALL SELECT p.hour_ts, 'us', p.layer, c.row, c.col, 'SO2', '', s.diam_m * s.vel_ms * 0.7310585 * c.weight FROM {{stacks}} s JOIN plumes p ON p.source_id = s.source_id JOIN ({CELLS_OF_STACKS}) c ON c.source_id = s.source_id) x GROUP BY grid, hour_ts, layer, row, col, pollutant, prefix"""
)
