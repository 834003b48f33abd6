"""Queries of grids, surrogates, meteorology and gridded output."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroflux.operators import grids, gridding, met
from aeroflux.operators import emissions as em
from aeroflux.operators import surrogates as sg
from aeroflux.operators.grids import Grid, Projection
from aeroflux.operators.temporal import steps
from aeroflux.plans.inventory_queries import emissions_of
from aeroflux.plans.temporal_queries import HOURLY, hourly_of
from aeroflux.plans.views import numbers, oracle, run, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

GRID = Grid("g5", 8, 7, 5.0, 5.0, 0.0, 0.0)
WIDE = Grid("us", 60, 50, 1.0, 0.5, -125.0, 25.0)
LAMBERT = Projection("lcc", 33.0, 45.0, 40.0, -97.0)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def boxes(df: DataFrame, *names: str) -> DataFrame:
    """Rectangles x1, y1, x2, y2 as rings."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return df.withColumn("rings", F.array(F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2")))).select(*names, "rings")


def surrogate_of(spark: SparkSession, sf_dir: str, kind: int | None = None, code: str = "100") -> DataFrame:
    weights = view(spark, sf_dir, "weights").withColumn("kind_no", F.col("kind"))
    weights = boxes(weights, "weight_id", "attr", "kind_no").withColumn("kind", F.lit("polygon"))
    inputs = sg.input_shapes(boxes(view(spark, sf_dir, "shapes"), "shape_id"), GRID)
    keep = None if kind is None else sg.attribute_filter(F.col("kind_no").cast("string"), [str(kind)], True)
    return sg.create_surrogate(inputs, sg.weight_shapes(weights, GRID, ["attr"], [1.0], keep), GRID, code)


def surrogate_sql(kind: int | None, code: str = "100") -> str:
    """Rectangles' shares: products of overlaps in each axis."""
    only = "" if kind is None else f" AND kind = {kind}"
    side = lambda lo, hi, a, b, c: f"greatest(0.0, least({hi}) - greatest({lo}))"  # noqa: E731, ARG005
    cell = "(SELECT r.i AS row, c.i AS col, c.i * 5.0 AS cx1, r.i * 5.0 AS cy1, c.i * 5.0 + 5 AS cx2, r.i * 5.0 + 5 AS cy2 FROM " + numbers(7, "r(i)") + " CROSS JOIN " + numbers(8, "c(i)") + ")"
    x3, y3 = side("s.x1, w.x1, c.cx1", "s.x2, w.x2, c.cx2", 0, 0, 0), side("s.y1, w.y1, c.cy1", "s.y2, w.y2, c.cy2", 0, 0, 0)
    x2, y2 = side("s.x1, w.x1", "s.x2, w.x2", 0, 0, 0), side("s.y1, w.y1", "s.y2, w.y2", 0, 0, 0)
    w = f"(SELECT *, attr / 12.0 AS wt FROM {{weights}} WHERE attr > 0 AND x1 <= 40 AND y1 <= 35{only})"
    s = "(SELECT *, x1 >= 0 AND y1 >= 0 AND x2 <= 40 AND y2 <= 35 AS covered FROM {shapes} WHERE x1 <= 40 AND y1 <= 35)"
    whole = f"(SELECT s.shape_id, sum(w.wt * {x2} * {y2}) AS total FROM {s} s CROSS JOIN {w} w GROUP BY s.shape_id)"
    return f"""SELECT '{code}' AS srg_code, 'g5' AS grid, p.shape_id, p.row, p.col, p.size / t.total AS weight, p.covered FROM (SELECT s.shape_id, s.covered, c.row, c.col, sum(w.wt * {x3} * {y3}) AS size FROM {s} s CROSS JOIN {w} w CROSS JOIN {cell} c GROUP BY ALL) p JOIN {whole} t ON t.shape_id = p.shape_id WHERE p.size > 0"""


@query(f"SELECT srg_code, grid, shape_id, row, col, round(weight, 9) AS weight, covered FROM ({surrogate_sql(None)}) s")
def surrogate_shares(spark, sf_dir):
    return surrogate_of(spark, sf_dir).withColumn("weight", F.round("weight", 9))


@query(f"SELECT srg_code, grid, shape_id, row, col, round(weight, 9) AS weight, covered FROM ({surrogate_sql(1, '101')}) s")
def filtered_surrogate(spark, sf_dir):
    return surrogate_of(spark, sf_dir, 1, "101").withColumn("weight", F.round("weight", 9))


NORMAL = f"SELECT srg_code, grid, shape_id, row, col, CASE WHEN covered THEN weight / sum(weight) OVER (PARTITION BY srg_code, shape_id) ELSE weight END AS weight, covered FROM ({surrogate_sql(None)}) s"


@query(f"SELECT srg_code, grid, shape_id, row, col, round(weight, 9) AS weight, covered FROM ({NORMAL}) n")
def normalised_surrogate(spark, sf_dir):
    return sg.normalise_surrogate(surrogate_of(spark, sf_dir)).select("srg_code", "grid", "shape_id", "row", "col", F.round("weight", 9).alias("weight"), "covered")


@query(f"SELECT 'mixed' AS srg_code, grid, shape_id, row, col, round(sum(weight * f), 9) AS weight FROM (SELECT *, 0.5 AS f FROM ({surrogate_sql(1, '101')}) a UNION ALL SELECT *, 0.25 FROM ({surrogate_sql(2, '102')}) b) u GROUP BY ALL")
def merged_surrogate(spark, sf_dir):
    both = surrogate_of(spark, sf_dir, 1, "101").unionByName(surrogate_of(spark, sf_dir, 2, "102"))
    merges = sg.resolve_merges({"mixed": [(0.5, "101"), (0.5, "half")], "half": [(0.5, "102")]})
    merged = sg.merge_surrogates(both, {"mixed": merges["mixed"]})
    return merged.groupBy("srg_code", "grid", "shape_id", "row", "col").agg(F.round(F.sum("weight"), 9).alias("weight"))


@query(f"SELECT s.shape_id, CASE WHEN a.shape_id IS NOT NULL THEN '101' WHEN b.shape_id IS NOT NULL THEN '102' WHEN c.shape_id IS NOT NULL THEN '100' END AS chosen FROM {{shapes}} s LEFT JOIN (SELECT DISTINCT shape_id FROM ({surrogate_sql(1)}) x) a ON a.shape_id = s.shape_id LEFT JOIN (SELECT DISTINCT shape_id FROM ({surrogate_sql(2)}) x) b ON b.shape_id = s.shape_id LEFT JOIN (SELECT DISTINCT shape_id FROM ({surrogate_sql(None)}) x) c ON c.shape_id = s.shape_id")
def backup_surrogates(spark, sf_dir):
    parts = [surrogate_of(spark, sf_dir, k, c) for k, c in ((1, "101"), (2, "102"), (None, "100"))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("srg_code", "name")
    shapes = view(spark, sf_dir, "shapes").select("shape_id", F.array(*map(F.lit, ("101", "102", "100"))).alias("names"))
    return sg.with_backups(shapes, whole).select("shape_id", "chosen")


@query(f"SELECT shape_id, row, col, round(weight * CASE WHEN (row + col) % 3 = 0 THEN 0.0 ELSE 0.5 END, 9) AS weight FROM ({NORMAL}) n")
def adjusted_cells(spark, sf_dir):
    cells = sg.normalise_surrogate(surrogate_of(spark, sf_dir))
    factor = grids.regular_grid(spark, GRID).where((F.col("row") + F.col("col")) % 3 != 0).select("grid", "row", "col", F.lit(0.5).alias("factor"))
    return sg.adjust(cells, factor).select("shape_id", "row", "col", F.round("weight", 9).alias("weight"))


SHAPE = "cast(substr(i.fips, 1, 2) AS int) % 25"


def shaped(df: DataFrame) -> DataFrame:
    return df.withColumn("shape_id", F.substring("fips", 1, 2).cast("int") % 25)


@query(f"SELECT n.grid, n.row, n.col, i.pollutant, i.prefix, round(sum(i.tons * 907.185 * n.weight), 0) AS value, 'kg' AS unit FROM {{inv}} i JOIN ({NORMAL}) n ON n.shape_id = {SHAPE} GROUP BY ALL")
def gridded_totals(spark, sf_dir):
    cells = sg.normalise_surrogate(surrogate_of(spark, sf_dir))
    return gridding.gridded_totals(shaped(emissions_of(spark, sf_dir)), cells, ["shape_id"]).withColumn("value", F.round("value", 0))


@query(f"""SELECT n.grid, n.row, n.col, i.pollutant, i.prefix, round(sum(i.tons * 907.185 / date_diff('second', i.begin_ts, i.end_ts) * date_diff('second', greatest(i.begin_ts, TIMESTAMP '1996-01-10'), least(i.end_ts, TIMESTAMP '1996-06-20')) * n.weight), 0) AS value, 'kg' AS unit
FROM {{inv}} i JOIN ({NORMAL}) n ON n.shape_id = {SHAPE} WHERE i.end_ts > TIMESTAMP '1996-01-10' AND i.begin_ts < TIMESTAMP '1996-06-20' GROUP BY ALL""")
def gridded_period(spark, sf_dir):
    cells = sg.normalise_surrogate(surrogate_of(spark, sf_dir))
    begin, end = F.lit("1996-01-10").cast("timestamp"), F.lit("1996-06-20").cast("timestamp")
    return gridding.gridded_period(shaped(emissions_of(spark, sf_dir)), cells, ["shape_id"], begin, end).withColumn("value", F.round("value", 0))


@query(f"SELECT i.hour_ts, n.grid, 0 AS layer, n.row, n.col, i.pollutant, i.prefix, round(sum(i.amount * n.weight), 3) AS value, round(sum(i.amount * n.weight) * 1e9 / 5000.0 / 5000.0 / 3600.0, 3) AS per_area FROM ({HOURLY}) i JOIN ({NORMAL}) n ON n.shape_id = {SHAPE} GROUP BY ALL")
def gridded_hourly(spark, sf_dir):
    cells = sg.normalise_surrogate(surrogate_of(spark, sf_dir))
    out = gridding.gridded_hourly(shaped(hourly_of(spark, sf_dir)), cells, ["shape_id"])
    area = gridding.per_area(F.col("value"), F.col("unit"), 5.0, 5.0)
    return out.withColumn("per_area", F.round(area, 3)).withColumn("value", F.round("value", 3)).drop("unit")


LCC_N = math.log(math.cos(math.radians(33)) / math.cos(math.radians(45))) / math.log(math.tan(math.pi / 4 + math.radians(45) / 2) / math.tan(math.pi / 4 + math.radians(33) / 2))
LCC_F = 6370997.0 * math.cos(math.radians(33)) * math.tan(math.pi / 4 + math.radians(33) / 2) ** LCC_N / LCC_N
RHO = f"({LCC_F:.17e} / power(tan(radians(lat) / 2 + pi() / 4), {LCC_N:.17e}))"
RHO0 = LCC_F / math.tan(math.pi / 4 + math.radians(40) / 2) ** LCC_N


@query(f"SELECT source_id, round({RHO} * sin(radians(lon + 97) * {LCC_N:.17e}), 3) AS x, round({RHO0:.17e} - {RHO} * cos(radians(lon + 97) * {LCC_N:.17e}), 3) AS y FROM {{stacks}}")
def projected_stacks(spark, sf_dir):
    x, y = grids.project(F.col("lon"), F.col("lat"), LAMBERT)
    return view(spark, sf_dir, "stacks").select("source_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


EDGED = "SELECT source_id, CASE WHEN source_id % 3 = 0 THEN floor(lon) ELSE lon END AS lon, CASE WHEN source_id % 4 = 0 THEN floor(lat) ELSE lat END AS lat FROM {stacks}"


@query(f"""SELECT p.source_id, r.i AS row, c.i AS col, round(1.0 / count(*) OVER (PARTITION BY p.source_id), 6) AS weight FROM ({EDGED}) p
JOIN {numbers(50, "r(i)")} ON p.lat >= 25 + 0.5 * r.i AND p.lat <= 25.5 + 0.5 * r.i JOIN {numbers(60, "c(i)")} ON p.lon >= -125 + c.i AND p.lon <= -124 + c.i""")
def stacks_in_cells(spark, sf_dir):
    """Every third stack is moved to a meridian and every fourth to a parallel that cells share: up to four cells have a part of it."""
    stacks = run(spark, sf_dir, EDGED)
    return grids.points_to_cells(stacks, WIDE, "lon", "lat").select("source_id", "row", "col", F.round("weight", 6).alias("weight"))


@query("SELECT source_id, s.shape_id AS row, 0 AS col, round(1.0 / count(*) OVER (PARTITION BY source_id), 6) AS weight FROM (SELECT source_id, abs(lon) - 67.0 AS x, lat - 3.0 AS y FROM {stacks}) p JOIN {shapes} s ON p.x BETWEEN s.x1 AND s.x2 AND p.y BETWEEN s.y1 AND s.y2")
def stacks_in_polygons(spark, sf_dir):
    cells = grids.irregular_grid(boxes(view(spark, sf_dir, "shapes"), "shape_id"), "poly", "shape_id")
    points = view(spark, sf_dir, "stacks").select("source_id", (F.abs("lon") - 67.0).alias("x"), (F.col("lat") - 3.0).alias("y"))
    return grids.points_to_irregular(points, cells, 10.0).select("source_id", "row", "col", F.round("weight", 6).alias("weight"))


@query("""SELECT row_i AS row, col_i AS col, k, round((ph_sum - first_value(ph_sum) OVER (PARTITION BY row_i, col_i ORDER BY k)) / 9.80665, 6) AS height FROM {met}""")
def layer_heights(spark, sf_dir):
    rows = view(spark, sf_dir, "met").withColumnRenamed("row_i", "row").withColumnRenamed("col_i", "col")
    return met.layer_heights(rows, ["row", "col"], F.col("ph_sum")).select("row", "col", "k", F.round("height", 6).alias("height"))


@query("""SELECT a.row_i AS row, a.col_i AS col, a.k, round(sqrt(power((a.u + b.u) / 2, 2) + power((a.v + c.v) / 2, 2)), 6) AS wind FROM {met} a JOIN {met} b ON b.row_i = a.row_i AND b.col_i = a.col_i + 1 AND b.k = a.k JOIN {met} c ON c.row_i = a.row_i + 1 AND c.col_i = a.col_i AND c.k = a.k""")
def wind_speeds(spark, sf_dir):
    rows = view(spark, sf_dir, "met").withColumnRenamed("row_i", "row").withColumnRenamed("col_i", "col")
    return met.wind_speed(rows.select("row", "col", "k", "u"), rows.select("row", "col", "k", "v"), []).withColumn("wind", F.round("wind", 6))


AIR = """SELECT row_i AS row, col_i AS col, k, (ph_sum - first_value(ph_sum) OVER w) / 9.80665 AS height, (theta + 300) * power((100000.0 * exp(-0.04 * k)) / 101300.0, 0.2854) AS temp, sqrt(u * u + v * v) AS wind,
coalesce((theta - lag(theta) OVER w) / nullif((ph_sum - lag(ph_sum) OVER w) / 9.80665, 0), 0.0) AS grad, power((100000.0 * exp(-0.04 * k)) / 101300.0, 0.2854) AS exner FROM {met} WINDOW w AS (PARTITION BY row_i, col_i ORDER BY k)"""


def air_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "met").withColumnRenamed("row_i", "row").withColumnRenamed("col_i", "col")
    high = met.layer_heights(rows, ["row", "col"], F.col("ph_sum")).withColumn("wind", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))
    return met.stability(high, ["row", "col"], F.col("theta"), F.lit(100000.0) * F.exp(F.col("k") * -0.04), F.col("height"))


@query(f"SELECT row, col, k, round(temp, 6) AS temp, round(grad, 9) AS dtheta_dz, round(grad / temp * exner, 9) AS s1, grad >= 0.005 AS stable FROM ({AIR}) a")
def air_stability(spark, sf_dir):
    return air_of(spark, sf_dir).select("row", "col", "k", F.round("temp", 6).alias("temp"), F.round("dtheta_dz", 9).alias("dtheta_dz"), F.round("s1", 9).alias("s1"), "stable")


PLUME = f"""WITH air AS ({AIR}), top AS (SELECT max(k) + 1 AS kemit FROM air),
own AS (SELECT s.source_id, s.row, s.col, s.h, s.d, s.v, s.t, coalesce(min(CASE WHEN a.height >= s.h THEN a.k - 1 END), (SELECT kemit - 2 FROM top)) AS k FROM (SELECT source_id, cast(source_id % 20 AS int) AS row, cast(source_id % 10 AS int) AS col, greatest(height_m, 0) AS h, greatest(diam_m, 0) AS d, least(greatest(vel_ms, 0), 40) AS v, temp_k AS t FROM {{stacks}}) s JOIN air a ON a.row = s.row AND a.col = s.col AND a.k BETWEEN 1 AND (SELECT kemit - 1 FROM top) GROUP BY ALL),
raised AS (SELECT o.*, greatest(a.wind, 1) AS w, greatest(o.t, a.temp + 10) AS ts, a.temp AS ta, a.grad >= 0.005 AS stable, a.grad / a.temp * a.exner AS s1 FROM own o JOIN air a ON a.row = o.row AND a.col = o.col AND a.k = o.k),
high AS (SELECT *, h + CASE WHEN ts - ta < 50 AND v > w AND v > 10 THEN d * power(v, 1.4) / power(w, 1.4) WHEN stable THEN 29.0 * power((ts - ta) * 9.80665 / ts * v * d * d / 4 / s1, 1.0 / 3) / power(w, 1.0 / 3) ELSE 7.4 * power((ts - ta) * 9.80665 / ts * v * d * d / 4 * h * h, 1.0 / 3) / w END AS z FROM raised)
SELECT s.source_id, coalesce(p.layer, 0) AS layer FROM {{stacks}} s LEFT JOIN (
SELECT g.source_id, coalesce(min(CASE WHEN a.height >= g.z THEN a.k - 1 END), (SELECT kemit - 2 FROM top)) AS layer FROM high g JOIN air a ON a.row = g.row AND a.col = g.col AND a.k BETWEEN 1 AND (SELECT kemit - 1 FROM top) GROUP BY g.source_id) p ON p.source_id = s.source_id"""


def plume_layers(spark, sf_dir):
    air = air_of(spark, sf_dir)
    kemit = air.agg(F.max("k") + 1).first()[0]
    stacks = view(spark, sf_dir, "stacks").withColumn("row", (F.col("source_id") % 20).cast("int")).withColumn("col", (F.col("source_id") % 10).cast("int"))
    return met.plume_layer(stacks, air, ["row", "col"], kemit).select("source_id", "layer")


QUERIES["plume_layers"] = plume_layers
_head, _rest = oracle(PLUME).split("\nWITH air AS ", 1)
ORACLE_SQL["plume_layers"] = f"{_head},\nair AS {_rest}"


CELLS_OF_STACKS = f"""SELECT p.source_id, r.i AS row, c.i AS col, 1.0 / count(*) OVER (PARTITION BY p.source_id) AS weight FROM ({EDGED}) p
JOIN {numbers(50, "r(i)")} ON p.lat >= 25 + 0.5 * r.i AND p.lat <= 25.5 + 0.5 * r.i JOIN {numbers(60, "c(i)")} ON p.lon >= -125 + c.i AND p.lon <= -124 + c.i"""


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared one; where none is set, as in tests, under a temporary one."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='aeroflux-')}/{name}-{uuid.uuid4().hex}"


def hourly_with_plumes(spark, sf_dir):
    """A day of area and point sources through an Outputter: stacks in the layers of their plumes, written as Parquet and read again."""
    air = air_of(spark, sf_dir)
    out = gridding.ParquetOutput(shared_path(spark, "hours"), air, ("row", "col"), air.agg(F.max("k") + 1).first()[0])
    start = F.lit("1996-06-30 12:00:00").cast("timestamp")
    stacks = view(spark, sf_dir, "stacks").withColumn("row", (F.col("source_id") % 20).cast("int")).withColumn("col", (F.col("source_id") % 10).cast("int"))
    points = steps(stacks, start, start + F.make_dt_interval(F.lit(1))).select("*", F.lit("SO2").alias("pollutant"), F.lit("").alias("prefix"), (F.col("diam_m") * F.col("vel_ms") * 0.7310585).alias("amount"), F.lit("kg").alias("unit"))
    places = grids.points_to_cells(run(spark, sf_dir, EDGED), WIDE, "lon", "lat")
    gridding.gridded_output(out, shaped(hourly_of(spark, sf_dir)), sg.normalise_surrogate(surrogate_of(spark, sf_dir)), ["shape_id"], points, places, ["source_id"])
    return spark.read.parquet(out.path).select("hour_ts", "grid", "layer", "row", "col", "pollutant", F.coalesce("prefix", F.lit("")).alias("prefix"), F.round("value", 3).alias("value"))


_ctes, _last = PLUME.split("\nSELECT s.source_id", 1)
QUERIES["hourly_with_plumes"] = hourly_with_plumes
_head, _rest = oracle(
    f"""{_ctes},
plume AS (SELECT s.source_id{_last})
SELECT hour_ts, grid, layer, row, col, pollutant, prefix, round(sum(value), 3) AS value FROM (
SELECT i.hour_ts, n.grid, 0 AS layer, n.row, n.col, i.pollutant, i.prefix, i.amount * n.weight AS value FROM ({HOURLY}) i JOIN ({NORMAL}) n ON n.shape_id = {SHAPE}
UNION ALL SELECT h.hour_ts, 'us', p.layer, c.row, c.col, 'SO2', '', s.diam_m * s.vel_ms * 0.7310585 * c.weight FROM {{stacks}} s JOIN plume p ON p.source_id = s.source_id JOIN ({CELLS_OF_STACKS}) c ON c.source_id = s.source_id
CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1996-06-30 12:00:00', TIMESTAMP '1996-07-01 11:00:00', INTERVAL 1 HOUR)) AS hour_ts) h) x GROUP BY ALL"""
).split("\nWITH air AS ", 1)
ORACLE_SQL["hourly_with_plumes"] = f"{_head},\nair AS {_rest}"

CORNERS = ", ".join(f"' || cast(cast({x} AS double) AS varchar) || ' ' || cast(cast({y} AS double) AS varchar) || '" for x, y in (("col * 5.0", "row * 5.0"), ("col * 5.0 + 5", "row * 5.0"), ("col * 5.0 + 5", "row * 5.0 + 5"), ("col * 5.0", "row * 5.0 + 5"), ("col * 5.0", "row * 5.0")))


@query(f"SELECT row, col, shape_id, round(weight, 9) AS weight, CASE WHEN covered THEN 'T' ELSE 'F' END AS covered, 'POLYGON (({CORNERS}))' AS geometry FROM ({NORMAL}) n")
def exported_surrogate(spark, sf_dir):
    """Cells of shapes with their polygons as text."""
    cells = sg.normalise_surrogate(surrogate_of(spark, sf_dir))
    return gridding.export_surrogate(cells, grids.regular_grid(spark, GRID)).withColumn("weight", F.round("weight", 9))


@query("SELECT pollutant, prefix, round(sum(tons * 907.185), 0) AS total, 'kg' AS unit FROM {inv} GROUP BY ALL")
def tabbed_report(spark, sf_dir):
    """Totals written as tab-separated text with a header and read again."""
    path = shared_path(spark, "report")
    gridding.write_table(em.grand_totals(emissions_of(spark, sf_dir)), path, tabs=True)
    back = spark.read.csv(path, sep="\t", header=True)
    return back.select("pollutant", F.coalesce("prefix", F.lit("")).alias("prefix"), F.round(F.col("total").cast("double"), 0).alias("total"), "unit")


@query("SELECT n.n_nationkey AS shape_id, count(*) AS cells, sum(r.i * 8 + c.i) AS numbers FROM {nation} n JOIN " + numbers(7, "r(i)") + " ON r.i * 5.0 < 10.0 * floor(n.n_nationkey / 5) + 11 AND r.i * 5.0 + 5 > 10.0 * floor(n.n_nationkey / 5) JOIN " + numbers(8, "c(i)") + " ON c.i * 5.0 < 10.0 * (n.n_nationkey % 5) + 12 AND c.i * 5.0 + 5 > 10.0 * (n.n_nationkey % 5) GROUP BY 1")
def cells_under_shapes(spark, sf_dir):
    """Which cells of a regular grid each shape touches, through tiles of the plane."""
    parts = sg.tiles(boxes(view(spark, sf_dir, "shapes"), "shape_id").withColumn("kind", F.lit("polygon")), GRID, "shape_id")
    on = parts.join(grids.regular_grid(spark, GRID).select("row", "col"), ["row", "col"])
    real = on.where(F.col("size") > 0)
    return real.groupBy("shape_id").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("row") * GRID.nx + F.col("col")).alias("numbers"))
