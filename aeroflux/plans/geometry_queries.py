"""Queries of datums, geometry as bytes and text, and surrogates of shapes that are not rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroflux.operators import datums, grids
from aeroflux.operators import surrogates as sg
from aeroflux.operators.grids import Grid, Projection
from aeroflux.plans.spatial_queries import GRID, surrogate_of, surrogate_sql
from aeroflux.plans.views import numbers, oracle, run, view
from aeroflux.sources import geometry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


# --- datums ----------------------------------------------------------------------------------------------------------

#: Cells of about a hundred metres, so that a shift of the datum moves a stack to another one.
FINE = Grid("fine", 60_000, 26_000, 0.001, 0.001, -125.10037, 24.90043)
DATUM = "CASE source_id % 4 WHEN 0 THEN 'lonlat' WHEN 1 THEN 'nad27' WHEN 2 THEN 'nad83' ELSE 'nad27' END"
REGION = "CASE source_id % 4 WHEN 3 THEN 'western' ELSE 'conus' END"


def moved_sql() -> str:
    """The Molodensky formula over the stacks."""
    c, w = datums.CLARKE_1866, datums.WGS84
    where = "".join(f"WHEN '{r}' THEN {{{r}}} " for r in ("conus", "western"))
    shift = lambda i: "CASE region " + where.format(**{r: f"{datums.NAD27_SHIFTS[r][i]:.3e}" for r in ("conus", "western")}) + "END"
    return f"""SELECT source_id, datum, CASE WHEN datum = 'nad27' THEN lon + degrees((-dx * sin(l) + dy * cos(l)) / (n * cos(p))) ELSE lon END AS lon, CASE WHEN datum = 'nad27' THEN lat + degrees((-dx * sin(p) * cos(l) - dy * sin(p) * sin(l) + dz * cos(p)
+ {w.a - c.a:.17e} * n * {c.e2:.17e} * sin(p) * cos(p) / {c.a:.17e} + {w.f - c.f:.17e} * (m / {1 - c.f:.17e} + n * {1 - c.f:.17e}) * sin(p) * cos(p)) / m) ELSE lat END AS lat
FROM (SELECT *, {c.a:.17e} / sqrt(1 - {c.e2:.17e} * sin(p) * sin(p)) AS n, {c.a:.17e} * {1 - c.e2:.17e} / power(1 - {c.e2:.17e} * sin(p) * sin(p), 1.5) AS m FROM (
SELECT source_id, lon, lat, radians(lon) AS l, radians(lat) AS p, {DATUM} AS datum, {shift(0)} AS dx, {shift(1)} AS dy, {shift(2)} AS dz FROM (SELECT source_id, lon, lat, {REGION} AS region FROM {{stacks}}) r) a) b"""


@query(f"SELECT source_id, datum, round(lon, 7) AS lon, round(lat, 7) AS lat, cast(floor((lat - {FINE.y0}) / {FINE.dy}) AS int) AS row, cast(floor((lon - {FINE.x0}) / {FINE.dx}) AS int) AS col FROM ({moved_sql()}) m")
def shifted_stacks(spark, sf_dir):
    """Stacks on three datums, brought to WGS 84 and to cells of about a hundred metres."""
    stacks = run(spark, sf_dir, f"SELECT source_id, lon, lat, {DATUM} AS datum, {REGION} AS region FROM {{stacks}}")
    lon, lat = datums.to_wgs84(F.col("lon"), F.col("lat"), F.col("datum"), F.col("region"))
    moved = stacks.select("source_id", "datum", lon.alias("lon"), lat.alias("lat"))
    return grids.points_to_cells(moved, FINE, "lon", "lat").select("source_id", "datum", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "row", "col")


NODES = f"SELECT a.i - 126 AS i, b.j + 24 AS j, 0.0001 * ((a.i * 7) % 5) AS dlon, -0.0002 * ((b.j * 3) % 7) AS dlat FROM {numbers(62, 'a(i)')} CROSS JOIN {numbers(27, 'b(j)')} WHERE (a.i + b.j) % 11 <> 0"
AT_NODES = f"""SELECT s.source_id, round(s.lon + coalesce((1 - u) * (1 - v) * sw.dlon + u * (1 - v) * se.dlon + (1 - u) * v * nw.dlon + u * v * ne.dlon, 0), 9) AS lon, round(s.lat + coalesce((1 - u) * (1 - v) * sw.dlat + u * (1 - v) * se.dlat + (1 - u) * v * nw.dlat + u * v * ne.dlat, 0), 9) AS lat,
sw.i IS NOT NULL AND se.i IS NOT NULL AND nw.i IS NOT NULL AND ne.i IS NOT NULL AS shifted FROM (SELECT source_id, lon, lat, floor(lon) AS i, floor(lat) AS j, lon - floor(lon) AS u, lat - floor(lat) AS v FROM {{stacks}}) s
LEFT JOIN ({NODES}) sw ON sw.i = s.i AND sw.j = s.j LEFT JOIN ({NODES}) se ON se.i = s.i + 1 AND se.j = s.j LEFT JOIN ({NODES}) nw ON nw.i = s.i AND nw.j = s.j + 1 LEFT JOIN ({NODES}) ne ON ne.i = s.i + 1 AND ne.j = s.j + 1"""


@query(AT_NODES)
def stacks_shifted_by_nodes(spark, sf_dir):
    """Shifts between the four nodes of a square; squares without all of their nodes leave a stack where it is."""
    nodes = run(spark, sf_dir, NODES).withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long"), "dlon": F.col("dlon").cast("double"), "dlat": F.col("dlat").cast("double")})
    moved = datums.shift_by_nodes(view(spark, sf_dir, "stacks").select("source_id", "lon", "lat"), nodes, 1.0)
    return moved.select("source_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "shifted")


@query("SELECT source_id, round(radians(lon + 96.137) * 6370997.0 * cos(radians(30)), 3) AS x, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6370997.0 * cos(radians(30)), 3) AS y FROM {stacks}")
def stacks_on_mercator(spark, sf_dir):
    x, y = grids.project(F.col("lon"), F.col("lat"), Projection("mercator", 30.0, lon0=-96.137))
    return view(spark, sf_dir, "stacks").select("source_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


COVERED = f"SELECT 'mixed' AS srg_code, grid, shape_id, row, col, round(sum(weight * f), 9) AS weight, bool_or(covered) AS covered FROM (SELECT *, 0.5 AS f FROM ({surrogate_sql(1, '101')}) a UNION ALL SELECT *, 0.25 FROM ({surrogate_sql(2, '102')}) b) u GROUP BY ALL"


@query(COVERED)
def merged_surrogate_covered(spark, sf_dir):
    """A merged surrogate with its shapes' flag of lying on the grid."""
    both = surrogate_of(spark, sf_dir, 1, "101").unionByName(surrogate_of(spark, sf_dir, 2, "102"))
    merged = sg.merge_surrogates(both, {"mixed": {"101": 0.5, "102": 0.25}})
    return merged.select("srg_code", "grid", "shape_id", "row", "col", F.round("weight", 9).alias("weight"), "covered")


# --- shapes ----------------------------------------------------------------------------------------------------------


def ring(*corners: tuple[str, str]) -> Column:
    return F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in corners))


def box(x1: str, y1: str, x2: str, y2: str, hole: bool = False) -> Column:
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    return ring(*(reversed(corners) if hole else corners))


#: A frame's hole, by the columns of ``shapes``.
HOLE = ("x1 + 3", "y1 + 2", "x2 - 3 - shape_id % 3", "y2 - 2")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes with a hole; every other one has a triangle beside it."""
    rows = view(spark, sf_dir, "shapes")
    beside = F.when(F.col("shape_id") % 2 == 1, F.array(ring(("x2 + 1", "y1"), ("x2 + 4", "y1"), ("x2 + 1", "y1 + 3")))).otherwise(F.array().cast(geometry.RINGS))
    return rows.withColumn("rings", F.concat(F.array(box("x1", "y1", "x2", "y2"), box(*HOLE, hole=True)), beside))


TRIPLE = f"""SELECT shape_id AS id, 'polygon' AS kind, 2 + shape_id % 2 AS rings, 8 + 3 * (shape_id % 2) AS points, (x2 - x1) * (y2 - y1) - ({HOLE[2]} - ({HOLE[0]})) * ({HOLE[3]} - ({HOLE[1]})) + 4.5 * (shape_id % 2) AS size FROM {{shapes}}
UNION ALL SELECT 100 + shape_id, 'line', 1 + shape_id % 2, 3 + 2 * (shape_id % 2), (x2 - x1) + (y2 - y1) + 5.0 * (shape_id % 2) FROM {{shapes}} UNION ALL SELECT 200 + shape_id, 'point', 1 + shape_id % 2, 1 + shape_id % 2, 1.0 + shape_id % 2 FROM {{shapes}}"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, rings): frames, lines of one or two parts, one or two points."""
    rows = view(spark, sf_dir, "shapes")
    odd = F.col("shape_id") % 2 == 1
    with_second = lambda first, second: F.when(odd, F.array(first, second)).otherwise(F.array(first))
    lines = with_second(ring(("x1", "y1"), ("x2", "y1"), ("x2", "y2")), ring(("x1", "y1"), ("x1 + 3", "y1 + 4")))
    points = with_second(ring(("x1", "y2")), ring(("x2", "y1")))
    of = lambda df, first, kind, rings: df.select((F.col("shape_id") + first).alias("id"), F.lit(kind).alias("kind"), rings.alias("rings"))
    return of(frames(spark, sf_dir), 0, "polygon", F.col("rings")).unionByName(of(rows, 100, "line", lines)).unionByName(of(rows, 200, "point", points))


def measured(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", F.size("rings").alias("rings"), F.size(F.flatten("rings")).alias("points"), sg.size_of(F.col("kind"), F.col("rings")).alias("size"))


@query(TRIPLE)
def shapes_through_wkb(spark, sf_dir):
    """Shapes written as bytes and read again: holes, parts, lines and points keep their number and size."""
    return measured(geometry.read_wkb(geometry.write_wkb(mixed(spark, sf_dir))))


@query(TRIPLE)
def shapes_through_wkt(spark, sf_dir):
    """Shapes written as text and read again."""
    text = mixed(spark, sf_dir).select("id", geometry.wkt(F.col("kind"), F.col("rings")).alias("geometry"))
    return measured(text.select("id", geometry.kind_of_wkt(F.col("geometry")).alias("kind"), geometry.rings_of_wkt(F.col("geometry")).alias("rings")))


# --- surrogates of frames and triangles ------------------------------------------------------------------------------

TRIANGLES = "SELECT weight_id, x1, y1, x2, y2, attr FROM {weights}"


def frame_surrogate(spark: SparkSession, sf_dir: str, weights: DataFrame) -> DataFrame:
    """Frames, read from their bytes, against weights of (weight_id, kind, rings, attr)."""
    shapes = frames(spark, sf_dir).select("shape_id", F.lit("polygon").alias("kind"), F.slice("rings", 1, 2).alias("rings"))
    inputs = sg.input_shapes(geometry.read_wkb(geometry.write_wkb(shapes)).drop("kind"), GRID)
    return sg.create_surrogate(inputs, sg.weight_shapes(weights, GRID, ["attr"], [1.0]), GRID, "300")


def frame_sql(total: str, part, left: str = "x1", bottom: str = "y1") -> str:
    """Shares of frames: part(x1, y1, x2, y2) is the weight's size inside a box, total its whole size; left and bottom are its least coordinates."""
    cell = "(SELECT r.i AS row, c.i AS col, c.i * 5.0 AS cx1, r.i * 5.0 AS cy1, c.i * 5.0 + 5 AS cx2, r.i * 5.0 + 5 AS cy2 FROM " + numbers(7, "r(i)") + " CROSS JOIN " + numbers(8, "c(i)") + ")"
    cut = lambda a, b, c, d: part(f"greatest({a}, cx1)", f"greatest({b}, cy1)", f"greatest(greatest({a}, cx1), least({c}, cx2))", f"greatest(greatest({b}, cy1), least({d}, cy2))")
    w = f"(SELECT *, attr / {total} AS wt FROM {{weights}} WHERE attr > 0 AND {left} <= 40 AND {bottom} <= 35)"
    s = f"(SELECT shape_id, x1 AS sx1, y1 AS sy1, x2 AS sx2, y2 AS sy2, {', '.join(f'{h} AS h{i}' for i, h in enumerate(HOLE))}, x1 >= 0 AND y1 >= 0 AND x2 <= 40 AND y2 <= 35 AS covered FROM {{shapes}} WHERE x1 <= 40 AND y1 <= 35)"
    inside = f"({part('sx1', 'sy1', 'sx2', 'sy2')} - {part('h0', 'h1', 'h2', 'h3')})"
    in_cell = f"({cut('sx1', 'sy1', 'sx2', 'sy2')} - {cut('h0', 'h1', 'h2', 'h3')})"
    return f"""SELECT '300' AS srg_code, 'g5' AS grid, p.shape_id, p.row, p.col, round(p.size / t.total, 9) AS weight, p.covered FROM (SELECT shape_id, covered, row, col, sum(wt * {in_cell}) AS size FROM {s} s CROSS JOIN {w} w CROSS JOIN {cell} c GROUP BY ALL) p
JOIN (SELECT shape_id, sum(wt * {inside}) AS total FROM {s} s CROSS JOIN {w} w GROUP BY shape_id) t ON t.shape_id = p.shape_id WHERE p.size > 1e-9 * t.total"""


def below(x: str, y: str) -> str:
    """Area of a weight's triangle (x1, y1), (x2, y1), (x1, y2) to the left of x and below y."""
    u, v = f"greatest(0.0, least(1.0, ({x} - x1) / (x2 - x1)))", f"greatest(0.0, least(1.0, ({y} - y1) / (y2 - y1)))"
    return f"((x2 - x1) * (y2 - y1) * ({u} * {v} - power(greatest(0.0, {u} + {v} - 1), 2) / 2))"


def shares(df: DataFrame) -> DataFrame:
    return df.where("weight > 1e-9").withColumn("weight", F.round("weight", 9))


@query(frame_sql("6.0", lambda a, b, c, d: f"({below(c, d)} - {below(a, d)} - {below(c, b)} + {below(a, b)})"))
def surrogate_of_triangles(spark, sf_dir):
    """Frames against triangles: holes take away, slanted edges cross cells."""
    rows = view(spark, sf_dir, "weights").withColumn("rings", F.array(ring(("x1", "y1"), ("x2", "y1"), ("x1", "y2"))))
    return shares(frame_surrogate(spark, sf_dir, rows.select("weight_id", F.lit("polygon").alias("kind"), "rings", "attr")))


@query(frame_sql("(x2 - x1)", lambda a, b, c, d: f"(CASE WHEN y1 + 0.375 BETWEEN {b} AND {d} THEN greatest(0.0, least({c}, x2) - greatest({a}, x1)) ELSE 0.0 END)", bottom="y1 + 0.375"))
def surrogate_of_lines(spark, sf_dir):
    """Frames against level lines, by length."""
    rows = view(spark, sf_dir, "weights").withColumn("rings", F.array(ring(("x1", "y1 + 0.375"), ("x2", "y1 + 0.375"))))
    return shares(frame_surrogate(spark, sf_dir, rows.select("weight_id", F.lit("line").alias("kind"), "rings", "attr")))


@query(frame_sql("1.0", lambda a, b, c, d: f"(CASE WHEN x1 + 0.625 BETWEEN {a} AND {c} AND y1 + 0.375 BETWEEN {b} AND {d} THEN 1.0 ELSE 0.0 END)", "x1 + 0.625", "y1 + 0.375"))
def surrogate_of_points(spark, sf_dir):
    """Frames against points, by their number."""
    rows = view(spark, sf_dir, "weights").withColumn("rings", F.array(ring(("x1 + 0.625", "y1 + 0.375"))))
    return shares(frame_surrogate(spark, sf_dir, rows.select("weight_id", F.lit("point").alias("kind"), "rings", "attr")))


@query(f"SELECT srg_code, grid, shape_id, row, col, round(weight, 9) AS weight, covered FROM ({surrogate_sql(2, '102')}) s")
def surrogate_without_kinds(spark, sf_dir):
    """Weights whose attribute is none of two values."""
    rows = view(spark, sf_dir, "weights").where(sg.attribute_filter(F.col("kind").cast("string"), ["0", "1"], False)).withColumn("rings", F.array(box("x1", "y1", "x2", "y2")))
    inputs = sg.input_shapes(view(spark, sf_dir, "shapes").select("shape_id", F.array(box("x1", "y1", "x2", "y2")).alias("rings")), GRID)
    weights = sg.weight_shapes(rows.select("weight_id", F.lit("polygon").alias("kind"), "rings", "attr"), GRID, ["attr"], [1.0])
    return sg.create_surrogate(inputs, weights, GRID, "102").withColumn("weight", F.round("weight", 9))


@query("SELECT shape_id, 5 AS points, (x2 - x1) * (y2 - y1) + (x2 - x1) * 2 / 2 AS size FROM {shapes}")
def simplified_shapes(spark, sf_dir):
    """Boxes with a peak of 2 on one side, and bends below the tolerance on the others, which go."""
    bent = ring(("x1", "y1"), ("x1 + 4", "y1 + 0.01"), ("x1 + 8", "y1"), ("x2", "y1"), ("x2 - 0.02", "y1 + 5"), ("x2", "y2"), ("(x1 + x2) / 2", "y2 + 2"), ("x1", "y2"))
    thin = sg.simplify(view(spark, sf_dir, "shapes").select("shape_id", F.array(bent).alias("rings")), 0.1)
    return thin.select("shape_id", F.size(F.flatten("rings")).alias("points"), F.round(sg.size_of(F.lit("polygon"), F.col("rings")), 9).alias("size"))


# --- nested domains --------------------------------------------------------------------------------------------------

#: d01 over the country, d02 in it by 3, d03 in that by 5.
DOMAINS = {"ref_x": None, "ref_y": None, "dx": 1.0, "dy": 1.0, "parents": [1, 1, 2], "ratios": [1, 3, 5], "i_start": [1, 10, 21], "j_start": [1, 8, 11], "e_we": [61, 61, 101], "e_sn": [31, 31, 51], "lon0": -96.137, "lat0": 37.713, "lonlat": True}
#: Origin and step of each, by the rule: a domain begins at its parent's (start - 1)th edge and divides its cells.
D01 = (-96.137 - (61 / 2 - 0.5), 37.713 - (31 / 2 - 0.5), 1.0, 60, 30)
D02 = (D01[0] + 9 * 1.0, D01[1] + 7 * 1.0, 1.0 / 3, 60, 30)
D03 = (D02[0] + 20 / 3, D02[1] + 10 / 3, 1.0 / 15, 100, 50)


@query(" UNION ALL ".join(f"SELECT 'd0{k}' AS grid, source_id, cast(floor((lat - {y0!r}) / {step!r}) AS int) AS row, cast(floor((lon - {x0!r}) / {step!r}) AS int) AS col FROM {{stacks}} WHERE lon >= {x0!r} AND lon < {x0 + nx * step!r} AND lat >= {y0!r} AND lat < {y0 + ny * step!r}" for k, (x0, y0, step, nx, ny) in enumerate((D01, D02, D03), 1)))
def stacks_in_domains(spark, sf_dir):
    """Stacks in the cells of three nested domains."""
    stacks = view(spark, sf_dir, "stacks").select("source_id", "lon", "lat")
    parts = [grids.points_to_cells(stacks, g, "lon", "lat") for g in grids.nested_grids(**DOMAINS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("grid", "source_id", "row", "col")



