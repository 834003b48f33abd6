"""Hand-worked cases for matching, time, space, meteorology and scaling."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroflux.functions import periods
from aeroflux.operators import rings as geo
from aeroflux.operators import gridding, grids, matching, met, scaling, speciation, surrogates, temporal
from aeroflux.operators.grids import Grid, Projection


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def test_hierarchical_matching(spark):
    ref = spark.createDataFrame([("2200000000", "00000", 1), ("2201000000", "36000", 2), ("2201000000", "00000", 3)], "scc string, fips string, code int")
    df = spark.createDataFrame([("2201001110", "36061"), ("2201001110", "34001"), ("2202000000", "36061"), ("1000000000", "36061")], "scc string, fips string")
    got = {(r["scc"], r["fips"]): r["code"] for r in matching.match_code_double(df, "scc", "fips", ref, "scc", "fips", "code").collect()}
    assert got == {("2201001110", "36061"): 2, ("2201001110", "34001"): 3, ("2202000000", "36061"): 1, ("1000000000", "36061"): None}
    with pytest.raises(Exception, match="no code for"):
        matching.match_code_double(df, "scc", "fips", ref, "scc", "fips", "code", required=True).collect()


def test_periods(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    got = one(spark, x=1).select(periods.period_of(t("2011-02-01"), t("2011-03-01")).alias("feb"), periods.period_of(t("2012-01-01"), t("2013-01-01")).alias("year"), periods.hours_in_year(t("2012-06-01")).alias("h"), periods.weeks_in_month(t("2011-02-10")).alias("w")).first()
    assert (got["feb"], got["year"], got["h"], got["w"]) == (2, 0, 8784, 4.0)
    with pytest.raises(Exception, match="no period"):
        one(spark, x=1).select(periods.period_of(t("2011-02-01"), t("2011-02-02"))).collect()


def test_lambert_golden(spark):
    """A known point on the sphere of 6370997 m with parallels 33 and 45."""
    x, y = grids.project(F.lit(-73.9712), F.lit(40.7831), Projection("lcc", 33.0, 45.0, 40.0, -97.0))
    got = one(spark, a=1).select(x.alias("x"), y.alias("y")).first()
    assert got["x"] == pytest.approx(1908562.0728963248, abs=1e-3) and got["y"] == pytest.approx(329746.43597362953, abs=1e-3)
    mx, my = grids.project(F.lit(10.0), F.lit(0.0), Projection("mercator"))
    got = one(spark, a=1).select(mx.alias("x"), my.alias("y")).first()
    assert got["x"] == pytest.approx(math.radians(10) * grids.SPHERE) and got["y"] == pytest.approx(0, abs=1e-6)


def test_regular_grid_and_edges(spark):
    grid = Grid("g", 4, 4, 20000.0, 20000.0, 1870000.0, 280000.0)
    cells = grids.regular_grid(spark, grid)
    assert cells.count() == 16 and cells.where("row = 3 AND col = 1").first()["xmin"] == 1890000
    points = spark.createDataFrame([(1, 1871000.0, 281000.0), (2, 1890000.0, 281000.0), (3, 1890000.0, 300000.0), (4, 0.0, 0.0), (5, 1870000.0, 280000.0)], "id int, x double, y double")
    got = {}
    for r in grids.points_to_cells(points, grid).collect():
        got.setdefault(r["id"], []).append((r["row"], r["col"], r["weight"]))
    assert got[1] == [(0, 0, 1.0)] and sorted(got[2]) == [(0, 0, 0.5), (0, 1, 0.5)] and len(got[3]) == 4 and 4 not in got and got[5] == [(0, 0, 1.0)]


def test_nested_grids():
    outer, inner = grids.nested_grids(None, None, 12.0, 12.0, [1, 1], [1, 3], [1, 5], [1, 6], [41, 31], [21, 16])
    assert (outer.name, outer.nx, outer.ny, outer.x0, outer.y0) == ("d01", 40, 20, -(20.5 - 0.5) * 12, -(10.5 - 0.5) * 12)
    assert (inner.nx, inner.ny, inner.dx, inner.x0, inner.y0) == (30, 15, 4.0, outer.x0 + 48, outer.y0 + 60)


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


GEOMETRY = "array<array<struct<x:double,y:double>>>"


def test_surrogate_with_holes_lines_and_points(spark):
    grid = Grid("g", 4, 4, 1.0, 1.0, 0.0, 0.0)
    # an L-shape and a square with a hole that is wound the other way
    shapes = spark.createDataFrame([("L", [ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3))]), ("O", [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 3), (3, 3), (3, 1))]), ("off", [ring((3, 3), (6, 3), (6, 4), (3, 4))])], f"shape_id string, rings {GEOMETRY}")
    inputs = surrogates.input_shapes(shapes, grid)
    assert {r["shape_id"]: r["covered"] for r in inputs.collect()} == {"L": True, "O": True, "off": False}
    weights = spark.createDataFrame([(1, "polygon", [ring((0, 0), (6, 0), (6, 6), (0, 6))], 36.0), (2, "polygon", [ring((9, 9), (10, 9), (10, 10))], 1.0)], f"weight_id int, kind string, rings {GEOMETRY}, pop double")
    got = {}
    for r in surrogates.create_surrogate(inputs, surrogates.weight_shapes(weights, grid, ["pop"], [1.0]), grid, "1").collect():
        got.setdefault(r["shape_id"], {})[r["row"], r["col"]] = r["weight"]
    assert got["L"] == pytest.approx({(0, 0): 0.2, (0, 1): 0.2, (0, 2): 0.2, (1, 0): 0.2, (2, 0): 0.2})
    assert len(got["O"]) == 12 and sum(got["O"].values()) == pytest.approx(1) and (1, 1) not in got["O"]
    assert got["off"] == pytest.approx({(3, 3): 1 / 3})  # the denominator counts what lies off the grid
    lines = spark.createDataFrame([(1, "line", [ring((0.5, 0.5), (2.5, 0.5))], 4.0), (2, "point", [ring((0.5, 2.5), (2, 2))], 3.0)], f"weight_id int, kind string, rings {GEOMETRY}, pop double")
    made = surrogates.weight_shapes(lines, grid, ["pop"], [1.0])
    assert {r["kind"]: r["weight"] for r in made.collect()} == {"line": 2.0, "point": 3.0}
    only = surrogates.create_surrogate(inputs.where("shape_id = 'L'"), made, grid, "1").collect()
    # 2.0 for each unit of line (half, one, half) and 3.0 for the point inside
    assert {(r["row"], r["col"]): r["weight"] for r in only} == pytest.approx({(0, 0): 1 / 7, (0, 1): 2 / 7, (0, 2): 1 / 7, (2, 0): 3 / 7})


def flat(*rows):
    """Rows of rings as arrays."""
    rings = [(k, r) for k, row in enumerate(rows) for r in row]
    points = [p for _, r in rings for p in r]
    return geo.Rings(np.array([p[0] for p in points], float), np.array([p[1] for p in points], float), np.array([len(r) for _, r in rings], int), np.array([k for k, _ in rings], int))


def inside(x, y, ring):
    return sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def test_random_shapes_against_sampling(monkeypatch):
    import random

    monkeypatch.setattr(geo, "BLOCK", 50)  # many blocks
    rng = random.Random(2)
    star = lambda: [(0.5 + r * math.cos(a), 0.5 + r * math.sin(a)) for a, r in ((2 * math.pi * k / 9, rng.uniform(0.1, 0.5)) for k in range(9))]
    rows = [(star(), star()) for _ in range(5)]
    n = 120
    # all rows at once, the last one with nothing in common
    areas = geo.common_sizes("polygon", flat(*[[a] for a, _ in rows], []), flat(*[[b] for _, b in rows], [rows[0][1]]), 6)
    for (a, b), area in zip(rows, areas):
        hits = sum(inside((i + 0.5) / n, (j + 0.5) / n, a) and inside((i + 0.5) / n, (j + 0.5) / n, b) for i in range(n) for j in range(n))
        assert area == pytest.approx(hits / n / n, abs=0.01)
    lengths = geo.common_sizes("line", flat(*[[[(0, 0.4), (1, 0.7)]] for _ in rows]), flat(*[[b] for _, b in rows]), 5)
    counts = geo.common_sizes("point", flat(*[[a, [(0.5, 0.5), (0.99, 0.99)]] for a, _ in rows]), flat(*[[b] for _, b in rows]), 5)
    for (a, b), length, count in zip(rows, lengths, counts):
        steps = [inside((i + 0.5) / 2000, 0.4 + 0.3 * (i + 0.5) / 2000, b) for i in range(2000)]
        assert length == pytest.approx(math.hypot(1, 0.3) * sum(steps) / 2000, abs=0.002)
        assert count == sum(inside(x, y, b) for x, y in [*a, (0.5, 0.5), (0.99, 0.99)])
    edges = flat([[(0, 0), (2, 0), (2, 2), (0, 2)]])
    assert geo.common_sizes("point", flat([[(0, 0), (2, 1), (1, 2), (3, 0), (1, 1)]]), edges, 1)[0] == 4  # edges and corners count


def test_surrogate_failures_and_filters(spark):
    grid = Grid("g", 4, 4, 1.0, 1.0, 0.0, 0.0)
    bad = spark.createDataFrame([(1, "line", [ring((1, 1), (1, 1))], 1.0)], f"weight_id int, kind string, rings {GEOMETRY}, pop double")
    with pytest.raises(Exception, match="no length"):
        surrogates.weight_shapes(bad, grid, ["pop"], [1.0]).collect()
    df = spark.createDataFrame([("1",), ("2",), ("3",)], "t string")
    keep = lambda **k: [r["t"] for r in df.where(surrogates.attribute_filter(F.col("t"), ["1", "2"], **k)).collect()]
    assert keep(equal=True) == ["1", "2"] and keep(equal=False) == ["3"] and keep(equal=False, compat=True) == ["1", "2", "3"]
    refs = spark.createDataFrame([(0, "1", "2", "a")], "country int, scc string, fips string, code string")
    with pytest.raises(Exception, match="conflicting"):
        surrogates.merge_grid_refs(refs, refs.withColumn("code", F.lit("b"))).collect()
    assert surrogates.resolve_merges({"a": [(0.5, "b"), (0.5, "c")], "b": [(0.2, "c"), (0.8, "d")], "c": []})["a"] == pytest.approx({"c": 0.6, "d": 0.4})
    with pytest.raises(ValueError):
        surrogates.resolve_merges({"a": [(1.0, "a")]})


def test_simplify(spark):
    thin = geo.thinned(flat([[(0, 0), (1, 0.01), (2, 0), (3, 1), (4, 0)], []]), 0.1)
    assert list(zip(thin.x, thin.y)) == [(0, 0), (2, 0), (3, 1), (4, 0)] and list(thin.n) == [4, 0]
    shape = spark.createDataFrame([(1, [ring((0, 0), (1, 0.001), (2, 0), (2, 2))])], f"shape_id int, rings {GEOMETRY}")
    assert len(surrogates.simplify(shape, 0.01).first()["rings"][0]) == 3 and surrogates.simplify(shape, 0.0) is shape


def test_standard_time_and_shares(spark):
    t = F.lit("2024-07-01 12:00:00").cast("timestamp")
    got = one(spark, a=1).select(temporal.standard_time(t, F.lit("America/New_York")).alias("ny"), temporal.standard_time(t, F.lit("Australia/Sydney")).alias("sy"), temporal.local_time(t, F.lit("America/New_York")).alias("local")).first()
    assert [str(got[c]) for c in ("ny", "sy", "local")] == ["2024-07-01 07:00:00", "2024-07-01 22:00:00", "2024-07-01 08:00:00"]
    measured = dict(nox=2.0, so2=None, gload=1.0, sload=0.0, heat=3.0, nox_sum=8.0, so2_sum=0.0, gload_sum=10.0, sload_sum=0.0, heat_sum=30.0)
    df = one(spark, **measured).withColumn("so2", F.col("so2").cast("double"))
    got = df.select(*[temporal.cem_share(F.lit(p)).alias(p) for p in ("NO2", "SO2", "VOC")]).first()
    assert (got["NO2"], got["SO2"], got["VOC"]) == (0.25, 0.1, 0.1)


def test_profiles_spread_a_year(spark):
    flat = [("monthly", "m", i, 1 / 12) for i in range(12)] + [("weekly", "w", i, 1 / 7) for i in range(7)] + [(k, "d", i, 1 / 24) for k in ("diurnal weekday", "diurnal weekend") for i in range(24)]
    profiles = spark.createDataFrame(flat, "kind string, code string, slot int, fraction double")
    holidays = spark.createDataFrame([("2023-07-04",)], "day string").select(F.to_date("day").alias("day"))
    t = lambda s: F.lit(s).cast("timestamp")
    emissions = one(spark, fips="1", month_code="m", week_code="w", day_code="d", tz="UTC", pollutant="NOX", prefix="", rate=2.0, unit="kg/s").withColumn("begin_ts", t("2023-01-01")).withColumn("end_ts", t("2024-01-01"))
    hours = temporal.steps(one(spark, a=1), t("2023-01-01"), t("2024-01-01")).select("hour_ts")
    out = temporal.hourly_emissions(emissions, hours, profiles, holidays)
    assert out.count() == 8760 and out.agg(F.sum("amount")).first()[0] == pytest.approx(2 * 365 * 86400)
    odd = temporal.hourly_emissions(emissions.withColumn("month_code", F.lit("zzz")), hours.limit(1), profiles, holidays)
    with pytest.raises(Exception, match="no temporal profile"):
        odd.collect()
    assert temporal.steps(one(spark, a=1), t("2023-01-01"), t("2023-01-01"), 3).count() == 1


def test_measured_hours(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    cem = spark.createDataFrame([("1", "B", "230101 00", 1.0, 0.0, 5.0, 0.0, 4.0), ("1", "B", "230101 01", 3.0, 0.0, 5.0, 0.0, 4.0), ("2", "B", "230101 00", 1.0, 1.0, 0.0, 0.0, 0.0)], "oris string, boiler string, hour_key string, nox float, so2 float, gload float, sload float, heat float")
    assert [r["oris"] for r in temporal.cem_sums(cem).collect()] == ["1"]
    rows = one(spark, oris="1", boiler="B", tz="UTC", pollutant="NOX", rate=1.0, unit="kg/s").withColumn("begin_ts", t("2023-01-01")).withColumn("end_ts", t("2023-01-02"))
    hours = temporal.steps(one(spark, a=1), t("2023-01-01"), t("2023-01-01 03:00:00")).select("hour_ts")
    got = [r["amount"] for r in temporal.hourly_by_cem(rows, hours, cem).orderBy("hour_ts").collect()]
    assert got == pytest.approx([86400 / 4, 86400 * 3 / 4, 0])


def test_plume_layers(spark):
    levels = [(0, 0, k, 100.0 * k, 290.0, 2.0, k > 3, 0.0004) for k in range(8)]
    air = spark.createDataFrame(levels, "row int, col int, k int, height double, temp double, wind double, stable boolean, s1 double")
    stacks = spark.createDataFrame([("low", 0, 0, 50.0, 1.0, 295.0, 12.0), ("hot", 0, 0, 50.0, 2.0, 400.0, 5.0), ("high", 0, 0, 450.0, 3.0, 450.0, 20.0), ("off", 9, 9, 50.0, 1.0, 300.0, 5.0)], "id string, row int, col int, height_m double, diam_m double, temp_k double, vel_ms double")
    got = {r["id"]: r["layer"] for r in met.plume_layer(stacks, air, ["row", "col"], 8).collect()}
    momentum = 12**1.4 / 2**1.4  # the momentum formula: about 12 m on top of 50 m
    buoyancy = 9.80665 * 110 / 400 * 5 * 1
    hot = 50 + 7.4 * (buoyancy * 2500) ** (1 / 3) / 2
    stable = 450 + 29 * (9.80665 * 160 / 450 * 20 * 2.25 / 0.0004) ** (1 / 3) / 2 ** (1 / 3)
    layer = lambda z: next((k for k in range(7) if 100 * (k + 1) >= z), 6)
    assert got == {"low": layer(50 + momentum), "hot": layer(hot), "high": layer(stable), "off": 0}
    assert {r["layer"] for r in met.plume_layer(stacks, air, ["row", "col"], 1).collect()} == {0}


def test_trends(spark):
    trends = spark.createDataFrame([("36", "01", "NOX", 2005, 10.0), ("36", "01", "NOX", 2010, 5.0), ("36", "02", "NOX", 2005, 0.0), ("36", "02", "NOX", 2010, 5.0), ("06", "01", "VOC", 2005, 2.0), ("06", "01", "VOC", 2010, 3.0)], "state string, tier1 string, pol string, yr int, emis double")
    factors = scaling.trend_factors(trends, 2005, 2010)
    tier1 = spark.createDataFrame([("1", "01"), ("2", "02")], "scc string, tier1 string")
    rows = [("36061", "1", 0, "NO2", 0.5), ("36061", "2", 0, "NO", 0.0), ("72001", "1", 0, "NO", 1.0), ("85001", "1", 0, "PAR", 1.5), ("36061", "9", 1, "NO", 1.0), ("36061", "1", 0, "CO", 1.0)]
    df = spark.createDataFrame(rows, "fips string, scc string, country int, pollutant string, want double").withColumn("rate", F.lit(1.0))
    assert all(r["rate"] == r["want"] for r in scaling.apply_trends(df, tier1, factors).collect())
    with pytest.raises(Exception, match="no tier"):
        scaling.apply_trends(df.withColumn("country", F.lit(0)), tier1, factors).collect()
    with pytest.raises(ValueError):
        scaling.trend_factors(trends, 2005, 1999)


def test_speciation_types_and_failures(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    data = speciation.SpeciationData(
        speciation=spark.createDataFrame([("VOC", "VOC"), ("NOX", ""), ("DUST", "")], "pollutant_key string, spec_type string"),
        spec_names=spark.createDataFrame([("NOX", 0, "Ethane", True)], "pollutant_key string, pos int, name string, grouped boolean"),
        spec_profile=spark.createDataFrame([("DUST", "SOIL", 0.4)], "pollutant_key string, species string, factor double"),
        species=spark.createDataFrame([("1", "Ethane", 30.0), ("2", "Benzene", 78.0)], "species_id string, name string, mw double"),
        voc_to_tog=spark.createDataFrame([("8", 1.25)], "code string, factor double"),
        profiles=spark.createDataFrame([("voc", "8", "1", 0.25), ("voc", "8", "2", 0.75)], "kind string, code string, species_id string, fraction double"),
        spec_ref=spark.createDataFrame([("22", "VOC", "8")], "scc string, pol string, code string"),
        spec_combo=spark.createDataFrame([], "period int, pol string, country_fips string, code string, fraction double"),
        group_factors=speciation.group_factors(spark.createDataFrame([("M", "1", "PAR", 2.0), ("M", "2", "PAR", 1.0), ("M", "2", "UNR", 5.0)], "mech string, species_id string, grp string, ratio double"), spark.createDataFrame([("M", "PAR", "mol", 14.0), ("M", "UNR", "mol", 16.0)], "mech string, grp string, basis string, mw double"), spark.createDataFrame([("1", 30.0), ("2", 78.0)], "species_id string, mw double")),
    )
    rows = [("a", "VOC", 100.0), ("b", "VOC", 100.0), ("b", "NOX", 10.0), ("c", "DUST", 10.0)]
    df = spark.createDataFrame(rows, "record_key string, pollutant string, rate double").select("*", F.lit("").alias("prefix"), F.lit("22").alias("scc"), F.lit("36061").alias("fips"), F.lit(0).alias("country"), t("2011-01-01").alias("begin_ts"), t("2012-01-01").alias("end_ts"), F.lit("kg/s").alias("unit"))
    out, dropped = speciation.speciate(df, data, "M")
    got = {}
    for r in out.collect():
        got[r["record_key"], r["pollutant"], r["unit"]] = got.get((r["record_key"], r["pollutant"], r["unit"]), 0) + r["rate"]
    assert got == pytest.approx({("a", "PAR", "kmol/s"): 31.25 * 2 / 30 + 93.75 / 78, ("a", "UNR", "kmol/s"): 93.75 * 5 / 78, ("b", "PAR", "kmol/s"): 93.75 / 78 + 10 * 2 / 30, ("b", "UNR", "kmol/s"): 93.75 * 5 / 78, ("c", "SOIL", "kg/s"): 4.0})
    assert [(r["record_key"], r["pollutant"], r["rate"]) for r in dropped.collect()] == [("b", "Ethane", 31.25)]
    mass, _ = speciation.speciate(df.where("record_key = 'a'"), data, "M", mass=True)
    assert mass.agg(F.sum("rate")).first()[0] == pytest.approx(125)
    with pytest.raises(Exception, match="no speciation"):
        speciation.speciate(df.withColumn("pollutant", F.lit("XYZ")), data, "M")[0].collect()


def test_sinks(spark, tmp_path):
    cells = grids.regular_grid(spark, Grid("g", 2, 1, 1.0, 1.0, 0.0, 0.0))
    assert gridding.export_grid(cells).where("col = 0").first()["geometry"] == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 1.0, 0.0 0.0))"
    made = spark.createDataFrame([("1", "g", "s", 0, 1, 0.5, True)], "srg_code string, grid string, shape_id string, row int, col int, weight double, covered boolean")
    assert gridding.export_surrogate(made, cells).first()["covered"] == "T"
    hourly = cells.select("grid", "row", "col", F.lit("2024-01-02 03:00:00").cast("timestamp").alias("hour_ts"), F.lit(1.5).alias("value"))
    gridding.write_gridded(hourly, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2 and {str(r["date"]) for r in back.collect()} == {"2024-01-02"}
    gridding.write_table(hourly.drop("hour_ts"), str(tmp_path / "tab"), tabs=True)
    assert spark.read.csv(str(tmp_path / "tab"), sep="\t", header=True).count() == 2
    unit = one(spark, v=2.0, u="kmol", k="kg").select(gridding.per_area(F.col("v"), F.col("u"), 2.0, 1.0).alias("gas"), gridding.per_area(F.col("v"), F.col("k"), 2.0, 1.0).alias("pm")).first()
    assert unit["gas"] == 1000 and unit["pm"] == pytest.approx(2e9 / 2000 / 1000 / 3600)


def test_points_with_one_name_keep_their_own_weights(spark):
    shapes = spark.createDataFrame([(k, [[(x, y) for x, y in ((k, 0.0), (k + 1.0, 0.0), (k + 1.0, 1.0), (k, 1.0))]]) for k in (0.0, 1.0)], "shape_id double, rings array<array<struct<x:double,y:double>>>")
    cells = grids.irregular_grid(shapes.withColumn("shape_id", F.col("shape_id").cast("int")), "poly", "shape_id")
    points = spark.createDataFrame([("s", 1.0, 0.5), ("s", 0.5, 0.5), (None, 1.5, 0.25), (None, 9.0, 9.0)], "source_id string, x double, y double")
    got = sorted((r["x"], r["row"], r["weight"]) for r in grids.points_to_irregular(points, cells, 10.0).collect())
    assert got == [(0.5, 0, 1.0), (1.0, 0, 0.5), (1.0, 1, 0.5), (1.5, 1, 1.0)]


def test_air_without_warmth_or_thickness(spark):
    rows = [(0, 0, 20.0, 0.0), (0, 1, 21.0, 40.0), (0, 2, 25.0, 40.0)]
    air = spark.createDataFrame(rows, "c int, k int, theta double, height double")
    got = met.stability(air, ["c"], F.col("theta"), F.lit(100000.0), F.col("height")).orderBy("k").collect()
    assert got[0]["dtheta_dz"] == 0 and got[1]["dtheta_dz"] == pytest.approx(1 / 40) and got[2]["dtheta_dz"] is None
    for theta, pressure in ((F.col("theta") - 320.0, F.lit(1e5)), (F.col("theta"), F.lit(0.0))):
        with pytest.raises(Exception, match="over 0"):
            met.stability(air, ["c"], theta, pressure, F.col("height")).collect()


def test_matching_levels_equal_all_fallbacks(spark):
    """The level index finds what trying every fallback finds, also with zeros inside codes and lengths that differ."""
    rng = random.Random(3)
    code = lambda n: "".join(rng.choices("0012", k=n))
    ref = {}
    for _ in range(60):
        ref.setdefault((code(4)[: rng.randint(0, 4)].ljust(4, "0"), code(3)[: rng.randint(0, 3)].ljust(3, "0")), len(ref))
    ref |= {("00000", "000"): 900, ("0", "000"): 901}
    pairs = {(code(rng.choice([4, 4, 4, 5, 1, 0])), code(3)) for _ in range(300)} | {(None, "000"), ("0000", None)}
    tries = lambda c: [c[: len(c) - i] + "0" * i for i in range(len(c) + 1)]
    want = {(a, b): next((ref[x, y] for x in tries(a) for y in tries(b) if (x, y) in ref), None) if a is not None and b is not None else None for a, b in pairs}
    frame = spark.createDataFrame(list(pairs), "a string, b string")
    table = spark.createDataFrame([(x, y, v) for (x, y), v in ref.items()] + [(None, "000", 950)], "x string, y string, v int")
    got = {(r["a"], r["b"]): r["v"] for r in matching.match_code_double(frame, "a", "b", table, "x", "y", "v").collect()}
    assert got == want
    one = {x: v for (x, y), v in ref.items() if y == "000"}
    single = {r["a"]: r["v"] for r in matching.match_code(frame.select("a").distinct(), "a", table.where("y = '000' AND x IS NOT NULL"), "x", "v").collect()}
    assert single == {a: next((one[x] for x in tries(a) if x in one), None) if a is not None else None for a in {p[0] for p in pairs}}
    assert [r["v"] for r in matching.match_code(frame.limit(3), "a", table.limit(0), "x", "v").collect()] == [None] * 3


def test_speciation_of_every_type(spark):
    """One record of each type, grouped singles and combinations among them, against rates worked out by hand."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    species = frame([("1", "ethane", 30.0), ("2", "benzene", 78.0), ("9", "benzene", 80.0), ("3", "NO", 30.0)], "species_id string, name string, mw double")
    data = speciation.SpeciationData(
        speciation=frame([("VOC", "VOC"), ("EXH__VOC", "VOCUngrouped"), ("NOX", "NOx"), ("PM25", "PM2.5"), ("BENZ", "Single"), ("GRP", ""), ("DIRECT", "")], "pollutant_key string, spec_type string"),
        spec_names=frame([("BENZ", 0, "benzene", False), ("BENZ", 1, "ethane", False), ("GRP", 0, "benzene", True)], "pollutant_key string, pos int, name string, grouped boolean"),
        spec_profile=frame([("DIRECT", "A", 0.25), ("DIRECT", "B", 0.75)], "pollutant_key string, species string, factor double"),
        species=species,
        voc_to_tog=frame([("p1", 2.0), ("p2", 1.0)], "code string, factor double"),
        profiles=frame([("voc", "p1", "1", 0.5), ("voc", "p1", "2", 0.5), ("voc", "p2", "1", 1.0), ("gas", "g", "3", 1.0), ("pm", "m", "3", 1.0)], "kind string, code string, species_id string, fraction double"),
        spec_ref=frame([("10", "VOC", "COMBO"), ("20", "VOC", "p1"), ("00", "NOX", "g"), ("00", "PM25", "m"), ("20", "EXH__VOC", "p2")], "scc string, pol string, code string"),
        spec_combo=frame([(0, "VOC", "001000", "p1", 0.5), (0, "VOC", "001000", "p2", 0.5)], "period int, pol string, country_fips string, code string, fraction double"),
        group_factors=speciation.group_factors(frame([("M", "1", "PAR", 2.0), ("M", "2", "PAR", 1.0), ("M", "2", "UNR", 5.0)], "mech string, species_id string, grp string, ratio double"), frame([("M", "PAR", "mol", 14.0), ("M", "UNR", "mol", 16.0)], "mech string, grp string, basis string, mw double"), species.select("species_id", "mw")),
    )
    year = "TIMESTAMP '2005-01-01'", "TIMESTAMP '2006-01-01'"
    rows = [("a", "VOC", "", "20"), ("b", "VOC", "", "11"), ("b", "BENZ", "", "11"), ("c", "VOC", "EXH", "21"), ("d", "NOX", "", "55"), ("d", "PM25", "", "55"), ("e", "GRP", "", "20"), ("f", "DIRECT", "", "20")]
    df = frame([(k, "s", "f", "01001", scc, 0, pol, pre, 60.0, "kg/s") for k, pol, pre, scc in rows], "record_key string, sector string, file string, fips string, scc string, country int, pollutant string, prefix string, rate double, unit string").selectExpr("*", f"{year[0]} AS begin_ts", f"{year[1]} AS end_ts")
    out, dropped = speciation.speciate(df, data, "M", partial=True)
    got = {}
    for r in out.collect():
        got[r["record_key"], r["pollutant"]] = got.get((r["record_key"], r["pollutant"]), 0) + r["rate"]
    want = {
        ("a", "PAR"): 60 * 2.0 * (0.5 * 2 / 30 + 0.5 / 78), ("a", "UNR"): 60 * 2.0 * 0.5 * 5 / 78,
        ("b", "PAR"): 0.0, ("b", "benzene"): 60 / 78,
        ("c", "ethane"): 60 / 30, ("d", "NO"): 60 / 30 + 60, ("e", "PAR"): 60 / 78, ("e", "UNR"): 300 / 78, ("f", "A"): 15.0, ("f", "B"): 45.0,
    }
    del want["b", "PAR"]  # both of its species are stated by the record's single pollutant
    assert got == pytest.approx(want)
    gone = {(r["record_key"], r["pollutant"]): 0.0 for r in dropped.collect()}
    for r in dropped.collect():
        gone[r["record_key"], r["pollutant"]] += r["rate"]
    assert gone == pytest.approx({("b", "ethane"): 60 * 0.5 * 2 * 0.5 + 60 * 0.5, ("b", "benzene"): 60 * 0.5 * 2 * 0.5})
    for rows_of, sums_of in zip(speciation.speciate(df, data, "M", partial=True), speciation.speciated_totals(df, data, "M", ["record_key"], partial=True)):
        by_row = {(r["record_key"], r["pollutant"], r["unit"][:-2]): r["total"] for r in rows_of.groupBy("record_key", "pollutant", "unit").agg((F.sum("rate") * 365 * 86400).alias("total")).collect()}
        assert {(r["record_key"], r["pollutant"], r["unit"]): r["total"] for r in sums_of.collect()} == pytest.approx(by_row)
    with pytest.raises(Exception, match="no combination"):
        speciation.speciate(df.where("record_key = 'b'").withColumn("fips", F.lit("99999")), data, "M", partial=True)[0].collect()
    with pytest.raises(Exception, match="no speciation profile"):
        speciation.speciate(df.where("record_key = 'a'").withColumn("scc", F.lit("77")), data, "M")[0].collect()
