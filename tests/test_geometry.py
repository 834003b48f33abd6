"""Datums against the exact geocentric shift; geometry as bytes and text against structs packed by hand; as-of joins."""

import datetime as dt
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from aeroflux.operators import asof, datums
from aeroflux.operators import surrogates as sg
from aeroflux.operators.grids import Projection
from aeroflux.sources import geometry, inventory


def by_geocentre(lon, lat, shift, of=datums.CLARKE_1866, to=datums.WGS84):
    """Through the earth's centre and back, by iteration."""
    p, q = math.radians(lat), math.radians(lon)
    n = of.a / math.sqrt(1 - of.e2 * math.sin(p) ** 2)
    x, y, z = n * math.cos(p) * math.cos(q) + shift[0], n * math.cos(p) * math.sin(q) + shift[1], n * (1 - of.e2) * math.sin(p) + shift[2]
    r = math.hypot(x, y)
    f = math.atan2(z, r * (1 - to.e2))
    for _ in range(20):
        n = to.a / math.sqrt(1 - to.e2 * math.sin(f) ** 2)
        f = math.atan2(z, r * (1 - to.e2 * n / (n + r / math.cos(f) - n)))
    return math.degrees(math.atan2(y, x)), math.degrees(f)


def test_nad27_agrees_with_the_geocentric_shift(spark):
    places = [(-80.0, 25.5, "eastern"), (-122.4, 47.6, "western"), (-97.0, 40.0, "conus"), (-150.0, 61.0, "alaska"), (-99.0, 19.0, "mexico"), (-100.0, 60.0, "canada")]
    frame = spark.createDataFrame(places, "lon double, lat double, region string")
    lon, lat = datums.to_wgs84(F.col("lon"), F.col("lat"), F.lit("nad27"), F.col("region"))
    for r in frame.select("*", lon.alias("x"), lat.alias("y")).collect():
        x, y = by_geocentre(r["lon"], r["lat"], datums.NAD27_SHIFTS[r["region"]])
        assert (r["x"] - x) * 111_000 * math.cos(math.radians(y)) == pytest.approx(0, abs=0.05)
        assert (r["y"] - y) * 111_000 == pytest.approx(0, abs=0.05)
        assert 5 < abs(r["x"] - r["lon"]) * 1e5 + abs(r["y"] - r["lat"]) * 1e5


def test_datums_that_stay_and_fail(spark):
    frame = spark.createDataFrame([(-90.0, 40.0, "nad83"), (None, 40.0, "lonlat"), (-90.0, 40.0, None)], "lon double, lat double, datum string")
    lon, lat = datums.to_wgs84(F.col("lon"), F.col("lat"), F.col("datum"))
    assert [tuple(r) for r in frame.select(lon, lat).collect()] == [(-90.0, 40.0), (None, 40.0), (None, None)]
    with pytest.raises(Exception, match="no shift of datum ed50"):
        frame.select(datums.to_wgs84(F.col("lon"), F.col("lat"), F.lit("ed50"))[0]).collect()
    with pytest.raises(Exception, match="no shift of NAD27 for moon"):
        frame.where("lon IS NOT NULL").select(datums.to_wgs84(F.col("lon"), F.col("lat"), F.lit("nad27"), F.lit("moon"))[0]).collect()
    x = datums.located(frame.where("datum = 'nad83'"), Projection("lcc", 33.0, 45.0, 40.0, -97.0)).first()["x"]
    assert x == pytest.approx(596_000, rel=0.01)


def test_inventory_points_on_wgs84(spark):
    point = "struct<plant_id string, lon double, lat double, datum string>"
    frame = spark.createDataFrame([("a", ("p", -97.0, 40.0, "nad27")), ("b", ("q", -97.0, 40.0, "nad83")), ("c", None)], f"record_key string, point {point}")
    got = {r["record_key"]: r["point"] for r in inventory.on_wgs84(frame).collect()}
    x, y = by_geocentre(-97.0, 40.0, datums.NAD27_SHIFTS["conus"])
    assert got["a"]["lon"] == pytest.approx(x, abs=1e-6) and got["a"]["lat"] == pytest.approx(y, abs=1e-6) and got["a"]["datum"] == "wgs84"
    assert (got["b"]["lon"], got["b"]["lat"]) == (-97.0, 40.0) and got["c"] is None


def ring_bytes(order, ring, extra=()):
    return struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + "d" * (2 + len(extra)), *p, *extra) for p in ring)


def polygon_bytes(order, rings, code=3, extra=(), srid=None):
    head = struct.pack("B", order == "<") + struct.pack(order + "I", code) + (struct.pack(order + "I", srid) if srid is not None else b"")
    return head + struct.pack(order + "I", len(rings)) + b"".join(ring_bytes(order, r, extra) for r in rings)


SHELL, HOLE = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]  # both wound the wrong way


def test_wkb_of_every_form(spark):
    point = lambda x, y: struct.pack("<BIdd", 1, 1, x, y)
    rows = {
        "little": polygon_bytes("<", [SHELL, HOLE]),
        "big": polygon_bytes(">", [SHELL, HOLE]),
        "heights": polygon_bytes("<", [SHELL, HOLE], 1003, (7.0,)),
        "heights and measures": polygon_bytes(">", [SHELL, HOLE], 3003, (7.0, 8.0)),
        "extended": polygon_bytes("<", [SHELL, HOLE], 3 | geometry.HAS_Z | geometry.HAS_SRID, (9.0,), 4326),
        "multi": struct.pack(">BII", 0, 6, 2) + polygon_bytes("<", [SHELL, HOLE]) + polygon_bytes(">", [[(9, 9), (10, 9), (9, 10), (9, 9)]]),
        "line": struct.pack("<BI", 1, 2) + ring_bytes("<", [(0, 0), (3, 4), (3, 0), (0, 0)]),
        "points": struct.pack("<BII", 1, 4, 2) + point(1, 2) + point(3, 4),
        "no parts": struct.pack("<BII", 1, 6, 0),
        "empty point": point(math.nan, math.nan),
        "null": None,
    }
    frame = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows.items()], "name string, geometry binary").repartition(2)
    got = {r["name"]: r for r in geometry.read_wkb(frame).withColumn("size", sg.size_of(F.col("kind"), F.col("rings"))).collect()}
    shell, hole = [(4, 0), (4, 4), (0, 4), (0, 0)], [(1, 2), (2, 2), (2, 1), (1, 1)]
    xy = lambda name: None if got[name]["rings"] is None else [[(p["x"], p["y"]) for p in r] for r in got[name]["rings"]]
    for name in ("little", "big", "heights", "heights and measures", "extended"):
        assert (got[name]["kind"], xy(name), got[name]["size"]) == ("polygon", [shell, hole], 15.0), name
    assert xy("multi") == [shell, hole, [(9, 9), (10, 9), (9, 10)]] and got["multi"]["size"] == 15.5
    assert got["line"]["kind"] == "line" and got["line"]["size"] == 12.0
    assert xy("points") == [[(1, 2)], [(3, 4)]]
    assert xy("no parts") == [] and xy("empty point") == [] and xy("null") is None and got["null"]["kind"] is None
    for bad, why in ((struct.pack("<BII", 1, 7, 0), "no rings in geometry 7"), (polygon_bytes("<", [SHELL])[:-3], "ends too early")):
        with pytest.raises(Exception, match=why):
            geometry.read_wkb(spark.createDataFrame([(bytearray(bad),)], "geometry binary")).collect()


def test_text_and_bytes_hold_the_same(spark):
    rng = random.Random(2)

    def shape(n, cx, cy, r, turn):
        return [(cx + r * math.cos(turn * 2 * math.pi * i / n), cy + r * math.sin(turn * 2 * math.pi * i / n)) for i in range(n)]

    rows = []
    for i in range(30):
        parts = []
        for k in range(rng.randint(1, 3)):
            parts.append(shape(rng.randint(3, 60), 10.0 * k, i, 3.0, 1))
            parts += [shape(rng.randint(3, 9), 10.0 * k + d, i, 0.5, -1) for d in (-1, 1)[: rng.randint(0, 2)]]
        rows.append((i, "polygon", [[{"x": x, "y": y} for x, y in r] for r in parts]))
    rows += [(100, "line", [[{"x": 0.0, "y": 0.1}, {"x": 1e-7, "y": -2.5e300}]]), (101, "point", [[{"x": 1.5, "y": 2.5}]]), (102, "polygon", [])]
    frame = spark.createDataFrame(rows, "id long, kind string, rings array<array<struct<x: double, y: double>>>").repartition(3)
    through = geometry.read_wkb(geometry.write_wkb(frame))
    text = frame.select("id", geometry.wkt(F.col("kind"), F.col("rings")).alias("t")).select("id", geometry.kind_of_wkt(F.col("t")).alias("kind"), geometry.rings_of_wkt(F.col("t")).alias("rings"))
    want = {r[0]: (r[1], [[(p["x"], p["y"]) for p in ring] for ring in r[2]]) for r in rows}
    for df in (through, text):
        assert {r["id"]: (r["kind"], [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]) for r in df.collect()} == want


def test_text_as_others_write_it(spark):
    texts = ["multipolygon( ( (0 0, 0 4 , 4 4, 4 0, 0 0), (1 1,2 1,2 2,1 2,1 1) ) , ((9 9,10 9,9 10,9 9)) )", "SRID=4326;POINT (1 2)", "LINESTRING Z (0 0 5, 3 4 5)", "MULTIPOINT (1 2, 3 4)", "POLYGON EMPTY", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [r for r in frame.select("id", geometry.kind_of_wkt(F.col("t")).alias("kind"), geometry.rings_of_wkt(F.col("t")).alias("rings")).orderBy("id").collect()]
    xy = lambda r: None if r["rings"] is None else [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]
    assert [r["kind"] for r in got] == ["polygon", "point", "line", "point", "polygon", None]
    assert xy(got[0]) == [[(4, 0), (4, 4), (0, 4), (0, 0)], [(1, 2), (2, 2), (2, 1), (1, 1)], [(9, 9), (10, 9), (9, 10)]]
    assert [xy(r) for r in got[1:]] == [[[(1, 2)]], [[(0, 0), (3, 4)]], [[(1, 2)], [(3, 4)]], [], None]
    with pytest.raises(Exception, match="no rings in GEOMETRYCOLLECTION"):
        spark.sql("SELECT 'GEOMETRYCOLLECTION (POINT (1 2))' AS t").select(geometry.kind_of_wkt(F.col("t"))).collect()


def test_as_of_join(spark):
    t = lambda h: dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)
    rng = random.Random(1)
    left = [(rng.choice("ab"), t(rng.randint(0, 40)), i) for i in range(80)] + [("c", t(1), 100), (None, t(1), 101), ("a", None, 102), ("a", t(5), 103), ("a", t(5), 104)]
    right = [("a", t(3), "a3"), ("a", t(20), "a20"), ("a", t(20), "a20 too"), ("b", t(7), "b7"), ("b", None, "never"), (None, t(0), "nobody")]
    lf = spark.createDataFrame(left, "k string, at timestamp, id int")
    rf = spark.createDataFrame(right, "k string, since timestamp, name string")
    for tolerance in (None, 10):
        want = []
        for k, at, i in left:
            times = [s for key, s, _ in right if k is not None and key == k and s and at and s <= at and (tolerance is None or at - s <= dt.timedelta(hours=tolerance))]
            hits = [n for key, s, n in right if times and key == k and s == max(times)]
            want += [(i, n) for n in hits or [None]]
        got = [(r["id"], r["name"]) for r in asof.join_as_of(lf, rf, ["k"], "at", "since", tolerance).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
