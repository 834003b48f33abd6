"""Many windows in one pass, and hours by classes, against what the plain operators give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from aeroflux.operators import emissions as em
from aeroflux.operators import temporal as tm

T0 = dt.datetime(2005, 1, 1)


def rows(n=60, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        begin = T0 + dt.timedelta(hours=rng.randint(0, 400))
        out.append((f"r{i % 7}", rng.choice(["NOX", "VOC"]), rng.choice(["", "EXH"]), begin, begin + dt.timedelta(hours=rng.choice([0, 1, 24, 300, 2000])), rng.choice([0.0, 0.5, 2.0, 7.25]), "kg/s"))
    return out


SCHEMA = "record_key string, pollutant string, prefix string, begin_ts timestamp, end_ts timestamp, rate double, unit string"


def test_window_totals_equal_period_totals(spark):
    emissions = spark.createDataFrame(rows(), SCHEMA)
    day = dt.timedelta(days=1)
    windows = [(1, T0, T0 + day), (2, T0 + day, T0 + 9 * day), (3, T0 + 5 * day, T0 + 6 * day), (4, T0 + 5 * day, T0 + 5 * day), (5, T0 - 9 * day, T0), (6, T0, T0 + 900 * day), (7, T0 + 800 * day, T0 + 900 * day), (8, T0, T0 + day)]
    got = {(r["record_key"], r["pollutant"], r["prefix"], r["window_id"]): r["total"] for r in em.window_totals(emissions, spark.createDataFrame(windows, "window_id int, begin_ts timestamp, end_ts timestamp")).collect()}
    want = {}
    for key, pol, pre, b, e, rate, _ in rows():
        for n, x, y in windows:
            if b < e and e > x and b < y:
                want[key, pol, pre, n] = want.get((key, pol, pre, n), 0.0) + rate * max(0.0, (min(e, y) - max(b, x)).total_seconds())
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-6)
    whole = em.window_totals(emissions, spark.createDataFrame(windows[:1], "window_id int, begin_ts timestamp, end_ts timestamp"), []).collect()
    plain = {(r["pollutant"], r["prefix"]): (r["total"], r["unit"]) for r in em.period_totals(emissions, F.lit(T0), F.lit(T0 + day), []).collect()}
    assert {(r["pollutant"], r["prefix"]): (pytest.approx(r["total"]), r["unit"]) for r in whole} == plain
    assert em.window_totals(emissions.limit(0), spark.createDataFrame(windows, "window_id int, begin_ts timestamp, end_ts timestamp")).count() == 0
    with pytest.raises(Exception, match="ends before it begins"):
        em.window_totals(emissions, spark.createDataFrame([(1, T0 + day, T0)], "window_id int, begin_ts timestamp, end_ts timestamp")).collect()


def profiles(spark):
    rng = random.Random(8)
    out = []
    for code in ("a", "b"):
        for kind, count in (("monthly", 12), ("weekly", 7), ("diurnal weekday", 24), ("diurnal weekend", 24)):
            out += [(kind, code, slot, rng.random()) for slot in range(count)]
    return spark.createDataFrame(out, "kind string, code string, slot int, fraction double")


def test_hours_by_class_equal_hours_by_record(spark):
    """Zones on both sides of UTC, holidays, intervals that cut hours, months and years."""
    rng = random.Random(3)
    coded = []
    for i in range(40):
        begin = dt.datetime(2004, 12, 20) + dt.timedelta(minutes=rng.randint(0, 80 * 24 * 60))
        end = begin + dt.timedelta(minutes=rng.choice([30, 90, 60 * 24 * 31, 60 * 24 * 400]))
        coded.append((f"r{i}", rng.choice(["NOX", "VOC"]), "", begin, end, rng.random(), "kg/s", rng.choice("ab"), rng.choice("ab"), rng.choice("ab"), rng.choice(["America/New_York", "Australia/Sydney", "UTC"]), rng.choice(["s", "t"])))
    schema = f"{SCHEMA}, month_code string, week_code string, day_code string, tz string, sector string"
    frame = spark.createDataFrame(coded, schema)
    start = F.lit(dt.datetime(2004, 12, 30))
    hours = tm.steps(spark.range(1), start, start + F.make_dt_interval(F.lit(40))).select("hour_ts")
    holidays = spark.createDataFrame([(dt.date(2005, 1, 3),), (dt.date(2005, 1, 3),)], "day date")
    zones = frame.select("tz").distinct()
    by_record = tm.hourly_by_profile(frame, hours, profiles(spark), holidays).groupBy("sector", "pollutant", "hour_ts").agg(F.sum("amount").alias("amount")).collect()
    by_class = tm.hourly_totals(frame, hours, profiles(spark), holidays, zones, ["sector"]).collect()
    key = lambda r: (r["sector"], r["pollutant"], r["hour_ts"])
    assert {key(r): r["amount"] for r in by_class} == pytest.approx({key(r): r["amount"] for r in by_record})
    assert len(by_class) > 1000 and {r["unit"] for r in by_class} == {"kg"}
    assert tm.hourly_totals(frame, hours.limit(0), profiles(spark), holidays, zones).count() == 0
    for op in (lambda f: tm.hourly_totals(f, hours, profiles(spark), holidays, zones), lambda f: tm.hourly_by_profile(f, hours, profiles(spark), holidays)):
        with pytest.raises(Exception, match="no temporal profile for a/zzz/a"):
            op(frame.withColumns({"month_code": F.lit("a"), "week_code": F.lit("zzz"), "day_code": F.lit("a")})).collect()


def test_measured_hours_join_by_zone(spark):
    """A year of hours is a table in the plan, not a literal."""
    frame = spark.createDataFrame([("1", "B", "NOX", "America/New_York", "x", T0, T0 + dt.timedelta(days=365), 1.0, "kg/s")], "oris string, boiler string, pollutant string, tz string, record_key string, begin_ts timestamp, end_ts timestamp, rate double, unit string")
    cem = spark.createDataFrame([("1", "B", f"0501{d:02d} {h:02d}", 1.0, 0.0, 5.0, 0.0, 4.0) for d in (1, 2) for h in range(24)], "oris string, boiler string, hour_key string, nox float, so2 float, gload float, sload float, heat float")
    start = F.lit(T0)
    hours = tm.steps(spark.range(1), start, start + F.make_dt_interval(F.lit(365))).select("hour_ts")
    out = tm.hourly_by_cem(frame, hours, cem)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = out.where("amount > 0").collect()
    assert out.count() == 8760 and len(got) == 48
    assert all(r["amount"] == pytest.approx(365 * 86400 / 48) for r in got)
    assert min(r["hour_ts"] for r in got) == T0 + dt.timedelta(hours=5)
