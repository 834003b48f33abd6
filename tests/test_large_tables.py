"""Steps whose work or memory grew faster than their tables: results against brute force, and what plans must not hold."""

import os
import random

import pytest
from pyspark.sql import functions as F

from aeroflux.operators import emissions, gridding, matching, met, temporal
from aeroflux.operators.temporal import steps
from aeroflux.plans import ingest_queries, inventory_queries, speciation_queries, views
from aeroflux.sources import inventory, references

AIR = "row int, k int, height double, temp double, wind double, stable boolean, s1 double"
STACKS = "id int, row int, height_m double, diam_m double, temp_k double, vel_ms double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def air_and_stacks(spark, levels=40):
    r = random.Random(3)
    # tops that don't always grow with k
    air = [(row, k, 0.0 if k == 0 else max(0.0, 30.0 * k + r.uniform(-80, 80)) if k < levels - 1 else 9e4, r.uniform(250, 300), r.uniform(0, 9), r.random() < 0.5, r.uniform(1e-4, 1e-3)) for row in range(3) for k in range(levels)]
    stacks = [(i, r.randrange(4), r.choice([-5.0, 0.0, 60.0, 333.0, 900.0]), r.uniform(0, 4), r.uniform(280, 500), r.uniform(0, 50)) for i in range(200)]
    return air, stacks


def layer_by_hand(air, stack, kemit):
    _, row, h, d, t, v = stack
    column = [a for a in air if a[0] == row]
    if not column:
        return 0
    at = lambda z: next((a[1] - 1 for a in column[1:kemit] if a[2] >= z), kemit - 2)
    h, d, v = max(h, 0), max(d, 0), min(max(v, 0), 40)
    _, _, _, ta, w, stable, s1 = column[at(h)]
    w, t = max(w, 1), max(t, ta + 10)
    b = (t - ta) * 9.80665 / t * v * d * d / 4
    rise = d * v**1.4 / w**1.4 if t - ta < 50 and v > w and v > 10 else 29 * (b / s1) ** (1 / 3) / w ** (1 / 3) if stable else 7.4 * (b * h * h) ** (1 / 3) / w
    return at(h + rise)


@pytest.mark.parametrize("kemit", [40, 12])
def test_plume_layers_by_hand(spark, kemit):
    air, stacks = air_and_stacks(spark)
    got = met.plume_layer(spark.createDataFrame(stacks, STACKS), spark.createDataFrame(air, AIR), ["row"], kemit)
    assert {r["id"]: r["layer"] for r in got.collect()} == {s[0]: layer_by_hand(air, s, kemit) for s in stacks}


def test_no_row_holds_a_column_of_air(spark):
    air, stacks = air_and_stacks(spark)
    got = met.plume_layer(spark.createDataFrame(stacks, STACKS), spark.createDataFrame(air, AIR), ["row"], 40)
    assert "collect_list" not in plan(got)


def test_stacks_in_hours_are_not_broadcast(spark):
    air, stacks = air_and_stacks(spark)
    start = F.lit("2024-01-01").cast("timestamp")
    hours = steps(spark.createDataFrame(stacks, STACKS), start, start + F.make_dt_interval(F.lit(1)))
    got = met.plume_layer_by_hour(hours, spark.createDataFrame(air, AIR).withColumn("frame_ts", start), ["row"], 40)
    assert plan(got).count("SortMergeJoin") >= 2
    assert {r["id"]: r["layer"] for r in got.collect()} == {s[0]: layer_by_hand(air, s, 40) for s in stacks}


def test_fallbacks_are_tried_on_classes_not_on_pairs(spark, monkeypatch):
    pairs = spark.range(600).selectExpr("lpad(cast(id % 60 + 1000 as string), 6, '2') AS a", "lpad(cast(id % 50 as string), 3, '1') AS b")
    ref = spark.createDataFrame([("221000", "110", 1), ("221050", "100", 2), ("200000", "110", 3), ("000000", "000", 4)], "a string, b string, v int")
    tried, plain = [], matching._matched

    def counted(df, columns, *rest):
        tried.append((len(columns), df.select(*columns).distinct().count()))
        return plain(df, columns, *rest)

    monkeypatch.setattr(matching, "_matched", counted)
    rows = matching.match_code_double(pairs, "a", "b", ref, "a", "b", "v").distinct().collect()
    assert max(n for k, n in tried if k == 2) <= 12 < pairs.distinct().count()
    known = {(a, b): v for a, b, v in [("221000", "110", 1), ("221050", "100", 2), ("200000", "110", 3), ("000000", "000", 4)]}
    falls = lambda c: [c[: len(c) - z] + "0" * z for z in range(len(c) + 1)]
    assert all(r["v"] == next(known[x, y] for x in falls(r["a"]) for y in falls(r["b"]) if (x, y) in known) for r in rows)


def test_filters_of_cells_stay_off_the_facts(spark):
    ring = F.array(F.col("shape_id") * 2.0, F.col("shape_id") * 3.0)
    cells = spark.range(9).select((F.col("id") % 3).alias("shape_id"), F.lit("g").alias("grid"), F.col("id").alias("row"), F.lit(0).alias("col"), F.lit(0.5).alias("weight")).where(F.array_max(F.transform(ring, lambda x: x)) >= 3.0)
    start = F.lit("2024-01-01").cast("timestamp")
    facts = spark.range(40).select((F.col("id") % 4).alias("shape_id"), F.lit("CO").alias("pollutant"), F.lit("").alias("prefix"), start.alias("hour_ts"), start.alias("begin_ts"), (start + F.make_dt_interval(F.lit(1))).alias("end_ts"), F.lit(1.0).alias("rate"), F.lit(2.0).alias("amount"), F.lit("kg/s").alias("unit"))
    for out, value in ((gridding.gridded_totals(facts, cells, ["shape_id"]), 432000.0), (gridding.gridded_hourly(facts, cells, ["shape_id"]), 10.0)):
        assert plan(out).count("array_max") == 1
        assert {r["row"]: r["value"] for r in out.collect()} == {row: value for row in (1, 2, 4, 5, 7, 8)}


def test_amounts_in_hours_are_not_broadcast(spark):
    cells = spark.range(3).select(F.col("id").alias("source_id"), F.lit("g").alias("grid"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("weight"))
    start = F.lit("2024-01-01").cast("timestamp")
    hours = steps(spark.range(3).select(F.col("id").alias("source_id"), F.lit("CO").alias("pollutant"), F.lit("").alias("prefix"), F.lit(2.0).alias("amount"), F.lit("kg").alias("unit")), start, start + F.make_dt_interval(F.lit(1)))
    out = gridding.gridded_hourly(hours, cells, ["source_id"])
    assert "SortMergeJoin" in plan(out) and "BroadcastHashJoin" not in plan(out)
    assert [r["value"] for r in out.collect()] == [6.0] * 24


def test_lines_of_profiles_are_not_ordered_in_one_task(spark):
    lines = [("f", i, t) for i, t in enumerate(["/WEEKLY/", "#no", "    1" + "   1" * 7, "    2" + "   1" * 7, "/MONTHLY/", "    1" + "   2" * 12, "/weekly/", "    2   7" + "   0" * 6])] + [("g", 0, "/MONTHLY/"), ("g", 1, "    9" + "   1" * 12)]
    got = references.parse_temporal_profiles(spark.createDataFrame(lines, "file string, line_id long, value string"))
    windows = [line for line in plan(got).splitlines() if " Window " in line]
    assert not any("last(" in line for line in windows)  # of all lines, a window over a file's
    shares = {(r["kind"], r["code"], r["slot"]): r["fraction"] for r in got.collect()}
    assert len(shares) == 7 * 2 + 12 * 2
    assert shares["weekly", "2", 0] == 1.0 and shares["weekly", "1", 0] == pytest.approx(1 / 7) and shares["monthly", "9", 11] == pytest.approx(1 / 12)


def test_lines_are_put_together_once(spark):
    rows = spark.range(3).select("id", F.col("id").cast("string").alias("t"))
    data = ingest_queries.lines_of(rows, F.concat("t", F.lit(",2")), "f", ["#a"]).where(F.length("value") > 0).where(~F.col("value").startswith("x"))
    optimised = data._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("concat(") == 1
    assert [r["value"] for r in data.orderBy("line_id").collect()] == ["#a", "0,2", "1,2", "2,2"]


def test_fields_of_a_fixed_width_line_are_cut_once(spark):
    head = "01001" + "P".ljust(15) + "1".ljust(15) + "S".ljust(12) + "7".ljust(6) + "B1".ljust(6) + "1".ljust(2) + "Plant".ljust(40) + "2280000000".ljust(18) + "10".ljust(4) + "2".ljust(6) + "100".ljust(4) + "0".ljust(10) + "10".ljust(9) + " " * 74 + "1234" + "30".ljust(9) + "-70".ljust(9) + " "
    line = head + ("5".ljust(13) + " " * 13 + "1".ljust(7) + "80 " + " " * 16) * 2
    lines = spark.createDataFrame([("s", "f", 0, 0, i, v) for i, v in enumerate(["#IDA", "#COUNTRY US", "#YEAR 2005", "#POLID NOX VOC", line])], "sector string, file string, month int, block long, line_id long, value string")
    records, rejects = inventory.parse(lines, 1.0)
    optimised = records._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("substring(value") <= 19
    assert rejects.count() == 0
    got = {r["pollutant"]: r for r in records.collect()}
    assert set(got) == {"NOX", "VOC"} and all(r["fips"] == "01001" and r["point"]["plant"] == "Plant" and r["point"]["vel_ms"] == pytest.approx(3.048) and r["control"]["reff"] == 80 for r in got.values())


def test_wanted_names_do_not_shuffle_the_emissions(spark):
    start = F.lit("2024-01-01").cast("timestamp")
    rows = spark.range(6).select(F.lit("s").alias("sector"), F.lit("f").alias("file"), F.when(F.col("id") < 2, "NOX").otherwise("CO").alias("pollutant"), F.lit("").alias("prefix"), start.alias("begin_ts"), (start + F.make_dt_interval(F.lit(1))).alias("end_ts"), F.lit(1.0).alias("rate"), F.lit("kg/s").alias("unit"))
    got = emissions.kept_and_dropped(rows, spark.createDataFrame([("NOX",)], "pollutant string"))
    assert "SortMergeJoin" not in plan(got)
    assert {(r["status"], r["pollutant"], r["total"]) for r in got.collect()} == {("kept", "NOX", 172800.0), ("dropped", "CO", 345600.0)}


def test_orders_are_hashed_in_the_inventory_view(spark, tmp_path):
    spark.range(3).selectExpr("id AS o_orderkey", "'1' AS o_orderpriority", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(6).selectExpr("id % 4 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "1.0D AS l_extendedprice", "'A' AS l_returnflag", "'O' AS l_linestatus", "timestamp'2024-01-05' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    inv = views.view(spark, str(tmp_path), "inv")
    assert "ShuffledHashJoin" in plan(inv) and inv.count() == 5


def test_hours_of_measured_units_are_made_once_a_unit(spark):
    start = F.lit("2024-01-01").cast("timestamp")
    rows = spark.range(40).select(F.col("id").alias("source"), F.lit("7").alias("oris"), (F.col("id") % 2).cast("string").alias("boiler"), F.lit("NOX").alias("pollutant"), F.when(F.col("id") < 20, "UTC").otherwise("Australia/Brisbane").alias("tz"), start.alias("begin_ts"), (start + F.make_dt_interval(F.lit(1))).alias("end_ts"), F.lit(1.0).alias("rate"), F.lit("kg/s").alias("unit"))
    cem = spark.createDataFrame([("7", b, f"240101 {h:02d}", float(h + 1), 0.0, 1.0, 0.0, 0.0) for b in "01" for h in range(4)], "oris string, boiler string, hour_key string, nox double, so2 double, gload double, sload double, heat double")
    hours = temporal.steps(spark.range(1), start, start + F.make_dt_interval(F.lit(0), F.lit(3))).select("hour_ts")
    out = temporal.hourly_by_cem(rows, hours, cem)
    assert "REPARTITION_BY_COL" in plan(out)
    got = {(r["source"], r["hour_ts"].hour): r["amount"] for r in out.collect()}
    assert len(got) == 40 * 3
    assert all(got[i, h] == pytest.approx(86400.0 * (h + 1) / 10 if i < 20 else 0.0) for i in range(40) for h in range(3))


def test_rows_are_not_shuffled_to_their_codes(spark):
    known = {("221010", "110"): 1, ("221000", "100"): 2, ("200000", "110"): 3, ("000000", "000"): 4}
    ref = spark.createDataFrame([(a, b, v) for (a, b), v in known.items()], "a string, b string, v int")
    rows = spark.range(50).selectExpr("id", "lpad(cast(id % 30 + 1000 as string), 6, '2') AS a", "IF(id = 3, NULL, lpad(cast(id % 20 as string), 3, IF(id % 3 = 0, '9', '1'))) AS b")
    out = matching.match_code_double(rows, "a", "b", ref, "a", "b", "v")
    joins = [line for line in plan(out).splitlines() if "LeftOuter" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
    falls = lambda c: [c[: len(c) - z] + "0" * z for z in range(len(c) + 1)]
    for r in out.collect():
        assert r["v"] == (None if r["id"] == 3 else next(known[x, y] for x in falls(r["a"]) for y in falls(r["b"]) if (x, y) in known))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_rows_are_shuffled_once_to_be_speciated(spark):
    tables = "/root/testdata/sf0.001"
    out, _ = speciation_queries.sp.speciated_totals(inventory_queries.emissions_of(spark, tables), speciation_queries.data_of(spark, tables), "M1", ["sector"], partial=True)
    joins = [line for line in plan(out).splitlines() if "SortMergeJoin" in line and "LeftOuter" in line]
    assert not any(f"{key}#" in line for line in joins for key in ("full_name", "country_fips", "kind", "spec_key", "_first"))


def test_lines_are_put_together_by_compiled_code(spark):
    """what stands in a generator's argument or inside a higher-order function is not compiled."""
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    lines = ingest_queries.lines_of(rows, ingest_queries.delimited(6, _0="t", _3=F.lit("x")), "f", ["#ORL"])
    assert [r["value"] for r in lines.orderBy("line_id").collect()] == ["#ORL", "a,,,x,,", ",,,x,,"]
    assert "explode(_line" in lines._jdf.queryExecution().optimizedPlan().toString()
    records, _ = inventory.parse(ingest_queries.lines_of(rows, ingest_queries.delimited(70, _0="t"), "f", ["#ORL", *ingest_queries.HEAD]), 1.0)
    text = records.select("fips")._jdf.queryExecution().optimizedPlan().toString()
    inside = text.split("transform(array(f", 1)[1].split("lambdafunction", 1)[0]
    assert "CASE" not in inside and "trim" not in inside
