"""Inventory and reference files, written by the tests, read into tables."""

import math

import pytest
from pyspark.sql import functions as F

from aeroflux.operators import emissions as em
from aeroflux.sources import inventory as inv
from aeroflux.sources import references as ref


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


def totals(emissions):
    return {(r["pollutant"], r["prefix"]): r["total"] for r in em.grand_totals(emissions).collect()}


def fields(count, **at):
    row = [""] * count
    for k, v in at.items():
        row[int(k[1:])] = v
    return ",".join(row)


def test_ff10_nonpoint_months_and_year(spark, put):
    rows = [
        "#FORMAT=FF10_NONPOINT",
        "#COUNTRY = CANADA",
        "#YEAR=2010",
        "country_cd,region_cd" + "," * 43,
        fields(45, _0='"CA"', _1='"36061"', _5='"2280003010"', _7='"NOX"', _8="21709.4748887999995"),
        fields(45, _0='"US"', _1="1 61", _5="22800030", _7='"EXH__NH3"', _8="99", _20="1", _21="-9"),
    ]
    got = inv.read_inventory(spark, {"othar": [put("ff10.csv", "\n".join(rows))]})
    assert totals(got.emissions) == pytest.approx({("NOX", ""): 21709.4748887999995 * 907.185, ("NH3", "EXH"): 907.185})
    monthly = got.emissions.where("pollutant = 'NH3'").orderBy("begin_ts").collect()
    assert len(monthly) == 12 and monthly[0]["fips"] == "01061" and monthly[0]["scc"] == "0022800030"
    assert str(monthly[1]["end_ts"]) == "2010-03-01 00:00:00" and monthly[1]["rate"] == 0
    assert [(r["country"], r["kind"]) for r in got.sources.orderBy("country").collect()] == [(0, "polygon"), (1, "polygon")]


def test_orl_monthly_average_day(spark, put):
    """A twelfth of yearly amounts applies to average days too: 0.00482333523611001 ton a day over a January of 31 days."""
    for number, name in enumerate(inv.periods.MONTHS, 1):
        day = "0.00482333523611001" if number == 1 else "0"
        put(f"road_{name}.csv", "#ORL\n#COUNTRY US\n#YEAR 2005\n" + fields(16, _0="1001", _1="2201001110", _2='"EXH__CO"', _4=day))
    path = put("road_jan.csv", "#ORL\n#COUNTRY US\n#YEAR 2005\n" + fields(16, _0="1001", _1="2201001110", _2='"EXH__CO"', _4="0.00482333523611001"))
    got = inv.read_inventory(spark, {"road": [path.replace("jan", "[month]")]}, freq="monthly")
    assert totals(got.emissions)["CO", "EXH"] == pytest.approx(11.3037815551)
    assert got.emissions.count() == 12


def test_orl_kinds(spark, put):
    head = "#ORL\n#COUNTRY US\n#YEAR 2005\n"
    point = fields(70, _0="1073", _1="7", _2="2", _3="S1", _4="1", _5='"A plant, Inc"', _6="30600106", _8="01", _9="100", _10="2", _11="500", _12="0", _13="10", _14="28", _15="M", _16="3251", _17="L", _18="-86.9", _19="33.5", _21="SO2", _22="365", _29="10", _30="B1")
    nonpoint = fields(37, _0="1001", _1="2102001000", _2="-9", _4="02", _6="VOC", _7="-9", _8="2", _9="50", _11="80")
    nonroad = fields(30, _0="1001", _1="2260001010", _2="CO", _3="5", _8="03")
    paths = [put(f"{k}.csv", head + row) for k, row in (("p", point), ("n", nonpoint), ("r", nonroad))]
    got = inv.read_inventory(spark, {"all": paths})
    assert totals(got.emissions) == pytest.approx({("SO2", ""): 365 * 907.185, ("VOC", ""): 2 * 907.185 * 365, ("CO", ""): 5 * 907.185})
    p = got.sources.where("kind = 'point'").first()
    assert p["point"]["height_m"] == pytest.approx(30.48) and p["point"]["temp_k"] == pytest.approx((500 + 459.67) / 1.8)
    assert p["point"]["flow_m3s"] == pytest.approx(3.048 * math.pi * 0.6096**2 / 4) and p["point"]["plant"] == "A plant, Inc"
    assert p["economic"]["sic"] == "2800" and p["economic"]["naics"] == "325100" and p["point"]["datum"] == "lonlat"
    assert p["record_key"] == "01073" + "0030600106" + "0" + "72S11"
    n = got.sources.where("pollutant = 'VOC'").first()["control"]
    assert (n["ceff"], n["reff"], n["rpen"]) == (50, 100, 80)


def test_ida_kinds(spark, put):
    head = "#IDA\n#COUNTRY US\n#YEAR 2005\n"
    area = "01001" + "2102001000" + f"{'12.5':>10}" + f"{'0':>10}" + " " * 11 + f"{'5':>7}" + f"{'':>3}" + f"{'-9':>6}" + f"{'':>10}" + f"{'3':>10}" + " " * 27
    mobile = "01001" + " " * 10 + "2201001110" + f"{'7':>10}" + f"{'':>10}"
    point = list(" " * 301)

    def at(start, text):
        point[start : start + len(text)] = text

    for start, text in ((0, "01073"), (5, "PL"), (20, "PT"), (35, "ST"), (59, "1"), (101, "30600106"), (119, "10"), (123, "1"), (129, "70"), (143, "5"), (226, "28"), (230, "33.5"), (239, "-86.9"), (249, "100"), (275, "40")):
        at(start, text)
    paths = [put("a.ida", head + "#POLID CO EXH__VOC\n" + area), put("m.ida", head + "#DATA NOX\n" + mobile), put("p.ida", head + "#POLID SO2\n" + "".join(point))]
    got = inv.read_inventory(spark, {"ida": paths})
    assert totals(got.emissions) == pytest.approx({("CO", ""): 12.5 * 907.185, ("VOC", "EXH"): 3 * 907.185 * 365, ("NOX", ""): 7 * 907.185, ("SO2", ""): 100 * 907.185})
    p = got.sources.where("kind = 'point'").first()
    assert (p["point"]["lon"], p["point"]["lat"], p["scc"], p["control"]["ceff"]) == (-86.9, 33.5, "0030600106", 40)
    a = got.sources.where("pollutant = 'CO'").first()["control"]
    assert (a["ceff"], a["reff"], a["rpen"]) == (5, 0, 0)


def test_daily_points(spark, put):
    head = "#FORMAT=FF10_DAILY_POINT\n#COUNTRY US\n#YEAR 2011\n"
    common = {"_0": "US", "_1": "1073", "_3": "P", "_7": "30600106", "_8": "SO2"}
    days = fields(46, **common, _12="2", _13="99", _14="1", _15="2", _44="50")
    month = fields(46, **common, _12="3", _13="31")
    blank = fields(46, **common, _13="5")
    got = inv.read_inventory(spark, {"d": [put("d.csv", "\n".join([head.strip(), days, month, blank]))]}, input_unit="kg")
    by = {str(r["begin_ts"]): r["rate"] for r in got.emissions.collect()}
    assert len(by) == 28 + 1 and by["2011-02-01 00:00:00"] * 86400 == pytest.approx(1) and by["2011-03-01 00:00:00"] * 31 * 86400 == pytest.approx(31)
    assert got.sources.first()["kind"] == "supplemental"


def test_ff10_points_and_bad_lines(spark, put):
    good = fields(77, _0="US", _1="1073", _3="P", _4="Q", _5="S", _6="1", _11="30600106", _12="SO2", _13="73", _17="10", _18="1", _19="70", _21="5", _22="325", _23="-86", _24="33", _25="002", _41="10", _42="B")
    path = put("p.csv", "#FORMAT=FF10_POINT\n#COUNTRY US\n#YEAR 2012\n" + good + "\nUS,too,short")
    with pytest.raises(ValueError, match="fields: 3"):
        inv.read_inventory(spark, {"p": [path]})
    got = inv.read_inventory(spark, {"p": [path]}, on_bad="reject")
    assert [r["reason"] for r in got.rejects.collect()] == ["fields: 3"]
    # rates take a year of 365 days, totals the leap year's 366
    assert totals(got.emissions)["SO2", ""] == pytest.approx(73 * 907.185 / 365 * 366)
    assert got.sources.first()["point"]["datum"] == "nad83"
    other = put("x.csv", "nothing known\n1,2")
    assert inv.read_inventory(spark, {"x": [other]}, on_bad="reject").rejects.first()["reason"] == "unknown file type"


def test_input_units():
    assert inv.units.to_kg("tonne") == 1000 and inv.units.to_kg("tonne", compat=True) == 0.001
    assert inv.units.to_kg("ton", monthly=True) == pytest.approx(907.185 / 12)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_code_references(spark, put):
    grid = put("gref", "#head\n136061;2280003010;100! a\n36061;22800030;\"200\"\n36061;22800030;300")
    assert rows(ref.read_grid_ref(spark, grid), "country", "scc", "fips", "code") == [(0, "0022800030", "36061", "300"), (1, "2280003010", "36061", "100")]
    temporal = put("tref", "/x/\n;1;2;3;;\n22800030;4;5;6;;136061\n22800030;7;8;9;;036061!late")
    assert rows(ref.read_temporal_ref(spark, temporal), "scc", "fips", "month_code", "day_code") == [("0000000000", "00000", "1", "3"), ("0022800030", "36061", "7", "9")]
    spec = put("gsref", '/POINT DEFN/ 4 4\n10100202;"95014";"SO2";;;\n2201001000;"COMBO";"VOC";;;! why')
    assert rows(ref.read_spec_ref(spark, spec), "scc", "pol", "code") == [("0010100202", "SO2", "95014"), ("2201001000", "VOC", "COMBO")]
    combo = put("combo", '#x\n"VOC";01003;0;2;8869;0.1256;8870;0.8744;1\n"NOX";101003;12;1;77;3;4')
    assert rows(ref.read_spec_combo(spark, combo), "period", "pol", "country_fips", "code", "fraction") == [(0, "VOC", "001003", "8869", 0.1256), (0, "VOC", "001003", "8870", 0.8744), (12, "NOX", "101003", "77", 0.75)]


def test_surrogate_specification(spark, put):
    path = put("spec.csv", "REGION,NAME,CODE,DATA,ATTR,WEIGHT,WATTR,WFUNC,FILTER,MERGE,B1,B2,B3,DETAILS,COMMENTS\nUSA,Population,100,county,FIPS,pop,POP2000,,,,,,,x,\nUSA,Mixed,110,county,FIPS,road,NONE,0.75*A+0.25*B,\"TYPE=1,2\",,Population,,,x,\nUSA,Half,120,county,FIPS,,NONE,,TYPE!=3,0.5*Population+0.5*Mixed,,,,x,")
    got = {r["code"]: r for r in ref.read_srg_spec(spark, path).collect()}
    assert [tuple(w) for w in got["100"]["weights"]] == [(1.0, "POP2000")] and [tuple(w) for w in got["110"]["weights"]] == [(0.75, "A"), (0.25, "B")]
    assert (got["110"]["filter"]["equal"], got["110"]["filter"]["values"], got["110"]["backups"]) == (True, ["1", "2"], ["Population"])
    assert got["120"]["filter"]["equal"] is False and [tuple(m) for m in got["120"]["merge"]] == [(0.5, "Population"), (0.5, "Mixed")]


def test_profiles_holidays_and_measures(spark, put):
    line = lambda code, values: f"{code:>5}" + "".join(f"{v:>4}" for v in values)
    path = put("tpro", "#c\n/MONTHLY/\n" + line("1", range(1, 13)) + "\n/WEEKLY/\n" + line("2", [1] * 7) + "\n/DIURNAL WEEKDAY/\n" + line("3", range(24)) + "\n/DIURNAL WEEKEND/\n" + line("3", [2] * 24))
    got = {(r["kind"], r["code"], r["slot"]): r["fraction"] for r in ref.read_temporal_profiles(spark, path).collect()}
    assert len(got) == 12 + 7 + 48 and got["monthly", "1", 11] == pytest.approx(12 / 78) and got["diurnal weekend", "3", 0] == pytest.approx(1 / 24)
    days = put("hol", "#x\n  19    07 04 2005  Monday ! a day\nshort")
    assert [str(r["day"]) for r in ref.read_holidays(spark, days).collect()] == ["2005-07-04"]
    cem = put("cem.csv", "10,B,050101,3,5,-9,1,0,2\n,B,050101,3,5,6,1,0,2\n10,B,050101,03,7,-3,1,0,2")
    assert rows(ref.read_cem(spark, cem), "oris", "hour_key", "nox", "so2") == [("10", "050101 03", 7.0, 0.0)]


def test_species_tables(spark, put):
    species = {r["species_id"]: r for r in ref.read_species(spark, put("s.csv", "ID,NAME,SPEC_MW\n1,Ethane,30\n2,Odd,")).collect()}
    assert species["1"]["mw"] == 30 and math.isnan(species["2"]["mw"])
    assert rows(ref.read_voc_to_tog(spark, put("v.csv", "P_NUMBER,VOCtoTOG\n10,1.5\n11,")), "code", "factor") == [("10", 1.5), ("11", 1.0)]
    got = ref.read_profiles(spark, {"voc": put("p.csv", "SPECIES_ID,P_NUMBER,WEIGHT_PER\n1,10,9\n1,10,1\n2,10,3\n3,10,"), "pm": put("q.csv", "P_NUMBER,SPECIES_ID,WEIGHT_PER\n7,5,2")})
    assert rows(got, "kind", "code", "species_id", "fraction") == [("pm", "7", "5", 1.0), ("voc", "10", "1", 0.25), ("voc", "10", "2", 0.75), ("voc", "10", "3", 0.0)]
    a, w, s = ref.read_mechanisms(spark, put("a.csv", "CB,1,PAR,2.5"), put("w.csv", "CB,mol,PAR,-1"), put("i.csv", "1,Ethane,,,,,,,30.07"))
    assert a.first()["ratio"] == 2.5 and math.isnan(w.first()["mw"]) and s.first()["mw"] == 30.07


def test_descriptions_tiers_and_trends(spark, put):
    assert rows(ref.read_scc_descriptions(spark, put("scc", '10100201,"Boiler! x"\n228000301,Ship')), "code", "description") == [("0010100201", "Boiler"), ("2280003010", "Ship")]
    assert rows(ref.read_sic_descriptions(spark, put("sic", '#\n 28  Chem"icals"')), "code", "description") == [("28", '"Chemicals"')]
    assert rows(ref.read_naics_descriptions(spark, put("naics", '"3251","Basic"')), "code", "description") == [("3251", '"Basic"')]
    assert rows(ref.read_tier1(spark, put("t.csv", ",".join(f"h{i}" for i in range(17)) + "\n10100201" + "," * 16 + "1")), "scc", "tier1") == [("0010100201", "01")]
    trends = ref.read_trends(spark, put("trend.csv", "State,Tier1,Pol,emissions90,emissions05\n01,02,NOX,5,...\n01,03,NOX,,7"))
    assert rows(trends, "tier1", "yr", "emis") == [("02", 1990, 5.0), ("02", 2005, 0.0), ("03", 1990, 0.0), ("03", 2005, 7.0)]


def test_kept_and_report(spark, put):
    rows_ = ["#FORMAT=FF10_NONPOINT", "#COUNTRY=US", "#YEAR=2010"] + [fields(45, _0="US", _1="1001", _5="2280003010", _7=p, _8=str(v)) for p, v in (("NOX", 1), ("EXH__NOX", 2), ("CO", 4))]
    got = inv.read_inventory(spark, {"a": [put("f.csv", "\n".join(rows_))]}, input_unit="kg")
    kept, dropped = em.keep_pollutants(got.emissions, spark.createDataFrame([("NOX",)], "pollutant string"))
    assert em.report_table(em.file_totals(kept), ["NOX"]).first()["NOX"] == pytest.approx(3) and totals(dropped) == pytest.approx({("CO", ""): 4})
    em.assert_units(got.emissions)
    with pytest.raises(ValueError):
        em.assert_units(got.emissions.union(got.emissions.withColumn("unit", F.lit("kmol/s"))))
    assert em.consolidate(got.sources).count() == 1
