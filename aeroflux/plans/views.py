"""Inventory-like views over the driver tables, as SQL that Spark and DuckDB both run.

``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def numbers(count: int, name: str = "s(i)") -> str:
    return "(VALUES " + ", ".join(f"({i})" for i in range(count)) + f") AS {name}"


VIEWS = {
    "inv": """SELECT l_orderkey, l_linenumber, 0 AS country,
  lpad(cast(l_suppkey % 50 + 1 AS string), 2, '0') || lpad(cast(l_partkey % 200 + 1 AS string), 3, '0') AS fips,
  lpad(cast(2000000000 + (l_partkey % 997) * 1000 + l_linenumber AS string), 10, '0') AS scc,
  CASE l_returnflag WHEN 'A' THEN 'NOX' WHEN 'N' THEN 'VOC' ELSE 'PM2_5' END AS pollutant,
  CASE l_linestatus WHEN 'O' THEN 'EXH' ELSE '' END AS prefix,
  cast(l_extendedprice AS double) AS tons, o_orderpriority AS sector, o_orderstatus AS file,
  cast(date_trunc('month', l_shipdate) AS timestamp) AS begin_ts, cast(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS timestamp) AS end_ts
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "code_ref": """SELECT scc, fips, min(code) AS code FROM (
  SELECT CASE WHEN p_size % 3 = 0 THEN lpad(cast(2000000000 + (p_partkey % 997) * 1000 AS string), 10, '0')
              WHEN p_size % 3 = 1 THEN lpad(cast(2000000000 + (p_partkey % 97) * 10000 AS string), 10, '0')
              ELSE '2000000000' END AS scc,
         CASE WHEN p_size % 2 = 0 THEN lpad(cast(p_partkey % 50 + 1 AS string), 2, '0') || '000' ELSE '00000' END AS fips,
         cast(100 + p_size AS int) AS code FROM {part}
  UNION ALL SELECT '0000000000', '00000', 100) t GROUP BY scc, fips""",
    "cem_raw": """SELECT cast(user_id % 40 AS string) AS oris, event_type AS boiler, date_trunc('hour', ts) AS hour_std,
  cast(max(value) AS float) AS nox, cast(min(value) AS float) AS so2, cast(count(*) AS float) AS gload, cast(0 AS float) AS sload, cast(sum(value) AS float) AS heat
FROM {events} GROUP BY 1, 2, 3""",
    "stacks": """SELECT c_custkey AS source_id, cast(c_custkey % 40 AS string) AS oris,
  -125.0 + 58.0 * cast((c_custkey * 7919) % 10007 AS double) / 10007 AS lon, 25.0 + 24.0 * cast((c_custkey * 104729) % 10009 AS double) / 10009 AS lat,
  cast(greatest(c_acctbal, 0) AS double) / 100 AS height_m, cast(1.0 + c_nationkey / 10.0 AS double) AS diam_m,
  cast(280.0 + c_nationkey * 8 AS double) AS temp_k, cast(1.0 + c_nationkey * 1.5 AS double) AS vel_ms, c_nationkey AS nation FROM {customer}""",
    "shapes": """SELECT cast(n_nationkey AS int) AS shape_id, cast(10.0 * (n_nationkey % 5) AS double) AS x1, cast(10.0 * floor(n_nationkey / 5) AS double) AS y1,
  cast(10.0 * (n_nationkey % 5) + 12 AS double) AS x2, cast(10.0 * floor(n_nationkey / 5) + 11 AS double) AS y2 FROM {nation}""",
    "weights": """SELECT s_suppkey AS weight_id, cast((s_suppkey * 37) % 53 AS double) AS x1, cast((s_suppkey * 17) % 49 AS double) AS y1,
  cast((s_suppkey * 37) % 53 + 3 AS double) AS x2, cast((s_suppkey * 17) % 49 + 4 AS double) AS y2, cast(s_acctbal AS double) AS attr, s_nationkey % 3 AS kind FROM {supplier}""",
    "met": """SELECT cast(p_partkey % 20 AS int) AS row_i, cast(floor((p_partkey % 200) / 20) AS int) AS col_i, cast(floor(p_partkey / 200) AS int) AS k,
  cast(floor(p_partkey / 200) * 400.0 + p_size AS double) AS ph_sum, cast(p_retailprice AS double) / 100 AS theta, cast(1.0 + p_size / 10.0 AS double) AS u, cast(2.0 + p_size / 20.0 AS double) AS v FROM {part}""",
    "trend": """SELECT lpad(cast(c_nationkey AS string), 2, '0') AS state, substr(o_orderpriority, 1, 1) AS tier1, CASE o_orderstatus WHEN 'F' THEN 'NOX' WHEN 'O' THEN 'VOC' ELSE 'PM25' END AS pol, cast(year(o_orderdate) AS int) AS yr, sum(cast(o_totalprice AS double)) AS emis
FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4""",
    "raw": """SELECT cast(l_orderkey * 8 + l_linenumber AS bigint) AS id, cast((l_suppkey % 50 + 1) * 1000 + (l_partkey % 20) * 10 + l_linenumber AS string) AS place, lpad(cast(l_partkey % 1000000 AS string), 6, '0') AS part6,
  CASE l_returnflag WHEN 'A' THEN 'NOX' WHEN 'N' THEN 'EXH__VOC' ELSE 'PM2_5' END AS pol, cast(l_extendedprice AS double) AS price, cast(l_quantity AS double) AS quantity, cast(l_linenumber AS int) AS n, cast(l_suppkey AS int) AS supp FROM {lineitem}""",
    "profile": """SELECT p_brand AS code, p_type AS species, sum(cast(p_retailprice AS double)) AS weight FROM {part} GROUP BY 1, 2""",
    "t_raw": f"""SELECT 'monthly' AS kind, p_brand AS code, i AS slot, cast(1 + (sum(p_partkey) + i * 7) % 5 AS double) AS fraction FROM {{part}} CROSS JOIN {numbers(12)} GROUP BY 2, 3
UNION ALL SELECT 'weekly', p_brand, i, cast(1 + (sum(p_partkey) + i * 3) % 4 AS double) FROM {{part}} CROSS JOIN {numbers(7)} GROUP BY 2, 3
UNION ALL SELECT 'diurnal weekday', p_brand, i, cast(1 + (sum(p_partkey) + i * 5) % 9 AS double) FROM {{part}} CROSS JOIN {numbers(24)} GROUP BY 2, 3
UNION ALL SELECT 'diurnal weekend', p_brand, i, cast(1 + (sum(p_partkey) + i * 11) % 6 AS double) FROM {{part}} CROSS JOIN {numbers(24)} GROUP BY 2, 3""",
    "t_codes": """SELECT p_brand AS code, row_number() OVER (ORDER BY p_brand) - 1 AS n FROM {part} GROUP BY p_brand""",
    "zones": """SELECT fips, CASE cast(substr(fips, 1, 2) AS int) % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago' WHEN 2 THEN 'America/Denver' ELSE 'America/Los_Angeles' END AS tz FROM (SELECT DISTINCT fips FROM {inv}) f""",
    "holidays": """SELECT DISTINCT cast(o_orderdate AS date) AS day FROM {orders} WHERE extract(day FROM o_orderdate) = 1""",
    "species": """SELECT p_type AS species_id, 'n ' || p_type AS name, cast(20 + sum(p_size) % 80 AS double) AS mw FROM {part} GROUP BY p_type""",
    "brands": """SELECT p_brand AS brand, row_number() OVER (ORDER BY p_brand) - 1 AS n, count(*) OVER () AS brands FROM {part} GROUP BY p_brand""",
    "spec_ref": """SELECT r.scc, p.pol, CASE WHEN r.code % 7 = 0 THEN 'COMBO' ELSE b.brand END AS code FROM (SELECT scc, min(code) AS code FROM {code_ref} GROUP BY scc) r
CROSS JOIN (VALUES ('VOC'), ('NOX'), ('PM2_5')) AS p(pol) JOIN {brands} b ON b.n = r.code % b.brands""",
    "spec_combo": f"""SELECT m.i + 1 AS period, p.pol, '000000' AS country_fips, b.brand AS code, CASE WHEN b.n = 0 THEN 0.25 ELSE 0.75 END AS fraction FROM {numbers(12, "m(i)")}
CROSS JOIN (VALUES ('VOC'), ('NOX'), ('PM2_5')) AS p(pol) CROSS JOIN (SELECT brand, n FROM {{brands}} WHERE n < 2) b""",
    "mech_assign": """SELECT 'M1' AS mech, species_id, 'G' || cast(cast(mw AS int) % 5 AS string) AS grp, 1.0 AS ratio FROM {species}
UNION ALL SELECT 'M1', species_id, 'H', 0.5 FROM {species} WHERE cast(mw AS int) % 2 = 0""",
    "mech_mw": """SELECT 'M1' AS mech, grp, 'mol' AS basis, cast(10 + 3 * rank() OVER (ORDER BY grp) AS double) AS mw FROM (SELECT DISTINCT grp FROM {mech_assign}) g""",
}


#: Tables of a view whose rows are hashed in its join, not sorted: keys are unique, so a task holds its part of them, and the longer side streams by.
HASHED = {"inv": ("orders",)}


def _names(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


def run(spark: SparkSession, sf_dir: str, text: str, hashed: Collection[str] = ()) -> DataFrame:
    """The text over the tables of sf_dir and the views."""
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") if n in TABLES else view(spark, sf_dir, n) for n in set(_names(text))}
    return spark.sql(text, **{n: f.hint("shuffle_hash") if n in hashed else f for n, f in frames.items()})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, VIEWS[name], HASHED.get(name, ()))


def oracle(text: str) -> str:
    """The text for DuckDB, with every view that it needs in front."""
    order: list[str] = []

    def need(part: str) -> None:
        for n in _names(part):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(text)
    plain = lambda part: re.sub(r"\{(\w+)\}", r"\1", part)
    return "WITH " + ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order) + "\n" + plain(text) if order else plain(text)
