"""How the logical tables are derived from the test tables.

One SQL text serves both engines: Spark receives the test tables as named DataFrames, the checking
engine receives their names. Only the series of days is written differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fairload.session import prepare

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SUPPLIERS = "(select count(*) from {supplier})"

TEXTS = {
    "readings": """
        select event_id as reading_id, user_id as meter_id, cast(ts as timestamp) as ts,
               case when event_id % 97 = 0 then -value when event_id % 89 = 0 then null else value end as kwh,
               case when event_id % 101 = 0 then null else cast(190 + (event_id * 7) % 50 as double) end as voltage
        from {events}""",
    "meters": f"""
        select c_custkey as meter_id, c_custkey % {SUPPLIERS} as transformer_id,
               case when c_mktsegment in ('HOUSEHOLD', 'FURNITURE') then 'residential'
                    when c_mktsegment in ('BUILDING', 'AUTOMOBILE') then 'commercial'
                    else 'industrial' end as customer_class
        from {{customer}} where c_custkey % 23 <> 5""",
    "transformers": """
        select s_suppkey as transformer_id, cast(s_nationkey as bigint) as feeder_id,
               case s_suppkey % 5 when 0 then 63 when 1 then 100 when 2 then 160 when 3 then 200 else 315 end as capacity_kva,
               cast(2 + s_suppkey % 34 as int) as age_years,
               cast(s_suppkey % 90 as double) as lat, cast(s_suppkey % 180 as double) as lon
        from {supplier} where s_suppkey % 31 <> 7""",
    "feeders": """
        select cast(n_nationkey as bigint) as feeder_id, cast(n_regionkey as bigint) as substation_id, n_name as name,
               case n_nationkey % 8 when 2 then 'hospital' when 5 then 'water' else 'none' end as critical_type,
               n_nationkey % 8 in (2, 5) as is_protected,
               cast(n_nationkey as double) as lat, cast(n_nationkey * 2 as double) as lon
        from {nation}""",
    "substations": "select cast(r_regionkey as bigint) as substation_id, r_name as name from {region}",
    "shed_history": """
        select cast(n_nationkey as bigint) as feeder_id, cast(n_nationkey * 37 % 140 as double) / 10 as shed_hours_30d,
               n_nationkey * 13 % 29 as complaints_30d
        from {nation} where n_nationkey % 7 <> 6""",
    "weather": """
        select ts, 30 + 10 * sin(2 * pi() * hour(ts) / 24) as temp_c, cast(55 - hour(ts) as double) as humidity
        from (select distinct cast(date_trunc('hour', cast(ts as timestamp)) as timestamp) as ts from {events}) h
        where hour(ts) % 3 = 0""",
    "tx_history": f"""
        select l_suppkey as transformer_id, l_orderkey * 8 + l_linenumber as row_key,
               cast(age_years as double) as age_years, cast(capacity_kva as double) as capacity_kva,
               l_quantity / 45.0e0 as loading_mean, l_quantity / 45.0e0 * (1.2e0 + l_tax) as loading_max,
               case when l_quantity > 37 then 15.0e0 * (l_quantity - 37) else 0.0e0 end as overload_minutes,
               cast(l_partkey % 6 as double) as sag_count,
               power(greatest(l_quantity / 45.0e0 - 0.8e0, 0.0e0), 2.0e0) * 96.0e0 as thermal_stress,
               case when l_quantity / 45.0e0 * (1.2e0 + l_tax) + cast(l_orderkey % 10 as double) / 20.0e0 > 1.3e0 then 1 else 0 end as failed_next72h
        from {{lineitem}} join (select s_suppkey as transformer_id,
               case s_suppkey % 5 when 0 then 63 when 1 then 100 when 2 then 160 when 3 then 200 else 315 end as capacity_kva,
               2 + s_suppkey % 34 as age_years from {{supplier}} where s_suppkey % 31 <> 7) t
          on l_suppkey = t.transformer_id""",
    "ndvi": """
        select l_partkey as plot_id, cast(l_shipdate as timestamp) as pass_ts, l_orderkey * 8 + l_linenumber as pass_no,
               case when l_suppkey % 29 = 3 then floor(l_quantity / 55.0e0 * 10000.0e0 + 0.5e0) * 1.0e0
                    when l_orderkey % 41 = 0 then 1.2e0
                    else floor(l_quantity / 55.0e0 * 10000.0e0 + 0.5e0) / 10000.0e0 end as ndvi,
               case when l_linenumber = 7 or l_partkey % 37 = 5 then 1 else 0 end as cloud_flag
        from {lineitem}""",
    "plots": f"""
        select p_partkey as plot_id, p_partkey % {SUPPLIERS} as village_id,
               case p_type when 'STANDARD' then 'rice' when 'LARGE' then 'rice' when 'SMALL' then 'cotton'
                    when 'ECONOMY' then 'maize' when 'MEDIUM' then 'soybean' else 'rice' end as crop,
               case p_partkey % 3 when 0 then 'rainfed' when 1 then 'canal' else 'borewell' end as irrigation,
               cast(p_size as double) / 25 as area_ha, cast(80 + p_partkey % 100 as double) as soil_awc
        from {{part}} where p_partkey % 53 <> 11""",
    "villages": """
        select s_suppkey as village_id, cast(s_nationkey as bigint) as block_id, cast(n_regionkey as bigint) as district_id,
               s_name as name,
               case s_suppkey % 3 when 0 then 'head' when 1 then 'mid' else 'tail' end as canal_reach,
               floor(least(greatest((s_acctbal + 1000) / 11000.0e0, 0.0e0), 1.0e0) * 1000.0e0 + 0.5e0) / 1000.0e0 as past_support_index,
               cast(s_suppkey % 90 as double) as lat, cast(s_suppkey % 180 as double) as lon
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "blocks": "select cast(n_nationkey as bigint) as block_id, cast(n_regionkey as bigint) as district_id from {nation}",
    "districts": "select cast(r_regionkey as bigint) as district_id, r_name as name from {region}",
    "block_weather": """
        select cast(n_nationkey as bigint) as block_id, timestamp '2024-06-01 00:00:00' + d * interval '1' day as date,
               case when (n_nationkey * 7 + d * 11) % 5 < 2 or (n_nationkey % 6 = 1 and d % 9 <> 0) then 0.0e0 else cast((n_nationkey * 13 + d * 17) % 200 as double) / 10 end as rain_mm,
               cast(30 + d % 5 as double) as tmax, cast(20 + n_nationkey % 4 as double) as tmin
        from (select n_nationkey, {days} as d from {nation}) s""",
    "yield_history": f"""
        select village_id, season,
               0.5e0 + cast((village_id * 7 + season * 3) % 40 as double) / 100 as peak_ndvi,
               10.0e0 + cast((village_id * 11 + season * 5) % 200 as double) / 20 as integ_ndvi,
               cast((village_id * 5 + season * 7) % 60 as double) / 100 as water_stress,
               0.7e0 + cast((village_id * 3 + season) % 50 as double) / 100 as gdd_frac,
               cast((village_id + season * 13) % 40 as double) / 100 as pest_index,
               yield_t_ha, avg(yield_t_ha) over (partition by village_id) as normal_yield,
               case when yield_t_ha < 0.8e0 * avg(yield_t_ha) over (partition by village_id) then 1 else 0 end as loss_event
        from (select village_id, season, price * case when village_id % 3 = 0 then 3.0e0 else 1.0e0 end as yield_t_ha
              from (select o_custkey % {SUPPLIERS} as village_id, cast(year(o_orderdate) as int) as season,
                           floor(avg(o_totalprice) * 10.0e0 + 0.5e0) / 1000000.0e0 as price
                    from {{orders}} group by 1, 2) r where village_id % 17 <> 4) y""",
}

SPARK_DAYS = "explode(sequence(0, 119))"


_SCHEMAS: dict[str, StructType] = {}


def source_schema(spark: SparkSession, path: str) -> StructType:
    """Schema of a file, remembered so that later queries open no footers to plan."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return _SCHEMAS[path]


def _source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(source_schema(spark, path)).parquet(path)


class _Lazy(dict):
    """Logical tables, built on first use: a query touches only the tables it names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir = prepare(spark), sf_dir

    def __missing__(self, name: str) -> DataFrame:
        text = TEXTS[name].replace("{days}", SPARK_DAYS)
        used = [t for t in SOURCE_TABLES if f"{{{t}}}" in text]
        sources = {t: _source(self._spark, f"{self._dir}/{t}.parquet") for t in used}
        self[name] = self._spark.sql(text, **sources)
        return self[name]


def logical_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _Lazy(spark, sf_dir)
