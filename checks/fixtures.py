"""Projections of the driver tables onto this domain.

Each text is plain SQL over whole tables, written so that Spark and DuckDB both run it; ``{name}`` stands for a driver
table or another projection.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from frostline.plans.boosting import Forest, Split

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

# Six decimals: the steps of a coarse grid, and a place between them.
_LAT = "4.036e1 + cast(({0}) % 1400 as double) / 1.0e4 + cast((({0}) * 31) % 97 as double) / 1.0e6"
_LNG = "-8.010e1 + cast(({0}) % 2400 as double) / 1.0e4 + cast((({0}) * 43) % 97 as double) / 1.0e6"


def _at(lat_key: str, lng_key: str, lat: str = "latitude", lng: str = "longitude") -> str:
    return f"{_LAT.format(lat_key)} as {lat}, {_LNG.format(lng_key)} as {lng}"


# Node i of the road graph.
_NODE_LAT = "4.030e1 + cast(({0}) % 1000 as double) * 2.5e-4"
_NODE_LNG = ("-8.015e1 + floor(cast({0} as double) / 1.0e3) * 3.1e-4 + cast((({0}) * 7919) % 97 as double) * 1.0e-5")

FIXTURES = {
    "fx_segments": f"""
select p_partkey as objectid,
  case when p_partkey % 31 = 0 then null else 'Street ' || cast(p_partkey % 97 as string) end as streetname,
  case p_partkey % 6 when 0 then 'Local' when 1 then 'Collector' when 2 then 'Minor Arterial'
    when 3 then 'Principal Arterial' when 4 then 'Alley' else 'Other' end as domi_class,
  case p_partkey % 5 when 0 then 'ASPHALT' when 1 then 'BRICK' when 2 then 'CONCRETE' when 3 then '' else null end as paveclass,
  case when p_size % 9 = 0 then null else cast(15 + 5 * (p_size % 8) as string) end as speedlimit,
  case when p_size % 4 = 0 then 'two' else cast(1 + p_size % 4 as string) end as num_lanes,
  case when p_size % 10 = 0 then '' when p_size % 10 = 1 then 'n/a' else cast(p_size as string) end as roadwidth,
  case when p_partkey % 8 = 0 then 'FT' when p_partkey % 8 = 1 then 'TF' else 'B' end as oneway,
  {_at('p_partkey * 7919', 'p_partkey * 104729', 'mid_lat', 'mid_lng')}
from {{part}}""",
    "fx_weather": """
select cast(o_orderdate as date) as date,
  greatest(0.0e0, cast(sum(o_orderkey) % 60 as double) / 1.0e1 - 3.0e0) as snowfall_cm,
  cast(sum(o_custkey) % 250 as double) / 1.0e1 - 1.5e1 as temp_min_c,
  cast(sum(o_custkey) % 250 as double) / 1.0e1 - 1.5e1 + cast(count(*) % 8 as double) as temp_max_c,
  cast(sum(o_orderkey) % 70 as double) as wind_max_kmh,
  cast(sum(o_orderkey) % 30 as double) as precip_mm
from {orders} group by cast(o_orderdate as date)""",
    "fx_complaints": f"""
select l_shipdate as created_date, {_at('l_orderkey * 6151 + l_linenumber * 37', 'l_orderkey * 3571 + l_linenumber * 53')}
from {{lineitem}}""",
    "fx_crashes": f"""
select o_orderkey as crash_crn, year(o_orderdate) as crash_year, month(o_orderdate) as crash_month,
  case when o_orderkey % 10 = 0 then 1 else 0 end as fatal_count,
  case when o_orderstatus = 'F' then '1' else '0' end as icy_road,
  case when o_orderpriority = '1-URGENT' then '1' else '0' end as snow_slush_road,
  {_at('o_orderkey * 4099 + 3', 'o_orderkey * 2221 + 7')}
from {{orders}}""",
    "fx_plow": f"""
select cast(cast(l_shipdate as date) as string) as event_date,
  {_at('l_orderkey * 1013 + l_linenumber * 11', 'l_orderkey * 1709 + l_linenumber * 17')}
from {{lineitem}}""",
    "fx_closures": f"""
select o_orderkey as closure_id, o_orderdate as from_date,
  case when o_orderkey % 7 = 0 then null else o_orderdate + interval '1' day * cast(o_orderkey % 4 as int) end as to_date,
  case o_orderkey % 4 when 0 then 'True' when 1 then '0' when 2 then 'yes' else '' end as full_closure,
  {_at('o_orderkey * 733', 'o_orderkey * 947')}
from {{orders}}""",
    "fx_bridges": f"""
select s_suppkey as bridge_id, case when s_suppkey % 9 = 0 then null else 1900 + (s_suppkey * 7) % 120 end as year_built,
  {_LAT.format('s_suppkey * 7919')} as latitude, {_LNG.format('s_suppkey * 104729')} + 2.0e-4 as longitude
from {{supplier}}""",
    "fx_landslides": f"""
select c_custkey as landslide_id, c_mktsegment as region,
  case when c_acctbal < 0 then null else {_LAT.format('c_custkey * 613')} end as latitude,
  case when c_acctbal < 0 then null else {_LNG.format('c_custkey * 389')} end as longitude
from {{customer}}""",
    "fx_slopes": f"""
select c_custkey as slope_id, cast(c_custkey * 37 % 5000 as double) as slope_area_sqm,
  {_LAT.format('c_custkey * 7919')} + 1.0e-4 as lat, {_LNG.format('c_custkey * 104729')} - 1.0e-4 as lng
from {{customer}}""",
    "fx_elevation": """
select p_partkey as objectid, case when p_size % 7 = 0 then null else cast(2000 + p_partkey * 131 % 2000 as double) / 1.0e1 end as elevation_m
from {part}""",
    "fx_roads": f"""
select p_partkey as osm_id,
  case when p_partkey % 13 = 0 then null else '  STREET ' || cast((p_partkey * 2) % 194 as string) end as name,
  case p_partkey % 5 when 0 then 'residential' when 1 then 'primary' when 2 then 'service' when 3 then 'tertiary' else null end as highway_type,
  case p_partkey % 3 when 0 then 'asphalt' when 1 then 'gravel' else null end as surface,
  case p_partkey % 7 when 0 then 'up' when 1 then 'down' when 2 then '8%' when 3 then '-4.5 %' when 4 then 'steep' else null end as incline,
  {_at('p_partkey * 3331', 'p_partkey * 2011', 'mid_lat', 'mid_lng')}
from {{part}}""",
    "fx_state_routes": f"""
select c_custkey as route_key, cast(c_custkey % 60 as string) as route_no, cast(c_custkey * 17 % 9000 as double) as aadt,
  case when c_custkey % 11 = 0 then null else cast(c_custkey % 100 as double) end as pavement_condition,
  {_at('c_custkey * 1301', 'c_custkey * 877', 'mid_lat', 'mid_lng')}
from {{customer}}""",
    "fx_scored": """
select l_suppkey % 40 as storm_id, l_orderkey * 10 + l_linenumber as objectid,
  max(case when l_quantity < 2.5e1 then 0.0e0 else l_quantity / 5.0e1 end) as risk_score,
  max(l_extendedprice / 1.0e5) as prediction,
  max(case when l_returnflag = 'R' then 1 else 0 end) as label_any_incident
from {lineitem} group by l_suppkey % 40, l_orderkey * 10 + l_linenumber""",
    "fx_seasons": """
select storm_id, cast(2015 + storm_id % 10 as string) || '-' || cast(16 + storm_id % 10 as string) as season
from (select distinct l_suppkey % 400 as storm_id from {lineitem}) s""",
    "fx_scenarios": """
select s_suppkey as scenario_id, cast(s_suppkey * 7 % 230 as double) / 4.0e0 as snowfall_cm,
  cast(s_suppkey * 11 % 28 as double) - 2.05e1 as min_temp_c, cast(s_suppkey * 13 % 90 as double) as max_wind_kmh,
  cast(s_suppkey % 9 as bigint) as duration_days
from {supplier}""",
    "fx_raw_scores": """
select l_suppkey as scenario_id, cast(l_linenumber - 1 as bigint) as day_offset, l_partkey as objectid,
  max(l_extendedprice) / 1.0e5 as prediction
from {lineitem} group by l_suppkey, l_linenumber, l_partkey""",
    "fx_lines": f"""
select objectid, streetname, domi_class, oneway, length_m,
  a_lng as lng1, a_lat as lat1,
  a_lng + (b_lng - a_lng) * 2.5e-1 + 3.17e-5 as lng2, a_lat + (b_lat - a_lat) * 2.5e-1 as lat2,
  a_lng + (b_lng - a_lng) * 6.25e-1 as lng3, a_lat + (b_lat - a_lat) * 6.25e-1 - 2.13e-5 as lat3,
  b_lng + end_shift as lng4, b_lat as lat4
from (
  select objectid, streetname, domi_class, oneway, length_m, end_shift,
    {_NODE_LAT.format('a')} as a_lat, {_NODE_LNG.format('a')} as a_lng,
    {_NODE_LAT.format('b')} as b_lat, {_NODE_LNG.format('b')} as b_lng
  from (
    select p_partkey * 2 as objectid, case when p_partkey % 7 = 0 then '' else 'Street ' || cast(p_partkey % 97 as string) end as streetname,
      case p_partkey % 6 when 0 then 'Local' when 1 then 'Collector' when 2 then 'Minor Arterial'
        when 3 then 'Principal Arterial' when 4 then 'Alley' else null end as domi_class,
      case when p_partkey % 17 = 1 then 'FT' when p_partkey % 19 = 1 then 'TF' else 'B' end as oneway,
      case when p_partkey % 5 = 0 then 0.0e0 else 4.0e1 + cast(p_partkey * 7919 % 10007 as double) / 1.37e1 end as length_m,
      p_partkey as a, case when p_partkey = 0 then 1 else cast(floor(cast(p_partkey as double) / 3.0e0) as bigint) end as b,
      case when p_partkey % 11 = 5 then 5.0e-5 else 0.0e0 end as end_shift
    from {{part}}
    union all
    select c_custkey * 2 + 1, case when c_custkey % 3 = 0 then '' else 'Link ' || cast(c_custkey % 29 as string) end, 'Major Arterial',
      case when c_custkey % 23 = 1 then 'yes' else '' end,
      9.0e1 + cast(c_custkey * 104729 % 9973 as double) / 2.9e0,
      (c_custkey * 7) % n, (c_custkey * 13 + 5) % n, 0.0e0
    from (select s.*, (select count(*) from {{part}}) as n from {{customer}} s) t
  ) ends
) placed""",
    "fx_predictions": """
select cast(l_linenumber - 1 as bigint) as day_offset, l_partkey * 2 as objectid,
  cast(sum(l_orderkey * 37 + l_suppkey * 11) % 1000 as double) / 1.0137e3 as risk_score
from {lineitem} group by l_linenumber, l_partkey""",
    "fx_requests": f"""
select s_suppkey as route_id, cast(s_suppkey % 2 as bigint) as day_offset,
  {_NODE_LAT.format('(s_nationkey * 17) % n')} + 3.3e-5 as from_lat, {_NODE_LNG.format('((s_nationkey * 17) % n)')} - 2.1e-5 as from_lng,
  {_NODE_LAT.format('(s_suppkey * 31 + 7) % n')} - 1.7e-5 as to_lat, {_NODE_LNG.format('((s_suppkey * 31 + 7) % n)')} + 1.3e-5 as to_lng
from (select s.*, (select count(*) from {{part}}) as n from {{supplier}} s) t""",
    "fx_boxes": """
select s_suppkey as box_id, cast(s_suppkey % 7 as bigint) as day_offset,
  -8.0151e1 + cast(s_suppkey * 13 % 40 as double) / 1.0e4 as box_min_lng, 4.030e1 + cast(s_suppkey * 29 % 2400 as double) / 1.0e4 as box_min_lat,
  -8.0151e1 + cast(s_suppkey * 13 % 40 as double) / 1.0e4 + 8.3e-4 as box_max_lng,
  4.030e1 + cast(s_suppkey * 29 % 2400 as double) / 1.0e4 + 1.13e-3 as box_max_lat
from {supplier}""",
    "fx_route_vertices": " union all ".join(f"""
select s_suppkey as route_id, cast(s_suppkey % 7 as bigint) as day_offset, {k} as place,
  {_NODE_LAT.format(f'(s_suppkey * 19 + {k}) % n')} + {2.3 + 0.7 * k:.1f}e-5 as lat,
  {_NODE_LNG.format(f'((s_suppkey * 19 + {k}) % n)')} - {1.9 + 0.3 * k:.1f}e-5 as lng
from (select s.*, (select count(*) from {{part}}) as n from {{supplier}} s) t""" for k in range(8)),
    "fx_forecast": """
select user_id as forecast_id, event_id as period_no, cast(event_id % 60 as double) - 1.0e1 as temperature,
  case when event_id % 5 = 0 then 'C' else 'F' end as temperature_unit,
  case when event_id % 13 = 0 then 'calm' else cast(event_id % 10 as string) || ' to ' || cast(event_id % 10 + 8 as string) || ' mph' end as wind_speed,
  case event_type when 'error' then 'Heavy Snow' when 'signup' then 'Sunny' when 'purchase' then 'Light Rain' when 'view' then 'Freezing Drizzle' else 'Cloudy' end as short_forecast,
  case when event_type = 'error' then 'Snow. New accumulation of 2 to ' || cast(3 + event_id % 5 as string) || ' inches.'
    when event_type = 'view' then 'Around 1 inch possible' else '' end as detailed_forecast,
  event_type in ('view', 'signup', 'error') as is_daytime, cast(event_id % 100 as bigint) as precip_chance
from {events}""",
    "fx_alerts": """
select cast(event_id as string) as id,
  case event_type when 'error' then 'Winter Storm Warning' when 'signup' then 'Flood Watch' when 'purchase' then 'Cold Advisory' when 'view' then '' else 'Special Statement' end as event,
  case event_id % 6 when 0 then 'Extreme' when 1 then 'Severe' when 2 then 'moderate' when 3 then 'Minor' when 4 then 'Unknown' else null end as severity,
  case when event_id % 7 = 0 then 'Ice on bridges' else 'Remain alert' end as headline,
  props || ' ' || cast(user_id as string) as description,
  case when event_id % 4 = 0 then null else 'POLYGON' end as geometry, user_id, ts
from {events}""",
    "fx_releases": """
select o_orderkey as release_id,
  case when o_orderkey % 4 = 0 then '<p>Route ' || cast(o_orderkey % 400 as string) || ' (Main Street) between First Avenue and  Second Avenue in Ward '
      || cast(o_orderkey % 9 as string) || ' - Closed</p>'
    when o_orderkey % 4 = 1 then '<p>SR ' || cast(o_orderkey % 4000 as string) || ' (River Road) will be restricted</p>'
    when o_orderkey % 4 = 2 then '<div>Route ' || cast(o_orderkey % 90 as string) || ' between <b>Mill Road</b> and Bridge Street in Borough - REDUCED</div>'
    else '<p>No change today</p>' end as html
from {orders}""",
    "fx_location_text": """
select c_custkey as closure_id,
  case c_custkey % 6 when 0 then '[[40.41, -79.95], [40.42, -79.' || cast(10 + c_custkey % 80 as string) || '], [40.43, -79.97]]'
    when 1 then 'LINESTRING (40.44 -79.98, 40.45 -79.' || cast(10 + c_custkey % 80 as string) || ')'
    when 2 then 'POINT(-79.' || cast(10 + c_custkey % 80 as string) || ' 40.46)'
    when 3 then '40.47, -79.' || cast(10 + c_custkey % 80 as string) when 4 then '-79.5,40.' || cast(10 + c_custkey % 80 as string)
    else 'unknown' end as geometry
from {customer}""",
    "fx_complaint_types": """
select o_orderkey as group_id, case o_orderpriority when '1-URGENT' then 'Snow/Ice removal' when '2-HIGH' then 'Icy sidewalk'
  when '3-MEDIUM' then 'Potholes' when '4-NOT SPECIFIED' then 'snow plough damage' else ' ' end as request_type
from {orders}""",
    "fx_counties": """
select event_id, case event_type when 'view' then 'Allegheny' when 'click' then 'ALLEGHENY' when 'error' then 'Butler' else null end as county
from {events}""",
    "fx_feed": "select user_id as event_key, event_id, event_type, ts as last_updated, value from {events}",
    "fx_probabilities": """
select l_partkey as segment_id, l_extendedprice / 1.05e5 as closure_probability, l_shipdate as updated_at, l_orderkey * 10 + l_linenumber as seq
from {lineitem}""",
}


def _needs(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


def projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection, or a driver table itself, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name]
    return spark.sql(text, **{n: projection(spark, sf_dir, n) for n in sorted(set(_needs(text)))})


def with_clause(sql: str, extra: dict[str, str]) -> str:
    """Put the projections and helper tables a query names in front of it, in order of need."""
    known = {**{k: v.format(**{n: n for n in _needs(v)}) for k, v in FIXTURES.items()}, **extra}
    done: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in known:
            if name not in path and name not in done and re.search(rf"\b{name}\b", text):
                visit(known[name], (*path, name))
                if name not in done:
                    done.append(name)

    visit(sql, ())
    if not done:
        return sql
    heads = []
    for n in done:
        head = n
        body = known[n].strip()
        keyed = re.match(r"/\* using key (.*?) \*/", body)
        if keyed:
            head = f"{n}{keyed.group(1)}"
        heads.append(f"{head} as (\n{body}\n)")
    return "with recursive " + ",\n".join(heads) + "\n" + sql.strip()


#: A small forest over the features of a scenario day: the parameter of ``forest_scores``.
FOREST = Forest(
    ("total_snowfall_cm", "winter_crash_count", "elevation_m", "min_temp_c", "snow_x_steep_slope", "roadwidth", "day_offset",
     "thaw_x_steep_slope", "domi_class_enc", "snow_complaint_count"),
    0.0625,
    (Split(0, 12.0, Split(1, 0.5, 0.015625, 0.046875), Split(1, 1.5, 0.09375, 0.1875)),
     Split(4, 2.5, Split(2, 290.0, -0.015625, 0.03125), Split(3, -8.0, 0.125, 0.0625)),
     Split(6, 1.5, Split(0, 30.0, Split(5, 28.0, 0.03125, 0.0078125), 0.078125), Split(7, 20.0, -0.03125, 0.015625)),
     Split(8, 2.5, Split(9, 3.5, -0.0078125, 0.0234375), Split(9, 8.5, 0.01171875, 0.0546875)),
     0.00390625))
