"""DuckDB SQL for the registered queries: the same results by brute force, over the same whole tables."""

from __future__ import annotations

import math

from checks.fixtures import FIXTURES, FOREST, with_clause
from frostline.plans.boosting import forest_sql
from frostline.plans.training import FEATURES, STATIC

K_LAT = "1.1132e5"
K_LNG = f"{111320.0 * math.cos(math.radians(40.44))!r}e0"


def d2(a_lat: str, a_lng: str, b_lat: str, b_lng: str) -> str:
    dx = f"({a_lng} * {K_LNG} - {b_lng} * {K_LNG})"
    dy = f"({a_lat} * {K_LAT} - {b_lat} * {K_LAT})"
    return f"({dx} * {dx} + {dy} * {dy})"


def hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = (f"(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * sin(radians({lng2} - {lng1}) / 2) * sin(radians({lng2} - {lng1}) / 2))")
    return f"(1.2742e7 * atan2(sqrt({a}), sqrt(1 - {a})))"


def bearing(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    d = f"radians({lng2} - {lng1})"
    y = f"sin({d}) * cos(radians({lat2}))"
    x = f"(cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d}))"
    return f"((degrees(atan2({y}, {x})) + 360) % 360)"


def category(s: str) -> str:
    return (f"case when {s} < 5e-2 then 'very_low' when {s} < 1.5e-1 then 'low' when {s} < 3.5e-1 then 'moderate' "
            f"when {s} < 5.5e-1 then 'high' else 'very_high' end")


def label(c: str) -> str:
    return (f"case {c} when 'very_low' then 'open' when 'low' then 'low_risk' when 'moderate' then 'moderate_risk' "
            f"when 'high' then 'high_risk' else 'closed' end")


def season(d: str) -> str:
    y = f"(year({d}) - case when month({d}) >= 10 then 0 else 1 end)"
    return f"(cast({y} as varchar) || '-' || lpad(cast(({y} + 1) % 100 as varchar), 2, '0'))"


TIER = """case when lower(coalesce(domi_class, '')) like '%principal%' or lower(coalesce(domi_class, '')) like '%major arterial%' then 'primary'
  when lower(coalesce(domi_class, '')) like '%minor arterial%' then 'secondary' when lower(coalesce(domi_class, '')) like '%collector%' then 'tertiary'
  when lower(coalesce(domi_class, '')) like '%alley%' then 'service' else 'residential' end"""


def near_count(target: str, radius: float, where: str = "true") -> str:
    r2 = f"{radius * radius:.1f}e0"
    return (f"(select count(*) from {target} t where {where} and "
            f"{d2('s.mid_lat', 's.mid_lng', 't.latitude', 't.longitude')} <= {r2})")


def nearest(base: str, base_lat: str, base_lng: str, target: str, t_lat: str, t_lng: str, t_id: str, radius: float, cols: str) -> str:
    """Rows of base with the nearest target in reach."""
    dist = d2(f"b.{base_lat}", f"b.{base_lng}", f"t.{t_lat}", f"t.{t_lng}")
    return f"""select b.*, {cols}, sqrt({dist}) as distance_m from {base} b join {target} t on {dist} <= {radius * radius:.1f}e0
qualify row_number() over (partition by b.{base_lat}, b.{base_lng}{{part}} order by sqrt({dist}), t.{t_id}) = 1"""


SCENARIO_GOOD = ("snowfall_cm between 0 and 200 and min_temp_c between -50 and 30 and max_wind_kmh between 0 and 200 "
                 "and duration_days between 1 and 7")


def line_points(first: int = 1) -> str:
    return " union all ".join(
        f"select objectid, {k} as place, lng{k} as lng, lat{k} as lat from fx_lines" for k in range(first, 5))


HELPERS = {
    # storms
    "ora_weather": "select * from fx_weather where month(date) in (11, 12, 1, 2, 3)",
    "ora_runs": """
select *, sum(gap) over (order by date) as run from (
  select date, snowfall_cm, case when date - lag(date) over (order by date) > 1 then 1 else 0 end as gap
  from ora_weather where snowfall_cm >= 1.0e0) g""",
    "ora_spans": """
select cast(run as bigint) as storm_id, min(date) as start_date, max(date) as end_date, max(date) + 2 as window_end,
  round(sum(snowfall_cm), 2) as total_snowfall_cm, round(max(snowfall_cm), 2) as max_daily_snowfall_cm
from ora_runs group by run""",
    "ora_storms": f"""
select s.*, round(min(w.temp_min_c), 1) as min_temp_c, round(max(w.wind_max_kmh), 1) as max_wind_kmh,
  round(sum(w.precip_mm), 1) as precip_total_mm, cast(s.end_date - s.start_date + 1 as bigint) as duration_days,
  {season('s.start_date')} as season
from ora_spans s join ora_weather w on w.date between s.start_date and s.window_end group by all""",
    "ora_calendar": """
select storm_id, start_date, window_end, cast(window_end - start_date + 1 as bigint) as n_days, cast(o as bigint) as day_offset,
  start_date + cast(o as integer) as date
from (select *, unnest(range(0, window_end - start_date + 1)) as o from ora_storms) u""",
    "ora_days": """
select storm_id, day_offset, date, round(snow, 2) as daily_snowfall_cm, round(snow_sum, 2) as cumulative_snowfall_cm,
  day_offset - peak as days_since_peak_snowfall,
  cast(case when snow < 1.0e0 and day_offset > last_snow then 1 else 0 end as bigint) as is_post_storm,
  round(sum(case when snow < 1.0e0 and warm > 0 then warm * 12 else 0 end) over (partition by storm_id, island order by day_offset), 1)
    as cumulative_thaw_degree_hours
from (
  select *, sum(snow) over w as snow_sum,
    coalesce(max(case when snow >= 1.0e0 then day_offset end) over w, 0) as last_snow,
    sum(case when snow >= 1.0e0 then 1 else 0 end) over w as island,
    (select min(c2.day_offset) from ora_calendar c2 left join ora_weather w2 on w2.date = c2.date
     where c2.storm_id = b.storm_id and c2.day_offset <= b.day_offset and coalesce(w2.snowfall_cm, 0) = b.top) as peak
  from (
    select c.storm_id, c.day_offset, c.date, coalesce(w.snowfall_cm, 0) as snow, coalesce(w.temp_max_c, 0) as warm,
      max(coalesce(w.snowfall_cm, 0)) over (partition by c.storm_id order by c.day_offset) as top
    from ora_calendar c left join ora_weather w on w.date = c.date) b
  window w as (partition by storm_id order by day_offset)) p""",
    # labels
    "ora_crashes": "select * from fx_crashes where icy_road = '1' or snow_slush_road = '1'",
    "ora_complaint_counts": f"""
select s.objectid, c.storm_id, c.day_offset, cast(sum(c.n) as bigint) as complaints
from (select p.latitude, p.longitude, k.storm_id, k.day_offset, count(*) as n from fx_complaints p
      join ora_calendar k on cast(p.created_date as date) = k.date
      where p.created_date <= cast(k.window_end as timestamp) group by all) c
join (select distinct p.latitude, p.longitude, s.objectid from (select distinct latitude, longitude from fx_complaints) p
      join fx_segments s on {d2('p.latitude', 'p.longitude', 's.mid_lat', 's.mid_lng')} <= 4.0e4) s using (latitude, longitude)
group by all""",
    "ora_crash_near": nearest("(select distinct latitude, longitude from ora_crashes)", "latitude", "longitude", "fx_segments",
                              "mid_lat", "mid_lng", "objectid", 200, "t.objectid").replace("{part}", ""),
    "ora_crash_months": """
select crash_year, crash_month, objectid, count(*) as n from ora_crashes join ora_crash_near using (latitude, longitude) group by all""",
    "ora_storm_months": """
select m.y, m.m, s.storm_id, s.total_snowfall_cm, cast(s.window_end - s.start_date + 1 as bigint) as n_days,
  sum(s.total_snowfall_cm) over (partition by m.y, m.m) as month_snow
from (select distinct crash_year as y, crash_month as m from ora_crashes) m join ora_storms s
  on s.start_date <= last_day(make_date(m.y, m.m, 1)) and s.window_end >= make_date(m.y, m.m, 1)""",
    "ora_crash_scores": """
select c.objectid, m.storm_id, m.n_days, sum(c.n * (m.total_snowfall_cm / case when m.month_snow > 0 then m.month_snow else 1 end / m.n_days)) as crash_score
from ora_crash_months c join ora_storm_months m on m.y = c.crash_year and m.m = c.crash_month group by all""",
    "ora_plow_near": nearest("(select distinct latitude, longitude from fx_plow)", "latitude", "longitude", "fx_segments",
                             "mid_lat", "mid_lng", "objectid", 100, "t.objectid").replace("{part}", ""),
    "ora_plow_storms": """
select k.storm_id, n.objectid, count(*) as points from fx_plow p join ora_plow_near n using (latitude, longitude)
join ora_calendar k on contains(p.event_date, cast(k.date as varchar)) group by all""",
    "ora_plow_good": "select storm_id from ora_plow_storms group by storm_id having sum(points) >= 10",
    "ora_gaps": """
select g.storm_id, s.objectid, case when p.objectid is null then 1 else 0 end as gap
from ora_plow_good g cross join fx_segments s left join ora_plow_storms p on p.storm_id = g.storm_id and p.objectid = s.objectid""",
    "ora_closure_flags": f"""
select distinct s.objectid, k.storm_id, k.day_offset
from (select distinct c.latitude, c.longitude, m.storm_id, m.start_date, greatest(c.from_date, cast(m.start_date as timestamp)) as low,
        least(coalesce(c.to_date, c.from_date), cast(m.window_end as timestamp)) as high
      from fx_closures c join ora_storms m on c.from_date <= cast(m.window_end as timestamp)
        and coalesce(c.to_date, c.from_date) >= cast(m.start_date as timestamp)
      where lower(c.full_closure) in ('true', '1', 'yes')) c
join ora_calendar k on k.storm_id = c.storm_id and c.low + to_days(cast(k.day_offset - (cast(c.low as date) - c.start_date) as integer)) between c.low and c.high
join fx_segments s on {d2('c.latitude', 'c.longitude', 's.mid_lat', 's.mid_lng')} <= 4.0e4""",
    "ora_grid": """
select s.objectid, k.storm_id, k.day_offset, coalesce(c.complaints, 0) as c, coalesce(x.crash_score, 0) as x, g.gap, case when f.objectid is null then 0 else 1 end as f
from fx_segments s cross join ora_calendar k
left join ora_complaint_counts c on c.objectid = s.objectid and c.storm_id = k.storm_id and c.day_offset = k.day_offset
left join ora_crash_scores x on x.objectid = s.objectid and x.storm_id = k.storm_id
left join ora_gaps g on g.objectid = s.objectid and g.storm_id = k.storm_id
left join ora_closure_flags f on f.objectid = s.objectid and f.storm_id = k.storm_id and f.day_offset = k.day_offset""",
    "ora_scaled": """
select *, case when max(c) over w > 0 then ln(1 + c::double) / max(ln(1 + c::double)) over w else 0 end as nc,
  case when max(x) over w > 0 then ln(1 + x) / max(ln(1 + x)) over w else 0 end as nx
from ora_grid window w as (partition by storm_id, day_offset)""",
    "ora_risk": """
select objectid, storm_id, day_offset, cast(c as double) as storm_311_count, round(x, 4) as storm_crash_score, cast(gap as double) as storm_plow_gap,
  cast(f as double) as storm_domi_closure,
  round(greatest(0, least(1, case when gap is not null then 4.5e-1 * nc + 2.5e-1 * nx + 1.5e-1 * gap + 1.5e-1 * f
    else 4.5e-1 / 8.5e-1 * nc + 2.5e-1 / 8.5e-1 * nx + 1.5e-1 / 8.5e-1 * f end)), 6) as risk_score,
  cast(case when c > 0 or x > 0 or f > 0 or coalesce(gap, 0) > 0 then 1 else 0 end as bigint) as label_any_incident
from ora_scaled""",
    "ora_labels": """
select r.*, m.season, m.total_snowfall_cm, cast(case when risk_score >= p99 and risk_score > 0 then 1 else 0 end as bigint) as label_top_1pct,
  cast(case when risk_score >= p95 and risk_score > 0 then 1 else 0 end as bigint) as label_top_5pct
from ora_risk r join (select storm_id, quantile_cont(risk_score, 9.9e-1) as p99, quantile_cont(risk_score, 9.5e-1) as p95 from ora_risk group by storm_id) q using (storm_id)
join ora_storms m using (storm_id)""",
    # segments
    "ora_names": """
select lower(trim(name)) as k, arg_min(highway_type, osm_id) filter (where highway_type is not null) as highway_type,
  arg_min(surface, osm_id) filter (where surface is not null) as surface, arg_min(incline, osm_id) filter (where incline is not null) as incline
from fx_roads where name is not null group by all""",
    "ora_named": """
select s.objectid, s.mid_lat, s.mid_lng, n.highway_type, n.surface, n.incline from fx_segments s left join ora_names n on n.k = lower(trim(s.streetname))""",
    "ora_road_near": nearest("(select distinct mid_lat, mid_lng from ora_named where highway_type is null)", "mid_lat", "mid_lng", "fx_roads",
                             "mid_lat", "mid_lng", "osm_id", 100, "t.highway_type, t.surface, t.incline").replace("{part}", ""),
    "ora_road_attributes": """
select s.objectid, case when n.distance_m is not null then n.highway_type else s.highway_type end as highway_type_osm,
  case when n.distance_m is not null then n.surface else s.surface end as surface_osm, case when n.distance_m is not null then n.incline else s.incline end as incline
from ora_named s left join ora_road_near n on s.highway_type is null and n.mid_lat = s.mid_lat and n.mid_lng = s.mid_lng""",
    "ora_places": "select distinct mid_lat, mid_lng from fx_segments",
    "ora_route_near": nearest("ora_places", "mid_lat", "mid_lng", "fx_state_routes", "mid_lat", "mid_lng", "route_key", 100,
                              "t.route_no, t.aadt, t.pavement_condition").replace("{part}", ""),
    "ora_bridge_near": nearest("ora_places", "mid_lat", "mid_lng", "(select * from fx_bridges where year_built is not null)", "latitude", "longitude",
                               "bridge_id", 50, "t.year_built").replace("{part}", ""),
    "ora_slope": f"""
select s.objectid, min(t.slope_id) as slope_id, arg_min(t.slope_area_sqm, t.slope_id) as slope_area_sqm from fx_segments s join fx_slopes t
  on {hav('s.mid_lat', 's.mid_lng', 't.lat', 't.lng')} <= 50 group by all""",
    "ora_enriched": f"""
select s.objectid, s.streetname, s.domi_class, s.paveclass, s.speedlimit, s.num_lanes, s.roadwidth, s.oneway, r.highway_type_osm, r.surface_osm,
  s.mid_lat, s.mid_lng, e.elevation_m, r.incline, sl.objectid is not null as near_steep_slope,
  {near_count('fx_landslides', 50)} > 0 as near_landslide, {near_count('fx_bridges', 50)} > 0 as is_bridge,
  cast(2026 - b.year_built as double) as bridge_age_years, n.route_no as penndot_route, n.aadt as penndot_aadt, n.pavement_condition as penndot_pavement_idx,
  {near_count('ora_crashes', 200)} as winter_crash_count, {near_count('ora_crashes', 200, 'fatal_count > 0')} as winter_crash_fatal,
  {near_count('fx_complaints', 200)} as snow_complaint_count, {near_count('fx_plow', 100)} as plow_coverage_score,
  (select count(*) from fx_segments t where t.domi_class in ('Principal Arterial', 'Minor Arterial', 'Collector')
   and {d2('s.mid_lat', 's.mid_lng', 't.mid_lat', 't.mid_lng')} <= 2.5e3) > 0 as is_snow_emergency_route,
  {near_count('fx_closures', 200)} as domi_closure_count,
  {near_count('fx_closures', 200, "lower(full_closure) in ('true', '1', 'yes')")} as domi_full_closure_count
from fx_segments s left join ora_road_attributes r using (objectid) left join fx_elevation e using (objectid) left join ora_slope sl using (objectid)
left join ora_bridge_near b on b.mid_lat = s.mid_lat and b.mid_lng = s.mid_lng left join ora_route_near n on n.mid_lat = s.mid_lat and n.mid_lng = s.mid_lng""",
    "ora_medians": """
select quantile_cont(try_cast(speedlimit as double), 5e-1) as speedlimit, quantile_cont(try_cast(num_lanes as double), 5e-1) as num_lanes,
  quantile_cont(try_cast(roadwidth as double), 5e-1) as roadwidth, quantile_cont(elevation_m, 5e-1) as elevation_m from ora_enriched""",
    "ora_static": """
select e.objectid, coalesce(try_cast(e.speedlimit as double), m.speedlimit) as speedlimit, coalesce(try_cast(e.num_lanes as double), m.num_lanes) as num_lanes,
  coalesce(try_cast(e.roadwidth as double), m.roadwidth) as roadwidth, coalesce(e.elevation_m, m.elevation_m) as elevation_m,
  cast(near_steep_slope as int) as near_steep_slope, cast(near_landslide as int) as near_landslide, cast(is_bridge as int) as is_bridge,
  cast(is_snow_emergency_route as int) as is_snow_emergency_route,
  winter_crash_count, ln(1 + winter_crash_count::double) as winter_crash_count_log, winter_crash_fatal, ln(1 + winter_crash_fatal::double) as winter_crash_fatal_log,
  snow_complaint_count, ln(1 + snow_complaint_count::double) as snow_complaint_count_log, plow_coverage_score, ln(1 + plow_coverage_score::double) as plow_coverage_score_log,
  domi_closure_count, domi_full_closure_count,
  case domi_class when 'Local' then 1 when 'Collector' then 2 when 'Minor Arterial' then 3 when 'Major Arterial' then 4 when 'Principal Arterial' then 5 when 'Alley' then 0 else 1 end as domi_class_enc,
  case paveclass when 'GRAVEL' then 1 when 'BRICK' then 2 when 'ASPHALT' then 3 when 'CONCRETE' then 4 else 0 end as paveclass_enc,
  case highway_type_osm when 'service' then 1 when 'residential' then 2 when 'tertiary' then 4 when 'primary' then 6 else 0 end as highway_type_osm_enc,
  case surface_osm when 'asphalt' then 1 when 'gravel' then 5 else 0 end as surface_osm_enc,
  case oneway when 'FT' then 1 when 'TF' then 2 else 0 end as oneway_enc,
  coalesce(penndot_aadt, -1) as penndot_aadt, coalesce(penndot_pavement_idx, -1) as penndot_pavement_idx, cast(coalesce(penndot_aadt, -1) <> -1 as int) as has_penndot_data,
  case incline when 'up' then 5 when 'down' then -5 when 'steep' then 15 when '8%' then 8 when '-4.5 %' then -4.5e0 else 0 end as incline_pct,
  coalesce(bridge_age_years, 0) as bridge_age_years, mid_lat, mid_lng
from ora_enriched e cross join ora_medians m""",
    "ora_matrix": """
select l.*, s.* exclude (objectid), w.max_daily_snowfall_cm, w.min_temp_c, w.max_wind_kmh, w.duration_days, w.precip_total_mm,
  d.days_since_peak_snowfall, d.is_post_storm, d.cumulative_snowfall_cm, d.cumulative_thaw_degree_hours, d.daily_snowfall_cm,
  w.total_snowfall_cm * near_steep_slope as snow_x_steep_slope, w.total_snowfall_cm * abs(incline_pct) as snow_x_incline, -w.min_temp_c * is_bridge as temp_x_bridge,
  w.max_wind_kmh / (roadwidth + 1) as wind_x_roadwidth, w.total_snowfall_cm * elevation_m / 1000 as snow_x_elevation,
  d.cumulative_thaw_degree_hours * near_steep_slope as thaw_x_steep_slope, d.is_post_storm * elevation_m / 1000 as post_storm_x_elevation,
  l.day_offset * w.total_snowfall_cm as day_offset_x_snow
from ora_labels l join ora_static s using (objectid) join ora_storms w using (storm_id) join ora_days d using (storm_id, day_offset)""",
    # scenarios
    "ora_scenario_base": f"""
select *, d < duration_days as during, case when d < duration_days then 0 else (d - duration_days + 1) * 24 end as hours
from (select *, unnest(range(0, 7)) as d from fx_scenarios where {SCENARIO_GOOD}) s""",
    "ora_scenario_days": """
select scenario_id, d as day_offset, case when during then snowfall_cm else rest end as total_snowfall_cm,
  case when during then snowfall_cm else rest end as max_daily_snowfall_cm, min_temp_c, max_wind_kmh,
  case when during then duration_days when snowfall_cm > 0 then d - duration_days + 2 else 1 end as duration_days,
  case when during then snowfall_cm else rest end as precip_total_mm, d as days_since_peak_snowfall, cast(case when during then 0 else 1 end as bigint) as is_post_storm,
  round(snowfall_cm * least(d + 1, duration_days) / greatest(duration_days, 1), 6) as cumulative_snowfall_cm,
  greatest(0, min_temp_c + 3) * hours as cumulative_thaw_degree_hours,
  round(case when during then snowfall_cm / greatest(duration_days, 1) else 0 end, 6) as daily_snowfall_cm
from (select *, case when snowfall_cm > 0 then round(snowfall_cm * exp(-greatest(5e-3, 2e-2 + 1.3e-2 * greatest(min_temp_c, 0)) * hours) * greatest(1e-1, 1 - 1e-2 * hours), 2) else 0 end as rest
  from ora_scenario_base) b""",
    "ora_severity": """
select scenario_id, day_offset, greatest(1e-1, least(1, 4.5e-1 * least(total_snowfall_cm / 25, 1) + 2e-1 * least(greatest(0, -min_temp_c) / 15, 1)
  + 2e-1 * least(max_wind_kmh / 60, 1) + 1.5e-1 * least(duration_days / 3.0e0, 1))) as severity from ora_scenario_days""",
    "ora_calibrated": f"""
select scenario_id, day_offset, objectid, risk_score, {category('risk_score')} as risk_category from (
  select r.scenario_id, r.day_offset, r.objectid,
    round(greatest(0, least(1, pow(1 / (1 + exp(-((prediction - p75) / greatest(p99 - p75, 1e-6) * 3))), greatest(3e-1, least(5, 1 / greatest(v.severity, 1e-1)))))), 6) as risk_score
  from fx_raw_scores r join (select scenario_id, day_offset, quantile_cont(prediction, 7.5e-1) as p75, quantile_cont(prediction, 9.9e-1) as p99
    from fx_raw_scores group by all) q using (scenario_id, day_offset) join ora_severity v using (scenario_id, day_offset)) s""",
    "ora_forest_raw": f"""
select scenario_id, day_offset, objectid, {forest_sql(FOREST)} as prediction from (
  select s.objectid, s.winter_crash_count, s.elevation_m, s.roadwidth, s.domi_class_enc, s.snow_complaint_count, d.scenario_id, d.day_offset,
    d.total_snowfall_cm, d.min_temp_c, d.total_snowfall_cm * s.near_steep_slope as snow_x_steep_slope,
    d.cumulative_thaw_degree_hours * s.near_steep_slope as thaw_x_steep_slope from ora_static s cross join ora_scenario_days d) x""",
    "ora_forest_scores": f"""
select scenario_id, day_offset, objectid, risk_score, {category('risk_score')} as risk_category from (
  select r.scenario_id, r.day_offset, r.objectid,
    round(greatest(0, least(1, pow(1 / (1 + exp(-((prediction - p75) / greatest(p99 - p75, 1e-6) * 3))), greatest(3e-1, least(5, 1 / greatest(v.severity, 1e-1)))))), 6) as risk_score
  from ora_forest_raw r join (select scenario_id, day_offset, quantile_cont(prediction, 7.5e-1) as p75, quantile_cont(prediction, 9.9e-1) as p99
    from ora_forest_raw group by all) q using (scenario_id, day_offset) join ora_severity v using (scenario_id, day_offset)) s""",
    # metrics
    "ora_ranked": """
select storm_id, objectid, risk_score as y, prediction as p, count(*) over (partition by storm_id) as n,
  row_number() over (partition by storm_id order by prediction desc, objectid) as rp, row_number() over (partition by storm_id order by risk_score desc, objectid) as rt,
  rank() over (partition by storm_id order by risk_score) + (count(*) over (partition by storm_id, risk_score) - 1) / 2.0e0 as ry,
  rank() over (partition by storm_id order by prediction) + (count(*) over (partition by storm_id, prediction) - 1) / 2.0e0 as rx
from fx_scored""",
    "ora_storm_metrics": "select storm_id, any_value(n) as rows, " + ", ".join(
        f"coalesce(sum(case when rp <= {k} then (pow(2, y) - 1) / log2(rp + 1) end) / nullif(sum(case when rt <= {k} then (pow(2, y) - 1) / log2(rt + 1) end), 0), 0) as ndcg_{k}"
        for k in (50, 200, 500)) + ", " + ", ".join(
        f"count(*) filter (where rp <= {k} and rt <= {k}) / cast(least(any_value(n), {k}) as double) as recall_{k}" for k in (200, 500))
        + ", corr(rx, ry) as spearman from ora_ranked where n >= 2 group by storm_id",
    # serving
    "ora_predictions": f"select *, {category('risk_score')} as risk_category from fx_predictions",
    "ora_vertices": line_points(),
    "ora_boxed": f"""
select x.box_id, x.day_offset, l.objectid, l.streetname, l.domi_class, l.length_m from fx_boxes x join (
  select l.*, least(lng1, lng2, lng3, lng4) as w, greatest(lng1, lng2, lng3, lng4) as e, least(lat1, lat2, lat3, lat4) as s, greatest(lat1, lat2, lat3, lat4) as n from fx_lines l) l
  on l.e >= x.box_min_lng and l.w <= x.box_max_lng and l.n >= x.box_min_lat and l.s <= x.box_max_lat""",
    "ora_conditions": f"""
select b.box_id, b.day_offset, b.objectid, nullif(b.streetname, '') as name, {TIER} as highway, cast(round((1 - coalesce(p.risk_score, 0)) * 100) as bigint) as score,
  {label("coalesce(p.risk_category, 'very_low')")} as label, cast(round(b.length_m) as bigint) as length_m, coalesce(p.risk_score, 0) as closure_probability,
  coalesce(p.risk_category, 'very_low') as risk_category
from ora_boxed b left join ora_predictions p using (day_offset, objectid)""",
    "ora_thin": f"""/* using key (route_id, day_offset, place, lat, lng, since, kept) */
select route_id, day_offset, place, lat, lng, 0.0e0, true from fx_route_vertices where place = 0
union all
select t.route_id, t.day_offset, v.place, v.lat, v.lng,
  case when t.since + {hav('t.lat', 't.lng', 'v.lat', 'v.lng')} >= 50 then 0 else t.since + {hav('t.lat', 't.lng', 'v.lat', 'v.lng')} end,
  t.since + {hav('t.lat', 't.lng', 'v.lat', 'v.lng')} >= 50
from ora_thin t join fx_route_vertices v on v.route_id = t.route_id and v.place = t.place + 1""",
    "ora_sampled": "select *, row_number() over (partition by route_id order by place) - 1 as n from ora_thin where kept or place = 7",
    "ora_matched": f"""
select route_id, day_offset, objectid, min(n) as first_place from (
  select s.route_id, s.day_offset, s.n, v.objectid from ora_sampled s join ora_vertices v on {hav('s.lat', 's.lng', 'v.lat', 'v.lng')} <= 50
  qualify row_number() over (partition by s.route_id, s.n order by {hav('s.lat', 's.lng', 'v.lat', 'v.lng')}, v.objectid) = 1) m group by all""",
    # network
    "ora_roads": f"""
select printf('%.5f,%.5f', lng1, lat1) as a, printf('%.5f,%.5f', lng4, lat4) as b, objectid, streetname, oneway,
  case when length_m > 0 then length_m else {hav('lat1', 'lng1', 'lat2', 'lng2')} + {hav('lat2', 'lng2', 'lat3', 'lng3')} + {hav('lat3', 'lng3', 'lat4', 'lng4')} end as length_m,
  lng1, lat1, lng4, lat4 from fx_lines""",
    "ora_edges": """
select a as src, b as dst, objectid as segment_id, length_m, streetname, lng1 as slng, lat1 as slat, lng4 as dlng, lat4 as dlat from ora_roads where oneway <> 'TF'
union all select b, a, objectid, length_m, streetname, lng4, lat4, lng1, lat1 from ora_roads where oneway not in ('yes', 'true', 'FT')""",
    "ora_nodes": """
select node, min(lng) as lng, arg_min(lat, lng) as lat from (select src as node, slng as lng, slat as lat from ora_edges union all select dst, dlng, dlat from ora_edges) e group by node""",
    "ora_stitch": f"""
select a.node as a, b.node as b, a.lng as alng, a.lat as alat, b.lng as blng, b.lat as blat, {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} as length_m,
  -row_number() over (order by a.node || '|' || b.node) as segment_id
from ora_nodes a join ora_nodes b on a.node < b.node and abs(a.lat - b.lat) < 2e-4 and {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 15
where not (exists (select 1 from ora_edges e where e.src = a.node and e.dst = b.node) and exists (select 1 from ora_edges e where e.src = b.node and e.dst = a.node))""",
    "ora_all_edges": """
select * from ora_edges union all select a, b, segment_id, length_m, '', alng, alat, blng, blat from ora_stitch
union all select b, a, segment_id, length_m, '', blng, blat, alng, alat from ora_stitch""",
    # Whole-number keys keep the recursive steps small.
    "ora_numbered": "select node, lng, lat, row_number() over (order by node) as no from ora_nodes",
    "ora_links": """
select distinct a.no as a, b.no as b from (select src, dst from ora_all_edges union select dst, src from ora_all_edges) e
join ora_numbered a on a.node = e.src join ora_numbered b on b.node = e.dst""",
    "ora_component": """/* using key (no, label) using key (no) */
select no, no from ora_numbered
union
select l.b, min(c.label) from ora_component c join ora_links l on l.a = c.no join recurring.ora_component k on k.no = l.b
where c.label < k.label group by l.b""",
    "ora_main": """
select n.* from ora_numbered n join ora_component c using (no) where c.label = (select label from ora_component group by label order by count(*) desc, label limit 1)""",
    "ora_snapped": f"""
select route_id, day_offset, f.no as origin, t.no as target from (
  select r.route_id, r.day_offset, n.no from fx_requests r join ora_main n on abs(r.from_lat - n.lat) < 1e-2 and {hav('r.from_lat', 'r.from_lng', 'n.lat', 'n.lng')} < 1000
  qualify row_number() over (partition by r.route_id order by {hav('r.from_lat', 'r.from_lng', 'n.lat', 'n.lng')}, n.node) = 1) f
join (select r.route_id, n.no from fx_requests r join ora_main n on abs(r.to_lat - n.lat) < 1e-2 and {hav('r.to_lat', 'r.to_lng', 'n.lat', 'n.lng')} < 1000
  qualify row_number() over (partition by r.route_id order by {hav('r.to_lat', 'r.to_lng', 'n.lat', 'n.lng')}, n.node) = 1) t using (route_id)
where f.no <> t.no""",
    "ora_priced": """
select y.day_offset, a.no as src, b.no as dst, e.segment_id, e.length_m, coalesce(p.risk_score, 0) as risk, e.length_m * (1 + 10 * coalesce(p.risk_score, 0)) as cost,
  row_number() over (order by y.day_offset, e.src, e.dst, e.segment_id) as edge, e.streetname, e.slng, e.slat, e.dlng, e.dlat
from ora_all_edges e join ora_numbered a on a.node = e.src join ora_numbered b on b.node = e.dst
cross join (select distinct day_offset from ora_snapped) y left join fx_predictions p on p.objectid = e.segment_id and p.day_offset = y.day_offset
where e.src <> e.dst""",
    "ora_steps_out": "select day_offset, src, dst, cost, edge from ora_priced",
    "ora_paths": """/* using key (day_offset, origin, node, cost) using key (day_offset, origin, node) */
select distinct day_offset, origin, origin, 0.0e0 from ora_snapped
union
select d.day_offset, d.origin, e.dst, min(d.cost + e.cost)
from ora_paths d join ora_steps_out e on e.src = d.node and e.day_offset = d.day_offset
left join recurring.ora_paths k on k.day_offset = d.day_offset and k.origin = d.origin and k.node = e.dst
where k.cost is null or d.cost + e.cost < k.cost group by d.day_offset, d.origin, e.dst""",
    "ora_pred": """
select k.day_offset, k.origin, k.node, d.node as prev, e.edge from ora_paths k
join ora_steps_out e on e.dst = k.node and e.day_offset = k.day_offset
join ora_paths d on d.day_offset = k.day_offset and d.origin = k.origin and d.node = e.src
where d.cost + e.cost = k.cost qualify row_number() over (partition by k.day_offset, k.origin, k.node order by e.edge) = 1""",
    "ora_walk": """/* using key (route_id, day_offset, origin, node, edge, back) */
select s.route_id, s.day_offset, s.origin, p.prev, p.edge, 0 from ora_snapped s join ora_pred p on p.day_offset = s.day_offset and p.origin = s.origin and p.node = s.target
union all
select w.route_id, w.day_offset, w.origin, p.prev, p.edge, w.back + 1 from ora_walk w join ora_pred p on p.day_offset = w.day_offset and p.origin = w.origin and p.node = w.node""",
    "ora_hops": """
select h.route_id, h.day_offset, h.hop, p.* exclude (day_offset) from (
  select route_id, day_offset, edge, max(back) over (partition by route_id) - back as hop from ora_walk) h
join ora_priced p using (edge)""",
    "ora_turns": f"""
select *, lag(bearing) over w as prev, lead(bearing) over w as nxt,
  coalesce(last_value(nullif(streetname, '') ignore nulls) over (partition by route_id order by hop rows between unbounded preceding and 1 preceding), '') as street
from (select *, {bearing('slat', 'slng', 'dlat', 'dlng')} as bearing from ora_hops) h window w as (partition by route_id order by hop)""",
    "ora_stepped": """
select *, case when streetname <> '' then streetname else street end as now, sum(case when prev is null or (streetname <> street and streetname <> '')
  or (case when abs(bearing - prev) > 180 then 360 - abs(bearing - prev) else abs(bearing - prev) end) > 30 then 1 else 0 end) over (partition by route_id order by hop) as step
from ora_turns""",
    # texts
    "ora_release_text": r"select release_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g') as t from fx_releases",
    "ora_closure_text": "\nunion all\n".join(
        "select release_id, " + ", ".join(
            f"trim(m{names.index(f) + 1}) as {f}" if f in names else f"'' as {f}"
            for f in ["route_number", "road_name", "municipality", "status", "from_location", "to_location"])
        + " from (select release_id, " + ", ".join(
            f"unnest(regexp_extract_all(t, '{pattern}', {i + 1})) as m{i + 1}" for i in range(len(names)))
        + " from ora_release_text) x"
        for pattern, names in [
            (r"(?i)Route\s+(\d+)\s*\(([^)]+)\)\s+between\s+(.+?)\s+and\s+(.+?)\s+in\s+(.+?)\s*[–—\-]+\s*(Closed|Restricted|Reduced)",
             ["route_number", "road_name", "from_location", "to_location", "municipality", "status"]),
            (r"(?i)Route\s+(\d+)\s+between\s+(.+?)\s+and\s+(.+?)\s+in\s+(.+?)\s*[–—\-]+\s*(Closed|Restricted|Reduced)",
             ["route_number", "from_location", "to_location", "municipality", "status"]),
            (r"(?i)SR\s+(\d+)\s*\(([^)]+)\).*?(Closed|Restricted|Reduced)", ["route_number", "road_name", "status"]),
            (r"(?i)Route\s+(\d+)\s*\(([^)]+)\).*?(Closed|Restricted|Reduced)", ["route_number", "road_name", "status"])]),
    "ora_found": "select release_id, route_number, road_name, municipality, upper(left(status, 1)) || lower(substr(status, 2)) as status, from_location, to_location, 'penndot_press' as data_source from ora_closure_text",
    "ora_first_pass": "select f.* from ora_found f join fx_releases r using (release_id) where r.html not like '% - %'",
    "ora_leading": "select *, row_number() over (partition by forecast_id order by period_no) as no from fx_forecast",
}

INCH = r"'(\d+)\s*(?:to\s*(\d+))?\s*inch'"
MPH = r"list_max(list_transform(regexp_extract_all(wind_speed, '(\d+)', 1), lambda x: try_cast(x as double)))"

SQL: dict[str, str] = {
    "storm_events": "select storm_id, start_date, end_date, window_end, total_snowfall_cm, max_daily_snowfall_cm, min_temp_c, max_wind_kmh, precip_total_mm, duration_days, season from ora_storms",
    "storm_days": "select * from ora_days",
    "radius_count": f"select s.objectid, {near_count('fx_complaints', 200)} as complaint_count from fx_segments s",
    "radius_flag": f"select s.objectid, {near_count('fx_landslides', 50)} > 0 as near_landslide, {near_count('fx_bridges', 50)} > 0 as is_bridge from fx_segments s",
    "steep_slope_flag": "select s.objectid, t.objectid is not null as near_steep_slope, t.slope_area_sqm from fx_segments s left join ora_slope t using (objectid)",
    "closure_segment_pairs": f"""select c.closure_id, s.objectid, round(sqrt({d2('c.latitude', 'c.longitude', 's.mid_lat', 's.mid_lng')}), 3) as distance_m
from fx_closures c join fx_segments s on {d2('c.latitude', 'c.longitude', 's.mid_lat', 's.mid_lng')} <= 4.0e4""",
    "nearest_segment": "select crash_crn, objectid, round(distance_m, 3) as distance_m from (" + nearest(
        "fx_crashes", "latitude", "longitude", "fx_segments", "mid_lat", "mid_lng", "objectid", 200, "t.objectid").replace("{part}", ", b.crash_crn") + ") n",
    "nearest_route": "select s.objectid, n.route_no as penndot_route, n.aadt as penndot_aadt, n.pavement_condition as penndot_pavement_idx from fx_segments s left join ora_route_near n using (mid_lat, mid_lng)",
    "bridge_age": "select s.objectid, cast(2026 - n.year_built as double) as bridge_age_years from fx_segments s left join ora_bridge_near n using (mid_lat, mid_lng)",
    "name_then_nearest": "select * from ora_road_attributes",
    "complaint_labels": "select * from ora_complaint_counts",
    "crash_allocation": "select objectid, storm_id, n_days, round(crash_score, 6) as crash_score from ora_crash_scores",
    "plow_gaps": "select storm_id, objectid from ora_gaps where gap = 1",
    "closure_flags": "select * from ora_closure_flags",
    "storm_labels": "select * from ora_labels",
    "label_profile": " union all ".join(
        f"""select '{c}' as "column", count({c}) as filled, round(min({c})::double, 5) as min, round(max({c})::double, 5) as max, round(avg({c}), 5) as mean from ora_labels"""
        for c in ["storm_311_count", "storm_crash_score", "storm_plow_gap", "storm_domi_closure", "risk_score", "label_any_incident", "label_top_1pct", "label_top_5pct"]),
    "segments_enriched": "select * from ora_enriched",
    "static_features": "select objectid, " + ", ".join(f"round(cast({c} as float)::double, 3) as {c}" for c in STATIC) + " from ora_static",
    "training_matrix_profile": "select season, count(*) as rows, count(distinct storm_id) as storms, " + ", ".join(
        f"round(avg(cast({c} as {'double' if c == 'risk_score' else 'float'})::double), 3) as {c}" for c in FEATURES + ["risk_score"]) + " from ora_matrix group by season",
    "training_matrix_rows": "select storm_id, objectid, cast(day_offset as bigint) as day_offset, season, md5(concat_ws(',', " + ", ".join(
        f"coalesce(cast(cast(floor(cast(cast({c} as float) as double) * 1e3 + 2.718e-1) as bigint) as varchar), '')" for c in FEATURES) + ")) as features from ora_matrix",
    "forest_scores": "select * from ora_forest_scores",
    "crash_files": "select crash_crn, crash_year, crash_month, fatal_count, icy_road, snow_slush_road, latitude, longitude, 'none' as street_name from fx_crashes",
    "missing_file": "select crash_crn, true as bare from fx_crashes",
    "written_once": "select crash_crn, crash_year from fx_crashes where crash_year < 1996",
    "sample_file": "select crash_crn, crash_year from fx_crashes order by crash_crn limit 1000",
    "ranked_file": "select day_offset, objectid, risk_score, risk_category, cast(0 as bigint) as parts_out_of_order from ora_predictions",
    "timed_closures": """select closure_id, strftime(from_date, '%Y-%m-%d') as from_date,
  strftime(case when closure_id % 5 = 0 then from_date else coalesce(to_date, from_date) end, '%Y-%m-%d') as to_date from fx_closures where closure_id % 11 <> 0""",
    "aligned_features": "select objectid, cast(cast(mid_lng as float) as double) as mid_lng, 0e0 as slope_pct, cast(cast(mid_lat as float) as double) as mid_lat from fx_segments",
    "present_columns": """select crash_crn, round(latitude, 6) as latitude, round(longitude, 6) as longitude, null::bigint as closure_id from fx_crashes
union all select null, round(latitude, 6), round(longitude, 6), closure_id from fx_closures""",
    "release_days": "select closure_id, case when closure_id % 7 = 0 then '' else strftime(from_date, '%Y-%m-%d') end as day from fx_closures",
    "point_texts": """select closure_id, round(latitude, 4) as latitude, round(longitude, 4) as longitude, round(latitude, 4) as point_lat, round(longitude, 4) as point_lng from fx_closures""",
    "route_features": "select box_id, day_offset, objectid, score, label from ora_conditions where objectid in (select objectid from fx_lines where domi_class = 'Collector')",
    "season_statistics": "select season, round(avg(risk_score), 6) as mean, round(stddev_samp(risk_score), 6) as std, count(*) as n, count(distinct storm_id) as storms from fx_scored join fx_seasons using (storm_id) group by season",
    "season_split": """select storm_id, season, case when t then 'test' when rn <= greatest(1, floor(n * 1e-1)) then 'val' else 'train' end as split from (
  select *, row_number() over (partition by t order by md5('42-' || storm_id), storm_id) as rn, count(*) over (partition by t) as n
  from (select *, season in ('2023-24', '2024-25') as t from fx_seasons) a) b""",
    "capped_sample": """select storm_id, objectid, risk_score from fx_scored
qualify row_number() over (partition by storm_id order by (risk_score > 0) desc, md5('42-' || storm_id || '-' || objectid), objectid) <= 9000""",
    "relevance_grades": """select storm_id, objectid, cast(case when risk_score <= 0 then 0 when risk_score <= a then 1 when risk_score <= b then 2 when risk_score <= c then 3 else 4 end as bigint) as relevance
from fx_scored cross join (select quantile_cont(risk_score, 2.5e-1) as a, quantile_cont(risk_score, 5e-1) as b, quantile_cont(risk_score, 7.5e-1) as c from fx_scored where risk_score > 0) q""",
    "storm_ranking_metrics": "select storm_id, rows, " + ", ".join(f"round({c}, 6) as {c}" for c in ["ndcg_50", "ndcg_200", "ndcg_500", "recall_200", "recall_500", "spearman"]) + " from ora_storm_metrics",
    "ranking_metrics": "select " + ", ".join(f"round(avg({c}), 6) as mean_{c}" for c in ["ndcg_50", "ndcg_200", "ndcg_500", "recall_200", "recall_500", "spearman"]) + ", count(*) as n_storms from ora_storm_metrics",
    "regression_metrics": """select round(sqrt(avg((y - p) * (y - p))), 6) as rmse, round(avg(abs(y - p)), 6) as mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) as r2,
  round(corr(ry, rp), 6) as spearman_corr, round(count(*) filter (where y >= 5e-1 and p >= 5e-1) / cast(count(*) filter (where p >= 5e-1) as double), 4) as precision_at_05,
  round(count(*) filter (where y >= 5e-1 and p >= 5e-1) / cast(count(*) filter (where y >= 5e-1) as double), 4) as recall_at_05, count(*) as n_samples
from (select *, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0e0 as ry, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0e0 as rp
  from (select risk_score as y, greatest(0, least(1, prediction)) as p from fx_scored) a) b""",
    "average_precision": """select (select round(sum(pos / tot * cp / cn), 6) from (
    select pos, sum(pos) over () as tot, sum(pos) over (order by p desc) as cp, sum(n) over (order by p desc) as cn
    from (select prediction as p, count(*)::double as n, sum(label_any_incident)::double as pos from fx_scored group by 1) l) r) as pr_auc,
  (select cast(sum(label_any_incident) as bigint) from fx_scored) as n_positive, """ + ", ".join(
        f"round((select sum(label_any_incident) from (select * from fx_scored order by prediction desc, storm_id, objectid limit {k}) t)::double / (select sum(label_any_incident) from fx_scored), 6) as recall_at_{k}"
        for k in (200, 500)),
    "score_statistics": "select round(quantile_cont(prediction, 5e-1), 6) as p50, round(quantile_cont(prediction, 7.5e-1), 6) as p75, round(quantile_cont(prediction, 9.9e-1), 6) as p99, round(avg(prediction), 6) as mean, round(stddev_pop(prediction), 6) as std from fx_scored",
    "group_sizes": "select storm_id, count(*) as rows from fx_scored group by storm_id",
    "importance_share": "select p_brand as feature, sum(p_size)::double as importance, round(sum(p_size)::double / (select sum(p_size) from part) * 100, 2) as importance_pct from part group by p_brand",
    "rejected_scenarios": f"select scenario_id from fx_scenarios where not ({SCENARIO_GOOD})",
    "scenario_days": "select * from ora_scenario_days",
    "scenario_severity": "select scenario_id, day_offset, round(severity, 6) as severity from ora_severity",
    "lingering_snow": """select scenario_id, case when live then round(snowfall_cm + rest, 2) else snowfall_cm end as total_snowfall_cm,
  case when live then round(greatest(snowfall_cm, rest), 2) else snowfall_cm end as max_daily_snowfall_cm,
  cast(case when live then greatest(duration_days, ceil(h / 24) + 1) else duration_days end as bigint) as duration_days,
  case when live then round(snowfall_cm + rest, 2) else snowfall_cm end as precip_total_mm, round(k, 4) as thermal_rate, round(greatest(1e-1, 1 - 1e-2 * h), 4) as plow_factor
from (select *, recent > 0 as live, recent * exp(-k * h) * greatest(1e-1, 1 - 1e-2 * h) as rest from (
  select *, max_wind_kmh / 3 - 5 as recent, max_wind_kmh as h, greatest(5e-3, 2e-2 + 1.3e-2 * greatest(case when snowfall_cm > 20 then min_temp_c + 8 else min_temp_c end, 0)) as k from fx_scenarios) a) b""",
    "calibrated_scores": "select * from ora_calibrated",
    "risk_distribution": "select day_offset, risk_category, count(*) as n, round(count(*) / sum(count(*)) over (partition by day_offset) * 100, 4) as share from ora_calibrated group by day_offset, risk_category",
    "highest_risk_by_day": "select day_offset, objectid, risk_score from fx_predictions qualify row_number() over (partition by day_offset order by risk_score desc, objectid) <= 10",
    "highest_risk": "select objectid, risk_score from fx_predictions where day_offset = 0 order by risk_score desc, objectid limit 10",
    "forecast_summary": f"""select forecast_id, has_snow, snow as total_snowfall_cm, snow as max_daily_snowfall_cm, min_temp_c, max_wind_kmh, cast(1 as bigint) as duration_days, snow as precip_total_mm from (
  select forecast_id, has_snow, round(greatest(case when has_snow then 5.0e0 else 5e-1 end, coalesce(named, 0)), 1) as snow, round(cold, 1) as min_temp_c, round(coalesce(wind, 20), 1) as max_wind_kmh from (
    select forecast_id, min(case when temperature_unit = 'F' then (temperature - 32) * 5 / 9 else temperature end) as cold, max({MPH} * 1.60934e0) as wind,
      bool_or(regexp_matches(lower(case when detailed_forecast <> '' then detailed_forecast else short_forecast end), 'snow|blizzard|winter storm|ice')) as has_snow,
      max(list_max(list_transform(list_zip(regexp_extract_all(lower(detailed_forecast), {INCH}, 1), regexp_extract_all(lower(detailed_forecast), {INCH}, 2)),
        lambda x: coalesce(try_cast(x[2] as double), try_cast(x[1] as double)))) * 2.54e0) as named
    from ora_leading where no <= 6 group by forecast_id) a) b""",
    "hourly_scenario": f"""select a.forecast_id, greatest(b.snow, 2.0e0) as snowfall_cm, round((cold - 32) * 5 / 9, 1) as min_temp_c, round(coalesce(wind, 0), 1) as max_wind_kmh, greatest(snow_days, 1) as duration_days
from (select forecast_id, min(temperature) as cold, bool_or(s) as has_snow, count(*) filter (where s and is_daytime) as snow_days
  from (select *, regexp_matches(lower(short_forecast), 'snow|blizzard|winter storm|ice|sleet|freezing') as s from ora_leading where no <= 14) p group by forecast_id) a
join (select forecast_id, sum(case when regexp_matches(lower(short_forecast), 'snow|blizzard|winter storm|ice|sleet|freezing') and precip_chance > 30
    then case when precip_chance > 70 then 2.0e0 when precip_chance > 50 then 1.0e0 else 5e-1 end else 0 end) as snow, max({MPH} * 1.60934e0) as wind from fx_forecast group by forecast_id) b using (forecast_id)
where has_snow""",
    "day_night_pairs": """select forecast_id, group_no, d as day_period, coalesce(n, -1) as night_period from ora_pairing where group_no <= 7 and d is not null""",
    "precipitation_bands": """select period_no, case when precip_chance < 10 then 'minimal' when precip_chance < 20 then 'slight'
  when w and precip_chance >= 80 then 'wintry_extreme' when w and precip_chance >= 60 then 'wintry_high' when w and precip_chance >= 40 then 'wintry_medium' when w then 'wintry_low'
  when precip_chance >= 70 then 'high' when precip_chance >= 50 then 'medium' when precip_chance >= 30 then 'fair' else 'low' end as band
from (select *, regexp_matches(lower(short_forecast), 'snow|ice|sleet|freezing|blizzard') as w from fx_forecast) f""",
    "conditions_bbox": "select * from ora_conditions",
    "segment_conditions": f"""select l.objectid % 7 as day_offset, l.objectid, nullif(l.streetname, '') as name, {TIER} as highway, cast(round((1 - coalesce(p.risk_score, 0)) * 100) as bigint) as score,
  {label("coalesce(p.risk_category, 'very_low')")} as label, cast(round(l.length_m) as bigint) as length_m, coalesce(p.risk_score, 0) as closure_probability,
  coalesce(p.risk_category, 'very_low') as risk_category from fx_lines l left join ora_predictions p on p.objectid = l.objectid and p.day_offset = l.objectid % 7""",
    "status_counts": """select *, case when (high_risk + closed) / total::double > 1.5e-1 then 'High Risk' when (high_risk + closed) / total::double > 5e-2 or moderate_risk / total::double > 2e-1 then 'Moderate Risk'
  when moderate_risk / total::double > 5e-2 then 'Low Risk' else 'Roads Clear' end as verdict from (select box_id, """ + ", ".join(
        f"count(*) filter (where label = '{x}') as {x}" for x in ["open", "low_risk", "moderate_risk", "high_risk", "closed"]) + ", count(*) as total from ora_conditions group by box_id) c",
    "segments_near": f"""select r.route_id as point_id, v.objectid, round(min({hav('r.from_lat', 'r.from_lng', 'v.lat', 'v.lng')}), 3) as distance_m
from fx_requests r join ora_vertices v on {hav('r.from_lat', 'r.from_lng', 'v.lat', 'v.lng')} <= 75 group by all""",
    "route_thinning": "select route_id, n, lng, lat from ora_sampled",
    "route_segments": f"""select m.route_id, m.day_offset, m.first_place, m.objectid, l.streetname as name, coalesce(p.risk_score, 0) as risk_score, coalesce(p.risk_category, 'very_low') as risk_category,
  {label("coalesce(p.risk_category, 'very_low')")} as label from ora_matched m join fx_lines l using (objectid) left join ora_predictions p using (day_offset, objectid)""",
    "route_risk": f"""select route_id, day_offset, round(a, 3) as average_risk, round(x, 3) as max_risk, {category('a')} as risk_category, matched_segments from (
  select m.route_id, m.day_offset, avg(coalesce(p.risk_score, 0)) as a, max(coalesce(p.risk_score, 0)) as x, count(*) as matched_segments
  from ora_matched m left join ora_predictions p using (day_offset, objectid) group by all) r""",
    "route_risk_by_day": f"""select route_id, day_offset, round(a, 3) as average_risk, {category('a')} as risk_category from (
  select m.route_id, p.day_offset, avg(p.risk_score) as a from ora_matched m join ora_predictions p on p.objectid = m.objectid group by all) r""",
    "prediction_status": "select day_offset, count(*) as predictions from fx_predictions group by day_offset",
    "stored_predictions": "select day_offset, objectid, case when day_offset = 2 then 0 else risk_score end as risk_score, case when day_offset = 2 then 'very_low' else risk_category end as risk_category from ora_predictions",
    "road_layer": f"select * from (select objectid, {TIER} as highway, length_m from fx_lines) r where highway in ('motorway', 'trunk', 'primary', 'secondary', 'tertiary') or length_m >= 80",
    "line_measures": f"""select objectid, round({hav('lat1', 'lng1', 'lat2', 'lng2')} + {hav('lat2', 'lng2', 'lat3', 'lng3')} + {hav('lat3', 'lng3', 'lat4', 'lng4')}, 3) as length,
  least(lng1, lng2, lng3, lng4) as min_lng, least(lat1, lat2, lat3, lat4) as min_lat, greatest(lng1, lng2, lng3, lng4) as max_lng, greatest(lat1, lat2, lat3, lat4) as max_lat,
  lat3 as mid_lat, round((lng1 + lng2 + lng3 + lng4) / 4, 6) as mean_lng from fx_lines""",
    "graph_edges": "select src, dst, segment_id, round(length_m, 3) as length_m from ora_edges",
    "stitched_edges": "select a as src, b as dst, round(length_m, 3) as length_m from ora_stitch union all select b, a, round(length_m, 3) from ora_stitch",
    "road_components": "select n.node as component, count(*) as nodes from ora_component c join ora_numbered n on n.no = c.label group by n.node",
    "safest_routes": f"""select route_id, day_offset, cast(round(l) as bigint) as distance_m, cast(round(l / (3.0e4 / 3600)) as bigint) as duration_sec, round(a, 3) as average_risk, round(x, 3) as max_risk,
  {category('a')} as risk_category, matched_segments from (
  select route_id, day_offset, sum(length_m) as l, avg(risk) as a, max(risk) as x, count(distinct segment_id) as matched_segments from ora_hops group by all) r""",
    "safest_route_steps": f"""select route_id, cast(step as bigint) as step, case when nxt is null then 'Continue on' when (nxt - bearing + 360) % 360 >= 30 and (nxt - bearing + 360) % 360 < 150 then 'Turn right onto'
    when (nxt - bearing + 360) % 360 >= 210 and (nxt - bearing + 360) % 360 < 330 then 'Turn left onto' else 'Continue on' end || ' ' || case when street = '' then 'road' else street end as instruction,
  street as streetname, cast(round(l) as bigint) as distance_m, round(risk, 3) as risk_score, {category('risk')} as risk_category from (
  select route_id, step, sum(length_m) as l, avg(risk) as risk, arg_min(now, hop) as street, arg_max(bearing, hop) as bearing, arg_max(coalesce(nxt, -1), hop) as n0, nullif(arg_max(coalesce(nxt, -1), hop), -1) as nxt
  from ora_stepped group by route_id, step) s where l > 0""",
    "safest_route_geometry": """select route_id, cast(sum(case when segment_id < 0 then 1 else 3 end) + 1 as bigint) as points, arg_min(slng, hop) as first_lng, arg_max(dlat, hop) as last_lat
from ora_hops group by route_id""",
    "alert_events": """select 'nws-' || id as source_event_id, case when regexp_matches(lower(event || coalesce(headline, '')), 'winter|snow|ice|freez|wind chill|blizzard|frost') then 'winter_condition' else 'weather_alert' end as event_type,
  cast(case lower(severity) when 'extreme' then 5 when 'severe' then 4 when 'moderate' then 3 when 'minor' then 2 else 1 end as bigint) as severity, event, left(description, 500) as description
from fx_alerts where geometry is not null and event <> ''""",
    "winter_alerts": "select id, event from fx_alerts where regexp_matches(lower(event), 'snow|ice|winter|freeze|blizzard|frost|cold') or regexp_matches(lower(headline), 'snow|ice|winter|freeze|blizzard|frost|cold')",
    "closure_text": "select release_id, route_number, road_name, municipality, upper(left(status, 1)) || lower(substr(status, 2)) as status, from_location, to_location, 'penndot_press' as data_source from ora_closure_text",
    "location_text": """select closure_id, round(case when geometry like '[%' then try_cast(geometry as double[][])[2][1] when geometry like 'LINESTRING%' then 40.45e0
    when geometry like 'POINT%' then 40.46e0 when geometry like '40.47%' then 40.47e0 when geometry like '-79.5%' then try_cast(split_part(geometry, ',', 2) as double) end, 6) as latitude,
  round(case when geometry like '[%' then try_cast(geometry as double[][])[2][2] when geometry like 'LINESTRING%' then try_cast(regexp_extract(geometry, '(-79\\.\\d+)\\)', 1) as double)
    when geometry like 'POINT%' then try_cast(regexp_extract(geometry, '(-79\\.\\d+)', 1) as double) when geometry like '40.47%' then try_cast(split_part(geometry, ', ', 2) as double)
    when geometry like '-79.5%' then -79.5e0 end, 6) as longitude from fx_location_text""",
    "page_text": r"select page_id, length(t) as n_chars, md5(t) as digest from (select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as t from pages) p",
    "winter_crash_filter": "select crash_crn from ora_crashes",
    "snow_complaints": "select * from fx_complaint_types where request_type like '%Snow%' or request_type like '%Ice%' or request_type like '%Icy%'",
    "complaint_types": "select case when trim(request_type) = '' then '(unknown)' else request_type end as value, count(*) as n from fx_complaint_types group by 1",
    "region_filter": "select landslide_id from fx_landslides where case when latitude is null then region = 'BUILDING' else latitude between 40.30e0 and 40.55e0 and longitude between -80.15e0 and -79.80e0 end",
    "county_filter": "select event_id from fx_counties where lower(county) = 'allegheny'",
    "priority_routes": "select objectid, domi_class from fx_segments where domi_class in ('Principal Arterial', 'Minor Arterial', 'Collector')",
    "winter_days": "select date, snowfall_cm from ora_weather",
    "column_medians": " union all ".join(
        f"""select '{c}' as "column", quantile_cont(try_cast({c} as double), 5e-1) as median from fx_segments""" for c in ["speedlimit", "num_lanes", "roadwidth"]),
    "first_per_name": "select lower(trim(name)) as key, min(osm_id) as osm_id, arg_min(coalesce(highway_type, '#'), osm_id) as h from fx_roads where name is not null group by 1",
    "merged_passes": """select * from ora_first_pass union all
select * from (select * from ora_found f where not exists (select 1 from ora_first_pass p where p.release_id = f.release_id and p.route_number = f.route_number
    and p.road_name = f.road_name and p.status = f.status)
  qualify row_number() over (partition by release_id, route_number, road_name, status order by municipality, from_location, to_location) = 1) late""",
    "exact_percentiles": "select storm_id, round(quantile_cont(prediction, 2.5e-1), 6) as p25, round(quantile_cont(prediction, 5e-1), 6) as p50, round(quantile_cont(prediction, 7.5e-1), 6) as p75, round(quantile_cont(prediction, 9.9e-1), 6) as p99 from fx_scored group by storm_id",
    "geojson_lines": "select objectid, cast(4 as bigint) as points, streetname, coalesce(domi_class, 'Local') as domi_class, length_m, lat3 as mid_lat, lng3 as mid_lng from fx_lines where length_m <> 0",
    "geojson_midpoints": "select objectid, round((lat1 + lat2 + lat3 + lat4) / 4, 6) as mid_lat, round((lng1 + lng2 + lng3 + lng4) / 4, 6) as mid_lng from fx_lines",
    "geojson_polygons": "select slope_id, round((lat + (lat + 1e-4) + (lat + 4e-4)) / 3, 6) as lat, round((lng + (lng + 1e-4) + (lng + 2e-4)) / 3, 6) as lng, slope_area_sqm from fx_slopes",
    "plow_traces": "select event_date, case when event_date < '1997' then 'T1' else '7' end as truck_id, count(*) as n, round(sum(latitude), 4) as sum_lat, round(sum(longitude), 4) as sum_lng from fx_plow group by all",
    "service_routes": "select route_no, count(*) as n, sum(aadt) as aadt, round(sum(mid_lat), 3) as sum_lat from fx_state_routes group by all",
    "way_documents": "select objectid as osm_id, streetname as name, 'residential' as highway_type, round((lat1 + lat4) / 2, 6) as mid_lat, round((lng1 + lng4) / 2, 6) as mid_lng, cast(3 as bigint) as node_count from fx_lines where coalesce(domi_class, '') <> 'Alley'",
    "daily_arrays": "select date, snowfall_cm, temp_max_c from fx_weather",
    "prediction_features": "select p.day_offset, p.objectid, p.risk_score, p.risk_category from ora_predictions p join fx_lines l using (objectid) where p.day_offset = 0 and p.objectid <> 0",
    "feed_snapshot_stream": "select event_id, user_id, event_type, value from events",
    "feed_snapshot_compacted": "select event_id, event_type, value from events",
    "feed_latest": "select user_id as event_key, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value from events group by user_id",
    "probability_updates": """select segment_id, closure_probability, case when closure_probability < 2.5e-1 then 'open' when closure_probability < 5e-1 then 'low_risk' when closure_probability < 7.5e-1 then 'moderate_risk' else 'closed' end as label,
  round((1 - closure_probability) * 100, 4) as score from (select segment_id, arg_max(closure_probability, (updated_at, seq)) as closure_probability from fx_probabilities group by segment_id) p where closure_probability between 0 and 1""",
}
SQL["feed_latest_stream"] = SQL["feed_latest"]
SQL["alert_documents"] = SQL["alert_events"]
SQL["label_summary"] = """select count(*) as rows, count(distinct objectid) as segments, count(distinct storm_id) as storms, min(risk_score) as min_score, max(risk_score) as max_score,
  round(avg(risk_score), 6) as mean_score, round(quantile_cont(risk_score, 5e-1), 6) as median_score from ora_labels"""
SQL["segment_records"] = """select s.objectid, coalesce(s.streetname, '') as streetname, s.domi_class, s.roadwidth, '' as speedlimit, l.lat3 as mid_lat, l.lng3 as mid_lng, 'wprdc_centerlines' as data_source
from fx_segments s left join fx_lines l using (objectid)"""
SQL["traffic_events"] = """select cast(event_id as varchar) as event_id, event_type, county, '' as description, value > 5 as is_full_closure, '511pa' as data_source
from fx_feed join fx_counties using (event_id) where lower(county) = 'allegheny'"""
SQL["first_per_name"] = "select key, osm_id, nullif(h, '#') as highway_type from (" + SQL["first_per_name"] + ") f"

# Pairing walks the periods of each forecast in order: a leading night stands alone, then each period takes a following night.
HELPERS["ora_pairing"] = """/* using key (forecast_id, group_no, d, n, nxt) */
select l.forecast_id, cast(1 as bigint), l.period_no, case when l.is_daytime and not m.is_daytime then m.period_no end,
  cast(case when l.is_daytime and not m.is_daytime then 3 else 2 end as bigint)
from ora_leading l left join ora_leading m on m.forecast_id = l.forecast_id and m.no = 2 where l.no = 1
union all
select p.forecast_id, p.group_no + 1, l.period_no, case when not m.is_daytime then m.period_no end, p.nxt + case when not m.is_daytime then 2 else 1 end
from ora_pairing p join ora_leading l on l.forecast_id = p.forecast_id and l.no = p.nxt left join ora_leading m on m.forecast_id = p.forecast_id and m.no = p.nxt + 1
where p.group_no < 7"""


def oracle_sql() -> dict[str, str]:
    return {name: with_clause(sql, HELPERS) for name, sql in SQL.items()}


assert not set(HELPERS) & set(FIXTURES)
