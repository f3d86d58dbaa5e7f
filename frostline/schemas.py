"""Column types of the source tables, and header variants of the feeds."""

SEGMENTS = ("objectid bigint, streetname string, domi_class string, paveclass string, speedlimit string, "
            "num_lanes string, roadwidth string, oneway string, owner string, shape_length string, mid_lat double, "
            "mid_lng double, data_source string")
ROADS = ("osm_id bigint, name string, highway_type string, surface string, lanes string, maxspeed string, "
         "oneway string, bridge string, tunnel string, lit string, sidewalk string, cycleway string, width string, "
         "access string, ref string, incline string, mid_lat double, mid_lng double, node_count int, "
         "data_source string")
ELEVATION = "objectid bigint, mid_lat double, mid_lng double, elevation_m double, data_source string"
SLOPES = ("objectid bigint, mid_lat double, mid_lng double, near_steep_slope boolean, slope_area_sqm double, "
          "data_source string")
BRIDGES = ("bridge_id string, name string, neighborhood string, latitude double, longitude double, year_built int, "
           "data_source string")
LANDSLIDES = "landslide_id string, latitude double, longitude double, source_study string, data_source string"
WEATHER = ("date date, snowfall_cm double, temp_max_c double, temp_min_c double, wind_max_kmh double, "
           "precip_mm double, rain_mm double, weather_code int, data_source string")
CRASHES = ("crash_crn string, crash_year int, crash_month int, weather_code string, road_condition_code string, "
           "icy_road string, snow_slush_road string, latitude double, longitude double, street_name string, "
           "speed_limit string, lane_count string, fatal_count int, injury_count int, data_source string")
COMPLAINTS = ("group_id string, request_type string, created_date timestamp, street string, neighborhood string, "
              "latitude double, longitude double, data_source string")
PLOW = ("event_date string, truck_id string, latitude double, longitude double, timestamp string, "
        "data_source string")
CLOSURES = ("closure_id string, permit_type string, work_type string, from_date timestamp, to_date timestamp, "
            "active string, primary_street string, from_street string, to_street string, full_closure string, "
            "travel_lane string, parking_lane string, sidewalk string, latitude double, longitude double, "
            "data_source string")
STATE_ROUTES = ("route_no string, street_name string, lane_count string, aadt double, pavement_condition double, "
                "roughness_index double, mid_lat double, mid_lng double, data_source string")
ROAD_CONDITIONS = ("condition_type string, route string, segment_desc string, county string, latitude double, "
                   "longitude double, last_updated string, data_source string")
TRAFFIC_EVENTS = ("event_id string, event_type string, roadway string, direction string, county string, "
                  "description string, location_description string, is_full_closure boolean, start_time string, "
                  "end_time string, last_updated string, fetched_at timestamp, data_source string")
PRESS_CLOSURES = ("date string, title string, url string, route_number string, road_name string, "
                  "municipality string, status string, from_location string, to_location string, data_source string")
PREDICTIONS = "day_offset bigint, objectid bigint, risk_score double, risk_category string"

# Header variants of each feed, first filled one wins.
COMPLAINT_ALIASES = {
    "group_id": ["group_id", "_id"], "request_type": ["request_type_name", "request_type"],
    "created_date": ["create_date_et", "created_on"], "street": ["street", "address"],
    "neighborhood": ["neighborhood"], "latitude": ["latitude"], "longitude": ["longitude"],
}
CRASH_ALIASES = {
    "crash_crn": ["crn", "crash_crn"], "crash_year": ["crash_year", "year"], "crash_month": ["crash_month", "month"],
    "weather_code": ["weather", "weather_code"], "road_condition_code": ["road_condition", "rdwy_surf_type_cd"],
    "icy_road": ["icy_road"], "snow_slush_road": ["snow_slush_road"], "latitude": ["dec_lat", "latitude"],
    "longitude": ["dec_long", "longitude"], "street_name": ["street_name", "rdwy_seq_descr"],
    "speed_limit": ["speed_limit"], "lane_count": ["lane_count", "rdwy_orient_type_cd"],
    "fatal_count": ["fatal_count", "fatal"], "injury_count": ["injury_count", "inj_count", "injury"],
}
CLOSURE_ALIASES = {
    "closure_id": ["id", "closure_id", "_id"], "permit_type": ["permit_type", "permittype"],
    "work_type": ["work_type", "worktype"], "from_date": ["from_date", "fromdate", "start_date"],
    "to_date": ["to_date", "todate", "end_date"], "active": ["active", "is_active"],
    "primary_street": ["primary_street", "primarystreet", "street"], "from_street": ["from_street", "fromstreet"],
    "to_street": ["to_street", "tostreet"], "full_closure": ["full_closure", "fullclosure"],
    "travel_lane": ["travel_lane", "travellane"], "parking_lane": ["parking_lane", "parkinglane"],
    "sidewalk": ["sidewalk"], "latitude": ["latitude"], "longitude": ["longitude"],
    "geometry": ["geometry", "geom", "the_geom"],
}
BRIDGE_ALIASES = {
    "bridge_id": ["id", "_id", "objectid"], "name": ["bridge_name", "name", "structure"],
    "neighborhood": ["neighborhood", "hood"], "latitude": ["latitude", "lat"], "longitude": ["longitude", "lng", "lon"],
    "year_built": ["year_built", "yearbuilt"],
}
SEGMENT_ALIASES = {
    "objectid": ["objectid", "fid"], "streetname": ["st_name", "streetname"], "domi_class": ["domi_class"],
    "paveclass": ["paveclass"], "speedlimit": ["speedlimit"], "num_lanes": ["num_lanes"], "roadwidth": ["roadwidth"],
    "oneway": ["oneway"], "owner": ["owner"], "shape_length": ["shape_leng", "shape_length"],
}
LANDSLIDE_ALIASES = {
    "landslide_id": ["ev_id", "objectid", "id", "_id"], "latitude": ["latitude", "lat", "y"],
    "longitude": ["longitude", "lng", "lon", "x"], "source_study": ["ls_cat", "source_study"],
    "region": ["div_name", "state_province"], "geometry": ["geom", "geometry", "the_geom", "shape"],
}
