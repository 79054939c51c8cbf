"""Fixed values of the data model: geometry, lags, kernels, weights, names."""

from __future__ import annotations

from typing import NamedTuple


class Box(NamedTuple):
    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float


# --- geometry (fixed values) -------------------------------------------------
REGION = Box(-6.0, 42.0, 9.5, 51.5)
GRID_STEP_DEG = 0.25
GRID_ROWS = 39
GRID_COLUMNS = 63
RASTER_STEP_DEG = 0.02
RASTER_ROWS = 476
RASTER_COLUMNS = 776
COORD_DECIMALS = 4
EARTH_RADIUS_KM = 6371.0088
KM_PER_LAT_DEG = 110.6
KM_PER_LON_DEG = 111.3
KERNEL_KM_PER_DEG = 111.2
COAST_LIMIT_KM = 200.0
LAND_MARGIN_KM = 30.0
SEGMENT_LENGTH_KM = 10.0
DENSIFY_KM = 2.0
LINE_MARGIN_DEG = 4.0

# --- risk model (fixed values) -----------------------------------------------
SEA_LAG_DAYS = 2
ISSUE_LAG_DAYS = 3
DRIFT_WINDOW_DAYS = 3
REACH_KM = 25.0
REACH_CUTOFF = 3.0
SNAP_RADIUS_KM = 15.0
HALF_LIFE_DAYS = 365.0
WINDOW_HALF_SLOTS = 15
WINDOW_SLOTS = 31
YEAR_SLOTS = 366
PRIOR_EVENTS = 0.5
INDEX_QUANTILES = (0.5, 0.999)
INDEX_FLOOR = 1e-9
NEGATIVES_PER_POSITIVE = 20
RIDGE = 1e-3
MAX_ITERATIONS = 50
TOLERANCE = 1e-8
SIGNALS = ("persistence", "drift_index", "swell_m", "wave_m", "onshore_m", "period_s")

# --- drift inputs (fixed values) ---------------------------------------------
DRIFT_HOURS = 480
WEIGHT_FLOOR = 1e-9
BUOYANCY_RATE = 0.31
FLOAT_HALF_LIFE_DAYS = 12.0
DEFAULT_GEAR_WEIGHT = 0.3
GEAR_WEIGHTS = {
    "trawlers": 1.0,
    "set_gillnets": 1.0,
    "fixed_gear": 0.6,
    "seiners": 0.2,
    "purse_seines": 0.2,
    "tuna_purse_seines": 0.1,
    "other_purse_seines": 0.2,
    "other_seines": 0.2,
    "trollers": 0.1,
    "set_longlines": 0.05,
    "drifting_longlines": 0.05,
    "pots_and_traps": 0.05,
    "squid_jigger": 0.05,
    "dredge_fishing": 0.05,
}
SEASON_WEIGHTS = (1.00, 1.00, 0.90, 0.50, 0.30, 0.20, 0.20, 0.20, 0.25, 0.40, 0.70, 0.95)

# --- names (fixed values) ----------------------------------------------------
GBIF = "gbif"
PELAGIS = "pelagis_histocarto"
GFW_FISHING = "gfw_fishing"
AIS_LIVE = "ais_live"
OBSERVED = "observed"
FORECAST = "forecast"
JOB_STATES = ("pending", "running", "done", "failed")
COMMUNE_UNCERTAINTY_M = 5000.0
DAY_UNCERTAINTY_HOURS = 12.0

WIND_MEASURES = ("wind_speed_kmh", "wind_direction_deg")
SEA_MEASURES = (
    "current_speed_kmh",
    "current_direction_deg",
    "wave_height_m",
    "wave_direction_deg",
    "wave_period_s",
    "swell_height_m",
    "swell_direction_deg",
    "swell_period_s",
    "sea_surface_temperature_c",
    "sea_level_m",
)
MEASURES = WIND_MEASURES + SEA_MEASURES

# Hourly payload variable -> table column, per product.
WIND_VARIABLES = {
    "windspeed_10m": "wind_speed_kmh",
    "winddirection_10m": "wind_direction_deg",
}
SEA_VARIABLES = {
    "ocean_current_velocity": "current_speed_kmh",
    "ocean_current_direction": "current_direction_deg",
    "wave_height": "wave_height_m",
    "wave_direction": "wave_direction_deg",
    "wave_period": "wave_period_s",
    "swell_wave_height": "swell_height_m",
    "swell_wave_direction": "swell_direction_deg",
    "swell_wave_period": "swell_period_s",
    "sea_surface_temperature": "sea_surface_temperature_c",
    "sea_level_height_msl": "sea_level_m",
}

# --- coverage planning (fixed values) ----------------------------------------
CHUNK_EPOCH = "2020-01-06"
ARCHIVE_CHUNK_DAYS = 14
BACKFILL_DAYS = 14
FORECAST_DAYS = 3
MAX_PRUNE_SHARE = 0.05
MIN_PRUNE_SEGMENTS = 5


class Kind(NamedTuple):
    kind: str
    first: str = "0001-01-01"
    last: str = "9999-12-31"
    lag: int = 0
    ahead: int = 0
    chunk: int = 1
    volatile: int = 0
    rolling: bool = False


KINDS = (
    Kind("gfw", first="2012-01-01", lag=4),
    Kind("weather_archive", first="1940-01-01", lag=5, chunk=14, volatile=19),
    Kind("marine_archive", first="2022-01-01", lag=5, chunk=14, volatile=19),
    Kind("forecast", volatile=1, rolling=True),
    Kind("strandings_gbif", last="2022-12-31", chunk=365),
    Kind("strandings_pelagis", first="2023-01-01", chunk=30, volatile=60),
    Kind("drift", first="2022-01-01", lag=4, volatile=20),
    Kind("risk", first="2022-01-01", ahead=3, volatile=23),
)
