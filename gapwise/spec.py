"""Column roles, thresholds and other settings of a sensor panel.

Everything here is a default: every function that uses one of these values
takes it as an argument.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Column names of the air-quality panel.
POLLUTANTS = (
    "pm2_5", "pm10", "no", "no2", "nox", "nh3", "co",
    "so2", "o3", "benzene", "toluene", "xylene", "aqi",
)
LAGGED_POLLUTANTS = ("pm2_5", "pm10", "no2", "no", "nox", "so2", "co", "o3", "nh3")
SNAPSHOT_ID_COLUMNS = (
    "country", "state", "city", "station", "timestamp", "latitude", "longitude",
)
META_COLUMNS = ("station_name", "city", "state", "status")
NON_FEATURE_COLUMNS = META_COLUMNS + ("aqi_bucket", "negative_value_flag")
FILLED_SUFFIX = "_was_filled"

# Feature windows, in rows.
LAGS = (1, 3, 6, 12, 24)
ROLLING_WINDOWS = (3, 6, 12, 24)
FILL_LIMIT = 2

# Selection gates.
MIN_COVERAGE = 0.60
MIN_SPAN_DAYS = 365
MIN_RECORDS = 5000
MAX_MISSING_PCT = 15.0
MIN_CONTINUITY_PCT = 85.0
SUBSET_SIZE = 10

# Calendar split, half-open.
TRAIN_END = "2019-01-01"
VALID_END = "2019-09-01"

# Snapshot text format and bounding box.
SNAPSHOT_TIME_FORMAT = "dd-MM-yyyy HH:mm:ss"
LATITUDE_RANGE = (6.0, 38.0)
LONGITUDE_RANGE = (68.0, 98.0)

# Upper bounds (inclusive) of the PM2.5 categories.
AQI_CATEGORIES = (
    (30.0, "Good"),
    (60.0, "Satisfactory"),
    (90.0, "Moderate"),
    (120.0, "Poor"),
    (250.0, "Very Poor"),
)
AQI_TOP_CATEGORY = "Severe"
AQI_NO_VALUE = "Unknown"
HIGH_POLLUTION = 91.0

# Scoring and sampling.
MIN_HISTORY_ROWS = 30
TREND_ROWS = 168
SEED = 42
ATTRIBUTION_SAMPLE_ROWS = 3000
HISTOGRAM_BINS = 80
TOP_FEATURES = 5
GLOBAL_TOP_FEATURES = 20


@dataclass(frozen=True)
class PanelSpec:
    """What the columns of a panel mean.

    A panel has at most one row per (``entity``, ``time``); ``step_seconds`` is
    the nominal spacing of an entity's rows and ``horizon`` how many steps ahead
    the target lies.
    """

    entity: str = "station_id"
    time: str = "datetime"
    values: tuple[str, ...] = POLLUTANTS
    lagged: tuple[str, ...] = LAGGED_POLLUTANTS
    target_of: str = "pm2_5"
    step_seconds: int = 3600
    horizon: int = 6
    lags: tuple[int, ...] = LAGS
    windows: tuple[int, ...] = ROLLING_WINDOWS
    fill_limit: int = FILL_LIMIT
    target: str = "target_pm25_6h"
    target_valid: str = "target_horizon_valid"
    non_features: tuple[str, ...] = field(default=NON_FEATURE_COLUMNS)

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.time]

    @property
    def feature_history(self) -> int:
        """Earlier rows a feature row looks at, not counting fills."""
        return max((*self.lags, *self.windows))

    def present(self, columns, wanted=None) -> list[str]:
        """The wanted columns that exist, in the wanted order."""
        have = set(columns)
        return [c for c in (self.values if wanted is None else wanted) if c in have]
