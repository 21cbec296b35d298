"""Site registry, column maps and feature lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fill codes that mean "no reading".
SENTINELS = (32767.0, 32766.0, -99.0)

TARGET = "target"
RESAMPLE_RULE = "15 minutes"
NIGHT_IRRADIANCE = 5.0
TRAIN_FRACTION = 0.70
VALIDATION_FRACTION = 0.15
LOOKBACK = 16
SEED = 42

# Standard name -> raw sensor column, one map per site layout.
SITE_A_COLUMNS = {
    "irr_horiz": "FHZIRR",
    "irr_plane": "FPAIRR",
    "amb_temp": "FPVDBT",
    "rh": "FPV_RH",
    "wind_speed": "FWINDA",
    "wind_max": "FWINDM",
    "pressure": "FRAIRP",
    "rain": "FPRECT",
    "target": "INVPWR",
    "mppt1": "MPPT1P",
    "mppt2": "MPPT2P",
    "voltage": "GRIDVT",
}
SITE_B_COLUMNS = {
    "irr_horiz": "FPHIRR",
    "amb_temp": "FAMBTM",
    "rh": "FPV_RH",
    "wind_speed": "FWINDS",
    "wind_max": "FWINDM",
    "pressure": "FVPRES",
    "target": "INVPWR",
}

# Standard name -> (title, description, unit) of the dataset dictionary.
DICTIONARY = {
    "irr_horiz": ("Solar Irradiance", "Sunlight on the level ground", "W/m²"),
    "amb_temp": ("Ambient Temperature", "Air temperature in the shade", "°C"),
    "rh": ("Relative Humidity", "Water vapour relative to saturation", "%"),
    "wind_speed": ("Wind Speed", "Mean wind speed", "m/s"),
    "pressure": ("Atmospheric Pressure", "Station air pressure", "hPa"),
    "target": ("PV Power Output (Target)", "Power the inverter feeds in", "W"),
}

# Alternatives tried, in order, when the irradiance column is absent.
IRRADIANCE_FALLBACKS = ("irr_plane", "FHZIRR", "FPHIRR")

SENSORS = ["irr_horiz", "amb_temp", "rh", "wind_speed", "pressure"]
CYCLIC = ["hour_sin", "hour_cos", "doy_sin", "doy_cos"]

# The feature lists of the three ways the series is prepared.
FEATURES_13 = SENSORS + CYCLIC + ["target_lag1", "target_lag4", "clearness_index", "month"]
FEATURES_18 = (
    SENSORS
    + CYCLIC
    + ["month", "clearness_index"]
    + ["irr_horiz_lag1", "irr_horiz_lag4", "irr_horiz_lag8", "target_lag1", "target_lag4"]
    + ["irr_horiz_roll4_mean", "irr_horiz_roll4_std"]
)
FEATURES_20 = FEATURES_18 + ["irr_horiz_roll8_mean", "irr_horiz_roll8_std"]

KEY_COLUMNS = ("site", "ts", "row_id", "idx", "split")


@dataclass(frozen=True)
class Site:
    """One plant: its label, raw column map and latitude in degrees."""

    name: str
    columns: dict[str, str]
    latitude: float | None = None

    def raw_schema(self) -> T.StructType:
        """CSV layout of the site: unnamed row index, day, hour, then the sensors."""
        fields = [
            T.StructField("_c0", T.LongType()),
            T.StructField("DAY", T.IntegerType()),
            T.StructField("HOUR", T.StringType()),
        ]
        fields += [T.StructField(raw, T.DoubleType()) for raw in self.columns.values()]
        return T.StructType(fields)


_SITES: dict[str, Site] = {}


def register_site(site: Site) -> Site:
    _SITES[site.name] = site
    return site


def get_site(name: str) -> Site:
    if name not in _SITES:
        raise KeyError(f"unknown site {name!r}; registered: {sorted(_SITES)}")
    return _SITES[name]


def known_latitudes() -> dict[str, float]:
    """Latitudes of the registered sites that have one."""
    return {s.name: s.latitude for s in _SITES.values() if s.latitude is not None}


def column_map(name: str) -> dict[str, str]:
    """Standard name -> raw column of a registered site."""
    return dict(get_site(name).columns)


register_site(Site("site_a", SITE_A_COLUMNS))
register_site(Site("site_b", SITE_B_COLUMNS))
