"""Column selection, renaming and schema completion."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed column lists per forecast model.
_COMMON = ["valid_time", "time", "latitude", "longitude", "t2m", "sh2", "d2m", "r2", "u10", "v10", "tp"]
KEEP_COLUMNS = {
    "HRRR": [*_COMMON, "mslma", "orog", "tcc", "asnow", "cape", "dswrf", "dlwrf", "gh"],
    **dict.fromkeys(("GFS", "NAM"), [*_COMMON, "prmsl", "orog", "tcc", "cape", "cin", "dswrf", "dlwrf", "gh"]),
}
FORECAST_BOOKKEEPING = ["index", "lead time", "lead_time", "lsm", "latitude", "longitude", "time", "orog"]
UNUSED_OBSERVATIONS = ["ta9m", "td", "relh", "srad", "pres", "mslp", "wspd_sonic_mean", "wspd_sonic", "wmax_sonic",
                       "wdir_sonic", "snow_depth", "precip_total"]
# Fixed name parts of features that are never normalised.
RAW_SCALE_PARTS = ("valid_time_cos", "valid_time_sin", "lat", "lon", "elev", "lulc", "slope", "images")
TARGET = "target_error"


def keep_model_columns(df: DataFrame, model: str) -> DataFrame:
    wanted = KEEP_COLUMNS[model.upper()]
    return df.select(*[c for c in wanted if c in df.columns])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def drop_matching(df: DataFrame, *patterns: str) -> DataFrame:
    """Drop columns whose name contains any of the patterns (regex)."""
    return df.drop(*[c for c in df.columns if any(re.search(p, c) for p in patterns)])


def add_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ("valid_time", "time")) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in df.columns if c not in keep})


def complete_schema(df: DataFrame, defaults: Mapping[str, float | None], types: str = "double") -> DataFrame:
    """Add missing columns and fill nulls with a per-column default, in that order."""
    out = {}
    for name, default in defaults.items():
        have = F.col(name) if name in df.columns else F.lit(None).cast(types)
        out[name] = have if default is None else F.coalesce(have, F.lit(default).cast(types))
    return df.withColumns(out)


def feature_names(columns: Sequence[str], not_features: Sequence[str] = (TARGET, "valid_time")) -> list[str]:
    return [c for c in columns if c not in not_features and "images" not in c]


def normalised_features(names: Sequence[str]) -> list[str]:
    """Features that get the per-window z-score."""
    return [n for n in names if n != TARGET and not any(part in n for part in RAW_SCALE_PARTS)]


def image_path(root: str, station: str = "station", valid_time: str = "valid_time"):
    """{root}/{year}/{station}/{station}_{year}_{MMddHH}.npy"""
    year = F.date_format(valid_time, "yyyy")
    return F.concat_ws(
        "/",
        F.lit(root),
        year,
        F.col(station),
        F.concat_ws("_", F.col(station), year, F.concat(F.date_format(valid_time, "MMddHH"), F.lit(".npy"))),
    )
