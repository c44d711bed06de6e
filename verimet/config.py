"""Run configuration as frozen dataclasses; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from verimet.functions.geo import Box

MODEL_KINDS = ("lstm", "bnn", "hybrid")


@dataclass(frozen=True)
class DataConfig:
    forecast_hours: tuple[int, ...] = tuple(range(1, 19))
    metvars: tuple[str, ...] = ("t2m", "u_total", "tp")
    nwp_model: str = "HRRR"
    observation_source: str = "asos"
    local_observation_dir: str | None = None

    def __post_init__(self) -> None:
        if self.observation_source not in ("asos", "local"):
            raise ValueError("observation_source must be 'asos' or 'local'")
        if self.observation_source == "local" and not self.local_observation_dir:
            raise ValueError("local_observation_dir must be set for local observations")
        if not self.forecast_hours:
            raise ValueError("forecast_hours must not be empty")
        if not self.metvars:
            raise ValueError("metvars must not be empty")


@dataclass(frozen=True)
class SplitConfig:
    """Chronological train / validation / test split."""

    start: date
    end: date
    train: float = 0.7
    val: float = 0.15
    test: float = 0.15

    def __post_init__(self) -> None:
        if abs(round(self.train + self.val + self.test, 6) - 1.0) > 1e-5:
            raise ValueError("train, val and test must add up to 1")
        if self.start >= self.end:
            raise ValueError("start must be before end")

    @property
    def train_end(self) -> date:
        return self.start + timedelta(days=int((self.end - self.start).days * self.train))

    @property
    def val_end(self) -> date:
        return self.train_end + timedelta(days=int((self.end - self.start).days * self.val))

    @property
    def test_end(self) -> date:
        return self.end

    def label(self, ts: Column) -> Column:
        """'train' / 'val' / 'test' for a timestamp; null outside the range."""
        day = F.to_date(ts)
        return (
            F.when(day < F.lit(self.start), None)
            .when(day < F.lit(self.train_end), "train")
            .when(day < F.lit(self.val_end), "val")
            .when(day <= F.lit(self.end), "test")
        )


@dataclass(frozen=True)
class RunConfig:
    box: Box
    split: SplitConfig
    data: DataConfig = field(default_factory=DataConfig)
    model: str = "lstm"
    past: int = 30

    def __post_init__(self) -> None:
        if self.model not in MODEL_KINDS:
            raise ValueError(f"model must be one of {MODEL_KINDS}, not {self.model!r}")


def load_config(path: str) -> RunConfig:
    """Read a YAML (when PyYAML is there) or JSON file with the same keys."""
    import json

    with open(path) as handle:
        text = handle.read()
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    box, training, data = raw["bbox"], raw["training"], raw.get("data", {})

    def day(v) -> date:
        return v if isinstance(v, date) else date.fromisoformat(str(v))

    return RunConfig(
        box=Box(box["lat_min"], box["lat_max"], box["lon_min"], box["lon_max"]),
        split=SplitConfig(
            day(training["start_date"]), day(training["end_date"]),
            training.get("train_frac", 0.7), training.get("val_frac", 0.15), training.get("test_frac", 0.15),
        ),
        data=DataConfig(
            tuple(data.get("forecast_hours", DataConfig.forecast_hours)),
            tuple(data.get("metvars", DataConfig.metvars)),
            observation_source=data.get("mesonet_source", "asos"),
            local_observation_dir=data.get("mesonet_local_dir"),
        ),
        model=raw.get("model", "lstm"),
        past=training.get("sequence_length", 30),
    )
