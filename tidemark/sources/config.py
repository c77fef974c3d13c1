"""Configuration and metric registry on the driver: strict keys, bounded parameters, exact and latest lookup."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The names of the metrics are the output contract, in natural order.
QUOTE = ["midpoint", "spread.absolute", "spread.relative"]
COMPLETED_BAR = ["open", "high", "low", "close", "volume", "simple_return", "true_range"]
SESSION = {
    "active_session": ["open", "high", "low", "latest_close", "range", "location", "volume", "bar_vwap_estimate", "coverage_ratio"],
    "previous_session": ["open", "high", "low", "close", "range", "simple_return", "volume", "bar_vwap_estimate", "coverage_ratio"],
    "overnight": ["open", "high", "low", "latest_close", "range"],
    "gap": ["indicative.points", "indicative.ratio", "opening.points", "opening.ratio"],
}
OPENING_RANGE = ["start_ns", "end_ns", "complete", "high", "low", "range", "distance_above_high_points", "distance_above_high_ratio", "distance_below_low_points", "distance_below_low_ratio", "coverage_ratio"]
POWER_HOUR = ["start_ns", "end_ns", "complete", "open", "high", "low", "close", "range", "simple_return", "volume", "bar_vwap_estimate", "directional_efficiency", "coverage_ratio"]
ROLLING = ["price_range", "realized_log_return_magnitude", "average_true_range", "directional_efficiency", "coverage_ratio", "expansion_ratio_recent", "range_percentile_recent", "recent_reference_count", "expansion_ratio_phase", "range_percentile_phase", "phase_reference_count"]


@dataclass(frozen=True)
class Parameter:
    name: str
    low: Decimal | None = None
    high: Decimal | None = None
    step: Decimal | None = None
    allowed: tuple = ()

    def check(self, value) -> None:
        if self.allowed and value not in self.allowed:
            raise ValueError(f"{self.name}: {value!r} is not allowed")
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise ValueError(f"{self.name}: {value!r} is out of bounds")
        if self.step and (Decimal(str(value)) - (self.low or 0)) % self.step:
            raise ValueError(f"{self.name}: {value!r} is off the grid")


@dataclass(frozen=True)
class Metric:
    metric_id: str
    version: int = 1
    unit: str = "points"
    dependencies: tuple[str, ...] = ()
    parameters: tuple[Parameter, ...] = ()

    def check(self, values: dict) -> None:
        if set(values) != {p.name for p in self.parameters}:
            raise ValueError(f"{self.metric_id}: the parameter set must be complete")
        for p in self.parameters:
            p.check(values[p.name])


@dataclass
class Registry:
    metrics: dict[tuple[str, int], Metric] = field(default_factory=dict)

    def add(self, *metrics: Metric) -> Registry:
        for m in metrics:
            if (m.metric_id, m.version) in self.metrics:
                raise ValueError(f"{m.metric_id} {m.version} is there already")
            missing = [d for d in m.dependencies if d == m.metric_id or not any(k[0] == d for k in self.metrics)]
            if missing:
                raise ValueError(f"{m.metric_id} needs {missing}")
            self.metrics[(m.metric_id, m.version)] = m
        return self

    def get(self, metric_id: str, version: int | None = None) -> Metric:
        if version is not None:
            return self.metrics[(metric_id, version)]
        return self.metrics[max(k for k in self.metrics if k[0] == metric_id)]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = sorted((m.metric_id, m.version, m.unit) for m in self.metrics.values())
        return spark.createDataFrame(rows, "metric_id string, version bigint, unit string")


def default_registry(windows: tuple[tuple[str, str], ...] = (("regular", "first5"), ("regular", "first15")), power: tuple[tuple[str, str], ...] = (("regular", "last60"),), rolling: tuple[tuple[str, str], ...] = (("fast", "60"), ("tactical", "300"), ("structural", "900"))) -> Registry:
    names = [f"quote.{m}" for m in QUOTE] + [f"completed_bar.{m}" for m in COMPLETED_BAR] + [f"{k}.{m}" for k, ms in SESSION.items() for m in ms]
    names += [f"opening_range.{p}.{w}.{m}" for p, w in windows for m in OPENING_RANGE] + [f"power_hour.{p}.{w}.{m}" for p, w in power for m in POWER_HOUR] + [f"rolling.{f}.{c}.{m}" for f, c in rolling for m in ROLLING]
    unit = lambda n: "ratio" if n.endswith(("ratio", "relative", "return", "location", "efficiency")) else "ns" if n.endswith("_ns") else "points"
    return Registry().add(*(Metric(n, 1, unit(n)) for n in names))


@dataclass(frozen=True)
class Settings:
    """Defaults of the library; a TOML file may override them, unknown keys fail."""

    quote_max_age_seconds: float = 2.0
    value_area_share: float = 0.7
    lookback_bars: int = 500
    gaps_kept: int = 10
    minimum_coverage: float = 0.8
    rolling_minimum_coverage: float = 0.9
    recent_references: int = 20
    recent_minimum: int = 8
    phase_sessions: int = 10
    phase_minimum: int = 5
    recency_decay: float = 0.95
    gap_request_limit: int = 1000

    @classmethod
    def load(cls, path: str) -> Settings:
        data = tomllib.loads(Path(path).read_text())
        unknown = set(data) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**data)
