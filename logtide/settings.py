"""Default parameters. All durations are in seconds."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
DAY = 86_400
FEATURES = ("error_rate", "p99_latency_ms", "avg_latency_ms", "request_volume", "warn_rate")
RECORD_TYPE = "SERVICE_WINDOW_AGGREGATE"
UNKNOWN_SERVICE = "unknown"


@dataclass(frozen=True)
class WindowSettings:
    size: int = 60
    out_of_orderness: int = 30
    allowed_lateness: int = 30
    top_errors: int = 5
    message_chars: int = 200
    reservoir: int = 10_000

    @property
    def duration(self) -> str:
        return f"{self.size} seconds"

    @property
    def watermark(self) -> str:
        return f"{self.out_of_orderness + self.allowed_lateness} seconds"


@dataclass(frozen=True)
class BaselineSettings:
    alpha: float = 0.1
    rolling: int = 7 * DAY
    cold_start: int = DAY
    # State that has not been touched for this long is forgotten.
    expiry: int = 7 * DAY + 3_600


@dataclass(frozen=True)
class DetectionSettings:
    z_fire: float = 3.0
    z_critical: float = 5.0
    forest_threshold: float = -0.15
    min_samples: int = 100
    retrain: int = 7 * DAY
    training_window: int = 7 * DAY
    trees: int = 100
    tree_rows: int = 256
    contamination: float = 0.05
    seed: int = 42


@dataclass(frozen=True)
class SuppressionSettings:
    cooldown: int = 600
    storm_window: int = 60
    storm_threshold: int = 5
    storm_cooldown: int = 300

    @property
    def memory(self) -> int:
        """After this long without alerts no state is left."""
        return max(self.cooldown, self.storm_window, self.storm_cooldown)


@dataclass(frozen=True)
class LimiterSettings:
    limit: int = 10
    window: int = 3_600
    # False: the window is [t - w, t]; True: (t - w, t].
    left_open: bool = False


ALERT_LIMITER = LimiterSettings()
REQUEST_LIMITER = LimiterSettings(limit=100, window=60, left_open=True)
