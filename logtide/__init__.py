"""Operational log analytics on Spark DataFrames and Structured Streaming."""

from logtide.session import build_session, scratch_dir
from logtide.settings import (
    BaselineSettings,
    DetectionSettings,
    LimiterSettings,
    SuppressionSettings,
    WindowSettings,
)

__all__ = [
    "BaselineSettings",
    "DetectionSettings",
    "LimiterSettings",
    "SuppressionSettings",
    "WindowSettings",
    "build_session",
    "scratch_dir",
]
