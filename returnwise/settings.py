"""Plain function arguments with defaults; nothing is read from the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class SplitWeeks:
    """Length of the calibration and holdout windows, in whole weeks."""

    calibration: int = 39
    holdout: int = 39


@dataclass(frozen=True)
class Settings:
    """Everything a run can be configured with.

    ``by_source`` overrides the split for named sources, because two sources may cover very
    different spans of time.
    """

    split: SplitWeeks = SplitWeeks()
    by_source: Mapping[str, SplitWeeks] = field(default_factory=dict)
    forward_horizon_days: int = 365
    recent_window_days: int = 91
    random_seed: int = 42


# Look-back windows (days) of the recent-rate sensitivity table.
SENSITIVITY_WINDOWS = (30, 61, 91, 100, 122, 152, 182, 273)

# Repeat counts with a bucket of their own; everything above shares one label.
FREQUENCY_BUCKETS = (0, 1, 2, 3, 4, 5, 6)
TOP_BUCKET = "7+"
