"""Job parameters. Every choice an analyst could be asked for is a field here."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ValidationConfig:
    dataset_type: str | None = None              # cross_sectional, time_series, panel; None: detect
    row_id: str | None = None                    # unique column; None: numbered at read time
    date_column: str | None = None
    date_formats: list[str] = field(default_factory=list)
    entity_column: str | None = None
    value_columns: list[str] = field(default_factory=list)   # default: all numeric columns
    y_column: str | None = None                  # default: first numeric column
    x_columns: list[str] = field(default_factory=list)       # default: the other numeric columns
    frequency: str | None = None                 # expected frequency of the dates
    panel_frequency: str | None = None
    seasonal_period: int | None = None
    missing_dates_action: str = "ignore"         # ignore, forward_fill, interpolate, drop
    outlier_method: str = "iqr"
    outlier_k: float | None = None
    duplicate_threshold: float = 0.95
