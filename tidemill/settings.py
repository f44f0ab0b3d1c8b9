"""Run settings: stage switches, targets, horizons, lags."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    targets: dict[str, str] = field(default_factory=lambda: {
        "litres": "liter_results", "Ireland_Milk_Price": "prices_results"})
    target_columns: tuple[str, ...] = ("litres",)
    forecast_weeks: int = 52
    lags: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7)
    smooth_window: int = 5
    # A series shorter than the smoothing window: "error" stops the run, "null" gives nulls, "keep" the raw values.
    short_series: str = "error"
    data_creation: bool = True
    smoothing: bool = True
    shifting: bool = True
    compare_smoothers: bool = False
    multi_step: bool = False
    train_models: bool = False
    save_models: bool = True
    search_draws: int = 30
    cv_splits: int = 5
    seed: int = 42
    # Columns that smoothing leaves alone, next to the target.
    unsmoothed: tuple[str, ...] = ("Date", "Week", "litres", "num_suppliers")
    # Series longer than this are cut over several tasks; None for data on a calendar grid.
    max_rows: int | None = None

    def target_dir(self, target: str) -> str:
        return self.targets.get(target, "default_value")
