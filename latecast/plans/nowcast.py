"""Line list in, nowcast out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.functions import strata
from latecast.operators import draws, model, summary, triangle, weekly
from latecast.operators.model import ModelSpec
from latecast.operators.weekly import WeekRule


@dataclass
class NowcastResult:
    """Lazy tables of one run; each is computed when used."""

    triangle: DataFrame
    spec: ModelSpec
    series_cols: tuple[str, ...]
    by_age: bool
    bins: str | Sequence[float] | None = None
    blank_zero_strata: bool = False

    @property
    def fitted(self) -> DataFrame:
        return model.fit_delay_model(self.triangle, self.spec, series_cols=self.series_cols)

    @property
    def trajectories(self) -> DataFrame:
        drawn = draws.trajectories(
            self.fitted, self.spec, series_cols=self.series_cols, by_age=self.by_age
        )
        if self.by_age and self.blank_zero_strata:
            zero = triangle.zero_case_strata(self.triangle, series_cols=self.series_cols)
            drawn = draws.blank_zero_strata(drawn, zero, series_cols=self.series_cols)
        return self._labelled(drawn)

    def _labelled(self, df: DataFrame) -> DataFrame:
        """The name of each age class beside its number, when the classes' limits are known."""
        if not self.by_age or self.bins is None:
            return df
        return df.withColumn("age_label", strata.age_label(F.col("age_class"), self.bins))

    @property
    def total(self) -> DataFrame:
        if not self.by_age:
            return summary.weekly_summary(self.trajectories, series_cols=self.series_cols)
        return summary.total_summary(self.trajectories, series_cols=self.series_cols)

    @property
    def age(self) -> DataFrame | None:
        if not self.by_age:
            return None
        return self._labelled(summary.weekly_summary(
            self.trajectories, series_cols=self.series_cols, by=["age_class"]
        ))

    @property
    def data(self) -> DataFrame:
        return self.triangle

    @property
    def output(self) -> DataFrame:
        return model.fit_table(self.triangle, self.spec, series_cols=self.series_cols)


def nowcast(
    df: DataFrame,
    date_onset: str,
    date_report: str,
    age_col: str | None = None,
    *,
    bins: str | Sequence[float] | None = "SI-PNI",
    series_cols: Sequence[str] = (),
    d_max: int = triangle.D_MAX,
    window: int = triangle.WINDOW,
    trim: int = 0,
    horizon: int = 0,
    use_epiweek: bool = False,
    keep_complete_week: bool = False,
    blank_zero_strata: bool = False,
    prune: bool = False,
    draws: int = 1000,
    seed: int = 1,
    spec: ModelSpec | None = None,
) -> NowcastResult:
    """Estimate events that have begun but are not reported yet, for every series at once.

    ``horizon`` weeks are forecast beyond the last onset week. With ``age_col`` each age class has its
    own level and delays. ``blank_zero_strata`` sets the draws of classes without any known case to 0.
    ``prune`` looks for the last days first, by a job of its own, and reads only what the window needs.
    ``spec`` overrides the single options of the estimate.
    """
    if spec is None:
        spec = ModelSpec(draws=draws, seed=seed)
    rule = WeekRule(trim, horizon, use_epiweek, keep_complete_week)
    if prune:
        df = weekly.recent_rows(
            df, date_onset, date_report, window=window, series_cols=series_cols, rule=rule
        )
    days = weekly.day_counts(
        df, date_onset, date_report, age_col, bins=bins, series_cols=series_cols
    )
    return nowcast_days(
        days, series_cols=series_cols, d_max=d_max, window=window, rule=rule, spec=spec,
        bins=bins, blank_zero_strata=blank_zero_strata,
    )


def nowcast_days(
    days: DataFrame,
    *,
    series_cols: Sequence[str] = (),
    d_max: int = triangle.D_MAX,
    window: int = triangle.WINDOW,
    rule: WeekRule = WeekRule(),
    spec: ModelSpec = ModelSpec(),
    bins: str | Sequence[float] | None = None,
    blank_zero_strata: bool = False,
) -> NowcastResult:
    """The same from day counts, for instance from a stored table of them."""
    if d_max < 1 or window < 1:
        raise ValueError("d_max and window must be positive")
    table = triangle.delay_triangle(
        days, d_max=d_max, window=window, series_cols=series_cols, rule=rule
    )
    return NowcastResult(
        table, spec, tuple(series_cols), "age_class" in days.columns, bins, blank_zero_strata
    )
