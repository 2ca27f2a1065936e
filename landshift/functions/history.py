"""Temporal states, seasonality and observation states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landshift.functions.text import words

SECONDS_PER_DAY = 86400.0


def elapsed_days(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6 / SECONDS_PER_DAY


def signal_state(support: Column, intervals: Column, gaps: Column) -> Column:
    return (
        F.when((support == intervals) & (intervals > 1), "persistent")
        .when(gaps > 0, "recurrent")
        .when(intervals > 1, "transient")
        .otherwise("isolated")
    )


def analysis_state(observations: Column, persistent: Column, recurrent: Column, transient: Column, signals: Column) -> Column:
    """``persistent``/``recurrent``/``transient``/``signals`` are counts of signals."""
    return (
        F.when(observations < 3, "insufficient_history")
        .when(persistent > 0, "persistent")
        .when(recurrent > 0, "recurrent")
        .when(transient > 0, "transient")
        .when(signals > 0, "isolated")
        .otherwise("no_temporal_signal")
    )


def midpoint_day(start: Column, end: Column) -> Column:
    """Day of the year halfway between two timestamps."""
    half = F.floor((F.unix_micros(start) + F.unix_micros(end)) / 2).cast("bigint")
    return F.dayofyear(F.timestamp_micros(half))


def season(days: Column, observations: Column, tolerance: int) -> Column:
    """Calendar comparability of the supporting midpoints, measured from the first."""
    distances = F.transform(
        F.slice(days, 2, F.greatest(F.size(days), F.lit(1))),
        lambda d: F.least(F.abs(d - days[0]), F.lit(366) - F.abs(d - days[0])),
    )
    return (
        F.when(observations < 4, "insufficient_temporal_evidence")
        .when(F.size(days) < 2, "less_seasonal_compatible")
        .when(F.array_max(distances) <= tolerance, "seasonal_compatible")
        .otherwise("less_seasonal_compatible")
    )


def gap_count(indices: Column) -> Column:
    """How often the next supporting interval is not the following one."""
    steps = F.zip_with(
        F.slice(indices, 1, F.size(indices) - 1),
        F.slice(indices, 2, F.greatest(F.size(indices) - 1, F.lit(0))),
        lambda left, right: (right > left + 1).cast("int"),
    )
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def quality_state(usable: Column, total: Column, minimum: float) -> Column:
    share = F.coalesce(F.try_divide(usable, total), F.lit(0.0))
    return F.when((share >= minimum) & (usable > 0), "usable").otherwise("valid_unusable")


def quality_reason(usable: Column, total: Column, minimum: float) -> Column:
    share = F.coalesce(F.try_divide(usable, total), F.lit(0.0))
    return (
        F.when(usable == 0, "no_usable_pixels")
        .when(share < minimum, "insufficient_usable_pixels")
        .otherwise("quality_policy_passed")
    )


def usable_fraction(percentage: Column, fraction: Column, usable: Column, total: Column) -> Column:
    """Usable share from whichever figure is stored; 1.0 when none is."""
    return F.coalesce(
        percentage / 100.0,
        fraction,
        F.when(usable <= 0, 0.0),
        F.when(total > 0, F.try_divide(usable, total)),
        F.lit(1.0),
    )


def ineligible_reason(state: Column, reason: Column, fraction: Column) -> Column:
    """Why an observation takes no part in an analysis."""
    return (
        F.when(
            (state == "valid_unusable") & (F.coalesce(reason, F.lit("")) != "")
            & (reason != "quality_policy_passed"),
            words(reason),
        )
        .when(state == "valid_unusable", "valid but unusable quality")
        .when(state == "failed", "quality assessment failed")
        .when(state == "legacy_unassessed", "legacy unassessed quality")
        .when(state.isNotNull() & (state != "") & (state != "usable"), words(state))
        .when(fraction <= 0, "zero usable pixels")
        .otherwise("unavailable")
    )
