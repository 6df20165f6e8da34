"""Per-user tumbling-window features, baselines, trends and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditmill import vocab
from auditmill.functions.scalars import (
    floor_window, is_business_hours, is_weekend, safe_ratio, weekday,
)
from auditmill.session import materialize


def event_flags(events: DataFrame) -> DataFrame:
    iam, s3 = F.col("service") == "iam", F.col("service") == "s3"
    write = ~F.col("is_read_only")
    name = F.coalesce("eventName", F.lit(""))
    return events.withColumns({
        "is_iam_event": iam,
        "is_s3_event": s3,
        "is_write_event": write,
        "is_s3_write": s3 & write,
        "is_s3_delete": name.contains("Delete"),
        "is_iam_write": iam & write,
        "is_iam_list": name.startswith("List") & iam,
        "is_s3_get": name == "GetObject",
        "is_error_event": F.col("is_error"),
        "is_after_hours": ~F.col("is_business_hours"),
    })


FLAG_COUNTS = {
    "iam_events": "is_iam_event",
    "s3_events": "is_s3_event",
    "write_events": "is_write_event",
    "s3_write_events": "is_s3_write",
    "s3_delete_events": "is_s3_delete",
    "iam_write_events": "is_iam_write",
    "iam_list_events": "is_iam_list",
    "s3_get_events": "is_s3_get",
    "error_events": "is_error_event",
    "after_hours_events": "is_after_hours",
}


def with_ratios(windows: DataFrame) -> DataFrame:
    total = F.col("total_events")
    return windows.withColumns({
        name: safe_ratio(F.col(num), total) for name, num in vocab.RATIO_COLUMNS.items()})


def window_calendar(windows: DataFrame, window_minutes: int) -> DataFrame:
    w = F.col("window")
    return windows.withColumns({
        "window_minutes": F.lit(window_minutes),
        "window_hour": F.hour(w),
        "window_day_of_week": weekday(w),
        "window_is_weekend": is_weekend(w),
        "window_is_business_hours": is_business_hours(w),
    })


def user_window_counts(events: DataFrame, window_minutes: int) -> DataFrame:
    """Counts, distinct counts and byte totals per (user, window).

    Events are reduced to one row per (user, window, name, bucket, address) first, so what is
    brought together does not grow with the events of a busy user.  A value counts for its
    window where it comes first in order: the rows of a window are sorted, which may spill, and
    move once for all distinct counts.
    """
    flagged = event_flags(
        events.filter(F.col("user_name").isNotNull() & F.col("eventTime").isNotNull()))
    values = flagged.groupBy(
        "user_name", floor_window(F.col("eventTime"), window_minutes).alias("window"),
        "eventName", "request_bucket_name", "sourceIPAddress",
    ).agg(
        F.count("eventID").alias("n"),
        *[F.sum(F.col(flag).cast("long")).alias(name) for name, flag in FLAG_COUNTS.items()],
        F.sum("bytes_transferred_out").alias("bytes_sum"), F.max("bytes_transferred_out").alias("bytes_max"),
    )
    mine = Window.partitionBy("user_name", "window")
    counted = {"unique_resources": "request_bucket_name", "unique_ips": "sourceIPAddress", "unique_event_types": "eventName"}
    for name, c in counted.items():
        values = values.withColumn(name, ~F.col(c).eqNullSafe(F.lag(c).over(mine.orderBy(c))))
    return (
        values.groupBy("user_name", "window")
        .agg(
            F.sum("n").alias("total_events"),
            *[F.sum(name).alias(name) for name in FLAG_COUNTS],
            *[F.count_if(F.col(name) & F.col(c).isNotNull()).alias(name) for name, c in counted.items()],
            F.sum("bytes_sum").alias("bytes_out_total"),
            F.max("bytes_max").alias("bytes_out_max"),
        )
    )


def window_table(events: DataFrame, window_minutes: int) -> DataFrame:
    return window_calendar(with_ratios(user_window_counts(events, window_minutes)), window_minutes)


def user_baselines(windows: DataFrame) -> DataFrame:
    """Mean, population deviation, 95th percentile and maximum per user and count.

    The group of a user is bounded by the number of windows in the time span.
    """
    aggs = []
    for c in vocab.BASELINE_COLUMNS:
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            (F.stddev_pop(c) + F.lit(1e-8)).alias(f"{c}_std"),
            F.percentile(c, F.lit(0.95)).alias(f"{c}_p95"),
            F.max(c).alias(f"{c}_max"),
        ]
    return windows.groupBy("user_name").agg(*aggs)


def _fill_days(gets: DataFrame, events: DataFrame) -> DataFrame:
    """Add the missing days of ``gets(user_name, event_date, gets)`` with a zero.

    The day spine is exploded per user from a scalar subquery over the event times, so
    there is no join of users and days.
    """
    day = F.to_date("eventTime")
    span = events.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi")).alias("span")).scalar()
    spine = (
        gets.select("user_name").distinct().withColumn("span", span)
        .select("user_name", F.explode(F.sequence("span.lo", "span.hi")).alias("event_date")))
    return (
        spine.join(gets, ["user_name", "event_date"], "left")
        .select("user_name", "event_date", F.coalesce("gets", F.lit(0)).alias("daily_s3_gets"))
    )


def daily_get_grid(events: DataFrame) -> DataFrame:
    """GetObject events per user and day, with zeros, over the days of all events.

    Only users with a GetObject have rows.
    """
    gets = (
        events.filter((F.col("eventName") == "GetObject") & F.col("user_name").isNotNull())
        .groupBy("user_name", F.to_date("eventTime").alias("event_date")).agg(F.count(F.lit(1)).alias("gets"))
    )
    return _fill_days(gets, events)


def daily_trends(grid: DataFrame, days: int = 3) -> DataFrame:
    """Least-squares slope over the last ``days`` days and change against yesterday.

    With x = 0..n-1 the slope is a fixed weighted sum of the lagged counts, which is
    exact where a regression aggregate leaves float noise.
    """
    w = Window.partitionBy("user_name").orderBy("event_date")
    count, mid = F.col("daily_s3_gets"), (days - 1) / 2
    norm = sum((i - mid) ** 2 for i in range(days))
    slope: Column = F.lit(0.0)
    for i in range(days):
        back = days - 1 - i
        if i != mid:
            slope = slope + (count if back == 0 else F.lag(count, back).over(w)) * F.lit(i - mid)
    before = F.lag(count, 1).over(w)
    return grid.withColumns({
        "s3_get_slope_3d": slope / F.lit(norm),
        "s3_get_pct_change_1d": F.when(before > 0, (count - before) / before).otherwise(F.lit(0.0)),
    })


def baseline_zscores(windows: DataFrame, baselines: DataFrame) -> DataFrame:
    """Distance from the user's own mean in deviations, clipped to [-10, 10]."""
    keep = [f"{c}_{s}" for c in vocab.ZSCORE_COLUMNS for s in ("mean", "std")]
    joined = windows.join(baselines.select("user_name", *keep), "user_name", "left")

    def z(c):
        raw = (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")
        clipped = F.least(F.greatest(raw, F.lit(-10.0)), F.lit(10.0))
        return F.coalesce(F.when(F.col(f"{c}_std") != 0, clipped), F.lit(0.0))

    return joined.withColumns({out: z(c) for c, out in vocab.ZSCORE_COLUMNS.items()}).drop(*keep)


def hour_context(windows: DataFrame, hours: DataFrame, context_minutes: int = 60) -> DataFrame:
    """Values of the enclosing longer window, as ``h1_*``."""
    context = hours.select(
        "user_name", F.col("window").alias("hour_key"),
        *[F.col(c).alias(f"h1_{c}") for c in vocab.HOUR_COLUMNS])
    return (
        windows.withColumn("hour_key", floor_window(F.col("window"), context_minutes))
        .join(context, ["user_name", "hour_key"], "left")
    )


def daily_context(windows: DataFrame, trends: DataFrame) -> DataFrame:
    daily = trends.select("user_name", F.col("event_date").alias("day"), "s3_get_slope_3d",
                          "s3_get_pct_change_1d")
    return windows.withColumn("day", F.to_date("window")).join(daily, ["user_name", "day"], "left")


def finalize_features(windows: DataFrame) -> DataFrame:
    """The 43 features in order, as doubles without nulls; absent ones are 0."""
    have = set(windows.columns)

    def feature(c):
        if c not in have:
            return F.lit(0.0).alias(c)
        value = F.col(c)
        if dict(windows.dtypes)[c] == "boolean":
            value = value.cast("int")
        return F.coalesce(value.cast("double"), F.lit(0.0)).alias(c)

    return windows.select(
        "user_name", "window", F.date_format("window", "yyyy-MM-dd").alias("window_date"),
        *[feature(c) for c in vocab.FEATURE_COLUMNS])


def window_labels(events: DataFrame, window_minutes: int) -> DataFrame:
    """The first attack, by (time, event id), of every window with an attack."""
    return (
        events.filter(F.col("is_attack") & F.col("user_name").isNotNull() & F.col("eventTime").isNotNull())
        .groupBy("user_name", floor_window(F.col("eventTime"), window_minutes).alias("window"))
        .agg(F.min_by(F.struct("attack_id", "attack_name"), F.struct("eventTime", "eventID")).alias("label"))
        .select("user_name", "window", "label.*")
    )


def label_windows(features: DataFrame, events: DataFrame | None, window_minutes: int) -> DataFrame:
    if events is None:
        return features.withColumns({
            "is_attack": F.lit(False), "attack_id": F.lit(0), "attack_name": F.lit("normal")})
    labels = window_labels(events, window_minutes)
    return (
        features.join(labels, ["user_name", "window"], "left")
        .withColumns({
            "is_attack": F.col("attack_id").isNotNull(),
            "attack_id": F.coalesce("attack_id", F.lit(0)),
            "attack_name": F.coalesce("attack_name", F.lit("normal")),
        })
    )


def label_distribution(features: DataFrame) -> DataFrame:
    """Windows per attack; the row with null attack carries the overall attack rate."""
    return (
        features.rollup(F.struct("attack_id", "attack_name").alias("attack"))
        .agg(F.count(F.lit(1)).alias("windows"),
             F.avg((F.col("attack_id") > 0).cast("int")).alias("rate"))
        .select("attack.attack_id", "attack.attack_name", "windows",
                F.round(100 * F.col("rate"), 4).alias("attack_pct"))
    )


def coarser_counts(windows: DataFrame, context_minutes: int) -> DataFrame:
    """Counts of longer windows as sums of the shorter ones that fill them."""
    sums = ["total_events", *FLAG_COUNTS]
    return windows.groupBy("user_name", floor_window(F.col("window"), context_minutes).alias("window")).agg(
        *[F.sum(c).alias(c) for c in sums])


def daily_grid_of_windows(windows: DataFrame, events: DataFrame) -> DataFrame:
    """:func:`daily_get_grid` from windows that do not cross midnight."""
    gets = windows.filter("s3_get_events > 0").groupBy("user_name", F.to_date("window").alias("event_date")).agg(
        F.sum("s3_get_events").alias("gets"))
    return _fill_days(gets, events)


def feature_matrix(events: DataFrame, window_minutes: int = 5, context_minutes: int = 60,
                   with_labels: bool = True) -> DataFrame:
    """Events -> labelled feature matrix.

    The window table is written once: rows, baselines, the longer windows and the daily
    counts are all read from it, so the events are aggregated a single time.
    """
    windows = materialize(window_table(events, window_minutes), "windows")
    whole = context_minutes % window_minutes == 0
    hours = with_ratios(coarser_counts(windows, context_minutes) if whole else user_window_counts(events, context_minutes))
    grid = daily_grid_of_windows(windows, events) if 1440 % window_minutes == 0 else daily_get_grid(events)
    out = baseline_zscores(windows, user_baselines(windows))
    out = daily_context(hour_context(out, hours, context_minutes), daily_trends(grid))
    out = finalize_features(out)
    return label_windows(out, events if with_labels else None, window_minutes)
