"""Raw audit records -> flat, typed, labelled events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditmill import vocab
from auditmill.functions.scalars import (
    first_truthy, is_business_hours, is_internal_ip, is_weekend, service_name, user_agent_category,
    weekday,
)


def parse_event_time(text: Column) -> Column:
    """Strict ISO seconds with a Z; anything else is null."""
    strict = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.when(strict, F.try_to_timestamp(text, F.lit(vocab.EVENT_TIME_FORMAT)))


def bucket_name(request: Column) -> Column:
    return first_truthy(
        request["bucketName"], request["bucket"],
        request["createBucketConfiguration"]["locationConstraint"],
    )


def object_key(request: Column) -> Column:
    return first_truthy(request["key"], request["objectKey"])


def resolve_user_name(identity: Column) -> Column:
    """``userName``; else the session part of a role's principal; else the principal."""
    principal = identity["principalId"]
    return F.coalesce(
        F.nullif(identity["userName"], F.lit("")),
        F.when(identity["type"] == "AssumedRole",
               F.substring_index(F.coalesce(principal, F.lit("")), ":", -1))
        .otherwise(principal),
    )


def flatten_events(raw: DataFrame) -> DataFrame:
    """One flat row of 36 columns per raw record; absent fields are null.

    A projection only: nested columns that nobody reads are pruned from the scan.
    """
    user, request = F.col("userIdentity"), F.col("requestParameters")
    session, extra = user["sessionContext"], F.col("additionalEventData")
    ts = parse_event_time(F.col("eventTime"))
    text = F.coalesce(F.col("eventTime"), F.lit(""))
    return raw.select(
        "eventID",
        ts.alias("eventTime"),
        text.alias("eventTime_str"),
        "eventName", "eventSource", "awsRegion", "eventType",
        F.coalesce("sourceIPAddress", F.lit("")).alias("sourceIPAddress"),
        F.coalesce("userAgent", F.lit("")).alias("userAgent"),
        user_agent_category(F.col("userAgent")).alias("ua_category"),
        is_internal_ip(F.col("sourceIPAddress")).alias("is_internal_ip"),
        user["type"].alias("user_type"),
        resolve_user_name(user).alias("user_name"),
        user["arn"].alias("user_arn"),
        user["accountId"].alias("user_account_id"),
        user["accessKeyId"].alias("user_access_key_id"),
        F.coalesce(session["attributes"]["mfaAuthenticated"] == "true", F.lit(False))
        .alias("user_mfa_authenticated"),
        session["sessionIssuer"]["type"].alias("session_issuer_type"),
        session["sessionIssuer"]["userName"].alias("session_issuer_username"),
        bucket_name(request).alias("request_bucket_name"),
        object_key(request).alias("request_key"),
        request["prefix"].alias("request_prefix"),
        F.col("errorCode").alias("error_code"),
        F.col("errorMessage").alias("error_message"),
        F.col("errorCode").isNotNull().alias("is_error"),
        F.coalesce("readOnly", F.lit(True)).alias("is_read_only"),
        F.coalesce("managementEvent", F.lit(False)).alias("is_management_event"),
        F.coalesce(extra["byteTransferredOut"].cast("double"), F.lit(0.0)).alias("bytes_transferred_out"),
        F.coalesce(extra["byteTransferredIn"].cast("double"), F.lit(0.0)).alias("bytes_transferred_in"),
        F.hour(ts).alias("event_hour"),
        weekday(ts).alias("event_day_of_week"),
        F.date_format(ts, "yyyy-MM-dd").alias("event_date"),
        (F.hour(ts) * 60 + F.minute(ts)).alias("event_minute_of_day"),
        F.coalesce(is_weekend(ts), F.lit(False)).alias("is_weekend"),
        F.coalesce(is_business_hours(ts), F.lit(False)).alias("is_business_hours"),
        service_name(F.col("eventSource")).alias("service"),
    )


def sort_by_event_time(events: DataFrame) -> DataFrame:
    """Total order by time (a range-partitioned sort), nulls last, ties by event id."""
    return events.orderBy(F.col("eventTime").asc_nulls_last(), "eventID")


def label_events(events: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Attach the attack label of each event; events without one are normal.

    Labels are unique by ``eventID``: repeated ids would multiply events, so they are
    reduced first.  No hint: Spark broadcasts the labels only while they are small.
    """
    if labels is None:
        return events.withColumns({
            "is_attack": F.lit(False), "attack_id": F.lit(0), "attack_name": F.lit("normal"),
        })
    one = labels.groupBy("eventID").agg(
        F.min(F.struct("attack_id", "attack_name")).alias("label"))
    return (
        events.drop("is_attack", "attack_id", "attack_name")
        .join(one, "eventID", "left")
        .withColumns({
            "is_attack": F.col("label").isNotNull(),
            "attack_id": F.coalesce("label.attack_id", F.lit(0)),
            "attack_name": F.coalesce("label.attack_name", F.lit("normal")),
        })
        .drop("label")
    )


def events_summary(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.min("eventTime").alias("first_time"),
        F.max("eventTime").alias("last_time"),
        F.count_distinct("user_name").alias("users"),
        F.count_distinct("eventName").alias("event_names"),
    )


def top_values(events: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most common values of ``column``."""
    return (
        events.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.desc("events"), "value").limit(n)
    )


def value_counts(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("events"))


def merge_event_sets(normal: DataFrame, attack: DataFrame) -> DataFrame:
    return sort_by_event_time(normal.unionByName(attack))


def attack_manifest(events: DataFrame) -> DataFrame:
    """Event count and time span per attack, computed from the labels."""
    return (
        events.filter("is_attack").groupBy("attack_id", "attack_name")
        .agg(F.count(F.lit(1)).alias("events"), F.min("eventTime").alias("window_start"),
             F.max("eventTime").alias("window_end"))
    )
