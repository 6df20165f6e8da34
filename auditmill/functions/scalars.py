"""Column expressions for strings, calendar fields and number formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from auditmill import vocab


def any_contains(text: Column, words) -> Column:
    """Does ``text`` contain one of ``words``?"""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_contained(text: Column, words) -> Column:
    """How many of ``words`` does ``text`` contain?"""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def first_truthy(*cols: Column) -> Column:
    """First non-empty value; the last one is taken as it is."""
    *head, last = cols
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in head], last)


def user_agent_category(ua: Column) -> Column:
    text = F.lower(F.coalesce(ua, F.lit("")))
    out = None
    for category, words in vocab.USER_AGENT_WORDS.items():
        hit = any_contains(text, words)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("other")


def service_name(source: Column) -> Column:
    source = F.coalesce(source, F.lit(""))
    out = None
    for host, service in vocab.SERVICE_NAMES.items():
        out = F.when(source == host, service) if out is None else out.when(source == host, service)
    return out.otherwise(F.substring_index(source, ".", 1))


def is_internal_ip(ip: Column) -> Column:
    ip = F.coalesce(ip, F.lit(""))
    return reduce(lambda a, b: a | b, [ip.startswith(p) for p in vocab.INTERNAL_IP_PREFIXES])


def weekday(ts: Column) -> Column:
    """0 = Monday."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return weekday(ts) >= 5


def is_business_hours(ts: Column) -> Column:
    hour = F.hour(ts)
    return (hour >= 9) & (hour < 18) & (weekday(ts) < 5)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text, rounded half-even on the exact binary value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def floor_window(ts: Column, minutes: int) -> Column:
    """Start of the tumbling window of ``minutes`` that holds ``ts``; null for a null time.

    Arithmetic, because ``F.window`` removes the rows without a time from whatever it is used in.
    """
    size = F.lit(minutes * 60_000_000)
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), size))


def ts_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
