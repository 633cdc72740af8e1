"""Dates, classes and casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(ts: Column) -> Column:
    """ISO 8601 week, ``2026-W09``; the year is the week's."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def parsed_time(text: Column) -> Column:
    """ISO time, with ``Z`` or without; null if it can't be read."""
    return F.try_to_timestamp(text)


def http_class(status: Column) -> Column:
    """Label of an HTTP status; ``unreachable`` for none."""
    return (
        F.when(status.isNull(), "unreachable")
        .when(status.between(200, 299), "ok")
        .when(status.isin(401, 403), "auth-required")
        .when(status == 404, "not-found")
        .when(status == 429, "rate-limited")
        .when(status >= 500, "server-error")
        .otherwise("unexpected")
    )


def int_or_none(text: Column) -> Column:
    return text.try_cast("long")


def text_list(raw: Column) -> Column:
    """Comma text as a list of nonempty trimmed values."""
    from .text import strip

    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), strip), lambda x: x != "")


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor the empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def first_nonempty(*lists: Column) -> Column:
    """The first list with a member; an empty list if none has."""
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))
