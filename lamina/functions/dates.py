"""Dates and times: components, picture formats, durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Picture components and their patterns for date_format.
COMPONENTS = {
    "Y0001": "yyyy", "Y": "yyyy", "Y01": "yy", "M01": "MM", "M": "M", "MNn": "MMMM", "MNn,*-3": "MMM", "D01": "dd", "D": "d", "D1": "d", "d": "D", "H01": "HH", "H": "H", "h": "h", "h01": "hh",
    "m01": "mm", "m": "mm", "s01": "ss", "s": "ss", "f001": "SSS", "P": "a", "FNn": "EEEE", "FNn,*-3": "EEE", "Z": "xxx", "z": "'GMT'xxx",
}


def picture(text: str) -> str:
    """[Y0001]-[M01]-[D01] to yyyy-MM-dd; text outside brackets is literal."""
    out = []
    for part in re.split(r"(\[[^\]]*\])", text):
        if part.startswith("["):
            key = part[1:-1].replace(" ", "")
            if key not in COMPONENTS:
                raise ValueError(f"unknown picture component {part}")
            out.append(COMPONENTS[key])
        elif part:
            out.append("'" + part.replace("'", "''") + "'" if re.search("[A-Za-z']", part) else part)
    return "".join(out)


def format_date(c: Column, text: str) -> Column:
    return F.date_format(c, picture(text))


format_datetime = format_date

COMPONENT = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hours": F.hour, "minutes": F.minute, "seconds": F.second, "week": F.weekofyear, "weekday": lambda c: F.weekday(c) + 1}


def instant(text: Column) -> Column:
    """A dateTime with an offset as an instant, so equal instants are equal keys; no dateTime gives empty."""
    return text.try_cast("timestamp")


def day_time_duration(seconds: Column) -> Column:
    """P1DT2H3M4S from whole seconds."""
    n = F.abs(seconds.cast("long"))
    part = lambda v, mark: F.when(v > 0, F.concat(v.cast("string"), F.lit(mark))).otherwise("")
    day, hour, minute, second = F.floor(n / 86400), F.floor(n % 86400 / 3600), F.floor(n % 3600 / 60), n % 60
    time = F.concat(part(hour, "H"), part(minute, "M"), part(second, "S"))
    text = F.concat(F.lit("P"), part(day, "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.when(text == "P", "PT0S").otherwise(text))


def current_date() -> Column:
    """current-date: the same for the whole of a query."""
    return F.current_date()


def current_datetime() -> Column:
    """current-dateTime: the same for the whole of a query."""
    return F.current_timestamp()


def current_time() -> Column:
    """current-time, as HH:mm:ss.ffffff."""
    return F.date_format(F.current_timestamp(), "HH:mm:ss.SSSSSS")


def seconds_between(a: Column, b: Column) -> Column:
    return F.unix_timestamp(a) - F.unix_timestamp(b)
