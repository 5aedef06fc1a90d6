"""Date functions: parsing free-form dates, ISO text, day buckets and day bounds."""

import json
import re
from calendar import month_name
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from email.utils import parsedate_to_datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from articleflow.functions import ColumnOrName, as_column
from articleflow.functions.text import plain_text

# Accepted date formats, in order of trial.
DATE_FORMATS = (
    "%Y-%m-%dT%H:%M:%S%z",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%d",
    "%Y/%m/%d",
    "%d %B %Y",
    "%B %d, %Y",
    "%A, %B %d, %Y",
    "%b %d, %Y",
)
# Dates looked for inside other text.
EMBEDDED_DATES = (
    re.compile(r"(?P<year>\d{4})[./-](?P<month>\d{1,2})[./-](?P<day>\d{1,2})[ T](?P<hour>\d{1,2}):(?P<minute>\d{2})"),
    re.compile(r"(?P<year>\d{4})[./-](?P<month>\d{1,2})[./-](?P<day>\d{1,2})"),
    re.compile(r"(?P<name>[A-Z][a-z]+) (?P<day>\d{1,2}), (?P<year>\d{4})"),
)
_MONTHS = {name: number for number, name in enumerate(month_name) if name}


def _by_standard(text: str) -> Iterator[datetime]:
    yield datetime.fromisoformat(text)


def _by_mail_header(text: str) -> Iterator[datetime]:
    yield parsedate_to_datetime(text)


def _by_layout(text: str) -> Iterator[datetime]:
    """A layout can only fit a text that begins the way it does: with a digit, or else with a name."""
    for layout in DATE_FORMATS:
        if text[0].isdigit() == (layout[1] in "Yd"):
            try:
                yield datetime.strptime(text, layout)
            except ValueError:
                continue


def _inside(text: str) -> Iterator[datetime]:
    for pattern in EMBEDDED_DATES:
        found = pattern.search(text)
        if found:
            parts = found.groupdict()
            name = parts.pop("name", None)
            if name is None or name in _MONTHS:
                numbers = {key: int(value) for key, value in parts.items()} | ({"month": _MONTHS[name]} if name else {})
                try:
                    yield datetime(**numbers)
                except ValueError:
                    continue


def _as_utc(moment: datetime) -> datetime:
    return moment.astimezone(timezone.utc) if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def _numbers(text: str) -> list:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return []


@lru_cache(maxsize=1 << 16)
def parse_date(value: str | None) -> datetime | None:
    """One date text to UTC; a JSON array of six numbers or more counts as year .. second."""
    if not value:
        return None
    if value[0] == "[":
        numbers = _numbers(value)
        if len(numbers) >= 6:
            try:
                return datetime(*[int(number) for number in numbers[:6]], tzinfo=timezone.utc)
            except (TypeError, ValueError):
                return None
    text = plain_text(value)
    for reading in (_by_standard, _by_mail_header, _by_layout, _inside) if text else ():
        try:
            for moment in reading(text):
                return _as_utc(moment)
        except (TypeError, ValueError, IndexError, OverflowError):
            continue
    return None


@arrow_udf(T.TimestampType())
def normalize_date(values: pa.Array) -> pa.Array:
    return pa.array([parse_date(value) for value in values.to_pylist()], pa.timestamp("us", tz="UTC"))


def to_iso(moment: ColumnOrName) -> Column:
    """UTC ISO-8601 text; the fraction is written only where there is one."""
    moment = as_column(moment)
    whole = moment == F.date_trunc("second", moment)
    layout = "yyyy-MM-dd'T'HH:mm:ss"
    return F.concat(
        F.when(whole, F.date_format(moment, layout)).otherwise(F.date_format(moment, layout + ".SSSSSS")),
        F.lit("+00:00"),
    )


def day_text(moment: ColumnOrName) -> Column:
    return F.date_format(as_column(moment), "yyyy-MM-dd")


def day_bounds(date_from: str | None, date_to: str | None) -> tuple[datetime | None, datetime | None]:
    """``YYYY-MM-DD`` bounds as a half-open range: first instant of the first day, first after the last."""
    first = last = None
    if date_from:
        first = datetime.combine(date.fromisoformat(date_from), datetime.min.time(), timezone.utc)
    if date_to:
        last = datetime.combine(date.fromisoformat(date_to), datetime.min.time(), timezone.utc) + timedelta(days=1)
    return first, last
