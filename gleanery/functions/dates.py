"""Calendar columns: ISO weeks, Budapest days, published dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import once

ZONE = "Europe/Budapest"


def iso_week(day: Column) -> Column:
    """'2026-W39' of a date (UTC)."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))


def monday(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day.cast("timestamp")))


def week_period(day: Column) -> Column:
    """Year and month of the week's Thursday, '2026 / 09'."""
    return F.date_format(F.date_add(monday(day), 3), "yyyy / MM")


def week_compact(day: Column) -> Column:
    return F.lower(F.replace(iso_week(day), F.lit("-"), F.lit("")))


def iso_week_monday(week: Column) -> Column:
    """Monday of '2026-W39'; null for what no week is called (W00, W53 of a short year, other forms)."""
    good = week.rlike(r"^\d{4}-W\d{2}$")
    year, number = F.try_to_number(F.substring(week, 1, 4), F.lit("9999")).cast("int"), F.try_to_number(F.substring(week, 7, 2), F.lit("99")).cast("int")
    fourth = F.make_date(F.when(good & (year > 0), year).otherwise(2000), F.lit(1), F.lit(4))
    start = F.date_add(monday(fourth), (F.coalesce(number, F.lit(0)) - 1) * 7)
    return F.when(good & (iso_week(start) == week), start)


def budapest_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def budapest_hour(ts: Column) -> Column:
    return F.hour(F.from_utc_timestamp(ts, ZONE))


def budapest_day_start(ts: Column) -> Column:
    """The instant (UTC) at which the local day began; days of 23 and 25 hours included."""
    return F.to_utc_timestamp(budapest_day(ts).cast("timestamp"), ZONE)


_TIME = r"(?:,?\s+(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([ap]m)?)?"
_ZONE = r"\s*(?:(?:gmt|utc|z)?\s*([+-]\d{2}):?(\d{2})|(gmt|utc|ut|z|[ecmp][sd]t))?$"
_WEEKDAY = r"^(?:[a-z]{3,9}\.?,?\s+)?"
#: Forms of a date, and which group is its day, month and year.
_FORMS = (
    (_WEEKDAY + r"(\d{1,2})[\s-]+([a-z]{3,9})\.?,?[\s-]+(\d{4})", (1, 2, 3)),
    (_WEEKDAY + r"([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", (2, 1, 3)),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", (3, 2, 1)),
    (r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})", (2, 1, 3)),
)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: Hours that names of zones are behind UTC.
_BEHIND = {"est": 5, "edt": 4, "cst": 6, "cdt": 5, "mst": 7, "mdt": 6, "pst": 8, "pdt": 7}


def _moment(text: Column, form: str, places: tuple[int, int, int]) -> Column:
    """The UTC day of a text of one form; null for any other. Days run on into the next month, 31 at most."""
    whole = form + _TIME + _ZONE
    part = lambda i: F.nullif(F.regexp_extract(text, whole, i), F.lit(""))
    number = lambda i: part(i).cast("int")
    day, name, year = number(places[0]), part(places[1]), number(places[2])
    month = F.when(name.rlike(r"^\d+$"), name.try_cast("int")).otherwise(F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.substring(name, 1, 3)), F.lit(0)).cast("int"))
    hour, half = F.coalesce(number(4), F.lit(0)), part(7)
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    minutes = hour * 60 + F.coalesce(number(5), F.lit(0))
    sign = F.when(part(8).startswith("-"), -1).otherwise(1)
    ahead = F.coalesce(number(8) * 60 + sign * number(9), F.lit(0)) - 60 * F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _BEHIND.items() for x in kv)), F.coalesce(part(10), F.lit("z"))), F.lit(0))
    good = text.rlike(whole) & day.between(1, 31) & month.between(1, 12) & (hour <= 24) & year.between(1, 9999)
    start = F.when(F.coalesce(good, F.lit(False)), F.make_date(year, month, F.lit(1)))
    return F.date_add(start, day - 1 + F.floor((minutes - ahead) / 1440).cast("int"))


def published_date(text: Column) -> Column:
    """An ISO prefix as written if it is a day; else the UTC day of a moment in one of the usual forms (a time without a zone is UTC); else null.

    Forms: 22 Sep 2026, 22-September-2026, Sep 22, 2026, 2026/09/22 and
    09/22/2026, with or without a weekday, a time and a zone.
    """

    def read(raw: Column) -> Column:
        plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(raw, r"\([^)]*\)", " "), r"\s+", " ")))
        iso = F.substring(raw, 1, 10).try_cast("date")
        return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), iso).otherwise(once(plain, lambda x: F.coalesce(*(_moment(x, *form) for form in _FORMS))))

    return once(text, read)


def is_closed(week: Column, current: Column) -> Column:
    """Weeks sort as text."""
    return week < current


def stale(day: Column, now: Column) -> Column:
    """struct(today, late): late is not today's after 18 hours in Budapest."""
    today = day == budapest_day(now)
    return F.struct(today.alias("today"), (~today & (budapest_hour(now) >= 18)).alias("late"))


def cooldown_seconds(last: Column, now: Column, minutes: int = 10) -> Column:
    """Seconds left of a cooldown; 0 where nothing was done before."""
    left = F.unix_timestamp(last) + minutes * 60 - F.unix_timestamp(now)
    return F.coalesce(F.greatest(F.lit(0), left), F.lit(0)).cast("long")


def day_label(day: Column) -> Column:
    return F.date_format(day, "MM / dd")


def week_label(week: Column) -> Column:
    return F.replace(week, F.lit("-"), F.lit(" / "))


def archive_label(monday: Column) -> Column:
    """The Sunday of a week by its Monday, as 'MM. DD.'."""
    return F.date_format(F.date_add(monday, 6), "MM. dd.")


def finished_days(since: Column, now: Column) -> Column:
    """Days from since to the last one that has ended; none if there is none."""
    last = F.date_sub(F.to_date(now), 1)
    return F.when(F.to_date(since) <= last, F.sequence(F.to_date(since), last)).otherwise(F.array().cast("array<date>"))
