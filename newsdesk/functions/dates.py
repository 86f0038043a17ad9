"""Dates of feeds, edition days and Portuguese labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.params import MONTHS, WEEKDAYS

ZONE = "America/Sao_Paulo"
_RFC = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z")


def parse_date(iso: Column, pub: Column, fallback: Column) -> Column:
    """The ISO date, else the RFC 822 one, else the fallback; a given but unreadable date gives the fallback."""
    value = F.coalesce(F.nullif(iso, F.lit("")), F.nullif(pub, F.lit("")))
    bare = F.regexp_replace(value, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(value), *[F.try_to_timestamp(bare, F.lit(f)) for f in _RFC], fallback)


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def edition_date(ts: Column, zone: str = ZONE) -> Column:
    """The day an instant falls on where the readers are."""
    return F.to_date(local(ts, zone))


def _name(names, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def clock_label(ts: Column, zone: str = ZONE) -> Column:
    """14h30."""
    return F.date_format(local(ts, zone), "HH'h'mm")


def time_label(ts: Column, zone: str = ZONE) -> Column:
    """às 14h30; empty without a date."""
    return F.coalesce(F.concat(F.lit("às "), clock_label(ts, zone)), F.lit(""))


def datetime_label(ts: Column, zone: str = ZONE) -> Column:
    """20 de mai • 14h30; empty without a date."""
    t = local(ts, zone)
    month = F.substring(_name(MONTHS, F.month(t)), 1, 3)
    return F.coalesce(F.concat(F.date_format(t, "dd"), F.lit(" de "), month, F.lit(" • "), clock_label(ts, zone)), F.lit(""))


def date_label(day: Column) -> Column:
    """3 de junho de 2026, of a yyyy-MM-dd string; anything else as it is."""
    d = F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))
    text = F.concat(F.dayofmonth(d).cast("string"), F.lit(" de "), _name(MONTHS, F.month(d)), F.lit(" de "), F.year(d).cast("string"))
    return F.coalesce(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), day)


def full_label(day: Column) -> Column:
    """terça-feira, 20 de maio de 2026."""
    d = F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))
    text = F.concat(
        _name(WEEKDAYS, F.weekday(d) + 1), F.lit(", "), F.date_format(d, "dd"), F.lit(" de "), _name(MONTHS, F.month(d)), F.lit(" de "), F.year(d).cast("string")
    )
    return F.coalesce(text, day)


def w3c(ts: Column) -> Column:
    """2026-06-02T12:00:00Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc1123(ts: Column) -> Column:
    """Tue, 02 Jun 2026 12:00:00 GMT, whatever the JVM's locale."""
    days = _name(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"), F.weekday(ts) + 1)
    months = _name(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), F.month(ts))
    return F.concat(days, F.lit(", "), F.date_format(ts, "dd"), F.lit(" "), months, F.date_format(ts, " yyyy HH:mm:ss 'GMT'"))
