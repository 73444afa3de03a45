"""ISO-week calendar as column expressions (no calendar table, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# French month and weekday names shown in date dimensions.
MONTH_NAMES = [
    "janvier", "février", "mars", "avril", "mai", "juin",
    "juillet", "août", "septembre", "octobre", "novembre", "décembre",
]
WEEKDAY_NAMES = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche"]


def int_slice(text: Column, start: int, length: int) -> Column:
    """A digit slice of a text column as int; NULL when it is not a number."""
    return F.substring(text, start, length).try_cast("int")


def week_of_code(code: Column) -> Column:
    """Week number of a record week code ``SSYYYY``."""
    return int_slice(code, 1, 2)


def year_of_code(code: Column) -> Column:
    """ISO year of a record week code ``SSYYYY``."""
    return int_slice(code, 3, 4)


def valuation_week(code: Column) -> Column:
    """Week number of a valuation week code ``YYYYSS`` (opposite order)."""
    return int_slice(code, 5, 2)


def valuation_year(code: Column) -> Column:
    """ISO year of a valuation week code ``YYYYSS``."""
    return int_slice(code, 1, 4)


def week_code(year: Column, week: Column) -> Column:
    """Record week code ``SSYYYY``."""
    return F.concat(F.lpad(week.cast("string"), 2, "0"), F.lpad(year.cast("string"), 4, "0"))


def iso_monday(year: Column, week: Column) -> Column:
    """Monday of an ISO week; NULL for a week the year does not have (53 of a 52-week year)."""
    monday = F.trunc(F.date_add(F.make_date(year, F.lit(1), F.lit(4)), (week - 1) * 7), "week")
    return F.when(F.weekofyear(monday) == week, monday)


def iso_date(year: Column, week: Column, weekday: Column) -> Column:
    """Date of (ISO year, week, weekday 1-7); NULL when any part is out of range."""
    return F.when(weekday.between(1, 7), F.date_add(iso_monday(year, week), weekday - 1))


def week_sunday(year: Column, week: Column) -> Column:
    """Last day of an ISO week."""
    return F.date_add(iso_monday(year, week), 6)


def sunday_year(year: Column, week: Column) -> Column:
    """Calendar year of the week's Sunday: the campaign the week belongs to."""
    return F.year(week_sunday(year, week))


def iso_year(day: Column) -> Column:
    """ISO year of a date: calendar year of its week's Thursday."""
    return F.year(F.date_add(day, 3 - F.weekday(day)))


def last_week_of_month(year: Column, month: Column) -> Column:
    """Last ISO week whose Thursday falls in the month."""
    month_end = F.last_day(F.make_date(year, month, F.lit(1)))
    thursday = F.date_sub(month_end, F.pmod(F.weekday(month_end) - 3, F.lit(7)))
    return F.weekofyear(thursday)


def week_of_day(year: Column, month: Column, day: Column) -> Column:
    """ISO week of a day and month, NULL for an impossible date or one of another ISO year."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    date = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(iso_year(date) == year, F.weekofyear(date))


def _pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index)


def date_dimensions(day: Column, prefix: str) -> dict[str, Column]:
    """Year, month, quarter, weekday and ISO-week labels of a date, with their sort keys."""
    year, month = F.year(day), F.month(day)
    year_text = F.date_format(day, "yyyy")
    return {
        f"{prefix}_annee": year_text,
        f"{prefix}_mois": F.concat(
            F.date_format(day, "yyyy-MM"), F.lit(" ("), _pick(MONTH_NAMES, month), F.lit(")")
        ),
        f"{prefix}_mois_sort": F.date_format(day, "yyyy-MM"),
        f"{prefix}_trimestre": F.concat(year_text, F.lit("-T"), F.quarter(day).cast("string")),
        f"{prefix}_jour_semaine": _pick(WEEKDAY_NAMES, F.weekday(day) + 1),
        f"{prefix}_jour_semaine_sort": F.weekday(day),
        f"{prefix}_semaine_iso": F.concat(
            F.lit("S"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"), F.lit("-"),
            iso_year(day).cast("string"),
        ),
        f"{prefix}_semaine_iso_sort": iso_year(day) * 100 + F.weekofyear(day),
    }


def week_dimension(code: Column) -> tuple[Column, Column]:
    """(label ``Sww-yyyy``, sortable ``yyyyww``) of a record week code."""
    label = F.concat(F.lit("S"), F.substring(code, 1, 2), F.lit("-"), F.substring(code, 3, 4))
    return label, year_of_code(code) * 100 + week_of_code(code)
