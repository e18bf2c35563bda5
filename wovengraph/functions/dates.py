"""Dates as periods of Julian Day Numbers, in two proleptic calendars.

Text form: ``CALENDAR:Y[-M[-D]][ ERA][:Y[-M[-D]][ ERA]]``. All functions are
column expressions over Spark's own dates, which are proleptic Gregorian. A
Julian date is looked up in the four years from 2000 on, where both calendars
have the same months, and moved by whole cycles of 1461 days. Years before the
common era count 1 BCE = 0, 2 BCE = -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the text format.
_DATE = r"[1-9][0-9]{0,3}(-(?!00)[0-9]{1,2}(-(?!00)[0-9]{1,2})?)?( BC| AD| BCE| CE)?"
DATE_PATTERN = rf"^(GREGORIAN|JULIAN):{_DATE}(:{_DATE})?$"
# Day numbers of 1970-01-01 and 2000-01-01, and of 1 January and 1 March of the Julian year 0.
UNIX_DAY, MILLENNIUM, JULIAN_JANUARY, JULIAN_MARCH = 2440588, 2451545, 1721058, 1721118
CYCLE = 1461


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def _number(date: Column, year: Column, julian: Column) -> Column:
    """Day number of a Spark date that stands for a month of the given year."""
    moved = F.floor(year / F.lit(4)).cast("int") * CYCLE + (JULIAN_JANUARY - MILLENNIUM)
    return F.datediff(date, _day("1970-01-01")) + UNIX_DAY + F.when(julian, moved).otherwise(0)


def _month_date(year: Column, month: Column, julian: Column) -> Column:
    return F.make_date(F.when(julian, F.pmod(year, F.lit(4)) + 2000).otherwise(year).cast("int"), month.cast("int"), F.lit(1))


def jdn(year: Column, month: Column, day: Column, julian: Column) -> Column:
    """Julian Day Number of a calendar date."""
    return (_number(_month_date(year, month, julian), year, julian) + day.cast("int") - 1).cast("int")


def from_jdn(number: Column, julian: Column) -> Column:
    """struct(year, month, day) of a Julian Day Number."""
    n = number.cast("int")
    old = n - JULIAN_MARCH
    date = F.when(julian, F.date_add(_day("2000-03-01"), F.pmod(old, F.lit(CYCLE)))).otherwise(
        F.date_add(_day("1970-01-01"), n - UNIX_DAY)
    )
    moved = F.when(julian, F.floor(old / F.lit(CYCLE)).cast("int") * 4 - 2000).otherwise(0)
    return F.struct((F.year(date) + moved).alias("year"), F.month(date).alias("month"), F.day(date).alias("day"))


def era(year: Column) -> Column:
    return F.when(year > 0, "CE").otherwise("BCE")


def era_year(year: Column) -> Column:
    """The year as it is counted within its era."""
    return F.when(year > 0, year).otherwise(1 - year)


def is_before_era(name: Column) -> Column:
    """BC = BCE, AD = CE; without a name the common era is meant."""
    return F.coalesce(name.isin("BC", "BCE"), F.lit(False))


def date_fields(number: Column, julian: Column) -> Column:
    """struct(year, month, day, era) with the year counted in its era."""
    d = from_jdn(number, julian)
    return F.struct(era_year(d["year"]).alias("year"), d["month"].alias("month"), d["day"].alias("day"), era(d["year"]).alias("era"))


def date_text(number: Column, julian: Column, precision: Column) -> Column:
    d = date_fields(number, julian)
    return (
        F.when(precision == "YEAR", F.format_string("%04d %s", d["year"], d["era"]))
        .when(precision == "MONTH", F.format_string("%04d-%02d %s", d["year"], d["month"], d["era"]))
        .otherwise(F.format_string("%04d-%02d-%02d %s", d["year"], d["month"], d["day"], d["era"]))
    )


def period_text(start: Column, end: Column, julian: Column) -> Column:
    """A period as text with day precision; a single day is given once."""
    first, last = date_text(start, julian, F.lit("DAY")), date_text(end, julian, F.lit("DAY"))
    return F.when(start == end, first).otherwise(F.concat(first, F.lit(" - "), last))


def interval_text(start: Column, end: Column) -> Column:
    return F.concat_ws(" - ", start.cast("string"), end.cast("string"))


def with_period(df: DataFrame, column: str, name: str = "period") -> DataFrame:
    """Add the parsed text as struct(calendar, start_jdn, end_jdn, start_prec, end_prec, error).

    The error is null for a good date. Each step is a projection of its own:
    one nested expression would repeat the early steps many times over.
    """
    c = F.col
    given = df.columns
    shaped = F.when(F.rlike(c(column), F.lit(DATE_PATTERN)), c(column))
    df = df.withColumn("_parts", F.split(shaped, ":")).withColumns(
        {"_julian": F.get("_parts", F.lit(0)) == "JULIAN", "_t1": F.get("_parts", F.lit(1)), "_t2": F.element_at("_parts", -1)}
    )
    sides = ("1", "2")
    df = df.withColumns({f"_s{i}": F.split(F.split_part(f"_t{i}", F.lit(" "), F.lit(1)), "-") for i in sides})
    steps = [
        lambda i: {
            f"_y{i}": F.get(f"_s{i}", F.lit(0)).try_cast("int"),
            f"_m{i}": F.get(f"_s{i}", F.lit(1)).try_cast("int"),
            f"_d{i}": F.get(f"_s{i}", F.lit(2)).try_cast("int"),
            f"_era{i}": F.split_part(f"_t{i}", F.lit(" "), F.lit(2)),
        },
        lambda i: {
            f"_y{i}": F.when(is_before_era(c(f"_era{i}")), 1 - c(f"_y{i}")).otherwise(c(f"_y{i}")),
            f"_month_ok{i}": c(f"_m{i}").isNull() | c(f"_m{i}").between(1, 12),
        },
        lambda i: {f"_first{i}": _month_date(c(f"_y{i}"), F.when(c(f"_month_ok{i}"), F.coalesce(f"_m{i}", F.lit(1))).otherwise(1), c("_julian"))},
        lambda i: {f"_last{i}": F.last_day(F.when(c(f"_m{i}").isNull(), F.add_months(f"_first{i}", 11)).otherwise(c(f"_first{i}")))},
        lambda i: {
            f"_start{i}": _number(c(f"_first{i}"), c(f"_y{i}"), c("_julian")) + F.coalesce(c(f"_d{i}") - 1, F.lit(0)),
            f"_end{i}": _number(c(f"_last{i}"), c(f"_y{i}"), c("_julian")),
            f"_ok{i}": c(f"_month_ok{i}") & (c(f"_d{i}").isNull() | c(f"_d{i}").between(1, F.day(F.last_day(f"_first{i}")))),
        },
    ]
    for step in steps:
        df = df.withColumns({k: v for i in sides for k, v in step(i).items()})
    df = df.withColumn("_end", F.when(c("_d2").isNotNull(), c("_start2")).otherwise(c("_end2")))
    error = (
        F.when(c("_parts").isNull(), "invalid format")
        .when(~(c("_ok1") & c("_ok2")), "invalid date")
        .when(c("_start1") > c("_end"), "start is after end")
    )
    df = df.withColumn("_error", error)
    good = c("_error").isNull()
    precision = lambda i: F.when(c(f"_d{i}").isNotNull(), "DAY").when(c(f"_m{i}").isNotNull(), "MONTH").otherwise("YEAR")
    parsed = F.struct(
        F.when(good, F.when(c("_julian"), "JULIAN").otherwise("GREGORIAN")).alias("calendar"),
        F.when(good, c("_start1")).alias("start_jdn"),
        F.when(good, c("_end")).alias("end_jdn"),
        F.when(good, precision("1")).alias("start_prec"),
        F.when(good, precision("2")).alias("end_prec"),
        c("_error").alias("error"),
    )
    return df.select(*[x for x in given if x != name], parsed.alias(name))
