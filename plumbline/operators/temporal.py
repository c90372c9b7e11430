"""Datetime columns: detection, range, span, activity by calendar part, seasonality and trend."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rounding import percent
from plumbline.functions.types import STRING, ColumnInfo, quoted
from plumbline.plans.small import local, pinned
from plumbline.profile import Profile, as_profile

SAMPLE = 50
# No datetime text that any pattern below can read has more characters.
LONGEST = 40
MICROS_PER_DAY = 86_400_000_000
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Shape of a first value -> pattern that all values must then follow.
_DATES = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{1,2} [A-Z][a-z]{2} \d{4}", "d MMM yyyy"),
    (r"[A-Z][a-z]{2} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"),
    (r"\d{1,2}-[A-Z][a-z]{2}-\d{4}", "d-MMM-yyyy"),
    (rf"({'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}}".replace("(", "(?:"), "MMMM d, yyyy"),
    (rf"\d{{1,2}} ({'|'.join(MONTHS)}) \d{{4}}".replace("(", "(?:"), "d MMMM yyyy"),
    (r"\d{4}-\d{2}", "yyyy-MM"),
)
_TIMES = (
    ("", ""),
    (r"( |T)\d{6}", "HHmmss"),
    (r"( |T)\d{2}:\d{2}", "HH:mm"),
    (r"( |T)\d{2}:\d{2}:\d{2}", "HH:mm:ss"),
    (r"( |T)\d{2}:\d{2}:\d{2}\.\d{1,9}", "HH:mm:ss.SSSSSSSSS"),
    (r"( |T)\d{1,2}:\d{2} [AP]M", "h:mm a"),
    (r"( |T)\d{1,2}:\d{2}:\d{2} [AP]M", "h:mm:ss a"),
)
# A weekday may stand before a date with a month's name, in full or by its first three letters.
_WEEKDAY = re.compile(rf"(?:({'|'.join(WEEKDAYS)})|(?:{'|'.join(d[:3] for d in WEEKDAYS)})), ", re.IGNORECASE)
# What may follow a time of day.
_ZONES = (("", ""), (r"(?:Z|[+-]\d{2}:\d{2})", "XXX"), (r"[+-]\d{4}", "xx"))


# Begins the pattern of texts that have a weekday before the date.
WEEKDAY_MARK = "weekday:"


def named(value: str) -> str:
    """The text with every word of three letters or more capitalised, as patterns want names of months."""
    return re.sub(r"[A-Za-z]{3,}", lambda m: m[0].capitalize(), value)


def guess_pattern(value: str) -> str | None:
    """The datetime pattern a text follows, or None. Slashes and dashes put the month first unless it exceeds 12.

    Names of months and weekdays count in any case. A weekday before a date is skipped, whether or not it is the date's own.
    """
    weekday = _WEEKDAY.match(value)
    if weekday:
        rest = guess_pattern(value[weekday.end() :])
        return f"{WEEKDAY_MARK}{rest}" if rest and "MMM" in rest else None
    dates = list(_DATES)
    ambiguous = re.match(r"(\d{1,2})([/-])\d{1,2}[/-](\d{4}|\d{2})(?!\d)", value)
    if ambiguous:
        sep = ambiguous.group(2)
        day_first = int(ambiguous.group(1)) > 12
        year = "y" * len(ambiguous.group(3))
        pattern = sep.join(("d", "M", year) if day_first else ("M", "d", year))
        dates.append((rf"\d{{1,2}}{sep}\d{{1,2}}{sep}\d{{{len(year)}}}", pattern))
    for date_shape, date_pattern in dates:
        for time_shape, time_pattern in _TIMES:
            for zone_shape, zone_pattern in _ZONES if time_pattern else _ZONES[:1]:
                found = re.fullmatch(date_shape + time_shape + zone_shape, named(value))
                if found:
                    joint = "" if not time_pattern else "'T'" if found.group(1) == "T" else " "
                    return date_pattern + joint + time_pattern + zone_pattern
    return None


def format_label(value: str) -> str:
    """Name of the date format of a first value, as far as its separators tell."""
    head = value.split("-")[0]
    if "-" in value and len(head) == 4:
        return "YYYY-MM-DD"
    if "/" in value:
        head = value.split("/")[0]
        if len(head) == 4:
            return "YYYY/MM/DD"
        if head.strip().isdigit():
            return "DD/MM/YYYY" if int(head) > 12 else "MM/DD/YYYY"
    return "ISO8601 / Standard"


@dataclass(frozen=True)
class DatetimeColumn:
    """A datetime column and how to read it. ``parsed`` is a timestamp, null where missing or unreadable."""

    info: ColumnInfo
    label: str
    patterns: tuple[str, ...] = ()

    @property
    def parsed(self) -> Column:
        c = F.col(quoted(self.info.name))
        return _read(c, self.patterns) if self.patterns else c.cast("timestamp")


def _read(c: Column, patterns: tuple[str, ...]) -> Column:
    def one(pattern: str) -> Column:
        text = c
        if "MMM" in pattern:
            if pattern.startswith(WEEKDAY_MARK):
                # A text without a weekday, or with another word before the comma, does not follow such a pattern.
                text = F.when(text.rlike(rf"(?i)^{_WEEKDAY.pattern}"), F.regexp_replace(text, r"^[A-Za-z]+, ", ""))
            # The only words are the month, a joining T, AM or PM, and Z: lower letters but the first of each run.
            month = F.regexp_extract(text, r"[A-Za-z]{3,}", 0)
            text = F.when(month == "", text).otherwise(F.replace(text, month, F.initcap(month)))
        return F.try_to_timestamp(text, F.lit(pattern.removeprefix(WEEKDAY_MARK)))

    return F.coalesce(*[one(p) for p in patterns])


def _first_values(p: Profile) -> dict[str, list[str]]:
    """The first non-missing values of each string column, in row order if there is one.

    Columns without missing values share one look at the head of the table. Columns whose shortest value is longer
    than any datetime are left out.
    """
    facts = p.count_rows
    texts = [c for c in p.columns if c.family == STRING and facts[c.name]["non_null"] >= 3]
    texts = [c for c in texts if facts[c.name]["min_len"] <= LONGEST]

    def head(columns: list[ColumnInfo], df: DataFrame) -> dict[str, list[str]]:
        ordered = df.orderBy(*p.order()) if p.order_by else df
        rows = ordered.limit(SAMPLE).select(*[c.value().alias(f"v{c.ordinal}") for c in columns]).collect()
        return {c.name: [r[f"v{c.ordinal}"] for r in rows] for c in columns}

    full = [c for c in texts if facts[c.name]["null_count"] == 0]
    found = head(full, p.df) if full else {}
    for c in texts:
        if c not in full:
            found |= head([c], p.df.where(c.value().isNotNull()))
    return found


def _string_candidate(p: Profile, info: ColumnInfo, first: list[str]) -> DatetimeColumn | None:
    """The column with the pattern of its first value, if at least 75 % of its first values follow it.

    When the first value follows no known pattern, any pattern seen among the first values will do.
    """
    guessed = [guess_pattern(v) for v in first]
    patterns = tuple(dict.fromkeys(g for g in (guessed[:1] if guessed[0] else guessed) if g))
    if not patterns:
        return None
    sampled = local(p.spark, [(v,) for v in first], "v string")
    readable = sampled.where(_read(F.col("v"), patterns).isNotNull()).count()
    return DatetimeColumn(info, format_label(first[0]), patterns) if readable / len(first) >= 0.75 else None


def detect_datetime(table: DataFrame | Profile) -> DataFrame:
    """Per column: whether it holds datetimes, the format, and the share of rows that could be read.

    Text needs three values, and half of *all* rows readable under the format of the first value.
    """
    p = as_profile(table)
    found = {c.info.ordinal: (c, good) for c, good in _detected(p)}
    rows = [
        (c.ordinal, c.name, c.ordinal in found, *(_described(found[c.ordinal]) if c.ordinal in found else (None, 0)))
        for c in p.columns
    ]
    df = local(p.spark, rows, "ordinal int, column_name string, detected boolean, format string, good bigint")
    share = F.when(F.col("detected"), percent("good", str(p.n_rows))).otherwise(0.0)
    return df.select("column_name", "detected", "format", share.alias("parse_success"))


def _described(found) -> tuple[str, int]:
    column, good = found
    return column.label, good


def _detected(p: Profile) -> list[tuple[DatetimeColumn, int]]:
    """Detected columns with their readable rows, in schema order; found once per profile."""
    if "datetime_columns" in p.__dict__:
        return p.__dict__["datetime_columns"]
    out = [(DatetimeColumn(c, "native"), p.count_rows[c.name]["non_null"]) for c in p.datetimes]
    texts = [_string_candidate(p, p.column(name), values) for name, values in _first_values(p).items()]
    texts = [t for t in texts if t is not None]
    if texts:
        good = p.df.agg(*[F.count(t.parsed).alias(f"g{t.info.ordinal}") for t in texts]).first()
        for t in texts:
            n = good[f"g{t.info.ordinal}"]
            # the rounded share decides, as reported
            if p.n_rows and round(n / p.n_rows * 100, 2) >= 50.0:
                out.append((t, n))
    p.__dict__["datetime_columns"] = sorted(out, key=lambda d: d[0].info.ordinal)
    return p.__dict__["datetime_columns"]


def _long(p: Profile) -> DataFrame:
    """All parsed datetimes as rows ``(ordinal, ts)``; missing ones are null."""
    columns = [d for d, _ in _detected(p)]
    if not columns:
        return p.spark.createDataFrame([], "ordinal int, ts timestamp")
    cells = [x for d in columns for x in (F.lit(d.info.ordinal), d.parsed)]
    return p.df.select(F.stack(F.lit(len(columns)), *cells).alias("ordinal", "ts"))


def _calendar(p: Profile) -> DataFrame:
    """Rows per column, year, month and weekday: a few thousand rows at most, from one scan."""
    if "calendar" not in p.__dict__:
        day = F.col("ts").cast("date")
        p.__dict__["calendar"] = pinned(
            _long(p)
            .where("ts IS NOT NULL")
            .groupBy(
                "ordinal", F.year(day).alias("year"), F.month(day).alias("month"), F.weekday(day).alias("weekday")
            )
            .agg(F.count(F.lit(1)).alias("n"))
        )
    return p.__dict__["calendar"]


def _ranges(p: Profile) -> DataFrame:
    """Per datetime column: readable rows, first and last instant, and distinct instants."""
    if "datetime_ranges" not in p.__dict__:
        long = _long(p).select("ordinal", F.unix_micros("ts").alias("us")).where("us IS NOT NULL")
        folded = long.groupBy("ordinal", "us").agg(F.count(F.lit(1)).alias("n"))
        found = folded.groupBy("ordinal").agg(
            F.sum("n").alias("readable"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
            F.count(F.lit(1)).alias("ndv"),
        )
        names = p.counts.select("ordinal", "column_name", "n_rows")
        p.__dict__["datetime_ranges"] = pinned(names.join(found, "ordinal"))
    return p.__dict__["datetime_ranges"]


def _day_text(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def date_range(table: DataFrame | Profile) -> DataFrame:
    """Earliest and latest day per datetime column."""
    p = as_profile(table)
    return _ranges(p).select(
        "column_name", _day_text(F.col("first_us")).alias("earliest_date"), _day_text(F.col("last_us")).alias("latest_date")
    )


def _span_columns() -> dict[str, Column]:
    days = F.floor((F.col("last_us") - F.col("first_us")) / MICROS_PER_DAY)
    years, months, rest = F.floor(days / 365), F.floor((days % 365) / 30), (days % 365) % 30

    def part(n: Column, unit: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise("")))

    text = F.concat_ws(" ", part(years, "Year"), part(months, "Month"), part(rest, "Day"))
    return {
        "total_days": days,
        "years": years,
        "months": months,
        "days": rest,
        "duration": F.when(text == "", "0 Day").otherwise(text),
    }


def time_span(table: DataFrame | Profile) -> DataFrame:
    """Whole days between first and last instant, as years of 365 days, months of 30 days, and days."""
    p = as_profile(table)
    return _ranges(p).select("column_name", *[c.alias(n) for n, c in _span_columns().items()])


def missing_timestamps(table: DataFrame | Profile) -> DataFrame:
    """Rows without a readable datetime, and their share."""
    p = as_profile(table)
    return _ranges(p).select(
        "column_name", F.expr("n_rows - readable").alias("missing_dates"), percent("n_rows - readable", "n_rows").alias("missing_percentage")
    )


def duplicate_timestamps(table: DataFrame | Profile) -> DataFrame:
    """Rows that repeat an earlier instant, and their share. Missing instants equal each other."""
    p = as_profile(table)
    return _ranges(p).select(
        "column_name",
        F.expr(_REPEATED).alias("duplicate_timestamps"),
        percent(_REPEATED, "n_rows").alias("duplicate_percentage"),
    )


# Every row beyond the first of its instant; the missing ones are one more group.
_REPEATED = "n_rows - ndv - if(n_rows > readable, 1L, 0L)"


def _named(names: tuple[str, ...], position: Column) -> Column:
    return F.array(*[F.lit(n) for n in names])[position]


def _part(name: str) -> tuple[Column, Column]:
    """Sort key and text of a calendar part."""
    month, weekday = F.col("month"), F.col("weekday")
    quarter = F.floor((month - 1) / 3).cast("int") + 1
    return {
        "year": (F.col("year"), F.col("year").cast("string")),
        "month": (month, _named(MONTHS, month - 1)),
        "quarter": (quarter, F.concat(F.lit("Q"), quarter.cast("string"))),
        "weekday": (weekday, _named(WEEKDAYS, weekday)),
    }[name]


def records_per(table: DataFrame | Profile, part: str) -> DataFrame:
    """Rows per ``year``, ``quarter``, ``month`` or ``weekday`` (the last three over all years)."""
    p = as_profile(table)
    position, text = _part(part)
    names = p.counts.select("ordinal", "column_name")
    return (
        _calendar(p)
        .groupBy("ordinal", position.alias("position"), text.alias("period"))
        .agg(F.sum("n").alias("records"))
        .join(names, "ordinal")
        .select("column_name", "position", "period", "records")
    )


def _extremes(p: Profile, part: str) -> DataFrame:
    """The busiest and the quietest period; the earlier one in the calendar on ties."""
    counted = records_per(p, part)
    most = F.min(F.struct((-F.col("records")).alias("k"), "position", "period"))["period"]
    least = F.min(F.struct("records", "position", "period"))["period"]
    return counted.groupBy("column_name").agg(
        most.alias(f"most_active_{part}"), least.alias(f"least_active_{part}")
    )


def seasonality(table: DataFrame | Profile) -> DataFrame:
    """Busiest year, month, quarter and weekday, and the quietest month among those that occur."""
    p = as_profile(table)
    found = _extremes(p, "year")
    for part in ("month", "quarter", "weekday"):
        found = found.join(_extremes(p, part), "column_name")
    return found.select(
        "column_name", "most_active_year", "most_active_month", "least_active_month", "most_active_quarter",
        "most_active_weekday",
    )


def yearly_trend(table: DataFrame | Profile) -> DataFrame:
    """Mean yearly rows of the later half of the years against the earlier half, with a 10 % margin."""
    p = as_profile(table)
    years = records_per(p, "year")
    by_column = Window.partitionBy("column_name")
    halves = years.select(
        "column_name",
        "records",
        (F.row_number().over(by_column.orderBy("position")) - 1 < F.floor(F.count(F.lit(1)).over(by_column) / 2)).alias("early"),
    )
    means = halves.groupBy("column_name").agg(
        F.avg(F.when(F.col("early"), F.col("records"))).alias("early"),
        F.avg(F.when(~F.col("early"), F.col("records"))).alias("late"),
    )
    trend = (
        F.when(F.col("late") > F.col("early") * 1.1, "Increasing Trend")
        .when(F.col("late") < F.col("early") * 0.9, "Decreasing Trend")
        .otherwise("Stable")
    )
    return means.select("column_name", trend.alias("trend"))


def datetime_summary(table: DataFrame | Profile) -> DataFrame:
    """One row per datetime column with any readable value."""
    p = as_profile(table)
    formats = detect_datetime(p).where("detected").select("column_name", "format", "parse_success")
    return (
        formats.join(date_range(p), "column_name")
        .join(time_span(p), "column_name")
        .join(missing_timestamps(p), "column_name")
        .join(duplicate_timestamps(p), "column_name")
        .join(seasonality(p), "column_name")
        .join(yearly_trend(p), "column_name")
    )


def datetime_findings(table: DataFrame | Profile) -> DataFrame:
    """Span, missing instants and peak periods of each datetime column, as finding rows."""
    p = as_profile(table)
    s = datetime_summary(p)

    def finding(rule: str, value: Column, message: Column):
        return F.struct(
            F.lit("datetime").alias("rule_set"), F.lit(rule).alias("rule_id"), F.col("column_name"),
            F.lit("info").alias("severity"), F.lit(rule).alias("metric"), value.cast("double").alias("value"),
            message.alias("message"),
        )

    span = F.when(F.col("years") > 0, F.col("duration")).otherwise(F.format_string("%d days", "total_days"))
    rows = F.array(
        finding("span_days", F.col("total_days"), F.concat(span, F.lit(" from "), "earliest_date", F.lit(" to "), "latest_date")),
        finding(
            "missing_dates", F.col("missing_dates"),
            F.when(F.col("missing_dates") == 0, "every row has a datetime")
            .otherwise(F.format_string("%d rows without a datetime (%.2f %%)", "missing_dates", "missing_percentage")),
        ),
        finding(
            "peak", F.col("most_active_year"),
            F.format_string("busiest: %s, %s, %s", "most_active_year", "most_active_month", "most_active_weekday"),
        ),
    )
    return s.select(F.inline(rows))
