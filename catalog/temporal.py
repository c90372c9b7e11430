"""Datetime profiles."""

from __future__ import annotations

from catalog.registry import EVENTS, LINEITEM, ORDERS, Source, query
from catalog.sql import pct, union
from plumbline.operators import charts, temporal

# Text dates of which every tenth cannot be read, and some are missing.
DIRTY_SQL = (
    "(SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'junk' WHEN event_id % 17 = 5 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"
    " AS seen, event_type FROM events)"
)
DIRTY = Source(
    "events",
    "event_id",
    "CASE WHEN event_id % 10 = 3 THEN 'junk' WHEN event_id % 17 = 5 THEN NULL ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS seen",
    "event_type",
    order_by="event_id",
)
_PARSED = f"(SELECT event_id, try_strptime(seen, '%Y-%m-%d %H:%M:%S') AS seen FROM {DIRTY_SQL})"
US_DATES_SQL = "(SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS placed FROM orders)"
US_DATES = Source("orders", "o_orderkey", "date_format(o_orderdate, 'MM/dd/yyyy') AS placed", order_by="o_orderkey")

# (source, column, readable instant)
_COLUMNS = {
    "orders": ("orders", "o_orderdate"),
    "lineitem": ("lineitem", "l_shipdate"),
    "events": ("events", "ts"),
    "dirty": (_PARSED, "seen"),
}


@query(
    "detect_native_datetime",
    union(
        f"SELECT '{c}' AS column_name, {c == 'ts'} AS detected, {chr(39) + 'native' + chr(39) if c == 'ts' else 'NULL'} AS format,"
        f" {pct(f'count({c})', 'count(*)') if c == 'ts' else '0.0::DOUBLE'} AS parse_success FROM events HAVING count(*) > 0"
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
)
def detect_native_datetime(spark, sf_dir):
    return temporal.detect_datetime(EVENTS.profile(spark, sf_dir))


@query(
    "detect_string_datetime",
    union(
        f"SELECT '{c}' AS column_name, {c == 'seen'} AS detected, {chr(39) + 'YYYY-MM-DD' + chr(39) if c == 'seen' else 'NULL'} AS format,"
        f" {pct(f'count({c})', 'count(*)') if c == 'seen' else '0.0::DOUBLE'} AS parse_success FROM {src} HAVING count(*) > 0"
        for c, src in (("event_id", DIRTY_SQL), ("seen", _PARSED), ("event_type", DIRTY_SQL))
    ),
)
def detect_string_datetime(spark, sf_dir):
    return temporal.detect_datetime(DIRTY.profile(spark, sf_dir))


def _head_over_12(sql: str) -> str:
    return f"(SELECT CAST(split_part(placed, '/', 1) AS INTEGER) FROM {sql} ORDER BY o_orderkey LIMIT 1) > 12"


@query(
    "date_format_label",
    f"SELECT 'placed' AS column_name, CASE WHEN {_head_over_12(US_DATES_SQL)} THEN 'DD/MM/YYYY' ELSE 'MM/DD/YYYY' END AS format,"
    f" {pct(f'count(try_strptime(placed, {chr(39)}%m/%d/%Y{chr(39)}))', 'count(*)')} AS parse_success FROM {US_DATES_SQL}",
)
def date_format_label(spark, sf_dir):
    found = temporal.detect_datetime(US_DATES.profile(spark, sf_dir)).where("detected")
    return found.select("column_name", "format", "parse_success")


def _range(source: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, strftime(min({c}), '%Y-%m-%d') AS earliest_date, strftime(max({c}), '%Y-%m-%d') AS latest_date FROM {source}"
    )


@query("date_range", _range(*_COLUMNS["orders"]))
def date_range(spark, sf_dir):
    return temporal.date_range(ORDERS.profile(spark, sf_dir))


@query("date_range_lineitem", _range(*_COLUMNS["lineitem"]))
def date_range_lineitem(spark, sf_dir):
    return temporal.date_range(LINEITEM.frame(spark, sf_dir).select("l_shipdate"))


def _plural(n: str, unit: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {n} || ' {unit}' || CASE WHEN {n} > 1 THEN 's' ELSE '' END END"


def _span(source: str, c: str) -> str:
    return (
        f"SELECT column_name, total_days, years, months, days, CASE WHEN total_days = 0 THEN '0 Day' ELSE concat_ws(' ',"
        f" {_plural('years', 'Year')}, {_plural('months', 'Month')}, {_plural('days', 'Day')}) END AS duration FROM (SELECT '{c}' AS column_name,"
        f" date_sub('day', min({c}), max({c})) AS total_days, total_days // 365 AS years, (total_days % 365) // 30 AS months,"
        f" (total_days % 365) % 30 AS days FROM {source})"
    )


@query("time_span", _span(*_COLUMNS["orders"]))
def time_span(spark, sf_dir):
    return temporal.time_span(ORDERS.profile(spark, sf_dir))


@query("time_span_events", _span(*_COLUMNS["events"]))
def time_span_events(spark, sf_dir):
    return temporal.time_span(EVENTS.frame(spark, sf_dir).select("ts"))


def _missing(source: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_dates, {pct(f'count(*) - count({c})', 'count(*)')} AS missing_percentage"
        f" FROM {source}"
    )


@query("missing_timestamps", _missing(*_COLUMNS["dirty"]))
def missing_timestamps(spark, sf_dir):
    return temporal.missing_timestamps(DIRTY.profile(spark, sf_dir))


def _repeated(source: str, c: str) -> str:
    repeats = f"count(*) - count(DISTINCT {c}) - CAST(count(*) > count({c}) AS BIGINT)"
    return f"SELECT '{c}' AS column_name, {repeats} AS duplicate_timestamps, {pct(repeats, 'count(*)')} AS duplicate_percentage FROM {source}"


@query("duplicate_timestamps", _repeated(*_COLUMNS["orders"]))
def duplicate_timestamps(spark, sf_dir):
    return temporal.duplicate_timestamps(ORDERS.profile(spark, sf_dir))


@query("duplicate_timestamps_gaps", _repeated(*_COLUMNS["dirty"]))
def duplicate_timestamps_gaps(spark, sf_dir):
    return temporal.duplicate_timestamps(DIRTY.profile(spark, sf_dir))


_PARTS = {
    "year": ("year({c})", "CAST(year({c}) AS VARCHAR)"),
    "month": ("month({c})", "monthname({c})"),
    "quarter": ("quarter({c})", "'Q' || quarter({c})"),
    "weekday": ("isodow({c}) - 1", "dayname({c})"),
}


def _records(source: str, c: str, part: str) -> str:
    position, text = (e.format(c=c) for e in _PARTS[part])
    return (
        f"SELECT '{c}' AS column_name, CAST({position} AS INTEGER) AS position, {text} AS period, count(*) AS records FROM {source}"
        f" WHERE {c} IS NOT NULL GROUP BY 2, 3"
    )


def _register_records(part: str) -> None:
    @query(f"records_per_{part}", _records(*_COLUMNS["orders"], part))
    def orders(spark, sf_dir):
        return temporal.records_per(ORDERS.profile(spark, sf_dir), part)

    @query(f"records_per_{part}_gaps", _records(*_COLUMNS["dirty"], part))
    def dirty(spark, sf_dir):
        return temporal.records_per(DIRTY.profile(spark, sf_dir), part)


for _part in _PARTS:
    _register_records(_part)


def _seasonal(source: str, c: str) -> str:
    def pick(part: str, order: str) -> str:
        return f"(SELECT period FROM ({_records(source, c, part)}) ORDER BY records {order}, position LIMIT 1)"

    return (
        f"SELECT '{c}' AS column_name, {pick('year', 'DESC')} AS most_active_year, {pick('month', 'DESC')} AS most_active_month,"
        f" {pick('month', 'ASC')} AS least_active_month, {pick('quarter', 'DESC')} AS most_active_quarter, {pick('weekday', 'DESC')}"
        f" AS most_active_weekday FROM (SELECT count(*) FROM {source})"
    )


@query("seasonality", _seasonal(*_COLUMNS["orders"]))
def seasonality(spark, sf_dir):
    return temporal.seasonality(ORDERS.profile(spark, sf_dir))


def _trend(source: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, CASE WHEN late > early * 1.1 THEN 'Increasing Trend' WHEN late < early * 0.9 THEN 'Decreasing Trend'"
        " ELSE 'Stable' END AS trend FROM (SELECT avg(records) FILTER (WHERE i < half) AS early, avg(records) FILTER (WHERE i >= half) AS late"
        f" FROM (SELECT records, row_number() OVER (ORDER BY position) - 1 AS i, count(*) OVER () // 2 AS half FROM ({_records(source, c, 'year')})))"
    )


@query("yearly_trend", _trend(*_COLUMNS["orders"]))
def yearly_trend(spark, sf_dir):
    return temporal.yearly_trend(ORDERS.profile(spark, sf_dir))


@query("yearly_trend_events", _trend(*_COLUMNS["events"]))
def yearly_trend_events(spark, sf_dir):
    """A single year is stable."""
    return temporal.yearly_trend(EVENTS.frame(spark, sf_dir).select("ts"))


def _summary(source: str, c: str, label: str) -> str:
    parts = [_range(source, c), _span(source, c), _missing(source, c), _repeated(source, c), _seasonal(source, c), _trend(source, c)]
    joined = " JOIN ".join(f"({q})" + (" USING (column_name)" if i else "") for i, q in enumerate(parts))
    good = pct(f"count({c})", "count(*)")
    return f"SELECT *, '{label}' AS format, (SELECT {good} FROM {source}) AS parse_success FROM {joined}"


@query("datetime_summary", _summary(*_COLUMNS["orders"], "native"))
def datetime_summary(spark, sf_dir):
    return temporal.datetime_summary(ORDERS.profile(spark, sf_dir))


@query("datetime_summary_text", _summary(*_COLUMNS["dirty"], "YYYY-MM-DD"))
def datetime_summary_text(spark, sf_dir):
    return temporal.datetime_summary(DIRTY.profile(spark, sf_dir))


@query("datetime_summary_lineitem", _summary(*_COLUMNS["lineitem"], "native"))
def datetime_summary_lineitem(spark, sf_dir):
    return temporal.datetime_summary(LINEITEM.frame(spark, sf_dir))


def _finding(rule: str, value: str, message: str) -> str:
    return (
        f"SELECT 'datetime' AS rule_set, '{rule}' AS rule_id, column_name, 'info' AS severity, '{rule}' AS metric, CAST({value} AS DOUBLE) AS value,"
        f" {message} AS message FROM s"
    )


@query(
    "datetime_findings",
    f"WITH s AS ({_summary(*_COLUMNS['dirty'], 'YYYY-MM-DD')}) "
    + union(
        [
            _finding("span_days", "total_days", "CASE WHEN years > 0 THEN duration ELSE total_days || ' days' END || ' from ' || earliest_date || ' to ' || latest_date"),
            _finding(
                "missing_dates", "missing_dates",
                "CASE WHEN missing_dates = 0 THEN 'every row has a datetime' ELSE printf('%d rows without a datetime (%.2f %%)', missing_dates, missing_percentage) END",
            ),
            _finding("peak", "most_active_year", "'busiest: ' || most_active_year || ', ' || most_active_month || ', ' || most_active_weekday"),
        ]
    ),
)
def datetime_findings(spark, sf_dir):
    return temporal.datetime_findings(DIRTY.profile(spark, sf_dir))


@query(
    "datetime_bars",
    union(f"SELECT *, '{part}' AS part FROM ({_records(*_COLUMNS['orders'], part)})" for part in ("year", "month", "weekday")),
)
def datetime_bars(spark, sf_dir):
    return charts.datetime_bars(ORDERS.profile(spark, sf_dir))


