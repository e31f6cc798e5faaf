"""Dates and instants of the exchange: Shanghai local time, UTC instants, packed and integer dates.

The functions that take Python values translate request bounds; the others build columns.
"""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
SHIFT = 28800
LOCAL = timezone(timedelta(seconds=SHIFT))
#: Requests up to this are YYYYMMDD; beyond it epochs, by magnitude in ns, us, ms or s.
LAST_DATE = 99991231
MAGNITUDES = ((10**17, 10**9), (10**14, 10**6), (10**11, 10**3))
#: Seconds of the local day at which trading opens and closes.
OPEN, CLOSE = 34200, 54000


def epoch_seconds(value: int) -> int:
    return next((value // unit for least, unit in MAGNITUDES if value > least), value)


def flex_bound(value: int, is_end: bool = False) -> datetime:
    """A request's bound as an instant: the begin or end of a local day, or an epoch as it is."""
    if value <= LAST_DATE:
        day = datetime(value // 10000, value // 100 % 100, value % 100, tzinfo=LOCAL)
        return day + timedelta(seconds=86399 if is_end else 0)
    return datetime.fromtimestamp(epoch_seconds(value), UTC)


def months(start: int, end: int) -> list[str]:
    """YYYYMM of every local month that a request touches."""
    first, last = (flex_bound(x).astimezone(LOCAL) for x in (start, end))
    return [f"{m // 12:04d}{m % 12 + 1:02d}" for m in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]


def local_to_utc(ts: Column) -> Column:
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), ts)


def seconds_of(value: Column) -> Column:
    """Seconds of an epoch of any unit."""
    out = value
    for least, unit in reversed(MAGNITUDES):
        out = F.when(value > least, F.floor(value / unit)).otherwise(out)
    return out.cast("long")


def flex_date(value: Column) -> Column:
    """Local date of a YYYYMMDD integer or an epoch of any unit."""
    of_int = F.try_make_timestamp_ntz(F.floor(value / 10000).cast("int"), (F.floor(value / 100) % 100).cast("int"), (value % 100).cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    of_epoch = F.timestamp_seconds(seconds_of(value) + SHIFT).cast("date")
    return F.when(value <= LAST_DATE, F.when(value > 0, of_int)).otherwise(of_epoch)


def flex_bound_text(value: Column, is_end: bool = False) -> Column:
    """Text of a bound: a local day's first or last second at +08:00, or the epoch's second at +00:00."""
    clock = " 23:59:59+08:00" if is_end else " 00:00:00+08:00"
    day = F.concat(F.date_format(flex_date(value), "yyyy-MM-dd"), F.lit(clock))
    second = F.concat(F.date_format(F.timestamp_seconds(seconds_of(value)), "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    return F.when(value <= LAST_DATE, day).otherwise(second)


def num_to_datetime(n: Column) -> Column:
    """YYYYMMDD (1e7 to 3e7), epoch seconds (beyond 1e9) or a day number with a fraction; else the least date.

    Microseconds under 10 or over 999990 snap to the whole second.
    """
    least = F.expr("timestamp_ntz'0001-01-01 00:00:00'")
    day = F.try_make_timestamp_ntz(F.floor(n / 10000).cast("int"), (F.floor(n / 100) % 100).cast("int"), (F.floor(n) % 100).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    micros = F.round((n - F.floor(n)) * 86400 * 1000000).cast("long")
    rest = micros % 1000000
    micros = F.when(rest < 10, micros - rest).when(rest > 999990, micros - rest + 1000000).otherwise(micros)
    epoch_day = (F.floor(n).cast("long") - 719163) * 86400
    ordinal = F.timestamp_micros(epoch_day * 1000000 + micros).cast("timestamp_ntz")
    epoch = F.timestamp_seconds(F.floor(n).cast("long")).cast("timestamp_ntz")
    bad = n.isNull() | F.isnan(n.cast("double")) | (n <= 0)
    return F.when(bad, least).when((n > 1e7) & (n < 3e7), day).when(n > 1e9, epoch).otherwise(ordinal)


def datetime_to_num(ts: Column) -> Column:
    """Day number (1 for 0001-01-01) with the time, to the microsecond, as a fraction."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECONDS"), ts).cast("double")
    return F.datediff(ts, F.to_date(F.lit("0001-01-01"))) + F.lit(1) + seconds / F.lit(86400.0)


def epoch_to_intdate(epoch: Column, legacy: bool = False) -> Column:
    """Local YYYYMMDD of epoch seconds, 0 for null, NaN or not above 0. legacy shifts the other way."""
    shifted = F.timestamp_seconds(F.coalesce(epoch, F.lit(0)).cast("long") + (-SHIFT if legacy else SHIFT))
    bad = epoch.isNull() | F.isnan(epoch.cast("double")) | (epoch <= 0)
    return F.when(bad, 0).otherwise(F.date_format(shifted, "yyyyMMdd").cast("int"))


def intdate_to_epoch(value: Column, legacy: bool = False) -> Column:
    """Epoch seconds of a local YYYYMMDD's begin, 0 if not above 0. The inverse of epoch_to_intdate on days."""
    day = F.try_make_timestamp_ntz(F.floor(value / 10000).cast("int"), (F.floor(value / 100) % 100).cast("int"), (value % 100).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    seconds = F.unix_timestamp(day.cast("timestamp"))
    return F.when(value.isNull() | (value <= 0), F.lit(0).cast("long")).otherwise(seconds + (SHIFT if legacy else -SHIFT))


def session_bound(epoch: Column, at: int) -> Column:
    """Epoch seconds at which the local day of an instant reaches `at` seconds."""
    return (F.floor((epoch + SHIFT) / 86400) * 86400 - SHIFT + at).cast("long")


def ensure_utc(ts: Column, zone: str = "UTC") -> Column:
    """The UTC instant of a naive timestamp, text or date in a zone."""
    return F.to_utc_timestamp(ts.cast("timestamp_ntz").cast("timestamp"), zone or "UTC")


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("q"), F.quarter(day).cast("string"))


def in_intervals(df: DataFrame, at: str, intervals: DataFrame, low: str, high: str, bins: float) -> DataFrame:
    """Rows of df joined with the rows of intervals in which `at` lies: low <= at < high. Numbers only; cast instants.

    Intervals may have any length, overlap or leave gaps: each is put into all bins of width `bins` that it touches, rows
    into their own, and the join is one of equal bins. With bins about as wide as most intervals are, an interval is in two
    bins or so. Nulls lie nowhere, and an interval that ends before it begins holds nothing.
    """
    bin_of = lambda c: F.floor(c / bins)
    spans = intervals.where(F.col(low) < F.col(high)).withColumn("interval_bin", F.explode(F.sequence(bin_of(F.col(low)), bin_of(F.col(high)))))
    rows = df.withColumn("interval_bin", bin_of(F.col(at)))
    joined = rows.join(spans, "interval_bin").where((rows[at] >= spans[low]) & (rows[at] < spans[high]))
    return joined.drop("interval_bin")


def sums_in_intervals(df: DataFrame, at: str, value: str, intervals: DataFrame, key: str, low: str, high: str, bins: float) -> DataFrame:
    """{key}, n_rows and total of a value: over the rows of df that lie in the intervals of a key; keys without rows are left
    out. See in_intervals().

    Rows are first summed by their place, and intervals of equal ends are taken once, so what is joined grows with the
    different places and ends, not with the pairs of rows and intervals.
    """
    places = df.where(F.col(at).isNotNull()).groupBy(at).agg(F.count("*").alias("place_rows"), F.sum(value).alias("place_total"))
    spans = intervals.select(key, low, high).where(F.col(low) < F.col(high))
    found = in_intervals(places, at, spans.select(low, high).distinct(), low, high, bins)
    found = found.groupBy(low, high).agg(F.sum("place_rows").alias("place_rows"), F.sum("place_total").alias("place_total"))
    return spans.join(found, [low, high]).groupBy(key).agg(F.sum("place_rows").alias("n_rows"), F.sum("place_total").alias("total"))


def quarter_table(spark: SparkSession, start: date, end: date) -> DataFrame:
    """label, from_epoch and to_epoch (seconds) of all quarters of the local calendar that a span touches."""
    at = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=LOCAL).timestamp())
    return spark.createDataFrame([(label, at(a), at(b)) for label, a, b in quarter_bounds(start, end)], "label string, from_epoch long, to_epoch long")


def quarter_bounds(start: date, end: date) -> list[tuple[str, date, date]]:
    """Label, first day and next quarter's first day of all quarters that a span touches."""
    first, last = (d.year * 4 + (d.month - 1) // 3 for d in (start, end))
    begin = lambda q: date(q // 4, q % 4 * 3 + 1, 1)
    return [(f"{q // 4}q{q % 4 + 1}", begin(q), begin(q + 1)) for q in range(first, last + 1)]


#: Directives of strptime formats and the patterns that Spark has for them.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%f": "SSSSSS"}


def pattern_of(strptime: str) -> str:
    for directive, pattern in DIRECTIVES.items():
        strptime = strptime.replace(directive, pattern)
    return strptime
