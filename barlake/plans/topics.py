"""Topic queries: minute bars, daily bars, closes, instruments, dividends and rights, by dates and ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import lake

Sids = list[str] | DataFrame | None


def chosen(bars: DataFrame, start: int, end: int, sids: Sids = None) -> DataFrame:
    """Bars (datetime is an instant) of the given ids in a range; none without ids. Of a lake only the folders that the range
    and the ids ask for are read."""
    return lake.with_sids(lake.within(bars, start, end), sids) if sids is not None else bars.limit(0)


def tick(bars: DataFrame, start: int, end: int, sids: Sids = None) -> DataFrame:
    """Bars of the given ids in a range, ordered by sid and tick."""
    return chosen(bars, start, end, sids).orderBy("sid", "tick")


def roll_up(bars: DataFrame, at: Column, order: list[str]) -> DataFrame:
    """Daily bars: first open, highest high, lowest low, last close, sums of volume and amount."""
    first, last = F.struct(*order), F.struct(*order)
    return bars.groupBy("sid", at.cast("date").alias("day")).agg(
        F.min_by("open", first).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", last).alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")
    )


def closes(bars: DataFrame, at: Column, order: list[str]) -> DataFrame:
    """The last close of each id and day."""
    return bars.groupBy("sid", at.cast("date").alias("day")).agg(F.max_by("close", F.struct(*order)).alias("close"))


def local(instant: Column) -> Column:
    return F.from_utc_timestamp(instant, "Asia/Shanghai")


def daily(bars: DataFrame, start: int, end: int, sids: Sids = None) -> DataFrame:
    return roll_up(chosen(bars, start, end, sids), local(F.col("datetime")), ["datetime", "tick"])


def close(bars: DataFrame, start: int, end: int, sids: Sids = None) -> DataFrame:
    return closes(chosen(bars, start, end, sids), local(F.col("datetime")), ["datetime", "tick"])


def asset(assets: DataFrame, start: int, end: int, sids: Sids = None) -> DataFrame:
    """Instruments: the given ids whatever the range, or else those first traded in the range."""
    found = assets.where(F.col("first_trading").between(start, end)) if sids is None else lake.with_sids(assets, sids)
    return found.select("sid", "name", "first_trading", "delist", "merger", "ratio")


def fixed_point(value: Column, by: int = 1000, half_even: bool = False) -> Column:
    return (F.rint(value * by) if half_even else F.round(value * by)).cast("int")


def _actions(table: DataFrame, start: int, end: int, sids: Sids, values: list[str], half_even: bool) -> DataFrame:
    found = lake.with_sids(table.where(F.col("ex_date").between(start, end)), sids)
    return found.select("sid", "ex_date", "register_date", *(fixed_point(F.col(v), half_even=half_even).alias(v) for v in values)).orderBy("sid", "ex_date")


def adjust(table: DataFrame, start: int, end: int, sids: Sids = None, half_even: bool = False) -> DataFrame:
    """Dividends by ex-date, in thousandths."""
    return _actions(table, start, end, sids, ["bonus_share", "transfer", "bonus"], half_even)


def right(table: DataFrame, start: int, end: int, sids: Sids = None, half_even: bool = False) -> DataFrame:
    """Rights issues by ex-date, in thousandths."""
    return _actions(table, start, end, sids, ["price", "ratio"], half_even)


TOPICS: dict[str, Callable[..., DataFrame]] = {"tick": tick, "daily": daily, "close": close, "asset": asset, "adjust": adjust, "right": right}


def fetch(topic: str, table: DataFrame, start: int, end: int, sids: Sids = None) -> DataFrame:
    """A topic by name; an unknown one raises KeyError. Add to TOPICS for more."""
    return TOPICS[topic](table, start, end, sids)
