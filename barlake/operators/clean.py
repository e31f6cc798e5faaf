"""Cleaning steps over bars: decode dates, scale to fixed point, cast, fill what is missing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timeutil
from . import quantiles

PRICES = ["open", "high", "low", "close"]
OHLCV = [*PRICES, "volume", "amount"]
KEEP = ("sid", "datetime", "tick")
#: Security kinds by their ids, in the order in which they are tried.
KINDS = (("stock", "^(6|0|3)[0-9]{5}"), ("fund", "^(51|15|16)[0-9]{4}"), ("benchmark", "^(1A0001|1B0688|2A01|399006)"))
#: Index codes as vendor files have them, and those of the lake.
CODES = {"SH.000001": "SH.1A0001", "SH.000688": "SH.1B0688", "SZ.399001": "SZ.2A01", "SZ.399006": "SZ.399006"}


def _numeric(df: DataFrame, but: tuple[str, ...] = KEEP) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def decode_packed(df: DataFrame, dates: str = "dates", minutes: str = "sub_dates", strict: bool = True) -> DataFrame:
    """Packed day and minute of day to datetime (local) and tick (epoch seconds), which replace them."""
    d, m = F.col(dates).cast("int"), F.col(minutes).cast("int")
    make = F.make_timestamp_ntz if strict else F.try_make_timestamp_ntz
    day = d % 2048
    local = make((F.floor(d / 2048) + 2004).cast("int"), F.floor(day / 100).cast("int"), (day % 100).cast("int"), F.floor(m / 60).cast("int"), (m % 60).cast("int"), F.lit(0))
    df = df.withColumn("datetime", local)
    return df.withColumn("tick", F.unix_timestamp(timeutil.local_to_utc(F.col("datetime")).cast("timestamp"))).drop(dates, minutes)


def parse_text_date(df: DataFrame, column: str = "datetime", strptime: str = "%Y-%m-%d %H:%M:%S", tick_mode: str = "utc", strict: bool = True) -> DataFrame:
    """Text to datetime (local) and tick: the true epoch, or with "wallclock" the epoch of the local clock read as UTC. Text
    that is no date raises, or, if not strict, is null."""
    pattern = timeutil.pattern_of(strptime)
    parsed = F.to_timestamp_ntz(F.col(column), F.lit(pattern)) if strict else F.try_to_timestamp(F.col(column), F.lit(pattern)).cast("timestamp_ntz")
    df = df.withColumn("datetime", parsed)
    clock = F.unix_timestamp(F.col("datetime").cast("timestamp"))
    return df.withColumn("tick", clock if tick_mode == "wallclock" else F.unix_timestamp(timeutil.local_to_utc(F.col("datetime")).cast("timestamp")))


def scale(df: DataFrame, by: float | dict[str, float], exclude: tuple[str, ...] = KEEP) -> DataFrame:
    """Multiply and cut to whole numbers (toward zero): all numeric columns but some, or those of a map."""
    factors = by if isinstance(by, dict) else dict.fromkeys(_numeric(df, exclude), by)
    return df.withColumns({c: (F.col(c) * F.lit(k)).cast("long") for c, k in factors.items()})


def cast_columns(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Cast the listed columns that are there (by default prices, volume and amount to long)."""
    types = types or dict.fromkeys(OHLCV, "long")
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def normalize_types(df: DataFrame) -> DataFrame:
    """Timestamps lose their zone; what is no number, text, date, binary or boolean becomes text. Nulls stay."""
    plain = (T.NumericType, T.StringType, T.TimestampNTZType, T.DateType, T.BooleanType, T.BinaryType)
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            out[f.name] = F.col(f.name).cast("timestamp_ntz")
        elif not isinstance(f.dataType, plain):
            out[f.name] = F.col(f.name).cast("string")
    return df.withColumns(out) if out else df


def clean_sid(sid: Column) -> Column:
    """An id without a market's prefix or suffix: SH.2A01 and 600000.SH."""
    return F.regexp_replace(F.regexp_replace(sid, r"^[a-zA-Z]+\.", ""), r"\.[a-zA-Z]+$", "")


def remap(df: DataFrame, column: str, codes: dict[str, str]) -> DataFrame:
    """Replace values that a map has; keep the others."""
    pairs = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return df.withColumn(column, F.coalesce(pairs[F.col(column)], F.col(column)))


def fill_na(df: DataFrame, value: float = 0, exclude: tuple[str, ...] = ("tick",)) -> DataFrame:
    """Null and NaN of numeric columns to a constant."""
    return df.na.fill(value, _numeric(df, exclude))


#: Statistics by the names that numpy has for them; those that pass over NaN are the same here, as NaN is never counted.
REDUCERS = {
    "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_pop, "var": F.var_pop, "prod": F.product,
    "average": F.avg, "amin": F.min, "amax": F.max, "ptp": lambda c: F.max(c) - F.min(c), "count_nonzero": lambda c: F.count_if(F.col(c) != 0).cast("double"), "size": lambda c: F.count(c).cast("double"),
}
REDUCERS |= {f"nan{x}": REDUCERS[x] for x in ("mean", "median", "min", "max", "sum", "std", "var", "prod")}


def fill_inf(df: DataFrame, how: str = "mean", columns: list[str] | None = None, by: str = "sid", hot_rows: int = quantiles.HOT_ROWS) -> DataFrame:
    """Infinite, NaN and null values to a statistic of the rest of the group; 0 for a name that numpy lacks. A function of
    numpy that is no statistic here is an error.

    The statistic is aggregated (map-side first) and joined, so a hot group isn't brought into one task; medians of groups
    of more than `hot_rows` rows are found by selection.
    """
    columns = columns or [c for c in OHLCV if c in df.columns]
    known = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    if how not in REDUCERS and hasattr(np, how):
        raise NotImplementedError(f"numpy.{how} isn't a statistic of a column here")
    if how not in REDUCERS:
        return df.withColumns({c: F.coalesce(known(c), F.lit(0.0)) for c in columns})
    values = df.select(F.col(by).alias(f"{by}_of"), *(known(c).alias(c) for c in columns))
    if how in ("median", "nanmedian"):
        held = quantiles.medians(values, f"{by}_of", columns, hot_rows)
    else:
        held = values.groupBy(f"{by}_of").agg(*(REDUCERS[how](c).alias(f"{c}_fill") for c in columns))
    out = df.join(held, F.col(by).eqNullSafe(F.col(f"{by}_of")), "left")
    return out.withColumns({c: F.coalesce(known(c), F.col(f"{c}_fill")) for c in columns}).select(df.columns)


def encode_text(df: DataFrame, columns: list[str], charset: str = "UTF-8") -> DataFrame:
    """Text columns to bytes; null stays."""
    return df.withColumns({c: F.encode(F.col(c), charset) for c in columns})


def decode_text(df: DataFrame, columns: list[str], charset: str = "UTF-8") -> DataFrame:
    """Byte columns to text; null stays."""
    return df.withColumns({c: F.decode(F.col(c), charset) for c in columns})


def drop_na(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without null or NaN in the given columns (by default in any)."""
    return df.na.drop(subset=columns)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def kind_of(sid: Column, benchmark_first: bool = False) -> Column:
    """stock, fund or benchmark by the first pattern that an id matches; null if none does."""
    kinds = sorted(KINDS, key=lambda k: k[0] != "benchmark") if benchmark_first else KINDS
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(kinds):
        out = F.when(sid.rlike(pattern), kind).otherwise(out)
    return out


def classify(df: DataFrame, benchmark_first: bool = False) -> DataFrame:
    """Add type and drop rows whose id has none."""
    return df.withColumn("type", kind_of(F.col("sid"), benchmark_first)).where("type is not null")


def partition_keys(df: DataFrame) -> DataFrame:
    """year, quarter, date (YYYYMM) from local time; a clean sid; then datetime as a UTC instant."""
    at = F.col("datetime")
    keys = {"year": F.year(at).cast("string"), "quarter": F.concat(F.lit("Q"), F.quarter(at).cast("string")), "date": F.date_format(at, "yyyyMM"), "sid": clean_sid(F.col("sid"))}
    return df.withColumns(keys).withColumn("datetime", timeutil.local_to_utc(at).cast("timestamp"))


def dedup_first(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """The first row, in an order, of each key."""
    rank = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("row_rank", F.row_number().over(rank)).where("row_rank = 1").drop("row_rank")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, by `order` from most wanted on."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("row_rank", F.row_number().over(rank)).where("row_rank = 1").drop("row_rank")


def steps(df: DataFrame, *functions, enabled: dict[int, bool] | None = None) -> DataFrame:  # noqa: ANN002
    """Apply functions from DataFrame to DataFrame in turn; a step that `enabled` turns off is left out."""
    for i, f in enumerate(functions):
        if (enabled or {}).get(i, True):
            df = df.transform(f)
    return df
