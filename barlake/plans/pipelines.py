"""Named pipelines from vendor files to the lake."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, master, quantiles
from ..sources import lake, readers

#: Headers of vendor CSV files and the columns they become.
STOCK_HEADER = {"日期": "datetime", "代码": "sid", "开盘价": "open", "最高价": "high", "最低价": "low", "收盘价": "close", "成交量（手）": "volume", "成交额（元）": "amount"}
BENCHMARK_HEADER = {k: v for k, v in STOCK_HEADER.items() if v not in ("volume", "amount")} | {"成交量": "volume", "成交金额": "amount"}
#: Fixed-point factors by pipeline.
STOCK_SCALE = dict.fromkeys(clean.PRICES, 100000) | {"volume": 100000, "amount": 1000}
FUND_SCALE = STOCK_SCALE | {"volume": 1000}
BENCHMARK_SCALE = STOCK_SCALE | {"volume": 1, "amount": 1}


def _to_lake(df: DataFrame, root: str, kind: str, append: bool) -> None:
    lake.write_lake(clean.partition_keys(df).withColumn("type", F.lit(kind)), root, append, lead=f"type={kind}")


def bad_binary(spark: SparkSession, source: str, kind: str) -> DataFrame:
    """path, reason and n_rows of binary files with bars whose day or minute doesn't exist."""
    bars = readers.read_binary_bars(spark, source, readers.FILE_NAMES[f"bin_{kind}"], dedup=False, paths=True)
    odd = clean.decode_packed(bars.select("path", "dates", "sub_dates"), strict=False).where("datetime is null")
    return odd.groupBy("path").agg(F.lit("no such time").alias("reason"), F.count("*").alias("n_rows"))


def bad_csv(spark: SparkSession, source: str, kind: str, header: dict[str, str]) -> DataFrame:
    """path, reason and n_rows of CSV files with rows whose time or whose numbers can't be read; a row with both counts for
    its time."""
    pattern = readers.FILE_NAMES["csv_any" if kind == "benchmark" else f"csv_{kind}"]
    rows = readers.read_csv_bars(spark, source, header, pattern=pattern, dedup=False, place=True)
    numbers = [c for c in rows.columns if c not in ("datetime", "sid", "row_place")]
    no_number = reduce(lambda a, b: a | b, (F.col(c).isNotNull() & F.col(c).try_cast("double").isNull() for c in numbers), F.lit(False))
    rows = rows.withColumn("text", F.col("datetime")).transform(partial(clean.parse_text_date, strict=False))
    no_time = F.col("text").isNotNull() & F.col("datetime").isNull()
    reason = F.when(no_time, "no such time").when(no_number, "no number")
    odd = rows.select(F.col("row_place.path").alias("path"), reason.alias("reason")).where("reason is not null")
    return odd.groupBy("path").agg(F.max("reason").alias("reason"), F.count("*").alias("n_rows"))


def _set_aside(found: Callable[[], DataFrame], on_error: str) -> DataFrame | None:
    """The bad files of a load that skips them, looked for once."""
    if on_error not in ("raise", "skip"):
        raise ValueError(f"on_error is raise or skip, not {on_error}")
    return quantiles.written(found(), "bad_files") if on_error == "skip" else None


def load_binary(spark: SparkSession, source: str, root: str, kind: str, append: bool = False, on_error: str = "raise") -> DataFrame | None:
    """Binary bars: decode, parse, scale by 1000, cast, write.

    With on_error="skip" files with a bar that can't be decoded are left out whole, and returned (see bad_binary()); that
    takes one more pass over the files.
    """
    bad = _set_aside(lambda: bad_binary(spark, source, kind), on_error)
    bars = readers.read_binary_bars(spark, source, readers.FILE_NAMES[f"bin_{kind}"], skip=bad)
    _to_lake(clean.steps(bars, clean.decode_packed, partial(clean.scale, by=1000), clean.cast_columns), root, kind, append)
    return bad


def load_csv(spark: SparkSession, source: str, root: str, kind: str, header: dict[str, str], factors: dict[str, float], append: bool = False, tick_mode: str = "utc", on_error: str = "raise") -> DataFrame | None:
    """CSV bars of the files of a kind: rename, parse, scale by column, cast, write. Index codes become the lake's. on_error
    is as for load_binary(); see bad_csv()."""
    types = {"datetime": "string", "sid": "string"}
    bad = _set_aside(lambda: bad_csv(spark, source, kind, header), on_error)
    bars = readers.read_csv_bars(spark, source, header, pattern=readers.FILE_NAMES["csv_any" if kind == "benchmark" else f"csv_{kind}"], skip=bad)
    if kind == "benchmark":
        bars = clean.remap(bars, "sid", clean.CODES)
    bars = bars.withColumns({c: F.col(c).cast(types.get(c, "double")) for c in bars.columns})
    _to_lake(clean.steps(bars, partial(clean.parse_text_date, tick_mode=tick_mode), partial(clean.scale, by=factors), clean.cast_columns), root, kind, append)
    return bad


def stock_bin(spark: SparkSession, source: str, root: str, append: bool = False, on_error: str = "raise") -> DataFrame | None:
    return load_binary(spark, source, root, "stock", append, on_error)


def fund_bin(spark: SparkSession, source: str, root: str, append: bool = False, on_error: str = "raise") -> DataFrame | None:
    return load_binary(spark, source, root, "fund", append, on_error)


def stock_csv(spark: SparkSession, source: str, root: str, append: bool = False, tick_mode: str = "utc", on_error: str = "raise") -> DataFrame | None:
    return load_csv(spark, source, root, "stock", STOCK_HEADER, STOCK_SCALE, append, tick_mode, on_error)


def fund_csv(spark: SparkSession, source: str, root: str, append: bool = False, tick_mode: str = "utc", on_error: str = "raise") -> DataFrame | None:
    return load_csv(spark, source, root, "fund", STOCK_HEADER, FUND_SCALE, append, tick_mode, on_error)


def benchmark_csv(spark: SparkSession, source: str, root: str, append: bool = False, tick_mode: str = "utc", on_error: str = "raise") -> DataFrame | None:
    return load_csv(spark, source, root, "benchmark", BENCHMARK_HEADER, BENCHMARK_SCALE, append, tick_mode, on_error)


def asset_load(spark: SparkSession, source: str, table: DataFrame) -> DataFrame:
    """The security master with the rows of CSV files added."""
    schema = "sid string, name string, first_trading int, delist int, merger string, ratio float"
    return master.append(table, master.cleaned(spark.read.schema(schema).option("header", "true").csv(source)))
