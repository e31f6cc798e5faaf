"""Order statistics of groups of any size: equal-count stretches of an order, and exact medians by selection.

Both start from a count of each group. Groups up to a bound are left to Spark's own functions; only the larger ones, of
which there are few, get quantile sketches (which combine map-side), so nothing here brings a hot group into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: Rows from which on a group is hot, its stretches at most, and the size of a sketch (its ranks are within 0.1 %).
HOT_ROWS, MOST_PARTS, SKETCH = 1_000_000, 512, 4096
#: Cut points of a round of selection.
CUTS = 64
#: Bytes of bounds that go to all tasks in a broadcast, by their counted groups.
BROADCAST_BYTES = 32 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """A frame written to the shared folder and read again: sketches are random, so what hangs on them is made once."""
    to = scratch(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"{k}_of"]) for k in keys))


def _fractions(parts: int) -> Column:
    return F.array(*(F.lit(i / parts) for i in range(1, parts)))


def bounds(df: DataFrame, group: list[str], order: str, rows: int = HOT_ROWS) -> tuple[DataFrame, int] | None:
    """{group}_of and stretch_bounds of the groups of more than `rows` rows: values of the order (as doubles) that cut a
    group into stretches of about equally many rows, on average at most `rows`, or as many as make `MOST_PARTS` of them; and
    the rows of the largest group's stretches. None if no group is that large."""
    of = [F.col(k).alias(f"{k}_of") for k in group]
    names = [f"{k}_of" for k in group]
    hot = df.groupBy(*of).agg(F.count("*").alias("group_rows")).where(F.col("group_rows") > rows)
    most, n = hot.agg(F.max("group_rows"), F.count("*")).first()
    if not n:
        return None
    parts = min(MOST_PARTS, -(-most // rows))
    hot = written(hot, "hot_groups")
    hot = F.broadcast(hot) if n * 64 <= BROADCAST_BYTES else hot
    sketched = df.select(*group, F.col(order).cast("double").alias("order_at")).join(hot, _same(df, hot, group))
    sketched = sketched.groupBy(*names, "group_rows").agg(F.kll_sketch_agg_double("order_at", F.lit(SKETCH)).alias("sketch"))
    found = sketched.withColumn("cuts", F.kll_sketch_get_quantile_double("sketch", _fractions(parts)))
    own = F.least(F.ceil(F.col("group_rows") / rows), F.lit(parts)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.get("cuts", F.greatest(F.ceil(i * parts / own).cast("int") - 1, F.lit(0))))
    found = written(found.select(*names, F.array_distinct(picked).alias("stretch_bounds")), "stretch_bounds")
    return F.broadcast(found) if n * (64 + 8 * parts) <= BROADCAST_BYTES else found, max(rows, -(-most // parts))


def stretches(df: DataFrame, group: list[str], order: str, rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """df with `stretch`, and about how many rows the longest holds, or 0 if no group is cut: the part of its group's order
    (a number or an instant) that a row lies in; rows without a value come first. A group of up to `rows` rows is one stretch. Rows of one value stay
    together, so a value that most rows have isn't cut."""
    found = bounds(df, group, order, rows)
    if found is None:
        return df.withColumn("stretch", F.lit(0)), 0
    found, longest = found
    at = F.col(order).cast("double")
    place = F.size(F.filter("stretch_bounds", lambda b: b <= at))
    stretch = F.when(F.col("stretch_bounds").isNull(), 0).when(at.isNull(), -1).otherwise(place)
    joined = df.join(found, _same(df, found, group), "left")
    return joined.select(*(df[c] for c in df.columns), stretch.cast("int").alias("stretch")), longest


def medians(df: DataFrame, by: str, columns: list[str], rows: int = HOT_ROWS) -> DataFrame:
    """by and {column}_fill: the exact median of each group's values (nulls don't count; df has no NaN).

    For groups of up to `rows` rows that is Spark's own. A larger group's values are cut at the quantiles of a sketch and
    counted; only the slot that holds the middle goes on, until it has few values or one value only.
    """
    small = lambda d: d.groupBy(by).agg(*(F.median(c).alias(f"{c}_fill") for c in columns))
    hot = df.groupBy(F.col(by).alias("hot_of")).agg(F.count("*").alias("group_rows")).where(F.col("group_rows") > rows)
    n = hot.count()
    if not n:
        return small(df)
    hot = written(hot.select("hot_of"), "hot_groups")
    hot = F.broadcast(hot) if n * 64 <= BROADCAST_BYTES else hot
    same = df[by].eqNullSafe(hot["hot_of"])
    cold = small(df.join(hot, same, "left_anti"))
    long = df.join(hot, same).select(F.col(by).alias("g"), F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x"))
    long = long.select("g", "x.c", "x.v").where("v is not null")
    found = selected(long, rows).groupBy("g").pivot("c", columns).agg(F.first("median"))
    every = hot.select(F.col("hot_of").alias("g"))  # a group without a value has no median
    found = every.join(found, every["g"].eqNullSafe(found["g"]), "left").select(every["g"].alias(by), *(F.col(c).alias(f"{c}_fill") for c in columns))
    return cold.unionByName(found)


def selected(values: DataFrame, rows: int) -> DataFrame:
    """g, c and median of values (g, c, v): distributed selection. Each round reads the values that are still in question."""
    keys = ["g", "c"]
    same = lambda a, b: a["g"].eqNullSafe(b["g"]) & (a["c"] == b["c"])
    state = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    # n: values in question; first and last: places of the middle ones among them, from 0
    state = written(state.select("*", F.floor((F.col("n") - 1) / 2).alias("first"), F.floor(F.col("n") / 2).alias("last")), "selection")
    done = []
    while True:
        done.append(state.where("low = high").select("g", "c", F.col("low").alias("median")))
        left = state.where("low < high")
        few, many = left.where(F.col("n") <= rows), left.where(F.col("n") > rows)
        inside = lambda s: values.join(s, same(values, s) & values["v"].between(s["low"], s["high"])).select(values["g"], values["c"], "v", "n", "first", "last")  # noqa: B023, E731
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1
        middle = inside(few).withColumn("place", place).where("place in (first, last)").groupBy(*keys)
        done.append(middle.agg((F.min("v") * 0.5 + F.max("v") * 0.5).alias("median")))
        if not many.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        open_ = inside(many)
        sketch = open_.groupBy(*keys).agg(F.kll_sketch_agg_double("v", F.lit(SKETCH)).alias("sketch"))
        cuts = written(sketch.select("g", "c", F.array_distinct(F.kll_sketch_get_quantile_double("sketch", _fractions(CUTS))).alias("cuts")), "cuts")
        # Values equal to a cut have a slot of their own, so ties end the search.
        slot = 2 * F.size(F.filter("cuts", lambda b: b < F.col("v"))) + F.exists("cuts", lambda b: b == F.col("v")).cast("int")
        slots = open_.join(F.broadcast(cuts), same(open_, cuts)).select(open_["g"], open_["c"], "v", "first", "last", slot.alias("slot"))
        slots = slots.groupBy("g", "c", "slot").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("first").alias("first"), F.first("last").alias("last"))
        before = F.sum("n").over(Window.partitionBy(*keys).orderBy("low").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        slots = written(slots.withColumn("before", before).where("last >= before and first < before + n"), "selection")
        one = slots.groupBy(*keys).agg(F.count("*").alias("slots"), F.min("high").alias("a"), F.max("low").alias("b"))
        # Between two slots the middle is the last value of one and the first of the other.
        done.append(one.where("slots = 2").select("g", "c", (F.col("a") * 0.5 + F.col("b") * 0.5).alias("median")))
        state = slots.where("last < before + n and first >= before").select("g", "c", "n", "low", "high", (F.col("first") - F.col("before")).alias("first"), (F.col("last") - F.col("before")).alias("last"))
