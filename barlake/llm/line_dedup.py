"""Line deduplication by site-relative frequency: lines that stand on a large share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import cut, free_name, table

#: Share of a host's pages from which on a line is boilerplate, and pages that must hold it. On hosts with few pages any
#: repeat is a large share, so two copies of a page would lose all their lines without the second bound.
RATIO, LEAST_PAGES = 0.075, 3


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """Remove from each text the lines that at least `ratio` of its host's pages hold (and `least` pages).

    A line is compared without surrounding blanks and counted once a page; blank lines are kept and not counted; a row is
    a page, so repeated rows count. Rows with a null host form one site; a null text has no lines and stays null; a text
    without boilerplate stays as it is, byte for byte; one of boilerplate only becomes empty, and its row stays. Adds
    the number of lines and of dropped lines; other columns are kept.

    Counting shuffles two hashes for each distinct line of a task, not texts. The boilerplate of a host is small (at most
    lines per page / ratio), so texts meet it in a broadcast, if its counted size allows, or else in a join that Spark
    splits where a host is hot.
    """
    site, all_lines, keys, bad = (free_name(df, x) for x in ("site_key", "split_lines", "line_keys", "boilerplate"))
    key = lambda x: F.struct(F.xxhash64(F.trim(x)).alias("a"), F.hash(F.trim(x)).alias("b"))
    split = F.split(F.col(text), "\n", -1)
    seen = df.select(F.coalesce(F.col(host), F.lit("\0")).alias(site), F.array_distinct(F.transform(F.filter(split, lambda x: F.trim(x) != ""), key)).alias(keys))
    # The pages of a host are counted with its lines: one more key, null, stands for the page itself.
    page = F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:int>")), F.coalesce(F.col(keys), F.array().cast("array<struct<a:bigint,b:int>>")))
    counts = seen.select(site, F.explode(page).alias("k")).groupBy(site, "k").agg(F.count("*").alias("n")).where((F.col("n") >= least) | F.col("k").isNull())
    counts = cut(counts)
    pages = counts.where(F.col("k").isNull()).select(site, F.col("n").alias("pages"))
    common = counts.where(F.col("k").isNotNull()).join(pages, site).where(F.col("n") >= F.col("pages") * F.lit(ratio))
    found = cut(common.groupBy(site).agg(F.collect_list("k").alias(bad)))
    rows = found.agg(F.coalesce(F.sum(F.size(bad) + 4), F.lit(0))).first()[0]
    right = found.withColumnRenamed(site, f"{site}_r")
    right = F.broadcast(right) if rows * 24 <= 32 << 20 else right
    out = df.join(right, F.coalesce(df[host], F.lit("\0")) == right[f"{site}_r"], "left")
    # The few that a text has: found through a hash set, so a host's whole list isn't searched for each line.
    own = F.array_intersect(F.transform(split, key), F.col(bad))
    keep = lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(keys), key(x))
    out = out.withColumn(keys, own).withColumn(all_lines, split)
    has = F.coalesce(F.size(keys) > 0, F.lit(False))
    kept = F.when(has, F.filter(all_lines, keep)).otherwise(F.col(all_lines))
    out = out.withColumn(lines, F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines)))
    out = out.withColumn(dropped, F.when(has, F.size(all_lines) - F.size(kept)).otherwise(0))
    return out.withColumn(text, F.when(has, F.array_join(kept, "\n")).otherwise(F.col(text))).drop(keys, all_lines, bad, f"{site}_r")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without boilerplate; a document's `source` is its host (see host_of for pages with URLs)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs)


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, p, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM (SELECT *, row_number() OVER () AS p FROM documents)),
counts AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT p) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
bad AS (SELECT source, line FROM counts JOIN pages USING (source) WHERE n >= pages * {RATIO} AND n >= {LEAST_PAGES}),
marked AS (SELECT l.*, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.source = b.source AND trim(l.line, ' ') = b.line)
SELECT doc_id, any_value(source) AS source, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
  CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_dropped
FROM marked GROUP BY p, doc_id
"""
