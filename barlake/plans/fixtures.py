"""Views over the given tables that stand for the inputs of a market-data lake, as SQL that any engine reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Each view and the tables or views it reads.
VIEWS = {
    "bars": """SELECT CASE user_id % 4 WHEN 0 THEN '6' || lpad(CAST(user_id AS string),5,'0') WHEN 1 THEN '0' || lpad(CAST(user_id AS string),5,'0')
  WHEN 2 THEN '51' || lpad(CAST(user_id AS string),4,'0') ELSE '15' || lpad(CAST(user_id AS string),4,'0') END AS sid,
  event_id, ts AS datetime, value AS open, value * 1.02 AS high, value * 0.98 AS low, value AS close,
  event_id % 1000 AS volume, value * (event_id % 1000) AS amount FROM events""",
    # Bars of forty ids over several months, as a lake has them.
    "spread_bars": """SELECT substr(sid, 1, 2) || '000' || substr(sid, 6, 1) AS sid, event_id, datetime + (event_id % 3) * INTERVAL '31' DAY AS datetime, open, high, low, close, volume, amount FROM bars""",
    "packed": "SELECT event_id, (year(ts) - 2004) * 2048 + month(ts) * 100 + day(ts) AS dates, hour(ts) * 60 + minute(ts) AS sub_dates, ts FROM events",
    "dirty_bars": """SELECT sid, event_id, CASE WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 89 = 0 THEN CAST('NaN' AS DOUBLE)
  WHEN event_id % 83 = 0 THEN NULL ELSE close END AS close FROM bars""",
    "asset": """SELECT lpad(CAST(p_partkey AS string),6,'0') AS sid, p_name AS name, CAST(20000101 + p_partkey % 28 AS INT) AS first_trading,
  CASE WHEN p_partkey % 10 = 0 THEN 20200101 END AS delist, p_brand AS merger, CAST(p_size AS FLOAT) AS ratio FROM part""",
    "asset_update": "SELECT lpad(CAST(p_partkey AS string),6,'0') AS sid, 20250101 AS delist FROM part WHERE p_partkey % 7 = 0",
    "adjustment": """SELECT lpad(CAST(l_partkey AS string),6,'0') AS sid, year(l_shipdate)*10000+month(l_shipdate)*100+day(l_shipdate) AS ex_date,
  year(l_shipdate)*10000+month(l_shipdate)*100+1 AS register_date, l_discount AS bonus_share, l_tax AS transfer, l_quantity AS bonus FROM lineitem""",
    "rightment": """SELECT lpad(CAST(o_custkey AS string),6,'0') AS sid, year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) AS ex_date,
  year(o_orderdate)*10000+month(o_orderdate)*100+1 AS register_date, o_totalprice / 1000 AS price, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS ratio FROM orders""",
    "target_bars": "SELECT sid, event_id AS tick, close FROM bars WHERE event_id % 3 <> 0",
    "staging_bars": "SELECT sid, event_id AS tick, close + 1 AS close FROM bars WHERE event_id % 3 = 0 OR event_id % 5 = 0",
}
# Ids are cut to six characters, so from a million parts on several securities have one; the part's key tells them apart.
VIEWS["keyed_asset"] = VIEWS["asset"].replace("SELECT ", "SELECT p_partkey AS asset_key, ", 1)
TABLES = ("events", "part", "orders", "lineitem")


def with_views(sql: str) -> str:
    """A query with the views it reads as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b(?:FROM|JOIN) {name}\b", text) and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    return f"WITH {views}\n{sql}" if views else sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = with_views(f"SELECT * FROM {name}")
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", text)]
    for t in used:
        text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
