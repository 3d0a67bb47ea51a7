"""Pricing totals of the lines shipped up to a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators import shipped_by, summarize_pricing
from ledgerline.sources import read_table

CUTOFF = "2000-09-02 00:00:00"

PRICING_SUMMARY_SQL = f"""
SELECT l_returnflag,
       l_linestatus,
       CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))
                * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc_price,
       CAST(SUM(CAST(l_discount AS DECIMAL(4,2))) * 100 AS DOUBLE)
           / (100 * COUNT(l_discount)) AS avg_disc,
       COUNT(*) AS count_order
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '{CUTOFF}'
GROUP BY l_returnflag, l_linestatus
"""


def pricing_summary(spark: SparkSession, folder: str, cutoff: str = CUTOFF) -> DataFrame:
    """``summarize_pricing`` over the lines of ``folder`` shipped by ``cutoff``."""
    return summarize_pricing(shipped_by(read_table(spark, folder, "lineitem"), cutoff))
