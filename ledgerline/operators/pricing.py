"""Filter and grouped totals over line items."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType

from ledgerline.functions import from_hundredths, from_ten_thousandths, hundredths, product, wide_sum


def shipped_by(lineitem: DataFrame, cutoff: str | date) -> DataFrame:
    """Lines with ``l_shipdate`` at or before ``cutoff``, a date or date and time.

    Text is in ISO format. Text that is no date, a cutoff with a time zone, and a
    column that is neither ``timestamp_ntz`` nor ``date`` are errors: the column is
    compared as stored, and the session time zone plays no part.
    """
    at = datetime.fromisoformat(cutoff if isinstance(cutoff, str) else cutoff.isoformat())
    if at.tzinfo is not None:
        raise ValueError(f"the cutoff has a time zone: {cutoff}")
    kind = lineitem.schema["l_shipdate"].dataType
    if not isinstance(kind, (DateType, TimestampNTZType)):
        raise TypeError(f"l_shipdate is {kind.simpleString()}, not timestamp_ntz or date")
    return lineitem.filter(F.col("l_shipdate") <= F.lit(at.isoformat(" ")).cast("timestamp_ntz"))


def summarize_pricing(lineitem: DataFrame) -> DataFrame:
    """Quantity, discounted price, mean discount and count per flag and status.

    Each task adds up its rows before the one shuffle, so a task sends at most
    one row per group however large or uneven the groups are.
    """
    price = hundredths(F.col("l_extendedprice"))
    discount = hundredths(F.col("l_discount"))
    quantity = hundredths(F.col("l_quantity"))
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        from_hundredths(wide_sum(quantity)).alias("sum_qty"),
        from_ten_thousandths(wide_sum(product(price, 100 - discount))).alias("sum_disc_price"),
        (wide_sum(discount).cast("double") / (100 * F.count("l_discount"))).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )
