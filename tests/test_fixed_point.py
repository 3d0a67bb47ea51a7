from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerline.functions import from_ten_thousandths, hundredths, wide_sum


def doubles(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def test_hundredths_of_exact_values(spark):
    values = [0.0, -0.0, 0.01, 0.07, 0.29, 1.1, -994.28, 104999.91, 90071992547.41, None]
    rows = doubles(spark, values).select(hundredths(F.col("x")).alias("u")).collect()
    assert [r.u for r in rows] == [
        None if v is None else int(round(Decimal(repr(v)) * 100)) for v in values
    ]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("value", [0.005, 1.999, 1e-9, float("nan"), float("inf"), 1e300])
def test_hundredths_refuses_to_round(spark, conf, ansi, value):
    conf("spark.sql.ansi.enabled", ansi)
    with pytest.raises(PySparkException):
        doubles(spark, [1.0, value]).agg(F.sum(hundredths(F.col("x")))).collect()


def test_the_error_names_the_value(spark):
    with pytest.raises(PySparkException, match="not a whole number of hundredths: 1.999"):
        doubles(spark, [1.999]).select(hundredths(F.col("x"))).collect()


@pytest.mark.parametrize("unit", [9 * 10**17, -9 * 10**17, 2**63 - 1, -(2**63), 2**20 - 1, -1])
def test_wide_sum_goes_past_bigint(spark, unit):
    total = spark.range(1000).select(F.lit(unit).alias("u")).agg(wide_sum(F.col("u"))).head()[0]
    assert total == 1000 * unit


def test_wide_sum_of_mixed_signs_and_nulls(spark):
    units = [5, -7, None, 2**40 + 3, -(2**41), 0]
    frame = spark.createDataFrame([(u,) for u in units], "u bigint")
    assert frame.agg(wide_sum(F.col("u"))).head()[0] == sum(u for u in units if u is not None)
    assert frame.filter("u is null").agg(wide_sum(F.col("u"))).head()[0] is None


@pytest.mark.parametrize("units", [0, 1, -1, 12345, 2**53 + 1, 10**20 + 7, -(10**24) - 1])
def test_from_ten_thousandths_rounds_once(spark, units):
    frame = spark.createDataFrame([(Decimal(units),)], "t decimal(29,0)")
    expected = float(Decimal(units).scaleb(-4))
    assert frame.select(from_ten_thousandths(F.col("t"))).head()[0] == expected
