from __future__ import annotations

from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerline.operators import shipped_by, summarize_pricing
from ledgerline.plans import pricing_summary
from ledgerline.sources import read_table
from tests.conftest import LINEITEM, TESTDATA

CUTOFF = datetime(2000, 9, 2)


def brute_force(rows, cutoff=CUTOFF):
    """The summary by exact fractions, one plain row at a time."""
    groups = {}
    for flag, status, quantity, price, discount, shipped in rows:
        if shipped is None or shipped > cutoff:
            continue
        group = groups.setdefault((flag, status), ([], [], [], []))
        quantity, price, discount = (
            None if x is None else Fraction(repr(x)) for x in (quantity, price, discount)
        )
        if quantity is not None:
            group[0].append(quantity)
        if price is not None and discount is not None:
            group[1].append(price * (1 - discount))
        if discount is not None:
            group[2].append(discount)
        group[3].append(1)
    return {
        (
            flag,
            status,
            float(sum(quantities)) if quantities else None,
            float(sum(nets)) if nets else None,
            float(sum(discounts) / len(discounts)) if discounts else None,
            len(ones),
        )
        for (flag, status), (quantities, nets, discounts, ones) in groups.items()
    }


def summary(frame, cutoff="2000-09-02"):
    rows = [tuple(r) for r in summarize_pricing(shipped_by(frame, cutoff)).collect()]
    assert len(rows) == len(set(r[:2] for r in rows))
    return set(rows)


def line(flag="A", status="F", quantity=1.0, price=100.01, discount=0.07, shipped=CUTOFF):
    return (flag, status, quantity, price, discount, shipped)


def test_given_table_against_brute_force(spark):
    frame = read_table(spark, f"{TESTDATA}/sf0.001", "lineitem")
    columns = [name.split()[0] for name in LINEITEM.split(", ")]
    rows = [tuple(r) for r in frame.select(columns).collect()]
    assert summary(frame) == brute_force(rows)


def cents(low, high):
    return st.none() | st.integers(low, high).map(lambda n: n / 100)


lines = st.tuples(
    st.sampled_from(["A", "N", "R", None]),
    st.sampled_from(["F", "O"]),
    cents(-100, 10**6),
    cents(-(10**6), 10**12),
    cents(0, 100),
    st.none() | st.sampled_from([-1, 0, 1]).map(lambda n: CUTOFF + timedelta(microseconds=n)),
)


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(lines, max_size=30))
def test_any_lines_against_brute_force(spark, rows):
    assert summary(spark.createDataFrame(rows, LINEITEM)) == brute_force(rows)


def test_no_lines(spark):
    frame = spark.createDataFrame([], LINEITEM)
    assert summary(frame) == set()
    assert summary(spark.createDataFrame([line(shipped=None)], LINEITEM)) == set()


def test_group_with_no_amounts(spark):
    rows = [line(quantity=None, price=None, discount=None)]
    assert summary(spark.createDataFrame(rows, LINEITEM)) == {("A", "F", None, None, None, 1)}


def test_cutoff_is_inclusive_to_the_microsecond(spark):
    step = timedelta(microseconds=1)
    rows = [line(shipped=CUTOFF + k * step) for k in (-1, 0, 1)]
    frame = spark.createDataFrame(rows, LINEITEM)
    assert {r[-1] for r in summary(frame)} == {2}
    assert {r[-1] for r in summary(frame, "2000-09-02 00:00:00.000001")} == {3}


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("cutoff", ["2000-13-02", "garbage", "", "2000-09-02 00:00:00-08:00", "2000-09-02T00:00Z"])
def test_a_cutoff_that_is_no_plain_time_is_an_error(spark, conf, ansi, cutoff):
    conf("spark.sql.ansi.enabled", ansi)
    with pytest.raises(ValueError):
        shipped_by(spark.createDataFrame([line()], LINEITEM), cutoff)


def test_a_column_with_a_zone_is_an_error(spark):
    frame = spark.createDataFrame([line()], LINEITEM)
    with pytest.raises(TypeError):
        shipped_by(frame.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")), "2000-09-02")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_large_amounts_are_exact_or_an_error(spark, conf, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    of = lambda rows: summary(spark.createDataFrame(rows, LINEITEM))
    rows = [line(quantity=4e16)] * 4
    assert of(rows) == brute_force(rows)
    for bad in (line(price=2e15, discount=0.1), line(price=1e14, discount=-1e6), line(quantity=5e16)):
        with pytest.raises(PySparkException):
            of([bad])


def test_session_time_zone_plays_no_part(spark, conf):
    expected = {tuple(r) for r in pricing_summary(spark, f"{TESTDATA}/sf0.001").collect()}
    for zone in ("America/Los_Angeles", "Pacific/Kiritimati"):
        conf("spark.sql.session.timeZone", zone)
        assert {tuple(r) for r in pricing_summary(spark, f"{TESTDATA}/sf0.001").collect()} == expected


def test_a_cutoff_in_an_hour_that_the_session_zone_skips(spark, conf):
    conf("spark.sql.session.timeZone", "America/Los_Angeles")
    rows = [line(shipped=datetime(2000, 4, 2, 2, 30)), line(shipped=datetime(2000, 4, 2, 3, 0))]
    frame = spark.createDataFrame(rows, LINEITEM)
    assert {r[-1] for r in summary(frame, "2000-04-02 02:30:00")} == {1}


def test_result_is_the_same_for_any_layout(spark):
    frame = read_table(spark, f"{TESTDATA}/sf0.01", "lineitem")
    expected = summary(frame)
    for layout in (
        frame.coalesce(1).sortWithinPartitions(F.desc("l_extendedprice")),
        frame.repartition(13),
        frame.repartition(5, "l_returnflag"),
        frame.repartitionByRange(7, "l_extendedprice"),
    ):
        assert summary(layout) == expected


def test_an_amount_that_cannot_be_exact_is_an_error(spark):
    rows = [line(), line(price=100.005)]
    with pytest.raises(PySparkException, match="100.005"):
        summary(spark.createDataFrame(rows, LINEITEM))
    # not one that the filter removes
    rows[1] = line(price=100.005, shipped=CUTOFF + timedelta(days=1))
    assert summary(spark.createDataFrame(rows, LINEITEM)) == brute_force(rows)


def test_totals_past_the_range_of_a_bigint(spark):
    price = 9 * 10.0**11
    frame = spark.range(20_000).select(
        F.lit("A").alias("l_returnflag"),
        F.lit("F").alias("l_linestatus"),
        F.lit(50.0).alias("l_quantity"),
        F.lit(price).alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"),
        F.lit("2000-01-01").cast("timestamp_ntz").alias("l_shipdate"),
    )
    assert 20_000 * price * 0.9 * 10**4 > 2**63
    assert summary(frame) == {("A", "F", 1e6, 20_000 * 9 * 9 * 10.0**10, 0.1, 20_000)}
