"""The physical plan is the one meant for a large table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import pricing_summary
from ledgerline.sources import read_table
from tests.conftest import TESTDATA


def nodes(frame):
    """All physical operators of a query that was run without adaptive execution."""
    todo, found = [frame._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        found.append(node)
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return found


def metric(node, name):
    return node.metrics().get(name).get().value()


@pytest.fixture
def plain(conf):
    conf("spark.sql.adaptive.enabled", "false")


def test_scan_reads_six_columns_and_its_plan_lists_the_filter(spark, plain):
    frame = pricing_summary(spark, f"{TESTDATA}/sf0.01")
    (scan,) = [n for n in nodes(frame) if n.nodeName().startswith("Scan")]
    assert set(scan.requiredSchema().fieldNames()) == {
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    }
    assert "LessThanOrEqual(l_shipdate,2000-09-02T00:00)" in scan.metadata().apply("PushedFilters")


def test_one_shuffle_between_two_hash_aggregates_in_generated_code(spark, plain):
    found = nodes(pricing_summary(spark, f"{TESTDATA}/sf0.01"))
    assert [n.nodeName().split()[0] for n in found] == [
        "WholeStageCodegen",
        "HashAggregate",
        "InputAdapter",
        "Exchange",
        "WholeStageCodegen",
        "HashAggregate",
        "Project",
        "Filter",
        "ColumnarToRow",
        "InputAdapter",
        "Scan",
    ]


def test_a_hot_group_shuffles_one_row_per_task(spark, plain, tmp_path):
    hot = F.col("l_quantity") < 45
    (
        read_table(spark, f"{TESTDATA}/sf0.01", "lineitem")
        .withColumn("l_returnflag", F.when(hot, "A").otherwise(F.col("l_returnflag")))
        .withColumn("l_linestatus", F.when(hot, "F").otherwise(F.col("l_linestatus")))
        .repartition(4)
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    )
    frame = pricing_summary(spark, str(tmp_path))
    rows = frame.collect()
    assert max(r.count_order for r in rows) > sum(r.count_order for r in rows) / 3
    found = nodes(frame)
    shuffles = [n for n in found if n.nodeName() == "Exchange"]
    scans = [n for n in found if n.nodeName().startswith("Scan")]
    assert metric(scans[0], "numOutputRows") == 60_000
    assert metric(shuffles[0], "shuffleRecordsWritten") <= 4 * len(rows)
