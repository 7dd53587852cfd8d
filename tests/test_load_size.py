"""Work of the load and of its metrics that must not be done twice."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.operators import targets as T
from riskloom.operators import validation as V
from riskloom.operators.features import build_loans
from riskloom.plans import book
from riskloom.sources import testbook


def write_tables(spark, path):
    """Orders with and without customers and returned lines, and a customer that is there twice."""
    orders = [(i, i % 7, 1000.0 + 137.25 * i, datetime.datetime(1995 + i % 4, 1 + i % 12, 3), ("1-URGENT", "2-HIGH", "5-LOW")[i % 3]) for i in range(1, 400)]
    orders += [(7, 3, 500.0, None, None), (401, None, 500.0, datetime.datetime(1996, 1, 3), "2-HIGH"), (None, 2, 90.0, None, "2-HIGH")]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "customer": ([(c, 100.5 * c - 250, ("BUILDING", "HOUSEHOLD", None)[c % 3]) for c in (0, 1, 2, 3, 3, 4, 5)], "c_custkey long, c_acctbal double, c_mktsegment string"),
        "lineitem": ([(i // 2, "RNA"[i % 3], 333.33 * i) for i in range(1, 800)], "l_orderkey long, l_returnflag string, l_extendedprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def in_order(df):
    return sorted(map(str, df.collect()))


def test_load_joins_once(spark, tmp_path):
    folder = write_tables(spark, tmp_path)
    load = book._BUILDERS["loans"](spark, folder)
    plan = load._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan and "c_custkey" not in plan
    whole = build_loans(testbook.raw_loans(spark, folder))
    assert load.schema == whole.schema and in_order(load) == in_order(whole) and load.count() > 300


@pytest.mark.parametrize("keys", [[], ["year"]])
def test_scores_are_counted_once(spark, keys):
    df = spark.range(2000).select(
        ((F.col("id") * 7919 % 997) / 997).alias("score"), (F.col("id") % 3 == 0).alias("is_default"), (F.col("id") % 4).alias("year")
    )
    measured = V.discrimination(df, keys)
    measured.collect()
    assert "ReusedExchange" in measured._jdf.queryExecution().executedPlan().toString()


def test_reference_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(x: float) -> float:
        read.add(1)
        return x

    values = [float(i * 7 % 611) for i in range(1500)] + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    df = df.select(F.udf(seen, "double")("v").alias("v"), F.lit(1.5).alias("w"))
    edges = V.psi_edges(df, ["v", "w"])
    assert edges["w"] == [1.5] and edges["v"][0] == 0 and edges["v"][-1] == 610
    assert read.value == len(values)


def test_means_of_losses_come_from_defaults(spark):
    rows = [("A", True, 0.5), ("A", True, 0.7), ("A", True, 0.99), ("A", False, None), ("B", True, 0.99), (None, True, 0.99), (None, True, 0.2)]
    df = spark.createDataFrame(rows, "grade string, is_default boolean, lgd double")
    top = T.K.LGD_RANGE[1]
    df = df.withColumn("lgd", F.when(F.col("lgd") == 0.99, F.lit(top)).otherwise(F.col("lgd")))
    whole, part = T.impute_lgd(df), T.impute_lgd(df, losses=df.filter("is_default"))
    assert in_order(whole) == in_order(part)
    got = sorted(((r["grade"] or "", r["lgd"]) for r in part.collect() if r["lgd"] is not None))
    assert got == [("", 0.2), ("", T.K.LGD_WITHOUT_HISTORY), ("A", 0.5), ("A", pytest.approx(0.6)), ("A", 0.7), ("B", T.K.LGD_WITHOUT_HISTORY)]
