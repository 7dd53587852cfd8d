"""Adapter: derives a raw loan book from the supplied orders, customers and order lines.

The supplied tables hold no loans. Each order becomes one loan with the columns a raw
lender file has, text where such files carry text. All arithmetic is on integers and
decimals, so any engine derives the same book.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c, precision=12):
    return c.cast(f"decimal({precision},2)")


def returned_per_order(lines: DataFrame) -> DataFrame:
    """Value of returned lines per order; sums before the shuffle, so a hot order is cheap."""
    return (
        lines.filter(F.col("l_returnflag") == "R")
        .groupBy("l_orderkey")
        .agg(F.sum(_money(F.col("l_extendedprice"))).alias("returned"))
    )


def joined_tables(orders: DataFrame, customers: DataFrame, returned: DataFrame | None) -> DataFrame:
    """What a raw loan derives from, one row per loan; ``orders`` may be a stream if ``returned`` is None.

    No join is hinted: Spark broadcasts the customers only below its size limit, and
    splits a hot customer's partition at run time otherwise.
    """
    c = customers.select("c_custkey", "c_acctbal", "c_mktsegment")
    df = orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
    if returned is None:
        df = df.withColumn("returned", F.lit(None).cast("decimal(22,2)"))
    else:
        df = df.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return df.select(
        "o_orderkey", "o_custkey", _money(F.col("o_totalprice")).alias("amt"), "o_orderdate", "o_orderpriority",
        _money(F.col("c_acctbal")).alias("balance"), "c_mktsegment", "returned",
    )


def raw_from_tables(orders: DataFrame, customers: DataFrame, returned: DataFrame | None) -> DataFrame:
    """Raw loans from the three inputs."""
    return raw_from_joined(joined_tables(orders, customers, returned))


def raw_from_joined(df: DataFrame) -> DataFrame:
    """Raw loans from the rows of :func:`joined_tables`, row by row."""
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    df = df.select(
        "*",
        ((ok * 7919 + ck * 10473) % 1000).alias("h"),
        ((ok * 31 + ck * 17) % 54).alias("f"),
        ((ok * 13 + ck * 7) % 100).alias("m"),
        ((ok * 53 + ck * 29) % 450).alias("dt"),
    )
    f, h, m, dt, amt = (F.col(x) for x in ("f", "h", "m", "dt", "amt"))
    grade_index = (
        F.when(f >= 44, 0).when(f >= 36, 1).when(f >= 28, 2).when(f >= 20, 3)
        .when(f >= 12, 4).when(f >= 6, 5).otherwise(6)
    )
    df = df.withColumn("gi", grade_index)
    gi = F.col("gi")
    df = df.withColumn("bad", h < gi * 50 + 30 + F.expr("(dt - dt % 5) div 5"))
    bad = F.col("bad")
    df = df.withColumn(
        "status",
        F.when(bad & (h % 5 < 3), "Charged Off")
        .when(bad & (h % 5 == 3), "Default")
        .when(bad, "Late (31-120 days)")
        .when(m % 4 == 0, "Current")
        .otherwise("Fully Paid"),
    )
    status = F.col("status")
    months = F.when(m % 4 == 0, 60).otherwise(36)
    cents = Decimal("0.01")
    instalment = F.when(
        m != 9,
        ((F.floor(((amt * 100).cast("long") / months))).cast("decimal(12,0)") * F.lit(cents)).cast("decimal(10,2)"),
    )

    def share_of_amount(tenths: str):
        return _money(amt * F.lit(Decimal(tenths)))

    return df.select(
        ok.alias("loan_id"),
        amt.alias("loan_amnt"),
        F.when(m < 3, None).when(m < 10, share_of_amount("0.9")).otherwise(amt).alias("funded_amnt"),
        F.when(m == 1, None).when(m % 4 == 0, " 60 months").otherwise(" 36 months").alias("term"),
        F.concat(
            ((gi * 300 + 500 + h % 300).cast("decimal(6,0)") * F.lit(cents)).cast("decimal(6,2)").cast("string"),
            F.lit("%"),
        ).alias("int_rate"),
        instalment.alias("installment"),
        F.substring(F.lit("ABCDEFG"), gi + 1, F.lit(1)).alias("grade"),
        F.concat(
            F.substring(F.lit("ABCDEFG"), gi + 1, F.lit(1)), (h % 5 + 1).cast("string")
        ).alias("sub_grade"),
        F.when(m < 5, None).when(m < 15, "< 1 year").when(m < 25, "10+ years")
        .otherwise(F.concat((m % 9 + 1).cast("string"), F.lit(" years"))).alias("emp_length"),
        F.when(F.col("c_mktsegment") == "BUILDING", "MORTGAGE")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "OWN").otherwise("RENT").alias("home_ownership"),
        (F.col("balance") * 10 + 20000).cast("decimal(14,2)").alias("annual_inc"),
        F.when(m % 3 == 0, "Verified").when(m % 3 == 1, "Source Verified")
        .otherwise("Not Verified").alias("verification_status"),
        F.col("o_orderdate").cast("date").alias("issue_d"),
        status.alias("loan_status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "medical")
        .when(F.col("o_orderpriority") == "2-HIGH", "credit_card")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "debt_consolidation")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "other")
        .otherwise("home_improvement").alias("purpose"),
        (dt.cast("double") / 10).alias("dti"),
        (m % 4).cast("int").alias("delinq_2yrs"),
        (f * 5 + 580).cast("int").alias("fico_range_low"),
        (f * 5 + 584).cast("int").alias("fico_range_high"),
        (h % 7).cast("int").alias("inq_last_6mths"),
        (f % 20 + 1).cast("int").alias("open_acc"),
        (m % 2).cast("int").alias("pub_rec"),
        (dt * 100 + h).cast("double").alias("revol_bal"),
        m.cast("double").alias("revol_util"),
        (f % 40 + 5).cast("int").alias("total_acc"),
        F.when(status == "Current", share_of_amount("0.5"))
        .otherwise(F.lit(Decimal("0.00")).cast("decimal(12,2)")).alias("out_prncp"),
        share_of_amount("0.7").alias("total_pymnt"),
        share_of_amount("0.6").alias("total_rec_prncp"),
        share_of_amount("0.1").alias("total_rec_int"),
        F.when(bad, _money(F.col("returned") * F.lit(Decimal("0.1")))).alias("recoveries"),
        instalment.cast("decimal(12,2)").alias("last_pymnt_amnt"),
    )


def loan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined rows of one scale folder."""
    return joined_tables(
        table(spark, sf_dir, "orders"),
        table(spark, sf_dir, "customer"),
        returned_per_order(table(spark, sf_dir, "lineitem")),
    )


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole raw book of one scale folder."""
    return raw_from_joined(loan_sources(spark, sf_dir))
