"""Files with columns in any order, and appends to tables that are split into folders."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions.columns import banded, number_sql
from riskloom.operators import loading as L
from riskloom.operators import portfolio as P
from riskloom.session import work_folder
from riskloom.sources import readers, sinks


def write_text(spark, name, lines):
    path = work_folder(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_loans_by_name_with_extra_columns_and_bad_rows(spark):
    names = [c for c in readers.PROJECTIONS["training"] if c != "loan_id"][::-1]
    values = {"loan_amnt": "1000.00", "funded_amnt": "900.00", "grade": "B", "dti": "18.5"}
    good = ",".join(["extra", *(values.get(c, "") for c in names)])
    bad = good.replace("1000.00", "many")
    path = write_text(spark, "loans-csv", [",".join(["member", *names]), good, bad])
    row = readers.read_loans_csv(spark, path, "training").collect()
    assert [(float(r.loan_amnt), float(r.funded_amnt), r.grade, r.dti) for r in row] == [(1000.0, 900.0, "B", 18.5)]
    assert row[0].loan_id is not None
    aside = readers.rejected_loans_csv(spark, path, "training").collect()
    assert [(r.loan_amnt, r.unread) for r in aside] == [(None, ["loan_amnt"])]


def test_missing_column_is_an_error(spark):
    path = write_text(spark, "short-csv", ["grade,dti", "A,1"])
    with pytest.raises(ValueError, match="loan_amnt"):
        readers.read_loans_csv(spark, path)


def test_batch_file_without_a_row_number(spark):
    path = write_text(
        spark,
        "batch-csv",
        ["fico_score,dti,int_rate,annual_inc,loan_amnt,emp_length,purpose,home_ownership", "720,18.5,11.99,75000,15000,5,debt_consolidation,MORTGAGE"],
    )
    row = readers.read_applications_csv(spark, path).first()
    assert (row.fico_score, row.dti, row.int_rate, row.annual_inc) == (720, 18.5, 11.99, 75000)


def test_append_to_a_table_by_year(spark):
    path = work_folder(spark, "by-year")
    rows = [(1, datetime.date(2015, 3, 1)), (2, datetime.date(2016, 5, 1))]
    loans = spark.createDataFrame(rows, "loan_id int, issue_d date")
    L.write_loans(loans.where("loan_id = 1"), path)
    assert L.append_new(loans, path) == 1
    assert L.append_new(loans, path) == 0
    assert sorted((r.loan_id, r.issue_year) for r in spark.read.parquet(path).collect()) == [(1, 2015), (2, 2016)]


def test_metrics_in_currency_fit(spark):
    path = work_folder(spark, "metrics")
    metrics = spark.createDataFrame(
        [("EAD", "v1", "rmse", 1234567890.25, datetime.date(2024, 1, 1), "test")],
        "model_type string, model_version string, metric_name string, metric_value double, evaluation_date date, dataset string",
    )
    sinks.append_metrics(metrics, path)
    assert float(spark.read.parquet(path).first().metric_value) == 1234567890.25


def test_unknown_values_have_no_label(spark):
    df = spark.createDataFrame([(None,), (0.5,), (2.0,)], "x double")
    assert [r[0] for r in df.select(banded("x", [(1.0, "low")], "high")).collect()] == [None, "low", "high"]
    assert df.selectExpr(f"{number_sql(float('inf'))} > 1").first()[0] is True


def test_pivot_leaves_out_quarters_without_grades(spark):
    rows = [(datetime.date(2015, 1, 1), "A", True), (datetime.date(2015, 4, 1), None, False), (datetime.date(2015, 7, 1), "B", False)]
    loans = spark.createDataFrame(rows, "issue_d date, grade string, is_default boolean")
    got = P.vintage_grade_pivot(loans, quarters=2).collect()
    assert [r.issue_quarter for r in got] == ["2015Q1", "2015Q3"]


def test_whole_numbers_with_a_decimal_point(spark):
    names = list(readers.PROJECTIONS["training"])
    line = {"loan_id": "7", "loan_amnt": "1000", "fico_range_low": "690.0", "open_acc": "1e1", "pub_rec": " 3"}
    path = write_text(spark, "decimal-csv", [",".join(names), *(",".join({**line, "total_acc": t}.get(c, "") for c in names) for t in ("12.00", "12.5", "99999999999.0"))])
    rows = readers.read_loans_csv(spark, path, "training").collect()
    assert [(r.loan_id, r.fico_range_low, r.open_acc, r.total_acc) for r in rows] == [(7, 690, 10, 12)]
    assert [tuple(r) for r in readers.reject_counts(spark, path, "training").collect()] == [("total_acc", 2)]


def test_a_file_without_a_readable_row_is_an_error(spark):
    names = list(readers.PROJECTIONS["training"])
    path = write_text(spark, "unreadable-csv", [",".join(names), ",".join("x" if c in ("dti", "pub_rec") else "" for c in names)])
    with pytest.raises(ValueError, match=r"dti \(1\), pub_rec \(1\)"):
        readers.read_loans_csv(spark, path, "training")
    empty = write_text(spark, "empty-csv", [",".join(names)])
    assert readers.read_loans_csv(spark, empty, "training").collect() == []


def test_narrowest_types(spark):
    lines = ["a,b,c,d,e,f,g", "1,1.5,2015-01-31,x,,Dec-2015,", "2.0,2,2016-02-29,1,,Jan-2016,7", "-3,1e3,2016-12-01,2015-01-01,,Feb-2016,0.0"]
    path = write_text(spark, "types-csv", lines)
    got = {r["column"]: r["type"] for r in readers.inferred_types(spark, path).collect()}
    assert got == {"a": "int", "b": "double", "c": "date", "d": "text", "e": "null", "f": "date", "g": "int"}


# --- writers that survive a death in between ----------------------------------------
class Died(BaseException):
    """What a killed driver looks like from inside: nothing catches it."""


def die(*_, **__):
    raise Died


def test_a_dead_job_stays_running(spark):
    ledger, result = work_folder(spark, "ledger"), work_folder(spark, "result")
    requests = spark.range(5).withColumnRenamed("id", "loan_id")
    with pytest.raises(Died):
        sinks.run_batch_job(spark, "dies", "PD", requests, die, result, ledger)
    with pytest.raises(ZeroDivisionError):
        sinks.run_batch_job(spark, "fails", "PD", requests, lambda _: 1 / 0, result, ledger)
    sinks.run_batch_job(spark, "ends", "PD", requests, lambda x: x, result, ledger)
    last = {r.job_name: (r.status, r.processed) for r in sinks.latest_jobs(spark.read.parquet(ledger)).collect()}
    assert last == {"dies": ("running", None), "fails": ("error", None), "ends": ("done", 5)}


def test_a_batch_is_appended_once_and_only_whole(spark, monkeypatch):
    path = work_folder(spark, "commits")
    batch = spark.range(7).withColumnRenamed("id", "loan_id")
    with pytest.raises(ValueError, match="no batch"):
        sinks.read_committed(spark, path)
    assert sinks.append_batch(batch, path, "a") and not sinks.append_batch(batch, path, "a")
    with monkeypatch.context() as m:  # the writer dies between the files and the record
        m.setattr(sinks.datetime, "datetime", type("Clock", (), {"now": staticmethod(die)}))
        with pytest.raises(Died):
            sinks.append_batch(batch.filter("loan_id < 3"), path, "b")
    assert sinks.read_committed(spark, path).count() == 7
    assert sinks.append_batch(batch.filter("loan_id < 2"), path, "b")
    assert sorted((r.batch_id, r.loan_id) for r in sinks.read_committed(spark, path).collect()) == [("a", i) for i in range(7)] + [("b", 0), ("b", 1)]
    assert sinks.append_batch(batch.filter("loan_id < 0"), path, "empty") and sinks.read_committed(spark, path).count() == 9


def test_a_stream_restarted_in_a_batch_loses_and_doubles_nothing(spark, monkeypatch):
    from pyspark.errors import StreamingQueryException

    from riskloom.operators import scoring as S
    from riskloom.streaming import scoring as SS

    source, path, progress = (work_folder(spark, x) for x in ("apps", "scored", "progress"))
    schema = "loan_id bigint, ts timestamp, fico_score double, dti double, int_rate double, annual_inc double, emp_length double, revol_util double, purpose string, home_ownership string, loan_amnt double"

    def arrive(ids):
        at = datetime.datetime(2024, 1, 1)
        rows = [(i, at, 400.0 if i % 5 == 0 else 700.0, 60.0 if i % 10 == 0 else 15.0, 12.0, 6e4, 5.0, 30.0, "other", "RENT", 1e4) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        apps = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        SS.start_scoring(apps, path, progress, dedupe_within="1 hour").awaitTermination()

    arrive(range(20))
    run()
    arrive([3, 3, *range(15, 30)])  # some again, within the hour
    split, calls = SS.score_stream, []

    def dies_after_the_predictions(batch, **options):
        scored, rejected = split(batch, **options)
        calls.append(1)
        return scored, rejected.select("loan_id", F.raise_error(F.lit("died")).cast("string").alias("violations"))

    with monkeypatch.context() as m:
        m.setattr(SS, "score_stream", dies_after_the_predictions)
        with pytest.raises(StreamingQueryException):
            run()
    assert calls
    run()
    scored, rejected = SS.read_scored(spark, path)
    assert sorted(int(r.loan_ref) for r in scored.collect()) == [i for i in range(30) if i % 5]
    assert sorted((r.loan_id, r.violations) for r in rejected.collect()) == [(i, "fico_score,dti" if i % 10 == 0 else "fico_score") for i in range(0, 30, 5)]


def test_stability_against_a_reference_of_any_width(spark):
    from riskloom.streaming import monitoring as M

    day = datetime.datetime(2024, 1, 1)
    windows = spark.createDataFrame([(day, float(b), 1 + b % 3) for b in range(0, 4000, 2)] + [(day, -7.0, 5)], "window_start timestamp, band double, n long")
    expected = spark.range(3000).select(F.col("id").cast("double").alias("band"), F.lit(1 / 3000).alias("share"))
    row = M.window_stability(windows, expected).first()
    size = 5 + sum(1 + b % 3 for b in range(0, 4000, 2))
    want = 0.0
    for b in range(3000):
        a, e = max((1 + b % 3) / size if b % 2 == 0 else 0.0, 1e-8), 1 / 3000
        want += (a - e) * math.log(a / e)
    assert row["n"] == size and row["psi"] == pytest.approx(want, abs=2e-6)


ODD_TEXTS = (
    "690.0", " 690 ", "+7", "-7.", ".5", "5.", "1e3", "1E-3", "1e1", "1d", "2.5f", "0x1p3", "NaN", "nan", "inf", "-Infinity", "+inf", "infinity", "many", "n/a", "",
    "١٢", "\t12\u007f", "36 months", "4 years", "12.35%", "10+ years", "99999999999", "123456789012345678901234", "1995", "1995-3", " 1995-03-04 ", "1995-03-04T05:06",
    "+1995-01-01", "1234567-01-01", "12345678", "1995-13-01", "Jan-1995", "jan-1995", "JAN-1995", "Jan-12345", "Jan-+12345", "Janu-1995", "Foo-1995", "Not Verified", "debt_consolidation",
)


@pytest.mark.parametrize(("kind", "shape"), [("int", "_DIGITS"), ("bigint", "_DIGITS"), ("double", "_NUMBER"), ("decimal(38,18)", "_NUMBER"), ("date", "_DATE")])
def test_texts_that_no_cast_can_read_are_not_cast(spark, kind, shape):
    df = spark.createDataFrame([(x,) for x in ODD_TEXTS], "x string")
    text, tested = F.col("x"), F.col("x").rlike(getattr(readers, shape))
    rows = df.select("x", text.try_cast(kind).cast("string").alias("plain"), readers._cast(text, kind, getattr(readers, shape)).cast("string").alias("got"), tested.alias("tried")).collect()
    assert [(r.x, r.got) for r in rows] == [(r.x, r.plain) for r in rows]
    assert not any(r.tried for r in rows if r.x in ("many", "36 months", "12.35%", "Not Verified", "debt_consolidation"))


def test_months_that_can_be_read_have_their_shape(spark):
    df = spark.createDataFrame([(x,) for x in ODD_TEXTS if x != "Janu-1995"], "x string")
    month = F.try_to_date("x", "MMM-yyyy").cast("string")
    rows = df.select("x", month.alias("plain"), F.when(F.col("x").rlike(readers._MONTH), month).alias("got")).collect()
    assert [(r.x, r.got) for r in rows] == [(r.x, r.plain) for r in rows] and sum(r.plain is not None for r in rows) >= 3
