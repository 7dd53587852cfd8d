"""Training, model scoring, files, ledger and streaming queries.

Model fits are iterative and have no SQL; their results are checked for shape and sense in
the tests. Files and streams must give what the batch gives, so those have SQL.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators import features as Fe
from riskloom.operators import portfolio as P
from riskloom.operators import scoring as S
from riskloom.operators import training as T
from riskloom.operators import validation as V
from riskloom.operators.loading import append_projection, stratified_folds, write_loans
from riskloom.plans.base_sql import on_loans
from riskloom.plans.book import loans, metrics
from riskloom.plans.metric_sql import measures
from riskloom.plans.monitoring_queries import QUERIES as MONITORING
from riskloom.plans.portfolio_queries import QUERIES as PORTFOLIO
from riskloom.plans.scoring_queries import PD_RATINGS, POINTS, RANGE_SQL, REQUESTS, SERVICE_PD, requests
from riskloom.plans.scoring_queries import QUERIES as SCORING
from riskloom.plans.validation_queries import _FINAL, final_scored
from riskloom.session import work_folder
from riskloom.sources import readers, sinks, testbook
from riskloom.streaming import monitoring as SM
from riskloom.streaming import scoring as SS


@cache
def _fitted(spark: SparkSession, application: str, sf_dir: str, name: str):
    """One model, fitted and saved on first use, whichever queries ask for it."""
    book = loans(spark, sf_dir)
    fits = {
        "boosted": lambda: T.fit_boosted(_training_rows(spark, application, sf_dir)),
        "scorecard": lambda: T.fit_scorecard(_training_rows(spark, application, sf_dir)),
        "lgd": lambda: T.train_lgd(book),
        "ead": lambda: T.train_ead(book),
        "pd": lambda: T.champion(_fitted(spark, application, sf_dir, "boosted"), _fitted(spark, application, sf_dir, "scorecard")),
    }
    model = fits[name]()
    if name != "boosted":  # it is saved where it is the champion
        T.save_trained(spark, model, _folder(spark, application, sf_dir), name)
    return model


@cache
def _folder(spark: SparkSession, application: str, sf_dir: str) -> str:
    return work_folder(spark, "models")


@cache
def _training_rows(spark: SparkSession, application: str, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "training-rows")
    T.pd_rows(loans(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


def trained(s, d, name):
    return _fitted(s, s.sparkContext.applicationId, d, name)


def model_folder(s, d, *names):
    for name in names:
        trained(s, d, name)
    return _folder(s, s.sparkContext.applicationId, d)


def _metric_rows(s, models) -> DataFrame:
    rows = [(t.name, k, float(v)) for t in models for k, v in t.metrics.items() if v is not None]
    return s.createDataFrame(rows, "model string, metric string, value double")


def model_scores(s, d) -> DataFrame:
    """Whole book scored by the saved models: PD, LGD and EAD per loan."""
    folder = model_folder(s, d, "pd", "lgd", "ead")
    x = model_requests(s, d)
    for add, name in ((T.with_pd, "pd"), (T.with_lgd, "lgd"), (T.with_ead, "ead")):
        x = add(x, T.load_model(f"{folder}/{name}"))
    return x.select("loan_id", "pd", "score", "rating", "model", "lgd", "ead", "ccf")


def model_requests(s, d) -> DataFrame:
    return requests(s, d, "term_months", "open_acc", "pub_rec").drop("ead")


def refit_comparison(s, d) -> DataFrame:
    """Boosted model and plain logistic regression, both on the older 80 % of the book,
    measured on the newer 20 %."""
    final = V.temporal_split(loans(s, d).filter(F.col("loan_status").isin(*K.FINAL_STATUSES)))
    rows = T.training_rows(final, K.PD_FEATURES, "is_default", F.col("fold"))
    older = rows.filter("fold = 'train'").withColumn("fold", T.fold_of(shares=(("train", 80), ("calibration", 20))))
    boosted = T.train_boosted_pd(older)
    plain = T.train_scorecard(rows, c=1.0, max_iter=1000, balanced=False)
    newer = rows.filter("fold = 'test'")
    keep = ("loan_id", "label", *K.PD_FEATURES)
    both = T.with_probability(boosted, newer, "boosted").select(*keep, "boosted")
    both = T.with_probability(plain, both, "logistic").withColumn("is_default", F.col("label") == 1)
    return V.compare_models(both, {"boosted": "boosted", "logistic": "logistic"})


def importance(s, d) -> DataFrame:
    """Shares of the boosted model's features in gain, cover and splits."""
    return T.feature_importance(trained(s, d, "boosted").model.node_table(s), K.PD_FEATURES)


def folds(s, d) -> DataFrame:
    """Fold of every resolved loan."""
    resolved = loans(s, d).filter(F.col("loan_status").isin(*K.RESOLVED_STATUSES))
    return stratified_folds(resolved, "is_default").select("loan_id", F.col("is_default").cast("int").alias("is_default"), "fold")


def appended_projection(s, d) -> DataFrame:
    """Two training loads appended to one table, totals of each column that is a number."""
    path = work_folder(s, "projection")
    for rest in (0, 1):
        append_projection(loans(s, d).filter(F.year("issue_d") % 2 == rest), path)
    x = s.read.parquet(path)
    return x.groupBy("grade", "term").agg(
        F.count(F.lit(1)).alias("n"), F.sum("loan_amnt").cast("double").alias("amount"),
        F.sum("fico_range_low").cast("double").alias("fico"), F.count_if("is_default").alias("bad"),
    )


# --- files -----------------------------------------------------------------------
def applications_file(s, d) -> DataFrame:
    """Score a batch CSV and read the result CSV back."""
    source, result = work_folder(s, "applications"), work_folder(s, "results")
    x = requests(s, d)
    names = ("fico_score", "dti", "int_rate", "annual_inc", "loan_amnt", "emp_length", "purpose", "home_ownership")
    x.select(F.col("loan_id").alias("idx"), *names).write.option("header", True).csv(source)
    scored = S.score_batch(readers.read_applications_csv(s, source), "idx")
    sinks.write_batch_csv(scored, result)
    return s.read.schema(
        "idx long, fico double, dti double, pd_pct double, grade string, lgd_pct double, ead double, expected_loss double"
    ).option("header", True).csv(result)


def loans_file(s, d) -> DataFrame:
    """Write the raw book as a lender's CSV, read it with the fixed schema and load it."""
    source = work_folder(s, "lender")
    raw = testbook.raw_loans(s, d)
    order = readers.PROJECTIONS["load"]
    raw.withColumn("issue_d", F.date_format("issue_d", "MMM-yyyy")).select(*_csv_order(raw, order)).write.option("header", True).csv(source)
    book = Fe.build_loans(readers.read_loans_csv(s, source))
    return P.portfolio_by_grade(book)


def wide_loans_file(s, d) -> DataFrame:
    """A lender's file with counts written 690.0, columns in another order, further columns and bad rows."""
    source = work_folder(s, "wide-lender")
    raw = testbook.raw_loans(s, d).withColumn("issue_d", F.date_format("issue_d", "MMM-yyyy"))
    counts = ("delinq_2yrs", "fico_range_low", "fico_range_high", "inq_last_6mths", "open_acc", "pub_rec", "total_acc")
    columns = [F.concat(F.col(c).cast("string"), F.lit(".0")).alias(c) if c in counts else F.col(c) for c in readers.PROJECTIONS["load"][::-1]]
    wide = raw.select(F.lit("x").alias("note"), *columns, F.lit(None).cast("string").alias("desc"))
    bad = F.col("loan_id") % 97
    wide = wide.withColumn("loan_amnt", F.when(bad == 0, "many").otherwise(F.col("loan_amnt").cast("string")))
    wide.withColumn("open_acc", F.when(bad == 1, "690.5").otherwise(F.col("open_acc"))).write.option("header", True).csv(source)
    loans_read = Fe.build_loans(readers.read_loans_csv(s, source))
    read = loans_read.groupBy(F.concat(F.lit("loans of grade "), "grade").alias("what")).agg(
        F.count(F.lit(1)).cast("string").alias("value")
    )
    fico = loans_read.agg(F.lit("sum of scores").alias("what"), F.sum("fico_range_low").cast("bigint").cast("string").alias("value"))
    rejects = readers.reject_counts(s, source).select(F.concat(F.lit("rejected for "), "column").alias("what"), F.col("n").cast("string").alias("value"))
    types = readers.inferred_types(s, source).where(F.col("column").isin(*_TYPES)).select(F.concat(F.lit("type of "), "column").alias("what"), F.col("type").alias("value"))
    return read.unionByName(fico).unionByName(rejects).unionByName(types)


_TYPES = {"loan_id": "int", "delinq_2yrs": "int", "fico_range_low": "int", "open_acc": "double", "dti": "double", "issue_d": "date",
          "loan_amnt": "text", "grade": "text", "desc": "null", "note": "text"}


def _csv_order(raw, order):
    import re

    from riskloom.schemas import RAW_LOANS

    names = re.findall(r"(\w+) (?:long|double|string|int)\b", RAW_LOANS)
    assert set(names) == set(order)
    return names


def metrics_file(s, d) -> DataFrame:
    """Save the measures of the score as JSON and read them with defaults."""
    path = work_folder(s, "metrics-json")
    sinks.save_metrics_json(V.discrimination(final_scored(s, d)), path, "analytic")
    saved = readers.read_saved_metrics(s, path)
    return saved.withColumn("eba_compliant", F.col("eba_compliant").cast("int"))


def saved_figures(s, d) -> DataFrame:
    """Figures of all models: PD and LGD as saved, EAD by default."""
    pd, lgd = work_folder(s, "pd-json"), work_folder(s, "lgd-json")
    sinks.save_metrics_json(V.discrimination(final_scored(s, d)), pd, "analytic")
    sinks.save_errors_json(s.createDataFrame([(0.25, 0.12345, None)], "r2 double, rmse double, mae double"), lgd)
    found = readers.read_saved_figures(s, pd, {"LGD": lgd})
    return found.withColumn("eba_compliant", F.col("eba_compliant").cast("int"))


def full_reload(s, d) -> DataFrame:
    """The table written with a part of the book, then reloaded in full and read by column."""
    path, book = work_folder(s, "reload"), loans(s, d)
    for rows in (book.filter("loan_id % 2 = 0"), book):
        write_loans(rows, path)
    x = readers.read_table(s, path, ["grade", "issue_year", "loan_amnt"])
    return x.groupBy("grade", "issue_year").agg(F.count(F.lit(1)).alias("n"), F.sum("loan_amnt").cast("double").alias("amount"))


def batch_preview(s, d) -> DataFrame:
    """The first hundred rows of a scored batch."""
    return S.score_batch(requests(s, d), "loan_id").orderBy("idx").limit(100).select("idx", "grade", "expected_loss")


def run_log(s, d) -> DataFrame:
    folder = model_folder(s, d, "pd", "scorecard", "lgd", "ead")
    return s.read.parquet(f"{folder}/runs").select(
        "experiment", "run", F.map_keys("params").alias("params"), F.size("metrics").alias("n_metrics")
    )


def job_ledger(s, d) -> DataFrame:
    """Last state of a job, with the states it went through."""
    result, ledger = work_folder(s, "job-result"), work_folder(s, "job-ledger")
    sinks.run_batch_job(s, "whole book", "PD", requests(s, d), lambda x: S.score_batch(x, "loan_id"), result, ledger)
    log = s.read.parquet(ledger)
    states = log.groupBy(F.col("job_id").alias("_job")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("logged_at", "status"))), lambda x: x["status"]), ",").alias("states")
    )
    last = sinks.latest_jobs(log).join(states, F.col("job_id") == F.col("_job"))
    return last.select("job_name", "model_type", "status", "states", "total_records", "processed", "error_message")


def committed_batches(s, d) -> DataFrame:
    """Loans appended in two batches, one of them twice, beside a batch that was not committed."""
    path, book = work_folder(s, "committed"), loans(s, d)
    for batch in (0, 1, 0):
        sinks.append_batch(book.filter(F.year("issue_d") % 2 == batch), path, f"years-{batch}")
    book.write.parquet(f"{path}/data/batch_id=died")
    x = sinks.read_committed(s, path)
    return x.groupBy("batch_id", F.year("issue_d").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("loan_amnt").cast("double").alias("amount"))


def metrics_table(s, d) -> DataFrame:
    """The metrics of the load, appended to their table in two parts and read back."""
    path = work_folder(s, "metrics-table")
    for model in (F.col("model_type") == "PD", F.col("model_type") != "PD"):
        sinks.append_metrics(metrics(s, d).filter(model), path)
    return s.read.parquet(path).withColumn("metric_value", F.col("metric_value").cast("double"))


def snapshot_table(s, d) -> DataFrame:
    """Write the snapshot twice for one date; the table holds it once."""
    path = work_folder(s, "snapshots")
    for _ in range(2):
        sinks.write_snapshot(P.grade_snapshot(loans(s, d), "2024-01-31"), path)
    return s.read.parquet(path).groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_loans").alias("loans"), F.sum("total_exposure").cast("double").alias("exposure")
    )


# --- streams ---------------------------------------------------------------------
def _read_stream(s, d, name: str) -> DataFrame:
    schema = testbook.table(s, d, name).schema
    return s.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*").parquet(d)


def _stream_applications(s, d) -> DataFrame:
    """Orders arrive as a stream of applications."""
    raw = testbook.raw_from_tables(_read_stream(s, d, "orders"), testbook.table(s, d, "customer"), None)
    clean = Fe.derive_features(Fe.clean_fields(Fe.admissible_loans(raw)))
    return S.applications(clean.withColumn("is_default", F.lit(None).cast("boolean")))


def _streamed(s, applications: DataFrame) -> tuple[DataFrame, DataFrame]:
    path = work_folder(s, "stream-scores")
    SS.start_scoring(applications, path, work_folder(s, "stream-scores-progress")).awaitTermination()
    scored, rejected = SS.read_scored(s, path)
    return scored.select(
        "loan_ref", "model_type", F.col("prediction").cast("double").alias("prediction"), F.col("score").cast("int").alias("score"), "rating"
    ), rejected


def stream_scoring(s, d) -> DataFrame:
    """The stream's applications leave as predictions."""
    return _streamed(s, _stream_applications(s, d))[0]


def stream_quarantine(s, d) -> DataFrame:
    """Both outcomes of a stream whose inputs were shocked: predictions, and what was rejected for which fields."""
    shocked = _stream_applications(s, d).withColumns({"dti": F.col("dti") * 1.5, "fico_score": F.col("fico_score") + 10})
    scored, rejected = _streamed(s, shocked)
    scored = scored.select("loan_ref", "prediction", F.lit(None).cast("string").alias("violations"))
    return scored.unionByName(rejected.select(F.col("loan_id").cast("string").alias("loan_ref"), F.lit(None).cast("double").alias("prediction"), "violations"))


def _stream_windows(s, d) -> DataFrame:
    events = _read_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return SM.monitor_stream(events)


def stream_monitor(s, d) -> DataFrame:
    windows = _stream_windows(s, d)
    path = work_folder(s, "stream-windows")
    SS.start_append(windows, path, work_folder(s, "stream-windows-progress")).awaitTermination()
    return s.read.schema(windows.schema).parquet(path)


def stream_stability(s, d) -> DataFrame:
    """Stability of every closed day against the whole of the events."""
    expected = SM.reference_shares(testbook.table(s, d, "events"))
    path = work_folder(s, "stream-stability")
    query = SM.start_stability(_stream_windows(s, d), expected, path, work_folder(s, "stream-stability-progress"))
    query.awaitTermination()
    return s.read.parquet(path).select("window_start", "n", "psi")


_CLOSED = "window_start + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)"
_BATCH_SQL = SCORING["batch_scoring"][1]
_BATCH_SQL = (  # the file has no gaps
    _BATCH_SQL.replace("CASE WHEN loan_id % 19 = 0 THEN 0e0 ELSE fico_score END", "fico_score")
    .replace("CASE WHEN loan_id % 23 <> 0 THEN dti END", "dti")
    .replace("CASE WHEN loan_id % 29 <> 0 THEN int_rate END", "int_rate")
    .replace("CASE WHEN loan_id % 31 <> 0 THEN loan_amnt END", "loan_amnt")
)

QUERIES = {
    "train_pd": (lambda s, d: _metric_rows(s, [trained(s, d, "pd")]), None),
    "train_scorecard": (lambda s, d: T.coefficients(trained(s, d, "scorecard"), s), None),
    "train_lgd": (lambda s, d: _metric_rows(s, [trained(s, d, "lgd")]), None),
    "train_ead": (lambda s, d: _metric_rows(s, [trained(s, d, "ead")]), None),
    "stratified_folds": (
        folds,
        on_loans(f"""resolved AS (SELECT loan_id, CAST(is_default AS INTEGER) AS is_default FROM loans WHERE loan_status IN ({', '.join(f"'{x}'" for x in K.RESOLVED_STATUSES)})),
        placed AS (SELECT *, COUNT(*) OVER (PARTITION BY is_default) AS n, ROW_NUMBER() OVER (PARTITION BY is_default
          ORDER BY CAST('0x' || SUBSTR(MD5('42:' || CAST(loan_id AS VARCHAR)), 1, 13) AS BIGINT)) - 1 AS place FROM resolved)
        SELECT loan_id, is_default, CASE WHEN place < n * 60 // 100 THEN 'train' WHEN place < n * 80 // 100 THEN 'calibration' ELSE 'test' END AS fold FROM placed"""),
    ),
    "append_projection": (
        appended_projection,
        on_loans("""SELECT grade, term_months AS term, COUNT(*) AS n, CAST(SUM(loan_amnt) AS DOUBLE) AS amount, CAST(SUM(fico_avg) AS DOUBLE) AS fico,
        COUNT(*) FILTER (is_default) AS bad FROM loans WHERE issue_d IS NOT NULL GROUP BY 1, 2"""),
    ),
    "feature_importance": (importance, None),
    "model_scoring": (model_scores, None),
    "refit_comparison": (refit_comparison, None),
    "csv_roundtrip": (applications_file, _BATCH_SQL),
    "loans_csv_load": (loans_file, PORTFOLIO["portfolio_by_grade"][1]),
    "loans_csv_wide": (
        wide_loans_file,
        on_loans(f"""good AS (SELECT * FROM loans WHERE loan_id % 97 > 1)
        SELECT 'loans of grade ' || grade AS what, CAST(COUNT(*) AS VARCHAR) AS value FROM good GROUP BY grade
        UNION ALL SELECT 'sum of scores', CAST(CAST(SUM(fico_range_low) AS BIGINT) AS VARCHAR) FROM good
        UNION ALL SELECT 'rejected for loan_amnt', CAST(COUNT(*) AS VARCHAR) FROM raw_loans WHERE loan_id % 97 = 0
        UNION ALL SELECT 'rejected for open_acc', CAST(COUNT(*) AS VARCHAR) FROM raw_loans WHERE loan_id % 97 = 1
        UNION ALL VALUES {', '.join(f"('type of {c}', '{t}')" for c, t in _TYPES.items())}"""),
    ),
    "metrics_json": (
        metrics_file,
        on_loans(f"""{_FINAL}, {measures('', 'final_scored')}, m AS (SELECT ROUND(ROUND(auc * 2 - 1, 6), 4) AS gini, ROUND(ks, 4) AS ks,
          ROUND(ROUND(auc, 6), 4) AS auc_roc, ROUND(brier, 4) AS brier_score, 'analytic' AS model, n_obs AS n_test, ROUND(dr, 4) AS dr_test FROM measured)
        SELECT *, CAST(gini >= 0.2 AS INTEGER) AS eba_compliant FROM m"""),
    ),
    "saved_figures": (
        saved_figures,
        on_loans(f"""{_FINAL}, {measures('', 'final_scored')}, m AS (SELECT ROUND(ROUND(auc * 2 - 1, 6), 4) AS gini, ROUND(ks, 4) AS ks,
          ROUND(ROUND(auc, 6), 4) AS auc_roc, ROUND(brier, 4) AS brier_score FROM measured)
        SELECT 'PD' AS model_type, figure, value, CAST((SELECT gini >= 0.2 FROM m) AS INTEGER) AS eba_compliant
        FROM (UNPIVOT m ON COLUMNS(*) INTO NAME figure VALUE value)
        UNION ALL VALUES ('LGD', 'r2', 0.25e0, 1), ('LGD', 'rmse', 0.1235e0, 1), ('LGD', 'mae', 0.0355e0, 1), ('EAD', 'r2', 1e0, 1), ('EAD', 'rmse', 35.17e0, 1)"""),
    ),
    "full_reload": (
        full_reload,
        on_loans("""SELECT grade, CAST(YEAR(issue_d) AS INTEGER) AS issue_year, COUNT(*) AS n, CAST(SUM(loan_amnt) AS DOUBLE) AS amount FROM loans GROUP BY 1, 2"""),
    ),
    "batch_preview": (batch_preview, f"SELECT idx, grade, expected_loss FROM ({_BATCH_SQL}) ORDER BY idx LIMIT 100"),
    "run_log": (run_log, None),
    "job_ledger": (
        job_ledger,
        on_loans("""SELECT 'whole book' AS job_name, 'PD' AS model_type, 'done' AS status, 'pending,running,done' AS states, COUNT(*) AS total_records, COUNT(*) AS processed,
        CAST(NULL AS VARCHAR) AS error_message FROM loans"""),
    ),
    "metrics_table": (metrics_table, MONITORING["model_metrics"][1]),
    "append_committed": (
        committed_batches,
        on_loans("""SELECT 'years-' || (YEAR(issue_d) % 2) AS batch_id, CAST(YEAR(issue_d) AS INTEGER) AS year, COUNT(*) AS n, CAST(SUM(loan_amnt) AS DOUBLE) AS amount
        FROM loans WHERE issue_d IS NOT NULL GROUP BY 1, 2"""),
    ),
    "snapshot_table": (
        snapshot_table,
        on_loans("""SELECT '2024-01-31' AS snapshot_date, COUNT(DISTINCT grade) AS n, COUNT(*) AS loans, CAST(SUM(loan_amnt) AS DOUBLE) AS exposure FROM loans"""),
    ),
    "stream_scoring": (
        stream_scoring,
        on_loans(f"""{REQUESTS}, pds AS (SELECT loan_id, {SERVICE_PD} AS p FROM requests)
        SELECT CAST(loan_id AS VARCHAR) AS loan_ref, 'PD' AS model_type, ROUND(p, 6) AS prediction, {POINTS} AS score,
          {PD_RATINGS['service']} AS rating FROM pds"""),
    ),
    "stream_quarantine": (
        stream_quarantine,
        on_loans(f"""{REQUESTS}, shocked AS (SELECT * REPLACE (dti * 1.5e0 AS dti, fico_score + 10 AS fico_score) FROM requests),
        checked AS (SELECT *, CONCAT_WS(','{RANGE_SQL}) AS violations FROM shocked),
        pds AS (SELECT loan_id, violations, {SERVICE_PD} AS p FROM checked)
        SELECT CAST(loan_id AS VARCHAR) AS loan_ref, CASE WHEN violations = '' THEN ROUND(p, 6) END AS prediction,
          NULLIF(violations, '') AS violations FROM pds"""),
    ),
    "stream_monitor": (
        stream_monitor,
        f"""WITH days AS (SELECT DATE_TRUNC('day', ts) AS window_start, FLOOR(value / 50) * 50 AS band, COUNT(*) AS n,
        ROUND(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 6) AS mean_value, MAX(value) AS highest FROM events GROUP BY 1, 2)
        SELECT * FROM days WHERE {_CLOSED}""",
    ),
    "stream_stability": (
        stream_stability,
        f"""WITH days AS (SELECT DATE_TRUNC('day', ts) AS window_start, FLOOR(value / 50) * 50 AS band, COUNT(*) AS n FROM events GROUP BY 1, 2),
        expected AS (SELECT FLOOR(value / 50) * 50 AS band, COUNT(*) / CAST((SELECT COUNT(*) FROM events) AS DOUBLE) AS e FROM events GROUP BY 1),
        sizes AS (SELECT window_start, CAST(SUM(n) AS BIGINT) AS size FROM days GROUP BY 1),
        shares AS (SELECT sizes.window_start, size, GREATEST(e, 1e-8) AS e, GREATEST(COALESCE(n, 0) / CAST(size AS DOUBLE), 1e-8) AS a
          FROM sizes CROSS JOIN expected LEFT JOIN days ON days.window_start = sizes.window_start AND days.band = expected.band)
        SELECT window_start, size AS n, ROUND(SUM((a - e) * LN(a / e)), 6) AS psi FROM shares WHERE {_CLOSED} GROUP BY 1, 2""",
    ),
}
