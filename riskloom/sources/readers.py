"""Readers for lender files, batch files, saved metrics and stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType, LongType, StringType

from riskloom import constants as K
from riskloom.schemas import APPLICATIONS, RAW_LOANS

# Columns of the loan file that each use reads; the scan skips the others.
_SHARED = (
    "loan_amnt", "funded_amnt", "term", "int_rate", "installment", "grade", "sub_grade", "emp_length",
    "home_ownership", "annual_inc", "verification_status", "loan_status", "purpose", "dti",
    "delinq_2yrs", "fico_range_low", "fico_range_high", "inq_last_6mths", "open_acc", "pub_rec",
    "revol_bal", "revol_util", "total_acc",
)
PROJECTIONS = {
    "load": ("loan_id", *_SHARED, "issue_d", "out_prncp", "total_pymnt", "total_rec_prncp", "total_rec_int",
             "recoveries", "last_pymnt_amnt"),
    "training": ("loan_id", *_SHARED, "recoveries", "out_prncp"),
    "exploration": ("loan_id", *_SHARED, "issue_d", "recoveries"),
    "validation": ("loan_id", *_SHARED, "issue_d"),
}


# Narrowest first; a column has the first type that all its values fit, and text otherwise.
INFERRED = ("null", "int", "double", "date", "text")


# What a cast or a parser can read at all has one of these shapes. A cast that fails costs an
# exception, many times the test, so other texts are not handed to it.
_PAD = r"[\x00-\x20\x7F]*"
_DIGITS = rf"^{_PAD}[-+]?[0-9]+{_PAD}$"
_NUMBER = rf"^{_PAD}[-+]?([.\p{{Nd}}][-+.\p{{Nd}}a-fA-FxXpP]*|[iInN][a-zA-Z]*){_PAD}$"
_DATE = rf"^{_PAD}[-+]?[0-9]{{4,7}}(-|{_PAD}$)"
_MONTH = r"^\P{Nd}{3,}-[-+]?\p{Nd}"


def _cast(text: Column, kind, shape: str) -> Column:
    return F.when(text.rlike(shape), text.try_cast(kind))


def _whole(text: Column, kind) -> Column:
    """A whole number, also where it is written with a decimal point, as in 690.0."""
    number = _cast(text, "decimal(38,18)", _NUMBER)
    return F.coalesce(_cast(text, kind, _DIGITS), F.when(number == F.floor(number), F.floor(number)).try_cast(kind))


def _read(text: Column, kind) -> Column:
    if isinstance(kind, IntegralType):
        return _whole(text, kind)
    return _cast(text, kind, _NUMBER) if isinstance(kind, FractionalType) else text.try_cast(kind)


def _text_rows(spark: SparkSession, path: str, trim: bool = False) -> DataFrame:
    text = spark.read.option("header", True)
    if trim:
        text = text.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return text.csv(path)


def inferred_types(spark: SparkSession, path: str) -> DataFrame:
    """Per column of a CSV file its narrowest type: null < int < double < date < text.

    One pass over the file. Each task keeps three flags a column, whether all values so far are
    whole numbers, numbers or dates, and whether there is a value; flags merge by AND and OR, so
    neither the order of rows nor their number matters.
    """
    rows = _text_rows(spark, path, trim=True)

    def flags(name: str) -> Column:
        c = F.col(f"`{name}`")
        month = F.when(c.rlike(_MONTH), F.try_to_date(c, "MMM-yyyy"))
        fits = (_whole(c, LongType()).isNotNull(), _cast(c, "double", _NUMBER).isNotNull(), _cast(c, "date", _DATE).isNotNull() | month.isNotNull())
        some = F.coalesce(F.bool_or(c.isNotNull()), F.lit(False))
        kinds = [F.when(~some, INFERRED[0]), *(F.when(F.bool_and(F.when(c.isNotNull(), f)), k) for f, k in zip(fits, INFERRED[1:], strict=False))]
        return F.struct(F.lit(name).alias("column"), F.coalesce(*kinds, F.lit(INFERRED[-1])).alias("type"))

    return rows.agg(F.array(*(flags(c) for c in rows.columns)).alias("found")).select(F.inline("found"))


def _by_name(spark: SparkSession, path: str, schema: str, columns: Sequence[str], key: str, trim: bool = False) -> DataFrame:
    """The named columns of a CSV file, wherever its header has them, cast to the schema.

    ``_unread`` lists the columns whose value is no value of their type. A missing key column
    is filled with row numbers; any other missing column is an error.
    """
    rows = _text_rows(spark, path, trim)
    if key not in rows.columns:
        rows = rows.withColumn(key, F.monotonically_increasing_id().cast("string"))
    absent = [c for c in columns if c not in rows.columns]
    if absent:
        raise ValueError(f"the file has no column {', '.join(absent)}")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    typed = [c for c in columns if not isinstance(kinds[c], StringType)]
    # each value is read once, before the rows that have an unreadable one are told
    rows = rows.select(*[_read(F.col(c), kinds[c]).alias(c) for c in columns], *[F.col(c).isNotNull().alias(f"_has_{c}") for c in typed])
    unread = F.array_compact(F.array(*[F.when(F.col(f"_has_{c}") & F.col(c).isNull(), F.lit(c)) for c in typed]))
    return rows.select(*columns, unread.alias("_unread"))


def read_loans_csv(spark: SparkSession, path: str, use: str = "load") -> DataFrame:
    """Raw loans from a CSV file with a header: columns by name, any order, others ignored.

    Rows with an unreadable value are left to ``rejected_loans_csv``. A file of which no row can
    be read is an error.
    """
    rows = _by_name(spark, path, RAW_LOANS, PROJECTIONS[use], "loan_id")
    good = rows.where(F.size("_unread") == 0).drop("_unread")
    if good.isEmpty() and not rows.isEmpty():  # reads up to the first good row
        reasons = ", ".join(f"{r['column']} ({r['n']})" for r in reject_counts(spark, path, use).orderBy(F.col("n").desc(), "column").collect())
        raise ValueError(f"no row of the file can be read; values that are none of their type: {reasons}")
    return good


def rejected_loans_csv(spark: SparkSession, path: str, use: str = "load") -> DataFrame:
    """The rows ``read_loans_csv`` leaves out, what could be read of them, and ``unread``: why."""
    rows = _by_name(spark, path, RAW_LOANS, PROJECTIONS[use], "loan_id").where(F.size("_unread") > 0)
    return rows.withColumnRenamed("_unread", "unread")


def reject_counts(spark: SparkSession, path: str, use: str = "load") -> DataFrame:
    """Rows left out per column whose value is no value of its type."""
    why = rejected_loans_csv(spark, path, use).select(F.explode("unread").alias("column"))
    return why.groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def read_applications_csv(spark: SparkSession, path: str) -> DataFrame:
    """A batch-scoring file, columns by name; blanks are gaps. Unreadable numbers become gaps too.

    Files without ``idx`` get row numbers.
    """
    schema = "idx long, " + APPLICATIONS
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    return _by_name(spark, path, schema, columns, "idx", trim=True).drop("_unread")


def read_saved_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Saved metrics of the PD model, with the default where a figure is absent."""
    saved = spark.read.schema(
        "gini double, ks double, auc_roc double, brier double, model string, n_test long, dr_test double"
    ).json(path)
    d = K.SAVED_METRIC_DEFAULTS
    filled = {
        "gini": F.coalesce("gini", F.lit(d["gini"])),
        "ks": F.coalesce("ks", F.lit(d["ks"])),
        "auc_roc": F.coalesce("auc_roc", F.lit(d["auc_roc"])),
        "brier_score": F.coalesce("brier", F.lit(d["brier_score"])),
    }
    return saved.select(*(c.alias(n) for n, c in filled.items()), "model", "n_test", "dr_test").withColumn(
        "eba_compliant", F.col("gini") >= 0.20
    )


def read_saved_figures(spark: SparkSession, pd_path: str, loss_paths: Mapping[str, str] | None = None) -> DataFrame:
    """Saved figures of all models, one row each: model_type, figure, value, eba_compliant.

    ``loss_paths`` names the saved errors of the LGD and EAD model; a model or figure that was
    not saved has its default.
    """
    pd = read_saved_metrics(spark, pd_path)
    names = ("gini", "ks", "auc_roc", "brier_score")
    figures = [F.struct(F.lit("PD").alias("model_type"), F.lit(n).alias("figure"), F.col(n).alias("value"), "eba_compliant") for n in names]
    out = pd.select(F.inline(F.array(*figures)))
    for model, defaults in K.SAVED_ERROR_DEFAULTS.items():
        path = (loss_paths or {}).get(model)
        saved = spark.range(1) if path is None else spark.read.schema("r2 double, rmse double, mae double").json(path)
        value = {n: F.lit(v) if path is None else F.coalesce(n, F.lit(v)) for n, v in defaults.items()}
        rows = [F.struct(F.lit(model).alias("model_type"), F.lit(n).alias("figure"), v.alias("value"), F.lit(True).alias("eba_compliant")) for n, v in value.items()]
        out = out.unionByName(saved.select(F.inline(F.array(*rows))))
    return out


def read_table(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """A stored table. Errors are raised; no stand-in rows are ever returned."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)
