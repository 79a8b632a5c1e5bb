"""Readers for the supported file layouts and named datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import Spec, nan_to_null
from ..operators.encode import binary_label, cast_double, factorize, member


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                   null_value: str | None = None, trim: bool = False) -> DataFrame:
    """Delimited text without a header."""
    options = {"sep": sep, "header": False, "ignoreLeadingWhiteSpace": trim}
    if null_value is not None:
        options["nullValue"] = null_value
    return spark.read.schema(schema).options(**options).csv(path)


def read_header_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header.  Without a schema one extra pass infers the types."""
    if schema is not None:
        return spark.read.schema(schema).csv(path, header=True)
    return spark.read.csv(path, header=True, inferSchema=True)


def number_rows(df: DataFrame) -> DataFrame:
    """Add a unique ``row_id`` that follows the order of the scan.

    The ids are not dense.  Give tables of many files an id column of their
    own instead, because the order of files in a scan is not by name.
    """
    return df.withColumn("row_id", F.monotonically_increasing_id())


# Column names, integer columns, file names, label and group
# values of the three supported public datasets.
ADULT = T.StructType(
    [
        T.StructField("age", T.IntegerType()),
        T.StructField("workclass", T.StringType()),
        T.StructField("fnlwgt", T.IntegerType()),
        T.StructField("education", T.StringType()),
        T.StructField("education_num", T.IntegerType()),
        T.StructField("marital_status", T.StringType()),
        T.StructField("occupation", T.StringType()),
        T.StructField("relationship", T.StringType()),
        T.StructField("race", T.StringType()),
        T.StructField("sex", T.StringType()),
        T.StructField("capital_gain", T.IntegerType()),
        T.StructField("capital_loss", T.IntegerType()),
        T.StructField("hours_per_week", T.IntegerType()),
        T.StructField("native_country", T.StringType()),
        T.StructField("income", T.StringType()),
    ]
)
GERMAN = T.StructType(
    [
        T.StructField("checking_status", T.StringType()),
        T.StructField("duration", T.IntegerType()),
        T.StructField("credit_history", T.StringType()),
        T.StructField("purpose", T.StringType()),
        T.StructField("credit_amount", T.IntegerType()),
        T.StructField("savings_status", T.StringType()),
        T.StructField("employment", T.StringType()),
        T.StructField("installment_commitment", T.IntegerType()),
        T.StructField("personal_status", T.StringType()),
        T.StructField("other_parties", T.StringType()),
        T.StructField("residence_since", T.IntegerType()),
        T.StructField("property_magnitude", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("other_payment_plans", T.StringType()),
        T.StructField("housing", T.StringType()),
        T.StructField("existing_credits", T.IntegerType()),
        T.StructField("job", T.StringType()),
        T.StructField("num_dependents", T.IntegerType()),
        T.StructField("own_telephone", T.StringType()),
        T.StructField("foreign_worker", T.StringType()),
        T.StructField("class", T.IntegerType()),
    ]
)
TITANIC = T.StructType(
    [
        T.StructField("PassengerId", T.IntegerType()),
        T.StructField("Survived", T.IntegerType()),
        T.StructField("Pclass", T.IntegerType()),
        T.StructField("Name", T.StringType()),
        T.StructField("Sex", T.StringType()),
        T.StructField("Age", T.DoubleType()),
        T.StructField("SibSp", T.IntegerType()),
        T.StructField("Parch", T.IntegerType()),
        T.StructField("Ticket", T.StringType()),
        T.StructField("Fare", T.DoubleType()),
        T.StructField("Cabin", T.StringType()),
        T.StructField("Embarked", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Dataset:
    """How a named source becomes a frame."""

    file: str
    read: Callable[[SparkSession, str], DataFrame]
    label: Callable[[], Column]
    protected: Callable[[], Column]
    drop: tuple[str, ...]
    outlier: str


DATASETS: dict[str, Dataset] = {
    "adult": Dataset(
        "adult.data",
        lambda spark, path: read_delimited(spark, path, ADULT, null_value="?", trim=True),
        lambda: binary_label("income", ">50K"),
        lambda: member("sex", "Female"),
        ("income",),
        "hours_per_week",
    ),
    "german": Dataset(
        "german.data",
        lambda spark, path: read_delimited(spark, path, GERMAN, sep=" "),
        lambda: binary_label("class", 1),
        lambda: member("personal_status", ["A92", "A95"]),
        ("class",),
        "duration",
    ),
    "titanic": Dataset(
        "titanic.csv",
        lambda spark, path: read_header_csv(spark, path, TITANIC),
        lambda: binary_label("Survived", 1),
        lambda: member("Sex", "female"),
        ("Survived", "PassengerId", "Name", "Ticket", "Cabin"),
        "Age",
    ),
}


def frame_of(df: DataFrame, label: Column, protected: Column, drop=(), outlier: str | None = None):
    """(frame, Spec) of a raw table that has a ``row_id``."""
    out = df.withColumns({"y": label, "protected": protected}).drop(*drop)
    spec = Spec.from_schema(out, outlier)
    return nan_to_null(cast_double(out, spec.num)), spec


def load_dataset(spark: SparkSession, name: str, folder: str, encode: bool = True):
    """(frame, Spec) of a named dataset; with ``encode`` categories are codes
    in first-appearance order."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; choose from {', '.join(sorted(DATASETS))}")
    d = DATASETS[name]
    raw = number_rows(d.read(spark, f"{folder.rstrip('/')}/{d.file}"))
    frame, spec = frame_of(raw, d.label(), d.protected(), d.drop, d.outlier)
    return (factorize(frame, spec.cat) if encode else frame), spec
