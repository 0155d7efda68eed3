from datetime import datetime

from pyspark.sql import functions as F

from revsync import schemas

PAYMENT_ROW = schemas.struct(
    provider="string",
    raw_status="string",
    canonical_status="string",
    amount_minor="bigint",
    currency="string",
    occurred_at="timestamp_ntz",
)


def payments(spark, rows):
    return spark.createDataFrame(rows, PAYMENT_ROW)


def at(text):
    return datetime.fromisoformat(text)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def first(spark, *columns):
    """The given Columns, worked out once."""
    return tuple(spark.range(1).select(*columns).first())


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def each(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def lit_ts(text):
    return F.lit(text).cast("timestamp_ntz")
