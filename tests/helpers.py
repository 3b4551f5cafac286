"""Helpers shared by the tests of the tables and jobs."""

from datetime import datetime

from snarelight.model import SCHEMAS

DAY = datetime(2024, 3, 1, 9, 0, 0)


def table(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMAS[name])


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
