"""Results in the form in which they are compared: doubles rounded, whole numbers as long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 6


def tidy(df: DataFrame, places: int = PLACES) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append(F.round(name, places).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("long").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
