"""Writers of stage outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BYTE_ORDER_MARK = "﻿"


def write_text_table(rows: DataFrame, path: str, sep: str = "\t", mark: bool = False) -> None:
    """Rows as TSV or CSV with a header, in as many files as there are partitions (SNK1); mark: a byte order mark before
    each header, which some spreadsheets need."""
    names = rows.columns
    if mark:
        rows = rows.toDF(*(BYTE_ORDER_MARK + c if i == 0 else c for i, c in enumerate(names)))
    rows.write.mode("overwrite").option("sep", sep).option("header", True).option("emptyValue", "").csv(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """A JSON document per line, nulls kept (SNK3, SNK4, SNK8)."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_evidence(table: DataFrame, summary: DataFrame, path: str) -> None:
    """A table and its summary as evidence (SNK9): CSV and JSON beside each other."""
    write_text_table(table, f"{path}/tabla", ",")
    write_documents(summary, f"{path}/resumen")


def stored_or_made(key: DataFrame, path: str, make: Callable[[], DataFrame], total: str, parts: str, tolerance: float = 1e-8) -> tuple[DataFrame, bool]:
    """A stored long table if it still fits, else a new one, which is stored (SNK10): (table, whether it was reused).

    key: the ids that are asked for, with the column total. The stored table fits if it has just these ids and if the column
    parts adds up to total for each.
    """
    spark, (name,) = key.sparkSession, [c for c in key.columns if c != total]
    try:
        stored = spark.read.parquet(path)
        sums = stored.groupBy(name).agg(F.sum(parts).alias("_sum"))
        both = key.join(sums, name, "full_outer")
        off = both.filter(F.col("_sum").isNull() | F.col(total).isNull() | (F.abs(F.col("_sum") - F.col(total)) > tolerance))
        if off.isEmpty():
            return stored, True
    except AnalysisException:
        pass  # nothing is stored, or something else
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False
