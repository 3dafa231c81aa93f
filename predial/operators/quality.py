"""Quality reports and table checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(rows: DataFrame, key: str, columns: list[str], status: Column) -> DataFrame:
    """(metric, value): rows, duplicate keys, nulls by column, success rate, all in one pass."""
    metrics = {
        "filas": F.count("*").cast("double"),
        "duplicados": (F.count("*") - F.count_distinct(F.coalesce(F.col(key), F.lit("")))).cast("double"),
        **{f"nulos_{c}": F.count_if(F.col(c).isNull()).cast("double") for c in columns},
        "tasa_ok": F.bround(100 * F.avg(status.cast("double")), 2),
    }
    return _unpivot(rows.agg(*(v.alias(k) for k, v in metrics.items())), list(metrics))


def _unpivot(one: DataFrame, names: list[str]) -> DataFrame:
    long = F.explode(F.array(*(F.struct(F.lit(n).alias("metrica"), F.col(n).alias("valor")) for n in names)))
    return one.select(long.alias("m")).select("m.*")


def compare(left: DataFrame, right: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """(columna, diferencias): rows whose values differ, null equal to null (Q4); keys on one side count for every column."""
    columns = [c for c in left.columns if c != key and c in right.columns]
    both = left.select(key, *(F.col(c).alias(f"l_{c}") for c in columns)).withColumn("_l", F.lit(True)).join(
        right.select(key, *(F.col(c).alias(f"r_{c}") for c in columns)).withColumn("_r", F.lit(True)), key, "full_outer"
    )
    kinds = dict(left.dtypes)

    def differs(c: str) -> Column:
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        same = a.eqNullSafe(b)
        if kinds[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
        return ~same | F.col("_l").isNull() | F.col("_r").isNull()

    return _unpivot(both.agg(*(F.count_if(differs(c)).alias(c) for c in columns)), columns).withColumnsRenamed({"metrica": "columna", "valor": "diferencias"})


def checks(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(control, ok, fallas): conditions that every row must meet, in one pass (Q2)."""
    one = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
    long = _unpivot(one, list(conditions))
    return long.select(F.col("metrica").alias("control"), (F.col("valor") == 0).alias("ok"), F.col("valor").alias("fallas"))


def require(metrics: DataFrame, name: str, expected: float) -> None:
    """Fail unless a metric has a value (Q3)."""
    found = metrics.filter(F.col("metrica") == name).first()
    if found is None or found["valor"] != expected:
        raise ValueError(f"{name} is {found and found['valor']}, not {expected}")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows as often (U4)."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def null_unsafe_to_null(rows: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    floats = [c for c, kind in rows.dtypes if kind in ("double", "float")]
    return reduce(lambda df, c: df.withColumn(c, F.nanvl(F.col(c), F.lit(None).cast(dict(rows.dtypes)[c]))), floats, rows)
