"""Sinks: partitioned logs, merged tables, spreadsheet-safe text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import last_of_each


def formula_safe(x: Column) -> Column:
    """Text that a spreadsheet would take as a formula gets a leading quote."""
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def safe_frame(df: DataFrame) -> DataFrame:
    return df.withColumns({c: formula_safe(F.col(c)) for c, kind in df.dtypes if kind == "string"})


def write_monthly(df: DataFrame, path: str, date: str, partition: str = "call_month") -> None:
    """A folder a month; only the months of df are replaced."""
    df.withColumn(partition, F.date_format(date, "yyyyMM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_by_date(df: DataFrame, path: str, ts: str) -> None:
    """df behind what the log has, a folder a month, rows by date and time inside a file; rows without a time are left out."""
    dated = df.where(F.col(ts).isNotNull()).withColumns({"data_date": F.to_date(ts), "month": F.date_format(ts, "yyyyMM")})
    dated.sortWithinPartitions("month", ts).write.mode("append").partitionBy("month").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only; Spark's committer makes a failed write invisible. Two writers
    at once both append: a precondition on the whole table needs a table format."""
    df.write.mode("append").parquet(path)


def merge_insert_only(spark: SparkSession, base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base and new together; replacing a row of base is refused."""
    clash = new.select(*keys).join(base.select(*keys), list(keys), "left_semi").limit(1).count()
    if clash:
        raise ValueError("a new row has the key of an existing one")
    return base.unionByName(new, allowMissingColumns=True)


def latest_view(log: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """What an append-only log says now: the last row of each key."""
    return last_of_each(log, keys, position)


def retained(log: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """Rows from the cutoff on, and those whose time cannot be read."""
    at = F.try_to_timestamp(F.col(ts).cast("string"))
    return log.where(at.isNull() | (at >= cutoff))


def refuse_personal(df: DataFrame, names: Sequence[str] = ("phone", "phone_number", "customer_name", "transcript")) -> DataFrame:
    """df, unless a column has a name that may not leave, or a value like a phone number."""
    bad = sorted(set(df.columns) & set(names))
    if bad:
        raise ValueError(f"columns that may not be shared: {bad}")
    text = [c for c, kind in df.dtypes if kind == "string"]
    if text and df.where(" or ".join(f"`{c}` rlike '^0[689][0-9]{{8}}$'" for c in text)).limit(1).count():
        raise ValueError("a value looks like a phone number")
    return df
