"""Readers with fixed schemas, strict or tolerant as each format needs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import any_date, money, norm_phone, norm_reasons, norm_text, strip

LABEL_COLUMNS = ("call_id", "phone_number", "product", "call_result", "main", "secondary", "third", "parse_ok")


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Label rows of a CSV with a header, all columns text; absent ones are null."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in LABEL_COLUMNS])


def records(rows: DataFrame) -> DataFrame:
    """Normalised records of label rows: reasons are a sorted set; parse_ok is true where it is blank or says true, 1 or yes."""
    return rows.select(
        strip(F.col("call_id")).alias("call_id"),
        norm_phone(F.col("phone_number")).alias("phone"),
        norm_text(F.col("product")).alias("product"),
        norm_text(F.col("call_result")).alias("call_result"),
        norm_reasons(F.col("main"), F.col("secondary"), F.col("third")).alias("reasons"),
        F.coalesce(norm_text(F.col("parse_ok")).isin("true", "1", "yes"), F.lit(True)).alias("parse_ok"),
    )


class Registry:
    """Readers by name and version; a name that is unknown, or registered anew as another version, is refused."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {}

    def add(self, name: str, version: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
        if name in self._known and self._known[name][0] != version:
            raise ValueError(f"{name} is registered as version {self._known[name][0]}, not {version}")
        self._known[name] = (version, reader)

    def read(self, spark: SparkSession, name: str, version: str, path: str) -> DataFrame:
        if name not in self._known or self._known[name][0] != version:
            raise KeyError(f"no reader {name} of version {version}")
        return self._known[name][1](spark, path)


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with exactly the schema's fields: a line that does not parse, a
    missing or an unknown field, a byte order mark, a carriage return or bytes that
    are not UTF-8 are refused. Blank lines are passed by.

    The text reader takes a byte order mark off, so the first bytes of each file are
    looked at apart, a file at a time, as test sets are files of a few megabytes.
    """
    first = F.hex(F.substring("content", 1, 3))
    marked = spark.read.format("binaryFile").load(path).where(first.startswith("EFBBBF") | first.startswith("FFFE") | first.startswith("FEFF"))
    if not marked.isEmpty():
        raise ValueError(f"{path} starts with a byte order mark")
    lines = spark.read.option("lineSep", "\n").text(path).where("trim(value) <> ''")
    asked = sorted(f.name for f in schema.fields)
    keys = F.array_sort(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))
    odd = F.col("value").contains("\r") | ~F.is_valid_utf8("value")
    bad = odd | (keys != F.array(*[F.lit(k) for k in asked])) | F.from_json("value", schema).isNull()
    n = lines.where(bad).count()
    if n:
        raise ValueError(f"{n} lines of {path} are not of the schema")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def run_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line must parse, and there must be one."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows


def tolerant_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines without those that do not parse, a torn last line among them."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def delimited(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "|", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text; short lines are filled with nulls, surplus fields are dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)


def two_row_header(rows: Sequence[Sequence[object]]) -> list[str]:
    """Names of a sheet with two header rows: the second where it is filled, else the first."""
    top, below = rows[0], rows[1]
    return [str(b).strip() if b is not None and str(b).strip() else str(a).strip() for a, b in zip(top, below, strict=True)]


def union_named(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that one lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def latest_file(spark: SparkSession, folder: str, glob: str = "*") -> str | None:
    """Path of the newest file of a folder that Spark can list."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime")
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row["path"] if row else None


def predictions(spark: SparkSession, path: str, item: T.StructType) -> DataFrame:
    """Batch predictions, a JSON object a line with `key`, `status` and an array of
    items: a row for each item, one row with a null item where there are none,
    and outcome: SUCCESS, EMPTY, FAILED (by status) or INVALID (not JSON)."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("status", T.StringType()), T.StructField("line_items", T.ArrayType(item)), T.StructField("_bad", T.StringType())])
    raw = spark.read.text(path).select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    ok = F.col("_bad").isNull() & (F.col("status") == "ok")
    outcome = F.when(F.col("_bad").isNotNull(), "INVALID").when(~F.coalesce(ok, F.lit(False)), "FAILED").when(F.coalesce(F.size("line_items"), F.lit(0)) <= 0, "EMPTY").otherwise("SUCCESS")
    items = F.when(outcome == "SUCCESS", F.col("line_items"))
    return raw.select("key", outcome.alias("outcome"), F.explode_outer(items).alias("item"))


def file_name_fields(path: Column, names: Sequence[str], sep: str = "_", dates: Sequence[str] = ()) -> list[Column]:
    """Columns of the positions of a file's name, without folder and extension; null
    where there is no such position, or where one of `dates` is not eight digits."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), sep)
    at = {n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}
    return [(F.when(x.rlike(r"^[0-9]{8}$"), x) if n in dates else x).alias(n) for n, x in at.items()]


def ledger_columns(rows: DataFrame, amounts: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """Text columns as decimal(18,2) money and as dates (dd.mm.yyyy or ISO)."""
    typed = {c: money(F.col(c)) for c in amounts} | {c: any_date(F.col(c), "dd.MM.yyyy", "yyyy-MM-dd") for c in dates}
    return rows.withColumns(typed)
