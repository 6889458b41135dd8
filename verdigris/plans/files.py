"""Queries that go through files: tables are written in a format of the label pipeline to the
shared folder, read back by the library's reader, and held against SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import readers, writers
from ..sources.scratch import shared_path
from ..sources.versions import VersionedLog, drop_older
from .bindings import frame, table, with_frames

QUERIES: dict = {}


def query(name: str, sql: str, *frames: str):
    def add(f):
        QUERIES[name] = (f, with_frames(sql, *frames))
        return f

    return add


def _lines(df: DataFrame, name: str, text) -> str:
    """Path of text files with a line for each row; a null line is left out."""
    path = shared_path(df.sparkSession, name)
    df.select(text.alias("value")).where("value is not null").write.text(path)
    return path


#: An answer's row as files have it: blanks around, mixed case, tokens for no phone, several forms of the flag.
_FLAG = "case pos % 6 when 0 then 'True' when 1 then ' YES ' when 2 then '1' when 3 then 'false' when 4 then 'no' end"
_RAW = {
    "call_id": "concat(' ', call_id, ' ')", "phone_number": "coalesce(phone, case pos % 3 when 0 then 'None' when 1 then '0' end)", "product": "upper(product)", "call_result": "concat(call_result, ' ')",
    "main": "case when main is null then ' ' else concat(upper(main), ', other') end", "secondary": "secondary", "third": "third", "parse_ok": _FLAG,
}


def _label_files(spark, d) -> str:
    path = shared_path(spark, "labels")
    frame(spark, d, "inc").selectExpr(*[f"{x} as {c}" for c, x in _RAW.items()]).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("s01_label_csv", "select product, parse_ok, count(*) as n, count(phone_number) as phones, count(main) as mains, sum(length(call_id)) as width from (select " + ", ".join(f"{x} as {c}" for c, x in _RAW.items()) + " from {inc} as t) group by 1, 2", "inc")
def s01(spark, d):
    rows = readers.label_csv(spark, _label_files(spark, d))
    return rows.groupBy("product", "parse_ok").agg(F.count(F.lit(1)).alias("n"), F.count("phone_number").alias("phones"), F.count("main").alias("mains"), F.sum(F.length("call_id")).alias("width"))


@query(
    "s02_records",
    """select call_id, phone, product, call_result, pos % 6 not in (3, 4) as parse_ok,
  array_to_string(list_sort(list_distinct(list_filter([main, case when main is not null then 'other' end, secondary, third], lambda v: v is not null))), '|') as reasons from {inc} as t""",
    "inc",
)
def s02(spark, d):
    return readers.records(readers.label_csv(spark, _label_files(spark, d))).withColumn("reasons", F.array_join("reasons", "|"))


_CASE = T.StructType([T.StructField("id", T.StringType()), T.StructField("turns", T.LongType()), T.StructField("text", T.StringType())])


@query("s04_strict_jsonl", "select cast(conv_id as varchar) || '-' || cast(turn as varchar) as id, turn as turns, sha256(text) as text_sha from conversations where text is not null")
def s04(spark, d):
    rows = table(spark, d, "conversations").where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").cast("long").alias("turns"), "text")
    path = _lines(rows, "cases", F.to_json(F.struct("id", "turns", "text")))
    return readers.strict_jsonl(spark, path, _CASE).select("id", "turns", F.sha2("text", 256).alias("text_sha"))


_RUN = "item_id long, replicate int, outcome string, latency_s double, completion_tokens long"
_RUN_SQL = "select item_id, cast(replicate as int) as replicate, outcome, latency_s, cast(completion_tokens as bigint) as completion_tokens from {runs} as t"


def _run_line():
    return F.to_json(F.struct("item_id", "replicate", "outcome", "latency_s", "completion_tokens"))


@query("s05_run_log", _RUN_SQL, "runs")
def s05(spark, d):
    path = _lines(frame(spark, d, "runs"), "runs", _run_line())
    return readers.run_log(spark, path, T.StructType.fromDDL(_RUN))


@query("s06_torn_jsonl", f"{_RUN_SQL} where event_id % 10 <> 3", "runs")
def s06(spark, d):
    line = _run_line()
    torn = F.when(F.col("event_id") % 10 == 3, F.left(line, F.length(line) - 4)).otherwise(line)
    return readers.tolerant_jsonl(spark, _lines(frame(spark, d, "runs"), "torn", torn), T.StructType.fromDDL(_RUN))


@query("s09_delimited", "select cast(c_custkey as varchar) as code, case when c_custkey % 7 <> 1 then c_name end as name, case when c_custkey % 7 not in (1, 2) then c_mktsegment end as segment from customer")
def s09(spark, d):
    code, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 7
    few = F.when(kind == 1, F.array(code)).when(kind == 2, F.array(code, "c_name")).when(kind == 3, F.array(code, "c_name", "c_mktsegment", F.lit("surplus"), F.lit("")))
    line = F.array_join(F.coalesce(few, F.array(code, "c_name", "c_mktsegment")), "|")
    headed = table(spark, d, "customer").select(line.alias("value"))
    path = shared_path(spark, "delimited")
    headed.select(F.col("value").alias("code|name|segment")).write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return readers.delimited(spark, path, ["code", "name", "segment"])


@query(
    "s11_predictions",
    """select cast(o_orderkey as varchar) as key, case o_orderkey % 5 when 0 then 'FAILED' when 1 then 'EMPTY' when 2 then 'INVALID' else 'SUCCESS' end as outcome, n from (
  select o_orderkey, unnest(case when o_orderkey % 5 in (3, 4) then [0, 1, 2][1:1 + o_orderkey % 3] else [null] end) as n from orders) where o_orderkey % 5 <> 2
union all select null, 'INVALID', null from orders where o_orderkey % 5 = 2""",
)
def s11(spark, d):
    kind = F.col("o_orderkey") % 5
    items = F.when(kind >= 3, F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int")), lambda i: F.struct(i.alias("n")))).otherwise(F.array().cast("array<struct<n:int>>"))
    line = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("key"), F.when(kind == 0, "error: quota").otherwise("ok").alias("status"), items.alias("line_items")))
    path = _lines(table(spark, d, "orders"), "predictions", F.when(kind == 2, F.left(line, F.lit(9))).otherwise(line))
    return readers.predictions(spark, path, T.StructType([T.StructField("n", T.IntegerType())])).select("key", "outcome", F.col("item.n").alias("n"))


@query("s12_file_name_fields", "select cast(o_orderkey as varchar) as call_id, cast(o_custkey as varchar) as phone_number, case when o_orderkey % 11 <> 0 then strftime(o_orderdate, '%Y%m%d') end as record_date from orders")
def s12(spark, d):
    date = F.when(F.col("o_orderkey") % 11 == 0, F.lit("no.date")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    paths = table(spark, d, "orders").select(F.concat(F.lit("/calls/in/"), F.concat_ws("_", "o_orderkey", "o_custkey", date), F.lit(".wav")).alias("path"))
    return paths.select(*readers.file_name_fields(F.col("path"), ["call_id", "phone_number", "record_date"], dates=["record_date"]))


@query("s14_versioned_append", "select event_id, ts, event_type from events where event_type <> 'view' and ts >= (select max(ts) - interval 20 day from events where event_type <> 'view') union all select event_id, ts, event_type from events where event_type = 'view'")
def s14(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "event_type")
    log, views = VersionedLog(spark, shared_path(spark, "log")), F.col("event_type") == "view"
    newest = events.where(~views).agg((F.max("ts") - F.expr("interval 20 day")).cast("string")).first()[0]
    log.append(events.where(~views), prune=drop_older("ts", newest) if newest else None)
    log.append(events.where(views), newest_first="ts")
    return log.read()


@query("s16_monthly_log", "select strftime(o_orderdate, '%Y%m') as call_month, count(*) as n, count(*) filter (where o_orderkey % 2 = 0) as again, cast(sum(o_orderkey) as bigint) as keys from orders where o_orderdate is not null group by 1")
def s16(spark, d):
    """The first months are written twice; only they are replaced by the second writing."""
    path, orders = shared_path(spark, "monthly"), table(spark, d, "orders").where("o_orderdate is not null").select("o_orderkey", "o_orderdate")
    early = F.month("o_orderdate") <= 3
    writers.write_monthly(orders.where(~early | (F.col("o_orderkey") % 2 == 0)), path, "o_orderdate")
    writers.write_monthly(orders.where(early), path, "o_orderdate")
    rows = spark.read.schema("o_orderkey long, o_orderdate date, call_month string").parquet(path)
    return rows.groupBy("call_month").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("again"), F.sum("o_orderkey").alias("keys"))


@query("a52_date_logs", "select cast(cast(ts as date) as varchar) as data_date, strftime(ts, '%Y%m') as month, count(*) as n, min(event_id) as first_id from events where ts is not null group by 1, 2")
def a52(spark, d):
    """Two deliveries are appended to the logs of their months; each date's rows are read from its month."""
    path, events = shared_path(spark, "dates"), table(spark, d, "events").select("event_id", "ts")
    for part in (0, 1):
        writers.append_by_date(events.where(F.col("event_id") % 2 == part), path, "ts")
    log = spark.read.schema("event_id long, ts timestamp, data_date date, month string").parquet(path)
    return log.groupBy(F.col("data_date").cast("string").alias("data_date"), "month").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("l04_append_merge", "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def l04(spark, d):
    """Rows are appended in deliveries of any order; the log's view has the last row of each user."""
    path, events = shared_path(spark, "append"), table(spark, d, "events").select("event_id", "user_id", "event_type")
    for part in (2, 0, 1):
        writers.append_log(events.where(F.col("event_id") % 3 == part), path)
    return writers.latest_view(spark.read.schema(events.schema).parquet(path), ["user_id"], "event_id")
