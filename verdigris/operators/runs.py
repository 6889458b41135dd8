"""Runs of a model: qualification of a provider by a few calls, and an index of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Calls of a probe, and the statuses with which a request as such is refused.
PROBE_CALLS, REFUSED = 6, (400, 404, 422)


def qualification(calls: DataFrame, by: Sequence[str], model: str, provider: str) -> DataFrame:
    """(outcome, model, provider, reasoning_tokens, prompt_tokens, item_id, http_status)
    -> by, calls, parse_ok, status, of each probe.

    The first that applies: a refused request, an answer of another shape, reasoning
    where there should be none, another identity, usage that is missing or differs
    between replicates of an item, anything else that is off, and QUALIFIED.
    """
    items = calls.groupBy(*by, "item_id").agg(F.countDistinct(F.when(F.col("prompt_tokens") > 0, F.col("prompt_tokens"))).alias("_n"))
    splits = items.groupBy(*by).agg(F.count_if(F.col("_n") > 1).alias("split"))
    same = lambda c, want: F.coalesce(F.array_sort(F.collect_set(c)) == F.array(F.lit(want)), F.lit(False))
    sums = calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("outcome") == "ok").alias("parse_ok"),
        F.count_if(F.col("http_status").isin(*REFUSED)).alias("refused"),
        F.count_if(F.col("outcome").isin("not_json", "schema_violation")).alias("shape"),
        F.count_if(F.col("reasoning_tokens") != 0).alias("reasoned"),
        F.count_if(F.col("reasoning_tokens").isNull()).alias("unknown"),
        F.count_if(F.coalesce(F.col("prompt_tokens"), F.lit(0)) <= 0).alias("unused"),
        (same("model", model) & same("provider", provider)).alias("identity"),
    )
    rows = sums.join(splits, list(by))
    status = (
        F.when(F.col("refused") > 0, "REQUEST_INCOMPATIBLE")
        .when(F.col("shape") > 0, "SCHEMA_INCOMPATIBLE")
        .when(F.col("reasoned") > 0, "REGIME_INCOMPATIBLE")
        .when(~F.col("identity"), "IDENTITY_INCOMPATIBLE")
        .when((F.col("unused") > 0) | (F.col("split") > 0) | (F.col("unknown") > 0), "PROVENANCE_INCOMPATIBLE")
        .when((F.col("calls") != PROBE_CALLS) | (F.col("parse_ok") != PROBE_CALLS), "SCHEMA_INCOMPATIBLE")
        .otherwise("QUALIFIED")
    )
    return rows.select(*by, "calls", "parse_ok", status.alias("status"))


RUN = T.StructType([T.StructField(n, t) for n, t in (("run_id", T.StringType()), ("created_utc", T.StringType()), ("arm", T.StringType()), ("model_requested", T.StringType()), ("rows", T.LongType()), ("total_cost_usd_lower_bound", T.DoubleType()))])

#: Of run.json too: what was asked for, and the counts that outcomes and the token proof are made from.
_TEXTS, _NUMBERS = ("provider_requested", "prompt_id", "testset_sha", "scorer_sha"), ("items", "repeats")
_MAPS = {"outcome_counts": T.LongType(), "prompt_token_spread": T.StringType(), "split_items": T.StringType()}
_ASKED = [*[T.StructField(n, T.StringType()) for n in _TEXTS], *[T.StructField(n, T.LongType()) for n in _NUMBERS], *[T.StructField(n, T.MapType(T.StringType(), t)) for n, t in _MAPS.items()]]


def outcomes(counts: Column) -> Column:
    """`ok=300`, and behind it each other outcome by name; `-` without counts."""
    bad = F.array_sort(F.filter(F.map_entries(counts), lambda e: e["key"] != "ok"))
    ok = F.concat(F.lit("ok="), F.coalesce(F.try_element_at(counts, F.lit("ok")), F.lit(0)).cast("string"))
    said = F.array_join(F.concat(F.array(ok), F.transform(bad, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ", ")
    return F.when(F.size(counts) > 0, said).otherwise("-")


def token_proof(spread: Column, split: Column, repeats: Column) -> Column:
    """How many items with prompt tokens had one value of them over all repeats, marked
    SPLIT where some had several; n/a below two repeats, which cannot tell; `-` without any."""
    checked = F.size(F.filter(F.map_values(spread), lambda v: v.isNotNull() & ~v.isin("[]", "")))
    several = F.when(F.size(split) > 0, F.size(split)).otherwise(0)
    share = F.concat_ws("/", (checked - several).cast("string"), checked.cast("string"))
    few = F.concat(F.lit("n/a ("), F.coalesce(repeats.cast("string"), F.lit("no")), F.lit(" rep)"))
    return F.when(F.coalesce(F.size(spread), F.lit(-1)) <= 0, "-").when(F.coalesce(repeats, F.lit(0)) < 2, few).when(several > 0, F.concat(F.lit("SPLIT "), share)).otherwise(share)


def _run_files(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """Names of the folder's own directories, and of those that hold a run.json: one listing each."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return [], []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path(folder)) if s.isDirectory())
    return names, sorted(s.getPath().getParent().getName() for s in fs.globStatus(path(f"{folder}/*/run.json")))


def run_index(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each run.json in a directory of the folder: directory, readable, the RUN
    columns, provider, prompt, items, repeats and hashes as asked for, outcomes and
    token_proof; run_id is the directory's name where the file has none. Sorted by the
    time of creation, or else the id; files that are no JSON come last."""
    _, found = _run_files(spark, folder)
    files = spark.read.text([f"{folder}/{name}/run.json" for name in found], wholetext=True) if found else spark.createDataFrame([], "value string")
    whole = T.StructType([*RUN.fields, *_ASKED])
    rows = files.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("directory"), F.from_json("value", whole).alias("r"), F.try_parse_json("value").isNotNull().alias("readable"))
    rows = rows.select("directory", "readable", *[F.col(f"r.{f.name}") for f in whole.fields])
    rows = rows.withColumns({"run_id": F.coalesce("run_id", "directory"), "outcomes": outcomes(F.col("outcome_counts")), "token_proof": token_proof(F.col("prompt_token_spread"), F.col("split_items"), F.col("repeats"))})
    return rows.drop(*_MAPS).orderBy(F.desc("readable"), F.coalesce("created_utc", "run_id"), "directory")


def without_run(spark: SparkSession, folder: str) -> DataFrame:
    """directory, why: the folder's directories that have no run.json, or one that is no JSON."""
    names, found = _run_files(spark, folder)
    missing = spark.createDataFrame([(n,) for n in sorted(set(names) - set(found))], "directory string").withColumn("why", F.lit("no run.json"))
    bad = run_index(spark, folder).where(~F.col("readable")).select("directory", F.lit("unreadable run.json").alias("why"))
    return missing.unionByName(bad).orderBy("directory")
