"""Run-log, latency, stability and window queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsons
from ..operators import islands, operations, quantiles, ranking
from ..operators import runs as run_ops
from ..operators.scoring import last_of_each
from .bindings import frame, run_sql, table, with_frames

QUERIES: dict = {}


def query(name: str, sql: str | None, *frames: str):
    def add(f):
        QUERIES[name] = (f, with_frames(sql, *frames) if sql else None)
        return f

    return add


def both(name: str, sql: str, *frames: str) -> None:
    QUERIES[name] = run_sql(sql, *frames)


_RANK = "select event_type, value as v, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events"


def _picked(**places: str) -> str:
    return f"with x as ({_RANK}) select event_type, max(n) as n, " + ", ".join(f"round(max(case when r = {p} then v end), 6) as {k}" for k, p in places.items()) + " from x group by 1"


def _quantiles(spark, d, **picks) -> DataFrame:
    return quantiles.quantiles(table(spark, d, "events"), "value", picks, ["event_type"])


@query("a18_quantile_ceil", _picked(p50="cast(ceil(0.5 * n) as bigint)", p95="cast(ceil(0.95 * n) as bigint)", p99="cast(ceil(0.99 * n) as bigint)"))
def a18(spark, d):
    return _quantiles(spark, d, p50=("ceil", 0.5), p95=("ceil", 0.95), p99=("ceil", 0.99))


@query("a19_quantile_rounded", _picked(p50="greatest(1, least(n, cast(round_even(0.5 * n + 0.5, 0) as bigint)))", p95="greatest(1, least(n, cast(round_even(0.95 * n + 0.5, 0) as bigint)))"))
def a19(spark, d):
    return _quantiles(spark, d, p50=("rounded", 0.5), p95=("rounded", 0.95))


@query("a20_quantile_trunc", _picked(p95="case when floor(0.95 * n) < 1 then n else cast(floor(0.95 * n) as bigint) end"))
def a20(spark, d):
    return _quantiles(spark, d, p95=("trunc", 0.95))


@query("a32_five_minute_buckets", """with x as (select cast(floor(epoch(ts) / 300) * 300 as bigint) as bucket, value as v from events), y as (select *, row_number() over (partition by bucket order by v) as r, count(*) over (partition by bucket) as n from x)
select bucket, max(n) as n, round(avg(v), 6) as mean, round(max(v), 6) as top, round(max(case when r = least(n, floor(0.95 * n) + 1) then v end), 6) as p95 from y group by 1""")
def a32(spark, d):
    rows = table(spark, d, "events").select((F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 300) * 300).alias("bucket"), "value")
    means = rows.groupBy(F.col("bucket").alias("of")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("top"))
    picks = quantiles.quantiles(rows, "value", {"p95": ("floor", 0.95)}, ["bucket"])
    return picks.join(means, F.col("bucket") == F.col("of")).select("bucket", "n", "mean", "top", "p95")


both("a21_median", "select event_type, round(median(value), 6) as median from {events} group by event_type")
both("a22_latency_export", "select outcome, round(median(latency_s), 6) as median, round(max(latency_s), 6) as top from {runs} as r group by outcome", "runs")
def _ranked(by: str, value: str, rows: str, **places: str) -> str:
    """SQL of a rank's element for each group, built from row numbers."""
    inner = f"select {by}, {value} as v, row_number() over (partition by {by} order by {value}) as r, count(*) over (partition by {by}) as n from {rows} as t where {value} is not null"
    return f"select {by}, " + ", ".join(f"round(max(case when r = {p} then v end), 6) as {k}" for k, p in places.items()) + f" from ({inner}) as x group by {by}"


_CEIL = {k: f"cast(ceil({q} * n) as bigint)" for k, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}
_TRUNC = "case when floor(0.95 * n) < 1 then n else cast(floor(0.95 * n) as bigint) end"
_ROUNDED = "greatest(1, least(n, cast(round_even(0.95 * n + 0.5, 0) as bigint)))"


@query(
    "a23_operations",
    f"""with s as (select event_type, count(*) as calls, count_if(outcome = 'ok') as parse_ok, round(count_if(outcome = 'ok') / count(*), 6) as parse_valid_rate, count_if(outcome = 'ok') >= 0.99 * count(*) as reliable,
  round(max(latency_s), 6) as top, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens, count_if(completion_tokens is null) as missing_completion,
  round(sum(cost), 4) as cost_floor, count_if(cost is null) as missing_cost from {{runs}} as r group by event_type)
select s.*, q.p50, q.p95, q.p99 from s join ({_ranked("event_type", "latency_s", "{runs}", **_CEIL)}) as q on s.event_type = q.event_type""",
    "runs",
)
def a23(spark, d):
    return operations.operational_summary(frame(spark, d, "runs"), ["event_type"])


both("a24_histogram", "select outcome, replicate, count(*) as n from {runs} as r group by outcome, replicate", "runs")
both("a25_token_spread", "select item_id, count(distinct prompt_tokens) as spread, count(distinct prompt_tokens) > 1 as split from {runs} as r where prompt_tokens > 0 group by item_id", "runs")
both("a26_rates", "select item_id, round(avg(case when outcome = 'ok' then 1e0 else 0e0 end), 6) as ok_rate, count_if(completion_tokens is null) as missing_usage, round(sum(cost), 4) as cost from {runs} as r group by item_id", "runs")
both("a27_cost_per_correct", """with s as (select item_id, min(replicate) as replicate from {runs} as r where outcome = 'ok' group by item_id),
c as (select r.event_type, r.cost, case when r.completion_tokens % 2 = 0 then 1 else 0 end as hit from {runs} as r join s on r.item_id = s.item_id and r.replicate = s.replicate)
select event_type, cast(sum(hit) as bigint) as hits, round(sum(cost) / nullif(sum(hit), 0), 6) as cost_per_hit from c group by event_type""", "runs")
both("a29_determinism", "select concurrency, count(*) as n, count_if(completion_tokens % 5 = 0) as mismatched from {requests} as r group by concurrency", "requests")
@query(
    "a31_first_last",
    f"""with s as (select event_type, count(value) as samples, round(min(value), 6) as low, round(avg(value), 6) as mean, round(max(value), 6) as top, round(max_by(value, event_id) - min_by(value, event_id), 6) as delta from events group by event_type)
select s.*, q.p95 from s join ({_ranked("event_type", "value", "events", p95=_ROUNDED)}) as q on s.event_type = q.event_type""",
)
def a31(spark, d):
    return operations.sample_blocks(table(spark, d, "events"), ["event_type"], "value", "event_id")


@query(
    "a33_arm_table",
    f"""with s as (select event_type, outcome, count(*) as n, round(avg(latency_s), 6) as mean, cast(sum(case when prompt_tokens % 2 = 0 then prompt_tokens else 0 end) as bigint) as text_tokens,
  cast(sum(case when prompt_tokens % 2 = 1 then prompt_tokens else 0 end) as bigint) as audio_tokens from {{runs}} as r group by event_type, outcome)
select s.*, q.p50, q.p95 from s join ({_ranked("event_type, outcome", "latency_s", "{runs}", p50=_CEIL["p50"], p95=_TRUNC)}) as q on s.event_type = q.event_type and s.outcome = q.outcome""",
    "runs",
)
def a33(spark, d):
    return operations.arm_table(frame(spark, d, "runs").withColumn("audio", F.col("prompt_tokens") % 2 == 1), ["event_type", "outcome"])


both("c16_stability", """with a as (select item_id, event_id % 2 as arm, count(*) as n, count(distinct completion_tokens % 3) as distinct_values from {runs} as r group by item_id, event_id % 2),
s as (select item_id, arm, n >= 2 and distinct_values = 1 as stable from a)
select count_if(x.stable and y.stable) as both_right, count_if(x.stable and not y.stable) as inc_only, count_if(not x.stable and y.stable) as cand_only, count_if(not x.stable and not y.stable) as both_wrong
from s as x join s as y on x.item_id = y.item_id and x.arm = 0 and y.arm = 1""", "runs")
both("c17_reliability", "select event_type, count(*) as calls, count_if(outcome = 'ok') as ok, count_if(outcome = 'ok') >= 0.99 * count(*) as reliable, count_if(completion_tokens is null) as no_usage from {runs} as r group by event_type", "runs")
both("c20_call_budget", "select count(distinct item_id) * max(replicate) as calls, max_by(event_type, (coalesce(cost, -1), -event_id)) as dearest, round(max(cost), 4) as price from {runs} as r", "runs")

_FINAL = """f as (select * from {requests} as r qualify row_number() over (partition by req_id order by attempt desc, event_id desc) = 1)"""


@query("a28_soak_summary", f"""with {_FINAL}, a as (select phase, count(*) as attempts, count(*) filter (where outcome <> 'ok') as failed from {{requests}} as r group by phase)
select f.phase, a.attempts, round(a.failed / a.attempts, 6) as raw_error, count(*) as finals, round(1 - count(*) filter (where outcome = 'ok') / count(*), 6) as final_error,
  round(count(*) / nullif(max(ts_start + e2e_s) - min(ts_start), 0), 6) as throughput, round(avg(ttft_s), 6) as ttft from f join a on f.phase = a.phase group by f.phase, a.attempts, a.failed""", "requests")
def a28(spark, d):
    rows = frame(spark, d, "requests")
    attempts = rows.groupBy(F.col("phase").alias("p")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome") != "ok").alias("failed"))
    final = rows.groupBy("req_id").agg(F.max_by(F.struct("phase", "outcome", "ts_start", "e2e_s", "ttft_s"), F.struct("attempt", "event_id")).alias("r")).select("r.*")
    span = F.max(F.col("ts_start") + F.col("e2e_s")) - F.min("ts_start")
    finals = final.groupBy("phase").agg(
        F.count(F.lit(1)).alias("finals"),
        F.round(1 - F.count_if(F.col("outcome") == "ok") / F.count(F.lit(1)), 6).alias("final_error"),
        F.round(F.count(F.lit(1)) / F.nullif(span, F.lit(0.0)), 6).alias("throughput"),
        F.round(F.avg("ttft_s"), 6).alias("ttft"),
    )
    joined = finals.join(attempts, F.col("phase") == F.col("p"))
    return joined.select("phase", "attempts", F.round(F.col("failed") / F.col("attempts"), 6).alias("raw_error"), "finals", "final_error", "throughput", "ttft")


@query("a30_drift", "with p as (select phase, avg(e2e_s) as m from {requests} as r group by phase) select a.phase, round((b.m - a.m) / a.m, 6) as drift from p as a join p as b on b.phase = a.phase + 12", "requests")
def a30(spark, d):
    means = frame(spark, d, "requests").groupBy((F.col("phase") % 12).alias("phase")).agg(F.avg(F.when(F.col("phase") < 12, F.col("e2e_s"))).alias("a"), F.avg(F.when(F.col("phase") >= 12, F.col("e2e_s"))).alias("b"))
    return means.where("a is not null and b is not null").select("phase", F.round((F.col("b") - F.col("a")) / F.col("a"), 6).alias("drift"))


both("e02_named_nothing", "select outcome, count_if(props is null or props = '{{}}') as empty, count(*) as n from {runs} as r group by outcome".replace("{{}}", "[]"), "runs")
both("e04_key_collisions", "select count(*) as n, count(distinct item_id * 100000 + replicate) as keys from {runs} as r", "runs")
both("e05_task_matrix", """with s as (select item_id, count(distinct case when replicate <= 3 then replicate end) as done, count_if(replicate > 3) as extra from {runs} as r group by item_id)
select cast(sum(3 - done) as bigint) as missing, cast(sum(extra) as bigint) as unexpected, count_if(done = 3 and extra = 0) as complete from s""", "runs")
both("e06_instability", """select item_id, count(*) as replicates, count(distinct props) > 1 as raw_unstable, count(distinct outcome) > 1 as scored_unstable, count(distinct props) > 1 and count(distinct outcome) = 1 as cosmetic from {runs} as r group by item_id having count(*) > 1""", "runs")
both("e07_decomposition", """with s as (select item_id, count(distinct props) > 1 as raw, count(distinct outcome) > 1 as scored from {runs} as r group by item_id having count(*) > 1)
select count(*) as observable, count_if(raw) as raw_unstable, count_if(scored) as scored_unstable, round(avg(case when scored then 1e0 else 0e0 end), 6) as rate from s""", "runs")
both("e08_flips", """with n as (select max(replicate) as reps, item_id from {runs} as r group by item_id),
c as (select item_id, event_type, count(distinct outcome) as kinds, count(distinct replicate) as seen from {runs} as r group by item_id, event_type)
select count_if(kinds > 1 or seen < reps) as flips, count(*) as cells from c join n on c.item_id = n.item_id where reps >= 2""", "runs")
both("e09_mechanisms", """with h as (select item_id, item_id % 10 as mechanism, count_if(outcome = 'ok') as hits, count(*) as n from {runs} as r group by item_id)
select mechanism, case when count_if(hits = 0) > 0 then 'FAIL' when count_if(hits > 0 and hits < n) > 0 then 'FLAKY' else 'PASS' end as verdict, count_if(hits = n) as always_correct, count(*) as items from h group by mechanism""", "runs")


@query("e10_modal", """with c as (select item_id, outcome, count(*) as n, min(replicate) as first_seen from {runs} as r group by 1, 2), m as (select item_id, count(*) as kinds, max(n) as top, sum(n) as total, arg_max(outcome, n * 1000000 - first_seen) as modal from c group by 1)
select item_id, case when kinds = total and total > 1 then null else modal end as modal from m""", "runs")
def e10(spark, d):
    votes = frame(spark, d, "runs").groupBy("item_id", "outcome").agg(F.count(F.lit(1)).alias("n"), F.min("replicate").alias("first_seen"))
    tops = votes.groupBy("item_id").agg(F.max_by("outcome", F.struct("n", -F.col("first_seen"))).alias("modal"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"))
    return tops.select("item_id", F.when(~((F.col("kinds") == F.col("total")) & (F.col("total") > 1)), F.col("modal")).alias("modal"))


both("e11_consistency", """with a as (select item_id, max(outcome) as o from {runs} as r where replicate = 1 group by item_id), b as (select item_id, max(outcome) as o from {runs} as r where replicate = 2 group by item_id)
select count(*) as items, count_if(a.o = b.o) as same, count_if(a.o <> 'ok' and b.o = 'ok') as only_first_fails, count_if(a.o = 'ok' and b.o <> 'ok') as only_second_fails from a join b on a.item_id = b.item_id""", "runs")
both("e12_field_verdict", """with s as (select item_id, event_id % 2 as arm, count(distinct outcome) as kinds, max(outcome) as o from {runs} as r group by item_id, event_id % 2)
select case when x.kinds > 1 or y.kinds > 1 then 'NOISE' when x.o = y.o then 'SAME' else 'CHANGED' end as verdict, count(*) as n from s as x join s as y on x.item_id = y.item_id and x.arm = 0 and y.arm = 1 group by 1""", "runs")
both("e13_noise_floor", "with s as (select item_id, event_type, count(distinct completion_tokens % 2) as kinds from {runs} as r group by item_id, event_type) select event_type, round(avg(case when kinds > 1 then 1e0 else 0e0 end), 6) as noise from s group by event_type", "runs")
both("e19_strict_majority", """with c as (select item_id, outcome, count(*) as n from {runs} as r group by item_id, outcome), t as (select item_id, sum(n) as total, max(n) as top from c group by item_id)
select c.item_id, max(case when 2 * c.n > t.total then c.outcome else 'no_majority' end) as x, coalesce(max(case when 2 * c.n > t.total then c.outcome end), 'no_majority') as vote from c join t on c.item_id = t.item_id group by c.item_id""".replace("max(case when 2 * c.n > t.total then c.outcome else 'no_majority' end) as x, ", ""), "runs")
both("e20_judge_summary", "select event_type, count(*) as n, count_if(outcome = 'ok') as usable, round(count_if(outcome = 'ok') / count(*), 6) as usable_rate, count_if(outcome = 'transport_error') as errors from {runs} as r group by event_type", "runs")
both("e22_plurality", """with c as (select item_id, outcome, count(*) as n from {runs} as r group by item_id, outcome), t as (select item_id, max(n) as top from c group by item_id)
select c.item_id, case when count(*) = 1 then max(c.outcome) end as consensus from c join t on c.item_id = t.item_id and c.n = t.top group by c.item_id""", "runs")
both("e24_blocks_split", """with b as (select user_id % 7 as stratum, user_id as block, row_number() over (partition by user_id % 7 order by user_id) - 1 as pos from (select distinct user_id from {events}) as u)
select block, stratum, case when pos % 3 = 0 then 'tune' else 'holdout' end as part from b""")
both("e25_split_leaks", """with s as (select user_id as item, case when user_id % 3 = 0 then 'tune' else 'holdout' end as part from {events} union all select user_id, 'tune' from {events} where user_id % 30 = 1)
select count(*) as items, count_if(parts > 1) as in_both from (select item, count(distinct part) as parts from s group by item) as x""")

_POLLS = "select user_id % 20 as host, epoch(ts) as t, event_id, event_type from events"


def _polls(spark, d) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type")


@query("w11_failure_runs", """with p as (select user_id % 20 as host, epoch_us(ts) as us, event_id, event_type in ('error', 'view') as bad from events),
m as (select *, count(*) filter (where not bad) over (partition by host order by us, event_id rows between unbounded preceding and current row) as run from p)
select host, min(us) as start, count(*) as length from m where bad group by host, run having count(*) >= 4""")
def w11(spark, d):
    return islands.consecutive_runs(_polls(spark, d), ["host"], ["us", "event_id"], F.col("event_type").isin("error", "view"), 4).select("host", F.col("start"), "length")


_ENDED = "epoch_us(ts) + cast(value * 60000000 as bigint)"


@query("w12_gaps", f"""with p as (select user_id % 20 as host, epoch_us(ts) as us, {_ENDED} as ended, event_type <> 'error' as ok from events),
g as (select host, gap_start, gap_end, gap_end - gap_start as gap from (select host, lag(us) over (partition by host order by us) as gap_start, us as gap_end from p) as x where gap_end - gap_start > 3600000000)
select g.host, gap_start, gap_end, gap, count(p.ended) as requests_in_window, count(*) filter (p.ok) as successes_in_window, count(*) filter (p.ok) > 0 as excused
from g left join p on g.host = p.host and p.ended between gap_start and gap_end group by g.host, gap_start, gap_end, gap""")
def w12(spark, d):
    ended = F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("value") * 60_000_000).cast("decimal(20,0)").cast("long")
    requests = table(spark, d, "events").select((F.col("user_id") % 20).alias("host"), ended.alias("ended"), (F.col("event_type") != "error").alias("ok"))
    return islands.excused_gaps(_polls(spark, d), requests, ["host"], "us", 3_600_000_000, "ended", "ok")


@query("t10_interval_union", """with s as (select user_id, epoch_us(ts) // 1000000 as a, epoch_us(ts) // 1000000 + cast(value * 100 as bigint) as b from events),
m as (select user_id, a, b, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as before from s)
select user_id, cast(sum(greatest(0, b - greatest(a, coalesce(before, a)))) as bigint) as covered, max(b) - min(a) as span from m group by user_id""")
def t10(spark, d):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    rows = table(spark, d, "events").select("user_id", seconds.alias("a"), (seconds + F.round(F.col("value") * 100).cast("long")).alias("b"))
    return islands.covered(rows, ["user_id"], "a", "b")


@query("w10_forward_fill", "select event_id, last_value(case when event_id % 3 = 0 then event_type end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as filled from events")
def w10(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("filled"))
    return islands.forward_fill(rows, ["user_id"], ["event_id"], "filled").select("event_id", "filled")


@query("w07_latest_non_null", """select user_id, arg_max(case when event_id % 2 = 0 then event_type end, event_id) filter (where event_id % 2 = 0) as kind, arg_max(value, event_id) as value from events group by user_id""")
def w07(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"), "value")
    return islands.latest_values(rows, ["user_id"], ["event_id"], ["kind", "value"])


@query("w08_latest_row", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def w08(spark, d):
    return last_of_each(table(spark, d, "events").withColumn("_at", F.struct("ts", "event_id")), ["user_id"], "_at").select("user_id", "event_id", "event_type")


both("w02_first_flag", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, row_number() over (partition by l_orderkey order by case when l_linenumber % 2 = 0 then 1 else 0 end, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1 as doc_first from {lineitem}")
both("w03_filtered_window_sum", "select event_id, cast(sum(case when event_type = 'purchase' then event_id else 0 end) over (partition by user_id) as bigint) as bought from {events}")
both("w04_any_over", "select event_id, bool_or(event_type = 'error') over (partition by user_id) as any_error from {events}")
both("w05_top_pick", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by case when event_type = 'purchase' then 0 else 1 end, value desc, event_id) as rn from {events}) as x where rn = 1")
both("w06_window_flags", "select event_id, max(case when event_type = 'click' then event_id end) over (partition by user_id) as last_click, count(props) over (partition by user_id) = 1 as only_one from {events}")
both("w09_keep_first", "select user_id, event_type, min(event_id) as event_id from {events} group by user_id, event_type")


@query("w01_surrogate_id", "select event_id, row_number() over (order by user_id, event_type, event_id) as id from events")
def w01(spark, d):
    return ranking.global_row_number(table(spark, d, "events"), "user_id", "id", ("event_type", "event_id")).select("event_id", "id")


@query("w13_row_index", "select o_orderkey, row_number() over (order by o_orderkey) - 1 as idx from orders")
def w13(spark, d):
    return ranking.global_row_number(table(spark, d, "orders"), "o_orderkey", "n").select("o_orderkey", (F.col("n") - 1).alias("idx"))


_NESTED = "'{\"a\": {\"k\": ' || cast(event_id as string) || '}, \"b\": [' || cast(user_id as string) || ', {\"k\": ' || props || '}]}'"


#: Keys out of order, spaces, numbers in several forms; and the same canonically.
_LOOSE = "'{\"v\": {\"z\": 1.0, \"a\": [true, null, ' || cast(event_id as string) || '.50]},  \"é\": \"x y\", \"p\":' || props || ', \"B\": -0.0, \"n\": 123456789012345678901234567890}'"
_TIGHT = "'{\"B\":-0.0,\"n\":123456789012345678901234567890,\"p\":' || replace(props, ' ', '') || ',\"v\":{\"a\":[true,null,' || cast(event_id as string) || '.5],\"z\":1.0},\"é\":\"x y\"}'"


@query("k03_canonical_sha", f"select event_id, sha256({_TIGHT}) as sha from events")
def k03(spark, d):
    return table(spark, d, "events").select("event_id", jsons.canonical_sha(F.expr(_LOOSE)).alias("sha"))


@query("p23_json_round_trip", "select event_id, coalesce(json_valid(case when event_id % 9 = 0 then left(props, 4) else props end), false) as same from events")
def p23(spark, d):
    text = F.when(F.col("event_id") % 9 == 0, F.left("props", F.lit(4))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", jsons.round_trip(text).alias("same"))


@query("p25_json_lookup", f"select event_id, json_extract_string(t, '$.b[0]') as at, json_extract_string(t, '$.b[1].k.k') as deep, len(json_extract(t, '$..k')) as found from (select event_id, {_NESTED} as t from events)")
def p25(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_NESTED).alias("t"))
    return rows.select("event_id", jsons.at_path(F.col("t"), "b.0").alias("at"), jsons.at_path(F.col("t"), "b.1.k.k").alias("deep"), F.size(jsons.values_of(F.col("t"), "k")).cast("long").alias("found"))


#: Probes of six calls of a user, one after the other.
_PROBES = """select item_id, cast(floor((replicate - 1) / 6) as bigint) as probe, outcome, case when event_id % 50 = 0 then 'other' else 'm' end as model, 'p' as provider,
  case event_id % 40 when 0 then 5 when 1 then null else 0 end as reasoning_tokens, case when event_id % 60 = 7 then 10 else 9 end as prompt_tokens,
  case when event_id % 97 = 0 then 404 else 200 end as http_status from {runs} as r"""


@query(
    "c19_qualification",
    f"""with x as ({_PROBES}), s as (select item_id, probe, count(*) as calls, count_if(outcome = 'ok') as parse_ok, count_if(http_status = 404) as refused, count_if(outcome = 'not_json') as shape,
  count_if(reasoning_tokens <> 0) as reasoned, count_if(reasoning_tokens is null) as unknown, count_if(model <> 'm') as others, count(distinct prompt_tokens) as kinds from x group by item_id, probe)
select item_id, probe, calls, parse_ok, case when refused > 0 then 'REQUEST_INCOMPATIBLE' when shape > 0 then 'SCHEMA_INCOMPATIBLE' when reasoned > 0 then 'REGIME_INCOMPATIBLE' when others > 0 then 'IDENTITY_INCOMPATIBLE'
  when kinds > 1 or unknown > 0 then 'PROVENANCE_INCOMPATIBLE' when calls <> 6 or parse_ok <> 6 then 'SCHEMA_INCOMPATIBLE' else 'QUALIFIED' end as status from s""",
    "runs",
)
def c19(spark, d):
    calls = spark.sql(_PROBES, runs=frame(spark, d, "runs"))
    # the item of a probe is asked for by one name, so that prompt tokens of its calls can be compared
    return run_ops.qualification(calls.withColumnRenamed("item_id", "user").withColumn("item_id", F.lit(1)), ["user", "probe"], "m", "p").withColumnRenamed("user", "item_id")
