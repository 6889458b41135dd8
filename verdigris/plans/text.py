"""Transcript, evidence, severity, grouped-report and log queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import norm_reasons
from ..operators import scoring as sc
from ..operators import transcripts as tr
from ..operators import usage
from .bindings import REASONS, frame, run_sql, table, with_frames

QUERIES: dict = {}


def query(name: str, sql: str | None, *frames: str):
    def add(f):
        QUERIES[name] = (f, with_frames(sql, *frames) if sql else None)
        return f

    return add


def both(name: str, sql: str, *frames: str) -> None:
    QUERIES[name] = run_sql(sql, *frames)


def _scored(spark, d, kind):
    """Of all documents, also those that a pooled rate leaves out."""
    return tr.error_counts(tr.spread(frame(spark, d, "whole_texts")), "ref", "hyp", kind)


def _totals(spark, d):
    """Of what a pooled rate is made of: a transcript that ran away has no rate."""
    rows = tr.with_runaways(tr.spread(frame(spark, d, "whole_texts")), "ref", "hyp").where("runaway is null").drop("runaway")
    return tr.error_totals(rows, "ref", "hyp", "char")


@query("t01_edit_counts", None)
def t01(spark, d):
    return _scored(spark, d, "char").select("doc_id", "substituted", "deleted", "inserted", "units")


@query("t02_edit_distance", None)
def t02(spark, d):
    return tr.error_totals(tr.spread(frame(spark, d, "whole_texts")), "ref", "hyp", "char").select("doc_id", F.col("errors").alias("distance"))


@query("t03_word_errors", None)
def t03(spark, d):
    return _scored(spark, d, "word").select("doc_id", "substituted", "deleted", "inserted", "units")


@query("t03_rates", None)
def t03_rates(spark, d):
    """Hypotheses also differ in what the lossless form forgives: digits of another script, zero-width characters, white space."""
    hyp = F.when(F.col("doc_id") % 3 == 0, F.translate("hyp", "0123456789", "๐๑๒๓๔๕๖๗๘๙")).when(F.col("doc_id") % 3 == 1, F.replace("hyp", F.lit(" a"), F.lit("  \u200ba"))).otherwise(F.col("hyp"))
    rows = tr.spread(frame(spark, d, "whole_texts")).withColumn("hyp", hyp)
    return tr.pooled_rates(tr.rate_errors(rows, "ref", "hyp"), ["family"])


@query("t04_lossless", "select n_nationkey, trim(regexp_replace(translate(nfc_normalize(n_name || '  ๑๒ เเ'), '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '\\s+', ' ', 'g')) as x from nation".replace("nfc_normalize(n_name || '  ๑๒ เเ')", "replace(nfc_normalize(n_name || '  ๑๒ เเ'), 'เเ', 'แ')"))
def t04(spark, d):
    return table(spark, d, "nation").select("n_nationkey", tr.lossless(F.concat("n_name", F.lit("  ๑๒ เเ"))).alias("x"))


@query("t05_runaways", None)
def t05(spark, d):
    rows = frame(spark, d, "whole_texts").withColumn("hyp", F.when(F.col("doc_id") % 10 == 0, F.repeat("hyp", F.lit(2))).otherwise(F.col("hyp")))
    return tr.with_runaways(rows, "ref", "hyp").select("doc_id", "runaway")


@query("t06_pooled_rate", None)
def t06(spark, d):
    return tr.pooled_rate(_totals(spark, d))


@query("t07_rate_by_family", None)
def t07(spark, d):
    return tr.pooled_rate(_totals(spark, d), ["family"])


@query("t11_outlier_share", None)
def t11(spark, d):
    return tr.outlier_share(_totals(spark, d), "doc_id", ["family"])


_LAT, _LON = "13 + (s_suppkey % 100) / 1000e0", "100 + (s_suppkey % 77) / 1000e0"


@query("t16_gps_flag", f"with p as (select s_suppkey, {_LAT} as lat, {_LON} as lon from supplier) select s_suppkey, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(13.05e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(13.05e0)) * pow(sin(radians(100.03e0 - lon) / 2), 2))), 3) as metres from p")
def t16(spark, d):
    here = tr.haversine(F.expr(_LAT), F.expr(_LON), F.lit(13.05), F.lit(100.03))
    return table(spark, d, "supplier").select("s_suppkey", F.round(here, 3).alias("metres"))


@query("e01_flatten_payload", "select event_id, unnest(json_keys(props)) as k, cast(json_extract_string(props, '$.k') as bigint) as v from events")
def e01(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("k", "v"))


both("e15_partition_sums", "select count(*) = count_if(role = 'user') + count_if(role = 'assistant') + count_if(role = 'system') as holds, count(*) as n from {conversations}")
both("e16_fabrication", """with s as (select i.call_id, i.secondary as label, g.secondary as truth from {inc} as i join {gt} as g on i.call_id = g.call_id and i.product = g.product where i.parse_ok union all
select i.call_id, i.third, g.third from {inc} as i join {gt} as g on i.call_id = g.call_id and i.product = g.product where i.parse_ok)
select count_if(truth is null) as blank_slots, count_if(truth is null and label is not null) as fabricated, count(*) as slots from s""", "inc", "gt")


def _severity(spark, d):
    joined = sc.label_join(frame(spark, d, "gt"), frame(spark, d, "inc")).where(F.col("gt").isNotNull())
    truth, answer = norm_reasons(F.col("gt.main"), F.col("gt.secondary"), F.col("gt.third")), norm_reasons(F.col("pred.main"), F.col("pred.secondary"), F.col("pred.third"))
    return joined.select(tr.severity(truth, answer, REASONS[:9], F.col("pred").isNotNull(), F.coalesce(F.col("pred.parse_ok"), F.lit(False))).alias("severity"))


_VOCAB = "[" + ", ".join(f"'{r}'" for r in REASONS[:9]) + "]"
_S = "list_distinct(list_filter([{0}.main, {0}.secondary, {0}.third], lambda v: v is not null))"
_SEVERITY = f"""with g as (select * from {{gt}} as t qualify row_number() over (partition by call_id, phone, product order by pos desc) = 1), p as (select * from {{inc}} as t qualify row_number() over (partition by call_id, phone, product order by pos desc) = 1),
j as (select p.call_id is not null as there, coalesce(p.parse_ok, false) as ok, {_S.format('g')} as t, {_S.format('p')} as a from g left join p on g.call_id = p.call_id and g.phone is not distinct from p.phone and g.product = p.product),
n as (select *, len(list_filter(t, lambda v: not list_contains(a, v))) as missing, len(list_filter(a, lambda v: not list_contains(t, v))) as extra, len(list_filter(a, lambda v: not list_contains({_VOCAB}, v))) as odd from j),
s as (select case when not there then 'missing_output' when not ok then 'invalid_output' when odd > 0 then 'fabricated_class' when missing = 0 and extra = 0 then 'correct' when len(t) = 0 then 'unsupported_claim' when len(a) = 0 then 'no_answer' when missing = 0 then 'over_labelling' when extra = 0 then 'under_labelling' else 'substitution' end as severity from n)"""


@query("e17_severity", f"{_SEVERITY} select severity, count(*) as n from s group by 1", "gt", "inc")
def e17(spark, d):
    return _severity(spark, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


_ROSTER = ("missing_output", "invalid_output", "fabricated_class", "unsupported_claim", "no_answer", "over_labelling", "under_labelling", "substitution")


@query("e18_severity_profile", f"{_SEVERITY}, r as (select unnest([{', '.join(repr(x) for x in _ROSTER)}]) as severity), c as (select severity, count(*) as n from s group by 1) select r.severity, coalesce(n, 0) as n, round(coalesce(n, 0) / (select count(*) from s), 6) as rate from r left join c on r.severity = c.severity", "gt", "inc")
def e18(spark, d):
    counts = [F.count_if(F.col("severity") == x).alias(x) for x in _ROSTER]
    one = _severity(spark, d).agg(F.count(F.lit(1)).alias("_all"), *counts)
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("severity"), F.col(x).alias("n"), F.round(F.col(x) / F.col("_all"), 6).alias("rate")) for x in _ROSTER])))


both("e21_disagreements", "select toxic, quality, count(*) as n from {labels} where not (toxic = 0 and quality = 1) group by toxic, quality")


@query("e23_stratified_sample", "select doc_id, lang from documents qualify row_number() over (partition by lang order by md5('s' || cast(doc_id as string)), doc_id) <= 5")
def e23(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string"))), "doc_id")
    return table(spark, d, "documents").withColumn("_n", F.row_number().over(w)).where("_n <= 5").select("doc_id", "lang")


@query("e27_citation_union", "select event_type, array_to_string(list_sort(list_distinct(list(cast(user_id % 13 as string)))), ',') as cites from events group by 1")
def e27(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 13).cast("string"))), ",").alias("cites"))


@query("e31_slice_f1", "with g as (select call_id, product, call_result from {gt} as t where phone is not null), p as (select call_id, product, call_result from {inc} as t where phone is not null), j as (select g.call_result as a, p.call_result as b from g join p using (call_id, product) where cast(g.call_id as bigint) % 2 = 0) select count_if(a = 'save' and b = 'save') as tp, round(2.0 * count_if(a = 'save' and b = 'save') / (count_if(a = 'save') + count_if(b = 'save')), 6) as f1 from j", "gt", "inc")
def e31(spark, d):
    g = frame(spark, d, "gt").where("phone is not null").select("call_id", "product", F.col("call_result").alias("a"))
    p = frame(spark, d, "inc").where("phone is not null").select("call_id", "product", F.col("call_result").alias("b"))
    j = g.join(p, ["call_id", "product"]).where(F.col("call_id").cast("long") % 2 == 0)
    hit, a, b = F.count_if((F.col("a") == "save") & (F.col("b") == "save")), F.count_if(F.col("a") == "save"), F.count_if(F.col("b") == "save")
    return j.agg(hit.alias("tp"), F.round(2.0 * hit / (a + b), 6).alias("f1"))


both("a34_performance_log", "select event_type, user_id % 4 as project, count(*) as n, count_if(event_type <> 'error') as passed, round(sum(value), 2) as latency, round(avg(value), 6) as mean from {events} group by event_type, user_id % 4")
both("a36_shop_row", "select user_id, count(*) as n, count_if(event_type = 'purchase') as bought, round(avg(value), 6) as mean from {events} group by user_id")
both("a38_status_rollup", "select user_id, case when bool_and(event_type <> 'error') then 'SUCCESS' when bool_or(event_type <> 'error') then 'PARTIAL' else 'FAILED' end as status from {events} group by user_id")


@query("a35_operation_log", "select event_type, round(avg(value), 6) as mean, cast(epoch(max(ts)) - epoch(min(ts)) as bigint) as runtime from events group by 1")
def a35(spark, d):
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), (F.unix_micros(F.max(at)) / 1e6 - F.unix_micros(F.min(at)) / 1e6).cast("decimal(20,6)").cast("double").alias("exact")).select("event_type", "mean", F.round("exact").cast("long").alias("runtime"))


#: Prices of a thousand tokens: model, direction, modality, price.
_PRICES = [
    ("click", "input", "text", 0.15), ("click", "input", "audio", 0.5), ("click", "output", "all", 1.25),
    ("view", "input", "all", 0.1), ("view", "output", "text", 0.3), ("view", "output", "thoughts", 0.4), ("purchase", "input", "text", 1.0),
]


@query(
    "a37_cost_pricing",
    f"""with p(model, direction, modality, price) as (values {", ".join(map(str, _PRICES))}),
u as (select event_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k, user_id, event_id % 50 as cached, event_id % 5 as thoughts from events),
t as (select event_id, event_type, 'input' as direction, 'text' as modality, greatest(k + 3 - cached, 0) as n from u union all select event_id, event_type, 'input', 'audio', greatest(user_id - greatest(cached - k - 3, 0), 0) from u
union all select event_id, event_type, 'output', 'text', k from u union all select event_id, event_type, 'output', 'thoughts', thoughts from u),
c as (select t.*, coalesce(a.price, b.price) as price from t left join p as a on a.model = t.event_type and a.direction = t.direction and a.modality = t.modality left join p as b on b.model = t.event_type and b.direction = t.direction and b.modality = 'all'),
r as (select event_id, event_type, round(coalesce(sum(n * price / 1000) filter (direction = 'input'), 0), 6) as i, round(coalesce(sum(n * price / 1000) filter (direction = 'output'), 0), 6) as o, coalesce(sum(n) filter (price is null), 0) as u from c group by 1, 2)
select event_type, round(sum(i), 4) as cost_input, round(sum(o), 4) as cost_output, cast(sum(u) as bigint) as unpriced from r group by 1""",
)
def a37(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    detail = lambda *parts: F.array(*[F.struct(F.lit(m).alias("modality"), n.alias("tokenCount")) for m, n in parts])
    said = F.struct(
        detail(("TEXT", k), ("AUDIO", F.col("user_id")), ("TEXT", F.lit(3).cast("long"))).alias("promptTokensDetails"),
        detail(("TEXT", k)).alias("candidatesTokensDetails"),
        (F.col("event_id") % 5).alias("thoughtsTokenCount"),
        (F.col("event_id") % 50).alias("cachedContentTokenCount"),
    )
    prices = spark.createDataFrame([(m, way, kind, price / 1000) for m, way, kind, price in _PRICES], "model string, direction string, modality string, cost_per_token double")
    rows = usage.usage_tokens(table(spark, d, "events").select("event_type", F.to_json(said).alias("usage")))
    costs = usage.with_costs(rows, prices, "event_type").groupBy("event_type")
    return costs.agg(F.round(F.sum("cost_input"), 4).alias("cost_input"), F.round(F.sum("cost_output"), 4).alias("cost_output"), F.sum("unpriced").alias("unpriced"))


@query("a39_messages_in_order", "with f as (select user_id, event_type, min(event_id) as pos from events group by 1, 2) select user_id, string_agg(event_type, ', ' order by pos) as messages from f group by 1")
def a39(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ", ").alias("messages"))


both("a40_any_failed", "select event_id, bool_or(event_type = 'error') over (partition by user_id) as file_failed from {events}")
both("a41_all_complete", "select user_id, bool_and(event_type in ('purchase', 'click', 'view')) as complete from {events} group by user_id")


@query("a42_weighted_service", "with c as (select c_custkey, 'greet' as item, c_custkey % 3 as s from customer union all select c_custkey, 'close', c_custkey % 4 from customer), w(item, w) as (values ('greet', 3), ('close', 2)) select c_custkey, round(sum(case when s = 0 then w else 0 end) / nullif(sum(case when s in (0, 1) then w else 0 end), 0), 2) as score from c join w using (item) group by 1")
def a42(spark, d):
    cells = F.array(*[F.struct(F.lit(w).alias("w"), (F.col("c_custkey") % m).alias("s")) for w, m in ((3, 3), (2, 4))])
    rows = table(spark, d, "customer").select("c_custkey", F.inline(cells))
    met, seen = F.sum(F.when(F.col("s") == 0, F.col("w")).otherwise(0)), F.sum(F.when(F.col("s").isin(0, 1), F.col("w")).otherwise(0))
    return rows.groupBy("c_custkey").agg(F.round(met / F.nullif(seen, F.lit(0)), 2).alias("score"))


@query("a43_status_pivot", "select user_id % 5 as svc, count_if(event_type = 'error') as failed, count_if(event_type = 'purchase') as success, count(*) as total from events where event_type in ('error', 'purchase') group by 1")
def a43(spark, d):
    rows = table(spark, d, "events").where("event_type in ('error', 'purchase')").select((F.col("user_id") % 5).alias("svc"), "event_type")
    wide = rows.groupBy("svc").pivot("event_type", ["error", "purchase"]).count().na.fill(0)
    return wide.select("svc", F.col("error").alias("failed"), F.col("purchase").alias("success"), (F.col("error") + F.col("purchase")).alias("total"))


both("a44_full_grid", "select s.svc, k.kind, coalesce(c.n, 0) as n from (select distinct user_id % 9 as svc from {events}) as s join (select distinct event_type as kind, 1 as one from {events}) as k on k.one = 1 left join (select user_id % 9 as svc, event_type as kind, count(*) as n from {events} where value > 90 group by user_id % 9, event_type) as c on s.svc = c.svc and k.kind = c.kind")


@query("a45_group_lists", "select n_regionkey, string_agg(n_name, ',' order by n_name) as nations from nation group by 1")
def a45(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


both("a46_mix_shares", "select product, count(*) as n, round(count(*) / (sum(count(*)) over ()), 6) as share from {gt} as g group by product", "gt")
both("a47_fix_effect", "select count_if(g.call_result = i.call_result and g.call_result = c.call_result) as both_hit, count_if(g.call_result = i.call_result and g.call_result <> c.call_result) as lost, count_if(g.call_result <> i.call_result and g.call_result = c.call_result) as won, count(*) as n from {gt} as g join {inc} as i on g.call_id = i.call_id and g.product = i.product join {cand} as c on g.call_id = c.call_id and g.product = c.product", "gt", "inc", "cand")
both("a48_zone_summary", "select coalesce(r_name, 'Total') as zone, count(*) as n, count_if(c_acctbal < 0) as negative from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey group by rollup(r_name)")
both("a49_suspicious_summary", "select coalesce(r_name, 'Total') as zone, count(*) - count_if(s_suppkey % 3 = 0) as unverified from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey group by rollup(r_name)")
both("a50_worst_of", "select user_id, case when bool_or(event_type = 'error') then 'Below' when bool_or(event_type = 'click') then 'Meet' else 'N/A' end as category from {events} group by user_id")


@query("a51_tokens_by_modality", "select user_id % 10 as grp, cast(sum(case when event_type = 'click' then cast(json_extract_string(props, '$.k') as bigint) else 0 end) as bigint) as text_tokens, cast(sum(case when event_type = 'view' then cast(json_extract_string(props, '$.k') as bigint) else 0 end) as bigint) as audio_tokens from events group by 1")
def a51(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("grp"))
    return rows.agg(F.sum(F.when(F.col("event_type") == "click", k).otherwise(0)).alias("text_tokens"), F.sum(F.when(F.col("event_type") == "view", k).otherwise(0)).alias("audio_tokens"))


both("l02_unresolved", "select s.event_id from (select event_id from {events} where event_id % 2 = 0) as s where not exists (select 1 from (select event_id as f from {events} where event_id % 6 = 0) as x where x.f = s.event_id)")
both("l03_resume", "select m.user_id, m.replicate from (select distinct user_id, event_id % 3 as replicate from {events}) as m where not exists (select 1 from {events} as e where e.user_id = m.user_id and e.event_id % 3 = m.replicate and e.event_type = 'signup')")
both("l05_retention", "select o_orderkey, cast(day as string) as day from (select o_orderkey, case when o_orderkey % 10 = 0 then null else cast(o_orderdate as date) end as day from {orders}) as x where day is null or day >= date '1996-01-01'")
both("l06_job_expiry", "select o_custkey from {orders} group by o_custkey having max(cast(o_orderdate as date)) < date '1997-01-01'")
both("l08_terminal_stamp", "select user_id, event_id, event_type from (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id desc) as rn from {events}) as x where rn = 1 and event_type not in ('purchase', 'error')")
both("l09_checkpoint_filter", "select event_id from {events} where event_type not in ('purchase', 'error')")
both("l10_insert_only_merge", "select count_if(b.k is not null) as conflicts, count(*) as new_rows from (select o_orderkey + o_custkey as k from {orders}) as a left join (select o_orderkey as k from {orders}) as b on a.k = b.k")
both("l11_control_log", "select user_id, event_type, max(event_id) as last_id from {events} group by user_id, event_type")
both("l07_month_expiry", "select date_part('year', o_orderdate) * 100 + date_part('month', o_orderdate) as month_no, count(*) as n from {orders} where date_part('year', o_orderdate) >= 1997 group by 1")


@query("e03_response_outcomes", None)
def e03(spark, d):
    from ..functions.responses import outcome

    rows = table(spark, d, "events")
    raw = F.expr("case event_id % 7 when 0 then props when 1 then '```json\n' || props || '\n```' when 2 then 'Here: ' || props || ' done' when 3 then '[1]' when 4 then 'I cannot help' when 5 then ' ' else '{\"x\": 1' end")
    return rows.select("event_id", outcome(raw, F.when(F.col("event_id") % 2 == 0, "length").otherwise("stop"), F.when(F.col("event_type") == "error", "timeout"), ("k",)).alias("outcome"))
