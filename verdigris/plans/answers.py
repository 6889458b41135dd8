"""Answers given several times, and splits of test sets: rows, instability, cells that flip, and arms compared; queries over all events and order lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import answers as an
from ..operators import gates, paired
from ..operators import splits as sp
from .bindings import CALL_RESULTS, frame, frame_sql, pick, table, with_frames

QUERIES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


#: The JSON of an answer of the frame said, in Spark's SQL.
_PAYLOAD = """concat('{"product": {', case when bare then '' else concat('"', p, '": {"retention_outcome": "', outcome, '", "', slot, '": {"reason": "', reason, '", "keyword": "', keyword, '"}}') end,
  case when second = 0 then '' else concat(case when bare then '' else ', ' end, '"device": ', case second when 1 then 'null' when 2 then '5' else '{"retention_outcome": "Save "}' end) end, '}, "recommendation": "', advice, '"}')"""


def _answers(spark, d) -> DataFrame:
    """item_id, arm, replicate, raw, payload, parse_ok."""
    rows = frame(spark, d, "said").withColumn("raw", F.expr(_PAYLOAD))
    return rows.select("item_id", "arm", "replicate", "raw", F.when(F.col("parse_ok"), F.col("raw")).alias("payload"), "parse_ok")


def _truths(spark, d) -> DataFrame:
    items = frame(spark, d, "said").select("item_id", "p").distinct()
    products = F.when(F.col("item_id") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array("p", F.lit("tol2")))
    return items.select("item_id", F.concat(F.lit("c"), "item_id").alias("call_id"), F.lit(None).cast("string").alias("phone"), products.alias("products"))


_SAID = frame_sql("said")
_NAMED = "(parse_ok and not (bare and second in (0, 1)))"


@query(
    "e01_answer_rows",
    f"""with s as (select *, {_NAMED} as named from ({_SAID}) as x),
r as (select *, p as product, outcome as call_result, case when slot = 'main' then reason else '' end as main, '' as secondary, case when slot = 'third' then reason else '' end as third from s where named and not bare
union all select *, 'device', case when second = 3 then 'Save ' end, '', '', '' from s where named and second in (2, 3)
union all select *, case when item_id % 13 <> 0 then p end, null, null, null, null from s where not named
union all select *, 'tol2', null, null, null, null from s where not named and item_id % 13 <> 0)
select item_id, arm, replicate, parse_ok, 'c' || cast(item_id as varchar) as call_id, product, call_result, main, secondary, third, parse_ok and not named as named_no_product from r""",
)
def e01(spark, d):
    return an.flatten(_answers(spark, d).drop("raw"), _truths(spark, d)).drop("phone")


_ITEMS = f"""select arm, item_id, count(*) as n, count(distinct raw) > 1 as raw, count(distinct scored) > 1 as scored, count(distinct advice) > 1 as advice, count(distinct quoted) > 1 as quoted from (
  select arm, item_id, case when bare then '' else concat_ws('|', p, outcome, slot, reason, keyword) end || cast(second as varchar) || advice || cast(parse_ok as varchar) as raw,
    case when {_NAMED} then case when bare then '' else concat_ws('|', p, outcome, reason) end || case second when 2 then 'd' when 3 then 'ds' else '' end else 'none' end || cast(parse_ok as varchar) as scored,
    case when parse_ok then advice else '' end as advice, case when parse_ok then case when bare then '' else concat_ws('|', p, slot, keyword) end || case when second = 3 then 'd' else '' end else '' end as quoted from ({_SAID}) as s) as t group by 1, 2"""


@query(
    "e07_fields",
    f"""with i as (select *, n > 1 as seen, raw and not scored as cosmetic from ({_ITEMS}) as x),
c as (select arm, count(*) as items, count(*) filter (seen) as observable, count(*) filter (raw) as raw_unstable, count(*) filter (scored) as scored_unstable, count(*) filter (cosmetic) as cosmetic_only,
  count(*) filter (cosmetic and advice) as cosmetic_recommendation, 0::bigint as cosmetic_call_event_detection, count(*) filter (cosmetic and quoted) as cosmetic_keyword from i group by 1)
select *, items - observable as not_observable, round(raw_unstable / observable, 6) as raw_unstable_rate, round(scored_unstable / observable, 6) as scored_unstable_rate, round(cosmetic_only / observable, 6) as cosmetic_only_rate,
  round(cosmetic_only / raw_unstable, 6) as cosmetic_share_of_instability from c""",
)
def e07(spark, d):
    # an unread answer's text is another text than any that was read
    answers = _answers(spark, d).withColumn("raw", F.when(F.col("parse_ok"), F.col("raw")).otherwise(F.concat("raw", F.lit("!"))))
    out = an.decompose(an.classify(answers, _truths(spark, d), ["arm"]), ["arm"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_rate") or c.startswith("cosmetic_share")})


_REPS = " union all ".join(f"select {i} as replicate, call_id, phone, product, call_result, main, secondary, third from ({frame_sql(f)}) as f{i}" for i, f in enumerate(("gt", "inc")))


@query(
    "e08_cells",
    f"""with r as ({_REPS}), n as (select *, array_to_string(list_sort(list_distinct(list_filter([main, secondary, third], lambda v: v is not null))), ',') as reasons from r),
k as (select replicate, call_id, phone, product, list_sort(list(coalesce(call_result, ''))) as c, list_sort(list(reasons)) as s from n group by all),
p as (select replicate, call_id, phone, list_sort(list(distinct product) filter (product is not null)) as x from n group by all),
f as (select 'call_result' as dimension, count(*) < 2 or count(distinct c) > 1 as moved from k group by call_id, phone, product
union all select 'reason', count(*) < 2 or count(distinct s) > 1 from k group by call_id, phone, product
union all select 'product', count(*) < 2 or count(distinct coalesce(x, [])) > 1 from p group by call_id, phone)
select dimension, count(*) as cells, count(*) filter (moved) as flips from f group by 1""",
)
def e08(spark, d):
    sides = [frame(spark, d, f).select(F.lit(i).alias("replicate"), "call_id", "phone", "product", "call_result", *an.SLOTS) for i, f in enumerate(("gt", "inc"))]
    return an.flips(sides[0].unionByName(sides[1]), 2)


_FIELDS = f"""with s as ({_SAID}), i as (select item_id, count(*) filter (arm = 'a') as na, count(*) filter (arm = 'b') as nb, not bool_and(parse_ok) as bad from s group by 1),
c as (select item_id, arm, 'products' as path, case when second > 0 then 'device' else '' end || case when bare then '' else p end as v from s
union all select item_id, arm, p || '.outcome', outcome from s where not bare union all select item_id, arm, p || '.reasons', reason from s where not bare
union all select item_id, arm, 'device.outcome', case when second = 3 then 'save' else 'MALFORMED' end from s where second > 0 union all select item_id, arm, 'device.reasons', '' from s where second = 3),
g as (select item_id, path, count(*) filter (arm = 'a') as xa, count(*) filter (arm = 'b') as xb, list_sort(list(distinct v) filter (arm = 'a')) as va, list_sort(list(distinct v) filter (arm = 'b')) as vb from c group by 1, 2),
f as (select g.item_id, path, case when xa not in (0, na) or xb not in (0, nb) or len(va) > 1 or len(vb) > 1 then 'NOISE' when va is not distinct from vb then 'SAME' else 'CHANGED' end as verdict from g join i using (item_id) where not bad and na > 0 and nb > 0
union all select item_id, null, 'PARSE_FAILED' from i where bad or na = 0 or nb = 0)"""


@query("e12_fields", f"{_FIELDS} select * from f")
def e12_fields(spark, d):
    return an.field_verdicts(_answers(spark, d), ("a", "b"))


@query(
    "e12_items",
    f"""{_FIELDS}, n as (select item_id, count(*) filter (verdict = 'PARSE_FAILED') as failed, count(*) filter (verdict = 'CHANGED') as changed, count(*) filter (verdict = 'NOISE') as noise, count(path) as paths from f group by 1)
select item_id, case when failed > 0 then 'PARSE_FAILED' when changed > 0 then 'CHANGED' when noise > 0 then 'NOISE' else 'SAME' end as verdict, changed, noise, paths from n""",
)
def e12_items(spark, d):
    return an.item_verdicts(an.field_verdicts(_answers(spark, d), ("a", "b")))


#: Parts as items: some are longer versions of another one.
_PACK = """select 'RET-' || cast(p_partkey as string) as item_id, p_type as family, case when p_partkey % 20 in (7, 13) then 'dilation of RET-' || cast(p_partkey - p_partkey % 20 as string) || ' at 3x: long' when p_partkey % 6 = 0 then 'plain' end as mechanism from {part}"""
#: A split of them that is wrong in every way.
_SPLIT = """select item_id, part from (select 'RET-' || cast(p_partkey + case when p_partkey % 43 = 0 then 1000000000 else 0 end as string) as item_id, case when p_partkey % 3 = 0 then 'tune' else 'holdout' end as part, p_partkey from {part}) as s where p_partkey % 31 <> 0
union all select 'RET-' || cast(p_partkey as string), case when p_partkey % 2 = 0 then 'tune' else 'holdout' end from {part} where p_partkey % 37 = 0"""
_BLOCKS = f"""i as ({_PACK.replace("{part}", "part")}), b as (select item_id, family, coalesce(nullif(regexp_extract(mechanism, '^dilation of (RET-[0-9]+) at [0-9]+x:', 1), ''), item_id) as block from i)"""


@query(
    "e24_families",
    f"""with {_BLOCKS}, h as (select block, count(*) as n, min({{'f': family, 'i': item_id}}) as first from b group by 1), s as (select block, case when n > 1 then 'dilation-block' else first.f end as stratum, first from h),
d as (select block, stratum, case when (row_number() over (partition by stratum order by first.f, first.i) - 1) % 3 = 0 then 'tune' else 'holdout' end as part from s)
select item_id, family, block, stratum, part from b join d using (block)""",
)
def e24(spark, d):
    return sp.draw(spark.sql(_PACK, part=table(spark, d, "part")))


@query(
    "e25_split_problems",
    f"""with {_BLOCKS}, s as ({_SPLIT.replace("{part}", "part")}), c as (select item_id, part, count(*) as n from s group by 1, 2), t as (select item_id from c where part = 'tune'),
z as (select block, count(*) as n, count(*) filter (item_id in (select item_id from t)) as tuned from b group by 1)
select 'duplicate' as problem, part, item_id as detail from c where n > 1
union all select 'unknown', part, item_id from c where item_id not in (select item_id from i)
union all select 'overlap', null, item_id from c where part = 'holdout' and item_id in (select item_id from t)
union all select 'missing', null, item_id from i where item_id not in (select item_id from c)
union all select 'straddling', null, block from z where tuned > 0 and tuned < n""",
)
def e25(spark, d):
    part = table(spark, d, "part")
    return sp.problems(spark.sql(_SPLIT, part=part), spark.sql(_PACK, part=part))


#: Calls of fifty arms; now and then another model, reasoning, no usage, or a prompt of another length.
_CALLS = """select item_id % 50 as arm, item_id, outcome, case when event_id % 1499 = 0 then 'n' when event_id % 701 = 0 then null else 'm' end as model, case when item_id % 50 = 7 then null else 'p' end as provider,
  case when event_id % 1009 = 0 then 5 when event_id % 811 = 0 then null else 0 end as reasoning_tokens, case when event_id % 907 = 0 then 0 when event_id % 1201 = 0 then 10 else 9 end as prompt_tokens from {runs} as r"""


@query(
    "c17_runtime",
    f"""with c as ({with_frames(_CALLS, "runs")}), p as (select arm, count(distinct prompt_tokens) filter (prompt_tokens > 0) > 1 as split from c group by arm, item_id), q as (select arm, bool_or(split) as split from p group by 1),
s as (select arm, count(*) as total, count(*) filter (outcome = 'ok') as parse_ok, count(*) filter (model <> 'm') > 0 or count(*) filter (model = 'm') = 0 as a, count(*) filter (provider <> 'p') > 0 or count(*) filter (provider = 'p') = 0 as b,
  count(*) filter (outcome = 'ok' and model is null) > 0 as c, count(*) filter (outcome = 'ok' and provider is null) > 0 as d, count(*) filter (reasoning_tokens <> 0 or (outcome = 'ok' and reasoning_tokens is null)) > 0 as e,
  count(*) filter (outcome = 'ok' and coalesce(prompt_tokens, 0) <= 0) > 0 as f from c group by 1)
select arm, total, parse_ok, parse_ok / total >= 0.99 as reliable, concat_ws(',', case when a then 'model' end, case when b then 'provider' end, case when c then 'model_unknown' end, case when d then 'provider_unknown' end, case when e then 'reasoning' end, case when f then 'usage' end, case when split then 'split' end) as problems from s join q using (arm)""",
)
def c17(spark, d):
    calls = spark.sql(_CALLS, runs=frame(spark, d, "runs"))
    return gates.runtime_gate(calls, ["arm"], "m", "p").withColumn("problems", F.array_join("problems", ","))


_RIGHT = f"""select item_id, item_id % 10 as pair, arm, bool_and(outcome = {pick("item_id % 4", CALL_RESULTS)}) as call_result, bool_and(keyword = 'k') as reason, bool_and(second not in (1, 2)) as product, count(*) >= 2 and count(distinct outcome) = 1 as stability"""
_DIMS = ", ".join(f"'{x}'" for x in (*gates.DIMENSIONS, gates.STABILITY))


@query(
    "c18_decisions",
    f"""with u as ({_RIGHT} from ({_SAID}) as s group by 1, 2, 3),
p as (select a.pair, unnest([{_DIMS}]) as dimension, unnest([1, 2, 3, 4]) as pos, unnest([a.call_result, a.reason, a.product, a.stability]) as x, unnest([b.call_result, b.reason, b.product, b.stability]) as y from u as a join u as b on a.item_id = b.item_id and a.arm = 'a' and b.arm = 'b'),
t as (select pair, dimension, pos, count(*) filter (x <> y) as d, count(*) filter (y and not x) - count(*) filter (x and not y) as net from p group by 1, 2, 3),
w as (select pair, dimension, pos, d, net, wins, sum(exp(lgamma(d + 1) - lgamma(wins + 1) - lgamma(d - wins + 1) - d * ln(2.0))) over (partition by pair, dimension order by wins desc) as tail from t, unnest(range((d + 1) // 2, d + 1)) as r(wins)),
b as (select pair, dimension, pos, net, min(case when tail <= 1.0 / 64 + 0.000000000001 then 2 * wins - d end) as band from w group by 1, 2, 3, 4),
v as (select pair, string_agg('behind:' || dimension, ',' order by pos) filter (net <= -band) as behind, string_agg('underpowered:' || dimension, ',' order by pos) filter (band is null) as thin,
  string_agg('net_loss:' || dimension, ',' order by pos) filter (abs(net) < band and net < case when dimension = 'reason' then -1 else 0 end) as lost from b group by 1),
c as (select item_id % 10 as pair, count(*) filter (arm = 'a') as ta, count(*) filter (arm = 'b') as tb, count(*) filter (arm = 'a' and (parse_ok or slot = 'main')) as a, count(*) filter (arm = 'b' and (parse_ok or slot = 'main')) as b from ({_SAID}) as s group by 1),
e as (select *, case when pair = 9 then 'UNAVAILABLE;qualification' when pair = 8 then 'INCONCLUSIVE;candidate:split' when a / ta < 0.99 then 'INCONCLUSIVE;incumbent_unreliable' when b / tb < 0.99 then 'FAIL;unreliable' when behind is not null then 'FAIL;' || behind
  when thin is not null or lost is not null then 'INCONCLUSIVE;' || concat_ws(',', thin, lost) else 'PASS;' end as r from c join v using (pair))
select pair, split_part(r, ';', 1) as decision, split_part(r, ';', 2) as reasons from e""",
)
def c18(spark, d):
    said = frame(spark, d, "said")
    sides = spark.sql(_RIGHT + " from {said} group by 1, 2, 3", said=said)
    both = sides.groupBy("pair", "item_id").agg(*[F.bool_and(F.when(F.col("arm") == a, F.col(x))).alias(f"{x}_{a}") for x in (*gates.DIMENSIONS, gates.STABILITY) for a in "ab"])
    cells = [F.struct(F.lit(x).alias("dimension"), F.col(f"{x}_a").alias("inc_ok"), F.col(f"{x}_b").alias("cand_ok")) for x in (*gates.DIMENSIONS, gates.STABILITY)]
    two = paired.disagreement(both.select("pair", F.inline(F.array(*cells))), ["pair", "dimension"])
    two = two.select("pair", "dimension", (F.col("inc_only") + F.col("cand_only")).alias("discordant"), (F.col("cand_only") - F.col("inc_only")).alias("net")).withColumn("band", stats.sign_band_of("discordant"))
    read = F.col("parse_ok") | (F.col("slot") == "main")
    counts = [F.count_if((F.col("arm") == a) & w).alias(n) for n, a, w in (("parse_ok", "b", read), ("total", "b", F.lit(True)), ("ref_parse_ok", "a", read), ("ref_total", "a", F.lit(True)))]
    arms = said.groupBy((F.col("item_id") % 10).alias("pair")).agg(*counts)
    arms = arms.withColumns({"qualification": F.when(F.col("pair") == 9, "REGIME_INCOMPATIBLE").otherwise("QUALIFIED"), "problems": F.when(F.col("pair") == 8, F.array(F.lit("split"))), "ref_problems": F.array().cast("array<string>")})
    out = gates.decisions(arms, two.withColumn("verdict", stats.verdict(F.col("net"), F.col("band"))), ["pair"], margins={"reason": 1})
    return out.withColumn("reasons", F.array_join("reasons", ","))
