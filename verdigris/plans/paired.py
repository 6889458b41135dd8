"""Paired-comparison and statistics queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import fragility as fr
from ..operators import paired as pr
from ..operators.scoring import KEYS
from ..sources.scratch import kept
from .bindings import CALL_RESULTS, REASONS, frame, sides, table, with_frames

QUERIES: dict = {}


def query(name: str, sql: str | None, *frames: str):
    def add(f):
        QUERIES[name] = (f, with_frames(sql, *frames) if sql else None)
        return f

    return add


def _units(spark, d) -> DataFrame:
    return pr.units_of_last_coded(sides(spark, d), "pos", CALL_RESULTS, REASONS)


def _side(name: str, frame: str) -> str:
    ok = "true" if frame == "gt" else "parse_ok"
    return f"""{name} as (select call_id, phone, product, call_result as r, array_to_string(list_sort(list_distinct(list_filter([main, secondary, third], lambda v: v is not null))), '|') as s, {ok} as ok, true as there
  from {{{frame}}} as t qualify row_number() over (partition by call_id, phone, product order by pos desc) = 1)"""


_KEY = "{0}.call_id = u.call_id and {0}.phone is not distinct from u.phone and {0}.product = u.product"
_UNITS = f"""{_side('g', 'gt')}, {_side('i', 'inc')}, {_side('c', 'cand')},
u as (select call_id, phone, product from g union select call_id, phone, product from i union select call_id, phone, product from c),
j as (select u.*, g.there as g_there, g.r as g_r, g.s as g_s, i.there as i_there, i.r as i_r, i.s as i_s, i.ok as i_ok, c.there as c_there, c.r as c_r, c.s as c_s, c.ok as c_ok
  from u left join g on {_KEY.format('g')} left join i on {_KEY.format('i')} left join c on {_KEY.format('c')})"""


def _right(a: str, dim: str) -> str:
    said = f"{a}_r is not null" if dim == "call_result" else f"{a}_s <> ''"
    same = f"{a}_r = g_r" if dim == "call_result" else f"{a}_s = g_s"
    outside = "when g_r is null then null " if dim == "call_result" else ""
    return f"case when g_there is null then ({a}_there is null or ({a}_ok and not ({said}))) {outside}else coalesce({a}_there and {a}_ok and {same}, false) end"


def _judged(dim: str) -> str:
    claim = lambda a: f"coalesce({a}_there and (not {a}_ok or " + (f"{a}_r is not null" if dim == "call_result" else f"{a}_s <> ''") + "), false)"
    err = lambda a: f"case when not {a}_right then case when {a}_there is null then 'missing' when not {a}_ok then 'invalid' when g_there is null then 'extra' else 'wrong' end end"
    return f"""{_UNITS}, q as (select *, {_right('i', dim)} as i_right, {_right('c', dim)} as c_right from j where g_there or {claim('i')} or {claim('c')}),
w as (select call_id, phone, product, i_right as inc_ok, c_right as cand_ok, {err('i')} as inc_error, {err('c')} as cand_error from q where i_right is not null and c_right is not null)"""


@query("j02_three_sides", f"with {_UNITS} select count(*) as units, count(g_there) as with_gt, count(i_there) as with_inc, count(c_there) as with_cand from j", "gt", "inc", "cand")
def j02(spark, d):
    return _units(spark, d).agg(F.count(F.lit(1)).alias("units"), F.count("gt").alias("with_gt"), F.count("inc").alias("with_inc"), F.count("cand").alias("with_cand"))


@query("c01_correctness", f"with {_judged('call_result')} select call_id, phone, product, inc_ok, cand_ok from w", "gt", "inc", "cand")
def c01(spark, d):
    return pr.judged(_units(spark, d), "call_result").select(*KEYS, "inc_ok", "cand_ok")


@query("c02_error_types", f"with {_judged('reason')} select coalesce(inc_error, 'none') as inc_error, coalesce(cand_error, 'none') as cand_error, count(*) as n from w group by 1, 2", "gt", "inc", "cand")
def c02(spark, d):
    rows = pr.judged(_units(spark, d), "reason").select(F.coalesce("inc_error", F.lit("none")).alias("inc_error"), F.coalesce("cand_error", F.lit("none")).alias("cand_error"))
    return rows.groupBy("inc_error", "cand_error").agg(F.count(F.lit(1)).alias("n"))


def _set_sql(frame: str) -> str:
    return f"(select call_id, phone, array_to_string(list_sort(list_distinct(list(product))), '|') as s from {{{frame}}} as t where phone is not null group by all)"


_CALL_SETS = f"""k as (select call_id, phone from {_set_sql('gt')} union select call_id, phone from {_set_sql('inc')} union select call_id, phone from {_set_sql('cand')}),
x as (select k.call_id, k.phone, coalesce(g.s, '') as g, coalesce(i.s, '') as i, coalesce(c.s, '') as c from k
  left join {_set_sql('gt')} as g on g.call_id = k.call_id and g.phone = k.phone left join {_set_sql('inc')} as i on i.call_id = k.call_id and i.phone = k.phone left join {_set_sql('cand')} as c on c.call_id = k.call_id and c.phone = k.phone)"""


@query("c03_product_units", f"with {_CALL_SETS} select call_id, phone, i = g as inc_ok, c = g as cand_ok from x", "gt", "inc", "cand")
def c03(spark, d):
    rows = [frame(spark, d, n).where("phone is not null").select("call_id", "phone", "product", F.lit(n).alias("side")) for n in ("gt", "inc", "cand")]
    sets = [F.array_sort(F.collect_set(F.when(F.col("side") == n, F.col("product")))).alias(n) for n in ("gt", "inc", "cand")]
    calls = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("call_id", "phone").agg(*sets)
    return calls.select("call_id", "phone", (F.col("inc") == F.col("gt")).alias("inc_ok"), (F.col("cand") == F.col("gt")).alias("cand_ok"))


_CLUSTERS = f"{_judged('call_result')}, k as (select call_id, phone, bool_and(inc_ok) as inc_ok, bool_and(cand_ok) as cand_ok, count(*) as n_units from w group by 1, 2)"


def _clusters(spark, d) -> DataFrame:
    return pr.clusters(pr.judged(_units(spark, d), "call_result"))


@query("c04_clusters", f"with {_CLUSTERS} select * from k", "gt", "inc", "cand")
def c04(spark, d):
    return _clusters(spark, d)


_TWO = "count_if(inc_ok and cand_ok) as both_right, count_if(inc_ok and not cand_ok) as inc_only, count_if(not inc_ok and cand_ok) as cand_only, count_if(not inc_ok and not cand_ok) as both_wrong"


@query("c05_disagreement", f"with {_CLUSTERS} select {_TWO} from k", "gt", "inc", "cand")
def c05(spark, d):
    return pr.disagreement(_clusters(spark, d))


_SECRET = b"verdigris"
_PAD = _SECRET.ljust(64, b"\0")


def _blob(x: int) -> str:
    return "'" + "".join(f"\\x{b ^ x:02X}" for b in _PAD) + "'::blob"


def _hmac(message: str) -> str:
    return f"left(sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || encode({message})))), 16)"


@query("c06_regressions", f"with {_CLUSTERS} select {_hmac('call_id')} as item, phone from k where inc_ok and not cand_ok", "gt", "inc", "cand")
def c06(spark, d):
    return _clusters(spark, d).where("inc_ok and not cand_ok").select(pr.key_hmac(F.col("call_id"), _SECRET).alias("item"), "phone")


@query("k01_hmac_key", f"select c_custkey, {_hmac('c_name')} as item from customer")
def k01(spark, d):
    return table(spark, d, "customer").select("c_custkey", pr.key_hmac(F.col("c_name"), _SECRET).alias("item"))


@query("k02_set_hash", "select c_nationkey, sha256(array_to_string(list_sort(list(c_name)), chr(10))) as hash from customer group by 1")
def k02(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(pr.set_hash(F.col("c_name")).alias("hash"))


@query("k04_blind_sides", "select c_custkey, case when ('0x' || substr(sha256(c_name), 1, 2))::int % 2 = 0 then 'A' else 'B' end as side from customer")
def k04(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.conv(F.substring(F.sha2("c_name", 256), 1, 2), 16, 10).cast("int") % 2 == 0, "A").otherwise("B").alias("side"))


#: 60 small arms: discordant counts from 0 to 59.
_ARMS = "select o_custkey % 60 as d, count(*) as n, cast(sum(o_orderkey % 2) as bigint) as up from orders where o_custkey % 60 >= 0 group by 1"


@query(
    "c07_sign_band",
    f"""with a as ({_ARMS}), b as (select a.d, r.band, (select sum(exp(lgamma(a.d + 1) - lgamma(w + 1) - lgamma(a.d - w + 1) - a.d * ln(2.0))) from unnest(range((a.d + r.band + 1) // 2, a.d + 1)) as t(w)) as tail
  from a, unnest(range(0, a.d + 1)) as r(band) where (r.band - a.d) % 2 = 0)
select a.d, cast(min(b.band) as int) as band from a left join b on a.d = b.d and b.tail <= 1.0 / 64 + 0.000000000001 group by a.d""",
)
def c07(spark, d):
    arms = table(spark, d, "orders").groupBy((F.col("o_custkey") % 60).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return arms.select("d", stats.sign_band_of("d").alias("band"))


_DIGIT = "concat('d', right(phone, 1))"


def _arms(spark, d) -> DataFrame:
    """Clusters, in arms by the last digit of the phone; those without a phone are an arm."""
    return _clusters(spark, d).withColumn("arm", F.expr(_DIGIT)).drop("n_units")


@query(
    "c07_arm_bands",
    f"""with {_CLUSTERS}, two as (select case when phone is not null then {_DIGIT} end as arm, count_if(inc_ok <> cand_ok) as discordant from k group by 1),
wins_of as (select arm, discordant, wins, sum(exp(lgamma(discordant + 1) - lgamma(wins + 1) - lgamma(discordant - wins + 1) - discordant * ln(2.0))) over (partition by arm order by wins desc) as tail
  from two, unnest(range((discordant + 1) // 2, discordant + 1)) as r(wins))
select arm, discordant, cast(min(case when tail <= 1.0 / 64 + 0.000000000001 then 2 * wins - discordant end) as int) as band from wins_of group by arm, discordant""",
    "gt", "inc", "cand",
)
def c07_arms(spark, d):
    two = _arms(spark, d).groupBy("arm").agg(F.count_if(F.col("inc_ok") != F.col("cand_ok")).alias("discordant"))
    return two.withColumn("band", stats.sign_band_of("discordant"))


@query(
    "c08_verdict",
    f"""with {_CLUSTERS}, two as (select {_TWO} from k), wins_of as (select inc_only, cand_only, inc_only + cand_only as d, wins,
  sum(exp(lgamma(d + 1) - lgamma(wins + 1) - lgamma(d - wins + 1) - d * ln(2.0))) over (order by wins desc) as tail
  from two, unnest(range((inc_only + cand_only + 1) // 2, inc_only + cand_only + 1)) as r(wins)),
band_of as (select inc_only, cand_only, min(case when tail <= 1.0 / 64 + 0.000000000001 then 2 * wins - d end) as band from wins_of group by inc_only, cand_only)
select inc_only, cand_only, cast(band as int) as band, case when band is null then 'UNDERPOWERED' when cand_only - inc_only >= band then 'AHEAD' when inc_only - cand_only >= band then 'BEHIND' else 'INDISTINGUISHABLE' end as verdict from band_of""",
    "gt", "inc", "cand",
)
def c08(spark, d):
    two = pr.disagreement(_clusters(spark, d)).withColumn("band", stats.sign_band_of(F.col("inc_only") + F.col("cand_only")))
    return two.select("inc_only", "cand_only", "band", stats.verdict(F.col("cand_only") - F.col("inc_only"), F.col("band")).alias("verdict"))


@query("c09_coverage_gate", "select count_if(s = 0) as missing, count_if(a = 0) as unexpected from (select call_id, max(s) as s, max(a) as a from (select call_id, 1 as s, 0 as a from {inc} as x union all select call_id, 0, 1 from {gt} as y) group by 1)", "gt", "inc")
def c09(spark, d):
    return pr.coverage_gate(frame(spark, d, "inc"), frame(spark, d, "gt"), "call_id")


@query("c10_count_gate", "select g, p, p = 0 or abs(p - g) > 0.02 * g as refused from (select (select count(*) from {gt} as x) as g, (select count(*) from {inc} as y) as p)", "gt", "inc")
def c10(spark, d):
    rows = frame(spark, d, "gt").select(F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(frame(spark, d, "inc").select(F.lit(0).alias("g"), F.lit(1).alias("p")))
    counts = rows.agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return counts.withColumn("refused", (F.col("p") == 0) | (F.abs(F.col("p") - F.col("g")) > 0.02 * F.col("g")))


_SHARES = "select c_nationkey as nation, count(*) as n, count_if(c_acctbal > 0) as k from customer group by 1"


def _shares(spark, d) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))


@query("c11_clopper_pearson", None)
def c11(spark, d):
    return _shares(spark, d).withColumn("i", stats.clopper_pearson("k", "n")).select("nation", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


_Z = repr(stats.Z)


@query(
    "c12_wilson",
    f"with s as ({_SHARES}), x as (select nation, k / n as p, n, {_Z}::double as z from s) select nation, round(greatest((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 0), 6) as low, round(least((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 1), 6) as high from x",
)
def c12(spark, d):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return _shares(spark, d).select("nation", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("c13_bootstrap", None)
def c13(spark, d):
    arms = _clusters(spark, d).select(F.concat(F.lit("d"), F.right("phone", F.lit(1))).alias("arm"), (F.col("inc_ok") & ~F.col("cand_ok")).cast("int").alias("inc_only"), (~F.col("inc_ok") & F.col("cand_ok")).cast("int").alias("cand_only"))
    return stats.cluster_bootstrap(arms, "arm")


@query("c13_seeded_bootstrap", None)
def c13_seeded(spark, d):
    return fr.seeded_bootstrap(kept(_arms(spark, d), "arms"), ["arm"], [F.col("call_id"), F.col("phone")])


@query("c14_fragility", None)
def c14_fragility(spark, d):
    return fr.fragility(kept(_arms(spark, d), "arms"), ["arm"], [F.col("call_id"), F.col("phone")])


@query(
    "c14_leave_one_out",
    f"with {_CLUSTERS}, t as (select {_TWO} from k) select 'inc_only' as removed, inc_only as times, (inc_only - 1) as inc_only, cand_only from t union all select 'cand_only', cand_only, inc_only, cand_only - 1 from t union all select 'other', both_right + both_wrong, inc_only, cand_only from t",
    "gt", "inc", "cand",
)
def c14(spark, d):
    def cell(name, times, inc, cand):
        return F.struct(F.lit(name).alias("removed"), times.alias("times"), inc.alias("inc_only"), cand.alias("cand_only"))

    i, c, rest = F.col("inc_only"), F.col("cand_only"), F.col("both_right") + F.col("both_wrong")
    return pr.disagreement(_clusters(spark, d)).select(F.inline(F.array(cell("inc_only", i, i - 1, c), cell("cand_only", c, i, c - 1), cell("other", rest, i, c))))


@query("c15_pooled", f"with {_CLUSTERS}, a as (select call_id, phone, inc_ok, cand_ok, left(call_id, 1) as pack from k), b as (select pack, {_TWO} from a group by pack) select cast(sum(both_right) as bigint) as both_right, cast(sum(inc_only) as bigint) as inc_only, cast(sum(cand_only) as bigint) as cand_only, cast(sum(both_wrong) as bigint) as both_wrong, count(*) as packs from b", "gt", "inc", "cand")
def c15(spark, d):
    packs = pr.disagreement(_clusters(spark, d).withColumn("pack", F.left("call_id", F.lit(1))), ["pack"])
    return packs.agg(*[F.sum(c).alias(c) for c in ("both_right", "inc_only", "cand_only", "both_wrong")], F.count(F.lit(1)).alias("packs"))


@query("c21_manifest_delta", "select field, old, new from (select 'orders' as field, cast(count(*) as string) as old, cast(count(distinct o_custkey) as string) as new from orders union all select 'lines', cast(count(*) as string), cast(count(*) as string) from lineitem) where old is distinct from new")
def c21(spark, d):
    one = table(spark, d, "orders").agg(F.count(F.lit(1)).cast("string").alias("old"), F.countDistinct("o_custkey").cast("string").alias("new")).select(F.lit("orders").alias("field"), "old", "new")
    two = table(spark, d, "lineitem").agg(F.count(F.lit(1)).cast("string").alias("old"), F.count(F.lit(1)).cast("string").alias("new")).select(F.lit("lines").alias("field"), "old", "new")
    return one.unionByName(two).where(~F.col("old").eqNullSafe(F.col("new")))
