"""Label-scoring queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import scoring as sc
from .bindings import CALL_RESULTS, PRODUCTS, REASONS, frame, table, with_frames

QUERIES: dict = {}


def query(name: str, sql: str | None, *frames: str):
    def add(f):
        QUERIES[name] = (f, with_frames(sql, *frames) if sql else None)
        return f

    return add


def _values(labels) -> str:
    return "(values " + ", ".join(f"('{x}')" for x in labels) + ") as labels(label)"


_NORM = "nullif(lower(trim({})), '')"
_MESSY = "case when c_custkey % 7 = 0 then '   ' when c_custkey % 5 = 0 then null else '  ' || upper(c_name) || ' ' end"


@query("p01_norm_text", f"select c_custkey, {_NORM.format('x')} as norm from (select c_custkey, {_MESSY} as x from customer)")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", nz.norm_text(F.expr(_MESSY)).alias("norm"))


_PHONE = "case c_custkey % 6 when 0 then '0' when 1 then ' NaN ' when 2 then 'None' when 3 then '' else ' 08' || cast(c_custkey as string) end"


@query("p02_norm_phone", f"select c_custkey, case when p in ('0', 'none', 'nan') then null else p end as phone from (select c_custkey, {_NORM.format(_PHONE)} as p from customer)")
def p02(spark, d):
    return table(spark, d, "customer").select("c_custkey", nz.norm_phone(F.expr(_PHONE)).alias("phone"))


_SLOTS = "p_brand || ' , ' || lower(p_type)", "case when p_partkey % 3 = 0 then '  ' else p_type end", "case when p_partkey % 4 = 0 then null else p_brand || ',,x' end"


def _reasons_sql(keep_empty: bool) -> str:
    split = "list_transform(string_split(array_to_string(list_filter([m, s, t], lambda v: v is not null and trim(v) <> ''), ','), ','), lambda v: lower(trim(v)))"
    kept = split if keep_empty else f"list_filter({split}, lambda v: v <> '')"
    return f"select p_partkey, array_to_string(list_sort(list_distinct({kept})), '|') as reasons from (select p_partkey, {_SLOTS[0]} as m, {_SLOTS[1]} as s, {_SLOTS[2]} as t from part)"


@query("p03_reasons", _reasons_sql(False))
def p03(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(nz.norm_reasons(*map(F.expr, _SLOTS)), "|").alias("reasons"))


@query("a10_reasons_with_empty", _reasons_sql(True))
def a10(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(nz.norm_reasons(*map(F.expr, _SLOTS), keep_empty=True), "|").alias("reasons"))


def _joined(spark, d) -> DataFrame:
    return sc.label_join(frame(spark, d, "gt"), frame(spark, d, "inc"))


_LAST = """g as (select * from {gt} as t qualify row_number() over (partition by call_id, phone, product order by pos desc) = 1),
p as (select * from {inc} as t qualify row_number() over (partition by call_id, phone, product order by pos desc) = 1),
j as (select g.k as gk, g.call_result as g_result, p.call_result as p_result, p.parse_ok as ok, g.call_id as g_call, p.call_id as p_call,
  g.main as gm, g.secondary as gs, g.third as gt3, p.main as pm, p.secondary as ps, p.third as pt,
  coalesce(g.call_id, p.call_id) as call_id, case when g.call_id is not null then g.phone else p.phone end as phone, coalesce(g.product, p.product) as product
  from g full join p on g.call_id = p.call_id and g.phone is not distinct from p.phone and g.product = p.product)"""


@query("j01_label_join", f"with {_LAST} select call_id, phone, product, g_result, case when p_call is null then 'missing' when ok then p_result else 'unparsed' end as said from j", "gt", "inc")
def j01(spark, d):
    said = F.when(F.col("pred").isNull(), "missing").when(F.col("pred.parse_ok"), F.col("pred.call_result")).otherwise("unparsed")
    return _joined(spark, d).select(*sc.KEYS, F.col("gt.call_result").alias("g_result"), said.alias("said"))


@query(
    "j03_outer_merge",
    "select count(*) as n, count(g.k) as with_gt, count(p.pos) as with_pred from {gt} as g full join {inc} as p on g.call_id is not distinct from p.call_id and g.phone is not distinct from p.phone and g.product is not distinct from p.product",
    "gt", "inc",
)
def j03(spark, d):
    joined = sc.label_join(frame(spark, d, "gt"), frame(spark, d, "inc"), position=None)
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count("gt.k").alias("with_gt"), F.count("pred.pos").alias("with_pred"))


@query("j04_call_merge", "select count(*) as n, count_if(g.product = p.product) as same from {gt} as g full join {inc} as p on g.call_id = p.call_id", "gt", "inc")
def j04(spark, d):
    joined = sc.label_join(frame(spark, d, "gt"), frame(spark, d, "inc"), keys=("call_id",), position=None)
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gt.product") == F.col("pred.product")).alias("same"))


def _matrix(where: str, g: str, p: str, labels, source: str = "j") -> str:
    return f"""select label, count_if({g} and {p}) as tp, count_if(not {g} and {p}) as fp, count_if({g} and not {p}) as fn, count_if(not {g} and not {p}) as tn
from {source} cross join {_values(labels)} {where} group by label"""


def _rates(matrix: str) -> str:
    return f"""select label, tp, fp, fn, tn, tp + fn as weight, round(case when tp + fp + fn + tn = 0 then 0 else (tp + tn) / (tp + fp + fn + tn) end, 6) as accuracy,
  round(prec, 6) as precision, round(rec, 6) as recall, round(case when prec + rec = 0 then 0 else 2 * prec * rec / (prec + rec) end, 6) as f1
from (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as prec, case when tp + fn = 0 then 0 else tp / (tp + fn) end as rec from ({matrix}))"""


_RESULT = _matrix("where g_result is not null", "(g_result = label)", "(coalesce(p_result, '') = label and coalesce(ok, false))", CALL_RESULTS)
_SET = "list_distinct(list_filter([{0}, {1}, {2}], lambda v: v is not null))"
_REASON = _matrix(
    "", f"list_contains({_SET.format('gm', 'gs', 'gt3')}, label)", f"(coalesce(ok, false) and list_contains({_SET.format('pm', 'ps', 'pt')}, label))", REASONS
)
_CALLS = """gs as (select call_id, phone, list_distinct(list(product)) as g from {gt} as t where phone is not null group by all),
ps as (select call_id, phone, list_distinct(list(product)) as p from {inc} as t where phone is not null group by all),
c as (select coalesce(gs.call_id, ps.call_id) as call_id, coalesce(g, []) as g, coalesce(p, []) as p from gs full join ps on gs.call_id = ps.call_id and gs.phone = ps.phone)"""
_PRODUCT = _matrix("", "list_contains(g, label)", "list_contains(p, label)", PRODUCTS, "c")


@query("a01_confusion", f"with {_LAST} {_RESULT}", "gt", "inc")
def a01(spark, d):
    return sc.score_call_result(_joined(spark, d), CALL_RESULTS)


@query("a02_call_result", f"with {_LAST} {_rates(_RESULT)}", "gt", "inc")
def a02(spark, d):
    return sc.rates(sc.score_call_result(_joined(spark, d), CALL_RESULTS))


@query("a03_reason", f"with {_LAST} {_rates(_REASON)}", "gt", "inc")
def a03(spark, d):
    return sc.rates(sc.score_reason(_joined(spark, d), REASONS))


@query("a04_product", f"with {_CALLS} {_rates(_PRODUCT)}", "gt", "inc")
def a04(spark, d):
    return sc.rates(sc.score_product(frame(spark, d, "gt"), frame(spark, d, "inc"), PRODUCTS))


@query("a05_rates", f"with {_LAST} select label, accuracy, precision, recall, f1 from ({_rates(_REASON)}) where weight > 0", "gt", "inc")
def a05(spark, d):
    return sc.rates(sc.score_reason(_joined(spark, d), REASONS)).where("weight > 0").select("label", "accuracy", "precision", "recall", "f1")


def _weighted(rates: str) -> str:
    means = ", ".join(f"round(sum({c} * weight) / sum(weight), 4) as {c}" for c in ("accuracy", "precision", "recall", "f1"))
    return f"select cast(sum(weight) as bigint) as weight, {means} from ({rates})"


@query("a06_weighted_average", f"with {_LAST} {_weighted(_rates(_RESULT))}", "gt", "inc")
def a06(spark, d):
    return sc.weighted_average(sc.rates(sc.score_call_result(_joined(spark, d), CALL_RESULTS)))


@query("a07_coverage", f"with {_LAST} select count(g_call) as requested, count_if(g_call is not null and p_call is not null) as joined, count_if(p_call is not null and not ok) as parse_failures, count_if(g_result is not null) as scored from j", "gt", "inc")
def a07(spark, d):
    return sc.coverage(_joined(spark, d))


def _cells(values) -> str:
    return ", ".join(f"count_if(c = '{v}') as {v}" for v in (*values, "nan"))


@query("a08_crosstab", f"with {_LAST}, x as (select coalesce(g_result, 'nan') as r, coalesce(p_result, 'nan') as c from j) select r as label, {_cells(CALL_RESULTS)}, count(*) as total from x group by r union all select 'total', {_cells(CALL_RESULTS)}, count(*) from x", "gt", "inc")
def a08(spark, d):
    flat = _joined(spark, d).select(F.col("gt.call_result").alias("g"), F.col("pred.call_result").alias("p"))
    return sc.crosstab(flat, "g", "p", CALL_RESULTS)


@query("a09_metrics_table", f"with {_LAST}, r as ({_rates(_RESULT)}) select label, weight, accuracy, precision, recall, f1 from r union all select 'weighted_avg', cast(sum(weight) as bigint), round(sum(accuracy * weight) / sum(weight), 6), round(sum(precision * weight) / sum(weight), 6), round(sum(recall * weight) / sum(weight), 6), round(sum(f1 * weight) / sum(weight), 6) from r", "gt", "inc")
def a09(spark, d):
    rates = sc.rates(sc.score_call_result(_joined(spark, d), CALL_RESULTS)).select("label", "weight", "accuracy", "precision", "recall", "f1")
    return rates.unionByName(sc.weighted_average(rates, digits=6).withColumn("label", F.lit("weighted_avg")))


@query("a11_product_sets", f"with {_CALLS} select call_id, array_to_string(list_sort(g), '|') as g, array_to_string(list_sort(p), '|') as p from c", "gt", "inc")
def a11(spark, d):
    return sc.product_join(frame(spark, d, "gt"), frame(spark, d, "inc")).select("call_id", F.array_join("g", "|").alias("g"), F.array_join("p", "|").alias("p"))


@query("j05_call_set_join", f"with {_CALLS} select count(*) as calls, count_if(list_sort(g) = list_sort(p)) as same, count_if(len(p) = 0) as no_prediction from c", "gt", "inc")
def j05(spark, d):
    sets = sc.product_join(frame(spark, d, "gt"), frame(spark, d, "inc"))
    return sets.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("g") == F.col("p")).alias("same"), F.count_if(F.size("p") == 0).alias("no_prediction"))


_PAIRS = "select g.call_result as g1, p.call_result as p1, g.main as g2, p.main as p2, g.secondary as g3, p.secondary as p3, g.k as k from {gt} as g join {inc} as p on g.call_id = p.call_id and g.phone = p.phone and g.product = p.product"
_EXACT = f"select dimension, count_if(ok) as tp, count_if(not ok) as fp from (select 'g1' as dimension, g1 is not distinct from p1 as ok from x union all select 'g2', g2 is not distinct from p2 from x union all select 'g3', g3 is not distinct from p3 from x) group by dimension"


def _exact(spark, d) -> DataFrame:
    g = frame(spark, d, "gt").where("phone is not null").select("call_id", "phone", "product", F.col("call_result").alias("g1"), F.col("main").alias("g2"), F.col("secondary").alias("g3"))
    p = frame(spark, d, "inc").where("phone is not null").select("call_id", "phone", "product", F.col("call_result").alias("p1"), F.col("main").alias("p2"), F.col("secondary").alias("p3"))
    return sc.exact_match(g.join(p, list(sc.KEYS)), [("g1", "p1"), ("g2", "p2"), ("g3", "p3")])


@query("a12_exact_matrix", f"with x as ({_PAIRS}) {_EXACT}", "gt", "inc")
def a12(spark, d):
    return _exact(spark, d)


@query("a13_plain_average", f"with x as ({_PAIRS}), m as ({_EXACT}) select round(avg(tp / (tp + fp)), 3) as accuracy from m", "gt", "inc")
def a13(spark, d):
    return _exact(spark, d).agg(F.round(F.avg(F.col("tp") / (F.col("tp") + F.col("fp"))), 3).alias("accuracy"))


@query("a14_weighted_average", f"with x as ({_PAIRS}), m as ({_EXACT}) select round(sum(tp / (tp + fp) * w) / sum(w), 2) as accuracy from (select *, case dimension when 'g1' then 5 when 'g2' then 3 else 2 end as w from m)", "gt", "inc")
def a14(spark, d):
    w = F.when(F.col("dimension") == "g1", 5).when(F.col("dimension") == "g2", 3).otherwise(2)
    return _exact(spark, d).agg(F.round(F.sum(F.col("tp") / (F.col("tp") + F.col("fp")) * w) / F.sum(w), 2).alias("accuracy"))


@query(
    "a15_field_accuracy",
    """with f as (select o_orderkey as id, 'status' as field, lower(o_orderstatus) as truth from orders union all select o_orderkey, 'priority', lower(o_orderpriority) from orders),
c as (select l_orderkey as id, list(distinct lower(l_linestatus)) as statuses, list(distinct lower(l_returnflag)) as flags from lineitem group by 1),
m as (select field, case when c.id is null then false when field = 'status' then list_contains(statuses, truth) else list_contains(flags, truth) end as hit from f left join c using (id))
select field, count_if(hit) as tp, count_if(not hit) as fp, round(count_if(hit) / count(*), 6) as accuracy from m group by field
union all select 'overall', count_if(hit), count_if(not hit), round(count_if(hit) / count(*), 6) from m""",
)
def a15(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    fields = F.array(F.struct(F.lit("status").alias("field"), F.lower("o_orderstatus").alias("truth")), F.struct(F.lit("priority").alias("field"), F.lower("o_orderpriority").alias("truth")))
    said = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.lower("l_linestatus")).alias("statuses"), F.collect_set(F.lower("l_returnflag")).alias("flags"))
    rows = o.join(said, o.o_orderkey == said.id, "left").select(F.inline(fields), "statuses", "flags")
    hit = F.coalesce(F.array_contains(F.when(F.col("field") == "status", F.col("statuses")).otherwise(F.col("flags")), F.col("truth")), F.lit(False))
    counted = rows.select("field", hit.alias("hit")).rollup("field").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"), F.round(F.count_if("hit") / F.count(F.lit(1)), 6).alias("accuracy"))
    return counted.withColumn("field", F.coalesce("field", F.lit("overall")))


@query("a16_match_metrics", f"with x as ({_PAIRS}), m as (select count_if(g1 = p1) as tp, count_if(g1 is distinct from p1) as fn from x) select tp, fn, round(tp / greatest(tp + fn, 1), 4) as recall, round(2.0 * tp / greatest(2 * tp + fn, 0.000000001), 4) as f1 from m", "gt", "inc")
def a16(spark, d):
    one = _exact(spark, d).where("dimension = 'g1'").select("tp", F.col("fp").alias("fn"))
    tp, fn = F.col("tp"), F.col("fn")
    return one.select("tp", "fn", F.round(tp / F.greatest(tp + fn, F.lit(1)), 4).alias("recall"), F.round(2.0 * tp / F.greatest(2 * tp + fn, F.lit(1e-9)), 4).alias("f1"))


@query(
    "a17_call_correct",
    f"with {_LAST}, r as (select call_id, coalesce(ok, false) and g_call is not null and len(list_filter({_SET.format('gm', 'gs', 'gt3')}, lambda v: not list_contains({_SET.format('pm', 'ps', 'pt')}, v))) = 0 as within, coalesce(ok, false) and g_call is not null and list_sort({_SET.format('gm', 'gs', 'gt3')}) = list_sort({_SET.format('pm', 'ps', 'pt')}) as exact from j) select call_id, bool_and(within) as within, bool_and(exact) as exact from r group by call_id",
    "gt", "inc",
)
def a17(spark, d):
    truth = nz.norm_reasons(F.col("gt.main"), F.col("gt.secondary"), F.col("gt.third"))
    said = nz.norm_reasons(F.col("pred.main"), F.col("pred.secondary"), F.col("pred.third"))
    ok = F.coalesce(F.col("pred.parse_ok"), F.lit(False)) & F.col("gt").isNotNull()
    rows = _joined(spark, d).select("call_id", (ok & (F.size(F.array_except(truth, said)) == 0)).alias("within"), (ok & (truth == said)).alias("exact"))
    return rows.groupBy("call_id").agg(F.bool_and("within").alias("within"), F.bool_and("exact").alias("exact"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Per-class counts and rates of the call result, with the weighted row."""
    return a09(spark, d)


