"""Reconciliation, join, projection and set queries and their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import matching
from ..operators import reconcile as rc
from ..operators.ranking import global_forward_fill, global_row_number, ordered_row_number
from ..sources.scratch import kept
from .bindings import frame, run_sql, table, with_frames

QUERIES: dict = {}


def query(name: str, sql: str | None, *frames: str):
    def add(f):
        QUERIES[name] = (f, with_frames(sql, *frames) if sql else None)
        return f

    return add


def both(name: str, sql: str, *frames: str) -> None:
    QUERIES[name] = run_sql(sql, *frames)


_CAND = """k as (select e.er_id, l.z_id from {ext} as e join {ledger} as l on e.company = l.company
  union select e.er_id, l.z_id from {ext} as e join {ledger} as l on trim(e.invoice) <> '' and e.invoice = l.invoice),
c as (select e.*, l.z_id, l.company as z_company, l.invoice as z_invoice, l.vat as z_vat, l.clear_date, l.payment_doc from {ext} as e
  left join k on e.er_id = k.er_id left join {ledger} as l on k.z_id = l.z_id)"""


@query("j09_either_key", f"with {_CAND} select er_id, z_id from c", "ext", "ledger")
def j09(spark, d):
    return matching.left_with_either(frame(spark, d, "ext"), frame(spark, d, "ledger").select("z_id", "company", "invoice"), rc.KEYS, "er_id", "z_id").select("er_id", "z_id")


def _verify(rule: rc.Scenario) -> str:
    keys = {"line": "er_id, z_id", "payment": "er_id, payment_doc", "document": "er_id"}[rule.amount_rule]
    date = "year(doc_date) = year(clear_date) and month(doc_date) = month(clear_date)" if rule.date_rule == "month" else "cast(doc_date as date) = cast(clear_date as date)"
    n = rule.number
    return f"""f{n} as (select *, coalesce(company = z_company, false) as k_company, coalesce(invoice = z_invoice, false) as k_invoice, coalesce({date}, false) as k_date from c where scenario = {n}),
v{n} as (select *, coalesce(vat = sum(case when k_company then z_vat end) over (partition by {keys}) % 1000, false) as k_vat from f{n}),
m{n} as (select *, k_company and k_vat{' and k_invoice' if rule.need_invoice else ''} as matched from v{n}),
p{n} as (select * from m{n} qualify row_number() over (partition by er_id order by matched desc, k_invoice desc, k_vat desc, k_date desc, k_company desc, z_id asc nulls last) = 1)"""


_STATUS = """case when z_id is null then 'FAILED' when issue then 'SUSPICIOUS' when not matched then 'PARTIAL' else 'COMPLETED' end as status,
nullif(concat_ws(', ', case when not k_company then 'company' end, case when not k_invoice then 'invoice' end, case when not k_date then 'date' end, case when not k_vat then 'vat' end), '') as remark"""
_RULES = ", ".join(_verify(r) for r in rc.SCENARIOS)
_ALL = " union all ".join(f"select er_id, scenario, z_id, matched, {_STATUS} from p{r.number}" for r in rc.SCENARIOS)


def _reconciled(spark, d):
    """The status of every document, and the ledger, which is grouped once for all that reads it."""
    ledger = kept(frame(spark, d, "ledger"), "ledger")
    return rc.reconcile(frame(spark, d, "ext"), ledger), ledger


@query("o05_scenarios", f"with {_CAND}, {_RULES} {_ALL}", "ext", "ledger")
def o05(spark, d):
    return _reconciled(spark, d)[0]


@query("p14_status_counts", f"with {_CAND}, {_RULES}, s as ({_ALL}) select scenario, status, count(*) as n from s group by scenario, status", "ext", "ledger")
def p14(spark, d):
    return _reconciled(spark, d)[0].groupBy("scenario", "status").agg(F.count(F.lit(1)).alias("n"))


@query("j25_ledger_enriched", f"with {_CAND}, {_RULES}, s as ({_ALL}), z as (select z_id, min(status) as mapped from s where z_id is not null group by 1) select l.z_id, coalesce(mapped, 'OPEN') as status from {{ledger}} as l left join z on l.z_id = z.z_id", "ext", "ledger")
def j25(spark, d):
    states, ledger = _reconciled(spark, d)
    states = states.where("z_id is not null").groupBy(F.col("z_id").alias("of")).agg(F.min("status").alias("mapped"))
    return ledger.join(states, F.col("z_id") == F.col("of"), "left").select("z_id", F.coalesce("mapped", F.lit("OPEN")).alias("status"))


_NAMES = "select distinct p_name as name from part", "select distinct case when p_partkey % 3 = 0 then upper(left(p_name, 1)) || substr(p_name, 2) else p_name end as master from part"


@query("j08_similar_names", f"with a as ({_NAMES[0]}), b as ({_NAMES[1]}) select name, master from a, b where jaro_winkler_similarity(name, master) >= 0.9")
def j08(spark, d):
    part = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper(F.left("p_name", F.lit(1))), F.substr("p_name", F.lit(2)))).otherwise(F.col("p_name"))
    return matching.similar_names(part.select(F.col("p_name").alias("name")), part.select(name.alias("master")), "name", "master", 0.9)


@query("t14_jaro_winkler", "select n_name, r_name, jaro_winkler_similarity(lower(n_name), lower(r_name)) >= 0.6 as near from nation, region where n_regionkey = r_regionkey")
def t14(spark, d):
    from ..functions.similarity import jaro_winkler

    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_name", "r_name", (jaro_winkler(F.lower("n_name"), F.lower("r_name")) >= 0.6).alias("near"))


_TAX = "case when s_suppkey % 4 = 0 then 'TH-' || cast(s_suppkey * 7919 as string) when s_suppkey % 4 = 1 then '' else cast(s_suppkey * 104729 as string) || '99999999' end"


@query("p07_tax_id", f"select s_suppkey, nullif(lpad(left(regexp_replace(x, '[^0-9]', '', 'g'), 13), 13, '0'), '0000000000000') as cut from (select s_suppkey, {_TAX} as x from supplier)")
def p07(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", nz.tax_id(F.expr(_TAX)).alias("cut"))


@query("p06_text_key", "select doc_id, md5(lower(regexp_replace(nfc_normalize(text), '[\\s\\x{00A0}\\x{3000}\\x{200B}-\\x{200D}\\x{FEFF}]+', '', 'g'))) as key from documents")
def p06(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(nz.text_key(F.col("text"))).alias("key"))


_MONEY = "case o_orderkey % 4 when 0 then '1,' || cast(100 + o_orderkey % 900 as string) || '.50' when 1 then cast(o_orderkey % 1000 as string) || '.25-' when 2 then ' 12 ' else 'n/a' end"


@query("s13_money", f"select o_orderkey, cast(case when x like '%-' then try_cast('-' || left(x, length(x) - 1) as decimal(18,2)) else try_cast(x as decimal(18,2)) end as double) as amount from (select o_orderkey, replace(trim({_MONEY}), ',', '') as x from orders)")
def s13(spark, d):
    return table(spark, d, "orders").select("o_orderkey", nz.money(F.expr(_MONEY)).cast("double").alias("amount"))


_DATE = "case o_orderkey % 4 when 0 then '2024-03-0' || cast(1 + o_orderkey % 9 as string) when 1 then '0' || cast(1 + o_orderkey % 9 as string) || '.11.2023' when 2 then '31/12/2022' else 'soon' end"


@query("p08_dates", f"select o_orderkey, strftime(coalesce(try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%d.%m.%Y'), try_strptime(x, '%d/%m/%Y')), '%Y-%m-%d') as day from (select o_orderkey, {_DATE} as x from orders)")
def p08(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format(nz.any_date(F.expr(_DATE), "yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy"), "yyyy-MM-dd").alias("day"))


both("p04_call_filter", "select c_custkey from {customer} where c_custkey is not null and c_custkey <> 0 and trim(c_name) <> '' and c_custkey % 3 <> 0")
both("p05_blank_to_null", "select p_partkey, case when trim(x) = '' then null else x end as x from (select p_partkey, case when p_partkey % 4 = 0 then '  ' else p_name end as x from {part}) as t")
both("p09_month_match", "select o_orderkey, coalesce(year(o_orderdate) = year(l_shipdate) and month(o_orderdate) = month(l_shipdate), false) as same_month from {orders} join {lineitem} on o_orderkey = l_orderkey")
both("p10_scenario_ladder", "select er_id, case when issue or copied then 0 when scenario = 5 then 5 when scenario = 1 then 1 when scenario = 2 then 2 when scenario = 3 then 3 else 4 end as scenario from {ext} as e", "ext")
both("p11_redaction", "select er_id, case when issue then null else invoice end as invoice, case when issue then null else vat end as vat from {ext} as e", "ext")
both("p12_confidence", "select er_id, round((a + b + c) / 3 * 100, 2) as score from (select er_id, case when trim(invoice) <> '' then 1e0 else 0e0 end as a, round(exp(-abs(vat % 7)), 2) as b, case when issue then 0e0 else 1e0 end as c from {ext} as e) as x", "ext")
both("p13_remark", "select er_id, nullif(concat_ws(', ', case when issue then 'issue' end, case when copied then 'copy' end, case when trim(invoice) = '' then 'no invoice' end), '') as remark from {ext} as e", "ext")
both("p15_bands", "select c_custkey, case when c_acctbal >= 7500 then 'excellent' when c_acctbal >= 5000 then 'good' when c_acctbal >= 0 then 'acceptable' else 'unacceptable' end as band from {customer}")
both("p16_blank_rows", "select doc_id from (select doc_id, case when doc_id % 11 = 0 then '  ' when doc_id % 13 = 0 then null else text end as text from {documents}) as t where text is null or trim(text) = ''")
both("p17_route", "select o_orderkey, concat_ws('/', cast(year(o_orderdate) as string), split_part(o_orderpriority, '-', 1), case when o_orderpriority like '%URGENT%' then 'fast' else 'slow' end) as route from {orders}")
both("p19_complaint", "select er_id, remark like '1-%' or remark like '2-%' or remark like '3-%' as complaint from {ext} as e", "ext")
both("p20_ratio_flags", "select o_orderkey, case when cast(split_part(x, '/', 1) as bigint) > 0 then 'Y' else 'N' end as flag from (select o_orderkey, cast(o_orderkey % 3 as string) || '/3' as x from {orders}) as t")
both("p21_upsert", "select c.c_custkey, coalesce(u.name, c.c_name) as name from {customer} as c left join (select s_suppkey as k, max(s_name) as name from {supplier} group by s_suppkey) as u on c.c_custkey = u.k")
both("p22_trim_all", "select p_partkey, trim(x) as x, case when lower(y) in ('none', 'nan') then null else y end as y from (select p_partkey, ' ' || p_name || ' ' as x, case when p_partkey % 3 = 0 then 'None' else p_brand end as y from {part}) as t")
both("p24_conditional_default", "select er_id, case when trim(invoice) = '' and vat = 0 then '' when trim(invoice) <> '' and vat = 0 then '0' else cast(vat as string) end as amount from {ext} as e", "ext")
both("j06_inner_align", "select g.call_id, count(*) as n from {gt} as g join {cand} as c on g.call_id = c.call_id group by g.call_id", "gt", "cand")
both("j07_left_match_flag", "select o_orderkey, o_custkey, c.k is not null as matched from {orders} left join (select c_custkey as k, min(c_name) as name from {customer} group by c_custkey) as c on o_custkey * 2 = c.k")
both("j10_tax_join", "select s_suppkey, c_custkey from {supplier} join {customer} on lpad(cast(s_suppkey * 3 as string), 13, '0') = lpad(cast(c_custkey as string), 13, '0')")
both("j11_on_predicate", "select o_orderkey, l.l_partkey from {orders} left join (select l_orderkey, min(l_partkey) as l_partkey from {lineitem} group by l_orderkey) as l on o_orderkey = l.l_orderkey and l.l_partkey > 1000")
both("j12_semi", "select c_custkey from {customer} where c_custkey in (select distinct o_custkey from {orders} where o_orderstatus = 'F')")
both("j13_key_resolution", "select distinct c_custkey, n_name, r_name from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey")
both("j14_distinct_both", "select a.k from (select distinct o_custkey * 4 + 1 as k from {orders}) as a join (select distinct c_custkey as k from {customer}) as b on a.k = b.k")
both("j15_latest_attribute", "select c_custkey, o.o_orderkey, o.o_orderpriority from {customer} left join (select o_custkey, o_orderkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from {orders}) as o on c_custkey = o.o_custkey and o.rn = 1")
both("j16_snapshot", "select o_orderkey, s.name from {orders} left join (select cast(s_suppkey as string) as k, min(s_name) as name from {supplier} group by s_suppkey) as s on cast(o_custkey as string) = s.k")
both("j17_membership", "select s_suppkey, a.k is not null or b.k is not null as active from {supplier} left join (select distinct l_suppkey as k from {lineitem} where l_quantity > 49) as a on s_suppkey = a.k left join (select distinct ps as k from (select l_suppkey as ps from {lineitem} where l_discount > 0.09) as x) as b on s_suppkey = b.k")
both("j21_anti", "select c_custkey from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey and o_totalprice > 250000)")
both("j22_failed_attribution", "select f.user_id, f.event_id from (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id desc) as rn from {events}) as f join (select distinct user_id as u from {events} where event_type = 'purchase') as p on f.user_id = p.u where rn = 1 and event_type = 'error'")
both("j24_blank_slots", "select count(*) as rows_seen, count_if(g.call_id is null) as orphans, count_if(g.secondary is null and i.secondary is not null) as fabricated from {inc} as i left join {gt} as g on i.call_id = g.call_id and i.product = g.product", "inc", "gt")


@query("j18_range_join", "with ph as (select l_linenumber as phase, min(l_orderkey) as lo, min(l_orderkey) + 5000 as hi from lineitem group by 1) select phase, count(*) as n from orders, ph where o_orderkey between lo and hi group by phase")
def j18(spark, d):
    phases = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("phase")).agg(F.min("l_orderkey").alias("lo")).withColumn("hi", F.col("lo") + 5000)
    return matching.range_join(table(spark, d, "orders").select("o_orderkey"), phases, "o_orderkey", "lo", "hi").groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query("j19_positional_zip", "with a as (select n_regionkey as g, n_name, row_number() over (partition by n_regionkey order by n_name) as rn from nation), b as (select s_nationkey % 5 as g, s_suppkey, row_number() over (partition by s_nationkey % 5 order by s_suppkey) as rn from supplier) select g, n_name, s_suppkey from a join b using (g, rn)")
def j19(spark, d):
    a = table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), "n_name")
    b = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("g"), "s_suppkey")
    return matching.positional_join(a, b, ["g"], F.col("n_name"), F.col("s_suppkey"))


@query("j20_corpus_diff", "with a as (select doc_id, text as t, row_number() over (order by doc_id) as rn from documents where doc_id % 2 = 0), b as (select doc_id, text as t, row_number() over (order by doc_id) as rn from documents where doc_id % 2 = 1) select a.doc_id, b.doc_id as other, a.t = b.t as same from a join b using (rn)")
def j20(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("t"))
    a = global_row_number(rows.where("doc_id % 2 = 0"), "doc_id", "rn")
    b = global_row_number(rows.where("doc_id % 2 = 1"), "doc_id", "rn").select(F.col("doc_id").alias("other"), F.col("t").alias("u"), "rn")
    return a.join(b, "rn").select("doc_id", "other", (F.col("t") == F.col("u")).alias("same"))


@query("j23_category_lookup", "with m as (select p_partkey, case when p_partkey % 5 = 0 then p_brand end as grp, p_type from part), f as (select p_type, last_value(grp ignore nulls) over (order by p_partkey rows between unbounded preceding and current row) as grp, p_partkey from m), k as (select lower(p_type) as t, min(grp) as grp from f group by 1) select p.p_partkey, coalesce(k.grp, 'Other') as category from part as p left join k on lower(p.p_type) = k.t")
def j23(spark, d):
    part = table(spark, d, "part")
    rows = part.select("p_partkey", "p_type", F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).alias("grp"))
    filled = global_forward_fill(rows, "p_partkey", "grp")
    mapping = filled.groupBy(F.lower("p_type").alias("t")).agg(F.min("grp").alias("grp"))
    return part.join(mapping, F.lower("p_type") == F.col("t"), "left").select("p_partkey", F.coalesce("grp", F.lit("Other")).alias("category"))


@query("o01_mixed_sort", "select row_number() over (order by c_nationkey desc, c_acctbal desc, c_name, c_custkey) as pos, c_custkey from customer")
def o01(spark, d):
    order = [-F.col("c_nationkey"), -F.col("c_acctbal"), F.col("c_name"), F.col("c_custkey")]
    return ordered_row_number(table(spark, d, "customer"), order, "pos").select("pos", "c_custkey")


@query("o02_rank_sort", "select o_orderkey, row_number() over (order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, o_orderkey) as pos from orders")
def o02(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return ordered_row_number(table(spark, d, "orders"), [rank, F.col("o_orderkey")], "pos").select("o_orderkey", "pos")


both("o03_most_common", "select user_id, max_by(event_type, n * 100000000 - first_id) as top from (select user_id, event_type, count(*) as n, min(event_id) as first_id from {events} group by user_id, event_type) as x group by user_id")
both("o04_longest", "select doc_id, n_chars from {documents} order by n_chars desc, doc_id limit 10")
both("o06_union_rejects", "select doc_id, lang, cast(null as string) as reason from {documents} where n_chars >= 500 union all select doc_id, cast(null as string), 'short' from {documents} where n_chars < 500")
both("o07_distinct_links", "select distinct o_custkey, l_suppkey from {orders} join {lineitem} on o_orderkey = l_orderkey where l_quantity > 45")
both("o08_set_algebra", "select k, 'both' as side from (select c_custkey as k from {customer} intersect select o_custkey from {orders}) as a union all select k, 'left' from (select c_custkey as k from {customer} except select o_custkey from {orders}) as b")
both("o09_first_seen_union", "select k, min(pos) as pos from (select o_custkey as k, o_orderkey as pos from {orders} union all select c_custkey, 1000000 + c_custkey from {customer}) as x group by k")
both("o11_group_by_all", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from {lineitem} group by all")


@query("o10_distinct_aggregates", "select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority) filter (where o_orderstatus <> 'P'))), ';') as priorities from orders group by 1 having count(*) filter (where o_orderstatus <> 'P') > 0")
def o10(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    return rows.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("priorities"))


