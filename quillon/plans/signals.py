"""Signal queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import kernels
from quillon.operators import dma, lenses, reports
from quillon.sources.tables import mentions, posts, table

#: The month of queries whose feature is a month (fallback, carried state).
MONTH = "1996-03"


def _class() -> Column:
    return F.substring("drug", 1, 7)



BAG = """
select distinct l.l_orderkey as post, p.p_brand as drug, n.n_name as event, r.r_name as soc
from lineitem l join part p on l.l_partkey = p.p_partkey join supplier s on l.l_suppkey = s.s_suppkey
join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
"""
#: Whole tables by the finer product, a brand and size: sparse cells, with all strength tiers.
FINE_BAG = BAG.replace("p.p_brand as drug", "p.p_brand || '/' || p.p_size as drug")
MONTH_BAG = BAG + "join orders o on o.o_orderkey = l.l_orderkey where o.o_orderdate >= timestamp '1996-03-01' and o.o_orderdate < timestamp '1996-04-01'"
POSTS = """
select o_orderkey as post, cast(o_orderdate as date) as posted_at, o_custkey as author, o_orderstatus = 'F' as ae_flag,
  o_orderpriority as severity, n_name as country, r_name as region
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""


def sql_cells(source: str, name: str = "cells", drug: str = "drug", event: str = "event", within: str = "") -> str:
    """CTEs from a source of mentions to a table of cells."""
    by = f"{within}, " if within else ""
    part = f"partition by {within}" if within else ""
    return f"""{name}_p as (select {by}{drug} as drug, {event} as event, count(*)::bigint as a from {source} group by all),
{name}_m as (select *, (sum(a) over (partition by {by}drug))::bigint as bd, (sum(a) over (partition by {by}event))::bigint as be, (sum(a) over ({part}))::bigint as t from {name}_p),
{name} as (select {by}drug, event, a, bd - a as b, be - a as c, t - bd - be + a as d, t from {name}_m)"""


PRR = "((a+0.5::double)/(a+b+1))/((c+0.5::double)/(c+d+1))"
PRR_SE = "sqrt(greatest(1e-9::double, 1/(a+0.5::double)-1/(a+b+1::double)+1/(c+0.5::double)-1/(c+d+1::double)))"
ROR = "((a+0.5::double)*(d+0.5))/((b+0.5::double)*(c+0.5))"
ROR_SE = "sqrt(1/(a+0.5::double)+1/(b+0.5::double)+1/(c+0.5::double)+1/(d+0.5::double))"
EXP = "((a+b)::double*(a+c)/(a+b+c+d))"
CHI = "case when (a+b)::double*(c+d)*(a+c)*(b+d) = 0 then 0 else (a+b+c+d)::double*power(abs(a::double*d-b::double*c)-(a+b+c+d)/2.0::double,2)/((a+b)::double*(c+d)*(a+c)*(b+d)) end"


def sql_interval(x: str, se: str, name: str) -> str:
    return f"round({x},3) as {name}, round(exp(ln({x})-1.96::double*{se}),3) as {name}_low, round(exp(ln({x})+1.96::double*{se}),3) as {name}_high"


IC = f"log2((a+0.5::double)/({EXP}+0.5))"
IC_SD = f"sqrt((1/(a+0.5::double)+1/({EXP}+0.5))/power(ln(2::double),2))"
MEASURES = f"round({EXP},3) as expected, {sql_interval(PRR, PRR_SE, 'prr')}, {sql_interval(ROR, ROR_SE, 'ror')}, round({CHI},3) as chi_square, round({IC},3)+0 as ic, round({IC}-1.96::double*{IC_SD},3)+0 as ic025"
STRENGTH = "case when prr>=2 and chi_square>=4 and a>=3 then 'STRONG' when prr>=1.5 and a>=2 then 'MODERATE' else 'WEAK' end"
SDR_PRR = "(prr_low>=1 and chi_square>=4 and a>=3)"


def sql_measures(source: str, name: str, keys: str = "drug, event") -> str:
    return f"{name}_r as (select {keys}, a, b, c, d, {MEASURES} from {source}), {name} as (select *, {STRENGTH} as strength from {name}_r)"


def signals_disproportionality(spark: SparkSession, sf: str) -> DataFrame:
    return dma.disproportionality(mentions(spark, sf, fine=True)).orderBy(F.desc("ic025"), F.desc("prr"), F.desc("a"), "drug", "event")


def dma_dense(spark: SparkSession, sf: str) -> DataFrame:
    return dma.disproportionality(mentions(spark, sf))


def sta07_gamma_prior(spark: SparkSession, sf: str) -> DataFrame:
    rows = dma.gamma_prior(dma.cells(dma.pair_counts(mentions(spark, sf, fine=True))))
    return rows.select("n", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"))


def sta08_ebgm_eb05(spark: SparkSession, sf: str) -> DataFrame:
    return dma.bayes(dma.disproportionality(mentions(spark, sf, fine=True)))


def sta11_person_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct persons by exposure and condition, a many-to-many join on the person, and the PRR rule on them."""
    rows = mentions(spark, sf, fine=True).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("post"), F.col("o_custkey").alias("person")), "post")
    both = rows.select("person", "drug").distinct().join(rows.select("person", "event").distinct(), "person")
    return dma.measures(dma.cells(dma.pair_counts(both))).withColumn("sdr", kernels.sdr_by_prr())


def len10_class_effect(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.class_effect(mentions(spark, sf, fine=True), _class())


def len11_active_comparator(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.active_comparator(mentions(spark, sf), _class())


def len13_organ_system_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.organ_system_alerts(mentions(spark, sf, fine=True)).select("drug", "soc", "a", "prr", "chi_square", "soc_sdr", "member_sdr", "max_member", "alert")


def len14_universe_subset(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.universe_and_subset(mentions(spark, sf), F.substring("drug", -1, 1).isin("1", "2"))


def len08_stratified_cohort(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics within the cohort of flagged posts."""
    cohort = posts(spark, sf).where("ae_flag").select("post")
    return dma.disproportionality(mentions(spark, sf).join(cohort, "post", "left_semi"))


def len07_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.interactions(mentions(spark, sf))


def len03_masking(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.masking(mentions(spark, sf, fine=True)).drop("top_rival", "maskers")


def len05_remine(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.remine(mentions(spark, sf))


def len18_spatial_scan(spark: SparkSession, sf: str) -> DataFrame:
    signal = mentions(spark, sf).where((F.col("drug") == "Brand#11") & (F.col("soc") == "ASIA")).select("post").distinct()
    return lenses.spatial_scan(posts(spark, sf), signal)


def sta13_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.calibrated(dma.disproportionality(mentions(spark, sf)), F.col("drug").isin("Brand#11", "Brand#12"))


def len16_cross_section(spark: SparkSession, sf: str) -> DataFrame:
    """For each event its products by PRR, the three largest."""
    return dma.ranked(dma.disproportionality(mentions(spark, sf)).select("event", "drug", "a", "prr"), ["event"], [F.desc("prr"), F.desc("a"), "drug"], 3)


def len34_story_candidates(spark: SparkSession, sf: str) -> DataFrame:
    strong = dma.disproportionality(mentions(spark, sf, fine=True)).where("strength != 'WEAK'")
    return strong.groupBy("event").agg(F.countDistinct("drug").alias("n_drugs"), F.max("prr").alias("best_prr"), F.max_by("drug", F.struct("prr", "drug")).alias("best")).where("n_drugs >= 2")


def sta37_priority(spark: SparkSession, sf: str) -> DataFrame:
    rows = dma.disproportionality(mentions(spark, sf, fine=True))
    severity = F.when(F.col("a") >= 6, "Critical").when(F.col("a") >= 4, "High").when(F.col("a") >= 2, "Medium").otherwise("Low")
    return rows.select("drug", "event", "strength", severity.alias("severity"), reports.priority(F.col("strength"), severity).alias("priority"))


def gra01_edges(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.network(mentions(spark, sf))[0]


def gra02_centrality(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.network(mentions(spark, sf, fine=True))[1]


def len40_audit_chain(spark: SparkSession, sf: str) -> DataFrame:
    return reports.chain_links(dma.pair_counts(mentions(spark, sf)), F.col("event"), ["drug", "event", "a"])


QUERIES = {f.__name__: f for f in (
    signals_disproportionality, dma_dense, sta07_gamma_prior, sta08_ebgm_eb05, sta11_person_summary, len10_class_effect, len11_active_comparator, len13_organ_system_alerts,
    len14_universe_subset, len08_stratified_cohort, len07_interactions, len03_masking, len05_remine, len18_spatial_scan, sta13_calibration, len16_cross_section,
    len34_story_candidates, sta37_priority, gra01_edges, gra02_centrality, len40_audit_chain,
)}

_fine = f"with bag as ({FINE_BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')}"
_dense = f"with bag as ({BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')}"
_LIKELY = "(n_rival >= 2 and (round(n_rival::double/event_total,4) >= 0.10 or n_rival > a))"
_MASK = f"""
t as (select *, (sum(a) over (partition by event))::bigint as event_total from cells),
f as (select x.drug, x.event, x.a, x.event_total, y.drug as rival, y.a as n_rival, row_number() over (partition by x.drug, x.event order by y.a desc, y.drug) as place
  from t x join cells y on x.event = y.event and x.drug != y.drug),
g as (select drug, event, max(a) as target, max(event_total) as event_total, max(round(n_rival::double/event_total,4)) as top_share, count(*) filter (where {_LIKELY}) as n_likely,
  first(rival order by n_rival desc, rival) as top_rival, list(rival order by n_rival desc, rival) filter (where {_LIKELY}) as maskers from f where place <= 10 group by drug, event)"""
ORACLES = {
    "signals_disproportionality": f"{_fine} select * from m",
    "dma_dense": f"{_dense} select * from m",
    "sta07_gamma_prior": f"""with bag as ({FINE_BAG}), {sql_cells('bag')}, q as (select count(*) as n, avg(a/{EXP}) as m, var_pop(a/{EXP}) as v from cells)
select n, round(case when n<3 then 1 when v<=1e-9 then 2 else greatest(0.2::double,least(50::double,m*m/v)) end,4) as alpha, round(case when n<3 then 1 when v<=1e-9 then 2 else greatest(0.2::double,least(50::double,m/v)) end,4) as beta from q""",
    "sta11_person_summary": f"""with bag as (select b.*, o_custkey as person from ({FINE_BAG}) b join orders on o_orderkey = post),
j as (select x.drug, y.event from (select distinct person, drug from bag) x join (select distinct person, event from bag) y using (person)),
{sql_cells('j')}, {sql_measures('cells', 'm')} select *, {SDR_PRR} as sdr from m""",
    "len10_class_effect": f"""with bag as (select *, substring(drug,1,7) as class from ({FINE_BAG})), {sql_cells('bag', drug='class')}, {sql_measures('cells', 'm')},
k as (select class, event, count(distinct drug) as n_drugs from bag group by all)
select m.drug as class, m.* exclude (drug), n_drugs, n_drugs >= 2 and strength != 'WEAK' as class_effect from m join k on m.drug = k.class and m.event = k.event""",
    "len11_active_comparator": f"""with bag as (select *, substring(drug,1,7) as class from ({BAG})), {sql_cells('bag', within='class')},
k as (select class, count(distinct drug) as members from bag group by all),
r as (select class, drug, event, a, b, c, d, members, {sql_interval(ROR, ROR_SE, 'ror')} from cells join k using (class))
select class, drug, event, a, b, c, d, members, case when members>=2 then ror end as ror, case when members>=2 then ror_low end as ror_low, case when members>=2 then ror_high end as ror_high, members>=2 and ror_low>1 as stands_out from r""",
    "len13_organ_system_alerts": f"""with bag as ({FINE_BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')}, {sql_cells('bag', 'sc', event='soc')}, {sql_measures('sc', 's')},
h as (select distinct event, soc from bag), k as (select drug, soc, bool_or({SDR_PRR}) as member_sdr, max(a) as max_member from m join h using (event) group by all)
select s.drug, k.soc, a, prr, chi_square, {SDR_PRR} as soc_sdr, member_sdr, max_member, {SDR_PRR} and not member_sdr and max_member < 3 as alert from s join k on s.drug = k.drug and s.event = k.soc""",
    "len14_universe_subset": f"""with bag as ({BAG}), u as (select post, substring(drug,1,7) as drug, event from bag), v as (select * from bag where right(drug,1) in ('1','2')), w as (select post, substring(drug,1,7) as drug, event from v),
{sql_cells('u', 'uc')}, {sql_cells('w', 'wc')}, {sql_measures('uc', 'um')}, {sql_measures('wc', 'wm')}
select drug, event, um.a as universe_n, um.prr as universe_prr, wm.a as subset_n, wm.prr as subset_prr, round(wm.prr/um.prr,3) as prr_ratio from um join wm using (drug, event)""",
    "len08_stratified_cohort": f"with bag as (select b.* from ({BAG}) b join orders on o_orderkey = post where o_orderstatus = 'F'), {sql_cells('bag')}, {sql_measures('cells', 'm')} select * from m",
    "len07_interactions": f"""with bag as ({BAG}), dp as (select distinct post, drug from bag), ep as (select distinct post, event from bag),
multi as (select post from dp group by post having count(*) >= 2), d as (select * from dp semi join multi using (post)), e as (select * from ep semi join multi using (post)),
nd as (select drug, count(*) as n from d group by 1), ne as (select event, count(*) as n from e group by 1), nde as (select drug, event, count(*) as n from d join e using (post) group by all),
pr as (select x.post, x.drug as drug_a, y.drug as drug_b from d x join d y on x.post = y.post and x.drug < y.drug), np as (select drug_a, drug_b, count(*) as n from pr group by all),
t as (select drug_a, drug_b, event, count(*) as n from pr join e using (post) group by all having count(*) >= 2),
r as (select t.drug_a, t.drug_b, t.event, t.n, log2((t.n+0.5::double)/(xa.n::double*xb.n/ne.n+0.5)) as om, (t.n::double/np.n)/greatest(xa.n::double/da.n, xb.n::double/db.n) as ratio
 from t join nde xa on xa.drug=t.drug_a and xa.event=t.event join nde xb on xb.drug=t.drug_b and xb.event=t.event join nd da on da.drug=t.drug_a join nd db on db.drug=t.drug_b join ne on ne.event=t.event join np on np.drug_a=t.drug_a and np.drug_b=t.drug_b),
q as (select drug_a, drug_b, event, n, round(om,3)+0 as omega, round(om-1.96::double*sqrt(1/(n+0.5::double))/ln(2::double),3)+0 as omega025, round(ratio,3) as interaction_ratio from r)
select *, case when omega025>0 or (n>=3 and omega>0) then 'MODERATE' else 'WEAK' end as strength from q""",
    "len03_masking": f"""with bag as ({FINE_BAG}), {sql_cells('bag')}, {_MASK}
select drug, event, target, event_total, top_share, n_likely, case when top_share>=0.35 and target::double/event_total<0.40 then 'high' when top_share>=0.15 or n_likely>0 then 'moderate' else 'low' end as risk from g""",
    "len05_remine": f"""with bag as ({BAG}), {sql_cells('bag')}, {_MASK}, {sql_measures('cells', 'm')},
x as (select drug, event, list_sort(coalesce(maskers[1:3], [top_rival])) as members, array_to_string(list_sort(coalesce(maskers[1:3], [top_rival])), '|') as excluded from g),
s as (select distinct excluded, unnest(members) as drug from x), hit as (select distinct excluded, post from bag join s using (drug)),
kept as (select k.excluded, bag.* from bag, (select distinct excluded from s) k where not exists (select 1 from hit where hit.post=bag.post and hit.excluded=k.excluded)),
{sql_cells('kept', 'kc', within='excluded')}, {sql_measures('kc', 'k', 'excluded, drug, event')},
z as (select x.excluded, x.drug, x.event, m.a as n_before, m.prr as prr_before, (m.prr_low>=1 and m.chi_square>=4 and m.a>=3) as sb, k.a as n_after, k.prr as prr_after, (k.prr_low>=1 and k.chi_square>=4 and k.a>=3) as sa,
 round((k.a::double/(k.a+k.b))/(m.a::double/(m.a+m.b)),3) as coreporting from x join m using (drug, event) left join k on k.excluded=x.excluded and k.drug=x.drug and k.event=x.event)
select excluded, drug, event, n_before, prr_before, n_after, prr_after, round(prr_after/prr_before,3) as masking_ratio, coreporting,
case when n_after is null then 'vanished' when not sb and sa then 'unmasked' when sb and not sa then 'attenuated' when coreporting not between 0.85 and 1.15 then 'co_reported' when round(prr_after/prr_before,3)<=0.85 then 'attenuated' when round(prr_after/prr_before,3)>=1.15 then 'amplified' else 'stable' end as outcome,
case when n_before>=3 then 'evaluable' when n_before=2 then 'provisional' else 'exploratory' end as tier from z""",
    "len18_spatial_scan": f"""with p as ({POSTS}), s as (select distinct post from ({BAG}) where drug='Brand#11' and soc='ASIA'),
b as (select country, count(*) as base, count(*) filter (where post in (select post from s)) as observed from p group by 1),
t as (select *, sum(observed) over () as total, (sum(observed) over ())::double*base/(sum(base) over ()) as mu from b),
r as (select country, observed, round(mu,3) as expected, round(case when observed>mu and mu>0 and total>mu then observed*ln(observed/mu)+case when total>observed then (total-observed)*ln((total-observed)/(total-mu)) else 0 end else 0 end,2) as llr, round(observed/mu,2) as rr from t)
select *, observed>=5 and rr>=3 and llr>=3.84 as flagged, row_number() over (order by llr desc, rr desc, observed desc, country)=1 as most_likely from r""",
    "sta13_calibration": f"""{_dense}, s as (select *, (ic-ic025)/1.96::double as se from m), q as (select count(*) as k, avg(ic) as mu, greatest(0::double, var_samp(ic)-avg(se*se)) as tau2 from s where drug in ('Brand#11','Brand#12'))
select drug, event, a, ic, round(case when k>=3 then (ic-mu)/sqrt(se*se+tau2) end,3)+0 as z, round(ic-mu-1.96::double*sqrt(se*se+tau2),3)+0 as low, round(case when prr>1 then prr+sqrt(prr*(prr-1)) else 1 end,2) as e_value from s, q""",
    "len16_cross_section": f"{_dense}, r as (select event, drug, a, prr, row_number() over (partition by event order by prr desc, a desc, drug) as rank from m) select * from r where rank<=3",
    "len34_story_candidates": f"{_fine} select event, count(distinct drug) as n_drugs, max(prr) as best_prr, first(drug order by prr desc, drug desc) as best from m where strength != 'WEAK' group by event having count(distinct drug) >= 2",
    "sta37_priority": f"""{_fine}, s as (select drug, event, strength, case when a>=6 then 'Critical' when a>=4 then 'High' when a>=2 then 'Medium' else 'Low' end as severity from m)
select *, round(least(100::double, (case strength when 'STRONG' then 3 when 'MODERATE' then 2 else 1 end)*(case severity when 'Critical' then 4 when 'High' then 3 when 'Medium' then 2 else 1 end)*2*1/108.0::double*100),1) as priority from s""",
    "gra01_edges": f"with bag as ({BAG}) select drug, event, count(*) as weight from bag group by all",
    "gra02_centrality": f"""with bag as ({FINE_BAG}), e as (select drug, event, count(*) as w from bag group by all), n as (select 'drug' as kind, drug as node, w from e union all select 'event', event, w from e),
k as (select kind, node, count(*) as degree, sum(w)::bigint as strength from n group by all) select *, round(degree::double/(select count(*)-1 from k),4) as centrality from k""",
    "len40_audit_chain": f"""with bag as ({BAG}), p as (select drug, event, count(*) as a from bag group by all), h as (select *, sha256(drug||'|'||event||'|'||a::varchar) as content_hash from p)
select *, sha256(coalesce(lag(content_hash) over (partition by drug order by event), repeat('0',64))||':'||content_hash) as link_hash from h""",
}
