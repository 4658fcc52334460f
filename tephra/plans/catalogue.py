"""The queries of the dataflow operators, each beside the SQL it is held against.

The tables stand for what the operators are made for: an order is a structure, its line items are observations, return
flags and customers' segments are types. Doubles are rounded in both, since sums depend on the order of rows. The modules
imported at the end register more queries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tephra.functions import radial
from tephra.operators import conformal, curation, metrics, neighbours, ordered, reports, stats, weights
from tephra.plans.registry import ORACLES, QUERIES, query, rounded, t  # noqa: F401  (looked up here)

# Columns are made when a query runs: they need a session.


def y() -> Column:
    """Labels."""
    return F.col("l_extendedprice")


def mu() -> Column:
    """Predictions."""
    return F.col("l_quantity") * 1500.0


def sigma() -> Column:
    """Deviations; those of large discounts are not positive."""
    return 2000.0 + F.col("l_tax") * 100000.0 - F.when(F.col("l_discount") > 0.095, 1e9).otherwise(0.0)


#: The same in SQL.
OBS = "(select *, l_extendedprice y, l_quantity*1500.0 mu, 2000.0+l_tax*100000.0-case when l_discount>0.095 then 1e9 else 0.0 end sigma from lineitem)"


@query(f"""select coalesce(l_returnflag,'all') l_returnflag, n, round(rmse,4) rmse, round(mae,4) mae from (
  select l_returnflag, count(*) n, sqrt(avg((y-mu)^2)) rmse, avg(abs(y-mu)) mae from {OBS} group by grouping sets ((l_returnflag),()))""")
def rmse_by_type(spark, d):
    return rounded(metrics.error_report(t(spark, d, "lineitem"), "l_returnflag", {"n": F.count("*"), "rmse": metrics.rmse(y(), mu()), "mae": metrics.mae(y(), mu())}))


@query(f"""select l_returnflag, round(sqrt(avg((y-mu)^2) filter (sigma>0)),4) rmse, round(avg(abs(y-mu)) filter (sigma>0),4) mae,
  round(avg((abs(y-mu)<=sigma)::int) filter (sigma>0),4) coverage, round(sqrt(avg(((y-mu)/sigma)^2) filter (sigma>0)),4) rms_z,
  round(quantile_cont(sigma,0.95) filter (sigma>0)/quantile_cont(sigma,0.05) filter (sigma>0),4) sigma_ratio,
  round(quantile_cont(sigma,0.5) filter (sigma>0),4) median_sigma, count(*) filter (sigma<=0) n_dropped from {OBS} group by 1""")
def metrics_summary(spark, d):
    return rounded(metrics.summarise(t(spark, d, "lineitem"), y(), mu(), sigma(), ["l_returnflag"]))


@query(f"select l_linestatus, round(avg((abs(y-mu)<=sigma)::int),4) coverage, round(sqrt(avg(((y-mu)/sigma)^2)),4) rms_z from {OBS} where sigma>0 group by 1")
def coverage_by_group(spark, d):
    live = t(spark, d, "lineitem").where(sigma() > 0)
    return rounded(live.groupBy("l_linestatus").agg(metrics.coverage(y(), mu(), sigma()).alias("coverage"), metrics.rms_z(y(), mu(), sigma()).alias("rms_z")))


@query("""with r as (select rank() over (order by l_extendedprice)+(count(*) over (partition by l_extendedprice)-1)/2.0 a,
  rank() over (order by l_quantity)+(count(*) over (partition by l_quantity)-1)/2.0 b from lineitem) select round(corr(a,b),6) rho from r""")
def spearman(spark, d):
    return rounded(metrics.spearman(t(spark, d, "lineitem"), "l_extendedprice", "l_quantity"), 6)


@query("""with r as (select l_returnflag='R' p, rank() over (order by l_extendedprice)+(count(*) over (partition by l_extendedprice)-1)/2.0 k from lineitem),
  s as (select sum(k) filter (p) s, count(*) filter (p)::double n1, count(*) filter (not p)::double n0 from r) select round((s-n1*(n1+1)/2)/(n1*n0),6) auroc from s""")
def auroc(spark, d):
    return rounded(metrics.auroc(t(spark, d, "lineitem").withColumn("pos", F.col("l_returnflag") == "R"), "l_extendedprice", "pos"), 6)


@query("""with r as (select rank() over (order by l_extendedprice)+(count(*) over (partition by l_extendedprice)-1)/2.0 a,
  rank() over (order by l_quantity)+(count(*) over (partition by l_quantity)-1)/2.0 b, rank() over (order by l_tax)+(count(*) over (partition by l_tax)-1)/2.0 c from lineitem),
  k as (select corr(a,b) ab, corr(a,c) ac, corr(b,c) bc from r) select round((ab-ac*bc)/sqrt((1-ac^2)*(1-bc^2)),6) rho from k""")
def partial_rank_corr(spark, d):
    return rounded(reports.partial_rank_correlation(t(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_tax"), 6)


@query(f"""with m as (select l_returnflag, sqrt(avg((y-mu)^2)) rmse, avg(abs(y-mu)) mae from {OBS} group by 1)
  select l_returnflag, 'rmse' metric, round(rmse,4) as value from m union all select l_returnflag, 'mae', round(mae,4) from m""")
def unpivot_metrics(spark, d):
    wide = t(spark, d, "lineitem").groupBy("l_returnflag").agg(metrics.rmse(y(), mu()).alias("rmse"), metrics.mae(y(), mu()).alias("mae"))
    return rounded(metrics.unpivot(wide, ["l_returnflag"], ["rmse", "mae"]))


@query(f"""with e as (select (y-mu)/10000.0 e, y/30000.0 s from {OBS}) select round(avg(abs(e)),6) mae, round(quantile_cont(abs(e),0.5),6) median,
  round(sqrt(avg(e^2) filter (abs(s)<=1)),6) rmse_small, round(sqrt(avg(e^2) filter (abs(s)>1)),6) rmse_large,
  round(sum(case when abs(s)>1 then e^2 else 0 end)/sum(e^2),6) share_large, round(sqrt(avg((case when abs(s)>1 then 1/abs(s) else 1 end*e)^2)),6) wrmse from e""")
def error_split_measures(spark, d):
    return rounded(metrics.error_split(t(spark, d, "lineitem"), (y() - mu()) / 10000.0, y() / 30000.0), 6)


@query(f"select round(sqrt(avg(e2/(s2/3)) filter (s2>0)/3),6) kappa from (select (y-mu)^2 e2, case when sigma>0 then sigma^2 else 0 end s2 from {OBS})")
def kappa_scale(spark, d):
    frame = t(spark, d, "lineitem").select(F.pow(y() - mu(), 2).alias("e2"), F.when(sigma() > 0, F.pow(sigma(), 2)).otherwise(0.0).alias("s2"))
    return rounded(frame.agg(metrics.kappa(F.col("e2"), F.col("s2")).alias("kappa")), 6)


@query()
def crps_mean(spark, d):
    """Mean score of normal predictions by type; SQL has no erf."""
    live = t(spark, d, "lineitem").where(sigma() > 0)
    return live.groupBy("l_returnflag").agg(F.avg(metrics.crps(y(), mu(), sigma())).alias("crps"))


@query("""with n as (select l_orderkey, count(*) n from lineitem group by 1) select o_orderkey, round(power(n,-0.5)*case o_orderpriority when '1-URGENT' then 2.0 when '5-LOW' then 0.5 else 1.0 end,6) w_e
  from orders join n on o_orderkey=l_orderkey""")
def weight_factors(spark, d):
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    kinds = {"1-urgent": 2.0, "5-low": 0.5}
    w = weights.compose([weights.structural(F.col("n")), weights.by_type(F.col("o_orderpriority"), kinds), weights.override(F.lit(None))])
    return rounded(t(spark, d, "orders").join(n, "o_orderkey").select("o_orderkey", w.alias("w_e")), 6)


@query("select case lower(c_mktsegment) when 'building' then 1 when 'machinery' then 2 else 0 end type_idx, count(*) n from customer group by 1")
def type_index(spark, d):
    return t(spark, d, "customer").groupBy(weights.type_index(F.col("c_mktsegment"), ["BUILDING", "machinery"]).alias("type_idx")).agg(F.count("*").alias("n"))


@query("select doc_id, coalesce(quality,-1) label from documents left join labels using(doc_id)")
def label_coalesce(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("label"))


def scores(spark, d) -> DataFrame:
    """Nonconformity scores: a line item's error over its scale, in the group of its flag, under its order."""
    line = t(spark, d, "lineitem").withColumn("grp", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    return line.select(F.col("l_orderkey").alias("cfg"), "grp", F.round(F.abs(y() - mu()) / (2000.0 + F.col("l_tax") * 100000.0), 6).alias("s"))


SCORES = "(select l_orderkey cfg, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end grp, round(abs(l_extendedprice-l_quantity*1500.0)/(2000.0+l_tax*100000.0),6) s from lineitem)"
WEIGHTED = f"(select *, 1.0::double/count(*) over (partition by cfg, grp) w from {SCORES})"
QUANTILE = f"""(with a as (select grp, s, sum(w) w from {WEIGHTED} group by 1,2), tt as (select grp, sum(w) tw, count(distinct cfg) n_cfg from {WEIGHTED} group by 1),
  c as (select grp, s, sum(w) over (partition by grp order by s) cw from a)
  select c.grp, n_cfg, coalesce(min(s) filter (cw/(tw+tw/n_cfg)>=0.9-1e-15),'infinity'::double) q from c join tt on c.grp=tt.grp group by 1,2)"""


@query(f"select grp, count(*) n, round(sum(w),4) w from {WEIGHTED} group by 1")
def config_weights(spark, d):
    return rounded(conformal.config_weights(scores(spark, d), "cfg", "grp").groupBy("grp").agg(F.count("*").alias("n"), F.sum("w").alias("w")))


@query(f"select grp, round(sqrt(sum(w*s^2)/(3*sum(w))),6) lam from {WEIGHTED} group by 1")
def pooled_lam_rms(spark, d):
    return rounded(conformal.pooled_lam(conformal.config_weights(scores(spark, d), "cfg", "grp"), "s", by=["grp"]), 6)


@query(f"select grp, n_cfg, round(q,6) q from {QUANTILE}")
def pooled_q(spark, d):
    weighted = conformal.config_weights(scores(spark, d), "cfg", "grp")
    return rounded(conformal.weighted_quantile(weighted, "s", "w", "cfg", 0.1, ["grp"]), 6)


BANDED = "(select l_orderkey cfg, 2*(l_linenumber-1)+(l_returnflag='R')::int grp, round(abs(l_extendedprice-l_quantity*1500.0)/(2000.0+l_tax*100000.0),6) s from lineitem)"


@query(f"""with w as (select *, 1.0::double/count(*) over (partition by cfg, grp) w from {BANDED}), n as (select count(distinct cfg)//4 n_eff from w),
  a as (select grp, s, sum(w) w from w group by 1,2), tt as (select grp, sum(w) tw, count(distinct cfg) n_cfg, count(*) n_atom, sqrt(sum(w*s^2)/(3*sum(w))) lam from w group by 1),
  c as (select grp, s, sum(w) over (partition by grp order by s) cw from a), g as (select tt.grp, n_cfg, n_atom, lam, coalesce(min(s) filter (cw/(tw+tw/n_cfg)>=0.9-1e-15),'infinity'::double) q from c join tt on c.grp=tt.grp group by 1,2,3,4),
  pa as (select s, sum(w) over (order by s) cw from (select s, sum(w) w from w group by 1)), pt as (select sum(w) tw, count(distinct cfg) n_cfg, sqrt(sum(w*s^2)/(3*sum(w))) lam from w),
  pool as (select coalesce(min(s) filter (cw/(pt.tw+pt.tw/pt.n_cfg)>=0.9-1e-15),'infinity'::double) q, any_value(pt.lam) lam from pa, pt),
  p as (select a.grp, a.n_cfg, a.n_atom, b.grp src, b.q, b.lam, row_number() over (partition by a.grp order by (a.grp%2<>b.grp%2)::int, abs(a.grp//2-b.grp//2), b.grp//2) k
    from g a left join g b on b.n_cfg>=(select n_eff from n) and (a.n_cfg<(select n_eff from n) or a.grp=b.grp)),
  o as (select p.grp, p.n_cfg, p.n_atom, coalesce(src,-1) source, coalesce(p.q, pool.q) q, coalesce(p.lam, pool.lam) lam from p, pool where k=1)
  select grp, n_cfg, n_atom, source, round(q,6) q, round(lam,6) lam, round(q/(lam*2.5002777108094003),6) r from o""")
def group_scales(spark, d):
    line = t(spark, d, "lineitem").withColumn("grp", 2 * (F.col("l_linenumber") - 1) + (F.col("l_returnflag") == "R").cast("int"))
    frame = line.select(F.col("l_orderkey").alias("cfg"), "grp", F.round(F.abs(y() - mu()) / (2000.0 + F.col("l_tax") * 100000.0), 6).alias("s"))
    return rounded(conformal.group_table(frame, "s", "cfg", "grp", 0.1, frame.select("cfg").distinct().count() // 4), 6)


@query("""with q as (select quantile_cont(l_extendedprice,0.5) a, quantile_cont(l_extendedprice,0.9) b, quantile_cont(l_extendedprice,0.99) c, min(l_extendedprice) m from lineitem),
  e as (select a e, m from q union select b, m from q union select c, m from q) select round(e,4) edge from e where e>m""")
def band_edges(spark, d):
    return rounded(conformal.band_edges(t(spark, d, "lineitem"), "l_extendedprice").select(F.explode("edges").alias("edge")))


@query("""with q as (select quantile_cont(l_extendedprice,0.5) a, quantile_cont(l_extendedprice,0.9) b, quantile_cont(l_extendedprice,0.99) c from lineitem),
  z as (select l_linenumber m from lineitem group by 1 order by count(*) desc, 1 limit 1)
  select 2*((l_extendedprice>=a)::int+(l_extendedprice>=b)::int+(l_extendedprice>=c)::int)+(l_linenumber<>m)::int grp, count(*) n from lineitem, q, z group by 1""")
def assign_groups(spark, d):
    line = t(spark, d, "lineitem")
    fixed = conformal.band_edges(line, "l_extendedprice").crossJoin(conformal.modal_value(line, "l_linenumber"))
    placed = line.crossJoin(F.broadcast(fixed))  # one row
    return placed.groupBy(conformal.assign_group(y(), F.col("l_linenumber"), F.col("mode"), F.col("edges")).alias("grp")).agg(F.count("*").alias("n"))


@query(f"select stratum, count(*) n from (select cfg, max(grp) stratum from {SCORES} group by 1) group by 1")
def config_strata(spark, d):
    return scores(spark, d).groupBy("cfg").agg(F.max("grp").alias("stratum")).groupBy("stratum").agg(F.count("*").alias("n"))


@query("""select l_returnflag, l_linenumber as mode from (select l_returnflag, l_linenumber, row_number() over (partition by l_returnflag order by count(*) desc, l_linenumber) k from lineitem group by 1,2) where k=1""")
def modal_value(spark, d):
    return conformal.modal_value(t(spark, d, "lineitem"), "l_linenumber", ["l_returnflag"])


def _recalibrated(spark, d, mode: str) -> DataFrame:
    s = scores(spark, d)
    stored = s.where("cfg % 4 <> 0").withColumn("src", F.lit(0))
    new = s.where("cfg % 4 = 0 and grp < 2").withColumn("src", F.lit(0))
    n = new.where("grp = 0").select("cfg").distinct().count()
    out = conformal.recalibrate(stored, new, mode, n_eff=n)
    return out.groupBy("grp", "src").agg(F.count("*").alias("n"), F.sum("cfg").alias("cfg_sum"))


def _recalibrated_sql(keep: str) -> str:
    return f"""with s as {SCORES}, o as (select * from s where cfg%4<>0), n as (select * from s where cfg%4=0 and grp<2), f as (select grp, count(distinct cfg) k from n group by 1),
  r as (select cfg, grp, 0 src from o where {keep} union all select cfg+(select max(cfg)+1 from o), grp, 1 from n) select grp, src, count(*) n, sum(cfg)::bigint cfg_sum from r group by 1,2"""


@query(_recalibrated_sql("true"))
def calibrate_append(spark, d):
    return _recalibrated(spark, d, "append")


@query(_recalibrated_sql("false"))
def calibrate_replace(spark, d):
    return _recalibrated(spark, d, "replace")


@query(_recalibrated_sql("grp not in (select grp from f where k>=(select k from f where grp=0))"))
def calibrate_per_group(spark, d):
    return _recalibrated(spark, d, "per_group")


def supplier_edges(spark, d) -> DataFrame:
    """Suppliers whose balances differ by less than 150."""
    return neighbours.edges(t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"], 150.0, "s_suppkey")


SUPPLIER = "(select a.s_suppkey i, b.s_suppkey j, a.s_acctbal x, b.s_acctbal-a.s_acctbal v, abs(b.s_acctbal-a.s_acctbal) dist from supplier a join supplier b on a.s_suppkey<>b.s_suppkey and abs(a.s_acctbal-b.s_acctbal)<150.0)"


@query(f"select i, j, round(dist,4) dist from {SUPPLIER}")
def edge_list(spark, d):
    return rounded(supplier_edges(spark, d).select(F.col("l_s_suppkey").alias("i"), F.col("r_s_suppkey").alias("j"), "dist"))


@query(f"select s_suppkey, count(j) n from supplier left join {SUPPLIER} on i=s_suppkey group by 1")
def neighbour_counts(spark, d):
    n = supplier_edges(spark, d).groupBy(F.col("l_s_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return t(spark, d, "supplier").select("s_suppkey").join(n, "s_suppkey", "left").na.fill(0, ["n"])


@query(f"select i, j, row_number() over (partition by i order by j)-1 slot from {SUPPLIER}")
def dense_slots(spark, d):
    found = neighbours.slots(supplier_edges(spark, d), "l_s_suppkey", ["r_s_suppkey"])
    return found.select(F.col("l_s_suppkey").alias("i"), F.col("r_s_suppkey").alias("j"), "slot")


@query(f"with e as (select i, j, row_number() over (partition by i order by j)-1 slot from {SUPPLIER}) select a.i, a.j, a.slot, b.slot back from e a join e b on a.i=b.j and a.j=b.i")
def reverse_edges(spark, d):
    found = neighbours.slots(supplier_edges(spark, d), "l_s_suppkey", ["r_s_suppkey"]).withColumn("v", F.col("r_s_acctbal") - F.col("l_s_acctbal"))
    back = neighbours.reverse_slots(found.select(F.col("l_s_suppkey").alias("i"), F.col("r_s_suppkey").alias("j"), "slot", "v"), "i", "j", ["v"])
    return back.select("i", "j", "slot", "back")


@query(f"select i, count(*) filter (dist<100) z, round(case when count(*) filter (dist<100)>=2 then stddev_pop(dist) filter (dist<100)/avg(dist) filter (dist<100) else -1 end,6) d from {SUPPLIER} group by 1")
def shell_features(spark, d):
    found = neighbours.shell_features(supplier_edges(spark, d).withColumnRenamed("l_s_suppkey", "i"), "i", 100.0)
    return rounded(found.withColumn("d", F.when(F.isnan("d"), -1.0).otherwise(F.col("d"))), 6)


@query(f"select i, round(50.0*power(sum(power(1-power(dist/150.0,2),2)*power(50.0/dist,10))+1e-30,-0.1),4) s from {SUPPLIER} where dist>0.001 group by 1")
def site_summary(spark, d):
    found = supplier_edges(spark, d).where("dist > 0.001").withColumnRenamed("l_s_suppkey", "i")
    return rounded(neighbours.site_summary(found, "i", 50.0, 150.0))


@query(f"select min(n) min_coordination from (select s_suppkey, count(j) n from supplier left join {SUPPLIER} on i=s_suppkey group by 1)")
def min_coordination(spark, d):
    return neighbours.min_coordination(t(spark, d, "supplier"), supplier_edges(spark, d), "s_suppkey", "l_s_suppkey")


@query("select s_suppkey from supplier s where not exists (select 1 from supplier o where o.s_nationkey=s.s_nationkey and o.s_suppkey<>s.s_suppkey and abs(o.s_acctbal-s.s_acctbal)<300.0)")
def physical_filter(spark, d):
    points = t(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    close = neighbours.edges(points, ["s_acctbal"], 300.0, "s_suppkey", ["s_nationkey"]).select(F.col("l_s_suppkey").alias("s_suppkey"))
    return points.select("s_suppkey").join(close, "s_suppkey", "left_anti")


def nearest_others(spark, d) -> DataFrame:
    v = t(spark, d, "embeddings")
    return neighbours.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "vec_id", "embedding", others=True)


NEAREST = """(select a.vec_id, min(list_sum(list_transform(list_zip(a.embedding,b.embedding), lambda z: power(z[1]::double-z[2]::double,2)))) d2 from embeddings a join embeddings b on b.vec_id<>a.vec_id where a.vec_id%100=0 group by 1)"""


@query(f"select vec_id, round(d2,4) d2 from {NEAREST}")
def nn_distance(spark, d):
    return rounded(nearest_others(spark, d).select("vec_id", "d2"))


@query(f"select label, round(sqrt(max(d2)),4) novelty from {NEAREST} join embeddings using(vec_id) group by 1")
def score_novelty(spark, d):
    return rounded(curation.novelty(t(spark, d, "embeddings").select("vec_id", "label"), nearest_others(spark, d), "label", "vec_id", "d2"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def top_k_pick(spark, d):
    return ordered.top_k(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50)


@query("select l_returnflag||':'||floor(l_quantity/10)::bigint||':'||floor(l_extendedprice/10000)::bigint as block, count(*) n from lineitem group by 1")
def grid_blocks(spark, d):
    scaled = t(spark, d, "lineitem").withColumn("q", F.col("l_quantity") * 1000)
    return neighbours.grid_blocks(scaled, ["q", "l_extendedprice"], 10000.0, ["l_returnflag"]).groupBy("block").agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linenumber, dense_rank() over (order by l_returnflag, l_linenumber)-1 cluster, n from (select l_returnflag, l_linenumber, count(*) n from lineitem group by 1,2)")
def dense_rank_clusters(spark, d):
    groups = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    return groups.withColumn("cluster", F.dense_rank().over(Window.orderBy("l_returnflag", "l_linenumber")) - 1)  # a row per pair of small codes


@query("""select bucket, count(*) n from (select case when n<=8 then power(2,ceil(log2(n))) when n<=128 then ceil(n/8.0)*8 else
  (select min(ceil(ceil(128*power(2,k/4.0))/8.0)*8) from range(1,81) r(k) where ceil(ceil(128*power(2,k/4.0))/8.0)*8>=n) end::bigint bucket from (select n_chars//16+1 n from documents)) group by 1""")
def size_buckets(spark, d):
    return t(spark, d, "documents").select(ordered.size_bucket(F.expr("n_chars div 16 + 1")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def phi() -> list[Column]:
    """Design rows."""
    return [F.lit(1.0), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]


def weight() -> Column:
    """Weights; the seventh line counts as absent."""
    return F.when(F.col("l_linenumber") == 7, 0.0).otherwise(1.0 / F.col("l_linenumber"))


def r() -> Column:
    """Distances."""
    return F.col("l_quantity") / 10.0 + 0.05


X = ["1.0", "l_quantity", "l_discount", "l_tax"]
GRAM_SQL = ", ".join([f"round(sum(w*w*{X[i]}*{X[j]}),2) g_{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"round(sum(w*w*{X[i]}*y),2) b_{i}" for i in range(4)] + ["round(sum(w*w*y*y),0) yy", "count(*) n", "round(sum(2*ln(w)),4) logw"])
ROWS = "(select *, l_extendedprice/1000.0 y, 1.0::double/l_linenumber w from lineitem where l_linenumber<>7)"


def eliminated(d: int, source: str, prior: float) -> str:
    """CTEs that solve (G + prior) x = b by Gauss-Jordan steps, from the one-row table ``source`` of g_i_j and b_i: in ``solved`` x_i and the inverse's v_i_j."""
    g = lambda i, j: f"g_{min(i, j)}_{max(i, j)}"
    names = [[f"a{i}_{j}" for j in range(2 * d + 1)] for i in range(d)]
    first = [f"({g(i, j)}+{prior if i == j else 0})::double {names[i][j]}" for i in range(d) for j in range(d)]
    first += [f"b_{i}::double {names[i][d]}" for i in range(d)] + [f"{float(i == j)}::double {names[i][d + 1 + j]}" for i in range(d) for j in range(d)]
    out = [f"e0 as (select {', '.join(first)} from {source})"]
    for k in range(d):
        step = []
        for i in range(d):
            for j in range(2 * d + 1):
                row = f"{names[k][j]}/{names[k][k]}"
                step.append(f"{row if i == k else f'{names[i][j]}-{names[i][k]}*({row})'} {names[i][j]}")
        out.append(f"e{k + 1} as (select {', '.join(step)} from e{k})")
    last = [f"{names[i][d]} x_{i}" for i in range(d)] + [f"{names[i][d + 1 + j]} v_{i}_{j}" for i in range(d) for j in range(d)]
    return ", ".join([*out, f"solved as (select {', '.join(last)} from e{d})"])


def factored(d: int) -> str:
    """CTEs of the Cholesky factor r_i_j (i <= j) of g_i_j and the target c_i, row by row, from the table ``gram`` to ``factor``."""
    out, source = [], "gram"
    for i in range(d):
        top = f"sqrt(g_{i}_{i}{''.join(f'-power(r_{k}_{i},2)' for k in range(i))})"
        out.append(f"p{i} as (select *, {top} r_{i}_{i} from {source})")
        rest = [f"(g_{i}_{j}{''.join(f'-r_{k}_{i}*r_{k}_{j}' for k in range(i))})/r_{i}_{i} r_{i}_{j}" for j in range(i + 1, d)]
        rest.append(f"(b_{i}{''.join(f'-r_{k}_{i}*c_{k}' for k in range(i))})/r_{i}_{i} c_{i}")
        out.append(f"f{i} as (select *, {', '.join(rest)} from p{i})")
        source = f"f{i}"
    return ", ".join([*out, f"factor as (select * from {source})"])


SUMS = ", ".join([f"sum(w*w*{X[i]}*{X[j]}) g_{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"sum(w*w*{X[i]}*y) b_{i}" for i in range(4)])
SOLVED = f"with gram as (select {SUMS} from {ROWS}), " + eliminated(4, "gram", 1e-3)
MU = "+".join(f"{X[i]}*x_{i}" for i in range(4))
VAR = "+".join(f"{X[i]}*{X[j]}*v_{i}_{j}" for i in range(4) for j in range(4))
ALL_ROWS = "(select *, l_extendedprice/1000.0 y from lineitem)"


def _gram(spark, d, by=()) -> DataFrame:
    out = stats.gram_entries(t(spark, d, "lineitem"), phi(), y() / 1000.0, weight(), by)
    return out.select(*[F.round(c, 0 if c == "yy" else 4 if c == "logw" else 2).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query(f"select {GRAM_SQL} from {ROWS}")
def gram_statistics(spark, d):
    return _gram(spark, d)


@query(f"select l_returnflag, {GRAM_SQL} from {ROWS} group by 1")
def gram_typed(spark, d):
    return _gram(spark, d, ["l_returnflag"])


def _fit(spark, d) -> tuple[np.ndarray, np.ndarray]:
    gram = stats.gram_of(stats.gram_entries(t(spark, d, "lineitem"), phi(), y() / 1000.0, weight()).first(), 4)
    return stats.posterior(gram, np.full(4, 1e-3))


@query("select round(regr_slope(l_extendedprice, l_quantity),3) slope, round(regr_intercept(l_extendedprice, l_quantity),2) intercept from lineitem")
def least_squares_line(spark, d):
    gram = stats.gram_of(stats.gram_entries(t(spark, d, "lineitem"), phi()[:2], y(), F.lit(1.0)).first(), 2)
    c = np.linalg.solve(gram.g, gram.b)
    return spark.createDataFrame([(round(float(c[1]), 3), round(float(c[0]), 2))], "slope double, intercept double")


@query(f"with gram as (select {SUMS} from {ROWS}), " + factored(4) + " " + " union all ".join(f"select {i} i, " + ", ".join(f"{f'round(r_{i}_{j},4)+0.0' if j >= i else '0.0'} r{j}" for j in range(4)) + f", round(c_{i},4)+0.0 c from factor" for i in range(4)))
def tsqr_factor(spark, d):
    """The merged QR factor of all rows, signs made positive."""
    frame = t(spark, d, "lineitem").select(F.array(*[p.cast("double") for p in phi()]).alias("phi"), (y() / 1000.0).alias("y"), weight().alias("w"))
    r, c, _ = stats.qr_factors(frame, "phi", "y", "w", 4)
    return rounded(spark.createDataFrame([(i, *[float(v) if j >= i else 0.0 for j, v in enumerate(r[i])], float(c[i])) for i in range(4)], "i int, r0 double, r1 double, r2 double, r3 double, c double"))


@query(SOLVED + " " + " union all ".join(f"select {i} i, round(x_{i},6)+0.0 mean, round(sqrt(v_{i}_{i}),6) std from solved" for i in range(4)))
def ridge_posterior(spark, d):
    mean, cov = _fit(spark, d)
    return rounded(spark.createDataFrame([(i, float(m), float(np.sqrt(cov[i, i]))) for i, m in enumerate(mean)], "i int, mean double, std double"), 6)


@query(f"{SOLVED} select l_returnflag, l_linenumber, count(*) n, round(avg({MU}),6) mu, round(avg({VAR}),8) var, round(max({VAR}),8) most from {ALL_ROWS}, solved group by 1, 2")
def predictive_variance(spark, d):
    """Mean and variance of all rows under the fitted model, by type."""
    mean, cov = _fit(spark, d)
    served = stats.predict(t(spark, d, "lineitem"), phi(), mean, cov)
    return served.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("mu"), 6).alias("mu"), F.round(F.avg("var"), 8).alias("var"), F.round(F.max("var"), 8).alias("most"))


@query(f"{SOLVED} select l_returnflag, l_linenumber, round(avg({VAR}),8) leverage, round(sqrt(avg(power((y-({MU}))/(1-({VAR})),2))),6) press from {ALL_ROWS}, solved group by 1, 2")
def press_residuals(spark, d):
    """Leverages and the errors rows would have if they were left out, by type."""
    mean, cov = _fit(spark, d)
    left = stats.leave_one_out(t(spark, d, "lineitem"), phi(), y() / 1000.0, mean, cov)
    return left.groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("leverage"), 8).alias("leverage"), F.round(F.sqrt(F.avg(F.col("press") * F.col("press"))), 6).alias("press"))


@query(f"{SOLVED}, h as (select *, {VAR} h, y-({MU}) r from {ALL_ROWS}, solved), c as (select quantile_cont(h,0.9) cut from h), k as (select " + ", ".join("(" + "+".join(f"{X[j]}*v_{i}_{j}" for j in range(4)) + f")*r/h d{i}" for i in range(4)) + " from h, c where h>=cut) select count(*) n, round(min(d0),4)+0.0 least0, round(max(d0),4)+0.0 most0, round(min(d1),4)+0.0 least1, round(max(d1),4)+0.0 most1, round(min(d2),4)+0.0 least2, round(max(d2),4)+0.0 most2, round(min(d3),4)+0.0 least3, round(max(d3),4)+0.0 most3 from k")
def point_corrections(spark, d):
    """Bounds of the least coefficient changes that would fit single rows of high leverage."""
    mean, cov = _fit(spark, d)
    seen = stats.point_corrections(t(spark, d, "lineitem"), phi(), y() / 1000.0, mean, cov)
    kept = stats.leverage_select(seen, "h", 90.0)
    return rounded(kept.agg(F.count("*").alias("n"), *[f(F.col("delta")[i]).alias(f"{n}{i}") for i in range(4) for n, f in (("least", F.min), ("most", F.max))]))


@query("select count(*) n from lineitem where l_extendedprice >= (select quantile_cont(l_extendedprice,0.9) from lineitem)")
def leverage_select(spark, d):
    return stats.leverage_select(t(spark, d, "lineitem"), "l_extendedprice", 90.0).agg(F.count("*").alias("n"))


@query("select l_orderkey, round(avg(l_quantity),6) mean, round(avg(l_tax)+var_pop(l_quantity),6) variance from lineitem group by 1")
def mixture_mean_var(spark, d):
    return rounded(stats.mixture(t(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_tax"), 6)


@query()
def logistic_weights(spark, d):
    frame = t(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("q"), "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.lit(1.0).alias("w"))
    beta = stats.logistic(frame, ["q", "l_discount"], "y", "w")
    return spark.createDataFrame([(i, float(b)) for i, b in enumerate(beta)], "i int, beta double")


def _rounds(steps: int) -> str:
    """Lloyd's rounds written out, a CTE each."""
    out = ["x as (select l_quantity/50 q, l_extendedprice/1e5 p from lineitem)", "c0 as (select * from (values (0,0.1::double,0.1::double),(1,0.5,0.5),(2,0.9,0.9)) v(k,q,p))"]
    for i in range(steps):
        out.append(f"c{i + 1} as (select k, avg(q) q, avg(p) p from (select x.q, x.p, arg_min(c.k, (power(x.q-c.q,2)+power(x.p-c.p,2), c.k)) k from (select *, row_number() over () i from x) x, c{i} c group by x.i, x.q, x.p) group by 1)")
    return f"with {', '.join(out)} select k, round(q,6) q, round(p,6) p from c{steps}"


KMEANS = _rounds(20)


@query(KMEANS)
def kmeans_centres(spark, d):
    frame = t(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 1e5).alias("p"))
    centres, _ = stats.kmeans(frame, ["q", "p"], np.array([[0.1, 0.1], [0.5, 0.5], [0.9, 0.9]]))
    return rounded(spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)], "k int, q double, p double"), 6)


@query("select o_orderkey, count(*) filter (l_returnflag='A') \"A\", count(*) filter (l_returnflag='N') \"N\", count(*) filter (l_returnflag='R') \"R\" from orders join lineitem on o_orderkey=l_orderkey group by 1")
def species_counts_pivot(spark, d):
    joined = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)


@query("select (greatest(s_nationkey,n_regionkey)*(greatest(s_nationkey,n_regionkey)+1)/2+least(s_nationkey,n_regionkey))::bigint pair, count(*) n from supplier join nation on s_nationkey=n_nationkey group by 1")
def pair_id(spark, d):
    joined = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(radial.pair_id(F.col("s_nationkey"), F.col("n_regionkey")).alias("pair")).agg(F.count("*").alias("n"))


@query("select min(l_extendedprice) least, max(l_extendedprice) most from lineitem where l_linenumber<>7")
def data_range(spark, d):
    return t(spark, d, "lineitem").where(weight() > 0).agg(F.min(y()).alias("least"), F.max(y()).alias("most"))


@query("select o_orderpriority, arg_min(o_orderkey, (o_totalprice, o_orderkey)) best from orders group by 1")
def gate_argmin(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("select k dedup_key, count(*) n, min(doc_id) first_id from (select doc_id, sha256(lang||'|'||text) k from documents) group by 1")
def dedup_key(spark, d):
    keyed = t(spark, d, "documents").select("doc_id", curation.content_key(F.col("lang"), F.col("text")).alias("dedup_key"))
    return keyed.groupBy("dedup_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def label_cache_miss(spark, d):
    return curation.misses(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


@query("""with c as (select s_suppkey k, s_nationkey b, s_acctbal v from supplier), w as (select c_custkey k, c_nationkey b, c_acctbal v from customer),
  n as (select w.k, arg_min(c.k, (abs(c.v-w.v), c.k)) l from w join c on c.b=w.b and abs(c.v-w.v)<=200.0 group by 1)
  select w.k, coalesce(c.k, n.l) label from w left join c on c.k=w.k left join n on n.k=w.k""")
def label_cache_lookup(spark, d):
    cache = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("b"), F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("label"))
    wanted = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("b"), F.col("c_acctbal").alias("v"))
    return curation.lookup(wanted, cache, "k", "b", "v", "label", 200.0).select("k", "label")


def _two(spark, d) -> tuple[DataFrame, DataFrame]:
    """Totals of orders, and the lines of other orders, several of one key, in the order of their numbers."""
    o = t(spark, d, "orders").where("o_orderkey % 3 <> 0").select("o_orderkey", "o_totalprice")
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"), "l_linenumber")
    return o, lines


TWO = "with o as (select o_orderkey, o_totalprice p from orders where o_orderkey%3<>0), l as (select l_orderkey o_orderkey, l_extendedprice p, l_linenumber k from lineitem)"


@query(f"{TWO} select o_orderkey, round(p,2) p from o union all select o_orderkey, round(arg_min(p,(k,o_orderkey,p)),2) from l where o_orderkey not in (select o_orderkey from o) group by 1")
def insert_if_absent(spark, d):
    return curation.insert_if_absent(*_two(spark, d), ["o_orderkey"], ["l_linenumber"]).select("o_orderkey", F.round("o_totalprice", 2).alias("p"))


@query(f"{TWO} select o_orderkey, round(p,2) p from o where o_orderkey not in (select o_orderkey from l) union all select o_orderkey, round(arg_max(p,(k,o_orderkey,p)),2) from l group by 1")
def upsert(spark, d):
    return curation.upsert(*_two(spark, d), ["o_orderkey"], ["l_linenumber"]).select("o_orderkey", F.round("o_totalprice", 2).alias("p"))


@query("""select o_orderkey, case when n>=2 and k<=least(greatest(1,round_even(n*0.1,0)),n-1) then 1 else 0 end held from
  (select o_orderkey, count(*) over (partition by o_orderpriority) n, row_number() over (partition by o_orderpriority order by md5('0:'||o_orderkey), o_orderkey) k from orders)""")
def stratified_by_hash(spark, d):
    return ordered.stratified_split(t(spark, d, "orders"), "o_orderpriority", "o_orderkey", 0.1).select("o_orderkey", F.col("held").cast("int").alias("held"))


@query("select role, count(*) n from (select case when h<0.8 then 'train' when h<0.9 then 'test' else 'ood' end as role from (select ('0x'||substr(md5('7:'||o_orderkey),1,7))::bigint/268435456.0 h from orders)) group by 1")
def split_by_hash(spark, d):
    return ordered.split_by_hash(t(spark, d, "orders"), "o_orderkey", {"train": 0.8, "test": 0.1, "ood": 0.1}, 7).groupBy("role").agg(F.count("*").alias("n"))


def _picks(m: int) -> str:
    """Greedy k-centre written out, a pick each."""
    gap = "list_sum(list_transform(list_zip(e.embedding,p.embedding), lambda z: power(z[1]::double-z[2]::double,2)))"
    out = ["s0 as (select vec_id, label, embedding, 'infinity'::double d from embeddings)", "p0 as (select label, min(vec_id) vec_id, arg_min(embedding, vec_id) embedding from embeddings group by 1)"]
    for i in range(1, m):
        out.append(f"s{i} as (select e.vec_id, e.label, e.embedding, least(e.d, {gap}) d from s{i - 1} e join p{i - 1} p using(label))")
        out.append(f"p{i} as (select label, arg_max(vec_id, (d, -vec_id)) vec_id, arg_max(embedding, (d, -vec_id)) embedding from s{i} group by 1 having max(d)>0)")
    return f"with {', '.join(out)} " + " union all ".join(f"select label, vec_id, {i} pick from p{i}" for i in range(m))


FARTHEST = _picks(8)


@query(FARTHEST)
def farthest_points(spark, d):
    return curation.farthest_points(t(spark, d, "embeddings"), "vec_id", "embedding", 8, ["label"])


@query("""with recursive r as (select l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) i from lineitem),
  p as (select l_orderkey, i, l_linenumber, l_quantity, 0 pack, l_quantity total, 1 held from r where i=1 union all
    select r.l_orderkey, r.i, r.l_linenumber, r.l_quantity, case when total+r.l_quantity>60 or held>=3 then pack+1 else pack end, case when total+r.l_quantity>60 or held>=3 then r.l_quantity else total+r.l_quantity end, case when total+r.l_quantity>60 or held>=3 then 1 else held+1 end
    from p join r on r.l_orderkey=p.l_orderkey and r.i=p.i+1) select l_orderkey, l_linenumber, l_quantity, pack from p""")
def bucket_pack(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return curation.pack_groups(lines, "l_orderkey", ["l_linenumber", "l_quantity"], "l_quantity", 60, 3)


@query("""with r as (select l_orderkey, l_linenumber, l_quantity/10.0+0.05 r from lineitem), s as (select *, (r-0.5)/(1.5-0.5) s, (5.5-0.5)/(1.5-0.5) sc from r),
  y as (select *, case when r<=0.5 then 1.0 else 1/(1+power(s,4)/(1+power(s,2))) end y, 1/(1+power(sc,4)/(1+power(sc,2))) yc from s)
  select l_orderkey, l_linenumber, round(least(greatest(-1+2*(y-1.0)/(yc-1.0),-1.0),1.0),8) x, round(power(1-power(least(greatest(r/5.0,0),1),2),2),8) fc from y""")
def agnesi(spark, d):
    line = t(spark, d, "lineitem")
    return rounded(line.select("l_orderkey", "l_linenumber", radial.agnesi(r(), 0.5, 1.5, 5.5).alias("x"), radial.cutoff(r(), 5.0).alias("fc")), 8)


@query("""select l_quantity, round(any_value(case when abs(r-2)<=1 then power(1-(r-2)*(r-2),2) else 0 end),8) poly,
  round(any_value(case when r<5 then power(r/2,-2)-power(2.5,-2)+2*power(2.5,-3)*(r/2-2.5) else 0 end),8) inv from (select *, l_quantity/10.0+0.05 r from lineitem) group by 1""")
def envelopes(spark, d):
    line = t(spark, d, "lineitem").select("l_quantity").distinct()
    return rounded(line.select("l_quantity", radial.poly_envelope(r() - 2).alias("poly"), radial.inverse_envelope(r(), 5.0, 2.0).alias("inv")), 8)


@query("""with y as (select distinct l_discount, 1-2*l_discount*5 y from lineitem), p as (select *, 1.0 p0, 1.5*y+0.5 p1 from y), q as (select *, (2*y+0.1)*p1-0.5*p0 p2 from p)
  select l_discount, round(p0,8) p0, round(p1,8) p1, round(p2,8) p2, round((1.8*y-0.2)*p2-0.7*p1,8) p3 from q""")
def poly_recursion(spark, d):
    rows = t(spark, d, "lineitem").select("l_discount").distinct()
    p = radial.recurrence(1 - 2 * F.col("l_discount") * 5, [1.0, 1.5, 2.0, 1.8], [0.0, 0.5, 0.1, -0.2], [0.0, 0.0, -0.5, -0.7])
    return rounded(rows.withColumn("p", p).select("l_discount", *[F.col("p")[i].alias(f"p{i}") for i in range(4)]), 8)


KNOTS = [float(np.exp(-0.5 * i)) for i in range(12)]
COEFFICIENTS = radial.spline_coefficients(KNOTS, 0.5)


@query(f"""with x as (select distinct l_quantity, l_quantity/10.0 x from lineitem), k as (select *, x/0.5+1 k from x), i as (select *, least(greatest(floor(k),1),{len(KNOTS) - 1})::int ix from k), f as (select *, k-ix t from i),
  c as (select [{",".join(map(repr, COEFFICIENTS))}] c) select l_quantity, round(power(1-t,3)/6*c[ix]+(3*power(t,3)-6*t*t+4)/6*c[ix+1]+(-3*power(t,3)+3*t*t+3*t+1)/6*c[ix+2]+power(t,3)/6*c[ix+3],8) s from f, c""")
def spline_eval(spark, d):
    rows = t(spark, d, "lineitem").select("l_quantity").distinct()
    return rounded(rows.select("l_quantity", radial.spline(F.col("l_quantity") / 10.0, COEFFICIENTS, 0.0, 0.5).alias("s")), 8)


@query("""with p as (select l_linenumber zi, l_linenumber+5 zj, r from (select distinct l_linenumber, l_quantity/10.0+0.05 r from lineitem)), x as (select *, r*(power(zi,0.23)+power(zj,0.23))/0.46850 x from p)
  select zi, zj, round(r,4) r, round(14.399645478425668::double*zi*zj/r*(0.18175*exp(-3.19980*x)+0.50986*exp(-0.94229*x)+0.28022*exp(-0.40290*x)+0.02817*exp(-0.20162*x)),6) v from x""")
def screened_pair(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("zi"), (F.col("l_linenumber") + 5).alias("zj"), r().alias("r")).distinct()
    return rows.select("zi", "zj", F.round("r", 4).alias("r"), F.round(radial.screened_pair(F.col("r"), F.col("zi"), F.col("zj")), 6).alias("v"))


@query("""select l_linenumber kp, l_returnflag, round(sum(cos(2*pi()*l_linenumber/7.0*l_suppkey)*l_discount),4)+0.0 re, round(sum(sin(2*pi()*l_linenumber/7.0*l_suppkey)*l_discount),4)+0.0 im from lineitem group by 1,2""")
def bloch_sum(spark, d):
    phase = 2 * np.pi * F.col("l_linenumber") / 7.0 * F.col("l_suppkey")
    return rounded(t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("kp"), "l_returnflag").agg(F.sum(F.cos(phase) * F.col("l_discount")).alias("re"), F.sum(F.sin(phase) * F.col("l_discount")).alias("im")))


@query("select o_orderpriority, round(avg(abs(g)),4) mae, round(sqrt(avg(g*g)),4) rmse, round(max(abs(g)),4) max, count(*) n from (select o_orderpriority, o_totalprice-(o_totalprice*0.99+o_orderkey%7) g from orders) group by 1")
def block_metrics(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("v"))
    return rounded(reports.block_metrics(o, o.withColumn("v", F.col("v") * 0.99 + F.col("o_orderkey") % 7), ["o_orderkey"], by=["o_orderpriority"]))


@query("select event_type, sum(k)::bigint k_sum, count(k) n from (select event_type, json_extract(props,'$.k')::bigint k from events) group by 1")
def json_info(spark, d):
    return t(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("k").alias("n"))


@query("""with r as (select 'q'||(l_linenumber%3) as name, l_suppkey model, avg(l_extendedprice) v from lineitem group by 1,2), u(name,kind,ref,tol) as (values ('q0','abs',35000.0,3000.0),('q1','rel',36000.0,0.1)),
  e as (select model, case kind when 'rel' then abs(v-ref)/abs(ref) else abs(v-ref) end/tol e from r join u using(name))
  select model, round(avg((e<=1)::int),6) share_within, round(sqrt(avg(e^2)),6) rms, round(exp(avg(ln(least(greatest(e,0.05),10)))),6) geomean from e group by 1""")
def rule_tolerance_score(spark, d):
    values = t(spark, d, "lineitem").groupBy(F.concat(F.lit("q"), F.col("l_linenumber") % 3).alias("name"), F.col("l_suppkey").alias("model")).agg(F.avg("l_extendedprice").alias("value"))
    rules = spark.createDataFrame([("q0", "abs", 35000.0, 3000.0), ("q1", "rel", 36000.0, 0.1)], "name string, kind string, ref double, tol double")
    return rounded(reports.tolerance_score(reports.tolerance_errors(values, rules), ["model"]), 6)


@query("""select l_suppkey%5 family, arg_min(p, (c,p)) filter (a<=0.03 and b<=0.05) best, case when count(*) filter (a<=0.03 and b<=0.05)=0 then case when count(*) filter (a<=0.03)=0 then 'a' when count(*) filter (b<=0.05)=0 then 'b' else 'jointly' end end reason
  from (select l_suppkey, l_orderkey*10+l_linenumber p, l_extendedprice c, l_discount a, l_tax b from lineitem) group by 1""")
def min_by_with_reason(spark, d):
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p")
    rows = t(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("family"), key, F.col("l_extendedprice").alias("c"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return reports.cheapest(rows, ["family"], "c", "p", {"a": 0.03, "b": 0.05})


@query("select cost, value from (select *, min(value) over (order by cost, value rows between unbounded preceding and 1 preceding) m from (select p_retailprice cost, p_size*1000+p_partkey as value from part)) where m is null or value<m")
def pareto_front(spark, d):
    rows = t(spark, d, "part").select(F.col("p_retailprice").alias("cost"), (F.col("p_size") * 1000 + F.col("p_partkey")).alias("value"))
    return ordered.pareto_front(rows, "cost", "value")


@query("with k as (select * from lineitem order by l_quantity, l_orderkey*10+l_linenumber limit (select greatest(1,round_even(0.2*count(*),0))::bigint from lineitem)) select round(avg((l_extendedprice>20000)::int),6) contamination, count(*) kept from k")
def contamination_top_k(spark, d):
    rows = t(spark, d, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(reports.contamination(rows, "l_quantity", y() > 20000, "key", 0.2), 6)


@query("with q as (select quantile_cont(l_extendedprice,0.95) e, quantile_cont(l_quantity,0.9) s from lineitem) select round(avg((l_quantity>=s)::int),6) recall from lineitem, q where l_extendedprice>=e")
def recall_top(spark, d):
    return rounded(reports.recall_top(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 0.95, 0.9), 6)


@query("select o_orderpriority, case when count(v)=count(*) then round(avg(v),4) end v_mean, case when count(v)=count(*) then min(v) end v_min, case when count(v)=count(*) then max(v) end v_max from (select o_orderpriority, case when o_orderpriority='5-LOW' and o_orderkey%9=0 then null else o_totalprice end v from orders) group by 1")
def seed_average(spark, d):
    v = F.when(~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 9 == 0)), F.col("o_totalprice"))
    return reports.seed_average(t(spark, d, "orders").select("o_orderpriority", v.alias("v")), ["o_orderpriority"], ["v"]).withColumn("v_mean", F.round("v_mean", 4))


@query("select o_custkey, max(case when o_orderstatus='F' then o_orderkey end) largest_ok, min(case when o_orderstatus<>'F' then o_orderkey end) least_failed from orders group by 1 having max(case when o_orderstatus='F' then 1 end)=1")
def largest_ok_min_fail(spark, d):
    rows = t(spark, d, "orders").withColumn("st", F.when(F.col("o_orderstatus") == "F", "ok").otherwise("oom"))
    return reports.largest_fits(rows, ["o_custkey"], "st", "o_orderkey")


@query("""with s as (select l_returnflag f, l_suppkey k, sum(l_quantity) v from lineitem group by 1,2), j as (select a.k, a.v/b.v ratio from s a join s b on a.k=b.k and a.f='A' and b.f='R') select k, round(ratio,6) ratio from j order by k desc limit 1""")
def ratio_at_common_key(spark, d):
    rows = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return rounded(reports.ratio_at_common_key(rows, "f", "A", "R", "k", "v"), 6)


@query("""with g as (select *, (o_orderstatus='F') ok from orders), r as (select *, sum(ok::int) over (partition by o_custkey) n, row_number() over (partition by o_custkey order by ok desc, case when ok then o_totalprice end, o_orderkey) k from g)
  select o_custkey, o_orderkey, n::bigint runs, (select round(quantile_cont(o_totalprice,0.5),4) from g where g.o_custkey=r.o_custkey and ok) median from r where k=greatest(1,(n+1)//2)""")
def median_run_per_case(spark, d):
    rows = t(spark, d, "orders").withColumn("st", F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error"))
    out = reports.one_per_case(rows, ["o_custkey"], "st", "o_totalprice", "o_orderkey")
    return out.select("o_custkey", "o_orderkey", "runs", F.round("median", 4).alias("median"))


@query("select l_linenumber, l_orderkey from (select *, row_number() over (partition by l_linenumber order by abs(l_extendedprice-40000), l_orderkey) k from lineitem) where k=1")
def nearest_row(spark, d):
    rows = t(spark, d, "lineitem").select("l_linenumber", "l_orderkey", "l_extendedprice")
    return ordered.nearest_row(rows, ["l_linenumber"], F.abs(F.col("l_extendedprice") - 40000), "l_orderkey").select("l_linenumber", "l_orderkey")


@query("select o_orderkey, round(round_even(o_totalprice/power(10,floor(log10(o_totalprice))),2)*power(10,floor(log10(o_totalprice))),6) s from orders where o_totalprice>0")
def sig_round(spark, d):
    return rounded(t(spark, d, "orders").where("o_totalprice > 0").select("o_orderkey", reports.sig_round(F.col("o_totalprice"), 3).alias("s")), 6)


# The relational and streaming categories that come with the engine.


@query("select c_custkey, count(o_orderkey) n, coalesce(round(sum(o_totalprice),2),0.0) total from customer left join orders on c_custkey=o_custkey group by 1")
def left_join(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n", "total"])


@query("select k, a, b from (select n_nationkey k, n_name a from nation where n_nationkey%2=0) full join (select n_nationkey k, n_name b from nation where n_nationkey%3=0) using(k)")
def full_outer_join(spark, d):
    n = t(spark, d, "nation")
    a, b = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a")), n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b"))
    return a.join(b, "k", "full")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey=c_custkey and o_totalprice>300000)")
def semi_join(spark, d):
    big = t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey=c_custkey)")
def anti_join(spark, d):
    return t(spark, d, "customer").select("c_custkey").join(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""select e.event_id, max(p.event_id) filter (p.ts=m) last_purchase from (select e.event_id, e.user_id, e.ts, max(p.ts) m from events e left join events p on p.user_id=e.user_id and p.event_type='purchase' and p.ts<=e.ts where e.event_type='error' group by 1,2,3) e
  left join events p on p.user_id=e.user_id and p.event_type='purchase' and p.ts=e.m group by 1""")
def as_of_join(spark, d):
    """The last purchase of the user at each error: a running last value over one shuffle by user and time."""
    e = t(spark, d, "events").where("event_type in ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).over(w)
    return e.withColumn("last_purchase", last["event_id"]).where("event_type = 'error'").select("event_id", "last_purchase")


@query("select coalesce(l_returnflag,'*') f, coalesce(l_linestatus,'*') s, count(*) n, round(sum(l_quantity),2) q from lineitem group by cube(l_returnflag, l_linestatus)")
def cube(spark, d):
    out = t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))
    return out.select(F.coalesce("l_returnflag", F.lit("*")).alias("f"), F.coalesce("l_linestatus", F.lit("*")).alias("s"), "n", "q")


@query("(select c_nationkey k from customer intersect select s_nationkey from supplier) union all (select n_nationkey+100 from nation except select s_nationkey+100 from supplier)")
def set_operations(spark, d):
    c, s, n = (t(spark, d, x).select(F.col(k).alias("k")) for x, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.intersect(s).union(n.select((F.col("k") + 100).alias("k")).subtract(s.select((F.col("k") + 100).alias("k"))))


@query("select o_orderkey, round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and 2 following),4) smooth from orders")
def window_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 2)
    return t(spark, d, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(w), 4).alias("smooth"))


@query("select floor(epoch(ts))::bigint//3600*3600 w, event_type, count(*) n, round(sum(value),2) v from events group by 1,2")
def tumbling_window(spark, d):
    w = F.window("ts", "1 hour")
    out = t(spark, d, "events").groupBy(w.alias("win"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return out.select(F.unix_timestamp("win.start").alias("w"), "event_type", "n", "v")


@query("select ((floor(epoch(ts))::bigint//1800)-k)*1800 w, count(*) n from events, (values (0),(1)) s(k) group by 1")
def sliding_window(spark, d):
    out = t(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("win")).agg(F.count("*").alias("n"))
    return out.select(F.unix_timestamp("win.start").alias("w"), "n")


@query("""with g as (select *, case when ts-lag(ts) over (partition by user_id order by ts)<interval 1 hour then 0 else 1 end s from events), x as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) k from g)
  select user_id, floor(epoch(min(ts)))::bigint w, count(*) n from x group by user_id, k""")
def session_windows(spark, d):
    out = t(spark, d, "events").groupBy("user_id", F.session_window("ts", "1 hour").alias("win")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_timestamp("win.start").alias("w"), "n")


@query()
def approximate_distinct(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median"))


from tephra.plans import models, results  # noqa: E402, F401
