"""Queries over result rows. Line items stand for runs: status a host, flag a code, number a mode, quantity a size, price a measure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tephra.operators import neighbours, results
from tephra.plans.registry import query, rounded, t


@query("""select c_custkey, case when c_custkey%3=0 then null else 'N'||c_nationkey end as "system", case when c_custkey%3=0 then null when c_custkey%5=0 then 'given' else 's'||c_custkey%4 end size from customer""")
def model_parts(spark, d):
    path = F.concat_ws("/", "c_mktsegment", F.concat(F.lit("N"), "c_nationkey"), F.concat(F.lit("s"), F.col("c_custkey") % 4))
    given = F.when((F.col("c_custkey") % 5 == 0) & (F.col("c_custkey") % 3 != 0), "given")
    rows = t(spark, d, "customer").withColumn("model", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(path)).withColumn("size", given)
    return results.with_parts(rows, "model", ["", "system", "size"]).select("c_custkey", "system", "size")


@query("""select case when l_linenumber<=4 then '{"host":"'||l_linestatus||'","key":'||l_linenumber||'}' else '{"c0":"'||l_returnflag||'","c1":'||case when l_suppkey%3=0 then 'null' else (l_suppkey%3)::varchar end||'}' end as case_id, count(*) n from lineitem group by 1""")
def case_key(spark, d):
    key = F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber"))
    other = F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 3)
    return t(spark, d, "lineitem").groupBy(results.case_key(key, F.col("l_linestatus"), [F.col("l_returnflag"), other]).alias("case_id")).agg(F.count("*").alias("n"))


@query("""select l_linestatus, l_returnflag, l_quantity, k from (select *, l_orderkey*10+l_linenumber k, row_number() over (partition by l_linestatus, l_returnflag order by abs(l_quantity-25.2), l_orderkey*10+l_linenumber) r from lineitem) where r=1""")
def fixed_size_table(spark, d):
    rows = t(spark, d, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return results.at_fixed_size(rows, ["l_linestatus", "l_returnflag"], "l_quantity", F.lit(25.2), "k")


@query("""with r as (select l_suppkey host, case when l_suppkey%2=0 and l_linenumber<=3 then case l_linenumber when 1 then 'parity_ok' when 2 then 'parity_fail' else 'error' end else 'ok' end st, case when l_tax<0.02 then null else l_discount-0.05 end gap from lineitem),
  g as (select host, sum((st='parity_ok')::int)::bigint passed, count(*) run, sum((st='error')::int)::bigint errors, round(max(abs(coalesce(gap,0))) filter (st<>'error'),6) gap from r where st<>'ok' group by 1)
  select * from g union all select distinct host, null::bigint, null::bigint, null::bigint, null::double from r where st='ok' and host not in (select host from g)""")
def parity_table(spark, d):
    status = F.when((F.col("l_suppkey") % 2 == 0) & (F.col("l_linenumber") <= 3), F.when(F.col("l_linenumber") == 1, "parity_ok").when(F.col("l_linenumber") == 2, "parity_fail").otherwise("error")).otherwise("ok")
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("host"), status.alias("st"), F.when(F.col("l_tax") >= 0.02, F.col("l_discount") - 0.05).alias("gap"))
    return rounded(results.parity_table(rows, ["host"], "st", ["gap"], rows.where("st = 'ok'")), 6)


@query("""select o_orderpriority, count(*) filter (o_orderstatus='F') f, count(*) filter (o_orderstatus='O') o, round(count(*) filter (o_orderstatus='F')/count(*) filter (o_orderstatus='O'),6) ratio from orders group by 1""")
def basis_ratio(spark, d):
    counts = t(spark, d, "orders").groupBy("o_orderpriority", F.lower("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    return rounded(results.pivot_ratio(counts, ["o_orderpriority"], "s", "n", "f", "o"), 6)


@query("""with m as (select distinct l_linenumber k from lineitem where l_linestatus='O' and l_returnflag<>'R' and l_linenumber<=5),
  s as (select 'after' phase, l_linenumber k, l_quantity q from lineitem where l_linestatus='O' and l_returnflag<>'R' and l_linenumber<=5
    union all select 'before', l_linenumber, l_quantity from lineitem where l_linestatus='F' and l_returnflag<>'R' and l_linenumber in (select k from m)
    union all select 'reference', m.k, l_quantity from lineitem, m where l_linestatus='O' and l_returnflag='R' and l_linenumber=6)
  select phase, k, count(*) n, round(sum(q),2) q from s group by 1,2""")
def phase_series(spark, d):
    rows = t(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_linenumber").alias("k"), "l_quantity")
    after, before = rows.where("l_linestatus = 'O'").withColumn("line", F.col("k")), rows.where("l_linestatus = 'F'").withColumn("line", F.col("k"))
    own = (F.col("l_returnflag") != "R") & ((F.col("l_linestatus") == "F") | (F.col("line") <= 5))
    found = results.phases(after, before, own, (F.col("l_returnflag") == "R") & (F.col("line") == 6), "k")
    return rounded(found.groupBy("phase", "k").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")), 2)


@query("""with c(code,mode,dtype) as (values (0,'a','f32'),(0,'a','f64'),(0,'b','f64'),(1,'a','f64')),
  x as (select c.*, unnest(range(1,p_size%4+2))*8 n_atoms from part join c on p_size%3=code where not (mode='b' and p_size>25))
  select code::varchar code, mode, dtype, count(*) n, sum(n_atoms)::bigint atoms from x group by 1,2,3""")
def parameter_cases(spark, d):
    models = t(spark, d, "part").select("p_size", (F.col("p_size") % 3).cast("string").alias("code"))
    ladder = F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), lambda i: i * 8)
    choices = {"0": [("a", ["f32", "f64"]), ("b", ["f64"])], "1": [("a", ["f64"])]}
    found = results.parameter_cases(models, choices, "code", ladder, (F.col("mode") == "b") & (F.col("p_size") > 25))
    return found.groupBy("code", "mode", "dtype").agg(F.count("*").alias("n"), F.sum("n_atoms").alias("atoms"))


@query("""with r as (select l_suppkey code, case when l_tax<=0.075 then 'parity_ok' when l_linenumber=1 then 'error' when l_linenumber=2 then 'parity_fail' else 'parity_ok' end st, case l_partkey%4 when 0 then 'alone' when 1 then 'spline' when 2 then null else 'pair' end gate from lineitem)
  select code, 'embedded' as mode from r where st<>'parity_ok' and gate is distinct from 'alone' union select code, 'standalone' from r where st<>'parity_ok' and gate in ('alone','spline')""")
def blocked_lines(spark, d):
    status = F.when(F.col("l_tax") <= 0.075, "parity_ok").when(F.col("l_linenumber") == 1, "error").when(F.col("l_linenumber") == 2, "parity_fail").otherwise("parity_ok")
    gate = F.element_at(F.array(F.lit("alone"), F.lit("spline"), F.lit(None), F.lit("pair")), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("code"), status.alias("st"), gate.alias("gate"))
    return results.blocked(rows, "code", "st", "gate", "alone", ["alone", "spline"])


@query("""with c(k,kind,target) as (values ('A','least',30000.0),('N','most',30000.0),('R','least',100.0),('X','least',1.0)),
  a as (select l_returnflag k, avg(l_extendedprice) v from lineitem where l_linestatus='O' group by 1), b as (select l_returnflag k, avg(l_extendedprice) v from lineitem where l_linestatus='F' and l_returnflag<>'R' group by 1)
  select c.k, kind, target, round(b.v,4) "before", round(a.v,4) "after", case kind when 'most' then a.v<=target else a.v>=target end met from c join a on a.k=c.k left join b on b.k=c.k""")
def criteria_table(spark, d):
    targets = spark.createDataFrame([("A", "least", 30000.0), ("N", "most", 30000.0), ("R", "least", 100.0), ("X", "least", 1.0)], "k string, kind string, target double")
    means = t(spark, d, "lineitem").groupBy("l_linestatus", F.col("l_returnflag").alias("k")).agg(F.avg("l_extendedprice").alias("v"))
    return rounded(results.criteria(targets, means.where("l_linestatus = 'F' and k <> 'R'"), means.where("l_linestatus = 'O'"), "k", "v"))


@query(f"""with h as (select l_linestatus part, sha256(l_orderkey||'|'||l_linenumber||'|'||l_returnflag) x from lineitem) select part, count(*) n, {", ".join(f"sum(('0x'||substr(x,{15 * i + 1},15))::bigint)::varchar s{i}" for i in range(4))} from h group by 1""")
def split_digest(spark, d):
    text = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag")
    found = t(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("part")).agg(*results.digest_sums(text))
    return found.select("part", "n", *[F.col(f"s{i}").cast("string").alias(f"s{i}") for i in range(4)])


@query("""with c as (select l_returnflag f, l_linenumber k, l_quantity x, round(avg(l_extendedprice),4) y from lineitem group by 1,2,3), m as (select f, k, arg_min(x,(y,x)) x0, min(y) y0 from c group by 1,2)
  select f, k, x0, y0, round(1000*(y0-(select y0 from m where f='A' and k=1)),2) excess from m""")
def curve_minima(spark, d):
    curve = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("x")).agg(F.round(F.avg("l_extendedprice"), 4).alias("y"))
    found = results.curve_minima(curve, ["f", "k"], "x", "y", {"f": "A", "k": 1})
    return found.withColumn("excess", F.round("excess", 2) + F.lit(0.0))


@query("""select 'c'||p_size base, case when p_partkey%3=0 then null else p_partkey%3 end::int seed, count(*) n from part group by 1,2""")
def seed_split(spark, d):
    name = F.concat(F.lit("c"), "p_size", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("_s"), F.col("p_partkey") % 3)))
    base, seed = results.seed_parts(F.col("name"))
    return t(spark, d, "part").select(name.alias("name")).select(base.alias("base"), seed.alias("seed")).groupBy("base", "seed").agg(F.count("*").alias("n"))


@query("""select case when p_type='PROMO' and p_size<10 then 'promo_small' when p_type='PROMO' then 'promo_'||p_size%3 when p_name like '%widget' then 'widget' else lower(p_type) end family, count(*) n from part group by 1""")
def family_of(spark, d):
    promo = F.col("p_type") == "PROMO"
    rules = [(promo & (F.col("p_size") < 10), "promo_small"), (promo, F.concat(F.lit("promo_"), F.col("p_size") % 3)), (F.col("p_name").endswith("widget"), "widget")]
    return t(spark, d, "part").groupBy(results.family(rules, F.lower("p_type")).alias("family")).agg(F.count("*").alias("n"))


@query("""select p_type family, count(*) n, sum(p_size)::bigint size from (select p_type, p_size from part union all select 'ALIAS', p_size from part where p_type='PROMO' union all select p_type||'_l', p_size from part where p_size>40) group by 1""")
def aliased_rows(spark, d):
    rows = results.with_aliases(t(spark, d, "part").select("p_type", "p_size"), "p_type", [("ALIAS", F.col("p_type") == "PROMO"), (F.concat("p_type", F.lit("_l")), F.col("p_size") > 40)])
    return rows.groupBy(F.col("p_type").alias("family")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("""select 1::bigint as rank, 0::bigint block, 'first' family, 'given' as label, 'm0' model union all
  select row_number() over (partition by p_type order by p_size, p_name||p_partkey), case p_type when 'PROMO' then 1 else 2 end, p_type, p_size::varchar, p_name||p_partkey from part where p_type in ('PROMO','ECONOMY')""")
def model_ladder(spark, d):
    return results.ordered_models(t(spark, d, "part"), ["PROMO", "ECONOMY"], "p_type", F.col("p_size"), F.concat("p_name", "p_partkey"), ("first", "given", "m0"))


@query("""with r as (select l_partkey%100 as name, l_linestatus f, l_returnflag code, 1e6/l_extendedprice c, case when l_discount>0.08 then 'oom' else 'ok' end st, l_linenumber%2=0 gated from lineitem),
  g as (select distinct l_linestatus f, l_returnflag code from lineitem where l_linenumber=7 and l_tax<=0.04 and l_returnflag<>'N'),
  ok as (select * from r where st='ok' and (not gated or exists (select 1 from g where g.f=r.f and g.code=r.code))),
  p as (select name, min(case when f='F' then 1 end) one from ok where name<50 group by 1), kept as (select ok.* from ok left join p using(name) where one is null or f='F')
  select name, round(min(c),6) "cost", arg_min(f,(c,f)) file from kept group by 1""")
def cheapest_runs(spark, d):
    line = t(spark, d, "lineitem")
    rows = line.select((F.col("l_partkey") % 100).alias("name"), F.when((F.col("l_partkey") % 100 < 50) | (F.col("l_linestatus") == "O"), F.col("l_linestatus")).otherwise(F.lit("F2")).alias("file0"), F.col("l_linestatus").alias("file"), F.col("l_returnflag").alias("code"), "l_extendedprice", F.when(F.col("l_discount") > 0.08, "oom").otherwise("ok").alias("status"), (F.col("l_linenumber") % 2 == 0).alias("gated"))
    gates = line.where("l_linenumber = 7 and l_returnflag <> 'N'").select(F.col("l_linestatus").alias("file"), F.col("l_returnflag").alias("code"), F.when(F.col("l_tax") <= 0.04, "parity_ok").otherwise("parity_fail").alias("status"))
    options = {"name": "name", "cost": 1e6 / F.col("l_extendedprice"), "file": "file", "line": ["code"], "needs_gate": F.col("gated")}
    low = results.cheapest_runs(rows.where("name < 50"), gates, preferred=["F"], **options)
    return rounded(low.unionByName(results.cheapest_runs(rows.where("name >= 50"), gates, **options)), 6)


@query("""with b as (select l_returnflag f, avg(l_tax) filter (l_linenumber=1) b1, avg(l_tax) filter (l_linenumber=2) b2, avg(l_tax) filter (l_linenumber=4) b4 from lineitem group by 1), l as (select l_returnflag f, avg(l_tax) lp from lineitem where l_linenumber=7 group by 1)
  select f, round(b1,6) b1, round(b2,6) b2, round(b4,6) b4, round(lp,6) as loop, round(lp/least(b1,b2,b4),6) best from b left join l using(f)""")
def batch_speedups(spark, d):
    means = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), "l_linenumber").agg(F.avg("l_tax").alias("v"))
    return rounded(results.speedups(means.where("l_linenumber = 7"), means.where("l_linenumber <> 7"), ["f"], "l_linenumber", "v", [1, 2, 4]), 6)


@query("""select l_returnflag, count(*) n, round(1000*sqrt(avg(e*e)),4) rms, round(1000*avg(abs(e)),4) mae from (select l_returnflag, (l_quantity*0.0015-l_extendedprice/1e6)/greatest(l_linenumber,1) e from lineitem where l_tax-0.01>0) group by 1""")
def live_errors(spark, d):
    found = results.live_errors(t(spark, d, "lineitem"), F.col("l_extendedprice") / 1e6, F.col("l_quantity") * 0.0015, F.col("l_tax") - 0.01, F.col("l_linenumber"))
    return rounded(found.groupBy("l_returnflag").agg(F.count("*").alias("n"), (1000 * F.sqrt(F.avg(F.col("error") * F.col("error")))).alias("rms"), (1000 * F.avg(F.abs("error"))).alias("mae")))


@query("""with x as (select l_returnflag z, l_linestatus s, l_quantity/50 a, l_discount*10 b from lineitem), g as (select z, sum(a*a) p, sum(a*b) q, sum(b*b) r from x where s='F' and z<>'R' group by 1),
  i as (select z, p+0.01*(p+r)/2 p, q, r+0.01*(p+r)/2 r from g) select x.z, count(*) n, round(sum((a*a*r-2*a*b*q+b*b*p)/(p*r-q*q)),6) total, round(max((a*a*r-2*a*b*q+b*b*p)/(p*r-q*q)),8) most from x left join i on i.z=x.z group by 1""")
def leverage_by_group(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("z"), F.col("l_linestatus").alias("s"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"))
    found = results.leverage_by_group(x.where("s = 'F' and z <> 'R'"), x, "z", ["a", "b"], 0.01)
    return found.groupBy("z").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"), F.round(F.max("score"), 8).alias("most"))


@query("""with x as (select l_returnflag, sqrt(4*power(l_quantity/50-0.2,2)+9*power(l_tax*10-0.3,2)) s1, sqrt(16*power(l_quantity/50-0.8,2)+2*0.5*(l_quantity/50-0.8)*(l_tax*10-0.5)+power(l_tax*10-0.5,2)) s2 from lineitem)
  select l_returnflag, round(avg(case when s1<=s2 then s1/1.5 else s2/0.7 end),6) mean, round(max(case when s1<=s2 then s1/1.5 else s2/0.7 end),6) most from x group by 1""")
def cluster_grade(spark, d):
    clusters = [((0.2, 0.3), ((4.0, 0.0), (0.0, 9.0)), 1.5), ((0.8, 0.5), ((16.0, 0.5), (0.5, 1.0)), 0.7)]
    grade = results.cluster_grade(clusters, [F.col("l_quantity") / 50, F.col("l_tax") * 10])
    return rounded(t(spark, d, "lineitem").select("l_returnflag", grade.alias("g")).groupBy("l_returnflag").agg(F.avg("g").alias("mean"), F.max("g").alias("most")), 6)


@query("""with e as (select quantile_cont(l_quantity,[0.2,0.4,0.6,0.8]) e from lineitem), b as (select len(list_filter(e, lambda v: v<=l_quantity)) b, l_extendedprice g, (l_tax<=0.04)::int h from lineitem, e),
  m as (select b, quantile_cont(g,0.5) med, count(*) n from b group by 1), r as (select b.b, n, avg(h) filter (g>=med)-avg(h) filter (g<med) gap from b join m using(b) group by 1,2)
  select round(sum(n*gap)/sum(n),6) split from r where n>=20 and gap is not null""")
def conditional_split(spark, d):
    rows = t(spark, d, "lineitem").select("l_extendedprice", "l_quantity", (F.col("l_tax") <= 0.04).alias("hit"))
    return rounded(results.conditional_split(rows, "hit", "l_extendedprice", "l_quantity"), 6)


@query("""with c as (select l_orderkey, sum(case when l_linenumber<=5 then (l_tax<=0.04)::int else 0 end) hits, sum((l_linenumber<=5)::int) n from lineitem group by 1)
  select round(sum(hits)/sum(n),6) as atom, round(avg(hits/n),6) cell, count(*) cells from c where n>0""")
def cell_coverage(spark, d):
    cells = results.cell_stats(t(spark, d, "lineitem"), "l_orderkey", F.col("l_tax") <= 0.04, F.col("l_linenumber") <= 5)
    return rounded(results.coverage_of_cells(cells), 6)


@query("""with p as (select a.s_suppkey i, b.s_suppkey j, abs(a.s_acctbal-b.s_acctbal) dist from supplier a join supplier b on a.s_suppkey<b.s_suppkey and abs(a.s_acctbal-b.s_acctbal)<400.0),
  e as (select s_suppkey k, s_nationkey/25.0-0.5 x, (s_suppkey%7)/7.0-0.4 y from supplier), m as (select avg(x*x+y*y) m from e),
  q as (select floor(dist/100)::int bin, a.x*b.x+a.y*b.y s, (a.x*0.6+a.y*0.8)*(b.x*0.6+b.y*0.8) l from p join e a on a.k=i join e b on b.k=j)
  select bin, count(*) n, round(avg(s)/any_value(m),6) c, round(avg(l)/(any_value(m)/3),6) longitudinal, round((3*avg(s)/any_value(m)-avg(l)/(any_value(m)/3))/2,6) transverse from q, m group by 1""")
def binned_correlation(spark, d):
    points = t(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") / 25.0 - 0.5).alias("x"), ((F.col("s_suppkey") % 7) / 7.0 - 0.4).alias("y"))
    mean = points.agg(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).first()[0]
    pairs = results.closest_pairs(neighbours.edges(points, ["s_acctbal"], 400.0, "s_suppkey"), "l_s_suppkey", "r_s_suppkey", "dist").withColumn("u", F.lit(0.6)).withColumn("v", F.lit(0.8))
    return rounded(results.binned_correlation(pairs, "dist", [0.0, 100.0, 200.0, 300.0, 400.0], ["l_x", "l_y"], ["r_x", "r_y"], ["u", "v"], mean), 6)
