"""Queries of radial families, harmonics, structures and fits. Line items give distances, suppliers atoms, nations structures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.functions import angular, families
from tephra.operators import monomials, neighbours, sites, structures
from tephra.plans import fit
from tephra.plans import sql as front
from tephra.plans.registry import query, rounded, t
from tephra.session import written

R_SQL = "(select distinct l_quantity, l_quantity/10.0+0.05 r from lineitem)"


def distances(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").select("l_quantity", (F.col("l_quantity") / 10.0 + 0.05).alias("r")).distinct()


def listed(frame: DataFrame, values: list[Column], digits: int = 8) -> DataFrame:
    return rounded(frame.select("l_quantity", *[v.cast("double").alias(f"g{i}") for i, v in enumerate(values)]), digits)


def _cheb_sql(x: str, n: int) -> list[str]:
    """T1 .. Tn written out."""
    return [f"cos({k}*acos(greatest(least({x},1.0),-1.0)))" for k in range(1, n + 1)]


@query(f"""with x as (select *, 1-2*(exp(5.25*(1-r/6.0))-1)/(exp(5.25)-1) x, (1+cos(pi()*r/6.0))/2*case when r>4.0 then (1+cos(pi()*(r-4.0)/2.0))/2 else 1 end e from {R_SQL})
  select l_quantity, round(e,8)+0.0 g0, {", ".join(f"round((1-{c})/2*e,8)+0.0 g{k}" for k, c in enumerate(_cheb_sql("x", 3), 1))} from x""")
def chebyshev_exp_cos(spark, d):
    return listed(distances(spark, d), families.chebyshev_exp_cos(F.col("r"), 5.25, 6.0, 2.0, 4))


@query(f"""select l_quantity, {", ".join(f"round((1-{c})/2,8)+0.0 g{k}" for k, c in enumerate(_cheb_sql("1-2*power(1-r/6.0,2)", 4)))} from {R_SQL}""")
def chebyshev_power(spark, d):
    return listed(distances(spark, d), families.chebyshev_power(F.col("r"), 2.0, 6.0, 4))


@query(f"""select l_quantity, {", ".join(f"round((1-{c})/2,8)+0.0 g{k}" for k, c in enumerate(_cheb_sql("1-r/6.0", 4)))} from {R_SQL}""")
def chebyshev_linear(spark, d):
    return listed(distances(spark, d), families.chebyshev_linear(F.col("r"), 6.0, 4))


def _bessel_sql() -> str:
    f = [f"{(-1) ** n * math.sqrt(2) * math.pi * (n + 1) * (n + 2) / math.hypot(n + 1, n + 2) / 6**1.5!r}::double*(sin({n + 1}*x)/({n + 1}*x)+sin({n + 2}*x)/({n + 2}*x))" for n in range(3)]
    e1, e2 = 9 / 65, 64 / 325
    d1 = 1 - e1
    d2 = 1 - e2 / d1
    return f"with x as (select *, pi()*r/6.0 x from {R_SQL}), a as (select *, {f[0]} g0, {f[1]} f1, {f[2]} f2 from x), b as (select *, (f1+{math.sqrt(e1)!r}::double*g0)/{math.sqrt(d1)!r}::double g1 from a) select l_quantity, round(g0,8)+0.0 g0, round(g1,8)+0.0 g1, round((f2+{math.sqrt(e2 / d1)!r}::double*g1)/{math.sqrt(d2)!r}::double,8)+0.0 g2 from b"


@query(_bessel_sql())
def spherical_bessel(spark, d):
    return listed(distances(spark, d), families.bessel(F.col("r"), 6.0, 3))


HERMITE = [math.exp(-0.4 * i) for i in range(9)]


@query(f"""with c as (select {HERMITE!r}::double[] f, {[-0.8 * v for v in HERMITE]!r}::double[] d), x as (select *, least(greatest(floor(r/0.5),0),7)::int i from {R_SQL}), u as (select *, r/0.5-i u from x)
  select l_quantity, round((1+2*u)*power(1-u,2)*f[i+1]+u*power(1-u,2)*0.5*d[i+1]+u*u*(3-2*u)*f[i+2]+u*u*(u-1)*0.5*d[i+2],8)+0.0 g0 from u, c""")
def hermite_table(spark, d):
    values, slopes = (F.array(*[F.lit(v) for v in x]) for x in (HERMITE, [-0.8 * v for v in HERMITE]))
    return listed(distances(spark, d), [families.hermite(F.col("r"), values, slopes, F.lit(0.5))])


@query(f"""select l_quantity, case when r<4.0 then round(3.5*exp(-0.3*r*r)/r*(1+cos(pi()*r/4.0))/2,8) else 0.0 end g0,
  case when r<4.0 then round(3.5*exp(-0.3*r*r)/r*(1+cos(pi()*r/4.0))/2*(10*power(u,3)-15*power(u,4)+6*power(u,5)),8)+0.0 else 0.0 end g1 from (select *, least(greatest((3.0-r)/1.5,0),1) u from {R_SQL})""")
def core_repulsion(spark, d):
    return listed(distances(spark, d), [families.core_repulsion(F.col("r"), -3.5, 0.3, 4.0), families.core_repulsion(F.col("r"), 3.5, 0.3, 4.0, 3.0, 1.5, "distance")])


def _zbl_sql() -> str:
    a = 0.46850 / (14**0.23 + 32**0.23)
    phi = "+".join(f"{w}*exp(-{q / a!r}::double*r)" for w, q in families.SCREEN)
    e, d1, d2 = families.screened_derivatives(3.0, a)
    cubic, quartic, shift = (1.5 * d2 - 3 * d1) / 2.25, (2 * d1 - 1.5 * d2) / 3.375, 0.75 * d1 - e - 2.25 * d2 / 12
    return f"""select l_quantity, case when r<3.0 then round({14.399645351950543 / 2 * 14 * 32!r}::double*(({phi})/r+power(o,3)*({cubic / 3!r}::double+{quartic / 4!r}::double*o)+{shift!r}::double)*(10*power(u,3)-15*power(u,4)+6*power(u,5)),6)+0.0 else 0.0 end g0
      from (select *, greatest(r-1.5,0) o, least(greatest((3.0-r)/1.5,0),1) u from {R_SQL})"""


@query(_zbl_sql())
def nuclear_core(spark, d):
    return listed(distances(spark, d), [families.nuclear_core(F.col("r"), 14.0, 32.0, 3.0, 1.5)], 6)


@query(f"""select l_quantity, {", ".join(f"round(case when r>0.5 and r<5.0 then (1-{c})/2*(1-(10*power(u,3)-15*power(u,4)+6*power(u,5))) else 0 end,8)+0.0 g{k}" for k, c in enumerate(_cheb_sql("1-r/5.0", 2)))} from (select *, least(greatest((1.0-r)/0.5,0),1) u from {R_SQL})""")
def radial_inside(spark, d):
    cut = families.inside(F.col("r"), families.chebyshev_linear(F.col("r"), 5.0, 2), 1.0, 0.5, 5.0, "distance")
    return listed(distances(spark, d), [cut[0], cut[1]])


@query("select l_quantity, l_discount, round(any_value(u*power(u*u+1e-6,-0.25)),8)+0.0 w from (select l_quantity, l_discount, l_quantity/25.0-1+l_discount u from lineitem) group by 1,2")
def root_warp(spark, d):
    rows = t(spark, d, "lineitem").select("l_quantity", "l_discount").distinct()
    return rounded(rows.select("l_quantity", "l_discount", families.root_warp(F.col("l_quantity") / 25.0 - 1 + F.col("l_discount")).alias("w")), 8)


@query("""with p as (select distinct l_quantity/25.0-1 x, l_discount*10-0.5 y, l_tax*10-0.4 z from lineitem) select round(x,6)+0.0 x, round(y,6)+0.0 y, round(z,6)+0.0 z, round(0.5*sqrt(3/pi())*y,8)+0.0 s1, round(0.5*sqrt(3/pi())*z,8)+0.0 s2, round(0.5*sqrt(15/pi())*x*y,8)+0.0 s4,
  round(0.25*sqrt(5/pi())*(2*z*z-x*x-y*y),8)+0.0 s6, round(0.25*sqrt(15/pi())*(x*x-y*y),8)+0.0 s8, round(0.25*sqrt(7/pi())*z*(2*z*z-3*x*x-3*y*y),8)+0.0 s12 from p""")
def solid_harmonics(spark, d):
    p = t(spark, d, "lineitem").select((F.col("l_quantity") / 25.0 - 1).alias("x"), (F.col("l_discount") * 10 - 0.5).alias("y"), (F.col("l_tax") * 10 - 0.4).alias("z")).distinct()
    s = angular.solid_harmonics(F.col("x"), F.col("y"), F.col("z"), 3)
    out = p.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in "xyz"], *[(F.round(s[i], 8) + F.lit(0.0)).alias(f"s{i}") for i in (1, 2, 4, 6, 8, 12)])
    return out


# structures


def atoms(spark, d) -> DataFrame:
    """Suppliers as atoms of their nation's structure."""
    s = t(spark, d, "supplier")
    return s.select(F.col("s_nationkey").alias("cfg"), F.col("s_suppkey").cast("int").alias("atom"), (F.col("s_suppkey") % 2).cast("int").alias("species"), (F.col("s_acctbal") / 2500.0).alias("x"), ((F.col("s_suppkey") * 37) % 101 / 20.0).alias("y"), ((F.col("s_suppkey") * 61) % 97 / 20.0).alias("z"))


ATOMS_SQL = "(select s_nationkey cfg, s_suppkey::int as atom, (s_suppkey%2)::int species, s_acctbal/2500.0 x, (s_suppkey*37)%101/20.0 y, (s_suppkey*61)%97/20.0 z from supplier)"
PAIRS_SQL = f"(select a.cfg, a.atom i, b.atom j, a.species zi, b.species zj, b.x-a.x dx, b.y-a.y dy, b.z-a.z dz, sqrt(power(b.x-a.x,2)+power(b.y-a.y,2)+power(b.z-a.z,2)) dist from {ATOMS_SQL} a join {ATOMS_SQL} b on a.cfg=b.cfg and a.atom<>b.atom)"


def cells(spark, d) -> DataFrame:
    box = F.array(*[F.array(*[F.lit(60.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])
    return t(spark, d, "supplier").select(F.col("s_nationkey").alias("cfg")).distinct().select("cfg", box.alias("a"), F.array(*[F.lit(False)] * 3).alias("pbc"))


def edges(spark, d, cutoff: float) -> DataFrame:
    return neighbours.periodic_edges(atoms(spark, d), cells(spark, d), cutoff)


@query(f"select cfg, i, j, row_number() over (partition by cfg order by i, j)-1 bond, (select count(*) from {PAIRS_SQL} q where q.cfg=p.cfg and q.dist<3.0 and (q.i<p.j or (q.i=p.j and q.j<p.i))) as reverse from {PAIRS_SQL} p where dist<3.0")
def bond_graph(spark, d):
    return structures.bonds(edges(spark, d, 3.0)).select("cfg", "i", "j", "bond", "reverse")


@query(f"select cfg, i, count(*) n, round(sum(zj),0)::bigint species, round(max(dist),4) far from {PAIRS_SQL} where dist<3.5 group by 1,2")
def environment_lists(spark, d):
    found = structures.environments(edges(spark, d, 4.0), atoms(spark, d), 3.5)
    return found.select("cfg", "i", F.col("count").cast("long").alias("n"), F.aggregate("slots", F.lit(0).cast("long"), lambda s, e: s + e["species"]).alias("species"), F.round(F.array_max(F.transform("slots", lambda e: e["dist"])), 4).alias("far"))


@query(f"select cfg, i, zi, zj, count(*) n, round(sum(dx),4)+0.0 dx from {PAIRS_SQL} where dist<3.0 group by 1,2,3,4")
def site_graph(spark, d):
    found = structures.site_edges(edges(spark, d, 4.0), atoms(spark, d), 3.0)
    return found.groupBy("cfg", "i", "zi", "zj").agg(F.count("*").alias("n"), (F.round(F.sum("dx"), 4) + F.lit(0.0)).alias("dx"))


@query(f"with s as (select *, row_number() over (partition by cfg, i order by j)-1 slot from {PAIRS_SQL} where dist<4.0), k as (select *, row_number() over (partition by cfg, i order by slot)-1 r, count(*) over (partition by cfg, i) c from s where dist<3.0) select cfg, i, j, r slot, c as \"count\" from k where r<2")
def shorter_list(spark, d):
    dense = structures.dense_list(edges(spark, d, 4.0), ["j", "dist"], ["j"])
    cut = structures.shorter(dense, 3.0, 2).where(F.col("count") > 0)
    return cut.select("cfg", "i", F.posexplode("slots").alias("slot", "_e"), F.col("count").cast("long").alias("count")).select("cfg", "i", "_e.j", F.col("slot").cast("long").alias("slot"), "count")


@query(f"select cfg, round(40.0-(max(z)-min(z)),6) gap from {ATOMS_SQL} group by 1")
def vacuum_gap(spark, d):
    tall = cells(spark, d).withColumn("a", F.array(F.col("a")[0], F.col("a")[1], F.array(F.lit(0.0), F.lit(0.0), F.lit(40.0))))
    return rounded(structures.vacuum_gap(atoms(spark, d).withColumnRenamed("z", "pz"), tall), 6)


@query("select k, round(1/(s+1e-6*max(s) over ()+1e-12),4) scale from (select k, stddev_pop(v::double) s from (select unnest(embedding) v, generate_subscripts(embedding,1)-1 k from embeddings) group by 1)")
def descriptor_scale(spark, d):
    e = t(spark, d, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return structures.descriptor_scale(e, "v").select(F.col("k").cast("long").alias("k"), F.round("scale", 4).alias("scale"))


@query("""with b as (select doc_id, n_chars, case when n<=8 then power(2,ceil(log2(n))) when n<=128 then ceil(n/8.0)*8 else (select min(ceil(ceil(128*power(2,k/4.0))/8.0)*8) from range(1,81) r(k) where ceil(ceil(128*power(2,k/4.0))/8.0)*8>=n) end::bigint bucket from (select doc_id, n_chars, n_chars//16+1 n from documents)),
  i as (select *, row_number() over (partition by bucket order by doc_id)-1 i, count(*) over (partition by bucket) c from b), w as (select *, least(power(2,floor(log2(greatest(floor(512/bucket),1)))), power(2,ceil(log2(c))))::bigint w from i)
  select doc_id, bucket, (i//w)::bigint batch, (i%w)::int slot, least(w, power(2,ceil(log2(c-(i//w)*w))))::bigint width from w""")
def size_batches(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.expr("n_chars div 16 + 1").alias("n"))
    return structures.packed(docs, "n", "doc_id", 512).select("doc_id", "bucket", "batch", "slot", "width")


@query("select z, row_number() over (order by z)-1 species from (select distinct n_regionkey z from nation union select distinct s_nationkey from supplier)")
def species_table(spark, d):
    return structures.species_table([t(spark, d, "nation").select(F.col("n_regionkey").alias("z")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("z"))])


@query("""with p(a,b) as (values (14,14),(14,32),(32,32)), g as (select a zi, b zj, k, 0.5+k*0.25 r from p, range(0,15) x(k)), u as (select *, least(greatest((r-1.0)/2.0,0),1) u, r*(power(zi,0.23)+power(zj,0.23))/0.46850 s from g)
  select zi, zj, k, round(r,4) r, round(14.399645478425668::double*zi*zj/r*(0.18175*exp(-3.19980*s)+0.50986*exp(-0.94229*s)+0.28022*exp(-0.40290*s)+0.02817*exp(-0.20162*s))*(1-(6*power(u,5)-15*power(u,4)+10*power(u,3))),6)+0.0 v from u""")
def pair_table(spark, d):
    from tephra.functions.radial import screened_pair

    grid = structures.tabulate(spark, [14, 32], lambda r, a, b: screened_pair(r, a, b) * structures.switch_off(r, 1.0, 3.0), 0.5, 4.0, 15)
    return grid.select("zi", "zj", F.col("k").cast("long").alias("k"), F.round("r", 4).alias("r"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


def radial_law(spark) -> DataFrame:
    return structures.tabulate(spark, [0, 1], lambda r, a, b: (1.0 + a + 2 * b) * F.exp(-r), 0.0, 4.0, 401)


@query(f"""with w as (select *, least(zi,zj) a, greatest(zi,zj) b, floor(dist/0.01)::int k from {PAIRS_SQL} where dist<4.0), v as (select *, (1+a+2*b)*exp(-0.01*k) lo, (1+a+2*b)*exp(-0.01*(k+1)) hi from w)
  select cfg, round(sum((lo+(dist/0.01-k)*(hi-lo))/2),4)+0.0 e, round(sum(-(hi-lo)/0.01/dist/2*dx*dx),3)+0.0 xx from v group by 1""")
def pair_baseline(spark, d):
    total, _ = structures.baseline(edges(spark, d, 4.0), atoms(spark, d).select("cfg", "atom", F.col("species").alias("z")), structures.pair_tables(radial_law(spark)))
    return total.select("cfg", (F.round("e", 4) + F.lit(0.0)).alias("e"), (F.round(F.col("v")[0], 3) + F.lit(0.0)).alias("xx"))


@query("select s_nationkey, round(sum(s_acctbal),4)+0.0 total from supplier group by 1")
def exact_sum(spark, d):
    return rounded(structures.exact_sum(t(spark, d, "supplier"), ["s_nationkey"], "s_acctbal"))


BASIS = sites.SiteBasis(3.0, 3, 2, 2)


@query(f"""with a as (select cfg, zi, zj, dist r, 1-2*dist/3.0 u, power(1-power(dist/3.0,2),2)/sqrt(4*pi()) c from {PAIRS_SQL} where dist<3.0), f as (select cfg, zi, zj, sum(c) f0, sum(u*c) f1, sum((2*u*u-1)*c) f2 from a group by 1,2,3),
  x as (select s.cfg, z.z zi, q.q zj from (select distinct cfg from {ATOMS_SQL}) s, (values (0),(1)) z(z), (values (0),(1)) q(q)) select x.cfg, x.zi, x.zj, round(coalesce(f0,0),6)+0.0 f0, round(coalesce(f1,0),6)+0.0 f1, round(coalesce(f2,0),6)+0.0 f2 from x left join f using(cfg,zi,zj)""")
def linear_rows(spark, d):
    """Energy design rows of all structures: their one-body columns by species of centre and neighbour."""
    rows = sites.design_rows(atoms(spark, d), edges(spark, d, 3.0), BASIS, ("E",))
    place = F.array(*[F.struct(F.lit(a).alias("zi"), F.lit(b).alias("zj"), *[(F.round(F.col("phi")[a * BASIS.width + b * 3 + k], 6) + F.lit(0.0)).alias(f"f{k}") for k in range(3)]) for a in range(2) for b in range(2)])
    return rows.select("cfg", F.explode(place).alias("_p")).select("cfg", "_p.*")


def labelled_structures(spark, d) -> fit.Structures:
    """The suppliers' structures with labels of a known smooth pair energy; structures of odd number lack virials."""
    law = structures.pair_tables(radial_law(spark).withColumn("v", F.col("v") * F.pow(1 - F.pow(F.col("r") / 4.0, 2), 2)))
    typed = neighbours.periodic_edges(atoms(spark, d), cells(spark, d), 4.0, ("species",))
    forces = written(structures.site_baseline(typed, law), "baseline")  # a row an atom: edges are many more
    total = forces.groupBy("cfg").agg(F.sum("e").alias("e"), F.array(*[F.sum(F.col("v")[k]) for k in range(9)]).alias("v"))
    kind = F.concat(F.lit("t"), F.col("cfg") % 3)
    all_cfg, place = cells(spark, d).select("cfg"), atoms(spark, d).select("cfg", "atom")
    configs = all_cfg.join(total, "cfg", "left").select("cfg", F.coalesce("e", F.lit(0.0)).alias("energy"), F.when(F.col("cfg") % 2 == 0, F.coalesce("v", F.array_repeat(F.lit(0.0), 9))).alias("virial"), kind.alias("config_type"))
    force = place.join(forces.select("cfg", "atom", "fx", "fy", "fz"), ["cfg", "atom"], "left").na.fill(0.0, ["fx", "fy", "fz"])
    return fit.Structures(atoms(spark, d), cells(spark, d), configs, force)


@query()
def fit_and_report(spark, d):
    """Metrics of a model fitted to four structures in five, on the others."""
    data = labelled_structures(spark, d)
    _, table = fit.run(data.where("cfg % 5 <> 0"), data.where("cfg % 5 = 0"), sites.SiteBasis(4.0, 3, 1, 2))
    return table


@query(f"select cfg, count(*)::bigint n, count(*)*3+1+case when cfg%2=0 then 6 else 0 end as live from {ATOMS_SQL} group by 1")
def observation_counts(spark, d):
    """Structures with their atoms and the labelled rows that they give."""
    rows = fit.observations(labelled_structures(spark, d), sites.SiteBasis(4.0, 1, 0, 2))
    return rows.groupBy("cfg").agg(F.max("n_atoms").alias("n"), F.sum((F.col("w") > 0).cast("int")).alias("live")).select("cfg", "n", F.when(F.col("n") > 0, F.col("live")).alias("live"))


@query("""select cast(date_trunc('month', o_orderdate) as date)::varchar as month, o_orderpriority, count(*) n, round(sum(o_totalprice),2) total from orders where o_totalprice > 100000.0 group by 1,2""")
def sql_text(spark, d):
    """A query in SQL text with a value, through the front end."""
    text = "select cast(cast(date_trunc('month', o_orderdate) as date) as string) as month, o_orderpriority, count(*) n, round(sum(o_totalprice),2) total from orders where o_totalprice > :least group by 1,2"
    return front.sql(spark, d, text, least=100000.0)


@query("""select extract(year from o_orderdate)::int as "year", extract(quarter from o_orderdate)::int as "quarter", extract(dow from o_orderdate)::int as weekday, count(*) n, max(date_diff('day', date '1992-01-01', o_orderdate::date))::int last_day, min((o_orderdate + interval 1 month)::date)::varchar due,
  max(last_day(o_orderdate))::varchar month_end from orders group by 1,2,3""")
def date_functions(spark, d):
    day = F.to_date("o_orderdate")
    grouped = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), (F.dayofweek("o_orderdate") - 1).alias("weekday"))
    return grouped.agg(F.count("*").alias("n"), F.max(F.datediff(day, F.lit("1992-01-01"))).alias("last_day"), F.min(F.add_months(day, 1)).cast("string").alias("due"), F.max(F.last_day(day)).cast("string").alias("month_end"))


@query("""with a as (select s_nationkey cfg, sum(s_acctbal/10000.0) a0, sum((s_suppkey%7)/7.0) a1, count(*)/10.0 a2 from supplier group by 1)
  select cfg, round(0.5*a0+1.5*a0*a1-2.0*a0*a1*a2+0.25*a1*a1*a2+0.1*a2*a2*a2,8)+0.0 e, round(0.5+1.5*a1-2.0*a1*a2,8)+0.0 d0, round(1.5*a0-2.0*a0*a2+0.5*a1*a2,8)+0.0 d1, round(-2.0*a0*a1+0.25*a1*a1+0.3*a2*a2,8)+0.0 d2 from a""")
def product_plan(spark, d):
    """Products of pooled values by a shared plan, with their slopes."""
    s = t(spark, d, "supplier")
    a = s.groupBy(F.col("s_nationkey").alias("cfg")).agg(F.array(F.sum(F.col("s_acctbal") / 10000.0), F.sum((F.col("s_suppkey") % 7) / 7.0), F.count("*") / 10.0).alias("a"))
    plan = monomials.build_plan([(0,), (0, 1), (0, 1, 2), (1, 1, 2), (2, 2, 2)], 3)
    out = monomials.evaluate(a, "a", plan, [0.5, 1.5, -2.0, 0.25, 0.1])
    return rounded(out.select("cfg", "e", *[F.col("slope")[i].alias(f"d{i}") for i in range(3)]), 8)


@query("select l_returnflag, round(max(abs(l_extendedprice-l_extendedprice::float::double)),6) most, round(sqrt(avg(power(l_extendedprice-l_extendedprice::float::double,2))),6) rms, round(max(abs(l_extendedprice-l_extendedprice::float::double)/abs(l_extendedprice)),10) relative from lineitem group by 1")
def precision_check(spark, d):
    out = monomials.precision_check(t(spark, d, "lineitem"), F.col("l_extendedprice"), F.col("l_extendedprice"), ["l_returnflag"])
    return out.select("l_returnflag", F.round("most", 6).alias("most"), F.round("rms", 6).alias("rms"), F.round("relative", 10).alias("relative"))
