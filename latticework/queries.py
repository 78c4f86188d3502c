"""Registered queries over the driver's tables, with their SQL oracles.

``U``: the 25 nations as a 5 x 5 lattice with customer and supplier measures.  ``P``: embeddings
as points, the first two components being coordinates.  Numbers are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import autocorrelation as ac
from .operators import classify as cl
from .operators import features as ft
from .operators import models as md
from .operators import ols as lm
from .operators import quality as qa
from .operators import validation as va
from .operators import weights as wt

DIGITS = 6
PERMUTATIONS, SEED = 99, 7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: str | Column, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column, DIGITS) + F.lit(0.0)).alias(name or c)


def units(spark: SparkSession, d: str) -> DataFrame:
    nation = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), "n_name")
    customers = t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i")).agg(F.avg("c_acctbal").alias("x"), F.count("*").alias("x2"))
    suppliers = t(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("i")).agg(F.avg("s_acctbal").alias("x1"))
    both = nation.join(customers, "i", "left").join(suppliers, "i", "left")
    zero = F.lit(0.0)
    return both.select(
        "i",
        F.col("i").cast("string").alias("id"),
        F.floor(F.col("i") / 5).alias("row"),
        (F.col("i") % 5).alias("col"),
        F.round(F.coalesce("x", zero), 6).alias("x"),
        F.round(F.coalesce("x1", zero), 6).alias("x1"),
        F.coalesce("x2", F.lit(0)).cast("double").alias("x2"),
    ).cache()


U = """u as (select n_nationkey::bigint as i, n_nationkey::varchar as id, (n_nationkey // 5)::bigint as row, (n_nationkey % 5)::bigint as col,
        round(coalesce(c.x, 0), 6) as x, round(coalesce(s.x, 0), 6) as x1, coalesce(c.n, 0)::double as x2
        from nation left join (select c_nationkey as k, avg(c_acctbal) as x, count(*) as n from customer group by 1) c on c.k = n_nationkey
        left join (select s_nationkey as k, avg(s_acctbal) as x from supplier group by 1) s on s.k = n_nationkey)"""
ROOK = "b as (select a.i as i, b.i as j, 1.0::double as weight from u a join u b on abs(a.row - b.row) + abs(a.col - b.col) = 1)"
QUEEN = "b as (select a.i as i, b.i as j, 1.0::double as weight from u a join u b on a.i <> b.i and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1)"
STD = "e as (select i, j, weight / sum(weight) over (partition by i) as weight from b)"
Z = "z as (select *, x - avg(x) over () as z from u)"
K = f"""k as (select count(*) as n, sum(z * z) as ss, (select sum(weight) from e) as s0 from z)"""


def perm(source: str = "z", column: str = "z") -> str:
    return f"""s as (select p, row_number() over (partition by p order by md5('{SEED}:' || p::varchar || ':' || i::varchar)) - 1 as i, {column} as v
        from {source}, (select unnest(range(1, {PERMUTATIONS} + 1)) as p))"""


def r(column: str, name: str | None = None) -> str:
    return f"round({column}, {DIGITS}) + 0.0 as {name or column}"


def points(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    names = ("x", "y", "c1", "c2", "target")
    return e.select(F.col("vec_id").alias("i"), *[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)], F.col("label").alias("grp"))


P = """pt as (select vec_id as i, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as c1, embedding[4]::double as c2, embedding[5]::double as target, label as grp from embeddings)"""
D2 = "d as (select a.i as i, b.i as j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2 from pt a join pt b on a.i <> b.i)"
KNN = 5
NEAR = f"nn as (select * from (select *, row_number() over (partition by i order by d2, j) as rank from d) where rank <= {KNN})"
BAND = 0.05


# ---- joins and contracts -------------------------------------------------------------------


@query(
    """with a as (select trim(c_custkey::varchar) as k from customer), b as (select distinct trim(o_custkey::varchar) as k from orders)
    select count(a.k) as n_spatial, count(b.k) as n_table, count(*) filter (a.k is not null and b.k is not null) as matched,
        count(*) filter (b.k is null) as unmatched_spatial, count(*) filter (a.k is null) as unused_table,
        round(count(*) filter (a.k is not null and b.k is not null) / count(a.k)::double, 6) as match_rate
    from a full join b on a.k = b.k"""
)
def join_quality_report(spark, d):
    report = qa.join_report(t(spark, d, "customer"), t(spark, d, "orders").select("o_custkey").distinct(), "c_custkey", "o_custkey")
    return report.withColumn("match_rate", F.round("match_rate", 6))


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def join_unmatched(spark, d):
    return qa.unmatched(t(spark, d, "customer").select("c_custkey", "c_name"), t(spark, d, "orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey")


@query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def join_unused(spark, d):
    return qa.unmatched(t(spark, d, "part").select("p_partkey", "p_name"), t(spark, d, "lineitem").where("l_quantity > 45"), "p_partkey", "l_partkey")


@query("select c_custkey, c_acctbal from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def join_semi(spark, d):
    return qa.matched(t(spark, d, "customer").select("c_custkey", "c_acctbal"), t(spark, d, "orders").where("o_totalprice > 200000"), "c_custkey", "o_custkey")


@query("select c.c_custkey, c.c_name, o.n_orders, round(o.total, 2) as total from customer c left join (select o_custkey, count(*) as n_orders, sum(o_totalprice) as total from orders group by 1) o on c.c_custkey = o.o_custkey")
def join_one_to_one(spark, d):
    orders = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    joined, *_ = qa.join_one_to_one(t(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "o_custkey", 0.0)
    return joined.select("c_custkey", "c_name", "n_orders", F.round("total", 2).alias("total"))


@query("select l_suppkey, count(*) as rows from lineitem where l_suppkey is not null group by 1 having count(*) > 1")
def key_duplicates(spark, d):
    return qa.duplicate_keys(t(spark, d, "lineitem"), "l_suppkey")


@query(
    """select 'event_type' as "column", count(*) filter (event_type is not null and try_cast(trim(event_type) as double) is null) as violations from events
    union all select 'value', count(*) filter (value is not null and try_cast(trim(value::varchar) as double) is null) from events
    union all select 'user_id', count(*) filter (user_id is not null and try_cast(trim(user_id::varchar) as double) is null) from events"""
)
def numeric_contract(spark, d):
    return qa.numeric_violations(t(spark, d, "events"), ["event_type", "value", "user_id"])


@query("\n    union all ".join(f"""select '{c}' as "column", count(*) - count({c}) as missing from events""" for c in ("ts", "user_id", "event_type", "value", "props")))
def missing_counts(spark, d):
    return qa.missing_counts(t(spark, d, "events"), ["ts", "user_id", "event_type", "value", "props"])


def _class_sql(edges: str) -> str:
    return f"""with q as (select {edges} as e from customer),
        c as (select c_custkey, c_acctbal, (c_acctbal > e[2])::int + (c_acctbal > e[3])::int + (c_acctbal > e[4])::int + (c_acctbal > e[5])::int as class_index, e from customer, q)
        select c_custkey, class_index, round(e[class_index + 1], 6) as class_low, round(e[class_index + 2], 6) as class_high from c"""


def _classes(spark, d, method):
    told = cl.classify(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", method, 5)
    return told.select("c_custkey", "class_index", F.round("class_low", 6).alias("class_low"), F.round("class_high", 6).alias("class_high"))


@query(_class_sql("quantile_cont(c_acctbal, [0, 0.2, 0.4, 0.6, 0.8, 1])"))
def classify_quantiles(spark, d):
    return _classes(spark, d, "quantiles")


@query(_class_sql("[" + ", ".join(f"min(c_acctbal) + (max(c_acctbal) - min(c_acctbal)) / 5 * {k}" for k in range(5)) + ", max(c_acctbal)]"))
def classify_equal_interval(spark, d):
    return _classes(spark, d, "equal_interval")


# ---- weights -------------------------------------------------------------------------------


def rook(spark, d):
    return wt.transform(wt.lattice_contiguity(units(spark, d), "rook"))


@query(f"with {U}, {ROOK} select i, j, weight from b")
def weights_rook(spark, d):
    return wt.lattice_contiguity(units(spark, d), "rook")


@query(f"with {U}, {QUEEN} select i, j, weight from b")
def weights_queen(spark, d):
    return wt.lattice_contiguity(units(spark, d), "queen")


@query(f"with {U}, {QUEEN}, {STD} select i, j, 1.0::double as weight from e")
def weights_binary(spark, d):
    return wt.transform(wt.transform(wt.lattice_contiguity(units(spark, d), "queen")), "binary")


@query(f"with {U}, {ROOK}, {STD} select i, j, {r('weight')} from e")
def weights_rowstd(spark, d):
    return rook(spark, d).select("i", "j", r6("weight"))


@query(f"with {P}, {D2}, {NEAR} select i, j, 1.0::double as weight from nn")
def weights_knn(spark, d):
    return wt.knn(points(spark, d), KNN)


@query(f"with {P}, {D2}, {NEAR} select i, j, 1.0::double as weight from nn union select j, i, 1.0::double from nn")
def knn_union(spark, d):
    return wt.knn(points(spark, d), KNN, "union")


@query(f"with {P}, {D2}, {NEAR} select a.i, a.j, 1.0::double as weight from nn a join nn b on a.i = b.j and a.j = b.i")
def knn_mutual(spark, d):
    return wt.knn(points(spark, d), KNN, "mutual")


@query(f"with {P}, {D2} select i, j, 1.0::double as weight from d where d2 <= {BAND} * {BAND}::double")
def weights_distance_band(spark, d):
    return wt.distance_band(points(spark, d), BAND)


@query(f"with {P}, {D2}, {NEAR}, b as (select i, j, 1 / greatest(sqrt(d2), 1e-12) as weight from nn), {STD} select i, j, {r('weight')} from e")
def weights_inverse_distance(spark, d):
    p = points(spark, d)
    return wt.weighted_nearest(wt.nearest(p, p, KNN, same=True), "inverse_distance").select("i", "j", r6("weight"))


@query(
    f"""with {U}, l as (select c_nationkey as o, (c_custkey % 25)::int as q, (c_custkey % 4)::double as w from customer),
    b as (select o::bigint as i, q::bigint as j, sum(w) as weight from l where o <> q group by all having sum(w) > 0), {STD} select i, j, {r('weight')} from e"""
)
def weights_from_edges(spark, d):
    c = t(spark, d, "customer")
    listed = c.select(F.concat(F.lit(" "), F.col("c_nationkey")).alias("origin_id"), (F.col("c_custkey") % 25).cast("string").alias("destination_id"), (F.col("c_custkey") % 4).cast("double").alias("weight"))
    return wt.from_edges(listed, units(spark, d)).select("i", "j", r6("weight"))


SPARSE = "b as (select a.i as i, b.i as j, 1.0::double as weight from u a join u b on abs(a.row - b.row) + abs(a.col - b.col) = 1 where a.col < 3 and b.col < 3 and a.row <> 2 and b.row <> 2)"


def sparse(spark, d):
    u = units(spark, d)
    kept = u.where("col < 3 and row <> 2")
    return wt.lattice_contiguity(kept, "rook"), u


@query(
    f"""with {U}, {SPARSE}, c as (select u.i, count(b.j) as k from u left join b on u.i = b.i group by 1)
    select count(*) as n, 14.0 + 14.0 as s0, count(*) filter (k = 0) as islands, 15::bigint as components, 6::bigint as largest_component, min(k) as min_neighbors, round(avg(k), 6) as mean_neighbors, max(k) as max_neighbors from c"""
)
def weights_diagnostics(spark, d):
    edges, u = sparse(spark, d)
    told = wt.diagnostics(edges, u)
    return told.select("n", "s0", "islands", "components", "largest_component", "min_neighbors", F.round("mean_neighbors", 6).alias("mean_neighbors"), "max_neighbors")


@query(f"with {U}, {SPARSE} select i, id from u where i not in (select i from b)")
def islands(spark, d):
    edges, u = sparse(spark, d)
    return wt.islands(edges, u).select("i", "id")


@query(
    f"""with recursive {U}, {SPARSE}, c(i, m) as (select i, i from u union select b.j, c.m from c join b on b.i = c.i)
    select i, min(m) as component from c group by i"""
)
def components(spark, d):
    edges, u = sparse(spark, d)
    return wt.components(edges, u)


@query(f"with {U}, {ROOK}, {STD} select e.i as i, {r('sum(e.weight * u.x)', 'lag')} from e join u on u.i = e.j group by e.i")
def spatial_lag(spark, d):
    u = units(spark, d)
    return wt.lag(rook(spark, d), u).select("i", r6("lag"))


# ---- autocorrelation -----------------------------------------------------------------------

MORAN = "sum(e.weight * a.{v} * b.{v}) * any_value(n) / any_value(s0) / any_value(ss)"
GEARY = "sum(e.weight * (a.{v} - b.{v}) * (a.{v} - b.{v})) * (any_value(n) - 1) / (2 * any_value(s0)) / any_value(ss)"


def _base(edges: str = ROOK) -> str:
    return f"{U}, {edges}, {STD}, {Z}, {K}"


@query(f"with {_base()} select {r(MORAN.format(v='z'), 'value')} from e join z a on a.i = e.i join z b on b.i = e.j, k")
def moran_global(spark, d):
    return ac.moran(units(spark, d), rook(spark, d)).select(r6("value"))


@query(f"with {_base()} select {r(GEARY.format(v='z'), 'value')} from e join z a on a.i = e.i join z b on b.i = e.j, k")
def geary_global(spark, d):
    return ac.geary(units(spark, d), rook(spark, d)).select(r6("value"))


def _test_sql(stat: str, center: str, expected: str) -> str:
    middle = {"expected": expected, "simulated": "round(avg(sim) over (), 10)", "zero": "0.0"}[center]
    return f"""with {_base()}, {perm()},
        o as (select round({stat.format(v='z')}, 10) as value from e join z a on a.i = e.i join z b on b.i = e.j, k),
        m as (select a.p, round({stat.format(v='v')}, 10) as sim from e join s a on a.i = e.i join s b on b.i = e.j and b.p = a.p, k group by a.p),
        c as (select sim, value, {middle} as mid from m, o, k)
        select {r('any_value(value)', 'value')}, {r(f'any_value({expected})', 'expected')}, {r(f'(count(*) filter (round(abs(sim - mid), 10) >= round(abs(value - mid), 10)) + 1) / {PERMUTATIONS + 1}.0', 'p_value')},
        count(*) as permutations, 'two-sided' as alternative, {r('avg(sim)', 'simulated_mean')}, {r('stddev_samp(sim)', 'simulated_std')} from c, k"""


def _test(spark, d, statistic, center):
    told = ac.permutation_test(units(spark, d), rook(spark, d), statistic, PERMUTATIONS, SEED, center=center)
    return told.select(r6("value"), r6("expected"), r6("p_value"), "permutations", "alternative", r6("simulated_mean"), r6("simulated_std"))


@query(_test_sql(MORAN, "expected", "-1.0 / (n - 1)"))
def moran_permutation(spark, d):
    return _test(spark, d, "moran", "expected")


@query(_test_sql(GEARY, "expected", "1.0"))
def geary_permutation(spark, d):
    return _test(spark, d, "geary", "expected")


@query(_test_sql(MORAN, "simulated", "-1.0 / (n - 1)"))
def moran_perm_residual_center(spark, d):
    return _test(spark, d, "moran", "simulated")


@query(_test_sql(MORAN, "zero", "-1.0 / (n - 1)"))
def moran_perm_zero_center(spark, d):
    return _test(spark, d, "moran", "zero")


BH = """h as (select *, p_value * count(*) over () / row_number() over (order by p_value, i) as adj, row_number() over (order by p_value, i) as rk from {src}),
    q as (select *, greatest(0.0, least(1.0, min(adj) over (order by rk desc rows between unbounded preceding and current row))) as q_value from h)"""
LOCAL = f"""{_base()}, m2 as (select ss / n as m2 from k),
    l as (select z.i, z.x as value, z.z, coalesce(sum(e.weight * b.z), 0) as spatial_lag_z, count(e.j) as neighbors from z left join e on e.i = z.i left join z b on b.i = e.j group by z.i, z.x, z.z),
    o as (select l.*, round(z * spatial_lag_z / m2, 10) as local_moran from l, m2),
    pr as (select unnest(range(1, {PERMUTATIONS} + 1)) as p),
    pm as (select pr.p, z.i as o, z.z as v, row_number() over (partition by pr.p order by md5('{SEED}:' || pr.p::varchar || ':' || z.i::varchar)) - 1 as pos from z, pr),
    sl as (select i, weight, row_number() over (partition by i order by j) as slot from e),
    sm as (select sl.i, me.p, sum(sl.weight * b.v) as slag from sl join pm me on me.o = sl.i join pm b on b.p = me.p and b.pos = (me.pos + sl.slot) % (select count(*) from z) group by sl.i, me.p),
    si as (select sm.i, round(z.z * slag / m2, 10) as sim from sm join z on z.i = sm.i, m2),
    md as (select i, round(avg(sim), 10) as mid from si group by i),
    pv as (select si.i, (count(*) filter (round(abs(sim - mid), 10) >= round(abs(local_moran - mid), 10)) + 1) / {PERMUTATIONS + 1}.0::double as p_value from si join md on md.i = si.i join o on o.i = si.i group by si.i),
    t as (select o.*, case when neighbors = 0 then 1.0 else pv.p_value end as p_value from o left join pv on pv.i = o.i), {BH.format(src='t')},
    f as (select *, q_value <= {{alpha}} and neighbors > 0 as significant from q),
    g as (select *, case when neighbors = 0 then 'Island' when not significant then 'NS' when z >= 0 and spatial_lag_z >= 0 then 'HH' when z < 0 and spatial_lag_z < 0 then 'LL' when z >= 0 then 'HL' else 'LH' end as cluster from f)"""


def _local(spark, d, alpha):
    return ac.local_moran(units(spark, d), rook(spark, d), PERMUTATIONS, SEED, alpha)


@query(f"with {LOCAL.format(alpha=0.05)} select i, {r('value')}, {r('z')}, {r('spatial_lag_z')}, {r('local_moran')}, neighbors from g")
def local_moran(spark, d):
    return _local(spark, d, 0.05).select("i", r6("value"), r6("z"), r6("spatial_lag_z"), r6("local_moran"), "neighbors")


@query(f"with {LOCAL.format(alpha=0.05)} select i, {r('p_value')}, {r('q_value')}, significant from g")
def local_moran_conditional(spark, d):
    return _local(spark, d, 0.05).select("i", r6("p_value"), r6("q_value"), "significant")


@query(f"with {LOCAL.format(alpha=0.6)} select cluster, count(*) as units from g group by 1")
def lisa_clusters(spark, d):
    return _local(spark, d, 0.6).groupBy("cluster").agg(F.count("*").alias("units"))


@query(
    f"""with {_base()}, {perm()}, m2 as (select ss / n as m2 from k),
    o as (select z.i, z.z, coalesce(sum(e.weight * b.z), 0) as lag from z left join e on e.i = z.i left join z b on b.i = e.j group by z.i, z.z),
    ob as (select o.*, round(z * lag / m2, 10) as local_i from o, m2),
    lg as (select a.p, a.i, a.v, sum(e.weight * b.v) as l from s a left join e on e.i = a.i left join s b on b.i = e.j and b.p = a.p group by all),
    sm as (select i, round(v * coalesce(l, 0) / m2, 10) as sim from lg, m2),
    pv as (select sm.i, (count(*) filter (abs(sim) >= abs(local_i)) + 1) / {PERMUTATIONS + 1}.0::double as local_p from sm join ob on ob.i = sm.i group by sm.i)
    select ob.i, {r('local_i')}, {r('local_p')}, {r('lag', 'spatial_lag')}, case when local_p > 0.1 then 'NS' when z >= 0 and lag >= 0 then 'HH' when z < 0 and lag < 0 then 'LL' when z >= 0 then 'HL' else 'LH' end as cluster
    from ob join pv on pv.i = ob.i"""
)
def local_moran_unconditional(spark, d):
    return ac.local_moran_unconditional(units(spark, d), rook(spark, d), PERMUTATIONS, SEED, 0.1).select("i", r6("local_i"), r6("local_p"), r6("spatial_lag"), "cluster")


GSTAR = f"""{U}, {ROOK}, {STD}, {perm('u', 'x')}, fu as (select i, j, weight from e where i <> j union all select i, i, 1.0 from u),
    st as (select avg(x) as m, sqrt(greatest(0, avg(x * x) - avg(x) * avg(x))) as sd, count(*) as n from u),
    sw as (select i, sum(weight) as sw, sum(weight * weight) as sw2, count(*) as neighbors_with_self from fu group by i),
    dn as (select sw.*, m, sd * sqrt(greatest(0.0, (n * sw2 - sw * sw) / (n - 1))) as den from sw, st),
    o as (select dn.i, any_value(neighbors_with_self) as neighbors_with_self, round((sum(weight * u.x) - any_value(m) * any_value(sw)) / any_value(den), 10) as g_star from dn join fu on fu.i = dn.i join u on u.i = fu.j group by dn.i),
    si as (select dn.i, s.p, round((sum(weight * s.v) - any_value(m) * any_value(sw)) / any_value(den), 10) as sim from dn join fu on fu.i = dn.i join s on s.i = fu.j group by dn.i, s.p),
    md as (select i, round(avg(sim), 10) as mid from si group by i),
    t as (select si.i, any_value(g_star) as g_star, any_value(neighbors_with_self) as neighbors_with_self, (count(*) filter (round(abs(sim - mid), 10) >= round(abs(g_star - mid), 10)) + 1) / {PERMUTATIONS + 1}.0::double as p_value
        from si join md on md.i = si.i join o on o.i = si.i group by si.i), {BH.format(src='t')}"""


@query(f"with {GSTAR} select q.i, {r('x', 'value')}, {r('g_star')}, {r('p_value')}, {r('q_value')}, neighbors_with_self from q join u on u.i = q.i")
def getis_ord_gstar(spark, d):
    told = ac.getis_ord(units(spark, d), rook(spark, d), PERMUTATIONS, SEED)
    return told.select("i", r6("value"), r6("g_star"), r6("p_value"), r6("q_value"), "neighbors_with_self")


@query(f"with {GSTAR} select case when p_value > 0.2 then 'NS' when g_star > 0 then 'Hot' else 'Cold' end as classification, count(*) as units from q group by 1")
def gstar_classes(spark, d):
    told = ac.getis_ord(units(spark, d), rook(spark, d), PERMUTATIONS, SEED, alpha=0.2, fdr=False)
    return told.groupBy("classification").agg(F.count("*").alias("units"))


@query(f"with t as (select c_custkey as i, (1 + c_custkey % 97) / 98.0::double as p_value from customer), {BH.format(src='t')} select i, {r('p_value')}, {r('q_value')} from q")
def bh_fdr(spark, d):
    p = t(spark, d, "customer").select(F.col("c_custkey").alias("i"), ((1 + F.col("c_custkey") % 97) / F.lit(98.0)).alias("p_value"))
    return ac.benjamini_hochberg(p).select("i", r6("p_value"), r6("q_value"))


def _sensitivity_sql(name: str, edges: str) -> str:
    stats = f"{r(MORAN.format(v='z'), 'moran_i')}, {r(GEARY.format(v='z'), 'geary_c')}"
    return f"select * from (with {_base(edges)} select '{name}' as weights, {r('any_value(s0)', 's0')}, {stats} from e join z a on a.i = e.i join z b on b.i = e.j, k)"


@query(" union all ".join(_sensitivity_sql(n, e) for n, e in (("rook", ROOK), ("queen", QUEEN))))
def sensitivity_by_weights(spark, d):
    u, out = units(spark, d), None
    for name in ("rook", "queen"):
        edges = wt.transform(wt.lattice_contiguity(u, name)).cache()
        row = edges.agg(r6(F.sum("weight"), "s0")).join(ac.moran(u, edges).select(r6("value", "moran_i"))).join(ac.geary(u, edges).select(r6("value", "geary_c")))
        row = row.select(F.lit(name).alias("weights"), "s0", "moran_i", "geary_c")
        out = row if out is None else out.unionByName(row)
    return out


# ---- regression ----------------------------------------------------------------------------

REG = f"""{P}, g as (select count(*)::double as n, avg(target) as my, avg(c1) as mx, covar_pop(target, c1) as sxy, var_pop(c1) as sxx, var_pop(target) as syy from pt),
    f as (select *, sxy / sxx as b1, my - sxy / sxx * mx as b0 from g),
    v as (select pt.*, b0 + b1 * c1 as fitted, target - b0 - b1 * c1 as residual, 1 / n + (c1 - mx) * (c1 - mx) / (n * sxx) as leverage, n, sxx, syy, b0, b1, mx from pt, f),
    w as (select *, sum(residual * residual) over () as sse from v)"""


def simple(spark, d):
    return lm.fit(points(spark, d), "target", ["c1"], "simple")


@query(
    f"""with {REG}, h as (select any_value(b0) as b0, any_value(b1) as b1, any_value(sse) / (any_value(n) - 2) as s2, any_value(n) as n, any_value(sxx) as sxx, any_value(mx) as mx,
        sum(residual * residual / ((1 - leverage) * (1 - leverage))) as m0, sum(c1 * residual * residual / ((1 - leverage) * (1 - leverage))) as m1, sum(c1 * c1 * residual * residual / ((1 - leverage) * (1 - leverage))) as m2 from w),
    i as (select *, (sxx + mx * mx) / (n * sxx) as i00, -mx / (n * sxx) as i01, 1 / (n * sxx) as i11 from h)
    select 'const' as term, {r('b0', 'coefficient')}, {r('sqrt(s2 * i00)', 'std_error')}, {r('sqrt(i00 * i00 * m0 + 2 * i00 * i01 * m1 + i01 * i01 * m2)', 'robust_std_error')} from i
    union all select 'c1', {r('b1', 'coefficient')}, {r('sqrt(s2 * i11)', 'std_error')}, {r('sqrt(i01 * i01 * m0 + 2 * i01 * i11 * m1 + i11 * i11 * m2)', 'robust_std_error')} from i"""
)
def ols_coefficients(spark, d):
    return lm.coefficients(simple(spark, d)).select("term", r6("coefficient"), r6("std_error"), r6("robust_std_error"))


@query()
def ols_inference(spark, d):
    return lm.coefficients(lm.fit(points(spark, d), "target", ["c1", "c2", "x", "y"], "full", "HC1"))


KINDS = {"HC0": "1", "HC1": "n / (n - 2)", "HC2": "1 / (1 - leverage)", "HC3": "1 / ((1 - leverage) * (1 - leverage))"}
ROBUST_SUMS = " union all ".join(
    f"select '{kind}' as robust_covariance, '{term}' as term, sqrt(sum({share} * {share} * residual * residual * {factor})) as se from w"
    for kind, factor in KINDS.items()
    for term, share in (("const", "(1 / n - mx * (c1 - mx) / (n * sxx))"), ("c1", "((c1 - mx) / (n * sxx))"))
)


@query(f"with {REG}, s as ({ROBUST_SUMS}) select robust_covariance, term, {r('se', 'robust_std_error')} from s")
def ols_robust_errors(spark, d):
    p, out = points(spark, d).cache(), None
    for kind in KINDS:
        rows = lm.coefficients(lm.fit(p, "target", ["c1"], "simple", kind)).select("robust_covariance", "term", r6("robust_std_error"))
        out = rows if out is None else out.union(rows)
    return out


@query(
    f"""with {REG}, c as (select corr(residual * residual, c1) as a, corr(residual * residual, c1 * c1) as b, corr(c1, c1 * c1) as m, any_value(n) as n from w),
    q as (select n, (a * a + b * b - 2 * a * b * m) / (1 - m * m) as r2 from c)
    select {r('n * r2', 'white_lm')}, {r('exp(-n * r2 / 2)', 'white_lm_p')}, {r('r2 / 2 / ((1 - r2) / (n - 3))', 'white_f')}, {r('pow(1 - r2, (n - 3) / 2)', 'white_f_p')} from q"""
)
def ols_white(spark, d):
    told = lm.white(simple(spark, d))  # both p-values have closed forms at two degrees of freedom
    return spark.createDataFrame([{k: float(v) for k, v in told.items()}]).select(*[r6(c) for c in told])


@query(f"with {P}, v as (select 1 / (1 - corr(c1, c2) * corr(c1, c2)) as v from pt) select 'c1' as term, {r('v', 'vif')} from v union all select 'c2', {r('v', 'vif')} from v")
def ols_vif(spark, d):
    return lm.vif(lm.fit(points(spark, d), "target", ["c1", "c2"])).select("term", r6("vif"))


@query(
    f"""with {REG}, s as (select any_value(n) as n, any_value(sse) as sse, any_value(syy) as syy from w), l as (select *, -n / 2 * (ln(2 * pi()) + ln(sse / n) + 1) as lik from s)
    select n::bigint as n, 2 as parameters, {r('1 - sse / (n * syy)', 'r_squared')}, {r('1 - (n - 1) / (n - 2) * (sse / (n * syy))', 'adjusted_r_squared')}, round(-2 * lik + 4, 4) as aic, round(-2 * lik + 2 * ln(n), 4) as bic, {r('sqrt(sse / n)', 'rmse')} from l"""
)
def ols_summary(spark, d):
    told = lm.summary(simple(spark, d))
    return told.select("n", "parameters", r6("r_squared"), r6("adjusted_r_squared"), F.round("aic", 4).alias("aic"), F.round("bic", 4).alias("bic"), r6("rmse"))


@query(
    f"""with {REG}, x as (select *, residual / sqrt(sse / (n - 2) * (1 - leverage)) as sr from w)
    select i as id, {r('fitted')}, {r('residual')}, {r('sr', 'standardized_residual')}, {r('sr * sqrt((n - 3) / (n - 2 - sr * sr))', 'studentized_residual')}, {r('leverage')}, {r('sr * sr * leverage / (2 * (1 - leverage))', 'cooks_distance')}, {r('sr * sqrt(leverage / (1 - leverage))', 'dffits')} from x"""
)
def ols_influence(spark, d):
    told = lm.influence(simple(spark, d), "i")
    return told.select("id", *[r6(c) for c in ("fitted", "residual", "standardized_residual", "studentized_residual", "leverage", "cooks_distance", "dffits")])


@query(f"with {REG}, x as (select residual, residual - lag(residual) over (order by i) as step from w) select {r('sum(step * step) / sum(residual * residual)', 'durbin_watson')} from x")
def durbin_watson(spark, d):
    return spark.range(1).select(F.lit(round(lm.durbin_watson(simple(spark, d), "i"), DIGITS)).alias("durbin_watson"))


@query(
    f"""with {REG}, m as (select count(*)::double as n, avg(residual) as m from w), c as (select avg(power(residual - m, 2)) as v, avg(power(residual - m, 3)) as s3, avg(power(residual - m, 4)) as s4, any_value(m.n) as n from w, m),
    s as (select n, s3 / power(v, 1.5) as s, s4 / (v * v) as k from c)
    select {r('n / 6 * (s * s + (k - 3) * (k - 3) / 4)', 'jarque_bera')}, {r('exp(-n / 12 * (s * s + (k - 3) * (k - 3) / 4))', 'jarque_bera_p')}, {r('s', 'residual_skew')}, {r('k', 'residual_kurtosis')} from s"""
)
def jarque_bera(spark, d):
    told = lm.jarque_bera(simple(spark, d))
    return spark.range(1).select(*[F.lit(round(v, DIGITS)).alias(c) for c, v in told.items()])


@query(f"with {REG} select {r('any_value(n) * corr(residual * residual, c1) * corr(residual * residual, c1)', 'lm')} from w")
def breusch_pagan_lm(spark, d):
    return spark.range(1).select(F.lit(round(lm.breusch_pagan(simple(spark, d))["breusch_pagan_lm"], DIGITS)).alias("lm"))


@query()
def classical_diagnostics(spark, d):
    return lm.classical(lm.fit(points(spark, d), "target", ["c1", "c2"]), "i")


LMT = f"""{U}, {ROOK}, {STD}, g as (select count(*)::double as n, avg(x) as my, avg(x1) as mx, covar_pop(x, x1) / var_pop(x1) as b1, var_pop(x1) as sxx from u),
    v as (select u.*, my + b1 * (x1 - mx) as f, x - my - b1 * (x1 - mx) as e0 from u, g), s as (select sum(e0 * e0) / count(*) as s2 from v),
    l as (select e.i, sum(weight * v.e0) as le, sum(weight * v.x) as ly, sum(weight * v.f) as lf from e join v on v.i = e.j group by e.i),
    a as (select sum(e0 * le) as uwu, sum(e0 * ly) as uwy, sum(lf * lf) as vv, sum(lf) as v0, sum(lf * (x1 - (select mx from g))) as v1 from v join l on l.i = v.i),
    tt as (select (select sum(weight * weight) from e) + (select sum(p.weight * q.weight) from e p join e q on p.i = q.j and p.j = q.i) as t),
    w as (select uwu / s2 as a, uwy / s2 as b, t, (vv - v0 * v0 / n - v1 * v1 / (n * sxx)) / s2 + t as j from a, s, tt, g)"""


@query(
    f"""with {LMT} select {r('a * a / t', 'lm_error')}, {r('b * b / j', 'lm_lag')}, {r('power(a - t / j * b, 2) / (t * (1 - t / j))', 'robust_lm_error')}, {r('power(b - a, 2) / (j - t)', 'robust_lm_lag')}, {r('a * a / t + power(b - a, 2) / (j - t)', 'lm_sarma')},
    {r('exp(-(a * a / t + power(b - a, 2) / (j - t)) / 2)', 'lm_sarma_p')} from w"""
)
def lm_tests(spark, d):
    told = lm.lm_tests(lm.fit(units(spark, d), "x", ["x1"]), rook(spark, d))
    return spark.range(1).select(*[F.lit(round(told[c], DIGITS)).alias(c) for c in ("lm_error", "lm_lag", "robust_lm_error", "robust_lm_lag", "lm_sarma", "lm_sarma_p")])


@query()
def ols_spatial_diagnostics(spark, d):
    return lm.spatial(lm.fit(units(spark, d), "x", ["x1", "x2"]), rook(spark, d), "rook", PERMUTATIONS, SEED)


# ---- validated learning --------------------------------------------------------------------

GRID = f"""{P}, qx as (select quantile_cont(x, [0.25, 0.5, 0.75]) as qx, quantile_cont(y, [0.25, 0.5, 0.75]) as qy from pt),
    gr as (select pt.*, ((y >= qy[1])::int + (y >= qy[2])::int + (y >= qy[3])::int) * 4 + (x >= qx[1])::int + (x >= qx[2])::int + (x >= qx[3])::int as g from pt, qx)"""


@query(f"with {GRID} select i, g as grp from gr")
def spatial_grid_groups(spark, d):
    return va.grid_groups(points(spark, d), 4, 4)


@query(f"with {GRID} select i from gr a where g <> 0 and not exists (select 1 from gr b where b.g = 0 and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0025)")
def buffer_filter(spark, d):
    p = points(spark, d)
    p = p.drop("grp").join(va.grid_groups(p, 4, 4), "i")
    return va.buffered(p.where("grp <> 0"), p.where("grp = 0"), 0.05).select("i")


@query(
    f"""with recursive {GRID}, o as (select g, count(*) as n, row_number() over (order by count(*) desc, g) as rk from gr group by g),
    st as (select 0::bigint as rk, [0, 0, 0, 0, 0]::bigint[] as loads, -1 as fold
        union all select o.rk, [loads[k] + case when k = list_position(loads, list_min(loads)) then o.n else 0 end for k in [1, 2, 3, 4, 5]], list_position(loads, list_min(loads)) - 1
        from st join o on o.rk = st.rk + 1)
    select fold::int as fold, sum(n)::bigint as rows, count(*) as groups from st join o using (rk) group by fold"""
)
def group_kfold(spark, d):
    groups = va.grid_groups(points(spark, d), 4, 4)
    return groups.join(va.group_folds(groups, 5), "grp").groupBy("fold").agg(F.count("*").alias("rows"), F.count_distinct("grp").alias("groups"))


@query(f"select vec_id as i, ((row_number() over (order by md5('{SEED}:' || vec_id::varchar), vec_id) - 1) % 5)::int as fold from embeddings")
def random_kfold(spark, d):
    return va.random_folds(points(spark, d), 5, SEED)


@query(f"with {P}, {D2}, {NEAR}, b as (select i, j, 1.0::double as weight from nn), {STD} select e.i, {r('sum(weight * c1)', 'lag_c1')}, {r('sum(weight * c2)', 'lag_c2')} from e join pt on pt.i = e.j group by e.i")
def covariate_lag_train(spark, d):
    return ft.covariate_lags(points(spark, d), None, ["c1", "c2"], KNN).select("i", r6("lag_c1"), r6("lag_c2"))


@query(
    f"""with {P}, d as (select a.i as i, b.i as j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2 from pt a join pt b on a.i % 4 = 0 and b.i % 4 <> 0), {NEAR},
    b as (select i, j, 1 / greatest(sqrt(d2), 1e-12) as weight from nn), {STD} select e.i, {r('sum(weight * c1)', 'lag_c1')} from e join pt on pt.i = e.j group by e.i"""
)
def covariate_lag_test(spark, d):
    p = points(spark, d)
    return ft.covariate_lags(p.where("i % 4 <> 0"), p.where("i % 4 = 0"), ["c1"], KNN, "inverse_distance").select("i", r6("lag_c1"))


@query()
def eigenbasis(spark, d):
    p = points(spark, d)
    basis = ft.EigenBasis(5.0, 6).fit(p.where("i % 4 <> 0"))
    return basis.transform(p)


PRED = f"{P}, pr as (select i, case when i % 3 = 0 then 'random' when i % 3 = 1 then 'fine' else 'coarse' end as validation, case when i % 2 = 0 then 'M0' else 'M1' end as model, (i % 7)::int as fold, target as y_true, c1 as y_pred, c1 - 0.1 as lower, c1 + 0.1 as upper from pt)"


def predictions(spark, d):
    i = F.col("i")
    return points(spark, d).select(
        "i",
        F.when(i % 3 == 0, "random").when(i % 3 == 1, "fine").otherwise("coarse").alias("validation"),
        F.when(i % 2 == 0, "M0").otherwise("M1").alias("model"),
        (i % 7).cast("int").alias("fold"),
        F.col("target").alias("y_true"),
        F.col("c1").alias("y_pred"),
        (F.col("c1") - 0.1).alias("lower"),
        (F.col("c1") + 0.1).alias("upper"),
    )


METRICS = f"""{PRED}, me as (select validation, model, fold, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) as rmse, avg(abs(y_true - y_pred)) as mae, 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) as r2,
    avg((y_true between lower and upper)::int::double) as interval_coverage, avg(upper - lower) as interval_width from pr group by all)"""


def metrics(spark, d):
    by, rows = ["validation", "model", "fold"], predictions(spark, d)
    return va.regression_metrics(rows, by).join(va.interval_metrics(rows, by), by)


@query(f"with {METRICS} select validation, model, fold, {r('rmse')}, {r('mae')}, {r('r2')} from me")
def regression_metrics(spark, d):
    return metrics(spark, d).select("validation", "model", "fold", r6("rmse"), r6("mae"), r6("r2"))


@query(f"with {METRICS} select validation, model, fold, {r('interval_coverage')}, {r('interval_width')} from me")
def interval_metrics(spark, d):
    return metrics(spark, d).select("validation", "model", "fold", r6("interval_coverage"), r6("interval_width"))


@query(f"with {P}, a as (select abs(target - c1) as e, row_number() over (order by abs(target - c1)) as k, count(*) over () as n from pt) select {r('e', 'q')} from a where k = least(n, ceil((n + 1) * 0.9))")
def conformal_quantile(spark, d):
    q = va.conformal_quantile(points(spark, d).select(F.abs(F.col("target") - F.col("c1")).alias("e")), "e", 0.9)
    return spark.range(1).select(r6(F.lit(q), "q"))


MEDIANS = f"{METRICS}, md as (select validation, model, median(rmse) as rmse, median(interval_coverage) as coverage from me group by all)"


@query(f"with {MEDIANS} select a.validation, a.model, {r('a.rmse', 'rmse_spatial')}, {r('b.rmse', 'rmse_random')}, {r('(a.rmse - b.rmse) / b.rmse', 'optimism_relative')} from md a left join md b on a.model = b.model and b.validation = 'random' where a.validation <> 'random'")
def optimism(spark, d):
    return va.optimism(metrics(spark, d)).select("validation", "model", r6("rmse_spatial"), r6("rmse_random"), r6("optimism_relative"))


STATS = ("rmse", "mae")


@query(f"with {METRICS} select validation, model, {', '.join(r(f'{s}({c})', f'{c}_{n}') for c in STATS for n, s in (('median', 'median'), ('mean', 'avg'), ('std', 'stddev_samp')))} from me group by all")
def summary_stats(spark, d):
    told = va.summary(metrics(spark, d), list(STATS))
    return told.select("validation", "model", *[r6(f"{c}_{n}") for c in STATS for n in ("median", "mean", "std")])


@query(
    f"""with {MEDIANS}, lo as (select case when i % 2 = 0 then 'M0' else 'M1' end as model, avg((c2 > 0.5)::int::double) as significant_share from pt group by 1),
    wi as (select a.model, count(*) filter (a.rmse < b.rmse) as wins, count(*) as designs, median(a.coverage) as coverage_median from md a join md b on b.validation = a.validation and b.model = 'M0' group by a.model)
    select wi.model, wins, designs, {r('coverage_median')}, {r('significant_share')}, coverage_median >= 0.2 as coverage_reached from wi left join lo on lo.model = wi.model"""
)
def gates(spark, d):
    local = points(spark, d).select(F.when(F.col("i") % 2 == 0, "M0").otherwise("M1").alias("model"), F.when(F.col("c2") > 0.5, "HH").otherwise("NS").alias("cluster"))
    told = va.gates(metrics(spark, d), local, 0.2)
    return told.select("model", "wins", "designs", r6("coverage_median"), r6("significant_share"), "coverage_reached")


@query()
def ridge_cv(spark, d):
    rows = []
    design = va.Design("fine", "spatial", 3, 4, 4)
    for fold, train, test in va.splits(points(spark, d), design, SEED):
        best, _, _ = md.tune("M0", train, design, {"alpha": [0.1, 1.0, 10.0]}, ["c1", "c2"], "target", {}, SEED)
        told = va.regression_metrics(md.fit_predict("M0", best, train, test, ["c1", "c2"], "target", {}, SEED), truth="target").first()
        rows.append((fold, best["alpha"], told.rmse, told.mae, told.r2))
    return spark.createDataFrame(rows, "fold int, alpha double, rmse double, mae double, r2 double")


@query()
def rf_cv(spark, d):
    p, rows = points(spark, d), []
    train, test = p.where("i % 4 <> 0"), p.where("i % 4 = 0")
    for model in ("M1", "M2U", "M3"):
        told = md.fit_predict(model, {"n_estimators": 5, "max_depth": 6}, train, test, ["c1", "c2"], "target", {"k": KNN, "n_components": 4}, SEED)
        rows.append((model, *va.regression_metrics(told, truth="target").first()))
    return spark.createDataFrame(rows, "model string, rmse double, mae double, r2 double")


# ---- tables --------------------------------------------------------------------------------


@query("select n_nationkey, " + ", ".join(f"(n_regionkey = {k})::int::double as region_{k}" for k in range(5)) + " from nation")
def one_hot(spark, d):
    return t(spark, d, "nation").select("n_nationkey", *[(F.col("n_regionkey") == k).cast("double").alias(f"region_{k}") for k in range(5)])


@query(f"select p_partkey, {r('p_size * 2.0', 'area')}, {r('2 * (p_size + 2.0)', 'perimeter')}, {r('4 * pi() * (p_size * 2.0) / greatest(power(2 * (p_size + 2.0), 2), 1e-12)', 'compactness')}, {r('ln(1 + p_retailprice)', 'log_price')} from part")
def compactness_features(spark, d):
    from .operators.geometry import box, compactness, measures

    boxes = t(spark, d, "part").select("p_partkey", "p_retailprice", box(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.lit(2.0)).alias("geom"))
    told = measures(boxes)
    return told.select("p_partkey", r6("area"), r6("perimeter"), r6(compactness(F.col("area"), F.col("perimeter")), "compactness"), r6(F.log1p("p_retailprice"), "log_price"))


@query(f"with {MEDIANS} select model, {', '.join(r(f'''max(rmse) filter (validation = '{v}')''', v) for v in ('coarse', 'fine', 'random'))} from md group by model")
def pivot_rmse(spark, d):
    told = metrics(spark, d).groupBy("model").pivot("validation", ["coarse", "fine", "random"]).agg(F.median("rmse"))
    return told.select("model", *[r6(v) for v in ("coarse", "fine", "random")])


@query(f"with {METRICS} select validation, model, count(*) as folds, {r('median(rmse)', 'rmse')} from (select * from me where fold < 3 union all select * from me where fold >= 3) group by all")
def union_runs(spark, d):
    m = metrics(spark, d)
    runs = m.where("fold < 3").unionByName(m.where("fold >= 3"))
    return runs.groupBy("validation", "model").agg(F.count("*").alias("folds"), r6(F.median("rmse"), "rmse"))


@query(f"with {U}, {ROOK} select i, j, 1.0::double as weight from b")
def polygon_contiguity(spark, d):
    from .operators.geometry import box, polygon_contiguity

    u = units(spark, d).withColumn("geom", box(F.col("col").cast("double"), F.col("row").cast("double"), F.col("col") + 1.0, F.col("row") + 1.0))
    return polygon_contiguity(u, "rook")


@query("select 25::bigint as geometries, 1.0::double as area_min, 1.0::double as area_median, 1.0::double as area_max, 0.0::double as xmin, 0.0::double as ymin, 5.0::double as xmax, 5.0::double as ymax")
def spatial_metrics(spark, d):
    from .operators.geometry import box, spatial_metrics

    u = units(spark, d).withColumn("geom", box(F.col("col").cast("double"), F.col("row").cast("double"), F.col("col") + 1.0, F.col("row") + 1.0))
    return spatial_metrics(u)
