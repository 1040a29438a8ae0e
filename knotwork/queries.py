"""The engine's registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import families as fam
from .functions.basis import bspline_columns, tensor_columns, truncated_power
from .functions.links import LOG, Identity, LOGb, Logit
from .operators import encode as enc
from .operators.cluster import bin_counts, bin_edges, cluster_series
from .operators.partials import Block, cross_pairs, gather
from .plans import inference
from .plans.gamm import GAMM
from .plans.hazard import PropHaz, cumulative_hazard, next_time
from .plans.hsmm import HSMM, HSMMFamily
from .plans.joint import GAMMLSS, GSMM, Adapter, MultiGauss
from .plans.terms import Formula, f, fs, i, irf, l, lhs, li, ri, rs
from .registry import QUERIES, SQL, frame, query, table


def smooth_response() -> Column:
    """A response with a signal: sine of the quantity, slope in the discount, stored digits as noise."""
    return 10 * F.sin(F.col("l_quantity") / 8.0) + 20 * F.col("l_discount") + F.pmod("l_extendedprice", F.lit(100.0)) / 25.0


def signal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("y", smooth_response())


# scans and encoding ---------------------------------------------------------------------------------
@query("select distinct l_returnflag as level, cast(dense_rank() over (order by l_returnflag) - 1 as integer) as code from lineitem")
def encode_levels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem")
    e = enc.learn(d, ["l_returnflag"])
    return enc.code(d.select("l_returnflag"), "l_returnflag", e.levels["l_returnflag"], "code").distinct().select(F.col("l_returnflag").alias("level"), "code")


@query("select count(*) as total, count(*) filter (event_id % 17 <> 0 and event_type is not null) as kept from events")
def na_mask_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    return d.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(enc.na_mask(d, ["v", "event_type"]), 1)).alias("kept"))


@query("select 'l_quantity' as variable, min(l_quantity) as low, max(l_quantity) as high from lineitem union all select 'l_discount', min(l_discount), max(l_discount) from lineitem")
def variable_ranges(spark: SparkSession, sf: str) -> DataFrame:
    e = enc.learn(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    return frame(spark, pd.DataFrame([(v, *r) for v, r in e.ranges.items()], columns=["variable", "low", "high"]))


# model matrices -------------------------------------------------------------------------------------
@query("""select 'Intercept' as name, cast(count(*) as double) as total from lineitem
union all select 'l_returnflag_N', cast(count(*) filter (l_returnflag = 'N') as double) from lineitem
union all select 'l_returnflag_R', cast(count(*) filter (l_returnflag = 'R') as double) from lineitem
union all select 'l_linestatus_O', cast(count(*) filter (l_linestatus = 'O') as double) from lineitem
union all select 'l_returnflag_N_l_linestatus_O', cast(count(*) filter (l_returnflag = 'N' and l_linestatus = 'O') as double) from lineitem
union all select 'l_returnflag_R_l_linestatus_O', cast(count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') as double) from lineitem""")
def design_onehot_interaction(spark: SparkSession, sf: str) -> DataFrame:
    from .plans import spec

    d = table(spark, sf, "lineitem")
    formula = Formula(lhs("l_quantity"), [i(), li(["l_returnflag", "l_linestatus"])])
    model = GAMM(formula)
    model.designs = [spec.build(d, formula, enc.learn(d, formula.variables()))]
    names = frame(spark, pd.DataFrame({"k": range(model.designs[0].n_coef), "name": model.designs[0].names}))
    flat = model.get_mmat(d).select(F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy(F.col("e.idx").alias("k")).agg(F.sum("e.val").alias("total"))
    return names.join(flat, "k", "left").select("name", F.coalesce("total", F.lit(0.0)).alias("total"))


@query("""with c as (select 1.0 as x0, l_quantity as x1, l_discount * 100 as x2, l_tax * 100 as x3, count(*) over () as n from lineitem)
select 0 as i, 0 as j, round(sum(x0*x0/n), 5) as v from c union all select 0, 1, round(sum(x0*x1/n), 5) from c union all select 0, 2, round(sum(x0*x2/n), 5) from c
union all select 0, 3, round(sum(x0*x3/n), 5) from c union all select 1, 1, round(sum(x1*x1/n), 5) from c union all select 1, 2, round(sum(x1*x2/n), 5) from c
union all select 1, 3, round(sum(x1*x3/n), 5) from c union all select 2, 2, round(sum(x2*x2/n), 5) from c union all select 2, 3, round(sum(x2*x3/n), 5) from c union all select 3, 3, round(sum(x3*x3/n), 5) from c""")
def ols_cross_product(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem")
    rows = d.select(F.array(*[F.lit(k) for k in range(4)]).alias("idx"), F.array(F.lit(1.0), "l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100).alias("val"))
    return cross_pairs(rows, "idx", "val").select("i", "j", F.round(F.col("v") / d.count(), 5).alias("v"))


@query("""select 'Intercept' as name, round(regr_intercept(y, l_quantity), 4) as estimate from (select l_quantity, 10*sin(l_quantity/8.0) + 20*l_discount as y from lineitem)
union all select 'l_quantity', round(regr_slope(y, l_quantity), 4) from (select l_quantity, 10*sin(l_quantity/8.0) + 20*l_discount as y from lineitem)""")
def ols_simple_fit(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumn("y", 10 * F.sin(F.col("l_quantity") / 8.0) + 20 * F.col("l_discount"))
    t = GAMM(Formula(lhs("y"), [i(), l(["l_quantity"])])).fit(d).coef_table()
    return frame(spark, t[["name", "estimate"]]).withColumn("estimate", F.round("estimate", 4))


_W = "(p_size - 1) / 7.0 - least(floor((p_size - 1) / 7.0), 6)"
_CUBICS = ("power(1 - w, 3) / 6", "(3*power(w, 3) - 6*power(w, 2) + 4) / 6", "(-3*power(w, 3) + 3*power(w, 2) + 3*w + 1) / 6", "power(w, 3) / 6")


@query("with u as (select p_partkey, cast(least(floor((p_size - 1) / 7.0), 6) as integer) as c, " + _W + " as w from part) " + " union all ".join(f"select p_partkey, c + {k} as k, round({e}, 8) as value from u" for k, e in enumerate(_CUBICS)))
def bspline_basis_rows(spark: SparkSession, sf: str) -> DataFrame:
    first, values = bspline_columns(F.col("p_size").cast("double"), 1.0, 50.0, 10)
    return table(spark, sf, "part").select("p_partkey", first.alias("c"), F.posexplode(values)).select("p_partkey", (F.col("c") + F.col("pos")).alias("k"), F.round("col", 8).alias("value"))


def _quantity_basis(spark: SparkSession, sf: str, nk: int = 10) -> DataFrame:
    first, values = bspline_columns(F.col("l_quantity"), 1.0, 50.0, nk)
    d = table(spark, sf, "lineitem")
    return d.select("l_discount", first.alias("c"), values.alias("val")).withColumn("idx", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: k + F.col("c")))


@query("with u as (select least(floor((l_quantity - 1) / 7.0), 6) as c, (l_quantity - 1) / 7.0 - least(floor((l_quantity - 1) / 7.0), 6) as w, count(*) over () as n from lineitem) select k, round(sum(v / n), 6) as share from (" + " union all ".join(f"select cast(c as integer) + {k} as k, {e} as v, n from u" for k, e in enumerate(_CUBICS)) + ") group by k")
def constraint_colsum(spark: SparkSession, sf: str) -> DataFrame:
    rows = _quantity_basis(spark, sf)
    n = rows.count()
    return rows.select(F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy(F.col("e.idx").alias("k")).agg(F.round(F.sum(F.col("e.val") / n), 6).alias("share"))


def _gram_sql() -> str:
    pairs = [f"select cast(c as integer) + {a} as i, cast(c as integer) + {b} as j, ({_CUBICS[a]}) * ({_CUBICS[b]}) / n as v from u" for a in range(4) for b in range(a, 4)]
    return "with u as (select least(floor((l_quantity - 1) / 7.0), 6) as c, (l_quantity - 1) / 7.0 - least(floor((l_quantity - 1) / 7.0), 6) as w, count(*) over () as n from lineitem) select i, j, round(sum(v), 6) as v from (" + " union all ".join(pairs) + ") group by i, j"


@query(_gram_sql())
def bspline_gram(spark: SparkSession, sf: str) -> DataFrame:
    rows = _quantity_basis(spark, sf)
    n = rows.count()
    return cross_pairs(rows, "idx", "val").select("i", "j", F.round(F.col("v") / n, 6).alias("v"))


@query("with u as (select least(floor((l_quantity - 1) / 7.0), 6) as c, (l_quantity - 1) / 7.0 - least(floor((l_quantity - 1) / 7.0), 6) as w, l_discount * 10 as d, count(*) over () as n from lineitem) select k, m, round(sum(v / n), 6) as share from (" + " union all ".join(f"select cast(c as integer) + {k} as k, {m} as m, ({e}) * {g} as v, n from u" for k, e in enumerate(_CUBICS) for m, g in enumerate(("(1 - d)", "d"))) + ") group by k, m")
def tensor_basis(spark: SparkSession, sf: str) -> DataFrame:
    rows = _quantity_basis(spark, sf)
    n, d = rows.count(), F.col("l_discount") * 10
    both = rows.select("c", tensor_columns(F.col("val"), F.array(1 - d, d), (4, 2)).alias("val"))
    # summed by first basis function before the eight products are spread
    part = both.groupBy("c").agg(*[F.sum(F.col("val")[k] / n).alias(f"v{k}") for k in range(8)])
    flat = part.select("c", F.posexplode(F.array(*[f"v{k}" for k in range(8)])).alias("pos", "v"))
    return flat.groupBy((F.col("c") + F.floor(F.col("pos") / 2)).cast("int").alias("k"), (F.col("pos") % 2).alias("m")).agg(F.round(F.sum("v"), 6).alias("share"))


@query("select p_partkey, round(case when p_size > 20 then power((p_size - 20) / 10.0, 3) else 0 end, 6) as value from part")
def truncated_power_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(truncated_power(F.col("p_size") / 10.0, 2.0, 3), 6).alias("value"))


# aggregates of families and links -------------------------------------------------------------------
@query("""select round(avg(ln(m / (1 - m))), 6) as logit, round(avg(1 / (1 + exp(-(ln(m / (1 - m)))))), 6) as back, round(avg(ln(l_quantity)), 6) as log, round(avg(ln(l_quantity - 0.0001)), 6) as logb,
round(avg(1 / (m * (1 - m))), 5) as logit_1, round(avg((2*m - 1) / (m*m*(1-m)*(1-m)) / 100), 5) as logit_2, round(avg(-1 / (l_quantity * l_quantity)), 6) as log_2 from (select l_quantity, l_quantity / 51.0 as m from lineitem)""")
def link_functions(spark: SparkSession, sf: str) -> DataFrame:
    m, q = F.col("l_quantity") / 51.0, F.col("l_quantity")
    lo, lg, lb = Logit(), LOG(), LOGb()
    return table(spark, sf, "lineitem").agg(*[F.round(F.avg(e), n).alias(a) for e, n, a in ((lo.f(m), 6, "logit"), (lo.fi(lo.f(m)), 6, "back"), (lg.f(q), 6, "log"), (lb.f(q), 6, "logb"), (lo.dy1(m), 5, "logit_1"), (lo.dy2(m) / 100, 5, "logit_2"), (lg.dy2(q), 6, "log_2"))])


@query("""with d as (select l_quantity as y, 10 + 30 * l_discount * 10 as mu, case when l_returnflag = 'A' then 1.0 else 0.0 end as b, 0.2 + l_discount * 5 as p, count(*) over () as n from lineitem)
select round(sum((y-mu)*(y-mu)/n), 5) as gaussian,
round(sum(2*(case when b > 0 then b*ln(b/p) else 0 end + case when 1-b > 0 then (1-b)*ln((1-b)/(1-p)) else 0 end)/n), 6) as binomial,
round(sum(2*(y*ln(y/mu) - (y-mu))/n), 5) as poisson, round(sum(2*((y-mu)/mu - ln(y/mu))/n), 6) as gamma,
round(sum((y-mu)*(y-mu)/(mu*mu*y)/n), 6) as invgauss, round(sum((exp(1.0)+3+1)*ln(1+((y-mu)/exp(2.0))*((y-mu)/exp(2.0))/(exp(1.0)+3))/n), 6) as scaledt from d""")
def deviances(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem")
    n = d.count()
    y, mu = F.col("l_quantity"), 10 + 30 * F.col("l_discount") * 10
    b, p = F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0), 0.2 + F.col("l_discount") * 5
    t = fam.ScaledT(theta=np.array([2.0, 1.0]))
    parts = (("gaussian", fam.Gaussian(), y, mu, 5), ("binomial", fam.Binomial(), b, p, 6), ("poisson", fam.Poisson(), y, mu, 5), ("gamma", fam.Gamma(), y, mu, 6), ("invgauss", fam.InvGauss(), y, mu, 6), ("scaledt", t, y, mu, 6))
    return d.agg(*[F.round(F.sum(g.D(a, m) / n), r).alias(name) for name, g, a, m, r in parts])


@query("""with d as (select case when event_type = 'error' then 1.0 else 0.0 end as y, 0.1 + value / 1000.0 as mu from events)
select round(avg((y - mu)/(mu*(1-mu)) + ln(mu/(1-mu))), 5) as z, round(avg(mu*(1-mu)), 6) as w, round(avg(mu*(1-mu)*((y - mu)/(mu*(1-mu)) + ln(mu/(1-mu)))), 5) as wz from d""")
def pirls_step(spark: SparkSession, sf: str) -> DataFrame:
    """The working response and weight that ``Binomial`` gives a weighted step."""
    y, mu = F.when(F.col("event_type") == "error", 1.0).otherwise(0.0), 0.1 + F.col("value") / 1000.0
    g = fam.Binomial()

    def work(v: Block) -> dict[str, list[float]]:
        z, w = g.working(v["y"], g.link.f(v["mu"]))
        return {"sums": [float(z.sum()), float(w.sum()), float((w * z).sum()), len(z)]}

    z, w, wz, n = gather(table(spark, sf, "events").select(y.alias("y"), mu.alias("mu")), work, {"sums": (4,)})["sums"]
    return frame(spark, pd.DataFrame([{"z": z / n, "w": w / n, "wz": wz / n}])).select(F.round("z", 5).alias("z"), F.round("w", 6).alias("w"), F.round("wz", 5).alias("wz"))


@query("""with d as (select event_type, value, lag(value) over (partition by user_id order by ts, event_id) as p from events)
select event_type, count(*) as n, round(avg(case when p is null then value else (value - 0.5*p)/sqrt(0.75) end), 4) as white from d group by event_type""")
def ar1_whitening(spark: SparkSession, sf: str) -> DataFrame:
    d = enc.lagged(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 1, "p")
    white = F.when(F.col("p").isNull(), F.col("value")).otherwise((F.col("value") - 0.5 * F.col("p")) / math.sqrt(0.75))
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(white), 4).alias("white"))


@query("""with d as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as k, user_id % 5 as onset from events)
select a.user_id, count(b.value) as n, round(sum(b.value), 3) as total from d a left join d b on a.user_id = b.user_id and a.k - a.onset = b.k group by a.user_id""")
def event_shift(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").withColumn("onset", F.col("user_id") % 5)
    return enc.lagged(d, "user_id", ["ts", "event_id"], "value", "onset", "p").groupBy("user_id").agg(F.count("p").alias("n"), F.round(F.sum("p"), 3).alias("total"))


_PER_TIME = """with s as (select user_id, cast(count(*) as double) as t, max(case when event_type = 'error' then 1 else 0 end) * (user_id % 3 > 0)::int as d, avg(value) / 245 - 1 as x from events group by user_id),
p as (select t, sum(d) as deaths, sum(exp(0.5 * x)) as own, sum(d * 0.5 * x) as lin from s group by t),
r as (select t, deaths, lin, sum(own) over (order by t desc) as risk from p),
h as (select t, deaths, lin, risk, sum(deaths / risk) over (order by t) as hazard from r)"""


def _survivors(spark: SparkSession, sf: str) -> DataFrame:
    died = F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)) * (F.col("user_id") % 3 > 0).cast("int")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("t"), died.alias("d"), (F.avg("value") / 245 - 1).alias("x"))


def _per_time(s: DataFrame) -> DataFrame:
    return s.groupBy(F.col("t").alias("time")).agg(F.sum(F.col("d").cast("double")).alias("deaths"), F.sum(F.exp(0.5 * F.col("x"))).alias("own"))


@query(_PER_TIME + " select round(sum(lin - deaths * ln(risk)), 4) as llk from h")
def cox_partial_llk(spark: SparkSession, sf: str) -> DataFrame:
    s = _survivors(spark, sf)
    h = cumulative_hazard(_per_time(s)).agg(F.sum(F.col("deaths") * F.log("risk")).alias("log"))
    lin = s.agg(F.sum(F.col("d") * 0.5 * F.col("x")).alias("lin"))
    return lin.join(F.broadcast(h)).select(F.round(F.col("lin") - F.col("log"), 4).alias("llk"))  # one row each


@query(_PER_TIME + " select t as time, deaths, round(risk, 5) as risk, round(hazard, 6) as hazard from h")
def baseline_hazard(spark: SparkSession, sf: str) -> DataFrame:
    return cumulative_hazard(_per_time(_survivors(spark, sf))).select("time", "deaths", F.round("risk", 5).alias("risk"), F.round("hazard", 6).alias("hazard"))


@query(_PER_TIME + " select user_id, round(exp(-hazard * exp(0.5 * x)), 6) as survival from (select s.user_id, s.x, case when s.t - 0.5 > (select max(t) from h) then (select hazard from h order by t desc limit 1) else (select hazard from h where h.t >= s.t - 0.5 order by h.t limit 1) end as hazard from s)")
def survival_asof(spark: SparkSession, sf: str) -> DataFrame:
    s = _survivors(spark, sf)
    table_ = cumulative_hazard(_per_time(s)).select("time", "hazard")
    met = next_time(s.withColumn("at", F.col("t") - 0.5), table_, "at")
    return met.select("user_id", F.round(F.exp(-F.col("hazard") * F.exp(0.5 * F.col("x"))), 6).alias("survival"))


@query("""with d as (select case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as y, value / 245 - 1 as x from events),
e as (select y, x, ln(1 + exp(0.2*x) + exp(0.4*x) + exp(0.6*x) + exp(0.8*x)) as z from d) select round(avg(0.2 * y * x - z), 6) as llk from e""")
def softmax_llk(spark: SparkSession, sf: str) -> DataFrame:
    y, family = F.lit(4.0), fam.MULNOMLSS(4)
    for k, c in enumerate(["click", "error", "purchase", "signup"]):
        y = F.when(F.col("event_type") == c, float(k)).otherwise(y)
    rows = table(spark, sf, "events").select(y.alias("y"), (F.col("value") / 245 - 1).alias("x"))
    total, n = gather(rows, lambda v: {"sums": [family.llk(v["y"], *(0.2 * k * v["x"] for k in range(1, 5))), len(v["y"])]}, {"sums": (2,)})["sums"]
    return frame(spark, pd.DataFrame([{"llk": total / n}])).select(F.round("llk", 6).alias("llk"))


@query("select round(avg(ln(0.05) + ln(2.0) - 0.5*(power(0.05*(l_quantity-25) + 0.3*(l_discount-0.05)*20, 2) + power(2*(l_discount-0.05)*20, 2))), 6) as llk from lineitem")
def mvn_llk(spark: SparkSession, sf: str) -> DataFrame:
    family = MultiGauss(2, [Identity(), Identity()])
    coef, one = np.array([25.0, 1.0, math.log(0.05), 0.3, math.log(2.0)]), lambda v: [np.ones((len(v["a"]), 1))] * 2
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 20).alias("b"))
    total, n = gather(rows, lambda v: {"sums": [family.llk(coef, [0, 1, 2], [v["a"], v["b"]], one(v)), len(v["a"])]}, {"sums": (2,)})["sums"]
    return frame(spark, pd.DataFrame([{"llk": total / n}])).select(F.round("llk", 6).alias("llk"))


@query("select user_id, 'value' as variable, cast(least(floor((value - (select min(value) from events)) / (((select max(value) from events) - (select min(value) from events)) / 8)), 7) as integer) as bin, count(*) as n from events group by 1, 2, 3")
def kmeans_bin_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events")
    return bin_counts(d, "user_id", bin_edges(d, ["value"], {"value": 8}))


@query("select 'o_orderpriority_' || o_orderpriority as name, round(sum((o_totalprice - 250000) / 1000) / (count(*) + 5.0), 5) as estimate from orders group by o_orderpriority")
def ranef_shrunk_means(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").withColumn("y", (F.col("o_totalprice") - 250000) / 1000)
    t = GAMM(Formula(lhs("y"), [ri("o_orderpriority")])).fit(d, lam=5.0, fixed_lam=True).coef_table()
    return frame(spark, t[["name", "estimate"]]).withColumn("estimate", F.round("estimate", 5))


# fits -----------------------------------------------------------------------------------------------
def _summary(spark: SparkSession, model, **more) -> DataFrame:  # noqa: ANN001, ANN003
    """Coefficients with the fit's numbers beside them."""
    t = model.coef_table()
    info = {k: float(v) for k, v in model.info().items() if k in ("edf", "scale", "llk", "reml", "converged")} | {k: float(v) for k, v in more.items()}
    return frame(spark, t.assign(**info))


def _binary(d: DataFrame) -> DataFrame:
    return d.withColumn("b", (F.pmod("l_extendedprice", F.lit(100.0)) / 100 < 1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 10))).cast("double"))


@query()
def gamm_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    d = signal(spark, sf)
    return _summary(spark, GAMM(Formula(lhs("y"), [i(), l(["l_returnflag"]), f(["l_quantity"]), f(["l_discount"], nk=5)])).fit(d))


@query()
def gamm_tensor(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, GAMM(Formula(lhs("y"), [i(), f(["l_quantity", "l_discount"], te=True)])).fit(signal(spark, sf)))


@query()
def gamm_by_factor(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "A", F.sin(F.col("l_quantity") / 8)).otherwise(F.cos(F.col("l_quantity") / 8)) + F.pmod("l_extendedprice", F.lit(100.0)) / 100)
    return _summary(spark, GAMM(Formula(lhs("y"), [i(), l(["l_returnflag"]), f(["l_quantity"], by="l_returnflag"), rs(["l_discount"], by="l_linestatus")])).fit(d))


@query()
def gamm_factor_smooth(spark: SparkSession, sf: str) -> DataFrame:
    d = signal(spark, sf).withColumn("k", F.pmod("l_suppkey", F.lit(10)).cast("string"))
    return _summary(spark, GAMM(Formula(lhs("y"), [i(), f(["l_quantity"]), fs(["l_quantity"], rf="k", nk=5), ri("k")])).fit(d))


@query()
def gamm_binomial(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, GAMM(Formula(lhs("b"), [i(), f(["l_quantity"])]), fam.Binomial()).fit(_binary(table(spark, sf, "lineitem"))))


@query()
def gamm_poisson(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, GAMM(Formula(lhs("l_quantity"), [i(), f(["l_discount"], nk=5)]), fam.Poisson()).fit(table(spark, sf, "lineitem")))


@query()
def gamm_gamma(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").withColumn("hour", F.hour("ts").cast("double"))
    return _summary(spark, GAMM(Formula(lhs("value"), [i(), f(["hour"]), l(["event_type"])]), fam.Gamma()).fit(d))


@query()
def gamm_inverse_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").withColumn("y", F.col("o_totalprice") / 1000 + 50)
    return _summary(spark, GAMM(Formula(lhs("y"), [i(), l(["o_orderpriority"])]), fam.InvGauss()).fit(d))


@query()
def gamm_scaled_t(spark: SparkSession, sf: str) -> DataFrame:
    model = GAMM(Formula(lhs("y"), [i(), f(["l_quantity"])]), fam.ScaledT())
    return _summary(spark, model.fit(signal(spark, sf), max_outer=60), theta0=model.family.theta[0], theta1=model.family.theta[1])


@query()
def gamm_ar1(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").withColumn("hour", F.hour("ts").cast("double"))
    return _summary(spark, GAMM(Formula(lhs("value"), [i(), f(["hour"])], series="user_id", order=["ts", "event_id"])).fit(d, rho=0.3))


@query()
def gamm_impulse(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("double")
    d = table(spark, sf, "events").withColumns({"k": place, "onset": F.col("user_id") % 7})
    return _summary(spark, GAMM(Formula(lhs("value"), [i(), irf(["k"], onset="onset", nk=6)], series="user_id", order=["ts", "event_id"])).fit(d))


@query()
def gammlss_normal(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, GAMMLSS([Formula(lhs("y"), [i(), f(["l_quantity"])]), Formula(None, [i(), l(["l_discount"])])], fam.GAUMLSS()).fit(signal(spark, sf)))


@query()
def gammlss_gamma(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").withColumn("y", F.col("value") / 100 + 0.1)
    return _summary(spark, GAMMLSS([Formula(lhs("y"), [i(), l(["event_type"])]), Formula(None, [i()])], fam.GAMMALS()).fit(d))


@query()
def gammlss_multinomial(spark: SparkSession, sf: str) -> DataFrame:
    y = F.when(F.col("event_type") == "click", 0.0).when(F.col("event_type") == "error", 1.0).otherwise(2.0)
    d = table(spark, sf, "events").withColumns({"y": y, "x": F.col("value") / 100})
    return _summary(spark, GAMMLSS([Formula(lhs("y"), [i(), l(["x"])]), Formula(None, [i(), l(["x"])])], fam.MULNOMLSS(2)).fit(d))


@query()
def gsmm_multivariate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumns({"a": F.col("l_quantity") / 10, "b": F.col("l_tax") * 20})
    return _summary(spark, GSMM([Formula(lhs("a"), [i(), l(["l_discount"])]), Formula(lhs("b"), [i()])], MultiGauss(2, [Identity(), Identity()])).fit(d))


@query()
def gsmm_quasi_newton(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumn("a", F.col("l_quantity") / 10)
    return _summary(spark, GSMM([Formula(lhs("a"), [i(), l(["l_discount"])]), Formula(None, [i()])], Adapter(fam.GAUMLSS())).fit(d, method="qEFS", lam=1.0))


@query()
def cox_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, PropHaz(Formula(lhs("t"), [f(["x"], nk=5)]), "d").fit(_survivors(spark, sf)))


@query()
def cox_residuals(spark: SparkSession, sf: str) -> DataFrame:
    s = _survivors(spark, sf)
    return PropHaz(Formula(lhs("t"), [l(["x"])]), "d").fit(s).get_resid(s).select("user_id", "resid")


@query()
def predict_intervals(spark: SparkSession, sf: str) -> DataFrame:
    d = signal(spark, sf)
    model = GAMM(Formula(lhs("y"), [i(), f(["l_quantity"])])).fit(d)
    grid = spark.range(1, 51).select(F.col("id").cast("double").alias("l_quantity"))
    return model.predict(grid, ci=True, whole_interval=True, n_ps=500, seed=1)


@query()
def predict_difference(spark: SparkSession, sf: str) -> DataFrame:
    d = signal(spark, sf)
    model = GAMM(Formula(lhs("y"), [i(), l(["l_returnflag"]), f(["l_quantity"], by="l_returnflag")])).fit(d)
    grid = spark.range(1, 51).select("id", F.col("id").cast("double").alias("l_quantity"))
    return model.predict_diff(grid.withColumn("l_returnflag", F.lit("A")), grid.withColumn("l_returnflag", F.lit("R")), ["id"])


@query()
def residuals(spark: SparkSession, sf: str) -> DataFrame:
    d = signal(spark, sf)
    return GAMM(Formula(lhs("y"), [i(), f(["l_quantity"])])).fit(d).get_resid(d, keep=["l_orderkey", "l_linenumber"])


@query()
def smooth_tests(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, inference.smooth_p_values(GAMM(Formula(lhs("y"), [i(), f(["l_quantity"]), f(["l_tax"], nk=5)])).fit(signal(spark, sf))))


@query()
def parametric_tests(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, inference.summary_parametric(GAMM(Formula(lhs("y"), [i(), l(["l_returnflag"]), l(["l_discount"])])).fit(signal(spark, sf))))


@query()
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    d = signal(spark, sf)
    one, two = (GAMM(Formula(lhs("y"), [i(), f(["l_quantity"]), *extra])).fit(d) for extra in ([f(["l_discount"], nk=5)], []))
    return frame(spark, pd.DataFrame([{k: float(v) for k, v in inference.compare_CDL(one, two, perform_GLRT=True).items()}]))


@query()
def posterior_summary(spark: SparkSession, sf: str) -> DataFrame:
    model = GAMM(Formula(lhs("y"), [i(), f(["l_quantity"], nk=5)])).fit(signal(spark, sf))
    return frame(spark, inference.convergence(inference.sample_posterior(model, spark, chains=2, draws=100, adapt=100)))


def _hsmm(spark: SparkSession, sf: str) -> tuple[HSMM, DataFrame]:
    d = table(spark, sf, "events").withColumn("y", F.log("value"))
    key = {"series": "user_id", "order": ["ts", "event_id"]}
    family = HSMMFamily(2, [fam.GAUMLSS()], 12, move=np.array([[0.0, 1.0], [1.0, 0.0]]), first=np.array([0.5, 0.5]))
    model = HSMM([Formula(lhs("y"), [i()], **key)] + [Formula(None, [i()], **key) for _ in range(7)], family)
    return model.fit(d, init_coef=np.array([4.0, 0.0, 5.5, -0.5, 1.0, -1.0, 1.0, -1.0])), d


@query()
def hsmm_fit(spark: SparkSession, sf: str) -> DataFrame:
    model = _hsmm(spark, sf)[0]
    return _summary(spark, model)


@query()
def hsmm_viterbi(spark: SparkSession, sf: str) -> DataFrame:
    model, d = _hsmm(spark, sf)
    return model.each(d, "viterbi")


@query()
def hsmm_residuals(spark: SparkSession, sf: str) -> DataFrame:
    model, d = _hsmm(spark, sf)
    return model.each(d, "forward")


@query()
def series_clusters(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events")
    return cluster_series(d, "user_id", bin_edges(d, ["value"], {"value": 6}), k=5, restarts=2)[0]


from . import closed_forms  # noqa: E402, F401  registers its queries


def entry(spark: SparkSession) -> DataFrame:
    return gamm_gaussian(spark, "/root/testdata/sf0.001")
