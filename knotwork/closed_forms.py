"""Registered queries that fit models with a closed form, which SQL can state: saturated and linear models,
likelihoods at given coefficients, and conditions that every fit meets at its end (SQL: zeros)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import families as fam
from .functions import special as sp
from .functions.basis import difference_penalty, natural, null_penalty, sum_to_zero
from .functions.linalg import penalty_logdet
from .functions.links import Identity
from .operators.partials import cross_pairs, gather
from .plans import inference
from .plans import solve as S
from .plans.gamm import GAMM
from .plans.hazard import PropHaz
from .plans.joint import GAMMLSS, GSMM, Adapter, MultiGauss
from .plans.terms import Formula, f, i, l, lhs, ri, rs
from .registry import frame, query, table
from .sources import readers

_Y = "10*sin(l_quantity/8.0) + 20*l_discount"
#: Sums of the straight line y ~ l_quantity.
_LINE = f"""with d as (select l_quantity as x, {_Y} as y, l_returnflag from lineitem),
s as (select count(*) as n, avg(x) as mx, regr_sxx(y, x) as sxx, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) as rss, regr_syy(y, x) as syy, avg(y) as my from d),
t as (select *, rss / (n - 2) as phi from s)"""


def _rounded(d: DataFrame, places: int, *names: str) -> DataFrame:
    """``names`` rounded, without a negative zero."""
    return d.withColumns({c: F.round(c, places) + F.lit(0.0) for c in names})


def _line(spark: SparkSession, sf: str) -> tuple[DataFrame, GAMM]:
    d = table(spark, sf, "lineitem").withColumn("y", 10 * F.sin(F.col("l_quantity") / 8.0) + 20 * F.col("l_discount"))
    return d, GAMM(Formula(lhs("y"), [i(), l(["l_quantity"])])).fit(d)


# straight line ----------------------------------------------------------------------------------------
@query(_LINE + """ select 'Intercept' as name, round(a, 4) as estimate, round(sqrt(phi * (1.0/n + mx*mx/sxx)), 5) as se, round(a / sqrt(phi * (1.0/n + mx*mx/sxx)), 2) as statistic from t
union all select 'l_quantity', round(b, 4), round(sqrt(phi / sxx), 5), round(b / sqrt(phi / sxx), 2) from t""")
def line_tests(spark: SparkSession, sf: str) -> DataFrame:
    got = frame(spark, inference.summary_parametric(_line(spark, sf)[1])[["name", "estimate", "se", "statistic"]])
    return _rounded(_rounded(_rounded(got, 4, "estimate"), 5, "se"), 2, "statistic")


@query(_LINE + " select 'Intercept' as name, round(a, 4) as estimate from t union all select 'l_quantity', round(b, 4) from t")
def line_by_qr(spark: SparkSession, sf: str) -> DataFrame:
    """The straight line by a tall-skinny QR decomposition of the rows."""
    d = table(spark, sf, "lineitem").withColumn("y", 10 * F.sin(F.col("l_quantity") / 8.0) + 20 * F.col("l_discount"))
    model = GAMM(Formula(lhs("y"), [i(), l(["l_quantity"])])).fit(d.repartition(20, "l_orderkey"), method="QR")
    return _rounded(frame(spark, model.coef_table()[["name", "estimate"]]), 4, "estimate")


@query(_LINE + " select 'Intercept' as name, round(a, 2) as estimate from t union all select 'l_quantity', round(b, 3) from t union all select 'deviation', round(sqrt(rss / n), 3) from t")
def line_by_quasi_newton(spark: SparkSession, sf: str) -> DataFrame:
    """The straight line and the residuals' deviation by limited-memory steps, without second derivatives."""
    d = table(spark, sf, "lineitem").withColumns({"y": 10 * F.sin(F.col("l_quantity") / 8.0) + 20 * F.col("l_discount"), "x": F.col("l_quantity") / 10 - 2.5})
    coef = GSMM([Formula(lhs("y"), [i(), l(["x"])]), Formula(None, [i()])], Adapter(fam.GAUMLSS())).fit(d, method="qEFS", conv_tol=1e-12, max_inner=80).fitted.coef
    found = [coef[0] - 2.5 * coef[1], coef[1] / 10, np.exp(coef[2]) + 0.0001]
    return frame(spark, pd.DataFrame({"name": ["Intercept", "l_quantity", "deviation"], "estimate": [round(found[0], 2), round(found[1], 3), round(found[2], 3)]}))


@query(_LINE + """ select round(2.0, 4) as edf, round(phi, 4) as scale, round(rss / n, 4) as deviance, round((-0.5*n*ln(2*pi()*phi) - 0.5*rss/phi) / n, 6) as llk,
round((-0.5*n*ln(2*pi()*phi) - 0.5*rss/phi - 0.5*(ln(n*sxx) - 2*ln(phi)) + ln(2*pi())) / n, 6) as reml from t""")
def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    fit = _line(spark, sf)[1].fitted
    row = {"edf": fit.edf, "scale": fit.scale, "deviance": fit.deviance / fit.n, "llk": fit.llk / fit.n, "reml": fit.reml / fit.n}
    return _rounded(_rounded(frame(spark, pd.DataFrame([row])), 4, "edf", "scale", "deviance"), 6, "llk", "reml")


@query(_LINE + """, g as (select cast(x as double) as x from range(1, 51) r(x)), p as (select x, a + b*x as fit, sqrt(phi * (1.0/n + (x-mx)*(x-mx)/sxx)) as se from g, t)
select x as l_quantity, round(fit, 4) as fit, round(se, 4) as se, round(fit - 1.959963984540054*se, 4) as lower, round(fit + 1.959963984540054*se, 4) as upper from p""")
def line_prediction(spark: SparkSession, sf: str) -> DataFrame:
    model = _line(spark, sf)[1]
    grid = spark.range(1, 51).select(F.col("id").cast("double").alias("l_quantity"))
    return _rounded(model.predict(grid, ci=True), 4, "fit", "se", "lower", "upper")


@query(_LINE + """ select cast(x as bigint) as id, round(-b * x, 4) as diff, round(x * sqrt(phi / sxx), 5) as se from t, range(1, 11) r(x)""")
def line_difference(spark: SparkSession, sf: str) -> DataFrame:
    model = _line(spark, sf)[1]
    one, two = (spark.range(1, 11).select("id", (20.0 + k * F.col("id")).alias("l_quantity")) for k in (0, 1))
    return _rounded(_rounded(model.predict_diff(one, two, ["id"]).select("id", "diff", "se"), 4, "diff"), 5, "se")


@query(_LINE + " select l_returnflag, round(avg(a + b*x), 4) as fit, round(avg(y - a - b*x), 4) as resid, round(avg((y - a - b*x) * (y - a - b*x)), 4) as square from d, t group by l_returnflag")
def line_residuals(spark: SparkSession, sf: str) -> DataFrame:
    d, model = _line(spark, sf)
    got = model.get_resid(d, keep=["l_returnflag"]).groupBy("l_returnflag").agg(F.avg("fit").alias("fit"), F.avg("resid").alias("resid"), F.avg(F.col("resid") * F.col("resid")).alias("square"))
    return _rounded(got, 4, "fit", "resid", "square")


@query(_LINE + """, v as (select n, phi, rss, syy, syy / (n - 1) as phi0, -0.5*n*ln(2*pi()*phi) - 0.5*(n-2) as l1, -0.5*n*ln(2*pi()*syy/(n-1)) - 0.5*(n-1) as l0 from t)
select round(l1 / n, 6) as llk1, round(l0 / n, 6) as llk2, round((-2*l1 + 2*l0 + 2) / n, 6) as aic_diff, round((syy - rss) / phi / n, 6) as test_stat, round(1.0, 4) as dof_diff from v""")
def line_comparison(spark: SparkSession, sf: str) -> DataFrame:
    d, one = _line(spark, sf)
    two = GAMM(Formula(lhs("y"), [i()])).fit(d)
    got, n = inference.compare_CDL(one, two, correct_V=False, perform_GLRT=True), one.fitted.n
    row = {k: float(got[k]) / n for k in ("llk1", "llk2", "aic_diff", "test_stat")} | {"dof_diff": float(got["DOF_diff"])}
    return _rounded(_rounded(frame(spark, pd.DataFrame([row])), 6, "llk1", "llk2", "aic_diff", "test_stat"), 4, "dof_diff")


# random intercepts at a fixed lambda ---------------------------------------------------------------------
@query("""with g as (select o_orderpriority as k, count(*) as n, sum((o_totalprice - 250000) / 1000) as s, sum(((o_totalprice - 250000) / 1000) * ((o_totalprice - 250000) / 1000)) as ss from orders group by 1),
a as (select sum(n) as n, sum(n / (n + 5.0)) as edf, sum(ss - 2*s*s/(n+5.0) + n*s*s/((n+5.0)*(n+5.0))) as rss from g)
select 'o_orderpriority_' || k as name, round(s / (g.n + 5.0), 4) as estimate, round(sqrt(rss / (a.n - edf) / (g.n + 5.0)), 5) as se, round(edf, 5) as edf, round(rss / (a.n - edf), 3) as scale from g, a""")
def ridge_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").withColumn("y", (F.col("o_totalprice") - 250000) / 1000)
    model = GAMM(Formula(lhs("y"), [ri("o_orderpriority")])).fit(d, lam=5.0, fixed_lam=True)
    got = frame(spark, model.coef_table()[["name", "estimate", "se"]].assign(edf=model.fitted.edf, scale=model.fitted.scale))
    return _rounded(_rounded(_rounded(got, 4, "estimate"), 5, "se", "edf"), 3, "scale")


@query("select cast(row_number() over (order by l_linestatus) - 1 as integer) as k, round(sum(l_discount), 3) as total, round(sum(l_discount * l_discount), 4) as square from lineitem group by l_linestatus")
def slope_columns(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem")
    model = GAMM(Formula(lhs("l_quantity"), [rs(["l_discount"], by="l_linestatus")])).fit(d, lam=1.0, fixed_lam=True)
    flat = model.get_mmat(d).select(F.explode(F.arrays_zip("idx", "val")).alias("e")).select("e.idx", "e.val")
    return flat.groupBy(F.col("idx").alias("k")).agg(F.round(F.sum("val"), 3).alias("total"), F.round(F.sum(F.col("val") * F.col("val")), 4).alias("square"))


# saturated one-parameter models ----------------------------------------------------------------------------
def _groups(table_: str, y: str, factor: str, link: str, deviance: str) -> str:
    """Coefficients of ``y ~ factor`` with treatment contrasts, and the mean unit deviance."""
    return f"""with d as (select {y} as y, {factor} as k from {table_}), g as (select k, avg(y) as m, row_number() over (order by k) as r from d group by k),
e as (select k, r, {link} as eta from g), v as (select avg({deviance}) as dev from d join g using (k))
select case when r = 1 then 'Intercept' else '{factor}_' || k end as name, round(eta - case when r = 1 then 0 else (select eta from e where r = 1) end, 4) as estimate, round(dev, 5) as deviance from e, v"""


def _saturated(spark: SparkSession, d: DataFrame, factor: str, family: fam.Family) -> DataFrame:
    model = GAMM(Formula(lhs("y"), [i(), l([factor])]), family).fit(d, conv_tol=1e-10)
    got = frame(spark, model.coef_table()[["name", "estimate"]].assign(deviance=model.fitted.deviance / model.fitted.n))
    return _rounded(_rounded(got, 4, "estimate"), 5, "deviance")


@query(_groups("lineitem", "case when l_quantity > 20 + 10 * l_tax then 1.0 else 0.0 end", "l_returnflag", "ln(m / (1 - m))", "2 * (case when y > 0 then -ln(m) else -ln(1 - m) end)"))
def binomial_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumn("y", (F.col("l_quantity") > 20 + 10 * F.col("l_tax")).cast("double"))
    return _saturated(spark, d, "l_returnflag", fam.Binomial())


@query(_groups("lineitem", "l_quantity", "l_returnflag", "ln(m)", "2 * (y * ln(y / m) - (y - m))"))
def poisson_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _saturated(spark, table(spark, sf, "lineitem").withColumn("y", F.col("l_quantity")), "l_returnflag", fam.Poisson())


@query(_groups("events", "value + 1", "event_type", "ln(m)", "2 * ((y - m) / m - ln(y / m))"))
def gamma_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _saturated(spark, table(spark, sf, "events").withColumn("y", F.col("value") + 1), "event_type", fam.Gamma())


@query(_groups("orders", "o_totalprice / 1000 + 50", "o_orderpriority", "ln(m)", "(y - m) * (y - m) / (m * m * y)"))
def inverse_gaussian_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _saturated(spark, table(spark, sf, "orders").withColumn("y", F.col("o_totalprice") / 1000 + 50), "o_orderpriority", fam.InvGauss())


# autoregressive errors ---------------------------------------------------------------------------------
_WHITE = """with d as (select value, lag(value) over (partition by user_id order by ts, event_id) as p from events),
w as (select case when p is null then value else (value - 0.3*p)/sqrt(0.91) end as y, case when p is null then 1.0 else 0.7/sqrt(0.91) end as x from d),
b as (select sum(x*y) / sum(x*x) as b from w)"""


@query(_WHITE + " select count(*) as n, round(any_value(b), 4) as estimate, round(avg(y), 4) as white, round(avg(y*y), 2) as square, round(avg((y - b*x) * (y - b*x)), 2) as left_over from w, b")
def ar1_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events")
    model = GAMM(Formula(lhs("value"), [i()], series="user_id", order=["ts", "event_id"])).fit(d, rho=0.3)
    y = F.col("fit") + F.col("resid")
    got = model.get_resid(d, "ar1").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("white"), F.avg(y * y).alias("square"), F.avg(F.col("resid") ** 2).alias("left_over"))
    got = got.withColumn("estimate", F.lit(float(model.fitted.coef[0])))
    return _rounded(_rounded(got, 4, "estimate", "white"), 2, "square", "left_over").select("n", "estimate", "white", "square", "left_over")


# several distribution parameters -------------------------------------------------------------------------
@query("""with g as (select l_linestatus as k, avg(l_quantity + 10 * l_tax) as m, ln(stddev_pop(l_quantity + 10 * l_tax) - 0.0001) as s, row_number() over (order by l_linestatus) as r from lineitem group by 1)
select 0 as par, 'Intercept' as name, round(m, 3) as estimate from g where r = 1 union all select 0, 'l_linestatus_' || k, round(m - (select m from g where r = 1), 3) from g where r > 1
union all select 1, 'Intercept', round(s, 3) from g where r = 1 union all select 1, 'l_linestatus_' || k, round(s - (select s from g where r = 1), 3) from g where r > 1""")
def normal_scale_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumn("y", F.col("l_quantity") + 10 * F.col("l_tax"))
    model = GAMMLSS([Formula(lhs("y"), [i(), l(["l_linestatus"])]), Formula(None, [i(), l(["l_linestatus"])])], fam.GAUMLSS()).fit(d, conv_tol=1e-13)
    return _rounded(frame(spark, model.coef_table()[["par", "name", "estimate"]]).withColumn("par", F.col("par").cast("int")), 3, "estimate")


@query("""with g as (select event_type as k, avg(value / 100 + 0.1) as m, row_number() over (order by event_type) as r from events group by 1)
select case when r = 1 then 'Intercept' else 'event_type_' || k end as name, round(ln(m) - case when r = 1 then 0 else (select ln(m) from g where r = 1) end, 3) as estimate from g""")
def gamma_scale_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").withColumn("y", F.col("value") / 100 + 0.1)
    t = GAMMLSS([Formula(lhs("y"), [i(), l(["event_type"])]), Formula(None, [i()])], fam.GAMMALS()).fit(d, conv_tol=1e-13).coef_table()
    return _rounded(frame(spark, t[t["par"] == 0][["name", "estimate"]]), 3, "estimate")


@query("""with d as (select case when event_type = 'click' then 0 when event_type = 'error' then 1 else 2 end as y, case when value > 100 then 'b' else 'a' end as k from events),
c as (select k, count(*) filter (y = 0) as n0, count(*) filter (y = 1) as n1, count(*) filter (y = 2) as n2 from d group by k),
e as (select k, ln(n1 * 1.0 / n0) as e1, ln(n2 * 1.0 / n0) as e2 from c)
select 0 as par, 'Intercept' as name, round(e1, 3) as estimate from e where k = 'a' union all select 0, 'k_b', round(max(e1) filter (k = 'b') - max(e1) filter (k = 'a'), 3) from e
union all select 1, 'Intercept', round(e2, 3) from e where k = 'a' union all select 1, 'k_b', round(max(e2) filter (k = 'b') - max(e2) filter (k = 'a'), 3) from e""")
def multinomial_groups(spark: SparkSession, sf: str) -> DataFrame:
    y = F.when(F.col("event_type") == "click", 0.0).when(F.col("event_type") == "error", 1.0).otherwise(2.0)
    d = table(spark, sf, "events").withColumns({"y": y, "k": F.when(F.col("value") > 100, "b").otherwise("a")})
    model = GAMMLSS([Formula(lhs("y"), [i(), l(["k"])]), Formula(None, [i(), l(["k"])])], fam.MULNOMLSS(2)).fit(d, conv_tol=1e-13)
    return _rounded(frame(spark, model.coef_table()[["par", "name", "estimate"]]).withColumn("par", F.col("par").cast("int")), 3, "estimate")


@query("""with s as (select avg(l_quantity / 10) as ma, avg(l_tax * 20 + l_quantity / 50) as mb, var_pop(l_quantity / 10) as a, covar_pop(l_quantity / 10, l_tax * 20 + l_quantity / 50) as c, var_pop(l_tax * 20 + l_quantity / 50) as b from lineitem),
p as (select *, b / (a*b - c*c) as p11, -c / (a*b - c*c) as p12, a / (a*b - c*c) as p22 from s)
select 'mean_a' as name, round(ma, 3) as estimate from p union all select 'mean_b', round(mb, 3) from p union all select 'root_aa', round(0.5 * ln(p11), 3) from p
union all select 'root_ab', round(p12 / sqrt(p11), 3) from p union all select 'root_bb', round(0.5 * ln(p22 - p12*p12/p11), 3) from p""")
def normal_pair(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumns({"a": F.col("l_quantity") / 10, "b": F.col("l_tax") * 20 + F.col("l_quantity") / 50})
    coef = GSMM([Formula(lhs("a"), [i()]), Formula(lhs("b"), [i()])], MultiGauss(2, [Identity(), Identity()])).fit(d, conv_tol=1e-12).fitted.coef
    return _rounded(frame(spark, pd.DataFrame({"name": ["mean_a", "mean_b", "root_aa", "root_ab", "root_bb"], "estimate": coef})), 3, "estimate")


# likelihoods at given coefficients --------------------------------------------------------------------------
@query("""with d as (select l_quantity / 10 + 0.5 as y, 2 + l_discount * 10 as m, 0.5 + l_tax as s, case when l_returnflag = 'A' then 1.0 else 0.0 end as b, 0.2 + l_discount * 5 as p, l_quantity as k, l_linenumber % 3 as c from lineitem)
select round(avg(-0.5*ln(2*pi()*1.5) - 0.5*(y-m)*(y-m)/1.5), 5) as gaussian, round(avg(b*ln(p) + (1-b)*ln(1-p)), 5) as binomial, round(avg(k*ln(10*m) - 10*m - lgamma(k+1)), 4) as poisson,
round(avg(2*ln(2/m) - lgamma(2.0) + ln(y) - 2*y/m), 5) as gamma, round(avg(-0.5*(ln(2*pi()*0.5) + 3*ln(y) + (y-m)*(y-m)/(0.5*m*m*y))), 5) as invgauss,
round(avg(lgamma((exp(1.0)+4)/2) - lgamma((exp(1.0)+3)/2) - 0.5*ln(pi()*(exp(1.0)+3)) - 0.5 - (exp(1.0)+4)/2*ln(1 + (y-m)*(y-m)/exp(1.0)/(exp(1.0)+3))), 5) as scaledt,
round(avg(-0.5*ln(2*pi()) - ln(s) - 0.5*(y-m)*(y-m)/(s*s)), 4) as normal_scale, round(avg(ln(1/(s*m))/s - lgamma(1/s) + (1/s-1)*ln(y) - y/(s*m)), 4) as gamma_scale,
round(avg(case when c = 0 then 0.0 when c = 1 then m else -p end - ln(1 + exp(m) + exp(-p))), 5) as multinomial from d""")
def log_densities(spark: SparkSession, sf: str) -> DataFrame:
    """``lp`` of every family, averaged over all rows."""
    q, t = F.col("l_quantity"), fam.ScaledT(theta=np.array([0.5, 1.0]))
    cols = {"y": q / 10 + 0.5, "m": 2 + F.col("l_discount") * 10, "s": 0.5 + F.col("l_tax"), "b": F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0), "p": 0.2 + F.col("l_discount") * 5, "k": q, "c": (F.col("l_linenumber") % 3).cast("double")}
    rows = table(spark, sf, "lineitem").select(*[e.cast("double").alias(n) for n, e in cols.items()])
    parts = {
        "gaussian": lambda v: fam.Gaussian().lp(v["y"], v["m"], 1.5), "binomial": lambda v: fam.Binomial().lp(v["b"], v["p"]), "poisson": lambda v: fam.Poisson().lp(v["k"], 10 * v["m"]),
        "gamma": lambda v: fam.Gamma().lp(v["y"], v["m"], 0.5), "invgauss": lambda v: fam.InvGauss().lp(v["y"], v["m"], 0.5), "scaledt": lambda v: t.lp(v["y"], v["m"]),
        "normal_scale": lambda v: fam.GAUMLSS().lp(v["y"], v["m"], v["s"]), "gamma_scale": lambda v: fam.GAMMALS().lp(v["y"], v["m"], v["s"]), "multinomial": lambda v: fam.MULNOMLSS(2).lp(v["c"], v["m"], -v["p"]),
    }
    got = gather(rows, lambda v: {n: [float(g(v).sum()), len(v["y"])] for n, g in parts.items()}, {n: (2,) for n in parts})
    out = frame(spark, pd.DataFrame([{n: float(v[0] / v[1]) for n, v in got.items()}]))
    places = {"poisson": 4, "normal_scale": 4, "gamma_scale": 4}
    return out.select(*[F.round(n, places.get(n, 5)).alias(n) for n in parts])


@query("""with d as (select l_quantity as y, l_discount * 20 as x, 2.0 + 0.3 * l_tax as s from lineitem), e as (select y, x, 25 + 2*x as mu, 2.0 + 0.5*x as es from d), r as (select y, x, mu, exp(es) + 0.0001 as sd from e)
select round(avg(-0.5*ln(2*pi()) - ln(sd) - 0.5*(y-mu)*(y-mu)/(sd*sd)), 5) as llk, round(avg((y-mu)/(sd*sd)), 6) as g0, round(avg(x*(y-mu)/(sd*sd)), 6) as g1,
round(avg(((y-mu)*(y-mu)/(sd*sd*sd) - 1/sd) * (sd - 0.0001)), 5) as g2, round(avg(x*((y-mu)*(y-mu)/(sd*sd*sd) - 1/sd) * (sd - 0.0001)), 5) as g3, round(avg(1/(sd*sd)), 6) as h00, round(avg(x*x/(sd*sd)), 6) as h11, round(avg(2/(sd*sd)*(sd-0.0001)*(sd-0.0001) - ((y-mu)*(y-mu)/(sd*sd*sd) - 1/sd)*(sd-0.0001)), 4) as h22 from r""")
def general_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    """Log-likelihood, gradient and negative Hessian of a location-scale model at given coefficients."""
    d = table(spark, sf, "lineitem").withColumn("x", F.col("l_discount") * 20)
    model = GSMM([Formula(lhs("l_quantity"), [i(), l(["x"])]), Formula(None, [i(), l(["x"])])], Adapter(fam.GAUMLSS()))
    llk, grad, hess = model.at(d, np.array([25.0, 2.0, 2.0, 0.5]))
    n = d.count()
    row = {"llk": llk, "g0": grad[0], "g1": grad[1], "g2": grad[2], "g3": grad[3], "h00": -hess[0, 0], "h11": -hess[1, 1], "h22": -hess[2, 2]}
    places = {"llk": 5, "g2": 5, "g3": 5, "h22": 4}
    return frame(spark, pd.DataFrame([{k: float(v) / n for k, v in row.items()}])).select(*[F.round(k, places.get(k, 6)).alias(k) for k in row])


_SURVIVORS = """with s as (select user_id, cast(count(*) as double) as t, max(case when event_type = 'error' then 1 else 0 end) * (user_id % 3 > 0)::int as d, avg(value) / 245 - 1 as x from events group by user_id),
p as (select t, sum(d) as deaths, sum(exp(0.5 * x)) as own, sum(x * exp(0.5 * x)) as ownx, sum(x * x * exp(0.5 * x)) as ownxx from s group by t),
r as (select t, deaths, sum(own) over (order by t desc) as risk, sum(ownx) over (order by t desc) as riskx, sum(ownxx) over (order by t desc) as riskxx from p),
h as (select *, sum(deaths / risk) over (order by t) as hazard from r)"""


@query(_SURVIVORS + """ select round((select sum(d * 0.5 * x) from s) - sum(deaths * ln(risk)), 4) as llk, round((select sum(d * x) from s) - sum(deaths * riskx / risk), 4) as gradient,
round(sum(deaths * (riskxx / risk - riskx * riskx / (risk * risk))), 4) as information from h""")
def cox_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    """Partial log-likelihood of the library's hazard model and its derivatives at a given coefficient."""
    from .queries import _survivors

    llk, grad, hess = PropHaz(Formula(lhs("t"), [l(["x"])]), "d").at(_survivors(spark, sf), np.array([0.5]))
    return _rounded(frame(spark, pd.DataFrame([{"llk": llk, "gradient": float(grad[0]), "information": float(-hess[0, 0])}])), 4, "llk", "gradient", "information")


@query(_SURVIVORS + " select user_id, round(d - hazard * exp(0.5 * x), 5) as resid from s join h using (t)")
def cox_martingales(spark: SparkSession, sf: str) -> DataFrame:
    from .queries import _survivors

    s, model = _survivors(spark, sf), PropHaz(Formula(lhs("t"), [l(["x"])]), "d")
    model.at(s, np.array([0.5]))
    return _rounded(model.get_resid(s).select("user_id", "resid"), 5, "resid")


# conditions that a fit meets -------------------------------------------------------------------------------
def _smooth(spark: SparkSession, sf: str) -> tuple[DataFrame, GAMM]:
    d = table(spark, sf, "lineitem").withColumn("y", 10 * F.sin(F.col("l_quantity") / 8.0) + 20 * F.col("l_discount") + F.pmod("l_extendedprice", F.lit(100.0)) / 25.0)
    return d, GAMM(Formula(lhs("y"), [i(), f(["l_quantity"]), f(["l_discount"], nk=5)])).fit(d)


@query("select cast(k as integer) as k, cast(0 as double) as total from range(1, 15) r(k)")
def centred_smooths(spark: SparkSession, sf: str) -> DataFrame:
    """Column sums of two constrained smooths."""
    d, model = _smooth(spark, sf)
    flat = model.get_mmat(d).select(F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy(F.col("e.idx").alias("k")).agg((F.sum("e.val") / d.count()).alias("total"))
    return _rounded(flat.where("k > 0"), 6, "total")


@query("select cast(k as integer) as k, cast(0 as double) as total from range(0, 15) r(k)")
def normal_equations(spark: SparkSession, sf: str) -> DataFrame:
    """What the normal equations of a penalised fit leave over, by coefficient: X'(y - Xb) less the penalty's part."""
    d, model = _smooth(spark, sf)
    fit, n = model.fitted, d.count()
    coef = F.array(*[F.lit(float(c)) for c in fit.coef])
    rows = model.get_mmat(d, keep=["y"])
    rows = rows.withColumn("rest", F.col("y") - F.aggregate(F.arrays_zip("idx", "val"), F.lit(0.0), lambda a, e: a + e["val"] * F.element_at(coef, e["idx"] + 1)))
    left = rows.select("rest", F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy(F.col("e.idx").alias("k")).agg(F.sum(F.col("rest") * F.col("e.val")).alias("v"))
    pull = S.total(fit.penalties, len(fit.coef)) @ fit.coef
    pen = frame(spark, pd.DataFrame({"k": np.arange(len(pull), dtype=np.int32), "pull": pull})).withColumn("k", F.col("k").cast("int"))
    return _rounded(pen.join(left, "k").select("k", ((F.col("v") - F.col("pull")) / n).alias("total")), 6, "total")


@query("select cast(k as integer) as k, cast(0 as double) as slope from range(0, 2) r(k)")
def smoothing_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of the restricted likelihood in each log lambda at the end of a fit."""
    fit = _smooth(spark, sf)[1].fitted
    slope = S.reml_gradient(fit.penalties, fit.cov, fit.coef, fit.scale)
    return _rounded(frame(spark, pd.DataFrame({"k": np.arange(len(slope), dtype=np.int32), "slope": slope})), 2, "slope")


@query("""with c as (select r, r + o as k, case o when 1 then -2.0 else 1.0 end as v from range(0, 8) a(r), range(0, 3) b(o)) select cast(x.k as integer) as i, cast(y.k as integer) as j, round(sum(x.v * y.v), 6) as v from c x join c y on x.r = y.r group by 1, 2""")
def difference_penalty_entries(spark: SparkSession, sf: str) -> DataFrame:
    s = difference_penalty(10)
    at = [(a, b) for a in range(10) for b in range(10) if abs(a - b) < 3]
    return frame(spark, pd.DataFrame({"i": np.array([a for a, _ in at], np.int32), "j": np.array([b for _, b in at], np.int32), "v": [float(s[a, b]) for a, b in at]}))


# numbers of the size of a model -----------------------------------------------------------------------------
@query("""select cast(x as double) as x, round(exp(-x/2.0) * (1 + x/2.0), 6) as chi2, round(power(1 + 2*x/10.0, -5), 6) as f, round(1 - x / sqrt(2.0 + x*x), 6) as t, round(1 - exp(-x/3.0), 6) as gamma,
round(exp(-x/4.0) * (1 + x/4.0), 4) as weighted, round(lgamma(x + 0.5), 6) as lgamma from range(1, 16) r(x)""")
def special_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Tails of chi-squared (4), F (2, 10), t (2), Gamma (1, 3) and of twice a chi-squared (4), and the log-gamma function."""
    x = np.arange(1.0, 16.0)
    got = {"x": x, "chi2": sp.chi2_sf(x, 4.0), "f": sp.f_sf(x, 2.0, 10.0), "t": sp.t_sf_two_sided(x, 2.0), "gamma": sp.gamma_cdf(x, np.float64(1.0), np.float64(3.0)), "weighted": [float(np.ravel(sp.weighted_chi2_sf(float(v), np.full(4, 2.0)))[0]) for v in x], "lgamma": sp.lgamma(x + 0.5)}
    out = frame(spark, pd.DataFrame({k: np.asarray(v, float) for k, v in got.items()}))
    return _rounded(_rounded(out, 6, "chi2", "f", "t", "gamma", "lgamma"), 4, "weighted")


@query("select cast(a as integer) as i, cast(b as integer) as j, round(1/12.0 + (a - 5.5) * (b - 5.5) / 143.0, 6) as v from range(0, 12) x(a), range(0, 12) y(b)")
def null_space_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """The penalty of straight lines, which second differences leave free."""
    s = null_penalty(difference_penalty(12))
    i, j = np.divmod(np.arange(144, dtype=np.int32), 12)
    return _rounded(frame(spark, pd.DataFrame({"i": i, "j": j, "v": s.ravel()})), 6, "v")


@query("select cast(n as integer) as n, round(ln(n) + (n - 1) * ln(3.0), 6) as logdet, cast(n - 1 as integer) as rank from range(4, 20) r(n)")
def penalty_determinants(spark: SparkSession, sf: str) -> DataFrame:
    """Log of the product of the non-zero eigenvalues of thrice the first-difference penalty, and its rank."""
    rows = [(n, *penalty_logdet([difference_penalty(n, 1)], [3.0])[1:]) for n in range(4, 20)]
    out = pd.DataFrame({"n": np.array([r[0] for r in rows], np.int32), "logdet": [r[1] for r in rows], "rank": np.array([r[2] for r in rows], np.int32)})
    return _rounded(frame(spark, out), 6, "logdet")


@query("select kind, cast(a as integer) as i, cast(b as integer) as j, case when a = b then 1.0::double else 0.0::double end as v from (values ('constraint'), ('natural')) k(kind), range(0, 9) x(a), range(0, 9) y(b)")
def orthonormal_maps(spark: SparkSession, sf: str) -> DataFrame:
    """The QR constraint of a smooth of all rows has orthonormal columns; so has its natural basis under the cross product."""
    from .queries import _quantity_basis

    rows = _quantity_basis(spark, sf)
    flat = rows.select(F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy("e.idx").agg(F.sum("e.val").alias("v")).orderBy("idx").toPandas()
    pairs = cross_pairs(rows, "idx", "val").toPandas()
    gram = np.zeros((10, 10))
    gram[pairs["i"], pairs["j"]] = gram[pairs["j"], pairs["i"]] = pairs["v"]
    z = sum_to_zero(flat["v"].to_numpy())
    inner = z.T @ gram @ z / rows.count()
    b, _ = natural(inner, z.T @ difference_penalty(10) @ z)
    i, j = np.divmod(np.arange(81, dtype=np.int32), 9)
    parts = [pd.DataFrame({"kind": k, "i": i, "j": j, "v": m.ravel()}) for k, m in (("constraint", z.T @ z), ("natural", b.T @ inner @ b))]
    return frame(spark, pd.concat(parts)).withColumn("v", F.abs(F.round("v", 5)))


@query("select round(sum(2 * n / (n + 5.0) - (n / (n + 5.0)) * (n / (n + 5.0))), 6) as edf1, round(sum(n / (n + 5.0)), 6) as edf from (select count(*) as n from orders group by o_orderpriority)")
def ridge_edf1(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").withColumn("y", (F.col("o_totalprice") - 250000) / 1000)
    model = GAMM(Formula(lhs("y"), [ri("o_orderpriority")])).fit(d, lam=5.0, fixed_lam=True)
    return _rounded(frame(spark, pd.DataFrame([{"edf1": float(inference.edf1(model).sum()), "edf": model.fitted.edf}])), 6, "edf1", "edf")


@query("select distinct o_orderpriority as level from orders where o_orderpriority is not null")
def unique_values(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, pd.DataFrame({"level": readers.read_unique(table(spark, sf, "orders"), "o_orderpriority")}))


@query("select count(*) as n, round(sum(value), 2) as total from events where event_id % 17 <> 0")
def covariate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One covariate where the response is known."""
    d = table(spark, sf, "events").withColumn("y", F.when(F.col("event_id") % 17 != 0, 1.0))
    return readers.read_cov(d, "y", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
