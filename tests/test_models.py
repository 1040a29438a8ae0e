import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knotwork.functions import families as fam
from knotwork.functions.links import Identity
from knotwork.functions.special import normal_ppf
from knotwork.operators import encode as enc
from knotwork.operators.partials import columns
from knotwork.plans import inference, solve
from knotwork.plans.arrow import ArrowGAMM
from knotwork.plans.gamm import GAMM
from knotwork.plans.hazard import PropHaz, next_time
from knotwork.plans.hsmm import HSMM, Chain, HSMMFamily, backward, backward_sample, forward, predictive_residuals, viterbi
from knotwork.plans.joint import GAMMLSS, GSMM, Adapter, FamilyAdapter, MultiGauss
from knotwork.plans.terms import Formula, f, fs, i, irf, l, lhs, li, ri, rs


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 1200
    x0, x1 = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    g, sub = rng.integers(0, 3, n), rng.integers(0, 12, n)
    b = rng.normal(size=12) * 0.5
    eta = 2 * np.sin(2 * np.pi * x0) + x1 + np.array([0, 0.5, -0.5])[g] + b[sub]
    p = pd.DataFrame({"x0": x0, "x1": x1, "g": [f"g{k}" for k in g], "sub": [f"s{k:02d}" for k in sub], "y": eta + rng.normal(size=n) * 0.7})
    p["b"] = (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(float)
    p["c"] = rng.poisson(np.exp(eta / 2)).astype(float)
    p["m"] = rng.gamma(2, np.exp(eta / 2) / 2)
    p["t"] = eta + rng.standard_t(4, n) * 0.5
    p["series"], p["k"] = [f"t{v // 30}" for v in range(n)], np.arange(n) % 30
    return spark.createDataFrame(p).repartition(3).cache()


def local(model, df, response):
    """Dense model matrix and response of all rows."""
    from knotwork.plans.spec import rows_of

    rows = rows_of(df, model.designs[0], [F.col(response)]).toPandas()
    block = {c: rows[c].to_numpy() for c in rows}
    return model.designs[0].matrix(block), block["y0"]


TERMS = [
    [i(), l(["g"]), f(["x0"]), f(["x1"]), ri("sub")],
    [i(), li(["g", "x1"]), f(["x0"], rp=1)],
    [i(), f(["x0", "x1"], te=True)],
    [i(), f(["x0"]), f(["x1"]), f(["x0", "x1"])],
    [i(), f(["x0"], by="g"), rs(["x1"], by="g")],
    [i(), f(["x0"], binary=("g", "g1")), f(["x1"], by_cont="x0", penalize_null=True)],
    [i(), f(["x0"]), fs(["x0"], rf="sub", nk=5)],
    [i(), f(["x0"], id=1), f(["x1"], id=1)],
    [i(), f(["x0"], constraint="DROP"), f(["x1"], constraint="DIFF")],
]


@pytest.mark.parametrize("terms", TERMS)
def test_fit_solves_the_penalised_normal_equations(data, terms):
    m = GAMM(Formula(lhs("y"), terms)).fit(data)
    x, y = local(m, data, "y")
    s = solve.total(m.fitted.penalties, x.shape[1])
    assert len(m.designs[0].names) == x.shape[1] == len(m.fitted.coef)
    assert np.allclose((x.T @ x + s) @ m.fitted.coef, x.T @ y, atol=1e-4 * np.abs(x.T @ y).max())
    assert np.isclose(m.fitted.deviance, ((y - x @ m.fitted.coef) ** 2).sum(), rtol=1e-6)
    v = np.linalg.pinv(x.T @ x + s)
    assert np.isclose(m.fitted.edf, np.trace(v @ x.T @ x), rtol=1e-3)
    # an interaction is constrained by its marginals
    smooth = [b for b in m.designs[0].blocks if isinstance(b.term, f) and (b.term.te or len(b.term.variables) == 1) and b.term.identifiable and not b.term.by and not b.term.binary and not b.term.by_cont and b.term.constraint == "QR"]
    for b in smooth:
        assert np.abs(x[:, b.start : b.start + b.width].sum(axis=0)).max() < 1e-6 * len(x)


def test_lambda_is_a_fixed_point_of_reml(data):
    m = GAMM(Formula(lhs("y"), [i(), f(["x0"])])).fit(data)
    best = inference.candidate(m, np.log([m.fitted.penalties[0].lam]))[0]
    assert np.isclose(best, m.fitted.reml, rtol=1e-8)
    assert all(inference.candidate(m, np.log([m.fitted.penalties[0].lam]) + d)[0] < best for d in (-0.7, 0.7))


@pytest.mark.parametrize(("family", "y"), [(fam.Binomial(), "b"), (fam.Poisson(), "c"), (fam.Gamma(), "m"), (fam.ScaledT(), "t")])
def test_weighted_fits(data, family, y):
    m = GAMM(Formula(lhs(y), [i(), l(["g"]), f(["x0"])]), family).fit(data)
    x, v = local(m, data, y)
    s = solve.total(m.fitted.penalties, x.shape[1])

    def value(c):
        mu = family.link.fi(x @ c)
        return family.D(v, mu).sum() + c @ s @ c

    at = m.fitted.coef
    slope = np.array([(value(at + 1e-5 * e) - value(at - 1e-5 * e)) / 2e-5 for e in np.eye(len(at))])
    assert np.abs(slope).max() < 2e-2 * max(1.0, np.abs(value(at)) ** 0.5)
    assert np.isclose(m.fitted.deviance, family.D(v, family.link.fi(x @ at)).sum(), rtol=1e-6)
    resid = m.get_resid(data, "Deviance").toPandas()
    assert np.isclose((resid.resid**2).sum(), m.fitted.deviance, rtol=1e-6)


def test_nulls_drop_rows_but_not_ranges(spark, data):
    holes = data.withColumn("x0", F.when(F.col("k") % 5 == 0, None).otherwise(F.col("x0"))).withColumn("y", F.when(F.col("k") % 7 == 3, float("nan")).otherwise(F.col("y")))
    edge = spark.createDataFrame([(9.0, None)], "x0 double, y double")
    m = GAMM(Formula(lhs("y"), [i(), f(["x0"])])).fit(holes.select("x0", "y").unionByName(edge))
    assert m.fitted.n == data.where("k % 5 <> 0 and k % 7 <> 3").count()
    assert m.designs[0].encoding.ranges["x0"][1] == 9.0


def test_types_and_codebook(spark, data):
    with pytest.raises(KeyError):
        enc.learn(data, ["nothing"])
    with pytest.raises(TypeError):
        GAMM(Formula(lhs("y"), [i(), f(["g"])])).fit(data)
    with pytest.raises(TypeError):
        GAMM(Formula(lhs("y"), [ri("x0")])).fit(data)
    e = enc.learn(data, ["g"], codebook={"g": {"g2": 0, "g0": 1, "g1": 2}})
    assert e.levels["g"] == ["g2", "g0", "g1"]
    many = spark.range(enc.MAP_LEVELS + 50).select(F.col("id").cast("string").alias("v"))
    levels = sorted(r[0] for r in many.collect())
    assert enc.code(many, "v", levels, "c").where("c is null").count() == 0


def test_predictions_and_intervals(spark, data):
    m = GAMM(Formula(lhs("y"), [i(), l(["g"]), f(["x0"])])).fit(data)
    x, _ = local(m, data, "y")
    out = m.predict(data.select("x0", "g"), ci=True).toPandas()
    want = x @ m.fitted.coef
    assert np.allclose(np.sort(out.fit), np.sort(want))
    se = np.sqrt(np.einsum("ij,jk,ik->i", x, m.fitted.cov * m.fitted.scale, x))
    assert np.allclose(np.sort(out.se), np.sort(se)) and np.allclose(out.upper - out.fit, 1.959963985 * out.se)
    new = m.predict(spark.createDataFrame([(0.5, "g1"), (0.5, "zz"), (None, "g0")], "x0 double, g string")).toPandas()
    b = dict(zip(m.designs[0].names, m.fitted.coef))
    assert np.isclose(new.fit[0] - new.fit[1], b["g_g1"]) and np.isnan(new.fit[2])
    assert m.band(data, [2], n_ps=400, seed=0) > 1.96
    d = m.predict_diff(data.withColumn("g", F.lit("g1")), data.withColumn("g", F.lit("g0")), ["series", "k"]).toPandas()
    assert np.allclose(d["diff"], b["g_g1"])
    draws = m.sample_post(4000, seed=1)
    assert np.allclose(np.cov(draws), m.fitted.cov * m.fitted.scale, atol=0.2 * np.abs(m.fitted.cov * m.fitted.scale).max())
    assert m.get_mmat(data).count() == 1200


def test_offset_and_transformed_response(data):
    shifted = data.withColumn("o", F.lit(5.0)).withColumn("z", F.exp(F.col("y") + 5))
    m = GAMM(Formula(lhs("z", lambda c: F.log(c)), [i(), f(["x0"])])).fit(shifted, offset="o")
    plain = GAMM(Formula(lhs("y"), [i(), f(["x0"])])).fit(data)
    assert np.allclose(m.fitted.coef, plain.fitted.coef, atol=1e-5)


def test_ar1_whitens(data):
    m = GAMM(Formula(lhs("y"), [i(), l(["x1"])], series="series", order=["k"])).fit(data, rho=0.4)
    p = data.toPandas().sort_values(["series", "k"])
    rows, ys = [], []
    for _, g in p.groupby("series"):
        x = np.column_stack((np.ones(len(g)), g.x1))
        w = np.eye(len(g)) / np.sqrt(1 - 0.16) - np.diag(np.full(len(g) - 1, 0.4 / np.sqrt(1 - 0.16)), -1)
        w[0, 0] = 1.0
        rows.append(w @ x)
        ys.append(w @ g.y.to_numpy())
    want = np.linalg.lstsq(np.vstack(rows), np.concatenate(ys), rcond=None)[0]
    assert np.allclose(m.fitted.coef, want)


def test_impulse_starts_at_the_onset(spark):
    data = [("a", k, float(k), 2) for k in range(10)] + [("b", k, float(k), 4) for k in range(10)]
    d = spark.createDataFrame(data, "s string, t int, k double, onset int").withColumn("y", F.rand(1))
    m = GAMM(Formula(lhs("y"), [i(), irf(["k"], onset="onset", nk=4)], series="s", order=["t"])).fit(d)
    assert len(m.fitted.coef) == 5
    r = enc.lagged(d, "s", ["t"], "k", "onset", "p").toPandas().sort_values(["s", "t"])
    assert r[r.s == "a"].p.isna().sum() == 2 and list(r[r.s == "b"].p.dropna()) == [0.0, 1, 2, 3, 4, 5]


def test_many_levels_by_elimination(data):
    shared = Formula(lhs("y"), [i(), f(["x0"])])
    for big, same in ((ri("sub"), ri("sub")), (fs(["x1"], rf="sub", nk=4), fs(["x1"], rf="sub", nk=4))):
        arrow = ArrowGAMM(shared, big).fit(data, lam=2.0, fixed_lam=True)
        dense = GAMM(Formula(lhs("y"), [*shared.terms, same])).fit(data, lam=2.0, fixed_lam=True, find_nested=False)
        p = len(arrow.fitted.coef)
        assert np.allclose(arrow.fitted.coef, dense.fitted.coef[:p], atol=1e-5)
        assert np.isclose(arrow.fitted.edf, dense.fitted.edf, rtol=1e-5) and np.isclose(arrow.fitted.scale, dense.fitted.scale, rtol=1e-5)
        own = np.concatenate([r["coef"] for r in arrow.levels.orderBy("level").collect()])
        assert np.allclose(own, dense.fitted.coef[p:], atol=1e-4)
    free, dense = ArrowGAMM(shared, ri("sub")).fit(data), GAMM(Formula(lhs("y"), [*shared.terms, ri("sub")])).fit(data)
    assert np.isclose(free.fitted.edf, dense.fitted.edf, rtol=1e-2)


def test_location_scale(spark, data):
    m = GAMMLSS([Formula(lhs("y"), [i(), f(["x0"])]), Formula(None, [i(), l(["x1"])])], fam.GAUMLSS()).fit(data, max_outer=15)
    p = m.score(data, ["x0"]).toPandas()
    assert np.isclose(fam.GAUMLSS().lp(data.toPandas().sort_values("x0").y.to_numpy(), *(p.sort_values("x0")[c].to_numpy() for c in ("par0", "par1"))).sum(), m.fitted.llk)
    assert abs(p.resid.mean()) < 0.1 and abs(p.resid.std() - 1) < 0.1
    quasi = GSMM([Formula(lhs("y"), [i(), l(["x0"])]), Formula(None, [i()])], Adapter(fam.GAUMLSS())).fit(data, method="qEFS", max_outer=2, max_inner=60)
    newton = GSMM([Formula(lhs("y"), [i(), l(["x0"])]), Formula(None, [i()])], Adapter(fam.GAUMLSS())).fit(data, max_outer=2)
    assert np.isclose(quasi.fitted.llk, newton.fitted.llk, rtol=1e-5)


def test_multivariate_normal(spark):
    z = np.random.default_rng(0).multivariate_normal([1, 2], [[1, 0.6], [0.6, 2]], 800)
    d = spark.createDataFrame(pd.DataFrame(z, columns=["a", "b"])).repartition(2)
    family = MultiGauss(2, [Identity(), Identity()])
    m = GSMM([Formula(lhs("a"), [i()]), Formula(lhs("b"), [i()])], family).fit(d, max_outer=5)
    r = family.root(m.fitted.coef[-3:])
    assert np.allclose(m.fitted.coef[:2], z.mean(axis=0), atol=1e-5) and np.allclose(np.linalg.inv(r.T @ r), np.cov(z.T, ddof=0), atol=1e-4)


def test_hazard(spark):
    rng = np.random.default_rng(3)
    n = 300
    x = rng.uniform(size=n)
    t = np.ceil(rng.exponential(np.exp(-1.5 * x)) * 20) / 20
    p = pd.DataFrame({"t": t, "d": (rng.uniform(size=n) < 0.8).astype(int), "x": x})
    d = spark.createDataFrame(p).repartition(3)
    m = PropHaz(Formula(lhs("t"), [f(["x"], nk=5)]), "d").fit(d, max_outer=4)
    rows = m._rows(d).repartitionByRange(4, F.desc("y0")).sortWithinPartitions(F.desc("y0")).cache()
    assert rows.rdd.getNumPartitions() == 4
    b = columns(rows.toArrow().combine_chunks())
    xx, tt, dd = m.designs[0].matrix(b), b["y0"], b["y1"]

    def llk(c):
        e = np.exp(xx @ c)
        return sum(dd[k] * (xx[k] @ c - np.log(e[tt >= tt[k]].sum())) for k in range(n))

    c = rng.normal(size=xx.shape[1]) * 0.3
    value, grad, hess = m.evaluate(rows, c)
    assert np.isclose(value, llk(c))
    assert np.allclose(grad, [(llk(c + 1e-5 * e) - llk(c - 1e-5 * e)) / 2e-5 for e in np.eye(len(c))], atol=1e-4)
    for k, e in enumerate(np.eye(len(c))):
        assert np.allclose(hess[k], (m.evaluate(rows, c + 1e-4 * e, False)[1] - m.evaluate(rows, c - 1e-4 * e, False)[1]) / 2e-4, atol=1e-4)
    base = m.baseline(d).toPandas().sort_values("time")
    e = np.exp(xx @ m.fitted.coef)
    want = np.cumsum([dd[tt == u].sum() / e[tt >= u].sum() for u in np.unique(tt)])
    assert np.allclose(base.hazard, want)
    assert abs(m.get_resid(d).toPandas().resid.sum()) < 1e-6
    assert m.get_resid(d, "Deviance").count() == n


def test_next_time(spark):
    table = spark.createDataFrame([(float(k), k * 10.0) for k in range(1, 40, 3)], "time double, v double")
    asked = spark.createDataFrame([(k / 2,) for k in range(0, 90)], "at double")
    for r in next_time(asked, table, "at").collect():
        later = [k for k in range(1, 40, 3) if k >= r["at"]]
        assert r["v"] == 10.0 * (later[0] if later else 37)


def enumerate_paths(c):
    k, s = c.last.shape
    n, found = len(c.emit), []

    def go(t, j, p, path):
        for d in range(1, k + 1):
            if c.ends_with_last and t + d > n:
                return
            e = min(t + d, n)
            q = p * c.last[d - 1, j] * np.prod(c.emit[t:e, j])
            if t + d >= n:
                found.append((q, path + [j] * (e - t)))
            else:
                for b in range(s):
                    if c.move[j, b] > 0:
                        go(t + d, b, q * c.move[j, b], path + [j] * d)

    for j in range(s):
        go(0, j, c.first[j], [])
    return found


@pytest.mark.parametrize(("states", "last"), [(2, False), (2, True), (3, False)])
def test_semi_markov_recursions(states, last):
    rng = np.random.default_rng(5)
    move = rng.uniform(size=(states, states)) * (1 - np.eye(states))
    durations = rng.uniform(size=(3, states))
    c = Chain(rng.uniform(0.1, 1, (6, states)), durations / durations.sum(axis=0), move / move.sum(axis=1, keepdims=True), np.full(states, 1 / states), last)
    paths = enumerate_paths(c)
    assert np.isclose(forward(c)[0], np.log(sum(p for p, _ in paths)))
    best = max(paths)
    states_, _, value = viterbi(c)
    assert np.isclose(value, np.log(best[0])) and list(states_) == best[1]
    share = {}
    for p, path in paths:
        share[tuple(path)] = share.get(tuple(path), 0) + p
    total, drawn = sum(share.values()), [tuple(backward_sample(c, rng)) for _ in range(3000)]
    for path, p in share.items():
        assert abs(drawn.count(path) / 3000 - p / total) < 0.05


def test_backward_and_predictive():
    rng = np.random.default_rng(6)
    durations = rng.uniform(size=(3, 2))
    c = Chain(rng.uniform(0.1, 1, (6, 2)), durations / durations.sum(axis=0), np.array([[0, 1.0], [1, 0]]), np.array([0.4, 0.6]))
    _, a, scale = forward(c)
    b = backward(c, scale)
    assert np.allclose((a * b).sum(axis=(1, 2)), 1.0)
    cdf = rng.uniform(size=(6, 2))
    paths = enumerate_paths(c)
    w = np.zeros(2)
    for p, path in paths:
        w[path[3]] += p / c.emit[3, path[3]]
    from knotwork.functions.special import normal_cdf

    assert np.isclose(normal_cdf(predictive_residuals(c, cdf))[3], w / w.sum() @ cdf[3])


def test_events_follow_their_template(spark):
    rng = np.random.default_rng(2)
    bump, rows = np.array([0.5, 1.0, 0.5]), []
    for s in range(10):
        y, z = [], []
        while len(y) < 30:
            gap = 2 + int(rng.poisson(3))
            y += [0.0] * gap + list(4 * bump)
            z += [0] * gap + [1] * 3
        rows += [(f"s{s}", t, float(y[t] + rng.normal() * 0.5), z[t]) for t in range(30)]
    d = spark.createDataFrame(rows, "s string, t int, y double, z int").repartition(2)
    key = {"series": "s", "order": ["t"]}
    family = HSMMFamily(2, [fam.GAUMLSS()], 15, move=np.array([[0, 1.0], [1, 0]]), first=np.array([1.0, 0.0]), events=[1], template=bump)
    m = HSMM([Formula(lhs("y"), [i()], **key)] + [Formula(None, [i()], **key) for _ in range(7)], family)
    m.fit(d, init_coef=np.array([0.2, 0, 3.0, 0, 1.5, -1, 0.0, 0.0]), max_outer=1, max_inner=8)
    assert abs(m.fitted.coef[2] - 4) < 0.4 and set(m.designs[6].dropped + m.designs[7].dropped) == {0}
    v = m.each(d, "viterbi").toPandas().merge(d.toPandas(), left_on=["series", "place"], right_on=["s", "t"])
    assert (v.state == v.z).mean() > 0.95
    assert abs(m.each(d, "predictive").toPandas().value.std() - 1) < 0.2


def test_family_adapter_and_dropping(data):
    x = data.withColumn("w", 2 * F.col("x1"))
    m = GSMM([Formula(lhs("y"), [i(), l(["x1"]), l(["w"])])], FamilyAdapter(fam.Gaussian())).fit(x, max_outer=1)
    plain = GAMM(Formula(lhs("y"), [i(), l(["x1"])])).fit(data)
    assert m.designs[0].dropped == [2] and np.allclose(m.fitted.coef[:2], plain.fitted.coef, atol=1e-3)
    assert np.isclose(np.exp(m.fitted.coef[-1]), plain.fitted.deviance / plain.fitted.n, rtol=1e-3)
    rank_one = GSMM([Formula(lhs("y"), [i(), l(["x1"])])], FamilyAdapter(fam.Gaussian())).fit(x, max_outer=1, max_inner=60, method="SR1")
    assert np.allclose(rank_one.fitted.coef[:2], plain.fitted.coef, atol=1e-2)


def test_penalty_determinant_of_very_different_lambdas():
    from knotwork.functions.linalg import penalty_logdet

    a, b = np.diag([1.0, 2, 0, 0]), np.diag([0.0, 0, 3, 0])
    inverse, log, rank = penalty_logdet([a, b], [1e-7, 1e7])
    assert rank == 3 and np.isclose(log, np.log(2e-14) + np.log(3e7))
    assert np.allclose(np.diag(inverse), [1e7, 5e6, 1 / 3e7, 0])


def test_semi_markov_model(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(12):
        j, t = int(rng.integers(2)), 0
        while t < 40:
            for u in range(t, min(t + (d := 1 + int(rng.poisson([4, 8][j]))), 40)):
                rows.append((f"s{s}", u, float(rng.normal([0, 3][j], 1)), j))
            t, j = t + d, 1 - j
    d = spark.createDataFrame(rows, "s string, t int, y double, z int").repartition(3)
    key = {"series": "s", "order": ["t"]}
    family = HSMMFamily(2, [fam.GAUMLSS()], 20, move=np.array([[0, 1.0], [1, 0]]), first=np.array([0.5, 0.5]))
    m = HSMM([Formula(lhs("y"), [i()], **key)] + [Formula(None, [i()], **key) for _ in range(7)], family)
    m.fit(d, init_coef=np.array([-0.5, 0, 2.5, 0, 1.5, -1, 1.5, -1.0]), max_outer=1, max_inner=6)
    assert abs(m.fitted.coef[0]) < 0.3 and abs(m.fitted.coef[2] - 3) < 0.3
    v = m.each(d, "viterbi").toPandas().merge(d.toPandas(), left_on=["series", "place"], right_on=["s", "t"])
    assert (v.state == v.z).mean() > 0.95
    r = m.each(d, "forward").toPandas().value
    assert abs(r.mean()) < 0.15 and abs(r.std() - 1) < 0.15
    assert {k: m.each(d, k, draws=2).count() for k in ("posterior", "predict", "probabilities")} == {"posterior": 960, "predict": 960, "probabilities": 960}


def test_tests_and_comparison(data):
    one = GAMM(Formula(lhs("y"), [i(), l(["g"]), f(["x0"]), f(["k"])])).fit(data)
    none = GAMM(Formula(lhs("y"), [i(), l(["g"]), f(["k"])])).fit(data)
    table = inference.smooth_p_values(one).set_index("term")
    assert table.p["f(x0)"] < 1e-6 < 0.01 < table.p["f(k)"]
    assert set(inference.summary_smooth(one, p_values=True).columns) >= {"term", "edf", "penalized", "p"}
    assert list(inference.summary_parametric(one).name) == ["Intercept", "g_g1", "g_g2"]
    out = inference.compare_CDL(one, none, perform_GLRT=True)
    assert out["aic_diff"] < 0 and out["p"] < 1e-6
    for grid in ("JJJ1", "JJJ2", "JJJ3"):
        assert inference.correct_covariance(one, grid, draws=60)[1] >= one.fitted.edf


def test_posterior_sampler(spark, data):
    m = GAMM(Formula(lhs("y"), [i(), l(["x1"])])).fit(data)
    t = inference.convergence(inference.sample_posterior(m, spark, chains=2, draws=400, adapt=200)).set_index("name")
    assert np.allclose(t.loc[m.designs[0].names, "mean"], m.fitted.coef, atol=0.05)
    assert np.allclose(t.loc[m.designs[0].names, "sd"], m.coef_table().se, rtol=0.25)
    assert t.rhat.max() < 1.05


def test_qr_route_and_step_control(data):
    from knotwork.plans import solve as S

    formula = Formula(lhs("y"), [i(), f(["x0"]), l(["x1"])])
    plain, qr = GAMM(formula).fit(data), GAMM(formula).fit(data.repartition(40), method="QR")
    assert np.allclose(plain.fitted.coef, qr.fitted.coef, atol=1e-5) and np.isclose(plain.fitted.llk, qr.fitted.llk, rtol=1e-7)
    with pytest.raises(ValueError, match="QR"):
        GAMM(formula, fam.Poisson()).fit(data, method="QR")
    for extension in ("nesterov", "none"):
        other = GAMM(formula).fit(data, extension=extension)
        assert other.fitted.converged and np.isclose(other.fitted.reml, plain.fitted.reml, atol=1e-3)
    fit = plain.fitted
    slope, rho = S.reml_gradient(fit.penalties, fit.cov, fit.coef, fit.scale), S.get_logs(fit.penalties)
    assert np.abs(slope).max() < 0.01
    # the slope is that of the restricted likelihood at a fixed scale
    value = []
    for step in (1.5, 1.5001):
        S.set_logs(fit.penalties, rho + step)
        h = fit.hessian + S.total(fit.penalties, len(fit.coef))
        coef = np.linalg.solve(h, fit.hessian @ fit.coef)
        llk = -0.5 * float((coef - fit.coef) @ fit.hessian @ (coef - fit.coef)) / fit.scale
        value.append(S.reml(llk, fit.hessian, coef, fit.scale, fit.penalties))
        cov = np.linalg.inv(h)
    assert np.isclose((value[1] - value[0]) / 1e-4, S.reml_gradient(fit.penalties, cov, coef, fit.scale).sum(), rtol=0.02, atol=1e-3)
    S.set_logs(fit.penalties, rho)


def test_matrix_files_and_differences(spark, data, tmp_path, capsys):
    from knotwork.plans import inference
    from knotwork.plans.kinds import ConstType
    from knotwork.plans.model import read_mmat

    m = GAMM(Formula(lhs("y"), [i(), f(["x0"], constraint=ConstType.DROP), l(["x1"])])).fit(data)
    m.write_mmat(data, str(tmp_path / "mmat"), keep=["y"])
    assert read_mmat(spark, str(tmp_path / "mmat")).count() == data.count()
    grid = spark.createDataFrame([(k, k / 10, 0.2) for k in range(1, 9)], "id long, x0 double, x1 double")
    other = grid.withColumn("x1", F.lit(0.7))
    near, wide = (m.predict_diff(grid, other, ["id"], whole_interval=w, n_ps=400, seed=1).orderBy("id").toPandas() for w in (False, True))
    assert np.allclose(near["diff"], -0.5 * m.fitted.coef[1]) and np.allclose(near["diff"], wide["diff"])
    assert ((wide["upper"] - wide["lower"]) >= 0.95 * (near["upper"] - near["lower"])).all()
    inference.print_parametric_terms(m)
    inference.print_smooth_terms(m)
    assert "Intercept" in capsys.readouterr().out


def test_cholesky_update():
    from knotwork.functions.linalg import chol_update

    rng = np.random.default_rng(2)
    a, v = rng.normal(size=(6, 6)), rng.normal(size=6)
    a = a @ a.T + 6 * np.eye(6)
    low = np.linalg.cholesky(a)
    assert np.allclose(chol_update(low, v), np.linalg.cholesky(a + np.outer(v, v)))
    assert np.allclose(chol_update(low, 0.5 * v, -1.0), np.linalg.cholesky(a - 0.25 * np.outer(v, v)))
    with pytest.raises(np.linalg.LinAlgError):
        chol_update(low, 100 * v, -1.0)


@pytest.mark.parametrize(("states", "fixed", "last"), [(2, True, False), (3, False, False), (3, False, True)])
def test_semi_markov_gradient(states, fixed, last):
    rng = np.random.default_rng(states)
    families = [fam.GAUMLSS(), fam.GAMMALS()] if states == 2 else [fam.GAUMLSS()]
    move = np.array([[0.0, 1.0], [1.0, 0.0]]) if fixed else None
    family = HSMMFamily(states, families, 9, move=move, first=np.full(states, 1 / states) if fixed else None, ends_with_last=last)
    n = 40
    ys = [rng.normal(size=n) + 3 * (np.arange(n) % 9 > 4), rng.gamma(2.0, 1.0, n)][: len(families)]
    xs = [np.column_stack((np.ones(n), rng.normal(size=n))) for _ in range(family.n_par)]
    splits = list(range(0, 2 * family.n_par + 1, 2))
    coef = rng.normal(0, 0.3, splits[-1])
    step, want = 1e-5, []
    for k in range(len(coef)):
        e = step * np.eye(len(coef))[k]
        want.append((family.llk(coef + e, splits, ys, xs) - family.llk(coef - e, splits, ys, xs)) / (2 * step))
    assert np.allclose(family.gradient(coef, splits, ys, xs), want, rtol=1e-4, atol=1e-4)


def test_other_lambdas_by_new_fits(data):
    plain = GAMM(Formula(lhs("y"), [i(), f(["x0"], nk=6)])).fit(data)
    rho = solve.get_logs(plain.fitted.penalties) + 0.5
    new, near = inference.refits(plain, data)(rho), inference.candidate(plain, rho)
    assert np.allclose(new[1], near[1], atol=1e-6)
    counts = data.withColumn("n", F.floor(F.abs("y")).cast("double"))
    m = GAMM(Formula(lhs("n"), [i(), f(["x0"], nk=6)]), fam.Poisson()).fit(counts)
    at = inference.refits(m, counts)
    rho = solve.get_logs(m.fitted.penalties)
    assert np.allclose(at(rho)[1], m.fitted.coef, atol=1e-4) and np.isclose(at(rho)[0], m.fitted.reml, atol=1e-3)
    assert at(rho + 3)[0] < at(rho)[0] and at(rho - 3)[0] < at(rho)[0] + 1e-6
    assert inference.correct_covariance(m, refit=at)[1] >= m.fitted.edf


def _many_series(states, families, ends_with_last, slopes=False):
    rng = np.random.default_rng(states)
    fixed = states == 2
    move = np.array([[0.0, 1.0], [1.0, 0.0]]) if fixed else None
    family = HSMMFamily(states, families, 7, move=move, first=np.full(states, 1 / states) if fixed else None, ends_with_last=ends_with_last)
    sizes = [1, 30, 5, 1, 12, 30, 8, 2]
    n, starts = sum(sizes), np.append(0, np.cumsum(sizes)[:-1])
    ys = [rng.normal(size=n) + 3 * (np.arange(n) % 9 > 4), rng.gamma(2.0, 1.0, n)][: len(families)]
    group = np.repeat(np.arange(len(sizes)) % 2, sizes)
    xs = [np.column_stack((np.ones(n), rng.normal(size=n) if k < states * sum(f.n_par for f in families) or slopes else group)) for k in range(family.n_par)]
    splits = list(range(0, 2 * family.n_par + 1, 2))
    return family, starts, ys, xs, splits, rng


@pytest.mark.parametrize(("states", "two", "last", "slopes"), [(2, True, False, False), (2, False, True, False), (3, False, False, False), (3, True, True, True)])
def test_semi_markov_series_at_once_equal_single_ones(states, two, last, slopes):
    from knotwork.plans import chains
    from knotwork.plans.hsmm import forward_residuals
    from knotwork.plans.joint import each_series

    family, starts, ys, xs, splits, rng = _many_series(states, [fam.GAUMLSS(), fam.GAMMALS()] if two else [fam.GAUMLSS()], last, slopes)
    coefs = list(rng.normal(0, 0.3, (5, splits[-1])))
    coefs[3][0] = np.nan  # no finite likelihood
    parts = list(each_series(ys, xs, starts))
    with np.errstate(all="ignore"):
        got, want = family.series_llks(coefs, splits, ys, xs, starts), np.stack([family.llks(coefs, splits, *p) for p in parts])
    assert np.isnan(got[:, 3]).all() and np.allclose(got[:, [0, 1, 2, 4]], want[:, [0, 1, 2, 4]], rtol=1e-10)
    assert np.allclose(family.series_gradient(coefs[0], splits, ys, xs, starts), sum(family.gradient(coefs[0], splits, *p) for p in parts), rtol=1e-8, atol=1e-8)
    ys[0][starts[1] : starts[2]] = np.nan  # one series has none
    with np.errstate(all="ignore"):
        bad = family.series_gradient(coefs[0], splits, ys, xs, starts)
        assert np.allclose(bad, sum(family.gradient(coefs[0], splits, *p) for k, p in enumerate(parts) if k != 1), rtol=1e-8, atol=1e-8)
    family, starts, ys, xs, splits, rng = _many_series(states, family.families, last, slopes)
    parts, seen = list(each_series(ys, xs, starts)), 0
    for lane in family.lanes(xs, starts):
        y, x = [v[lane.perm] for v in ys], [v[lane.perm] for v in xs]
        tables = [v[0] for v in family.tables([coefs[0]], splits, x)]
        emit = np.array(family.emissions(coefs[0], splits, y, x, {}))
        states_of, rest = chains.viterbi(lane, emit, *tables, last)
        cdf = rng.uniform(size=emit.shape)
        u = chains.mixtures(lane, emit, *tables, last, cdf)
        for k, number in enumerate(lane.series):
            c, _ = family.chain(coefs[0], splits, *parts[number])
            own, end, _ = viterbi(c)
            mine = lane.rank() == k
            assert (states_of[mine] == own).all() and rest[k] == end
            assert np.allclose(normal_ppf(u[mine]), forward_residuals(c, cdf[:, mine].T))
            seen += 1
    assert seen == len(starts)


def test_many_series_cost_far_less_than_one_by_one():
    from time import perf_counter

    from knotwork.plans.joint import each_series

    family = HSMMFamily(2, [fam.GAUMLSS()], 12, move=np.array([[0.0, 1.0], [1.0, 0.0]]), first=np.array([0.5, 0.5]))
    y, starts = np.random.default_rng(1).normal(size=200 * 60), np.arange(200) * 60
    xs, splits, coef = [np.ones((len(y), 1))] * 8, list(range(9)), np.array([0.0, 0, 1, 0, 1, -1, 1, -1])
    coefs = [coef + 0.01 * k for k in range(8)]
    began = perf_counter()
    together = family.series_llks(coefs, splits, [y], xs, starts), family.series_gradient(coef, splits, [y], xs, starts)
    middle = perf_counter()
    alone = [(family.llks(coefs, splits, *p), family.gradient(coef, splits, *p)) for p in each_series([y], xs, starts)]
    assert 3 * (middle - began) < perf_counter() - middle
    assert np.allclose(together[0], [a for a, _ in alone]) and np.allclose(together[1], sum(b for _, b in alone))


def test_series_reach_a_task_whole(spark):
    from knotwork.operators.partials import in_series, whole_series

    d = spark.range(40000).select((F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 40009).alias("t"))
    d = d.withColumn("g", F.when(F.col("g") != 3, F.col("g"))).withColumn("t", F.when(F.col("t") % 1000 != 0, F.col("t")))

    schema = pa.schema({"g": pa.float64(), "n": pa.int64(), "kinds": pa.int64(), "sorted": pa.bool_()})

    def run(batches):
        for table in whole_series(batches, 1000):
            p = table.to_pandas()
            number = p._first.cumsum()
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"g": p.groupby(number).g.first(), "n": p.groupby(number).size(), "kinds": p.groupby(number).g.nunique(dropna=False), "sorted": [bool(v.is_monotonic_increasing) for _, v in p.t.fillna(1e9).groupby(number)]}), schema, preserve_index=False)

    got = in_series(d, "g", ("t",)).mapInArrow(run, "g double, n long, kinds long, sorted boolean").toPandas()
    assert len(got) == 7 and got.n.sum() == 40000 and (got.kinds == 1).all() and got.sorted.all()


def _decoded(series, alone):
    """Times of decoding many series at once and one by one."""
    from time import perf_counter

    family = HSMMFamily(2, [fam.GAUMLSS()], 12, move=np.array([[0.0, 1.0], [1.0, 0.0]]), first=np.array([0.5, 0.5]))
    y, starts = np.random.default_rng(1).normal(size=200 * 60), np.arange(200) * 60
    xs, splits, coef = [np.ones((len(y), 1))] * 8, list(range(9)), np.array([0.0, 0, 1, 0, 1, -1, 1, -1])
    lane = family.lanes(xs, starts)[0]
    emit, tables = np.array(family.emissions(coef, splits, [y[lane.perm]], xs, {})), [v[0] for v in family.tables([coef], splits, xs)]
    began = perf_counter()
    series(lane, emit, *tables, False)
    middle = perf_counter()
    for k in range(0, len(y), 60):
        alone(family.chain(coef, splits, [y[k : k + 60]], [x[k : k + 60] for x in xs])[0])
    return middle - began, perf_counter() - middle


def test_residuals_of_many_series_cost_far_less_than_one_by_one():
    from knotwork.plans import chains
    from knotwork.plans.hsmm import forward_residuals

    cdf = np.full((2, 200 * 60), 0.5)
    many, single = _decoded(lambda *a: chains.mixtures(*a, cdf), lambda c: forward_residuals(c, np.full((60, 2), 0.5)))
    assert 3 * many < single


def test_decoding_many_series_costs_far_less_than_one_by_one():
    from knotwork.plans import chains

    many, single = _decoded(chains.viterbi, viterbi)
    assert 3 * many < single
