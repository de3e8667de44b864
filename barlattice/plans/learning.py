"""Walk-forward learning queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from barlattice.functions.indicators import FEATURES, with_indicators
from barlattice.operators import learning as N
from barlattice.operators import xsection as X
from barlattice.plans.indicators import FEATURE_CTE, FEATURE_OK, FEATURE_SQL, W
from barlattice.plans.registry import query, rr
from barlattice.plans.xsection import EVERY, MST, V, master
from barlattice.session import pin

H, LB, STRIDE, TRAIN_EVERY, LAM = 21, 504, 5, 504, 1e0
NAMES = N.NAMES
RE = EVERY * round(TRAIN_EVERY / EVERY)


@query("forward_label", "candles_daily", f"select sym, d, round(lead(c, {H}) over ({W})/c - 1, 8) + 0e0 fwd, lead(d, {H}) over ({W}) label_ts from candles_daily")
def forward_label(t):
    return N.forward_label(t.candles_daily, H).select("sym", "d", rr("fwd", 8).alias("fwd"), "label_ts")


TRAIN = f"""{MST}, {FEATURE_CTE}, fl as (select *, lead(c, {H}) over ({W})/c - 1 fwd, lead(d, {H}) over ({W}) label_ts from feats),
  lf as (select * from fl where {FEATURE_OK} and fwd is not null),
  decs as (select gi dc, d dc_d from mst where gi % {RE} = 0 and gi > 0),
  anc as (select dc, dc_d, unnest(range(greatest(dc - {LB}, 0), dc, {STRIDE})) gi from decs),
  tr as (select anc.dc, anc.gi, lf.* from anc join mst m on m.gi = anc.gi join lf on lf.d = m.d where lf.label_ts < anc.dc_d)"""


def train(t):
    m = master(t)
    return pin(N.training_set(N.labelled_features(t.pin("candles_daily"), H), m, N.retrain_dates(m, EVERY, TRAIN_EVERY), LB, STRIDE))


@query("training_set", V, f"{TRAIN} select dc as dec, gi, sym, round(fwd, 8) + 0e0 fwd, round(mom63, 6) + 0e0 mom63, label_ts from tr")
def training_set(t):
    return train(t).select("dec", "gi", "sym", rr("fwd", 8).alias("fwd"), rr("mom63", 6).alias("mom63"), "label_ts")


@query("tercile_label", V, f"""{TRAIN}, r as (select *, row_number() over (partition by dc, gi order by fwd desc) r, greatest(count(*) over (partition by dc, gi)//3, 1) k from tr),
  th as (select *, max(case when r = k then fwd end) over (partition by dc, gi) thr from r)
  select dc as dec, gi, sym, case when fwd >= thr then 1e0 else 0e0 end top from th""")
def tercile_label(t):
    return N.tercile_label(train(t)).select("dec", "gi", "sym", "top")


STATS = (f"{TRAIN}, ss as (select dc, count(*) n, " + ", ".join(f"avg({f}) m_{f}, case when stddev_pop({f}) > 1e-9 then stddev_pop({f}) else 1e0 end s_{f}" for f in NAMES)
         + " from tr group by dc), zt as (select tr.dc, tr.gi, tr.sym, fwd, " + ", ".join(f"({f} - m_{f})/s_{f} z_{f}" for f in NAMES) + " from tr join ss using (dc))")


@query("standardize_fold", V, f"{STATS} select dc as dec, gi, sym, " + ", ".join(f"round(z_{f}, 6) + 0e0 z_{f}" for f in NAMES) + " from zt")
def standardize_fold(t):
    z, _ = N.standardize_fold(train(t))
    return z.select("dec", "gi", "sym", *[rr(f"z_{f}").alias(f"z_{f}") for f in NAMES])


def zfold(t):
    tr = train(t)
    z, stats = N.standardize_fold(tr)
    return tr, z, stats


_T = ["1e0"] + [f"z_{f}" for f in NAMES]
_MOM = ", ".join([f"round(sum({a}*{b}), 4) + 0e0 h_{i}_{j}" for i, a in enumerate(_T) for j, b in enumerate(_T) if j >= i] + [f"round(sum({a}*fwd), 6) + 0e0 g_{i}" for i, a in enumerate(_T)])


@query("ridge_moments", V, f"{STATS} select dc as dec, count(*) n, {_MOM} from zt group by dc")
def ridge_moments(t):
    _, z, _ = zfold(t)
    m = N.moments(z, F.col("fwd"))
    p = len(_T)
    tri = [(i, j) for i in range(p) for j in range(i, p)]
    return m.select("dec", "n", *[rr(F.get("h", F.lit(k)), 4).alias(f"h_{i}_{j}") for k, (i, j) in enumerate(tri)], *[rr(F.get("g", F.lit(i)), 6).alias(f"g_{i}") for i in range(p)])


P = len(_T)
LIST = "[" + ", ".join(_T) + "]"


def solve_sql(name: str, p: int) -> str:
    """CTEs that eliminate ``{name}0 (dc, i, j, v)``, p equations with the right side as column p; ``{name}{p}`` holds the solution there."""
    step = """{n}{k1} as materialized (select t.dc, t.i, t.j, case when t.i = {k} then t.v/d.v else t.v - f.v*r.v/d.v end v from {n}{k} t join {n}{k} d on d.dc = t.dc and d.i = {k} and d.j = {k}
   join {n}{k} r on r.dc = t.dc and r.i = {k} and r.j = t.j join {n}{k} f on f.dc = t.dc and f.i = t.i and f.j = {k})"""
    return ", ".join(step.format(n=name, k=k, k1=k + 1) for k in range(p))


IJ = f"(select cast(unnest(range({P})) as int) i) a, (select cast(unnest(range({P + 1})) as int) j) b"
RIDGE = f"""{STATS}, xs as (select dc, list_append({LIST}, fwd) x from zt), cn as (select dc, count(*) n from zt group by dc),
  r0 as materialized (select dc, i, j, sum(x[i + 1]*x[j + 1]) + case when i = j and i > 0 then {LAM} else 0e0 end v from xs, {IJ} group by 1, 2, 3), {solve_sql("r", P)}"""


def logistic_sql(steps: int = 8) -> str:
    dot = "list_sum(list_transform(range(1, " + str(P + 1) + "), lambda k: w[k]*x[k]))"
    out = [f"""{STATS}, tp as (select dc, gi, sym, case when fwd >= max(case when r = k then fwd end) over (partition by dc, gi) then 1e0 else 0e0 end y
    from (select *, row_number() over (partition by dc, gi order by fwd desc) r, greatest(count(*) over (partition by dc, gi)//3, 1) k from tr) q),
  xl as materialized (select dc, {LIST} x, y from zt join tp using (dc, gi, sym)), cn as (select dc, count(*) n from xl group by dc),
  w0 as materialized (select distinct dc, list_transform(range({P}), lambda k: 0e0) w from xl)"""]
    for s in range(steps):
        out.append(f"""p{s} as materialized (select dc, x, y, w, 1/(1 + exp(-greatest(-3e1, least(3e1, {dot})))) pr from xl join w{s} using (dc)),
  s{s}_0 as materialized (select dc, i, j, case when j < {P} then sum(x[i + 1]*x[j + 1]*greatest(pr*(1 - pr), 1e-6)) + case when i = j and i > 0 then {LAM} else 0e0 end
      else sum(x[i + 1]*(y - pr)) - case when i > 0 then {LAM}*any_value(w[i + 1]) else 0e0 end end v from p{s}, {IJ} group by 1, 2, 3),
  {solve_sql(f"s{s}_", P)},
  w{s + 1} as materialized (select dc, list_transform(range(1, {P + 1}), lambda k: w[k] + dw[k]) w from w{s} join (select dc, list(v order by i) dw from s{s}_{P} where j = {P} group by dc) q using (dc))""")
    return ", ".join(out)


@query("fit_ridge", V, f"{RIDGE} select dc as dec, n, i term, round(v, 6) + 0e0 weight from r{P} join cn using (dc) where j = {P}")
def fit_ridge(t):
    _, z, _ = zfold(t)
    return N.fit_ridge(z, LAM).select("dec", "n", F.posexplode("w").alias("term", "weight")).withColumn("weight", rr("weight", 6))


@query("fit_logistic", V, f"{logistic_sql()} select dc as dec, n, k - 1 term, round(w[k], 6) + 0e0 weight from w8 join cn using (dc), (select cast(unnest(range(1, {P + 1})) as int) k) q")
def fit_logistic(t):
    tr, _, stats = zfold(t)
    return N.fit_logistic(N.apply_stats(N.tercile_label(tr), stats), LAM).select("dec", "n", F.posexplode("w").alias("term", "weight")).withColumn("weight", rr("weight", 6))


def tree_predictions(t, model):
    fit, predict = N.TREES[model]
    z = pin(zfold(t)[1].drop("n"))
    return predict(z, fit(z)).select("dec", "gi", "sym", "fwd", "prediction")


@query("fit_gbm", V)
def fit_gbm(t):
    return tree_predictions(t, "gbm")


@query("fit_forest", V)
def fit_forest(t):
    return tree_predictions(t, "forest")


@query("feature_importance", V)
def feature_importance(t):
    _, z, _ = zfold(t)
    z = pin(z.drop("n"))
    parts = [N.feature_importance(fit(z)).select(F.lit(name).alias("model"), "dec", "feature", "importance") for name, (fit, _) in N.TREES.items()]
    parts.append(N.weight_importance(N.fit_ridge(z, LAM)).select(F.lit("ridge").alias("model"), "dec", "feature", "importance"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def ml_candidates(t):
    ind = with_indicators(t.pin("candles_daily"), {**FEATURES, "vol": ("vol", 20)})
    return X.decision_rows(ind, master(t), EVERY).na.drop(subset=NAMES)


@query("walk_forward_scores", V)
def walk_forward_scores(t):
    c = pin(ml_candidates(t).select("gi", "sym", "vol", *NAMES))
    s = N.walk_forward_scores(t.pin("candles_daily"), master(t), c.select("gi", "sym", *NAMES), horizon=H, lookback=LB, train_every=TRAIN_EVERY, lam=LAM)
    x = c.select("gi", "sym", F.col("mom63").alias("rule")).join(s, ["gi", "sym"], "left")
    return x.withColumn("score", X.score_fallback(F.col("model"), F.col("rule")))


def walk_forward(t, model):
    c = pin(ml_candidates(t).select("gi", "sym", *NAMES))
    return N.walk_forward_scores(t.pin("candles_daily"), master(t), c, model=model, horizon=H, lookback=LB, train_every=TRAIN_EVERY, lam=LAM)


@query("walk_forward_gbm", V)
def walk_forward_gbm(t):
    return walk_forward(t, "gbm")


@query("walk_forward_forest", V)
def walk_forward_forest(t):
    return walk_forward(t, "forest")


@query("walk_forward_logistic", V)
def walk_forward_logistic(t):
    return walk_forward(t, "logistic")
