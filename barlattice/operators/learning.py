"""Walk-forward ranking models.

All folds are fitted together: a training row carries its decision date, linear models need one aggregate of moments
per pass over all folds (partial sums before the shuffle), and only the p x p systems are solved one by one.  Trees grow level by
level, or round by round, from sums per bin of all folds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.indicators import FEATURES, feature_vector
from barlattice.session import pin

NAMES = list(FEATURES)


def forward_label(df: DataFrame, h: int, *, key="sym", ts="d", c="c") -> DataFrame:
    """Return over the next h own bars and the time at which it is known."""
    w = Window.partitionBy(key).orderBy(ts)
    fwd = F.lead(c, h).over(w) / F.nullif(F.col(c), F.lit(0e0)) - 1
    return df.withColumn("fwd", F.when(F.col(c) > 0, fwd)).withColumn("label_ts", F.lead(ts, h).over(w))


def labelled_features(panel: DataFrame, h: int) -> DataFrame:
    return feature_vector(forward_label(panel, h)).filter("fwd is not null")


def retrain_dates(master: DataFrame, rebalance: int, train_every: int) -> DataFrame:
    """Decision dates on which the model is trained: every round(train_every / rebalance)-th one."""
    return master.filter(F.col("gi") % retrain_step(rebalance, train_every) == 0).select(F.col("gi").alias("dec"), F.col("d").alias("dec_d"))


def training_set(rows: DataFrame, master: DataFrame, decisions: DataFrame, lookback: int, stride: int = 5) -> DataFrame:
    """Rows of every decision's fold: anchors every ``stride`` slots of the last ``lookback``, labels closed before it.

    The anchors of a decision are generated from its index and joined by equality.
    """
    first = F.greatest(F.col("dec") - lookback, F.lit(0))
    a = decisions.filter("dec > 0").withColumn("gi", F.explode(F.sequence(first.cast("bigint"), (F.col("dec") - 1).cast("bigint"), F.lit(stride).cast("bigint"))))
    a = a.join(master.select(F.col("gi").cast("bigint").alias("gi"), "d"), "gi")
    return a.join(rows, "d").filter(F.col("label_ts") < F.col("dec_d"))


def tercile_label(train: DataFrame, *, by=("dec", "gi")) -> DataFrame:
    """1 for the best third of an anchor's names by forward return (at least one; ties with the threshold count)."""
    w = Window.partitionBy(*by)
    x = train.withColumn("_r", F.row_number().over(w.orderBy(F.col("fwd").desc())))
    cut = F.greatest(F.floor(F.count("*").over(w) / 3), F.lit(1))
    x = x.withColumn("_cut", cut)
    x = x.withColumn("_thr", F.max(F.when(F.col("_r") == F.col("_cut"), F.col("fwd"))).over(w))
    return x.withColumn("top", F.when(F.col("fwd") >= F.col("_thr"), 1e0).otherwise(0e0)).drop("_r", "_cut", "_thr")


def fold_stats(train: DataFrame, features=NAMES, by="dec") -> DataFrame:
    """Mean and population std per fold and feature (a dead feature gets std 1), and the fold's size."""
    g = train.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features],
                              *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    return g.select(by, "n", *[F.col(f"m_{f}") for f in features], *[F.when(F.col(f"s_{f}") > 1e-9, F.col(f"s_{f}")).otherwise(1e0).alias(f"s_{f}") for f in features])


def apply_stats(df: DataFrame, stats: DataFrame, features=NAMES, by="dec") -> DataFrame:
    """Adds z_ columns; one statistics row per fold, so that side is broadcast."""
    x = df.join(stats, by)
    return x.select(*df.columns, "n", *[((F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}")).alias(f"z_{f}") for f in features])


def standardize_fold(train: DataFrame, features=NAMES, by="dec") -> tuple[DataFrame, DataFrame]:
    stats = fold_stats(train, features, by)
    return apply_stats(train, stats, features, by), stats


def _terms(features) -> list[Column]:
    return [F.lit(1e0), *[F.col(f"z_{f}") for f in features]]


def moments(z: DataFrame, y: Column, weight: Column | None = None, *, features=NAMES, by="dec") -> DataFrame:
    """One aggregate per fold: upper triangle of X'WX as ``h``, X'y as ``g``, rows as ``n``."""
    t = _terms(features)
    p = len(t)
    wt = F.lit(1e0) if weight is None else weight
    hs = [F.sum(t[i] * t[j] * wt) for i in range(p) for j in range(i, p)]
    gs = [F.sum(t[i] * y) for i in range(p)]
    names = [f"_h{i}" for i in range(len(hs))], [f"_g{i}" for i in range(p)]
    a = z.groupBy(by).agg(*[e.alias(n) for e, n in zip(hs, names[0])], *[e.alias(n) for e, n in zip(gs, names[1])], F.count("*").alias("n"))
    return a.select(by, "n", F.array(*names[0]).alias("h"), F.array(*names[1]).alias("g"))


def solve_moments(mom: DataFrame, lam: float, *, by="dec", base: str | None = None) -> DataFrame:
    """(by, n, w): solves (H + lam I) w = g per fold, the bias unpenalised; with ``base`` a Newton step from it."""
    ty = mom.schema[by].dataType.simpleString()

    def run(it):
        for pdf in it:
            out = []
            for h, g, *rest in zip(pdf["h"], pdf["g"], *([pdf[base]] if base else [])):
                g = np.asarray(g, float)
                p = len(g)
                m = np.zeros((p, p))
                m[np.triu_indices(p)] = np.asarray(h, float)
                m = m + np.triu(m, 1).T
                m[range(1, p), range(1, p)] += lam
                w0 = np.asarray(rest[0], float) if base else np.zeros(p)
                if base:
                    g = g.copy()
                    g[1:] -= lam * w0[1:]
                try:
                    w = w0 + np.linalg.solve(m, g)
                except np.linalg.LinAlgError:
                    w = np.full(p, np.nan)
                out.append([float(v) for v in w] if np.isfinite(w).all() else None)
            yield pd.DataFrame({by: pdf[by], "n": pdf["n"], "w": out})

    cols = [by, "n", "h", "g", *([base] if base else [])]
    return mom.select(*cols).mapInPandas(run, f"{by} {ty}, n bigint, w array<double>")


def fit_ridge(z: DataFrame, lam: float, y="fwd", *, features=NAMES, by="dec") -> DataFrame:
    return solve_moments(moments(z, F.col(y), features=features, by=by), lam, by=by)


def dot(w: Column, features=NAMES) -> Column:
    t = _terms(features)
    return reduce(lambda a, b: a + b, [F.get(w, F.lit(i)) * t[i] for i in range(len(t))])


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-3e1), F.least(F.lit(3e1), v))))


def fit_logistic(z: DataFrame, lam: float, y="top", *, features=NAMES, by="dec", steps: int = 8) -> DataFrame:
    """L2 logistic regression by Newton steps, all folds in every pass; the bias is unpenalised."""
    p = len(features) + 1
    z = pin(z)
    w = z.select(by).distinct().withColumn("w", F.array(*[F.lit(0e0)] * p))
    for _ in range(steps):
        pr = sigmoid(dot(F.col("w"), features))
        x = z.join(w.select(by, "w"), by)  # one weight row per fold
        x = x.withColumn("_pr", pr)
        m = moments(x, F.col(y) - F.col("_pr"), F.greatest(F.col("_pr") * (1 - F.col("_pr")), F.lit(1e-6)), features=features, by=by)
        w = pin(solve_moments(m.join(w.select(by, F.col("w").alias("w0")), by), lam, by=by, base="w0"))
    return w


def retrain_step(rebalance: int, train_every: int) -> int:
    """Bars between trainings: ``train_every`` rounded to whole rebalances, at least one."""
    return rebalance * max(1, int(train_every / rebalance + 0.5))


def score_linear(rows: DataFrame, stats: DataFrame, weights: DataFrame, min_train: int, *, logistic=False, features=NAMES) -> DataFrame:
    """(gi, sym, model): model score of candidate rows that carry ``dec``; null while the fold is too small."""
    z = apply_stats(rows, stats, features)
    x = z.drop("n").join(weights.select("dec", "n", "w"), "dec", "left")  # one row per fold
    v = dot(F.col("w"), features)
    v = sigmoid(v) if logistic else v
    return x.select("gi", "sym", F.when((F.col("n") >= min_train) & F.col("w").isNotNull(), v).alias("model"))


# ---- tree models -----------------------------------------------------------------------------------------------------
#
# Features are cut at quantiles of their fold, so a tree needs sums per bin only.  All folds grow together: an aggregate is keyed by fold, its
# partial sums are formed before the shuffle, and its size depends on bins and features, not on rows.

BINS = 32
LEAF_SHARE = 5e-2


def bin_edges(z: DataFrame, *, features=NAMES, by="dec", bins: int = BINS) -> DataFrame:
    """(by, n, edges): rows of each fold and its candidate thresholds per feature, ascending values that rows have."""
    q = [k / bins for k in range(1, bins)]
    edges = [F.array_sort(F.array_distinct(F.percentile_approx(f"z_{f}", q, 10_000))) for f in features]
    return z.groupBy(by).agg(F.count("*").alias("n"), F.array(*edges).alias("edges"))


def _zs(features) -> Column:
    return F.array(*[F.col(f"z_{f}") for f in features])


def _binned(z: DataFrame, edges: DataFrame, features, by) -> DataFrame:
    """Adds ``bins``: for each feature how many thresholds lie below the row's value; bin k holds the values up to threshold k."""
    bins = [F.size(F.filter(F.get("edges", F.lit(k)), lambda e: e < F.col(f"z_{f}"))) for k, f in enumerate(features)]  # noqa: B023
    return z.join(edges, by).withColumn("bins", F.array(*bins)).drop("edges")


def _with_thresholds(edges: str, feat: Column, at: Column) -> Column:
    return F.get(F.get(F.col(edges), feat), at)


def fit_gbm(z: DataFrame, y="fwd", *, rounds=40, rate=1e-1, features=NAMES, by="dec", bins: int = BINS, edges: DataFrame | None = None) -> DataFrame:
    """Boosted one-split trees of every fold: (by, n, base, stumps, importance); leaves hold at least 5 % of the fold.

    A stump changes the residual sum of every bin by its leaf values times the rows that the two bins share.  So one aggregate, counts of all
    pairs of bins and sums per bin, is enough for all rounds of all folds; boosting then works on (features x bins) squared numbers.
    """
    edges = bin_edges(z, features=features, by=by, bins=bins) if edges is None else edges
    p = len(features)
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(g).alias("g"), F.get("bins", F.lit(f)).alias("a"), F.get("bins", F.lit(g)).alias("b")) for f in range(p) for g in range(f, p)])
    x = _binned(z, edges, features, by).select(by, F.col(y).cast("double").alias("_y"), F.explode(pairs).alias("c"))
    cells = x.groupBy(by, "c.f", "c.g", "c.a", "c.b").agg(F.count("*").alias("rows"), F.sum("_y").alias("total"))
    ty = z.schema[by].dataType.simpleString()

    def boost(pdf: pd.DataFrame) -> pd.DataFrame:
        f, g, a, b = (pdf[c].to_numpy() for c in "fgab")
        rows, total = pdf["rows"].to_numpy(float), pdf["total"].to_numpy(float)
        shared = np.zeros((p, bins, p, bins))
        shared[f, a, g, b] = rows
        shared[g, b, f, a] = rows
        own = f == g
        count, left_over = np.zeros((p, bins)), np.zeros((p, bins))
        count[f[own], a[own]], left_over[f[own], a[own]] = rows[own], total[own]
        n = count[0].sum()
        base = left_over[0].sum() / n
        left_over = left_over - base * count
        least = max(1, int(n * LEAF_SHARE))
        n_left = np.cumsum(count, axis=1)
        stumps, gains = [], np.zeros(p)
        for _ in range(rounds):
            low, whole = np.cumsum(left_over, axis=1), left_over[0].sum()
            with np.errstate(all="ignore"):
                gain = low**2 / n_left + (whole - low) ** 2 / (n - n_left) - whole**2 / n
            gain = np.where((n_left >= least) & (n - n_left >= least), gain, -np.inf)
            feat, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if not gain[feat, at] > 1e-12:
                break
            lo, hi = rate * low[feat, at] / n_left[feat, at], rate * (whole - low[feat, at]) / (n - n_left[feat, at])
            left_over = left_over - lo * shared[feat, :at + 1].sum(axis=0) - hi * shared[feat, at + 1:].sum(axis=0)
            gains[feat] += gain[feat, at]
            stumps.append({"feat": int(feat), "at": int(at), "left": float(lo), "right": float(hi)})
        share = gains / gains.sum() if gains.sum() > 0 else gains
        return pd.DataFrame({by: [pdf[by].iloc[0]], "base": [base], "s": [stumps], "importance": [share.tolist()]})

    # one group holds a fold's cells, at most (features * bins) ** 2 of them
    out = cells.groupBy(by).applyInPandas(boost, f"{by} {ty}, base double, s array<struct<feat:int,at:int,left:double,right:double>>, importance array<double>")
    stump = F.transform("s", lambda r: F.struct(r["feat"].alias("feat"), _with_thresholds("edges", r["feat"], r["at"]).alias("thr"), r["left"].alias("left"), r["right"].alias("right")))
    return out.join(edges, by).select(by, "n", "base", stump.alias("stumps"), "importance")


def predict_gbm(rows: DataFrame, model: DataFrame, *, features=NAMES, by="dec", out="prediction") -> DataFrame:
    x = rows.join(model.select(by, "base", "stumps"), by)  # one row per fold
    value = F.aggregate("stumps", F.col("base"), lambda v, s: v + F.when(F.get("_z", s["feat"]) <= s["thr"], s["left"]).otherwise(s["right"]))
    return x.withColumn("_z", _zs(features)).select(*rows.columns, value.alias(out))


def _draws(row: Column) -> Column:
    """How often a row is drawn: Poisson with mean 1, from its hash; resampling that needs no order and no fold size."""
    u = F.pmod(row, F.lit(1 << 53)) / float(1 << 53)
    upto, term, out = 0.0, float(np.exp(-1)), F.lit(0)
    for k in range(1, 9):
        upto, term = upto + term, term / k
        out = out + F.when(u >= upto, 1).otherwise(0)
    return out


def _choice(trees: int, depth: int, features: int, seed: int) -> list[list[list[int]]]:
    """Features that a node may split on, by tree and node number."""
    take = max(1, round(features**0.5))
    rng = np.random.default_rng(seed)
    return [[sorted(rng.choice(features, take, replace=False).tolist()) for _ in range(2**depth)] for _ in range(trees)]


def fit_forest(z: DataFrame, y="fwd", *, trees=24, depth=3, features=NAMES, by="dec", bins: int = BINS, seed=7, edges: DataFrame | None = None) -> DataFrame:
    """Regression trees on resampled rows: (by, n, trees, depth, nodes, importance); every level of all trees of all folds is one aggregate.

    ``nodes`` is indexed by ``tree * 2 ** (depth + 1) + node``, a node's children being 2 k and 2 k + 1 and the root 1: feature, threshold, mean.
    """
    edges = pin(bin_edges(z, features=features, by=by, bins=bins) if edges is None else edges)
    width, choice = 2 ** (depth + 1), _choice(trees, depth, len(features), seed)
    x = _binned(z, edges, features, by).select(by, "n", F.col(y).cast("double").alias("_y"), F.xxhash64(*[f"z_{f}" for f in features], y).alias("_row"), "bins")
    x = pin(x)
    splits, ends = None, None
    for d in range(depth):
        rows = x.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        rows = rows.withColumn("_w", _draws(F.xxhash64("_row", "tree"))).filter("_w > 0").withColumn("node", F.lit(1))
        if splits is not None:  # down to the level's nodes by the splits so far, one small row per fold
            rows = rows.join(splits.groupBy(by).agg(_indexed(F.col("tree") * width + F.col("node"), F.struct("feat", "at"), trees * width).alias("_tree")), by)
            for _ in range(d):
                cut = F.get("_tree", F.col("tree") * width + F.col("node"))
                rows = rows.withColumn("node", F.when(cut.isNotNull(), 2 * F.col("node") + F.when(F.get("bins", cut["feat"]) > cut["at"], 1).otherwise(0)).otherwise(-1))
            rows = rows.filter(F.col("node") >= 2**d)
        allowed = F.get(F.get(F.lit(choice), F.col("tree")), F.col("node"))
        cells = rows.select(by, "n", "tree", "node", "_y", "_w", "bins", F.explode(allowed).alias("feat")).withColumn("at", F.get("bins", F.col("feat")))
        cells = cells.groupBy(by, "n", "tree", "node", "feat", "at").agg(F.sum("_w").alias("k"), F.sum(F.col("_w") * F.col("_y")).alias("s"))
        level = pin(_best_splits(cells, by))
        if d == 0:
            ends = level.select(by, "tree", F.lit(1).alias("node"), (F.col("s") / F.col("k")).alias("mean"))
        cutting = level.filter("feat is not null")
        splits = cutting if splits is None else splits.unionByName(cutting)
        sides = F.array(F.struct((2 * F.col("node")).alias("node"), (F.col("sl") / F.col("kl")).alias("mean")), F.struct((2 * F.col("node") + 1).alias("node"), ((F.col("s") - F.col("sl")) / (F.col("k") - F.col("kl"))).alias("mean")))
        ends = ends.unionByName(cutting.select(by, "tree", F.inline(sides)))
    known = ends.join(splits.select(by, "tree", "node", "feat", "at", "gain"), [by, "tree", "node"], "left").join(edges.select(by, "edges"), by)
    entry = F.struct("feat", _with_thresholds("edges", F.col("feat"), F.col("at")).alias("thr"), "mean")
    gains = [F.coalesce(F.sum(F.when(F.col("feat") == k, F.col("gain"))), F.lit(0e0)) for k in range(len(features))]
    model = known.groupBy(by).agg(_indexed(F.col("tree") * width + F.col("node"), entry, trees * width).alias("nodes"), F.array(*gains).alias("g"))
    total = F.aggregate("g", F.lit(0e0), lambda v, e: v + e)
    share = F.transform("g", lambda v: F.when(F.col("_t") > 0, v / F.nullif(F.col("_t"), F.lit(0e0))).otherwise(0e0))
    return model.withColumn("_t", total).join(edges.select(by, "n"), by).select(by, "n", F.lit(trees).alias("trees"), F.lit(depth).alias("depth"), "nodes", share.alias("importance"))


def _indexed(at: Column, value: Column, size: int) -> Column:
    """An array of ``size`` entries, null where the group has none."""
    entries = F.map_from_entries(F.collect_list(F.struct(at.alias("k"), value.alias("v"))))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at(entries, i))


def _best_splits(cells: DataFrame, by) -> DataFrame:
    """Per node its rows ``k`` and sum ``s``, and the best split (feature, threshold index, gain, left rows and sum), null if none is allowed."""
    spec = [by, "n", "tree", "node", "feat"]
    upto = Window.partitionBy(*spec).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    x = cells.select(*spec, "at", F.sum("k").over(upto).alias("kl"), F.sum("s").over(upto).alias("sl"), F.sum("k").over(Window.partitionBy(*spec)).alias("k"), F.sum("s").over(Window.partitionBy(*spec)).alias("s"))
    least = F.greatest(F.lit(2), F.floor(F.col("n") * LEAF_SHARE))
    kr, sr = F.col("k") - F.col("kl"), F.col("s") - F.col("sl")
    gain = F.col("sl") * F.col("sl") / F.col("kl") + sr * sr / F.nullif(kr, F.lit(0)) - F.col("s") * F.col("s") / F.col("k")
    x = x.withColumn("gain", F.when((F.col("kl") >= least) & (kr >= least) & (gain > 1e-12), gain))
    best = F.max_by(F.struct("feat", "at", "gain", "kl", "sl"), F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col("feat")).alias("f"), (-F.col("at")).alias("a"))))
    g = x.groupBy(by, "tree", "node").agg(best.alias("b"), F.first("k").alias("k"), F.max_by("s", -F.col("feat")).alias("s"))
    return g.select(by, "tree", "node", "k", "s", "b.feat", "b.at", "b.gain", "b.kl", "b.sl")


def predict_forest(rows: DataFrame, model: DataFrame, *, features=NAMES, by="dec", out="prediction") -> DataFrame:
    """Mean over the trees of the leaf each row falls in."""
    x = rows.join(model.select(by, F.col("trees").alias("_trees"), F.col("depth").alias("_depth"), "nodes"), by).withColumn("_z", _zs(features))
    width = F.size("nodes") / F.col("_trees")

    def step(tree, node):
        cut = F.get("nodes", (tree * width + node).cast("int"))
        return F.when(cut["feat"].isNull(), node).otherwise(2 * node + F.when(F.get("_z", cut["feat"]) > cut["thr"], 1).otherwise(0))

    def leaf(tree):
        node = F.aggregate(F.sequence(F.lit(1), F.col("_depth")), F.lit(1), lambda at, _: step(tree, at))
        return F.get("nodes", (tree * width + node).cast("int"))["mean"]

    means = F.filter(F.transform(F.sequence(F.lit(0), F.col("_trees") - 1), leaf), lambda v: v.isNotNull())  # a tree may have drawn no row
    return x.withColumn("_m", means).select(*rows.columns, (F.aggregate("_m", F.lit(0e0), lambda a, v: a + v) / F.nullif(F.size("_m"), F.lit(0))).alias(out))


TREES = {"gbm": (fit_gbm, predict_gbm), "forest": (fit_forest, predict_forest)}


def feature_importance(model: DataFrame, features=NAMES, by="dec") -> DataFrame:
    """Normalised gains of tree models, one row per fold and feature."""
    return model.select(by, F.inline(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("importance").alias("importance"))))


def weight_importance(weights: DataFrame, features=NAMES, by="dec") -> DataFrame:
    """Weights of a linear model per fold and feature, with their share of the absolute sum."""
    w = F.transform(F.sequence(F.lit(1), F.lit(len(features))), lambda i: F.get(F.col("w"), i))
    x = weights.filter("w is not null").select(by, F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), w.alias("weight")).alias("z"))
    total = F.aggregate("z", F.lit(0e0), lambda a, e: a + F.abs(e["weight"]))
    x = x.withColumn("_t", total).select(by, "_t", F.inline("z"))
    return x.select(by, "feature", "weight", F.when(F.col("_t") > 0, F.abs("weight") / F.nullif(F.col("_t"), F.lit(0e0))).otherwise(0e0).alias("importance"))


def walk_forward_scores(panel: DataFrame, master: DataFrame, candidates: DataFrame, *, model="ridge", horizon=21, lookback=504, stride=5,
                        lam=1e0, rebalance=21, train_every=252, min_train=60) -> DataFrame:
    """(gi, sym, model): point-in-time score of every candidate at every decision, null where the rule must rank.

    ``candidates``: (gi, sym, features), already as of the decision.  All folds of a model are fitted together.
    """
    decs = pin(retrain_dates(master, rebalance, train_every))
    train = pin(training_set(labelled_features(panel, horizon), master, decs, lookback, stride))
    # the model in force is the one trained at the last training slot: arithmetic on the slot, no range join
    cand = candidates.withColumn("dec", F.col("gi") - F.col("gi") % retrain_step(rebalance, train_every))
    z, stats = standardize_fold(train)
    stats = pin(stats)
    if model == "ridge":
        return score_linear(cand, stats, fit_ridge(apply_stats(train, stats), lam), min_train)
    if model == "logistic":
        lab = tercile_label(train)
        return score_linear(cand, stats, fit_logistic(apply_stats(lab, stats), lam), min_train, logistic=True)
    fit, predict = TREES[model]
    scored = predict(apply_stats(cand, stats), fit(apply_stats(train, stats).drop("n")), out="model")
    return scored.select("gi", "sym", F.when(F.col("n") >= min_train, F.col("model")).alias("model"))
