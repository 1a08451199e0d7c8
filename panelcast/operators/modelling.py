"""Forecasting and classification on ``pyspark.ml`` plus metric SQL (ML1-ML18).

Model fitting is Spark ML (distributed tree learners); everything around it
(splits, weights, metrics, confusion matrices, thresholds, ensembles, drift,
AR(1) fallback forecasts) is DataFrame arithmetic, so it runs where the data is.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .aggregates import attach_params
from .frames import STATION_DATE, SeriesFrame, bounded
from .neighbours import nearest_neighbours
from .quantiles import kth_smallest

# Booster settings of the reference forecaster.
GBT_PARAMS = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
              "featureSubsetStrategy": "0.8", "seed": 42}


# ------------------------------------------------------------------ splits / weights

def stratified_split(df: DataFrame, label: str, key: Sequence[str], frac: float = 0.85, seed: int = 42,
                     out: str = "is_train") -> DataFrame:
    """Seeded stratified split (ML5): per class, the ``floor(frac * n_c)`` rows with the
    smallest ``xxhash64(key, seed)`` train.  The per-class cut is the exact k-th
    smallest 64-bit hash, so no class is ranked in one task."""
    h = F.xxhash64(*[F.col(k) for k in key], F.lit(seed))
    d = df.withColumn("_h", h)
    cut = kth_smallest(d, "_h", [label], F.floor(F.col("n") * frac), out="_cut")
    j = d.join(cut, label, "left")
    return j.withColumn(out, F.coalesce((F.col("_h") <= F.col("_cut")).cast("int"), F.lit(0))).drop("_h", "_cut")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``N / (K * n_c)`` per row (ML4), from one grouped count joined back."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = c.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = attach_params(c, tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(w, label, "left")  # one row per label; the planner knows how many


# ------------------------------------------------------------------ models

def assemble(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def fit_regressor(train: DataFrame, features: Sequence[str], target: str, **params) -> "Pipeline":
    """Boosted-tree regressor for one target (ML1); defaults are the reference's settings."""
    p = {**GBT_PARAMS, **params}
    gbt = GBTRegressor(featuresCol="features", labelCol=target, predictionCol=f"{target}_pred", **p)
    return Pipeline(stages=[assemble(features), gbt]).fit(train)


def fit_regressors(train: DataFrame, features: Sequence[str], targets: Sequence[str], **params) -> dict:
    """One regressor per target (ML8); the targets never feed each other."""
    return {t: fit_regressor(train.where(F.col(t).isNotNull()), [f for f in features if f not in targets], t, **params)
            for t in targets}


def fit_classifier(train: DataFrame, features: Sequence[str], label_idx: str, weight: str | None = "weight",
                   **params) -> "Pipeline":
    """Weighted multi-class forest with class probabilities (ML3)."""
    p = {"numTrees": 100, "maxDepth": 6, "seed": 42, **params}
    rf = RandomForestClassifier(featuresCol="features", labelCol=label_idx, weightCol=weight, **p)
    return Pipeline(stages=[assemble(features), rf]).fit(train)


def fit_boosted_classes(train: DataFrame, features: Sequence[str], label: str, classes: Sequence[str], weight: str | None = "weight",
                        **params) -> dict:
    """One weighted boosted model per class, its rows against all others (ML3); a class without rows, or with all, gets its share instead."""
    p = {**GBT_PARAMS, **params}
    n = train.groupBy(label).count().collect()  # one row per class
    counts = {r[label]: r["count"] for r in n}
    out: dict = {}
    for c in classes:
        share = counts.get(c, 0) / max(sum(counts.values()), 1)
        if share in (0, 1):
            out[c] = share
            continue
        gbt = GBTClassifier(featuresCol="features", labelCol="_is_class", weightCol=weight, **p)
        out[c] = Pipeline(stages=[assemble(features), gbt]).fit(train.withColumn("_is_class", (F.col(label) == c).cast("double")))
    return out


def boosted_probabilities(df: DataFrame, models: Mapping[str, object], prefix: str = "prob_", out: str = "predicted") -> DataFrame:
    """``prob_<class>`` (the class models' probabilities, normalised to sum 1) and the likeliest class (ML3, ML17)."""
    names = {c: f"{prefix}{c.lower().replace(' ', '_')}" for c in models}
    x, kept = df, list(df.columns)
    for c, m in models.items():
        if isinstance(m, (int, float)):
            x = x.withColumn(names[c], F.lit(float(m)))
        else:
            x = m.transform(x).select(*kept, vector_to_array("probability")[1].alias(names[c]))
        kept = x.columns
    total = sum((F.col(n) for n in names.values()), F.lit(0.0))
    x = x.select(*df.columns, *[F.coalesce(F.try_divide(F.col(n), total), F.lit(1.0 / len(names))).alias(n) for n in names.values()])
    return x.withColumn(out, attach_category(list(names.values()), list(models))[0])


def probability_columns(scored: DataFrame, classes: Sequence[str], prob: str = "probability",
                        prefix: str = "prob_") -> DataFrame:
    """``prob_<class>`` columns and the decoded label (ML17)."""
    arr = vector_to_array(F.col(prob))
    cols = {f"{prefix}{c.lower().replace(' ', '_')}": arr[i] for i, c in enumerate(classes)}
    return scored.withColumns(cols)


def feature_importance(model, features: Sequence[str], families: Mapping[str, str] | None = None):
    """(feature, importance) ranking and share per family (ML7).  Importances are a
    vector of feature count length: tiny, created on the driver."""
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")
    fams = families or {"lag": "_lag_", "rolling": "_roll", "cyclical": "_(sin|cos)$"}
    fam = None
    for name, pat in fams.items():
        cond = F.col("feature").rlike(pat)
        fam = F.when(cond, F.lit(name)) if fam is None else fam.when(cond, F.lit(name))
    df = df.withColumn("family", fam.otherwise(F.lit("other")))
    share = df.groupBy("family").agg(F.sum("importance").alias("share"))
    return df.orderBy(F.col("importance").desc(), "feature"), share


# ------------------------------------------------------------------ metrics

def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R^2 over rows with both values (ML2)."""
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    g = d.groupBy(*by) if by else d
    e = F.col(y) - F.col(p)
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                 (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"))


def confusion(df: DataFrame, y: str, p: str, classes: Sequence[str]) -> DataFrame:
    """label x prediction counts with every class as a column (ML6)."""
    c = df.groupBy(y).pivot(p, list(classes)).count().na.fill(0, subset=list(classes))
    return c.select(y, *[F.col(f"`{k}`").cast("long").alias(k) for k in classes])


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per class precision, recall, F1, support, plus overall accuracy (ML6, ML18)."""
    tp = df.groupBy(F.col(y).alias("cls")).agg(F.count(F.lit(1)).alias("support"),
                                               F.count_if(F.col(y) == F.col(p)).alias("tp"))
    pr = df.groupBy(F.col(p).alias("cls")).agg(F.count(F.lit(1)).alias("predicted"))
    acc = df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))
    r = tp.join(pr, "cls", "full").na.fill(0, ["support", "tp", "predicted"])
    prec = F.try_divide(F.col("tp"), F.col("predicted"))
    rec = F.try_divide(F.col("tp"), F.col("support"))
    r = r.select("cls", prec.alias("precision"), rec.alias("recall"),
                 F.try_divide(2 * prec * rec, prec + rec).alias("f1"), F.col("support").cast("long").alias("support"))
    return attach_params(r, acc)


# ------------------------------------------------------------------ forecast frames

def threshold_adjust(probs: Sequence[str], weights: Sequence[float], classes: Sequence[str]) -> Column:
    """Weighted, renormalised probabilities -> arg-max class (ML13)."""
    ws = [F.col(c) * F.lit(float(w)) for c, w in zip(probs, weights)]
    tot = ws[0]
    for x in ws[1:]:
        tot = tot + x
    cand = F.array(*[F.struct(F.try_divide(x, tot).alias("p"), F.lit(-i).alias("o"), F.lit(k).alias("c"))
                     for i, (x, k) in enumerate(zip(ws, classes))])
    return F.array_max(cand)["c"]


def soft_vote(prob_sets: Sequence[Sequence[str]]) -> list[Column]:
    """Average aligned probability columns of several models (ML15)."""
    k = len(prob_sets)
    out = []
    for cols in zip(*prob_sets):
        s = F.col(cols[0])
        for c in cols[1:]:
            s = s + F.col(c)
        out.append(s / F.lit(float(k)))
    return out


def fit_voters(train: DataFrame, features: Sequence[str], label: str, classes: Sequence[str], weight: str | None = "weight",
               boosted: Mapping | None = None, trees: int = 100) -> dict:
    """Three fitted classifiers of one label (ML15): boosted trees per class, a forest and a logistic model."""
    number = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    x = train.withColumn("_label", number[F.col(label)]).where(F.col("_label").isNotNull())
    logistic = LogisticRegression(featuresCol="features", labelCol="_label", weightCol=weight, regParam=0.01)
    return {"boosted": fit_boosted_classes(train, features, label, classes, weight, **(boosted or {})),
            "forest": fit_classifier(x, features, "_label", weight, numTrees=trees),
            "logistic": Pipeline(stages=[assemble(features), logistic]).fit(x)}


def vote(df: DataFrame, voters: Mapping[str, object], classes: Sequence[str], prefix: str = "prob_", out: str = "predicted") -> DataFrame:
    """``prob_<class>``: the mean of the three models' probabilities, and the likeliest class (ML15, ML17).

    Probabilities of each model stay as ``<model>_prob_<class>``."""
    names = [f"{prefix}{c.lower().replace(' ', '_')}" for c in classes]
    x, kept = df, list(df.columns)
    sets = []
    for m, model in voters.items():
        own = [f"{m}_{n}" for n in names]
        if m == "boosted":
            x = boosted_probabilities(x, model, f"{m}_{prefix}", "_voted").drop("_voted")
        else:
            x = model.transform(x)
            x = x.select(*kept, *[F.coalesce(F.get(vector_to_array("probability"), F.lit(i)), F.lit(0.0)).alias(n)
                                  for i, n in enumerate(own)])  # a class beyond those trained on has no chance
        kept, sets = x.columns, [*sets, own]
    x = x.select("*", *[c.alias(n) for c, n in zip(soft_vote(sets), names)])
    return x.withColumn(out, attach_category(names, list(classes))[0])


def attach_category(probs: Sequence[str], classes: Sequence[str]) -> tuple[Column, Column]:
    """(predicted category, confidence = max probability) (ML16)."""
    cand = F.array(*[F.struct(F.col(c).alias("p"), F.lit(-i).alias("o"), F.lit(k).alias("c"))
                     for i, (c, k) in enumerate(zip(probs, classes))])
    best = F.array_max(cand)
    return best["c"], best["p"]


def drift_correct(pred: Column, day_index: Column, target_mean: Column, draw: Column | None = None,
                  target_std: Column | None = None) -> Column:
    """Pull towards the historical mean by ``min(0.1 + 0.005 i, 0.3)``; day 0 untouched (ML11).

    With ``draw`` (a standard draw per row, see ``windows.hash_draws``) and the historical standard deviation,
    noise of a tenth of it is added, on day 0 of a twentieth."""
    a = F.least(F.lit(0.1) + F.lit(0.005) * day_index, F.lit(0.3))
    moved = F.when(day_index == 0, pred).otherwise(pred + a * (target_mean - pred))
    if draw is None:
        return moved
    return moved + draw * target_std * F.when(day_index == 0, F.lit(0.05)).otherwise(F.lit(0.1))


def ar1_forecast(history: DataFrame, horizon_dates: DataFrame, col: str, station: str = "station",
                 date: str = "date", min_points: int = 10, frame: SeriesFrame = STATION_DATE) -> DataFrame:
    """AR(1) on first differences per series with a fallback ladder (ML12).

    d_t = a + b d_{t-1} fitted by ``regr_intercept`` / ``regr_slope``; the h-step
    level is ``last + sum_{j<=h} d_j`` in closed form.  No history -> global
    mean; fewer than ``min_points`` values -> series mean; degenerate fit
    (NULL slope, |b| >= 1) -> mean of the last 10 values.
    """
    h = history.select(station, date, col).where(F.col(col).isNotNull())
    d = bounded(h, frame, lambda w: {"_d": F.col(col) - F.lag(col, 1).over(w)}, before=1)
    d = bounded(d, frame, lambda w: {"_dp": F.lag("_d", 1).over(w)}, before=1)
    fit = d.groupBy(station).agg(
        F.regr_slope("_d", "_dp").alias("_b"), F.regr_intercept("_d", "_dp").alias("_a"),
        F.count(col).alias("_n"), F.avg(col).alias("_mean"),
        F.max_by(F.col(col), F.col(date)).alias("_last"), F.max(date).alias("_t0"),
        F.max_by(F.col("_d"), F.col(date)).alias("_d0"))
    from .windows import last_rows
    last10 = last_rows(h, 10, frame).groupBy(station).agg(F.avg(col).alias("_m10"))
    glob = h.agg(F.avg(col).alias("_g"))
    j = attach_params(horizon_dates.join(fit, station, "left").join(last10, station, "left"), glob)
    hh = F.datediff(F.col(date), F.col("_t0")).cast("double")
    a, b, d0 = F.col("_a"), F.col("_b"), F.coalesce(F.col("_d0"), F.lit(0.0))
    bh = F.pow(b, hh)
    geo = F.try_divide(F.lit(1.0) - bh, F.lit(1.0) - b)           # sum_{j=0}^{h-1} b^j
    s = a * F.try_divide(hh - b * geo, F.lit(1.0) - b) + d0 * b * geo
    ok = b.isNotNull() & (F.abs(b) < 1)
    val = (F.when(F.col("_n").isNull(), F.col("_g"))
            .when(F.col("_n") < min_points, F.col("_mean"))
            .when(~ok, F.col("_m10"))
            .otherwise(F.col("_last") + s))
    method = (F.when(F.col("_n").isNull(), "global_mean").when(F.col("_n") < min_points, "series_mean")
               .when(~ok, "last10_mean").otherwise("ar1"))
    return j.select(*horizon_dates.columns, val.alias(col), method.alias("method"))


def fill_features(train: DataFrame, others: Sequence[DataFrame], features: Sequence[str]):
    """Training medians fill NULL features in train and in the other frames (IMP3 before ML1/ML3)."""
    from .impute import apply_medians, fit_medians
    med = fit_medians(train, features)
    return [apply_medians(x, med, features, default=0.0) for x in [train, *others]]


def oversample_minority(df: DataFrame, features: Sequence[str], label: str, minority: str, needed: int,
                        k: int = 2, seed: int = 42) -> DataFrame:
    """Exactly ``needed`` synthetic minority rows ``a + u (b - a)`` between a row and one
    of its k nearest same-class neighbours (ML14).

    Neighbours are exact (:mod:`neighbours`).  Every minority row gets
    ``needed // n`` copies and the rows under an exact hash cut (``kth_smallest``)
    one more, so the count is exact without a limit; copy r of a row uses its
    ``(r mod k')``-th neighbour.  A row that is alone in its class pairs with itself.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # unique row ids, fixed once by a checkpoint so every later read sees the same ids
    m = df.where(F.col(label) == minority).withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    n_min = m.count()
    if needed <= 0 or n_min == 0:
        return df.limit(0).select(*features, label)
    nb = nearest_neighbours(m, "_id", features, k)
    nb = nb.groupBy("_a").agg(F.sort_array(F.collect_list(F.struct("_nr", "_b"))).alias("_nbs"))
    base, extra = divmod(needed, n_min)
    rows = m.select(F.col("_id").alias("_a"), *features).withColumn("_hh", F.xxhash64("_a", F.lit(seed + 1)))
    if extra:
        cut = kth_smallest(rows, "_hh", [], extra, out="_cut")
        rows = attach_params(rows, cut).withColumn("_reps", F.lit(base) + (F.col("_hh") <= F.col("_cut")).cast("int"))
    else:
        rows = rows.withColumn("_reps", F.lit(base))
    rows = rows.where(F.col("_reps") > 0).join(nb, "_a", "left")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_reps") - 1)).alias("_rep"))
    pick = F.when(F.size("_nbs") > 0, F.get(F.col("_nbs"), F.col("_rep") % F.size("_nbs"))["_b"]).otherwise(F.col("_a"))
    rows = rows.withColumn("_b", pick)
    other = m.select(F.col("_id").alias("_b"), *[F.col(f).alias(f"_o_{f}") for f in features]).dropDuplicates(["_b"])
    j = rows.join(other, "_b", "left")
    u = (F.abs(F.xxhash64("_a", "_b", "_rep", F.lit(seed))) % 1_000_000) / F.lit(1_000_000.0)
    return j.select(*[(F.col(f) + u * (F.coalesce(F.col(f"_o_{f}"), F.col(f)) - F.col(f))).alias(f) for f in features],
                    F.lit(minority).alias(label))
