"""Learned scores: cross-fitted boosted trees, logit blends, agreement of seeds, ranking metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import expit, logit
from .keys import bucket, crc_fold, exact_quantiles, finite, running

CLIP = 13.8


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Trees take no NaN: missing values become a sentinel beside an indicator."""
    ready = df.select("*", *[finite(F.col(c).cast("double"), -999.0).alias(f"_f_{c}") for c in features], *[F.col(c).isNull().cast("double").alias(f"_m_{c}") for c in features])
    made = [f"_{k}_{c}" for c in features for k in "fm"]
    return VectorAssembler(inputCols=made, outputCol="_x").transform(ready).drop(*made)


def cross_fit(df: DataFrame, features: Sequence[str], label: str, fold: str, weight: str | None = None, folds: int = 2, rounds: int = 20, depth: int = 4, out: str = "p1") -> DataFrame:
    """Out-of-fold probabilities: each row is scored by the models that haven't seen its fold, their mean.

    A row whose fold is null (not in the sample) gets the mean of all. The early-stopping rows are those with es = true.
    """
    x = _vectors(df, features).withColumn("_y", F.col(label).cast("double"))
    x = x.withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))
    scored = x
    for i in range(folds):
        train = x.filter((F.col(fold) == i) & F.col("_y").isNotNull())
        kw = {"validationIndicatorCol": "es"} if "es" in df.columns else {}
        model = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=depth, seed=7, predictionCol=f"_p{i}", **kw).fit(train)
        model.setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_q{i}")
        scored = model.transform(scored).withColumn(f"_q{i}", vector_to_array(f"_q{i}")[1])
    return scored.withColumn(out, out_of_fold([F.col(f"_q{i}") for i in range(folds)], F.col(fold))).drop("_x", "_y", "_w", *[f"_{k}{i}" for i in range(folds) for k in "prq"])


def out_of_fold(models: list[Column], fold: Column) -> Column:
    """Mean of the models that haven't seen the row's fold; of all of them where it has none."""
    total = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    out = None
    for i in range(len(models)):
        rest = [m for j, m in enumerate(models) if j != i]
        out = F.when(fold == i, total(rest)) if out is None else out.when(fold == i, total(rest))
    return out.otherwise(total(models))


def balanced_weights(prefixes: DataFrame, by: str = "s1", name: str = "weight") -> DataFrame:
    """Every anchor's rows weigh 1 together, so that anchors with long lists count no more than others."""
    return prefixes.withColumn(name, 1.0 / F.count(F.lit(1)).over(Window.partitionBy(by)))


def group_folds(df: DataFrame, group: str, folds: int = 3, prefix: str = "name:", name: str = "fold") -> DataFrame:
    """Rows that share a group (a name, say) share a fold, so that no fold is scored by a model that has seen its names."""
    return df.withColumn(name, crc_fold(F.col(group), folds, prefix))


def keep_negatives(df: DataFrame, key: Column, lexical: Column, label: str = "label", share: float = 0.25) -> DataFrame:
    """Lexical-only negatives thinned to the share by key hash and weighted up for it; everything else weighs 1."""
    n = round(1 / share)
    thin = lexical & (F.col(label) == 0)
    return df.filter(~thin | (bucket(key, n, "neg") == 0)).withColumn("weight", F.when(thin, float(n)).otherwise(1.0))


def hybrid(first: Column, second: Column, use_first: Column) -> Column:
    """Two models by provenance."""
    return F.when(use_first, first).otherwise(second)


def anchored_blend(anchor: Column, corrected: Sequence[tuple[Column, Column, float]]) -> Column:
    """expit of the anchor's logit plus, for each (better, base, share), share * (logit(better) - logit(base)), clipped."""
    z = logit(anchor)
    for better, base, share in corrected:
        z = z + share * (logit(better) - logit(base))
    return expit(F.least(F.greatest(z, F.lit(-CLIP)), F.lit(CLIP)))


def agreement_features(scores: Sequence[Column], anchor: Column) -> dict[str, Column]:
    """Logits of several models: each (as an array), spread, standard deviation, votes above 0.5, distance of the anchor from their mean, whether any is missing."""
    zs = F.array(*[logit(s) for s in scores])
    known = F.filter(zs, lambda z: z.isNotNull())
    n = F.size(known)
    mean = F.aggregate(known, F.lit(0.0), lambda s, z: s + z) / n
    var = F.aggregate(known, F.lit(0.0), lambda s, z: s + (z - mean) * (z - mean)) / n
    return {
        "z": zs, "z_spread": F.array_max(known) - F.array_min(known), "z_std": F.sqrt(var), "vote05": F.size(F.filter(known, lambda z: z > 0)), "anchor_z": logit(anchor),
        "missing_gate": (n < len(scores)).cast("int"), "anchor_vs_mean": logit(anchor) - mean,
    }


def seed_mean(anchor: Column, seeds: Sequence[Column], gate: Column, share: float = 1.0) -> Column:
    """The anchor moved by the seeds' mean change in logits, where the gate holds."""
    mean = sum((logit(s) for s in seeds[1:]), logit(seeds[0])) / len(seeds)
    return F.when(gate, expit(logit(anchor) + share * (mean - logit(anchor)))).otherwise(anchor)


def seed_consensus(selections: Sequence[DataFrame], base: DataFrame, how: str = "unanimous") -> DataFrame:
    """Per anchor the set that all seeds (or most of them) select, else the base's set: (s1, cands)."""
    sign = lambda d: d.groupBy("s1").agg(F.array_sort(F.collect_set("cand")).alias("cands"))
    tagged = None
    for i, s in enumerate(selections):
        t = sign(s).withColumn("i", F.lit(i))
        tagged = t if tagged is None else tagged.union(t)
    n = tagged.groupBy("s1", "cands").agg(F.count(F.lit(1)).alias("n"))
    need = len(selections) if how == "unanimous" else len(selections) // 2 + 1
    agreed = n.filter(F.col("n") >= need).select("s1", F.col("cands").alias("new"))
    return sign(base).join(agreed, "s1", "full").select("s1", F.coalesce("new", "cands").alias("cands"))


def residual_boost(df: DataFrame, features: Sequence[str], label: str, p: str, rounds: int = 3, depth: int = 3, rate: float = 0.3, out: str = "p3") -> DataFrame:
    """Boosting from given scores: small trees are fitted one after the other to the residual of the current probability, in logit space."""
    from pyspark.ml.regression import DecisionTreeRegressor

    x = _vectors(df, features).withColumn("_z", logit(F.col(p)))
    models = []
    for i in range(rounds):
        q = expit(F.col("_z"))
        step = x.withColumns({"_g": (F.col(label) - q) / F.greatest(q * (1 - q), F.lit(1e-3)), "_h": F.greatest(q * (1 - q), F.lit(1e-3))})
        models.append(DecisionTreeRegressor(featuresCol="_x", labelCol="_g", weightCol="_h", maxDepth=depth, seed=7, predictionCol=f"_s{i}").fit(step))
        x = models[-1].transform(x).withColumn("_z", F.col("_z") + rate * F.col(f"_s{i}")).drop(f"_s{i}")
    return x.withColumn(out, expit(F.col("_z"))).drop("_x", "_z")


def platt(df: DataFrame, scores: Sequence[str], label: str, out: str = "p") -> DataFrame:
    """Logistic regression on the logits of the scores."""
    x = VectorAssembler(inputCols=[f"_z_{s}" for s in scores], outputCol="_x").transform(df.select("*", *[logit(F.col(s)).alias(f"_z_{s}") for s in scores]).withColumn("_y", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_q", rawPredictionCol="_r", predictionCol="_p").fit(x)
    return model.transform(x).withColumn(out, vector_to_array("_q")[1]).drop("_x", "_y", "_q", "_r", "_p", *[f"_z_{s}" for s in scores])


def simplex_blend(df: DataFrame, scores: Sequence[str], label: str, grid: int = 10) -> dict[str, float]:
    """Weights on the simplex (in steps of 1 / grid) whose blended logits have the least log loss: all weights are summed in one pass."""
    from itertools import product

    weights = [w for w in product(range(grid + 1), repeat=len(scores)) if sum(w) == grid]
    y = F.col(label)
    losses = []
    for k, w in enumerate(weights):
        p = expit(sum((F.lit(v / grid) * logit(F.col(s)) for v, s in zip(w, scores)), F.lit(0.0)))
        losses.append(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias(str(k)))
    row = df.agg(*losses).first()
    best = min(range(len(weights)), key=lambda k: (row[k], k))
    return {s: v / grid for s, v in zip(scores, weights[best])}


def simplex_fit(df: DataFrame, scores: Sequence[str], label: str, rounds: int = 20, step: float = 2.0) -> dict[str, float]:
    """As simplex_blend, to any weights: exponentiated gradient from the coarse grid's best. Each round is one pass that sums loss and gradient; a step that does not help is halved."""
    y, zs = F.col(label), [logit(F.col(s)) for s in scores]
    # Nothing is lost to start with: a weight of 0 could never grow again.
    start = simplex_blend(df, scores, label, 4)
    best = [max(start[s], 0.02) for s in scores]
    best = [w / sum(best) for w in best]

    def measure(w: list[float]) -> tuple[float, list[float]]:
        p = expit(sum((F.lit(v) * z for v, z in zip(w, zs)), F.lit(0.0)))
        loss = F.avg(-(y * F.ln(F.greatest(p, F.lit(1e-300))) + (1 - y) * F.ln(F.greatest(1 - p, F.lit(1e-300)))))
        row = df.agg(loss.alias("l"), *[F.avg((p - y) * z).alias(f"g{k}") for k, z in enumerate(zs)]).first()
        return row["l"], [row[f"g{k}"] for k in range(len(zs))]

    coarse, _ = measure(list(start.values()))
    loss, gradient = measure(best)
    for _ in range(rounds):
        low = min(gradient)
        moved = [w * math.exp(-step * (g - low)) for w, g in zip(best, gradient)]
        tried = [w / sum(moved) for w in moved]
        new_loss, new_gradient = measure(tried)
        if new_loss < loss:
            best, loss, gradient = tried, new_loss, new_gradient
        else:
            step /= 2
    return dict(zip(scores, best)) if loss < coarse else start


def prefix_model(prefixes: DataFrame, features: Sequence[str], target: str, out: str = "utility", rounds: int = 20, depth: int = 4, weight: str | None = None) -> DataFrame:
    """Regression of a prefix's score on its statistics (and evidence), applied to the same table; rows may be weighted (see balanced_weights)."""
    x = _vectors(prefixes, features)
    kw = {"weightCol": weight} if weight else {}
    return GBTRegressor(featuresCol="_x", labelCol=target, maxIter=rounds, maxDepth=depth, seed=7, predictionCol=out, **kw).fit(x.filter(F.col(target).isNotNull())).transform(x).drop("_x")


def count_model(anchors: DataFrame, features: Sequence[str], matches: str) -> DataFrame:
    """p_single (no match) by boosted trees and n_expected by Poisson regression."""
    x = _vectors(anchors, features).withColumn("_y", (F.col(matches) == 0).cast("double"))
    single = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=10, maxDepth=3, seed=7, predictionCol="_p").fit(x).setRawPredictionCol("_r").setProbabilityCol("_q")
    n = GeneralizedLinearRegression(featuresCol="_x", labelCol=matches, family="poisson", link="log", regParam=0.1, maxIter=25, predictionCol="n_expected").fit(x)
    return n.transform(single.transform(x)).withColumn("p_single", vector_to_array("_q")[1]).drop("_x", "_y", "_q", "_r", "_p")


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """auc, average precision and log loss, exact, from one row per distinct score: ties share a rank."""
    p, y = F.col(score), F.col(label)
    g = df.groupBy(p.alias("p")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    run = running(g, "p", ["pos", "neg"])
    total = F.broadcast(g.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")))  # one row
    x = run.join(total).withColumns({"nb": F.col("neg_before"), "tp": F.col("all_pos") - F.col("pos_before"), "all": F.col("all_pos") - F.col("pos_before") + F.col("all_neg") - F.col("neg_before")})
    auc = F.sum(F.col("pos") * (F.col("nb") + 0.5 * F.col("neg"))) / (F.sum("pos") * F.sum("neg"))
    q = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.sum(F.col("pos") * F.ln(q) + F.col("neg") * F.ln(1 - q)) / F.sum(F.col("pos") + F.col("neg"))
    return x.agg(auc.alias("auc"), (F.sum(F.col("pos") * F.col("tp") / F.col("all")) / F.sum("pos")).alias("ap"), loss.alias("logloss"))


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by gain; an indicator's gain counts for its feature."""
    v = model.featureImportances.toArray()
    return sorted(((f, float(v[2 * i] + v[2 * i + 1])) for i, f in enumerate(features)), key=lambda x: -x[1])


def specialist_features(pairs: DataFrame, anchors: DataFrame, forms: Sequence[str]) -> DataFrame:
    """Shared core words, anchors with the record's full name, equality and emptiness flags, one flag per legal form. pairs: with name and address views of both sides (_1, _2)."""
    full = anchors.groupBy(F.col("name_n").alias("name_n_2")).agg(F.count(F.lit(1)).alias("full_form_s1_count"))
    out = pairs.join(full, "name_n_2", "left").fillna(0, ["full_form_s1_count"])
    split = lambda c: F.split(F.col(c), " ")
    flags = {f"has_{f}": F.array_contains(split("name_n_2"), f).cast("int") for f in forms}
    return out.withColumns({
        "n_core_shared": F.size(F.array_intersect(split("name_core_1"), split("name_core_2"))), "core_eq": (F.col("name_core_1") == F.col("name_core_2")).cast("int"),
        "addr_eq": (F.col("addr_n_1") == F.col("addr_n_2")).cast("int"), "addr_empty_2": (F.col("addr_n_2") == "").cast("int"), "india": (F.col("country") == "India").cast("int"), **flags,
    })


def quantile_map(source: DataFrame, reference: DataFrame, col: str, points: int = 101, keep_zero: bool = False) -> tuple[list[float], list[float]]:
    """Quantiles of the column in both tables: the map that carries one distribution onto the other. NaN and null are ignored, zeros too if they are to be kept."""
    def table(df: DataFrame) -> list[float]:
        x = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
        return exact_quantiles(x.filter(F.col(col) != 0) if keep_zero else x, col, [i / (points - 1) for i in range(points)])

    return table(source), table(reference)


def apply_quantile_map(x: Column, table: tuple[list[float], list[float]], keep_zero: bool = False) -> Column:
    """Linear between the quantiles, flat beyond them; null and NaN (and zero, if kept) stay."""
    src, ref = table
    if not src or not ref:
        return x
    s, r = (F.array(*[F.lit(float(v)) for v in t]) for t in (src, ref))
    k = F.size(F.filter(s, lambda v: v <= x))  # quantiles up to x
    lo, hi, a, b = F.element_at(s, k), F.element_at(s, k + 1), F.element_at(r, k), F.element_at(r, k + 1)
    inside = F.when(hi > lo, a + (b - a) * (x - lo) / (hi - lo)).otherwise(a)
    out = F.when(x.isNull() | F.isnan(x), x).when(x < src[0], F.lit(float(ref[0]))).when(x >= src[-1], F.lit(float(ref[-1]))).otherwise(inside)
    return F.when(x == 0, x).otherwise(out) if keep_zero else out
