"""Scores of a selection against the truth: precision-weighted F per anchor, ceilings, losses, comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(k: Column, t: Column, m: Column) -> Column:
    """F0.5 of k predicted with t true among them and m truths in all: 5t / (4k + m). No truths: 1 if nothing is predicted, else 0."""
    return F.when(m == 0, (k == 0).cast("double")).when(t > 0, 5.0 * t / (4 * k + m)).otherwise(0.0)


def truth_counts(s1: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per anchor: m truths, r of them among the candidates."""
    m = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("m"))
    r = truth.join(candidates.select("s1", "cand").distinct(), ["s1", "cand"], "left_semi").groupBy("s1").agg(F.count(F.lit(1)).alias("r"))
    return s1.select("s1", "country").join(m, "s1", "left").join(r, "s1", "left").fillna(0, ["m", "r"])


def row_scores(selected: DataFrame, truth: DataFrame) -> DataFrame:
    """truth (s1, m, ...) with k, t and the score f. selected: (s1, cand, label)."""
    a = selected.groupBy("s1").agg(F.count(F.lit(1)).alias("k"), F.sum("label").cast("long").alias("t"))
    return truth.join(a, "s1", "left").fillna(0, ["k", "t"]).withColumn("f", f05(F.col("k"), F.col("t"), F.col("m")))


def report(scores: DataFrame) -> DataFrame:
    """Macro and micro figures and the decomposition of the loss, over all, per country and per number of truths (0 to 3, 4+), by grouping sets.

    scores: (s1, country, m, r, k, t, f). mb and country are null in the rows that sum over them.
    """
    k, t, m, r = (F.col(c) for c in "ktmr")
    x = scores.withColumns({"mb": F.when(m >= 4, "4+").otherwise(m.cast("string")), "ceiling": f05(r, r, m), "clean": f05(t, t, m)})
    # An anchor whose truths are all unpredicted has nothing true to keep.
    x = x.withColumn("clean", F.when(m == 0, 1.0).otherwise(F.col("clean"))).withColumn("ceiling", F.when(m == 0, 1.0).otherwise(F.col("ceiling")))
    out = x.groupingSets([["country"], ["mb"], []], "country", "mb").agg(
        F.count(F.lit(1)).alias("n"), F.avg("f").alias("macro_f05"), F.avg(F.when(k > 0, t / k).otherwise(1.0)).alias("macro_precision"),
        F.avg(F.when(m > 0, t / m).otherwise((k == 0).cast("double"))).alias("macro_recall"), (F.sum(t) / F.greatest(F.sum(k), F.lit(1))).alias("micro_precision"),
        (F.sum(t) / F.greatest(F.sum(m), F.lit(1))).alias("micro_recall"), F.avg((k > 0).cast("int")).alias("frac_nonempty"), F.avg(k).alias("matches_per_s1"),
        F.avg("ceiling").alias("oracle_ceiling"), (1 - F.avg("ceiling")).alias("loss_not_in_candidates"), (F.avg("ceiling") - F.avg("clean")).alias("loss_below_threshold"),
        (F.avg("clean") - F.avg("f")).alias("loss_false_positives"),
    )
    return out


def ceiling(counts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best score that the candidates allow, recall, and candidates per anchor (mean, 95th percentile, most)."""
    n = candidates.groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    x = counts.join(n, "s1", "left").fillna(0, ["n"])
    m, r = F.col("m"), F.col("r")
    return x.agg(
        F.avg(F.when(m == 0, 1.0).otherwise(f05(r, r, m))).alias("oracle"), (F.sum(r) / F.sum(m)).alias("recall"), F.avg("n").alias("mean_n"),
        F.percentile("n", F.lit(0.95)).alias("p95_n"), F.max("n").alias("max_n"),
    )


def compare(new: DataFrame, old: DataFrame, truth: DataFrame) -> DataFrame:
    """Per country: mean change of the score, anchors better and worse, pairs added and removed (true and false)."""
    a, b = row_scores(new, truth).select("s1", "country", F.col("f").alias("f_new")), row_scores(old, truth).select("s1", F.col("f").alias("f_old"))
    x = a.join(b, "s1").groupBy("country").agg(
        F.round(F.avg(F.col("f_new") - F.col("f_old")), 9).alias("delta"), F.count_if(F.col("f_new") > F.col("f_old")).alias("improved"), F.count_if(F.col("f_new") < F.col("f_old")).alias("harmed")
    )
    both = ["s1", "cand"]
    moved = new.join(old, both, "left_anti").withColumn("side", F.lit("added")).unionByName(old.join(new, both, "left_anti").withColumn("side", F.lit("removed")), allowMissingColumns=True)
    per = moved.join(truth.select("s1", "country").withColumnRenamed("country", "_c"), "s1").groupBy(F.col("_c").alias("country")).agg(
        *[F.count_if((F.col("side") == s) & (F.col("label") == v)).alias(f"{s}_{n}") for s in ("added", "removed") for v, n in ((1, "true"), (0, "false"))]
    )
    return x.join(per, "country", "left").fillna(0)


def votes(models: list[DataFrame]) -> DataFrame:
    """How many pairs are selected by exactly n of the models, and by which (signature)."""
    tagged = None
    for i, m in enumerate(models):
        t = m.select("s1", "cand", F.lit(i).alias("i"))
        tagged = t if tagged is None else tagged.union(t)
    each = tagged.groupBy("s1", "cand").agg(F.array_join(F.array_sort(F.collect_set("i")), "").alias("signature"), F.countDistinct("i").alias("n_models"))
    return each.groupBy("n_models", "signature").agg(F.count(F.lit(1)).alias("pairs"))


def mirror_estimate(patterns: DataFrame) -> DataFrame:
    """Per family: records at +k and at the mirror -k; the estimated share of decoys at +k, and its bounds from Jeffreys' interval of the mirror's share."""
    g = patterns.groupBy("family").agg(F.count_if(F.col("k") > 0).alias("n_plus"), F.count_if(F.col("k") < 0).alias("n_minus"))
    share = F.greatest(F.lit(0.0), 1 - F.col("n_minus") / F.col("n_plus"))
    p = (F.col("n_minus") + 0.5) / (F.col("n_plus") + F.col("n_minus") + 1)
    half = 1.96 * F.sqrt(p * (1 - p) / (F.col("n_plus") + F.col("n_minus") + 2))
    return g.withColumns({"decoy_share": F.when(F.col("n_plus") > 0, share), "p_low": F.greatest(F.lit(0.0), p - half), "p_high": F.least(F.lit(1.0), p + half)})


def removal_value(k: Column, probabilities: Column, p: Column, extra: Column) -> Column:
    """Expected change of an anchor's score if one of its k selected pairs (of probability p) is removed.

    probabilities: of the other selected pairs. Their number of true ones is distributed by an exact recursion over the
    array (Poisson-binomial); extra: expected truths that are not selected.
    """
    start = F.array(F.lit(1.0))
    dist = F.aggregate(
        probabilities, start,
        lambda d, q: F.zip_with(F.concat(F.transform(d, lambda x: x * (1 - q)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(d, lambda x: x * q)), lambda a, b: a + b),
    )
    # kk pairs predicted, `hit` more true ones than the others' t; the scores of every t, weighted by its probability.
    score = lambda t, kk, hit: F.when(t + hit + extra <= 0, (kk == 0).cast("double")).otherwise(5.0 * t / (4 * kk + t + hit + extra))
    value = lambda kk, own, hit: F.aggregate(F.transform(dist, lambda x, t: x * score(t + own, kk, hit)), F.lit(0.0), lambda a, b: a + b)
    before = p * value(k, 1, 0) + (1 - p) * value(k, 0, 0)
    after = p * value(k - 1, 0, 1) + (1 - p) * value(k - 1, 0, 0)
    return after - before


def acceptance(selected: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each named set of pairs (set, s1, cand): how many there are, how many the selection takes, and the share."""
    mark = selected.select("s1", "cand", F.lit(1).alias("_in")).distinct()
    return sets.join(mark, ["s1", "cand"], "left").groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("accepted"), F.round(F.count("_in") / F.count(F.lit(1)), 6).alias("share"))


def match_profile(selected: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per country: anchors, matches, matches per anchor, share of empty anchors, records with several owners and their pairs."""
    k = selected.groupBy("s1").agg(F.count(F.lit(1)).alias("k"))
    per = anchors.select("s1", "country").join(k, "s1", "left").fillna(0, ["k"])
    owners = selected.join(anchors.select("s1", "country"), "s1").groupBy("country", "cand").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = owners.groupBy("country").agg(F.count(F.lit(1)).alias("multi_assigned_records"), F.sum("n").alias("multi_pairs"))
    out = per.groupBy("country").agg(F.count(F.lit(1)).alias("n_s1"), F.sum("k").alias("matches"), F.round(F.avg("k"), 6).alias("matches_per_s1"), F.round(F.avg((F.col("k") == 0).cast("int")), 6).alias("empty_share"))
    return out.join(several, "country", "left").fillna(0, ["multi_assigned_records", "multi_pairs"])


def band_share(pairs: DataFrame, low: float = 0.02, high: float = 0.99) -> DataFrame:
    """Per country: pairs, those with a score strictly between the bounds, and their share."""
    band = (F.col("p") > low) & (F.col("p") < high)
    return pairs.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_if(band).alias("n_band"), F.round(F.avg(band.cast("int")), 6).alias("band_share"))


def bootstrap_sums(deltas: DataFrame, rounds: int, group: str = "s1") -> DataFrame:
    """Per round the resampled mean of delta: every group (an anchor, or a cluster of them) is drawn 0 to 6 times, by the quantiles of Poisson(1) at a hash of group and round.

    A group is drawn whole, and alike in every table that is resampled in the same rounds, so differences are paired.
    Groups are summed first; each is exploded to the rounds and the sums are merged before the shuffle.
    """
    per = deltas.groupBy(group).agg(F.sum("delta").alias("d"), F.count(F.lit(1)).alias("n"))
    at = F.conv(F.substring(F.md5(F.concat_ws("/", F.col(group).cast("string"), F.col("round").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    times, below = F.lit(0), 0.0
    for k in range(6):
        below += math.exp(-1) / math.factorial(k)
        times = times + F.when(at >= round(below, 9), 1).otherwise(0)
    drawn = per.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("times", times)
    return drawn.groupBy("round").agg(F.round(F.sum(F.col("d") * F.col("times")) / F.sum(F.col("n") * F.col("times")), 9).alias("mean"))


def bootstrap(deltas: DataFrame, rounds: int = 1000, seed: int = 7) -> tuple[float, float, float]:
    """Mean of delta over anchors, with its 95 % interval, from multinomial draws.

    Equal deltas are summed first, so what reaches the driver is one row per distinct (rounded) value.
    """
    import numpy as np

    rows = deltas.groupBy(F.round("delta", 6).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    d, n = np.array([r["d"] for r in rows]), np.array([r["n"] for r in rows])
    total = int(n.sum())
    means = np.random.default_rng(seed).multinomial(total, n / total, rounds) @ d / total
    return float(d @ n / total), *(float(x) for x in np.quantile(means, (0.025, 0.975)))


def poisson_interval(n: int, z: float = 1.96) -> tuple[float, float]:
    """Bounds of a Poisson mean (Wilson and Hilferty)."""
    low = 0.0 if n == 0 else n * (1 - 1 / (9 * n) - z / (3 * math.sqrt(n))) ** 3
    return low, (n + 1) * (1 - 1 / (9 * (n + 1)) + z / (3 * math.sqrt(n + 1))) ** 3
